"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A text is split by the pattern of the vocabulary. A piece's bytes are mapped to Latin-1 and go once through an
Aho-Corasick automaton of all tokens, which gives the longest token at every position. From left to right the
longest token that fits is taken, else its longest prefix that is a token, else the token before is taken back.
Two tokens fit side by side if the merges of their joint bytes give exactly these two; that is looked up in a
memo. A position from which nothing fitted is not entered again, so time is linear in the bytes. A sequence in
which all neighbours fit is the one that the merges give.

Null texts are empty and have no ids; bytes that are not UTF-8 are read as U+FFFD. Repeated rows, ties and
further columns of any name pass, as these are functions of one column. Empty tables give empty tables.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, small_batches, table

#: Bounds of the memos; results do not depend on them.
KEPT, KEPT_CHARS, PAIRS = 250_000, 48, 1_000_000
NEVER = 2**62

# Letters and digits of Unicode 17 and later, which the reference encoder's Unicode 16 does not have.
LATER = "".join(
    f"{chr(a)}-{chr(b)}"
    for a, b in (
        *((0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF)),
        *((0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF)),
        *((0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1)),
        *((0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF)),
        *((0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168)),
        *((0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2)),
        *((0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E)),
        *((0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F)),
    )
)
_LATER = re.compile(f"[{LATER}]")
#: Runs that the pattern of the query splits one by one, as its pieces cross no border of them: what is no blank, with one space before it; blanks.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = rf" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
#: A code point that is neither letter nor digit nor blank in any version.
_NEITHER = "￿"


class Codec:
    """Encoder and decoder of one vocabulary: `ranks` maps the bytes of a token to its id, which is the order of merges.

    runs: a pattern whose matches cover a text and that the pieces of `pattern` do not cross; the ids of short runs are kept in a memo."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, runs: str | None = None):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.sizes = {i: len(t) for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.runs = re.compile(runs or r"(?s).+")
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (i, len(t) - 1))
        self.automaton.make_automaton()
        self.known_runs, self.pieces = Memo(), Memo()
        self.edges: dict[tuple[int, int], list[tuple[bytes, int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}

    def merges(self, data: bytes) -> list[bytes]:
        """The merges themselves, of lowest rank and leftmost first: for the bytes of one token, so of bounded length; stops at two parts."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 2:
            found = ((self.ranks.get(a + b), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            least = min((f for f in found if f[0] is not None), default=None)
            if least is None:
                break
            k = least[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """The parts that lie at the token's left (0) or right (-1) end while it is merged: (bytes, rank at which the part is made, rank at which it goes)."""
        out, goes, t = [], NEVER, self.tokens[token]
        while True:
            made = self.ranks[t] if len(t) > 1 else -1
            out.append((t, made, goes))
            if len(t) == 1:
                return out
            parts = self.merges(t)
            if len(parts) > 2 or parts[side] not in self.ranks:  # merges never make this token: it stands for itself only as a whole piece
                return [(t, NEVER, NEVER)]
            t, goes = parts[side], made

    def fit(self, a: int, b: int) -> bool:
        """Whether the merges leave the two tokens side by side: computed, and kept in the memo.

        They do not if parts at the border meet, while both are there, with a rank that comes before those at which
        they go: the part before the border goes first at equal ranks, as merges run from left to right."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        left = self.edges[a, -1] = self.edges.get((a, -1)) or self.edge(a, -1)
        right = self.edges[b, 0] = self.edges.get((b, 0)) or self.edge(b, 0)
        rank, known = self.ranks.get, True
        for x, x_made, x_goes in left:
            for y, y_made, y_goes in right:
                r = rank(x + y)
                if r is not None and (t := max(r, x_made, y_made)) < x_goes and t <= y_goes:
                    known = False
        known = self.pairs[a << 32 | b] = known and left[0][1] < NEVER and right[0][1] < NEVER
        return known

    def prefix(self, token: int) -> int:
        """The longest proper prefix of a token that is a token, or -1: computed, and kept in the memo."""
        t = self.tokens[token]
        known = self.shorter[token] = next((self.ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ranks), -1)
        return known

    def backtracked(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        n = len(data)
        longest = [-1] * n
        for end, (token, reach) in self.automaton.iter(data.decode("latin-1")):
            longest[end - reach] = token  # ends ascend, so the last at a start is the longest
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token, before = 0, longest[0], -1
        sizes, pairs, shorter = self.sizes, self.pairs, self.shorter
        while True:
            if token < 0:  # nothing fits here: the token before was wrong
                open_[at] = 0
                token = out.pop()
                at -= sizes[token]
                before = out[-1] if out else -1
                token = shorter[token] if token in shorter else self.prefix(token)
                continue
            end = at + sizes[token]
            if open_[end]:
                known = True if before < 0 else pairs.get(before << 32 | token)
                if self.fit(before, token) if known is None else known:
                    out.append(token)
                    if end == n:
                        return out
                    at, before, token = end, token, longest[end]
                    continue
            token = shorter[token] if token in shorter else self.prefix(token)

    def piece(self, piece: str) -> list[int]:
        known = self.pieces.get(piece)
        if known is None:
            data = piece.encode()
            whole = self.ranks.get(data)
            known = self.pieces.put(piece, [whole] if whole is not None else self.backtracked(data))
        return known

    def split(self, text: str) -> list[str]:
        if text.isascii() or _LATER.search(text) is None:
            return self.pattern.findall(text)
        return [text[slice(*m.span())] for m in self.pattern.finditer(_LATER.sub(_NEITHER, text))]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known_runs.newer.get
        for r in self.runs.findall(text):
            if (ids := known(r)) is None and (ids := self.known_runs.get(r)) is None:
                pieces = self.split(r)
                ids = self.known_runs.put(r, self.piece(r) if len(pieces) == 1 else [i for p in pieces for i in self.piece(p)])
                known = self.known_runs.newer.get
            out += ids
        return out


class Memo:
    """Ids of texts of at most KEPT_CHARS: two halves of KEPT entries; when the newer one is full, the older one goes."""

    def __init__(self) -> None:
        self.newer: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def get(self, text: str) -> list[int] | None:
        known = self.newer.get(text)
        if known is None and (known := self.older.get(text)) is not None:
            self.put(text, known)
        return known

    def put(self, text: str, ids: list[int]) -> list[int]:
        if len(text) <= KEPT_CHARS:
            if len(self.newer) >= KEPT:
                self.older, self.newer = self.newer, {}
            self.newer[text] = ids
        return ids


def read_ranks(path: str) -> bytes:
    """The lines of a rank file: base64 of a token, blank, its rank."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(2)
def _codec(key: str, lines: bytes, pattern: str, runs: str | None) -> Codec:  # noqa: ARG001  one codec a Python worker and vocabulary
    return Codec({base64.b64decode(t): int(r) for t, r in map(bytes.split, lines.splitlines()) if t}, pattern, runs)


@lru_cache(2)
def _spelling(key: str, lines: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ARG001
    """(bytes of all tokens, start of each id, length of each id)."""
    tokens = {int(r): base64.b64decode(t) for t, r in map(bytes.split, lines.splitlines()) if t}
    sizes = np.zeros(max(tokens, default=-1) + 1, np.int64)
    sizes[list(tokens)] = [len(t) for t in tokens.values()]
    return np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8), np.cumsum(sizes) - sizes, sizes


def decoded(ids: pa.ListArray, spelling: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Array:
    """The bytes of each list of ids; empty for null."""
    blob, starts, sizes = spelling
    out = []
    for k in range(len(ids)):  # one text at a time, so memory follows the longest
        own = ids[k].values
        i = own.to_numpy(zero_copy_only=False) if own is not None else np.zeros(0, np.int64)
        n = sizes[i]
        out.append(blob[np.repeat(starts[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes() if len(i) else b"")
    return pa.array(out, pa.binary())


class Vocabulary:
    """A vocabulary for Spark: the file is read by the driver and broadcast (its size is that of the file), so executors need no copy of it."""

    def __init__(self, spark: SparkSession, path: str, pattern: str, runs: str | None = None):
        lines = read_ranks(path)
        shared, key = spark.sparkContext.broadcast(lines), hashlib.sha256(lines).hexdigest()
        small_batches(spark)

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            codec, flat, ends = _codec(key, shared.value, pattern, runs), array("i"), [0]
            for t in texts:
                flat.extend(codec.encode(t.as_buffer().to_pybytes().decode(errors="replace")) if t.is_valid else ())
                ends.append(len(flat))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))

        @F.arrow_udf("binary")
        def decode(ids: pa.Array) -> pa.Array:
            return decoded(ids, _spelling(key, shared.value))

        self._encode, self._decode = encode, decode

    def ids(self, text: Column) -> Column:
        """The ids of a text: array<int>, empty for null."""
        return self._encode(text.cast("binary"))

    def bytes(self, ids: Column) -> Column:
        """The bytes of ids: binary, empty for null."""
        return self._decode(ids)


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs with their ids as a last column: `ids`, after underscores where that name is taken."""
    (name,) = apart(docs, "ids")
    return docs.withColumn(name, vocabulary.ids(F.col("text")))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    words = Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, RUNS)
    docs = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), words)
    out = docs.select("doc_id", "ids", words.bytes(F.col("ids")).alias("decoded"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
