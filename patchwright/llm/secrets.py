"""Secret scans: fixed forms, and dictionary-primed zstandard novelty.

Base spans are the three fixed forms. The method looks at the other candidates, runs of MIN_CHARS or more
token characters with a letter and a digit, or mixed case, that have a sensitive word up to REACH characters
before them. Zstandard is primed with an identifier dictionary and the code around the candidate
(CONTEXT characters before and behind it, with it and its copies blanked). Its novelty is the bytes that it adds to the
compressed form of ORDINARY, a fixed run of letters as frequent as in words, over its length, as written or as
lower-case words, whichever is less. Beside ORDINARY a candidate's letters are coded by the frequencies of words at any
length, where alone a short one would be stored as it is. Candidates are measured in even pieces of up to PIECE
characters, each primed with those before it, so one score holds for all lengths and its cost grows with the length.
A candidate of novelty MIN_NOVELTY or more is reported as `novel`. A candidate that overlaps a base
span is not looked at again, nor is an embedded file: base64 of a data URI, or one that begins as a known file format does.

Documents without any such form are recognised by one pattern in the JVM, and their texts never
reach Python.

Defined cases: a null text is empty and has no spans; offsets are code points, the end exclusive;
repeated rows come back as often as they came; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

MIN_CHARS, REACH, CONTEXT, PIECE, MIN_NOVELTY, LEVEL = 16, 48, 256, 40, 0.8, 9
KINDS = ("assign", "access", "hex", "novel")
# The base forms and the words that make a context sensitive.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.ASCII)
HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)
SENSITIVE = re.compile(r"password|passwd|pwd|secret|token|api_?key|access_?key|private_?key|credential|authori[sz]ation|bearer|signature", re.ASCII | re.IGNORECASE)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.ASCII)
#: What a document with any span has; Java and Python read it alike.
HINT = r"(?i)password|passwd|pwd|secret|token|api_?key|access_?key|private_?key|credential|authori[sz]ation|bearer|signature|(?-i)AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
# Identifiers and phrases that code around keys is made of.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 password passwd secret token api_key apikey access_key private_key credential authorization bearer signature "
    "username user_id client_id client_secret session_id request response header content_type application json config settings environment variable example placeholder changeme "
    "your_api_key_here insert_token_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890 test_password default_password get_secret set_password reset_password access_token refresh_token "
    "import from return function class public static final string value const let var null none true false http https localhost example.com index name type data key file path"
).encode()

# Frequent words of code.
WORDS = (
    "about abstract access account action active add address after all any app append apply archive area array async attribute auth auto back base batch begin block body boolean box branch buffer build button byte "
    "cache call cancel change channel char check child class clean clear client clock close cluster code collection color column command common compare complete condition connect context control convert copy core count "
    "create current date debug decode default define delete detail device directory dispatch document download driver element empty enable encode end engine entity entry error event exception execute exit export factory "
    "field filter find first flag folder format frame future generate get global group handler hash height image index input instance item iterator join label language last level library line list load local log long "
    "manager map match message method model module next node number object option order output package page parent parse path process property protocol query queue range read record remove report reset result return role row "
    "search select send server service size sort start state status stream structure table target task test thread time total type update user valid version view wait window worker write"
)
# How base64 of PNG, JPEG, GIF, PDF, ZIP and gzip files begins.
EMBEDDED = ("iVBORw0KGgo", "/9j/", "R0lGOD", "JVBERi0", "UEsDB", "H4sI")
_draw = random.Random(0)
#: The words with their letters in random order, so that the dictionary does not have them.
ORDINARY = " ".join("".join(_draw.sample(w, len(w))) for w in WORDS.split()).encode()[:1000] + b" "
DICTIONARY = WORDS.encode() + b" " + IDENTIFIERS


def novelty(candidate: str, before: str, behind: str) -> float:
    """Marginal compressed bytes of the candidate in its primed surroundings, over its length: the sum of its pieces, each in the lesser of both spellings."""
    # no content size, checksum or dictionary id: the frame is all payload
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
    step, total = -(-len(candidate) // -(-len(candidate) // PIECE)), 0
    for k in range(0, len(candidate), step):
        piece, near = candidate[k : k + step], (before + candidate[max(0, k - CONTEXT) : k])[-CONTEXT:]
        primed = zstandard.ZstdCompressionDict(DICTIONARY + near.encode() + b"\n" + behind.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        press = zstandard.ZstdCompressor(dict_data=primed, compression_params=params)
        total += min(len(press.compress(ORDINARY + x.encode())) for x in (piece, spelled(piece))) - len(press.compress(ORDINARY))
    return total / len(candidate)


def embedded(text: str, a: int) -> bool:
    """Whether a file in base64 begins at a."""
    return text[max(0, a - 7) : a] == "base64," or text.startswith(EMBEDDED, a)


def surroundings(text: str, a: int, b: int) -> tuple[str, str]:
    """CONTEXT characters before and behind text[a:b]; its copies there, in any case and cut by the border or not, are blank."""
    copy, n = re.compile(re.escape(text[a:b]), re.IGNORECASE), b - a
    before = copy.sub(" " * n, text[max(0, a - CONTEXT - n) : a])
    return before[-CONTEXT:], copy.sub(" " * n, text[b : b + CONTEXT + n])[:CONTEXT]


def spelled(candidate: str) -> str:
    """The candidate as words: parts of camel case and of names with separators, in lower case."""
    return re.sub(r"(?<=[a-z])(?=[A-Z])|[_/+=-]+", " ", candidate).lower()


def mixed(s: str) -> bool:
    """A letter and a digit, or both cases inside."""
    return (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)) or (any(c.islower() for c in s[1:]) and any(c.isupper() for c in s[1:]))


def find(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind), by start, then kind as listed."""
    spans = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    words = [m.end() for m in SENSITIVE.finditer(text)]
    if words:
        taken = sorted(spans)
        w = k = 0
        reach = -1  # furthest end of a base span that starts before the candidate ends
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            while w < len(words) and words[w] <= a:
                w += 1
            while k < len(taken) and taken[k][0] < b:
                reach = max(reach, taken[k][1])
                k += 1
            if w and a - words[w - 1] <= REACH and reach <= a and mixed(m[0]) and not embedded(text, a):
                if novelty(m[0], *surroundings(text, a, b)) >= MIN_NOVELTY:
                    spans.append((a, b, "novel"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and spans, an array of struct(start, end, kind)."""
    schema = "doc_id bigint, spans array<struct<start:bigint,end:bigint,kind:string>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": a, "end": b, "kind": k} for a, b, k in find(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    small_batches(docs.sparkSession)
    hinted = F.when(F.col("text").rlike(HINT), F.col("text"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), hinted.alias("text")).mapInArrow(run, schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "novel")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
