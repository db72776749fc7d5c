"""LM scoring: cross-entropy difference of matched n-gram models, each document left out of its own.

Tokens are words as they are written, runs of marks and line breaks. Two bigram models, one of the target
documents and one of all documents (background), share one vocabulary: every token of every document, a symbol for a
text's begin, and SPARE symbols that none has. They are matched in vocabulary, smoothing and size. With background
counts scaled to the target's tokens, b(.), and the target's t(.):

    background: c = (1 + MIX) * b        target: c = t + MIX * b
    P(w)   = (c(w) + 1) / (N + vocabulary)
    P(w|v) = (c(vw) + PRIOR * P(w)) / (c(v) + PRIOR)

So the target model is interpolated with the background; else what is seen once in the background and, being rare, not
in the smaller target would count as if it were absent from it.

Counts come from every document, less the scored document's own (of the target's, if it is one). A document's
score is its mean loss per token under the target model less that under the background model, in nats: low is target-like.

How it runs: texts are tokenised once and written as chunks of about CHUNK tokens: the chunk's different words as 64-bit
hashes, the most frequent first, and each token as a place among them. A chunk asks for the counts of its words and
bigrams (grams), which are 64-bit keys: it sends each key with what the chunk itself has of it to the key's slot, a range
of keys; the number of slots follows the tokens. A slot adds up its keys and answers each chunk with the sums of the grams that another chunk
has too. So what is sent is one entry per chunk and gram, less than two a token, packed in rows by chunk and slot (at
most a row an entry), and no list of words or counts comes to the driver or into one task. A key has as many
entries as chunks have it, whatever its documents.
Grams that many documents have (HOT or more among about SAMPLE) are counted by the tasks, without rows per chunk: at most
SAMPLE * (mean different grams of a document) / HOT of them, however large the input. That list decides where a gram is
counted, not how.

Defined cases: null or wordless texts have no tokens and score 0; without a target all scores are 0; of
several labels of a doc_id any of quality 1 makes it target; a null doc_id is never target; repeated rows count and come
back as often as they came; other columns are ignored. Two different grams may share a key with a chance of 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, materialise, small_batches, table
from .textops import blocks, mix, token_hashes

SPARE, PRIOR, MIX = 9, 100.0, 1.0
CHUNK, SLOT, SAMPLE, HOT = 800_000, 800_000, 5_000, 10
BEGIN = np.uint64(0x6A09E667F3BCC908)  # the hash of a text's begin
LOW = np.uint64((1 << 32) - 1)
TOKENS = "chunk bigint, n_tokens bigint, n_target bigint, ids array<bigint>, targets array<boolean>, sizes array<bigint>, words binary, places binary"
ASKED = "slot int, chunk bigint, data binary"
ROWS = 1 << 16


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays), 1)


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw, sizes = np.frombuffer(zstandard.decompress(data), np.uint8), [np.dtype(k).itemsize for k in kinds]
    n, cuts = len(raw) // sum(sizes), np.cumsum([0, *sizes])
    return [np.ascontiguousarray(raw[n * i : n * j].reshape(j - i, n).T).view(kind).ravel() for kind, i, j in zip(kinds, cuts, cuts[1:], strict=False)]


def rows_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, t in enumerate(types)], names=list(names))


def tokenised(marked: DataFrame, chunk: int) -> DataFrame:
    """(doc_id, text, is_target) as written chunks: documents with their sizes, the different words and each token's place among them."""

    def batch_of(number: int, ids: list, targets: list, hashes: list, sizes: list) -> pa.RecordBatch:
        words, places, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order, rank = np.argsort(-n, kind="stable"), np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words))
        size = np.concatenate(sizes)
        of_target = int(size[np.array(targets, bool)].sum())
        return rows_of(TOKENS, [(number, len(places), of_target, ids, targets, size, words[order].tobytes(), pack(rank[places]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n, held = TaskContext.get().partitionId() << 32, 0, ([], [], [], [])
        for batch in batches:
            ids, targets = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j, h, bounds in blocks(batch.column(1), token_hashes):
                held[0].extend(ids[i:j])
                held[1].extend(targets[i:j])
                held[2].append(h)
                held[3].append(np.diff(bounds))
                n += len(h)
                if n >= chunk:
                    yield batch_of(number, *held)
                    number, n, held = number + 1, 0, ([], [], [], [])
        if held[0]:
            yield batch_of(number, *held)

    return materialise(marked.mapInArrow(run, TOKENS), "tokens")


class Grams:
    """The words (the last one is the begin) and bigrams of a chunk, or of some of its documents.

    keys: of all words, then of all bigrams; sums: tokens of each by model (background, target); docs: the documents of each.
    Entries are the different bigrams of each document: doc, pair (among bigrams), n (times), nv and nw (tokens of
    the first and second word in the document)."""

    def __init__(self, row: dict, some: np.ndarray | None = None):
        sizes, target = np.array(row["sizes"], np.int64), np.array(row["targets"], bool)
        w = unpack(row["places"], np.uint32)[0].astype(np.uint64)
        if some is not None:
            w = w[np.repeat(some, sizes)]
            sizes, target = sizes[some], target[some]
        words = np.append(np.frombuffer(row["words"], np.uint64), BEGIN)
        begin, full = np.uint64(len(words) - 1), np.flatnonzero(sizes)
        high = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(32)
        v = np.roll(w, 1)
        v[(np.cumsum(sizes) - sizes)[full]] = begin
        pairs, place = np.unique((v << np.uint64(32)) | w, return_inverse=True)
        self.first, self.second = (pairs >> np.uint64(32)).astype(np.int64), (pairs & LOW).astype(np.int64)
        self.n_words, self.n_docs = len(words), len(sizes)
        self.keys = np.concatenate([words, mix(mix(words[self.first]) * np.uint64(3) + words[self.second])])
        each, self.n = np.unique(high | place.astype(np.uint64), return_counts=True)
        self.doc, self.pair = (each >> np.uint64(32)).astype(np.int64), (each & LOW).astype(np.int64)
        own, of = np.unique(np.concatenate([high | w, (full.astype(np.uint64) << np.uint64(32)) | begin]), return_counts=True)
        self.target = target[self.doc].astype(np.int64)
        of_doc = each & ~LOW
        self.nv, self.nw = (of[np.searchsorted(own, of_doc | x[self.pair].astype(np.uint64))] for x in (self.first, self.second))
        word, marked = (own & LOW).astype(np.int64), target[(own >> np.uint64(32)).astype(np.int64)]
        two = ((word, of, marked, len(words)), (self.pair, self.n, self.target, len(pairs)))
        self.sums = np.stack([np.concatenate([np.bincount(at, n * m, k) for at, n, m, k in two]) for two in ([(a, n, 1, k) for a, n, _, k in two], two)])
        self.docs = np.concatenate([np.bincount(at, minlength=k) for at, _, _, k in two])


def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Grams]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row["chunk"], Grams(row)


def columns(**cols: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of bigint columns."""
    whole = {name: np.ascontiguousarray(c).astype(np.int64) for name, c in cols.items()}
    for k in range(0, len(next(iter(whole.values()))), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + ROWS]) for c in whole.values()], names=[*whole])


@dataclass
class Model:
    """Tokens of the background and of the target, the vocabulary's size; sorted keys of hot grams and their sums by model."""

    tokens: tuple[int, int]
    vocabulary: int
    hot: np.ndarray
    counts: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the hot grams, whether it is one) of each key."""
        at = np.minimum(np.searchsorted(self.hot, keys), max(len(self.hot) - 1, 0))
        return at, (self.hot[at] == keys) if len(self.hot) else np.zeros(len(keys), bool)

    def scores(self, g: Grams, sums: np.ndarray) -> np.ndarray:
        """Per document the loss under the target model less that under the background model. sums: by model and gram, over all documents."""
        scale, pair = self.tokens[1] / max(self.tokens[0], 1), g.n_words + g.pair
        v, w = g.first[g.pair], g.second[g.pair]
        p = []
        for rate, share in (((1 + MIX) * scale, 0.0), (MIX * scale, 1.0)):
            count = lambda at, own: rate * (sums[0, at] - own) + share * (sums[1, at] - g.target * own)  # noqa: B023, E731
            one = (count(w, g.nw) + 1) / ((1 + MIX) * self.tokens[1] + self.vocabulary)
            p.append((count(pair, g.n) + PRIOR * one) / (count(v, g.nv) + PRIOR))
        return np.bincount(g.doc, g.n * np.log(p[0] / p[1]), g.n_docs)


def find_hot(tokens: DataFrame, documents: int, sample: int, hot: int) -> np.ndarray:
    """The grams that at least `hot` of about `sample` documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                number = mix(np.array([row["chunk"]], np.uint64)) + np.arange(len(row["ids"]), dtype=np.uint64)
                g = Grams(row, mix(number) % np.uint64(max(documents, 1)) < sample)
                some = np.flatnonzero(g.docs)
                yield from columns(key=g.keys[some].view(np.int64), docs=g.docs[some])

    found = tokens.mapInArrow(run, "key bigint, docs bigint").groupBy("key").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= hot)
    return np.sort(found.select("key").toArrow().column(0).to_numpy().view(np.uint64))


def count_hot(tokens: DataFrame, shared) -> np.ndarray:
    """Sums of the hot grams by model: each task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(shared.value.hot)))
        for _, g in grams(batches):
            at, is_hot = shared.value.places(g.keys)
            sums[:, at[is_hot]] += g.sums[:, is_hot]
        some = np.flatnonzero(sums[0])
        yield from columns(at=some, background=sums[0, some], target=sums[1, some])

    out = np.zeros((2, len(shared.value.hot)))
    if len(shared.value.hot):
        got = tokens.mapInArrow(run, "at bigint, background bigint, target bigint").groupBy("at").agg(F.sum("background"), F.sum("target")).toArrow()
        out[:, got.column(0).to_numpy()] = got.column(1).to_numpy(), got.column(2).to_numpy()
    return out


def count_words(tokens: DataFrame) -> int:
    """Different words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in batch.column(0):
                yield from columns(word=np.frombuffer(words.as_py(), np.int64))

    return tokens.select("words").mapInArrow(run, "word bigint").distinct().count()


def by_slot(keys: np.ndarray, cold: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The cold places in the order of their keys, and where each slot begins and the last ends."""
    order = cold[np.argsort(keys[cold])]
    slot = ((keys[order] >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
    return order, np.searchsorted(slot, np.arange(slots + 1, dtype=np.uint64))


def asked(tokens: DataFrame, shared, slots: int) -> DataFrame:
    """Per chunk and slot the grams that are not hot: steps of the sorted keys and what the chunk has of each by model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, g in grams(batches):
            order, cuts = by_slot(g.keys, np.flatnonzero(~shared.value.places(g.keys)[1]), slots)
            some, (background, target) = np.flatnonzero(np.diff(cuts)), g.sums.astype(np.uint64)
            for k in range(0, len(some), 64):
                parts = [(int(i), order[cuts[i] : cuts[i + 1]]) for i in some[k : k + 64]]
                yield rows_of(ASKED, [(i, chunk, pack(np.diff(g.keys[at], prepend=np.uint64(0)), background[at], target[at])) for i, at in parts])

    return tokens.mapInArrow(run, ASKED)


def answer(rows: pa.Table) -> pa.Table:
    """The sums over all chunks of the grams that more than one chunk has, for each chunk that asked: steps of the places in its row, sums by model."""
    given = [unpack(data.as_py(), np.uint64, np.uint64, np.uint64) for data in rows["data"]]
    sizes = [len(x[0]) for x in given]
    keys, place, chunks = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in given]), return_inverse=True, return_counts=True)
    sums = [np.bincount(place, np.concatenate([x[k] for x in given]), len(keys)).astype(np.uint64) for k in (1, 2)]
    out, start = [], 0
    for slot, chunk, size in zip(rows["slot"].to_pylist(), rows["chunk"].to_pylist(), sizes, strict=True):
        own = place[start : start + size]
        start += size
        at = np.flatnonzero(chunks[own] > 1).astype(np.uint32)
        if len(at):
            out.append((slot, chunk, pack(np.diff(at, prepend=np.uint32(0)), *(x[own[at]] for x in sums))))
    return pa.Table.from_batches([rows_of(ASKED, out)])


def score_chunk(shared, slots: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        g, model = Grams(row), shared.value
        at, is_hot = model.places(g.keys)
        sums = g.sums.astype(np.float64)
        sums[:, is_hot] = model.counts[:, at[is_hot]]
        order, cuts = by_slot(g.keys, np.flatnonzero(~is_hot), slots)
        for slot, data in zip(right["slot"].to_pylist(), right["data"], strict=True):
            steps, *two = unpack(data.as_py(), np.uint32, np.uint64, np.uint64)
            sums[:, order[cuts[slot] + np.cumsum(steps, dtype=np.int64)]] = two
        n = np.array(row["sizes"], np.int64)
        score = model.scores(g, sums) / np.maximum(n, 1)
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_tokens": pa.array(n), "score": pa.array(score)})

    return run


def scored(docs: DataFrame, target_ids: DataFrame, chunk: int = CHUNK, slot: int = SLOT, sample: int = SAMPLE, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_tokens, score. target_ids: doc_id of the target documents."""
    small_batches(docs.sparkSession)
    ids = target_ids.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("t_id")).distinct()
    ids = bounded(materialise(ids, "target-ids"))
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    tokens = tokenised(plain.join(ids, F.col("doc_id") == F.col("t_id"), "left").select("doc_id", "text", F.col("t_id").isNotNull().alias("is_target")), chunk)
    sizes = tokens.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_target", F.size("ids")))).first()
    model = Model((sizes[0], sizes[1]), count_words(tokens) + SPARE, find_hot(tokens, sizes[2], sample, hot))
    share = docs.sparkSession.sparkContext.broadcast
    model.counts = count_hot(tokens, share(model))
    shared = share(model)
    slots = max(1, -(-sizes[0] // slot))
    given = asked(tokens, shared, slots).groupBy("slot").applyInArrow(answer, ASKED)
    return tokens.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(score_chunk(shared, slots), "doc_id bigint, n_tokens bigint, score double")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
