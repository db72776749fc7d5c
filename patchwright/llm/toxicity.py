"""Toxicity: class-conditional Kneser-Ney models with shared backoff counts.

Two bigram models, toxic and ordinary, are fitted on labelled documents over one vocabulary. A bigram counts
once a document. A word counts by the distinct words before it (its continuation count), but
no more than the documents that hold it, so that one repetitive text cannot vouch for its own words. For
class c with counts n_c, totals T_c, and each count losing up to DISCOUNT (as in the modified form of
Kneser-Ney, where a count k loses up to k), L_c in all:

- word:   P_c(w)   = (n_c(w) - lost_c(w)) / T_c + L_c / T_c * S(w)
- bigram: P_c(w|v) = (n_c(vw) - lost_c(vw)) / T_c(v) + L_c(v) / T_c(v) * (S_v(w) + b(v) * P_c(w))

S are the shared backoff counts: what both classes lost on an expression, pooled. S(w) is its share of all
that was lost; S_v takes one count off each bigram, and b(v) is the mass of those. So a rare expression is
about as likely under either model, and all probabilities of a class sum to one. Words that neither class holds carry no evidence.

A document's score is a logistic curve over its length-normalised log-likelihood differences: per word of
its most toxic stretch of SPAN words (in long texts an insult must not drown), under the word model and under
the bigram model. The curve is fitted on labelled documents whose counts are
not in the models. Learning uses labels, and only from rows with crc32(doc_id as text) mod 5 not 0:
remainders 1 to 3 give the counts, 4 the curve. At most max_docs documents a class and part are
used, those with the least hash of doc_id, as long as a part's texts have no more than max_bytes bytes; scoring reads every text whole.

Defined cases: null or wordless texts score as a text without evidence; without labels of both
classes every score is the base rate, at most 0.49, so that nothing is rejected unread; of several labels of a doc_id the largest
holds; a null doc_id counts as held out; repeated rows come back as often as they came.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import apart, small_batches, table
from .textops import blocks, mix

MAX_DOCS, MAX_BYTES, SPAN = 4000, 32_000_000, 3
SLICE = 500  # texts counted at a time
_LOW = np.uint64(0xFFFFFFFF)
DISCOUNT, SHARED_DISCOUNT = 4.0, 1.0


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(text, toxic, part, doc_id): at most max_docs rows and max_bytes of text for each of two classes and two parts, each text once."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(remainder(F.col("doc_id")) != 0).withColumn("part", (remainder(F.col("doc_id")) == 4).cast("int"))
    order = [F.xxhash64(F.lit(9), "doc_id"), F.col("doc_id")]
    picked = None
    for toxic in (0, 1):
        for part in (0, 1):
            some = known.where((F.col("toxic") == toxic) & (F.col("part") == part)).orderBy(*order).limit(max_docs)
            picked = some if picked is None else picked.unionByName(some)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").select("text", "toxic", "part", "doc_id").distinct()  # at most 4 * max_docs ids
    rows = rows.groupBy("text", "toxic", "part").agg(F.min("doc_id").alias("doc_id"))
    # no more than the picked rows in a group
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic", "part").orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("so_far", so_far).where(F.col("so_far") <= max_bytes).drop("so_far")


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, previous word, word) of every word; the first of a text follows 0."""
    doc, prev, word = [], [], []
    for i, _, h, bounds in blocks(texts):
        p = np.concatenate([[np.uint64(0)], h[:-1]]) if len(h) else h
        starts = bounds[:-1][np.diff(bounds) > 0]
        p[starts] = 0
        doc.append(i + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))
        prev.append(p)
        word.append(h)
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return cat(doc, np.int64), cat(prev, np.uint64), cat(word, np.uint64)


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0x9E3779B97F4A7C15) + w)


def _once(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Indices of the first of each (document, item)."""
    return np.unique(mix(item + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)[1]


def _at(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each wanted hash among the sorted known ones, and whether it is there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    for i in range(0, len(texts), SLICE):
        yield texts.slice(i, SLICE)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Parts of (sorted hashes, counts) as one."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, place = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    return hashes, np.bincount(place, np.concatenate([n for _, n in parts]), len(hashes)).astype(np.int64)


class Counts:
    """Of the ordinary, then of the toxic class: sorted words with continuation counts; bigrams, as numbers of both words, with their documents.

    A bigram's key has the number of its word in the lower half and that of the word before it in the upper, from 1; 0 is the begin of a text."""

    def __init__(self, texts: list[pa.Array]) -> None:
        held = []
        for t in texts:
            grams = (_grams(part) for part in _slices(t))
            held.append(_merged([np.unique(w[_once(doc, w)], return_counts=True) for doc, _, w in grams]))
        self.words = np.unique(np.concatenate([h for h, _ in held]))
        pairs = [_merged([self._keys(part) for part in _slices(t)]) for t in texts]
        self.pairs = np.unique(np.concatenate([k for k, _ in pairs]))
        self.of_words, self.of_pairs = np.zeros((2, len(self.words))), np.zeros((2, len(self.pairs)), np.float32)
        for c in (0, 1):
            self.of_words[c, np.searchsorted(self.words, held[c][0])] = held[c][1]
            continued = np.bincount((pairs[c][0] & _LOW).astype(np.int64), minlength=len(self.words))
            self.of_words[c] = np.minimum(self.of_words[c], continued)
            self.of_pairs[c, np.searchsorted(self.pairs, pairs[c][0])] = pairs[c][1]

    def _keys(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The bigrams of some texts and in how many of them each is."""
        doc, v, w = _grams(texts)
        before = np.where(v == 0, 0, np.searchsorted(self.words, v) + 1).astype(np.uint64)
        key = (before << np.uint64(32)) | np.searchsorted(self.words, w).astype(np.uint64)
        return np.unique(key[_once(doc, mix(key))], return_counts=True)

    def word_model(self) -> np.ndarray:
        """P_c(w), a row a class."""
        n = self.of_words
        total, lost = n.sum(axis=1, keepdims=True), np.minimum(n, DISCOUNT)
        return (n - lost) / total + lost.sum(axis=1, keepdims=True) / total * lost.sum(axis=0) / lost.sum()

    def pair_model(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of pairs, their P_c(w|v), hashes of v, weight of the shared level after v by class); pairs that are left out have the probability of unseen ones."""
        m, head = self.of_pairs, (self.pairs >> np.uint64(32)).astype(np.int64)
        add = lambda x: np.bincount(head, x, len(self.words) + 1)
        lost = np.minimum(m, DISCOUNT)
        total, of_lost = np.stack([add(x) for x in m]), np.stack([add(x) for x in lost])
        weight = np.where(total > 0, of_lost / np.maximum(total, 1), 1.0)
        pooled = lost.sum(axis=0)
        of_head = of_lost.sum(axis=0)
        back = add(np.minimum(pooled, SHARED_DISCOUNT)) / np.maximum(of_head, 1)
        some = np.flatnonzero(pooled > SHARED_DISCOUNT)
        m, lost, pooled, head = m[:, some], lost[:, some], pooled[some], head[some]
        word = (self.pairs[some] & _LOW).astype(np.int64)
        lower = (pooled - SHARED_DISCOUNT) / of_head[head] + back[head] * p[:, word]
        known, hashes = np.flatnonzero(of_head), np.concatenate([[np.uint64(0)], self.words])
        q = (m - lost) / np.maximum(total[:, head], 1) + weight[:, head] * lower
        return pair(hashes[head], self.words[word]), q, hashes[known], weight[:, known]


class Model:
    """Sorted hashes of known words, bigrams and first words with their log ratios (toxic to ordinary), and the curve."""

    def __init__(self) -> None:
        self.words = self.pairs = self.heads = np.zeros(0, np.uint64)
        self.word_ratio = self.pair_ratio = self.head_ratio = np.zeros(0, np.float32)
        self.curve = np.zeros(3)

    def fit_counts(self, texts: list[pa.Array]) -> None:
        """texts: of the ordinary, then of the toxic class."""
        counts = Counts(texts)
        p = counts.word_model()
        pairs, q, heads, weight = counts.pair_model(p)
        order = np.argsort(pairs)
        ratio = lambda x: np.log(x[1] / x[0]).astype(np.float32)
        self.words, self.word_ratio = counts.words, ratio(p)
        self.heads, self.head_ratio = heads, ratio(weight)
        self.pairs, self.pair_ratio = pairs[order], ratio(q[:, order])

    def ratios(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log ratio of each word under the word models, and after the word before it under the bigram models."""
        at, known = _at(self.words, h)
        if not known.any():
            return (np.zeros(len(h), np.float32),) * 2
        word = np.where(known, self.word_ratio[at], np.float32(0))
        before = np.concatenate([[np.uint64(0)], h[:-1]])
        before[bounds[:-1][np.diff(bounds) > 0]] = 0
        at, after_known = _at(self.heads, before)
        both = np.where(known & after_known, word + self.head_ratio[at], word)
        if len(self.pairs):
            at, seen = _at(self.pairs, pair(before, h))
            both = np.where(seen, self.pair_ratio[at], both)
        return word, both

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: the greatest mean over a stretch of SPAN words, under the word and the bigram models."""
        out = np.zeros((len(texts), 2))
        for i, _, h, bounds in blocks(texts):
            for c, r in enumerate(self.ratios(h, bounds)):
                total = np.concatenate([[0.0], np.cumsum(r, dtype=np.float64)])
                for k in range(len(bounds) - 1):
                    x = total[bounds[k] : bounds[k + 1] + 1]
                    if len(x) > 1:
                        size = min(SPAN, len(x) - 1)
                        out[i + k, c] = (x[size:] - x[:-size]).max() / size
        return out

    def fit_curve(self, texts: pa.Array, toxic: np.ndarray) -> None:
        """Logistic regression by Newton steps with a small ridge."""
        x = np.column_stack([self.features(texts), np.ones(len(toxic))])
        b, ridge = np.zeros(3), np.diag([1e-2, 1e-2, 1e-3])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ b)
            b = b + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.curve = b

    def score(self, texts: pa.Array) -> np.ndarray:
        x = np.column_stack([self.features(texts), np.ones(len(texts))])
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


def fit_table(text: pa.Array, toxic: np.ndarray, part: np.ndarray) -> Model:
    model = Model()
    rate = toxic.mean() if len(toxic) else 0.5
    if {*toxic[part == 0]} == {0, 1} and {*toxic[part == 1]} == {0, 1}:
        take = lambda m: text.take(pa.array(np.flatnonzero(m)))
        model.fit_counts([take((part == 0) & (toxic == c)) for c in (0, 1)])
        model.fit_curve(take(part == 1), toxic[part == 1])
    else:
        rate = np.clip(rate, 1e-6, 0.49)
        model.curve[2] = np.log(rate / (1 - rate))
    return model


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Fitted in one task over the bounded training rows; only the model comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            t = pa.Table.from_batches(got)
            text = t.column("text").cast(pa.large_string()).combine_chunks()
            model = fit_table(text, t.column("toxic").to_numpy(), t.column("part").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model, 5)], pa.binary())], names=["model"])

    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, max_docs).repartition(1).sortWithinPartitions("doc_id").select("text", "toxic", "part")
    found = rows.mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fit_table(pa.array([], pa.large_string()), np.zeros(0), np.zeros(0))


def scored(docs: DataFrame, model: Model, names: Sequence[str] = ("score", "predicted")) -> DataFrame:
    """docs with score and predicted under these names (columns of docs that have them are replaced), in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(text))

    out = docs.drop(*names).withColumn(names[0], score("text"))
    return out.withColumn(names[1], (F.col(names[0]) >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """The documents that are not predicted toxic, in their columns, whatever their names."""
    names = apart(docs, "score", "predicted")
    return scored(docs, fit(docs, labels, max_docs), names).where(F.col(names[1]) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
