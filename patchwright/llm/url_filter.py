"""URL filters: rules, then logistic regression on hashed character n-grams of host and path.

A rule is (verdict, host, path): it fits its host and all subdomains of it where the url's path
starts with the rule's; of those that fit, the longest decides, and of equally long ones that to block. Urls without a rule go to a
classifier: character n-grams of NGRAMS characters of host and path, apart, each once, hashed to BUCKETS
weights, fitted on a small labelled table by full-batch gradient steps with an L2 penalty. N-grams of a whole
batch are hashed at once. Model and rules are bounded by their parameters, so judging is one pass without a shuffle.

Defined cases: a null url, or one without ://, has an empty host and path, fits no rule and is
judged as having no n-grams (by the intercept); repeated rows come back as often as they came;
other columns are ignored. Without labels of both kinds the classifier allows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table
from .textops import mix

NGRAMS, BUCKETS, STEPS, RATE, PENALTY = (3, 4, 5), 1 << 14, 400, 0.5, 1e-3
MAX_LABELLED, MAX_RULES = 5000, 1000
#: Few hosts are unwanted, and the labelled table has about as many of either kind: a url that tells little is allowed.
BLOCK_AT = 0.6

# The rules of the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

# The labelled table is made from these by `labelled_table`: words of unwanted and of ordinary hosts.
UNWANTED = """
poker slots roulette betting lottery jackpot blackjack bookmaker viagra pharmacy steroids pillbox diet-miracle weightloss porn escort webcam-girls erotic hookup
nude payday credit-repair quickcash forex-profit bitcoin-double get-rich replica fake-watches counterfeit warez crack-keygen torrent-movies phish verify-account
malware free-download-exe spyware adserver popunder clickbait tracker linkexchange backlinks seo-boost bulk-mail giveaway free-gift prize-winner
""".split()
ORDINARY = """
library university museum school college institute hospital clinic council county parliament ministry archive gazette journal review tribune herald weather forecast
garden kitchen recipes bakery travel railway airport harbour cycling football chess theatre orchestra cinema gallery history geology physics chemistry biology
mathematics software developer database network documentation handbook dictionary encyclopedia grammar poetry novel publisher bookshop carpenter furniture textile energy forestry
""".split()
PLACES = ("www.{0}.test/en/{2}", "{0}-{1}.test/{2}", "m.{1}-{0}.test/page/{2}", "blog.{0}{1}.test/{1}", "{0}.site.test/fr/{2}", "www.{1}{0}.test/de/{2}/{0}")


def parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path) of a url."""
    def part(n: int) -> Column:
        return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", n), F.lit(""))

    return ascii_lower(part(1)), part(2)


def labelled_table(spark: SparkSession) -> DataFrame:
    """(host, path, blocked): the small labelled table as a frame; each word in each place, beside another of its kind."""
    rows = []
    for blocked, words in ((1, UNWANTED), (0, ORDINARY)):
        for i, word in enumerate(words):
            for k, place in enumerate(PLACES):
                host, path = place.format(word, words[(i + 7 * k + 3) % len(words)], 37 * i + k).split("/", 1)
                rows.append((host, f"/{path}", blocked))
    return spark.createDataFrame(rows, "host string, path string, blocked int")


def buckets(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each row's different n-grams; host and path are framed by marks of their own."""
    framed = [f"\x02{h}\x03" if h else "" for h in hosts] + [f"\x04{p}\x05" if p else "" for p in paths]
    row = np.tile(np.arange(len(hosts)), 2).repeat([len(x) for x in framed])
    part = np.arange(len(framed)).repeat([len(x) for x in framed])
    chars = mix(np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    found = []
    for n in NGRAMS:
        at = np.flatnonzero(part[: len(part) - n + 1] == part[n - 1 :]) if len(part) >= n else np.zeros(0, np.int64)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + chars[at + k])
        found.append(row[at] * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64))
    return np.divmod(np.unique(np.concatenate(found)), BUCKETS)


def values(row: np.ndarray, rows: int) -> np.ndarray:
    """The value of a row's n-grams: its vector has length one."""
    return 1 / np.sqrt(np.maximum(np.bincount(row, minlength=rows), 1))


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """(weights, intercept) from at most max_labelled rows (host, path, blocked), those first in order."""
    rows = labelled.where("blocked IN (0, 1)").select(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit("")), "blocked").orderBy(F.xxhash64("host", "path"), "host", "path", "blocked").limit(max_labelled).collect()
    y = np.array([r[2] for r in rows], float)
    w, b = np.zeros(BUCKETS), 0.0
    if len({*y.tolist()}) < 2:
        return w, -1.0
    row, col = buckets([r[0] for r in rows], [r[1] for r in rows])
    value = values(row, len(y))
    for _ in range(STEPS):
        z = b + value * np.bincount(row, w[col], len(y))
        g = 1 / (1 + np.exp(-z)) - y
        w -= RATE * (np.bincount(col, (g * value)[row], BUCKETS) / len(y) * 10 + PENALTY * w)
        b -= RATE * g.mean()
    return w, float(b)


def probabilities(model: tuple[np.ndarray, float], hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    w, b = model
    row, col = buckets(hosts, paths)
    return 1 / (1 + np.exp(-(b + values(row, len(hosts)) * np.bincount(row, w[col], len(hosts)))))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. At most MAX_RULES rules."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # the longest is asked first
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, probability (of the classifier; null where a rule decides)."""
    model = pages.sparkSession.sparkContext.broadcast(fit(labelled))
    schema = "page_id bigint, host string, path string, rule string, verdict string, probability double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path, verdict = (batch.column(k).to_pylist() for k in (1, 2, 4))
            score = probabilities(model.value, host, path)
            p = [float(x) if v is None else None for v, x in zip(verdict, score, strict=True)]
            verdict = [v or ("block" if x >= BLOCK_AT else "allow") for v, x in zip(verdict, score, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdict, pa.string()), pa.array(p, pa.float64())], names=[*batch.schema.names[:5], "probability"])

    host, path = parts(F.col("url"))
    out = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    out = out.withColumn("found", rule_for(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "found.rule", "found.verdict")
    return out.mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), labelled_table(spark))
