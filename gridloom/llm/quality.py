"""Quality classification by hierarchical empirical Bayes.

A logistic classifier gives each document log odds of being good from hashed words and a few text
statistics.  Its probabilities are summed by path and by host in one grouped aggregation, and rates
are shrunk level by level: hosts toward the global rate, paths toward their host, with prior strengths
from the method of moments.  A document's posterior adds its path's log odds, relative to the global
rate, to its own; sparse sites thus stay near the global prior.

The classifier learns from at most about ``TRAIN_ROWS`` labelled documents, chosen by a hash of the id;
sites' statistics cover all documents.  ``site_of`` takes host and path from URLs; tables without URLs give
other columns.  Nulls: a null text has no words; null hosts and paths are sites of their own; labels with
a null id or label, or no document, teach nothing.  Several labels of one id count once with the worst,
and of several documents of one id that with the smallest text hash teaches.  Without two classes to
learn from every document is kept.  Repeated rows are judged alike; very long texts are read block by
block; an empty table gives no rows.  Other columns, also ones with the result's names, pass through
``keep_good``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import common as C

TRAIN_ROWS = 10_000
BITS = 18
LEAST_DOCS = 10
STATS = 9
BROADCAST_SITES = 200_000
OWN = C.alnum_words()


def _byte_classes() -> np.ndarray:
    """Rows of 0 and 1 by byte: capitals, digits, symbols, bars and exclamation marks, line ends, non-ASCII."""
    own = np.zeros((6, 256), np.int8)
    own[0, 65:91] = own[1, 48:58] = 1
    own[2, [ord(c) for c in "#$%&*+/<=>@\\^_`{}~"]] = 1
    own[3, [ord("|"), ord("!")]] = own[4, 10] = 1
    own[5, 128:] = 1
    return own


CLASSES = _byte_classes()


FIELD = 21  # bits of a count where three are added up as one number
PACKED = np.array([sum(CLASSES[3 * g + k].astype(np.int64) << FIELD * k for k in range(3)) for g in range(2)])


def class_counts(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """How many bytes of each class each row has."""
    if len(buf) >= 1 << FIELD:  # one long text
        sums = [np.concatenate(([0], np.cumsum(own[buf], dtype=np.int64))) for own in CLASSES]
        return [s[offs[1:]] - s[offs[:-1]] for s in sums]
    out = []
    for three in PACKED:
        total = np.concatenate(([0], np.cumsum(three[buf])))
        own = total[offs[1:]] - total[offs[:-1]]
        out += [own >> FIELD * k & (1 << FIELD) - 1 for k in range(3)]
    return out


def features(buf: np.ndarray, offs: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of each distinct word (of the ``used`` buckets), and statistics by row."""
    words = C.Words(buf, offs, OWN)
    bucket = (words.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1), words.counts)
    again = np.zeros(len(bucket), bool)
    again[1:] = (bucket[1:] == bucket[:-1]) & (row[1:] == row[:-1])
    by_row = lambda mask: np.bincount(row[mask], minlength=len(offs) - 1)
    pairs, times = np.unique(row << BITS | bucket, return_counts=True)
    at, kind = pairs >> BITS, pairs & ((1 << BITS) - 1)
    most, kinds = np.zeros(len(offs) - 1, np.int64), np.bincount(at, minlength=len(offs) - 1)
    np.maximum.at(most, at, times)
    n, size = np.maximum(words.counts, 1), np.maximum(np.diff(offs), 1)
    share = [c / size for c in class_counts(buf, offs)]
    stats = np.stack([*share, by_row(again) / n, kinds / n * np.log1p(n) / 7, most / n], axis=1)
    if used is not None:
        kept = used[kind]
        at, kind = at[kept], kind[kept]
    return at, kind, stats


class Classifier:
    """Logistic regression on words that occur in enough documents and on standardised statistics."""

    def __init__(self, weights: np.ndarray, dense: np.ndarray, mean: np.ndarray, scale: np.ndarray, bias: float):
        self.weights, self.dense, self.mean, self.scale, self.bias = weights, dense, mean, scale, bias
        self.used = weights != 0

    def log_odds(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        at, kind, stats = features(buf, offs, self.used)
        words = np.bincount(at, weights=self.weights[kind], minlength=len(offs) - 1)
        return np.clip(words + ((stats - self.mean) / self.scale) @ self.dense + self.bias, -30, 30)


def fit(kinds: list[np.ndarray], stats: np.ndarray, good: np.ndarray, steps: int = 150, ridge: float = 3e-4) -> Classifier:
    """Full-batch Adam on balanced classes."""
    n = len(good)
    flat, at = np.concatenate(kinds), np.repeat(np.arange(n), [len(k) for k in kinds])
    enough = np.bincount(flat, minlength=1 << BITS) >= min(LEAST_DOCS, max(2, n // 20))
    column = np.cumsum(enough) - 1
    kept = enough[flat]
    flat, at, width = column[flat[kept]], at[kept], int(enough.sum())
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    x = np.clip((stats - mean) / scale, -20, 20)
    weight = np.where(good, 0.5 / max(good.sum(), 1), 0.5 / max((~good).sum(), 1))
    value = np.zeros(width + STATS + 1)
    m, v = np.zeros_like(value), np.zeros_like(value)
    for t in range(1, steps + 1):
        z = np.bincount(at, weights=value[:width][flat], minlength=n) + x @ value[width:-1] + value[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good)
        grad = np.concatenate((np.bincount(flat, weights=error[at], minlength=width), x.T @ error, [error.sum()]))
        grad[:-1] += ridge * value[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        value -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[enough] = value[:width]
    return Classifier(weights, value[width:-1], mean, scale, float(value[-1]))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Classifier | None:
    """A classifier of good documents (quality 1, not toxic) from a bounded sample of the labels."""
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).alias("good"))
    n = known.count()
    if not n:
        return None
    rate = min(1.0, train_rows / n)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 31)) <= int(rate * (1 << 31)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, stats = [], []
            for start, end, buf, offs, _ in C.blocks(batch.column("text")):
                at, kind, own = features(buf, offs)
                cut = np.searchsorted(at, np.arange(end - start + 1))
                kinds += [kind[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                stats += own.tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "good", "hash")), pa.array(kinds, pa.binary()), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "good", "hash", "kinds", "stats"])

    # the chosen ids are a bounded sample: about train_rows rows of 9 bytes
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "good", F.xxhash64("text").alias("hash"), "text")
    rows = C.map_arrow(found, run, "doc_id long, good boolean, hash long, kinds binary, stats array<double>")
    got = rows.groupBy("doc_id").agg(F.min_by(F.struct("good", "kinds", "stats"), "hash").alias("x")).select("doc_id", "x.*").toArrow().sort_by("doc_id")
    good = np.array(got.column("good").to_pylist(), dtype=bool)
    if not good.any() or good.all():
        return None
    return fit([np.frombuffer(k, "<i4") for k in got.column("kinds").to_pylist()], np.array(got.column("stats").to_pylist()), good)


def with_log_odds(docs: DataFrame, model: Classifier, out: str, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    passed = [f for f in docs.schema.fields if f.name not in drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = C.held(key, lambda: shared.value)
        for batch in batches:
            odds = [own.log_odds(buf, offs) for _, _, buf, offs, _ in C.blocks(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in passed), pa.array(np.concatenate(odds) if odds else np.zeros(0))], names=[*(f.name for f in passed), out])

    return C.map_arrow(docs, run, T.StructType([*passed, T.StructField(out, T.DoubleType())]))


def site_of(url: Column) -> tuple[Column, Column]:
    """Host (lower case, without ``www.``) and first part of the path of a URL; null where it has none."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")
    return host, F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/*([^/]*)", 1)


def _strength(rate: float, spread: float, noise: float) -> float:
    """Beta prior strength by moments: what the spread of rates leaves beyond sampling noise."""
    between = max(spread - noise, 1e-6)
    return float(np.clip(rate * (1 - rate) / between - 1, 2.0, 1e6))


def site_rates(scored: DataFrame) -> tuple[DataFrame, float]:
    """Shrunk rates by ``host`` and ``path`` from the probabilities ``p`` of all documents, and the global rate.

    One grouped aggregation by path, which combines inside tasks; everything after it is on sites.
    """
    paths = C.materialise(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s"), F.count("*").alias("k")).first()
    rate = float(np.clip((total["s"] + 1) / (total["n"] + 2), 1e-6, 1 - 1e-6)) if total["n"] else 0.5

    def spread(sites: DataFrame, n: str, s: str, around: Column) -> tuple[float, float]:
        got = sites.agg((F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - around, 2)) / F.sum(n)).alias("v"), (F.count("*") / F.sum(n)).alias("w")).first()
        return float(got["v"] or 0.0), float(got["w"] or 0.0) * rate * (1 - rate)

    a = _strength(rate, *spread(hosts, "host_n", "host_s", F.lit(rate)))
    hosts = hosts.withColumn("host_rate", (F.col("host_s") + a * rate) / (F.col("host_n") + a))
    both = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    b = _strength(rate, *spread(both, "n", "s", F.col("host_rate")))
    return C.materialise(both.select("host", "path", "host_rate", ((F.col("s") + b * F.col("host_rate")) / (F.col("n") + b)).alias("path_rate"))), rate


def odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def posterior(scored: DataFrame, host: str, path: str, log_odds: str, sites: DataFrame, rate: float) -> DataFrame:
    """``scored`` with ``host_rate``, ``path_rate`` and ``score``; sites are broadcast only up to a counted size."""
    sites = sites.withColumnsRenamed({"host": "__host", "path": "__path"})
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    joined = scored.join(sites, F.col(host).eqNullSafe(F.col("__host")) & F.col(path).eqNullSafe(F.col("__path"))).drop("__host", "__path")
    return joined.withColumn("score", 1 / (1 + F.exp(-(F.col(log_odds) + odds(F.col("path_rate")) - odds(F.lit(rate))))))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id``, ``doc_score``, ``host_rate``, ``path_rate``, ``score`` and ``keep`` for every row."""
    model = train(docs, labels, train_rows)
    light = docs.select("doc_id", "text", host.alias("host"), path.alias("path"))
    if model is None:
        return light.select("doc_id", *(F.lit(1.0).alias(c) for c in ("doc_score", "host_rate", "path_rate", "score")), F.lit(True).alias("keep"))
    scored = C.materialise(with_log_odds(light, model, "z", drop=("text",)).withColumn("p", 1 / (1 + F.exp(-F.col("z")))))
    sites, rate = site_rates(scored)
    return posterior(scored, "host", "path", "z", sites, rate).select("doc_id", F.col("p").alias("doc_score"), "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the posterior keeps, with their columns as they are."""
    model = train(docs, labels, train_rows)
    if model is None:
        return docs
    light = docs.select("text", host.alias("host"), path.alias("path"))
    scored = with_log_odds(light, model, "z", drop=("text",)).select("host", "path", (1 / (1 + F.exp(-F.col("z")))).alias("p"))
    sites, rate = site_rates(scored)
    safe = [f"in_{i}" for i in range(len(docs.columns))]  # whatever the columns are called, no name clashes
    named = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, safe, strict=True)), host.alias("h"), path.alias("p"))
    again = with_log_odds(named, model, "z", safe[docs.columns.index("text")])
    kept = posterior(again, "h", "p", "z", sites, rate).filter("score >= 0.5")
    return kept.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, safe, strict=True)))
