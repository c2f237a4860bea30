"""Exact top-k inner products by columnar branch and bound.

Candidates are read in blocks whose vectors lie dimension by dimension, the dimensions with the most
mass first and the candidates by falling norm.  For a tile of alike queries the inner products grow
one block of dimensions at a time; what the remaining dimensions can still add is at most the product
of the remaining norms (Cauchy-Schwarz), so a candidate whose bound is below the k-th score that a
query already has is out.  While most candidates may still serve some query of the tile, the tile goes
on together; then each query goes on alone with its own survivors, compacted after every block of
dimensions.  The first few candidates are finished at once, so that there is a k-th score to begin
with.  Scores are exact integers; ``Best.work`` counts the multiplications, ``Best.whole`` those of a
full product.

The queries are a stated set.  They travel to the candidates in passes of at most ``pass_bytes``; a
pass reads the candidates once, each task keeps k rows for a query, and one ranking over those few
rows ends it.  Several passes run one after the other, and each frees its queries when it ends.  A
query's own id is no candidate.  If an id occurs in several rows, it counts once with its best score.
Vectors that are null, or hold null or non-finite components, take no part, and a query meets candidates
of its own dimension only.  Ties go to the smaller id.  Empty tables give no rows; other columns are
not read, so their names don't matter; very long vectors are only more blocks of dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import common as C

SCALE = 256
BLOCK_DIMS = 8
TILE = 16
LEAD = 256  # candidates that are finished before others are bounded
PROBE = 64  # candidates that tell whether bounding all is worth it
ALONE = 0.5  # share of a tile's candidates at which its queries part
BLOCK_ROWS = 4096
PASS_BYTES = 32 << 20
SCHEMA = "query_id long, vec_id long, score long"
ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold finite numbers only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole_numbers(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer vectors (as doubles), one pair for each dimension that occurs, by id."""
    ids = np.asarray(batch.column(0))
    lists = batch.column(1)
    size = np.asarray(lists.value_lengths())
    flat, offs = np.asarray(lists.values), np.asarray(lists.offsets)
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        yield ids[rows], np.floor(flat[offs[rows][:, None] + np.arange(dim)].astype(np.float64) * scale)


def rest_norms(x: np.ndarray, block: int) -> np.ndarray:
    """For each block's end, the norm of what follows, rounded up: (blocks, rows)."""
    d = x.shape[1]
    sums = np.stack([(x[:, i : i + block] ** 2).sum(axis=1) for i in range(0, d, block)]) if d else np.zeros((0, len(x)))
    after = np.concatenate((np.cumsum(sums[::-1], axis=0)[::-1][1:], np.zeros((1, len(x)))))
    return np.sqrt(after) * (1 + 1e-9)


def scores_exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products that doubles can't hold, as saturated 64-bit integers."""
    whole = q.astype(object) @ x.T.astype(object)
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """Each query's k best candidates so far."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.scores = np.full((len(queries), k), np.iinfo(np.int64).min)
        self.held = np.zeros(len(queries), np.int64)
        self.work = self.whole = 0

    def floor(self, rows: np.ndarray) -> np.ndarray:
        """Scores below which a candidate can't enter."""
        return np.where(self.held[rows] == self.k, self.scores[rows, -1].astype(np.float64), -np.inf)

    def merge(self, row: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Let candidates compete that are not below the floor; ``scores`` are whole numbers."""
        if self.held[row] == self.k:
            enough = scores >= self.scores[row, -1]
            ids, scores = ids[enough], scores[enough]
        other = ids != self.queries[row]
        n = self.held[row]
        ids, scores = np.concatenate((self.ids[row, :n], ids[other])), np.concatenate((self.scores[row, :n], scores[other]))
        order = np.lexsort((ids, ~scores))
        ids, scores = ids[order], scores[order]
        _, first = np.unique(ids, return_index=True)
        keep = np.sort(first)[: self.k]
        self.held[row] = len(keep)
        self.ids[row, : len(keep)], self.scores[row, : len(keep)] = ids[keep], scores[keep]


def alike(q: np.ndarray) -> np.ndarray:
    """An order of the queries in which like ones are near each other: by the nearest of a few of them."""
    if len(q) <= TILE:
        return np.arange(len(q))
    some = q[:: max(1, len(q) // max(2, int(len(q) ** 0.5)))]
    return np.argsort((q @ some.T).argmax(axis=1), kind="stable")


def search_block(best: Best, q: np.ndarray, ids: np.ndarray, x: np.ndarray, block: int = 0) -> None:
    """Let a block of candidates compete for every query."""
    n, dim = x.shape
    block = block or BLOCK_DIMS
    best.whole += len(q) * n * dim
    if not dim or np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * dim >= EXACT:
        best.work += len(q) * n * dim
        for row, whole in enumerate(scores_exact(q, x) if dim else np.zeros((len(q), n), np.int64)):
            best.merge(row, ids, whole)
        return
    norm = np.sqrt((x * x).sum(axis=1)) * (1 + 1e-9)
    order = np.argsort(-norm, kind="stable")
    ids, norm = ids[order], norm[order]
    mass = np.argsort(-((x * x).sum(axis=0) * (q * q).sum(axis=0)), kind="stable")
    columns = np.ascontiguousarray(x[order][:, mass].T)
    rest, lead = rest_norms(columns.T, block), min(n, LEAD)
    for tile in np.array_split(alike(q), -(-len(q) // TILE)) if len(q) else ():
        own = q[tile][:, mass]
        q_rest, size = rest_norms(own, block), np.sqrt((own * own).sum(axis=1)) * (1 + 1e-9)
        best.work += len(tile) * lead * dim
        for row, whole in zip(tile.tolist(), (own @ columns[:, :lead]).astype(np.int64), strict=True):
            best.merge(row, ids[:lead], whole)
        floor = best.floor(tile)
        end = int(np.searchsorted(-norm, -np.min(floor / np.maximum(size, 1e-300)), "right")) if (floor > 0).all() else n
        live = np.arange(lead, max(lead, end))  # beyond, even the whole norms fall short
        left, rests = columns[:, lead : max(lead, end)], rest[:, lead : max(lead, end)]  # of the live ones
        sums, i, b = np.zeros((len(tile), len(live))), 0, 0
        may = np.ones(sums.shape, bool)
        while i < dim and len(live):
            sums += own[:, i : i + block] @ left[i : i + block]
            best.work += len(tile) * len(live) * min(block, dim - i)
            i, b = i + block, b + 1
            bound = lambda x, r, b=b: x + (q_rest[b - 1][:, None] * r + 1) >= floor[:, None]
            step = max(1, len(live) // PROBE)
            if i < dim and bound(sums[:, ::step], rests[b - 1, ::step]).mean() > 0.9:
                continue  # a glance at some says that it is too early
            may = bound(sums, rests[b - 1])
            some = may.any(axis=0)
            if some.mean() < 0.7:
                live, sums, may, left, rests = live[some], sums[:, some], may[:, some], left[:, some], rests[:, some]
            if i < dim and may.size and may.mean() < ALONE:
                break
        if not len(live):
            continue
        for r, row in enumerate(tile.tolist()):  # each query with its own survivors
            at, c, kept = i, b, np.flatnonzero(may[r])
            total, mine = sums[r, kept], live[kept]
            while at < dim and len(mine):
                total = total + own[r, at : at + block] @ columns[at : at + block, mine]
                best.work += len(mine) * min(block, dim - at)
                keep = total + (q_rest[c, r] * rest[c, mine] + 1) >= floor[r]
                mine, total = mine[keep], total[keep]
                at, c = at + block, c + 1
            if len(mine):
                best.merge(row, ids[mine], total.astype(np.int64))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's k best candidates."""
    shape = lambda df: df.filter(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    cand, asked = shape(candidates), shape(queries).distinct()
    spark = candidates.sparkSession
    size = asked.agg(F.sum(F.size("vector") * 8 + 16).alias("bytes")).first()["bytes"] or 0
    passes = max(1, -(-size // (pass_bytes // 2)))
    found: DataFrame | None = None
    for p in range(passes):
        part = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p)
        rows = part.toArrow()  # half of pass_bytes on average
        whole = [pair for batch in rows.to_batches() if batch.num_rows for pair in whole_numbers(batch, scale)]
        by_dim = {d: [np.concatenate([a for a, x in whole if x.shape[1] == d]), np.concatenate([x for _, x in whole if x.shape[1] == d])] for d in {x.shape[1] for _, x in whole}}
        shared = spark.sparkContext.broadcast(by_dim)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {d: Best(ids, k) for d, (ids, _) in shared.value.items()}
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK_ROWS):
                    for ids, x in whole_numbers(compact(whole.slice(at, BLOCK_ROWS)), scale):
                        if x.shape[1] in best:
                            search_block(best[x.shape[1]], shared.value[x.shape[1]][1], ids, x)
            for b in best.values():
                there = np.arange(k) < b.held[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.queries, b.held)), pa.array(b.ids[there]), pa.array(b.scores[there])], schema=ARROW)

        got = C.map_arrow(cand, run, SCHEMA)
        if passes > 1:
            got = C.materialise(got)
            shared.unpersist()
        found = got if found is None else found.unionByName(got)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def compact(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A slice with list offsets of its own."""
    return pa.RecordBatch.from_arrays([pa.concat_arrays([c]) if c.offset == 0 else c.take(pa.array(np.arange(len(c)))) for c in batch.columns], names=batch.schema.names)
