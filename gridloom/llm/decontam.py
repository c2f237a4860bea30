"""Benchmark decontamination: a broadcast hash set of test n-grams against training token windows.

Words are runs of ASCII digits, a-z (A-Z are lower-cased) and all non-ASCII characters.  An item's
windows are its runs of ``n`` words, or its whole sequence where it has fewer.  The main path builds
the window set on the driver: sorted hashes, places in one byte buffer of normalised item texts, and
item lists, all plain arrays.  Neither the texts nor the arrays may be larger than
``max_broadcast_bytes``, and both are measured before they are broadcast.  Every document block looks
its windows up in a bitmap and the hashes, and each surviving window is verified on its bytes.  A larger
benchmark takes ``join_hits``: windows that pass a fixed-size bitmap are joined on their words, each
with one row that lists its items, and both ways give the same results.

Null texts have no words.  Items with null text have no windows; an item with a null id marks words
but is not listed; items that tie or repeat are listed once.  Repeated rows are judged one by one; a very
long text is a block of its own; empty tables hit nothing.  Input columns other than the text are
passed through; one named like a result column is replaced.
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

OWN = C.alnum_words()
BITS = 22
MAX_BROADCAST_BYTES = 32 << 20
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_items", T.ArrayType(T.LongType()))])


class Windows:
    """The distinct windows of one length: sorted hashes, where their bytes are, and their items."""

    def __init__(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, text: np.ndarray):
        by = np.lexsort((row, hashes))
        hashes, start, end, row = hashes[by], start[by], end[by], row[by]
        lead = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        of = np.repeat(lead, np.diff(lead, append=len(hashes)))
        own = np.flatnonzero(of != np.arange(len(hashes)))
        alike = np.array([np.array_equal(text[start[i] : end[i]], text[start[of[i]] : end[of[i]]]) for i in own.tolist()], bool)
        if not alike.all():  # other words of an equal hash: windows of their own, one after the other
            words = [text[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            by = np.array(sorted(range(len(hashes)), key=lambda i: (int(hashes[i]), words[i], int(row[i]))))
            hashes, start, end, row = hashes[by], start[by], end[by], row[by]
            lead = np.array([k for k, i in enumerate(by.tolist()) if not k or words[i] != words[by[k - 1]]])
        self.hashes, self.start, self.size = hashes[lead], start[lead].astype(np.int32), (end - start)[lead].astype(np.int32)
        self.first = np.append(lead, len(hashes)).astype(np.int32)
        self.row = row.astype(np.int32)
        self.bits = int(np.clip(len(self.hashes).bit_length() + 4, 8, BITS))
        self.map = np.zeros(1 << self.bits, dtype=bool)
        self.map[self.hashes >> np.uint64(64 - self.bits)] = True

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.hashes, self.start, self.size, self.first, self.row, self.map

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that are there."""
        at = np.flatnonzero(self.map[hashes >> np.uint64(64 - self.bits)])
        return at[self.hashes[np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)] == hashes[at]]


class WindowSet:
    """All benchmark windows by length."""

    def __init__(self, items: list[tuple[int | None, str]], n: int):
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        texts, at = [np.zeros(0, np.uint8)], 0
        self.ids = [i for i, _ in items]
        for start, _, buf, offs, _ in C.blocks(pa.array([t for _, t in items], pa.large_string())):
            words = C.Words(buf, offs, OWN)
            hashed, own = words.hashes(), np.minimum(words.counts, n)
            text, begin = words.normal_text()
            for size in np.unique(own[own > 0]).tolist():
                grams = C.windows(hashed, size)
                row = np.repeat(np.arange(len(own)), words.counts)[: len(grams)]
                kept = np.flatnonzero((own[row] == size) & (np.arange(len(grams)) + size <= words.at[row + 1]))
                last = kept + size - 1
                ends = begin[last] + words.end[last] - words.start[last]
                found.setdefault(size, []).append((grams[kept], begin[kept] + at, ends + at, row[kept] + start))
            texts.append(text)
            at += len(text)
        self.text = np.concatenate(texts)
        self.lengths = {k: Windows(*(np.concatenate(x) for x in zip(*v, strict=True)), self.text) for k, v in sorted(found.items())}

    def nbytes(self) -> int:
        return self.text.nbytes + 40 * len(self.ids) + sum(x.nbytes for w in self.lengths.values() for x in w.arrays())

    def items(self, size: int, gram: np.uint64, words: bytes) -> list[int | None]:
        """The ids of the items that hold these words as a window."""
        own = self.lengths[size]
        k = int(np.searchsorted(own.hashes, gram))
        while k < len(own.hashes) and own.hashes[k] == gram:
            a = int(own.start[k])
            if self.text[a : a + own.size[k]].tobytes() == words:
                return [self.ids[r] for r in own.row[own.first[k] : own.first[k + 1]].tolist()]
            k += 1
        return []


def inside(words: C.Words, at: np.ndarray, size: int) -> np.ndarray:
    """Those of the window starts whose windows stay in their row."""
    return at[np.searchsorted(words.at, at, "right") == np.searchsorted(words.at, at + size - 1, "right")]


def leaks_of(column: pa.Array, found: WindowSet) -> Iterator[tuple[int, C.Words, np.ndarray, list[set]]]:
    """For each block: its first row, its words, which words are hit, and the items of each row."""
    for start, end, buf, offs, _ in C.blocks(column):
        words = C.Words(buf, offs, OWN)
        hashed = words.hashes()
        step = np.zeros(len(hashed) + 1, dtype=np.int64)
        items: list[set] = [set() for _ in range(end - start)]
        for size, own in found.lengths.items():
            grams = C.windows(hashed, size)
            at = inside(words, own.known(grams), size)
            for i, row in zip(at.tolist(), (np.searchsorted(words.at, at, "right") - 1).tolist(), strict=True):
                who = found.items(size, grams[i], words.normal(i, size))
                if who:
                    items[row].update(who)
                    step[i] += 1
                    step[i + size] -= 1
        yield start, words, np.cumsum(step[:-1]) > 0, items


def window_set(bench: DataFrame, n: int, max_bytes: int) -> WindowSet | None:
    """The benchmark's windows, or None where its texts or the windows' arrays are larger than the bound."""
    known = bench.filter("text is not null").select("item_id", "text")
    total = known.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    if total > max_bytes:
        return None
    found = WindowSet(sorted((tuple(x) for x in known.distinct().collect()), key=repr), n)
    return found if found.nbytes() <= max_bytes else None


def find_leaks(docs: DataFrame, bench: DataFrame, n: int = 10, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` and ``hit_items`` (sorted ids of the items that occur)."""
    found = window_set(bench, n, max_broadcast_bytes)
    if found is None:
        return leaks_by_join(docs, bench, n)
    shared, key = docs.sparkSession.sparkContext.broadcast(found), uuid.uuid4().hex
    rest = docs.drop(*RESULT.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = C.held(key, lambda: shared.value)
        for batch in batches:
            n_words, n_hit, who = [], [], []
            for _, words, hit, items in leaks_of(batch.column("text"), own):
                total = np.concatenate(([0], np.cumsum(hit)))
                n_words += words.counts.tolist()
                n_hit += (total[words.at[1:]] - total[words.at[:-1]]).tolist()
                who += [sorted(x - {None}) for x in items]
            added = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(who, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *RESULT.names])

    return C.map_arrow(rest, run, T.StructType([*rest.schema.fields, *RESULT.fields]))


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 10, remove: str = "document", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``docs`` without contaminated rows, or with the hit words cut out of their texts.

    ``remove``: "document" drops each row with a hit; "span" cuts every run of hit words.  The schema
    stays as it is.
    """
    if remove not in ("document", "span"):
        raise ValueError("remove must be 'document' or 'span'")
    found = window_set(bench, n, max_broadcast_bytes)
    if found is None:
        return decontaminate_by_join(docs, bench, n, remove)
    shared, key, place = docs.sparkSession.sparkContext.broadcast(found), uuid.uuid4().hex, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = C.held(key, lambda: shared.value)
        for batch in batches:
            keep, cut = np.ones(batch.num_rows, dtype=bool), {}
            for start, words, hit, _ in leaks_of(batch.column("text"), own):
                for row in np.unique(np.searchsorted(words.at, np.flatnonzero(hit), "right") - 1).tolist():
                    keep[start + row] = False
                    cut[start + row] = without(words, hit, row) if remove == "span" else None
            yield batch.filter(pa.array(keep)) if remove == "document" else with_texts(batch, place, cut)

    return C.map_arrow(docs, run, docs.schema)


def with_texts(batch: pa.RecordBatch, place: int, new: dict[int, str]) -> pa.RecordBatch:
    if not new:
        return batch
    text = batch.column(place).to_pylist()
    for row, own in new.items():
        text[row] = own
    return batch.set_column(place, batch.schema.field(place), pa.array(text, batch.schema.field(place).type))


def decontaminate_by_join(docs: DataFrame, bench: DataFrame, n: int, remove: str) -> DataFrame:
    """``decontaminate`` for a benchmark of any size."""
    names = [f"in_{i}" for i in range(len(docs.columns))]
    place = docs.columns.index("text")
    safe = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(docs.columns, names, strict=True)))
    back = lambda df: df.select(*(F.col(x).alias(c) for c, x in zip(docs.columns, names, strict=True)))
    hits = join_hits(docs.select("text"), bench, n)[1]
    keyed = safe.withColumn("key", text_key(names[place]))
    if remove == "document":
        return back(keyed.join(hits.select("key"), "key", "left_anti"))
    marked = keyed.join(hits.select("key", "spans"), "key", "left").select(*names, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, cut = batch.column("spans").to_pylist(), {}
            for row, own in enumerate(spans):
                if own:
                    buf, offs, _ = C.text_buffer(batch.column(place).slice(row, 1))
                    words = C.Words(buf, offs, OWN)
                    hit = np.zeros(len(words.start), bool)
                    for s in own:
                        hit[s["at"] : s["at"] + s["size"]] = True
                    cut[row] = without(words, hit, 0)
            yield with_texts(batch.select(names), place, cut)

    return back(C.map_arrow(marked, run, safe.schema))


def without(words: C.Words, hit: np.ndarray, row: int) -> str:
    """The text of a row without its runs of hit words."""
    a, b = int(words.at[row]), int(words.at[row + 1])
    first, last = row_bytes(words, row)
    edge = np.diff(hit[a:b].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    parts, at = [], first
    for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        parts.append(words.buf[at : words.start[a + x]].tobytes())
        at = int(words.end[a + y - 1])
    return b"".join([*parts, words.buf[at:last].tobytes()]).decode()


def row_bytes(words: C.Words, row: int) -> tuple[int, int]:
    return int(words.offs[row]), int(words.offs[row + 1])


WINDOW = "size int, place long, at int, gram binary, item_id long, key binary"
WINDOW_ARROW = pa.schema([("size", pa.int32()), ("place", pa.int64()), ("at", pa.int32()), ("gram", pa.binary()), ("item_id", pa.int64()), ("key", pa.binary())])


def text_key(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def join_hits(docs: DataFrame, bench: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """For each distinct text (by digest) its words' number, and for those with hits the items and ``spans``.

    Only a bitmap of 2**22 bits for each window length travels to the documents.  A window that many
    items hold is one row of the benchmark's side; one that many texts hold is a key that adaptive
    execution splits.
    """

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for start, end, buf, offs, _ in C.blocks(batch.column("text")):
                words, rows = C.Words(buf, offs, OWN), []
                hashed = words.hashes()
                for k in range(end - start):
                    a, count = int(words.at[k]), int(words.counts[k])
                    size = min(n, count)
                    for i, h in enumerate(C.windows(hashed[a : a + count], size).tolist() if size else []):
                        rows.append({"size": size, "place": h >> (64 - BITS), "gram": words.normal(a + i, size), "item_id": ids[start + k]})
                yield pa.RecordBatch.from_pylist(rows, WINDOW_ARROW)

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.unpackbits(v).astype(bool) for k, v in shared.value.items()}
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for start, end, buf, offs, _ in C.blocks(batch.column("text")):
                words = C.Words(buf, offs, OWN)
                hashed = words.hashes()
                rows = [{"size": 0, "place": int(words.counts[k]), "key": keys[start + k]} for k in range(end - start)]
                for size, own in held.items():
                    grams = C.windows(hashed, size)
                    at = inside(words, np.flatnonzero(own[grams >> np.uint64(64 - BITS)]), size)
                    row = np.searchsorted(words.at, at, "right") - 1
                    rows += [{"size": size, "at": int(i - words.at[r]), "gram": words.normal(i, size), "key": keys[start + r]} for i, r in zip(at.tolist(), row.tolist(), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, WINDOW_ARROW)

    items = C.map_arrow(bench.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text"), of_items, WINDOW)
    known = C.materialise(items.groupBy("size", "place", "gram").agg(F.collect_set("item_id").alias("ids")))
    bits: dict[int, np.ndarray] = {}
    for size, places in known.groupBy("size", F.expr("place div 65536 as part")).agg(F.collect_set("place").alias("places")).select("size", "places").toLocalIterator():
        bits.setdefault(size, np.zeros(1 << BITS, dtype=bool))[np.array(places)] = True
    shared = docs.sparkSession.sparkContext.broadcast({k: np.packbits(v) for k, v in bits.items()})
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), text_key("text").alias("key")).dropDuplicates(["key"])
    seen = C.materialise(C.map_arrow(texts, of_texts, WINDOW).select("size", "place", "at", "gram", "key"))
    hits = seen.filter("size > 0").select("key", "at", "size", "gram").join(known.select("size", "gram", "ids"), ["size", "gram"])
    spans = hits.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("hit_items"), F.collect_set(F.struct("at", "size")).alias("spans"))
    return seen.filter("size = 0").select("key", F.col("place").alias("n_words")), C.materialise(spans)


def leaks_by_join(docs: DataFrame, bench: DataFrame, n: int = 10) -> DataFrame:
    """``find_leaks`` for a benchmark of any size.  Equal texts are scanned once."""
    counts, spans = join_hits(docs.select("text"), bench, n)
    words = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))))
    found = counts.join(spans, "key", "left").select(F.col("key").alias("__key"), "n_words", F.coalesce(words, F.lit(0)).cast("long").alias("n_hit"), F.coalesce("hit_items", F.array().cast("array<bigint>")).alias("hit_items"))
    rest = docs.drop(*RESULT.names)
    return rest.withColumn("__key", text_key("text")).join(found, "__key").select(*rest.columns, *RESULT.names)
