"""Exact Jaccard join of word n-gram sets, and the groups that its links form.

A document's set holds its distinct k-word shingles as 64-bit hashes.  Documents with equal sets are
one node (the set's digest), so copies meet only there.  The join then goes:

1. One scan gives every document's digest and set size and sends each batch's shingles to buckets,
   once for each batch, as sorted differences of a few bytes.  The buckets count documents exactly
   and answer each batch with the shingles that occur more than once; a very common shingle is one
   entry for each batch.
2. Shingles are ordered rare first by these counts.  Two sets can only link if their prefixes in that
   order share a shingle.  Unique shingles fill the prefixes' first places and match nothing, so
   only the rest of a prefix is posted, packed by bucket.  Very common ones are salted by node.
3. In a bucket, the members of a shingle meet the group's centre (a star, never all pairs), checked
   by length, position, and how many of their shingles occur elsewhere at all.  Groups of three or
   more are kept for step 5.
4. A pair's suffixes are bounded by cell counts of both sets; what remains is verified once per pair
   on the whole sets, which are gathered only for nodes that may be in a pair.  Components of the
   verified links are found by alternating large and small stars.
5. Groups whose members lie in several components are open.  Each gets a reference, the node that
   most of its members met, and every member is written as its difference from the reference: a
   shingles of it missing, b others added.  With ``g = den * a + num * b`` and K = (den - num) times
   the reference's size, two members link exactly if ``(num + den) * x >= g + g' - K``, where x counts
   what their differences share; a member links with the reference if g <= K.  Two members that both
   do are in one component, so one of any pair left has g > K, and then x must be at least a share of
   both differences.  That is a join with rare-first prefixes of its own, over differences: what the
   members of a group of near copies have in common is not in them, so its pairs follow what
   members share beyond the group, not the square of its size.  The pairs found are verified like
   the first, and the components of all links are the result.

Two sets link when ``den * overlap >= num * union``.  Null texts and texts without words have empty
sets and link with nothing; an empty table gives no rows.  Repeated rows and ids are rows of their own,
and of tied ids the texts' hashes decide.  A very long text is one set like any other.  Columns other
than ``doc_id`` and ``text`` are not read.  Shingles and sets are known by 64-bit hashes under a random
seed of each call; among n of them an equality has a chance of about n**2 / 2**65, and would shift
an overlap by one (shingles) or join two documents (sets).
"""

from __future__ import annotations

import secrets
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import common as C

WORDS = 5
NUM, DEN = 75, 100
BATCH_TOKENS = 1 << 20
BUCKET_TOKENS = 1 << 20
SALT_ROWS = 1 << 16
SALTS = 32
LARGE = 1024
REFERENCE_ROWS = 256  # members that meet one copy of their reference's set
FILTER_BITS = 26
SUFFIX_CELLS = 256
BROADCAST_IDS = 1_000_000  # ids of 8 bytes; more are joined by shuffle
OWN = C.space_words()


def digest(own: np.ndarray) -> int:
    """A set's 64-bit identity from its sorted hashes."""
    with np.errstate(over="ignore"):
        x = np.array([C.mix(own + np.uint64(0x9E3779B97F4A7C15)).sum(), len(own)], np.uint64)
        return int(C.signed(C.mix(x[:1] + x[1:] * np.uint64(0xBF58476D1CE4E5B9)))[0])


def sets_of(column: pa.Array, k: int, seed: int = 0) -> Iterator[np.ndarray]:
    for _, _, buf, offs, _ in C.blocks(column):
        yield from C.shingles(C.Words(buf, offs, OWN), k, seed)


def least_overlap(a, b, num: int = NUM, den: int = DEN):
    """The smallest overlap at which sets of these sizes link."""
    return -(-num * (a + b) // (num + den))


def prefix(n, num: int = NUM, den: int = DEN):
    """Sets of this size that link with anything share one of so many first shingles."""
    return n - -(-num * n // den) + 1


def token_buckets(docs: DataFrame) -> int:
    """How many buckets hold about ``BUCKET_TOKENS`` shingles each, going by the texts' bytes."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    return max(8, int(size) // (6 * BUCKET_TOKENS) + 1)


def planes(x: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences, byte by byte: the high bytes are mostly zero and compress."""
    return np.diff(x.astype("<u4"), prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(flat).view("<u4").ravel(), dtype=np.uint32)


SCAN = "bucket int, batch long, doc_id long, key long, d long, n long, shingle binary, times binary, owner binary"
SCAN_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("d", pa.int64()), ("n", pa.int64()), ("shingle", pa.binary()), ("times", pa.binary()), ("owner", pa.binary())])


def scan_shingles(docs: DataFrame, buckets: int, k: int, seed: int) -> DataFrame:
    """The one scan of all texts, as rows to be shuffled by ``bucket``.

    For each document its id, digest and set size.  For each batch of documents (``shingle`` is null:
    its distinct sets' digests and sizes; bucket -1: the shingles that several of its sets share, with
    their owners), and for each bucket the batch's shingles there, once each, with their counts and
    the owners of those that occur once.  So a shingle has one entry for each batch, however common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen = TaskContext.get().partitionId() << 32, set()
        held, nodes, sizes, total = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(held)
            owner = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in held])
            key = C.mix(every) % np.uint64(buckets) << np.uint64(32) | every >> np.uint64(32)
            by = np.argsort(key, kind="stable")
            key, owner = key[by], owner[by]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            count = np.diff(start, append=len(key))
            unique, lead = key[start], owner[start]
            many = count > 1
            rows = [{"bucket": number % buckets, "batch": number, "times": np.array(nodes, np.int64).tobytes(), "owner": narrow(np.array(sizes))}]
            if many.any():
                inside = np.repeat(many, count)
                rows.append({"bucket": number % buckets, "batch": number, "n": -1, "shingle": unique[many].tobytes(), "times": narrow(count[many]), "owner": narrow(owner[inside])})
            cut = np.searchsorted(unique >> np.uint64(32), np.arange(buckets + 1))
            for i in np.flatnonzero(np.diff(cut)).tolist():
                part = slice(cut[i], cut[i + 1])
                rows.append({"bucket": i, "batch": number, "shingle": planes(unique[part] & np.uint64(0xFFFFFFFF)), "times": narrow(count[part]), "owner": narrow(lead[part][~many[part]])})
            yield pa.RecordBatch.from_pylist(rows, SCAN_ARROW)

        for batch in batches:
            ids, lengths = [], []
            for own in sets_of(batch.column("text"), k, seed):
                d = digest(own) if len(own) else None
                ids.append(d)
                lengths.append(len(own))
                if d is None or d in seen:
                    continue
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(d)
                held.append(own)
                nodes.append(d)
                sizes.append(len(own))
                total += len(own)
                if total >= BATCH_TOKENS:
                    yield from flush()
                    held, nodes, sizes, total, number = [], [], [], 0, number + 1
            n = batch.num_rows
            spread = pa.array((np.arange(n) + number) % buckets, pa.int32())
            none = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([spread, pa.nulls(n, pa.int64()), batch.column("doc_id"), batch.column("key"), pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), none, none, none], schema=SCAN_ARROW)
        if held:
            yield from flush()

    return C.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text"), run, SCAN)


COUNTED = "batch long, doc_id long, key long, d long, n long, shingle binary, times binary, owner binary"
COUNTED_ARROW = pa.schema(list(SCAN_ARROW)[1:])
MANY = 0xFFFFFFFF


def count_shingles(scanned: DataFrame, spread: int) -> DataFrame:
    """Exact document counts by bucket.  Each batch gets back its shingles that occur elsewhere too or
    several times in it: a rank of the count over the shingle's place, and its owner (``MANY``: see the
    batch's own list).  Rows of documents and batches pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def answer() -> Iterator[pa.RecordBatch]:
            parts = [unplanes(r[1]) for r in held]
            size = [len(x) for x in parts]
            every, times = np.concatenate(parts), np.concatenate([widen(r[2]) for r in held])
            by = np.argsort(every, kind="stable")
            start = np.flatnonzero(np.concatenate(([True], np.diff(every[by]) != 0)))
            total = np.add.reduceat(times[by], start)
            counts = np.empty(len(every), np.int64)
            counts[by] = np.repeat(total, np.diff(start, append=len(every)))
            at = 0
            for (batch, _, _, owner), n in zip(held, size, strict=True):
                own, mine, count = every[at : at + n], times[at : at + n], counts[at : at + n]
                at += n
                who = np.full(n, MANY, np.int64)
                who[mine == 1] = widen(owner)
                shared = count > 1
                if shared.any():
                    ids = rank_of(count[shared]).astype(np.uint64) << np.uint64(56) | np.uint64(now) << np.uint64(32) | own[shared].astype(np.uint64)
                    yield pa.RecordBatch.from_pylist([{"batch": batch, "n": -2, "shingle": ids.tobytes(), "owner": who[shared].astype("<u4").tobytes()}], COUNTED_ARROW)

        for batch in batches:
            rows = batch.num_rows
            tokens = np.asarray(batch.column("shingle").is_valid()) & np.asarray(batch.column("n").is_null())
            rest = batch.filter(pa.array(~tokens))
            if rest.num_rows:
                yield pa.RecordBatch.from_arrays(rest.columns[1:], schema=COUNTED_ARROW)
            if rows > rest.num_rows:
                own = batch.filter(pa.array(tokens))
                for bucket, *row in zip(*(own.column(c).to_pylist() for c in ("bucket", "batch", "shingle", "times", "owner")), strict=True):
                    if bucket != now and held:
                        yield from answer()
                        held = []
                    now = bucket
                    held.append(row)
        if held:
            yield from answer()

    return C.map_arrow(scanned.repartition(spread, "bucket").sortWithinPartitions("bucket"), run, COUNTED)


POSTED = "bucket int, shingle binary, place binary, run binary, node binary, size binary, shared binary, weight binary"


def post(counted: DataFrame, spread: int, buckets: int, num: int, den: int) -> DataFrame:
    """Prefixes by bucket of shingle.  A set's unique shingles come first and can't match, so they only
    take up places; what is left of the prefix is posted in order of count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def prefixes() -> Iterator[pa.RecordBatch]:
            lead = [r for r in held if r[0] is None]
            node, size = np.frombuffer(lead[0][2], np.int64), widen(lead[0][3])
            local = [r for r in held if r[0] == -1]
            parts, owners = [], []
            for _, shingle, _, owner in (r for r in held if r[0] == -2):
                ids, who = np.frombuffer(shingle, np.uint64), np.frombuffer(owner, "<u4").astype(np.int64)
                parts.append(ids[who != MANY])
                owners.append(who[who != MANY])
                common = ids[who == MANY]
                if len(common):
                    keys, times, every = np.frombuffer(local[0][1], np.uint64), widen(local[0][2]), widen(local[0][3])
                    first = np.cumsum(times) - times
                    at = np.searchsorted(keys, common & np.uint64((1 << 56) - 1))
                    n = times[at]
                    parts.append(np.repeat(common, n))
                    ends = np.cumsum(n)
                    owners.append(every[np.repeat(first[at] - (ends - n), n) + np.arange(ends[-1])])
            if not parts:
                return
            s, o = np.concatenate(parts), np.concatenate(owners)
            by = np.lexsort((s, o))
            s, o = s[by], o[by]
            shared = np.bincount(o, minlength=len(node))
            weight = (np.bincount(o, weights=(s >> np.uint64(56)).astype(float), minlength=len(node)) / np.maximum(size, 1) * 64).astype(np.int64)
            first = np.cumsum(shared) - shared
            place = np.arange(len(s)) - first[o] + (size - shared)[o]
            kept = place < prefix(size, num, den)[o]
            s, o, place = s[kept], o[kept], place[kept]
            if len(s):
                yield packed(s, place, node[o], size[o], shared[o], weight[o], buckets)

        for batch in batches:
            for number, *row in zip(*(batch.column(c).to_pylist() for c in ("batch", "n", "shingle", "times", "owner")), strict=True):
                if number != now and held:
                    yield from prefixes()
                    held = []
                now = number
                held.append(row)
        if held:
            yield from prefixes()

    return C.map_arrow(counted.filter("batch is not null").repartition(spread, "batch").sortWithinPartitions("batch"), run, POSTED)


def packed(s, at, d, n, shared, weight, buckets: int) -> pa.RecordBatch:
    """Postings as one row for each bucket, with runs of one node written once."""
    to = bucket_of(s, d, buckets)
    by = np.argsort(to, kind="stable")
    s, at, d, n, shared, weight, to = s[by], at[by], d[by], n[by], shared[by], weight[by], to[by]
    cut = np.flatnonzero(np.diff(to, prepend=-1, append=-2))
    names = ("bucket", "shingle", "place", "run", "node", "size", "shared", "weight")
    rows: dict[str, list] = {c: [] for c in names}
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        first = np.flatnonzero(np.concatenate(([True], d[a + 1 : b] != d[a : b - 1])))
        values = (int(to[a]), s[a:b].tobytes(), narrow(at[a:b]), narrow(np.diff(first, append=b - a)), d[a:b][first].tobytes(), *(narrow(x[a:b][first]) for x in (n, shared, weight)))
        for c, v in zip(names, values, strict=True):
            rows[c].append(v)
    return pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in names[1:])], names=list(names))


def rank_of(counts: np.ndarray) -> np.ndarray:
    """Document counts on a scale of sixths of a power of two."""
    return np.minimum(np.log2(counts.astype(np.float64)) * 6, 255).astype(np.uint8)


def salts(shingle: np.ndarray) -> np.ndarray:
    """Into how many parts a shingle is dealt, from the count that its rank stands for."""
    return (np.exp2((shingle >> np.uint64(56)).astype(np.float64) / 6) / SALT_ROWS).astype(np.int64) + 1


def bucket_of(shingle: np.ndarray, node: np.ndarray, buckets: int) -> np.ndarray:
    part = salts(shingle)
    salt = np.where(part > 1, (node.view(np.uint64) % part.astype(np.uint64)), 0).astype(np.uint64)
    with np.errstate(over="ignore"):
        return (C.mix(shingle + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)


def narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers with their width in the first byte."""
    top = int(x.max(initial=0))
    kind = "u1" if top < 1 << 8 else "u2" if top < 1 << 16 else "u4"
    return kind[1].encode() + x.astype(kind).tobytes()


def widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[:1].decode()}", offset=1).astype(np.int64)


def meet(posted: DataFrame, spread: int, num: int, den: int) -> DataFrame:
    """Rows of ``gid``, ``a``, ``b``, ``n``, ``s``: pairs (gid null), and members ``a`` of groups to come back to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "shingle", "place", "run", "node", "size", "shared", "weight")), strict=True):
                if bucket != now and held:
                    yield from joined(held, num, den)
                    held = []
                now = bucket
                held.append(row)
        if held:
            yield from joined(held, num, den)

    return C.map_arrow(posted.repartition(spread, "bucket").sortWithinPartitions("bucket"), run, "gid long, a long, b long, n long, s long")


def joined(held: list[list], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The star pairs and open groups of one bucket.  A group's centre is the member whose shingles are
    the most common on average: an original rather than one of its variants."""
    runs = [widen(r[2]) for r in held]
    shingle, place = np.concatenate([np.frombuffer(r[0], np.uint64) for r in held]), np.concatenate([widen(r[1]) for r in held])
    node = np.concatenate([np.repeat(np.frombuffer(r[3], np.int64), k) for r, k in zip(held, runs, strict=True)])
    size, shared, weight = (np.concatenate([np.repeat(widen(r[i]), k) for r, k in zip(held, runs, strict=True)]) for i in (4, 5, 6))
    by = np.lexsort((node, -weight, shingle))
    shingle, place, node, size, shared = (v[by] for v in (shingle, place, node, size, shared))
    new = np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])))
    shingle, place, node, size, shared = (v[new] for v in (shingle, place, node, size, shared))
    start = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
    count = np.diff(start, append=len(shingle))
    first = np.repeat(start, count)
    other = np.arange(len(shingle)) != first
    a, b = first[other], np.flatnonzero(other)
    low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    most = np.minimum(place[a], place[b]) + np.minimum(size[a] - place[a], size[b] - place[b])
    most = np.minimum(most, np.minimum(shared[a], shared[b]))
    fits = (low * den >= high * num) & (most >= least_overlap(size[a], size[b], num, den))
    ends = np.sort(np.stack((node[a[fits]], node[b[fits]]), axis=1), axis=1)
    pairs = np.unique(ends, axis=0)
    split = salts(shingle[start]) > 1
    again = (count > 2) | split
    kept, gid = [], []
    known: set[int] = set()
    for s, k, salted in zip(start[again].tolist(), count[again].tolist(), split[again].tolist(), strict=True):
        key = int(C.signed(shingle[s : s + 1])[0]) if salted else digest(np.sort(node[s : s + k].view(np.uint64)))
        if salted or key not in known:
            known.add(key)
            kept.append(np.arange(s, s + k))
            gid.append(np.full(k, key))
    rows = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    gids = np.concatenate(gid) if gid else np.zeros(0, np.int64)
    names = ["gid", "a", "b", "n", "s"]
    for i in range(0, len(pairs), 1 << 16):
        part = pairs[i : i + (1 << 16)]
        none = pa.nulls(len(part), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(part[:, 0]), pa.array(part[:, 1]), none, none], names=names)
    for i in range(0, len(rows), 1 << 16):
        part = rows[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(gids[i : i + (1 << 16)]), pa.array(node[part]), pa.nulls(len(part), pa.int64()), pa.array(size[part]), pa.array(shared[part])], names=names)


def gather_sets(docs: DataFrame, nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """``d`` and ``own`` (sorted hashes as bytes) of the nodes.

    A bitmap of 2**FILTER_BITS bits at most tells the scan which sets may be wanted; it never loses one.
    """
    spot = F.pmod(F.xxhash64("d"), F.lit(1 << FILTER_BITS)) + 1  # these functions count from 1
    bits = nodes.select(spot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    wanted = np.zeros((1 << FILTER_BITS) // 32768 * 4096, np.uint8)
    for part, data in bits.collect():  # 8 MB at most
        wanted[(part - 1) * 4096 : part * 4096] = np.frombuffer(bytes(data), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(wanted.tobytes(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bitmap, seen = np.frombuffer(zlib.decompress(shared.value), np.uint8), set()
        for batch in batches:
            ids, blobs = [], []
            for own in sets_of(batch.column("text"), k, seed):
                if not len(own):
                    continue
                d = digest(own)
                s = xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), seed=42) % (1 << FILTER_BITS)
                if bitmap[s >> 3] >> (s & 7) & 1 and d not in seen:
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(d)
                    ids.append(d)
                    blobs.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["d", "own"])

    found = C.map_arrow(docs.select("text"), run, "d long, own binary")
    return C.materialise(found.dropDuplicates(["d"]).join(nodes, "d", "left_semi"))


def cells(own: np.ndarray) -> np.ndarray:
    return np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=SUFFIX_CELLS)


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a``, ``b`` with ``link``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                need = least_overlap(len(p), len(q), num, den)
                most = int(np.minimum(cells(p), cells(q)).sum())  # the suffix filter
                links.append(most >= need and len(np.intersect1d(p, q, assume_unique=True)) >= need)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(links, pa.bool_())], names=["a", "b", "link"])

    with_a = pairs.join(sets.select(F.col("d").alias("a"), F.col("own").alias("x")), "a")
    both = with_a.join(sets.select(F.col("d").alias("b"), F.col("own").alias("y")), "b").select("a", "b", "x", "y")
    return C.map_arrow(both, run, "a long, b long, link boolean")


def components(edges: DataFrame) -> DataFrame:
    """``d`` and ``comp`` (the smallest node reachable) by alternating large and small stars.

    Minima are grouped aggregations that combine inside tasks, so a node of any degree is fine; each
    round is written to the shared folder.
    """
    pick = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = C.materialise(pick(edges))
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state["n"]:
            return now.select(F.col("u").alias("d"), F.col("v").alias("comp"))
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = C.materialise(pick(large))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = C.materialise(pick(small))


def with_facts(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Each row with the facts of its ``key``, where there are any (one row of facts for each key).  Facts
    are broadcast if a count shows that they are few, else copied ``SALTS`` times: no key is one task's."""
    facts = C.materialise(facts)
    if facts.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(facts), key)
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")


def open_groups(groups: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """``gid``, ``d``, ``c``: the members, with their components, of groups that span several, without
    members that can link with no size in their group."""
    here = C.materialise(groups.join(found, "d", "left").select("gid", "d", "n", "s", F.coalesce("comp", "d").alias("c")))
    parted = lambda df, *more: df.groupBy("gid").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), *more).filter("c0 <> c1").drop("c0", "c1")
    several = with_facts(here, parted(here, F.min("n").alias("low")), "gid")
    partner = F.greatest("low", F.ceil(F.col("n") * num / den))
    able = C.materialise(several.filter(F.col("s") >= F.ceil((F.col("n") + partner) * num / (num + den))).select("gid", "d", "c"))
    return with_facts(able, parted(able), "gid")


def with_reference(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``ref``, ``d``, ``c``, once each: a group's reference is that of its members' partners, or of
    themselves, which is in most pairs."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("k"))
    other = degree.select(F.col("a").alias("b"), "k")
    best = both.join(other, "b").groupBy("a").agg(F.max(F.struct("k", "b")).alias("m"))
    own = best.join(degree, "a").select(F.col("a").alias("d"), F.greatest("m", F.struct("k", F.col("a").alias("b"))).alias("m"))
    met = members.join(own, "d", "left").select("gid", "d", "c", F.coalesce("m", F.struct(F.lit(0).cast("long").alias("k"), F.col("d").alias("b"))).alias("m"))
    met = C.materialise(met)
    refs = met.groupBy("gid").agg(F.max("m").alias("r")).select("gid", F.col("r.b").alias("ref"))
    return C.materialise(with_facts(met, refs, "gid").select("ref", "d", "c").distinct())


def differences(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Each member's difference from its reference: ``g``, ``limit`` (K), its size ``m`` and shingles ``t``.

    A reference of many members is copied, so that they need not meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, limit, m, t = [], [], [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                own, ref = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                less, more = np.setdiff1d(ref, own, assume_unique=True), np.setdiff1d(own, ref, assume_unique=True)
                g.append(den * len(less) + num * len(more))
                limit.append((den - num) * len(ref))
                m.append(len(less) + len(more))
                t.append(C.signed(np.concatenate((less, more))))
            ends = np.concatenate(([0], np.cumsum(m))).astype(np.int32)
            flat = pa.array(np.concatenate(t) if t else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("ref", "d", "c")), *(pa.array(x, pa.int64()) for x in (g, limit, m)), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["ref", "d", "c", "g", "limit", "m", "t"])

    parts = C.materialise(members.groupBy("ref").agg(F.expr(f"int(count(*) div {REFERENCE_ROWS}) + 1").alias("parts")))
    copies = parts.join(sets, parts["ref"] == sets["d"]).select("ref", F.col("own").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = with_facts(members, parts, "ref").withColumn("part", F.pmod(F.xxhash64("d"), F.col("parts")).cast("int"))
    both = dealt.join(sets.select("d", F.col("own").alias("x")), "d").join(copies, ["ref", "part"]).select("ref", "d", "c", "x", "y")
    return C.materialise(C.map_arrow(both, run, "ref long, d long, c long, g long, limit long, m long, t array<long>"))


def pairs_of_differences(diff: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``a`` < ``b`` of different components that may link, by prefixes of their differences."""
    far = F.col("g") > F.col("limit")  # not linked with the reference
    asked = diff.filter(far).select("ref").distinct()
    diff = with_facts(diff.withColumn("far", far), asked, "ref")
    token = diff.select("ref", "d", "c", "g", "limit", "m", "far", F.explode("t").alias("t"))
    counts = token.groupBy("ref", "t").agg(F.count("*").alias("k"), F.max("far").alias("any")).filter("k > 1 and any").select("ref", "t", "k")
    known = token.join(counts, ["ref", "t"]).groupBy("ref", "d", "c", "g", "limit", "m", "far").agg(F.sort_array(F.collect_list(F.struct("k", "t"))).alias("ts"))
    # all that a difference must share with another: with one of g > K, or, if its own g is, with any
    least = F.when(F.col("far"), F.ceil((F.col("g") - F.col("limit")) / den)).otherwise(F.ceil((F.col("g") + 1) / (num + den)))
    known = known.withColumn("s", F.size("ts").cast("long")).withColumn("lead", F.col("m") - F.col("s"))
    first = F.slice("ts", 1, F.greatest(F.col("m") - least + 1 - F.col("lead"), F.lit(0)).cast("int"))
    posted = known.select("ref", "d", "c", "g", "limit", "m", "far", "s", "lead", F.posexplode(first).alias("at", "x"))
    posted = C.materialise(posted.select("ref", F.col("x.t").alias("t"), "d", "c", "g", "limit", "m", "far", "s", (F.col("lead") + F.col("at")).alias("at")))
    p, q = posted.filter("far").alias("p"), posted.alias("q")
    most = F.least("p.s", "q.s", F.least("p.at", "q.at") + F.least(F.col("p.m") - F.col("p.at"), F.col("q.m") - F.col("q.at")))
    may = (F.col("p.c") != F.col("q.c")) & (~F.col("q.far") | (F.col("p.d") < F.col("q.d"))) & (most * (num + den) >= F.col("p.g") + F.col("q.g") - F.col("p.limit"))
    met = p.join(q, (F.col("p.ref") == F.col("q.ref")) & (F.col("p.t") == F.col("q.t")) & may)
    return met.select(F.least("p.d", "q.d").alias("a"), F.greatest("p.d", "q.d").alias("b")).distinct()


def placed_rows(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``doc_id``, ``key`` (the text's hash), ``n`` and ``c`` (component; null for empty sets) of each row."""
    seed, mark = secrets.randbits(64), C.mark()
    buckets = token_buckets(docs)
    spread = max(8, min(buckets, 2000))
    counted = C.materialise(count_shingles(scan_shingles(docs, buckets, k, seed), spread))
    rows = counted.filter("batch is null").select("doc_id", "key", "d", "n")
    met = C.materialise(meet(post(counted, spread, buckets, num, den), spread, num, den))
    pairs = C.materialise(met.filter("gid is null").select("a", "b").distinct())
    groups = C.materialise(met.filter("gid is not null").select("gid", F.col("a").alias("d"), "n", "s").distinct())
    nodes = pairs.select(F.col("a").alias("d")).union(pairs.select("b")).union(groups.select("d")).distinct()
    sets = gather_sets(docs, nodes, k, seed)
    links = C.materialise(verify(pairs, sets, num, den)).filter("link").select("a", "b")
    found = components(links)
    still = C.materialise(open_groups(groups, found, num, den))
    if not still.isEmpty():
        diff = differences(with_reference(still, pairs), sets, num, den)
        near = diff.filter("g <= limit and d <> ref").select(F.least("d", "ref").alias("a"), F.greatest("d", "ref").alias("b"))
        more = C.materialise(pairs_of_differences(diff, num, den))
        checked = verify(more, sets, num, den).filter("link").select("a", "b")
        found = components(found.select(F.col("d").alias("a"), F.col("comp").alias("b")).unionByName(near).unionByName(checked))
    placed = C.materialise(rows.join(found, "d", "left").select("doc_id", "key", "n", F.coalesce("comp", "d").alias("c")))
    C.release(mark)
    return placed


def jaccard_groups(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for each row of ``docs`` (``doc_id``, ``text``)."""
    placed = placed_rows(docs, k, num, den)
    named = placed.filter("c is not null").groupBy("c").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    found = with_components(placed.filter("c is not null"), named, placed.count()).unionByName(placed.filter("c is null").withColumn("least_id", F.col("doc_id")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("least_id").alias("component_id"))


def with_components(rows: DataFrame, facts: DataFrame, total: int) -> DataFrame:
    """Each row with the facts of its component ``c`` (one row each, with ``copies``, its size).  Facts of
    large components are broadcast, at most ``LARGE * 64`` of them, so no component meets in one task."""
    facts, large = C.materialise(facts), max(LARGE, total // (LARGE * 64))
    hot = facts.filter(F.col("copies") > large).drop("copies")
    cold = facts.filter(F.col("copies") <= large).drop("copies")
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), "c", "left")
    done = marked.filter("__hot").drop("__hot")
    return done.unionByName(marked.filter("__hot is null").select(*rows.columns).join(cold, "c"))


def one_of_each(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of ``docs`` that stay when one of each group does: the smallest id, of equal ids the text
    with the smallest hash, and of rows that are equal in both any one.  A null id comes last, so it
    stays only where its whole group has none.  Rows without words all stay."""
    placed = placed_rows(docs, k, num, den).filter("c is not null")
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    each = C.materialise(placed.groupBy("c", name.alias("r")).agg(F.count("*").alias("times")))
    first = each.groupBy("c").agg(F.min("r").alias("first"), F.count("*").alias("copies"))
    each = with_components(each, first, each.count())
    each = C.materialise(each.select("r.__id", "r.__key", F.col("r").eqNullSafe(F.col("first")).alias("stays"), "times"))
    gone, twice = each.filter("not stays").select("__id", "__key"), each.filter("stays and times > 1").select("__id", "__key")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    is_row = lambda other: docs["doc_id"].cast("long").eqNullSafe(other["__id"]) & (F.xxhash64(docs["text"]) == other["__key"])
    kept = docs.join(gone, is_row(gone), "left_anti")
    if twice.isEmpty():
        return kept
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("text")
    once = kept.join(twice, is_row(twice), "left_semi").withColumn("__i", F.row_number().over(order)).filter("__i = 1").drop("__i")
    return kept.join(twice, is_row(twice), "left_anti").unionByName(once)
