"""Exact Jaccard join of documents over five-word shingles, by pivots and Voronoi regions of the metric space.

1. Census. A shingle of only one document brings it no nearer to any other, so a document's distance to every other
   is at least its share of such shingles. Documents for which that bound exceeds the radius are alone; the others
   keep the shingles they share with somebody, rarest first, and their full size. Equal sets become one point.
2. First pivots. Nearly all distances of this space are 1, where nearness to a pivot tells nothing. But a point within
   the radius of another has one of its first ``window`` shingles in common with it. The points with such a shingle
   take the same one of them as pivot, and a pivot's region are the points that took it: every pair within the radius
   lies in a region, and what lies in none is alone.
3. Recursion. A region over LEAF points is split by new pivots, drawn from its points. Each point is at home with its
   nearest pivot, or in the far part if none is within NEAR_HOME. A point also goes to each pivot that is at most two
   radii farther than its own and within NEAR_HOME and a radius: no pair within the radius can be parted by that (the
   triangle inequality). Points within the radius of a pivot are linked to it at once, so of its region only pairs with
   a point outside that core are left; a region that is all core is done.
4. Leaves. In a region of at most LEAF points, distances to the pivot leave a window of candidates for each point
   (the triangle inequality again), and points join until all are linked into one group or have been compared.
   Regions that pivots don't make smaller, as all distances in them are alike, are joined as pairs of blocks: each
   block of points outside the core with each block of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternfold.llm import blocks, shared
from patternfold.llm.blocks import mix, slices
from patternfold.llm.components import components

#: Two documents link when NEAR * (size of union) <= 100 * (size of intersection).
NEAR = 75
SIZE = 5
LEAF = 1024
#: Pivots of a region that is split (about), how near a home must be, how often regions are split at most, and to which
#: share of its parent a part must shrink to be split again.
PIVOTS, NEAR_HOME, LEVELS, SHRINK = 16, 0.5, 6, 0.8
_U = np.uint64
_DOC_BITS = _U(12)
_DOC = _U((1 << 12) - 1)
_ROWS = 1 << 12
_CENSUS, _SHARED, _DOCS, _COUNTS = 0, 1, 2, 3
_NAMES = ["bucket", "base", "kind", "packed", "more", "doc_ids"]
_DDL = "bucket int, base long, kind int, packed binary, more binary, doc_ids array<long>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    columns = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _NAMES)


def _stage(bits: int):
    """A slice's shingles, dealt by the first ``bits`` bits of their hash: 52 bits of hash and 12 of row in a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 32
        for batch in batches:
            for part in slices(batch):
                for i in range(0, part.num_rows, _ROWS):
                    yield _batch(_slice_rows(part.slice(i, _ROWS), base, bits))
                    base += _ROWS

    return run


def _slice_rows(part: pa.RecordBatch, base: int, bits: int) -> list[tuple]:
    h, counts = blocks.windows(blocks.words(part.column("text"), lower=True), SIZE)
    key = h & ~_DOC | np.repeat(np.arange(len(counts), dtype=_U), counts)
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    row = (key & _DOC).astype(np.int64)
    sizes = np.bincount(row, minlength=len(counts))
    home = base >> 12
    out = [(home & 0x7FFFFFFF, base, _DOCS, sizes.astype("<u4").tobytes(), None, part.column("doc_id").to_pylist())]
    if not len(key):
        return out
    same = (key[1:] ^ key[:-1]) <= _DOC
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    if twice.any():
        out.append((home & 0x7FFFFFFF, base, _SHARED, key[twice].tobytes(), None, None))
    single, common = key[~twice], key[twice & ~np.concatenate([[False], same])]
    held = np.bincount(np.cumsum(twice & ~np.concatenate([[False], same]))[twice], minlength=len(common) + 1)[1:]
    common = common & ~_DOC | np.minimum(held, _ROWS - 1).astype(_U)  # how many of the slice's documents hold it, in place of a row
    edges = np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits)
    a, b = np.searchsorted(single, edges).tolist(), np.searchsorted(common, edges).tolist()
    a, b = [0, *a, len(single)], [0, *b, len(common)]
    for k in range(1 << bits):
        if a[k + 1] > a[k] or b[k + 1] > b[k]:
            out.append((k, base, _CENSUS, single[a[k] : a[k + 1]].tobytes(), common[b[k] : b[k + 1]].tobytes(), None))
    return out


def _census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the shingles of each bucket, those that another document has too, with how frequent they are; the rest of the rows pass through."""
    held: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        other = np.flatnonzero(kind != _CENSUS)
        if len(other):
            yield batch.take(pa.array(other))
        for r in batch.take(pa.array(np.flatnonzero(kind == _CENSUS))).to_pylist():
            held.setdefault(r["bucket"], []).append((r["base"], np.frombuffer(r["packed"], _U), np.frombuffer(r["more"], _U)))
    for bucket in list(held):
        rows = held.pop(bucket)
        one, more = (np.concatenate([x[i] for x in rows]) for i in (1, 2))
        known, inverse = np.unique(np.concatenate([one, more]) >> _DOC_BITS, return_inverse=True)
        holders = np.bincount(inverse, weights=np.concatenate([np.ones(len(one)), (more & _DOC).astype(float)]), minlength=len(known))
        level = np.log2(np.maximum(holders, 1)).astype(np.uint8)  # how frequent, roughly: 2 ** level
        out = []
        for base, packed, common in rows:
            home = (base >> 12) & 0x7FFFFFFF
            for kind, own in ((_SHARED, packed), (_COUNTS, common)):
                at = np.searchsorted(known, own >> _DOC_BITS)
                at, own = at[holders[at] > 1], own[holders[at] > 1]
                if len(own):
                    out.append((home, base, kind, own.tobytes(), level[at].tobytes(), None))
        yield _batch(out)


_POINT = "key long, doc_id long, n_shingles long, alive boolean, digest binary, shingles binary"
_POINT_NAMES = ["key", "doc_id", "n_shingles", "alive", "digest", "shingles"]


def _assemble(near: int):
    """Rows of one slice, which stand together, to a row for each of its documents."""

    def finish(base: int, rows: list[dict]) -> pa.RecordBatch:
        info = next(r for r in rows if r["kind"] == _DOCS)
        sizes = np.frombuffer(info["packed"], "<u4").astype(np.int64)
        join = lambda kind, column, type_: np.concatenate([np.zeros(0, type_), *(np.frombuffer(r[column], type_) for r in rows if r["kind"] == kind)])
        inside = [r for r in rows if r["kind"] == _SHARED and r["more"] is None]  # shared within the slice: their counts came apart
        rows = [r for r in rows if r["more"] is not None]
        key, level = join(_SHARED, "packed", _U), join(_SHARED, "more", np.uint8)
        if inside:
            own = np.concatenate([np.frombuffer(r["packed"], _U) for r in inside])
            common, common_level = join(_COUNTS, "packed", _U) >> _DOC_BITS, join(_COUNTS, "more", np.uint8)
            order = np.argsort(common)
            key, level = np.concatenate([key, own]), np.concatenate([level, common_level[order][np.searchsorted(common[order], own >> _DOC_BITS)]])
        row = (key & _DOC).astype(np.int64)
        n = len(sizes)
        seen = np.bincount(row, minlength=n)
        alive = (sizes > 0) & (100 * seen >= near * sizes)
        key, row, level = key[alive[row]], row[alive[row]], level[alive[row]]
        order = np.lexsort((key, level, row))
        key, ends = key[order] >> _DOC_BITS, np.searchsorted(row[order], np.arange(n + 1))
        shingles = [key[a:b].tobytes() if up else None for a, b, up in zip(ends[:-1].tolist(), ends[1:].tolist(), alive.tolist())]
        digest = [hashlib.blake2b(s, digest_size=16).digest() if s is not None and c == m else None for s, c, m in zip(shingles, seen.tolist(), sizes.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(base + np.arange(n)), pa.array(info["doc_ids"], pa.int64()), pa.array(sizes), pa.array(alive), pa.array(digest, pa.binary()), pa.array(shingles, pa.binary())], _POINT_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and r["base"] != rows[0]["base"]:
                    yield finish(rows[0]["base"], rows)
                    rows = []
                rows.append(r)
        if rows:
            yield finish(rows[0]["base"], rows)

    return run


def points(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """Step 1, written to the shared folder: key (of the row), doc_id, n_shingles, alive, digest (of sets that are
    shared as a whole), shingles (shared ones, 8 bytes each, rarest first; for rows that are alive)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    shared.text_batches(spark)
    parts = max(docs.rdd.getNumPartitions(), 1)
    bits = max(4, (8 * parts - 1).bit_length())
    dealt = docs.mapInArrow(_stage(bits), _DDL).repartition(min(1 << bits, max(8 * parts, int(spark.conf.get("spark.sql.shuffle.partitions")))), "bucket").mapInArrow(_census, _DDL)
    met = dealt.repartition(max(2 * parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "base").sortWithinPartitions("base").mapInArrow(_assemble(near), _POINT)
    return shared.written(met, "points")


def window_size(n: np.ndarray, shared_: np.ndarray, near: int = NEAR) -> np.ndarray:
    """How many of its shared shingles, in a common order, a point must offer to meet all others in the radius.

    Two such points have ceil(near * n / 100) shingles in common, so one at least is among all but that many, and one.
    """
    return shared_ - -(-near * n // 100) + 1


_ASK, _PAIRS, _REPLY = 0, 1, 2
_OFFER = "bucket int, base long, kind int, shingles binary, keys binary"
_OFFER_NAMES = ["bucket", "base", "kind", "shingles", "keys"]


def _offers(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()])], _OFFER_NAMES)


def _rank(key: np.ndarray) -> np.ndarray:
    return mix(key.astype(_U) + _U(1))


def _offer(near: int, parts: int):
    """Of each batch of points: for every shingle in a window the best of its points, dealt by shingle; and all pairs of window shingle and point, which stay with the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, off = blocks.utf8(batch.column("shingles"))
            h = np.frombuffer(raw.tobytes(), _U)
            size = np.diff(off) // 8
            take = np.maximum(window_size(batch.column("n_shingles").to_numpy(), size, near), 0)
            h, key = h[blocks.ragged(off[:-1] // 8, take)], np.repeat(batch.column("key").to_numpy(), take)
            order = np.lexsort((_rank(key), h))
            h, key = h[order], key[order]
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            several = (np.diff(np.append(head, len(h))) > 1).astype(_U)
            first, best = h[head], key[head]
            bucket = (mix(first) >> _U(40)).astype(np.int64) % parts
            order = np.argsort(bucket, kind="stable")
            first, best, several = first[order] << _U(1) | several[order], best[order], several[order]
            ends = np.searchsorted(bucket[order], np.arange(parts + 1)).tolist()
            home = (base ^ base >> 32) & 0x7FFFFFFF
            yield _offers([(home, base, _PAIRS, h.tobytes(), key.tobytes()), *((k, base, _ASK, first[a:b].tobytes(), best[a:b].tobytes()) for k, a, b in zip(range(parts), ends, ends[1:]) if b > a)])
            base += 1

    return run


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shingle that two points have in their windows: the best of all batches is their pivot, told to each batch."""
    held: dict[int, list[tuple[int, bytes, bytes]]] = {}
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        other = np.flatnonzero(kind != _ASK)
        if len(other):
            yield batch.take(pa.array(other))
        for r in batch.take(pa.array(np.flatnonzero(kind == _ASK))).to_pylist():
            held.setdefault(r["bucket"], []).append((r["base"], np.frombuffer(r["shingles"], _U), np.frombuffer(r["keys"], np.int64)))
    for b in list(held):
        rows = held.pop(b)
        h, key = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
        several, h = h & _U(1), h >> _U(1)
        order = np.lexsort((_rank(key), h))
        head = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        size = np.diff(np.append(head, len(h)))
        some = (size > 1) | (np.add.reduceat(several[order], head) > 0)
        pivot, shared_ = np.empty_like(key), np.empty(len(key), bool)
        pivot[order], shared_[order] = np.repeat(key[order][head], size), np.repeat(some, size)
        out, a = [], 0
        for base, own, _ in rows:
            pick = shared_[a : a + len(own)]
            if pick.any():
                out.append(((base ^ base >> 32) & 0x7FFFFFFF, base, _REPLY, (own[pick] >> _U(1)).tobytes(), pivot[a : a + len(own)][pick].tobytes()))
            a += len(own)
        yield _offers(out)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch, whose rows stand together: its points with the pivots of their window shingles."""

    def finish(rows: list[dict]) -> pa.RecordBatch:
        pairs = next(r for r in rows if r["kind"] == _PAIRS)
        join = lambda column, type_: np.concatenate([np.zeros(0, type_), *(np.frombuffer(r[column], type_) for r in rows if r["kind"] == _REPLY)])
        h, pivot = join("shingles", _U), join("keys", np.int64)
        order = np.argsort(h)
        h, pivot = h[order], pivot[order]
        own, key = np.frombuffer(pairs["shingles"], _U), np.frombuffer(pairs["keys"], np.int64)
        if not len(h):
            own, key = own[:0], key[:0]
        at = np.minimum(np.searchsorted(h, own), max(len(h) - 1, 0))
        hit = h[at] == own
        pair = np.unique(np.stack([pivot[at[hit]], key[hit]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["pivot", "key"])

    rows: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and r["base"] != rows[0]["base"]:
                yield finish(rows)
                rows = []
            rows.append(r)
    if rows:
        yield finish(rows)


class Region:
    """Points with their shared shingles; distances from any of them to all by an index of their shingles."""

    def __init__(self, n: np.ndarray, sets: list[np.ndarray], near: int):
        self.n, self.near = n, near
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets) if len(sets) else np.zeros(0, _U)
        self.bounds = np.concatenate([[0], np.cumsum(size)])
        order = np.argsort(flat, kind="stable")
        self.point = np.repeat(np.arange(len(sets)), size)[order]
        _, start, inverse, count = np.unique(flat[order], return_index=True, return_inverse=True, return_counts=True)
        back = np.empty(len(flat), np.int64)
        back[order] = inverse
        self.start, self.count = start[back], count[back]

    def common(self, i: int) -> np.ndarray:
        a, b = self.bounds[i], self.bounds[i + 1]
        return np.bincount(self.point[blocks.ragged(self.start[a:b], self.count[a:b])], minlength=len(self.n))

    def join(self, pivot: int, core: np.ndarray | None = None) -> np.ndarray:
        """Groups of linked points (the least index in each). ``core``: points known to be linked with each other."""
        k = len(self.n)
        group = np.arange(k)
        if core is not None and core.any():
            group[core] = np.flatnonzero(core)[0]
        common = self.common(pivot)
        away = 1 - common / (self.n + self.n[pivot] - common)
        served = np.zeros(k, bool)
        radius = 1 - self.near / 100
        i = pivot
        while True:
            if i != pivot:
                common = self.common(i)
            # outside the window of distances to the pivot no link is possible
            near = (100 * common >= self.near * (self.n + self.n[i] - common)) & (np.abs(away - away[i]) <= radius + 1e-9)
            served[i] = True
            met = np.unique(np.append(group[near], group[i]))
            if len(met) > 1:
                group[np.isin(group, met)] = met[0]
            sizes = np.bincount(group, minlength=k)
            rest = np.flatnonzero(~served & (group != sizes.argmax()))
            if not len(rest):
                return group
            i = int(rest[np.argmax(away[rest])])


_ROW = "region long, key long, n_shingles long, shingles binary, core boolean, parent long"


def _join_region(near: int):
    """Links of a region or a pair of blocks: rows key, n_shingles, shingles, core, and region or pivot. Repeated keys count once."""

    def run(table: pa.Table) -> pa.Table:
        keys, first = np.unique(table.column("key").to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        n, core = table.column("n_shingles").to_numpy(), table.column("core").to_numpy()
        sets = [np.frombuffer(s, _U) for s in table.column("shingles").to_pylist()]
        at = np.flatnonzero(keys == table.column("region")[0].as_py())
        group = Region(n, sets, near).join(int(at[0]) if len(at) else 0, core)
        some = np.flatnonzero(group != np.arange(len(group)))
        return pa.table({"a": pa.array(keys[some]), "b": pa.array(keys[group[some]])})

    return run


def distances(n: np.ndarray, sets: list[np.ndarray], pivot_n: np.ndarray, pivot_sets: list[np.ndarray]) -> np.ndarray:
    """[point, pivot]: Jaccard distances of the whole sets, of which ``sets`` are the shared parts."""
    flat, owner = np.concatenate(pivot_sets), np.repeat(np.arange(len(pivot_sets)), [len(x) for x in pivot_sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    own, point = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    a, b = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
    at = blocks.ragged(a, b - a)
    common = np.bincount(np.repeat(point, b - a) * len(pivot_n) + owner[at], minlength=len(sets) * len(pivot_n)).reshape(len(sets), -1)
    return 1 - common / (n[:, None] + pivot_n[None] - common)


def _split(near: int, level: int):
    """Part of a region and its new pivots to rows of its parts, and links of points to pivots within the radius (rows without shingles: key and the pivot as parent)."""
    radius = 1 - near / 100

    def run(points_: pa.Table, pivots: pa.Table) -> pa.Table:
        region, size = points_.column("region")[0].as_py() if points_.num_rows else 0, points_.num_rows
        key, n = points_.column("key").to_numpy(), points_.column("n_shingles").to_numpy()
        shingles = points_.column("shingles").to_pylist()
        pivot_key, first = np.unique(pivots.column("pivot_key").to_numpy(), return_index=True)
        k = len(pivot_key)
        away = np.ones((size, 0))
        if size and k:
            some = pivots.take(pa.array(first))
            away = distances(n, [np.frombuffer(s, _U) for s in shingles], some.column("pivot_n_shingles").to_numpy(), [np.frombuffer(s, _U) for s in some.column("pivot_shingles").to_pylist()])
        nearest = away.min(axis=1, initial=1.0)
        far = np.flatnonzero(nearest > NEAR_HOME)
        point, to = np.nonzero((away <= np.minimum(nearest + 2 * radius, NEAR_HOME + radius)[:, None] + 1e-9))
        core = away[point, to] <= radius + 1e-9
        core &= 100 * (1 - away[point, to]) >= near - 1e-7
        link = core & (key[point] != pivot_key[to])
        if size:
            child = mix(np.concatenate([pivot_key[to], np.full(len(far), -1)]).astype(_U) ^ mix(np.array([region], np.int64).astype(_U) + _U(level))).astype(np.int64)
        else:
            child = np.zeros(0, np.int64)
        rows = np.concatenate([point, far])
        m = int(link.sum())
        return pa.table({
            "region": pa.concat_arrays([pa.array(child), pa.nulls(m, pa.int64())]), "key": pa.array(np.concatenate([key[rows], key[point[link]]])),
            "n_shingles": pa.concat_arrays([pa.array(n[rows]), pa.nulls(m, pa.int64())]), "shingles": pa.array([shingles[i] for i in rows.tolist()] + [None] * m, pa.binary()),
            "core": pa.array(np.concatenate([core, np.zeros(len(far) + m, bool)])), "parent": pa.array(np.concatenate([np.full(len(rows), region), pivot_key[to[link]]]).astype(np.int64)),
        })

    return run


def _blocks(rows: DataFrame, near: int) -> DataFrame:
    """Links of regions (rows with size and rest, the number outside the core) as pairs of blocks."""
    half = max(LEAF // 2, 1)
    all_, some = F.ceil(F.col("size") / half).cast("int"), F.ceil(F.col("rest") / half).cast("int")
    dealt = rows.withColumn("_a", some).withColumn("_b", all_).withColumn("_own", F.xxhash64("key"))
    every = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("_a") - 1)).alias("i"), F.pmod("_own", F.col("_b")).cast("int").alias("j"))
    outer = dealt.where("not core").select("*", F.pmod("_own", F.col("_a")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("j"))
    return every.unionByName(outer).select("region", "i", "j", "key", "n_shingles", "shingles", "core").groupBy("region", "i", "j").applyInArrow(_join_region(near), "a long, b long")


def links(alive: DataFrame, near: int = NEAR) -> DataFrame:
    """Steps 2 to 4 over points key, n_shingles, shingles: links a, b that join all groups of points in the radius."""
    spark = alive.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = alive.mapInArrow(_offer(near, 4 * parts), _OFFER).repartition(parts, "bucket").mapInArrow(_choose, _OFFER)
    chosen = asked.repartition(parts, "base").sortWithinPartitions("base").mapInArrow(_members, "pivot long, key long")
    members = shared.written(chosen, "members")
    sizes = members.groupBy("pivot").count()
    join = lambda few: members.join(few, "pivot").join(alive.select("key", "n_shingles", "shingles"), "key").select(F.col("pivot").alias("region"), "key", "n_shingles", "shingles", F.lit(False).alias("core"), "count")
    found = [join(sizes.where(F.col("count").between(2, LEAF))).groupBy("region").applyInArrow(_join_region(near), "a long, b long")]
    rows = join(sizes.where(F.col("count") > LEAF)).withColumn("parent", F.lit(0).cast("long")).drop("count")
    before = sizes.select(F.lit(0).cast("long").alias("parent"), F.lit(2**62).alias("above")).limit(1)
    for level in range(LEVELS + 1):
        rows = shared.written(rows, "regions")
        size = rows.groupBy("region").agg(F.count("*").alias("size"), F.count_if(~F.col("core")).alias("rest"), F.first("parent").alias("parent"))
        size = shared.written(size.join(before, "parent", "left").where("rest > 0 and size > 1"), "sizes")
        if size.isEmpty():
            break
        last = (F.col("size") > F.col("above") * SHRINK) | F.lit(level == LEVELS)
        here = rows.drop("parent").join(size.drop("parent"), "region")
        if level:
            found.append(here.where(F.col("size") <= LEAF).groupBy("region").applyInArrow(_join_region(near), "a long, b long"))
            found.append(_blocks(here.where((F.col("size") > LEAF) & last), near))
            here = here.where((F.col("size") > LEAF) & ~last)
        pivots = here.where(F.pmod(F.xxhash64("key", "region", F.lit(level)), F.col("size")) < PIVOTS)
        salts = F.ceil(F.col("size") / LEAF).cast("int")
        left = here.select("region", "key", "n_shingles", "shingles", F.pmod(F.xxhash64("key"), salts).cast("int").alias("salt"))
        right = pivots.select(*(F.col(c).alias(f"pivot_{c}") for c in ("region", "key", "n_shingles", "shingles")), F.explode(F.sequence(F.lit(0), salts - 1)).alias("pivot_salt"))
        split = shared.written(left.groupBy("region", "salt").cogroup(right.groupBy("pivot_region", "pivot_salt")).applyInArrow(_split(near, level), _ROW), "split")
        found.append(split.where("region is null").select(F.col("key").alias("a"), F.col("parent").alias("b")))
        before = size.select(F.col("region").alias("parent"), F.col("size").alias("above"))
        rows = split.where("region is not null")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def join_components(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of doc_id, text.

    component_id is the least doc_id reachable by links of ``near`` percent. Null and empty texts have no shingle and
    are linked with nothing, a row without doc_id counts as a document and gives no id; repeated rows are documents
    each. Other columns are ignored.
    """
    every = points(docs, near)
    alive = every.where("alive")
    names = ["key", "doc_id", "n_shingles"]
    # sets of which every shingle is shared may be equal to others; all other points are their own class
    whole = alive.where("digest is not null")
    classes = shared.written(whole.groupBy("digest").agg(F.min("key").alias("node")), "classes")
    own = F.col("key").alias("node")
    node = whole.select(*names, "digest").join(classes, "digest").select(*names, "node").unionByName(alive.where("digest is null").select(*names, own))
    single = whole.select("key", "n_shingles", "shingles").join(classes.select(F.col("node").alias("key")), "key", "left_semi").unionByName(alive.where("digest is null").select("key", "n_shingles", "shingles"))
    found = components(links(single, near))
    named = shared.written(node.join(found, "node", "left").select(*names, F.coalesce("component", "node").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    alone = every.where("not alive").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.join(least, "component").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def op6_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of all documents by links of NEAR percent (null and empty texts alone; repeated rows are documents each)."""
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
