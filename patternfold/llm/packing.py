"""Packing of whole documents into training windows with related documents beside each other.

A document's ids fill windows of their own while they can; what is left (under a window) is its tail. Tails
are ordered by the two words that weigh most in their BM25 (of the words that another document may have too), so that
copies and texts of one matter come together, and cut into shards, at borders taken from some of their keys. Each shard
is a BM25 inverted index over 64-bit terms with document frequencies and mean length of the whole corpus; frequencies
are those of a count-min sketch of SKETCH rows, which is never below the true one. The first unused tail is a seed: its unused neighbours by BM25 fill its
window, those that fit first; the best that doesn't fit is cut, and its rest stays in the index. Only the last
window of a shard can end early.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternfold.llm import arrays, blocks, shared
from patternfold.llm.blocks import mix, ragged, slices
from patternfold.llm.byte_tokens import default_vocabulary, kept

WINDOW = 1024
END_ID = 0
SKETCH, SKETCH_BITS = 4, 18
SHARD_ROWS = 1024
K1, B = 1.2, 0.75
NEIGHBOURS = 64
KEYS, MOST_KEYS = 100, 1_000_000  # as Spark's own range partitioning draws them

_NAMES = ["kind", "doc_id", "doc_tokens", "full", "tail", "terms", "tfs", "words", "key", "data"]
_SCHEMA = "kind string, doc_id long, doc_tokens long, full array<long>, tail binary, terms binary, tfs binary, words long, key int, data binary"


def _places(terms: np.ndarray) -> list[np.ndarray]:
    """Where each row of the sketch counts the terms."""
    return [(mix(terms + np.uint64(k)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64) + (k << SKETCH_BITS) for k in range(SKETCH)]


class Statistics:
    """Documents, their mean number of words, and in how many of them a term is (at most)."""

    def __init__(self, sums: np.ndarray):
        self.sketch, self.documents = sums[:-2], int(sums[-2])
        self.mean = max(1.0, int(sums[-1]) / max(self.documents, 1))

    def frequency(self, terms: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([self.sketch[p] for p in _places(terms)])

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.frequency(terms)
        return np.log1p((self.documents - df + 0.5) / (df + 0.5)).clip(0)


def _stage(vocabulary: str, window: int, end_id: int):
    """Encodes documents: CRCs of full windows, the tail with its terms; and the corpus statistics of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = kept(vocabulary)
        stats = np.zeros((SKETCH << SKETCH_BITS) + 2, np.int64)  # document frequencies, documents, words
        for batch in batches:
            for part in slices(batch):
                yield _stage_rows(part, tokenizer.encode_pieces(part.column("text")), window, end_id, stats)
        keys, data = arrays.pieces(stats)
        n = len(keys)
        none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(["stats"] * n, pa.string()), *none, pa.array(keys, pa.int32()), pa.array(data, pa.binary())], _NAMES)

    return run


def _terms(part: pa.RecordBatch, encoded) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and first id (within the row) of every word, by row."""
    _, sizes, lengths, term, row, odd = encoded
    at = np.cumsum(lengths) - lengths
    first = np.zeros(len(sizes), np.int64)
    new = np.flatnonzero(np.diff(row, prepend=-1))
    first[row[new]] = at[new]
    at = at - first[row]
    word = term > 0
    row, term, at = row[word], term[word], at[word]
    if len(odd):  # encoded whole: words spread evenly over the ids
        w = blocks.words(part.column("text").take(pa.array(odd)), lower=True)
        of = odd[w.doc]
        rank = np.arange(len(of)) - w.bounds[:-1][w.doc]
        row, term, at = np.concatenate([row, of]), np.concatenate([term, np.maximum(w.hash, 1)]), np.concatenate([at, rank * sizes[of] // np.maximum(w.counts[w.doc], 1)])
        order = np.argsort(row, kind="stable")
        row, term, at = row[order], term[order], at[order]
    return row, term, at


def _stage_rows(part: pa.RecordBatch, encoded, window: int, end_id: int, stats: np.ndarray) -> pa.RecordBatch:
    ids, sizes = encoded[:2]
    n = len(sizes)
    ids = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4")
    row, term, at = _terms(part, encoded)
    sizes = sizes + 1
    first = np.cumsum(sizes) - sizes
    fulls = sizes // window
    data = ids.tobytes()
    full = [[zlib.crc32(data[4 * (a + k * window) : 4 * (a + (k + 1) * window)]) for k in range(m)] for a, m in zip(first.tolist(), fulls.tolist())]
    narrow = ids.max(initial=0) < 65536
    data, width = (ids.astype("<u2").tobytes(), 2) if narrow else (data, 4)
    tails = [data[width * (a + m * window) : width * (a + s)] for a, m, s in zip(first.tolist(), fulls.tolist(), sizes.tolist())]

    known, term = np.unique(term, return_inverse=True)
    seen = np.sort(row << 32 | term)
    seen = seen[np.diff(seen, prepend=-1) > 0] & 0xFFFFFFFF
    df = np.bincount(seen, minlength=len(known))
    for place in _places(known):
        np.add.at(stats, place, df)
    stats[-2] += n
    stats[-1] += len(term)

    mine = at >= (fulls * window)[row]
    row, term = row[mine], term[mine]
    words = np.bincount(row, minlength=n)
    pair = np.sort(row << 32 | term)
    head = np.flatnonzero(np.diff(pair, prepend=-1))
    tf = np.diff(head, append=len(pair))
    pair = pair[head]
    cuts = np.searchsorted(pair >> 32, np.arange(n + 1)).tolist()
    terms, tfs = known[pair & 0xFFFFFFFF].astype("<u8").tobytes(), tf.astype("<u4").tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(["doc"] * n, pa.string()), part.column("doc_id").cast(pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(full, pa.list_(pa.int64())), pa.array(tails, pa.binary()),
            pa.array([terms[8 * a : 8 * b] for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array([tfs[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
            pa.array(words.astype(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
        ],
        _NAMES,
    )


def _weights(tf: np.ndarray, words: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """BM25 of terms that stand tf times in texts of so many words."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * words / mean))


def _first(weight: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The places of each text's largest weight, the first of equal ones; ``of`` ascends and texts without any have none."""
    head = np.flatnonzero(np.diff(of, prepend=-1))
    if not len(head):
        return head
    most = np.zeros(n)
    most[of[head]] = np.maximum.reduceat(weight, head)
    at = np.flatnonzero(weight == most[of])
    return at[np.flatnonzero(np.diff(of[at], prepend=-1))]


def _routes(batch: pa.RecordBatch, s: Statistics) -> tuple[np.ndarray, np.ndarray]:
    """Route and second of each tail: the two terms of most weight among those that another document may have; 0 where there is none."""
    n = batch.num_rows
    raw, off = blocks.utf8(batch.column("terms"))
    term, size = np.frombuffer(raw.tobytes(), "<u8"), np.diff(off) // 8
    tf = np.frombuffer(blocks.utf8(batch.column("tfs"))[0].tobytes(), "<u4").astype(float)
    of = np.repeat(np.arange(n), size)
    df = s.frequency(term)
    weight = _weights(tf, batch.column("words").to_numpy()[of], np.log1p((s.documents - df + 0.5) / (df + 0.5)).clip(0), s.mean)
    some = np.flatnonzero(df > 1)
    both = np.zeros((2, n), np.uint64)
    for own in both:  # a tail's terms ascend, so the first of equal weights is the least term
        best = _first(weight[some], of[some], n)
        own[of[some[best]]] = term[some[best]]
        some = np.delete(some, best)
    return (both[0] >> np.uint64(1)).astype(np.int64), (both[1] >> np.uint64(1)).astype(np.int64)


_KEY = np.dtype([("route", np.int64), ("second", np.int64), ("row", np.int64)])


def _keyed(route: np.ndarray, second: np.ndarray, row: np.ndarray) -> np.ndarray:
    out = np.empty(len(row), _KEY)
    out["route"], out["second"], out["row"] = route, second, row
    return out


def _keys(statistics):
    """Route, second and row of tails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*map(pa.array, _routes(batch, statistics.value)), batch.column("row")], list(_KEY.names))

    return run


def _borders(keys: np.ndarray, shards: int) -> np.ndarray:
    """The first key of every shard but the first, by equal shares of some tails' keys."""
    keys = np.sort(keys, order=_KEY.names)
    return keys[np.unique(np.arange(1, shards) * len(keys) // shards)] if len(keys) else keys


def _route(statistics, borders):
    """Adds route, second and the number of the shard to tails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            route, second = _routes(batch, statistics.value)
            shard = np.searchsorted(borders.value, _keyed(route, second, batch.column("row").to_numpy()), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(route), pa.array(second), pa.array(shard.astype(np.int32))], [*batch.schema.names, "route", "second", "shard"])

    return run


class Shard:
    """An inverted index over tails: postings by term, each with its BM25 weight.

    Terms that an eighth of the shard holds are kept as rows of a matrix, the others as lists.
    """

    def __init__(self, terms: list[np.ndarray], tfs: list[np.ndarray], words: np.ndarray, statistics: Statistics):
        n = len(terms)
        sizes = np.fromiter(map(len, terms), np.int64, n)
        term = np.concatenate(terms) if n else np.zeros(0, np.uint64)
        tf = np.concatenate(tfs).astype(np.float32) if n else np.zeros(0, np.float32)
        doc = np.repeat(np.arange(n), sizes)
        known, inverse, count = np.unique(term, return_inverse=True, return_counts=True)
        weight = _weights(tf, words[doc], statistics.idf(known)[inverse], statistics.mean).astype(np.float32)
        heavy = count * 8 >= n
        number = np.cumsum(heavy) - 1
        self.n, self.matrix = n, np.zeros((int(heavy.sum()), n), np.float32)
        dense = heavy[inverse]
        self.matrix[number[inverse[dense]], doc[dense]] = weight[dense]
        self.present = np.ascontiguousarray(self.matrix.T > 0).astype(np.float32)
        inverse, doc, weight = inverse[~dense], doc[~dense], weight[~dense]
        order = np.argsort(inverse, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        first = np.cumsum(np.where(heavy, 0, count)) - np.where(heavy, 0, count)
        self.start, self.count = first[inverse], count[inverse]  # of the postings of each document's terms
        self.bounds = np.searchsorted(doc, np.arange(n + 1))

    def scores(self, i: int) -> np.ndarray:
        """BM25 of every document of the shard for all terms of document i."""
        a, b = self.bounds[i], self.bounds[i + 1]
        at = ragged(self.start[a:b], self.count[a:b])
        light = np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)
        return light + self.present[i] @ self.matrix


def fill(shard: Shard, left: np.ndarray, window: int) -> Iterator[list[tuple[int, int]]]:
    """Windows as lists of (document, ids taken). ``left``: ids of each tail; comes down to 0."""
    seed, n = 0, len(left)
    order = np.arange(n) * 1e-9  # ties: order of the shard
    while True:
        while seed < n and not left[seed]:
            seed += 1
        if seed == n:
            return
        room = window - int(left[seed])
        taken = [(seed, int(left[seed]))]
        left[seed] = 0
        if room:
            far = shard.scores(seed)  # best first once it is turned round
            far[left == 0] = -1.0
            np.subtract(order, far, out=far)
            cut = -1
            top = min(NEIGHBOURS, n)
            while room:
                some = np.argpartition(far, top - 1)[:top] if top < n else np.arange(n)
                some = some[np.argsort(far[some], kind="stable")]
                for d, size in zip(some.tolist(), left[some].tolist()):
                    if not room:
                        break
                    if size and size <= room:
                        taken.append((d, size))
                        room -= size
                        left[d] = 0
                    elif size and cut < 0:
                        cut = d
                if room and cut >= 0:
                    taken.append((cut, room))
                    left[cut] -= room
                    room = 0
                if top == n:
                    break
                top = min(n, 4 * top)  # all of those were used up
        yield taken


def _pack(window: int, statistics):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= 2 * SHARD_ROWS:
                rows, held = held[:SHARD_ROWS], held[SHARD_ROWS:]
                out, number = _pack_shard(rows, window, statistics.value, number)
                yield out
        if held:
            yield _pack_shard(held, window, statistics.value, number)[0]

    return run


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_shard(rows: list[dict], window: int, statistics: Statistics, number: int) -> tuple[pa.RecordBatch, int]:
    ids = [np.frombuffer(r["tail"], "<u2" if len(r["tail"]) == 2 * (r["doc_tokens"] - window * len(r["full"])) else "<u4").astype("<u4") for r in rows]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    shard = Shard([np.frombuffer(r["terms"], "<u8") for r in rows], [np.frombuffer(r["tfs"], "<u4") for r in rows], np.array([r["words"] for r in rows], float), statistics)
    left = sizes.copy()
    done = np.zeros(len(ids), np.int64)
    out: list[tuple] = []
    for taken in fill(shard, left, window):
        offset = 0
        for d, n in taken:
            r, a = rows[d], int(done[d])
            out.append((r["doc_id"], window * len(r["full"]) + a, n, zlib.crc32(ids[d][a : a + n].tobytes()), r["doc_tokens"], 2 * number + 1, offset))
            done[d] += n
            offset += n
        number += 1
    columns = list(zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE)], schema=_PIECE), number


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents (doc_id, text; null text: empty, a single end id; repeated rows are documents each):

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Other columns are ignored. One pass over the
    text, staged in the shared folder; only tails are shuffled. Sequence numbers are unique, with gaps.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    shared.text_batches(spark)
    path = shared.fresh(spark, "tails")
    docs.select("doc_id", "text").mapInArrow(_stage(vocabulary, window, end_id), _SCHEMA).write.partitionBy("kind").parquet(path)
    fields = dict(f.strip().split(" ") for f in _SCHEMA.split(","))
    read = lambda kind, *names: spark.read.schema(", ".join(f"{n} {fields[n]}" for n in names)).parquet(f"{path}/kind={kind}") if _exists(spark, f"{path}/kind={kind}") else spark.createDataFrame([], ", ".join(f"{n} {fields[n]}" for n in names))
    statistics = Statistics(arrays.total(read("stats", "key", "data"), (SKETCH << SKETCH_BITS) + 2))
    sent = spark.sparkContext.broadcast(statistics)
    names = ["doc_id", "doc_tokens", "full", "tail", "terms", "tfs", "words"]
    schema = ", ".join([*(f"{n} {fields[n]}" for n in names), "row long, route long, second long, shard int"])
    tails = read("doc", *names).where(F.col("doc_tokens") % window != 0).withColumn("row", F.monotonically_increasing_id())
    shards = max(1, -(-statistics.documents // SHARD_ROWS))
    borders = spark.sparkContext.broadcast(_borders(_some_keys(tails, sent, shards), shards))
    packed = tails.mapInArrow(_route(sent, borders), schema).repartitionById(shards, "shard").sortWithinPartitions("route", "second", "row").mapInArrow(_pack(window, sent), _PIECE_DDL)
    whole = read("doc", "doc_id", "doc_tokens", "full").select("doc_id", "doc_tokens", F.posexplode("full").alias("k", "ids_crc32"))
    alone = whole.select("doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(packed)


def _some_keys(tails: DataFrame, sent, shards: int) -> np.ndarray:
    """Keys of about KEYS tails a shard, MOST_KEYS at most, to place the shards' borders by; every tail is dealt by them."""
    if shards == 1:
        return np.zeros(0, _KEY)
    share = min(1.0, KEYS / SHARD_ROWS, MOST_KEYS / sent.value.documents)
    found = tails.select("terms", "tfs", "words", "row").sample(share, seed=1).mapInArrow(_keys(sent), "route long, second long, row long").toArrow()
    return _keyed(*(found.column(name).to_numpy() for name in _KEY.names))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows (null texts: an end id; repeated rows are documents each)."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
