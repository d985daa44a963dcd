"""Token ids in a content-addressed store.

Each document's ids are cut into chunks where a rolling hash of the last ids hits a pattern, so that equal
passages give equal chunks wherever they stand. A store is a folder with three tables:

* ``kind=chunk``: digest, ids (little-endian, 2 bytes each where the vocabulary allows, else 4). Once per digest.
* ``kind=recipe``: doc_id, n_tokens, digests (16 bytes for each chunk, in order), root (Merkle root of them).
* ``ordered``: recipes in ascending doc_id order, in parts that follow each other.
* ``manifest``: for each part its documents, their ids and the Merkle root over their roots; and for part -1 the root over
  the parts' roots, and the bytes of an id.

Reading back verifies each chunk against its digest, each document against its root, each part against the manifest's
root and number of documents, and the parts against the root of all.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patternfold.llm import shared
from patternfold.llm.blocks import slices
from patternfold.llm.byte_tokens import default_vocabulary, kept

END_ID = 2
WINDOW = 16
LEAST, MEAN_BITS, MOST = 32, 7, 512

_U = np.uint64
#: Ids as they are stored, by their bytes.
_KIND = {2: np.dtype("<u2"), 4: np.dtype("<u4")}
_GEAR = np.random.default_rng(31).integers(0, 2**64, 1 << 16, dtype=np.uint64)


def cut_points(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End positions of all chunks, and chunks per document.

    A chunk ends after an id at which the rolling hash of the last WINDOW ids has MEAN_BITS zero bits, if the
    chunk has LEAST ids by then; at MOST ids it ends in any case. Chunks don't cross documents.
    """
    g = _GEAR[ids & 0xFFFF]
    roll = np.zeros(len(ids), _U)
    for k in range(min(WINDOW, len(g))):  # h(i) = sum over k of gear(i - k) * 2**k: each step of the window doubles the older ids
        roll[k:] += g[: len(g) - k] << _U(k)
    hits = np.flatnonzero(roll >> _U(64 - MEAN_BITS) == 0) + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    at = np.searchsorted(hits, bounds, side="right").tolist()
    marks = hits.tolist()
    ends: list[int] = []
    counts = []
    for d in range(len(sizes)):
        begin, stop, n0 = bounds[d], bounds[d + 1], len(ends)
        for c in marks[at[d] : at[d + 1]]:
            while c - begin > MOST:
                begin += MOST
                ends.append(begin)
            if c - begin >= LEAST:
                ends.append(c)
                begin = c
        while stop - begin > MOST:
            begin += MOST
            ends.append(begin)
        if stop > begin:
            ends.append(stop)
        counts.append(len(ends) - n0)
    return np.array(ends, np.int64), np.array(counts, np.int64)


def merkle_root(digests: list[bytes]) -> bytes:
    """Binary tree of 16-byte nodes; an odd last node rises unchanged. No leaf: the digest of nothing."""
    if not digests:
        return hashlib.blake2b(b"", digest_size=16).digest()
    level = digests
    while len(level) > 1:
        up = [hashlib.blake2b(level[i] + level[i + 1], digest_size=16, person=b"node").digest() for i in range(0, len(level) - 1, 2)]
        level = up + level[len(level) - len(level) % 2 :]
    return level[0]


class MerkleStream:
    """merkle_root of leaves that come one after the other, in the memory of the tree's height."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        size, node = 1, leaf
        while self.nodes and self.nodes[-1][0] == size:
            node = merkle_root([self.nodes.pop()[1], node])
            size *= 2
        self.nodes.append((size, node))

    def root(self) -> bytes:
        if not self.nodes:
            return merkle_root([])
        node = self.nodes[-1][1]
        for _, left in reversed(self.nodes[:-1]):
            node = merkle_root([left, node])
        return node


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=b"chunk").digest()


def _shift_tables(most: int) -> np.ndarray:
    """t[n, k, b]: what byte k of value b of a CRC-32 becomes when n zero ids (4 bytes each) follow."""
    base = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for b in range(256):
            # from the state b << 8k over zero bytes; zlib inverts before and after
            base[k, b] = zlib.crc32(b"\0\0\0\0", (b << (8 * k)) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.zeros((most + 1, 4, 256), np.uint32)
    out[0] = (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for n in range(1, most + 1):
        p = out[n - 1]
        out[n] = base[0][p & 255] ^ base[1][p >> 8 & 255] ^ base[2][p >> 16 & 255] ^ base[3][p >> 24]
    return out


_TABLES: list[np.ndarray] = []


def crc_join(crc: np.ndarray, added: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte runs in one, from their CRCs and the ids in the second (MOST at most)."""
    if not _TABLES:
        _TABLES.append(_shift_tables(MOST))
    t = _TABLES[0]
    return t[n_ids, 0, crc & 255] ^ t[n_ids, 1, crc >> 8 & 255] ^ t[n_ids, 2, crc >> 16 & 255] ^ t[n_ids, 3, crc >> 24] ^ added


def _encode_rows(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = kept(vocabulary)
        for batch in batches:
            for part in slices(batch):
                yield from _rows(part, *tokenizer.encode(part.column("text")), end_id, tokenizer.id_bytes)

    return run


def _rows(part: pa.RecordBatch, ids: np.ndarray, sizes: np.ndarray, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    """Recipe rows of a slice, and a row for each chunk that is new in it."""
    ids = np.insert(ids, np.cumsum(sizes), end_id).astype(_KIND[width])
    sizes = sizes + 1
    ends, counts = cut_points(ids, sizes)
    data = ids.tobytes()
    marks = (ends * width).tolist()
    chunks, a = [], 0
    for b in marks:
        chunks.append(data[a:b])
        a = b
    digests = [digest(c) for c in chunks]
    last = np.cumsum(counts).tolist()
    recipes, roots, a = [], [], 0
    for b in last:
        recipes.append(b"".join(digests[a:b]))
        roots.append(merkle_root(digests[a:b]))
        a = b
    n = len(sizes)
    doc_id = part.column("doc_id").cast(pa.int64())
    nothing = pa.nulls(n, pa.binary())
    yield pa.RecordBatch.from_arrays(
        [pa.array(["recipe"] * n), pa.array(roots, pa.binary()), doc_id, pa.array(np.arange(n)), pa.array(sizes.astype(np.int64)), pa.array(recipes, pa.binary()), nothing], _NAMES
    )
    new = dict(zip(digests, chunks))
    k = len(new)
    empty = pa.nulls(k, pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(["chunk"] * k), pa.array(list(new), pa.binary()), empty, empty, empty, pa.nulls(k, pa.binary()), pa.array(list(new.values()), pa.binary())], _NAMES)


#: The digests of a recipe, one after the other.
_SPLIT = "posexplode(transform(sequence(0, cast(octet_length(digests) div 16 as int) - 1), i -> substring(digests, i * 16 + 1, 16)))"
_NAMES = ["kind", "digest", "doc_id", "row", "n_tokens", "digests", "ids"]


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encodes doc_id, text of ``docs`` (null text: empty; repeated rows stay) and writes the store at ``path``.

    Ids take 2 bytes if all of the vocabulary's fit, else 4. One pass over the text and one shuffle: chunks, already
    distinct within a slice, meet by digest and the first stays. Recipes go to partitions by row, not by document, so
    no key is hot. An empty table gives a store without documents.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    shared.text_batches(spark)
    rows = docs.select("doc_id", "text").mapInArrow(_encode_rows(vocabulary, end_id), "kind string, digest binary, doc_id long, row long, n_tokens long, digests binary, ids binary")
    rows = rows.withColumn("row", F.when(F.col("kind") == "recipe", F.monotonically_increasing_id()))
    one = rows.groupBy("kind", "digest", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("digests").alias("digests"), F.first("ids").alias("ids"))
    one.write.partitionBy("kind").parquet(path)
    _write_manifest(spark, path, kept(vocabulary).id_bytes)


_PARTS = "part int, documents long, n_tokens long, root binary"


def _write_manifest(spark: SparkSession, path: str, width: int) -> None:
    """Recipes in ascending doc_id order, and what the manifest says of their parts."""
    recipes = _table(spark, path, "recipe")
    ordered = recipes.select("doc_id", "n_tokens", "row", "digests", F.col("digest").alias("root")).repartitionByRange(F.col("doc_id").asc_nulls_first(), "root", "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root", "row")
    ordered.withColumn("part", F.spark_partition_id()).write.parquet(f"{path}/ordered")
    parts = part_roots(spark, path).orderBy("part").collect()
    rows = [(r.part, r.documents, r.n_tokens, bytes(r.root), width) for r in parts]
    rows.append((-1, sum(r.documents for r in parts), sum(r.n_tokens for r in parts), merkle_root([bytes(r.root) for r in parts]), width))
    spark.createDataFrame(rows, _PARTS + ", id_bytes int").coalesce(1).write.parquet(f"{path}/manifest")


_ORDERED = "doc_id long, n_tokens long, row long, digests binary, root binary, part int"


def _order(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ORDERED).parquet(f"{path}/ordered")


def part_roots(spark: SparkSession, path: str) -> DataFrame:
    """part, documents, n_tokens, root of each part as it is read: a row for each partition that wrote the order, whatever stands in it (no row for an empty store)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, documents, ids, tree = None, 0, 0, MerkleStream()
        done: list[tuple] = []
        for batch in batches:
            for p, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "n_tokens", "root"))):
                if p != part:
                    if documents:
                        done.append((part, documents, ids, tree.root()))
                    part, documents, ids, tree = p, 0, 0, MerkleStream()
                documents, ids = documents + 1, ids + (n or 0)
                tree.add(root or b"")
        if documents:
            done.append((part, documents, ids, tree.root()))
        columns = list(zip(*done)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["part", "documents", "n_tokens", "root"])

    rows = _order(spark, path).select("part", "doc_id", "root", "row", "n_tokens")
    return rows.repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "root", "row").mapInArrow(run, _PARTS)


def check_manifest(spark: SparkSession, path: str) -> tuple[int, list[tuple[int, int, bool]]]:
    """Bytes of an id; and of each part its number, the ids of all parts before it by the manifest, and whether it is as the manifest says (false for all if the manifest's own root is not that of its parts)."""
    rows = spark.read.schema(_PARTS + ", id_bytes int").parquet(f"{path}/manifest").orderBy("part").collect()
    top, parts = [r for r in rows if r.part == -1], [r for r in rows if r.part >= 0]
    sound = len(top) == 1 and bytes(top[0].root) == merkle_root([bytes(r.root) for r in parts]) and top[0].documents == sum(r.documents for r in parts)
    found = {r.part: r for r in part_roots(spark, path).collect()}
    out, before = [], 0
    for r in parts:
        own = found.pop(r.part, None)
        out.append((r.part, before, bool(sound and own and (own.documents, own.n_tokens, bytes(own.root)) == (r.documents, r.n_tokens, bytes(r.root)))))
        before += r.n_tokens
    return (rows[0].id_bytes if rows else 2), out + [(p, before, False) for p in sorted(found)]


def manifest(spark: SparkSession, path: str, parts: list[tuple[int, int, bool]] | None = None) -> DataFrame:
    """doc_id, row, start, n_tokens, root, digests, sound (its part is as the manifest says): every document in order of doc_id (nulls first; equal ids by root)."""
    parts = check_manifest(spark, path)[1] if parts is None else parts
    before = spark.createDataFrame(parts, "part int, before long, sound boolean")
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root", "row").rowsBetween(Window.unboundedPreceding, -1)
    return _order(spark, path).join(F.broadcast(before), "part").select("doc_id", "row", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "root", "digests", "sound")


def _table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    schema = {"chunk": "digest binary, ids binary", "recipe": "digest binary, row long, doc_id long, n_tokens long, digests binary"}[kind]
    return spark.read.schema(schema).parquet(f"{path}/kind={kind}")


def _chunk_facts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, data = batch.column("digest").to_pylist(), batch.column("ids").to_pylist()
            good = [d is not None and not len(d) % width and digest(d) == g for d, g in zip(data, digests)]
            data = [d if g else b"" for d, g in zip(data, good)]
            sizes = [len(d) // width for d in data]
            wide = np.frombuffer(b"".join(data), _KIND[width]).astype("<u4").tobytes()
            at = np.concatenate([[0], np.cumsum(sizes)]) * 4
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(crc, pa.int64()), pa.array(good)], ["digest", "n", "crc", "good"])

    return run


def _join_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each document's chunks in order: its length, CRC and whether they are the ones its root was made of."""
    for batch in batches:
        chunks = batch.column("chunks")
        off = np.asarray(chunks.offsets, np.int64)
        off, flat = off - off[0], chunks.flatten()
        n, crc = np.asarray(flat.field("n")).astype(np.int64), np.asarray(flat.field("crc")).astype(np.uint32)
        digests, good = flat.field("digest").to_pylist(), np.asarray(flat.field("good").to_numpy(zero_copy_only=False), bool)
        sizes = np.diff(off)
        total = crc[off[:-1]].copy()
        live = np.flatnonzero(sizes > 1)
        k = 1
        while len(live):
            at = off[live] + k
            total[live] = crc_join(total[live], crc[at], n[at])
            k += 1
            live = live[sizes[live] > k]
        length = np.add.reduceat(n, off[:-1]) if len(sizes) else np.zeros(0, np.int64)
        roots = batch.column("root").to_pylist()
        verified = [bool(good[a:b].all()) and merkle_root(digests[a:b]) == r for a, b, r in zip(off[:-1].tolist(), off[1:].tolist(), roots)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(length), pa.array(total.astype(np.int64)), pa.array(verified), pa.array(sizes)], ["row", "n_ids", "ids_crc32", "verified", "n_chunks"])


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Reads the store back: doc_id, start, n_tokens, ids_crc32, n_chunks, verified, a row for each document of the order.

    Chunks are read and hashed once each; documents need only their chunks' lengths and CRCs, which join by
    digest. A missing or altered chunk, a lost or altered recipe and a part that is not as the manifest says make
    verified false (a lost recipe also ids_crc32 and n_chunks null, lost chunks the counts).
    """
    width, parts = check_manifest(spark, path)
    facts = _table(spark, path, "chunk").mapInArrow(_chunk_facts(width), "digest binary, n int, crc long, good boolean")
    recipes = _table(spark, path, "recipe")
    refs = recipes.select("row", F.expr(_SPLIT).alias("pos", "digest"))
    met = refs.join(facts, "digest", "left")
    lists = met.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"), F.coalesce("good", F.lit(False)).alias("good")))).alias("chunks"))
    order = manifest(spark, path, parts).select("doc_id", "row", "start", "n_tokens", "root", "sound")
    checked = lists.join(order.select("row", "root"), "row").select("row", "root", "chunks").mapInArrow(_join_crcs, "row long, n_ids long, ids_crc32 long, verified boolean, n_chunks long")
    right = F.col("sound") & F.col("verified") & (F.col("n_ids") == F.col("n_tokens"))
    return order.join(checked, "row", "left").select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", F.coalesce(right, F.lit(False)).alias("verified"))


def reconstruct(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, row, ids array<int> of the given documents, or of all. A document of which a chunk is lost has null."""
    width = check_manifest(spark, path)[0]
    recipes = _table(spark, path, "recipe")
    if doc_ids is not None:
        recipes = recipes.where(F.col("doc_id").isin(doc_ids))
    refs = recipes.select("doc_id", "row", F.expr(_SPLIT).alias("pos", "digest"))
    lists = refs.join(_table(spark, path, "chunk"), "digest", "left").groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("parts"))

    def run(batches):
        for batch in batches:
            ids = [None if any(p["ids"] is None for p in parts) else np.frombuffer(b"".join(p["ids"] for p in parts), _KIND[width]).astype(np.int32) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "row", "ids"])

    return lists.mapInArrow(run, "doc_id long, row long, ids array<int>")


def op3_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores all documents and verifies what is read back (null texts: empty; repeated rows are documents each)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = shared.fresh(spark, "store")
    write_store(docs, path)
    return verify(spark, path)
