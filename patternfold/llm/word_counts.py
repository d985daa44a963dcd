"""Counts of all words of the corpus, brought back to the documents that hold them.

A slice of documents names each of its words once. Words meet by hash, are counted over all training documents and
the counts go back to the slice. So a word costs a row's share per slice, however often it stands in the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternfold.llm import blocks, shared
from patternfold.llm.blocks import slices

_U = np.uint64
_WORDS, _COUNTS, _DOCS, _TOTAL = 0, 1, 2, 3
_NAMES = ["bucket", "base", "kind", "first", "packed", "more", "doc_ids", "hashes", "train"]
_DDL = "bucket int, base long, kind int, first long, packed binary, more binary, doc_ids array<long>, hashes array<long>, train array<boolean>"
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)


def text_words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of ``part``'s column text."""
    w = blocks.words(part.column("text"), lower=True)
    return w.hash, w.doc


def _stage(bits: int, column: str = "text", words=text_words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 32
        for batch in batches:
            for part in slices(batch, column, trims=False):
                yield _batch(_slice_rows(part, base, bits, words))
                base += 1
        blocks.trim()

    return run


def _slice_rows(part: pa.RecordBatch, base: int, bits: int, words) -> list[tuple]:
    hashes, doc = words(part)
    train = part.column("train").to_numpy(zero_copy_only=False)
    known, local = np.unique(hashes, return_inverse=True)
    pair = np.sort(doc << 32 | local)
    head = np.flatnonzero(np.diff(pair, prepend=-1))
    tf, pair = np.diff(head, append=len(pair)), pair[head]
    per = np.bincount(pair >> 32, minlength=part.num_rows)
    counted = train[doc] if len(doc) else np.zeros(0, bool)
    count = np.bincount(local[counted], minlength=len(known))
    home = base % 0x7FFFFFFF
    narrow = np.minimum(tf, 255).astype(np.uint8)  # larger ones follow in full
    big = tf >= 255
    more = per.astype("<u4").tobytes() + narrow.tobytes() + tf[big].astype("<u4").tobytes()
    out = [(home, base, _DOCS, len(known), (pair & 0xFFFFFFFF).astype("<u4").tobytes(), more, part.column("doc_id").to_pylist(), part.column("hash").to_pylist(), train.tolist())]
    edges = np.searchsorted(known, np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits)).tolist()
    edges = [0, *edges, len(known)]
    for k in range(1 << bits):
        a, b = edges[k], edges[k + 1]
        if b > a:
            out.append((k, base, _WORDS, a, known[a:b].tobytes(), count[a:b].astype("<u4").tobytes(), None, None, None))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        other = np.flatnonzero(kind != _WORDS)
        if len(other):
            yield batch.take(pa.array(other))
        for r in batch.take(pa.array(np.flatnonzero(kind == _WORDS))).to_pylist():
            held.setdefault(r["bucket"], []).append((r["base"], r["first"], np.frombuffer(r["packed"], _U), np.frombuffer(r["more"], "<u4")))
    tokens = distinct = 0
    for bucket in list(held):
        rows = held.pop(bucket)
        h = np.concatenate([r[2] for r in rows])
        order = np.argsort(h, kind="stable")
        head = np.flatnonzero(np.diff(h[order], prepend=h[order[0]] ^ _U(1)))
        sums = np.add.reduceat(np.concatenate([r[3] for r in rows])[order].astype(np.int64), head)
        tokens, distinct = tokens + int(sums.sum()), distinct + int((sums > 0).sum())
        back = np.empty(len(h), np.int64)
        back[order] = np.repeat(sums, np.diff(head, append=len(h)))
        out, a = [], 0
        for base, first, own, _ in rows:
            out.append((base % 0x7FFFFFFF, base, _COUNTS, first, back[a : a + len(own)].astype("<i8").tobytes(), None, None, None, None))
            a += len(own)
        yield _batch(out)
    yield _batch([(0, -1, _TOTAL, tokens, np.int64(distinct).tobytes(), None, None, None, None)])


_OUT = ["kind", "doc_id", "hash", "train", "n_words", "n_known", "log_sum", "tokens", "distinct"]
_OUT_DDL = "kind string, doc_id long, hash long, train boolean, n_words long, n_known long, log_sum double, tokens long, distinct long"


def _finish(rows: list[dict]) -> pa.RecordBatch:
    if rows[0]["base"] < 0:
        n = len(rows)
        none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(["total"] * n), *none, pa.array([r["first"] for r in rows]), pa.array([int.from_bytes(r["packed"], "little", signed=True) for r in rows])], _OUT)
    info = next(r for r in rows if r["kind"] == _DOCS)
    count = np.zeros(info["first"], np.int64)
    for r in rows:
        if r["kind"] == _COUNTS:
            own = np.frombuffer(r["packed"], "<i8")
            count[r["first"] : r["first"] + len(own)] = own
    n = len(info["doc_ids"])
    local = np.frombuffer(info["packed"], "<u4")
    per = np.frombuffer(info["more"][: 4 * n], "<u4").astype(np.int64)
    tf = np.frombuffer(info["more"][4 * n : 4 * n + len(local)], np.uint8).astype(np.int64)
    tf[tf == 255] = np.frombuffer(info["more"][4 * n + len(local) :], "<u4")
    doc = np.repeat(np.arange(n), per)
    c = count[local]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(["doc"] * n), pa.array(info["doc_ids"], pa.int64()), pa.array(info["hashes"], pa.int64()), pa.array(info["train"], pa.bool_()), pa.array(np.bincount(doc, weights=tf, minlength=n).astype(np.int64)),
            pa.array(np.bincount(doc, weights=tf * (c > 0), minlength=n).astype(np.int64)), pa.array(np.bincount(doc, weights=tf * np.log10(c + 0.5), minlength=n).astype(float)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
        ],
        _OUT,
    )


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and r["base"] != rows[0]["base"]:
                yield _finish(rows)
                rows = []
            rows.append(r)
    if rows:
        yield _finish(rows)


def unigram_scores(docs: DataFrame, column: str = "text", words=text_words) -> tuple[DataFrame, dict]:
    """For doc_id, text, hash (long), train (boolean) of ``docs``: a DataFrame doc_id, hash, train, n_tokens, n_known,
    base_score of each row, and the totals tokens (N), distinct (V) and documents of training.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; each text has an end token as well. base_score is the sum of
    log10((c + 0.5) / (N + 0.5 (V + 1))). Null texts have the end token alone. Where another ``column`` stands for the
    text, ``words`` tells the hash and the row of every word in a batch of it.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", column, "hash", "train")
    shared.text_batches(spark)
    parts = max(docs.rdd.getNumPartitions(), 1)
    bits = max(4, (4 * parts - 1).bit_length())
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared.fresh(spark, "words")
    dealt = docs.mapInArrow(_stage(bits, column, words), _DDL).repartition(min(1 << bits, max(4 * parts, least)), "bucket").mapInArrow(_count, _DDL)
    dealt.repartition(max(2 * parts, least), "base").sortWithinPartitions("base").mapInArrow(_assemble, _OUT_DDL).write.parquet(path)
    rows = spark.read.schema(_OUT_DDL).parquet(path)
    found = rows.agg(F.sum("tokens"), F.sum("distinct"), F.sum(F.when(F.col("train"), 1).otherwise(0))).first()
    tokens, distinct, n = (int(x or 0) for x in found)
    totals = {"tokens": tokens + n, "distinct": distinct + (n > 0), "documents": n}
    log_all = float(np.log10(totals["tokens"] + 0.5 * (totals["distinct"] + 1)))
    end = float(np.log10(n + 0.5))
    scored = rows.where("kind = 'doc'").select(
        "doc_id", "hash", "train", (F.col("n_words") + 1).alias("n_tokens"), (F.col("n_known") + int(n > 0)).alias("n_known"), (F.col("log_sum") + end - (F.col("n_words") + 1) * log_all).alias("base_score")
    )
    return scored, totals
