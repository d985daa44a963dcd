"""Quality by ordinal regression: a cumulative-link model over hashed text.

P(grade <= k) = sigmoid(t[k] - s), with ascending thresholds t and one score s for all grades: the sum of the weights
of the distinct words of a text (ASCII punctuation parts them, A-Z in lower case), of the first STEM bytes of its
longer words, and of its levels of capitals,
digits, symbols, repeated words and length. Expected grade and the chance of the best grade follow from s.

Grades: 0 toxic, 1 of low quality, 2 good. The model is fitted on at most MOST_LABELLED labelled rows, those whose ids
have the least hashes; every document is scored, over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternfold.llm import blocks
from patternfold.llm.blocks import slices

BITS = 18
STEM = 6
LEVELS = 16
STYLES = 5
SIZE = (1 << BITS) + STYLES * LEVELS
GRADES = 3
MOST_LABELLED = 8_000
LEAST_SHARE, LEAST_TEXTS = 0.003, 5
EPOCHS, RATE, DECAY = 30, 0.5, 3e-2

_U = np.uint64
_SYMBOLS = np.zeros(256, np.uint8)
_SYMBOLS[[ord(c) for c in "#*$%&|<>!"]] = 1


def _parted() -> np.ndarray:
    """Bytes as they are, but ASCII punctuation as spaces."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(33, 127):
        if not chr(b).isalnum():
            table[b] = 32
    return table


_PARTED = _parted()


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, one text after the other, and how many each has."""
    raw, off = blocks.utf8(column)
    n = len(off) - 1
    plain = _PARTED[raw]
    start, end = blocks.word_marks(plain, off)
    h = blocks.segment_hashes(plain, start, end, lower=True)
    counts = np.diff(np.searchsorted(start, off))
    doc = np.repeat(np.arange(n), counts)
    pair = np.sort(doc << BITS | (h >> _U(64 - BITS)).astype(np.int64))
    pair = pair[np.diff(pair, prepend=-1) > 0]
    kinds = np.bincount(pair >> BITS, minlength=n)
    long = end - start > STEM
    stems = blocks.segment_hashes(plain, start[long], start[long] + STEM, lower=True)
    pair = np.sort(np.concatenate([pair, doc[long] << BITS | (blocks.mix(stems + _U(STEM)) >> _U(64 - BITS)).astype(np.int64)]))
    pair = pair[np.diff(pair, prepend=-1) > 0]
    distinct = np.bincount(pair >> BITS, minlength=n)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (sums[off[1:]] - sums[off[:-1]]) / np.maximum(np.diff(off), 1)

    # levels of a share: finer where it is small
    level = lambda x: np.clip(np.floor(np.log2(np.maximum(x, 2.0**-14)) + 14), 0, LEVELS - 1).astype(np.int64)
    styles = [
        level(share((raw >= 65) & (raw <= 90))), level(share((raw >= 48) & (raw <= 57))), level(share(_SYMBOLS[raw])),
        level(1 - kinds / np.maximum(counts, 1)), np.minimum(np.log2(counts + 1).astype(np.int64), LEVELS - 1),
    ]
    style = np.stack([(1 << BITS) + LEVELS * i + x for i, x in enumerate(styles)], axis=1)
    ends = np.cumsum(distinct)
    numbers = np.insert(pair & (1 << BITS) - 1, np.repeat(ends, STYLES), style.ravel())
    return numbers, distinct + STYLES


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    weights: np.ndarray  # SIZE
    thresholds: np.ndarray  # GRADES - 1, ascending

    def scores(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.zeros(0)
        return np.add.reduceat(self.weights[numbers].astype(np.float64), np.cumsum(counts) - counts)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """[text, k]: P(grade > k)."""
        return 1 - _sigmoid(self.thresholds[None] - score[:, None])

    @classmethod
    def fit(cls, numbers: np.ndarray, counts: np.ndarray, grades: np.ndarray, seed: int = 3) -> "OrdinalModel":
        """Adaptive gradient descent on the negative log likelihood; thresholds keep their order by their gaps' logarithms."""
        w, square = np.zeros(SIZE), np.full(SIZE, 1e-4)
        share = np.clip([np.mean(grades <= k) if len(grades) else 0.5 for k in range(GRADES - 1)], 0.01, 0.99)
        base = np.log(share / (1 - share))
        t = np.array([base[0], *np.log(np.maximum(np.diff(base), 0.1))])
        t_square = np.full(len(t), 1e-2)
        r = np.random.default_rng(seed)
        first = np.cumsum(counts) - counts
        cut = lambda t: np.concatenate([[-40.0], t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))]), [40.0]])
        # words of few of the texts say more about these texts than about others
        often = np.bincount(numbers, minlength=SIZE) >= max(LEAST_TEXTS, LEAST_SHARE * len(grades))
        average, average_t, steps = np.zeros(SIZE), np.zeros(len(t)), 0
        for epoch in range(EPOCHS if len(grades) else 0):
            order = r.permutation(len(grades))
            for i in range(0, len(order), 16):
                some = order[i : i + 16]
                at, owner = numbers[blocks.ragged(first[some], counts[some])], np.repeat(np.arange(len(some)), counts[some])
                at, owner = at[often[at]], owner[often[at]]
                s = np.bincount(owner, weights=w[at], minlength=len(some))
                edges = cut(t)
                hi, lo = _sigmoid(edges[grades[some] + 1] - s), _sigmoid(edges[grades[some]] - s)
                p = np.maximum(hi - lo, 1e-9)
                dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
                ds = dhi - dlo  # of the loss
                own, inverse = np.unique(at, return_inverse=True)
                g = np.bincount(inverse, weights=ds[owner]) + DECAY * w[own]
                square[own] += g * g
                w[own] -= RATE * g / np.sqrt(square[own])
                de = np.zeros(GRADES + 1)
                np.add.at(de, grades[some] + 1, -dhi)
                np.add.at(de, grades[some], dlo)
                inner = de[1:-1]
                dt = np.array([inner.sum(), *(np.exp(t[k]) * inner[k:].sum() for k in range(1, len(t)))])
                t_square += dt * dt
                t -= RATE * dt / np.sqrt(t_square)
            if 2 * epoch >= EPOCHS:
                average, average_t, steps = average + w, average_t + t, steps + 1
        if steps:
            w, t = average / steps, average_t / steps
        return cls(w.astype(np.float32), cut(t)[1:-1])


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade of doc_id, quality, toxic. Rows without id or quality are left out; of repeated ids the least grade counts."""
    grade = F.when(F.coalesce("toxic", F.lit(0)) > 0, 0).when(F.col("quality") < 1, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null").select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit(docs: DataFrame, grades: DataFrame, most: int = MOST_LABELLED) -> OrdinalModel:
    """``docs``: doc_id, text; ``grades``: doc_id, grade. At most ``most`` graded ids are used, and broadcast; of an id's texts, the least counts once."""
    drawn = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("id"), "grade")
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("id")).groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                numbers, counts = features(part.column("text"))
                data, cuts = numbers.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("grade"), pa.array([data[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())], ["doc_id", "grade", "numbers"])

    table = rows.mapInArrow(run, "doc_id long, grade int, numbers binary").toArrow().combine_chunks().sort_by("doc_id")
    raw, off = blocks.utf8(table.column("numbers"))
    return OrdinalModel.fit(np.frombuffer(raw.tobytes(), "<u4").astype(np.int64), np.diff(off) // 4, table.column("grade").to_numpy().astype(np.int64))


def grade(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` with expected_grade, p_good (chance of the best grade) and kept (p_good of a half at least).

    Null and empty texts are graded by their lengths. Columns of those names are replaced, others pass through.
    """
    new = ["expected_grade", "p_good", "kept"]
    docs = docs.drop(*[c for c in docs.columns if c in new and c != text])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "expected_grade double, p_good double, kept boolean"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                tails = shared.value.tails(shared.value.scores(*features(part.column(text))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= 0.5)], [*part.schema.names, *new])

    return docs.mapInArrow(run, schema)


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades every document by a model of the labelled ones (null and empty texts by their lengths; repeated rows alike)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return grade(docs, model).select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("p_good", 6).alias("p_good"), "kept")
