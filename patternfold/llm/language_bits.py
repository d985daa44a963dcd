"""Language identification by one bit-sliced Bloom filter for all languages.

The filter has a word of language bits at each position. An n-gram's K words, joined by AND, are the mask of
all languages that (seem to) hold it; the set bits are counted by language over a text, corrected for each
language's rate of false positives, and the largest corrected share decides.

N-grams are three symbols: letters (case folded), digits, punctuation and white space by class, and letters
beyond ASCII by their last byte. A language holds an n-gram if its share of the language's n-grams is at
least RATE and at least a KIN-th of its share in any other language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternfold.llm import arrays, blocks, shared
from patternfold.llm.blocks import mix, slices

CODES = 64**3
POSITIONS = 1 << 18
K = 3
RATE = 2e-5
KIN = 8
UNKNOWN = "und"
MOST_LANGUAGES = 512


def _symbols() -> np.ndarray:
    """Symbol 0: white space; 1-26: letters; 27: digits; 28: other ASCII; 29-63: later bytes of other characters."""
    s = np.full(256, 28, np.uint8)
    s[[9, 10, 11, 12, 13, 32]] = 0
    s[65:91] = s[97:123] = np.arange(1, 27)
    s[48:58] = 27
    s[128:] = 29 + np.arange(128) % 35
    return s


_SYMBOL = _symbols()
#: Lead bytes of two-byte Latin letters carry little; their second byte stands for the letter.
_LEAD = np.zeros(256, bool)
_LEAD[0xC2:0xC6] = True


def grams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """N-gram codes of all texts, n-grams per text, and the texts' bytes and offsets. A text is framed by two spaces on each side."""
    raw, off = blocks.utf8(column)
    keep = ~_LEAD[raw]
    at = np.concatenate([[0], np.cumsum(keep)])[off]
    symbols = _SYMBOL[raw[keep]]
    n = len(off) - 1
    sizes = np.diff(at)
    out = np.zeros(len(symbols) + 4 * n, np.int32)
    shift = np.repeat(4 * np.arange(n) + 2, sizes)
    out[np.arange(len(symbols)) + shift] = symbols
    codes = out[:-2] << 12 | out[1:-1] << 6 | out[2:] if len(out) else out
    starts = at[:-1] + 4 * np.arange(n)
    good = np.ones(len(codes), bool)
    for k in (1, 2):  # n-grams that would reach into the next text
        last = starts + sizes + 4 - k
        good[last[last < len(codes)]] = False
    return codes[good], sizes + 2, raw, off


def _positions(codes: np.ndarray, k: int) -> np.ndarray:
    return (mix(codes.astype(np.uint64) * np.uint64(2654435761) + np.uint64(k + 1)) & np.uint64(POSITIONS - 1)).astype(np.int64)


_ALL = np.arange(CODES)
_AT: list[np.ndarray] = []


@dataclass
class LanguageFilter:
    languages: list[str]
    planes: np.ndarray  # uint64 [64 languages each, POSITIONS]
    false_rate: np.ndarray  # by language

    @classmethod
    def build(cls, languages: list[str], counts: np.ndarray) -> "LanguageFilter":
        """counts: [language, CODES]."""
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        held = (share >= RATE) & (share * KIN >= share.max(axis=0, keepdims=True)) if len(languages) else np.zeros((0, CODES), bool)
        planes = np.zeros((max(1, -(-len(languages) // 64)), POSITIONS), np.uint64)
        for i in range(len(languages)):
            own = np.flatnonzero(held[i])
            for k in range(K):
                planes[i // 64, _positions(own, k)] |= np.uint64(1 << i % 64)
        fill = np.array([((planes[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        return cls(languages, planes, fill**K)

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """[plane, n-gram]: the languages holding each n-gram."""
        if not _AT:
            _AT.extend(_positions(_ALL, k) for k in range(K))
        found = self.planes[:, _AT[0][codes]]
        for k in range(1, K):
            found &= self.planes[:, _AT[k][codes]]
        return found

    def shares(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """[text, language]: share of a text's n-grams that the language holds, without the false positives."""
        n = len(counts)
        out = np.zeros((n, len(self.languages)))
        if not len(codes):
            return out
        starts = np.cumsum(counts) - counts
        masks = self.masks(codes)
        for i, rate in enumerate(self.false_rate):
            bits = (masks[i // 64] >> np.uint64(i % 64)).astype(np.uint8) & np.uint8(1)
            hits = np.add.reduceat(bits, starts, dtype=np.int64)
            out[:, i] = np.clip((hits / counts - rate) / (1 - rate), 0, 1) if rate < 1 else 0
        return out

    def predict(self, column) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (the best share over the sum of all), and the best share, of each text."""
        codes, counts, raw, off = grams(column)
        shares = self.shares(codes, counts)
        letters = ((raw | 32) >= 97) & ((raw | 32) <= 122)
        seen = np.concatenate([[0], np.cumsum(letters)])
        has = seen[off[1:]] > seen[off[:-1]]
        for d in np.flatnonzero(~has & (np.diff(off) > 0)).tolist():
            has[d] = any(c.isalpha() for c in raw[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace"))
        if not self.languages:
            return [UNKNOWN] * len(has), np.zeros(len(has)), np.zeros(len(has))
        best = shares.argmax(axis=1)
        top = shares[np.arange(len(best)), best]
        total = shares.sum(axis=1)
        score = np.where(has & (total > 0), top / np.where(total > 0, total, 1), 0.0)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())], score, np.where(has, top, 0.0)


def learn(docs: DataFrame, train: Column, text: str = "text", language: str = "lang") -> LanguageFilter:
    """Counts the n-grams of every row where ``train`` holds and text and language are known; nulls are left out.

    What reaches the driver are the counts: CODES numbers for each language. More than MOST_LANGUAGES are refused, so
    that a column of something else can't fill its memory.
    """
    rows = docs.where(train & F.col(language).isNotNull() & F.col(text).isNotNull())
    shared.text_batches(docs.sparkSession)
    languages = sorted(r[0] for r in rows.select(language).distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {language}")
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(languages) * CODES, np.int64)
        for batch in batches:
            for part in slices(batch):
                codes, per, _, _ = grams(part.column("text"))
                own = np.array([number[x] for x in part.column("lang").to_pylist()], np.int64)
                starts = np.concatenate([[0], np.cumsum(per)])
                for i in np.unique(own).tolist():
                    pick = blocks.ragged(starts[:-1][own == i], per[own == i])
                    counts[i * CODES : (i + 1) * CODES] += np.bincount(codes[pick], minlength=CODES)
        keys, data = arrays.pieces(counts)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], ["key", "data"])

    pieces = rows.select(F.col(text).alias("text"), F.col(language).alias("lang")).mapInArrow(run, "key int, data binary")
    counts = arrays.total(pieces, len(languages) * CODES) if languages else np.zeros(0, np.int64)
    return LanguageFilter.build(languages, counts.reshape(len(languages), CODES))


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and share. Null texts and texts without a letter: und, 0, 0.

    Columns of those names are replaced, all others pass through.
    """
    new = ["lang_pred", "score", "share"]
    docs = docs.drop(*[c for c in docs.columns if c in new and c != text])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, score double, share double"])
    shared.text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                language, score, share = sent.value.predict(part.column(text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(language, pa.string()), pa.array(score), pa.array(share)], [*part.schema.names, *new])

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id", parts: int = 4, which: int = 2) -> Column:
    """Whether crc32(key as text) mod ``parts`` is ``which``; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == which, F.lit(False))


def op4_language_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out (null texts and texts without a letter: und; repeated rows alike)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.select("doc_id", "text", "lang"), F.col("doc_id").isNotNull() & ~held_out())
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "share")
