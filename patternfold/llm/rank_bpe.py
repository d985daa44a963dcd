"""BPE encoding and decoding with contiguous rank arrays.

Words of equal length stand in the rows of one array of parts beside one array of the ranks of adjacent
parts. Each step scans every row for its least rank (the leftmost of equal ones), deletes that boundary by
moving the rest of the row left, and looks up the two ranks beside the new part. Words over LONG bytes,
where repeated scans would cost the square of the length, merge by a heap to the same result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from patternfold.llm import blocks
from patternfold.llm.blocks import Growing, HashIndex, Remembered, mix, ragged, slices

LONG = 1024
_NONE = np.int32(2**31 - 1)
_U = np.uint64

#: Fixed values of the tokenizer file: how it splits normalised text.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(others)) for b in range(256)]


def normalise(text: str) -> str:
    """NFC, then lower case letter by letter (a final sigma is like any other)."""
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class RankBpe:
    """A word-level BPE of a tokenizer file with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[s] for s in symbols], np.int32)
        self.final = np.array([self.vocab[s + self.suffix] for s in symbols], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([self.vocab[a + b] for a, b in pairs], np.int32)
        self.index = HashIndex(17)
        self.index.add(self._key(left, right))
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((a.astype(np.int64) << 24 | b).astype(_U) + _U(1))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of parts; _NONE where they don't merge or there is no right part (-1)."""
        found = self.index.find(self._key(a, np.maximum(b, 0)))
        return np.where((found < 0) | (a < 0) | (b < 0), _NONE, found).astype(np.int32)

    def _merge_rows(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of parts of one length, merged; rows are filled up with -1. Also their lengths."""
        n, width = part.shape
        out, sizes = np.full((n, width), -1, np.int32), np.full(n, width, np.int64)
        if width == 1:
            return part, sizes
        rank = self.ranks(part[:, :-1].ravel(), part[:, 1:].ravel()).reshape(n, width - 1)
        rank = np.concatenate([rank, np.full((n, 1), _NONE, np.int32)], axis=1)
        row = np.arange(n)
        while len(row):
            at = rank.argmin(axis=1)
            every = np.arange(len(row))
            best = rank[every, at]
            live = best < _NONE
            if not live.all():
                out[row[~live], : part.shape[1]] = part[~live]
                row, part, rank, at, best = row[live], part[live], rank[live], at[live], best[live]
                every = np.arange(len(row))
                if not len(row):
                    break
            sizes[row] -= 1
            columns = np.arange(part.shape[1])[None]
            source = np.minimum(columns + (columns > at[:, None]), part.shape[1] - 1)
            gone = part.shape[1] - 1
            part, rank = np.take_along_axis(part, source, 1), np.take_along_axis(rank, source, 1)
            part[:, gone], rank[:, gone] = -1, _NONE
            part[every, at] = self.merged[best]
            part, rank = part[:, :gone], rank[:, :gone]  # every live row has lost a boundary
            if gone == 1:
                out[row, :1] = part
                break
            after = np.minimum(at + 1, gone - 1)
            rank[every, at] = np.where(at + 1 < gone, self.ranks(part[every, at], part[every, after]), _NONE)
            some = np.flatnonzero(at > 0)
            rank[some, at[some] - 1] = self.ranks(part[some, at[some] - 1], part[some, at[some]])
        return out, sizes

    def _merge_long(self, part: np.ndarray) -> np.ndarray:
        parts, n = part.tolist(), len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), i, parts[i], parts[i + 1]) for i, r in enumerate(self.ranks(part[:-1], part[1:])) if r < _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = int(self.merged[rank]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n:
                    r = int(self.ranks(np.array([parts[x]]), np.array([parts[after[x]]]))[0])
                    if r < _NONE:
                        heapq.heappush(heap, (r, x, parts[x], parts[after[x]]))
        return np.array([p for p in parts if p >= 0], np.int32)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        first = np.cumsum(sizes) - sizes
        symbols = self.inner[raw]
        full = sizes > 0
        last = (first + sizes - 1)[full]
        symbols[last] = self.final[raw[last]]
        counts = np.zeros(len(pieces), np.int64)
        got: list[tuple[np.ndarray, np.ndarray]] = []
        for length in np.unique(sizes[full]).tolist():
            rows = np.flatnonzero(sizes == length)
            if length > LONG:
                for r in rows.tolist():
                    ids = self._merge_long(symbols[first[r] : first[r] + length])
                    counts[r] = len(ids)
                    got.append((np.array([r]), ids))
                continue
            step = max(1, (1 << 18) // length)
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                merged, n = self._merge_rows(symbols[first[some][:, None] + np.arange(length)])
                counts[some] = n
                got.append((some, merged[merged >= 0]))
        ends = np.cumsum(counts)
        ids = np.empty(int(counts.sum()), np.int32)
        for rows, own in got:
            ids[ragged(ends[rows] - counts[rows], counts[rows])] = own
        return ids, counts

    def encode_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (without special tokens) and how many each has."""
        pieces, per = [], np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            found = PATTERN.findall(normalise(t))
            per[i] = len(found)
            pieces += found
        ids, counts = self.merge([p.encode("utf-8") for p in pieces])
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(per)])]
        return ids, np.diff(ends)

    def encode(self, text: str) -> list[int]:
        """A whole text; the strings of special tokens give their ids."""
        ids: list[int] = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids += self.encode_words([part])[0].tolist()
        return ids

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, as for a file that names no decoder."""
        return " ".join(self.tokens[i] for i in ids)

    def text(self, ids: list[int]) -> str:
        """Readable text: bytes back from their symbols, word ends to spaces."""
        back = {c: b for b, c in enumerate(byte_symbols())}
        out = bytearray()
        for i in ids:
            token, end = self.tokens[i], False
            if i in self.special.values():
                out += token.encode()
                continue
            if self.suffix and token.endswith(self.suffix):
                token, end = token[: -len(self.suffix)], True
            out += bytes(back[c] for c in token)
            if end:
                out += b" "
        return out.decode("utf-8", "replace").rstrip(" ")


class _Words(Remembered):
    """What a worker process remembers of words: their ids and tokens as text."""

    def __init__(self, path: str):
        self.bpe = RankBpe(path)
        self.token_text = {i: t.encode("utf-8") for i, t in self.bpe.tokens.items()}
        self.id_text = {i: str(i).encode() for i in self.bpe.tokens}
        self.marks = [s.encode() for s in self.bpe.special]
        self._reset()

    def _reset(self) -> None:
        super()._reset()
        self.ids, self.tokens, self.count = Growing(object), Growing(object), Growing(np.int64)

    def _keep(self, numbers) -> None:
        self.ids, self.tokens, self.count = Growing(object, self.ids.take(numbers)), Growing(object, self.tokens.take(numbers)), Growing(np.int64, self.count.take(numbers))

    def _learn(self, raw, start, end) -> None:
        flat, count = self.bpe.encode_words([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())])
        ids, tokens = np.empty(len(start), object), np.empty(len(start), object)
        flat, a = flat.tolist(), 0
        id_text, token_text = self.id_text, self.token_text
        for k, n in enumerate(count.tolist()):
            own = flat[a : a + n]
            ids[k], tokens[k] = b" ".join([id_text[i] for i in own]), b" ".join([token_text[i] for i in own])
            a += n
        self.ids.add(ids), self.tokens.add(tokens), self.count.add(count)

    def rows(self, part: pa.RecordBatch, column: str) -> list[tuple[int, str, str]]:
        w = blocks.words(part.column(column))
        raw = w.raw.tobytes()
        number = self.numbers(w.hash, w.raw, w.start, w.end)
        count = self.count.take(number)
        bounds = w.bounds
        sums = np.concatenate([[0], np.cumsum(count)])[bounds]
        ids, tokens = self.ids.take(number), self.tokens.take(number)
        bare = count == 0  # only white space beyond ASCII
        out = []
        for d in range(part.num_rows):
            a, b = bounds[d], bounds[d + 1]
            text = raw[w.off[d] : w.off[d + 1]]
            if any(m in text for m in self.marks):
                whole = self.bpe.encode(text.decode("utf-8"))
                own_ids, own_tokens, n = " ".join(map(str, whole)).encode(), self.bpe.decode(whole).encode(), len(whole)
            else:
                i, t = ids[a:b], tokens[a:b]
                if bare[a:b].any():
                    i, t = i[~bare[a:b]], t[~bare[a:b]]
                own_ids, own_tokens, n = b" ".join(i.tolist()), b" ".join(t.tolist()), int(sums[d + 1] - sums[d])
            out.append((n, hashlib.sha256(own_ids).hexdigest(), hashlib.sha256(own_tokens).hexdigest()))
        return out


_KEPT: dict[str, _Words] = {}


def token_digests(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 for every row of ``df``.

    Null texts count as empty; repeated rows stay; other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _KEPT:
            _KEPT[path] = _Words(path)
        for batch in batches:
            for part in slices(batch):
                rows = _KEPT[path].rows(part, "text")
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, df[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ids (array<int>) of every text; null texts have none. A column named ``out`` is replaced."""
    df = df.drop(*[c for c in df.columns if c == out and c != text])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` array<int>"])

    def run(batches):
        bpe = RankBpe(path)
        for batch in batches:
            for part in slices(batch, text):
                ids = [bpe.encode(t or "") for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*part.schema.names, out])

    return df.mapInArrow(run, schema)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests (null texts: empty; repeated rows alike)."""
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_vocabulary())
