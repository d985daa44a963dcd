"""A small causal self-attention language model over subword ids, trained and run in numpy.

Subwords are the ids of a byte-level BPE file that the corpus uses most; other ids are taken apart along their merges.
Texts are encoded once, and their ids written. The last number is the end of a text, which also stands before it. A text
is scored in windows of WINDOW inputs that overlap by WINDOW - STRIDE: the last STRIDE positions of each are scored, so
every subword once, with causal attention.

The next subword's probability has three factors, one for each choice along a tree, so no step is as wide as the
vocabulary. Training: one pass over all training documents, dealt by row to a trainer for each CORPUS_ROWS of them and to
ROUNDS rounds. In each round all trainers start from the mean of the round before. A trainer makes steps of TRAIN_BATCH to
MOST_BATCH windows of its documents, however many they are, and holds CHUNK subwords at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternfold.llm import arrays, blocks, shared
from patternfold.llm.blocks import Growing, Remembered, ragged, slices
from patternfold.llm.byte_tokens import default_vocabulary
from patternfold.llm.word_counts import unigram_scores

BITS = (3, 4, 4)
FAN = tuple(1 << b for b in BITS)
SUBWORDS = (1 << sum(BITS)) - 1
END = SUBWORDS
WIDTH = 16  # the last one of the values and of the hidden values is always one: sums and biases come with the products
WINDOW, STRIDE = 24, 20
BACK = WINDOW - STRIDE
BATCH, GROUP = 128, 8  # windows that attend at a time, and such batches whose outputs are computed together
CORPUS_ROWS = 25_600
ROUNDS = 2
TRAIN_BATCH, GROWTH, MOST_BATCH = 64, 400, 512  # windows that make a step
CHUNK = 1 << 20  # subwords a trainer holds at a time, and a batch more
RATE = 0.03
_POINT = 1 << 24
SAFE = 60.0  # logits beyond it are shifted before exp
_MASK = np.where(np.tri(WINDOW, dtype=bool), 0, -np.inf).astype(np.float32)[BACK:]


#: The characters that stand for the 256 bytes in byte-level files, and how a text falls into pieces.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {chr(c): c for c in _SHOWN} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in _SHOWN)}
_PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|[^\S ]+| """


class WordIds(Remembered):
    """Ids of words in a byte-level BPE file, each word encoded once while remembered.

    Of two neighbours that make a known token, those that make the earliest one merge first. A space begins a piece, so what stands around a word has no part in its ids."""

    MOST = 1_200_000

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        merged = (m if isinstance(m, str) else " ".join(m) for m in model["merges"])
        spelled = dict.fromkeys([*_BYTES, *(m.replace(" ", "") for m in merged)])
        self.encoding = tiktoken.Encoding("words", pat_str=_PIECES, mergeable_ranks={bytes(_BYTES[c] for c in x): i for i, x in enumerate(spelled)}, special_tokens={})
        self.id = np.array([vocabulary[x] for x in spelled], np.int64)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.width[self.id] = [len(x) for x in spelled]
        self.opens = np.zeros(len(self.width), bool)  # ids that begin with a space: a word's first one does, no other
        self.opens[self.id] = [_BYTES[x[0]] == 32 for x in spelled]
        self.kind = np.uint16 if len(self.width) <= 1 << 16 else np.uint32
        self._reset()

    def _reset(self) -> None:
        super()._reset()
        self.start, self.length, self.store = Growing(np.int64), Growing(np.int64), Growing(self.kind)

    def _keep(self, numbers) -> None:
        sizes = self.length.take(numbers)
        ids = self.store.take(ragged(self.start.take(numbers), sizes))
        self._reset()
        self._append(ids, sizes)

    def _append(self, ids, sizes) -> None:
        self.start.add(self.store.n + np.cumsum(sizes) - sizes)
        self.store.add(ids), self.length.add(sizes)

    def _learn(self, raw, start, end) -> None:
        """Words follow each other, each after a space, so that many are encoded at a time."""
        for i in range(0, len(start), 16384):
            size = end[i : i + 16384] - start[i : i + 16384]
            stop = np.cumsum(size + 1)
            data = np.full(int(stop[-1]), 32, np.uint8)
            data[ragged(stop - size, size)] = raw[ragged(start[i : i + 16384], size)]
            ids = self.id[self.encoding.encode_ordinary(data.tobytes().decode())]
            ends = np.searchsorted(np.cumsum(self.width[ids]), stop) + 1
            self._append(ids, np.diff(ends, prepend=0))

    def streams(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        w = blocks.words(column, lower=True)
        number = self.numbers(w.hash, w.raw, w.start, w.end)
        length = self.length.take(number)
        ids = self.store.take(ragged(self.start.take(number), length))
        return ids, np.diff(np.concatenate([[0], np.cumsum(length)])[w.bounds])


_KEPT: dict[str, WordIds] = {}


def kept(path: str) -> WordIds:
    if path not in _KEPT:
        _KEPT[path] = WordIds(path)
    return _KEPT[path]


class Subwords:
    """The SUBWORDS ids of a BPE file that a corpus uses most, its single bytes among them, numbered from the most frequent on; other ids are taken apart along their merges."""

    def __init__(self, path: str, counts: np.ndarray):
        """``counts``: how often each id stands in the corpus."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        halves = {vocabulary[a + b]: (vocabulary[a], vocabulary[b]) for a, b in pairs}
        counts = np.concatenate([counts, np.zeros(max(vocabulary.values()) + 1 - len(counts), np.int64)])
        whole = np.array([i not in halves for i in range(len(counts))])
        ranked = np.lexsort((np.arange(len(counts)), -counts, ~whole))
        chosen = ranked[: max(SUBWORDS, int(whole.sum()))][:SUBWORDS]
        chosen = chosen[np.lexsort((chosen, -counts[chosen]))]
        number = np.full(len(counts), -1, np.int64)
        number[chosen] = np.arange(len(chosen))
        known = number.tolist()
        parts: dict[int, list[int]] = {}

        def apart(i: int) -> list[int]:
            if i not in parts:
                parts[i] = [known[i]] if known[i] >= 0 else apart(halves[i][0]) + apart(halves[i][1]) if i in halves else []
            return parts[i]

        every = [apart(i) for i in range(len(counts))]
        self.size = np.fromiter(map(len, every), np.int64, len(every))
        self.parts = np.fromiter((x for p in every for x in p), np.int32, int(self.size.sum()))
        self.first = np.cumsum(self.size) - self.size
        self.start = np.full(len(every), -1, np.int32)  # an id's first part; -1 where it has none
        self.start[self.size > 0] = self.parts[self.first[self.size > 0]]

    def streams(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subwords of all texts, each text with its end, and how many each has, from ids of the file."""
        small, ends = np.take(self.start, ids), np.concatenate([[0], np.cumsum(sizes)])
        odd = np.flatnonzero(np.take(self.size != 1, ids))  # few; their further parts come in with the ends of texts
        if not len(odd):
            return np.insert(small, ends[1:], END), sizes + 1
        more = self.size[ids[odd]] - 1
        further = self.parts[ragged(self.first[ids[odd]] + 1, np.maximum(more, 0))]
        some = np.insert(small, np.concatenate([np.repeat(odd + 1, np.maximum(more, 0)), ends[1:]]), np.concatenate([further, np.full(len(sizes), END, np.int32)]))
        return some[some >= 0] if (more < 0).any() else some, np.diff(np.concatenate([[0], np.cumsum(more)])[np.searchsorted(odd, ends)]) + sizes + 1


def windows(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets of all texts in one row each, where windows start, and windows per text.

    A text takes BACK places before its windows' STRIDE ones; what no subword fills holds the end, and target -1.
    """
    per = -(-sizes // STRIDE)
    room = BACK + STRIDE * per
    begin = np.cumsum(room) - room
    used = np.ones(int(room.sum()), bool)
    used[ragged(begin, np.full(len(room), BACK))] = False
    used[ragged(begin + BACK + sizes, STRIDE * per - sizes)] = False
    x, y = np.empty(len(used) + 1, np.int32), np.full(len(used), -1, np.int32)
    y[used] = ids
    x[0] = END
    np.bitwise_and(y, END, out=x[1:])  # -1 becomes the end, whose bits are all ones
    x[begin + BACK + sizes] = END  # a text's last target is nobody's input
    x = x[:-1]
    turn = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    return x, y, np.repeat(begin, per) + STRIDE * turn, per


def _softmax_sums(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """Turns the rows of ``logits`` into exp(logits - shift) in place; their sums, and the shift.

    Rows are shifted by their greatest logit wherever any is so large that exp could leave the range of float32.
    """
    shift: np.ndarray | float = 0.0
    if logits.size and max(float(logits.max()), -float(logits.min())) > SAFE:
        shift = logits.max(axis=-1)
        logits -= shift[..., None]
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[-1], logits.dtype), shift


class Attention:
    """One layer, one head: inputs attend to themselves and what stands before them in their window; the subword before
    also has a path of its own. Queries meet the inputs and values go to the hidden values as they are: with one head of
    full width, a matrix of keys would only be a factor of that of queries, and one of outputs a factor of that of values. The next subword is told by three choices along a tree: one of FAN[0] branches, one of
    FAN[1] in it, one of FAN[2] leaves. Each choice is a softmax over the hidden values."""

    SHAPES = {
        "e": (SUBWORDS + 1, WIDTH), "p": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "b": (WIDTH, WIDTH),
        "u1": (WIDTH, FAN[0]), "u2": (FAN[0], WIDTH, FAN[1]), "u3": (FAN[0] * FAN[1], WIDTH, FAN[2]),
    }

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.learned = 0  # subwords it was fitted on

    @classmethod
    def fresh(cls, seed: int = 5) -> "Attention":
        r = np.random.default_rng(seed)
        scale = {"e": 0.5, "p": 0.1}
        w = {k: (r.standard_normal(s) * scale.get(k, 0.25)).astype(np.float32) for k, s in cls.SHAPES.items()}
        for k in ("u1", "u2", "u3"):
            w[k][..., -1, :] = 0
        return cls(w)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in self.SHAPES])

    @classmethod
    def unflat(cls, flat: np.ndarray) -> "Attention":
        """A model whose weights are views of ``flat``."""
        out, a = {}, 0
        for k, s in cls.SHAPES.items():
            n = int(np.prod(s))
            out[k] = flat[a : a + n].reshape(s)
            a += n
        return cls(out)

    def _hidden(self, x: np.ndarray):
        w, n = self.w, len(x)
        h = np.take(w["e"], x, axis=0)
        h += w["p"]
        flat, own = h.reshape(-1, WIDTH), h[:, BACK:].reshape(-1, WIDTH)
        q = (own @ (w["q"] / np.float32(WIDTH**0.5))).reshape(n, STRIDE, WIDTH)
        v = (flat @ w["v"]).reshape(n, WINDOW, WIDTH)
        v[:, :, -1] = 1  # so that the product with the values also gives the sum of the weights
        s = np.matmul(q, h.transpose(0, 2, 1))
        large = s.size and max(float(s.max()), -float(s.min())) > SAFE
        s += _MASK  # minus infinity: no weight at all for what stands behind
        if large:
            s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        c = np.matmul(s, v)
        scale = 1 / c[:, :, -1:]
        c *= scale
        before = h[:, BACK - 1 : -1].reshape(-1, WIDTH)
        g = before @ w["b"]
        g += own
        g += c.reshape(-1, WIDTH)
        np.tanh(g, out=g)
        g[:, -1] = 1
        return h, own, before, q, v, s, scale, c, g

    def _choices(self, g: np.ndarray, y: np.ndarray):
        """For the targets that are not -1, ordered along the tree: their positions, hidden values, numbers, the
        bounds of each inner node's targets, and the logits of each of the three choices."""
        node = (y >> BITS[2]).astype(np.int16)
        order = np.argsort(node, kind="stable")
        ends = np.searchsorted(node[order], np.arange(FAN[0] * FAN[1] + 1))
        order = order[ends[0] :]
        ends = (ends - ends[0]).tolist()
        own, t = np.take(g, order, axis=0), np.take(y, order)
        spans = [[(i, a, b) for i, a, b in zip(range(len(e)), e, e[1:]) if b > a] for e in (ends[:: FAN[1]], ends)]
        logits = [own @ self.w["u1"], np.empty((len(t), FAN[1]), g.dtype), np.empty((len(t), FAN[2]), g.dtype)]
        for k, l, of in zip(("u2", "u3"), logits[1:], spans):
            u = self.w[k]
            for i, a, b in of:
                np.matmul(own[a:b], u[i], out=l[a:b])
        return order, own, t, spans, logits

    @staticmethod
    def _picks(t: np.ndarray) -> list[np.ndarray]:
        """The branch taken at each of the three choices."""
        return [t >> BITS[1] + BITS[2], t >> BITS[2] & FAN[1] - 1, t & FAN[2] - 1]

    def log_probs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logarithms for targets y [n, STRIDE] under inputs x [n, WINDOW]; 0 where y is -1."""
        return self._out(self._hidden(x)[-1], y.ravel())

    def _out(self, g: np.ndarray, y: np.ndarray) -> np.ndarray:
        order, _, t, _, logits = self._choices(g, y)
        at, out = np.arange(len(t)), np.zeros(len(t), g.dtype)
        for l, pick in zip(logits, self._picks(t)):
            out += np.take(l.ravel(), at * l.shape[1] + pick)
            total, shift = _softmax_sums(l)
            out -= np.log(total)
            out -= shift
        back = np.zeros(len(y), g.dtype)
        back[order] = out
        return back

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over targets, and its gradients. Attention runs on BATCH windows at a time, which stay in cache, the choices on all."""
        w, n = self.w, len(x)
        parts = [self._hidden(x[i : i + BATCH]) for i in range(0, n, BATCH)]
        g = np.concatenate([p[-1] for p in parts])
        order, own, t, spans, logits = self._choices(g, y.ravel())
        count, at = max(len(t), 1), np.arange(len(t))
        loss = 0.0
        for l, pick in zip(logits, self._picks(t)):
            sums, _ = _softmax_sums(l)
            sums *= count
            l /= sums[:, None]
            line, hit = l.ravel(), at * l.shape[1] + pick
            p = np.take(line, hit)
            loss -= float(np.log(p * count + 1e-30).sum()) / count
            line[hit] = p - 1 / count
        d = {k: np.zeros_like(v) for k, v in w.items()}
        d["u1"] += own.T @ logits[0]
        back = logits[0] @ w["u1"].T
        some = np.empty_like(back)
        for key, l, of in zip(("u2", "u3"), logits[1:], spans):
            for i, a, b in of:
                np.matmul(own[a:b].T, l[a:b], out=d[key][i])
                np.matmul(l[a:b], w[key][i].T, out=some[a:b])
            back += some
        dz = np.zeros_like(g)
        dz[order] = back
        dh = np.empty((n, WINDOW, WIDTH), g.dtype)
        for i, part in zip(range(0, n, BATCH), parts):
            self._back(d, part, dz[i * STRIDE : (i + BATCH) * STRIDE], dh[i : i + BATCH])
        d["p"] += dh.sum(axis=0)
        of = x.ravel().astype(np.int16)
        inputs = np.argsort(of, kind="stable")
        of = np.take(of, inputs)
        head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        if len(head):
            d["e"][of[head]] = np.add.reduceat(np.take(dh.reshape(-1, WIDTH), inputs, axis=0), head, axis=0)
        return loss, d

    def _back(self, d: dict[str, np.ndarray], part: tuple, dz: np.ndarray, dh: np.ndarray) -> None:
        """From the gradient dz of hidden values: adds to the gradients of the layer, and sets that of its inputs. Uses up ``part`` and dz."""
        w, n = self.w, len(dh)
        h, here, before, q, v, s, scale, c, g = part
        g *= g
        np.subtract(1, g, out=g)  # 0 for the one
        dz *= g
        dc = dz.reshape(n, STRIDE, WIDTH)
        s *= scale
        ds = np.matmul(dc, v.transpose(0, 2, 1))
        dv = np.matmul(s.transpose(0, 2, 1), dc).reshape(-1, WIDTH)
        # the mean of ds under the weights is what dc tells of c
        c *= dc
        ds -= (c.reshape(-1, WIDTH) @ np.ones((WIDTH, 1), g.dtype)).reshape(n, STRIDE, 1)
        ds *= s
        np.matmul(ds.transpose(0, 2, 1), q, out=dh)
        dq = np.matmul(ds, h).reshape(-1, WIDTH)
        dq *= np.float32(WIDTH**-0.5)
        d["b"] += before.T @ dz
        d["q"] += here.T @ dq
        d["v"] += h.reshape(-1, WIDTH).T @ dv
        all_ = dh.reshape(-1, WIDTH)
        all_ += dv @ w["v"].T
        dh[:, BACK - 1 : -1] += (dz @ w["b"].T).reshape(n, STRIDE, WIDTH)
        dz += dq @ w["q"].T
        dh[:, BACK:] += dc

    def score(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        x, y, start, per = windows(ids, sizes)
        sums = np.empty(len(start))
        inputs, outputs = np.arange(WINDOW), np.arange(BACK, WINDOW)
        for i in range(0, len(start), GROUP * BATCH):
            many = start[i : i + GROUP * BATCH, None]
            g = np.concatenate([self._hidden(np.take(x, many[j : j + BATCH] + inputs))[-1] for j in range(0, len(many), BATCH)])
            sums[i : i + GROUP * BATCH] = self._out(g, np.take(y, many + outputs).ravel()).reshape(-1, STRIDE).sum(axis=1)
        return np.add.reduceat(sums, np.cumsum(per) - per) / np.log(10) if len(per) else np.zeros(0)


class Trainer:
    """Adam over the windows of texts as they come: each window makes one step with others, none is kept after it."""

    def __init__(self, model: Attention, expected: float, seed: int, fresh: bool = False, rate: float = RATE):
        """``expected``: texts that will come, about; the rate falls to a tenth over them. ``fresh``: biases begin with how often branches occur in the first of them."""
        self.flat, self.rate, self.expected, self.random = model.flat(), rate, max(expected, 1.0), np.random.default_rng(seed)
        self.model, self.fresh = Attention.unflat(self.flat), fresh
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.step = self.texts = self.subwords = 0
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def begin(self, ids: np.ndarray) -> None:
        count = np.bincount(ids, minlength=SUBWORDS + 1).reshape(FAN) + 0.5
        for k, c in (("u1", count.sum(axis=(1, 2))), ("u2", count.sum(axis=2)), ("u3", count.reshape(-1, FAN[2]))):
            self.model.w[k][..., -1, :] = np.log(c / c.sum(axis=-1, keepdims=True))

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids.append(ids)
        self.sizes.append(sizes)
        if sum(map(len, self.ids)) >= CHUNK:
            self.flush()

    def flush(self) -> None:
        """A pass over the texts at hand, windows in random order. The more steps, the more windows make one: TRAIN_BATCH of them, twice as many after every GROWTH steps up to MOST_BATCH."""
        if not self.sizes:
            return
        ids, sizes = np.concatenate(self.ids), np.concatenate(self.sizes)
        self.ids, self.sizes = [], []
        if not len(sizes):
            return
        if not self.subwords and self.fresh:
            self.begin(ids)
        x, y, start, _ = windows(ids, sizes)
        start = self.random.permutation(start)
        i = 0
        while i < len(start):
            pick = start[i : i + min(MOST_BATCH, TRAIN_BATCH << self.step // GROWTH), None]
            self._step(*self.model.gradients(np.take(x, pick + np.arange(WINDOW)), np.take(y, pick + np.arange(BACK, WINDOW))), self.texts + len(sizes) * i / len(start))
            i += len(pick)
        self.texts += len(sizes)
        self.subwords += len(ids)

    def _step(self, _loss: float, d: dict[str, np.ndarray], done: float) -> None:
        self.step += 1
        now = self.rate * min(1.0, self.step / 20) * (1.0 - 0.9 * min(1.0, done / self.expected))
        g = np.concatenate([d[k].ravel() for k in Attention.SHAPES])
        self.first *= 0.9
        self.first += np.float32(0.1) * g
        g *= g
        g *= np.float32(0.02)
        self.second *= 0.98
        self.second += g
        np.multiply(self.second, 1 / (1 - 0.98**self.step), out=g)
        np.sqrt(g, out=g)
        g += np.float32(1e-8)
        np.divide(self.first, g, out=g)
        g *= now / (1 - 0.9**self.step)
        self.flat -= g


_ENCODED = "kind string, doc_id long, hash long, held_out boolean, ids binary, key int, data binary"


def encode(rows: DataFrame, path: str) -> tuple[DataFrame, np.ndarray]:
    """doc_id, hash, held_out, ids (binary) of ``rows`` (with a column text), written to the shared folder, and how often each id stands in rows that aren't held out."""
    spark = rows.sparkSession
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.binary()]
    names = ["kind", "doc_id", "hash", "held_out", "ids", "key", "data"]
    length = len(kept(path).width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = kept(path), np.zeros(length, np.int64)
        for batch in batches:
            for part in slices(batch, trims=False):
                ids, sizes = own.streams(part.column("text"))
                held, n = part.column("held_out").to_numpy(zero_copy_only=False), part.num_rows
                counts += np.bincount(ids[np.repeat(~held, sizes)], minlength=length)
                data, cuts = ids.astype(ids.dtype.newbyteorder("<")).tobytes(), (ids.itemsize * np.concatenate([[0], np.cumsum(sizes)])).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(["doc"] * n, pa.string()), part.column("doc_id").cast(pa.int64()), part.column("hash"), part.column("held_out"), pa.array([data[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        blocks.trim()
        keys, data = arrays.pieces(counts)
        yield pa.RecordBatch.from_arrays([pa.array(["count"] * len(keys), pa.string()), *(pa.nulls(len(keys), k) for k in kinds[1:5]), pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names)

    shared.text_batches(spark)
    where = shared.fresh(spark, "subwords")
    rows.select("doc_id", "hash", "held_out", "text").mapInArrow(run, _ENCODED).write.option("compression", "zstd").parquet(where)
    every = spark.read.schema(_ENCODED).parquet(where)
    return every.where("kind = 'doc'").select("doc_id", "hash", "held_out", "ids"), arrays.total(every.where("kind = 'count'"), length)


def _ids(part: pa.RecordBatch, kind) -> tuple[np.ndarray, np.ndarray]:
    raw, off = blocks.utf8(part.column("ids"))
    return np.frombuffer(raw.tobytes(), np.dtype(kind).newbyteorder("<")), np.diff(off) // np.dtype(kind).itemsize


def id_words(path: str):
    """For unigram_scores: hash and row of every word in a batch with ids, which are as different as the words they spell."""

    def words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        own = kept(path)
        ids, sizes = _ids(part, own.kind)
        start = np.flatnonzero(np.take(own.opens, ids))
        end = np.append(start[1:], len(ids))[: len(start)]
        hashes = blocks.segment_hashes(ids.view(np.uint8), ids.itemsize * start, ids.itemsize * end)
        counts = np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)])))
        return hashes, np.repeat(np.arange(len(sizes)), counts)

    return words


def fit(encoded: DataFrame, documents: int, subwords: Subwords, rounds: int = ROUNDS) -> Attention:
    """A model of the rows doc_id, hash, ids of ``encoded`` (``documents`` of them): every row is learned from once, by one trainer in one round. What reaches the driver is one model a round."""
    context = encoded.sparkSession.sparkContext
    trainers = max(1, -(-documents // CORPUS_ROWS))
    dealt = encoded.select("ids", F.xxhash64("doc_id", "hash", F.monotonically_increasing_id()).alias("deal"))  # by row: copies go to different trainers
    model, learned, known = Attention.fresh(), 0, context.broadcast(subwords)
    size = len(model.flat())
    kind = np.uint16 if len(subwords.size) <= 1 << 16 else np.uint32
    for turn in range(rounds):
        now = context.broadcast(model.flat())

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            own = Trainer(Attention.unflat(now.value.copy()), documents / (trainers * rounds), turn, fresh=not turn)
            for batch in batches:
                for part in slices(batch, "ids", trims=False):
                    own.add(*known.value.streams(*_ids(part, kind)))
            own.flush()
            blocks.trim()
            numbers = np.concatenate([np.rint(own.flat.astype(np.float64) * own.subwords * _POINT / 4096), [own.subwords]]).astype(np.int64)
            keys, data = arrays.pieces(numbers)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], ["key", "data"])

        part = dealt.where(F.pmod("deal", F.lit(rounds)) == turn).repartition(trainers, "deal").select("ids")
        sums = arrays.total(part.mapInArrow(run, "key int, data binary"), size + 1)
        if sums[-1]:
            model = Attention.unflat((sums[:-1] * (4096 / _POINT) / sums[-1]).astype(np.float32))
            learned += int(sums[-1])
    model.learned = learned
    return model


def score(encoded: DataFrame, model: Attention, subwords: Subwords) -> DataFrame:
    """``encoded`` without its ids, with score: log10 probability of each text, its end included."""
    context = encoded.sparkSession.sparkContext
    flat, known = context.broadcast(model.flat()), context.broadcast(subwords)
    others = [f for f in encoded.schema if f.name not in ("ids", "score")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "score double"])
    kind = np.uint16 if len(subwords.size) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Attention.unflat(flat.value)
        for batch in batches:
            for part in slices(batch, "ids", trims=False):
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in others), pa.array(own.score(*known.value.streams(*_ids(part, kind))))], [*(f.name for f in others), "score"])
        blocks.trim()

    return encoded.mapInArrow(run, schema)


def score_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of doc_id, text.

    Rows with crc32(doc_id as text) mod 5 = 1 are held out, all others train; a null doc_id trains. Null texts are
    empty: their end alone is scored. Repeated rows are scored alike. Other columns are ignored.
    """
    path = path or default_vocabulary()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), held.alias("held_out"))
    encoded, counts = encode(rows, path)
    base, totals = unigram_scores(encoded.withColumn("train", ~F.col("held_out")), "ids", id_words(path))
    subwords = Subwords(path, counts)
    model = fit(encoded.where(~F.col("held_out")), totals["documents"], subwords)
    scored = score(encoded, model, subwords)
    one = base.groupBy("doc_id", "hash").agg(F.first("n_tokens").alias("n_tokens"), F.first("n_known").alias("n_known"), F.first("base_score").alias("base_score"))
    met = scored.alias("s").join(one.alias("b"), F.col("s.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("s.hash") == F.col("b.hash")))
    return met.select("s.doc_id", "held_out", "n_tokens", "n_known", F.lit(totals["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by unigrams and by the attention model (null texts: their end; repeated rows alike)."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
