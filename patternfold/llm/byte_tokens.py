"""Whole documents to ids of a byte-level tokenizer file, quickly.

The tokenizer's own pattern never joins text across the last white-space character before a word, so a
document is cut there, each distinct piece is encoded once by the tokenizers library, and ids are
gathered by piece. Documents in which that cut could matter (white space beyond ASCII, or the text of an
added token) are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np

from patternfold.llm import blocks
from patternfold.llm.blocks import Growing, Remembered, mix, ragged

_U = np.uint64
JOINED = 2048
_KEPT: dict[str, "ByteTokenizer"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def kept(path: str) -> "ByteTokenizer":
    """One per worker process, so that its pieces serve later tasks as well."""
    if path not in _KEPT:
        _KEPT[path] = ByteTokenizer(path)
    return _KEPT[path]


class ByteTokenizer(Remembered):
    """encode(column) -> (ids, ids per row). At most MOST pieces are remembered."""

    MOST = 1_200_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)  # a character for each byte
        self.id_bytes = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 and max(self.tokenizer.get_vocab().values()) < 1 << 16 else 4
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        super()._reset()
        self.first, self.length, self.store, self.term = Growing(np.int64), Growing(np.int64), Growing(np.uint32), Growing(np.uint64)

    def _keep(self, numbers: np.ndarray) -> None:
        sizes, term = self.length.take(numbers), self.term.take(numbers)
        ids = self.store.take(ragged(self.first.take(numbers), sizes))
        self._reset()
        self._append(ids, sizes, term)

    def _append(self, ids: np.ndarray, sizes: np.ndarray, term: np.ndarray) -> None:
        self.first.add(self.store.n + np.cumsum(sizes) - sizes)
        self.store.add(ids), self.length.add(sizes), self.term.add(term)

    def _learn(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encodes new pieces. Those that begin with a space go to the library many at a time, one after the other:
        the space keeps them apart, and the bytes of their ids tell where each ends."""
        spaced = raw[start] == 32
        order, every, lengths, terms = [], [], [], []
        for group, step in ((np.flatnonzero(spaced), JOINED), (np.flatnonzero(~spaced), 1)):
            for i in range(0, len(group), 8 * JOINED):  # what the library returns is large
                some = group[i : i + 8 * JOINED]
                begin, size = start[some], end[some] - start[some]
                data = raw[ragged(begin, size)].tobytes()
                stop = np.cumsum(size)
                cuts = [0, *stop[step - 1 :: step].tolist()]
                if cuts[-1] < len(data):
                    cuts.append(len(data))
                found = self.tokenizer.encode_batch_fast([data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)
                ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
                ends = np.searchsorted(np.cumsum(self.width[ids]), stop) + 1
                order.append(some), every.append(ids), lengths.append(np.diff(ends, prepend=0)), terms.append(self._terms(np.frombuffer(data, np.uint8), stop - size, stop))
        order, ids, sizes, term = map(np.concatenate, (order, every, lengths, terms))
        back = np.argsort(order, kind="stable")
        self._append(ids[ragged((np.cumsum(sizes) - sizes)[back], sizes[back])], sizes[back], term[back])

    @staticmethod
    def _terms(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The lower-case word's hash of each piece; 0 where there is no word."""
        start = start + (raw[start] == 32)
        full = np.flatnonzero((end > start) & ~blocks.is_space(raw[np.minimum(start, len(raw) - 1)]))
        out = np.zeros(len(start), _U)
        out[full] = np.maximum(blocks.segment_hashes(raw, start[full], end[full], lower=True), 1)
        return out

    def _odd(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows that must be encoded whole."""
        lead = np.flatnonzero((raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3))
        hit: list[np.ndarray] = []
        if len(lead):
            pad = np.concatenate([raw, np.zeros(2, np.uint8)])
            a, b, c = raw[lead], pad[lead + 1], pad[lead + 2]
            space = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
            space |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
            space |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
            space |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
            space |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
            hit.append(lead[space])
        for token in self.added:
            at = np.flatnonzero(raw[: len(raw) - len(token) + 1] == token[0]) if len(raw) >= len(token) else np.zeros(0, np.int64)
            if len(at) and len(token) > 1:
                at = at[raw[at + 1] == token[1]]
            hit.append(at)  # its first two bytes are enough to be careful
        at = np.concatenate(hit)
        return np.unique(np.searchsorted(off, at, side="right") - 1)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and how many each has."""
        return self.encode_pieces(column)[:2]

    def encode_pieces(self, column):
        """encode(), and of the pieces in rows that aren't encoded whole: ids, term (hash of the lower-case word;
        0: white space) and row of each; and the rows encoded whole."""
        w = blocks.words(column)
        odd = self._odd(w.raw, w.off)
        hashes, start, end, counts = self._pieces(w)
        if len(odd):
            keep = ~np.isin(np.repeat(np.arange(len(counts)), counts), odd)
            hashes, start, end = hashes[keep], start[keep], end[keep]
            counts = counts.copy()
            counts[odd] = 0
        number = self.numbers(hashes, w.raw, start, end)
        lengths = self.length.take(number)
        ids = self.store.take(ragged(self.first.take(number), lengths))
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        sizes = np.diff(ends)
        if len(odd):
            text = w.raw.tobytes()
            whole = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([text[w.off[d] : w.off[d + 1]].decode("utf-8", "replace") for d in odd], add_special_tokens=False)]
            parts, last = [], 0
            for d, own in zip(odd, whole):
                parts += [ids[last : ends[d]], own]
                last = ends[d]
                sizes[d] = len(own)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, sizes, lengths, self.term.take(number), np.repeat(np.arange(len(counts)), counts), odd

    @staticmethod
    def _pieces(w: blocks.Words):
        """Hash, start, end of every piece in order of the text, and pieces per row.

        Before a word with white space of k characters: its first k - 1 are a piece; the last is joined to
        the word if it is a space, and is a piece of its own if not. White space at a row's end is a piece.
        """
        n, rows = len(w.start), len(w.off) - 1
        raw, bounds = w.raw, w.bounds
        before = np.empty(n, np.int64)
        if n:
            before[1:] = w.end[:-1]
        has = w.counts > 0
        before[bounds[:-1][has]] = w.off[:-1][has]
        gap = w.start - before
        glue = np.zeros(n, bool)
        some = gap > 0
        glue[some] = raw[w.start[some] - 1] == 32
        hashes = np.where(glue, mix(w.hash + _U(0x51ED270B)), w.hash)
        start = w.start - glue
        left = gap - glue  # white space that is not joined
        at, begin, end = [], [], []
        one = np.flatnonzero((left > 0) & ~glue)
        at.append(one), begin.append(w.start[one] - 1), end.append(w.start[one])
        two = np.flatnonzero(gap > 1)
        at.append(two), begin.append(before[two]), end.append(w.start[two] - 1)
        last = w.off[:-1].copy()
        last[has] = w.end[bounds[1:][has] - 1] if n else 0
        tail = np.flatnonzero(w.off[1:] > last)
        at.append(bounds[1:][tail]), begin.append(last[tail]), end.append(w.off[1:][tail])
        row = [np.searchsorted(w.off, b, side="right") - 1 for b in begin]
        at, begin, end, row = map(np.concatenate, (at, begin, end, row))
        counts = w.counts + np.bincount(row, minlength=rows)
        if len(at):
            order = np.argsort(begin, kind="stable")
            at, begin, end = at[order], begin[order], end[order]
            size = end - begin
            space = np.zeros(len(begin), _U)
            simple = size == 1
            space[simple] = mix(raw[begin[simple]].astype(_U) + _U(0xABCD0000))
            for k in np.flatnonzero(~simple).tolist():
                space[k] = int.from_bytes(__import__("hashlib").blake2b(raw[begin[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
            where = np.lexsort((begin, at))
            at, begin, end, space = at[where], begin[where], end[where], space[where]
            hashes, start, stop = np.insert(hashes, at, space), np.insert(start, at, begin), np.insert(w.end, at, end)
        else:
            stop = w.end
        return hashes, start, stop, counts
