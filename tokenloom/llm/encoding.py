"""Token ids of many whole texts by the tokenizers library, each distinct chunk encoded once for each batch and kept for later ones."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from ._bytes import SpanHash, runs, utf8

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(9, 14)]] = True
#: And the first bytes of all other white space in UTF-8.
MAYBE_WHITE = WHITE.copy()
MAYBE_WHITE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """For tokenizers whose tokens hold ASCII white space never or only in front.

    A text is cut where no token can cross: with ``drops_space`` at all ASCII white space, which such tokenizers lose;
    else before a space or line feed that follows no ASCII white space and precedes none of any kind, as only the token that follows can hold it.
    Equal chunks give equal ids, so each is encoded once (is_pretokenized keeps chunks apart). Chunks are told apart by
    two 64-bit hashes; should the first ever collide, that batch's texts are encoded whole.
    """

    def __init__(self, path: str, drops_space: bool, keep: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.drops_space, self.keep = Tokenizer.from_file(path), drops_space, keep
        self._clear()

    def _clear(self) -> None:
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _chunks(self, buf: np.ndarray, off: np.ndarray):
        white = WHITE[buf]
        if self.drops_space:
            return runs(~white, off)
        n = len(buf)
        cut = np.zeros(n + 1, bool)
        if n > 2:
            cut[1 : n - 1] = ((buf[1:-1] == 0x20) | (buf[1:-1] == 0x0A)) & ~white[:-2] & ~MAYBE_WHITE[buf[2:]]
            inner = off[(off > 0) & (off < n)]
            cut[inner - 1] = False  # the last byte of a text stands before no other
        cut[off] = True
        cut[n] = False
        start = np.flatnonzero(cut)
        return start, np.r_[start[1:], n][: len(start)], np.searchsorted(start, off)

    def _learn(self, hashes, checks, words: list[str]) -> None:
        if len(self.hash) + len(words) > self.keep:
            self._clear()
        counts, ids = [], []
        for i in range(0, len(words), 2000):
            slab = words[i : i + 2000]
            done = self.tokenizer.encode(slab, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(done.ids, np.int32))
            counts.append(np.bincount(np.array([w for w in done.word_ids if w is not None], np.int64), minlength=len(slab)))
        count = np.concatenate(counts)
        start = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, *ids])
        order = np.argsort(all_ := np.r_[self.hash, hashes])
        self.hash, self.check = all_[order], np.r_[self.check, checks][order]
        self.start, self.count = np.r_[self.start, start][order], np.r_[self.count, count][order]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of each text; null counts as empty."""
        buf, off = utf8(column)
        start, end, first = self._chunks(buf, off)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        h, check = SpanHash(buf)(start, end), SpanHash(buf, 23)(start, end)
        unique, at, back = np.unique(h, return_index=True, return_inverse=True)
        known = np.minimum(np.searchsorted(self.hash, unique), max(0, len(self.hash) - 1))
        new = self.hash[known] != unique if len(self.hash) else np.ones(len(unique), bool)
        if new.any():
            if len(self.hash) + int(new.sum()) > self.keep:
                new[:] = True
            data = buf.tobytes()
            words = [data[a:z].decode() for a, z in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)]
            self._learn(unique[new], check[at[new]], words)
            known = np.searchsorted(self.hash, unique)
        where = known[back]
        if (self.check[where] != check).any():
            return self._whole(column)
        count = self.count[where]
        ends = np.cumsum(count)
        ids = self.ids[np.arange(int(ends[-1])) + np.repeat(self.start[where] - ends + count, count)]
        return ids, np.r_[0, ends][first]

    def _whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        done = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]
        return np.concatenate([np.array(x, np.int32) for x in done]), np.cumsum([0, *map(len, done)])


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drops_space: bool) -> Encoder:
    """One for each Python worker."""
    key = (path, drops_space)
    if key not in _encoders:
        _encoders[key] = Encoder(path, drops_space)
    return _encoders[key]


def with_end(ids: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an id after each text's."""
    out = np.full(len(ids) + len(off) - 1, end_id, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(off) - 1), np.diff(off))] = ids
    return out, off + np.arange(len(off))
