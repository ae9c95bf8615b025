"""Encoding whole batches of texts: their pieces are found, told apart and looked up as arrays.

A piece of at most 15 bytes is its own key of two integers, so equal keys are equal pieces.
Pieces met for the first time are merged as in ``merging``; what they became is kept in arrays.
"""

from __future__ import annotations

import numpy as np

from packetscope.llm.merging import REMEMBERED, Encoder, Remembered, lone_spaces
from packetscope.llm.shingles import mixed

# pieces kept between batches (about 60 bytes each), longest that are, and bytes of a key
KEPT, LONGEST_KEY, _KEY = 1 << 19, 15, 16
# bytes of text that are arrays at one time, and pieces kept as objects besides
AT_ONCE, PIECES = 1 << 21, 1 << 14
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LETTERS = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
# what stands before a piece, or that the first half of the key is only its number in the batch
_NEWLINE, _SPACE, _NUMBER = (np.uint64(n << 56) for n in (1, 2, 3))


class BatchEncoder(Encoder):
    """Encodes as ``Encoder`` does; made once per process."""

    _made: dict[str, BatchEncoder] = {}

    def __init__(self, file: str):
        super().__init__(file, PIECES)
        self.words = Remembered(REMEMBERED // 4)
        # one more than the id of each mark
        self.mark_ids = np.zeros(256, np.int64)
        for mark, ids in self.marks.items():
            self.mark_ids[ord(mark)] = int.from_bytes(ids, "little") + 1
        self._keep(*[np.zeros(0, np.uint64)] * 3, *[np.zeros(0, np.int64)] * 2, np.zeros(0, "<u4"))

    def _keep(self, hashes, low, high, starts, sizes, pool) -> None:
        """Sorted hashes of pieces with their keys, and where their ids lie in ``pool``."""
        self.hashes, self.low, self.high = hashes, low, high
        self.starts, self.sizes, self.pool = starts, sizes, pool

    def _plain(self, text: str) -> bool:
        """Whether lone spaces and newlines cut a text and nothing in it needs another way."""
        return (
            bool(text) and "\0" not in text and lone_spaces(text) and self.assigned(text)
            and (self.special is None or self.special.search(text) is None)
        )

    def _encode(self, texts: list[str]) -> list[bytes]:
        plain = [self._plain(text) for text in texts]
        others = iter(super()._encode([t for t, p in zip(texts, plain) if not p]))
        found = iter(self._encode_plain([t for t, p in zip(texts, plain) if p]))
        return [next(found if p else others) for p in plain]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        # each text as if a newline stood before it
        encoded = [b"\n" + text.encode() for text in texts]
        raw = b"".join(encoded) + b"\n" + bytes(_KEY)
        size = len(raw) - _KEY
        letters = np.frombuffer(raw, np.uint8, size)
        cuts = np.flatnonzero((letters == 32) | (letters == 10))
        begin, length, led = cuts[:-1] + 1, np.diff(cuts) - 1, letters[cuts[:-1]] == 10
        # a mark after a letter is a pre-token of its own, so words with and without it are one piece
        last = cuts[1:] - 1
        marked = np.flatnonzero((self.mark_ids[letters[last]] > 0) & _LETTERS[letters[last - 1]] & (length > 1))
        length[marked] -= 1
        eight = np.ndarray(size + _KEY // 2 + 1, "<u8", raw, strides=(1,))
        low = eight[begin] & _MASKS[np.minimum(length, 8)]
        high = eight[begin + 8] & _MASKS[np.clip(length - 8, 0, 7)]
        high |= np.where(led, _NEWLINE, _SPACE)
        numbers: dict[bytes, int] = {}
        for i in np.flatnonzero(length > LONGEST_KEY).tolist():
            at = begin[i]
            low[i] = numbers.setdefault(raw[at - 1 : at + length[i]], len(numbers))
            high[i] = _NUMBER
        hashes = mixed(mixed(low) + high)
        hashes, first, piece = np.unique(hashes, return_index=True, return_inverse=True)
        if (low[first][piece] != low).any() or (high[first][piece] != high).any():
            return super()._encode(texts)  # two pieces of one hash, which hardly ever happens
        low, high = low[first], high[first]
        starts, sizes, pool, new = self._looked_up(raw, begin, length, led, first, hashes, low, high)
        of_piece = sizes[piece]
        of_piece[marked] += 1
        ends = np.cumsum(of_piece)
        places = np.repeat(starts[piece] - ends + of_piece, of_piece) + np.arange(ends[-1])
        marks = ends[marked] - 1
        places[marks] = 0
        ids = pool[places]
        ids[marks] = self.mark_ids[letters[last[marked]]] - 1
        bounds = np.searchsorted(cuts, np.cumsum([0, *map(len, encoded)]))
        bounds = np.append(0, ends)[bounds]
        self._remember(hashes, low, high, starts, sizes, pool, new)
        skip = len(self.newline) // 4
        return [ids[a + skip : b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def _looked_up(self, raw, begin, length, led, first, hashes, low, high):
        """Where the ids of each distinct piece start in a pool, how many they are, and which are new."""
        starts, sizes = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        known = np.zeros(len(first), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = (self.hashes[at] == hashes) & (self.low[at] == low) & (self.high[at] == high)
            starts[known], sizes[known] = self.starts[at[known]], self.sizes[at[known]]
        new = np.flatnonzero(~known)
        place = first[new]
        from_, to = begin[place] - led[place], begin[place] + length[place]
        pieces = [raw[a:b].decode() for a, b in zip(from_.tolist(), to.tolist())]
        long = self._learn(set(pieces))
        ids = list(map(self.pieces.now.__getitem__, pieces))
        self.pieces.turn(long)
        sizes[new] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts[new] = len(self.pool) + np.cumsum(sizes[new]) - sizes[new]
        return starts, sizes, np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")]), new

    def _remember(self, hashes, low, high, starts, sizes, pool, new) -> None:
        """Keep the new pieces as well, or only this batch's when they are too many."""
        if len(self.hashes) + len(new) > KEPT:
            self._keep(*(x[:0] for x in (hashes, low, high, starts, sizes)), pool[:0])
            new = np.arange(len(hashes))
            places = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            pool, starts = pool[places], np.cumsum(sizes) - sizes
        new = new[high[new] != _NUMBER]
        columns = zip((self.hashes, self.low, self.high, self.starts, self.sizes), (hashes, low, high, starts, sizes))
        joined = [np.concatenate([kept, more[new]]) for kept, more in columns]
        order = np.argsort(joined[0], kind="stable")
        self._keep(*(x[order] for x in joined), pool)

    def forget(self) -> None:
        super().forget()
        self._keep(*(x[:0] for x in (self.hashes, self.low, self.high, self.starts, self.sizes)), self.pool[:0].copy())
