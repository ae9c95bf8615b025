"""Words and paragraphs of many texts at once, as arrays of places in their bytes.

What a text is cut into is found by comparing neighbouring bytes of a whole batch, never
text by text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash

from packetscope.llm.common import _LOWER_WORDS
from packetscope.llm.shingles import mixed

# bytes of text that are arrays at one time
AT_ONCE = 1 << 20
# words of more bytes are hashed one by one
LONG_WORD = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPACES = np.array([b < 128 and chr(b).isspace() for b in range(256)])
_MARKS = np.array([b in b".!?" for b in range(256)])
# white space beyond ASCII by its bytes: two of them, or three
_WIDE = [c for c in map(chr, range(128, 1 << 16)) if c.isspace()]
_CODES = np.array(sorted(int.from_bytes(c.encode().ljust(3, b"\0")) for c in _WIDE), np.int64)
_LEADS = np.zeros(256, np.int64)
for _c in _WIDE:
    _LEADS[_c.encode()[0]] = len(_c.encode())


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin and end; the first and the last place are outside."""
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edges[::2], edges[1::2]


class Texts:
    """The bytes of some texts with a line's end after each, and what lies in them."""

    def __init__(self, column: pa.Array):
        texts = column.cast(pa.large_binary()).to_pylist()
        self.raw = b"\n".join([b"", *texts, b" " * 8])
        self.letters = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = 1 + np.cumsum(sizes + 1) - sizes - 1
        self.lower = self.raw.translate(_LOWER_WORDS)
        self._points = None

    def words(self, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end, of all letters or of those ``inside``."""
        letters = np.frombuffer(self.lower, np.uint8) != 32
        return _runs(letters if inside is None else letters & inside)

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each word in lower case."""
        eight = np.ndarray(len(self.lower) - 7, "<u8", self.lower, strides=(1,))
        size = end - begin
        value = mixed((eight[begin] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * _ODD)
        for step in range(8, LONG_WORD, 8):
            more = np.flatnonzero(size > step)
            if not len(more):
                return value
            part = eight[begin[more] + step] & _MASKS[np.minimum(size[more] - step, 8)]
            value[more] = mixed(value[more] * _ODD + part)
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            value[i] = xxhash.xxh64_intdigest(self.lower[begin[i] : end[i]])
        return value

    def _wide_spaces(self) -> np.ndarray:
        """Bytes of white space beyond ASCII."""
        if self.raw.isascii():
            return np.zeros(0, np.int64)
        at = np.flatnonzero(_LEADS[self.letters])
        size, letters = _LEADS[self.letters[at]], self.letters.astype(np.int64)
        codes = letters[at] << 16 | letters[at + 1] << 8 | np.where(size == 3, letters[at + 2], 0)
        found = np.isin(codes, _CODES)
        at, size = at[found], size[found]
        return np.concatenate([at, at + 1, at[size == 3] + 2])

    def paragraphs(self, cut: int):
        """Text, place, begin and end of each paragraph, and which bytes lie in one (None: all words do)."""
        space, wide = _SPACES[self.letters], self._wide_spaces()
        space[wide] = True
        begin, end = _runs(~space)
        if not len(begin):
            return *[np.zeros(0, np.int64)] * 4, np.zeros(len(self.letters), bool)
        # the last piece between white space of every line, and what else ends a sentence
        breaks = np.searchsorted(end, np.flatnonzero(self.letters == 10), "right") - 1
        line = np.zeros(len(begin), bool)
        line[breaks[breaks >= 0]] = True
        ends = np.flatnonzero(line | _MARKS[self.letters[end - 1]])
        chosen = line[ends]
        inner = np.flatnonzero(~chosen)
        order = np.full(len(ends), 1 << 32, np.int64)
        spans = zip(begin[ends[inner]].tolist(), end[ends[inner]].tolist())
        order[inner] = [zlib.crc32(self.raw[a:b]) for a, b in spans]
        if len(ends) >= cut:
            windows = np.lib.stride_tricks.sliding_window_view(order, cut)
            last = np.cumsum(np.append(0, chosen))
            within = np.flatnonzero(last[cut:] == last[:-cut])
            chosen[within + windows[within].argmin(axis=1)] = True
        stops = ends[chosen]
        begin, end = begin[np.append(0, stops[:-1] + 1)], end[stops]
        owner = np.searchsorted(self.begins, begin, "right") - 1
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        inside = None
        if len(wide):  # letters of words elsewhere, not between paragraphs
            change = np.zeros(len(self.letters), np.int8)
            change[begin] = 1
            change[end] = -1
            inside = np.cumsum(change, dtype=np.int8) == 1
        return owner, place, begin, end, inside

    def points(self, places: np.ndarray) -> np.ndarray:
        """Code points before these places in all texts."""
        if self._points is None:
            self._points = np.append(0, np.cumsum((self.letters & 0xC0) != 0x80, dtype=np.int64))
        return self._points[places]


def run_hashes(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash of every ``words`` neighbours."""
    value, done, power, size = None, 0, hashes, 1
    rest = words
    while True:
        if rest & 1:
            if value is None:
                value = power
            else:
                most = max(0, len(hashes) - done - size + 1)
                value = mixed(value[:most] * _ODD + power[done : done + most])
            done += size
        rest >>= 1
        if not rest:
            return value
        most = max(0, len(power) - size)
        power = mixed(power[:most] * _ODD + power[size : size + most])
        size *= 2


def shingled(hashes: np.ndarray, sizes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of groups of words one after the other, and how many each group has.

    A group of fewer words than a shingle, but not none, is one shingle.
    """
    counts = np.where(sizes > 0, np.maximum(sizes - words, 0) + 1, 0)
    starts, first = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
    at = np.repeat(starts - first, counts) + np.arange(counts.sum())
    whole = run_hashes(hashes, words)
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    if not len(short):
        return whole[at], counts
    values = np.append(whole, np.zeros(words, np.uint64))[at]
    for size in np.unique(sizes[short]).tolist():
        of = short[sizes[short] == size]
        values[first[of]] = run_hashes(hashes, size)[starts[of]]
    return values, counts
