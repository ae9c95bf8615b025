"""Hashed word shingles of many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

# words in a shingle
WORDS = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Turns lists of words into shingle hashes; keeps the hashes of words it met."""

    KEPT = 1 << 19

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def _hashes(self, texts: list[list[bytes]]) -> np.ndarray:
        known, hashed = self.known, xxhash.xxh64_intdigest
        if len(known) > self.KEPT:
            known.clear()
        for words in texts:
            for word in words:
                if word not in known:
                    known[word] = hashed(word)
        return np.fromiter((known[w] for words in texts for w in words), np.uint64)

    def __call__(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of all texts, and the number of the text each belongs to.

        A text of fewer words than a shingle, but not none, is one shingle. Shingles come
        in the order of the text and repeat as they do there.
        """
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = self._hashes(texts)
        text = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        value = np.zeros(len(flat), np.uint64)
        for step in range(self.words):
            after = np.zeros(len(flat), np.uint64)
            after[: len(flat) - step] = flat[step:] if step else flat
            # words beyond the end of a short text do not count
            after[place + step >= sizes[text]] = 0
            value = mixed(value * _ODD + after + np.uint64(step + 1))
        starts = place <= np.maximum(sizes[text] - self.words, 0)
        return value[starts], text[starts]


def counted(values: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by text and value, their texts, and how often each occurs."""
    order = np.lexsort((values, texts))
    values, texts = values[order], texts[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (texts[1:] != texts[:-1])
    at = np.flatnonzero(new)
    return values[at], texts[at], np.diff(np.append(at, len(values)))


def bands_of(signature: np.ndarray, rows: int) -> np.ndarray:
    """One integer per text and band of ``rows`` components."""
    n, size = signature.shape
    out = np.zeros((n, size // rows), np.uint64)
    for row in range(rows):
        out = mixed(out * _ODD + signature[:, row::rows])
    return mixed(out + np.arange(out.shape[1], dtype=np.uint64) * _ODD).astype(np.int64)


def tuned(similarity: float, recall: float = 0.9995, most: int = 100) -> tuple[int, int]:
    """Bands and rows per band: the longest bands that still find a pair of this similarity
    with the wanted probability, within ``most`` components."""
    best = (1, 1)
    for rows in range(1, 9):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best
