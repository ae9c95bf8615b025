"""A word list as a minimal acyclic transducer: byte strings in, sequences of ids out.

Words that end alike share their last states. Each edge carries how many words sort
before it, so the sum along a word's path is the word's number, and the number points to
its ids. The whole thing is a few integer arrays in one file, which workers map into
memory; many words are walked at the same time, one byte position after the other.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Sequence

import numpy as np

_ARRAYS = 5  # edge keys, edge targets, edge outputs, id offsets, ids


class _State:
    __slots__ = ("edges", "final", "number", "below")

    def __init__(self):
        self.edges: list[list] = []  # [byte, state], in byte order
        self.final = False
        self.number = -1
        self.below = 0

    def key(self):
        return self.final, tuple((b, s.number) for b, s in self.edges)


def _minimal(words: Sequence[bytes]) -> list[_State]:
    """States of the smallest automaton for sorted, distinct words; the last is the start."""
    known: dict = {}
    states: list[_State] = []

    def settle(state: _State) -> _State:
        found = known.get(key := state.key())
        if found is None:
            known[key] = found = state
            state.number = len(states)
            state.below = state.final + sum(s.below for _, s in state.edges)
            states.append(state)
        return found

    path = [_State()]  # states along the word before
    before = b""
    for word in words:
        common = len(os.path.commonprefix([before, word]))
        for depth in range(len(before), common, -1):
            path[depth - 1].edges[-1][1] = settle(path.pop())
        for byte in word[common:]:
            state = _State()
            path[-1].edges.append([byte, state])
            path.append(state)
        path[-1].final = True
        before = word
    for depth in range(len(before), 0, -1):
        path[depth - 1].edges[-1][1] = settle(path.pop())
    root = path[0]
    root.number, root.below = len(states), root.final + sum(s.below for _, s in root.edges)
    states.append(root)
    return states


def compile_lexicon(entries: dict[bytes, Sequence[int]]) -> bytes:
    """The lexicon as the contents of a file. Empty words are left out."""
    words = sorted(w for w in entries if w)
    states = _minimal(words)
    keys, targets, outputs = [], [], []
    for state in states:
        passed = int(state.final)
        for byte, target in state.edges:
            keys.append(state.number * 256 + byte)
            # the lowest bit of a target says whether a word ends there
            targets.append(target.number * 2 + target.final)
            outputs.append(passed)
            passed += target.below
    ids = [entries[w] for w in words]
    offsets = np.cumsum([0, *map(len, ids)])
    arrays = [keys, targets, outputs, offsets, [i for one in ids for i in one]]
    arrays = [np.asarray(a, dtype="<i8") for a in arrays]
    head = np.asarray([len(states) - 1, max(map(len, words), default=0), *map(len, arrays)], "<i8")
    return b"".join(a.tobytes() for a in (head, *arrays))


def mapped(data: bytes) -> mmap.mmap:
    """The file's bytes, memory-mapped. The file has no name, so nothing is left behind."""
    with tempfile.TemporaryFile() as file:
        file.write(data)
        file.flush()
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)


class Lexicon:
    """Reads a compiled lexicon."""

    def __init__(self, data: bytes | mmap.mmap):
        head = np.frombuffer(data, "<i8", 2 + _ARRAYS)
        self.start, self.longest = int(head[0]), int(head[1])
        at, arrays = head.nbytes, []
        for size in head[2:]:
            arrays.append(np.frombuffer(data, "<i8", int(size), at))
            at += int(size) * 8
        self.keys, self.targets, self.outputs, self.offsets, self.ids = arrays

    def number(self, words: Sequence[bytes]) -> np.ndarray:
        """For each word its place among the sorted words, or -1."""
        found = np.full(len(words), -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        rows = np.flatnonzero((lengths > 0) & (lengths <= self.longest))
        if not len(rows) or not len(self.keys):
            return found
        wide = int(lengths[rows].max())
        joined = b"".join(words[i].ljust(wide, b"\0") for i in rows)
        letters = np.frombuffer(joined, np.uint8).reshape(len(rows), wide)
        state = np.full(len(rows), self.start, np.int64)
        total = np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        for place in range(wide):
            key = state[live] * 256 + letters[live, place]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[edge] == key
            live, edge = live[ok], edge[ok]
            total[live] += self.outputs[edge]
            state[live] = self.targets[edge] >> 1
            done = lengths[rows[live]] == place + 1
            ends = live[done & (self.targets[edge] & 1 == 1)]
            found[rows[ends]] = total[ends]
            live = live[~done]
        return found

    def lookup(self, words: Sequence[bytes]) -> list[np.ndarray | None]:
        """For each word its ids, or None."""
        return [
            None if n < 0 else self.ids[self.offsets[n] : self.offsets[n + 1]]
            for n in self.number(words).tolist()
        ]
