"""Byte-pair encoding of many words at a time, and of texts through caches of their pieces.

Words met for the first time are merged together: one numpy step applies to each of them the
merge that is its own next one. Everything else is looked up piece by piece.
"""

from __future__ import annotations

import gc
import hashlib
import re
from itertools import compress
from operator import not_

import numpy as np
import public_tokenizers
import regex

from packetscope.llm.bpe import Vocabulary
from packetscope.llm.unicode import Assigned

# pieces of one generation that a worker remembers, longest of them, longest word that is merged with the others
REMEMBERED, SHORT, LONGEST = 1 << 17, 64, 48
# marks that are a pre-token of their own after letters; an apostrophe may begin a contraction
_MARKS = frozenset(".,;:!?")
_NONE = np.int32(1 << 30)
# white space that is more than a lone space or newline between two others; the ASCII part of the others
_DOUBLE, _OTHERS = ("  ", "\n\n", " \n", "\n "), tuple("\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_OTHER_SPACE = re.compile(r"[^\S \n]")


def lone_spaces(text: str) -> bool:
    """Whether all white space of a text is single spaces and newlines between two others."""
    if text[0] in " \n" or text[-1] in " \n" or any(d in text for d in _DOUBLE):
        return False
    if text.isascii():
        return not any(o in text for o in _OTHERS)
    return _OTHER_SPACE.search(text) is None


class Merger:
    """Exact merging of words by the ranks of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.first = np.array(vocabulary.first, np.int32)
        codes = np.array([(a << 32) | b for a, b in vocabulary.ranks], np.int64)
        found = np.array(list(vocabulary.ranks.values()), np.int32).reshape(-1, 2)
        order = np.argsort(codes)
        self.codes, self.rank, self.merged = codes[order], found[order, 0], found[order, 1]
        # the first look at a word needs pairs of bytes only
        left, right = np.repeat(self.first, 256), np.tile(self.first, 256)
        self.byte_ranks, self.byte_merged = self._ranks(left, right)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or a huge number) and merged id of each pair."""
        if not len(self.codes):
            return np.full(len(left), _NONE), np.zeros(len(left), np.int32)
        codes = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        return np.where(known, self.rank[at], _NONE), self.merged[at]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian uint32; no word may be empty.

        In each step every word with a mergeable pair merges its leftmost pair of lowest
        rank. Ranks are kept per place, so a step looks up two pairs a word.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        if not words:
            return []
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids, pairs = self.first[raw], raw[:-1].astype(np.int64) << 8 | raw[1:]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        out: list[bytes] = [b""] * len(words)
        rank, new = self.byte_ranks[pairs], self.byte_merged[pairs]
        rank, new = np.append(rank, _NONE), np.append(new, _NONE)
        rank[np.flatnonzero(np.diff(word))] = _NONE  # a word's last place has no pair
        while len(ids):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            sizes = np.diff(starts, append=len(ids))
            best = np.minimum.reduceat(rank, starts)
            done = best == _NONE
            if done.any():
                finished = np.repeat(done, sizes)
                raw, at = ids[finished].astype("<u4").tobytes(), 0
                for number, size in zip(word[starts[done]].tolist(), (4 * sizes[done]).tolist()):
                    out[number] = raw[at : at + size]
                    at += size
                ids, word, rank, new = (x[~finished] for x in (ids, word, rank, new))
                best, sizes = best[~done], sizes[~done]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            places = hits[np.diff(word[hits], prepend=-1) != 0]
            ids[places] = new[places]
            rank[places] = rank[places + 1]
            keep = np.ones(len(ids), bool)
            keep[places + 1] = False
            places = places - np.arange(len(places))  # where they stand once the others are gone
            last = np.append(np.diff(word[keep]) != 0, True)
            ids, word, rank, new = (x[keep] for x in (ids, word, rank, new))
            for at in (places, places[places > 0] - 1):
                at = at[~last[at]]
                rank[at], new[at] = self._ranks(ids[at], ids[at + 1])
            rank[last] = _NONE
        return out


class Remembered:
    """Ids of the pieces met last, in two generations.

    When the younger one is full, it becomes the older one, which is forgotten as a whole; what
    is met again meanwhile moves to the younger one, so frequent pieces always stay.
    """

    def __init__(self, most: int):
        self.most = most
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, pieces: set[str]) -> set[str]:
        """The pieces of which nothing is known; the others are at hand in ``now``."""
        new, old = pieces.difference(self.now), self.old
        known = list(filter(old.__contains__, new))
        self.now.update(zip(known, map(old.__getitem__, known)))
        new.difference_update(known)
        return new

    def turn(self, long: set[str]) -> None:
        """After a batch: let long pieces go, and start anew when there are too many."""
        for piece in long:
            self.now.pop(piece, None)
        if len(self.now) > self.most:
            self.old, self.now = self.now, {}

    def clear(self) -> None:
        self.now, self.old = {}, {}


class Encoder:
    """Encodes texts on a worker exactly as the library does; made once per process."""

    _made: dict[str, Encoder] = {}

    def __init__(self, file: str, remembered: int | None = None):
        self.file, self.library = file, None
        self.vocabulary = Vocabulary.of(file)
        self.merger = Merger(self.vocabulary)
        self.pretokens = regex.compile(public_tokenizers.PATTERN).findall
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.assigned = Assigned()
        # pre-tokens; pieces without white space inside, after a space or with the newline before them
        most = REMEMBERED if remembered is None else remembered
        self.words, self.pieces = Remembered(most // 4), Remembered(most)
        self.newline, *marks = self._merge(["\n", *_MARKS])
        self.marks = dict(zip(_MARKS, marks))

    @classmethod
    def of(cls, file: str) -> Encoder:
        key = hashlib.sha256(file.encode()).hexdigest()
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(file)
        return cls._made[key]

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens, merged in one go unless they are very long."""
        raw = [w.encode() for w in words]
        long = [i for i, r in enumerate(raw) if len(r) > LONGEST]
        kept = {i: raw[i] for i in long}
        for i in long:
            raw[i] = b"x"
        ids = self.merger.merge_all(raw)
        for i, r in kept.items():
            ids[i] = np.asarray(self.vocabulary.merge(r), "<u4").tobytes()
        return ids

    def _learn_words(self, words: set[str]) -> set[str]:
        """Add pre-tokens to the cache; returns the long ones among the new."""
        new = list(self.words.missing(words))
        self.words.now.update(zip(new, self._merge(new)))
        return {w for w in new if len(w) > SHORT}

    def _learn(self, pieces: set[str]) -> set[str]:
        """Add pieces to the cache; letters alone are one pre-token, marks may follow them, others
        are cut first. Returns the long ones among the new."""
        new, cache = self.pieces.missing(pieces), self.pieces.now
        plain, led, marked, others = set(filter(str.isalpha, new)), [], [], []
        long = {p for p in new if len(p) > SHORT}
        new.difference_update(plain)
        for piece in new:
            letters = piece[1:] if piece[0] == "\n" else piece
            if letters.isalpha():
                led.append(piece)
            elif letters[-1] in _MARKS and letters[:-1].isalpha():
                marked.append((piece, piece[:-1], self.marks[piece[-1]]))
            else:
                others.append(piece)
        stems = self.pieces.missing({stem for _, stem, _ in marked}.difference(plain, led))
        led += [p for p in stems if p[0] == "\n"]
        stems.difference_update(led)
        long.update([p for p in stems if len(p) > SHORT], [p for p in led if len(p) > SHORT])
        spaced = [*plain, *stems]
        ids = self._merge([p[1:] for p in led] + [" " + p for p in spaced])
        cache.update(zip(led, [self.newline + i for i in ids[: len(led)]]))
        cache.update(zip(spaced, ids[len(led) :]))
        cache.update([(p, cache[stem] + mark) for p, stem, mark in marked])
        split = {p: self.pretokens(p[1:] if p[0] == "\n" else " " + p) for p in others}
        long_words = self._learn_words(set().union(*split.values()))
        words, before = self.words.now.__getitem__, {True: self.newline, False: b""}
        cache.update([(p, before[p[0] == "\n"] + b"".join(map(words, parts))) for p, parts in split.items()])
        self.words.turn(long_words)
        return long

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        gc.disable()  # a batch makes very many lists and no cycles
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        plans, pieces, loose = [], set(), set()
        known = self.pieces.now.get
        for text in texts:
            if not self.assigned(text):
                # letters newer than this Unicode table: the library decides how to cut them
                plans.append([np.asarray(self._library(text), "<u4").tobytes()])
                continue
            parts = [text]
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
            plan = []
            for part in parts:
                if self.special is not None and part in self.vocabulary.special:
                    plan.append(self.vocabulary.special[part].to_bytes(4, "little"))
                elif not part:
                    continue
                elif lone_spaces(part):
                    # a pre-token always begins before a lone space and around a lone newline
                    first, *cut = part.replace("\n", " \n").split(" ")
                    cut.insert(0, "\n" + first)
                    found = list(map(known, cut))
                    pieces.update(compress(cut, map(not_, found)))
                    plan.append((cut, found))
                else:
                    words = self.pretokens(part)
                    loose.update(words)
                    plan.append((words, None))
            plans.append(plan)
        long = self._learn(pieces)
        long_words = self._learn_words(loose)
        out = [b"".join(map(self._ids, plan)) for plan in plans]
        self.words.turn(long_words)
        self.pieces.turn(long)
        return out

    def _ids(self, part) -> bytes:
        if isinstance(part, bytes):
            return part
        cut, found = part
        if found is None:
            return b"".join(map(self.words.now.__getitem__, cut))
        # the first piece was taken as if a newline stood before it
        now = self.pieces.now
        return b"".join([ids or now[p] for p, ids in zip(cut, found)])[len(self.newline) :]

    def forget(self) -> None:
        """Let all remembered pieces go."""
        self.words.clear()
        self.pieces.clear()

    def _library(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.file)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library.encode(text, add_special_tokens=False).ids
