"""Byte-pair vocabulary of a tokenizer file, exact merging of one word, frequent chunks."""

from __future__ import annotations

import heapq
import json
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetscope.llm.common import giving_back, slices

# most chunks a task keeps while it counts, and most it hands on
KEPT_CHUNKS, SENT_CHUNKS = 1 << 20, 1 << 16


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Bytes that print stand for themselves, the others take the letters from 256 on.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """What encoding and decoding need of a byte-level BPE file."""

    first: list[int]  # id of each byte
    ranks: dict[tuple[int, int], tuple[int, int]]  # pair of ids -> (rank, merged id)
    tokens: list[bytes]  # bytes of each id
    special: dict[str, int]

    @classmethod
    def of(cls, text: str) -> Vocabulary:
        file = json.loads(text)
        model, letters = file["model"], byte_letters()
        if model["type"] != "BPE" or model.get("end_of_word_suffix") or file["normalizer"]:
            raise ValueError("only plain byte-level BPE files are read here")
        vocab, back = model["vocab"], {c: b for b, c in enumerate(letters)}
        ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        added = file["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with matching options are not supported")
        tokens = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in added)]))
        for token, number in vocab.items():
            tokens[number] = bytes(back[c] for c in token)
        for token in added:
            tokens[token["id"]] = token["content"].encode()
        special = {t["content"]: t["id"] for t in added}
        return cls([vocab[c] for c in letters], ranks, tokens, special)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: again and again the pair of lowest rank, leftmost first."""
        ids = [self.first[b] for b in word]
        return self._merge_short(ids) if len(ids) <= 48 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, none = self.ranks.get, (1 << 60, -1)
        pairs = [get(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            at = pairs.index(best)
            ids[at : at + 2] = [best[1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get((ids[at - 1], ids[at]), none)
            if at < len(pairs):
                pairs[at] = get((ids[at], ids[at + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same over a linked list with a heap, for words of any length."""
        n, ranks = len(ids), self.ranks
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*ranks[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (found := ranks.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (found[0], x, found[1], ids[x], ids[y]))
        return [x for x in ids if x >= 0]


def frequent_chunks(texts: DataFrame, size: int, lower: bool = False) -> dict[str, int]:
    """The most frequent pieces between white space, with counts over all texts.

    Every task counts all of its texts and hands on its most frequent pieces; their sums
    choose at most ``size``. Only the choice of what to keep at hand rests on it, never a
    result, so what a task leaves out costs time at most.
    """

    def count(batches):
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update((text.lower() if lower else text).split())
            if len(seen) > KEPT_CHUNKS:
                seen = Counter(dict(seen.most_common(KEPT_CHUNKS // 4)))
        top = [(c, n) for c, n in seen.most_common(SENT_CHUNKS) if len(c) <= 64]
        for at in range(0, len(top), 8192):
            part = top[at : at + 8192]
            yield pa.RecordBatch.from_pydict(
                {"chunk": [c for c, _ in part], "n": [n for _, n in part]},
                schema=pa.schema([("chunk", pa.string()), ("n", pa.int64())]),
            )

    counted = texts.select("text").mapInArrow(giving_back(count), "chunk string, n long")
    sums = counted.groupBy("chunk").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.desc("n"), "chunk").limit(size).collect()
    return {r["chunk"]: r["n"] for r in top}
