"""Cross-entropy difference between a target and a background language model.

Both are bigram models over one vocabulary, all words of the corpus, smoothed alike and
counted over all documents; the target model counts those marked as wanted. A document's
score is the mean over its words of the target's loss less the background's: the lower, the
more it reads like the target.

Texts are cut into words once and written as blocks of numbered words. Each block asks for
the counts of its own words and bigrams, each asked for once however often the block holds
it; the questions are grouped by ranges of hashes, added up over all blocks and answered.
So the models grow with the corpus, lie in no place as a whole, and no count is shared or
cut off. A word or bigram is told by 62 bits of a hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetscope.llm.common import byte_slices, id_and_text, id_type, words_of
from packetscope.llm.shingles import mixed
from packetscope.session import ship, written

# the bigram's share in a probability
SHARE = 0.7
# bytes of text in a block, and words of the corpus for each range of hashes: both bound
# what a worker holds at one time, neither changes a result
BLOCK_BYTES, RANGE_WORDS = 1 << 22, 1 << 20
_ROW_BITS = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
# the lowest two bits of a key tell words, bigrams and the start of a text apart
_KIND = np.uint64(3)
_WORD, _PAIR, _START = np.uint64(0), np.uint64(1), np.uint64(2)


def _packed(values: np.ndarray) -> bytes:
    """64-bit integers, byte planes one after another: the upper ones are nearly all zero."""
    planes = np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").reshape(-1)


def numbered(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``block, ids, n_words, sizes, words, places``: texts as numbers of words.

    ``words`` has the keys of a block's distinct words, ``places`` says for each word of its
    texts which of them it is, ``sizes`` how many words each text has; all are packed.
    """
    ship(texts.sparkSession)

    def run(batches):
        block = TaskContext.get().partitionId() << _ROW_BITS
        for batch in byte_slices(batches, 1, block_bytes):
            of_texts = [words_of(t) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, of_texts), np.int64, len(of_texts))
            flat = pa.array([w for words in of_texts for w in words], pa.binary()).dictionary_encode()
            hashes = [xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()]
            words = np.asarray(hashes, np.uint64) & ~_KIND | _WORD
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    ids,
                    pa.array([len(flat)], pa.int64()),
                    *(
                        pa.array([_packed(v)], pa.binary())
                        for v in (sizes, words, flat.indices.to_numpy())
                    ),
                ],
                names=["block", "ids", "n_words", "sizes", "words", "places"],
            )
            block += 1

    kind = id_type(texts, "doc_id")
    return texts.select("doc_id", "text").mapInArrow(
        run,
        f"block long, ids array<{kind}>, n_words long, sizes binary, words binary, places binary",
    )


class Block:
    """Words and bigrams of a block: sorted distinct keys, and where each word finds its own."""

    def __init__(self, sizes: bytes, words: bytes, places: bytes):
        self.sizes = _unpacked(sizes).astype(np.int64)
        keys, places = _unpacked(words), _unpacked(places).astype(np.int64)
        starts = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.first = np.zeros(len(places), bool)
        self.first[starts] = True
        now = keys[places]
        before = np.roll(now, 1)
        before[starts] = _START
        pairs, pair = np.unique(mixed(before * _ODD + now) & ~_KIND | _PAIR, return_inverse=True)
        # words, the start and bigrams in one sorted list
        every = np.concatenate([keys, np.full(min(len(starts), 1), _START), pairs])
        order = np.argsort(every)
        self.keys = every[order]
        at = np.empty_like(order)
        at[order] = np.arange(len(order))
        self.now = at[places]
        self.before = np.roll(self.now, 1)
        if len(starts):
            self.before[starts] = at[len(keys)]
        self.pair = at[len(every) - len(pairs) + pair]

    def counts(self, wanted: np.ndarray) -> np.ndarray:
        """How often each key occurs, in all texts and in the wanted ones."""
        rows = []
        for taken in (np.ones(len(self.owner), bool), wanted[self.owner]):
            found = np.concatenate(
                [self.now[taken], self.pair[taken], self.before[taken & self.first]]
            )
            rows.append(np.bincount(found, minlength=len(self.keys)))
        return np.stack(rows)

    def losses(self, counts: np.ndarray, total: int, size: int, share: float) -> np.ndarray:
        """Mean loss of each text under one model, in nats per word."""
        context = counts[self.before]
        weight = np.where(context > 0, share, 0.0)
        single = (counts[self.now] + 1.0) / (total + size)
        chance = weight * counts[self.pair] / np.maximum(context, 1) + (1 - weight) * single
        sums = np.bincount(self.owner, -np.log(chance), len(self.sizes))
        return sums / np.maximum(self.sizes, 1)


def _ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many equal ranges of 64 bits each key lies in; rises with the key."""
    half = np.uint64(32)
    return (((keys >> half) * np.uint64(ranges)) >> half).astype(np.int64)


def questions(blocks: DataFrame, wanted: DataFrame, ranges: int) -> DataFrame:
    """``block, place (range of hashes), keys, counts``: what each block holds and asks for.

    ``wanted`` has distinct ids; only they and the ids of the blocks meet, no texts.
    """
    flagged = (
        blocks.select("block", F.posexplode("ids").alias("at", "doc_id"))
        .join(wanted, "doc_id")
        .groupBy("block")
        .agg(F.collect_list("at").alias("wanted"))
    )

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["sizes"], row["words"], row["places"])
                flags = np.zeros(len(block.sizes), bool)
                flags[row["wanted"] or []] = True
                counts, place = block.counts(flags), _ranges(block.keys, ranges)
                cuts = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
                parts = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]] * len(parts), pa.int64()),
                        pa.array(place[cuts[:-1]], pa.int64()),
                        # sorted keys as steps from one to the next
                        pa.array([_packed(np.diff(block.keys[p], prepend=_WORD)) for p in parts], pa.binary()),
                        pa.array([_packed(counts[:, p].ravel()) for p in parts], pa.binary()),
                    ],
                    names=["block", "place", "keys", "counts"],
                )

    columns = blocks.select("block", "sizes", "words", "places")
    return columns.join(flagged, "block", "left").mapInArrow(
        run, "block long, place long, keys binary, counts binary"
    )


def answers(asked: DataFrame) -> DataFrame:
    """``block, place, counts``: the corpus' counts of the keys a block asked for, as it asked.

    One more row for each range, with a null block, has its distinct words (``size``) and the
    words of all texts and of the wanted ones.
    """

    def run(group: pa.Table) -> pa.Table:
        place = group.column("place")[0].as_py()
        keys = [np.cumsum(_unpacked(k), dtype=np.uint64) for k in group.column("keys").to_pylist()]
        counts = np.concatenate(
            [_unpacked(c).reshape(2, -1) for c in group.column("counts").to_pylist()], axis=1
        )
        every, own = np.unique(np.concatenate(keys), return_inverse=True)
        # sums of doubles are exact up to 2^53
        sums = np.stack([np.bincount(own, c, len(every)) for c in counts]).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        word = (every & _KIND) == _WORD
        back = [_packed(sums[:, part].ravel()) for part in np.split(own, ends[:-1])]
        n = len(back)
        return pa.table(
            {
                "block": pa.concat_arrays(
                    [group.column("block").combine_chunks(), pa.array([None], pa.int64())]
                ),
                "place": pa.array([place] * (n + 1), pa.int64()),
                "counts": pa.array([*back, None], pa.binary()),
                "size": pa.array([None] * n + [int(word.sum())], pa.int64()),
                "n": pa.array([None] * n + [int(sums[0, word].sum())], pa.int64()),
                "wanted_n": pa.array([None] * n + [int(sums[1, word].sum())], pa.int64()),
            }
        )

    return asked.groupBy("place").applyInArrow(
        run, "block long, place long, counts binary, size long, n long, wanted_n long"
    )


def cross_entropy_difference(
    docs: DataFrame,
    wanted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: float = SHARE,
    block_bytes: int = BLOCK_BYTES,
    range_words: int = RANGE_WORDS,
) -> DataFrame:
    """``doc_id, n_words, target_loss, background_loss, score``, a row per row, whole texts.

    ``wanted`` has the ids of target documents; null ids are never wanted, ids that repeat
    there count once. Losses are means per word in nats, ``score`` is target less background.

    Null, empty and wordless texts have 0 words, losses and score 0. Without any wanted
    document the target model knows only how many words there are. Repeated rows are counted
    and come back each, null ids too; a text longer than a block is a block of its own; other
    columns are not read; an empty table gives an empty one. There are no ties to settle.
    """
    texts = id_and_text(docs, id_col, text_col)
    blocks = written(numbered(texts, block_bytes), "numbered")
    ids = wanted.select(wanted[id_col].alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    words = blocks.agg(F.sum("n_words")).first()[0] or 0
    found = written(answers(questions(blocks, ids, words // range_words + 1)), "answers")
    # three numbers: the vocabulary with one unseen word, and the lengths of both corpora
    size, total, wanted_total = (
        n or 0 for n in found.where("block IS NULL").agg(F.sum("size"), F.sum("n"), F.sum("wanted_n")).first()
    )
    size += 1

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                sizes, words, places, found = (row.column(i)[0].as_py() for i in range(1, 5))
                block = Block(sizes, words, places)
                parts = [_unpacked(p["counts"]).reshape(2, -1) for p in found or []]
                counts = np.concatenate([np.zeros((2, 0), np.uint64), *parts], axis=1).astype(np.int64)
                background = block.losses(counts[0], total, size, share)
                target = block.losses(counts[1], wanted_total, size, share)
                yield pa.RecordBatch.from_arrays(
                    [
                        row.column(0).flatten(),
                        *map(pa.array, (block.sizes, target, background, target - background)),
                    ],
                    names=["doc_id", "n_words", "target_loss", "background_loss", "score"],
                )

    of_blocks = (
        found.where("block IS NOT NULL")
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("place", "counts"))).alias("found"))
    )
    kind = id_type(texts, "doc_id")
    return (
        blocks.join(of_blocks, "block", "left")
        .select("ids", "sizes", "words", "places", "found")
        .mapInArrow(
            run, f"doc_id {kind}, n_words long, target_loss double, background_loss double, score double"
        )
    )
