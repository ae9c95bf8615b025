"""Token counts by a two-tier lookup that never moves a pre-token.

Tier one is a broadcast table of the lengths of frequent pre-tokens, tier two the cache of
each worker, filled by the tokenizer itself.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetscope.llm.bpe import frequent_chunks
from packetscope.llm.common import id_and_text, id_type, slices
from packetscope.llm.unicode import Assigned
from packetscope.session import ship

# frequent pre-tokens in the broadcast table, and words a worker remembers besides
TABLE_SIZE, REMEMBERED = 1 << 16, 1 << 19
# longer pieces are forgotten after their batch
SHORT = 64
# separators Python counts as white space and the tokenizer does not
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class FrequentLengths:
    """Pre-token -> number of tokens, as open addressing over three flat arrays.

    Words are told apart by a 64-bit hash and their length in bytes; two words of the
    table that agree in both are left out of it, and a word is only taken as found if
    its bytes are equal as well.
    """

    def __init__(self, lengths: dict[str, int]):
        words = sorted(lengths)
        self.slots = 1 << max(4, (2 * len(words)).bit_length())
        self.place = np.full(self.slots, -1, np.int32)
        raw = [w.encode() for w in words]
        self.ends = np.cumsum([0, *map(len, raw)]).astype(np.int64)
        self.bytes = b"".join(raw)
        self.tokens = np.asarray([lengths[w] for w in words], np.int32)
        for number, word in enumerate(raw):
            at = self._first(word)
            while self.place[at] >= 0:
                at = (at + 1) % self.slots
            self.place[at] = number

    def _first(self, word: bytes) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(word) % self.slots

    def get(self, text: str) -> int | None:
        word = text.encode()
        at = self._first(word)
        while (number := self.place[at]) >= 0:
            if self.bytes[self.ends[number] : self.ends[number + 1]] == word:
                return int(self.tokens[number])
            at = (at + 1) % self.slots
        return None


class Counter:
    """Counts tokens on a worker; kept between tasks."""

    def __init__(self, file: str, table: FrequentLengths):
        from tokenizers import Tokenizer, pre_tokenizers

        config = json.loads(file)
        pattern = config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(pattern).findall
        self.whole = Tokenizer.from_str(file)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        names = sorted((t["content"] for t in config["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.table, self.assigned = table, Assigned()
        self.words: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def learn(self, chunks: set[str]) -> None:
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
        if len(self.words) > REMEMBERED:
            self.words.clear()
        new = [c for c in chunks if c not in self.chunks]
        split = [self.cut(c) for c in new]
        misses = []
        for word in {w for words in split for w in words if w not in self.words}:
            found = self.table.get(word)
            if found is None:
                misses.append(word)
            else:
                self.words[word] = found
        encoded = self.model.encode_batch(misses, add_special_tokens=False)
        self.words.update(zip(misses, map(len, encoded)))
        words = self.words
        for chunk, parts in zip(new, split):
            self.chunks[chunk] = sum([words[w] for w in parts])
        for word in [w for parts in split for w in parts if len(w) > SHORT]:
            words.pop(word, None)

    def count(self, texts: list[str]) -> list[int]:
        plans, wanted = [], set()
        for text in texts:
            if not self.assigned(text) or _ODD_SPACE.search(text):
                # cut by the library, which knows other letters or other white space
                plans.append((len(self.whole.encode(text, add_special_tokens=False).ids), []))
                continue
            specials = 0
            if self.special is not None and self.special.search(text):
                text, specials = self.special.subn(" ", text)
            chunks = _lower(text).split()
            wanted.update(chunks)
            plans.append((specials, chunks))
        self.learn(wanted)
        known = self.chunks
        counts = [n + sum([known[c] for c in chunks]) for n, chunks in plans]
        for chunk in [c for c in wanted if len(c) > SHORT]:
            del known[chunk]
        return counts


def _lower(text: str) -> str:
    """As the tokenizer file normalizes: composed, then each character by itself in lower case."""
    if text.isascii():
        return text.lower()
    # a final capital sigma gets no special form there
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _table_of(texts: DataFrame, file: str, size: int) -> FrequentLengths:
    counter = Counter(file, FrequentLengths({}))
    chunks = {_lower(c) for c in frequent_chunks(texts, size, lower=True)}
    counter.learn({p for c in chunks if counter.assigned(c) for p in c.split()})
    return FrequentLengths(counter.words)


_made: list = []


def _counter(shared) -> Counter:
    if not _made or _made[0] != shared.id:
        _made[:] = [shared.id, Counter(shared.value[0], shared.value[1])]
    return _made[1]


class _Shared:
    """A broadcast with an id that workers can compare."""

    def __init__(self, spark, value):
        import uuid

        self.id, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.broadcast.value


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    table_size: int = TABLE_SIZE,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens``, a row per row, over whole texts.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids come back
    as they are; other columns are not read. An empty table gives an empty one. The
    broadcast holds the pre-tokens of at most ``table_size`` frequent chunks.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        file = f.read()
    texts = id_and_text(docs, id_col, text_col)
    shared = _Shared(spark, (file, _table_of(texts, file, table_size)))

    def count(batches):
        counter = _counter(shared)
        for batch in slices(batches):
            tokens = counter.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    sized = texts.withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = id_type(texts, "doc_id")
    return sized.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")


def with_limit(counted: DataFrame, limit: int = 2048) -> DataFrame:
    """Mark documents of more than ``limit`` tokens."""
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
