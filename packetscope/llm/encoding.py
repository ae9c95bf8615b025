"""BPE encoding and decoding through a lexicon transducer.

Frequent words come from a minimal acyclic transducer that workers memory-map; words it
does not hold are merged exactly and remembered by the worker. The rows never move: a
text is encoded where it is read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetscope.llm.bpe import Vocabulary, frequent_chunks
from packetscope.llm.common import byte_slices, give_back, id_and_text, id_type, kept
from packetscope.llm.lexicon import Lexicon, compile_lexicon, mapped
from packetscope.llm.merging import Encoder
from packetscope.session import ship

# pre-tokens in the lexicon, pieces of one generation that a worker remembers besides, and bytes of
# text that are objects at one time
LEXICON_SIZE, REMEMBERED, AT_ONCE = 1 << 16, 1 << 17, 1 << 20


class LexiconEncoder(Encoder):
    """Encodes and decodes on a worker; made once per process and stage."""

    def __init__(self, file: str, lexicon: Lexicon):
        self.lexicon = lexicon
        super().__init__(file, REMEMBERED)

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens from the lexicon; those it does not hold are merged."""
        ids = self.lexicon.lookup([w.encode() for w in words])
        merged = iter(super()._merge([w for w, i in zip(words, ids) if i is None]))
        return [next(merged) if i is None else i.astype("<u4").tobytes() for i in ids]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        token = self.vocabulary.tokens.__getitem__
        return b"".join(map(token, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _lexicon_of(texts: DataFrame, vocabulary: Vocabulary, size: int) -> bytes:
    """Compile the pre-tokens of the most frequent chunks, as they stand after a space."""
    cut = regex.compile(public_tokenizers.PATTERN).findall
    words: dict[bytes, list[int]] = {}
    for chunk in frequent_chunks(texts, size):
        for word in cut(" " + chunk):
            raw = word.encode()
            if raw not in words:
                words[raw] = vocabulary.merge(raw)
    return compile_lexicon(words)


def encode_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    lexicon_size: int = LEXICON_SIZE,
) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns ``doc_id, n_tokens, ids (binary, little-endian uint32), decoded``, a row per
    row. Null and empty texts have no ids and decode to the empty text. Repeated rows and
    null ids come back as they are; other columns are not read, whatever their names. An
    empty table gives an empty one. Special strings inside a text become their ids.

    The lexicon and the vocabulary are broadcast; both are bounded by ``lexicon_size``
    and the tokenizer file, not by the corpus.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = f.read()
    vocabulary = Vocabulary.of(file)
    texts = id_and_text(docs, id_col, text_col)
    shared = spark.sparkContext.broadcast((file, _lexicon_of(texts, vocabulary, lexicon_size)))

    def encode(batches):
        encoder = _encoder(shared)
        for batch in byte_slices(batches, 1, AT_ONCE):
            ids = encoder.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(map(encoder.decode, ids), pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )
        # the process lives on for other stages; what is frequent is in the lexicon
        encoder.forget()
        give_back()

    kind = id_type(texts, "doc_id")
    return texts.mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def _encoder(shared) -> LexiconEncoder:
    """One encoder per worker process and lexicon, kept between tasks until another stage runs."""
    file, lexicon = shared.value
    key = hashlib.sha256(file.encode() + lexicon).hexdigest()
    return kept(key, lambda: LexiconEncoder(file, Lexicon(mapped(lexicon))))


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and checksums of encoded documents."""
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
