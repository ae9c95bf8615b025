"""Pack documents into sequences of fixed length, neighbours on a Hilbert curve together.

Each text is encoded once, where it lies. A document's hashed token counts are projected to
a few dimensions; the Hilbert key of that point is its place in the order. Running sums of
tokens along the order say where each document begins, and so in which sequences its pieces
lie: every sequence is full but the very last.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetscope.llm.batching import AT_ONCE, BatchEncoder
from packetscope.llm.common import byte_slices, id_type
from packetscope.llm.hilbert import DIMS, cells_of, hilbert_keys, projection
from packetscope.plans.ordered import running_totals
from packetscope.session import ship, written

LENGTH, TERMINATOR = 1024, 0
# tokens are hashed to so many counts before they are projected
BUCKETS = 4096
_ROW_BITS = 40


def curve_keys(documents: list[np.ndarray], directions: np.ndarray) -> np.ndarray:
    """Hilbert key of each document's ids; the empty document lies in the middle.

    Counts of hashed ids weigh as 64 times their root, in whole numbers, so that every
    machine finds the same key.
    """
    projected = np.zeros((len(documents), directions.shape[1]), np.int64)
    squares = np.zeros(len(documents), np.int64)
    for row, ids in enumerate(documents):
        hashed = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)
        counts = np.bincount(hashed, minlength=BUCKETS)
        used = np.flatnonzero(counts)
        weights = np.sqrt(4096.0 * counts[used]).astype(np.int64)
        projected[row] = weights @ directions[used]
        squares[row] = weights @ weights
    return hilbert_keys(cells_of(projected, squares))


def encoded(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``row, doc_id, key, n, ids``: every text with its terminator; ids are compressed."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())

    def encode(batches):
        encoder, directions = BatchEncoder.of(file.value), projection(BUCKETS, DIMS)
        packed = zstandard.ZstdCompressor(level=1)
        end = np.array([TERMINATOR], "<u4").tobytes()
        row = TaskContext.get().partitionId() << _ROW_BITS
        for batch in byte_slices(batches, 1, AT_ONCE):
            ids = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            keys = curve_keys([np.frombuffer(i, "<u4") for i in ids], directions)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + len(ids)), pa.int64()),
                    batch.column(0),
                    pa.array(keys, pa.int64()),
                    pa.array([len(i) // 4 + 1 for i in ids], pa.int64()),
                    pa.array([packed.compress(_narrow(i + end)) for i in ids], pa.binary()),
                ],
                names=["row", "doc_id", "key", "n", "ids"],
            )
            row += len(ids)

    rows = docs.select(docs["doc_id"], docs["text"])
    kind = id_type(rows, "doc_id")
    return rows.mapInArrow(encode, f"row long, doc_id {kind}, key long, n long, ids binary")


def _narrow(ids: bytes) -> bytes:
    """The four bytes of all ids one after another: the upper ones are nearly all zero."""
    return np.frombuffer(ids, np.uint8).reshape(-1, 4).T.tobytes()


def _wide(planes: bytes) -> bytes:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.tobytes()


def pack(
    docs: DataFrame, length: int = LENGTH, tokenizer_path: str | None = None
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens.

    Returns ``doc_id, start, length, ids (binary, little-endian uint32), doc_tokens,
    sequence_id, offset``. Every document ends with a terminator (id 0). Documents follow
    one another along the curve, then by id (null first) and content, and are cut where a
    sequence is full; only the last sequence of all may be shorter.

    Null and empty texts are documents of one token. Very long texts are cut into as many
    sequences as they need. Repeated rows are packed each; equal rows are interchangeable.
    Other columns are not read. An empty table has no pieces.
    """
    rows = written(encoded(docs, tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")), "encoded")
    # only the narrow columns are sorted
    narrow = rows.select("row", "doc_id", "key", "n", F.xxhash64("ids").alias("content"))
    order = [F.col(c) for c in ("key", "doc_id", "content", "row")]
    ends = running_totals(narrow, order, {"n": "end"})
    placed = rows.select("row", "doc_id", "n", "ids").join(
        ends.select("row", (F.col("end") - F.col("n")).alias("position")), "row"
    )

    def cut(batches):
        unpacked = zstandard.ZstdDecompressor()
        for batch in byte_slices(batches, 2):
            source, pieces = [], []
            columns = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for at, (n, compressed, position) in enumerate(zip(*columns)):
                ids, start = _wide(unpacked.decompress(compressed)), 0
                while start < n:
                    sequence, offset = divmod(position + start, length)
                    size = min(n - start, length - offset)
                    source.append(at)
                    pieces.append(
                        (start, size, ids[4 * start : 4 * (start + size)], n, sequence, offset)
                    )
                    start += size
            start, size, ids, n, sequence, offset = zip(*pieces)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(source)),
                    pa.array(start, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(n, pa.int64()),
                    pa.array(sequence, pa.int64()),
                    pa.array(offset, pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    kind = id_type(rows, "doc_id")
    return placed.select("doc_id", "n", "ids", "position").mapInArrow(
        cut,
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long",
    )


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
