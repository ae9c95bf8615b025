"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# rows that become Python objects at one time; bounds a worker's memory on long texts
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, by a path that Spark opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, so other columns cannot clash; null text is empty."""
    return docs.select(
        docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")
    )


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def id_type(df: DataFrame, column: str) -> str:
    """SQL name of a column's type, to hand an id through unchanged."""
    return df.schema[column].dataType.simpleString()


# ASCII letters and digits and everything beyond ASCII make words; A-Z count as a-z
_LOWER_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Lower-case words of a text, as UTF-8."""
    return text.encode().translate(_LOWER_WORDS).split()


def give_back() -> None:
    """Return what a task has freed to the system; worker processes live on for other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


_kept: dict = {}


def kept(key, make):
    """What a worker process keeps between the tasks of a stage, one thing at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Forget what another stage kept."""
    _kept.clear()


def giving_back(run):
    """A worker's function on batches that gives memory back after its last one, and first
    lets go what other stages kept."""

    def whole(batches):
        let_go()
        yield from run(batches)
        give_back()

    return whole


def text_udf(kind: str, arrow_kind: pa.DataType, worker):
    """A column function over texts. ``worker()`` is made once per task and maps a list of
    texts (null: empty) to a list of values."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        of_texts = worker()
        for texts in batches:
            parts = [
                pa.array(
                    of_texts([t or "" for t in texts.slice(at, SLICE).to_pylist()]), arrow_kind
                )
                for at in range(0, len(texts), SLICE)
            ]
            yield pa.concat_arrays(parts) if parts else pa.array([], arrow_kind)
        del of_texts
        give_back()

    return F.arrow_udf(run, kind)


def byte_slices(
    batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 22
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts take ``most`` bytes, or one row if it is longer."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
