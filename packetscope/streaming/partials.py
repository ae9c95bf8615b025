"""Sums of a stream, kept as one small table per batch and merged in generations.

A batch writes its own sums under its number. Every ``every`` batches the sums of all earlier
ones are merged into one table, the generation; it counts from the moment it is complete, and
from then on batches before it do not. So a batch that is repeated after a failure can neither
be lost nor counted twice, and the number of tables stays bounded.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetscope.session import remove

EVERY = 16


def _listed(spark: SparkSession, folder: str, complete: bool) -> dict[int, str]:
    """Number to path of the ``name=number`` folders; ``complete`` asks for the end mark."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path(folder)):
        return {}
    found = {}
    for status in system.listStatus(path(folder)):
        name, _, number = status.getPath().getName().partition("=")
        if number.isdigit() and not name.startswith("_"):
            inner = os.path.join(folder, f"{name}={number}")
            if not complete or system.exists(path(os.path.join(inner, "_SUCCESS"))):
                found[int(number)] = inner
    return found


class Partials:
    """The partial sums under a folder: ``keys`` tell rows apart, ``sums`` are added up."""

    def __init__(self, out: str, keys: list[str], sums: list[str], every: int = EVERY):
        self.out, self.keys, self.sums, self.every = out, keys, sums, every
        self.batches, self.merged = os.path.join(out, "partial"), os.path.join(out, "merged")

    def _added(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[F.sum(s).alias(s) for s in self.sums])

    def _parts(self, spark: SparkSession, before: int | None = None) -> list[str]:
        """Paths that count: the newest generation and the batches it does not hold."""
        merged = {n: p for n, p in _listed(spark, self.merged, True).items() if before is None or n <= before}
        newest = max(merged, default=0)
        late = {n: p for n, p in _listed(spark, self.batches, True).items() if n >= newest}
        used = [p for n, p in sorted(late.items()) if before is None or n < before]
        return ([merged[newest]] if merged else []) + used

    def write(self, counted: DataFrame, number: int) -> None:
        """Keep the sums of a batch; the same number again replaces them."""
        spark = counted.sparkSession
        if number and number % self.every == 0:
            self._merge(spark, number)
        counted.write.mode("overwrite").parquet(os.path.join(self.batches, f"batch={number}"))

    def _merge(self, spark: SparkSession, upto: int) -> None:
        """Make the generation of all batches below ``upto``, unless it is there already.

        What the generation before it replaced is removed, so a reader that has just listed
        the tables still finds them.
        """
        done = _listed(spark, self.merged, True)
        if upto in done:
            return
        parts = self._parts(spark, upto)
        if not parts:
            return
        rows = self._added(spark.read.parquet(*parts))
        rows.write.mode("overwrite").parquet(os.path.join(self.merged, f"upto={upto}"))
        last = max(done, default=0)
        for number, path in _listed(spark, self.batches, False).items():
            if number < last:
                remove(spark, path)
        for number, path in done.items():
            if number < last:
                remove(spark, path)

    def read(self, spark: SparkSession) -> DataFrame:
        """The sums over all batches so far."""
        return self._added(spark.read.parquet(*(self._parts(spark) or [self.batches])))


class Position:
    """How many rows of a batch have been handed on, as one empty file in a durable folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.folder = folder
        self.system = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.system.mkdirs(self.path(folder))

    def _marks(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.path(self.folder)))

    def of(self, batch: int) -> int:
        """Rows of a batch that are done with."""
        of_batch = [m for m in self._marks() if m.startswith(f"{batch:012d}-")]
        return int(of_batch[-1].split("-")[1]) if of_batch else 0

    def set(self, batch: int, rows: int) -> None:
        """Note the new position, then drop the ones before it."""
        old, new = self._marks(), f"{batch:012d}-{rows:015d}"
        self.system.create(self.path(os.path.join(self.folder, new)), True).close()
        for mark in old:
            if mark != new:
                self.system.delete(self.path(os.path.join(self.folder, mark)), False)
