"""pcap files: :func:`read_pcap`, :func:`write_pcap`, and ``spark.read.format("pcap")``.

A pcap file has no index, so :func:`pcap_index` makes one: a walk from record header to
record header cuts each file into ranges of whole records and counts their packets. Ranges
of one large file are then read by many tasks, and every packet gets its number in the whole
capture. The index can be kept and used again. The plain data source needs no walk: one
partition per file, ids from 1 in each. Both stream: a task holds a few megabytes.
"""

from __future__ import annotations

import os
import struct
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from packetscope.functions.text import epoch_micros
from packetscope.plans.ordered import running_totals
from packetscope.session import ship, written

SCHEMA = "packet_id bigint, ts timestamp, frame binary"
# a batch ends with the row that reaches either
ROWS_PER_BATCH, BYTES_PER_BATCH = 8192, 4 << 20
# bytes of a range of the index, bytes read at one time while headers are walked
RANGE_BYTES, _WALK_BYTES = 64 << 20, 1 << 20
# what opening a range counts for when ranges are dealt to tasks
_OPEN_BYTES = 4 << 20

INDEX_SCHEMA = "file int, path string, start bigint, stop bigint, packets bigint, magic binary"

# magic number -> (byte order, fraction digits of the time stamp to microseconds)
_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1),
    b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000),
    b"\xa1\xb2\x3c\x4d": (">", 1000),
}
_GLOBAL_HEADER = struct.Struct("<IHHiIII")
_RECORD_HEADER = struct.Struct("<IIII")


class PcapError(ValueError):
    """A file that is no pcap file or ends inside a record."""


def _open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; plain paths are local or mounted, URIs as given."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    system, inner = _open_fs(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise PcapError(f"no such file or folder: {path}")
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted(
        prefix + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".pcap")
    )


def _magic_of(head: bytes) -> bytes:
    if len(head) < 24 or bytes(head[:4]) not in _MAGIC:
        raise PcapError("not a pcap file")
    return bytes(head[:4])


def read_records(stream, magic: bytes, left: int | None = None):
    """(microseconds, frame bytes) of the records at the stream's position.

    ``left`` bytes of whole records are read, or all up to the end.
    """
    order, per_micro = _MAGIC[magic]
    record = struct.Struct(order + "IIII")
    number = 0
    while left is None or left > 0:
        raw = stream.read(16)
        if not raw:
            return
        if len(raw) < 16:
            raise PcapError(f"file ends inside the header of packet {number + 1}")
        seconds, fraction, kept, _ = record.unpack(raw)
        frame = stream.read(kept)
        if len(frame) < kept:
            raise PcapError(f"file ends inside packet {number + 1}")
        number += 1
        if left is not None:
            left -= 16 + kept
        yield seconds * 1_000_000 + fraction // per_micro, bytes(frame)


def _batches(records, first: int):
    """Numbered records in batches bounded by rows and by bytes."""
    rows, held = [], 0
    for number, (micros, frame) in enumerate(records, first):
        rows.append((number, micros, frame))
        held += len(frame)
        if len(rows) == ROWS_PER_BATCH or held >= BYTES_PER_BATCH:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def record_ranges(file, size: int, magic: bytes, range_bytes: int):
    """(start, stop, packets) of runs of whole records, by a walk over their headers.

    A block is read and its headers are followed in memory; a record that reaches past the
    block is skipped by its length.
    """
    header = struct.Struct(_MAGIC[magic][0] + "8xI4x")
    at = start = 24
    block, base, number, packets = b"", 0, 0, 0
    while at < size:
        if at + 16 > base + len(block):
            file.seek(at)
            block, base = file.read(_WALK_BYTES), at
            if len(block) < 16:
                raise PcapError(f"file ends inside the header of packet {number + 1}")
        at += 16 + header.unpack_from(block, at - base)[0]
        number, packets = number + 1, packets + 1
        if at > size:
            raise PcapError(f"file ends inside packet {number}")
        if at - start >= range_bytes:
            yield start, at, packets
            start, packets = at, 0
    if packets:
        yield start, at, packets


def pcap_index(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of whole records of all captures under a path, a row each.

    One task walks one file; only record headers are looked at. Files are numbered in the
    order of their paths. Empty captures have no range.
    """
    ship(spark)
    files = _files(path)
    listed = spark.createDataFrame(list(enumerate(files)), "file int, path string")

    def walk(batches):
        for batch in batches:
            for number, name in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                system, inner = _open_fs(name)
                with system.open_input_file(inner) as file:
                    magic = _magic_of(file.read(24))
                    rows = list(record_ranges(file, file.size(), magic, range_bytes))
                n = len(rows)
                starts, stops, packets = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * n, pa.int32()),
                        pa.array([name] * n, pa.string()),
                        pa.array(starts, pa.int64()),
                        pa.array(stops, pa.int64()),
                        pa.array(packets, pa.int64()),
                        pa.array([magic] * n, pa.binary()),
                    ],
                    names=["file", "path", "start", "stop", "packets", "magic"],
                )

    return listed.repartitionById(max(1, len(files)), "file").mapInArrow(walk, INDEX_SCHEMA)


def read_ranges(index: DataFrame) -> DataFrame:
    """(packet_id, ts, frame) of an index's ranges; ids run through all of its files.

    Ranges are dealt to tasks by their bytes, small files share one. The index is small: a
    row stands for a range of many megabytes or for a file.
    """
    spark = index.sparkSession
    ship(spark)
    index = written(index, "pcap-index")
    size = F.col("stop") - F.col("start") + F.lit(_OPEN_BYTES)
    total = index.agg(F.sum(size), F.max(size)).first()
    if total[0] is None:
        return spark.createDataFrame([], SCHEMA)
    # as Spark deals out files: enough tasks for all cores, but none for next to nothing
    share = max(_OPEN_BYTES, min(total[1], total[0] // spark.sparkContext.defaultParallelism))
    summed = running_totals(
        index.withColumn("size", size), [F.col("file"), F.col("start")], {"packets": "upto", "size": "end"}
    )
    placed = summed.select(
        "path", "start", "stop", "magic",
        (F.col("upto") - F.col("packets") + 1).alias("first"),
        F.floor((F.col("end") - F.col("size")) / share).cast("int").alias("task"),
    )
    tasks = placed.agg(F.max("task")).first()[0] + 1

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, inner = _open_fs(row["path"])
                with system.open_input_file(inner) as file:
                    file.seek(row["start"])
                    stream = _Buffered(file)
                    records = read_records(stream, row["magic"], row["stop"] - row["start"])
                    yield from _batches(records, row["first"])

    return placed.repartitionById(tasks, "task").mapInArrow(read, SCHEMA)


class _Buffered:
    """Small reads out of large ones."""

    def __init__(self, file):
        self.file, self.block, self.at = file, b"", 0

    def read(self, size: int) -> bytes:
        if self.at + size > len(self.block):
            rest = self.block[self.at :]
            self.block = rest + self.file.read(max(size - len(rest), _WALK_BYTES))
            self.at = 0
        out = self.block[self.at : self.at + size]
        self.at += len(out)
        return out


@dataclass
class PcapFile(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class PcapReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [PcapFile(p) for p in _files(self.path)] or [PcapFile("")]

    def read(self, partition):
        if not partition.path:
            return
        system, inner = _open_fs(partition.path)
        with system.open_input_stream(inner, buffer_size=1 << 20) as stream:
            yield from _batches(read_records(stream, _magic_of(stream.read(24))), 1)


def _batch(rows) -> pa.RecordBatch:
    numbers, micros, frames = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(numbers, pa.int64()),
            pa.array(micros, pa.int64()).cast(pa.timestamp("us", tz="UTC")),
            pa.array(frames, pa.binary()),
        ],
        names=["packet_id", "ts", "frame"],
    )


@dataclass
class PcapFileWritten(WriterCommitMessage):
    path: str
    packets: int


class PcapWriter(DataSourceArrowWriter):
    """One file per task, under a name of its own; names sort as the partitions do.

    Files get the ``.pcap`` ending when the job commits. What a failed or repeated
    task left behind never gets it, so a lost executor leaves no doubled packets.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        system, inner = _open_fs(self.path)
        system.create_dir(inner, recursive=True)
        part = TaskContext.get().partitionId()
        pending = os.path.join(inner, f"part-{part:08d}-{uuid.uuid4().hex}.pending")
        packets = 0
        with system.open_output_stream(pending) as out:
            out.write(_GLOBAL_HEADER.pack(0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
            for batch in iterator:
                times = batch.column("ts_micros").to_pylist()
                for micros, frame in zip(times, batch.column("frame").to_pylist()):
                    seconds, rest = divmod(micros, 1_000_000)
                    out.write(_RECORD_HEADER.pack(seconds, rest, len(frame), len(frame)))
                    out.write(frame)
                packets += batch.num_rows
        return PcapFileWritten(pending, packets)

    def commit(self, messages):
        system, _ = _open_fs(self.path)
        for message in messages:
            if message is not None:
                system.move(message.path, message.path.removesuffix(".pending") + ".pcap")

    def abort(self, messages):
        system, _ = _open_fs(self.path)
        for message in messages:
            if message is not None:
                system.delete_file(message.path)


class PcapSource(DataSource):
    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PcapReader(self.options["path"])

    def writer(self, schema, overwrite):
        return PcapWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the source known; executors need the package to run it."""
    ship(spark)
    spark.dataSource.register(PcapSource)


def read_pcap(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(packet_id, ts, frame) of a capture file or of all captures in a folder.

    Ids count 1..n over all files in the order of their paths. Files are walked once for
    their index when this is called, and read in ranges when the result is.
    """
    return read_ranges(pcap_index(spark, path, range_bytes))


def write_pcap(frames: DataFrame, path: str) -> None:
    """Write (ts, frame) rows as pcap files, one per partition.

    A TIMESTAMP is an instant; a TIMESTAMP_NTZ is read as UTC clock time.
    """
    register(frames.sparkSession)
    instant = dict(frames.dtypes)["ts"] == "timestamp"
    micros = F.unix_micros("ts") if instant else epoch_micros(F.col("ts"))
    rows = frames.select(micros.alias("ts_micros"), "frame")
    rows.write.format("pcap").mode("append").save(path)
