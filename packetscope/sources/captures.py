"""Reading and writing capture files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetscope.operators.features import basic_features, detailed_features
from packetscope.plans.ordered import running_totals
from packetscope.session import written
from packetscope.sources.layouts import (
    LAYOUTS,
    LayoutError,
    detect_layout,
    layout_schema,
    normalise,
    to_layout,
)

PCAP_HEADER_BYTES = 24
PCAP_BYTES_PER_PACKET = 64


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line; reads no data rows."""
    try:
        columns = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    except Exception as problem:
        raise LayoutError(f"cannot read a capture at {path}: {problem}") from problem
    if not columns:
        raise LayoutError(f"the capture at {path} is empty or has no header")
    return columns


def read_text_rows(spark: SparkSession, path: str, layout: str | None = None) -> DataFrame:
    """Text rows of a capture, by a known layout's schema or by its own header."""
    if layout is not None and layout not in LAYOUTS:
        raise LayoutError(f"unknown layout {layout!r}, expected one of {sorted(LAYOUTS)}")
    header = _header(spark, path)
    # files of a folder must agree on the header, or columns would be mixed up
    reader = spark.read.option("header", True).option("enforceSchema", False).option("escape", '"')
    if layout is None or header != LAYOUTS[layout]:
        return reader.option("inferSchema", False).csv(path)
    return reader.schema(layout_schema(layout)).csv(path)


def read_capture(spark: SparkSession, path: str, layout: str | None = None) -> DataFrame:
    """Canonical packets of a saved capture under any known header."""
    return normalise(read_text_rows(spark, path, layout))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, number`` of all lines but the header of each file, empty ones too.

    Lines are told apart by file, block of the file and place in the block; only a row per
    block is summed up, the lines stay where they are read. Numbers do not depend on how files
    are cut into blocks, nor blocks dealt to tasks.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    blocks = lines.groupBy("file", "block").agg(
        F.min("at").alias("first"),
        F.count(F.lit(1)).alias("lines"),
        (F.max("block") == 0).cast("long").alias("headers"),
    )
    summed = running_totals(
        written(blocks, "blocks"),
        [F.col("file"), F.col("block")],
        {"lines": "upto", "headers": "headers_upto"},
    ).select("file", "block", "first", "lines", (F.col("upto") - F.col("lines") - F.col("headers_upto")).alias("before"))
    placed = lines.join(summed, ["file", "block"])
    place = F.col("at") - F.col("first")
    # the lines are read twice; a file that changed in between must not give wrong numbers
    moved = F.raise_error(F.lit("the capture changed while it was numbered")).cast("long")
    number = F.when(place.between(0, F.col("lines") - 1), F.col("before") + place + 1).otherwise(moved)
    return placed.select(
        "line", number.alias("number"), ((F.col("block") == 0) & (place == 0)).alias("is_header")
    )


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """Canonical packets with ``packet_id`` 1.. in file order, files by their paths.

    Empty lines use up a number and are left out, so a packet's number is its line's. All
    files must have the same header. Values do not hold line ends.
    """
    header = _header(spark, path)
    lines = _numbered_lines(spark, path)
    fields = ", ".join(f"c{i} STRING" for i in range(len(header)))
    parsed = F.from_csv("line", F.lit(f"{fields}, more STRING"), {"escape": '"'})
    cells = lines.where("line <> ''").select("number", "is_header", parsed.alias("cells"))
    same = F.lit(True)
    for i, name in enumerate(header):
        same = same & F.col(f"cells.c{i}").eqNullSafe(F.lit(name))
    other = F.raise_error(F.lit(f"a file of {path} has another header")).cast("boolean")
    rows = cells.where(F.when(F.col("is_header") & ~same, other).otherwise(~F.col("is_header")))
    text = rows.select(
        F.col("number").alias("packet_id"),
        *[F.col(f"cells.c{i}").alias(name) for i, name in enumerate(header)],
    )
    return normalise(text, keep=["packet_id"]).drop("packet_no")


def detect_source_type(spark: SparkSession, path: str) -> str:
    """``detailed`` if the header says so; anything else, unreadable too, is ``basic``."""
    try:
        return detect_layout(_header(spark, path))
    except LayoutError:
        return "basic"


def load_features(spark: SparkSession, path: str, source_type: str | None = None) -> DataFrame:
    """Feature table of a capture with packet ids, layout detected unless it is given."""
    kind = source_type or detect_source_type(spark, path)
    packets = read_numbered(spark, path)
    return basic_features(packets) if kind == "basic" else detailed_features(packets)


def write_capture(df: DataFrame, path: str, layout: str = "basic") -> None:
    """Write canonical packets as CSV; the detailed layout writes nothing for no rows."""
    rows = to_layout(df, layout)
    if layout == "detailed" and rows.isEmpty():
        return
    rows.write.mode("error").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def pcap_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modification time of the pcap files under a folder.

    File contents are not read: only these columns are taken from the listing.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap")
    files = reader.option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime")


def estimate_packets(sizes: DataFrame) -> DataFrame:
    """Rough packet count per file from its size; files without a full header give none."""
    body = F.col("length") - PCAP_HEADER_BYTES
    return sizes.filter(body >= 0).select(
        "path",
        body.alias("body_bytes"),
        F.greatest(F.lit(1), F.floor(body / PCAP_BYTES_PER_PACKET)).alias("estimated_packets"),
    )


def newest_file(spark: SparkSession, path: str, pattern: str = "*.csv") -> str | None:
    """Path of the file last modified, or None for an empty folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    row = files.agg(F.max_by("path", "modificationTime").alias("path")).first()
    return row["path"]
