"""Structured Streaming jobs over a landing folder.

Every job runs with ``availableNow``: it takes all files that are there, in
batches, then stops. Started again with the same checkpoint it goes on with the
files that came in since. State is bounded in all of them: what totals and rates keep per
batch is merged in generations (see ``partials``), its size is that of their result.
"""

from __future__ import annotations

import itertools
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from packetscope.functions.addresses import direction
from packetscope.operators.lookups import transport_of
from packetscope.operators.rules import size_class, ttl_low, with_findings
from packetscope.operators.stats import section_counts
from packetscope.session import scratch_path
from packetscope.sources.layouts import normalise, to_layout
from packetscope.streaming.partials import Partials, Position

EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def stream_events(
    spark: SparkSession, folder: str, files: str = "events*.parquet", per_trigger: int | None = None
) -> DataFrame:
    """Event files of a folder as a stream; ``per_trigger`` bounds a batch.

    What matches ``files`` may be single files or folders of part files.
    """
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(os.path.join(folder, files))


def stream_csv(
    spark: SparkSession, folder: str, columns: list[str], per_trigger: int | None = None
) -> DataFrame:
    """Canonical packets from capture files as they land."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.schema(schema).option("header", True).option("escape", '"')
    reader = reader.option("enforceSchema", False)
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return normalise(reader.csv(folder))


def _finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def ingest_csv(packets: DataFrame, out: str, layout: str = "basic") -> None:
    """Append packets as CSV rows of a layout; each batch is written exactly once."""
    rows = to_layout(packets, layout)
    writer = rows.writeStream.format("csv").option("header", True).option("escape", '"')
    writer = writer.option("emptyValue", "").option("checkpointLocation", os.path.join(out, "_state"))
    _finish(writer.trigger(availableNow=True).start(os.path.join(out, "rows")))


TOTAL_SECTIONS = [
    ("protocol", "protocol"), ("source", "src_ip"), ("destination", "dst_ip"), ("port", "dst_port"),
    ("class", "packet_class"), ("total", "packets"),
]


def _totals(out: str) -> Partials:
    return Partials(out, ["section", "key"], ["n"])


def running_totals(packets: DataFrame, out: str) -> None:
    """Counts per protocol, address, destination port and class, and in total.

    Addresses are unbounded, so they are not kept in operator state. Each batch
    writes its own counts under its batch number; a repeated batch overwrites
    them, and :func:`read_totals` adds them up.
    """
    _write_partials(
        packets, _totals(out), lambda batch: section_counts(with_classes(batch), TOTAL_SECTIONS)
    )


def with_classes(packets: DataFrame) -> DataFrame:
    """The columns that :data:`TOTAL_SECTIONS` counts besides those of a packet."""
    transport = F.lower(transport_of(F.col("protocol")))
    known = F.when(transport.isin("tcp", "udp", "icmp"), transport)
    return packets.withColumns(
        {"packet_class": F.coalesce(known, F.lit("other")), "packets": F.lit("all")}
    )


def _write_partials(packets: DataFrame, partials: Partials, counted) -> None:
    """Keep ``counted(batch)`` of every batch."""
    writer = packets.writeStream.foreachBatch(
        lambda batch, number: partials.write(counted(batch), number)
    )
    writer = writer.option("checkpointLocation", os.path.join(partials.out, "_state"))
    _finish(writer.trigger(availableNow=True).start())


def read_totals(spark: SparkSession, out: str) -> DataFrame:
    """Totals so far of :func:`running_totals`."""
    return _totals(out).read(spark)


def window_counts(packets: DataFrame, window: str = "1 minute") -> DataFrame:
    """Packets and bytes per time window of a table."""
    rates = packets.groupBy(F.window(F.col("ts").cast("timestamp"), window).alias("w")).agg(
        F.count("*").alias("n"), F.sum(F.col("length").cast("bigint")).alias("bytes")
    )
    return rates.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "n",
        "bytes",
    )


def _rates(out: str) -> Partials:
    return Partials(out, ["window_start", "window_end"], ["n", "bytes"])


def packet_rates(packets: DataFrame, out: str, window: str = "1 minute") -> None:
    """Packets and bytes per time window.

    Packets may come in any order and however late: their batch counts them, and
    :func:`read_rates` adds up.
    """
    _write_partials(packets, _rates(out), lambda batch: window_counts(batch, window))


def read_rates(spark: SparkSession, out: str) -> DataFrame:
    """Rates so far of :func:`packet_rates`, the last windows included."""
    return _rates(out).read(spark)


def annotate(packets: DataFrame) -> DataFrame:
    """Per-packet findings and classes; stateless, so the same on a table or a stream."""
    return with_findings(packets).select(
        "packet_id",
        "protocol",
        direction(F.col("src_ip"), F.col("dst_ip")).alias("direction"),
        size_class(F.col("length")).alias("size_class"),
        ttl_low(F.col("ttl")).alias("ttl_low"),
        "findings",
    )


def append_rows(rows: DataFrame, out: str) -> None:
    """Append the rows of a stateless stream as parquet."""
    writer = rows.writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", os.path.join(out, "_state"))
    _finish(writer.trigger(availableNow=True).start(os.path.join(out, "rows")))


def stream_findings(packets: DataFrame, out: str) -> None:
    """Annotated packets appended as they arrive."""
    append_rows(annotate(packets), out)


def live_view(packets: DataFrame, show, rows: int = 100, state: str | None = None) -> None:
    """Hand every packet to ``show(page, number)``, in pages of at most ``rows`` in packet order.

    A page is a list of rows. The driver holds one page and the partition it comes from.
    ``state`` names a durable folder: a view that was stopped goes on after the last page that
    ``show`` returned from, inside a batch too. Without it a view starts from the beginning.
    Rows with the same packet id keep one order, so pages are the same when a batch is repeated.
    """
    spark = packets.sparkSession
    state = state or scratch_path(spark, "live")
    position = Position(spark, os.path.join(state, "shown"))

    def pass_on(batch: DataFrame, number: int) -> None:
        in_order = batch.orderBy("packet_id", F.xxhash64(*batch.columns)).toLocalIterator()
        shown = position.of(number)
        waiting = itertools.islice(in_order, shown, None)
        while page := list(itertools.islice(waiting, rows)):
            show(page, number)
            shown += len(page)
            position.set(number, shown)

    writer = packets.writeStream.foreachBatch(pass_on)
    writer = writer.option("checkpointLocation", os.path.join(state, "_state"))
    _finish(writer.trigger(availableNow=True).start())
