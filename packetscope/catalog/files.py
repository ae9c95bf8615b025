"""Captures written to the shared folder in their file formats and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from packetscope.catalog import sql
from packetscope.catalog.registry import query
from packetscope.constants import BASIC_FEATURES
from packetscope.functions.text import utc_clock
from packetscope.operators import decode, encode
from packetscope.session import scratch_path
from packetscope.sources.captures import (
    estimate_packets,
    load_features,
    pcap_sizes,
    read_capture,
    read_numbered,
    write_capture,
)
from packetscope.sources.layouts import LAYOUTS, to_layout
from packetscope.sources.pcap import read_pcap, write_pcap

_COLUMNS = ["layout", "ts", "src_mac", "dst_mac", "src_ip", "dst_ip", "src_port", "dst_port",
            "protocol", "length", "ttl", "tcp_flags_mask"]
_SECOND = "date_trunc('second', ts)::TIMESTAMP"
_ON_TCP = f"({sql.TRANSPORT}) = 'TCP'"


def _loaded(layout: str, ts: str, mask: str = "tcp_flags_mask") -> str:
    return f"""SELECT '{layout}' AS layout, {ts} AS ts, src_mac, dst_mac, src_ip, dst_ip, src_port, dst_port,
 protocol, length, ttl, {mask} AS tcp_flags_mask FROM packets"""


_NO_ZERO = "CASE WHEN tcp_flags_mask <> 0 THEN tcp_flags_mask END"


@query(
    "load_alias",
    f"""
{_loaded('basic', _SECOND)} UNION ALL {_loaded('detailed', _SECOND, _NO_ZERO)} UNION ALL {_loaded('saved', _SECOND)}
UNION ALL {_loaded('raw', "date_trunc('millisecond', ts)::TIMESTAMP", _NO_ZERO)}
UNION ALL SELECT 'tshark', ts, src_mac, dst_mac, src_ip, dst_ip, CASE WHEN {_ON_TCP} THEN src_port END,
 CASE WHEN {_ON_TCP} THEN dst_port END, CASE ip_proto WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP'
 ELSE CAST(ip_proto AS VARCHAR) END, length, ttl, tcp_flags_mask FROM packets""",
)
def load_alias(packets):
    """All five layouts through CSV files and the header aliases."""
    spark = packets.sparkSession
    parts = []
    for layout in LAYOUTS:
        path = scratch_path(spark, f"capture-{layout}")
        write_capture(packets, path, layout)
        parts.append(read_capture(spark, path).withColumn("layout", F.lit(layout)).select(*_COLUMNS))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "load_features",
    f""", {sql.BASIC} SELECT {', '.join(BASIC_FEATURES)}, is_threat FROM basic""",
)
def loaded_features(packets):
    """Feature table of a basic capture file, its layout found from the header."""
    spark = packets.sparkSession
    path = scratch_path(spark, "capture-basic")
    write_capture(packets, path, "basic")
    return load_features(spark, path).drop("packet_id")


@query(
    "file_numbers",
    """ SELECT r + n AS packet_id, src_ip, dst_ip, protocol, length FROM (SELECT *,
 row_number() OVER (ORDER BY packet_id) AS r,
 CAST(sum(CASE WHEN packet_id % 10 = 3 THEN 2 ELSE 0 END)
  OVER (ORDER BY packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM packets) AS p""",
)
def file_numbers(packets):
    """Packets numbered over several files in file order; two empty lines before every tenth."""
    spark = packets.sparkSession
    path = scratch_path(spark, "capture-lines")
    rows = packets.repartitionByRange(4, "packet_id").sortWithinPartitions("packet_id")
    cells = to_layout(rows, "basic", keep=["packet_id"])
    line = F.to_csv(F.struct(*[f"`{c}`" for c in LAYOUTS["basic"]]), {"escape": '"', "emptyValue": ""})
    gap = F.when(F.col("packet_id") % 10 == 3, F.lit("\n\n")).otherwise(F.lit(""))
    # the first row of a file brings the header along
    is_first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    head = F.when(is_first, F.lit(",".join(LAYOUTS["basic"]) + "\n")).otherwise(F.lit(""))
    cells.select(F.concat(head, gap, line).alias("value")).write.text(path)
    return read_numbered(spark, path).select("packet_id", "src_ip", "dst_ip", "protocol", "length")


@query("pcap_scan", f", {sql.FRAMES} SELECT ts, frame_hex FROM frames")
def pcap_scan(packets):
    """Frames through pcap files."""
    spark = packets.sparkSession
    path = scratch_path(spark, "pcap")
    write_pcap(encode.frames(packets), path)
    return read_pcap(spark, path).select(
        utc_clock(F.col("ts")).alias("ts"), F.hex("frame").alias("frame_hex")
    )


@query(
    "pcap_numbers",
    f""", {sql.FRAMES} SELECT row_number() OVER (ORDER BY packet_id) AS packet_id, ts, frame_hex FROM frames""",
)
def pcap_numbers(packets):
    """Packet numbers that run through all files of a capture, each file read in ranges."""
    spark = packets.sparkSession
    path = scratch_path(spark, "pcap")
    rows = packets.repartitionByRange(6, "packet_id").sortWithinPartitions("packet_id")
    write_pcap(encode.frames(rows), path)
    return read_pcap(spark, path, 1 << 18).select(
        "packet_id", utc_clock(F.col("ts")).alias("ts"), F.hex("frame").alias("frame_hex")
    )


@query(
    "pcap_decode",
    """ SELECT CASE WHEN protocol IN ('HTTPS', 'FTP', 'SSH', 'TELNET') THEN 'TCP' ELSE protocol END AS protocol,
 count(*) AS n, count(DISTINCT src_ip) AS sources FROM packets GROUP BY 1""",
)
def pcap_decode(packets):
    """Protocol mix of a pcap capture: scan, decode, count."""
    spark = packets.sparkSession
    path = scratch_path(spark, "pcap")
    write_pcap(encode.frames(packets), path)
    rows = decode.decode_frames(read_pcap(spark, path))
    return rows.groupBy("protocol").agg(
        F.count("*").alias("n"), F.countDistinct("src_ip").alias("sources")
    )


@query(
    "pcap_estimate",
    f""", {sql.FRAMES}, sizes AS (SELECT CAST(sum(16 + length(frame_hex) // 2) AS BIGINT) AS body_bytes FROM frames)
SELECT body_bytes, greatest(1, body_bytes // 64) AS estimated_packets FROM sizes""",
)
def pcap_estimate(packets):
    """Size-based packet estimate of a capture; its files taken as one."""
    spark = packets.sparkSession
    path = scratch_path(spark, "pcap")
    write_pcap(encode.frames(packets), path)
    body = estimate_packets(pcap_sizes(spark, path)).agg(F.sum("body_bytes").alias("body_bytes"))
    return body.select(
        "body_bytes",
        F.greatest(F.lit(1), F.floor(F.col("body_bytes") / 64)).alias("estimated_packets"),
    )
