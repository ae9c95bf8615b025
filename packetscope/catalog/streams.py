"""Streaming jobs over the event files, run to the end of what is there."""

from __future__ import annotations

import os

from packetscope.catalog import sql
from packetscope.catalog.annotations import _FINDINGS
from packetscope.catalog.registry import folder_query
from packetscope.fixtures import packets_from
from packetscope.operators.features import detailed_features
from packetscope.session import scratch_path
from packetscope.sources.captures import read_capture
from packetscope.streaming import jobs


def _stream(spark, sf_dir):
    return packets_from(jobs.stream_events(spark, sf_dir))


@folder_query(
    "stream_ingest",
    f""" SELECT date_trunc('second', ts)::TIMESTAMP AS ts, src_mac, dst_mac, src_ip, dst_ip, src_port, dst_port,
 protocol, length, ttl, tcp_flags_mask, {sql.packet_direction()} AS packet_direction FROM packets""",
)
def stream_ingest(spark, sf_dir):
    out = scratch_path(spark, "ingest")
    jobs.ingest_csv(_stream(spark, sf_dir), out)
    return read_capture(spark, os.path.join(out, "rows")).select(
        "ts", "src_mac", "dst_mac", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        "length", "ttl", "tcp_flags_mask", "packet_direction",
    )


@folder_query(
    "stream_totals",
    f""" SELECT 'protocol' AS section, protocol AS key, count(*) AS n FROM packets GROUP BY protocol
 UNION ALL SELECT 'source', src_ip, count(*) FROM packets GROUP BY src_ip
 UNION ALL SELECT 'destination', dst_ip, count(*) FROM packets GROUP BY dst_ip
 UNION ALL SELECT 'port', CAST(dst_port AS VARCHAR), count(*) FROM packets
  WHERE dst_port IS NOT NULL GROUP BY dst_port
 UNION ALL SELECT 'class', CASE WHEN ({sql.TRANSPORT}) IN ('TCP', 'UDP', 'ICMP')
  THEN lower({sql.TRANSPORT}) ELSE 'other' END, count(*) FROM packets GROUP BY 2
 UNION ALL SELECT 'total', 'all', count(*) FROM packets""",
)
def stream_totals(spark, sf_dir):
    out = scratch_path(spark, "totals")
    jobs.running_totals(_stream(spark, sf_dir), out)
    return jobs.read_totals(spark, out)


@folder_query(
    "stream_rate",
    """, w AS (SELECT date_trunc('minute', ts)::TIMESTAMP AS window_start, count(*) AS n,
 CAST(sum(length) AS BIGINT) AS bytes FROM packets GROUP BY 1)
SELECT window_start, window_start + INTERVAL 1 MINUTE AS window_end, n, bytes FROM w""",
)
def stream_rate(spark, sf_dir):
    """All windows, the last ones included."""
    out = scratch_path(spark, "rate")
    jobs.packet_rates(_stream(spark, sf_dir), out)
    return jobs.read_rates(spark, out)


@folder_query(
    "stream_findings",
    f""" SELECT packet_id, protocol, {sql.direction()} AS direction,
 CASE WHEN length < 60 THEN 'small' WHEN length > 1400 THEN 'large' ELSE 'medium' END AS size_class,
 {sql.one('ttl < 64')} AS ttl_low, {_FINDINGS} AS findings FROM packets""",
)
def stream_findings(spark, sf_dir):
    out = scratch_path(spark, "findings")
    jobs.stream_findings(_stream(spark, sf_dir), out)
    return spark.read.parquet(os.path.join(out, "rows"))


@folder_query(
    "stream_features", f", {sql.DETAILED} SELECT packet_id, is_threat FROM detailed"
)
def stream_features(spark, sf_dir):
    """Feature expressions and the rule label applied as packets arrive."""
    out = scratch_path(spark, "features")
    labelled = detailed_features(_stream(spark, sf_dir)).select("packet_id", "is_threat")
    jobs.append_rows(labelled, out)
    return spark.read.parquet(os.path.join(out, "rows"))


class _Stopped(Exception):
    """The viewer was closed."""


@folder_query(
    "stream_live",
    """ SELECT count(*) AS shown, CAST(sum(packet_id) AS BIGINT) AS ids, CAST(max(packet_id) AS BIGINT) AS last_id,
 1 AS stops FROM packets""",
)
def stream_live(spark, sf_dir):
    """A live view that is closed after two pages and opened again shows every packet once."""
    state = scratch_path(spark, "live")
    seen = {"shown": 0, "ids": 0, "last_id": 0, "stops": 0, "pages": 0}

    def show(page, number):
        if seen["pages"] == 2 and not seen["stops"]:
            seen["stops"] = 1
            raise _Stopped("closed")
        seen["pages"] += 1
        seen["shown"] += len(page)
        seen["ids"] += sum(r["packet_id"] for r in page)
        seen["last_id"] = max(seen["last_id"], max(r["packet_id"] for r in page))

    narrow = _stream(spark, sf_dir).select("packet_id", "ts", "protocol")
    try:
        jobs.live_view(narrow, show, 250, state)
    except Exception as problem:
        if not seen["stops"]:
            raise problem
    jobs.live_view(_stream(spark, sf_dir).select("packet_id", "ts", "protocol"), show, 250, state)
    row = tuple(seen[n] for n in ("shown", "ids", "last_id", "stops"))
    return spark.createDataFrame([row], "shown bigint, ids bigint, last_id bigint, stops int")
