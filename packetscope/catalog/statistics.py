"""Counts, top lists and reports."""

from __future__ import annotations

from packetscope.catalog import sql
from packetscope.catalog.registry import query
from packetscope.operators import stats
from packetscope.operators.features import detailed_features
from packetscope.plans import reports

_TOTAL = "(SELECT count(*) FROM packets)"


def _pct(total: str = _TOTAL, digits: int = 2) -> str:
    return f"round(CAST(100 AS DOUBLE) * count(*) / nullif({total}, 0), {digits}) AS pct"


def _top(column: str, k: int = 10) -> str:
    return f""" SELECT {column}, count(*) AS n, {_pct()} FROM packets WHERE {column} IS NOT NULL
 GROUP BY {column} ORDER BY n DESC, {column} LIMIT {k}"""


@query("total_packets", " SELECT count(*) AS n FROM packets")
def total(packets):
    return stats.total_packets(packets)


@query("proto_dist", f" SELECT protocol, count(*) AS n, {_pct()} FROM packets GROUP BY protocol")
def proto_dist(packets):
    return stats.protocol_distribution(packets)


def _classes(kind: str) -> str:
    return f""" SELECT count(*) FILTER (WHERE {kind} = 'TCP') AS tcp_packets,
 count(*) FILTER (WHERE {kind} = 'UDP') AS udp_packets, count(*) FILTER (WHERE {kind} = 'ICMP') AS icmp_packets,
 count(*) FILTER (WHERE {kind} NOT IN ('TCP', 'UDP', 'ICMP')) AS other_packets,
 count(*) AS total_packets FROM packets"""


@query("proto_class_exact", _classes("protocol"))
def proto_class_exact(packets):
    return stats.class_counts_exact(packets)


@query("proto_class_layer", _classes(f"({sql.TRANSPORT})"))
def proto_class_layer(packets):
    return stats.class_counts_layer(packets)


@query("top_src", _top("src_ip"))
def top_src(packets):
    return stats.top_share(packets, "src_ip", 10)


@query("top_dst", _top("dst_ip"))
def top_dst(packets):
    return stats.top_share(packets, "dst_ip", 10)


@query(
    "top_dst_ports",
    f""" SELECT dst_port, count(*) AS n FROM packets WHERE ({sql.TRANSPORT}) IN ('TCP', 'UDP')
 AND dst_port IS NOT NULL GROUP BY dst_port ORDER BY n DESC, dst_port LIMIT 10""",
)
def top_dst_ports(packets):
    return stats.top(stats.dst_port_counts(packets), "dst_port", 10)


@query(
    "top_ports_both",
    """, both_ends AS (SELECT src_port AS port FROM packets UNION ALL SELECT dst_port FROM packets)
SELECT port, count(*) AS n FROM both_ends WHERE port IS NOT NULL GROUP BY port ORDER BY n DESC, port LIMIT 10""",
)
def top_ports_both(packets):
    return stats.top(stats.port_counts(packets), "port", 10)


@query(
    "all_src_sorted",
    """ SELECT src_ip, count(*) AS n FROM packets WHERE src_ip IS NOT NULL GROUP BY src_ip
 ORDER BY n DESC, src_ip""",
)
def all_src_sorted(packets):
    return stats.top(stats.value_counts(packets, "src_ip"), "src_ip")


@query(
    "direction_counts",
    f""", d AS (SELECT {sql.packet_direction()} AS packet_direction FROM packets)
SELECT packet_direction, count(*) AS n FROM d WHERE packet_direction IN ('Inbound', 'Outbound', 'Local', 'External')
GROUP BY packet_direction""",
)
def direction_counts(packets):
    return stats.direction_counts(packets)


@query(
    "distinct_counts",
    f""" SELECT 'source_ips' AS field, count(DISTINCT src_ip) AS n_distinct FROM packets
 UNION ALL SELECT 'dest_ips', count(DISTINCT dst_ip) FROM packets
 UNION ALL SELECT 'source_ports', count(DISTINCT src_port) FROM packets WHERE ({sql.TRANSPORT}) IN ('TCP', 'UDP')
 UNION ALL SELECT 'dest_ports', count(DISTINCT dst_port) FROM packets WHERE ({sql.TRANSPORT}) IN ('TCP', 'UDP')
 UNION ALL SELECT 'protocols', count(DISTINCT p) FROM (SELECT protocol AS p FROM packets UNION ALL
  SELECT {sql.TRANSPORT} FROM packets WHERE ({sql.TRANSPORT}) IN ('TCP', 'UDP'))""",
)
def distinct_counts(packets):
    return stats.distinct_counts(packets)


@query("distinct_approx")
def distinct_approx(packets):
    return stats.distinct_counts_approx(packets)


@query(
    "app_counts",
    """ SELECT count(*) FILTER (WHERE protocol = 'HTTP') AS http_packets,
 count(*) FILTER (WHERE protocol = 'DNS') AS dns_packets FROM packets""",
)
def app_counts(packets):
    return stats.app_counts(packets)


_HTTP_TOTAL = "(SELECT count(*) FROM packets WHERE protocol = 'HTTP')"


@query(
    "http_hosts",
    f""" SELECT http_host, count(*) AS n, {_pct(_HTTP_TOTAL)} FROM packets
 WHERE protocol = 'HTTP' AND http_host IS NOT NULL GROUP BY http_host ORDER BY n DESC, http_host LIMIT 10""",
)
def http_hosts(packets):
    return stats.http_hosts(packets)


_SECONDS = "round((epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1000000 AS DOUBLE), 6)"


@query(
    "capture_span",
    f" SELECT min(ts) AS start_ts, max(ts) AS end_ts, {_SECONDS} AS seconds FROM packets",
)
def capture_span(packets):
    return stats.capture_span(packets)


@query(
    "packet_rate",
    f" SELECT count(*) AS total_packets, round(count(*) / {_SECONDS}, 6) AS packet_rate FROM packets",
)
def packet_rate(packets):
    return stats.rates(packets).select("total_packets", "packet_rate")


@query(
    "byte_rate",
    f""" SELECT CAST(sum(length) AS BIGINT) AS total_bytes, {_SECONDS} AS seconds,
 round(CAST(sum(length) AS DOUBLE) / {_SECONDS}, 6) AS byte_rate FROM packets""",
)
def byte_rate(packets):
    return stats.rates(packets).select("total_bytes", "seconds", "byte_rate")


@query(
    "proto_list",
    """ SELECT DISTINCT 1 AS position, protocol FROM packets
 UNION ALL SELECT 0, 'All' UNION ALL SELECT 2, 'Other'""",
)
def proto_list(packets):
    return stats.protocol_menu(packets)


@query(
    "label_counts",
    f", {sql.DETAILED} SELECT CAST(sum(is_threat) AS BIGINT) AS threats, count(*) AS packets FROM detailed",
)
def label_counts(packets):
    return stats.label_counts(detailed_features(packets))


@query(
    "raw_counters",
    """ SELECT count(*) FILTER (WHERE ip_proto = 6) AS tcp_count, count(*) FILTER (WHERE ip_proto = 17) AS udp_count,
 count(*) FILTER (WHERE ip_proto = 1) AS icmp_count, count(*) FILTER (WHERE ip_proto = 2054) AS arp_count,
 count(*) FILTER (WHERE ip_proto NOT IN (1, 6, 17, 2054)) AS other_count, count(*) AS total_count FROM packets""",
)
def raw_counters(packets):
    return stats.raw_counters(packets)


# --- long-form lists and reports ----------------------------------------------------------

_LISTS = f""", src AS (SELECT 'source' AS section, src_ip AS key, count(*) AS n FROM packets GROUP BY src_ip),
dst AS (SELECT 'destination' AS section, dst_ip AS key, count(*) AS n FROM packets GROUP BY dst_ip),
both_ports AS (SELECT 'port' AS section, port, count(*) AS n FROM (SELECT src_port AS port FROM packets
 UNION ALL SELECT dst_port FROM packets) WHERE port IS NOT NULL GROUP BY port),
dst_ports AS (SELECT 'port' AS section, dst_port AS port, count(*) AS n FROM packets
 WHERE ({sql.TRANSPORT}) IN ('TCP', 'UDP') GROUP BY dst_port),
protos AS (SELECT 'protocol' AS section, protocol AS key, count(*) AS n FROM packets GROUP BY protocol),
hosts AS (SELECT 'http_host' AS section, http_host AS key, count(*) AS n FROM packets
 WHERE protocol = 'HTTP' GROUP BY http_host)"""


def _ranked(table: str, k: int | None, key: str = "key", pct: str = "NULL::DOUBLE") -> str:
    where = "" if k is None else f" WHERE rank <= {k}"
    return f"""SELECT section, CAST(rank AS INT) AS rank, CAST({key} AS VARCHAR) AS key, n, {pct} AS pct
 FROM (SELECT *, row_number() OVER (ORDER BY n DESC, {key}) AS rank FROM {table}){where}"""


def _share(total: str, digits: int) -> str:
    return f"round(CAST(100 AS DOUBLE) * n / {total}, {digits})"


_TOTAL_ROW = "SELECT 'total_packets' AS section, 1 AS rank, '' AS key, count(*) AS n, NULL::DOUBLE AS pct FROM packets"


def _class_rows(kind: str, share: bool) -> str:
    parts = []
    for rank, name in enumerate(("TCP", "UDP", "ICMP", "Other"), 1):
        test = f"{kind} = '{name}'" if name != "Other" else f"{kind} NOT IN ('TCP', 'UDP', 'ICMP')"
        count = f"count(*) FILTER (WHERE {test})"
        pct = f"round(CAST(100 AS DOUBLE) * {count} / greatest(count(*), 1), 1)" if share else "NULL::DOUBLE"
        parts.append(f"SELECT 'class', {rank}, '{name}', {count}, {pct} FROM packets")
    return " UNION ALL ".join(parts)


@query(
    "top5_sections",
    f"""{_LISTS} SELECT section, key, n, rank FROM ({_ranked('src', 5)} UNION ALL {_ranked('dst', 5)}
 UNION ALL {_ranked('both_ports', 5, 'port')})""",
)
def top5_sections(packets):
    return stats.top5_sections(packets)


_TRAFFIC = f"""{_LISTS}, report AS ({_TOTAL_ROW}
 UNION ALL {_ranked('protos', None, pct=_share(_TOTAL, 2))} UNION ALL {_ranked('src', 10, pct=_share(_TOTAL, 2))}
 UNION ALL {_ranked('dst', 10, pct=_share(_TOTAL, 2))} UNION ALL {_ranked('hosts', 10, pct=_share(_HTTP_TOTAL, 2))}
 UNION ALL SELECT 'http_requests', 1, '', count(*), NULL FROM packets WHERE protocol = 'HTTP')"""


@query("traffic_report", f"{_TRAFFIC} SELECT section, rank, key, n, pct FROM report")
def traffic_report(packets):
    return reports.traffic_report(packets)


@query(
    "report_lines",
    f"""{_TRAFFIC}, numbered AS (SELECT *, CASE section WHEN 'total_packets' THEN 1 WHEN 'protocol' THEN 2
 WHEN 'source' THEN 3 WHEN 'destination' THEN 4 WHEN 'http_requests' THEN 5 ELSE 6 END AS section_no FROM report)
SELECT section_no, rank AS line_no, CASE section_no WHEN 1 THEN printf('Total Packets: %d', n)
 WHEN 5 THEN printf('  Total HTTP Requests: %d', n)
 WHEN 6 THEN printf('    %s: %d (%.2f%%)', key, n, pct) ELSE printf('  %s: %d (%.2f%%)', key, n, pct) END AS line
FROM numbered UNION ALL SELECT * FROM (VALUES (2, 0, 'Protocol Distribution:'), (3, 0, 'Top Source IPs:'),
 (4, 0, 'Top Destination IPs:'), (5, 0, 'HTTP Statistics:')) UNION ALL
 SELECT 6, 0, '  Top Hosts:' WHERE {_HTTP_TOTAL} > 0""",
)
def report_lines(packets):
    return reports.report_lines(packets)


@query(
    "capture_summary",
    f"""{_LISTS}, rows_(section, rank, key, n, pct) AS ({_TOTAL_ROW} UNION ALL SELECT 'duration_ms', 1, '',
 CAST(round((epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1000 AS DOUBLE)) AS BIGINT), NULL FROM packets
 UNION ALL {_class_rows(f'({sql.TRANSPORT})', True)}
 UNION ALL {_ranked('src', None, pct=_share(_TOTAL, 1))} UNION ALL {_ranked('dst', None, pct=_share(_TOTAL, 1))}
 UNION ALL {_ranked('dst_ports', None, 'port', _share(_TOTAL, 1))}) SELECT section, key, n, pct FROM rows_""",
)
def capture_summary(packets):
    return reports.capture_summary(packets)


@query(
    "viewer_summary",
    f"""{_LISTS} {_TOTAL_ROW} UNION ALL {_class_rows('protocol', False)}
 UNION ALL {_ranked('src', 5)} UNION ALL {_ranked('dst', 5)} UNION ALL {_ranked('both_ports', 5, 'port')}""",
)
def viewer_summary(packets):
    return reports.viewer_summary(packets)


@query(
    "proto_chart",
    f""", c(section, rank, protocol_class, n, pct) AS ({_class_rows('protocol', True)})
SELECT protocol_class, n, pct FROM c WHERE n > 0""",
)
def proto_chart(packets):
    return reports.protocol_chart(packets)
