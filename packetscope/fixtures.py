"""Test relations over the given tables: packets and scored packets.

``PACKETS_SQL`` is plain SQL that reads the same in other engines, so a checker
can use it as the prefix of its own query.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

PACKETS_CTE = """
b AS (SELECT *, event_id % 17 AS k FROM {events}),
packets AS (
 SELECT event_id AS packet_id, ts, user_id,
  CASE WHEN k < 4 THEN 'TCP' WHEN k = 4 THEN 'HTTP' WHEN k = 5 THEN 'TLS' WHEN k = 6 THEN 'UDP'
       WHEN k = 7 THEN 'DNS' WHEN k = 8 THEN 'ICMP' WHEN k = 9 THEN 'ARP' WHEN k = 10 THEN 'HTTP (Raw)'
       WHEN k = 11 THEN 'DHCP' WHEN k = 12 THEN 'SNMP' WHEN k = 13 THEN 'HTTPS' WHEN k = 14 THEN 'FTP'
       WHEN k = 15 THEN 'SSH' ELSE 'TELNET' END AS protocol,
  '02:00:00:00:00:' || lpad(CAST(user_id % 90 AS STRING), 2, '0') AS src_mac,
  CASE WHEN event_id % 97 = 1 THEN 'ff:ff:ff:ff:ff:ff'
       ELSE '02:00:00:00:01:' || lpad(CAST(event_id % 90 AS STRING), 2, '0') END AS dst_mac,
  CASE WHEN event_id % 3 = 1 THEN '198.51.100.' || CAST(user_id % 200 + 1 AS STRING)
       WHEN event_id % 13 = 2 THEN '172.' || CAST(14 + user_id % 20 AS STRING) || '.0.9'
       WHEN event_id % 13 = 3 THEN '8.8.' || CAST(user_id % 4 AS STRING) || '.8'
       ELSE '10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id % 250 + 1 AS STRING) END AS src_ip,
  CASE WHEN event_id % 97 = 1 THEN '255.255.255.255'
       WHEN event_id % 5 = 0 THEN '192.168.1.' || CAST(event_id % 50 + 1 AS STRING)
       ELSE '93.184.' || CAST(event_id % 7 AS STRING) || '.34' END AS dst_ip,
  CASE WHEN k IN (8, 9) THEN NULL ELSE CAST(1024 + (event_id * 37) % 60000 AS INT) END AS src_port,
  CAST(CASE WHEN k IN (8, 9) THEN NULL
       WHEN k < 4 THEN CASE WHEN event_id % 7 = 0 THEN 22 WHEN event_id % 7 = 1 THEN 3389
                            WHEN event_id % 7 = 2 THEN 445 ELSE 5000 + event_id % 100 END
       WHEN k IN (4, 10) THEN CASE WHEN event_id % 4 = 0 THEN 8080 ELSE 80 END
       WHEN k IN (5, 13) THEN 443 WHEN k = 6 THEN 9000 + event_id % 50 WHEN k = 7 THEN 53
       WHEN k = 11 THEN 67 WHEN k = 12 THEN 161 WHEN k = 14 THEN 21 WHEN k = 15 THEN 22 ELSE 23 END AS INT) AS dst_port,
  CAST(40 + (event_id * 19) % 1600 AS INT) AS length,
  CASE WHEN k = 9 THEN NULL ELSE CAST(event_id % 129 AS INT) END AS ttl,
  CASE WHEN k < 6 OR k IN (10, 13, 14, 15, 16) THEN CAST((event_id * 5) % 64 AS INT) ELSE NULL END AS tcp_flags_mask,
  CASE WHEN k < 6 OR k IN (10, 13, 14, 15, 16) THEN CAST((event_id * 53) % 66000 AS INT) ELSE NULL END AS tcp_window,
  CASE WHEN k IN (6, 7, 11, 12) THEN CAST(8 + event_id % 500 AS INT) ELSE NULL END AS udp_length,
  CASE WHEN k = 7 THEN 'h' || CAST(user_id AS STRING) || CASE WHEN event_id % 2 = 0 THEN '.example.com.' ELSE '.Example.XYZ.' END ELSE NULL END AS dns_query,
  CASE WHEN k = 7 THEN CAST(CASE WHEN event_id % 10 = 0 THEN 255 ELSE 1 END AS INT) ELSE NULL END AS dns_qtype,
  CASE WHEN k = 4 THEN CASE WHEN event_id % 3 = 0 THEN 'POST' WHEN event_id % 3 = 1 THEN 'GET' ELSE 'HEAD' END ELSE NULL END AS http_method,
  CASE WHEN k = 4 THEN CASE WHEN event_id % 9 = 0 THEN 'cdn.evil.net' ELSE 'www.example.com' END ELSE NULL END AS http_host,
  CASE WHEN k = 4 THEN CASE WHEN event_id % 6 = 0 THEN '/WP-login.php' ELSE '/index.html' END ELSE NULL END AS http_path,
  CASE WHEN k = 4 THEN CAST(CASE WHEN event_id % 8 = 0 THEN 404 WHEN event_id % 8 = 1 THEN 503 ELSE 200 END AS INT) ELSE NULL END AS http_status,
  CASE WHEN k = 8 THEN CAST(CASE WHEN event_id % 5 = 0 THEN 8 WHEN event_id % 5 = 1 THEN 0 WHEN event_id % 5 = 2 THEN 3 WHEN event_id % 5 = 3 THEN 11 ELSE 42 END AS INT) ELSE NULL END AS icmp_type,
  CASE WHEN k = 8 THEN CAST(CASE WHEN event_id % 5 = 4 THEN 200 WHEN event_id % 5 = 2 THEN event_id % 4 ELSE 0 END AS INT) ELSE NULL END AS icmp_code,
  CASE WHEN k = 9 THEN CASE WHEN event_id % 2 = 0 THEN 'request' ELSE 'reply' END ELSE NULL END AS arp_opcode,
  CASE WHEN k = 11 THEN CAST(1 + event_id % 9 AS INT) ELSE NULL END AS dhcp_type_code,
  CASE WHEN k = 12 THEN CAST(event_id % 10 AS INT) ELSE NULL END AS snmp_pdu_code,
  CASE WHEN k = 5 THEN CAST(768 + event_id % 5 AS INT) ELSE NULL END AS tls_version,
  CASE WHEN k = 5 THEN CAST(20 + event_id % 4 AS INT) ELSE NULL END AS tls_content_type,
  CASE WHEN k = 5 AND event_id % 4 = 2 THEN CAST(1 + event_id % 3 AS INT) ELSE NULL END AS tls_handshake_type,
  CAST(CASE WHEN event_id % 19 = 0 THEN 17 WHEN k IN (6, 7, 11, 12) THEN 17 WHEN k = 8 THEN 1 WHEN k = 9 THEN 2054
       WHEN event_id % 23 = 0 THEN 200 WHEN event_id % 29 = 0 THEN 4 ELSE 6 END AS INT) AS ip_proto,
  CASE WHEN event_id % 41 = 0 THEN 'N/A' WHEN event_id % 43 = 0 THEN '' WHEN event_id % 47 = 0 THEN 'None'
       WHEN event_id % 53 = 0 THEN '80.0' ELSE CAST(1024 + (event_id * 37) % 60000 AS STRING) END AS src_port_raw
 FROM b)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "events.parquet"))


def packets_from(source: DataFrame) -> DataFrame:
    """The packets projection of an events table or stream."""
    text = f"WITH {PACKETS_CTE} SELECT * FROM packets"
    return source.sparkSession.sql(text, events=source)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from(events(spark, sf_dir))
