"""Dictionary lookups as broadcast joins.

Every dimension here is a literal table of at most 147 rows, so broadcasting it
is safe at any data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetscope.constants import (
    ARP_OPCODES,
    DHCP_PORTS,
    DHCP_TYPES,
    DNS_PORTS,
    HTTP_PORTS,
    ICMP_MEANINGS,
    PORT_SERVICES,
    PROTOCOL_DESCRIPTIONS,
    PROTOCOL_FAMILIES,
    PROTOCOL_SHORT_NAMES,
    SNMP_PDUS,
    SNMP_PORTS,
    TLS_PORTS,
)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def dimension(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A literal table (planned as a local scan, no job needed to build it)."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def _join_name(
    df: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str, name: str
) -> DataFrame:
    side = F.broadcast(dim.select(F.col(dim_key).alias("__k"), F.col(value).alias(name)))
    return df.join(side, df[key] == F.col("__k"), "left").drop("__k")


def protocol_dimension(spark: SparkSession) -> DataFrame:
    """number, short_name (usual numbers only) and description."""
    short = dict(PROTOCOL_SHORT_NAMES)
    rows = [(n, short.get(n), text) for n, text in PROTOCOL_DESCRIPTIONS]
    return dimension(spark, rows, ["number", "short_name", "description"])


def with_protocol_name(df: DataFrame, number: str = "ip_proto") -> DataFrame:
    """Add protocol_name, protocol_short (first word) and protocol_description."""
    dim = protocol_dimension(df.sparkSession).withColumnRenamed("number", "__n")
    joined = df.join(F.broadcast(dim), df[number] == F.col("__n"), "left")
    unknown = F.concat(F.lit("Unknown Protocol ("), df[number].cast("string"), F.lit(")"))
    name = F.coalesce(F.col("short_name"), F.col("description"), unknown)
    return joined.select(
        df["*"],
        name.alias("protocol_name"),
        F.split_part(name, F.lit(" "), F.lit(1)).alias("protocol_short"),
        F.coalesce(F.col("description"), unknown).alias("protocol_description"),
    )


def protocol_fallback(number: Column) -> Column:
    """Name of the three usual IP payloads, else the number as text."""
    return (
        F.when(number == 1, F.lit("ICMP"))
        .when(number == 6, F.lit("TCP"))
        .when(number == 17, F.lit("UDP"))
        .otherwise(number.cast("string"))
    )


def with_port_services(df: DataFrame) -> DataFrame:
    """Add src_service and dst_service, NULL for ports with no known use."""
    ports = dimension(df.sparkSession, PORT_SERVICES, ["port", "service"])
    named = _join_name(df, ports, "src_port", "port", "service", "src_service")
    return _join_name(named, ports, "dst_port", "port", "service", "dst_service")


def _with_code_name(df: DataFrame, rows: list[tuple], code: str, name: str) -> DataFrame:
    dim = dimension(df.sparkSession, rows, ["code", "text"])
    joined = _join_name(df, dim, code, "code", "text", name)
    return joined.withColumn(name, F.coalesce(F.col(name), F.col(code).cast("string")))


def with_dhcp_name(df: DataFrame, code: str = "dhcp_type_code", name: str = "dhcp_type") -> DataFrame:
    return _with_code_name(df, DHCP_TYPES, code, name)


def with_snmp_name(df: DataFrame, code: str = "snmp_pdu_code", name: str = "snmp_pdu") -> DataFrame:
    return _with_code_name(df, SNMP_PDUS, code, name)


def with_arp_name(df: DataFrame, code: str = "arp_op", name: str = "arp_opcode") -> DataFrame:
    return _with_code_name(df, ARP_OPCODES, code, name)


def with_icmp_meaning(df: DataFrame) -> DataFrame:
    """Add icmp_meaning: the entry for (type, code), else the one for the type alone."""
    spark = df.sparkSession
    exact = dimension(
        spark, [r for r in ICMP_MEANINGS if r[1] is not None], ["t", "c", "exact_meaning"]
    )
    general = dimension(
        spark, [(t, m) for t, c, m in ICMP_MEANINGS if c is None], ["g", "general_meaning"]
    )
    return (
        df.join(
            F.broadcast(exact), (df.icmp_type == F.col("t")) & (df.icmp_code == F.col("c")), "left"
        )
        .join(F.broadcast(general), df.icmp_type == F.col("g"), "left")
        .withColumn("icmp_meaning", F.coalesce("exact_meaning", "general_meaning"))
        .drop("t", "c", "g", "exact_meaning", "general_meaning")
    )


def with_protocol_family(df: DataFrame) -> DataFrame:
    """Add protocol_family: full name of the usual protocols, else ``specialized``."""
    dim = dimension(df.sparkSession, PROTOCOL_FAMILIES, ["family_key", "protocol_family"])
    joined = df.join(F.broadcast(dim), F.upper(df.protocol) == F.col("family_key"), "left")
    return joined.drop("family_key").withColumn(
        "protocol_family", F.coalesce("protocol_family", F.lit("specialized"))
    )


def _either(src: Column, dst: Column, ports: list[int]) -> Column:
    return F.coalesce(src.isin(ports), F.lit(False)) | F.coalesce(dst.isin(ports), F.lit(False))


def protocol_by_port(transport: Column, src_port: Column, dst_port: Column) -> Column:
    """Well-known protocol a port pair points to, in the order the writers test them.

    On TCP a TLS port overrides an HTTP port; on UDP the first of DNS, DHCP and
    SNMP wins. Otherwise the transport itself.
    """
    return (
        F.when(
            transport == "TCP",
            F.when(_either(src_port, dst_port, TLS_PORTS), F.lit("TLS"))
            .when(_either(src_port, dst_port, HTTP_PORTS), F.lit("HTTP"))
            .otherwise(transport),
        )
        .when(
            transport == "UDP",
            F.when(_either(src_port, dst_port, DNS_PORTS), F.lit("DNS"))
            .when(_either(src_port, dst_port, DHCP_PORTS), F.lit("DHCP"))
            .when(_either(src_port, dst_port, SNMP_PORTS), F.lit("SNMP"))
            .otherwise(transport),
        )
        .otherwise(transport)
    )


def transport_of(protocol: Column) -> Column:
    """Transport layer under a protocol label: TCP, UDP, ICMP or Other."""
    return (
        F.when(
            protocol.isin("TCP", "HTTP", "HTTP (Raw)", "TLS", "HTTPS", "FTP", "SSH", "TELNET", "SFTP"),
            F.lit("TCP"),
        )
        .when(protocol.isin("UDP", "DNS", "DHCP", "SNMP"), F.lit("UDP"))
        .when(protocol == "ICMP", F.lit("ICMP"))
        .otherwise(F.lit("Other"))
    )
