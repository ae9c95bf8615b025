"""packetscope: packet-log analytics as Spark DataFrame, SQL and streaming jobs."""
