import os
import struct

import pytest
from pyspark.sql import functions as F

from packetscope.operators.encode import frames
from packetscope.session import scratch_path, shared_dir
from packetscope.sources import captures, pcap
from packetscope.sources.layouts import LAYOUTS, LayoutError, detect_layout, to_layout
from packetscope.sources.pcap import read_pcap, write_pcap

FIELDS = ["src_ip", "dst_ip", "length", "ttl"]


@pytest.mark.parametrize("layout", list(LAYOUTS))
def test_layout_round_trip(spark, packets, layout):
    path = scratch_path(spark, f"test-{layout}")
    captures.write_capture(packets, path, layout)
    back = captures.read_capture(spark, path, layout).select(*FIELDS)
    assert back.exceptAll(packets.select(*FIELDS)).count() == 0
    assert back.count() == packets.count()


def test_written_headers(spark, packets):
    for layout, columns in LAYOUTS.items():
        assert to_layout(packets, layout).columns == columns


def test_detection():
    assert detect_layout(["a", "DNS QName"]) == "detailed"
    assert detect_layout(LAYOUTS["basic"]) == "basic"
    assert detect_layout([]) == "basic"


def test_errors(spark, packets, tmp_path):
    with pytest.raises(LayoutError):
        captures.read_capture(spark, str(tmp_path / "missing"))
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(LayoutError):
        captures.read_capture(spark, str(empty))
    with pytest.raises(LayoutError):
        to_layout(packets, "nonsense")
    assert captures.detect_source_type(spark, str(tmp_path / "missing")) == "basic"


def test_header_aliases_and_quoting(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(
        'Time,src_IP,Destination IP,proto,size,Flags,http path,Raw\n'
        '2024-01-01 10:00:00,10.0.0.1,8.8.8.8,TCP,60.0,SYN ACK,"/a,""b""","[1, 2]"\n'
        ",,,,,,,\n"
    )
    rows = captures.read_capture(spark, str(path)).collect()
    first = rows[0]
    assert (first.src_ip, first.dst_ip, first.protocol, first.length) == ("10.0.0.1", "8.8.8.8", "TCP", 60)
    assert first.tcp_flags_mask == 18 and first.http_path == '/a,"b"' and first.raw_data == "[1, 2]"


def test_detailed_writer_makes_no_file_for_no_rows(spark, packets):
    path = scratch_path(spark, "none")
    captures.write_capture(packets.filter("packet_id < 0"), path, "detailed")
    assert not os.path.exists(path)


def test_features_of_a_detailed_file(spark, packets):
    path = scratch_path(spark, "detailed")
    captures.write_capture(packets, path, "detailed")
    assert captures.detect_source_type(spark, path) == "detailed"
    table = captures.load_features(spark, path)
    assert "tls_is_client_hello" in table.columns and table.count() == packets.count()


def test_newest_file(spark, tmp_path):
    for i, name in enumerate(("b.csv", "a.csv", "c.txt")):
        (tmp_path / name).write_text("x\n")
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    assert captures.newest_file(spark, str(tmp_path)).endswith("a.csv")
    assert captures.newest_file(spark, str(tmp_path), "*.none") is None


def test_pcap_round_trip(spark, packets):
    path = scratch_path(spark, "pcap")
    sent = frames(packets).repartition(3)
    write_pcap(sent, path)
    got = read_pcap(spark, path)
    assert got.rdd.getNumPartitions() == 3
    want = sent.select(F.col("ts").cast("timestamp").alias("ts"), F.hex("frame").alias("h"))
    assert got.select("ts", F.hex("frame").alias("h")).exceptAll(want).count() == 0
    assert got.count() == packets.count()


@pytest.mark.parametrize("order,magic,fraction", [(">", 0xA1B2C3D4, 250), ("<", 0xA1B23C4D, 250_000)])
def test_pcap_byte_orders_and_nanoseconds(spark, tmp_path, order, magic, fraction):
    head = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    record = struct.pack(order + "IIII", 1700000000, fraction, 3, 99) + b"abc"
    (tmp_path / "x.pcap").write_bytes(head + record * 2)
    rows = read_pcap(spark, str(tmp_path)).select("packet_id", F.unix_micros("ts").alias("us"), "frame").collect()
    assert [r.packet_id for r in rows] == [1, 2]
    assert rows[0].us == 1700000000000250 and bytes(rows[0].frame) == b"abc"


def capture_bytes(sizes, first=0):
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    body = b"".join(
        struct.pack("<IIII", first + i, 0, n, n) + bytes([i % 256]) * n for i, n in enumerate(sizes)
    )
    return head + body


def test_one_capture_is_read_by_several_tasks(spark, tmp_path):
    sizes = [(i * 37) % 1400 for i in range(3000)] + [60_000, 0, 2_000_000, 0]
    (tmp_path / "b.pcap").write_bytes(capture_bytes(sizes))
    (tmp_path / "a.pcap").write_bytes(capture_bytes([5, 6], first=9000))
    (tmp_path / "c.pcap").write_bytes(capture_bytes([]))
    (tmp_path / "d.pcap").write_bytes(capture_bytes([7], first=9100))
    index = pcap.pcap_index(spark, str(tmp_path), 100_000).collect()
    assert len([r for r in index if r.path.endswith("b.pcap")]) > 20
    assert sum(r.packets for r in index) == len(sizes) + 3
    for range_bytes in (100_000, 1 << 30):
        got = read_pcap(spark, str(tmp_path), range_bytes)
        rows = sorted(
            (r.packet_id, r.us // 1_000_000, bytes(r.frame))
            for r in got.select("packet_id", F.unix_micros("ts").alias("us"), "frame").collect()
        )
        want = [(9000, b"\0" * 5), (9001, b"\1" * 6)]
        want += [(i, bytes([i % 256]) * n) for i, n in enumerate(sizes)] + [(9100, b"\0" * 7)]
        assert rows == [(n, at, frame) for n, (at, frame) in enumerate(want, 1)]
    assert read_pcap(spark, str(tmp_path), 100_000).rdd.getNumPartitions() > 4
    assert read_pcap(spark, str(tmp_path / "c.pcap")).count() == 0


def test_batches_are_bounded_by_bytes():
    records = [(0, b"x" * 60_000)] * 500 + [(0, b"")] * 20_000
    batches = list(pcap._batches(iter(records), 1))
    assert sum(b.num_rows for b in batches) == len(records)
    assert all(b.num_rows <= pcap.ROWS_PER_BATCH and b.nbytes < pcap.BYTES_PER_BATCH + 500_000 for b in batches)
    assert [i for b in batches for i in b.column(0).to_pylist()] == list(range(1, len(records) + 1))


def test_plain_source_reads_a_file_a_partition(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.pcap").write_bytes(capture_bytes([4, 0, 9]))
    pcap.register(spark)
    got = spark.read.format("pcap").load(str(tmp_path))
    assert sorted(r.packet_id for r in got.collect()) == [1, 1, 2, 2, 3, 3]


def test_broken_pcap_is_an_error(spark, tmp_path):
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    (tmp_path / "cut.pcap").write_bytes(head + struct.pack("<IIII", 1, 1, 50, 50) + b"short")
    with pytest.raises(Exception, match="ends inside packet 1"):
        read_pcap(spark, str(tmp_path)).collect()


def test_estimates(spark, tmp_path):
    for name, size in (("a.pcap", 24 + 640), ("b.pcap", 24), ("c.pcap", 10)):
        (tmp_path / name).write_bytes(b"\0" * size)
    rows = captures.estimate_packets(captures.pcap_sizes(spark, str(tmp_path))).collect()
    assert sorted((r.body_bytes, r.estimated_packets) for r in rows) == [(0, 1), (640, 10)]


def test_scratch_is_under_the_named_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))


def test_packets_are_numbered_in_file_order(spark, packets):
    path = scratch_path(spark, "numbered")
    captures.write_capture(packets.orderBy("packet_id").coalesce(1), path, "detailed")
    rows = captures.read_numbered(spark, path)
    got = [r.src_ip for r in rows.orderBy("packet_id").select("src_ip").collect()]
    assert got == [r.src_ip for r in packets.orderBy("packet_id").select("src_ip").collect()]
    assert rows.agg(F.min("packet_id"), F.max("packet_id")).first() == (1, packets.count())


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("source_ip,length\n10.0.0.1,60\n")
    (tmp_path / "b.csv").write_text("length,source_ip\n60,10.0.0.1\n")
    with pytest.raises(Exception, match="header"):
        captures.read_capture(spark, str(tmp_path)).select("src_ip", "length").collect()


def test_numbers_do_not_depend_on_how_files_are_cut(spark, tmp_path):
    want, number = [], 0
    for name in ("b.csv", "a.csv", "c.csv"):
        (tmp_path / name).write_text("source_ip,length,http_path\n")
    for file, name in enumerate(("a.csv", "b.csv", "c.csv")):
        with open(tmp_path / name, "a") as out:
            for i in range(700 if file < 2 else 0):
                number += 1
                if i % 11 == 5:
                    out.write("\n")
                    continue
                out.write(f'10.{file}.0.1,{i},"/{"x" * (i % 90)},""q"""\n')
                want.append((number, f"10.{file}.0.1", i, f'/{"x" * (i % 90)},"q"'))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1000", "7777", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = captures.read_numbered(spark, str(tmp_path))
            got = rows.select("packet_id", "src_ip", "length", "http_path").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert sorted(map(tuple, got)) == want


def test_numbering_refuses_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("source_ip,length\n10.0.0.1,60\n")
    (tmp_path / "b.csv").write_text("length,source_ip\n60,10.0.0.1\n")
    with pytest.raises(Exception, match="header"):
        captures.read_numbered(spark, str(tmp_path)).collect()


def test_numbering_a_capture_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("source_ip,length\n")
    assert captures.read_numbered(spark, str(tmp_path / "a.csv")).count() == 0
