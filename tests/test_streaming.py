import os

import pytest
from pyspark.sql import functions as F

from packetscope.constants import BASIC_COLUMNS
from packetscope.fixtures import events, packets_from
from packetscope.operators.stats import section_counts
from packetscope.session import scratch_path
from packetscope.sources.captures import read_capture, write_capture
from packetscope.streaming import jobs
from packetscope.streaming.partials import Partials


@pytest.fixture()
def landing(spark, sf_dir):
    """The events in four files."""
    path = scratch_path(spark, "landing")
    events(spark, sf_dir).repartition(4).write.parquet(path)
    return path


def stream(spark, path, per_trigger=1):
    return packets_from(jobs.stream_events(spark, path, "*.parquet", per_trigger))


def batches(out):
    return len([n for n in os.listdir(os.path.join(out, "partial")) if n.startswith("batch=")])


def test_totals_add_up_over_batches_and_restarts(spark, sf_dir, packets, landing):
    out = scratch_path(spark, "totals")
    jobs.running_totals(stream(spark, landing), out)
    assert batches(out) == 4
    want = section_counts(jobs.with_classes(packets), jobs.TOTAL_SECTIONS)
    assert jobs.read_totals(spark, out).exceptAll(want).count() == 0
    # more files arrive; the same checkpoint takes only those
    events(spark, sf_dir).write.mode("append").parquet(landing)
    jobs.running_totals(stream(spark, landing), out)
    twice = {(r.section, r.key): r.n for r in jobs.read_totals(spark, out).collect()}
    assert twice == {(r.section, r.key): 2 * r.n for r in want.collect()}


def test_ingest_drains_everything(spark, packets, landing):
    out = scratch_path(spark, "ingest")
    jobs.ingest_csv(stream(spark, landing), out)
    rows = read_capture(spark, os.path.join(out, "rows"))
    assert rows.count() == packets.count()
    assert rows.select("src_ip", "dst_port").exceptAll(packets.select("src_ip", "dst_port")).count() == 0


def test_findings_on_a_stream_equal_those_on_the_table(spark, packets, landing):
    out = scratch_path(spark, "findings")
    jobs.stream_findings(stream(spark, landing), out)
    got = spark.read.parquet(os.path.join(out, "rows"))
    assert got.exceptAll(jobs.annotate(packets)).count() == 0 and got.count() == packets.count()


def test_csv_landing_folder(spark, packets):
    folder, out = scratch_path(spark, "csv"), scratch_path(spark, "out")
    write_capture(packets.repartition(3), folder, "basic")
    rows = jobs.stream_csv(spark, folder, BASIC_COLUMNS, per_trigger=1).select("src_ip", "dst_ip", "length")
    jobs.append_rows(rows, out)
    got = spark.read.parquet(os.path.join(out, "rows"))
    assert got.exceptAll(packets.select("src_ip", "dst_ip", "length")).count() == 0
    assert got.count() == packets.count()


def test_live_view_hands_out_every_packet_in_pages(spark, packets, landing):
    seen = []
    jobs.live_view(stream(spark, landing), lambda page, number: seen.append((number, page)), rows=20)
    assert {n for n, _ in seen} == {0, 1, 2, 3} and all(len(p) <= 20 for _, p in seen)
    ids = [r.packet_id for _, page in seen for r in page]
    assert sorted(ids) == sorted(r.packet_id for r in packets.select("packet_id").collect())


def test_rates_lose_no_packet_however_late(spark, packets, sf_dir):
    """Four files in descending order of time, one per batch."""
    path, out = scratch_path(spark, "late"), scratch_path(spark, "rates")
    ordered = events(spark, sf_dir).orderBy(F.desc("ts"))
    parts = [r.ts for r in ordered.select("ts").collect()][249:750:250]
    bounds = [None, *parts, None]
    for newer, older in zip(bounds, bounds[1:]):
        part = events(spark, sf_dir)
        part = part if newer is None else part.where(F.col("ts") < F.lit(newer))
        part = part if older is None else part.where(F.col("ts") >= F.lit(older))
        part.coalesce(1).write.mode("append").parquet(path)
    jobs.packet_rates(stream(spark, path), out)
    assert batches(out) == 4
    got, want = jobs.read_rates(spark, out), jobs.window_counts(packets)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.agg(F.sum("n")).first()[0] == packets.count()


def tables(out, name):
    folder = os.path.join(out, name)
    return sorted(os.listdir(folder)) if os.path.exists(folder) else []


def test_fifty_batches_leave_a_bounded_number_of_tables(spark):
    out = scratch_path(spark, "partials")
    partials = Partials(out, ["key"], ["n"], every=8)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n long").coalesce(1)
    most = 0
    for number in range(50):
        partials.write(rows, number)
        most = max(most, len(tables(out, "partial")) + len(tables(out, "merged")))
        if number in (7, 8, 9, 31, 49):
            got = {r.key: r.n for r in partials.read(spark).collect()}
            assert got == {"a": number + 1, "b": 2 * (number + 1)}
    assert most <= 2 * 8 + 2 + 1


def test_a_repeated_batch_is_counted_once(spark, monkeypatch):
    out = scratch_path(spark, "partials")
    partials = Partials(out, ["key"], ["n"], every=4)
    rows = spark.createDataFrame([("a", 1)], "key string, n long").coalesce(1)
    for number in (0, 1, 2, 3, 3, 4, 4, 5):
        partials.write(rows, number)
    assert partials.read(spark).first()["n"] == 6
    # the batch that merges fails before, in the middle of and after the merge, and is repeated
    for number in (6, 7):
        partials.write(rows, number)
    unfinished = os.path.join(out, "merged", "upto=8")
    rows.write.parquet(unfinished)
    os.remove(os.path.join(unfinished, "_SUCCESS"))
    assert partials.read(spark).first()["n"] == 8
    partials._merge(spark, 8)
    assert partials.read(spark).first()["n"] == 8
    for _ in range(2):
        partials.write(rows, 8)
    assert partials.read(spark).first()["n"] == 9


def test_a_stopped_view_goes_on_where_it_was(spark, packets, landing):
    state, shown, calls = scratch_path(spark, "view"), [], [0]

    def show(page, number):
        calls[0] += 1
        if calls[0] in (3, 4, 9):
            raise RuntimeError("closed")
        shown.extend(r["packet_id"] for r in page)

    for _ in range(3):
        with pytest.raises(Exception, match="closed"):
            jobs.live_view(stream(spark, landing).select("packet_id", "ts"), show, 60, state)
    jobs.live_view(stream(spark, landing).select("packet_id", "ts"), show, 60, state)
    assert sorted(shown) == sorted(r["packet_id"] for r in packets.select("packet_id").collect())
    # nothing new, nothing shown
    jobs.live_view(stream(spark, landing).select("packet_id", "ts"), show, 60, state)
    assert len(shown) == packets.count()
