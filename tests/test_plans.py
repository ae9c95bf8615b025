"""Numbering, running sums and the split, on fixtures with one dominating key."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from packetscope.operators import stats
from packetscope.operators.metrics import auc, class_report, evaluate, roc_points, score_histogram
from packetscope.plans.ordered import number_rows, running_totals
from packetscope.plans.reports import capture_summary, report_lines, traffic_report
from packetscope.plans.split import stratified_split


def hot_rows(n=2000):
    """A third of the rows share one time stamp."""
    draw = random.Random(7)
    return [(i, 5 if i % 3 == 0 else draw.randrange(50)) for i in range(n)]


def test_numbers_follow_the_order(spark):
    rows = hot_rows()
    frame = spark.createDataFrame(rows, "id long, t int").repartition(7)
    got = {r.id: r.no for r in number_rows(frame, [F.col("t"), F.col("id")], "no").collect()}
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    assert got == want


def test_running_totals_over_ranges(spark):
    rows = hot_rows()
    frame = spark.createDataFrame(rows, "id long, t int").repartition(5)
    got = {
        r.id: r.upto
        for r in running_totals(frame, [F.desc("t"), F.col("id")], {"t": "upto"}).collect()
    }
    total, want = 0, {}
    for i, t in sorted(rows, key=lambda r: (-r[1], r[0])):
        total += t
        want[i] = total
    assert got == want


def test_numbering_an_empty_table(spark):
    frame = spark.createDataFrame([], "id long, t int")
    assert number_rows(frame, [F.col("id")], "no").count() == 0


def test_split_is_exact_per_class_and_repeatable(spark):
    rows = [(i, int(i % 10 == 0)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, label int").repartition(6)
    got = {r.id: r.is_train for r in stratified_split(frame, "id", "label").collect()}
    for label in (0, 1):
        members = [i for i, l in rows if l == label]
        ranked = sorted(members, key=lambda i: (hashlib.md5(f"{i}42".encode()).hexdigest(), i))
        keep = set(ranked[: len(members) * 7 // 10])
        assert {i for i in members if got[i] == 1} == keep


def test_split_of_tiny_and_single_classes(spark):
    frame = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, label int")
    got = {r.id: r.is_train for r in stratified_split(frame, "id", "label").collect()}
    assert got[1] == 0 and got[2] + got[3] == 1


def counted_reads(spark, frame):
    """The frame, and a counter of the rows that were worked out."""
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    return frame.mapInArrow(count, frame.schema), reads


def test_split_works_rows_out_once(spark):
    frame = spark.range(5000).selectExpr("id", "cast(id % 3 = 0 as int) label", "id * 2 other")
    source, reads = counted_reads(spark, frame)
    assert stratified_split(source, "id", "label").agg(F.sum("is_train"), F.sum("other")).count() == 1
    assert reads.value == 5000


@pytest.mark.parametrize("report", [traffic_report, report_lines, capture_summary])
def test_reports_read_the_packets_once(spark, packets, report):
    source, reads = counted_reads(spark, packets)
    result = report(source)
    assert result.count() > 5
    assert reads.value == packets.count()
    # only top lists are ranked, and cut to their length before the shuffle
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Window " not in plan or "WindowGroupLimit" in plan


def test_protocol_labels_are_ranked_whole(spark, packets):
    many = packets.withColumn("protocol", F.concat(F.lit("P"), F.col("packet_id") % 700))
    rows = traffic_report(many, 3).filter("section = 'protocol'").orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and len(rows) > 10
    assert [(-r.n, r.key) for r in rows] == sorted((-r.n, r.key) for r in rows)


def test_reports_of_an_empty_capture(spark, packets):
    empty = packets.filter("packet_id < 0")
    assert {(r.section, r.n) for r in traffic_report(empty).collect()} == {("total_packets", 0), ("http_requests", 0)}
    assert {r.n for r in capture_summary(empty).collect()} == {0}


def test_split_by_longer_prefixes_and_repeated_keys(spark):
    rows = [(i % 700, int(i % 10 == 0)) for i in range(3000)] + [(9999, 1)] * 500
    frame = spark.createDataFrame(rows, "id long, label int").repartition(6)
    once = stratified_split(frame, "id", "label")
    deep = stratified_split(frame, "id", "label", few=0)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, deep.collect()))
    got = {(r.id, r.label): r.is_train for r in deep.collect()}
    for label in (0, 1):
        ranked = sorted((hashlib.md5(f"{i}42".encode()).hexdigest(), i) for i, l in rows if l == label)
        last = ranked[len(ranked) * 7 // 10 - 1]
        assert {i for (i, l), t in got.items() if l == label and t} == {i for h, i in ranked if (h, i) <= last}


def test_split_without_classes_or_rows(spark):
    frame = spark.createDataFrame([(1, None), (2, None)], "id long, label int")
    assert [r.is_train for r in stratified_split(frame, "id", "label").collect()] == [0, 0]
    assert stratified_split(frame.limit(0), "id", "label").count() == 0


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, score double")


def test_auc_matches_pair_counting(spark):
    draw = random.Random(3)
    rows = [(int(s + draw.random() > 0.9), int(s > 0.5), round(s, 2)) for s in (draw.random() for _ in range(400))]
    pos = [s for l, _, s in rows if l == 1]
    neg = [s for l, _, s in rows if l == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert auc(scored(spark, rows)).first().auc == round(wins / (len(pos) * len(neg)), 6)


def test_auc_and_roc_need_both_classes(spark):
    frame = scored(spark, [(1, 1, 0.5), (1, 1, 0.7)])
    assert auc(frame).first().auc is None
    assert {r.tpr for r in roc_points(frame).collect()} == {None}


def test_report_without_a_class_has_zero_rates(spark):
    rows = {r["class"]: r for r in class_report(scored(spark, [(1, 0, 0.1), (1, 0, 0.2)])).collect()}
    assert rows["1"].recall == 0.0 and rows["0"].precision == 0.0 and rows["0"].support == 0
    values = {r.metric: r.value for r in evaluate(scored(spark, [(1, 1, 0.9), (0, 1, 0.8)])).collect()}
    assert values["accuracy"] == 0.5 and values["confusion 0 1"] == 1.0


def test_histogram_of_one_value(spark):
    rows = score_histogram(scored(spark, [(1, 1, 0.5)] * 3)).collect()
    assert len(rows) == 20 and sum(r.n for r in rows) == 3


def test_classes_sum_to_total(packets):
    for frame in (stats.class_counts_exact(packets), stats.class_counts_layer(packets)):
        r = frame.first()
        assert r.tcp_packets + r.udp_packets + r.icmp_packets + r.other_packets == r.total_packets


def test_top_list_breaks_ties_by_key(spark):
    frame = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "k string")
    got = [(r.k, r.n) for r in stats.top(stats.value_counts(frame, "k"), "k", 2).collect()]
    assert got == [("c", 2), ("a", 1)]


def test_share_counts_rows_without_a_key(spark):
    frame = spark.createDataFrame([("a",), (None,), (None,), ("",)], "protocol string")
    row = stats.protocol_distribution(frame).first()
    assert (row.protocol, row.n, row.pct) == ("a", 1, 25.0)


def test_empty_capture_has_no_share_and_no_rate(spark, packets):
    empty = packets.filter("packet_id < 0")
    assert stats.protocol_distribution(empty.drop("protocol")).first().pct is None
    assert stats.rates(empty).first().packet_rate == 0.0
