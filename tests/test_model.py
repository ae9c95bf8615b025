import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from packetscope.operators import model
from packetscope.operators.features import DETAILED_FEATURES, detailed_features
from packetscope.operators.metrics import auc
from packetscope.plans.comparison import compare_captures
from packetscope.session import scratch_path, written
from packetscope.sources.captures import write_capture


@pytest.fixture(scope="module")
def table(packets):
    return written(detailed_features(packets), "features")


@pytest.fixture(scope="module")
def fitted(table):
    return model.split_and_train(table, "detailed", trees=8, depth=5)


def test_predictions_are_sound(fitted, table):
    threat, predicted = fitted
    scored = model.as_scored(predicted)
    assert scored.filter("score < 0 OR score > 1 OR prediction NOT IN (0, 1)").count() == 0
    assert 0.25 < scored.count() / table.count() < 0.35
    assert threat.feature_columns == DETAILED_FEATURES


def test_same_seed_same_scores(fitted, table):
    _, again = model.split_and_train(table, "detailed", trees=8, depth=5)
    a, b = model.as_scored(fitted[1]), model.as_scored(again)
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("with_id", [True, False])
def test_same_forest_under_other_settings(spark, table, with_id):
    rows = table if with_id else table.drop("packet_id")
    forests = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions, moved in (("3", rows.repartition(2)), ("11", rows.repartition(9))):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        forests.append(model.train(moved, "detailed", trees=4, depth=4).forest.toDebugString.split("\n", 1)[1])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert forests[0] == forests[1]


def test_rows_without_an_id_all_stay(spark):
    rows = spark.range(10_000).selectExpr("cast(if(id % 3 = 0, 7, id % 50) as int) x", "cast(null as string) y")
    steady = model._steady(rows, 10_000)
    assert steady.exceptAll(rows).count() == 0 and rows.exceptAll(steady).count() == 0
    sizes = [r[1] for r in steady.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 9000


def test_auc_agrees_with_the_evaluator(fitted):
    scored = written(model.as_scored(fitted[1]), "scored")
    other = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label").evaluate(
        scored.withColumn("label", F.col("label").cast("double"))
    )
    assert auc(scored).first().auc == pytest.approx(other, abs=1e-5)


def test_importances_name_every_input(fitted):
    rows = fitted[0].importances(None).collect()
    assert sum(r.importance for r in rows) == pytest.approx(1.0)
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)
    assert any(r.feature.startswith("protocol_str=") for r in rows)
    assert fitted[0].importances(10).count() == 10


def test_save_and_load(spark, fitted, table):
    path = scratch_path(spark, "model")
    fitted[0].save(path)
    loaded = model.ThreatModel.load(path)
    assert loaded.feature_columns == fitted[0].feature_columns and loaded.source_type == "detailed"
    a = fitted[0].predict(table).select("packet_id", "score")
    assert a.exceptAll(loaded.predict(table).select("packet_id", "score")).count() == 0
    with pytest.raises(FileNotFoundError):
        model.ThreatModel.load(path + "-missing")
    with pytest.raises(ValueError):
        model.ThreatModel([], "basic").save(path)


def test_missing_features_and_new_protocols_still_score(fitted, table):
    odd = table.drop("is_tcp").withColumn("protocol_str", F.lit("NEVER SEEN"))
    assert fitted[0].predict(odd).filter("score IS NULL").count() == 0


def test_one_class(spark, table):
    for only in (0, 1):
        threat = model.train(table.filter(f"is_threat = {only}"), "detailed", trees=2)
        row = threat.predict(table.limit(1)).first()
        assert (row.prediction, row.score) == (only, float(only))
        path = scratch_path(spark, "single")
        threat.save(path)
        assert model.ThreatModel.load(path).single_class == only


def test_unseen_text_has_no_slot(spark):
    train = spark.createDataFrame([("a",), ("b",), ("b",)], "p string")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "p string")
    got = {r.p: r.hot_slot for r in model.one_hot(train, rows, "p").collect()}
    assert got == {"b": 0, "a": 1, "c": -1}


def test_rare_text_shares_the_slot_of_unseen_text(spark):
    train = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("c",), (None,)], "p string")
    got = {r.p: r.hot_slot for r in model.one_hot(train, train, "p", most=2).collect()}
    assert got == {"b": 0, "c": 1, "a": -1, None: -1}
    nothing = model.one_hot(train.limit(0), train, "p")
    assert {r.hot_slot for r in nothing.collect()} == {-1}


def test_zscore_without_spread(spark):
    frame = spark.createDataFrame([(5,), (5,)], "x int")
    assert {r.x_z for r in model.zscores(frame, ["x"]).collect()} == {0.0}


def test_comparison_of_two_capture_files(spark, packets):
    basic, detailed = scratch_path(spark, "basic"), scratch_path(spark, "detailed")
    write_capture(packets, basic, "basic")
    write_capture(packets, detailed, "detailed")
    out = scratch_path(spark, "comparison")
    row = compare_captures(spark, basic, detailed, out, trees=4, depth=4).first()
    assert (row.basic_features, row.detailed_features, row.feature_gain) == (27, 44, 17)
    assert model.ThreatModel.load(out + "/basic_model").source_type == "basic"
    lines = [r.value for r in spark.read.text(out + "/comparison_results").collect()]
    assert lines[3] == f"Accuracy: {row.basic_accuracy:.4f}" and "Feature count increase: 17" in lines
