"""Split, scaling, encoding, forest and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetscope.catalog import sql
from packetscope.catalog.registry import query
from packetscope.operators import metrics, model
from packetscope.operators.features import (
    LABEL,
    basic_features,
    column_kinds,
    detailed_features,
    scored,
)
from packetscope.plans.split import stratified_split
from packetscope.session import scratch_path, written

_SPLIT = """split AS (SELECT packet_id, is_threat, protocol_str, CASE WHEN row_number() OVER (PARTITION BY is_threat
 ORDER BY md5(CAST(packet_id AS VARCHAR) || '42'), packet_id) <= count(*) OVER (PARTITION BY is_threat) * 7 // 10
 THEN 1 ELSE 0 END AS is_train FROM detailed)"""


@query("strat_split", f", {sql.DETAILED}, {_SPLIT} SELECT packet_id, is_threat, is_train FROM split")
def strat_split(packets):
    table = detailed_features(packets).select("packet_id", LABEL)
    return stratified_split(table, "packet_id", LABEL)


@query(
    "zscore",
    """, s AS (SELECT avg(length) AS lm, stddev_pop(length) AS ls, avg(ttl) AS tm, stddev_pop(ttl) AS ts_ FROM packets)
SELECT packet_id, round((length - (SELECT lm FROM s)) / (SELECT ls FROM s), 6) AS length_z,
 round((ttl - (SELECT tm FROM s)) / (SELECT ts_ FROM s), 6) AS ttl_z FROM packets""",
)
def zscore(packets):
    scaled = model.zscores(packets.select("packet_id", "length", "ttl"), ["length", "ttl"])
    return scaled.select("packet_id", "length_z", "ttl_z")


@query(
    "one_hot",
    f""", {sql.DETAILED}, {_SPLIT}, vocabulary AS (SELECT protocol_str, row_number() OVER (ORDER BY count(*) DESC, protocol_str) - 1 AS slot
 FROM split WHERE is_train = 1 GROUP BY protocol_str)
SELECT packet_id, protocol_str, CAST(coalesce(slot, -1) AS INT) AS hot_slot FROM split LEFT JOIN vocabulary USING (protocol_str)""",
)
def one_hot(packets):
    table = detailed_features(packets).select("packet_id", LABEL, "protocol_str")
    parts = written(stratified_split(table, "packet_id", LABEL), "split")
    encoded = model.one_hot(parts.filter("is_train = 1"), parts, "protocol_str")
    return encoded.select("packet_id", "protocol_str", "hot_slot")


@query(
    "class_weights",
    f""", {sql.DETAILED} SELECT is_threat, count(*) AS n, round((SELECT count(*) FROM detailed)
 / CAST((SELECT count(DISTINCT is_threat) FROM detailed) * count(*) AS DOUBLE), 6) AS weight
FROM detailed GROUP BY is_threat""",
)
def class_weights(packets):
    return model.class_weights(detailed_features(packets))


@query("scored", f", {sql.SCORED} SELECT packet_id, label, score, prediction FROM scored")
def scored_rows(packets):
    return scored(packets)


@query(
    "accuracy",
    f""", {sql.SCORED} SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored""",
)
def accuracy(packets):
    return metrics.accuracy(scored(packets))


_CELLS = "(SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(label, prediction))"


@query(
    "confusion",
    f""", {sql.SCORED} SELECT c.label, c.prediction, count(s.packet_id) AS n FROM {_CELLS} c
 LEFT JOIN scored s ON s.label = c.label AND s.prediction = c.prediction GROUP BY c.label, c.prediction""",
)
def confusion(packets):
    return metrics.confusion(scored(packets))


_REPORT = f""", {sql.SCORED},
per AS (SELECT c, CAST(count(*) FILTER (WHERE label = c AND prediction = c) AS DOUBLE) AS hit,
 count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS called
 FROM scored, (VALUES (0), (1)) AS t(c) GROUP BY c),
rates AS (SELECT c, coalesce(hit / nullif(called, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r,
 coalesce(2 * hit / nullif(called + support, 0), 0) AS f, support FROM per),
report AS (SELECT CAST(c AS VARCHAR) AS class, round(p, 6) AS precision, round(r, 6) AS recall,
 round(f, 6) AS f1_score, support FROM rates
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM rates
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
 round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM rates)"""


@query("class_report", f"{_REPORT} SELECT class, precision, recall, f1_score, support FROM report")
def class_report(packets):
    return metrics.class_report(scored(packets))


@query(
    "eval_bundle",
    f"""{_REPORT} SELECT 'accuracy' AS metric, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS value FROM scored
 UNION ALL SELECT 'confusion ' || c.label || ' ' || c.prediction, CAST(count(s.packet_id) AS DOUBLE) FROM {_CELLS} c
  LEFT JOIN scored s ON s.label = c.label AND s.prediction = c.prediction GROUP BY c.label, c.prediction
 UNION ALL SELECT class || ' precision', precision FROM report UNION ALL SELECT class || ' recall', recall FROM report
 UNION ALL SELECT class || ' f1_score', f1_score FROM report
 UNION ALL SELECT class || ' support', CAST(support AS DOUBLE) FROM report""",
)
def eval_bundle(packets):
    return metrics.evaluate(scored(packets))


@query(
    "score_hist",
    f""", {sql.SCORED}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM scored),
binned AS (SELECT least(CAST(floor((score - (SELECT lo FROM e)) / ((SELECT hi - lo FROM e) / 20)) AS INT) + 1, 20) AS bin FROM scored)
SELECT CAST(g.bin AS INT) AS bin, round((SELECT lo FROM e) + (SELECT hi - lo FROM e) / 20 * (g.bin - 1), 6) AS low,
 round((SELECT lo FROM e) + (SELECT hi - lo FROM e) / 20 * g.bin, 6) AS high, count(b.bin) AS n
FROM (SELECT unnest(range(1, 21)) AS bin) g LEFT JOIN binned b ON g.bin = b.bin GROUP BY g.bin""",
)
def score_hist(packets):
    return metrics.score_histogram(scored(packets))


_ROC = f""", {sql.SCORED}, per AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos,
 count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY score),
cum AS (SELECT score, pos, neg, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
 CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM per),
tot AS (SELECT sum(pos) AS p, sum(neg) AS n FROM per)"""


@query(
    "roc_points",
    f"""{_ROC} SELECT score AS threshold, tp, fp, round(CAST(tp AS DOUBLE) / (SELECT p FROM tot), 6) AS tpr,
 round(CAST(fp AS DOUBLE) / (SELECT n FROM tot), 6) AS fpr FROM cum
 UNION ALL SELECT NULL, 0, 0, 0, 0""",
)
def roc_points(packets):
    return metrics.roc_points(scored(packets))


@query(
    "auc",
    f"""{_ROC} SELECT round(CAST(sum((fp - coalesce(lf, 0)) * (tp + coalesce(lt, 0))) AS DOUBLE) / 2
 / (SELECT CAST(p AS DOUBLE) * n FROM tot), 6) AS auc
FROM (SELECT tp, fp, lag(tp) OVER (ORDER BY score DESC) AS lt, lag(fp) OVER (ORDER BY score DESC) AS lf FROM cum)""",
)
def auc(packets):
    return metrics.auc(scored(packets))


@query("rf_predict")
def rf_predict(packets):
    """Class and threat probability of the held-out rows."""
    _, predicted = model.split_and_train(detailed_features(packets), "detailed")
    return model.as_scored(predicted)


_HELD_OUT = f""", {sql.DETAILED}, {_SPLIT}"""


@query(
    "rf_sound",
    f"""{_HELD_OUT} SELECT packet_id, is_threat AS label, true AS known_class, true AS is_probability,
 true AS class_of_score FROM split WHERE is_train = 0""",
)
def rf_sound(packets):
    """What must hold of every held-out row's prediction."""
    _, predicted = model.split_and_train(detailed_features(packets), "detailed", trees=5, depth=4)
    rows = model.as_scored(predicted)
    agrees = F.when(F.col("score") == 0.5, True).otherwise(F.col("prediction") == (F.col("score") > 0.5).cast("int"))
    return rows.select(
        "packet_id",
        "label",
        F.col("prediction").isin(0, 1).alias("known_class"),
        F.col("score").between(0.0, 1.0).alias("is_probability"),
        agrees.alias("class_of_score"),
    )


@query(
    "model_saved",
    f"""{_HELD_OUT} SELECT packet_id, true AS same_class, true AS same_score, 44 AS features, 'detailed' AS source_type
FROM split WHERE is_train = 0""",
)
def model_saved(packets):
    """A saved and loaded model predicts what the fitted one does."""
    fitted, predicted = model.split_and_train(detailed_features(packets), "detailed", trees=5, depth=4)
    path = scratch_path(packets.sparkSession, "model")
    fitted.save(path)
    loaded = model.ThreatModel.load(path)
    before = written(predicted, "predicted")
    again = loaded.predict(before.drop("prediction", "score")).select(
        "packet_id", F.col("prediction").alias("class"), F.col("score").alias("probability")
    )
    return before.join(again, "packet_id").select(
        "packet_id",
        (F.col("prediction") == F.col("class")).alias("same_class"),
        (F.col("score") == F.col("probability")).alias("same_score"),
        F.lit(len(loaded.feature_columns)).alias("features"),
        F.lit(loaded.source_type).alias("source_type"),
    )


@query(
    "single_class",
    f""", {sql.DETAILED} SELECT packet_id, is_threat AS trained_on, is_threat AS prediction,
 CAST(is_threat AS DOUBLE) AS score FROM detailed""",
)
def single_class(packets):
    """Models that have seen one class only answer it with certainty."""
    table = written(detailed_features(packets), "features")
    parts = []
    for known in (0, 1):
        rows = table.filter(F.col(LABEL) == known)
        answered = model.train(rows, "detailed", trees=5, depth=4).predict(rows)
        parts.append(answered.select("packet_id", F.col(LABEL).alias("trained_on"), "prediction", "score"))
    return parts[0].unionByName(parts[1])


@query(
    "column_kinds",
    f""", {sql.BASIC} SELECT 'numeric' AS kind, count(*) * 26 AS cells FROM basic
 UNION ALL SELECT 'text', count(protocol_str) FROM basic""",
)
def kinds_of_columns(packets):
    """Cells of numeric and of text features, told apart by type."""
    table = basic_features(packets)
    kinds = dict(zip(("numeric", "text"), column_kinds(table)))
    counts = table.agg(
        *[F.coalesce(sum((F.count(c) for c in names[1:]), F.count(names[0])), F.lit(0)).alias(kind)
          for kind, names in kinds.items()]
    )
    pairs = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("cells")) for k in kinds]
    return counts.select(F.inline(F.array(*pairs)))


@query("rf_metrics")
def rf_metrics(packets):
    _, predicted = model.split_and_train(detailed_features(packets), "detailed")
    return model.model_metrics(predicted)


@query("rf_importance")
def rf_importance(packets):
    """Ten most important inputs of the basic model."""
    fitted, _ = model.split_and_train(basic_features(packets), "basic")
    return fitted.importances(10)


@query("model_compare")
def model_compare(packets):
    return model.compare_models(basic_features(packets), detailed_features(packets)).select(
        "basic_accuracy", "basic_features", "detailed_accuracy", "detailed_features",
        "accuracy_gain", "feature_gain", "verdict",
    )


@query(
    "model_report",
)
def model_report(packets):
    """The comparison as text lines."""
    compared = model.compare_models(basic_features(packets), detailed_features(packets))
    return model.comparison_lines(compared).select(F.col("line_no"), "line")
