"""Classifier metrics over (label, prediction, score), all as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetscope.plans.ordered import running_totals


_CELLS = [(0, 0), (0, 1), (1, 0), (1, 1)]
_RATES = ("precision", "recall", "f1_score")


def _cell(label: int, prediction: int) -> Column:
    return F.col(f"c{label}{prediction}")


def _cells(df: DataFrame) -> DataFrame:
    """One row with the four confusion counts; every other metric is derived from it."""
    return df.agg(
        *[
            F.count_if((F.col("label") == a) & (F.col("prediction") == p)).alias(f"c{a}{p}")
            for a, p in _CELLS
        ]
    )


def _ratio(above: Column, below: Column) -> Column:
    return F.coalesce(above / F.nullif(below, F.lit(0)), F.lit(0.0))


def _accuracy() -> Column:
    hits, total = _cell(0, 0) + _cell(1, 1), sum((_cell(a, p) for a, p in _CELLS[1:]), _cell(0, 0))
    return F.round(hits / F.nullif(total, F.lit(0)), 6)


def accuracy(df: DataFrame) -> DataFrame:
    return _cells(df).select(_accuracy().alias("accuracy"))


def _confusion_rows() -> list[Column]:
    return [
        F.struct(
            F.lit(a).alias("label"), F.lit(p).alias("prediction"), _cell(a, p).alias("n")
        )
        for a, p in _CELLS
    ]


def confusion(df: DataFrame) -> DataFrame:
    """(label, prediction, n) for both classes, empty cells 0."""
    return _cells(df).select(F.inline(F.array(*_confusion_rows())))


def _report_rows(digits: int) -> list[tuple[str, dict[str, Column]]]:
    """(class, values) of both classes and the two averages, over the cell columns."""
    rates, supports = [], []
    for c in (0, 1):
        hit, missed, called = _cell(c, c), _cell(c, 1 - c), _cell(1 - c, c)
        supports.append(hit + missed)
        rates.append(
            {
                "precision": _ratio(hit, hit + called),
                "recall": _ratio(hit, hit + missed),
                "f1_score": _ratio(2 * hit, 2 * hit + called + missed),
            }
        )
    total = supports[0] + supports[1]
    macro = {r: (rates[0][r] + rates[1][r]) / 2 for r in _RATES}
    weighted = {
        r: _ratio(rates[0][r] * supports[0] + rates[1][r] * supports[1], total) for r in _RATES
    }
    rows = [
        ("0", {**rates[0], "support": supports[0]}),
        ("1", {**rates[1], "support": supports[1]}),
        ("macro avg", {**macro, "support": total}),
        ("weighted avg", {**weighted, "support": total}),
    ]
    return [
        (name, {k: F.round(v, digits) if k in _RATES else v for k, v in values.items()})
        for name, values in rows
    ]


def class_report(df: DataFrame, digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted averages.

    A division by zero counts as 0.
    """
    rows = [
        F.struct(F.lit(name).alias("class"), *[v.alias(k) for k, v in values.items()])
        for name, values in _report_rows(digits)
    ]
    return _cells(df).select(F.inline(F.array(*rows)))


def evaluate(df: DataFrame, digits: int = 6) -> DataFrame:
    """(metric, value): accuracy, confusion cells and the class report, in one pass."""
    values = [("accuracy", _accuracy())]
    values += [(f"confusion {a} {p}", _cell(a, p)) for a, p in _CELLS]
    for name, row in _report_rows(digits):
        values += [(f"{name} {k}", v) for k, v in row.items()]
    rows = [F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in values]
    return _cells(df).select(F.inline(F.array(*rows)))


def score_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, low, high, n) over [min, max] of the score; empty bins included.

    The top edge belongs to the last bin. With one single value the range is
    widened by one half on either side.
    """
    ends = df.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    half = F.when(lo == hi, F.lit(0.5)).otherwise(F.lit(0.0))
    low, high = lo - half, hi + half
    counts = (
        df.select(F.least(F.width_bucket("score", low, high, F.lit(bins)), F.lit(bins)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    step = (high - low) / bins
    return grid.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        F.round(low + step * (F.col("bin") - 1), 6).alias("low"),
        F.round(low + step * F.col("bin"), 6).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _cumulative(df: DataFrame) -> DataFrame:
    """Per distinct score, positives and negatives with running totals from the top.

    Equal scores form one point. Scores of a forest are nearly all different, so
    the running sums go through sort ranges and not through one window task.
    """
    per_score = df.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    return running_totals(per_score, [F.desc("score")], {"pos": "tp", "neg": "fp"})


def roc_points(df: DataFrame) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) by falling threshold, after a start at (0, 0).

    The start has a NULL threshold. Rates are NULL unless both classes occur.
    """
    points = _cumulative(df).select(F.col("score").alias("threshold"), "tp", "fp")
    # the lowest threshold calls everything, so the last sums are the class totals
    ends = points.agg(F.max("tp").alias("p"), F.max("fp").alias("n"))
    both = ends.filter((F.col("p") > 0) & (F.col("n") > 0))
    p, n = both.select("p").scalar(), both.select("n").scalar()
    start = df.sparkSession.sql(
        "SELECT CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp"
    )
    return start.unionByName(points).select(
        "threshold",
        "tp",
        "fp",
        F.round(F.col("tp") / p, 6).alias("tpr"),
        F.round(F.col("fp") / n, 6).alias("fpr"),
    )


def auc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve by trapezoids; NULL unless both classes occur.

    Twice the area in (positive, negative) pairs is a whole number, so it is
    summed exactly and divided once.
    """
    exact = "decimal(38,0)"
    strip = F.col("neg").cast("decimal(18,0)") * (2 * F.col("tp") - F.col("pos")).cast("decimal(19,0)")
    sums = _cumulative(df).agg(
        F.sum(strip.cast(exact)).alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    )
    pairs = F.lit(2.0) * F.col("p").cast("double") * F.col("n").cast("double")
    return sums.select(
        F.round(F.col("area").cast("double") / F.nullif(pairs, F.lit(0.0)), 6).alias("auc")
    )
