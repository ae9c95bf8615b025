"""Threat classifier: weights, scaling, encoding, random forest, comparison."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetscope.operators.features import LABEL, column_kinds, ensure_columns
from packetscope.operators.metrics import accuracy, evaluate
from packetscope.plans.split import stratified_split

TREES = 100
DEPTH = 10
SEED = 42
# most frequent values of a text column that get a slot; protocol names and numbers are fewer
VOCABULARY = 512
# rows of a task in fitting, and how finely small tables are split
_PART_ROWS, _SMALL_PART_ROWS, _SMALL_PARTS = 2_000_000, 4096, 16


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """(label, n, weight): total rows over classes times rows of the class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    sums = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    total, classes = sums.select("total").scalar(), sums.select("classes").scalar()
    return counts.withColumn("weight", F.round(total / (classes * F.col("n")), 6))


def with_class_weight(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Add ``weight`` per row; the joined table has one row per class (two)."""
    return df.join(F.broadcast(class_weights(df, label).select(label, "weight")), label)


def zscores(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Add ``<name>_z``: distance from the mean in population deviations, 0 without spread."""
    moments = df.agg(
        *[F.avg(c).alias(f"{c}_m") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}_s") for c in columns],
    )

    def scaled(c: str) -> Column:
        mean, spread = moments.select(f"{c}_m").scalar(), moments.select(f"{c}_s").scalar()
        z = (F.col(c) - mean) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)
        return F.round(z, digits)

    return df.withColumns({f"{c}_z": scaled(c) for c in columns})


def vocabulary(train: DataFrame, column: str, most: int = VOCABULARY) -> list[str]:
    """The most frequent values, most frequent first, ties by value; at most ``most``."""
    counts = train.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return [r[0] for r in counts.orderBy(F.desc("n"), column).limit(most).collect()]


def one_hot_stages(train: DataFrame, column: str, most: int = VOCABULARY) -> list:
    """Indexer by falling frequency, and encoder.

    The values beyond the vocabulary are one more category, that of unseen text, which
    encodes to all zeros. The driver holds ``most`` values, whatever the column holds.
    """
    # an indexer needs a label; one that no text can have stands for an empty vocabulary
    labels = vocabulary(train, column, most) or ["\x00"]
    return [
        StringIndexerModel.from_labels(
            labels, inputCol=column, outputCol=f"{column}_index", handleInvalid="keep"
        ),
        OneHotEncoder(inputCol=f"{column}_index", outputCol=f"{column}_hot"),
    ]


def one_hot(train: DataFrame, rows: DataFrame, column: str, most: int = VOCABULARY) -> DataFrame:
    """Add ``hot_slot``: the place of the single 1 in the encoded text, -1 for all zeros.

    The vocabulary comes from ``train``.
    """
    model = Pipeline(stages=one_hot_stages(train, column, most)).fit(train)
    hot = vector_to_array(f"{column}_hot")
    return (
        model.transform(rows)
        .withColumn("hot_slot", (F.array_position(hot, 1.0) - 1).cast("int"))
        .drop(f"{column}_index", f"{column}_hot")
    )


def _steady(df: DataFrame, total: int) -> DataFrame:
    """Same rows in the same partitions every time, so a seed gives the same forest.

    Their number follows from the rows alone, not from the session. Rows with an id are
    spread by it. Without one, equal rows are counted and spread in blocks, so a row that
    repeats very often fills no single task.
    """
    parts = max(-(-total // _PART_ROWS), min(_SMALL_PARTS, -(-total // _SMALL_PART_ROWS)), 1)
    if "packet_id" in df.columns:
        return df.repartition(parts, "packet_id").sortWithinPartitions("packet_id")
    names = df.columns
    block = max(1, total // (4 * parts))
    counted = df.groupBy(*names).agg(F.count("*").alias("__n"))
    blocks = counted.withColumn("__block", F.explode(F.sequence(F.lit(0), F.expr(f"(__n - 1) div {block}"))))
    copies = F.least(F.lit(block), F.col("__n") - F.col("__block") * block)
    placed = blocks.repartition(parts, *names, "__block").sortWithinPartitions(*names, "__block")
    return placed.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).select(*names)


@dataclass
class ThreatModel:
    """A fitted pipeline with what is needed to apply it to other rows."""

    feature_columns: list[str]
    source_type: str
    label_column: str = LABEL
    pipeline: PipelineModel | None = None
    single_class: int | None = None
    vector_names: list[str] = field(default_factory=list)

    @property
    def forest(self) -> RandomForestClassificationModel:
        return self.pipeline.stages[-1]

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add ``prediction`` (0/1) and ``score`` (probability of class 1).

        Missing feature columns count as 0. A model that has only seen one class
        answers that class with certainty.
        """
        if self.pipeline is None:
            known = float(self.single_class == 1)
            return rows.withColumns(
                {"prediction": F.lit(self.single_class).cast("int"), "score": F.lit(known)}
            )
        made = self.pipeline.transform(ensure_columns(rows, self.feature_columns))
        kept = [c for c in rows.columns]
        return made.select(
            *kept,
            F.col("prediction").cast("int").alias("prediction"),
            F.get(vector_to_array("probability"), F.lit(1)).alias("score"),
        )

    def importances(self, k: int | None = 10) -> DataFrame:
        """(feature, importance), largest first. One row per model input, so small."""
        spark = SparkSession.active()
        pairs = list(zip(self.vector_names, [float(v) for v in self.forest.featureImportances.toArray()]))
        table = spark.createDataFrame(pairs, "feature string, importance double")
        ordered = table.orderBy(F.desc("importance"), "feature")
        return ordered if k is None else ordered.limit(k)

    def save(self, path: str) -> None:
        """Pipeline directory and a metadata row next to it."""
        if self.pipeline is None and self.single_class is None:
            raise ValueError("no model to save, train one first")
        spark = SparkSession.active()
        meta = {
            "feature_columns": self.feature_columns,
            "source_type": self.source_type,
            "label_column": self.label_column,
            "single_class": self.single_class,
            "vector_names": self.vector_names,
        }
        if self.pipeline is not None:
            self.pipeline.write().overwrite().save(os.path.join(path, "pipeline"))
        row = spark.createDataFrame([(json.dumps(meta),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(os.path.join(path, "metadata"))

    @classmethod
    def load(cls, path: str) -> ThreatModel:
        spark = SparkSession.active()
        try:
            meta = json.loads(spark.read.text(os.path.join(path, "metadata")).first()["value"])
        except Exception as problem:
            raise FileNotFoundError(f"no saved model at {path}") from problem
        model = cls(**meta)
        if model.single_class is None:
            model.pipeline = PipelineModel.load(os.path.join(path, "pipeline"))
        return model


def train(
    table: DataFrame,
    source_type: str,
    label: str = LABEL,
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = SEED,
) -> ThreatModel:
    """Fit scaler, encoder and a class-weighted forest on a feature table."""
    feature_columns = [c for c in table.columns if c not in (label, "packet_id")]
    numeric, text = column_kinds(table, label)
    # one row per class, two for threat labels
    classes = {r[0]: r.n for r in table.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        known = int(next(iter(classes), 0))
        return ThreatModel(feature_columns, source_type, label, single_class=known)
    stages = [
        VectorAssembler(inputCols=numeric, outputCol="__numeric"),
        StandardScaler(inputCol="__numeric", outputCol="__scaled", withMean=True),
    ]
    for column in text:
        stages += one_hot_stages(table, column)
    stages += [
        VectorAssembler(inputCols=["__scaled", *[f"{c}_hot" for c in text]], outputCol="__features"),
        RandomForestClassifier(
            featuresCol="__features",
            labelCol=label,
            weightCol="weight",
            numTrees=trees,
            maxDepth=depth,
            featureSubsetStrategy="sqrt",
            seed=seed,
        ),
    ]
    steady = _steady(with_class_weight(table, label), sum(classes.values()))
    fitted = Pipeline(stages=stages).fit(steady)
    names = list(numeric)
    for column in text:
        indexer = next(
            s for s in fitted.stages if s.hasParam("outputCol") and s.getOutputCol() == f"{column}_index"
        )
        names += [f"{column}={value}" for value in indexer.labels]
    return ThreatModel(feature_columns, source_type, label, pipeline=fitted, vector_names=names)


def split_and_train(
    table: DataFrame, source_type: str, trees: int = TREES, depth: int = DEPTH
) -> tuple[ThreatModel, DataFrame]:
    """Model of the 70 % part and the scored 30 % part.

    Fitting passes over the rows dozens of times; the split has written them.
    """
    parts = stratified_split(table, "packet_id", LABEL)
    model = train(parts.filter("is_train = 1").drop("is_train"), source_type, trees=trees, depth=depth)
    held_out = parts.filter("is_train = 0").drop("is_train")
    return model, model.predict(held_out)


def as_scored(predicted: DataFrame, label: str = LABEL) -> DataFrame:
    return predicted.select(
        *[c for c in ("packet_id",) if c in predicted.columns],
        F.col(label).alias("label"),
        "prediction",
        "score",
    )


def compare_models(
    basic: DataFrame,
    detailed: DataFrame,
    trees: int = TREES,
    depth: int = DEPTH,
    output_dir: str | None = None,
) -> DataFrame:
    """(layout, accuracy, features) of both models, with differences and a verdict.

    Only measured values. With ``output_dir`` both models are saved there.
    """
    measured = {}
    for name, table in (("basic", basic), ("detailed", detailed)):
        model, predicted = split_and_train(table, name, trees, depth)
        if output_dir is not None:
            model.save(os.path.join(output_dir, f"{name}_model"))
        measured[f"{name}_accuracy"] = accuracy(as_scored(predicted)).scalar()
        measured[f"{name}_features"] = F.lit(len(model.feature_columns))
    one_row = basic.sparkSession.range(1)
    both = one_row.select(*[value.alias(name) for name, value in measured.items()])
    gain = F.round(F.col("detailed_accuracy") - F.col("basic_accuracy"), 6)
    return both.select(
        "*",
        gain.alias("accuracy_gain"),
        (F.col("detailed_features") - F.col("basic_features")).alias("feature_gain"),
        F.when(gain > 0, F.lit("detailed better")).otherwise(F.lit("similar")).alias("verdict"),
    )


# fixed values: the lines of the comparison report, which readers of its file rely on;
# a pair is a format and the column it prints
_COMPARISON = [
    "NETWORK THREAT DETECTION MODEL COMPARISON",
    "=" * 50,
    "BASIC MODEL",
    ("Accuracy: %.4f", "basic_accuracy"),
    ("Features: %d", "basic_features"),
    "DETAILED MODEL",
    ("Accuracy: %.4f", "detailed_accuracy"),
    ("Features: %d", "detailed_features"),
    "COMPARISON",
    ("Accuracy improvement: %.4f", "accuracy_gain"),
    ("Feature count increase: %d", "feature_gain"),
    ("CONCLUSION: %s", "verdict"),
]


def comparison_lines(comparison: DataFrame) -> DataFrame:
    """(line_no, line) of the comparison report."""
    lines = [F.lit(line) if isinstance(line, str) else F.format_string(*line) for line in _COMPARISON]
    return comparison.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))


def write_comparison(comparison: DataFrame, path: str) -> None:
    """The report (a dozen lines) as one text file."""
    lines = comparison_lines(comparison).coalesce(1).sortWithinPartitions("line_no")
    lines.select("line").write.mode("error").text(path)


def model_metrics(predicted: DataFrame) -> DataFrame:
    return evaluate(as_scored(predicted))
