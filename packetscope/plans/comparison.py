"""Compare the two classifiers on two capture files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from packetscope.operators.model import DEPTH, TREES, compare_models, write_comparison
from packetscope.session import written
from packetscope.sources.captures import load_features


def compare_captures(
    spark: SparkSession,
    basic_path: str,
    detailed_path: str,
    output_dir: str,
    trees: int = TREES,
    depth: int = DEPTH,
) -> DataFrame:
    """Train on a basic and a detailed capture, save both models and the report, return its row."""
    basic = load_features(spark, basic_path, "basic")
    detailed = load_features(spark, detailed_path, "detailed")
    result = written(compare_models(basic, detailed, trees, depth, output_dir), "comparison")
    write_comparison(result, os.path.join(output_dir, "comparison_results"))
    return result
