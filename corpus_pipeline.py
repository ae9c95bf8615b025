"""From raw documents to token ids: five stages, each over all that the one before kept.

1. toxicity: documents the classifier rejects at their language's threshold go
2. near duplicates: one document of each class stays
3. decontamination: documents that hold a passage of the benchmark go
4. secrets: their spans are replaced in the text, ``n_chars`` follows
5. encoding: ids of the clean text

Each stage is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetscope.llm import decontamination, encoding, near_duplicates, secrets, toxicity
from packetscope.llm.common import table
from packetscope.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's threshold. Labels are learned from as in the operator;
    null and empty texts are scored like any other."""
    net = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = toxicity.toxicity(docs, net)
    return docs.where(score < toxicity.threshold(docs["lang"], net))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class; documents without words all stay."""
    return near_duplicates.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; null and empty texts stay."""
    found = decontamination.find_passages(docs, table(spark, sf_dir, "benchmark"))
    return docs.where(F.size(found["hits"]) == 0)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets replaced by their kind in brackets. Null texts stay null."""
    clean = docs.withColumn("text", secrets.redact(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids``, with checksums of the ids and of what they decode to."""
    encoded = encoding.encode_documents(docs)
    return encoded.select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("encoding", encode),
]

# models, signatures and merges cannot be said in SQL; tests compare with plain versions
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
