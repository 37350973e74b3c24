"""A training-text pipeline over ``documents``: language, near copies, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns
a DataFrame, which is written as Parquet and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfield.llm import language, mixing, pieces, secrets, signatures
from lumenfield.session import work_path

STAGES = [
    ("language ID", language.stage),
    ("n-gram Jaccard join", signatures.stage),
    ("secret scans", secrets.stage),
    ("mixing", mixing.stage),
    ("SentencePiece", pieces.stage),
]

#: language ID, learned secrets and tokens are beyond SQL; tests compare with brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages leave, with their token ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
