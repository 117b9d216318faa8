"""What the operators share on the Spark side."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.session import materialize, ship

__all__ = ["documents", "materialize", "with_key", "on_key", "prepare", "KEY", "HASH", "cut"]

KEY, HASH = "__tw_doc", "__tw_hash"


def prepare(spark: SparkSession) -> SparkSession:
    """Sends the package to the workers, and texts to Python a thousand at a time where the session leaves that at its default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return ship(spark)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_key(docs: DataFrame) -> DataFrame:
    """Adds the row key: the document's id and a hash of its text.  Rows that agree in both are the same row for every operator."""
    return docs.withColumns({KEY: F.col("doc_id"), HASH: F.xxhash64("text")})


def on_key(left: DataFrame, right: DataFrame):
    """Null-safe: a document without an id is a document."""
    return left[KEY].eqNullSafe(right[KEY]) & left[HASH].eqNullSafe(right[HASH])


def cut(batch: pa.RecordBatch, rows: int = 100_000):
    """Parts of a large result, so that no Arrow batch grows without bound."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)
