"""Groups read as ordered streams: one task sees all rows of a key in order, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS_PER_PARTITION = 4


def ordered_stream(
    rows: DataFrame, key: Sequence[str], order: Sequence[Column | str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str,
) -> DataFrame:
    """`run` gets the rows of many keys, key after key, each in `order`; equal keys (nulls included) are adjacent and never parted.

    Keys are hashed into buckets and a bucket is one grouped stream, so a task holds a batch at a time whatever the size of a key.
    """
    buckets = BUCKETS_PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("__tw_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    return placed.repartition("__tw_bucket").sortWithinPartitions("__tw_bucket", *key, *order).groupBy("__tw_bucket").applyInArrow(run, schema)
