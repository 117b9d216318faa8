"""Exact interpolated quantiles that hold no group in one buffer.

`percentile` keeps every distinct value of a group in one aggregation buffer.  Here values are
counted first (map-side combined), a histogram over fixed, data-independent bins locates the bins
holding the wanted ranks, and only the rows of those bins are ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_UNIT = 4096


def value_bin(value: Column) -> Column:
    """Monotone, data-independent bin of a number: even steps near zero, even ratios far from it."""
    v = value.cast("double")
    return F.floor(F.signum(v) * F.asinh(F.abs(v)) * F.lit(BINS_PER_UNIT)).cast("long")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float | Callable[[Column], Column]],
) -> DataFrame:
    """One row per group: `keys` plus one linear-interpolated quantile column per entry of `probs`.

    A callable entry maps the group size to a 0-based rank instead.
    """
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_w"))
        .withColumn("_bin", value_bin(F.col("_v")))
    )
    by_bin = Window.partitionBy(*keys).orderBy("_bin")
    hist = (
        counted.groupBy(*keys, "_bin").agg(F.sum("_w").alias("_bw"))
        .withColumn("_to", F.sum("_bw").over(by_bin.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_n", F.sum("_bw").over(Window.partitionBy(*keys)))
        .withColumn("_from", F.col("_to") - F.col("_bw"))
    )
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), (p(F.col("_n")) if callable(p) else (F.col("_n") - 1) * F.lit(float(p))).cast("double").alias("at"))
        for name, p in probs.items()
    ])
    hit = F.filter(
        wanted,
        lambda t: ((F.floor(t["at"]) >= F.col("_from")) & (F.floor(t["at"]) < F.col("_to")))
        | ((F.ceil(t["at"]) >= F.col("_from")) & (F.ceil(t["at"]) < F.col("_to"))),
    )
    targets = hist.withColumn("_t", hit).where(F.size("_t") > 0).select(*keys, "_bin", "_from", "_t")
    in_bin = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counted.join(targets, [*keys, "_bin"])
        .withColumn("_hi", F.sum("_w").over(in_bin) + F.col("_from"))
        .withColumn("_lo", F.col("_hi") - F.col("_w"))
        .withColumn("_t", F.explode("_t"))
        .select(*keys, "_v", "_lo", "_hi", F.col("_t.name").alias("_name"), F.col("_t.at").alias("_at"))
    )
    covers = lambda rank: (rank >= F.col("_lo")) & (rank < F.col("_hi"))
    low, high = F.floor("_at"), F.ceil("_at")
    aggs = []
    for name in probs:
        mine = F.col("_name") == name
        aggs.append(F.max(F.when(mine & covers(low), F.col("_v"))).alias(f"_a_{name}"))
        aggs.append(F.max(F.when(mine & covers(high), F.col("_v"))).alias(f"_b_{name}"))
        aggs.append(F.max(F.when(mine, F.col("_at") - low)).alias(f"_f_{name}"))
    picked = ranked.groupBy(*keys).agg(*aggs)
    return picked.select(*keys, *[
        (F.col(f"_a_{n}") + F.col(f"_f_{n}") * (F.col(f"_b_{n}") - F.col(f"_a_{n}"))).alias(n) for n in probs
    ])
