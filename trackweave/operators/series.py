"""Ordered-series primitives that never put a whole video into one task.

A video is cut into chunks of `chunk` consecutive frames.  Running values are computed inside a
chunk by an ordinary window, one summary row per chunk is carried across chunks by a second
window (a video of a billion frames has about thirty thousand summary rows), and an equi join
brings the carry back.  Windows with a bounded reach use `halo_chunks` instead: the few rows near
a chunk border are copied to the neighbour, which needs one shuffle and no join.

Recurrences whose steps compose (`prefix_composed`) are scanned in the same two levels by doubling, in the JVM.  Those that do not
are cut into pieces that start from a guess and hand their end state on until every piece has started from the true one
(`handed_over`).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.session import materialize

CHUNK_FRAMES = 32_768
LEAST_RANGES = 16
VIDEO = ("video_id",)
FRAME = "frame_id"


def _names(order: str | Sequence[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def _has_map(df: DataFrame, column: str) -> bool:
    return "map<" in df.schema[column].dataType.simpleString()


def chunk_of(order: str, chunk: int) -> Column:
    return F.floor(F.col(order) / F.lit(chunk)).cast("long")


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Tag `_chunk`: ranges of about equal numbers of rows in (keys, order), however values are spread.

    Cuts come from a sample, so the tagged rows are written once and every reader sees the same ones.
    """
    ranges = max(LEAST_RANGES, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, order[0])]))
    return materialize(placed.repartitionByRange(ranges, *[F.col(c) for c in (*keys, *order)]).withColumn("_chunk", F.spark_partition_id().cast("long")))


def running(
    df: DataFrame,
    *,
    keys: Sequence[str] = VIDEO,
    order: str | Sequence[str] = FRAME,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    firsts: Mapping[str, Column] | None = None,
    prevs: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
    prior_maxes: Mapping[str, Column] | None = None,
    chunk: float | None = CHUNK_FRAMES,
) -> DataFrame:
    """Add running columns over each series, all from one pair of windows and one carry join.

    sums: running sum including the row.  lasts / firsts: nearest non-null value at or before /
    at or after the row.  prevs / nexts: value of the neighbouring row.  prior_maxes: maximum over
    the rows strictly before.  The first order column must be numeric; it defines the chunks.  Rows
    without a key or a place in the order belong to no series and are left out.  Without `chunk` the cuts are
    equi-depth (`range_chunks`), for orders that are values and may lie in a heap.
    """
    sums, lasts, firsts = dict(sums or {}), dict(lasts or {}), dict(firsts or {})
    prevs, nexts, prior_maxes = dict(prevs or {}), dict(nexts or {}), dict(prior_maxes or {})
    order = _names(order)
    keys = list(keys)
    src = df.withColumn("_chunk", chunk_of(order[0], chunk)) if chunk is not None else range_chunks(df, keys, order)

    part = Window.partitionBy(*keys, "_chunk")
    asc = part.orderBy(*order)
    desc = part.orderBy(*[F.col(c).desc() for c in order])
    carry_asc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry_desc = (
        Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    to_here = (Window.unboundedPreceding, 0)

    def tagged(value: Column) -> Column:
        return F.struct(*[F.col(c) for c in order], value.alias("_v"))

    summary: list[Column] = []
    carry: list[Column] = []
    local: list[tuple[str, Column]] = []
    final: dict[str, Column] = {}

    for name, value in sums.items():
        local.append((f"_l_{name}", F.sum(value).over(asc.rowsBetween(*to_here))))
        summary.append(F.sum(value).alias(f"_s_{name}"))
        carry.append(F.sum(f"_s_{name}").over(carry_asc).alias(f"_c_{name}"))
        zero = F.lit(0)
        final[name] = F.coalesce(F.col(f"_l_{name}"), zero) + F.coalesce(F.col(f"_c_{name}"), zero)
    for group, window, pick, over in ((lasts, asc, F.max, carry_asc), (firsts, desc, F.min, carry_desc)):
        for name, value in group.items():
            local.append((f"_l_{name}", F.last(value, ignorenulls=True).over(window.rowsBetween(*to_here))))
            summary.append(pick(F.when(value.isNotNull(), tagged(value))).getField("_v").alias(f"_s_{name}"))
            carry.append(F.last(f"_s_{name}", ignorenulls=True).over(over).alias(f"_c_{name}"))
            final[name] = F.coalesce(f"_l_{name}", f"_c_{name}")
    for group, window, pick, over in ((prevs, asc, F.max, carry_asc), (nexts, desc, F.min, carry_desc)):
        for name, value in group.items():
            local.append((f"_l_{name}", F.lag(F.struct(value.alias("v"))).over(window)))
            summary.append(F.struct(pick(tagged(value)).getField("_v").alias("v")).alias(f"_s_{name}"))
            carry.append(F.last(f"_s_{name}").over(over).alias(f"_c_{name}"))
            final[name] = F.coalesce(F.col(f"_l_{name}"), F.col(f"_c_{name}")).getField("v")
    for name, value in prior_maxes.items():
        local.append((f"_l_{name}", F.max(value).over(asc.rowsBetween(Window.unboundedPreceding, -1))))
        summary.append(F.max(value).alias(f"_s_{name}"))
        carry.append(F.max(f"_s_{name}").over(carry_asc).alias(f"_c_{name}"))
        final[name] = F.greatest(f"_l_{name}", f"_c_{name}")

    # both uses of `src` read one shuffle: the checksum keeps the optimizer from giving the summary a
    # narrower exchange of its own, which would compute everything upstream a second time
    src = src.repartition(*keys, "_chunk")
    whole = F.bit_xor(F.xxhash64(*[c for c in src.columns if not _has_map(src, c)])).alias("_all")
    carried = src.groupBy(*keys, "_chunk").agg(*summary, whole).select(*keys, "_chunk", "_all", *carry)
    carried = carried.where(F.col("_all").isNotNull()).drop("_all")
    stepped = src.select("*", *[expr.alias(name) for name, expr in local])
    kept = [c for c in df.columns if c not in final]
    return stepped.join(carried, [*keys, "_chunk"]).select(
        *kept, *[expr.alias(name) for name, expr in final.items()]
    )


def with_position(
    df: DataFrame, name: str = "pos", *, keys: Sequence[str] = VIDEO,
    order: str | Sequence[str] = FRAME, chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Dense 0-based position of each row inside its series."""
    return running(df, keys=keys, order=order, sums={name: F.lit(1).cast("long")}, chunk=chunk).withColumn(
        name, F.col(name) - 1
    )


def halo_chunks(df: DataFrame, pos: str, *, before: int = 0, after: int = 0, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Cut dense positions into `_chunk`s whose rows see `before`/`after` neighbours.

    Copies made for a neighbouring chunk carry `_own = false`; drop them after the window.
    """
    if max(before, after) > chunk:
        raise ValueError("halo must not exceed the chunk length")
    home = chunk_of(pos, chunk)
    offset = F.col(pos) - home * F.lit(chunk)
    homes = F.array(
        F.when((offset < F.lit(after)) & (home > 0), home - 1),
        home,
        F.when(offset >= F.lit(chunk - before), home + 1),
    )
    return df.withColumn("_chunk", F.explode(F.array_compact(homes))).withColumn("_own", F.col("_chunk") == home)


def halo_window(
    df: DataFrame, columns: Callable[[Window], Mapping[str, Column]], *, keys: Sequence[str] = VIDEO,
    pos: str = FRAME, before: int = 0, after: int = 0, chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Window functions with a bounded reach over a dense series: one shuffle, no hot task."""
    window = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    made = columns(window)
    kept = [c for c in df.columns if c not in made]
    cut = halo_chunks(df, pos, before=before, after=after, chunk=chunk)
    done = cut.select(*kept, "_own", *[expr.alias(name) for name, expr in made.items()])
    return done.where("_own").select(*kept, *made)


def islands(
    df: DataFrame, breaker: Column, name: str = "island", *, keys: Sequence[str] = VIDEO,
    order: str | Sequence[str] = FRAME, chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Number the stretches of a series; a row where `breaker` holds starts a new one."""
    return running(df, keys=keys, order=order, sums={name: breaker.cast("long")}, chunk=chunk)


Fold = Callable[[dict, pd.DataFrame], pd.DataFrame]
BUCKETS_PER_PARTITION = 8


def ordered_scan(
    df: DataFrame, fold: Fold, schema: str, *, keys: Sequence[str] = VIDEO,
    order: Sequence[Column | str] = (FRAME,),
) -> DataFrame:
    """Order-dependent fold over each series as a stream of Arrow batches.

    `fold(state, rows)` gets a run of consecutive rows of one series and a state dict that lives
    until the series ends; it returns the output rows.  Only one batch is held at a time, so a long
    series costs time in its task but never memory.  Callers pass the finest keys at which the
    state restarts, so that one long video is still spread over many tasks.

    Series are hashed into buckets and a bucket is one streamed group: grouping makes the whole-series
    placement a requirement of the plan, which a bare `repartition` before a map is not.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: tuple | None = None
        state: dict = {}
        for rows in batches:
            if not len(rows):
                continue
            rows = rows.drop(columns="_bucket")
            block = rows[keys]
            starts = (block != block.shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
            if not starts or starts[0] != 0:
                starts = [0, *starts]
            bounds = [*starts, len(rows)]
            done = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                here = tuple(block.iloc[lo])
                if here != current:
                    current, state = here, {}
                done.append(fold(state, rows.iloc[lo:hi]))
            yield pd.concat(done, ignore_index=True) if len(done) > 1 else done[0]

    buckets = BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    ranked = placed.repartition("_bucket").sortWithinPartitions("_bucket", *keys, *order)
    return ranked.groupBy("_bucket").applyInPandas(run, schema)


Compose = Callable[[DataFrame, Column, Column], tuple[DataFrame, Column]]


def prefix_composed(df: DataFrame, name: str, step: Column, compose: Compose, *, keys: Sequence[str] = VIDEO, order: str = FRAME, chunk: int = 1024) -> DataFrame:
    """Add `name`: the steps of all rows of a series up to and including the row, composed in order.

    `compose(rows, earlier, later)` is associative; it gives the struct that `step` is, and `rows` with the columns it needs on the way
    (where `earlier` is null they may be anything).  Inside a chunk (at most one row per unit of `order`) the prefixes double in
    length with every window; chunk totals are composed in the same way and carried in.
    """
    keys = list(keys)
    made = df.withColumns({"_chunk": chunk_of(order, chunk), name: step})

    def joined(rows: DataFrame, earlier: str, columns: list[str]) -> DataFrame:
        wide, both = compose(rows, F.col(earlier), F.col(name))
        return wide.select(*columns, F.when(F.col(earlier).isNull(), F.col(name)).otherwise(both).alias(name))

    def doubled(rows: DataFrame, window: Window, longest: int) -> DataFrame:
        others = [c for c in rows.columns if c != name]
        for k in range(max(longest - 1, 0).bit_length()):
            rows = joined(rows.withColumn("_before", F.lag(name, 1 << k).over(window)), "_before", others)
        return rows

    local = materialize(doubled(made, Window.partitionBy(*keys, "_chunk").orderBy(order), chunk))
    total = local.groupBy(*keys, "_chunk").agg(F.max_by(name, order).alias(name))
    most = local.groupBy(*keys).agg(F.count_distinct("_chunk").alias("n")).agg(F.max("n")).first()[0] or 0  # one number
    if most <= 1:
        return local.select(*[c for c in df.columns if c != name], name)
    total = materialize(total)
    along = Window.partitionBy(*keys).orderBy("_chunk")
    carried = doubled(total, along, most).select(*keys, "_chunk", F.lag(name).over(along).alias("_carry"))
    return joined(local.join(carried, [*keys, "_chunk"]), "_carry", [c for c in df.columns if c != name])


PIECE_FRAMES, RUN_IN = 4096, 256


def _plain(value):
    return value.item() if hasattr(value, "item") else list(value)


def handed_over(
    df: DataFrame, fold: Fold, schema: str, *, keys: Sequence[str] = VIDEO, order: str = FRAME, fresh: Column | None = None,
    piece: int = PIECE_FRAMES, run_in: int = RUN_IN,
) -> DataFrame:
    """The result of `fold` over each whole series, one output row per row, from pieces that run side by side.

    A piece covers `piece` units of `order`.  All pieces but the first of a series start from a guess: the state after `run_in` units before
    it, folded from an empty state.  Each leaves the state it started from and the one it ended in.  A piece that did not start exactly
    where the one before it ended runs again from there, until none is left: then, piece by piece, all have started from the true state.  A
    fold that forgets its past needs one or two rounds; one that never does needs a round per piece and is still right.
    Where `fresh` holds the fold ignores its state, so a piece that opens with such a row never runs again.
    A state is a dict of numbers, None and lists of them; a fold gets tuples and queues back as lists.
    """
    keys = list(keys)
    rows = halo_chunks(df.withColumn("_fresh", fresh if fresh is not None else F.lit(False)), order, before=run_in, chunk=piece).withColumnRenamed("_chunk", "_piece")
    rows = materialize(rows)
    out_schema = f"{schema}, _piece long, _start string, _end string"

    def one(pdf: pd.DataFrame) -> pd.DataFrame | None:
        own = pdf["_own"].to_numpy()
        if not own.any():
            return None
        given, at = pdf["_given"].iloc[0], int(pdf["_piece"].iloc[0])
        rest = pdf.drop(columns=["_own", "_fresh", "_given", "_piece", "_bucket"])
        state: dict = {}
        if isinstance(given, str):
            state = json.loads(given)
        elif not own.all():
            fold(state, rest[~own])
        opens = pdf["_fresh"].to_numpy()[own.argmax()]
        start = "" if opens else json.dumps(state, sort_keys=True, default=_plain)
        out = fold(json_state := json.loads(start or "{}"), rest[own].reset_index(drop=True))
        end = json.dumps(json_state, sort_keys=True, default=_plain)
        marks = [None] * (len(out) - 1)
        return out.assign(_piece=at, _start=[start, *marks], _end=[end, *marks])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the last piece of a batch may go on in the next one
        held = None
        for rows in batches:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            block = rows[[*keys, "_piece"]]
            starts = (block != block.shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
            parts = [one(rows.iloc[a:b]) for a, b in zip(starts[:-1], starts[1:])]
            parts = [p for p in parts if p is not None]
            if parts:
                yield pd.concat(parts, ignore_index=True)
            held = rows.iloc[starts[-1]:] if starts else None
        last = one(held) if held is not None else None
        if last is not None:
            yield last

    # many pieces a group: a group of its own costs more than the fold over a piece
    buckets = BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def done(part: DataFrame) -> DataFrame:
        placed = part.withColumn("_bucket", F.pmod(F.xxhash64(*keys, "_piece"), F.lit(buckets))).repartition("_bucket")
        return materialize(placed.sortWithinPartitions("_bucket", *keys, "_piece", order).groupBy("_bucket").applyInPandas(run, out_schema))

    results = [done(rows.withColumn("_given", F.lit(None).cast("string")))]
    states = results[0].where("_end IS NOT NULL").select(*keys, "_piece", "_start", "_end", F.lit(0).alias("_round"))
    opening = Window.partitionBy(*keys).orderBy("_piece")
    while True:
        linked = states.withColumn("_given", F.lag("_end").over(opening))
        again = materialize(linked.where((F.col("_start") != "") & (F.col("_given") != F.col("_start"))).select(*keys, "_piece", "_given"))
        if again.isEmpty():
            break
        results.append(done(rows.where("_own").join(again, [*keys, "_piece"])))
        newer = results[-1].where("_end IS NOT NULL").select(*keys, "_piece", "_start", "_end", F.lit(len(results) - 1).alias("_round"))
        states = materialize(states.join(again, [*keys, "_piece"], "left_anti").unionByName(newer))
    if len(results) == 1:
        return results[0].drop("_piece", "_start", "_end")
    kept = [r.join(states.where(F.col("_round") == i).select(*keys, "_piece"), [*keys, "_piece"], "left_semi") for i, r in enumerate(results)]
    return reduce(DataFrame.unionByName, kept).drop("_piece", "_start", "_end")
