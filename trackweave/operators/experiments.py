"""Parameter sweeps and leave-one-out plans as ordinary columns of one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.geometry import with_box_geometry
from trackweave.operators import sequential as sq
from trackweave.operators import tracks as tr
from trackweave.operators.evaluate import track_error_report
from trackweave.operators.gapfill import fill_linear
from trackweave.operators.metrics import BINS_PER_CHUNK, deltas
from trackweave.operators.quantiles import value_bin
from trackweave.operators.series import FRAME, VIDEO, with_position
from trackweave.session import materialize

SLICES = 64  # parts of a group of records

def with_configs(rows: DataFrame, configs: Sequence[dict]) -> DataFrame:
    """Every row once per configuration, whose fields become columns."""
    structs = [F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in configs]
    return rows.select("*", F.inline(F.array(*structs)))


def selection_sweep(
    detections: DataFrame, videos: DataFrame, truth: DataFrame, thresholds: Sequence[float], baseline: float, *, params: tr.SelectionParams = tr.SelectionParams(),
) -> DataFrame:
    """Error of the most confident selected detection under every merge threshold, against a baseline.

    Tracks are scored once; the thresholds multiply only the scored tracks.
    """
    keys = ["threshold", *VIDEO]
    scored = materialize(tr.competing_tracks(tr.track_scores(detections, videos, params)))
    chosen = tr.over_threshold(with_configs(scored, [{"threshold": float(t)} for t in thresholds]), keys).where("selected")
    pool = tr.tracked(detections).join(chosen.select(*keys, tr.TRACK), [*VIDEO, tr.TRACK])
    best = pool.groupBy(*keys, FRAME).agg(F.max(F.struct("confidence", (-F.col("det_no")).alias("d"), "cx", "cy")).alias("b"))
    track = best.select(*keys, FRAME, "b.cx", "b.cy")
    expected = with_configs(truth.select(*VIDEO, FRAME, "center_x", "center_y"), [{"threshold": float(t)} for t in thresholds])
    report = materialize(track_error_report(track, expected, keys=keys).select(*keys, "n_evaluated", "mean_error", "detection_rate"))
    return deltas(report, report.where(F.col("threshold") == baseline).drop("threshold"), ("mean_error",))


@dataclass(frozen=True)
class TrackingConfig:
    """A setting of the tracking program: how conflicts are resolved and how long the smoother looks (0: not at all)."""

    name: str
    resolver: sq.ResolverParams = field(default_factory=sq.ResolverParams)
    window: int = 0


def tracking_runs(pool: DataFrame, videos: DataFrame, configs: Sequence[TrackingConfig], trace: DataFrame | None = None, *, chunk: int | None = None) -> DataFrame:
    """The tracks (config, video_id, frame_id, box) of many settings from one pool of candidates.

    Stages are shared as far as settings agree: candidates are gathered once, each distinct resolver runs once (all of them in one
    job, as a column), gaps are filled once per resolver, and each window smooths what the settings that use it need.
    """
    variants = list(dict.fromkeys(c.resolver for c in configs))
    more = {} if chunk is None else {"chunk": chunk}
    resolved = sq.resolve_variants(sq.candidate_frames(pool, trace, videos, variants[0]), variants, **more)
    keys = (*VIDEO, "variant")
    each = videos.select("*", F.explode(F.array(*[F.lit(i) for i in range(len(variants))])).alias("variant"))
    filled = materialize(fill_linear(resolved, each, keys=keys, **more).select(*keys, FRAME, *sq.BOX))
    done = []
    for window in dict.fromkeys(c.window for c in configs):
        users = [(variants.index(c.resolver), c.name) for c in configs if c.window == window]
        wanted = filled.where(F.col("variant").isin([v for v, _ in users]))
        smooth = wanted if window <= 0 else sq.smooth_ema(wanted, window, keys=keys)
        names = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(n).alias("config")) for v, n in users])
        own = smooth.withColumn("_c", F.explode(F.filter(names, lambda c: c["variant"] == F.col("variant"))))
        done.append(own.select(F.col("_c.config").alias("config"), *VIDEO, FRAME, *sq.BOX))
    return reduce(DataFrame.unionByName, done)


def tracking_sweep(
    pool: DataFrame, videos: DataFrame, truth: DataFrame, configs: Sequence[TrackingConfig], baseline: str, trace: DataFrame | None = None, *, chunk: int | None = None,
) -> DataFrame:
    """Error of every setting and video against the annotated centres, and against the setting `baseline`."""
    keys = ["config", *VIDEO]
    track = with_box_geometry(tracking_runs(pool, videos, configs, trace, chunk=chunk)).select(*keys, FRAME, "cx", "cy")
    expected = with_configs(truth.select(*VIDEO, FRAME, "center_x", "center_y"), [{"config": c.name} for c in configs])
    report = materialize(track_error_report(track, expected, keys=keys).select(*keys, "n_evaluated", "mean_error", "detection_rate"))
    return deltas(report, report.where(F.col("config") == baseline).drop("config"), ("mean_error",))


def sweep_means(sweep: DataFrame, columns: Sequence[str] = ("mean_error", "mean_error_delta")) -> DataFrame:
    return sweep.groupBy("threshold").agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n_videos"))


def _with_totals(rows: DataFrame, totals: DataFrame, group: str, stem: str) -> DataFrame:
    """Rows with their group's totals.  Groups are few and large, so a group is joined in `SLICES` parts and never lies in one task."""
    spread = totals.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return rows.withColumn("_slice", F.pmod(F.xxhash64(stem), F.lit(SLICES)).cast("int")).join(spread, [group, "_slice"]).drop("_slice")


def fold_plan(records: DataFrame, *, group: str = "model", stem: str = "stem", score: str = "score_true") -> DataFrame:
    """One fold per record, best score first: the record is the test, the last other one validates.

    A fold trains on everything else, so it is described by its size and never listed pair by pair.
    """
    keyed = records.withColumns({"_neg": -F.col(score), "_bin": value_bin(-F.col(score))})
    placed = with_position(materialize(keyed), "fold_idx", keys=(group,), order=("_bin", "_neg", stem), chunk=BINS_PER_CHUNK)
    last = records.groupBy(group).agg(F.min(F.struct(score, (-F.col(stem)).alias("s"))).alias("_l"), F.count(F.lit(1)).alias("n"))
    last = last.select(group, (-F.col("_l.s")).alias("_last"), "n")
    before = _with_totals(records, last, group, stem).where(F.col(stem) != F.col("_last")).groupBy(group).agg(
        F.min(F.struct(score, (-F.col(stem)).alias("s"))).alias("_p")).select(group, (-F.col("_p.s")).alias("_second"))
    val = F.when(F.col(stem) == F.col("_last"), F.col("_second")).otherwise(F.col("_last"))
    return _with_totals(placed, last.join(before, group), group, stem).select(
        group, "fold_idx", stem, score, val.alias("val_stem"), (F.col("n") - 2).alias("n_train"))


def fold_ranges(plan: DataFrame, *, group: str = "model", stem: str = "stem", score: str = "score_true") -> DataFrame:
    """Smallest and largest training score of each fold.

    Test and validation take out two records, so the three lowest and highest of the group decide.
    """
    def extremes(order: Sequence[Column], name: str) -> DataFrame:
        # the three of a group are among the threes of its parts
        place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        parts = plan.select(group, stem, score, F.pmod(F.xxhash64(stem), F.lit(SLICES)).cast("int").alias("_slice")).repartition(group, "_slice")
        some = parts.withColumn("_r", place(group, "_slice")).where("_r <= 3").select(group, stem, score)
        three = some.withColumn("_r", place(group)).where("_r <= 3")
        return three.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_r", score, stem))).alias(name))

    lows = extremes([F.col(score).asc(), F.col(stem)], "_lo")
    highs = extremes([F.col(score).desc(), F.col(stem)], "_hi")
    first = lambda c: F.filter(c, lambda e: (e[stem] != F.col(stem)) & (e[stem] != F.col("val_stem")))[0][score]
    return _with_totals(plan, lows.join(highs, group), group, stem).withColumns({"low": first("_lo"), "high": first("_hi")}).drop("_lo", "_hi")
