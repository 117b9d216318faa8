"""Ridge regression and leave-one-out predictions from sums of products."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.session import materialize


def product_sums(rows: DataFrame, keys: Sequence[str], features: str, target: str) -> DataFrame:
    """Per group: count, means of the origin, and the matrix of products of (1, x - origin, y - origin).

    The origin is the group's mean, which keeps later subtractions precise.  Every partition reduces
    its rows to one matrix per group before the shuffle; the size depends on the number of features
    only.  Rows: keys, `dim`, `origin` (array) and `sums` (flattened upper matrix).
    """
    keys = list(keys)
    joined = F.concat(F.col(features), F.array(F.col(target).cast("double")))
    means = rows.select(*keys, F.posexplode(joined).alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg("v").alias("m"))
    origin = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_m"))
    origin = origin.select(*keys, F.transform("_m", lambda s: s["m"]).alias("origin"))
    centred = rows.select(*keys, joined.alias("_v")).join(origin, keys).select(
        *keys, F.zip_with("_v", "origin", lambda a, b: a - b).alias("_v"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False):
                z = np.column_stack([np.ones(len(part)), np.stack(part["_v"].to_numpy())])
                sums[key] = sums.get(key, 0.0) + z.T @ z
        for key, total in sums.items():
            flat = total.ravel()
            yield pd.DataFrame({**{k: [v] * len(flat) for k, v in zip(keys, key)}, "pos": np.arange(len(flat)), "v": flat})

    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    cells = centred.mapInPandas(partial, f"{fields}, pos long, v double").groupBy(*keys, "pos").agg(F.sum("v").alias("v"))
    flat = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_s"))
    return flat.select(*keys, F.transform("_s", lambda s: s["v"]).alias("sums")).join(origin, keys)


def _solve(sums: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and intercept on unscaled features, for z-scaled ridge with a free intercept."""
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    cov = sums[1:, 1:] - n * np.outer(mean, mean)
    var = np.diag(cov)[:-1] / n
    scale = np.sqrt(np.where(var > 1e-12 * np.maximum(1.0, np.diag(sums)[1:-1] / n), var, 1.0))  # constants stay as they are
    gram = cov[:-1, :-1] / np.outer(scale, scale)
    w = np.linalg.solve(gram + alpha * np.eye(len(gram)), cov[:-1, -1] / scale) / scale
    return w, mean[-1] - mean[:-1] @ w


def ridge_fit(sums: DataFrame, keys: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """One row per group with `weights` and `intercept`; a group is a single row here."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            weights, intercepts = [], []
            for flat, origin in zip(pdf["sums"], pdf["origin"]):
                size = len(origin) + 1
                w, b = _solve(np.asarray(flat).reshape(size, size), alpha)
                origin = np.asarray(origin)
                weights.append(w.tolist())
                intercepts.append(float(b + origin[-1] - origin[:-1] @ w))
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "weights": weights, "intercept": intercepts})

    fields = ", ".join(f"{k} {sums.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(run, f"{fields}, weights array<double>, intercept double")


def ridge_predict(rows: DataFrame, model: DataFrame, keys: Sequence[str], features: str, name: str = "score_pred") -> DataFrame:
    dot = F.aggregate(F.zip_with(features, "weights", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return rows.join(model, list(keys)).withColumn(name, dot + F.col("intercept")).drop("weights", "intercept")


BLOCK_ROWS = 4096


class LeaveOneOut:
    """Ridge models of a group without one record each, from one factorisation of the whole group's matrix.

    Leaving a record out takes an outer product from the matrix of covariances and changes every scale a little.  The whole group's
    inverse is so close to what is asked that a few steps of conjugate gradients with it as preconditioner reach the last digits; a
    step costs a product with the matrix where a solution of its own would cost a factorisation.
    """

    def __init__(self, sums: np.ndarray, alpha: float):
        self.sums, self.alpha, self.n = sums, alpha, sums[0, 0]
        self.mean = sums[0, 1:] / self.n
        self.cov = sums[1:, 1:] - self.n * np.outer(self.mean, self.mean)
        var = np.diag(self.cov)[:-1] / self.n
        # a feature that may be constant without some record keeps its scale there: those records are solved directly
        self.plain = bool((var > 1e-9 * np.maximum(1.0, np.diag(sums)[1:-1] / self.n)).all()) and self.n > 3
        if self.plain:
            self.inverse = np.linalg.inv(self.cov[:-1, :-1] + alpha * np.diag(var))

    def predict(self, z: np.ndarray) -> float | None:
        """The record's own target as the others predict it; z is (features, target) around the group's origin."""
        if self.n < 2:
            return None
        n, d = self.n - 1, z - self.mean
        mean = (self.n * self.mean - z) / n
        out = self.n / n * np.outer(d, d)
        left = np.diag(self.cov)[:-1] - np.diag(out)[:-1]
        if not self.plain or (left < 1e-6 * np.diag(self.cov)[:-1]).any():
            row = np.concatenate([[1.0], z])
            w, b = _solve(self.sums - np.outer(row, row), self.alpha)
            return float(z[:-1] @ w + b)
        scale, c = self.alpha * left / n, self.cov[:-1, -1] - out[:-1, -1]
        first = self.n / n * d[:-1]

        def times(w: np.ndarray) -> np.ndarray:
            return self.cov[:-1, :-1] @ w - first * (d[:-1] @ w) + scale * w

        w = self.inverse @ c
        residual = c - times(w)
        step = towards = self.inverse @ residual
        rate, goal = residual @ step, 1e-13 * np.linalg.norm(c)
        for _ in range(4 * len(c)):
            if np.linalg.norm(residual) <= goal:
                break
            moved = times(towards)
            length = rate / (towards @ moved)
            w, residual = w + length * towards, residual - length * moved
            step = self.inverse @ residual
            rate, before = residual @ step, rate
            towards = step + rate / before * towards
        return float((z[:-1] - mean[:-1]) @ w + mean[-1])


def ridge_leave_one_out(rows: DataFrame, keys: Sequence[str], stem: str, features: str, target: str, alpha: float = 1.0, *, block: int = BLOCK_ROWS) -> DataFrame:
    """Each record predicted by a model of all the others: the group's sums minus the record itself.

    A group is dealt into blocks of about `block` records by a hash of the record; a block meets the group's matrix once, so no record
    carries it, no fold is copied and groups may be of any size.
    """
    keys = list(keys)
    sums = materialize(product_sums(rows, keys, features, target))
    size = sums.select(*keys, F.greatest(F.ceil(F.get("sums", F.lit(0)) / block), F.lit(1)).alias("_blocks"))
    own = rows.select(*keys, stem, F.col(features).alias("_x"), F.col(target).cast("double").alias("_y")).join(size, keys)
    own = own.withColumn("_block", F.pmod(F.xxhash64(stem), F.col("_blocks"))).drop("_blocks")
    dealt = sums.join(size, keys).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")

    def run(records: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if not len(records):
            return pd.DataFrame()
        origin = np.asarray(group["origin"].iloc[0])
        model = LeaveOneOut(np.asarray(group["sums"].iloc[0]).reshape(len(origin) + 1, len(origin) + 1), alpha)
        preds = []
        for x, y in zip(records["_x"], records["_y"]):
            pred = model.predict(np.append(np.asarray(x), y) - origin)
            preds.append(None if pred is None else pred + origin[-1])
        return pd.DataFrame({**{k: records[k] for k in keys}, stem: records[stem], "score_true": records["_y"], "score_pred": preds})

    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in [*keys, stem])
    both = [*keys, "_block"]
    return own.groupBy(*both).cogroup(dealt.groupBy(*both)).applyInPandas(run, f"{fields}, score_true double, score_pred double")
