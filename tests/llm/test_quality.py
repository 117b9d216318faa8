"""The quality classifier: its parts against direct computation, and whole on planted junk."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackweave.llm import kernel, langid

SCHEMA = "doc_id long, text string, lang string, score double, statistics string"


def some_texts(n=400, seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["the", "ing", "and", "er", "ion", "ß", "ü"]) for _ in range(rnd.randint(1, 3)))
    clean = lambda: " ".join(" ".join(word() for _ in range(rnd.randint(4, 12))).capitalize() + "." for _ in range(rnd.randint(3, 20)))
    junk = lambda: rnd.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "*** "), lambda t: (t[:20] + "\n") * 40])(clean())
    return [(i, clean() if i % 4 else junk(), int(i % 4 > 0)) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 0.0, "s") for i, t, _ in some_texts()]
    more = [(1000, None, None, None, None), (1001, "", "en", None, None), (1002, " \n\t", "en", None, None), (1003, "y. " * 50_000, "en", None, None), (None, "Some text.", None, None, None),
            (1004, "x", "en", None, None), rows[7], rows[7]]
    return spark.createDataFrame(rows + more, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, y) for i, _, y in some_texts()] + [(1000, None), (1001, 0), (1002, 0), (None, 1), (99_999, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_statistics_of_simple_texts():
    x = dict(zip(kernel.STATISTICS, kernel.statistics(pa.array(["Ab cd. cd.\nAB #1\nAB #1\n\n"]))[0]))
    want = {"words": np.log1p(7), "bytes_per_word": 16 / 7, "longest_word": np.log1p(3), "upper_share": 5 / 24, "digit_share": 2 / 24, "symbol_share": 2 / 24, "end_share": 2 / 7,
            "capital_words": 3 / 7, "all_capital_words": 2 / 7, "marked_words": 2 / 7, "short_words": 5 / 7, "long_words": 0, "distinct_words": 4 / 7, "commonest_word": 2 / 7,
            "repeated_pairs": 1 / 6, "lines": np.log1p(3), "repeated_lines": 1 / 3, "ended_lines": 1 / 3}
    assert {k: x[k] for k in want} == pytest.approx(want)
    alone = kernel.statistics(pa.array([None, "", " \n", "a b\nc", "a b\nc"]))
    assert np.isfinite(alone).all() and (alone[0] == 0).all() and (alone[3] == alone[4]).all()
    texts = [t for _, t, _ in some_texts(60)]
    together, one_by_one = kernel.statistics(pa.array(texts)), np.concatenate([kernel.statistics(pa.array([t])) for t in texts])
    np.testing.assert_allclose(together, one_by_one)


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 6))
    z = kernel.Projection(np.zeros(6), np.ones(6), 20_000, 2.0, 1)(x)[:, 1:]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 2.0 ** 2))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_normal_equations_are_sums_over_all_rows(spark):
    rng = np.random.default_rng(2)
    x, y, fold = rng.normal(size=(300, len(kernel.STATISTICS))).astype(np.float32), rng.integers(0, 2, 300), rng.integers(0, kernel.FOLDS, 300)
    rows = spark.createDataFrame([(a.tolist(), float(b), int(f)) for a, b, f in zip(x, y, fold)], "statistics array<float>, label double, fold int").repartition(7)
    projection = kernel.Projection(np.zeros(x.shape[1]), np.ones(x.shape[1]), 32, 3.0, 1)
    sums = kernel.normal_equations(rows, projection)
    z = projection(x.astype(float))
    for k in range(kernel.FOLDS):
        np.testing.assert_allclose(sums[k], z[fold == k].T @ np.column_stack([z, y])[fold == k], atol=1e-9)
    w = kernel.solve(sums.sum(axis=0), 1e-3)
    penalty = np.diag([0, *[1e-3 * len(x) / 33] * 32])
    np.testing.assert_allclose((z.T @ z + penalty) @ w, z.T @ y, atol=1e-5)


def test_isotonic_equals_min_max():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = rng.integers(1, 12)
        size, at = rng.integers(1, 5, n), np.sort(rng.normal(size=n))
        good = rng.integers(0, size + 1)
        mean = lambda a, b: good[a:b + 1].sum() / size[a:b + 1].sum()  # noqa: B023, E731
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        points, value = kernel.isotonic(at, good, size)
        assert sorted(set(np.round(want, 12))) == pytest.approx(sorted(set(np.round(value, 12))))
        assert (np.diff(value) > 0).all() and (np.diff(points) > 0).all()


def test_planted_junk_is_told_apart(docs, labels):
    measured = kernel.measure(docs)
    model = kernel.train(measured, labels, "quality", ~langid.held_out(5))
    out = kernel.score(measured, model).withColumn("held_out", langid.held_out(5)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out) and out[0].__fields__[:3] == ["doc_id", "text", "lang"]
    truth = {i: y for i, _, y in some_texts()}
    held = [(r.score >= 0.3) == truth[r.doc_id] for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean(held) > 0.95
    same = {r.score for r in out if r.doc_id == 7}
    assert len(same) == 1


def test_labels_of_one_kind_or_none(docs, labels):
    measured = kernel.measure(docs)
    for kept, want in (("false", 0.5), ("quality = 1", 1.0), ("quality = 0", 0.0)):
        model = kernel.train(measured, labels.where(kept), "quality", F.lit(True))
        assert {r.score for r in kernel.score(measured, model).collect()} == {want}
    nothing = kernel.measure(docs.limit(0))
    assert kernel.score(nothing, kernel.train(nothing, labels, "quality", F.lit(True))).count() == 0
