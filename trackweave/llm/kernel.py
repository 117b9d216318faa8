"""Quality of a text by kernel ridge regression on its statistics, approximated with random Fourier features.

Each text is read once and whole into `STATISTICS` (shares, means and counts on a log scale).  They are standardised by moments of all
learning rows; cosines of `features` random projections approximate a Gaussian kernel between texts.  Every task adds up its part of
the normal equations, one set per fold; Spark sums the parts row by row, so what reaches the driver is `FOLDS` square matrices however
many rows there are.  Leaving one fold's sums out gives the ridge solution that scores that fold unseen; those scores, counted in
`BINS` bins, are calibrated by isotonic regression (pooling adjacent violators), interpolated between the middles of its steps.

All labelled learning rows count, each once per label.  Defined cases: a null or empty text has the statistics of no words and is scored as
such; labels other than 0 count as 1; without labelled rows every score is 0.5, and with labels of one kind that kind; repeated ids take
all labels of their id; an empty table gives no rows; output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.rows import materialize
from trackweave.llm.words import Words, slices, span_hashes

STATISTICS = (
    "words", "bytes_per_word", "longest_word", "word_spread", "upper_share", "digit_share", "punctuation_share", "symbol_share", "end_share", "other_byte_share",
    "capital_words", "all_capital_words", "marked_words", "short_words", "long_words", "distinct_words", "commonest_word", "repeated_pairs", "lines", "words_per_line",
    "repeated_lines", "ended_lines", "byte_entropy", "spaces_per_word")
FEATURES, WIDTH, RIDGE, FOLDS, BINS, CLIP = 256, 5.0, 1e-3, 5, 4096, 6.0

UPPER = np.isin(np.arange(256), np.arange(65, 91))
LOWER_CASE = np.isin(np.arange(256), np.arange(97, 123))
DIGIT = np.isin(np.arange(256), np.arange(48, 58))
END = np.isin(np.arange(256), [ord(c) for c in ".!?"])
SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>{}[]\\/=+^~@_"])
PUNCTUATION = np.isin(np.arange(256), [ord(c) for c in ",;:.!?'\"()-"])
HIGH = np.arange(256) >= 0x80


def _most(keys: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text how many distinct keys there are, and how often the commonest occurs."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, text))
    key, own = keys[order], text[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])))
    size = np.diff(np.append(first, len(key)))
    most = np.zeros(n)
    np.maximum.at(most, own[first], size)
    return np.bincount(own[first], minlength=n).astype(float), most


def statistics(column: pa.Array) -> np.ndarray:
    """A row of `STATISTICS` for each text."""
    w = Words(column)
    n, buf, offsets = len(w.count), w.buf, w.offsets
    count, size = w.count.astype(float), np.diff(offsets).astype(float)
    of_word, of_byte = w.text_of(), np.repeat(np.arange(n), np.diff(offsets))
    total = lambda flags: np.bincount(of_word, weights=flags, minlength=n)
    per_byte = lambda table: np.diff(np.append(0, np.cumsum(table[buf], dtype=np.int64))[offsets]).astype(float)
    words, filled = np.maximum(count, 1), np.maximum(size, 1)
    length = (w.end - w.start).astype(float)

    def inside(table: np.ndarray) -> np.ndarray:
        run = np.append(0, np.cumsum(table[buf], dtype=np.int64))
        return (run[w.end] - run[w.start]).astype(float)

    upper, lower, high = inside(UPPER), inside(LOWER_CASE), inside(HIGH)
    starts = UPPER[buf[w.start]] if len(w) else np.zeros(0, bool)
    letters = upper + lower + high
    longest = np.zeros(n)
    np.maximum.at(longest, of_word, length)
    mean = total(length) / words
    spread = np.sqrt(np.maximum(total(length ** 2) / words - mean ** 2, 0))
    h = w.hashes()
    distinct, most = _most(h, of_word, n)
    with np.errstate(over="ignore"):
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[of_word[1:] == of_word[:-1]] if len(h) else h
    pairs = np.maximum(count - 1, 0)
    distinct_pairs, _ = _most(pair, of_word[1:][of_word[1:] == of_word[:-1]] if len(h) else of_word, n)
    # lines that hold a word
    edge = np.zeros(len(buf) + 1, bool)
    edge[np.flatnonzero(buf == 0x0A) + 1] = True
    edge[offsets] = True
    start = np.flatnonzero(edge[:-1])
    end = np.append(start[1:], len(buf))[:len(start)]
    last = np.searchsorted(w.start, end) - 1
    full = last >= np.searchsorted(w.start, start)
    start, last = start[full], last[full]
    of_line = np.searchsorted(offsets, start, "right") - 1
    lines = np.bincount(of_line, minlength=n).astype(float)
    distinct_lines, _ = _most(span_hashes(buf, start, w.end[last]) if len(start) else np.zeros(0, np.uint64), of_line, n)
    ended = np.bincount(of_line, weights=END[buf[w.end[last] - 1]] if len(start) else None, minlength=n)
    # entropy of bytes
    pairs_of = np.bincount(of_byte * 256 + buf, minlength=n * 256).reshape(n, 256) if n else np.zeros((0, 256))
    share = pairs_of / filled[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    some_lines = np.maximum(lines, 1)
    return np.column_stack([
        np.log1p(count), mean, np.log1p(longest), spread, total(upper) / filled, per_byte(DIGIT) / filled, per_byte(PUNCTUATION) / filled, per_byte(SYMBOL) / filled,
        per_byte(END) / words, per_byte(HIGH) / filled, total(starts) / words, total((upper == letters) & (letters > 1)) / words, total(inside(SYMBOL) > 0) / words,
        total(length <= 2) / words, total(length >= 13) / words, distinct / words, most / words, (pairs - distinct_pairs) / np.maximum(pairs, 1), np.log1p(lines), np.log1p(count / some_lines),
        (lines - distinct_lines) / some_lines, ended / some_lines, entropy, (size - total(length)) / words])


def measure(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs` with `statistics`, the only thing that is learned from or scored."""
    def read(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            parts = [statistics(part.column("text")) for part in slices(pa.record_batch({"text": text}), limit=1 << 20)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            yield pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS), pa.array(x.astype(np.float32).ravel()))

    return docs.select(*[c for c in docs.columns if c != "statistics"], F.arrow_udf(read, "array<float>")("text").alias("statistics"))


class Projection:
    """Standardised statistics to cosines: their products approximate a Gaussian kernel of `width` standard deviations."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.way = rng.normal(0, 1 / width, (len(mean), features))
        self.phase = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """A constant, then the cosines."""
        z = np.clip((x - self.mean) / self.spread, -CLIP, CLIP)
        return np.column_stack([np.ones(len(x)), np.sqrt(2 / len(self.phase)) * np.cos(z @ self.way + self.phase)])


def isotonic(score: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising steps closest to good / n over ascending scores, as points to interpolate between."""
    at, top, size = [], [], []
    for s, g, m in zip(score.tolist(), good.tolist(), n.tolist()):
        at.append(s * m)
        top.append(g)
        size.append(m)
        while len(at) > 1 and top[-2] * size[-1] >= top[-1] * size[-2]:
            for column in (at, top, size):
                last = column.pop()
                column[-1] += last
    size = np.array(size, float)
    return np.array(at) / size, np.array(top) / size


def solve(total: np.ndarray, ridge: float) -> np.ndarray:
    """Coefficients from summed normal equations: the matrix, and the products with the labels in its last column."""
    a, b = total[:, :-1], total[:, -1]
    penalty = ridge * max(a[0, 0], 1.0) * np.eye(len(a)) / len(a)
    penalty[0, 0] = 0
    return np.linalg.solve(a + penalty + 1e-9 * np.eye(len(a)), b)


class Model:
    def __init__(self, projection: Projection | None, weights: np.ndarray | None, at: np.ndarray, value: np.ndarray):
        self.projection, self.weights, self.at, self.value = projection, weights, at, value

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.projection is None:
            return np.full(len(x), self.value[0])
        return np.clip(np.interp(self.projection(x) @ self.weights, self.at, self.value), 0.0, 1.0)


def rows_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("statistics").flatten(), dtype=float).reshape(-1, len(STATISTICS))


def normal_equations(rows: DataFrame, projection: Projection) -> np.ndarray:
    """Per fold the summed products of the features with each other and with the label: a part per task, added up by Spark a matrix row at a time."""
    width = len(projection.phase) + 1

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, width, width + 1))
        for batch in batches:
            z, fold = projection(rows_of(batch)), batch.column("fold").to_numpy(zero_copy_only=False)
            zy = np.column_stack([z, batch.column("label").to_numpy(zero_copy_only=False)])
            for k in range(FOLDS):
                total[k] += z[fold == k].T @ zy[fold == k]
        yield pa.record_batch({"line": pa.array(range(FOLDS * width), pa.int32()), "products": pa.array(list(total.reshape(-1, width + 1)), pa.list_(pa.float64()))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, total = None, np.zeros(width + 1)
        for batch in batches:
            if batch.num_rows:
                line = batch.column("line")[0].as_py()
                total += np.asarray(batch.column("products").flatten()).reshape(-1, width + 1).sum(axis=0)
        yield pa.record_batch({"line": pa.array([line], pa.int32()), "products": pa.array([total], pa.list_(pa.float64()))})

    schema = "line int, products array<double>"
    summed = rows.mapInArrow(parts, schema).groupBy("line").applyInArrow(add, schema).collect()  # FOLDS * width rows
    out = np.zeros((FOLDS * width, width + 1))
    for r in summed:
        out[r["line"]] = r["products"]
    return out.reshape(FOLDS, width, width + 1)


def train(measured: DataFrame, labels: DataFrame, label: str, learn: Column, *, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = 5) -> Model:
    """From rows (doc_id, statistics) and labels (doc_id, `label`) for which `learn` (over doc_id) holds."""
    kept = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).select(F.col("doc_id").alias("id"), (F.col(label) != 0).cast("double").alias("label"))
    fold = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(FOLDS)).cast("int")
    rows = materialize(measured.select("doc_id", "statistics").join(kept, F.col("doc_id") == F.col("id")).select("statistics", "label", fold.alias("fold")))
    each = [F.col("statistics")[i].cast("double") for i in range(len(STATISTICS))]
    moments = rows.agg(F.count("*"), F.avg("label"), *[f(c) for c in each for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0] or moments[1] in (0.0, 1.0):
        return Model(None, None, np.zeros(1), np.array([moments[1] if moments[0] else 0.5]))
    mean, spread = np.array(moments[2::2], float), np.array(moments[3::2], float)
    projection = Projection(mean, spread, features, width, seed)
    sums = normal_equations(rows, projection)
    total = sums.sum(axis=0)
    unseen = [solve(total - part, ridge) for part in sums]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((BINS, 2), np.int64)
        for batch in batches:
            z, k = projection(rows_of(batch)), batch.column("fold").to_numpy(zero_copy_only=False)
            raw = np.einsum("ij,ij->i", z, np.array(unseen)[k])
            at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)  # scores from -0.5 to 1.5
            np.add.at(seen, at, np.column_stack([batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64), np.ones(len(at), np.int64)]))
        at = np.flatnonzero(seen[:, 1])
        yield pa.record_batch({"at": pa.array(at, pa.int32()), "good": pa.array(seen[at, 0]), "n": pa.array(seen[at, 1])})

    counted = rows.mapInArrow(binned, "at int, good long, n long").groupBy("at").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).orderBy("at").collect()
    at, good, n = (np.array([r[c] for r in counted], float) for c in ("at", "good", "n"))
    return Model(projection, solve(total, ridge), *isotonic((at + 0.5) * 2 / BINS - 0.5, good, n))


def score(measured: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of `measured` but the statistics, with score."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(model.score(np.asarray(column.flatten(), dtype=float).reshape(-1, len(STATISTICS))))

    return measured.select(*[c for c in measured.columns if c not in ("statistics", "score")], F.arrow_udf(run, "double")("statistics").alias("score"))
