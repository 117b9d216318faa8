"""Toxicity of a text by a weighted lexicon, found by Aho-Corasick matching after folding.

Folding lowers case and maps look-alike letters, digits and signs to the letters they stand for; everything else parts words.
Lexicon and weights are learned: from at most `SAMPLE` labelled rows (chosen by a hash of the id; the bound of every fitted part)
the words that mark toxic texts beyond doubt, each weighted by its log odds, `LEXICON` at most; and two-word phrases with a
lexicon word that mark clean texts, which exempt it.  A text's figures are the weight of its matches over its length, that
weight alone and their number; a logistic regression on the sample turns them into a probability.

Defined cases: a null or empty text has no match and gets the probability of such texts; without labelled rows of both kinds
every score is 0; labels that disagree for one id count as toxic; output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.rows import materialize
from trackweave.llm.words import slices

SAMPLE, LEXICON, SURE, LEAST = 20_000, 2_000, 4.5, 3

# Characters that are read as a Latin letter.
LOOKALIKES = {
    "a": "аαａ@4", "b": "ьβｂ8", "c": "сϲｃ", "d": "ԁｄ", "e": "еεｅ3", "g": "ɡｇ9", "h": "һｈ", "i": "іιｉ1!|", "j": "јｊ", "k": "кκｋ", "l": "ӏｌ",
    "m": "мｍ", "n": "ոｎ", "o": "оοｏ0", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ5$", "t": "тτｔ7", "u": "υսｕ", "v": "ѵνｖ", "w": "ԝｗ", "x": "хχｘ", "y": "уγｙ", "z": "ᴢｚ"}


def folding() -> dict[int, str]:
    """For str.translate, after lower-casing: letters stay, look-alikes become letters, the other ASCII signs part words."""
    table = {i: " " for i in range(128) if not chr(i).isalpha()}
    table |= {i: None for i in range(0x200B, 0x2010)}
    return table | {ord(c): letter for letter, alike in LOOKALIKES.items() for c in alike}


def fold(text: str | None, table: dict[int, str]) -> str:
    return f" {' '.join((text or '').lower().translate(table).split())} "


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task how many toxic and clean texts hold a word."""
    table, seen = folding(), {}
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            for word in set(fold(text, table).split()):
                seen.setdefault(word, [0, 0])[1 - toxic] += 1
        if len(seen) > 500_000:
            yield _counts(seen)
            seen = {}
    yield _counts(seen)


def _counts(seen: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.record_batch({"word": pa.array(seen, pa.string()), "bad": pa.array([v[0] for v in seen.values()], pa.int64()), "good": pa.array([v[1] for v in seen.values()], pa.int64())})


class Matcher:
    """`weights` of single words, and `exempt` phrases that take their matches away."""

    def __init__(self, weights: dict[str, float], exempt: list[str]):
        self.weights, self.table = weights, folding()
        self.find = ahocorasick.Automaton()
        for word in weights:
            self.find.add_word(f" {word} ", (word, False))
        for phrase in exempt:
            self.find.add_word(f" {phrase} ", (phrase, True))
        self.find.make_automaton()
        self.any = bool(weights)

    def matches(self, folded: str) -> list[tuple[int, str]]:
        """Start and word of each match outside of exempt phrases."""
        if not self.any:
            return []
        words, free = [], []
        for end, (found, exempt) in self.find.iter(folded):
            start = end - len(found) - 1
            (free if exempt else words).append((start, found))
        return [(a, w) for a, w in words if not any(s <= a and a + len(w) <= s + len(p) for s, p in free)] if free else words

    def figures(self, text: str | None) -> tuple[float, float, float]:
        folded = fold(text, self.table)
        hits = self.matches(folded)
        weight = sum(self.weights[w] for _, w in hits)
        return weight * 10 / (10 + folded.count(" ") - 1), float(np.log1p(weight)), float(np.log1p(len(hits)))


def _phrases_of(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights, [])
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                folded, own = fold(text, matcher.table), set()
                for start, word in matcher.matches(folded):
                    after = folded[start + len(word) + 2:].split(" ", 1)[0] if start + len(word) + 2 < len(folded) else ""
                    before = folded[max(0, start - 60):start].rsplit(" ", 1)[-1] if start else ""
                    own |= {f"{word} {after}"} if after else set()
                    own |= {f"{before} {word}"} if before else set()
                for phrase in own:
                    seen.setdefault(phrase, [0, 0])[1 - toxic] += 1
            yield _counts(seen)
    return run


def _figures_of(weights: dict[str, float], exempt: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights, exempt)
        for batch in batches:
            got = np.array([matcher.figures(t) for t in batch.column("text").to_pylist()], float).reshape(-1, 3)
            yield pa.record_batch({"toxic": batch.column("toxic"), "a": got[:, 0], "b": got[:, 1], "c": got[:, 2]})
    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Intercept first; Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * len(x) * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) * np.append(0, w[1:]))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, weights: dict[str, float], exempt: list[str], fitted: np.ndarray | None):
        self.weights, self.exempt, self.fitted = weights, exempt, fitted


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, lexicon: int = LEXICON) -> Model:
    """Lexicon, exempt phrases and regression from the labelled rows for which `learn` (over doc_id) holds."""
    picked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "__tw_id")
    # at most `sample` rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(materialize(picked)), F.col("doc_id") == F.col("__tw_id")).select("toxic", "text")
    rows = materialize(rows)
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        return Model({}, [], None)

    def odds(counted: DataFrame) -> DataFrame:
        """Log odds of a word's texts, and how sure they are: the signed root of twice the log likelihood ratio."""
        def part(seen: Column, of: int, rest: Column) -> Column:
            expected = rest * of / (bad + good)
            return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

        with_word, without = F.col("bad") + F.col("good"), F.lit(bad + good) - F.col("bad") - F.col("good")
        ratio = part(F.col("bad"), bad, with_word) + part(F.col("good"), good, with_word) + part(bad - F.col("bad"), bad, without) + part(good - F.col("good"), good, without)
        weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
        return counted.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).withColumn("weight", weight).withColumn(
            "z", F.signum("weight") * F.sqrt(F.greatest(2 * ratio, F.lit(0.0))))

    names = "word string, bad long, good long"
    found = odds(rows.mapInArrow(_words_of, names)).where((F.col("z") >= SURE) & (F.col("bad") >= LEAST)).orderBy(F.desc("z"), "word").limit(lexicon)
    weights = {r["word"]: r["weight"] for r in found.collect()}
    phrases = odds(rows.mapInArrow(_phrases_of(weights), names)).where((F.col("z") <= -SURE) & (F.col("good") >= LEAST)).orderBy("z", "word").limit(lexicon)
    exempt = [r["word"] for r in phrases.collect()]
    got = np.array([tuple(r) for r in rows.mapInArrow(_figures_of(weights, exempt), "toxic int, a double, b double, c double").collect()], float)
    return Model(weights, exempt, logistic(got[:, 1:], got[:, 0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of `docs` with score and predicted."""
    others = [c for c in docs.columns if c not in ("score", "predicted")]
    if model.fitted is None:
        return docs.select(*others, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    weights, exempt, fitted = model.weights, model.exempt, model.fitted

    def read(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(weights, exempt)
        for text in texts:
            out = [np.zeros(0)]
            for part in slices(pa.record_batch({"text": text})):
                x = np.array([matcher.figures(t) for t in part.column("text").to_pylist()], float).reshape(-1, 3)
                out.append(1 / (1 + np.exp(-np.clip(fitted[0] + x @ fitted[1:], -30, 30))))
            yield pa.array(np.concatenate(out))

    done = docs.withColumn("__tw_score", F.arrow_udf(read, "double")("text"))
    return done.select(*others, F.col("__tw_score").alias("score"), (F.col("__tw_score") >= 0.5).cast("int").alias("predicted"))
