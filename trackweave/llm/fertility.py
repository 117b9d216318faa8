"""Quality of texts by what public vocabularies make of them.

A sentence-piece vocabulary with byte fallback encodes every distinct word of a task once, and a second one, of words in bytes,
counts its tokens.  Per text: characters per token of both, tokens of the first for one of the second (text that only one of them
knows), share of fallback bytes, and the entropy of its tokens relative to that of as many different ones.  All texts that pass the plain rules
set the bands of their group: the quartiles of each figure (from counts in fixed bins), widened by `NEAR` interquartile ranges, at
least by `CLOSE`.  A group is a script, a language (column lang, where there is one) and a length in powers of two, since the
entropy falls with length.  Under `ENOUGH` texts of one language, all texts of that script and length set the bands; if they are
too few as well, all of the script, and then `WIDE` and `LEAST` hold.  A text outside a band is rejected.

Plain figures: words, code points in words, symbols, lines equal to an earlier line, words in three-word windows that occur twice.

Defined cases: without a second vocabulary its figures are 0 for all texts and no text fails by them; a null or empty text has zeros and fails; scripts are told by the letters' leading bytes; output columns replace
input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.idfile import encoded_words, tokenizer
from trackweave.llm.rows import materialize
from trackweave.llm.words import Remembered, Words, mix, slices, span_hashes, window_hashes, window_starts

SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
FIGURES = ("chars_per_token", "fallback_share", "relative_entropy", "chars_per_second", "first_per_second")
BINS, WIDE, LEAST = 512, 6.0, {"chars_per_token": 0.5, "fallback_share": 0.05, "relative_entropy": 0.1, "chars_per_second": 0.5, "first_per_second": 0.25}
ENOUGH, NEAR, CLOSE = 20, 3.0, {"chars_per_token": 0.1, "fallback_share": 0.02, "relative_entropy": 0.05, "chars_per_second": 0.1, "first_per_second": 0.1}
RANGE = {"chars_per_token": 16.0, "fallback_share": 1.0, "relative_entropy": 1.0, "chars_per_second": 16.0, "first_per_second": 8.0}
SCRIPTS = ("none", "latin", "greek", "cyrillic", "semitic", "indic", "east_asian", "other")
SHAPE = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, n_fallback long, script string, "
         "chars_per_token double, fallback_share double, relative_entropy double, n_second long, chars_per_second double, first_per_second double")


def script_table() -> np.ndarray:
    """The script that a byte starts a letter of; 0 for none."""
    of = np.zeros(256, np.int8)
    of[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = 1
    of[[0xCD, 0xCE, 0xCF]] = 2
    of[0xD0:0xD4] = 3
    of[0xD7:0xDC] = 4
    of[0xE0] = 5
    of[0xE3:0xEE] = 6
    of[[*range(0xCA, 0xCD), *range(0xD4, 0xD7), *range(0xDC, 0xE0), 0xE1]] = 7
    return of


@lru_cache(2)
def vocabulary(path: str) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.vocab_size())])


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def duplicate_lines(words: Words) -> np.ndarray:
    edge = np.zeros(len(words.buf) + 1, bool)
    edge[np.flatnonzero(words.buf == 0x0A) + 1] = True
    edge[words.offsets] = True
    start = np.flatnonzero(edge[:-1])
    end = np.append(start[1:], len(words.buf))[:len(start)]
    text = np.searchsorted(words.offsets, start, "right") - 1
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, text = start[full], end[full], text[full]
    end = end - (words.buf[end - 1] == 0x0A)
    lines = np.bincount(text, minlength=len(words.count))
    distinct = np.unique(np.stack([text.astype(np.uint64), span_hashes(words.buf, start, end)]), axis=1)[0].astype(np.int64) if len(text) else text
    return lines - np.bincount(distinct, minlength=len(words.count))


def repeated_words(words: Words, h: np.ndarray) -> np.ndarray:
    at = window_starts(words.count, words.first, 3)
    text = np.repeat(np.arange(len(words.count)), np.maximum(words.count - 2, 0))
    key = window_hashes(h, 3)[at] ^ mix(text.astype(np.uint64) + np.uint64(1))
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[n[back] > 1]
    hit = np.zeros(len(words) + 2, bool)
    for i in range(3):
        hit[twice + i] = True
    return per_text(hit[:len(words)], words.first)


def relative_entropy(tokens: np.ndarray, text: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Entropy of each text's tokens over the logarithm of their number (or of the vocabulary)."""
    pair, count = np.unique(text * size + tokens, return_counts=True)
    own = pair // size
    surprise = np.bincount(own, weights=count * np.log2(count), minlength=len(n))
    full = np.log2(np.maximum(n, 1)) - surprise / np.maximum(n, 1)
    return np.where(n > 1, full / np.maximum(np.log2(np.clip(n, 2, size)), 1e-9), 0.0)


def second_counts(path: str) -> Remembered:
    """How many tokens of the second vocabulary a word has."""
    model = tokenizer(path)

    def work(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.ones(len(words), np.int64), encoded_words(model, words)[0].astype(np.int32)
    return Remembered(work)


def _measured(path: str, second: str | None):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, is_byte = vocabulary(path)
        counted = second_counts(second) if second else None
        known = Remembered(lambda strings: model.encode([s.decode() for s in strings], num_threads=1))
        script = script_table()
        for text in texts:
            out = []
            for part in slices(pa.record_batch({"text": text})):
                words = Words(part.column("text"))
                h = words.hashes()
                size, tokens = known.lists(words.buf, words.start, words.end, h)
                own = np.repeat(words.text_of(), size)
                n = np.bincount(own, minlength=len(words.count))
                others = per_text(counted.lists(words.buf, words.start, words.end, h)[1], words.first) if counted else np.zeros(len(words.count), np.int64)
                fallback = np.bincount(own[is_byte[tokens]], minlength=len(words.count))
                inside = np.zeros(len(words.buf) + 1, np.int8)
                inside[words.start] += 1
                np.subtract.at(inside, words.end, 1)
                chars = per_text((np.cumsum(inside[:-1]) > 0) & ((words.buf & 0xC0) != 0x80), words.offsets)
                kinds = script[words.buf]
                most = np.stack([per_text(kinds == k, words.offsets) for k in range(1, len(SCRIPTS))])
                which = np.where(most.max(axis=0) > 0, most.argmax(axis=0) + 1, 0)
                out.append([
                    words.count, chars, per_text(SYMBOLS[words.buf], words.offsets), duplicate_lines(words), repeated_words(words, h), n, fallback,
                    np.array(SCRIPTS, object)[which], chars / np.maximum(n, 1), fallback / np.maximum(n, 1), relative_entropy(tokens.astype(np.int64), own, n, len(is_byte)),
                    others, chars * (others > 0) / np.maximum(others, 1), n * (others > 0) / np.maximum(others, 1)])
            names = [f.split()[0] for f in SHAPE.split(", ")]
            kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in SHAPE.split(", ")]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([o[i] for o in out]) if out else [], kind) for i, kind in enumerate(kinds)], names=names)
    return run


def measure(docs: DataFrame, path: str, second: str | None = None) -> DataFrame:
    """All rows and columns of `docs` with the figures and base_failed.  path: a sentence-piece vocabulary; second: one of the tokenizers library."""
    def read(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _measured(path, second)(it)

    figures = [f.split()[0] for f in SHAPE.split(", ")]
    done = docs.withColumn("__tw_figures", F.arrow_udf(read, f"struct<{SHAPE.replace(' ', ': ').replace(',:', ',')}>")("text"))
    done = done.select(*[c for c in docs.columns if c not in (*figures, "base_failed")], *[F.col(f"__tw_figures.{c}").alias(c) for c in figures])
    return done.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _group(measured: DataFrame) -> dict:
    """What a text is compared within: its script, its language where the table has one, and its length in powers of two."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in measured.columns else F.lit("")
    return {"__tw_script": F.col("script"), "__tw_lang": lang, "__tw_size": F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")}


def bands(measured: DataFrame) -> DataFrame:
    """Per group and figure the lowest and highest value that is kept; a row per group and bin is the most that meets in a task."""
    keys = ["__tw_script", "__tw_lang", "__tw_size"]
    each = measured.where("NOT base_failed").withColumns(_group(measured)).select(*keys, F.posexplode(F.array(*FIGURES)).alias("figure", "value"))
    width, close, least = (F.element_at(F.array(*[F.lit(v(f)) for f in FIGURES]), F.col("figure") + 1) for v in (lambda f: RANGE[f] / BINS, CLOSE.get, LEAST.get))
    counted = each.withColumn("bin", F.least(F.floor(F.col("value") / width), F.lit(BINS - 1))).groupBy(*keys, "figure", "bin").agg(F.count("*").alias("n"))
    script, lang, size = (F.col(k) for k in keys)
    levels = [(0, lang, size), (1, F.lit(""), size), (2, F.lit(""), F.lit(-1))]
    of = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), a.alias("lang"), b.alias("size")) for level, a, b in levels]))
    counted = counted.select(script.alias("script"), "figure", "bin", "n", of.alias("of")).select("script", "of.*", "figure", "bin", "n")
    own = ["level", "script", "lang", "size"]
    counted = counted.groupBy(*own, "figure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*own, "figure")
    counted = counted.withColumns({"below": F.sum("n").over(group.orderBy("bin")), "all": F.sum("n").over(group)})
    low = counted.groupBy(*own, "figure").agg(
        F.first("all").alias("all"), F.min(F.when(F.col("below") * 4 >= F.col("all"), F.col("bin"))).alias("q1"), F.min(F.when(F.col("below") * 4 >= F.col("all") * 3, F.col("bin") + 1)).alias("q3"))
    spread = (F.col("q3") - F.col("q1")) * width
    reach = F.when(F.col("level") < 2, F.greatest(spread * NEAR, close)).otherwise(F.greatest(spread * WIDE, least))
    low = low.withColumn("enough", (F.col("level") == 2) | (F.col("all") >= ENOUGH))
    sides = {"low": F.when(F.col("enough"), F.col("q1") * width - reach), "high": F.when(F.col("enough"), F.col("q3") * width + reach)}
    names = [(side, i) for side in sides for i in range(len(FIGURES))]
    wide = materialize(low.groupBy(*own).agg(*[F.max(F.when(F.col("figure") == i, sides[side])).alias(f"{side}_{i}") for side, i in names]))
    first, second, third = (wide.where(F.col("level") == level).alias(f"l{level}") for level in range(3))
    found = first.join(second, (F.col("l0.script") == F.col("l1.script")) & (F.col("l0.size") == F.col("l1.size")))
    found = found.join(third, F.col("l0.script") == F.col("l2.script"))
    return found.select(*[F.col(f"l0.{k[5:]}").alias(k) for k in keys], *[F.coalesce(*[f"l{level}.{side}_{i}" for level in range(3)]).alias(f"__tw_{side}_{i}") for side, i in names])


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """`measured` with kept.  Few different tokens are bad and many are not; the other figures have two sides."""
    match = F.lit(True)
    for key, value in _group(measured).items():
        match &= value == limits[key]
    joined = measured.join(limits, match, "left")
    inside = F.lit(True)
    for i, figure in enumerate(FIGURES):
        inside &= F.col(figure) >= F.col(f"__tw_low_{i}")
        if figure != "relative_entropy":
            inside &= F.col(figure) <= F.col(f"__tw_high_{i}")
    return joined.select(*measured.columns, (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
