"""Passages of test items in texts, copied or edited.

Both sides are folded to words of ASCII lower case without ASCII punctuation.  A seed is `SEED` consecutive words of an item; it
is rare when the product of its words' relative frequencies in all texts is at most `RARE` (frequencies of words, not of the
seed: an item that leaked into a third of the corpus keeps its seeds).  An item without a rare seed keeps all of its seeds.
Texts are read where they lie: a bitmap of fixed size (`BITS`) picks positions that may hold a seed, and only the passages
around those positions are shuffled to the items, by an exact join on the seed.  Each passage and item are scored by
Smith-Waterman alignment of words (match 2, mismatch and gap -1) over twice the item's words: 1 is a whole copy.

Defined cases: null and empty texts have no passage; items of fewer than `SEED` words are not searched; rows equal in id and
text count once; ties take the first passage; a null doc_id or item_id is kept as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.rows import HASH, KEY, cut, materialize, with_key
from trackweave.llm.words import PLAIN, Words, slices, take_spans, window_hashes, window_starts

SEED, RARE, BITS, LEAST = 3, 1e-8, 1 << 23, 0.5
PAGE = 1 << 15  # bits of one row of a SQL bitmap


def _item_rows(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "item"):
                words = Words(part.column("item"), PLAIN)
                h = words.hashes()
                at = window_starts(words.count, words.first, seed)
                text = np.repeat(np.arange(len(words.count)), np.maximum(words.count - seed + 1, 0))
                each = h[at[:, None] + np.arange(seed)].view(np.int64)
                out = pa.record_batch({
                    "item_key": part.column("item_key").take(pa.array(text)), "size": words.count[text].astype(np.int64), "seed": window_hashes(h, seed)[at].view(np.int64),
                    "words": pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * seed, each.ravel())})
                yield from cut(out)
    return run


def bitmap(values: DataFrame, name: str, bits: int = BITS) -> np.ndarray:
    """Which of the `bits` values of the column's hash occur: bits / 8 bytes, however many rows there are."""
    bit = F.pmod(F.col(name), F.lit(bits)) + 1  # bit 0 of page 1 stands for 1
    pages = values.select(F.bitmap_bucket_number(bit).alias("page"), F.bitmap_bit_position(bit).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("map")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for page, _map in pages:
        out[(page - 1) * PAGE // 8:page * PAGE // 8] = np.frombuffer(bytes(_map), np.uint8)
    return out


def maybe(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _word_rows(bits: np.ndarray):
    """Occurrences of the words in question, and of all words (null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for part in slices(batch):
                h = Words(part.column("text"), PLAIN).hashes()
                total += len(h)
                word, n = np.unique(h[maybe(h, bits)], return_counts=True)
                yield pa.record_batch({"word": word.view(np.int64), "n": n.astype(np.int64)})
        yield pa.record_batch({"word": pa.array([None], pa.int64()), "n": pa.array([total], pa.int64())})
    return run


def _passage_rows(bits: np.ndarray, seed: int, margin: int):
    """Passages around possible seeds, `margin` words to either side; seeds whose passages touch share one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), PLAIN)
                seeds = window_hashes(words.hashes(), seed)
                at = window_starts(words.count, words.first, seed)
                hit = at[maybe(seeds[at], bits)]
                if not len(hit):
                    continue
                text = np.searchsorted(words.first, hit, "right") - 1
                new = np.append(True, (text[1:] != text[:-1]) | (hit[1:] - hit[:-1] > margin))
                head = np.flatnonzero(new)
                last = np.append(head[1:], len(hit)) - 1
                own = text[head]
                low = np.maximum(hit[head] - margin, words.first[own])
                high = np.minimum(hit[last] + seed + margin, words.first[own + 1])
                bounds = np.append(head, len(hit)).astype(np.int32)
                out = pa.record_batch({
                    KEY: part.column(KEY).take(pa.array(own)), HASH: part.column(HASH).take(pa.array(own)), "start": (low - words.first[own]).astype(np.int64),
                    "seeds": pa.ListArray.from_arrays(bounds, seeds[hit].view(np.int64)), "passage": take_spans(words.buf, words.start[low], words.end[high - 1]).cast(pa.binary())})
                yield from cut(out, 2000)
    return run


def local_alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two sequences, and the (first) end in the passage at which it is reached."""
    place = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == word, 2, -1))
        row = np.maximum.accumulate(new + place) - place  # gaps in the item's row
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _score_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "passage"):
            item, passage = Words(part.column("item"), PLAIN), Words(part.column("passage").cast(pa.large_binary()).cast(pa.large_string()))
            a, b = item.hashes(), passage.hashes()
            score, low, high = (np.zeros(part.num_rows, t) for t in (float, np.int64, np.int64))
            first = np.asarray(part.column("start"))
            for i in range(part.num_rows):
                x, y = a[item.first[i]:item.first[i + 1]], b[passage.first[i]:passage.first[i + 1]]
                best, end = local_alignment(x, y)
                back = local_alignment(x[::-1], y[:end][::-1])[1]
                score[i], low[i], high[i] = best / (2 * len(x)), first[i] + end - back, first[i] + end
            yield pa.record_batch({KEY: part.column(KEY), HASH: part.column(HASH), "item_key": part.column("item_key"), "score": score, "start_word": low, "end_word": high})


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST, seed: int = SEED, rare: float = RARE, bits: int = BITS) -> DataFrame:
    """Row key of documents, item_id, score and the words [start_word, end_word) of the best passage, for scores of `least` and more."""
    keyed = with_key(docs.select("doc_id", "text")).select(KEY, HASH, "text")
    tests = items.select("item_id", F.col("text").alias("item")).where("item IS NOT NULL").distinct()
    tests = materialize(tests.withColumn("item_key", F.xxhash64("item_id", "item")))
    parts = materialize(tests.select("item_key", "item").mapInArrow(_item_rows(seed), "item_key long, size long, seed long, words array<long>"))
    longest = parts.agg(F.max("size")).first()[0] or 0
    vocabulary = parts.select(F.explode("words").alias("word"))
    counted = keyed.select("text").mapInArrow(_word_rows(bitmap(vocabulary, "word", bits)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialize(counted)
    total = max(counted.where("word IS NULL").agg(F.sum("n")).first()[0] or 0, 1)
    each = parts.select("item_key", "seed", F.explode("words").alias("word")).join(counted.where("word IS NOT NULL"), "word", "left")
    odds = each.groupBy("item_key", "seed").agg(F.sum(F.log(F.coalesce("n", F.lit(1)) / total)).alias("log_p"), F.count("*").alias("k"))
    odds = odds.withColumn("is_rare", F.col("log_p") * seed / F.col("k") <= float(np.log(rare)))
    some = odds.groupBy("item_key").agg(F.max("is_rare").alias("some"))
    seeds = materialize(odds.join(some, "item_key").where("is_rare OR NOT some").select("seed", "item_key").distinct())

    passages = keyed.mapInArrow(_passage_rows(bitmap(seeds, "seed", bits), seed, int(longest)), f"{KEY} long, {HASH} long, start long, seeds array<long>, passage binary")
    passages = materialize(passages.distinct())
    pairs = passages.select(KEY, HASH, "start", F.explode(F.array_distinct("seeds")).alias("seed")).join(seeds, "seed").select(KEY, HASH, "start", "item_key").distinct()
    pairs = pairs.withColumnsRenamed({KEY: "k2", HASH: "h2", "start": "s2"})
    found = passages.join(pairs, passages[KEY].eqNullSafe(pairs["k2"]) & (passages[HASH] == pairs["h2"]) & (passages["start"] == pairs["s2"])).select(KEY, HASH, "start", "item_key", "passage")
    found = found.join(tests.select("item_key", "item"), "item_key").mapInArrow(_score_rows, f"{KEY} long, {HASH} long, item_key long, score double, start_word long, end_word long")
    best = found.where(F.col("score") >= least).groupBy(KEY, HASH, "item_key").agg(F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word"))).alias("b"))
    return best.join(tests.select("item_key", "item_id"), "item_key").select(KEY, HASH, "item_id", "b.score", "b.start_word", "b.end_word")


def drop_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that hold no passage of an item."""
    keyed = with_key(docs)
    bad = contaminated(docs, items, **how).select(F.col(KEY).alias("__tw_doc2"), F.col(HASH).alias("__tw_hash2")).distinct()
    return keyed.join(bad, keyed[KEY].eqNullSafe(bad["__tw_doc2"]) & (keyed[HASH] == bad["__tw_hash2"]), "left_anti").select(*docs.columns)
