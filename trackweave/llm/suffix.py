"""Repeated passages by sparse suffixes.

Of the suffixes of all texts (in words) those stay that start at a minimiser: the least hashed run of `GRAM` words among
`SPREAD` neighbouring ones.  Two equal passages keep the same suffixes.  A suffix matters if its first `HEAD` words start
another kept suffix too; `HEAD` = passage - SPREAD + 1, so every passage of `passage` words or more that occurs twice has one.

1. heads are counted by hash; suffixes whose head occurs once go;
2. each other suffix is extended by the same words on both sides: every run of `passage` words has one suffix of its own (its first
   `SPREAD` words' minimiser), so a suffix lists the hashes of the runs it stands for;
3. equal lists collapse to one with a count, the runs of what is left are counted by hash, and a run that occurs twice is repeated as a
   whole, with one and the same partner.  A head that a third of all texts shares is split: lists are dealt by their hash, runs by theirs;
4. repeated runs that overlap in a text are one passage; those that merely touch are two.

Defined cases: null, empty and short texts have no passage; rows equal in id and text are two texts; a null doc_id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.rows import HASH, KEY, cut, materialize, on_key, with_key
from trackweave.llm.words import Words, mix, sliding_min, slices, window_hashes, window_starts

PASSAGE, GRAM, SPREAD = 50, 4, 20
POSITION = np.uint64((1 << 28) - 1)


def minimisers(h: np.ndarray, gram: int = GRAM, spread: int = SPREAD) -> np.ndarray:
    """The least hashed run of `gram` words among the `spread` from each position on, the first of equal ones."""
    grams = window_hashes(h, gram)
    ranked = (mix(grams) & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
    return (sliding_min(ranked, spread) & POSITION).astype(np.int64)


def kept_suffixes(words: Words, head: int, gram: int = GRAM, spread: int = SPREAD):
    """Text, position in it, ordinal in it and head hash of the suffixes at minimisers that are `head` words long at least."""
    h = words.hashes()
    minimiser = minimisers(h, gram, spread)
    rooms = np.maximum(words.count - (spread + gram - 1) + 1, 0)
    at = np.arange(rooms.sum()) + np.repeat(words.first[:-1] - (np.cumsum(rooms) - rooms), rooms)
    least = np.unique(minimiser[at]) if len(at) else at
    text = np.searchsorted(words.first, least, "right") - 1
    long = least + head <= words.first[text + 1]
    least, text = least[long], text[long]
    n = np.bincount(text, minlength=len(words.count))
    ordinal = np.arange(len(least)) - np.repeat(np.cumsum(n) - n, n)
    heads = window_hashes(h, head)
    return text, least - words.first[text], ordinal, heads[least].view(np.int64) if len(least) else np.zeros(0, np.int64)


def _head_rows(head: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                value, n = np.unique(kept_suffixes(Words(part.column("text")), head)[3], return_counts=True)
                yield from cut(pa.record_batch({"head": value, "n": n.astype(np.int64)}))
    return run


def _suffix_rows(head: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text, at, ordinal, value = kept_suffixes(Words(part.column("text")), head)
                take = pa.array(text)
                yield from cut(pa.record_batch({KEY: part.column(KEY).take(take), HASH: part.column(HASH).take(take), "at": at.astype(np.int32), "ordinal": ordinal.astype(np.int32), "head": value}))
    return run


def _window_rows(passage: int):
    """Per wanted suffix the hashes of the runs of `passage` words that it stands for, and where the first one starts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                at = window_starts(words.count, words.first, passage)
                if not len(at):
                    continue
                h = words.hashes()
                lists = part.column("wanted")
                wanted = np.zeros(len(words), bool)
                wanted[np.repeat(words.first[:-1], lists.value_lengths().to_numpy()) + lists.flatten().to_numpy()] = True
                least = minimisers(h)[at]
                at, least = at[wanted[least]], least[wanted[least]]
                first = np.flatnonzero(np.append(True, least[1:] != least[:-1])) if len(at) else at
                text = np.searchsorted(words.first, at[first], "right") - 1
                take = pa.array(text)
                value = window_hashes(h, passage)[at].view(np.int64)
                yield from cut(pa.record_batch({
                    KEY: part.column(KEY).take(take), HASH: part.column(HASH).take(take), "start": (at[first] - words.first[text]).astype(np.int32),
                    "windows": pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(value))}), 20_000)
    return run


def repeated_passages(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """Row key and words [start_word, end_word) of every run of `passage` words or more that occurs elsewhere."""
    head = passage - SPREAD + 1
    keyed = with_key(docs.select("doc_id", "text")).select(KEY, HASH, "text")
    heads = keyed.select("text").mapInArrow(_head_rows(head), "head long, n long").groupBy("head").agg(F.sum("n").alias("n")).where("n > 1").select("head")
    heads = materialize(heads)  # as a table of its own, so that the join can split a head that many rows share
    suffixes = materialize(keyed.mapInArrow(_suffix_rows(head), f"{KEY} long, {HASH} long, at int, ordinal int, head long").join(heads, "head", "left_semi"))

    wanted = suffixes.groupBy(KEY, HASH).agg(F.collect_set("at").alias("wanted"))
    texts = keyed.join(wanted, on_key(keyed, wanted)).select(keyed[KEY], keyed[HASH], keyed["text"], "wanted")
    rows = materialize(texts.mapInArrow(_window_rows(passage), f"{KEY} long, {HASH} long, start int, windows array<long>").withColumn("list", F.xxhash64("windows")))
    lists = materialize(rows.groupBy("list").agg(F.count("*").alias("n"), F.first("windows").alias("windows")))
    each = lists.select("list", "n", F.posexplode("windows").alias("i", "window"))
    twice = materialize(each.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window"))
    found = each.join(twice, "window", "left_semi").groupBy("list").agg(F.sort_array(F.collect_list("i")).alias("i"))
    edge = lambda side: F.filter("i", lambda x: ~F.array_contains("i", x + side))
    found = materialize(found.select("list", F.arrays_zip(edge(-1).alias("a"), edge(1).alias("b")).alias("runs")))
    spans = rows.join(found, "list").select(KEY, HASH, "start", F.explode("runs").alias("r"))
    spans = spans.select(KEY, HASH, (F.col("start") + F.col("r.a")).alias("start_word"), (F.col("start") + F.col("r.b") + passage).alias("end_word"))
    own = Window.partitionBy(KEY, HASH).orderBy("start_word", "end_word")
    merged = spans.withColumn("until", F.max("end_word").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    merged = merged.withColumn("part", F.sum(F.coalesce(F.col("start_word") >= F.col("until"), F.lit(True)).cast("int")).over(own))
    return merged.groupBy(KEY, HASH, "part").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).select(KEY, HASH, "start_word", "end_word")
