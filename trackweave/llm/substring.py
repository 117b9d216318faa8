"""Exact removal of repeated word windows by super-k-mer partitioning.

Every window of `window` words has a minimiser: the least hashed run of `seed_words` words in it, the leftmost at a tie.
Consecutive windows with the same minimiser form one super-k-mer and travel together.  Equal windows have equal
minimisers at equal offsets, so they meet under one seed:

1. count seeds over all texts; a seed that occurs once holds no repeated window (8 bytes a super-k-mer are shuffled);
2. super-k-mers with a repeated seed are counted by content; equal ones collapse into one row before anything meets;
3. where one seed has several different super-k-mers, one packed string of each goes to the bucket of its seed; there
   windows are sorted and counted, equal hashes compared byte by byte.  Seeds with more than `hot` different super-k-mers
   are not gathered: their windows are counted one by one as rows keyed by the window itself;
4. repeated ranges go back to the documents by row key.

Defined cases: a null or empty text has no words and is kept as "" with n_words 0; a repeated row is a second occurrence of
its windows, so all of both go; a null doc_id is a document of its own; output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.rows import HASH, KEY, cut, materialize, on_key, with_key
from trackweave.llm.words import Words, covered, sliding_min, slices, take_spans, window_hashes, window_starts

WINDOW, SEED_WORDS, HOT = 35, 8, 4096
POSITION = np.uint64((1 << 28) - 1)


def super_kmers(words: Words, window: int, k: int):
    """Per super-k-mer: text, first window (word index), number of windows, seed, hash of its content."""
    h = words.hashes()
    at = window_starts(words.count, words.first, window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    seeds = window_hashes(h, k)
    ranked = (seeds & ~POSITION) | np.arange(len(seeds), dtype=np.uint64)
    least = (sliding_min(ranked, window - k + 1)[at] & POSITION).astype(np.int64)
    text = np.repeat(np.arange(len(words.count)), np.maximum(words.count - window + 1, 0))
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at)))
    wide = window_hashes(h, window)[at]
    content = np.add.reduceat(wide * (2 * (np.arange(len(at)) - np.repeat(head, size)).astype(np.uint64) + np.uint64(1)), head)
    return text[head], at[head], size, seeds[least[head]].view(np.int64), content.view(np.int64)


def _seed_rows(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                seed = super_kmers(Words(part.column("text")), window, k)[3]
                once, n = np.unique(seed, return_counts=True)
                yield from cut(pa.record_batch({"seed": once, "n": n.astype(np.int64)}))
    return run


def _super_kmer_rows(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                text, at, size, seed, content = super_kmers(words, window, k)
                yield from cut(pa.record_batch({
                    KEY: part.column(KEY).take(pa.array(text)), HASH: part.column(HASH).take(pa.array(text)),
                    "start": (at - words.first[text]).astype(np.int32), "windows": size.astype(np.int32), "seed": seed, "content": content}))
    return run


def _packed_rows(window: int):
    """Per document and wanted super-k-mer the packed string: its words joined by one space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, wanted = Words(part.column("text")), part.column("wanted")
                each = wanted.flatten()
                n = np.diff(np.asarray(wanted.offsets))
                base = np.repeat(words.first[:-1], n)
                first = base + each.field("start").to_numpy()
                last = first + each.field("windows").to_numpy() + window - 2
                pack = [b" ".join(words.buf[words.start[a]:words.end[b]].tobytes().split()) for a, b in zip(first, last)]
                out = pa.record_batch({"seed": each.field("seed"), "content": each.field("content"), "n": each.field("n"), "hot": each.field("hot"), "packed": pa.array(pack, pa.binary())})
                yield from cut(out, 5000)
    return run


def _count_windows(rows: pa.Table, window: int) -> pa.RecordBatch:
    """The repeated windows of whole buckets: sorted by hash, equal neighbours compared by their bytes."""
    words = Words(rows.column("packed").combine_chunks().cast(pa.large_binary()).cast(pa.large_string()))
    at = window_starts(words.count, words.first, window)
    hashes = window_hashes(words.hashes(), window)[at]
    row = np.repeat(np.arange(len(words.count)), words.count - window + 1)
    n = rows.column("n").to_numpy()[row]
    start, end = words.start[at], words.end[at + window - 1]
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    same = np.flatnonzero(sorted_[1:] == sorted_[:-1])
    a, b = order[same], order[same + 1]
    equal = np.array_equal(end[a] - start[a], end[b] - start[b]) and take_spans(words.buf, start[a], end[a]).equals(take_spans(words.buf, start[b], end[b]))
    if equal:
        head = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(order) else np.zeros(0, np.int64)
        total = np.add.reduceat(n[order], head) if len(order) else n
        hit = np.zeros(len(order), bool)
        hit[order] = np.repeat(total >= 2, np.diff(np.append(head, len(order))))
    else:  # two windows share a hash: count by the windows themselves
        keys = [words.buf[s:e].tobytes() for s, e in zip(start, end)]
        total = {}
        for key, times in zip(keys, n):
            total[key] = total.get(key, 0) + times
        hit = np.array([total[key] >= 2 for key in keys])
    return _ranges(rows, words.count, window, row[hit], (at - words.first[row])[hit])


def _ranges(rows: pa.Table, count: np.ndarray, window: int, row: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    """Consecutive repeated windows as ranges of words within their super-k-mer."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(row)) - 1
    at = pa.array(row[head])
    return pa.record_batch({
        "seed": rows.column("seed").combine_chunks().take(at), "content": rows.column("content").combine_chunks().take(at),
        "low": offset[head].astype(np.int32), "high": (offset[last] + window if len(head) else last).astype(np.int32)})


def _bucket_rows(window: int, limit: int = 20_000):
    """Rows come sorted by seed; whole buckets are counted together, about `limit` rows at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < limit:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            seed = table.column("seed").to_numpy()
            whole = int(np.searchsorted(seed, seed[-1], "left"))
            if whole:
                yield from cut(_count_windows(table.slice(0, whole), window))
            held = table.slice(whole).to_batches()
            rows = table.num_rows - whole
        if rows:
            yield from cut(_count_windows(pa.Table.from_batches(held), window))
    return run


def _window_rows(window: int):
    """Windows of hot seeds, one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "packed", 1 << 18):
                words = Words(part.column("packed").cast(pa.large_binary()).cast(pa.large_string()))
                at = window_starts(words.count, words.first, window)
                row = np.repeat(np.arange(len(words.count)), words.count - window + 1)
                take = pa.array(row)
                yield from cut(pa.record_batch({
                    "seed": part.column("seed").take(take), "content": part.column("content").take(take), "n": part.column("n").take(take),
                    "low": (at - words.first[row]).astype(np.int32), "words": take_spans(words.buf, words.start[at], words.end[at + window - 1]).cast(pa.binary())}), 10_000)
    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS, hot: int = HOT) -> DataFrame:
    """Row key and the ranges [low, high) of words that lie in a window occurring elsewhere; documents without any are missing."""
    keyed = with_key(docs.select("doc_id", "text")).select(KEY, HASH, "text")
    seeds = keyed.select("text").mapInArrow(_seed_rows(window, seed_words), "seed long, n long")
    seeds = seeds.groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").select("seed")
    seeds = materialize(seeds)  # as a table of its own, so that the join can split a seed that many rows share
    names = f"{KEY} long, {HASH} long, start int, windows int, seed long, content long"
    hits = materialize(keyed.mapInArrow(_super_kmer_rows(window, seed_words), names).join(seeds, "seed", "left_semi"))

    one = F.min_by(F.struct(KEY, HASH, "start", "windows"), F.struct(KEY, HASH, "start"))
    contents = materialize(hits.groupBy("seed", "content").agg(F.count("*").alias("n"), one.alias("one")))
    several = contents.groupBy("seed").agg(F.count("*").alias("kinds")).where("kinds > 1")
    alone = contents.join(several, "seed", "left_anti").where("n > 1")
    contested = contents.join(several, "seed").select("one.*", "seed", "content", "n", (F.col("kinds") > hot).alias("hot"))
    wanted = contested.groupBy(KEY, HASH).agg(F.collect_list(F.struct("start", "windows", "seed", "content", "n", "hot")).alias("wanted"))
    packed = keyed.join(wanted, on_key(keyed, wanted)).select(keyed["text"], "wanted")
    packed = materialize(packed.mapInArrow(_packed_rows(window), "seed long, content long, n long, hot boolean, packed binary"))

    ranges = "seed long, content long, low int, high int"
    bucket = packed.where("NOT hot").select("seed", "content", "n", "packed").repartition("seed").sortWithinPartitions("seed")
    cold = bucket.mapInArrow(_bucket_rows(window), ranges)
    each = packed.where("hot").mapInArrow(_window_rows(window), "seed long, content long, n long, low int, words binary")
    twice = each.groupBy("words").agg(F.sum("n").alias("times")).where("times > 1").select("words")
    warm = each.join(twice, "words", "left_semi").select("seed", "content", "low", (F.col("low") + window).alias("high"))
    found = cold.unionByName(warm).unionByName(alone.select("seed", "content", F.lit(0).alias("low"), (F.col("one.windows") + window - 1).alias("high")))
    found = found.distinct()  # rows repeated in id and text are packed once each
    back = hits.join(found, ["seed", "content"]).select(KEY, HASH, (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    return back.groupBy(KEY, HASH).agg(F.collect_set(F.struct("low", "high")).alias("__tw_ranges"))


def _kept(text: pa.Array, ranges: pa.Array) -> pa.Array:
    batch = pa.record_batch({"text": text, "ranges": ranges})
    n_words, n_removed, kept = [], [], []
    for part in slices(batch):
        words = Words(part.column("text"))
        for t, spans in enumerate(part.column("ranges").to_pylist()):
            a, b = words.first[t], words.first[t + 1]
            own = words.buf[words.offsets[t]:words.offsets[t + 1]].tobytes().split()
            if spans:
                gone = covered(b - a, np.array([s["low"] for s in spans]), np.array([s["high"] for s in spans]))
                stay = np.flatnonzero(~gone)
                n_removed.append(len(own) - len(stay))
                own_kept = [own[i] for i in stay]
            else:
                n_removed.append(0)
                own_kept = own
            n_words.append(len(own))
            kept.append(b" ".join(own_kept).decode())
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["n_words", "n_removed", "kept_text"])


def drop_repeated_windows(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS, hot: int = HOT) -> DataFrame:
    """All rows and columns of `docs` with n_words, n_removed and kept_text (the kept words joined by one space)."""
    keyed = with_key(docs)
    ranges = repeated_ranges(docs, window, seed_words, hot).withColumnsRenamed({KEY: "__tw_doc2", HASH: "__tw_hash2"})
    joined = keyed.join(ranges, keyed[KEY].eqNullSafe(ranges["__tw_doc2"]) & keyed[HASH].eqNullSafe(ranges["__tw_hash2"]), "left")
    kept = F.arrow_udf(_kept, "struct<n_words: bigint, n_removed: bigint, kept_text: string>")
    done = joined.withColumn("__tw_kept", kept("text", "__tw_ranges"))
    out = ("n_words", "n_removed", "kept_text")
    return done.select(*[c for c in docs.columns if c not in out], *[F.col(f"__tw_kept.{c}").alias(c) for c in out])
