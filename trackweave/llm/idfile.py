"""Token ids in compressed blocks, written in document order and read back.

Blocks of at most `BLOCK` ids stand alone: each starts from an empty model and carries a CRC-32 of its ids.  A range coder is
told: is the id what followed these two ids last time (order 2)?  Else, what followed this one (order 1)?  Else, by order 0:
is it new to the block?  If so its upper byte by how often such ones came before and its lower byte, else its place in the
list of ids so far by how often such places came before, four bits a step from cumulative frequencies that adapt.  The chances of
the first two are mixed from three adaptive estimates with weights that learn as they go.  All arithmetic is on integers,
so any machine decodes what another wrote.  Many blocks of a task are coded side by side, one lane each, step by step with NumPy.

The container is a Parquet table, written and read by Spark: a row per block with its part (range of documents), number in the
part, ids before it in the part, the documents' pieces in it and the payload.

Defined cases: strings such as <|endoftext|> in a text become their special ids, as the library's plain call does; a null or empty text
has the end id alone; an empty table is a folder without blocks; equal ids of documents follow one another by hash of text, null ids come first;
a document over several blocks is put together again; a block that fails its checksum and an id of more than 16 bits raise an error.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackweave.llm.rows import HASH, KEY, with_key
from trackweave.llm.words import Remembered, Words, slices

BLOCK, LANES, END_ID = 2048, 2048, 1
SLOTS = 1 << 10  # guesses of an order; two contexts that share one take turns
TOP = 1 << 12
FLOOR, RATE = 64, 4
KNOWN, NEW = 1 + 8 + 128, 1 + 16  # nodes of the two nibble trees: places in the list of ids so far, upper byte of new ids


@lru_cache(1)
def curves() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logit (times 256) of a 12-bit probability; back from -2047..2047; where cumulative frequencies go after each of 16 symbols."""
    stretch = np.array([round(256 * math.log((i + 0.5) / (TOP - i - 0.5))) for i in range(TOP)], np.int32)
    squash = np.array([round(TOP / (1 + math.exp(-i / 256))) for i in range(-2047, 2048)], np.int32)
    k = np.arange(16)
    goal = np.where(k[None, :] <= k[:, None], k * FLOOR, (1 << 16) - (16 - k) * FLOOR).astype(np.int32)
    return np.clip(stretch, -2047, 2047), np.clip(squash, 1, TOP - 1), goal


class Coder:
    """A range coder per lane: 48 bits of state, symbols of frequencies out of 65536, units of 16 bits, carries settled at the end."""

    def __init__(self, lanes: int, payload: list[bytes] | None = None):
        self.range, self.low = np.full(lanes, 1 << 48, np.int64), np.zeros(lanes, np.int64)
        self.decoding = payload is not None
        if payload is None:
            self.at, self.units = np.zeros(lanes, np.int64), np.zeros((lanes, 256), np.int32)
            return
        padded = [p + b"\0" * (6 + len(p) % 2) for p in payload]
        size = np.array([len(p) // 2 for p in padded], np.int64)
        self.units = np.frombuffer(b"".join(padded), ">u2").astype(np.int64)
        self.at = np.cumsum(size) - size
        for _ in range(3):
            self.low = self.low << 16 | self.units[self.at]
            self.at += 1

    def step(self, lane: np.ndarray, share: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Codes the symbol [start, start + size) in these lanes; `share` is a 65536th of their range.  Decoding, `low` counts from the range's start."""
        low = self.low[lane]
        low += -share * start if self.decoding else share * start
        width = share * size
        small = np.flatnonzero(width < 1 << 32)
        if len(small):
            own = lane[small]
            at = self.at[own]
            if self.decoding:
                low[small] = low[small] << 16 | self.units[np.minimum(at, len(self.units) - 1)]
            else:
                if at.max() >= self.units.shape[1]:
                    self.units = np.concatenate([self.units, np.zeros_like(self.units)], axis=1)
                self.units[own, at] = low[small] >> 32
                low[small] = (low[small] & 0xFFFFFFFF) << 16
            self.at[own] = at + 1
            width[small] <<= 16
        self.low[lane], self.range[lane] = low, width

    def bit(self, lane: np.ndarray, chance: np.ndarray, truth: np.ndarray | None) -> np.ndarray:
        """chance of a one, of 65536."""
        share = self.range[lane] >> 16
        bit = self.low[lane] < share * chance if truth is None else truth
        self.step(lane, share, np.where(bit, 0, chance), np.where(bit, chance, 65536 - chance))
        return bit

    def finish(self) -> list[bytes]:
        lanes = np.arange(len(self.low))
        if len(lanes) and self.at.max() >= self.units.shape[1]:
            self.units = np.concatenate([self.units, np.zeros_like(self.units)], axis=1)
        self.units[lanes, self.at] = (self.low + 0xFFFFFFFF) >> 32  # zeros follow
        while True:
            carry = self.units >> 16
            if not carry.any():
                break
            self.units &= 0xFFFF
            self.units[:, :-1] += carry[:, 1:]
        return [row[:n + 1].astype(">u2").tobytes() for row, n in zip(self.units, self.at)]


def places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Is the id the first of its kind in its block, and its place in the list of distinct ids so far; a column per block."""
    fresh, place = np.empty(ids.T.shape, bool), np.empty(ids.T.shape, np.uint16)
    first, own = np.zeros(1 << 16, np.int32), np.arange(ids.shape[1], dtype=np.int32)
    for k, row in enumerate(ids):
        first[row[::-1]] = own[::-1]
        at = first[row]
        fresh[:, k] = new = at == own
        place[:, k] = (np.cumsum(new, dtype=np.int32) - 1)[at]
    return fresh, place


def code_blocks(sizes: np.ndarray, ids: np.ndarray | None, payload: list[bytes] | None = None):
    """Codes blocks of these sizes (descending) side by side.  ids: (lanes, longest), filled in when decoding."""
    lanes = len(sizes)
    coder = Coder(lanes, payload)
    decode = payload is not None
    longest = int(sizes.max(initial=0))
    if decode:
        ids, listed, count = np.zeros((lanes, longest), np.int32), np.zeros((lanes, max(longest, 1)), np.uint16), np.zeros(lanes, np.int64)
    else:
        if ids.size and (ids.min() < 0 or ids.max() >= 1 << 16):
            raise ValueError("ids of more than 16 bits")
        fresh_of, place_of = places(ids)
        columns = ids.T.astype(np.uint16, order="C")
    stretch, squash, goal = curves()
    guesses = [np.full(lanes * SLOTS, -16, np.int32) for _ in range(2)]  # an id and 4 bits of trust
    nodes = np.tile((np.arange(16) * 4096).astype(np.uint16), (lanes * (KNOWN + NEW), 1))
    cells = nodes.reshape(-1)
    # estimates of a flag: by trust of its own guess and whether the orders agree, by trust of the other order's, by the flags before
    flags = [[np.full(lanes * 32, 1 << 15, np.int32) for _ in range(3)] for _ in range(2)]
    weights = [[np.full(lanes, 22000, np.int32) for _ in range(3)] for _ in range(2)]
    past = [np.zeros(lanes, np.int32) for _ in range(2)]
    novel, news = np.full(lanes * 16, 1 << 15, np.int32), np.zeros(lanes, np.int32)
    last1, last2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def flag(which, lane, first, second, truth):
        history = past[which][lane]
        at = [lane * 32 + first, lane * 32 + second, lane * 32 + history]
        p = [t[x] for t, x in zip(flags[which], at)]
        s = [stretch[x >> 4] for x in p]
        w = [x[lane] for x in weights[which]]
        mixed = squash[np.clip((s[0] * w[0] + s[1] * w[1] + s[2] * w[2]) >> 16, -2047, 2047) + 2047]
        bit = coder.bit(lane, mixed.astype(np.int64) << 4, truth)
        one = bit.astype(np.int32)
        miss, full = ((one << 12) - mixed) * 6, one * 65535
        for k in range(3):
            weights[which][k][lane] = np.clip(w[k] + ((s[k] * miss + 512) >> 10), -200_000, 200_000)
            flags[which][k][at[k]] = p[k] + ((full - p[k]) >> 4)
        past[which][lane] = (history << 1 & 31) | one
        return bit

    def nibble(lane, node, symbol, raw=None):
        """One of 16 by the node's frequencies; lanes of `raw` have 256 equally likely ones instead."""
        share = coder.range[lane] >> 16
        at = lane * (KNOWN + NEW) + node
        if decode:
            value = np.minimum(coder.low[lane] // share, 65535)
            below = nodes[at] <= value.astype(np.uint16)[:, None]
            symbol = np.bitwise_count(np.packbits(below, axis=1).view(np.uint16))[:, 0].astype(np.int64) - 1
        start = cells[at * 16 + (symbol & 15)].astype(np.int64)
        size = np.where(symbol & 15 == 15, 65536, cells[at * 16 + np.minimum((symbol & 15) + 1, 15)].astype(np.int64)) - start
        if raw is not None:
            if decode:
                symbol = np.where(raw, value >> 8, symbol)
            start, size = np.where(raw, symbol << 8, start), np.where(raw, 256, size)
            at, seen = at[~raw], symbol[~raw]
        else:
            seen = symbol
        coder.step(lane, share, start, size)
        row = nodes[at].astype(np.int32)
        row += (goal[seen] - row) >> RATE
        nodes[at] = row
        return symbol

    width, lane = -1, np.zeros(0, np.int64)
    for i in range(longest):
        active = int(np.searchsorted(-sizes, -i, "left"))
        if active != width:
            width, lane = active, np.arange(active)
        a, b = last1[lane], last2[lane]
        at2 = lane * SLOTS + ((a * 0x9E3779B1 + b * 0x85EBCA77 >> 15) & (SLOTS - 1))
        at1 = lane * SLOTS + ((a * 0x9E3779B1 >> 17) & (SLOTS - 1))
        e2, e1 = guesses[0][at2], guesses[1][at1]
        g2, g1, t2, t1 = e2 >> 4, e1 >> 4, e2 & 15, e1 & 15
        x = np.full(width, -1, np.int32) if decode else columns[i, :width].astype(np.int32)
        agree = (g1 == g2).astype(np.int32) << 4
        hit = np.zeros(width, bool)
        own = np.flatnonzero(g2 >= 0)
        if len(own):
            hit[own] = flag(0, own, t2[own] + agree[own], t1[own], None if decode else x[own] == g2[own])
        if decode:
            x[hit] = g2[hit]
        own = np.flatnonzero(~hit & (g1 >= 0) & (g1 != g2))
        if len(own):
            second = flag(1, own, t1[own], t2[own] + 16, None if decode else x[own] == g1[own])
            hit[own] = second
            if decode:
                x[own[second]] = g1[own[second]]
        rest = np.flatnonzero(~hit)
        if len(rest):
            at = rest * 16 + news[rest]
            p = novel[at]
            fresh = coder.bit(rest, np.clip(p, 64, 65472).astype(np.int64), None if decode else fresh_of[i, rest])
            novel[at] = p + ((fresh * 65535 - p) >> 4)
            news[rest] = (news[rest] << 1 & 15) | fresh
            # 16 bits of a new id, 11 of a place: two nibbles each, then the lower byte or a third nibble
            value = None if decode else np.where(fresh, x[rest], place_of[i, rest].astype(np.int32) << 4).astype(np.int64)
            top = nibble(rest, np.where(fresh, KNOWN, 0), None if decode else value >> 12)
            next_ = nibble(rest, np.where(fresh, KNOWN + 1, 1) + top, None if decode else value >> 8 & 15)
            lower = nibble(rest, np.where(fresh, 0, 9 + (top << 4 | next_)), None if decode else np.where(fresh, value & 255, value >> 4 & 15), fresh)
            if decode:
                added, known = rest[fresh], ~fresh
                place = (top << 8 | next_ << 4 | lower)[known]
                x[rest[known]] = listed[rest[known], np.minimum(place, longest - 1)]
                x[added] = (top << 12 | next_ << 8 | lower)[fresh]
                listed[added, count[added]] = x[added]
                count[added] += 1
        if decode:
            ids[:width, i] = x
        for table, at, e, g, t in ((guesses[0], at2, e2, g2, t2), (guesses[1], at1, e1, g1, t1)):
            same = g == x
            table[at] = np.where(same | (t > 1), e & -16, x << 4) | np.where(same, np.minimum(t + 1, 15), t >> 1)
        last2[lane], last1[lane] = a, x
    return ids if decode else coder.finish()


@lru_cache(1)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def encoded_words(model: Tokenizer, words: list[bytes], some: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and all ids in a row.  Words meet the model as in a text, many at a time with a space between
    them (which it removes); where an id's characters start tells its word."""
    size, flat = np.zeros(len(words), np.int64), []
    for a in range(0, len(words), some):
        strings = [w.decode() for w in words[a:a + some]]
        found = model.encode(" ".join(strings), add_special_tokens=False)
        ids = np.array(found.ids, np.int32)
        if len(ids):
            ends = np.cumsum([len(x) + 1 for x in strings])
            own = np.searchsorted(ends, np.fromiter((x for x, _ in found.offsets), np.int64, len(ids)), "right")
            size[a:a + len(strings)] = np.bincount(own, minlength=len(strings))
        flat.append(ids)
    return size, np.concatenate(flat) if flat else np.zeros(0, np.int32)


@lru_cache(1)
def remembered(path: str) -> Remembered:
    """One for all tasks of a worker."""
    return Remembered(partial(encoded_words, tokenizer(path)), 1 << 16)


def _block_rows(path: str):
    """Documents come in order; a row per block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(path)
        part = TaskContext.get().partitionId()
        held, docs, waiting, number, before = [], [], 0, 0, 0

        def flush(final: bool):
            """Blocks of what waits; what doesn't fill a block stays for later."""
            nonlocal held, docs, waiting, number, before
            ids = np.concatenate(held) if held else np.zeros(0, np.int32)
            use = len(ids) if final else len(ids) // BLOCK * BLOCK
            if use:
                cuts = np.append(np.arange(0, use, BLOCK), use)
                sizes = np.diff(cuts)
                held = []
                lanes = np.zeros((len(sizes), BLOCK), np.int32)
                lanes.ravel()[:use] = ids[:use]
                payload = code_blocks(sizes, lanes[:, :int(sizes.max())])
                del lanes
                edge = np.cumsum([n for *_, n in docs])
                rows, d, done = [], 0, 0
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    names, counts = [], []
                    while a < b:
                        take = min(b, int(edge[d])) - a
                        names.append({KEY: docs[d][0], HASH: docs[d][1], "place": docs[d][2]})
                        counts.append(int(take))
                        a += take
                        if a == edge[d]:
                            d += 1
                    rows.append({"part": part, "block": number + k, "before": before + int(cuts[k]), "n": int(sizes[k]), "crc": zlib.crc32(ids[cuts[k]:cuts[k + 1]].astype("<u4").tobytes()), "docs": names, "counts": counts, "payload": payload[k]})
                left = int(edge[-1]) - use
                docs = ([(*docs[d][:3], int(edge[d]) - use)] + docs[d + 1:]) if left else []
                held, waiting, number, before = [ids[use:].copy()], left, number + len(sizes), before + use
                yield pa.RecordBatch.from_pylist(rows, schema=BLOCK_TYPE)

        place = 0
        for batch in batches:
            for some in slices(batch):
                words = Words(some.column("text"))
                size, flat = known.lists(words.buf, words.start, words.end, words.hashes())
                n = np.bincount(words.text_of(), weights=size, minlength=some.num_rows).astype(np.int64)
                ids = np.insert(flat, np.cumsum(n), END_ID)
                held.append(ids)
                docs += list(zip(some.column(KEY).to_pylist(), some.column(HASH).to_pylist(), range(place, place + len(n)), (n + 1).tolist()))
                place += len(n)
                waiting += len(ids)
                if waiting >= LANES * BLOCK:
                    yield from flush(False)
        yield from flush(True)
    return run


BLOCK_TYPE = pa.schema([
    ("part", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()),
    ("docs", pa.list_(pa.struct([(KEY, pa.int64()), (HASH, pa.int64()), ("place", pa.int64())]))), ("counts", pa.list_(pa.int64())), ("payload", pa.binary())])
BLOCK_DDL = f"part int, block long, before long, n long, crc long, docs array<struct<{KEY}: long, {HASH}: long, place: long>>, counts array<long>, payload binary"


def write_ids(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Writes the ids of all texts of `docs`, each followed by the end id, in ascending order of doc_id to the folder `path`."""
    rows = with_key(docs.select("doc_id", "text")).select(KEY, HASH, "text")
    rows.repartitionByRange(KEY, HASH).sortWithinPartitions(KEY, HASH).mapInArrow(_block_rows(tokenizer_path), BLOCK_DDL).write.parquet(path)


def decoded_blocks(rows: list[dict]) -> list[np.ndarray]:
    order = sorted(range(len(rows)), key=lambda i: -rows[i]["n"])
    sizes = np.array([rows[i]["n"] for i in order], np.int64)
    ids = code_blocks(sizes, None, [rows[i]["payload"] for i in order])
    out: list = [None] * len(rows)
    for lane, i in enumerate(order):
        out[i] = ids[lane, :sizes[lane]]
        if zlib.crc32(out[i].astype("<u4").tobytes()) != rows[i]["crc"]:
            raise ValueError(f"block {rows[i]['part']}/{rows[i]['block']} is damaged")
    return out


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document and block with the ids of the document in it."""
    held: list[dict] = []

    def flush():
        got = {"part": [], "place": [], "block": [], KEY: [], "start": [], "ids": []}
        for row, ids in zip(held, decoded_blocks(held)):
            a = 0
            for doc, n in zip(row["docs"], row["counts"]):
                for k, v in (("part", row["part"]), ("place", doc["place"]), ("block", row["block"]), (KEY, doc[KEY]), ("start", row["before"] + a), ("ids", ids[a:a + n])):
                    got[k].append(v)
                a += n
        for a in range(0, len(got["ids"]), 2000):
            part = {k: v[a:a + 2000] for k, v in got.items()}
            bounds = np.append(0, np.cumsum([len(x) for x in part["ids"]])).astype(np.int32)
            yield pa.record_batch({
                "part": pa.array(part["part"], pa.int32()), "place": pa.array(part["place"], pa.int64()), "block": pa.array(part["block"], pa.int64()), KEY: pa.array(part[KEY], pa.int64()),
                "start": pa.array(part["start"], pa.int64()), "ids": pa.ListArray.from_arrays(bounds, np.concatenate(part["ids"]))})

    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            if len(held) == LANES:
                yield from flush()
                held = []
    if held:
        yield from flush()


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """part, place (of the document in its part), block, KEY, start (in the part) and ids of each document's piece in each block."""
    return spark.read.parquet(path).mapInArrow(_piece_rows, f"part int, place long, block long, {KEY} long, start long, ids array<int>")


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """part and the ids before it; a row per part is all that is windowed."""
    sizes = spark.read.parquet(path).groupBy("part").agg(F.sum("n").alias("n"))
    return sizes.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("offset"))


def _crc(ids: pa.Array) -> pa.Array:
    bounds, flat = np.asarray(ids.offsets), np.asarray(ids.flatten()).astype("<u4")
    bounds = bounds - bounds[0]
    return pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])], pa.int64())


def _pushed(matrix: list[int], v: int) -> int:
    out = 0
    while v:
        low = v & -v
        out ^= matrix[low.bit_length() - 1]
        v ^= low
    return out


@lru_cache(64)
def zeros(k: int) -> list[int]:
    """What 2^k zero bits do to each bit of a CRC-32."""
    if k == 0:
        return [0xEDB88320, *(1 << i for i in range(31))]
    half = zeros(k - 1)
    return [_pushed(half, column) for column in half]


def crc_joined(first: int, second: int, size: int) -> int:
    """The CRC-32 of two byte strings together, from theirs and the second's size: zeros pushed through the first, by doubling."""
    bits = size * 8
    for k in range(bits.bit_length()):
        if bits >> k & 1:
            first = _pushed(zeros(k), first)
    return first ^ second


def _crc_of_pieces(pieces: pa.Array) -> pa.Array:
    out = []
    for own in pieces.to_pylist():
        total = own[0]["crc"]
        for p in own[1:]:
            total = crc_joined(total, p["crc"], 4 * p["n"])
        out.append(total)
    return pa.array(out, pa.int64())


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    pieces = read_pieces(spark, path)
    pieces = pieces.select("part", "place", "block", KEY, "start", F.size("ids").cast("long").alias("n"), F.arrow_udf(_crc, "long")("ids").alias("crc"))
    whole = pieces.groupBy("part", "place").agg(F.first(KEY).alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("pieces"))
    joined = whole.join(part_starts(spark, path), "part")
    return joined.select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", F.arrow_udf(_crc_of_pieces, "long")("pieces").alias("ids_crc32"))
