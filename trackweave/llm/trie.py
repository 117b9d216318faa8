"""A z-fast trie over sequences, as a table of compacted nodes that Spark joins search and grow.

A sequence is an array of prefix keys: the key of depth d is 128 bits drawn from its first d symbols and their places.  A node of the trie
is an edge: the prefix keys of depths p + 1 to e, where e is its extent and p that of its parent.  It is found by its handle, the
prefix of two-fattest depth in (p, e], the number there with the most trailing zero bits.  The node at which a sequence leaves the trie is
located by fat binary search: of the depths still open the two-fattest is looked up by its key; a hit moves below that node,
a miss above that depth.  So a search of a sequence of n symbols takes about log2(n) equi joins, not n.

Sequences are inserted in batches.  Those of a batch are searched in the trie so far; where they leave an edge half-way, the edge is
split, and what lies beyond is grouped by prefix key, whose least and greatest next key tell a fork.  Only what is new is grouped, by sums,
least and greatest values that combine before the shuffle.  Figures of subtrees are summed over the nodes above each node (listed by
pointer doubling), and edges are expanded into one row per depth at the end.

Sequences that are alike are one before anything joins, and a join has one row per key on the trie's side, so a frequent first
turn is a skewed join that Spark splits.  A conversation is held as 40 bytes a turn; its texts never leave the scan.

Defined cases: null roles and texts are empty; turns of one place are ordered by a digest of role and text, nulls first; rows without a
conversation id belong to no conversation; an empty table has no nodes; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.rows import materialize
from trackweave.llm.streams import ordered_stream

#: Part of the sequences that is in the trie after each batch.
BATCHES = (0.125, 1.0)
IDS_A_LINE = 1 << 16
KEY = "struct<a: bigint, b: bigint>"
STEP = "struct<a: bigint, b: bigint, before: bigint, upto: bigint>"
NO_IDS = hashlib.sha256(b"").hexdigest()


def prefixes(first: pa.Array, second: pa.Array, size: pa.Array) -> pa.Array:
    """Per sequence and depth the prefix key, and the sum of sizes before and up to that depth; all lists have equal lengths."""
    offsets = np.asarray(first.offsets, dtype=np.int64)
    n = np.diff(offsets)
    begin = np.repeat(offsets[:-1] - offsets[0], n)

    def running(column: pa.Array, add: np.ufunc, kind) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros(offsets[-1] - offsets[0] + 1, kind)
        add.accumulate(np.asarray(column.flatten(), dtype=kind), out=total[1:])
        return total[:-1], total

    keys = []
    for column in (first, second):
        _, total = running(column, np.bitwise_xor, np.int64)
        keys.append(total[1:] ^ total[begin])
    before, total = running(size, np.add, np.int64)
    steps = pa.StructArray.from_arrays([pa.array(v) for v in (*keys, before - total[begin], total[1:] - total[begin])], names=["a", "b", "before", "upto"])
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), steps)


def sequences(symbols: DataFrame) -> DataFrame:
    """id, len and steps of rows (id, symbols array<struct<digest, size>>)."""
    place = F.transform("symbols", lambda s, i: F.struct(
        F.xxhash64(F.lit(1), i, s["digest"]).alias("a"), F.xxhash64(F.lit(2), i, s["digest"]).alias("b"), s["size"].cast("long").alias("size")))

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield prefixes(*columns)

    keyed = symbols.select("id", place.alias("_s"))
    return keyed.select("id", F.size("_s").alias("len"), F.arrow_udf(run, f"array<{STEP}>")("_s.a", "_s.b", "_s.size").alias("steps"))


def key_at(steps: Column, depth: Column) -> Column:
    """The prefix key at a depth; that of depth 0 is (0, 0), beyond the end null."""
    at = F.get(steps, depth - 1)
    return F.when(depth == 0, F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))).otherwise(F.struct(at["a"].alias("a"), at["b"].alias("b")))


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] with the most trailing zero bits."""
    block = F.pow(F.lit(2.0), F.length(F.bin(low.bitwiseXOR(high))) - 1).cast("int")
    return high - high % block


def locate(batch: DataFrame, trie: DataFrame, longest: int) -> DataFrame:
    """Adds `met`, the extent of the lowest node that is a prefix of the sequence, found by fat binary search over the handles."""
    handles = trie.select(
        F.col("handle.a").alias("_ha"), F.col("handle.b").alias("_hb"), F.col("fat").alias("_hf"), F.col("p").alias("_p"), F.col("e").alias("_e"), F.col("key").alias("_ekey"))
    at = batch.withColumns({"_low": F.lit(0), "_high": F.col("len")})
    for _ in range(longest.bit_length()):
        open_ = F.col("_low") < F.col("_high")
        at = at.withColumn("_f", F.when(open_, two_fattest(F.col("_low"), F.col("_high"))))
        at = at.withColumn("_k", F.when(F.col("_f").isNotNull(), key_at(F.col("steps"), F.col("_f"))))
        at = at.join(handles, (F.col("_k.a") == F.col("_ha")) & (F.col("_k.b") == F.col("_hb")) & (F.col("_f") == F.col("_hf")), "left")
        hit = F.col("_e").isNotNull()
        whole = hit & (F.col("_e") <= F.col("len")) & F.coalesce(key_at(F.col("steps"), F.col("_e")) == F.col("_ekey"), F.lit(False))
        # a node whose handle is met but not its extent is the one at which the sequence leaves: the one above it is whole
        low = F.when(whole, F.col("_e")).when(hit, F.col("_p")).otherwise(F.col("_low"))
        high = F.when(~open_ | whole, F.col("_high")).when(hit, F.col("_p")).otherwise(F.col("_f") - 1)
        at = at.select(*batch.columns, low.alias("_low"), high.alias("_high"))
    return at.select(*batch.columns, F.col("_low").alias("met"))


def _edges(of: DataFrame) -> DataFrame:
    """Trie rows from rows (p0, steps, cuts): a node for each two neighbours of p0 and `cuts`; steps begin at depth p0 + 1."""
    ends = F.array_sort("cuts")
    pairs = F.transform(ends, lambda e, i: F.struct(F.when(i == 0, F.col("p0")).otherwise(F.get(ends, i - 1)).alias("p"), e.alias("e")))
    each = of.select("p0", "up0", "steps", F.explode(pairs).alias("_c")).select("p0", "up0", "steps", "_c.p", "_c.e")
    own = F.slice("steps", F.col("p") - F.col("p0") + 1, F.col("e") - F.col("p"))
    fat = two_fattest(F.col("p"), F.col("e"))
    key = lambda depth: key_at(F.col("steps"), depth - F.col("p0"))
    return each.select(
        key(F.col("e")).alias("key"), "p", "e", F.when(F.col("p") == F.col("p0"), F.col("up0")).otherwise(key(F.col("p"))).alias("up"),
        fat.alias("fat"), key(fat).alias("handle"), own.alias("steps"))


def insert(trie: DataFrame | None, batch: DataFrame, longest: int) -> DataFrame:
    """The trie with the sequences of `batch` (len, steps; none of length 0)."""
    if trie is None:
        left, stays = batch.select("len", "steps", F.lit(0).alias("common")), None
    else:
        met = locate(batch.select("len", "steps"), trie, longest)
        child = trie.select(F.get("steps", F.lit(0)).alias("_first"), F.col("p").alias("_p"), F.col("e").alias("_e"), F.col("key").alias("_key"), F.col("steps").alias("_steps"))
        child = child.select(F.col("_first.a").alias("_fa"), F.col("_first.b").alias("_fb"), "_p", "_e", "_key", "_steps")
        ahead = key_at(F.col("steps"), F.col("met") + 1)
        met = met.withColumns({"_na": ahead["a"], "_nb": ahead["b"]})
        met = met.join(child, (F.col("_na") == F.col("_fa")) & (F.col("_nb") == F.col("_fb")) & (F.col("met") == F.col("_p")), "left")
        # prefix keys agree up to where the sequences part, so the number of equal ones is the length of what is common
        same = F.size(F.filter(F.arrays_zip(F.col("_steps").alias("x"), F.slice("steps", F.col("met") + 1, F.col("_e") - F.col("met")).alias("y")),
                               lambda s: (s["x"]["a"] == s["y"]["a"]) & (s["x"]["b"] == s["y"]["b"])))
        met = materialize(met.select("len", "steps", F.col("_key").alias("edge"), F.col("_e").alias("edge_end"), (F.col("met") + F.when(F.col("_e").isNull(), 0).otherwise(same)).alias("common")))
        cuts = met.where((F.col("common") < F.col("edge_end"))).groupBy(F.col("edge.a").alias("_a"), F.col("edge.b").alias("_b")).agg(F.collect_set("common").alias("_cuts"))
        known = trie.join(cuts, (F.col("key.a") == F.col("_a")) & (F.col("key.b") == F.col("_b")), "left")
        pieces = _edges(known.where("_cuts IS NOT NULL").select(F.col("p").alias("p0"), F.col("up").alias("up0"), "steps", F.array_union("_cuts", F.array("e")).alias("cuts")))
        stays = known.where("_cuts IS NULL").select(*trie.columns).unionByName(pieces)
        left = met.where("common < len").select("len", "steps", "common")
    left = materialize(left.withColumn("_id", F.struct(F.col("common").alias("c"), F.get("steps", F.size("steps") - 1).alias("k"))))
    depths = left.select(
        "_id", "len", "common", F.posexplode(F.expr("slice(steps, common + 1, len - common)")).alias("i", "step"), "steps").select(
        "_id", (F.col("common") + F.col("i") + 1).alias("d"), F.col("step.a").alias("a"), F.col("step.b").alias("b"),
        F.get("steps", F.col("common") + F.col("i") + 1).alias("next")).withColumn("next", F.struct("next.a", "next.b"))
    depths = depths.withColumn("next", F.when(F.col("next.a").isNotNull(), F.col("next")))
    forks = depths.groupBy("a", "b", "d").agg(F.min("next").alias("lo"), F.max("next").alias("hi"), F.bool_or(F.col("next").isNull()).alias("end"))
    forks = forks.where(F.col("end") | (F.col("lo") != F.col("hi"))).select("a", "b", "d")
    cuts = depths.select("_id", "a", "b", "d").join(forks, ["a", "b", "d"]).groupBy("_id").agg(F.collect_set("d").alias("cuts"))
    tails = left.join(cuts, "_id").select(F.col("common").alias("p0"), key_at(F.col("steps"), F.col("common")).alias("up0"), F.expr("slice(steps, common + 1, len - common)").alias("steps"), "cuts")
    fresh = _edges(tails).groupBy("key", "e").agg(*[F.first(c).alias(c) for c in ("p", "up", "fat", "handle", "steps")])
    names = ["key", "p", "e", "up", "fat", "handle", "steps"]
    return materialize(fresh.select(*names) if stays is None else stays.select(*names).unionByName(fresh.select(*names)))


def build(distinct: DataFrame, batches: tuple[float, ...] = BATCHES) -> tuple[DataFrame | None, int]:
    """The trie of rows (len, steps), each sequence once, and the longest length; no trie where all are empty."""
    some = distinct.where("len > 0")
    longest = some.agg(F.max("len")).first()[0]
    if longest is None:
        return None, 0
    trie, done = None, 0.0
    share = F.pmod(F.xxhash64(F.get("steps", F.size("steps") - 1)), F.lit(1 << 20)) / (1 << 20)
    for upto in batches:
        batch = some.where((share >= done) & (share < upto))
        if trie is not None or not batch.isEmpty():
            trie = insert(trie, batch, longest)
        done = upto
    return trie, longest


def with_above(trie: DataFrame, longest: int) -> DataFrame:
    """Adds `above`, the keys of the node and of all nodes over it but the root, by doubling."""
    root = (F.col("up.a") == 0) & (F.col("up.b") == 0)
    at = trie.withColumns({"above": F.array("key"), "_to": F.when(~root, F.col("up"))})
    for _ in range(longest.bit_length()):
        at = materialize(at)
        jump = at.select(F.col("key.a").alias("_ja"), F.col("key.b").alias("_jb"), F.col("above").alias("_more"), F.col("_to").alias("_next"))
        at = at.join(jump, (F.col("_to.a") == F.col("_ja")) & (F.col("_to.b") == F.col("_jb")), "left").select(
            *trie.columns, F.when(F.col("_more").isNull(), F.col("above")).otherwise(F.concat("above", "_more")).alias("above"), F.col("_next").alias("_to"))
    return materialize(at.drop("_to"))


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest = None, None
    kinds = [pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        done = []
        for a, b, line in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "line")]):
            if now != (a, b):
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(line.encode())
        yield pa.record_batch([pa.array([r[i] for r in done], kind) for i, kind in enumerate(kinds)], names=["a", "b", "ids_sha256"])
    if now is not None:
        yield pa.record_batch([pa.array([v], kind) for v, kind in zip((*now, digest.hexdigest()), kinds)], names=["a", "b", "ids_sha256"])


def ids_digests(ends: DataFrame, ids_a_line: int = IDS_A_LINE) -> DataFrame:
    """a, b and the SHA-256 of the ids of rows (a, b, id) that end there, ascending and joined by commas.

    Ids are written out in lines of at most `ids_a_line`; only keys with several lines are hashed line by line.
    """
    lines = ends.groupBy("a", "b", F.floor(F.col("id") / ids_a_line).alias("part")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda v: v.cast("string")), ",").alias("line"))
    lines = materialize(lines)
    count = lines.groupBy("a", "b").agg(F.count("*").alias("n"))
    told = lines.join(count, ["a", "b"])
    short = told.where("n = 1").select("a", "b", F.sha2(F.col("line").cast("binary"), 256).alias("ids_sha256"))
    return short.unionByName(ordered_stream(told.where("n > 1").drop("n"), ["a", "b"], ["part"], _hash_lines, "a long, b long, ids_sha256 string"))


def nodes(found: DataFrame, batches: tuple[float, ...] = BATCHES, ids_a_line: int = IDS_A_LINE) -> DataFrame:
    """Every distinct prefix of the sequences (id, len, steps), the empty one included: least id, depth, the parent's least id, number of
    sequences, children, leaves below, saved size below (each node's sequences but one times its last symbol's size), digest of the ids that end there."""
    found = materialize(found)
    last = key_at(F.col("steps"), F.col("len"))
    ends = found.select("id", "len", "steps", last["a"].alias("a"), last["b"].alias("b"))
    alike = materialize(ends.groupBy("a", "b", "len").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("steps").alias("steps")))
    trie, longest = build(alike.select("len", "steps"), batches)
    digests = materialize(ids_digests(ends.select("a", "b", "id"), ids_a_line))
    root = alike.agg(F.sum("n").alias("n_convs"), F.min("least").alias("conv_id")).where("n_convs IS NOT NULL")
    zero = F.lit(0).cast("long")
    if trie is None:
        top = root.select("conv_id", zero.alias("a"), zero.alias("b"), "n_convs", zero.alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved"))
        return _named(top.withColumns({"depth": zero, "parent_conv_id": F.lit(None).cast("long")}), digests)
    paths = with_above(trie, longest)
    key = lambda c: [F.col(f"{c}.a").alias("a"), F.col(f"{c}.b").alias("b")]
    above = F.explode("above").alias("up")
    counts = paths.select(*key("key"), "above").join(alike.where("len > 0").select("a", "b", "n", "least"), ["a", "b"]).select("n", "least", above).groupBy(*key("up")).agg(
        F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"))
    children = trie.groupBy(*key("up")).agg(F.count("*").alias("n_children"))
    first, size = F.get("steps", F.lit(0))["before"], F.get("steps", F.size("steps") - 1)["upto"]
    told = paths.select(*key("key"), "p", "e", "up", "steps", "above").join(counts, ["a", "b"]).join(children, ["a", "b"], "left")
    told = materialize(told.withColumns({"own": (F.col("n_convs") - 1) * (size - first), "n_children": F.coalesce("n_children", zero)}))
    below = told.select(F.col("n_children") == 0, "own", above).toDF("leaf", "own", "up").groupBy(*key("up")).agg(F.sum("own").alias("saved"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"))
    parents = told.select(F.col("a").alias("_pa"), F.col("b").alias("_pb"), F.col("conv_id").alias("_pid"))
    full = told.drop("above").join(below, ["a", "b"]).join(parents, (F.col("up.a") == F.col("_pa")) & (F.col("up.b") == F.col("_pb")), "left")
    # along an edge only the depth and the size saved so far differ
    wide = full.select("*", F.posexplode("steps").alias("i", "step")).withColumn("depth", (F.col("p") + F.col("i") + 1).cast("long"))
    end = F.col("depth") == F.col("e")
    rows = wide.select(
        "conv_id", "depth", F.col("step.a").alias("a"), F.col("step.b").alias("b"), F.when(F.col("i") > 0, F.col("conv_id")).otherwise(F.col("_pid")).alias("parent_conv_id"),
        (F.col("i") == 0).alias("top"), "p", "n_convs", F.when(end, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * (F.col("step.before") - first)).alias("saved"))
    least = root.first()  # one row
    rows = rows.withColumn("parent_conv_id", F.when(F.col("top") & (F.col("p") == 0), F.lit(least["conv_id"])).otherwise(F.col("parent_conv_id"))).drop("top", "p")
    sums = told.agg(F.sum("own").alias("saved"), F.count_if(F.col("n_children") == 0).alias("n_leaves"), F.count_if(F.col("p") == 0).alias("n_children"))
    top = sums.select(
        F.lit(least["conv_id"]).alias("conv_id"), zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(least["n_convs"]).alias("n_convs"), "n_children", "n_leaves", "saved")
    return _named(rows.unionByName(top), digests)


def _named(rows: DataFrame, digests: DataFrame) -> DataFrame:
    out = rows.join(digests, ["a", "b"], "left").withColumn("ids_sha256", F.coalesce("ids_sha256", F.lit(NO_IDS)))
    return out.select("conv_id", "depth", "parent_conv_id", *[F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves")],
                      F.col("saved").cast("long").alias("saved_tokens"), F.col("ids_sha256").alias("ends_sha256"))
