"""Near-duplicate texts by order min-hashing.

A k-mer is `K` consecutive words together with the number of times it has occurred in its text before.  A sketch takes the
`ELL` least k-mers under its own hash and keeps them in text order, so that it survives edits but not rearrangement.  Texts
that share one of `SKETCHES` sketches are candidates; a candidate is a link where at least 0.8 of the two sets of five-word
shingles is shared and the banded alignment of the words needs edits for at most 0.2 of the longer text.

Equal word sequences collapse first, so copies cost one row.  A large group is not paired within itself: in each bucket of
equal sketches the members are first compared with a central one (the text that shares most sketches with others, as the
original of edited copies does).  What then shares a bucket and still is in different classes is compared without exception, if the
two share one of their rarest shingles and their bitmaps differ in few enough bits, as all pairs of the asked similarity do; texts that
only share a frequent passage, or that are copies of one text with many edits each, do not.  At similarity 0.8 a pair shares none of 12 sketches with a probability below 1e-5.

Defined cases: texts without words are classes of their own; texts of fewer than five words match only equal word sequences;
a null doc_id is a document (its class_id is null unless the class holds an id); repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.rows import HASH, KEY, cut, materialize, with_key
from trackweave.llm.words import Q, Words, mix, powers, slices, window_hashes, window_starts

K, ELL, SKETCHES, SIMILARITY = 5, 2, 12, 0.8
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
LONGS = 8  # bitmap of a set of shingles, 64 bits each


def occurrence_labelled(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each value made distinct from its earlier occurrences in the same text."""
    own = values ^ mix(text.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(own)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = values.copy()
    if len(twice):
        at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
        again = np.flatnonzero(twice[at] == own)
        order = again[np.argsort(own[again], kind="stable")]
        new = np.append(True, own[order][1:] != own[order][:-1])
        head = np.flatnonzero(new)
        rank = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
        out[order] += rank.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return mix(out)


def order_sketches(words: Words, sketches: int = SKETCHES, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the texts that have k words or more, and a row of sketch values for each (two k-mers kept in text order)."""
    count = np.maximum(words.count - k + 1, 0)
    has = np.flatnonzero(count)
    if not len(has):
        return has, np.zeros((0, sketches), np.int64)
    value = window_hashes(words.hashes(), k)[window_starts(words.count, words.first, k)]
    value = occurrence_labelled(value, np.repeat(np.arange(len(count)), count))
    n = count[has]
    head = np.cumsum(n) - n
    out = np.zeros((len(has), sketches), np.uint64)
    for j in range(sketches):
        odd, shift = mix(np.array([2 * j + 1, 2 * j + 2], np.uint64))
        v = value * (odd | np.uint64(1)) + shift
        first = np.flatnonzero(v == np.repeat(np.minimum.reduceat(v, head), n))
        v[first] = MOST
        second = np.flatnonzero(v == np.repeat(np.minimum.reduceat(v, head), n))
        a, b = value[np.minimum(first, second)], value[np.maximum(first, second)]
        out[:, j] = mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(j)))
    return has, out.view(np.int64)


def _sketch_rows(sketches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                has, values = order_sketches(words, sketches)
                size = np.zeros(len(words.count) + 1, np.int32)
                size[has + 1] = sketches
                full = np.flatnonzero(words.count)
                content = np.zeros((2, len(words.count)), np.uint64)
                for i, seed in enumerate((0, 1)):
                    h = words.hashes(seed)
                    place = (np.arange(len(words)) - np.repeat(words.first[:-1], words.count)).astype(np.uint64)
                    if len(full):
                        content[i, full] = np.add.reduceat(mix(h + mix(place + np.uint64(7))), words.first[full])
                yield pa.record_batch({
                    KEY: part.column(KEY), HASH: part.column(HASH), "c1": mix(content[0]).view(np.int64), "c2": mix(content[1]).view(np.int64),
                    "n_words": words.count.astype(np.int64), "sketches": pa.ListArray.from_arrays(np.cumsum(size, dtype=np.int32), values.ravel())})
    return run


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edits between two sequences, `limit` + 1 if there are more: farthest points on the diagonals of the band, step by step."""
    same = min(len(a), len(b))
    differ = np.flatnonzero(a[:same] != b[:same])
    lead = int(differ[0]) if len(differ) else same
    a, b = a[lead:], b[lead:]
    same = min(len(a), len(b))
    if same:
        differ = np.flatnonzero(a[len(a) - same:][::-1] != b[len(b) - same:][::-1])
        tail = int(differ[0]) if len(differ) else same
        a, b = a[:len(a) - tail], b[:len(b) - tail]
    n, m = len(a), len(b)
    delta = m - n
    if min(n, m) == 0 or abs(delta) > limit:
        return min(max(n, m), limit + 1)
    size = max(n, m) + 1
    up, down = powers(Q, size), powers(pow(Q, -1, 1 << 64), size)
    sum_a, sum_b = np.zeros(n + 1, np.uint64), np.zeros(m + 1, np.uint64)
    np.cumsum(a * up[:n], out=sum_a[1:])
    np.cumsum(b * up[:m], out=sum_b[1:])

    def slide(x, k):
        y = x + k
        room = np.minimum(n - x, m - y)
        factor = np.where(k >= 0, up[np.maximum(k, 0)], down[np.maximum(-k, 0)])
        got = np.zeros_like(x)
        step = 1 << max(0, int(room.max(initial=0)).bit_length() - 1)
        while step:
            longer = np.minimum(got + step, room)
            fits = (got + step <= room) & ((sum_a[x + longer] - sum_a[x]) * factor == sum_b[y + longer] - sum_b[y])
            got = np.where(fits, got + step, got)
            step >>= 1
        return x + got

    none = -(1 << 40)
    limit = min(limit, max(n, m))
    far = np.full(2 * limit + 5, none, np.int64)
    mid = limit + 2
    for e in range(limit + 1):
        low, high = max(-e, -n, delta - (limit - e)), min(e, m, delta + (limit - e))
        if low > high:
            break
        k = np.arange(low, high + 1)
        if e == 0:
            x = np.zeros(len(k), np.int64)
        else:
            at = k + mid
            x = np.maximum(np.maximum(far[at] + 1, far[at + 1] + 1), far[at - 1])
            x = np.minimum(np.minimum(x, n), m - k)
        live = (x >= 0) & (x + k >= 0)
        fresh = np.full(len(far), none, np.int64)
        fresh[k[live] + mid] = slide(x[live], k[live])
        far = fresh
        if abs(delta) <= e and far[delta + mid] >= n:
            return e
    return limit + 1


def similar(a: np.ndarray, b: np.ndarray, s: np.ndarray, t: np.ndarray, least: float = SIMILARITY) -> bool:
    """Word hashes of two texts and their sets of shingles: enough shingles in common, and aligned with few enough edits."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    if len(a) < K or len(b) < K:
        return np.array_equal(a, b)
    if min(len(s), len(t)) < least * max(len(s), len(t)):
        return False
    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
    both = int((t[at] == s).sum())
    if both < least * (len(s) + len(t) - both):
        return False
    limit = int((1 - least) * max(len(a), len(b)) + 1e-9)
    return edit_distance(a, b, limit) <= limit


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                sides = []
                for node, text in (("a", "text_a"), ("b", "text_b")):  # a text that many pairs share is taken apart once
                    _, first, back = np.unique(np.asarray(part.column(node)), return_index=True, return_inverse=True)
                    words = Words(part.column(text).take(pa.array(first)))
                    h = words.hashes()
                    each = [h[words.first[i]:words.first[i + 1]] for i in range(len(first))]
                    sides.append((each, [np.unique(window_hashes(x, K)) for x in each], back))
                (one, sets_a, at_a), (two, sets_b, at_b) = sides
                keep = [similar(one[i], two[j], sets_a[i], sets_b[j], least) for i, j in zip(at_a, at_b)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node in links (a, b).

    Every node takes the least root among its neighbours and their roots, then roots are shortened, until nothing changes;
    only counts come to the driver."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    label = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        seen = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(seen, label["node"] == seen["a"]).select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        # a root that has found a smaller root takes all nodes below it along
        told = step.groupBy(F.col("was").alias("old")).agg(F.min("root").alias("new"))
        step = step.join(told, step["root"] == told["old"], "left").select("node", "was", F.least("root", F.coalesce("new", "root")).alias("root"))
        new = materialize(step)
        if not new.where("was <> root").limit(1).count():
            return new.select("node", "root")
        label = new.select("node", "root")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """`roots` after further links: only the links between roots need following."""
    def root(side: str) -> DataFrame:
        return roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))

    between = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    higher = components(between.where("a <> b")).withColumnsRenamed({"node": "n4", "root": "r4"})
    every = roots.union(links.select("a", "a")).union(links.select("b", "b")).groupBy("node").agg(F.min("root").alias("root"))
    return materialize(every.join(higher, F.col("root") == F.col("n4"), "left").select("node", F.coalesce("r4", "root").alias("root")))


def pivot_pairs(now: DataFrame, r: int) -> DataFrame:
    """Every member of a bucket of several classes with the bucket's lead: the most central member, in later rounds one of the central ones."""
    turn = F.xxhash64("node", F.col("j") % 3, F.lit(r))
    weight = F.col("shares") if r == 0 else F.col("shares") * (1024 + F.pmod(turn, F.lit(1024)))
    lead = F.max(F.struct(weight.alias("w"), turn.alias("t"), "node", "root"))
    ends = now.groupBy("j", "value").agg(lead.alias("p"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("j", "value", "p")
    pair = now.join(ends, ["j", "value"]).where("root <> p.root")
    return pair.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def still_divided(now: DataFrame) -> DataFrame:
    """Per node that has them: its buckets of several classes."""
    ends = now.groupBy("j", "value").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("j", "value")
    return now.join(ends, ["j", "value"]).groupBy("node").agg(F.any_value("root").alias("root"), F.collect_list(F.xxhash64("j", "value")).alias("keys"))


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each text, and their number."""
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"))
            count = np.maximum(words.count - K + 1, 0)
            own = np.repeat(np.arange(len(count)), count)
            value = window_hashes(words.hashes(), K)[window_starts(words.count, words.first, K)] if count.sum() else np.zeros(0, np.uint64)
            order = np.lexsort((value, own))
            own, value = own[order], value[order]
            new = np.append(True, (own[1:] != own[:-1]) | (value[1:] != value[:-1]))[:len(own)]
            own, value = own[new], value[new]
            size = np.bincount(own, minlength=len(count))
            node = np.asarray(part.column("node"))
            yield from cut(pa.record_batch({"node": node[own], "size": size[own], "s": value.view(np.int64)}))


def rest_pairs(own: DataFrame, body: DataFrame, least: float, block: int = 256) -> DataFrame:
    """All pairs of nodes of different classes that share a sketch and can be similar at all.

    Shingles are put in one order for all texts, the rarest first.  Two texts that share `least` of their shingles share one of the first
    n - least * n + 1 of each, so texts meet on those alone: texts that have nothing in common but a frequent passage do not, for
    its shingles come behind their own ones.  Where many texts do meet on a shingle, the members outside its largest class meet
    all others, in blocks of about `block`, so a large class costs its size times the few that are not in it.

    Edited copies of one text still meet on what all have kept of it.  Of those only pairs go on whose shingles can differ in few enough places:
    shingles of one text alone always differ, and each odd bit of `LONGS` * 64 over the others (every shingle turns one) stands for one or more that do."""
    shingles = materialize(body.join(own.select("node"), "node", "left_semi").mapInArrow(_shingle_rows, "node long, size long, s long"))
    again = shingles.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    place = F.shiftrightunsigned("s", 64 - (LONGS * 64 - 1).bit_length())
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    turned = [F.coalesce(F.bit_xor(F.when(F.shiftright(place, 6) == i, bit)), F.lit(0).cast("long")) for i in range(LONGS)]
    shared = shingles.join(again, "s").groupBy("node").agg(
        F.any_value("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "s"))).alias("held"), F.array(*turned).alias("bits"))
    # shingles of one text alone come first in its order and meet nobody
    first = F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1 - (F.col("size") - F.size("held"))
    rare = shared.select("node", "size", "bits", F.slice("held", F.lit(1), F.greatest(first, F.lit(0)).cast("int")).alias("rare"), (F.col("size") - F.size("held")).alias("alone")).where(F.size("rare") > 0)
    each = rare.join(own, "node").select(F.posexplode("rare.s").alias("i", "key"), "alone", "bits", "node", "root", "size", "keys")
    # shingles from this one on, itself included: no more can be shared with a text that is met here first
    each = materialize(each.select("key", "node", "root", "size", "keys", "alone", "bits", (F.col("size") - F.col("alone") - F.col("i")).alias("left")))
    per_class = each.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = per_class.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    largest = largest.select("key", "most", F.ceil(F.col("others") / block).cast("int").alias("blocks"))
    each = materialize(each.join(largest, "key"))
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    minor = each.where("root <> most").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    minor = minor.select("key", "block", *[F.col(c).alias(f"{c}_u") for c in ("node", "root", "size", "keys", "alone", "bits", "left")]).repartition(tasks, "key", "block")
    each = each.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).repartition(tasks, "key", "block")
    enough = least / (1 + least) * (F.col("size") + F.col("size_u")) - 1e-9
    differ = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bits_u")[i])) for i in range(LONGS)), F.col("alone") + F.col("alone_u"))
    meet = each.join(minor, ["key", "block"]).where(
        (F.col("root") != F.col("root_u")) & (F.least("size", "size_u") >= least * F.greatest("size", "size_u")) & (F.least("left", "left_u") >= enough)
        & (differ <= (1 - least) / (1 + least) * (F.col("size") + F.col("size_u")) + 1e-9) & F.arrays_overlap("keys", "keys_u"))
    return meet.select(F.least("node", "node_u").alias("a"), F.greatest("node", "node_u").alias("b")).distinct()


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, sketches: int = SKETCHES, rounds: int = 1) -> DataFrame:
    """One row per row of `docs`: KEY, HASH, class_id, n_links (those verified from its distinct text to different texts; enough to span the class, not all there are) and kept (the least row key of its class)."""
    keyed = with_key(docs.select("doc_id", "text")).select(KEY, HASH, "text")
    table = materialize(keyed.mapInArrow(_sketch_rows(sketches), f"{KEY} long, {HASH} long, c1 long, c2 long, n_words long, sketches array<long>"))
    rank = F.struct(F.col(KEY).isNull().alias("unnamed"), F.col(KEY).alias("id"), F.col(HASH).alias("hash"))
    texts = materialize(table.where("n_words > 0").groupBy("c1", "c2").agg(F.min(rank).alias("name"), F.any_value("n_words").alias("n_words"), F.any_value("sketches").alias("sketches")))
    each = texts.select("name", F.posexplode("sketches").alias("j", "value"))
    shared = each.groupBy("j", "value").agg(F.count("*").alias("n")).where("n > 1")
    member = materialize(each.join(shared, ["j", "value"]))
    node = F.xxhash64("name.id", "name.hash", "name.unnamed").alias("node")
    named = keyed.select(F.struct(F.col(KEY).isNull().alias("unnamed"), F.col(KEY).alias("id"), F.col(HASH).alias("hash")).alias("name"), "text").select(node, "text")
    # repeated rows are one text here as well
    body = materialize(named.join(member.select(node).distinct(), "node", "left_semi").dropDuplicates(["node"]))
    member = member.select("j", "value", "n", F.xxhash64("name.id", "name.hash", "name.unnamed").alias("node"))
    # the original of many edited copies shares sketches with most of them: the sum of its buckets' sizes is the largest
    central = member.groupBy("node").agg(F.sum("n").alias("shares"))
    member = materialize(member.select("j", "value", "node").join(central, "node"))

    tried = links = roots = None
    for r in range(rounds + 1):
        now = member.withColumn("root", F.col("node")) if roots is None else (
            member.join(roots.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left").select("j", "value", "node", "shares", F.coalesce("root", "node").alias("root")))
        pair = pivot_pairs(now, r) if r < rounds else rest_pairs(materialize(still_divided(now)), body, least)
        pair = materialize(pair if tried is None else pair.join(tried, ["a", "b"], "left_anti"))
        with_a = pair.join(body.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
        with_b = with_a.join(body.withColumnsRenamed({"node": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")
        found = materialize(with_b.mapInArrow(_verified(least), "a long, b long"))
        tried = pair if tried is None else tried.union(pair)
        if found.limit(1).count():
            links = found if links is None else links.union(found)
            roots = components(found) if roots is None else merged(roots, found)

    names = texts.select("c1", "c2", "name", F.xxhash64("name.id", "name.hash", "name.unnamed").alias("node"))
    if links is None:
        names = names.withColumns({"root": F.col("node"), "n_links": F.lit(0).cast("long")})
    else:
        links = links.distinct()
        degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("n_links")).withColumnRenamed("a", "n3")
        names = names.join(roots.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left").join(degree, F.col("node") == F.col("n3"), "left")
        names = names.select("c1", "c2", "name", "node", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    names = materialize(names)
    first = names.groupBy("root").agg(F.min("name").alias("first"))
    names = names.join(first, "root").select("c1", "c2", "n_links", "first")
    one = table.where("n_words > 0").join(names, ["c1", "c2"]).select(KEY, HASH, "first", "n_links")
    none = table.where("n_words = 0").select(KEY, HASH, rank.alias("first"), F.lit(0).cast("long").alias("n_links"))
    return one.unionByName(none).select(
        KEY, HASH, F.col("first.id").alias("class_id"), "n_links", (F.col(KEY).eqNullSafe(F.col("first.id")) & (F.col(HASH) == F.col("first.hash"))).alias("kept"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` whose text is the first of its class; rows equal in id and text stay once.  Texts without words all stay."""
    keyed = with_key(docs)
    stay = near_duplicates(docs, **how).where("kept").groupBy(F.col(KEY).alias("__tw_doc2"), F.col(HASH).alias("__tw_hash2")).agg(F.count("*").alias("__tw_times"))
    rows = keyed.join(stay, keyed[KEY].eqNullSafe(stay["__tw_doc2"]) & keyed[HASH].eqNullSafe(stay["__tw_hash2"]))
    again = (F.col("__tw_times") > 1) & F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    return rows.where(~again).unionByName(rows.where(again).dropDuplicates([KEY, HASH])).select(*docs.columns)
