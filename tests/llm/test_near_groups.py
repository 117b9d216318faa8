"""Near duplicates in large groups: classes equal those of all similar pairs, and work does not grow with the square of a group."""

import random
from collections import defaultdict

import numpy as np
import pytest

from trackweave.llm import near, substring
from trackweave.llm.rows import KEY


def edited(rnd, words, share):
    out = list(words)
    for _ in range(max(1, int(len(out) * share))):
        i = rnd.randrange(len(out))
        kind = rnd.random()
        if kind < 0.4:
            out[i] = f"n{rnd.randrange(10 ** 6)}"
        elif kind < 0.7:
            del out[i]
        else:
            out.insert(i, f"n{rnd.randrange(10 ** 6)}")
    return out


def some_groups(seed=2):
    rnd = random.Random(seed)
    fresh = lambda n: [f"w{rnd.randrange(10 ** 7)}" for _ in range(n)]
    passage, original, other = fresh(80), fresh(120), fresh(90)
    texts = [fresh(rnd.randint(30, 60)) + passage + fresh(rnd.randint(10, 30)) for _ in range(150)]  # share a passage, are not alike
    texts += [edited(rnd, original, 0.04) for _ in range(80)]  # near copies of one text
    texts += [edited(rnd, other, share) for share in (0.02, 0.05, 0.08, 0.1, 0.12) for _ in range(8)]
    chain = fresh(100)
    for _ in range(12):  # each like the one before, the last unlike the first
        chain = edited(rnd, chain, 0.03)
        texts.append(chain)
    texts += [texts[0]] * 100 + [texts[200]] * 100 + [fresh(4), fresh(4), []]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def classes_by_all_pairs(rows):
    words = {i: t.split() for i, t in rows}
    sets = {i: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} for i, w in words.items()}
    root = {i: i for i in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(words)
    number = {w: k for k, w in enumerate(sorted({w for v in words.values() for w in v}))}
    coded = {i: near.mix(np.array([number[w] for w in v], np.uint64) + np.uint64(9)) for i, v in words.items()}
    for x, a in enumerate(ids):
        for b in ids[:x]:
            same = words[a] == words[b] and words[a]
            if not same:
                if not sets[a] or not sets[b] or len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b]):
                    continue
                limit = int(0.2 * max(len(words[a]), len(words[b])) + 1e-9)
                same = near.edit_distance(coded[a], coded[b], limit) <= limit
            if same:
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(set)
    for i in ids:
        groups[find(i)].add(i)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("rounds", [0, 1])
def test_classes_equal_all_similar_pairs(spark, monkeypatch, rounds):
    rows = some_groups()
    seen = []
    plain = near.rest_pairs
    monkeypatch.setattr(near, "rest_pairs", lambda *a: seen.append(plain(*a)) or seen[-1])
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string").repartition(4)
    got = defaultdict(set)
    out = near.near_duplicates(docs, rounds=rounds).collect()
    for r in out:
        got[r.class_id].add(r[KEY])
    assert len(out) == len(rows) + 20 and set(map(frozenset, got.values())) == classes_by_all_pairs(rows)
    if rounds:  # the 150 texts with a passage in common, some 11,000 pairs, are not listed
        assert seen[0].count() < 500


def test_copies_with_many_edits_are_not_paired_within_their_group(spark, monkeypatch):
    """Copies just below the similarity meet on what all have kept of their original, but cannot be similar to each other."""
    rnd = random.Random(4)
    original = [f"w{rnd.randrange(10 ** 7)}" for _ in range(150)]
    vary = ["x", "y"]  # few other words at few places, so that most shingles are shared by several copies
    texts = [original] + [[rnd.choice(vary) if i in spots else w for i, w in enumerate(original)] for spots in (set(rnd.sample(range(2, 150, 6), n)) for n in [1, 2] * 30 + [4, 5] * 60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    seen = []
    plain = near.rest_pairs
    monkeypatch.setattr(near, "rest_pairs", lambda *a: seen.append(plain(*a)) or seen[-1])
    got = defaultdict(set)
    for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        got[r.class_id].add(r[KEY])
    assert set(map(frozenset, got.values())) == classes_by_all_pairs(rows)
    assert seen[0].count() < 300


def test_repeated_rows_are_verified_once(spark, monkeypatch):
    rnd = random.Random(9)
    one = [f"w{rnd.randrange(10 ** 6)}" for _ in range(80)]
    two = edited(rnd, one, 0.02)
    made = []
    plain = near.materialize
    monkeypatch.setattr(near, "materialize", lambda df: made.append(plain(df)) or made[-1])
    docs = spark.createDataFrame([(1, " ".join(one))] * 300 + [(2, " ".join(two))] * 300, "doc_id long, text string")
    out = near.near_duplicates(docs).collect()
    assert len(out) == 600 and {r.class_id for r in out} == {1}
    bodies = [d for d in made if d.columns == ["node", "text"]]
    assert [b.count() for b in bodies] == [2]


def test_ranges_of_repeated_rows_are_listed_once(spark):
    """Copies of two texts that differ in one word: lists hold distinct ranges, however many copies there are."""
    rnd = random.Random(10)
    one = [f"w{rnd.randrange(10 ** 6)}" for _ in range(120)]
    two = one[:60] + ["other"] + one[61:]
    docs = spark.createDataFrame([(1, " ".join(one))] * 200 + [(2, " ".join(two))] * 200, "doc_id long, text string").repartition(3)
    found = substring.repeated_ranges(docs).collect()
    assert len(found) == 2 and all(len(r["__tw_ranges"]) == len(set(r["__tw_ranges"])) <= 120 for r in found)
    out = substring.drop_repeated_windows(docs).collect()
    assert len(out) == 400 and all(r.n_removed == 120 and r.kept_text == "" for r in out)
