"""Conversation trie and repair against brute force: nulls, ties, repeated rows, empty and long texts, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from trackweave.llm import trie, turns
from trackweave.llm.queries import QUERIES, damaged, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, digest string, a int, steps int"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def some_conversations(seed=4):
    rnd = random.Random(seed)
    role = lambda: rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""])
    text = lambda: rnd.choice(["Yes.", "No?", "maybe", "", " \n", None, "Good day!", "a" * 30_000 + ".", "Ende ", "x.\u0085", "é. \t"])
    rows = []
    for conv in [*range(0, 40), *range(100, 150), 205, 207, -5, -150, 301]:
        for t in range(rnd.randint(1, 9)):
            rows.append((conv, None if rnd.random() < 0.05 else t + rnd.randint(0, 1), role(), text()))
    rows += [(700 + i, t, ["user", "assistant"][t % 2], f"Turn {t}.") for i in range(60) for t in range(4)]  # copies
    rows += [(800, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(300)]
    rows += [rows[0], rows[0], rows[20], (None, 0, "user", "Hi."), (None, None, "assistant", "Ho.")]
    return [(*r, "d", 1, 2) for r in rows]


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame(some_conversations(), SCHEMA).repartition(5)


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def ordered(rows, fill):
    """Turns (turn, role, text) of each conversation in order."""
    of = defaultdict(list)
    for r in rows:
        of[r.conv_id].append((r.turn, fill if r.role is None else r.role, fill if r.text is None else r.text))
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, digest(x[1], x[2]))) for c, v in of.items()}


def trie_of(rows):
    own = {c: v for c, v in ordered(rows, "").items() if c is not None}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        full[c] = tuple((r, t) for _, r, t in own.get(base, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return {(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
             hashlib.sha256(",".join(map(str, sorted(c for c in m if len(full[c]) == len(k)))).encode()).hexdigest()) for k, m in members.items()}


NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("batches,ids_a_line", [((0.125, 1.0), 1 << 16), ((1.0,), 7), ((0.1, 0.2, 0.5, 1.0), 3)])
def test_trie_equals_all_prefixes(talks, batches, ids_a_line):
    got = [tuple(r[c] for c in NAMES) for r in trie.nodes(trie.sequences(rebuilt(talks)), batches, ids_a_line).collect()]
    want = trie_of(talks.collect())
    assert len(got) == len(want) and set(got) == want


def test_trie_of_nothing(spark, talks, tmp_path):
    assert trie.nodes(trie.sequences(rebuilt(talks.limit(0)))).count() == 0
    # of a conversation whose own turns all give way to those of an absent one only the root is left
    lone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 5)
    spark.createDataFrame([(lone, t, "user", "x") for t in range(3)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    row, = QUERIES["op12_conversation_trie"](spark, str(tmp_path)).collect()
    assert tuple(row[c] for c in NAMES) == (lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())


def test_two_fattest(spark):
    rows = spark.range(0, 70).select(F.col("id").cast("int").alias("lo")).crossJoin(spark.range(1, 71).select(F.col("id").cast("int").alias("hi"))).where("lo < hi")
    for r in rows.select("lo", "hi", trie.two_fattest(F.col("lo"), F.col("hi")).alias("f")).collect():
        assert r.f == max(range(r.lo + 1, r.hi + 1), key=lambda x: x & -x)


def all_edits(code):
    """Cheapest cost and first cheapest letters, by plain recursion over what is left."""
    @lru_cache(None)
    def best(i, phase, inserted):
        ahead = 3 if phase == 2 else 2
        ways = [(0, "")] if i == len(code) and phase in (0, 3) else []
        if inserted < 2:
            c, s = best(i, ahead, inserted + 1)
            ways.append((c + 5, "I" + s))
        if i < len(code):
            fault, role = divmod(code[i], 4)
            c, s = best(i + 1, phase, 0)
            ways.append((c + 2, "D" + s))
            if fault != turns.DELETED:
                more = 5 * (fault == turns.CUT)
                c, s = best(i + 1, ahead, 0)
                ways.append((c + 1 + more, "R" + s))
                if role == turns.SYSTEM and phase == 0:
                    c, s = best(i + 1, 1, 0)
                    ways.append((c + more, "K" + s))
                elif role == (turns.ASSISTANT if ahead == 3 else turns.USER):
                    ways.append((c + more, "K" + s))
        return min(ways, default=(10 ** 9, ""))

    return best(0, 0, 0)


@pytest.mark.parametrize("block", [1, 3, 16, 1000])
def test_auction_finds_the_first_cheapest_edits(block):
    rnd = random.Random(block)
    for n in [*range(8)] * 25 + [60, 150]:
        code = bytes(4 * rnd.choice([0, 0, 0, 1, 2]) + rnd.choice([0, 1, 1, 2, 2, 3]) for _ in range(n))
        assert turns.cheapest_edits(code, block) == all_edits(code)
    assert turns.cheapest_edits(b"") == (0, "")


def test_auction_is_linear_in_the_turns(monkeypatch):
    calls = []
    plain = turns.arcs
    monkeypatch.setattr(turns, "arcs", lambda *a: calls.append(1) or plain(*a))
    work = []
    for n in (2000, 4000):
        calls.clear()
        turns.cheapest_edits(bytes([1, 1, 2] * (n // 3)))
        work.append(len(calls))
    assert work[1] < 2.2 * work[0] and work[0] < 200 * 2000


def repair_of(rows):
    """Per conversation the report, the repaired lines and their digest."""
    out = {}
    for conv, own in ordered(rows, " ").items():
        counts, code, seen = [0, 0, 0], [], set()
        for _, role, text in own:
            body = text.strip(SPACE)
            kind = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else 3
            seen.add((role, text))
            if kind < 3:
                counts[kind] += 1
            code.append(4 * [1, 1, 2, 0][kind] + ("sua".index(role[0]) if role[:1] in ("s", "u", "a") else 3))
        cost, audit = all_edits(bytes(code))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        numbers = [t for t, _, _ in own if t is not None]
        lines, left = [], iter(own)
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(left)
            if edit in "IR":
                role = "assistant" if lines and lines[-1][0] == "u" else "user"
            if edit != "D":
                lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, lines)
    return out


def test_repair_equals_brute_force(talks):
    plans = turns.plan_repairs(talks)
    want = repair_of(talks.collect())
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in plans.collect()} == {c: v[:-1] for c, v in want.items()}
    got = defaultdict(dict)
    for r in turns.repaired_turns(talks, plans).collect():
        got[r.conv_id][r.position] = f"{r.role}:{r.text}"
    assert {c: [v[i] for i in range(len(v))] for c, v in got.items()} == {c: v[-1] for c, v in want.items() if v[-1]}
    digests = {r.conv_id: r.repaired_sha256 for r in turns.repaired_digests(talks, plans).collect()}
    assert digests == {c: hashlib.sha256("\n".join(v[-1]).encode()).hexdigest() for c, v in want.items()}
    assert turns.plan_repairs(talks.limit(0)).count() == 0 and turns.repaired_turns(talks.limit(0), plans.limit(0)).count() == 0


def test_repair_query(spark, talks, tmp_path):
    talks.write.parquet(f"{tmp_path}/conversations.parquet")
    rows = [r for r in talks.collect()]
    kept = []
    for r in rows:
        part = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{part(r.conv_id)}:{part(r.turn)}".encode()) % 20
        role, text = ("user" if fault == 4 else part(r.role)), part(r.text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept += [type("Row", (), {"conv_id": r.conv_id, "turn": r.turn, "role": role, "text": text})] * (0 if fault == 0 else 2 if fault == 3 else 1)
    assert damaged(talks).count() == len(kept)
    want = {c: (*v[:-1], hashlib.sha256("\n".join(v[-1]).encode()).hexdigest()) for c, v in repair_of(kept).items()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {r.conv_id: tuple(r[c] for c in names) for r in QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == {r.conv_id: want.get(r.conv_id, nothing) for r in rows}
