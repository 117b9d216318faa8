"""The operators of trackweave.llm against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from trackweave.llm import bytebpe, decontaminate, fertility, idfile, langid, lm, near, substring, suffix, toxicity
from trackweave.llm.rows import KEY

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, seed string, score string"
PARTS = {"en": ["the", "ing", "and", "er", "ion", "at"], "de": ["sch", "ung", "der", "ein", "ü", "keit"]}


def some_texts(n=60, seed=5):
    rnd = random.Random(seed)
    word = lambda lang: "".join(rnd.choice(PARTS[lang]) for _ in range(rnd.randint(1, 4)))
    text = lambda lang, size: " ".join(word(lang) for _ in range(size))
    rows = [(i, text(lang, rnd.randint(3, 120)), lang) for i in range(n) for lang in [rnd.choice(["en", "de"])]]
    shared = text("en", 60)
    rows += [(n, text("en", 30) + " " + shared + " " + text("en", 20), "en"), (n + 1, shared + "\t\n" + text("en", 33), "en")]
    rows += [(n + 2, rows[3][1], "en"), (n + 3, rows[4][1] + " end", "de"), (n + 4, " ".join(["again"] * 150), "en"), (n + 5, text("de", 4000), "de")]
    return rows + [(n + 6, None, None), (n + 7, "", "en"), (n + 8, " \n ", "en"), (None, rows[5][1], "en"), (None, "x" * 5000, None), (7, rows[7][1], rows[7][2]), (n + 9, "12 34 !?", "en"), (n + 10, "The <|endoftext|> 😀 É", "de")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "src0", len(t or ""), 1, "s", "x") for i, t, lang in some_texts()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(rows):
    return [(r.doc_id, WORD.findall(r.text or "")) for r in rows]


def windows_twice(rows, n):
    seen = Counter(tuple(w[i:i + n]) for _, w in rows for i in range(len(w) - n + 1))
    return [{j for i in range(len(w) - n + 1) if seen[tuple(w[i:i + n])] > 1 for j in range(i, i + n)} for _, w in rows]


@pytest.mark.parametrize("hot", [1, 4096])
def test_substring(docs, hot):
    rows = words_of(docs.collect())
    want = [(i, len(w), len(g), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in g).encode()).hexdigest()) for (i, w), g in zip(rows, windows_twice(rows, 35))]
    out = substring.drop_repeated_windows(docs, hot=hot)
    assert set(docs.columns) < set(out.columns)
    got = [tuple(r) for r in out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_suffix(docs):
    rows = words_of(docs.dropDuplicates(["doc_id", "text"]).collect())
    sure, most = windows_twice(rows, 50), windows_twice(rows, suffix.PASSAGE - suffix.SPREAD + 1)
    got = defaultdict(set)
    for r in suffix.repeated_passages(docs.dropDuplicates(["doc_id", "text"])).collect():
        assert r.end_word - r.start_word >= 50
        got[r[KEY]] |= set(range(r.start_word, r.end_word))
    for (i, _), must, may in zip(rows, sure, most):
        if i is not None:
            assert must <= got[i] <= may, i


def test_near(docs):
    out = near.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    rows = [(i, w) for i, w in words_of(docs.collect()) if i is not None and w]
    of = {i: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} or {tuple(w)} for i, w in rows}
    got = {r[KEY]: r.class_id for r in out}
    for a in of:
        for b in of:
            if len(of[a] & of[b]) >= 0.8 * len(of[a] | of[b]):
                assert got[a] == got[b], (a, b)
    assert got[67] == 67 and got[68] == 68  # no words: classes of their own
    kept = [r.doc_id for r in near.keep_one(docs).collect()]
    assert kept.count(7) == 1 and 62 not in kept and 3 in kept


def test_edit_distance():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.randrange(3) for _ in range(rnd.randrange(15))] for _ in range(2))
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        limit = rnd.randrange(15)
        a, b = (near.mix(np.array(x, np.uint64) + np.uint64(5)) for x in (a, b))
        assert near.edit_distance(a, b, limit) == min(last[-1], limit + 1)


def test_bpe(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.ranks(path), special_tokens={})
    for r in bytebpe.encode(docs, path, public_tokenizers.PATTERN, back=True).withColumn("bytes", bytebpe.decode("ids", path)).collect():
        text = r.text or ""
        assert r.ids == exact.encode_ordinary(text) and bytes(r.decoded) == bytes(r.bytes) == text.encode()
        assert len(r.char_start) == len(r.ids) and all(0 <= c < len(text) for c in r.char_start)
    rnd = random.Random(2)
    signs = ["a", "b", "ab", " ", "=", "-", "é", "\n", "日", "😀", "1", "'", "s", " ", "th", "\t"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(50))) for _ in range(3000)] + ["=" * n for n in range(99)]
    got = next(bytebpe._encoded(path, public_tokenizers.PATTERN, False)(iter([pa.array(texts)]))).field("ids").to_pylist()
    assert got == [exact.encode_ordinary(t) for t in texts]


def test_decontaminate(spark, docs):
    rnd = random.Random(9)
    item = [f"w{rnd.randrange(10 ** 6)}" for _ in range(30)]
    edited = [w if j % 9 else "other" for j, w in enumerate(item)]
    more = spark.createDataFrame([(500, "Before " + " ".join(item).upper() + ", after", None, None, 1, 1, "", ""), (501, " ".join(edited), None, None, 1, 1, "", "")], SCHEMA)
    items = spark.createDataFrame([(1, " ".join(item) + ".", 3), (2, None, 3), (3, "", 3), (None, "too short", 3), (1, " ".join(item) + ".", 3)], "item_id long, text string, score int")
    out = {(r[KEY], r.item_id): r for r in decontaminate.contaminated(docs.union(more), items).collect()}
    assert set(out) == {(500, 1), (501, 1)}
    assert out[500, 1].score == 1 and (out[500, 1].start_word, out[500, 1].end_word) == (1, 31) and 0.5 < out[501, 1].score < 1
    assert decontaminate.drop_contaminated(docs.union(more), items).count() == docs.count()


def test_id_files(spark, docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    marked = ["a<|endoftext|>b <|startoftext|>", "<|endoftext|>", "<|EndOfText|> <|endoftext|", " <|endoftext|><|endoftext|>\n"]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(400 + i, t) for i, t in enumerate(marked)], "doc_id long, text string"))
    idfile.write_ids(docs, path, f"{tmp_path}/ids")
    got = idfile.documents_of(spark, f"{tmp_path}/ids").collect()
    idfile.write_ids(docs.limit(0), path, f"{tmp_path}/none")
    assert idfile.documents_of(spark, f"{tmp_path}/none").count() == 0
    model = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = np.array(model.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        want[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))


def test_id_blocks_and_checksums():
    rnd = random.Random(3)
    sizes = np.array([700, 300, 2, 1])
    ids = np.array([[rnd.choice([5, 6, 7, 49407, rnd.randrange(49408)]) for _ in range(700)] for _ in sizes], np.int32)
    payload = idfile.code_blocks(sizes, ids)
    back = idfile.code_blocks(sizes, None, payload)
    assert all((back[i, :n] == ids[i, :n]).all() for i, n in enumerate(sizes))
    assert idfile.crc_joined(zlib.crc32(b"abc"), zlib.crc32(b"defgh"), 5) == zlib.crc32(b"abcdefgh")
    with pytest.raises(ValueError):
        idfile.decoded_blocks([{"n": 1, "payload": payload[3], "crc": 1, "part": 0, "block": 0}])


def test_language(docs, empty):
    labels, network = langid.train(docs, F.col("lang"), ~langid.held_out(5))
    out = langid.predict_language(docs, labels, network).collect()
    assert {r.lang_pred for r in out if not re.search(r"[^\W\d_]", r.text or "")} == {"und"}
    sure = [r for r in out if r.lang and len((r.text or "").split()) > 20 and "again" not in r.text]
    assert np.mean([r.lang == r.lang_pred for r in sure]) > 0.95 and all(0 <= r.score <= 1 for r in out)
    assert langid.train(empty, F.col("lang"), ~langid.held_out(5)) == ([], None)
    assert langid.predict_language(docs, [], None).select("lang_pred").distinct().collect()[0][0] == "und"


def test_language_gradients():
    net = langid.Network(3, hidden=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (5, 6)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    grad, _ = net.gradients(x, y)
    for k in net.w:
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        net.w[k][at] += 1e-3
        up = net.gradients(x, y)[1]
        net.w[k][at] -= 2e-3
        down = net.gradients(x, y)[1]
        net.w[k][at] += 1e-3
        assert math.isclose(grad[k][at], (up - down) / 2e-3, rel_tol=1e-3)


def test_lm(docs):
    tokens = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    rows = [(r.doc_id, tokens(r.text)) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(t for i, own in rows if not held(i) for t in own)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(own), sum(c[t] > 0 for t in own), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own), 6)) for i, own in rows)
    out = lm.score_texts(docs, langid.held_out(10)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


def test_toxicity(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["sun", "tree", "river", "stone", "cloud"]) for _ in range(30)) + (" you vile 5cum" if i % 4 == 0 else ""), i % 4 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 1.5) for i, t, _ in rows] + [(None, None, 0.0), (1000, "", 0.0), (1001, "Sun ѕCUM river", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(bad)) for i, _, bad in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, ~langid.held_out(5))
    assert "scum" in model.weights and "sun" not in model.weights
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == int(bad) for i, _, bad in rows) and got[1001].predicted == 1 and got[1000].predicted == 0 and 0 <= got[None].score < 0.5
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0), F.lit(True))).select(F.max("score")).first()[0] == 0
    exempt = toxicity.Matcher({"scum": 2.0}, ["pond scum"])
    assert exempt.matches(" pond scum ") == [] and exempt.matches(" scum pond ") == [(0, "scum")]


def test_fertility(docs):
    measured = fertility.measure(docs, public_tokenizers.path("piece_bpe_32k.model"))
    for r in measured.collect():
        text = r.text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        three = Counter(zip(w, w[1:], w[2:]))
        again = {j for i in range(len(w) - 2) if three[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
    judged = fertility.judge(measured, fertility.bands(measured)).collect()
    assert len(judged) == docs.count() and all(r.kept for r in judged if not r.base_failed)


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert substring.drop_repeated_windows(empty).count() == suffix.repeated_passages(empty).count() == near.near_duplicates(empty).count() == 0
    assert decontaminate.contaminated(empty, items).count() == lm.score_texts(empty, langid.held_out(10)).count() == 0
    measured = fertility.measure(empty, public_tokenizers.path("piece_bpe_32k.model"))
    assert fertility.judge(measured, fertility.bands(measured)).count() == 0


def test_pipeline(spark, docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "byte_bpe"]
    first = corpus_pipeline.language_id(spark, docs, "")
    assert first.columns == docs.columns and {66, 67, 68, 69}.isdisjoint({r.doc_id for r in first.collect()})
    cut = corpus_pipeline.substring_dedup(spark, docs, "")
    assert cut.schema == docs.schema and cut.where("text = ''").count() == docs.where("text = ''").count()
    assert corpus_pipeline.byte_bpe(spark, docs, "").where("NOT round_trip").count() == 0


def test_lm_spells_frequent_tokens(monkeypatch):
    spelled = []
    monkeypatch.setattr(lm, "spell", lambda words, table, weights: spelled.extend(words.word(i) for i in range(len(words))) or np.full(len(words), -1.0))
    texts = pa.table({"doc_id": [1], "text": ["Common rare common new"], "held_out": [False]})
    counts = pa.table({"token": ["common", "rare"], "by_topic": [[100] + [0] * 15, [1] + [0] * 15]})
    out = lm._scored(None, None, [110] + [0] * 15, [9] + [0] * 15, 3)(texts, counts)
    assert sorted(spelled) == [b"common", b"new", b"rare"] and out.column("n_known").to_pylist() == [4]


def test_lm_learns_from_all_training_tokens(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEARN", 50)
    words = spark.createDataFrame([(f"w{i * i}", 1 + i % 9) for i in range(300)], "token string, c long")
    weights, seen = lm.mixing_weights(words, np.zeros(lm.ORDERS * lm.SLOTS * 2, np.float32), 300)
    assert seen == 300 and np.isfinite(weights).all()


def test_fertility_rejects_planted_junk(spark):
    rnd = random.Random(6)
    word = {lang: ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(400)] for lang, parts in PARTS.items()}
    clean = [(i, " ".join(rnd.choices(word[lang], k=rnd.randint(100, 180))), lang) for i in range(240) for lang in [["en", "de"][i % 2]]]
    noise = [(1000 + i, " ".join("".join(rnd.choice("bcdfghjklmnpqrstvwxz") for _ in range(rnd.randint(3, 9))) for _ in range(60)), "en") for i in range(4)]
    few = [(2000 + i, " ".join(rnd.choice(word["de"][:6]) for _ in range(130)), "de") for i in range(4)]
    docs = spark.createDataFrame(clean + noise + few, "doc_id long, text string, lang string")
    measured = fertility.measure(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("base_failed", F.lit(False))  # the bands alone
    got = {r.doc_id: r.kept for r in fertility.judge(measured, fertility.bands(measured)).collect()}
    assert not any(got[i] for i, _, _ in noise + few)
    assert all(got[i] for i, _, _ in clean)


def test_fertility_compares_two_vocabularies(spark, docs):
    """Counts by the second vocabulary equal the library's over whole texts; words that only the first one splits stand out."""
    path, second = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(second)
    for r in fertility.measure(docs, path, second).collect():
        n = len(model.encode(r.text or "", add_special_tokens=False).ids)
        assert r.n_second == n
        assert r.chars_per_second == pytest.approx(r.word_chars / n if n else 0) and r.first_per_second == pytest.approx(r.n_tokens / n if n else 0)
    rnd = random.Random(9)
    words = ["".join(rnd.choice(PARTS["en"]) for _ in range(rnd.randint(1, 3))) for _ in range(400)]
    clean = [(i, " ".join(rnd.choices(words, k=rnd.randint(100, 180)))) for i in range(120)]
    capitals = [(1000 + i, " ".join(rnd.choices(words, k=120)).upper()) for i in range(3)]
    more = spark.createDataFrame(clean + capitals, "doc_id long, text string")
    measured = fertility.measure(more, path, second).withColumn("base_failed", F.lit(False))
    figures = {r.doc_id: r for r in fertility.judge(measured, fertility.bands(measured)).collect()}
    assert all(figures[i].kept for i, _ in clean) and not any(figures[i].kept for i, _ in capitals)
    assert min(figures[i].first_per_second for i, _ in capitals) > max(figures[i].first_per_second for i, _ in clean)


def test_suffix_equals_the_windows(spark, docs):
    rnd = random.Random(8)
    line = lambda n: " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(n))
    a, b, c, long = line(35), line(35), line(35), line(120)
    texts = [f"{a} {b}", f"{b} {line(9)} {a}", f"{line(5)} {a} {c}", f"{c} {b}", f"{line(7)} {long}", f"{long} {a}", f"{long[:len(long) // 2]} {b} {line(3)}", long]
    more = spark.createDataFrame([(300 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = words_of(both.collect())
    got = defaultdict(set)
    for r in suffix.repeated_passages(both).collect():
        assert r.end_word - r.start_word >= 50
        got[r[KEY]] |= set(range(r.start_word, r.end_word))
    want = {i: g for (i, _), g in zip(rows, windows_twice(rows, 50)) if g}
    assert got == want and not {300, 301, 302, 303} & set(got)


def test_language_learns_every_label(spark):
    docs = spark.createDataFrame([(i, f"text {i} of label", f"l{i % 70}") for i in range(140)], "doc_id long, text string, lang string")
    labels, network = langid.train(docs, F.col("lang"), F.lit(True), per_language=5)
    assert len(labels) == 70 and network.w["bias"].shape == (70,)
