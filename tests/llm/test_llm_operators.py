"""The operators against brute force, the public tokenizers and each other, on small tables with every odd case."""

import base64
import gzip
import hashlib
import io
import math
import os
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import connect, diff
from pyspark.sql import functions as F

import public_tokenizers
from paytrail.llm import archives, automaton, bpe, credentials, dedup, graph, katz, pieces, queries, segments, severity, slots
from paytrail.llm.words import ALNUM, shingles, words

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = " ".join(f"word{i % 5000} Ünïcode" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, `count` long, id long, _hash string"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, "src0", None if t is None else len(t), "k", 7, -1, None) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "one"), (6, "One"), (7, "a b c d e f g"), (7, "a b c d e f g"), (None, "a b c d e f g"), (8, "日本語 テキスト 😀")]


@pytest.fixture(scope="module")
def docs():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, con, name):
    assert diff(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name]) is None


def test_every_operator_keeps_every_row(spark):
    odd, none = table(spark, ODD), table(spark, [])
    path = public_tokenizers.path(queries.BPE_VOCABULARY)
    bench = spark.createDataFrame([("x", "a b c"), (None, None)], "item_id string, text string")
    model = severity.Model(np.zeros(0, np.int64), np.zeros(0), np.array([1.0, 2.0]))
    runs = {
        "slots": lambda d: slots.shard_documents(d),
        "dedup": dedup.near_duplicates,
        "automaton": lambda d: automaton.matches(d, bench),
        "pieces": lambda d: pieces.count_tokens(d, public_tokenizers.path(queries.UNIGRAM_VOCABULARY)),
        "severity": lambda d: severity.score(d, model),
        "secrets": credentials.scan,
        "bpe": lambda d: bpe.decode(bpe.encode(d, path, public_tokenizers.PATTERN), path),
        "katz": lambda d: katz.score(d, F.col("doc_id") % 2 == 1),
    }
    for name, run in runs.items():
        ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in run(odd).select("doc_id").collect())
        assert ids == sorted((i is None, i or 0) for i, _ in ODD), name
        assert run(none).count() == 0, name


# ---- words


def test_words_of_both_kinds():
    texts = ["A bB\tc", None, "", "x", "é-É 1a_b", " q"]
    col = pa.array(texts)
    for letters, pattern in ((None, brute.GRAPHIC), (ALNUM, brute.ALNUM)):
        w = words(col) if letters is None else words(col, letters)
        want = [pattern.findall(brute.lower(t)) for t in texts]
        assert np.diff(w.bounds).tolist() == [len(x) for x in want]
        flat = [x for v in want for x in v]
        assert len(set(w.hash.tolist())) == len(set(flat)) and dict(zip(flat, w.hash.tolist())) == dict(zip(flat[::-1], w.hash.tolist()[::-1]))


def test_slices_of_an_array_hash_alike():
    col = pa.array(["skipped", "one two three four five six", None, "one two", "one two three four five six"])
    s, bounds = shingles(words(col.slice(1)), 5)
    assert bounds.tolist() == [0, 2, 2, 3, 5] and s[:2].tolist() == s[3:].tolist() and s[2] not in s[:2]


# ---- 1 sharding


def test_shards(spark, docs, tmp_path):
    folder = str(tmp_path / "map")
    rows = slots.shard_documents(spark.read.parquet(f"{SF}/documents.parquet"), 24, folder).collect()
    text = dict(docs)
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in text.items()}
    load = Counter()
    for s in range(24):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
        load[s] = sum(r["size"] for r in rows if r["shard"] == s)
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    stored = slots.read_map(spark, folder, 1)
    assert len(stored) == slots.SLOTS and all(stored[r["virtual_slot"]] == r["shard"] for r in rows)
    with pytest.raises(Exception, match="exist"):
        slots.write_map(spark, stored, folder, 1)


def test_stored_map_is_edited_when_data_change(spark, tmp_path):
    folder = str(tmp_path / "map")
    rows = [(i, "x" * (i * 37 % 400)) for i in range(6000)]
    run = lambda r, shards: slots.shard_documents(table(spark, r), shards, folder).collect()
    load = lambda got: [sum(r["size"] for r in got if r["shard"] == s) for s in range(max(x["shard"] for x in got) + 1)]
    first = run(rows, 6)
    assert {r["map_version"] for r in first} == {1} and slots.latest_version(spark, folder) == 1
    same = run(rows, 6)  # nothing to move: no new version
    assert {r["map_version"] for r in same} == {1} and slots.latest_version(spark, folder) == 1
    assert {r["doc_id"]: r["shard"] for r in same} == {r["doc_id"]: r["shard"] for r in first}
    full = {r["doc_id"] for r in first if r["shard"] == 2}
    more = [(i, t * 2 if i in full else t) for i, t in rows]  # one shard has grown
    second, before = run(more, 6), {r["doc_id"]: r["shard"] for r in first}
    moved = [r["doc_id"] for r in second if r["shard"] != before[r["doc_id"]]]
    assert {r["map_version"] for r in second} == {2} and 0 < len(moved) < 0.2 * len(rows) and len(set(moved) - full) < 0.1 * len(moved)
    assert max(load(second)) - min(load(second)) <= 2000
    (tmp_path / "map" / "version=3").mkdir()  # cut off while it was written
    wider, before = run(more, 7), {r["doc_id"]: r["shard"] for r in second}
    moved = [r["doc_id"] for r in wider if r["shard"] != before[r["doc_id"]]]
    assert {r["map_version"] for r in wider} == {3} and 0 < len(moved) < 0.3 * len(rows)
    assert max(load(wider)) - min(load(wider)) <= 2000 and slots.read_map(spark, folder, 3) != slots.read_map(spark, folder, 2)
    fewer, before = run(more, 5), {r["doc_id"]: r["shard"] for r in wider}
    assert {r["shard"] for r in fewer} == set(range(5)) and {r["map_version"] for r in fewer} == {4}
    assert sum(r["shard"] != before[r["doc_id"]] for r in fewer) < 0.5 * len(rows)
    for s in range(5):
        own = sorted(r["slot"] for r in fewer if r["shard"] == s)
        assert own == list(range(len(own)))
    assert {r["map_version"] for r in slots.shard_documents(table(spark, rows), 6).collect()} == {0}


def test_maps_are_edited_not_remade():
    rng = random.Random(5)
    totals = {s: rng.randint(1, 1000) for s in range(2000)}
    first = slots.new_map(totals, 10, 2000)
    load = lambda m: [sum(totals[s] for s, k in m.items() if k == shard) for shard in range(max(m.values()) + 1)]
    assert max(load(first)) - min(load(first)) <= 1000
    grown = slots.grow_map(first, totals)
    assert {grown[s] for s in grown if grown[s] != first[s]} == {10}
    assert abs(load(grown)[10] - sum(totals.values()) / 11) <= 1000
    later = totals | {s: 5000 for s in range(2000) if first[s] == 3}
    edited = slots.edit_map(first, later, 10)
    moved = sum(edited[s] != first[s] for s in first)
    totals = later
    assert 0 < moved < 400 and max(load(edited)) - min(load(edited)) <= 5000
    smaller = slots.edit_map(first, totals, 9)
    assert set(smaller.values()) == set(range(9))


# ---- 2 top-k


@pytest.mark.parametrize("block_rows", [65_536, 20])
def test_topk_equals_brute_force(spark, block_rows, monkeypatch):
    monkeypatch.setattr(segments, "LEAST_BLOCKS", 4)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 12)).round(2)
    vectors[50:150] = vectors[0]  # one very common vector: ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(20, vectors[20].tolist())]
    odd = [(400, None), (401, [1.0, None] * 6), (402, [math.nan] * 12), (403, [math.inf] * 12), (None, [1.0] * 12), (404, [1.0, 2.0]), (420, [3.0, -4.0]), (405, []), (440, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, score int")
    clean = {i: [math.floor(1024 * x) for x in v] for i, v in [*rows, *odd[5:]]}
    want = []
    for q, a in clean.items():
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in clean.items() if i != q and len(a) == len(b))[:10]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    got = segments.top_k(df, F.col("vec_id") % 20 == 0, block_rows=block_rows)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert segments.top_k(df.limit(0), F.lit(True)).count() == 0


def test_bounds_hold_at_every_resolution():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 37)) * 100, rng.normal(size=(50, 37)) * 100
    last = None
    for starts in segments.cuts(37):
        bound = segments.statistics(a, starts) @ segments.statistics(b, starts).T
        assert (bound >= a @ b.T - 1e-6).all()
        last = bound if last is None else last
    assert bound.mean() < last.mean()


# ---- 3 near-duplicates


def _near(rng, base, changes):
    w = base.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def near():
    rng = random.Random(11)
    text = lambda n: " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))
    bases = [text(120) for _ in range(6)]
    rows = [(1000 + i, _near(rng, bases[i % 6], rng.randrange(5))) for i in range(150)]
    chain = bases[0]
    for i in range(8):  # neighbours are linked, ends are not
        rows.append((2000 + i, chain))
        chain = " ".join([*chain.split()[7:], *text(7).split()])
    shared = text(60)
    rows += [(3000 + i, f"{shared} {text(80)}") for i in range(60)]  # a passage in common, no link
    rows += [(4000 + i, "same text here") for i in range(40)] + [(4100, "SAME  text\there"), (4200, "same text"), (4300, None), (4301, ""), (4302, " \n")]
    rng.shuffle(rows)
    return rows


def test_near_duplicates_equal_brute_force(spark, near):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in dedup.near_duplicates(table(spark, near)).collect()}
    assert got == brute.near_duplicates(near)


def test_one_id_with_several_texts(spark):
    """No link of a text is lost, and no text, where its id also stands for another text."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (5, a), (6, a + " more"), (1, a), (0, c), (1, c + " more"), (9, b), (None, a), (7, ""), (7, None), (7, "x")]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in dedup.near_duplicates(table(spark, rows)).filter("doc_id is not null").collect())
    assert got == [(0, 0, True), (1, 0, False), (1, 1, True), (1, 1, True), (1, 1, True), (5, 1, False), (6, 1, False), (7, 7, True), (7, 7, True), (7, 7, True), (9, 1, False)]
    kept = dedup.keep_first(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.filter("doc_id <> 7 or text = 'x'").collect()) == [(0, c), (1, a), (1, b), (7, "x")]
    assert kept.filter("doc_id is null").count() == 1 and kept.filter("doc_id = 7").count() == 2
    assert dedup.keep_first(table(spark, [])).collect() == []


def test_near_duplicates_of_odd_rows(spark):
    rows = [tuple(r) for r in dedup.near_duplicates(table(spark, ODD)).collect()]
    by = {r[0]: r[1:] for r in rows}
    assert by[6] == (1, 5, False) and by[5] == (1, 5, True) and by[2] == (0, 2, True) and by[None] == (3, None, True) and by[7] == (3, 7, True)
    kept = dedup.keep_first(table(spark, ODD))
    assert kept.columns == table(spark, []).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 7, None, 8])


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 70)] + [(200, 200 + i) for i in range(1, 50)] + [(500, 400), (400, 500), (300, 300)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(71)}, **{i: 200 for i in range(200, 250)}, 400: 400, 500: 400}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 4 decontamination

ITEMS = [("a", "The quick brown fox jumps over the lazy dog and then it sleeps for a while"), ("b", "Tiny item"), ("c", "quick brown fox"), ("d", None), ("e", "..."), ("f", "one two three four five six seven eight nine ten"), ("g", "one two three four five six seven eight nine ten eleven"), ("a2", "the QUICK brown fox jumps over the lazy dog and then it rests")]


@pytest.mark.parametrize("most", [automaton.BLOCK_BYTES, 80])
def test_decontamination_equals_brute_force(spark, most):
    rng = random.Random(2)
    pool = [w for _, t in ITEMS if t for w in t.split()] + ["other", "tiny", "item", "Fox!", "é"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(100 + k, f"x {t} y {t}") for k, (_, t) in enumerate(ITEMS) if t] + [(200, ITEMS[0][1][:48] + " zzz"), (201, None), (202, "")]
    rows += [(203, " ".join(["one two three four five six seven eight nine ten"] * 3)), (203, "tiny, ITEM")]
    df = table(spark, rows)
    bench = spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id string, text string, doc_id long")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in automaton.matches(df, bench, most=most).withColumn("n_hit", automaton.hit_words()).collect())
    want = []
    for i, t in rows:
        n, hit, found = brute.contamination(t, ITEMS)
        want.append((i, n, len(hit), tuple(sorted(found))))
    assert got == sorted(want)
    left = {(r["doc_id"], r["text"]): r for r in automaton.decontaminate(df, bench, most=most).collect()}
    for i, t in rows:
        if not brute.contamination(t, ITEMS)[1]:
            assert (i, t) in left
    assert all(not brute.contamination(t, ITEMS)[1] for _, t in left) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in left.values())
    assert 203 not in {i for i, _ in left} and automaton.matches(df, bench.limit(0)).filter("size(items) > 0").count() == 0


def test_block_size_does_not_change_what_is_cut(spark):
    rng = random.Random(5)
    runs = {k: [f"{k}{n}" for n in range(12)] for k in "abcdefgh"}
    items = [(k, " ".join(x)) for k, x in runs.items()]
    plain = lambda k, n: " ".join(f"own{k}x{i}" for i in range(n))
    rows = [(i, f"{items[i][1]} {plain(i, 8)} {items[j][1]} {plain(j, 8)}") for i in range(8) for j in range(8) if i != j]  # 60 % from two items
    rows += [(100 + 8 * i + j, f"{plain(i, 40)} {' '.join(runs['abcdefgh'[i]][:6])} {items[j][1]} {' '.join(runs['abcdefgh'[i]][6:])} {plain(j, 40)}") for i in range(8) for j in range(8) if i != j]
    rows += [(i, t) for i, t in rows[:3]] + [(300, None), (301, ""), (302, plain(0, 30))]
    rng.shuffle(rows)
    df = table(spark, rows)
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert len(list(automaton.item_blocks(bench, most=60))) > 1
    one, many = (sorted(map(str, automaton.decontaminate(df, bench, most=most).collect())) for most in (automaton.BLOCK_BYTES, 60))
    left = [r["text"] for r in automaton.decontaminate(df, bench, most=60).collect()]
    assert one == many and len(many) == 56 + 3 and not any(brute.contamination(t, items)[1] for t in left)


def test_query_of_decontamination(spark, docs):
    items = [(str(r["item_id"]), r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.contamination(spark, SF).collect()}
    for i, t in docs:
        n, hit, found = brute.contamination(t, items)
        assert got[i] == (n, len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    assert any(x[-1] for x in got.values())


# ---- 5 token counts


def test_counts_equal_the_public_tokenizer(spark, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path(queries.UNIGRAM_VOCABULARY)
    rng = random.Random(4)
    tied = [("<unk>", 0.0), *[(w, -float(rng.randrange(1, 4))) for w in ("a", "b", "ab", "ba", "aba", "bab", "▁", "▁a", "▁ab", "bb", "abab")]]
    strings = ["".join(rng.choice("abx ▁") for _ in range(rng.randrange(25))) for _ in range(400)]
    for vocabulary, texts in ((tied, strings), (pieces.vocabulary(path), [t for _, t in docs] + [t for _, t in ODD] + strings[:50] + ["<unk><unk> x", "  two  blanks ", "zßﷺ" * 9])):
        public = Tokenizer(models.Unigram(vocabulary, unk_id=0))
        public.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
        own = pieces.Counter(vocabulary)
        assert [own.text(t or "")[0] for t in texts] == [len(public.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = {r["doc_id"]: r["n_tokens"] for r in queries.token_counts(spark, SF).collect()}
    assert got == {i: own.text(t or "")[0] for i, t in docs}


def test_score_is_the_best_of_all_paths():
    vocabulary = [("<unk>", 0.0), ("a", -1.5), ("b", -2.0), ("ab", -2.5), ("aba", -4.5), ("▁a", -1.0), ("▁", -0.5)]
    own = pieces.Counter(vocabulary)

    def best(word):
        if not word:
            return 0.0
        options = [s + best(word[len(p) :]) for p, s in vocabulary[1:] if word.startswith(p)]
        if not any(word[0] == p for p, _ in vocabulary):
            options.append(min(s for _, s in vocabulary) - 10 + best(word[1:]))
        return max(options)

    rng = random.Random(1)
    for _ in range(200):
        word = "▁" + "".join(rng.choice("abz") for _ in range(rng.randrange(8)))
        assert own.best(word)[1] == pytest.approx(best(word))


# ---- 6 toxicity


def test_grades_are_learned():
    rng = random.Random(9)
    bad = [f"vile{i}" for i in range(12)]
    texts, grade = [], []
    for _ in range(1500):
        g = rng.choice([0, 0, 0, 1, 2])
        w = [f"w{rng.randrange(300)}" for _ in range(40)] + rng.sample(bad, (0, 2, 6)[g])
        rng.shuffle(w)
        texts.append(" ".join(w))
        grade.append(g)
    w = words(pa.array(texts[:1000]), ALNUM)
    f = severity.features(w)
    pairs = np.unique((np.broadcast_to(w.doc, f.shape) << severity.BITS | f)[f >= 0])
    model = severity.fit(pairs >> severity.BITS, pairs & ((1 << severity.BITS) - 1), np.array(grade[:1000]), 3)
    scores = model.scores(pa.array(texts[1000:]))
    held = np.array(grade[1000:])
    assert (model.grade(scores) == held).mean() > 0.95 and np.abs(model.expected(scores) - held).mean() < 0.2
    assert model.thresholds[0] < model.thresholds[1]
    one = severity.fit(np.zeros(0, int), np.zeros(0, int), np.zeros(5, int), 3)
    assert one.expected(one.scores(pa.array(["x", None])))[0] < 0.01


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels, all_docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    fitted = severity.learn(all_docs, labels.filter("doc_id % 4 != 0"))
    judged = severity.score(all_docs, fitted).join(labels.filter("doc_id % 4 = 0"), "doc_id").collect()
    bad = [r["rejected"] for r in judged if r["toxic"]]
    good = [r["rejected"] for r in judged if not r["toxic"]]
    assert sum(bad) >= 0.6 * len(bad) and sum(good) <= 0.05 * len(good)
    again = severity.learn(all_docs, labels.filter("doc_id % 4 != 0"))
    assert (again.weight == fitted.weight).all() and (again.thresholds == fitted.thresholds).all()
    none = severity.learn(all_docs, labels.limit(0))
    assert severity.keep_mild(all_docs, none).count() == all_docs.count()


# ---- 7 secrets


def _all_spans(text, rules=credentials.RULES):
    return sorted((a, k, b) for k, r in enumerate(rules) for a, b in r.spans(text or ""))


def test_index_misses_nothing(docs):
    rng = random.Random(8)
    bits = ["password", "PassWd", " : ", "=", '"', "'", "AKIA", "ABCDEFGH1234567890", "0123456789abcdef", "deadbeef", "apikey", "API_KEY=", "x" * 15, "ſecret:", "toKen =", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOi1.eyJzdWIiOiIx.", "ghp_" + "a1" * 20, "xoxb-1234567890-x", "Authorization: Bearer abcdefghijkl123", "ftp://me:word12@host/", "é", "\n", " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(600)] + [t for _, t in docs] + [None, ""]
    found = credentials.find(pa.array(texts))
    assert found == [_all_spans(t) for t in texts]
    kinds = {k for x in found for _, k, _ in x}
    assert kinds == set(range(len(credentials.RULES)))


def test_private_keys_are_found_whole():
    rule = next(r for r in credentials.RULES if r.kind == "private_key")
    head, end, body = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "\n".join(["MIIEpAIBAAKCAQ+/" * 4] * 5)
    fields = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A\n\n"
    keys = [f"{head}\n{body}\nab==\n{end}", f"{head}\n{fields}{body}\nabc\n{end}", f"{head}\n> {body}\n{end}", f"{head}\\n{body}\\nab==\\n{end}".replace("\n", "\\n"), f"{head} {body} {end}".replace("\n", " ")]
    keys += [f"{head}\r\n{body}\r\nabc", f"{head}\n{fields}{body}\nab==", f"{head}\\n{body}\\nab==".replace("\n", "\\n"), f"{head}\n{body}\nabc\n-----END"[:-9], head.replace("RSA", "VERY " * 20 + "RSA"), head]
    for key in keys:
        for after in ("", "\n", "\n\nThen a line of prose.", "\nNote: a line", '", then prose'):
            text = f'before "{key}{after}'
            assert rule.spans(text) == [(8, 8 + len(key))], text
            assert credentials.mask(text, credentials.find(pa.array([text]))[0]) == f'before "[SECRET]{after}'
    two = f"{head}\n{body}\n{keys[0]} and {keys[1]}"
    assert [two[a:b] for a, b in rule.spans(two)] == [f"{head}\n{body}", keys[0], keys[1]]
    assert len(rule.spans(head * 20_000 + "-" * 500_000 + (body + "\n") * 5_000)) == 20_000


def test_logins_of_any_length():
    rule = next(r for r in credentials.RULES if r.kind == "url_login")
    for user, word in (("", "hunter22"), ("u" * 65, "word12"), ("me", "p" * 129), ("u" * 5000, "p" * 5000)):
        text = f"see redis://{user}:{word}@host/"
        assert rule.spans(text) == [(4, text.index("@") + 1)] and credentials.find(pa.array([text]))[0]
    assert not rule.spans("a://b:c@host") and not rule.spans("http://host:8080/x me@host")


def test_trigram_queries():
    assert credentials.trigram_query("[0-9a-f]+") is True
    assert credentials.trigram_query("AKIA[A-Z0-9]+") == ("and", frozenset({b"aki", b"kia"}))
    assert credentials.trigram_query("abc|de") is True
    assert credentials.trigram_query("(?:abc|abd)x?") == ("or", frozenset({b"abc", b"abd", ("and", frozenset({b"abc", b"bcx"})), ("and", frozenset({b"abd", b"bdx"}))}))


def test_query_of_secrets(spark, docs):
    got = {r["doc_id"]: r for r in queries.secrets(spark, SF).collect()}
    names = [r.kind for r in credentials.RULES]
    for i, t in docs:
        spans = _all_spans(t)
        base = [s for s in spans if s[1] < 3]
        told = lambda x: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in x)
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in base) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(told(base).encode()).hexdigest() and r["spans"] == told(spans)
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in got.values()) > 0


def test_masked_texts(spark):
    rows = [(1, "é token = abcdefghijkl0123 end"), (2, None), (3, "clean"), (4, "deadbeefdeadbeef" * 3), (5, "key ghp_" + "ab12" * 10 + "!"), (6, "")]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in credentials.redact(table(spark, rows)).collect()}
    assert got[1] == ("é [SECRET] end", 14) and got[2] == (None, None) and got[3] == ("clean", 5) and got[4] == ("[SECRET]", 8) and got[5] == ("key [SECRET]!", 13)
    assert all(not _all_spans(t) for t, _ in got.values())


# ---- 8 byte BPE


def test_bpe_equals_the_public_library(spark, docs):
    import tiktoken

    path = public_tokenizers.path(queries.BPE_VOCABULARY)
    ranks = bpe.read_ranks(path)
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    odd = ["", None, "a" * 399 + "b", "ab" * 700, "\n\n \t x", "<|endoftext|>", "日本語テキスト😀" * 40, "".join(chr(rng.randrange(32, 1500)) for _ in range(3000)), "it's we'LL 1234567  x"]
    texts = [t for _, t in docs[:80]] + odd
    with bpe.Bpe(bpe.vocabulary(ranks), public_tokenizers.PATTERN) as own:
        ids, bounds = own.encode(texts)
    with own:  # again, with the words that were kept
        assert all(np.array_equal(a, b) for a, b in zip(own.encode(texts), (ids, bounds)))
        own.forget(7)
        assert all(np.array_equal(a, b) for a, b in zip(own.encode(texts), (ids, bounds)))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [public.encode_ordinary(t or "") for t in texts]
    assert bpe.Decoder(ranks).decode(ids, bounds).to_pylist() == [(t or "").encode() for t in texts]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.byte_pairs(spark, SF).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, t in docs:
        want = public.encode_ordinary(t or "")
        assert got[i] == (len(want), sha(",".join(map(str, want)).encode()), sha((t or "").encode()))


def test_contraction_follows_ranks_not_order():
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abc", b"ab", b"abcd", b"cd", b"aa", b"aaa"]
    own = bpe.Bpe(bpe.vocabulary({t: r for r, t in enumerate(tokens)}), r".+")

    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            found = [(own.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in own.ranks]
            if not found:
                return [own.ranks[p] for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(5, 30))) for _ in range(300)]
    with own:
        ids, bounds = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain(t.encode()) for t in texts]
    assert all(own._heap(t.encode()) == plain(t.encode()) for t in texts)


# ---- 9 language model


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 40)))) for i in range(400)] + [(900, None), (901, "Unseen words only"), (902, "")]


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_model_equals_brute_force(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_WORDS", block)
    held = {i for i, _ in corpus if zlib.crc32(str(i).encode()) % 7 == 2}
    model = brute.Katz([t for i, t in corpus if i not in held], katz.discounts, katz.CUT)
    got = {r["doc_id"]: r for r in katz.score(table(spark, corpus).repartition(3), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).collect()}
    n, v = model.n, len(model.c1)
    for i, t in corpus:
        w, r = model.tokens(t), got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(w), sum(x in model.c1 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((model.c1[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] == pytest.approx(model.score(t), abs=1e-6)
    assert held and 0 < len(held) < len(corpus)


def test_chances_add_up(corpus):
    model = brute.Katz([t for _, t in corpus], katz.discounts, katz.CUT)
    every = [*model.c1, "something unknown"]
    assert sum(model.known(w) for w in every) == pytest.approx(1)
    for h in [None, "w0", "w3", "w40", "unseen"]:
        assert sum(model.chance(h, w) for w in every) == pytest.approx(1)


def test_discounts():
    assert katz.discounts([100, 40, 20, 12, 8, 6]).tolist()[0] == 1.0
    assert all(0 < x < 1 for x in katz.discounts([100, 40, 20, 12, 8, 6])[1:])
    assert katz.discounts([3, 0, 0, 0, 0, 0])[1] == 0.5


def test_model_without_training_rows(spark):
    rows = katz.score(table(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]


# ---- 10 archives


def test_headers_of_both_versions():
    body = b"1 0 org\nURL IP-address Archive-date Content-type Archive-length\n"
    one = b"filedesc://x.arc 0.0.0.0 20010101000000 text/plain %d\n%s\n" % (len(body), body)
    page = b"HTTP/1.0 200 OK\r\nX-Page-Id: -5\r\n\r\n<p>\r\n\r\nhttp://a 1 2 3 4\n</p>"
    one += b"http://a/%%20 1.2.3.4 2001020304 text/html %d\n%s\n" % (len(page), page)
    one += b"dns:a 1.2.3.4 20010203040506 text/dns 3\nabc\n"
    got = list(archives.arc_records(io.BytesIO(one), "x"))
    assert [(r.kind, r.page_id, r.date, r.ip) for r in got] == [("response", -5, "2001-02-03T04:00:00Z", "1.2.3.4"), ("resource", None, "2001-02-03T04:05:06Z", "1.2.3.4")]
    assert got[0].payload_digest == hashlib.sha1(page.split(b"\r\n\r\n", 1)[1]).hexdigest() and got[1].payload_bytes == 3
    about = b"2 0 org\n" + archives.ARC_FIELDS[2].encode() + b"\n"
    two = b"filedesc://x.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 x.arc %d\n%s\n" % (len(about), about)
    two += b"http://a - 20010203040506 text/html 200 sum - 9 x.arc %d\n%s\n" % (len(page), page)
    assert [(r.kind, r.ip) for r in archives.arc_records(io.BytesIO(two), "x")] == [("response", None)]
    with pytest.raises(ValueError, match="cut off"):
        list(archives.arc_records(io.BytesIO(two[:-9]), "x"))
    with pytest.raises(ValueError, match="version"):
        list(archives.arc_records(io.BytesIO(one + b"http://b - 2001 t 200 s - 9 x 3\nabc\n"), "x"))


def test_pages_come_back(spark, tmp_path):
    big, other = "<p>é\r\n\r\nWARC/1.0\r\n</p>" * 60, "x" * 999
    rows = [(1, "http://a/b c", big), (5, None, big), (3, "", big), (9, "http://d", other), (8, "http://e", other), (2, "http://n", None), (4, "http://empty", ""), (7, "http://dup", big + "!"), (7, "http://dup", big + "!"), (None, "http://f", big + "?")]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, kind string, block int").repartition(3)
    archives.write_arc(pages, str(tmp_path / "arc"))
    archives.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = sorted((tuple(r) for r in archives.captures(spark, str(tmp_path / "warc")).collect()), key=repr)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    want = []
    for i, _, t in rows:
        last = 5 if t == big else None
        want.append((i, size(t), sha(t), "revisit" if last and i != last else "response", last if last and i != last else None))
    at = [k for k, w in enumerate(want) if w[0] == 7][0]
    want[at] = (7, size(big + "!"), sha(big + "!"), "revisit", 7)  # of two equal rows one is kept
    assert got == sorted(want, key=repr)
    raw = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "warc").glob("part-*")))
    assert raw.count(b"WARC-Type: revisit\r\n") == 3 and b"WARC-Profile: " in raw and raw.count(b"WARC-Type: warcinfo") >= 1
    ids = re.findall(rb"WARC-Record-ID: (\S+)", raw)
    assert len(ids) == len(set(ids))
    digest = base64.b32encode(hashlib.sha1(big.encode()).digest())
    assert b"WARC-Payload-Digest: sha1:" + digest in raw
    archives.write_arc(pages.limit(0), str(tmp_path / "arc0"))
    archives.convert(spark, str(tmp_path / "arc0"), str(tmp_path / "warc0"))
    assert archives.captures(spark, str(tmp_path / "warc0")).count() == 0
