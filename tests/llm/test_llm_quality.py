"""Anomaly rules, fill-in-the-middle and the audit of filters against brute force, with every odd case."""

import hashlib
import os
import random
import re
from collections import Counter
from itertools import permutations
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from paytrail.llm import anomalies, audit, middle, queries
from paytrail.llm.words import gathered
from paytrail.sources.scratch import ROW_BY_ROW, pin

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "\n".join(f"word{i % 5000} Ünïcode # {i % 7}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard long, slot int, words string, n long, form string, output string, score double, part string, digest string"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, g, "src0", 1, -1, 2, "w x", -3, "psm", "o", 0.5, "p", "d") for i, t, g in rows], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame([(i, q, t, 9, "x") for i, q, t in rows], "doc_id long, quality int, toxic int, n long, fails string")


ODD = [
    (1, None, "en"), (2, "", None), (3, " \t\n", "en"), (4, LONG, "de"), (5, "one", ""), (6, "One\n\nOne\n  \nOne", "en"), (7, "a b c d e f g a b c d e f g", "en"),
    (7, "a b c d e f g a b c d e f g", "en"), (None, "a b c d e f g a b c d e f g", "en"), (8, "日本語 テキスト 😀 x y\n", "ja"), (9, "<P>is <S>kept\n<M>", "en"), (10, "a\r\nb\n\nc", None),
    (11, "a<\n<S\n>b<M", "en"), (12, LONG, "fr"), (13, "A " * 99 + "A", "en"), (14, "x x x x x x x x x x x x", "en"), (7, "other text", "en"),
]


@pytest.fixture(scope="module")
def real():
    return [(r["doc_id"], r["text"], r["lang"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, hit = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            hit.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(lines), len(set(w)), len(re.findall("[A-Z]", text)), len(re.findall(r"[!-/:-@\[-`{-~]", text)), len(text)


def test_counts_match_brute_force(spark, real):
    rng = random.Random(5)
    made = [(1000 + k, "".join(rng.choice(["a", "b", "c", " ", "\n", "é", "#", "A"]) for _ in range(rng.randrange(80))), "en") for k in range(300)]
    rows = ODD + real + made
    got = [tuple(r) for r in anomalies.statistics(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(i, *counts(t)) for i, t, _ in rows], key=str)


def test_quality_query_on_every_row(spark, real):
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_quality"](spark, SF).collect()}
    assert len(got) == len(real)
    for i, t, _ in real:
        want, r = counts(t), got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want[:5]
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])


def walk(forest, x):
    """Score of one row, node by node."""
    total = 0.0
    for node in forest.roots:
        while forest.column[node] >= 0:
            node = forest.left[node] + (x[forest.column[node]] >= forest.value[node])
        total += forest.value[node]
    return 2 ** (-total / len(forest.roots) / float(anomalies.expected_path(forest.size)))


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(1)
    good, poor = rng.normal(size=(500, 3)), rng.normal(6, 1, size=(60, 3))
    forest = anomalies.grow(good, poor)
    x = np.concatenate([good[:50], poor[:50]])
    got = forest.score(x)
    assert np.allclose(got, [walk(forest, r) for r in x])
    assert got[50:].min() > np.quantile(got[:50], 0.9)
    again = anomalies.grow(good, poor)
    assert np.array_equal(again.value, forest.value) and np.array_equal(again.column, forest.column)


def test_paths_end_where_rows_stand_alone():
    """Two rows are cut once; equal rows never; the mean path of a search tree over three rows is 2 (H(2)) - 4/3."""
    two = anomalies.grow(np.array([[0.0], [1.0]]), np.zeros((0, 1)), trees=3)
    assert two.score(np.array([[0.0], [1.0]])).tolist() == [0.5, 0.5]
    equal = anomalies.grow(np.ones((8, 2)), np.zeros((0, 2)), trees=2)
    assert (equal.column == -1).all()
    assert float(anomalies.expected_path(2)) == 1.0 and float(anomalies.expected_path(1)) == 0.0
    none = anomalies.grow(np.zeros((0, 2)), np.zeros((0, 2)))
    assert none.score(np.ones((3, 2))).tolist() == [0, 0, 0]


def test_calibration_takes_the_widest_gap():
    assert anomalies.calibrate([(10, 0, 1000), (20, 50, 0)], bins=100) == pytest.approx(0.16)
    assert anomalies.calibrate([(10, 0, 1000), (30, 0, 20), (40, 50, 0)], lose=0.005, bins=100) == pytest.approx(0.36)
    assert anomalies.calibrate([(10, 5, 0)], bins=100) == np.inf
    assert anomalies.calibrate([], bins=100) == np.inf
    assert anomalies.calibrate([(10, 5, 0), (50, 0, 100)], bins=100) == np.inf  # poor rows look more usual than good ones


def test_held_out_labels(spark):
    """Trained on the labels of even ids, judged on those of odd ids that the base rules let pass."""
    sf = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    stats = anomalies.statistics(docs).cache()
    model = anomalies.learn(stats, known.filter("doc_id % 2 = 0"))
    rows = anomalies.judge(stats, model).join(known.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").select("quality", "kept").collect()
    poor, good = [r["kept"] for r in rows if r["quality"] == 0], [r["kept"] for r in rows if r["quality"] == 1]
    assert len(poor) > 8 and np.mean(poor) < 0.1 and np.mean(good) > 0.95


def test_no_labels_reject_nothing_more(spark):
    none = labels(spark, [])
    got = anomalies.quality(table(spark, ODD), none).collect()
    assert len(got) == len(ODD) and all(r["kept"] != r["base_failed"] for r in got)
    assert anomalies.quality(table(spark, []), labels(spark, [(1, 0, 1), (None, 1, None), (3, None, 0)])).collect() == []


def middle_of(i, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return i, n, "plain", text, None, None
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (i, n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)) if h[3] % 100 < 50 else (i, n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


def test_middle_matches_brute_force(spark, real):
    rng = random.Random(3)
    made = [(1000 + k, "".join(rng.choice(["a", "\n", "<", "S>", "<M", "\r", " ", "😀", "$1", "\\"]) for _ in range(rng.randrange(30))), "en") for k in range(500)]
    rows = ODD + real + made + [(5000 + k, "x" * 200_000 + "\n" * 200_000, "en") for k in range(4)]
    out = middle.restore(middle.transform(table(spark, rows)))
    got = [tuple(r) for r in out.select("doc_id", "n", "form", "output", middle.prefix_chars(), middle.middle_chars(), "restored").collect()]
    assert sorted(got, key=str) == sorted([(*middle_of(i, t), t or "") for i, t, _ in rows], key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_middle_parameters_and_empty_table(spark):
    rows = table(spark, [(i, "a\nb\nc", "en") for i in range(200)])
    forms = Counter(r["form"] for r in middle.transform(rows, middle.Params(rate=30, spm=0)).collect())
    assert set(forms) == {"plain", "psm"} and 25 < forms["psm"] < 95
    assert middle.restore(middle.transform(table(spark, []))).collect() == []


def test_middle_is_one_stage_without_python(spark):
    plan = middle.restore(middle.transform(table(spark, ODD)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def audit_of(rows, known):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = {i for i, q, _ in known if q == 1} - {None}, {i for i, _, t in known if t == 1} - {None}
    cases = {}
    for i, t, g in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {k for k, c in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i)) if c}
        cases.setdefault(g or "", []).append((fails, i in good, i in toxic))
    out = []
    for part, found in cases.items():
        shapley, mine = Counter(), []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                left = [x for x in found if not x[0] & set(order[:k])]
                gone = [x for x in left if f in x[0]]
                shapley[f] += len(gone)
                mine.append((part, "".join(order), k + 1, len(left) - len(gone), len(gone), sum(f in x[0] for x in found) - len(gone), sum(x[0] == {f} for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in mine]
    return sorted(out)


NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
KNOWN = [(1, 1, 0), (1, 0, 1), (4, 0, 0), (5, None, 1), (None, 1, 1), (7, 1, None), (8, 2, 1), (12, 1, 1)]


def test_audit_matches_brute_force(spark, real):
    rows = ODD + [(i + 100, t, g) for i, t, g in real[:120]]
    known = KNOWN + [(i + 100, i % 2, i % 3 == 0) for i in range(0, 120, 3)]
    got = audit.audit(table(spark, rows).repartition(5), labels(spark, [(i, q, None if t is None else int(t)) for i, q, t in known]))
    assert sorted(tuple(r) for r in got.select(*NAMES).collect()) == audit_of(rows, known)
    assert dict(got.dtypes)["step"] == "int" and all(dict(got.dtypes)[c] == "bigint" for c in NAMES[3:])


def test_audit_of_copies_with_and_without_ids(spark):
    rows = [(5, "same", "en"), (5, "same", "en"), (None, "same", "en"), (6, "same", "de"), (4, "same", "de"), (4, None, "en"), (9, "", "en"), (None, None, None)]
    got = audit.audit(table(spark, rows), labels(spark, []))
    assert sorted(tuple(r) for r in got.select(*NAMES).collect()) == audit_of(rows, [])
    assert audit.audit(table(spark, []), labels(spark, [])).collect() == []


def test_matrix_has_one_dictionary(spark, real, monkeypatch):
    """Whole matrix against counters: equal words have one number in all shards, different words have different ones."""
    monkeypatch.setattr(audit, "SHARD_BYTES", 1 << 14)
    rows = ODD + real[:80]
    shards = audit.term_matrix(table(spark, rows).repartition(4)).collect()
    assert len(shards) > 10 and len({s["shard"] for s in shards}) == len(shards)
    texts, got = {}, Counter()
    for i, t, _ in rows:
        texts.setdefault(i, []).append(Counter(WORD.findall(t or "")))
    for s in shards:
        for k, i in enumerate(s["row_id"]):
            a, b = s["bounds"][k], s["bounds"][k + 1]
            entries = dict(zip(s["columns"][a:b], s["counts"][a:b]))
            assert len(entries) == b - a
            assert any(sorted(entries.values()) == sorted(c.values()) for c in texts[i])
            for c in entries:
                got[c] += 1
    want = Counter(w for cs in texts.values() for c in cs for w in c)
    assert sorted(got.values()) == sorted(want.values())


def test_matrix_entries_by_word():
    col = pa.array(["b a b", None, "a  c\ta ", "", "c"])
    bounds, columns, counts, words = audit.count_terms(col)
    names = words.to_pylist()
    got = [Counter({names[columns[j]]: int(counts[j]) for j in range(bounds[i], bounds[i + 1])}) for i in range(len(col))]
    assert got == [Counter(b=2, a=1), Counter(), Counter(a=2, c=1), Counter(), Counter(c=1)]


def test_shard_rows_stay_small(spark, real, monkeypatch):
    """a shard's documents come in rows of bounded text with one dictionary, and each row is a Parquet group of its own."""
    monkeypatch.setattr(audit, "SHARD_BYTES", 1 << 15)
    monkeypatch.setattr(audit, "PIECE_BYTES", 1 << 12)
    rows = [(i, t, p) for i, (_, t, p) in enumerate(ODD + real[:80])]
    size = {i: len((t or "").encode()) for i, t, _ in rows}
    got = audit.term_matrix(table(spark, rows).repartition(2)).collect()
    assert len(got) > 2 * len({s["shard"] for s in got})
    for s in got:
        assert len(s["row_id"]) == 1 or sum(size[i] for i in s["row_id"]) <= 1 << 12
    totals = {r.row_id: (r.n_words, r.n_distinct) for r in audit.row_totals(audit.term_matrix(table(spark, rows))).collect()}
    assert totals == {i: (len(w := WORD.findall(t or "")), len(set(w))) for i, t, _ in rows}
    words = {}
    for s in got:
        for k, i in enumerate(s["row_id"]):
            for c in s["columns"][s["bounds"][k] : s["bounds"][k + 1]]:
                words.setdefault(c, []).append(i)
    of = Counter(w for _, t, _ in rows for w in set(WORD.findall(t or "")))
    assert sorted(map(len, words.values())) == sorted(of.values())
    held = pin(spark.range(5).select(F.array("id").alias("ids")).coalesce(1), "groups", ROW_BY_ROW)
    assert [pq.ParquetFile(urlparse(f).path).metadata.num_row_groups for f in held.df.inputFiles()] == [5]


def test_pieces_are_full_whatever_the_batches():
    """small batches make no shards of their own."""
    texts = ["a" * 40, None, "b" * 70, "c" * 30, "", "d" * 250, "e" * 100, "f"]
    batches = [pa.record_batch({"text": pa.array(texts[k : k + 2], pa.string())}) for k in range(0, len(texts), 2)]
    want = [texts[:2], texts[2:5], texts[5:6], texts[6:7], texts[7:]]
    assert [p.column(0).to_pylist() for p in gathered(iter(batches), "text", 100)] == want
    whole = pa.record_batch({"text": pa.array(texts, pa.string())})
    assert [p.column(0).to_pylist() for p in gathered(iter([whole]), "text", 100)] == want
