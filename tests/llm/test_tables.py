"""Problems 1, 3 and 5 on small fixtures, against plain Python."""

import math
import random
import statistics
import unicodedata
from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from codestrata.llm import cooccurrence as C
from codestrata.llm import frequency as Q
from codestrata.llm import fusion as U


def test_exact_median_narrows(spark):
    r = random.Random(1)
    for values in ([r.gauss(0, 1) for _ in range(3001)], [r.choice([1, 1, 1, 2, 900]) for _ in range(800)], [float(i) for i in range(1000)], [5.0], [1.0, 4.0]):
        cells = spark.createDataFrame([(float(v), 1) for v in values], "x double, n long")
        for limit in (100_000, 40):
            assert math.isclose(U.exact_median(cells, F.col("x"), limit=limit), statistics.median(values), abs_tol=1e-12)
    assert U.exact_median(spark.createDataFrame([(None, 1)], "x double, n long"), F.col("x")) is None


def test_fuse(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, 1, 2, 3, 50]), r.choice([None, float("nan"), 0.0, 10.0, 1e9]), "x") for i in range(200)]
    rows += [(900, None, None, "x"), (901, 7, None, "x")]
    df = spark.createDataFrame(rows, "id int, a int, b double, n string").selectExpr("*", "'old' as rank", "1 as _a")
    got = {x.id: x for x in U.fuse(df, {"a": 1.0, "b": 2.0}).collect()}
    assert len(got) == len(rows)

    def stats(v):
        m = statistics.median(v)
        d = [abs(x - m) for x in v]
        return m, 1.4826 * statistics.median(d) or 1.2533 * statistics.mean(d)

    col = lambda k: [x[k] for x in rows if x[k] is not None and x[k] == x[k]]
    (ma, sa), (mb, sb) = stats(col(1)), stats(col(2))
    sq = lambda x, m, s: 1 / (1 + math.exp(min(700.0, -(x - m) / s)))
    want, key = {}, {}
    for i, a, b, _ in rows:
        there = [a is not None, b is not None and b == b]
        z = [(a - ma) / sa if there[0] else 0.0, (b - mb) / sb if there[1] else 0.0]
        log = sum(w * -math.log1p(math.exp(min(700.0, -x))) for w, x in zip((1.0, 2.0), z))
        want[i] = math.exp(log / 3) if any(there) else None
        key[i] = (round(log, 10), round(z[0] + 2 * z[1], 6)) if any(there) else None
    for i, w in want.items():
        assert (got[i].fused is None) == (w is None) and (w is None or abs(got[i].fused - w) < 2e-6)
    assert all(x.rank == 1 + sum(k is not None and k > key[x.id] for k in key.values()) for x in got.values() if key[x.id]) and got[900].rank is None
    same = spark.createDataFrame([(1, 3), (2, 3)], "id int, a int")
    assert [x.fused for x in U.fuse(same, {"a": 1.0}).collect()] == [0.5, 0.5]
    assert U.fuse(df.limit(0), {"a": 1.0, "b": 1.0}).count() == 0


def test_missing_score_is_no_bonus(spark):
    """A row without a score never outranks one that is higher in the shared score and above the median in the other."""
    r = random.Random(6)
    rows = [(i, r.choice([1, 2, 3, 5, 147, 991]), r.choice([None, 1, 2, 10, 5000])) for i in range(300)]
    got = {x.id: x for x in U.fuse(spark.createDataFrame(rows, "id int, a int, b int"), {"a": 1.0, "b": 1.0}).collect()}
    mid = statistics.median(b for _, _, b in rows if b is not None)
    for x in got.values():
        for y in got.values():
            if x.b is None and y.b is not None and y.a > x.a and y.b > mid:
                assert y.rank < x.rank
            if x.b == y.b and y.a > x.a:
                assert y.rank < x.rank  # saturated scores keep their order


def test_many_cells(spark, monkeypatch):
    rows = [(i, i % 7 if i % 3 else 2, i % 5 if i % 4 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a int, b int")
    few = {x.id: (x.fused, x.rank) for x in U.fuse(df, {"a": 1.0, "b": 1.0}).collect()}
    monkeypatch.setattr(U, "FEW_CELLS", 1)
    monkeypatch.setattr(U, "HOT_CELL", 5)
    many = U.fuse(df, {"a": 1.0, "b": 1.0}).collect()
    assert len(many) == 400 and {x.id: (x.fused, x.rank) for x in many} == few


def test_ngrams(spark):
    r = random.Random(3)
    seqs = [("f", r.choice(["a", "b", None, "d"]), [r.choice("xyz") for _ in range(r.randint(0, 6))]) for _ in range(300)]
    seqs += [("g", "a", ["x"] * 50), ("f", "a", None)]
    n, docs = Counter(), defaultdict(set)
    for f, rec, t in seqs:
        for i in range(len(t or [])):
            for j in range(i + 1, min(len(t), i + 3) + 1):
                n[f, tuple(t[i:j])] += 1
                docs[f, tuple(t[i:j])] |= {rec} - {None}
    df = spark.createDataFrame(seqs, "field string, record string, terms array<string>")
    for hot in (200_000, 5):
        rows = Q.ngram_counts(df, 3, hot_rows=hot).collect()
        assert {(x.field, tuple(x.gram)): (x.occurrences, x.records) for x in rows} == {k: (v, len(docs[k])) for k, v in n.items()}
        assert len(rows) == len(n)


def test_value_marks(spark):
    rows = [(f"f{i}", "run", "Function") for i in range(30)] + [("f1", "été​", " METHOD "), ("f2", "été", "method"), ("f3", None, None), ("f4", "  ", "﻿method")]
    got = {(x.field, x.value): (x.occurrences, x.files, x.mark) for x in Q.value_frequencies(spark.createDataFrame(rows, "file string, name string, kind string")).collect()}
    assert got[("name", unicodedata.normalize("NFC", "été"))] == (2, 2, "rare")
    assert got[("name", "run")] == (30, 30, "common") and got[("name", "")] == (1, 1, "rare")
    assert got[("kind", "function")] == (30, 30, "common") and got[("kind", "method")] == (3, 3, None)
    assert Q.value_frequencies(spark.createDataFrame([], "file string, name string, kind string")).count() == 0


def test_terms_of_names(spark):
    rows = [("a", 1, "BindCatalogñ"), ("b", 2, "bind_catalog\u006e\u0303"), ("c", 3, "get\u200bGraph24é"), ("d", 4, "解析HTMLTree"), ("e", 5, None), ("f", 6, "__")]
    got = {x.n: x.t for x in spark.createDataFrame(rows, "s string, n int, name string").transform(lambda df: Q.canonical_columns(df, "name")).select("n", Q.name_terms(F.col("name")).alias("t")).collect()}
    assert got == {1: ["bind", "catalogñ"], 2: ["bind", "catalogñ"], 3: ["get", "graph24é"], 4: ["解析html", "tree"], 5: None, 6: []}


def test_pairs(spark, monkeypatch):
    r = random.Random(4)
    names = [f"r/{i}" for i in range(12)]
    rows = []
    for k in range(150):
        fs = [r.choice(["", "./"]) + r.choice(names) + r.choice(["", "\r"]) for _ in range(r.randint(0, 6))]
        rows += [(k, r.choice(["r", None]) if k % 7 else "q", fs + [None, ""], 1)] * r.choice([1, 1, 2])
    rows = [next(x for x in rows if x[0] == y[0]) for y in rows]
    rows += [(900, "r", None, 1), (901, "r", [], 1), (902, "r", [f"z{i}" for i in range(31)], 1), (None, "r", ["r/1", "r/2"], 1)]
    base = {}
    for k, g, fs, _ in rows:
        items = sorted({x.removesuffix("\r").removeprefix("./") for x in fs or [] if x} - {""})
        if k is not None and 0 < len(items) <= 30:
            base[k] = (g, items)
    single, both, total = Counter(), Counter(), Counter()
    for g, items in base.values():
        total[g] += 1
        single.update((g, x) for x in items)
        both.update((g, a, b) for a, b in combinations(items, 2))
    df = spark.createDataFrame(rows, "key long, grp0 string, files array<string>, pair_n int")
    got = C.pair_counts(C.baskets(df, "key", "grp0", "files"), 2, 0.5).collect()
    want = {k: s for k, s in both.items() if s >= 2 and s * total[k[0]] >= 0.5 * single[k[0], k[1]] * single[k[0], k[2]]}
    assert {(x.grp, x.item_a, x.item_b): x.pair_n for x in got} == want and len(got) == len(want)
    for x in got:
        lift = x.pair_n * total[x.grp] / (single[x.grp, x.item_a] * single[x.grp, x.item_b])
        assert abs(x.lift - lift) < 1e-5 and abs(x.pmi - math.log2(lift)) < 1e-5
    monkeypatch.setattr(C.salted_join, "__defaults__", (3, 1))
    again = C.pair_counts(C.baskets(df, "key", "grp0", "files"), 2, 0.5).collect()
    assert {(x.grp, x.item_a, x.item_b): x.pair_n for x in again} == want and len(again) == len(want)
    assert C.pair_counts(C.baskets(df.limit(0), "key", "grp0", "files")).count() == 0
