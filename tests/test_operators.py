import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from codestrata.operators import graph, history, lookup, maintain, notes, resolve, search

SYM = "id string, name string, fqn string, kind string, file string, start_line int, end_line int, signature string, doc string, exported boolean, language string, complexity int, cognitive int"
REF = "ref_id long, source_id string, target_id string, target_name string, kind string, file string, line int, receiver string, self_receiver boolean"
BIND = "file string, source_module string, line int, pos int, name string, alias string, bind string, local string"
FILE = "path string, language string, commit_frequency int"


def sym(i, name, file, kind="function", exported=True, cls=None, line=1, language="typescript", complexity=None):
    return (i, name, f"{file}:{cls}.{name}" if cls else f"{file}:{name}", kind, file, line, line + 5, "", None, exported, language, complexity, None)


def ref(i, source, target, name, file, line=1, receiver=None, self_receiver=None):
    return (i, source, target, name, "calls", file, line, receiver, self_receiver)


def bind(file, module, name, alias=None, kind="value", line=1, pos=0):
    return (file, module, line, pos, name, alias, kind, alias or name)


def build(spark, symbols, refs, binds, files=None):
    files = files or sorted({(s[4], s[10]) for s in symbols} | {(r[5], "typescript") for r in refs if r[5] not in {s[4] for s in symbols}})
    return resolve.Scoped(spark.createDataFrame(refs, REF), spark.createDataFrame(symbols, SYM), spark.createDataFrame(binds, BIND), spark.createDataFrame([(p, lang, None) for p, lang in files], FILE))


def tree(s, root, **k):
    rows = graph.caller_trees(s, s.symbols.where(F.col("id") == root).select("id"), **k).orderBy("node").collect()
    return [(r.symbol_id or r.file, r.depth, r.strength, r.is_cycle, r.leaf_by_policy, r.depth_capped, r.via) for r in rows]


def test_import_targets(spark):
    files = ["p/a.ts", "p/b.ts", "p/b/index.ts", "p/c.js", "p/c.ts", "p/d/__init__.py", "p/d.py", "p/e/f.py", "q/x.tsx", "p/y.mjs", "p/i.py", "p/t.ts"]
    cases = [("p/a.ts", "./b", "p/b.ts"), ("p/a.ts", "./c.js", "p/c.js"), ("p/a.ts", "../q/x.jsx", "q/x.tsx"), ("p/a.ts", "./y.mjs", "p/y.mjs"), ("p/a.ts", "lodash", None), ("p/c.js", "./t", "p/t.ts"), ("p/i.py", ".d", "p/d/__init__.py"),
             ("p/e/f.py", "..i", "p/i.py"), ("p/i.py", "os", None), ("p/i.py", ".", None), ("p/a.ts", "./none", None), ("p/a.ts", "./././b", "p/b.ts"), ("p/a.ts", ".././p/d/../t", "p/t.ts")]
    lang = lambda p: {"py": "python", "js": "javascript"}.get(p.rsplit(".")[-1], "typescript")
    b = spark.createDataFrame([bind(f, m, "x") for f, m, _ in cases], BIND)
    f = spark.createDataFrame([(p, lang(p), None) for p in files], FILE)
    got = {(r.file, r.source_module): r.target for r in resolve.import_targets(b, f).collect()}
    assert got == {(f, m): t for f, m, t in cases}


def test_scoping(spark):
    s = [sym("save1", "save", "a.ts"), sym("save2", "save", "b.ts"), sym("meth", "save", "c.ts", "method", cls="C"), sym("caller", "caller", "u.ts"), sym("hid", "hidden", "a.ts", exported=False),
         sym("go1", "Build", "g/a.go", language="go"), sym("gt", "Pairs", "g/a.go", "type", language="go"), sym("ab", "do", "a.ts")]
    r = [ref(1, "caller", None, "save", "u.ts"), ref(2, None, None, "save", "v.ts"), ref(3, None, None, "save", "w.ts"), ref(4, "caller", None, "save", "u.ts", receiver="obj"), ref(5, None, None, "save", "w.ts", receiver="ns"),
         ref(6, None, None, "store", "x.ts"), ref(7, None, None, "hidden", "u.ts", receiver="o"), ref(8, None, None, "Build", "g/b.go"), ref(9, None, None, "Pairs", "g/b.go"), ref(10, None, None, "do", "u.ts", receiver="o"),
         ref(11, "save1", None, "save", "a.ts", receiver="o"), ref(12, None, None, "save", "y.ts"), ref(13, None, None, "save", "z.ts", receiver="this", self_receiver=True), ref(14, None, None, "save", "t.ts", receiver="ty")]
    b = [bind("u.ts", "./a", "save"), bind("w.ts", "./b", "*", "ns", "namespace"), bind("x.ts", "./b", "save", "store"), bind("y.ts", "@lib/x", "save"), bind("t.ts", "./b", "ty", None, "type")]
    files = [(p, "go" if p.endswith(".go") else "typescript") for p in ("a.ts", "b.ts", "c.ts", "u.ts", "v.ts", "w.ts", "x.ts", "y.ts", "z.ts", "t.ts", "g/a.go", "g/b.go")]
    sc = build(spark, s, r, b, files)
    e = {}
    for x in sc.edges(sc.symbols).collect():
        e.setdefault(x.id, {})[x.ref_id] = x.strength
    assert e == {
        "save1": {1: "import-connected", 4: "weak-member", 12: "import-connected"}, "save2": {4: "weak-member", 5: "import-connected", 6: "import-connected", 11: "weak-member", 12: "import-connected"},
        "meth": {4: "weak-member", 11: "weak-member"}, "go1": {8: "import-connected"}, "gt": {9: "import-connected"},
    }
    assert {x.id: x.callers for x in sc.fan_in().collect()} == {k: len(v) for k, v in e.items()}


def test_caller_tree_goldens(spark):
    s = [sym("gamma", "gamma", "c.ts"), sym("beta", "beta", "b.ts"), sym("alpha", "alpha", "a.ts")]
    r = [ref(1, "beta", None, "gamma", "b.ts"), ref(2, "alpha", None, "beta", "a.ts")]
    b = [bind("b.ts", "./c", "gamma"), bind("a.ts", "./b", "beta")]
    sc = build(spark, s, r, b)
    assert tree(sc, "gamma") == [("beta", 1, "import-connected", False, False, False, None), ("alpha", 2, "import-connected", False, False, False, "beta")]
    assert tree(sc, "gamma", depth=1) == [("beta", 1, "import-connected", False, False, True, None)]
    sc = build(spark, [sym("foo", "fooo", "a.ts"), sym("bar", "barr", "a.ts", line=9)], [ref(1, "foo", "bar", "barr", "a.ts"), ref(2, "bar", "foo", "fooo", "a.ts")], [])
    assert [(x[0], x[3]) for x in tree(sc, "foo")] == [("bar", False), ("foo", True)]
    s = [sym("t", "target", "t.ts")] + [sym(f"k{i}", f"caller{i}", "t.ts", line=10 + i) for i in range(4)]
    sc = build(spark, s, [ref(i, f"k{i}", "t", "target", "t.ts") for i in range(4)], [])
    assert [x[0] for x in tree(sc, "t", breadth=2)] == ["k0", "k1"] and len(tree(sc, "t", nodes=3)) == 3
    s = [sym("m", "process", "m.ts", "method", cls="P"), sym("runner", "runner", "r.ts"), sym("driver", "driver", "d.ts")]
    r = [ref(1, "runner", None, "process", "r.ts", receiver="obj"), ref(2, "driver", None, "runner", "d.ts")]
    sc = build(spark, s, r, [bind("d.ts", "./r", "runner")])
    assert [(x[0], x[4]) for x in tree(sc, "m")] == [("runner", True)]
    assert [x[0] for x in tree(sc, "m", include_weak=True)] == ["runner", "driver"]


def test_caller_tree_model(spark):
    """Random resolved graphs against a plain breadth-first walk."""
    rnd = random.Random(11)
    for _ in range(3):
        n = 12
        s = [sym(f"s{i:02}", f"name{i}", "f.ts", line=i + 1) for i in range(n)]
        r = [ref(k, f"s{rnd.randrange(n):02}", f"s{rnd.randrange(n):02}", "x", "f.ts", line=k) for k in range(40)]
        callers = {}
        for x in r:
            if x[1] != x[2]:
                callers.setdefault(x[2], set()).add(x[1])
        want, queue = [], [("s00", ("s00",), 0, 1.0)]
        for node, path, d, conf in queue:
            for c in sorted(callers.get(node, ()))[:3] if d < 3 else ():
                if len(want) >= 20:
                    break
                cyc, cc = c in path, conf * 0.85
                grow = not cyc and cc >= 0.35
                want.append((c, d + 1, cyc, grow and d + 1 == 3))
                if grow:
                    queue.append((c, (*path, c), d + 1, cc))
        sc = build(spark, s, r, [])
        assert [(x[0], x[1], x[3], x[5]) for x in tree(sc, "s00", breadth=3, nodes=20)] == want


def test_risk(spark):
    f = spark.createDataFrame([("hub.ts", "typescript", 50), ("cold.ts", "typescript", 1), ("leaf.ts", "typescript", 50), ("none.ts", "typescript", None)], FILE)
    s = spark.createDataFrame([sym("h", "hubb", "hub.ts"), sym("c", "cold", "cold.ts"), sym("l", "leaf", "leaf.ts")], SYM)
    rows = graph.risk_hotspots(f, s, spark.createDataFrame([("h", 5), ("c", 5)], "id string, callers long")).collect()
    assert [r.id for r in rows] == ["h", "c"]


def test_history(spark):
    ts = datetime(2024, 1, 1)
    rows = [(i, "r", ts + timedelta(hours=i), f) for i, f in enumerate([["a", "b"]] * 6 + [["a"]] * 4 + [["b"]] * 6 + [[f"x{k}" for k in range(31)]])]
    c = spark.createDataFrame(rows, "commit_ord long, repo string, ts timestamp, files array<string>").where(F.size("files") <= 30)
    p = history.cochange(c).collect()
    assert [(x.file_a, x.file_b, x.shared, x.conf_ab, x.conf_ba) for x in p] == [("a", "b", 6, 0.6, 0.5)] and p[0].last_seen == ts + timedelta(hours=5)
    assert {(x.file, x.pct) for x in history.partners(history.cochange(c), 20, 5).collect()} == {("a", 60), ("b", 50)}
    got = history.missing_partners(spark.createDataFrame([("a",)], "path string"), history.cochange(c)).collect()
    assert [(x.file, x.partner) for x in got] == [("a", "b")]
    assert history.window_of(c, ts + timedelta(hours=30), 1).count() == 10
    assert history.cochange(c.limit(0)).count() == 0


def test_maintenance(spark):
    kind = "path string, size long, last_modified double, language string, commit_frequency int"
    old = spark.createDataFrame([("a", 1, 1.0, "go", 3), ("b", 1, 1.0, "go", 4), ("c", 1, 1.0, None, None)], kind)
    new = spark.createDataFrame([("a", 2, 1.0, "go", None), ("c", 1, 1.0, None, None), ("d", 1, 1.0, "go", None)], kind)
    assert {r.path: r.change for r in maintain.index_diff(old, new).collect()} == {"a": "changed", "b": "deleted", "c": "same", "d": "new"}
    assert {r.path: r.change for r in maintain.index_diff(old, new, complete=False).collect()}["b"] == "same"
    assert {r.path: (r.size, r.commit_frequency) for r in maintain.upsert_files(old, new).collect()} == {"a": (2, 3), "b": (1, 4), "c": (1, None), "d": (1, None)}
    meta = spark.createDataFrame([("h1", 180, 1000)], "head string, window_days int, analyzed_at long")
    assert [maintain.stale_analysis(meta, *x).first().reason for x in (("h1", 180, 1001), ("h2", 180, 1001), ("h1", 90, 1001), ("h1", 180, 10**9))] == [None, "head moved", "window changed", "too old"]


def test_globs_and_scopes(spark):
    paths = ["node_modules/a.js", "x/node_modules/b.js", "src/a.min.js", "src/a.js", "a/generated/b.ts", "generated/b.ts", "lib/q/tiny.c", "lib/q/r/tiny.c", ".hid/x.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path for r in df.where(~lookup.excluded(F.col("path"), ["node_modules", "*.min.js", "**/generated/**", "lib/*/tiny*", ".h?d"])).collect()}
    assert got == {"src/a.js", "lib/q/r/tiny.c", ".hid/x.py"}
    assert lookup.normalize_path("a/../b") == "b" and lookup.normalize_path("../b") is None
    head = spark.createDataFrame([("a.h", "int x;\n"), ("b.h", "#import <A.h>\n"), ("c.m", ""), ("d.H", "@class X;")], "p string, t string")
    assert [r[0] for r in head.select(lookup.refine_header(lookup.detect_language(F.col("p")), F.col("p"), F.col("t"))).collect()] == ["cpp", "objc", "objc", "objc"]


def test_notes(spark, tmp_path):
    store = notes.NoteStore(spark, str(tmp_path / "notes"))
    assert store.read() is None and not store.forget("x")
    a = store.remember("Keep the lock while writing.", [{"file": "a.ts", "symbol": "save", "file_hash": "h1", "signature": "save()"}], "2024-01-01")
    b = store.remember("Other", [], "2024-01-02")
    with pytest.raises(ValueError):
        store.remember("x" * 4001, [], "2024-01-03")
    anchors = store.read().select(F.col("id").alias("note_id"), F.explode("anchors").alias("a")).select("note_id", "a.*")

    def verdict(file_hash, symbols):
        f = spark.createDataFrame([("a.ts", file_hash)] if file_hash else [], "path string, content_hash string")
        v = notes.anchor_verdicts(anchors, f, spark.createDataFrame([("a.ts", n, s) for n, s in symbols], "file string, name string, signature string"))
        r = v.first()
        return r.verdict, r.detail, {x.id: x.verdict for x in notes.note_verdicts(store.read(), v).collect()}[b]

    assert verdict("h1", [("save", "save()")]) == ("fresh", None, "unverified")
    assert verdict("h2", [("save", "save()")])[:2] == ("stale", "signature intact")
    assert verdict("h2", [("save", "save(x)")])[:2] == ("stale", "signature changed")
    assert verdict("h2", [("store", "store()")])[:2] == ("stale", "symbol renamed or removed")
    assert verdict(None, [])[0] == "missing"
    assert store.forget(a) and [r.id for r in store.read().collect()] == [b]


def test_patterns():
    src = "foo(a, b.c(d)); foo(x); let q = foo(1, [2, 3]); // foo(7, 8)\nif (y == y) {} if (y == z) {}"
    toks = search.tokens_of(src)
    at = lambda p: [src[toks[i][1] :][:6] for i in search.match_pattern(toks, search.compile_pattern(p))]
    assert at("foo($A)") == ["foo(x)"] and at("foo($A, $B)") == ["foo(a,", "foo(1,"] and len(at("foo($$$)")) == 3 and at("$A == $A") == ["y == y"]
    with pytest.raises(ValueError):
        search.compile_pattern("foo(")
    with pytest.raises(ValueError):
        search.languages_of("cobol")


def test_search_order(spark):
    s = spark.createDataFrame([sym("a", "parseTree", "a.ts"), sym("b", "other", "parse/x.ts", exported=False), sym("c", "parseTree", "c.ts", exported=False), (*sym("d", "unrelated", "d.ts")[:8], "calls parse at once", True, "go", None, None)], SYM)
    rows = search.search_symbols(s, ["parse"]).collect()
    assert rows[0].id == "a" and rows[0].total == 4 and [r.id for r in rows].index("a") < [r.id for r in rows].index("c")
    assert [r.id for r in search.search_symbols(s, ["parse"], languages=["go"]).collect()] == ["d"]
    assert search.search_symbols(s.limit(0), ["parse"]).count() == 0
    assert [r.id for r in search.suggest(s, "parsetre").collect()] == ["a", "c"]


def test_budget(spark):
    df = spark.createDataFrame([("g", i, "x" * n) for i, n in enumerate([40, 400, 8, 4])] + [("h", 0, "y" * 9000), ("h", 1, "")], "g string, o int, t string")
    rows = {(r.g, r.o) for r in search.within_budget(df, ["g"], ["o"], "t", budget=20).collect()}
    assert rows == {("g", 0), ("h", 0)}


def test_innermost(spark):
    spans = spark.createDataFrame([("f", "out", 1, 20), ("f", "in", 5, 9), ("f", "far", 40, 50)], "file string, id string, start_line int, end_line int")
    sites = spark.createDataFrame([(1, "f", 6), (2, "f", 12), (3, "f", 30), (4, "g", 1)], "k int, file string, line int")
    assert {r.k: r.span_id for r in lookup.innermost(sites, spans, ["k"]).collect()} == {1: "in", 2: "out"}
    assert {r.k: r.span_id for r in lookup.innermost(sites, spans, ["k"], nearest=True).collect()} == {1: "in", 2: "out", 3: "far"}


def test_edge_reports_cover_all_symbols(spark, monkeypatch):
    """All symbols, short names and a hot one included, against the edges of every pair; reference ranks with more than 20 and own calls."""
    from codestrata.plans import call_queries as q

    rnd = random.Random(5)
    names, dirs = ["resolve", "save", "open", "loadEverything"], ["", "p", "p/a", "p/b", "q"]
    files = [(f"{x}/f{k}.{e}".lstrip("/"), {"ts": "typescript", "go": "go", "py": "python"}[e]) for x in dirs for k, e in ((0, "ts"), (1, "ts"), (2, "go"), (3, "go"), (4, "py"))]
    s = [sym(f"s{i:03}", rnd.choice(names), f[0], rnd.choice(["function", "method", "type", "class"]), rnd.random() < 0.6, rnd.choice([None, "C"]), i, f[1]) for i in range(90) for f in [rnd.choice(files)]]
    b = [bind(f, rnd.choice(["./f0", "./f1", "../f0", "lib", ".f4"]), *rnd.choice([("resolve", None, "value"), ("save", "stow", "value"), ("*", None, "value"), ("*", "ns", "namespace"), ("open", None, "value")]), line=k) for f, _ in files for k in range(rnd.randrange(3))]
    r = []
    for i in range(700):
        own = rnd.choice(s)
        f = own[4] if rnd.random() < 0.6 else rnd.choice(files)[0]
        inside = [x for x in s if x[4] == f]
        hit = rnd.choice(inside)[0] if inside and rnd.random() < 0.1 else None
        r.append(ref(i, own[0] if f == own[4] else None, hit, rnd.choice(["resolve", "resolve", "save", "stow", "open", own[1]]), f, rnd.randrange(50), rnd.choice([None, "ns", "o", "()"])))
    r += [ref(1000 + i, s[0][0], None, s[0][1], s[0][4], 0, "o") for i in range(60)]
    sc = build(spark, s, r, b, files)
    monkeypatch.setattr(q, "scoped", lambda *_: sc)
    edges = sc.edges(sc.symbols).cache()
    caller = F.coalesce("source_id", F.concat(F.lit("m:"), "file"))
    per = edges.groupBy("id", caller.alias("c")).agg(F.max("file").alias("file"), F.max(graph.strength_rank(F.col("strength"))).alias("k"))
    want = {
        q.edge_strength_tiers: edges.groupBy("id", "strength").agg(F.count("*"), F.count_distinct("file")),
        q.distinct_callers: per.groupBy("id").agg(F.count("*"), F.count_distinct("file"), *[F.count_if(F.expr(x)) for x in ("k = 3", "k in (1, 2)", "k = 0")]),
        q.caller_groups: graph.group_callers(edges),
        q.reference_ranks: graph.rank_references(edges, sc.symbols),
    }
    assert edges.groupBy("id").count().where("count > 30").count() > 20
    for query, rows in want.items():
        assert sorted(map(tuple, query(spark, "").collect())) == sorted(map(tuple, rows.collect())), query.__name__
    assert {"resolve", "save"} <= {x.name for x in q.distinct_callers(spark, "").join(sc.symbols, "id").collect()}


def test_caller_groups_of_a_hot_name_are_not_shuffled(spark, monkeypatch):
    """A name that many files call and many define: its rows are a product, made behind the last exchange; names split into parts and pairs left out."""
    from codestrata.plans import call_queries as q

    s = [sym(f"d{i}", "resolve", f"p{i % 7}/f{i}.ts") for i in range(40)] + [sym("only", "openOnce", "p0/f0.ts")] + [sym(f"x{i}", "closeAll", f"x/f{i}.ts") for i in range(9)]
    r = [ref(i, f"d{i % 40}" if i % 3 else None, None, "resolve", f"p{i % 40 % 7}/f{i % 40}.ts", i, "o") for i in range(120)] + [ref(200 + i, None, None, "closeAll", "p1/f1.ts", i) for i in range(3)] + [ref(300, None, None, "openOnce", "p1/f1.ts")]
    b = [bind("p1/f1.ts", "../p2/f2", "resolve"), bind("p1/f1.ts", "lib", "closeAll", line=2), bind("p1/f1.ts", "lib", "openOnce", line=3), bind("p3/f3.ts", "../p2/f2", "*", "o", "namespace"), bind("p3/f3.ts", "lib", "other", line=4)]
    sc = build(spark, s, r, b)
    monkeypatch.setattr(q, "scoped", lambda *_: sc)
    want = sorted(map(tuple, graph.group_callers(sc.edges(sc.symbols)).collect()))
    df = q.caller_groups(spark, "")
    assert sorted(map(tuple, df.collect())) == want and len(want) > 1500
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and "hashpartitioning(id#" not in plan.split("HashAggregate")[0]
    g = sc.split().general.groupBy("cls", "name", "file", F.coalesce("source_id", F.concat(F.lit("m:"), "file")).alias("caller")).agg(F.count("*").alias("sites"))
    rows = [sorted(map(tuple, sc.split().meet(g, some, most).select("id", "caller", "sites").collect())) for some, most in ((1, 1), (20, 3), (20, 50), (10**9, 1))]
    assert rows[0] == rows[1] == rows[2] == rows[3] and len(rows[0]) > 1000


def test_impact_is_by_name(spark, monkeypatch):
    """Callers in other files and at module level count; weak edges are callers but are not walked."""
    from codestrata.plans import call_queries as q

    s = [sym("gamma", "gamma", "c.ts"), sym("beta", "beta", "b.ts"), sym("alpha", "alpha", "a.ts"), sym("weak", "weakly", "w.ts"), sym("far", "faraway", "v.ts"), sym("in1", "inner", "c.ts")]
    r = [ref(1, "beta", None, "gamma", "b.ts"), ref(2, "alpha", None, "beta", "a.ts"), ref(3, None, None, "gamma", "m.ts"), ref(4, "weak", None, "gamma", "w.ts", receiver="o"), ref(5, "far", None, "weakly", "v.ts"), ref(6, "in1", "gamma", "gamma", "c.ts"), ref(7, "gamma", None, "beta", "c.ts")]
    b = [bind("b.ts", "./c", "gamma"), bind("m.ts", "./c", "gamma"), bind("a.ts", "./b", "beta"), bind("c.ts", "./b", "beta"), bind("v.ts", "./w", "weakly")]
    sc = build(spark, s, r, b)
    monkeypatch.setattr(q, "scoped", lambda *_: sc)
    # gamma: beta, m.ts, weak and in1 call it; over beta also alpha and gamma itself; far only over a weak edge.
    assert {x.id: (x.callers, x.files, x.depths) for x in q.blast_radius_depth2(spark, "").collect()} == {"gamma": (6, 5, 2), "beta": (6, 5, 2), "weak": (1, 1, 1)}
    assert {(x.id, x.depth): x.callers for x in q.impact_by_hop(spark, "").collect()} == {("gamma", 1): 4, ("gamma", 2): 2, ("beta", 1): 2, ("beta", 2): 4, ("weak", 1): 1}


@pytest.fixture(scope="module")
def hot(spark):
    """Calls of a few names by many files, some imported from a library, so that they lead on to all symbols of a name; (scoped, callers by symbol and hop)."""
    rnd = random.Random(11)
    names = ["resolve", "save", "loadEverything", "own"]
    files = [f"{d}/f{k}.ts" for d in ("p", "q", "q/r") for k in range(7)]
    s = [sym(f"s{i:03}", rnd.choice(names), rnd.choice(files), rnd.choice(["function", "function", "method", "class"]), rnd.random() < 0.7, line=i) for i in range(150)]
    b = [bind(f, rnd.choice(["./f0", "../p/f1", "lib", "lib"]), *rnd.choice([("resolve", None, "value"), ("save", "stow", "value"), ("*", None, "value"), ("*", "ns", "namespace"), ("loadEverything", None, "value")]), line=k) for f in files for k in range(rnd.randrange(3))]
    r = []
    for i in range(500):
        f = rnd.choice(files)
        inside = [x[0] for x in s if x[4] == f]
        r.append(ref(i, rnd.choice([None, *inside]), rnd.choice(inside) if inside and rnd.random() < 0.1 else None, rnd.choice([*names, "stow"]), f, i, rnd.choice([None, None, "ns", "o"])))
    sc = build(spark, s, r, b, [(f, "typescript") for f in files])
    one, walked = {}, {}
    for e in sc.edges(sc.symbols).collect():
        c = (e.source_id or "m:" + e.file, e.file)
        one.setdefault(e.id, set()).add(c)
        if e.strength in ("resolved", "import-connected"):
            walked.setdefault(e.id, set()).add(c[0])
    return sc, {i: (c, set().union(*[one.get(m, set()) for m in walked.get(i, ())]) - c) for i, c in one.items()}


def kept_rows(monkeypatch):
    """The numbers of rows of all tables that are kept on the way."""
    from codestrata.operators import hops

    rows = []

    def noted(keep, *dfs):
        out = keep(*dfs)
        rows.extend(x.count() for x in (out if isinstance(out, list) else [out]))
        return out

    for module in (graph, hops):
        for name in ("cut", "store", "store_all"):
            if keep := getattr(module, name, None):
                monkeypatch.setattr(module, name, lambda *dfs, keep=keep: noted(keep, *dfs))
    return rows


def test_blast_radius_of_hot_names_is_counted_without_their_product(spark, hot, monkeypatch):
    """No table on the way has a row per symbol and caller; counts of several blocks of callers and symbols add up."""
    from codestrata.operators import hops
    from codestrata.plans import call_queries as q

    sc, want = hot
    monkeypatch.setattr(q, "scoped", lambda *_: sc)
    counts = sorted((i, len(a | b), len({f for _, f in a | b}), 1 + bool(b)) for i, (a, b) in want.items())
    sc.split()
    rows = kept_rows(monkeypatch)
    assert sorted(map(tuple, q.blast_radius_depth2(spark, "").collect())) == counts
    assert sum(x[1] for x in counts) > 4 * max(rows) and sum(x[3] == 2 for x in counts) > 50
    for block in (40, 150, 10**7):
        monkeypatch.setattr(hops, "BLOCK", block)
        assert sorted(map(tuple, q.blast_radius_depth2(spark, "").collect())) == counts


def test_impact_of_hot_names_is_counted_without_their_product(spark, hot, monkeypatch):
    from codestrata.plans import call_queries as q

    sc, want = hot
    monkeypatch.setattr(q, "scoped", lambda *_: sc)
    counts = sorted((i, k, len(c)) for i, by in want.items() for k, c in enumerate(by, 1) if c)
    sc.split()
    rows = kept_rows(monkeypatch)
    assert sorted(map(tuple, q.impact_by_hop(spark, "").collect())) == counts
    assert sum(x[2] for x in counts) > 4 * max(rows)


def test_search_matches_prefix_and_near_terms(spark):
    s = spark.createDataFrame([sym("eq", "leaseHolder", "a.ts"), sym("pre", "leasesOpen", "b.ts"), sym("near", "leaveNow", "c.ts"), sym("far", "learner", "d.ts"), sym("nl", "größeÄndern", "e.ts"), sym("fq", "other", "resolver/x.ts"), sym("nt", "mustResolve", "f.ts")], SYM)
    rows = search.search_symbols(s, ["lease"]).collect()
    assert {r.id for r in rows} == {"eq", "pre", "near"} and rows[0].id == "eq" and rows[0].total == 3
    assert [r.id for r in search.search_symbols(s, ["größe"]).collect()] == ["nl"]
    assert [r.id for r in search.suggest(s, "resolv").collect()] == ["nt", "fq"]
