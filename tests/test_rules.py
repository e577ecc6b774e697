"""Call rules per language, anchors, scopes, notes of a context, and twins on a fixture where the test tables have no rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from codestrata.functions import expressions as X
from codestrata.operators import extract, graph, lookup, maintain, notes, rules
from codestrata.plans import catalog
from tests.test_operators import REF, SYM, bind, build, ref, sym


def test_rules_by_language(spark):
    s = [
        sym("jm", "run", "A.java", "method", cls="A", language="java"), sym("jm2", "stop", "A.java", "method", cls="A", language="java"), sym("jc", "Box", "A.java", "class", language="java"), sym("jf", "helper", "A.java", "function", language="java"),
        sym("gf", "len", "m.go", language="go"), sym("gt", "Pair", "n.go", "type", language="go"), sym("pf1", "f", "x.php", language="php"), sym("pf2", "f", "x.php", line=9, language="php"),
        sym("t1", "Twin", "B.java", "class", language="java"), sym("t2", "Twin", "B.java", "class", line=9, language="java"), sym("tm", "go", "B.java", "method", cls="Twin", language="java"),
        sym("tf", "save", "t.ts"), sym("tv", "save", "t.ts", "method", cls="C"),
    ]
    rows = [
        (1, "jm", "stop", "A.java", None, None, False, "jm2"),  # implicit self
        (2, "jm", "helper", "A.java", None, None, False, None),  # no bare functions in Java
        (3, "jm", "Box", "A.java", None, None, True, "jc"), (4, None, "stop", "A.java", "A", None, False, "jm2"), (5, "jm", "stop", "A.java", "this", True, False, "jm2"),
        (6, None, "len", "m.go", None, None, False, "gf"), (7, None, "len", "n.go", None, None, False, "dropped"), (8, None, "Pair", "n.go", None, None, True, "gt"), (9, None, "other", "n.go", None, None, False, None),
        (10, None, "f", "x.php", None, None, False, None),  # two functions of that name
        (11, None, "go", "B.java", "Twin", None, False, None), (12, None, "Twin", "B.java", None, None, True, None),  # two types of that name
        (13, None, "save", "t.ts", None, None, False, "tf"), (14, "tv", "save", "t.ts", None, None, False, "tf"), (15, None, "save", "t.ts", "()", None, False, None), (16, None, "save", "gone.zz", None, None, None, None),
    ]
    calls = spark.createDataFrame([r[:7] + ("own",) for r in rows], "ref_id long, source_id string, target_name string, file string, receiver string, self_receiver boolean, is_new boolean, made_id string").drop("made_id")
    files = spark.createDataFrame(sorted({(x[4], x[10]) for x in s} | {("gone.zz", None)}, key=str), "path string, language string")
    got = {r.ref_id: r.resolved_id for r in rules.resolve_by_rules(calls, spark.createDataFrame(s, SYM), files).collect()}
    assert got == {r[0]: r[7] for r in rows if r[7] != "dropped"}
    assert rules.resolve_by_rules(calls.limit(0), spark.createDataFrame(s, SYM), files).count() == 0


def test_anchors_and_scopes(spark):
    cases = {
        "src/a.ts": ("src/a.ts", None, None), " src/a.ts:save ": ("src/a.ts", "save", None), "a.ts:C.save:12": ("a.ts", "C.save", 12), "a.ts:12": ("a.ts", None, 12), "a.ts:12:7": ("a.ts", None, 12), "a.ts:save:0": ("a.ts", "save", None),
        "C:\\p\\a.ts:Ns::T::m:3": ("C:\\p\\a.ts", "Ns::T::m", 3), "a.ts:": ("a.ts", None, None), "  ": (None, None, None), "": (None, None, None), "a.ts:0": ("a.ts", None, None), "a.ts:99999999999999": ("a.ts", None, None), "\u00a0a.ts:x\u00a0": ("a.ts", "x", None),
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "raw string").select("raw", *[c.alias(k) for k, c in lookup.parse_anchor(F.col("raw")).items()])
    assert {r.raw: (r.file, r.symbol, r.line) for r in df.collect()} == cases | {None: (None, None, None)}
    f = spark.createDataFrame([("pkg/api.v2/x.ts",), ("pkg/run",)], "path string")
    sc = spark.createDataFrame([("pkg/api.v2",), ("pkg/run",), ("pkg/",), ("",), (None,)], "scope string")
    assert {r.scope: r.normal for r in lookup.normalize_scope(sc, f).collect()} == {"pkg/api.v2": "pkg/api.v2/", "pkg/run": "pkg/run", "pkg/": "pkg/", "": None, None: None}
    lab = spark.createDataFrame([(1, 3, 4), (2, None, 4), (3, 3, None), (4, None, None)], "id int, a int, b int").select("id", X.complexity_label(F.col("a"), F.col("b")).alias("l"))
    assert {r.id: r.l for r in lab.collect()} == {1: "cyc 3 / cog 4", 2: "cog 4", 3: "cyc 3", 4: None}


def test_notes_shown(spark):
    n = spark.createDataFrame([(f"n{i}", "t", f"2024-01-0{i}") for i in range(1, 7)], "id string, text string, created_at string")
    a = spark.createDataFrame([("n1", "a.ts", "C.save"), ("n1", "a.ts", None), ("n2", "a.ts", "save"), ("n3", "a.ts", None), ("n4", "a.ts", None), ("n5", "a.ts", "load"), ("n6", "b.ts", None)], "note_id string, file string, symbol string")
    t = spark.createDataFrame([("s1", "a.ts", "save"), ("s2", "a.ts", None), ("s3", "c.ts", "x")], "target_id string, file string, name string")
    rows = notes.notes_of_context(n, a, t).orderBy("target_id", "place").collect()
    assert [(r.target_id, r.note_id, r.level, r.omitted) for r in rows] == [("s1", "n2", 0, 1), ("s1", "n1", 0, 1), ("s1", "n4", 1, 1), ("s2", "n4", 1, 0), ("s2", "n3", 1, 0), ("s2", "n1", 1, 0)]
    v = spark.createDataFrame([("n1", "a.ts", "stale"), ("n1", "b.ts", "missing"), ("n2", "a.ts", "fresh"), ("n3", "a.ts", "stale"), ("n4", "c.ts", "stale")], "note_id string, file string, verdict string")
    got = {r.file: (r.suspects, r.suspects_in_all) for r in notes.suspect_notes(v, spark.createDataFrame([("a.ts",), ("b.ts",), ("a.ts",)], "path string")).collect()}
    assert got == {"a.ts": (2, 2), "b.ts": (1, 2)}


def test_store_tells_damaged_and_newer(spark, tmp_path):
    root = str(tmp_path / "notes")
    store = notes.NoteStore(spark, root)
    first = store.remember("One.", [], "2024-01-01")
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{root}/v2")
    assert [r.id for r in store.read().collect()] == [first] and store.versions() == [1]
    assert any(p.name.startswith(".bad-v2-") for p in (tmp_path / "notes").iterdir())
    store.read().withColumn("schema_version", F.lit(store.VERSION + 1)).write.parquet(f"{root}/v2")
    assert store.read_only() and store.read().count() == 1
    with pytest.raises(PermissionError):
        store.remember("Two.", [], "2024-01-02")


def test_blast_and_summary(spark):
    s = [sym("c", "gamma", "c.ts"), sym("b", "beta", "b.ts"), sym("a", "alpha", "a.ts"), sym("x", "other", "x.ts")]
    r = [ref(1, "b", None, "gamma", "b.ts"), ref(2, "a", None, "beta", "a.ts"), ref(3, None, None, "gamma", "x.ts"), ref(4, "x", None, "gamma", "x.ts", receiver="o")]
    sc = build(spark, s, r, [bind("b.ts", "./c", "gamma"), bind("a.ts", "./b", "beta"), bind("x.ts", "./c", "gamma")])
    got = graph.blast_of(sc, sc.symbols.where("id in ('c', 'a')").select("id")).collect()
    assert [(g.id, g.blast_callers, g.blast_files, g.blast_depth) for g in got] == [("c", 4, 3, 2)]
    t = graph.caller_summary(graph.caller_trees(sc, sc.symbols.where("id = 'c'").select("id"), depth=1)).first()
    assert (t.callers, t.files, t.depths, t.depth_capped, t.structural, t.name_match, t.weak_member) == (3, 2, 1, True, 0, 2, 1)


def test_cyclomatic_of_each_language(spark):
    bodies = [
        ("1", "a.py", "def f(a):\n    # if while for\n    s = 'if x and y'\n    if a and b or c:\n        for i in a: pass\n    return s\n", 5), ("2", "a.ts", "function f(a) {\n  const s = `if ${a ? 1 : 2}`; // if\n  if (a && b) { for (;;) {} }\n  return a ?? 'while';\n}\n", None),
        ("3", "a.go", "func f(a int) {\n\ts := `if for`\n\tif a > 1 || b {\n\t\tfor {\n\t\t}\n\t}\n\tswitch a {\n\tcase 1:\n\t}\n}\n", 5), ("4", "a.js", "function f() { return 1; }\n", None), ("5", "a.rs", "fn f(a: i32) { while a > 1 { if a == 2 {} } }\n", 3),
    ]
    df = spark.createDataFrame([b[:3] for b in bodies], "id string, file string, code string")
    got = {r.id: r.complexity for r in extract.complexities(df).collect()}
    assert {k: got[k] for k, *_ in bodies if k != "2"} == {b[0]: b[3] for b in bodies if b[0] != "2"} and got["2"] >= 5


def test_clear_history(spark):
    f = spark.createDataFrame([("a", 3), ("b", None)], "path string, commit_frequency int")
    assert {r.path: r.commit_frequency for r in maintain.clear_history(f).collect()} == {"a": None, "b": None}


def test_twins_with_rows(spark, tmp_path):
    """alias_join and export_callers_set have no rows in the small test tables: here they have."""
    s = [sym("s1", "save", "p/a.ts"), sym("s2", "load", "p/a.ts"), sym("s3", "save", "p/b.ts"), sym("u", "use", "p/u.ts")]
    r = [ref(1, "u", None, "store", "p/u.ts"), ref(2, "u", None, "load", "p/u.ts"), ref(3, None, None, "load", "p/v.ts"), ref(4, None, None, "save", "p/v.ts"), ref(5, None, None, "store", "p/v.ts")]
    n = lambda *xs: list(xs)
    imports = [("p/u.ts", "./a", 1, n(("save", "store", "value"), ("load", None, "value"))), ("p/v.ts", "./a", 1, n(("load", None, "value"))), ("p/v.ts", "@x/y", 2, n(("save", "store", None))), ("p/v.ts", "./b", 3, n(("save", None, "value")))]
    d = str(tmp_path)
    spark.createDataFrame(s, SYM).coalesce(1).write.parquet(f"{d}/symbols.parquet")
    spark.createDataFrame(r, REF).coalesce(1).write.parquet(f"{d}/symbol_refs.parquet")
    spark.createDataFrame(imports, "file string, source_module string, line int, imported_names array<struct<name string, alias string, kind string>>").coalesce(1).write.parquet(f"{d}/file_imports.parquet")
    files = [(p, "p", "typescript", 1, 1.0, 1, 1, "h", None) for p in ("p/a.ts", "p/b.ts", "p/u.ts", "p/v.ts")]
    spark.createDataFrame(files, "path string, repo string, language string, size long, last_modified double, last_indexed long, symbol_count int, content_hash string, commit_frequency int").coalesce(1).write.parquet(f"{d}/files.parquet")
    spark.createDataFrame([], "commit_ord long, repo string, ts timestamp, files array<string>, author string").coalesce(1).write.parquet(f"{d}/raw_commits.parquet")
    con = duckdb.connect()
    for t in ("symbols", "symbol_refs", "file_imports", "files", "raw_commits"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    for q in ("alias_join", "export_callers_set"):
        df = catalog.queries()[q](spark, d)
        cols = sorted(df.columns)
        got = sorted(map(str, (tuple(x[c] for c in cols) for x in df.collect())))
        assert got and got == sorted(map(str, con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[q]})").fetchall()))
