import os
import subprocess
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codestrata.operators import extract, history
from codestrata.sources import git, scan, store
from codestrata.streaming import debounce, refresh, watch


def test_scan(spark, tmp_path):
    for p, t in {"a.ts": "let a", "src/b.py": "x = 1", "src/deep/c.go": "package c", "node_modules/x.js": "no", "bin.dat": "a\0b", "read me.md": "text", "h.h": "@class X;"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    (tmp_path / "big.ts").write_text("x" * 3000)
    rows = scan.scan(spark, str(tmp_path), scan.Config(max_bytes=2000)).collect()
    got = {r.path: r.language for r in rows}
    assert got == {"a.ts": "typescript", "src/b.py": "python", "src/deep/c.go": "go", "read me.md": "unknown", "h.h": "objc"}
    assert next(r for r in rows if r.path == "src/b.py").content == "x = 1"
    assert {r.path for r in scan.scan(spark, str(tmp_path), scan.Config(max_files=2)).collect()} == {"a.ts", "big.ts"}
    (tmp_path / "link.ts").symlink_to(tmp_path / "a.ts")
    (tmp_path / "loop").symlink_to(tmp_path / "src")
    found, complete = scan.listing(spark, str(tmp_path), scan.Config(max_bytes=2000))
    assert complete and {r.path for r in found.collect()} == {"a.ts", "src/b.py", "src/deep/c.go", "read me.md", "h.h", "bin.dat"}
    (tmp_path / "shut").mkdir(mode=0o000)
    if os.getuid():
        assert not scan.listing(spark, str(tmp_path))[1]
    (tmp_path / "shut").chmod(0o700)
    assert scan.read_text(str(tmp_path), "a.ts") == "let a" and scan.read_text(str(tmp_path), "../x") is None and scan.read_text(str(tmp_path), "big.ts", 10) is None


def test_config(tmp_path):
    (tmp_path / ".codestrata").mkdir()
    (tmp_path / ".codestrata/config.json").write_text('{"max_files": 5, "exclude": ["a"], "max_bytes": "bad"}')
    c = scan.load_config(str(tmp_path), {"CODESTRATA_MAX_FILES": "7"}, {"git_window_days": -1})
    assert (c.max_files, c.exclude, c.max_bytes, c.git_window_days) == (7, ("a",), 1_048_576, 180)
    (tmp_path / ".codestrata/config.json").write_text("[")
    assert scan.load_config(str(tmp_path), {}) == scan.Config()
    assert scan.package_entries('{"main": "./a.js", "bin": {"x": "b.js"}, "exports": {".": {"types": "t.d.ts", "import": "./c.js"}, "./*": "./d/*.js"}}') == ["a.js", "b.js", "c.js"]
    assert scan.package_entries("[") == []


def test_git(spark, tmp_path):
    env = {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@x", "HOME": str(tmp_path), "PATH": "/usr/bin:/bin"}

    def do(*args, at=None):
        e = env | ({"GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at} if at else {})
        subprocess.run(["git", *args], cwd=tmp_path, env=e, check=True, capture_output=True)

    do("init", "-q", "-b", "main")
    for i in range(6):
        (tmp_path / "utils.ts").write_text(str(i))
        if i:
            (tmp_path / "auth.ts").write_text(str(i))
        do("add", "-A")
        do("commit", "-q", "-m", f"c{i}", at=f"2024-01-01T0{i}:00:00 +0000")
    c = git.log(spark, str(tmp_path), "r", now=datetime(2024, 2, 1))
    assert {r.path: r.commits for r in history.commit_counts(c).collect()} == {"utils.ts": 6, "auth.ts": 5}
    p = history.cochange(c).first()
    assert (p.file_a, p.shared, p.conf_ab) == ("auth.ts", 5, 1.0) and p.last_seen == datetime(2024, 1, 1, 5)
    assert git.log(spark, str(tmp_path), "r", cap=2, now=datetime(2024, 2, 1)).count() == 2
    (tmp_path / "new é.ts").write_text("x")
    do("mv", "auth.ts", "login.ts")
    assert {(r.path, r.status, r.orig_path) for r in git.working_set(spark, str(tmp_path)).collect()} == {("new é.ts", "untracked", None), ("login.ts", "renamed", "auth.ts")}
    b = git.branch_summary(str(tmp_path))
    assert b == {"branch": "main", "default": "main", "ahead": 0, "changed": 2} and git.head(str(tmp_path))
    assert [x[2] for x in git.recent_commits(str(tmp_path), "utils.ts", 2)] == ["c5", "c4"]
    assert git.head("/") is None and not git.safe_ref("--x") and not git.safe_ref("a..b") and git.safe_ref("origin/main~1")
    with pytest.raises(git.GitError):
        git.run("/", "log")
    with pytest.raises(ValueError):
        git.working_set(spark, str(tmp_path), "--output=x")


def test_log_text():
    got = git.parse_log("\x00300\na\nb\n\n\x00200\r\na\r\n\n\x00bad\nx\n\n\x00100\n")
    assert [(int(t.timestamp()), f) for _, t, f in got] == [(300, ["a", "b"]), (200, ["a"]), (100, [])]


def test_index_store(spark, tmp_path):
    s = store.IndexStore(spark, str(tmp_path / "i"), "p")
    assert s.load("files") is None
    s.save({"files": spark.createDataFrame([("b",), ("a",)], "path string")})
    s.save({"files": spark.createDataFrame([("c",)], "path string")})
    assert [r.path for r in s.load("files").collect()] == ["c"] and store.IndexStore(spark, str(tmp_path / "i"), "q").load("files") is None


def test_extract(spark):
    t = spark.createDataFrame([("a.py", "def f():\n    return g()\n", 1), ("b.txt", "x", 1), ("c.ts", None, 1), (None, "x", 1), ("d.go", "", 1)], "path string, content string, language int")
    o = extract.outlines(t).cache()
    assert {(r.file, r.name, r.kind) for r in extract.symbols_of(o).collect()} == {("a.py", "f", "function")}
    c = extract.calls_of(o).collect()
    assert [(r.file, r.target_name) for r in c] == [("a.py", "g")] and c[0].source_id == extract.symbols_of(o).first().id
    assert extract.imports_of(o).count() == 0 and extract.outlines(t.limit(0)).count() == 0


def fold(events, gap, most):
    out = []
    for t, k in sorted(events):
        if out and t - out[-1][1] <= gap and t - out[-1][0] <= most:
            out[-1][1], out[-1][2] = t, out[-1][2] + 1
            out[-1][3].add(k)
        else:
            out.append([t, t, 1, {k}])
    return {(a, b, n, len(k)) for a, b, n, k in out}


def _events(seed):
    import random

    r, t, rows = random.Random(seed), 0.0, []
    for i in range(120):
        t += r.choice([0.25, 0.5, 1.0, 3.0])
        rows.append((i % 2, t, r.choice("abc")))
    return rows


def test_debounce_batch(spark):
    base, rows = datetime(2024, 1, 1), _events(1)
    df = spark.createDataFrame([(g, base + timedelta(seconds=t), k, i) for i, (g, t, k) in enumerate(rows)] + [(7, None, "a", 999)], "g int, ts timestamp, k string, event_id int")
    got = {}
    for x in debounce.deadline_batches(df, "g", "ts", "k", 1.5, 4.0).collect():
        sec = lambda d: round((d - base).total_seconds(), 3)
        got.setdefault(x.g, set()).add((sec(x.first_ts), sec(x.last_ts), x.events, x.keys))
    # a deadline is measured inside a quiet run, so the fold restarts at each gap
    for g in (0, 1):
        assert got[g] == {(round(a, 3), round(b, 3), n, k) for a, b, n, k in fold([(t, k) for h, t, k in rows if h == g], 1.5, 4.0)}
    assert debounce.deadline_batches(df.limit(0), "g", "ts", "k", 1.5, 4.0).count() == 0


def test_debounce_stream(spark, tmp_path):
    base, rows = datetime(2024, 1, 1), _events(2)
    src = tmp_path / "in"
    end = [(g, rows[-1][1] + 100, "z") for g in (0, 1)] + [(9, rows[-1][1] + 300, "z")]
    for i, part in enumerate([rows[:50], rows[50:], end[:2], end[2:]]):
        spark.createDataFrame([(g, base + timedelta(seconds=t), k) for g, t, k in part], "g int, ts timestamp, k string").coalesce(1).write.mode("append").parquet(str(src / f"p{i}"))
    stream = spark.readStream.schema("g int, ts timestamp, k string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src)).withWatermark("ts", "1 second")
    q = debounce.debounce_stream(stream, "g", "ts", "k", 1.5, 4.0).writeStream.format("memory").queryName("deb").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    zero = int(base.timestamp() * 1000)
    for g in (0, 1):
        got = {((r.first_ms - zero) / 1000, (r.last_ms - zero) / 1000, r.events, r.keys) for r in spark.sql(f"select * from deb where grp = {g}").collect()}
        want = {(round(a, 3), round(b, 3), n, k) for a, b, n, k in fold([(t, k) for h, t, k in rows if h == g], 1.5, 4.0)}
        assert {(round(a, 3), round(b, 3), n, k) for a, b, n, k in got} - {(end[g][1], end[g][1], 1, 1)} == want


def test_refresh_stream(spark, tmp_path):
    kind = "path string, content_hash string, commit_frequency int"
    state = {"t": spark.createDataFrame([("a", "h1", 3), ("b", "h2", 4)], kind), "n": []}
    ev = "path string, ts timestamp, seq int, deleted boolean, content_hash string, commit_frequency int"
    t = datetime(2024, 1, 1)
    rows = [("a", t, 1, False, "h9", None), ("a", t, 2, False, "h3", None), ("b", t, 1, True, None, None), ("c", t, 1, False, "h5", None), ("d", t, 1, True, None, None), ("d", t, 2, False, "h6", None)]
    spark.createDataFrame(rows, ev).coalesce(1).write.parquet(str(tmp_path / "e"))

    def write(df, number):
        got = df.collect()
        state["t"] = spark.createDataFrame(got, kind)
        state["n"].append(number)

    refresh.start(spark, spark.readStream.schema(ev).parquet(str(tmp_path / "e")), lambda: state["t"], write, str(tmp_path / "cp")).awaitTermination(60)
    assert {tuple(r) for r in state["t"].collect()} == {("a", "h3", 3), ("c", "h5", None), ("d", "h6", None)} and state["n"] == [0]
    echo = spark.createDataFrame([("a", t, 5, False, "h3", None)], ev)
    assert {tuple(r) for r in refresh.apply_batch(state["t"], echo).collect()} == {tuple(r) for r in state["t"].collect()}
    assert state["t"].where(F.col("path") == "b").count() == 0


def _tables(index):
    return {t: {tuple(str(v) for k, v in sorted(r.asDict().items()) if k not in ("last_indexed", "last_modified")) for r in index.read(t).collect()} for t in index.TABLES}


def test_live_index_like_a_rebuild(spark, tmp_path):
    """A stream that sees files made, edited, renamed and deleted ends with the tables of a rebuild; a batch applied twice changes nothing."""
    root = tmp_path / "src"
    (root / "p/node_modules").mkdir(parents=True)
    write = lambda p, t: (root / p).write_text(t)
    write("p/a.py", "def one():\n    return two()\n\ndef two():\n    return 2\n")
    write("p/b.ts", "import { x } from './c';\nexport class A { run() { return this.stop(); } stop() { return x(); } }\n")
    write("p/c.go", "package c\n\nfunc Old() { len(nil); Old() }\n")
    write("p/node_modules/d.js", "function no() {}\n")
    index = refresh.LiveIndex(spark, str(tmp_path / "live"), buckets=4)

    def settles(want):
        """Waits for the watching query to index ``want``."""
        end = time.time() + 120
        while time.time() < end:
            try:
                if {r.path: r.size for r in index.read("files").collect()} == {p: (root / p).stat().st_size for p in want}:
                    return True
            except Exception:  # the table is being replaced or not there yet
                pass
            time.sleep(0.5)
        return False

    query = watch.start(spark, str(root), index, str(tmp_path / "cp"))
    assert settles({"p/a.py", "p/b.ts", "p/c.go"})
    assert {r.path for r in index.read("files").collect()} == {"p/a.py", "p/b.ts", "p/c.go"}
    refs = {(r.file, r.target_name): r.target_id for r in index.read("refs").collect()}
    assert refs["p/a.py", "two"] and refs["p/b.ts", "stop"] and refs["p/c.go", "Old"] and ("p/c.go", "len") not in refs
    time.sleep(1.1)  # file times count in seconds on some systems
    write("p/a.py", "def one():\n    return three()\n\ndef three():\n    return 3\n")
    (root / "p/c.go").rename(root / "p/moved.go")
    os.utime(root / "p/moved.go")
    (root / "p/b.ts").unlink()
    assert settles({"p/a.py", "p/moved.go"}) and watch.shutdown(query, seconds=15) in (True, False) and not query.isActive
    fresh = refresh.LiveIndex(spark, str(tmp_path / "fresh"), buckets=7)
    events = watch.changes(spark, str(root), fresh)
    assert {r.outcome for r in fresh.apply(events).collect()} == {"new"}
    assert _tables(index) == _tables(fresh)
    assert watch.changes(spark, str(root), fresh).count() == 0
    assert {r.outcome for r in fresh.apply(events).collect()} <= {"echo"} and _tables(index) == _tables(fresh)


def test_outcomes(spark, tmp_path):
    index = refresh.LiveIndex(spark, str(tmp_path / "x"), buckets=2, max_bytes=50)
    t = datetime(2024, 1, 1)
    ev = lambda *rows: spark.createDataFrame([(p, t + timedelta(seconds=s), q, gone, c, len(c or ""), 1.0) for p, s, q, gone, c in rows], refresh.EVENT)
    got = lambda b: {r.path: r.outcome for r in index.apply(b).collect()}
    assert got(ev(("a.py", 0, 0, False, "x = 1\n"), ("b.py", 0, 0, False, None), ("c.py", 0, 0, False, "y" * 60), ("d.py", 0, 0, True, None))) == {"a.py": "new", "b.py": "unread", "c.py": "too large", "d.py": "deleted"}
    assert got(ev(("a.py", 1, 0, True, None), ("a.py", 2, 0, False, "x = 1\n"))) == {"a.py": "echo"}
    assert got(ev(("a.py", 3, 0, False, "x = 2\n"))) == {"a.py": "changed"} and index.read("files").count() == 1
    assert got(ev(("a.py", 4, 0, True, None))) == {"a.py": "deleted"} and index.read("files").count() == 0


def test_watch_helpers(spark, tmp_path):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert watch.with_retries(flaky, wait=0) == "ok" and len(calls) == 3
    with pytest.raises(OSError):
        watch.with_retries(lambda: (_ for _ in ()).throw(OSError()), attempts=2, wait=0)
    g = watch.Generation(size=2)
    assert [g.get(k, lambda k=k: k * 2) for k in (1, 2, 3)] == [2, 4, 6] and g.get(3, lambda: "new") == 6 and g.get(1, lambda: "made again") == "made again"
    g.advance()
    assert g.get(3, lambda: "fresh") == "fresh"
    q = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    assert watch.shutdown(q, seconds=0.0) in (True, False) and not q.isActive
