"""Problems 2 and 4 on small fixtures."""

import itertools
import random
from collections import Counter

import pytest

from codestrata.llm import docpairs as D
from codestrata.llm import provenance as P

SAYS = ["Clamps to 12 rows.", "/** Returns true once no lock has touched the scope. */", "* Idempotent; a second call does nothing.\r", "@returns the number of rows left after the merge", "@deprecated slow for large inputs, each call copies them", "按60毫秒合并重复的事件，保留最后一个",
        "TODO: drop this once upstream sends sorted rows; until then it sorts each batch", "Liest den Wert erneut, falls er unverändert ist.", "@param rows sorted by key, without repeats", "Not thread-safe: two callers may race."]
SILENT = [None, "", "  ​", "-----", "/** load rows */", "Loads the rows.", "loadRows()", "The load_rows function.", "Function loadRows", "TODO", "todo(dev3)", "FIXME add docs", "@todo describe", "n/a", "asdf", "noqa: E501", "eslint-disable-next-line", "@ts-ignore",
          "@param rows", ":rtype: str", "@returns", "@throws", "@param {string} rows the rows", "SPDX-License-Identifier: X-1.0", "Copyright 2020 The Authors", "(c) Some team", "#region Rows", "MARK: - Rows", "===== Rows =====", "return rows.get(key);", "if (rows == null) return;", "self.rows = None",
          "const a = rows + 1;", "{@inheritDoc}", "(non-Javadoc)", "TODO Auto-generated method stub", "Creates a new instance.", "Helper.", "Description", "utility method", "Parameters", "?"]


@pytest.mark.parametrize("doc", SAYS)
def test_says(doc):
    assert D.says_something(doc, "loadRows")


@pytest.mark.parametrize("doc", SILENT)
def test_silent(doc):
    assert not D.says_something(doc, "loadRows")


def test_assignment_is_optimal():
    r = random.Random(5)
    for _ in range(200):
        n, m = r.randint(1, 5), r.randint(1, 5)
        w = {(i, j): r.choice([0.5, 1.0, 2.0, 3.0]) + r.random() / 100 for i in range(n) for j in range(m) if r.random() < 0.6}
        got = D.max_assignment(w)
        assert len(set(got.values())) == len(got) and all(e in w for e in got.items())
        best = max(sum(w.get((i, j), 0) for i, j in enumerate(p) if j is not None) for p in itertools.permutations(list(range(m)) + [None] * n, n))
        assert abs(sum(w[e] for e in got.items()) - best) < 1e-9


def test_many_functions_at_one_place():
    """Damaged ranges: thousands of functions beside a few comments stay cheap, and every indexed description is kept."""
    text = "\n".join(f"// Waits for lock {i} to be free.\nfunction f{i}() {{}}" for i in range(30))
    funcs = [{"id": str(k), "name": f"g{k}", "fqn": None, "start_line": 1 + k % 60, "end_line": 60, "signature": "g()", "doc": "Waits for lock 3 to be free." if k % 3 == 0 else None} for k in range(3000)]
    out = D.link_file("a.js", text, funcs)
    assert {i for i, _, origin, _ in out if origin == "index"} == {k for k in range(3000) if k % 3 == 0}
    assert len([1 for x in out if x[2] == "text"]) <= 30


def test_pairs(spark):
    text = "/** Clamps to 12 entries. */\nfunction a(x) {\n}\n\n// Waits for the lock to be free.\n// @param q how long at most\nfunction b(q) {\n}\nfunction c() {}\n"
    rows = [("1", "a", "r/f.js", " Function ", 2, 3, "a(x)", "Clamps to 12 entries."), ("2", "b", "r/f.js", "METHOD", 7, 8, "b(q)", None), ("3", "c", "r/f.js", "function", 9, 9, "c()", "TODO"),
            ("4", "d", "r/none.js", "function", None, None, None, "Drops rows without a key."), ("5", "v", "r/f.js", "variable", 1, 1, "", "Keeps all open handles."), ("6", None, None, "method", 1, 2, None, "Sorts them by age, newest first."), (None, "x", "r/f.js", "method", 1, 2, None, "Sorts by age.")]
    rows.append(rows[0])
    s = spark.createDataFrame([(*x, f"{x[2]}:{x[1]}", "zz") for x in rows], "id string, name string, file string, kind string, start_line int, end_line int, signature string, doc string, fqn string, content string")
    t = spark.createDataFrame([("r/f.js", text), ("r/f.js", text), ("r/n.js", None), (None, "x")], "path string, content string")
    got = {x.id: x for x in D.doc_pairs(s, t).collect()}
    assert {k: v.origin for k, v in got.items()} == {"1": "index", "2": "text", "4": "index", "6": "index"}
    assert "Waits for the lock" in got["2"].description and got["2"].code.startswith("function b")
    assert D.doc_pairs(s.limit(0), t.limit(0)).count() == 0


def _funcs(*rows):
    return [{"id": str(k), "name": n, "fqn": None, "start_line": line, "end_line": line, "signature": sig, "doc": doc} for k, (n, line, sig, doc) in enumerate(rows)]


def test_indexed_descriptions_go_through_the_matching():
    stale = "Waits for the lock to be free.\n@param timeout how long at most"
    text = "// Waits for the lock to be free.\n// @param timeout how long at most\nfunction lock(q) {}\n\nfunction late(timeout) {}\n"
    rows = _funcs(("lock", 3, "lock(q)", stale), ("late", 5, "late(timeout)", "TODO"))
    origins = lambda t, fs: {(i, o) for i, _, o, _ in D.link_file("a.js", t, fs)}
    assert origins(text, rows) == {(0, "index")}  # the text has it right above: accepted though its tags are stale
    assert origins(None, rows) == set()  # without the text nothing speaks for it: implausible
    other = text.replace("function lock(q) {}", "function other(timeout) {}\n" + "\n" * 20 + "function lock(q) {}")
    assert (0, "index") not in origins(other, _funcs(("lock", 24, "lock(q)", stale), ("other", 3, "other(timeout)", None)))
    # a description whose tags fit the neighbour only goes to the neighbour
    moved = _funcs(("lock", 3, "lock(q)", stale), ("late", 5, "late(timeout)", None))
    assert origins("function lock(q) {}\nfunction late(timeout) {}\n", moved) == {(1, "moved")}
    # tags that fit, or none, need no text
    assert origins(None, _funcs(("lock", 3, "lock(timeout)", stale), ("b", 9, None, "Drops rows without a key."))) == {(0, "index"), (1, "index")}


def test_long_file_has_no_edges():
    """A comment is given once wherever it stands in a long file."""
    text = "\n".join(f"// Waits for lock {i} to be free.\nfunction f{i}() {{}}\nfunction g{i}() {{}}" for i in range(3000))
    fs = _funcs(*[(f"{c}{i}", 3 * i + 2 + (c == "g"), "f()", None) for i in range(3000) for c in "fg"])
    out = D.link_file("a.js", text, fs)
    assert len(out) == 3000 and len({d for _, d, _, _ in out}) == 3000


HAND = "import x from './x';\n// Generated rows are ignored here, only hand-made ones count.\nfunction load(a) {\n  let b = open(a + 1);\n  if (b > 3) {\n    return b;\n  }\n  return close(b, 'DO NOT EDIT');\n}\n"


def _library(seed):
    r = random.Random(seed)
    return "\n".join(f"let {r.choice('abc')}{r.random()} = call{r.randint(0, 99)}({r.random()}, x{i % 7});" if i % 3 else f"if (q{r.randint(0, 999)}) {{ go(); }}" for i in range(40))


def test_provenance(spark):
    lib = _library(1)
    lines = lib.split("\n")
    lines[20] = "let changed = here();"
    files = {
        "a/src/hand.js": HAND, "a/gen/hand2.js": HAND.replace("load", "generate"), "a/lib/x.js": lib, "b/y.js": "\n".join(lines), "b/z.js": lib.replace("\n", "\r\n"), "c/own.js": _library(2), "c/own2.js": _library(2),
        "d/g.py": "# Code generated by tool. DO NOT EDIT.\nx = f(1)\n", "d/acc.js": "\n".join(f"function get{i}(m) {{ return m.f[{i}]; }}" for i in range(20)), "d/data.py": "d = [\n" + "\n".join(" 1, 22, 333, 44, 5, 66," for _ in range(40)) + "\n]\n",
        "d/min.js": "var a=function(c){for(var j=0;j<2;)c(j++)};" * 20, "d/tinyq.js": "// Third-party library tinyq, release 1.2.3 (x)\nlet q = 1;\n", "d/broken.js": "let x = ;\nfoo(", "d/e.js": "", "d/n.js": None,
        "e/s.ts": "#!/bin/sh\nset -e\necho hello\n", "f/s.ts": "#!/bin/sh\nset -e\necho hello\n",
    }
    df = spark.createDataFrame([(p, t, 1) for p, t in files.items()] + [(None, lib, 1), ("d/min.js", files["d/min.js"], 1)], "path string, content string, kind int")
    got = {x.path: x.kind for x in P.provenance(df).collect()}
    assert got == {"a/lib/x.js": "vendored", "b/y.js": "vendored", "b/z.js": "vendored", "d/g.py": "generated", "d/acc.js": "generated", "d/data.py": "data", "d/min.js": "minified", "d/tinyq.js": "vendored"}
    assert P.provenance(df.limit(0)).count() == 0


def test_marks_and_shapes():
    java = "class A {\n" + "\n".join(f"  public int get{n}() {{\n    return {n.lower()};\n  }}" for n in "Row Col Top Left Width Height Depth Count Size Name Kind Path".split()) + "\n}\n"
    assert P.composition("a/A.java", java) is None
    assert P.composition("a/x.py", "# Do not change the order of the calls below\nopen(a)\nclose(a)\n") is None
    assert P.composition("a/x.py", "# Schema v3. Generated by protogen 4.1; DO NOT EDIT.\nx = f(1)\n") == "generated"
    assert P.composition("a/x.py", "# DO NOT EDIT\nx = f(1)\n") == "generated" and P.composition("a/x.py", "# do not edit this file by hand\nx = f(1)\n") == "generated"
    assert P.composition("a/parser.js", "// Talks to parser 2 only, see release 1.2.3 of the protocol\nlet a = f(b);\n") is None


def _lines(r, n):
    return [f"let {r.choice('abc')}{r.random()} = call{r.randint(0, 99)}({r.random()});" for _ in range(n)]


def test_one_source_has_to_contain_it(spark, monkeypatch):
    """A file of passages from many repositories is no copy; one that mixes two libraries half and half is."""
    r = random.Random(9)
    parts = [_lines(r, 12) for _ in range(6)]
    files = {f"r{i}/own.js": parts[i] + _lines(r, 30) for i in range(6)} | {"z/mosaic.js": [x for q in parts for x in q]}
    lib = _lines(r, 60)
    files |= {f"v{i}/lib.js": lib for i in range(30)} | {f"e{i}/lib.js": lib[:20] + _lines(r, 3) + lib[23:] for i in range(30)}
    stock = _lines(r, 12)
    files |= {f"s{i}/a.js": stock + _lines(r, 6 + i % 3) for i in range(30)}  # lines that everyone has are not rare
    long_line = "var x = " + " + ".join(f"f{i}(a, b)" for i in range(60)) + ";"
    files |= {"m/one.js": [long_line], "n/one.js": [long_line], "m/sh.js": ["set -e", "echo hello"], "n/sh.js": ["set -e", "echo hello"]}
    df = spark.createDataFrame([(p, "\n".join(t), "x") for p, t in files.items()], "path string, content string, repo string")
    want = {p for p in files if p[0] in "ve" or p.endswith("one.js")}
    assert {x.path for x in P.provenance(df).collect() if x.kind == "vendored"} == want
    import codestrata.llm.skew as K
    monkeypatch.setattr(K.join_by_key, "__defaults__", (4,))
    assert {x.path for x in P.provenance(df).collect() if x.kind == "vendored"} == want


def test_every_source_counts(spark):
    """A source that the index proposes for no hash, and a text that very many repositories keep with changes of their own."""
    r = random.Random(10)
    text = _lines(r, 60)
    repos = sorted((f"m{i}" for i in range(30)), key=P._signed)
    copy, source = f"{repos[14]}/copy.js", f"{repos[15]}/source.js"
    files = {source: text + _lines(r, 70), copy: text[:48] + _lines(r, 20)}
    for i in range(12):  # all around it hold a few passages of it, and are the least, the greatest and the most copied
        part = text[max(5 * i - 2, 0) : 5 * i + 7]
        files |= {f"{repos[i]}/x.js": part + _lines(r, 30), f"{repos[-1 - i]}/x.js": part + _lines(r, 40)}
        files[f"{repos[-1 - i]}/y.js"] = files[f"{repos[-1 - i]}/x.js"]
    lib = _lines(r, 60)
    for i in range(25):  # each with another change: no passage is in fewer than 17 forms, none in a whole copy
        files[f"k{i}/lib.js"] = lib[: i + 10] + _lines(r, 2) + lib[i + 12 :]
    df = spark.createDataFrame([(p, "\n".join(t)) for p, t in files.items()], "path string, content string")
    got = {x.path: x.containment for x in P.provenance(df).collect() if x.kind == "vendored"}
    assert set(got) == {copy} | {p for p in files if p[0] == "k"}
    assert got[copy] == round(46 / 66, 6)


def test_containment_equals_a_plain_model(spark, monkeypatch):
    import codestrata.llm.skew as K
    r = random.Random(11)
    for rare, hot, whole in ((3, 100_000, 4), (3, 4, 0), (0, 100_000, 10**6)):
        monkeypatch.setattr(P, "RARE", rare)
        monkeypatch.setattr(P, "WHOLE", whole)
        monkeypatch.setattr(K.join_by_key, "__defaults__", (hot,))
        monkeypatch.setattr(K.salted_join, "__defaults__", (hot, 500_000 if hot > 4 else 0))
        rows = []
        for family in range(30):
            pool = [family * 100 + i for i in range(r.choice((10, 20, 40)))]
            for _ in range(r.choice((2, 5, 12))):
                own = [-r.randrange(10**9) for _ in range(r.randrange(12))]
                rows.append((r.randrange(8), sorted(set(r.sample(pool, r.randint(1, len(pool)))) | set(own) | set(r.sample(range(3000), 2)))))
        rows += [(r.randrange(8), rows[i][1]) for i in range(0, len(rows), 20)]
        repos = {}
        for repo, hashes in rows:
            repos.setdefault(tuple(hashes), set()).add(repo)
        number = {h: i for i, h in enumerate(repos)}
        library = {x for h, q in repos.items() if len(q) > 1 for x in h}
        df = Counter(x for h in repos for x in h)
        want, best = {number[h] for h, q in repos.items() if len(q) > 1}, {}
        for h, q in repos.items():
            for g, o in repos.items():
                if g != h and len(q) == 1 and (len(o) > 1 or o != q):
                    held = set(h) & set(g)
                    if 2 * sum(df[x] <= rare or x in library for x in held) >= len(h) or 3 * len(held) >= 2 * len(h):
                        want.add(number[h])
                        best.setdefault(number[h], set()).add(len(held) / len(h))
        table = spark.createDataFrame([(repo, number[tuple(h)], h) for repo, h in rows], "repo long, form long, hashes array<long>")
        got = {x.form: x.contained for x in P.containment(table).collect()}
        assert set(got) == want and 40 < len(want) < len(repos) - 20
        assert all(share in best.get(form, {1.0}) for form, share in got.items())
