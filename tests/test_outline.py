import pytest

from codestrata.functions.outline import body_complexity, comment_doc_line, outline, symbol_id

CASES = {
    "typescript": ("a.ts", "import { x as y, type T } from './m';\nimport * as ns from 'n';\n/** Saves it. */\nexport function save(a: string): void {\n  if (a && y(a)) { this.go(); ns.run(); } else { save(a); }\n}\nexport class A extends B {\n  private n = 1;\n  m(): number { return a ? 1 : 2; }\n}\ninterface I { z: number }\nenum E { P }\nconst f = (q) => q + 1;\n",
                   {("save", "function"), ("A", "class"), ("n", "variable"), ("m", "method"), ("I", "interface"), ("E", "enum"), ("f", "function")}, {("y", None), ("go", "this"), ("run", "ns"), ("save", None)}, {("x", "y", "value"), ("T", None, "type"), ("*", "ns", "namespace")}),
    "python": ("a.py", "from .m import x as y\nimport os\n\n@deco()\nclass A(B):\n    '''Doc.'''\n    def m(self, a):\n        for i in a:\n            if i and y(i): self.go()\n        return os.path.join(a)\n\ndef f(): return A()\nV = 1\n",
               {("A", "class"), ("m", "method"), ("f", "function"), ("V", "variable")}, {("deco", None), ("y", None), ("go", "self"), ("join", "()"), ("A", None)}, {("x", "y", "value"), ("os", None, "module")}),
    "java": ("A.java", "package p;\nimport a.b.C;\npublic class A {\n  private int n = 1;\n  public A() { init(); }\n  public int m(String s) { for (;;) { if (s.isEmpty()) return this.k(); } }\n  enum E { X }\n}\n",
             {("A", "class"), ("n", "variable"), ("constructor", "method"), ("m", "method"), ("E", "enum")}, {("init", None), ("isEmpty", "s"), ("k", "this")}, {("C", None, "value")}),
    "go": ("a.go", "package a\nimport (\n\t\"x/y\"\n)\ntype T struct {\n\tA int\n}\nfunc (t *T) M(a int) int {\n\tif a > 1 && y.F(a) { return g(a) }\n\treturn 0\n}\nfunc main() {}\nvar v = 1\n",
           {("T", "class"), ("M", "method"), ("main", "function"), ("v", "variable")}, {("F", "y"), ("g", None)}, {("y", None, "module")}),
    "c": ("a.c", "#include \"x.h\"\nstruct S { int a; };\nstatic int f(int a) { while (a) { g(a); } return s->h(a); }\n", {("S", "class"), ("f", "function")}, {("g", None), ("h", "s")}, {("*", None, "value")}),
    "rust": ("a.rs", "use a::b;\npub struct S { x: i32 }\nimpl S {\n  pub fn m(&self) -> i32 { if self.x > 1 { go(1) } else { 0 } }\n}\nfn f() {}\ntrait T { fn z(&self); }\n", {("S", "class"), ("m", "method"), ("f", "function"), ("T", "interface")}, {("go", None)}, {("b", None, "value")}),
    "kotlin": ("a.kt", "import a.b.C as D\nclass A {\n  val n = 1\n  fun m(a: Int): Int { if (a > 1) { go(a) }\n return 1 }\n}\nfun String.ext() { x.y() }\n", {("A", "class"), ("n", "variable"), ("m", "method"), ("ext", "method")}, {("go", None), ("y", "x")}, {("C", "D", "value")}),
    "swift": ("a.swift", "import Foo\nclass A {\n  init(a: Int) { go() }\n  func m() { guard x else { return } }\n}\nextension B { func n() {} }\nprotocol P {}\n", {("A", "class"), ("init", "method"), ("m", "method"), ("n", "method"), ("P", "interface")}, {("go", None)}, {("Foo", None, "module")}),
    "csharp": ("A.cs", "using System.Text;\nnamespace N {\n  public class A {\n    public A() { }\n    public int M(int a) { foreach (var x in y) { Go(x); } return a; }\n    int F(int q) => q;\n  }\n}\n", {("N", "module"), ("A", "class"), ("constructor", "method"), ("M", "method"), ("F", "method")}, {("Go", None)}, {("Text", None, "namespace")}),
    "php": ("a.php", "<?php\nuse A\\B as C;\nclass X {\n  public function m($a) { if ($a) { $this->go(); } }\n}\nfunction f() { g(); }\n", {("X", "class"), ("m", "method"), ("f", "function")}, {("g", None)}, {("B", "C", "value")}),
    "dart": ("a.dart", "import 'x.dart' as x;\nclass A {\n  int m(int a) { if (a > 1) go(a); return 1; }\n}\nvoid main() { x.run(); }\n", {("A", "class"), ("m", "method"), ("main", "function")}, {("go", None), ("run", "x")}, None),
    "ruby": ("a.rb", "require 'x'\nmodule M\n  class A\n    # Does it.\n    def m(a)\n      if a\n        go(a)\n      end\n    end\n    private\n    def p; end\n  end\nend\n", {("M", "module"), ("A", "class"), ("m", "method"), ("p", "method")}, {("go", None)}, {("*", None, "wildcard")}),
    "objc": ("a.m", "#import <F.h>\n@implementation A\n- (int)run:(int)a with:(int)b { go(a); return 1; }\n@end\n", {("A", "class"), ("run:with:", "method")}, {("go", None)}, {("*", None, "value")}),
    "cpp": ("a.cpp", "#include <x>\nnamespace n { class A { public: int m(int a); }; }\nint A::m(int a) { return a > 1 ? go(a) : 0; }\n", {("n", "module"), ("A", "class"), ("m", "method")}, {("go", None)}, {("*", None, "value")}),
}


@pytest.mark.parametrize("language", CASES)
def test_rows(language):
    path, text, symbols, calls, imports = CASES[language]
    o = outline(path, text, language)
    assert symbols <= {(s["name"], s["kind"]) for s in o["symbols"]}
    assert calls <= {(c["target_name"], c["receiver"]) for c in o["calls"]}
    if imports is not None:
        assert imports == {(i["name"], i["alias"], i["kind"]) for i in o["imports"]}
    ids = [s["id"] for s in o["symbols"]]
    assert len(set(ids)) == len(ids) and all(len(s["signature"]) <= 120 and s["end_line"] >= s["start_line"] for s in o["symbols"])


def test_details():
    s = {x["name"]: x for x in outline(*CASES["typescript"][:2], "typescript")["symbols"]}
    assert s["save"]["exported"] and s["save"]["doc"] == "Saves it." and s["m"]["fqn"] == "a.ts:A.m" and s["m"]["exported"] and not s["I"]["exported"]
    assert (s["save"]["complexity"], s["save"]["cognitive"]) == (3, 4) and (s["m"]["complexity"], s["m"]["cognitive"]) == (2, 1)
    p = {x["name"]: x for x in outline(*CASES["python"][:2], "python")["symbols"]}
    assert (p["m"]["complexity"], p["m"]["cognitive"]) == (4, 4) and p["f"]["complexity"] is None and p["A"]["doc"] == "Doc."
    g = {x["name"]: x for x in outline(*CASES["go"][:2], "go")["symbols"]}
    assert g["M"]["fqn"] == "a.go:T.M" and g["M"]["exported"] and not g["main"]["exported"]
    assert comment_doc_line("/**\n *\n * First. \n * Second\n */") == "First." and comment_doc_line("/** */") is None
    assert symbol_id("f", "n", "function", "n()") != symbol_id("f", "n", "function", "n()", "C")
    assert outline("x.txt", "a", "unknown") == {"symbols": [], "calls": [], "imports": []}
    assert outline("x.py", "def f(", "python")["symbols"] == []


@pytest.mark.parametrize("language", CASES)
def test_any_prefix_survives(language):
    path, text = CASES[language][:2]
    for k in range(0, len(text), 7):
        outline(path, text[:k], language)
        outline(path, text[:k] + "}])({" + text[k:], language)


def test_body_complexity():
    """By the rules of each language; comments and strings hold no decisions."""
    cases = {
        "python": ("    def f(a):\n        # if a and b\n        for x in [y for y in a if y]:\n            if x and a or '''if\nwhile''':\n                pass\n", 6),
        "typescript": ("f(a) {\n  // if (a) && b\n  if (a && b ?? c) { return a ? `if (x) ${y}` : 'for' }\n  for (const x of a) {}\n}", 6),
        "javascript": ("function f(a) { switch (a) { case 1: case 2: default: } try {} catch (e) {} while (a || b) {} }", 6),
        "go": ("func f(a int) {\n\tfor i := range x { if a > 0 && b { s := `if for` } }\n\tswitch a { case 1: default: }\n}", 5),
        "ruby": ("def f(a)\n  # if a\n  return 'if' unless a && b\n  x if y\nend", 4),
        "java": ("int f() { return a ? 1 : 2; }", 2),
    }
    assert {k: body_complexity(c, k) for k, (c, _) in cases.items()} == {k: n for k, (_, n) in cases.items()}
    assert body_complexity("def f():\n    return 1", "python") is None and body_complexity("if", "unknown") is None
    assert body_complexity("    if a:\n        return", "python") == 2


def test_broken_python_keeps_the_rest():
    text = "import os\n\ndef good(a):\n    return os.path.join(a)\n\n<<<<<<< HEAD\ndef left(:\n    pass\n=======\n@deco\ndef right():\n    x = = 3\n    return good(1)\n>>>>>>> z\n\nclass A:\n    def m(self):\n        return self.n()\n    def n(self): return (1\n"
    o = outline("a.py", text, "python")
    got = {(s["name"], s["kind"], s["start_line"]) for s in o["symbols"]}
    assert {("good", "function", 3), ("right", "function", 11)} <= got and ("left", "function", 7) not in got
    assert {("join", 4), ("good", 13)} <= {(c["target_name"], c["line"]) for c in o["calls"]} and [i["module"] for i in o["imports"]] == ["os"]
    assert outline("b.py", "def f(:\n" * 50, "python") == {"symbols": [], "calls": [], "imports": []}
