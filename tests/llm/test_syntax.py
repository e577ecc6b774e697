import ast
import random
import time

import pytest

from codestrata.llm import syntax as S

VALID = {
    "python": ["", "\n\n# c\n", "x = 1\n", "def f(a, *, b: int = 2, **k) -> int:\n    '''doc'''\n    return [i async for i in a if i] or {**k, 'x': (yield)}\n", "if a:\n  pass\nelif b: x = y = 3\nelse:\n\tz\n",
               "match x:\n    case [1, *r] if r: pass\n    case {'k': v, **o} | Foo(a=1): y\n", "with (open(a) as f, g()): pass\n", "a[1:2, ::3, *b] = lambda *a, k=1: (x := 2)\n", "async def f():\n    await x\n    async with a as b, c: ...\n",
               "class A(B, metaclass=C):\n    @p.x(1)\n    def f(self): return not a in b is not c\n", "from ..a import (b as c, d,)\nimport x.y as z, w\n", "try:\n  a\nexcept* E as e: b\nfinally:\n  c\n", "print(f'{a!r:>{w}}', *a, **b)\ndel a, b[0]\n", "match = 3\nprint(match, case)\ntype X[T] = list[T]\n", "x = 1 if a else 2; y: int = 3\n"],
    "javascript": ["", "#!/usr/bin/env node\nlet a = 1\nlet b = a\n++b", "const f = async (a, {b = 2, ...c}, [d,,e] = []) => ({a, b, [c]: 1, get x() { return 1 }, async *g() {}})\n", "a = b / c / d; r = /[/]x/gi.test(`q${`n${1}`}` + 'z')", "for (const x of y) if (x) break; else continue\ndo x++; while (x < 5) y()",
                   "class A extends B(c) { static #p = 1; static { this.x = 2 } constructor() { super(); } get [k]() { return this.#p } async *m() {} x = 1\n y }", "import d, * as n from 'm'; import {a as b, default as c} from 'x'; export * as q from 'z'; export default function () {}", "x ??= a?.b?.[c]?.(d) ?? (1, 2) ** 3; var {a, b: [c]} = d; label: for (;;) { continue label }", "switch (a) { case 1: case 2: x(); default: }\ntry { a } catch { b } finally { c }", "for (var i = 0, n = a.length; i < n; i++) for (k in o) ;\nnew Foo().bar(new.target, ...a)", "if (a) { } else if (b) return1(); throw new E(`t`)", "!function(t,u){u.t_=t&&u||392}(0,{});var a=function(c){for(var j=0;j<215;)c(j++)};"],
    "typescript": ["interface A<T extends B = C> extends D, E<F> { readonly a?: string; [k: string]: any; m<U>(x: U, ...r: T[]): x is A; new (a): B; (b: c): d }", "type M = { -readonly [K in keyof T as `x${K}`]?: T[K] } | ((a: number, b?: string) => void)[] & typeof x.y\ntype C = A extends infer U extends string ? U : never",
                   "abstract class A<T> implements B, C<T> { private readonly x: number = 1; constructor(public a: string, protected b?: Map<string, Array<number>>) { super() } abstract f(): void; static async g<T>(this: A, x: T): Promise<void> {} @dec() h!: string }", "enum E { A = 1, B, 'c' = A | B }\ndeclare module 'm' { export const x: number; function f(): void }\nnamespace N.M { export let y = <any>z }", "const f = <T,>(a: T): a is T => g<T>(a as unknown as T)!.b satisfies C; let x: [a: string, b?: number, ...rest: boolean[]] = y", "import type { A, B as C } from './x'; export type { D } from 'y'; import fs = require('fs'); export = fs", "function over(a: string): void;\nfunction over(a: number): void;\nfunction over(a: any) { return a < b && c > d }", "let v = a ? (b) : c => d; declare global { interface W { x: 1 } }\nexport default interface Q {}", "function h(registry: boolean): string | null {\n  return registry;\n}\nexport const n: number = 3;"],
    "java": ["", "package a.b; import static x.Y.*; @A(b = {1, 2}) public final class C<T extends D & E> extends F<T> implements G, H { int[] a = {1, 2}, b[]; static { x(); } C() { this(1); } <U> U m(final List<? super T>... x) throws E { return (U) x[0]; } }",
             "class A { void f() { for (var x : y) { if (x instanceof String s && s.length() > 3) continue; } for (int i = 0, j = 1; i < 3; i++, j--) {} int k = a < b ? c >>> 2 : d >> 1; Runnable r = () -> {}; var q = (int a, b) -> a; } }".replace("(int a, b)", "(int a, int b)"), "enum E implements I { A(1) { void f() {} }, B; private E(int... x) {} }\nrecord R<T>(int a, String... b) { R { a = 1; } }\nsealed interface S permits T {}", "class A { int f(Object o) { return switch (o) { case Integer i when i > 3 -> 1; case P(var x, int y) -> { yield 2; } case null, default -> throw new E(); }; } String t = \"\"\"\n a \"q\" \n\"\"\"; Function<A, B> g = A::new; int[][] z = new int[3][]; }", "class A { void f() { try (var a = b(); c) { x.<T>y(); a.new B() {}; } catch (E | F e) { throw e; } finally { synchronized (this) { } } List<Map<String, List<Integer>>> m = new ArrayList<>(); outer: while (true) break outer; } @interface Q { int v() default 1; } }"],
    "c": ["int x;", "#include <a.h>\n#if A\nint f(\n#else\nint g(\n#endif\nvoid) { return sizeof(int *) + (unsigned)1 * *p; }", "typedef struct S { int a : 3, *b[4]; union { float f; } u; } T; static const T t = { .a = 1, [2] = { 3 } }; enum E { A = 1, B, };", "int (*fp)(int, void (*)(char), ...); int main(int argc, char *argv[]) { for (int i = 0; i < 3; i++) if (a) b(); else do c--; while (*p++ = q->r.s); switch (x) { case 1 ... 3: default: ; } goto end; end: return (T){1}.a ? a ?: b : c; }", "foo_t *a, f(bar_t x); int y = L'x' + '\\n' + sizeof x; char *s = \"a\" PRIu64 \"b\"; __attribute__((noreturn)) void g(void);", "static long f(long a) {\n    long b = a;\n    a * b;\n    emit(\"x\", a);\n    return b;\n}"],
    "go": ["package a\n", "package a\nimport (\n\t\"x\"\n\ty \"z\"\n)\ntype T[K comparable, V ~int | string] struct {\n\tA, B int `json`\n\t*E\n\tF func(int, ...string) (a, b error)\n}\n", "package a\nfunc (t *T[K, V]) F(x, y int, z ...string) (err error) {\n\tif v, ok := m[k]; !ok { return } else if x == (T{}) { }\n\tfor i := range 10 { }\n\tfor ; ; { }\n\tfor k, v := range m { a[k] <- v }\n\tdefer func() { recover() }()\n\tswitch x := y.(type) {\n\tcase int, *T:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase <-c:\n\tcase d <- 1:\n\t}\n\treturn nil\n}\n", "package a\nvar x = map[string][]int{\"a\": {1, 2}, \"b\": nil}\nconst (\n\tA = iota\n\tB\n)\nvar f = func(a int) int { return a<<1 &^ 2 }\nvar y = []byte(`raw\n\"`)[1:2:3]\nvar z = G[int](T{A: 1}.B, &T{'x'}, struct{}{})\n", "package a\ntype I interface {\n\tF(a int) string\n\tfmt.Stringer\n}\nfunc main() {\n\tgo f(x...)\n\tx.y, z = <-c, *p\n\ti++\nL:\n\tfor {\n\t\tbreak L\n\t}\n}\n"],
}
BROKEN = {
    "python": ["def f(:\n  pass\n", "if a\n  b\n", "x = \n", "a = 'b\n", "f(a]\n", "<<<<<<< HEAD\nx\n", "  x\n y\n", "deff f(): pass\n", "for x in y:\npass\n", "class A:\n", "f(\n", "1 = = 2\n", "<!DOCTYPE html>\n"],
    "javascript": ["let x = ;", "f(a];", "class A { f( { } }", "if (a { }", "{ \"a\": 1, \"b\": 2 }", "fucntion f() {}", "let s = 'abc", "a b", "function f() {", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> z", "let f = (a: number) => a", "<a omitted for brevity>", "const x;", "`abc${", "/* abc"],
    "typescript": ["let x: = 3", "interface A { a: ; }", "function f(a: string: void {}", "enum E { A B }", "import a from b", "@@ -12,7 +12,9 @@ x\nlet a = 1", "type A = {", "f<T>(a"],
    "java": ["class A { int x }", "class A { void f() { x = 1 } }", "class A { void f( { } }", "clas A { }", "class A { String s = \"a; }", "class A {", "public static void main() { x(; }", "class A { int a = ; }", "import a.b\nclass A {}", "#!/bin/sh"],
    "c": ["int f( { }", "int x = ;", "int f(void) { return 1 }", "struct S { int a }", "void f() { if (x { } }", "int main() {", "char *s = \"abc;", "f(a];", "@@ -1 +1 @@", "<<<<<<< x\nint a;"],
    "go": ["", "package a\nfunc f( {\n}\n", "package a\nfnc f() {}\n", "package a\nvar x = \n", "package a\nfunc f() {\n\tx := \"abc\n}\n", "package a\nfunc f() {\n\tif x {\n}\n", "package a\nfunc f()\n{\n}\n", "import \"x\"\n", "package a\nfunc f() { a := b c }\n", "package a\nx := 1\n"],
}


@pytest.mark.parametrize("name", VALID)
def test_valid(name):
    lang = S.language(name, S.tables())
    assert [(t, lang.first_error(t)) for t in VALID[name] if lang.first_error(t)] == []
    assert all(lang.first_error(t.replace("\n", "\r\n")) is None for t in VALID[name] if "\\\n" not in t)


@pytest.mark.parametrize("name", BROKEN)
def test_broken(name):
    lang = S.language(name, S.tables())
    assert [t for t in BROKEN[name] if lang.first_error(t) is None] == []


def test_typescript_takes_javascript():
    lang = S.language("typescript", S.tables())
    assert [t for t in VALID["javascript"] if lang.first_error(t)] == []


def test_python_like_the_interpreter():
    rnd, lang = random.Random(7), S.language("python", S.tables())
    base = VALID["python"][3:] + ["def g(x):\n    for i in range(3):\n        if x[i] == 'a' and y:\n            return {i: 1}\n    return f(a, b=[1, 2])\n"]
    agree = total = 0
    for t in base:
        for _ in range(60):
            k = rnd.randrange(len(t))
            s = t[:k] + rnd.choice(["", "(", "]", ":", "'", " x ", "\n", t[k : k + 3]]) + t[k + 1 :]
            try:
                ast.parse(s)
                ok = True
            except Exception:
                ok = False
            total += 1
            agree += ok == (lang.first_error(s) is None)
    assert agree / total > 0.94  # the rest: what the interpreter checks beyond its grammar


def test_query(spark):
    rows = [("r/a.py", "x = 1\n"), ("r/b.py", "x = \n"), ("r/b.py", "x = \n"), ("r/c.go", None), ("r/d.txt", "((("), ("r/e.js", ""), (None, "x"), ("r/f.ts", "let a: = 1")]
    df = spark.createDataFrame(rows, "path string, content string").selectExpr("*", "1 as line", "'x' as language")
    got = {(r.path, r.line) for r in S.parse_files(df).collect()}
    assert got == {("r/a.py", None), ("r/b.py", 1), ("r/e.js", None), ("r/f.ts", 1)}
    assert S.parse_files(df.limit(0)).count() == 0


def test_work_grows_with_depth_only():
    lang = S.language("c", S.tables())
    for shape in ("int f(void){return %s1%s;}" % ("(a)(" * 200, ")" * 200), "int f(void){return %s1;}" % ("(a)" * 200), "int f(void){return %s1%s;}" % ("f(a)(" * 200, ")" * 200)):
        began = time.process_time()
        assert lang.first_error(shape) is None
        assert time.process_time() - began < 1
    took = []
    for depth in (500, 2000):
        began = time.process_time()
        assert lang.first_error("int f(void){return %s1%s;}" % ("(a)(" * depth, ")" * depth)) is None
        assert lang.first_error("int f(void){return %s1%s;}" % ("(a)(" * depth, ")" * (depth - 1))) is not None
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.1


@pytest.mark.parametrize(
    "text, line",
    [
        ("#if A\nint x;\n#else\nint x = ;\n#endif\n", 4),
        ("#if A\nint x;\n#elif B\nint y;\n#else\nint f( {\n#endif\nint z;\n", 6),
        ("#ifdef A\n#ifdef B\nint a;\n#else\nint b = ;\n#endif\nint c;\n#else\nint d;\n#endif\n", 5),
        ("#ifndef H\nint a;\n", 1), ("int a;\n#endif\n", 2), ("int a;\n#else\n", 2),
        ("#if 0\nthis is ( not code\n#endif\nint a;\n", None), ("#if 1\nint a;\n#else\nnot code (\n#endif\n", None), ("#if A\nint f(\n#else\nint g(\n#endif\nvoid);\n", None),
    ],
)
def test_every_branch_of_c(text, line):
    got = S.language("c", S.tables()).first_error(text)
    assert (got and got[0]) == line


def test_targets_and_parameters():
    py, js, ts = (S.language(n, S.tables()) for n in ("python", "javascript", "typescript"))
    for t in ("1 = 2\n", "a = b = 1 = c\n", "f() = 1\n", "a + b = c\n", "def f(a, a=1, b): pass\n", "def f(*): pass\n", "lambda a=1, b: 0\n", 'f"{a b}"\n', 'f"{}"\n', 'f"{a"\n', "x: int: 3\n", "(a, b) += 1\n"):
        assert py.first_error(t), t
    for t in ("a, (b, *c), [d] = e.f[1] = g\n", "def f(a, /, b, *, c=1, d, **k): pass\n", "def f(a=1, /, b=2, *c): pass\n", "lambda a, b=1, *c, d: 0\n", 'f"{a!r:>{w}} {{x}} {b=} {c:%Y-%m}"\n', "a.b += 1\n(x): int = 3\n", "x[1:2]: int\n", "rf'{a}\\d{{2}}'\n", "f'{d[\"a\"]}'\n"):
        assert py.first_error(t) is None, t
    for t in ("1 = 2;", "-a = 1;", "a++ = 1;", "'x' = y", "a || b => c"):
        assert js.first_error(t), t
    for t in ("[a, b] = c; ({a} = b); a.b = c[d] = 1; (a) = 2", "#x in y && z; class A { accessor b = 1 }", "let accessor = 1"):
        assert js.first_error(t) is None and ts.first_error(t) is None, t
    assert ts.first_error("class A { private accessor b: number = 1; static accessor c = 2 }") is None
    assert [t for t in ("let x = a ? b : c + d as T;", "a = b ? (c) : d => e;") if ts.first_error(t)] == []


def test_places():
    assert S.language("go", S.tables()).first_error("package a\n// c\nvar x = )\n") == (3, ")")
    assert S.language("java", S.tables()).first_error("/* a\n */ class A {\n int x }") == (3, "}")
    assert S.language("python", S.tables()).first_error("# c\nx = 1\n  y = 2\n")[0] == 3
