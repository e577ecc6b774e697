"""Outline of a source text: symbols, calls, imports and complexity, for the indexed languages.

Python goes through the interpreter's own syntax tree. Brace languages share one
tokenizer and one scope tracker, driven by a table per language; Ruby has a tracker by
keywords. Results follow the index's row rules (kinds, class-qualified names, exported
rule, one-line doc, signature of at most 120 characters), not any particular grammar.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections import Counter
from dataclasses import dataclass, field

MAX_METRIC, SIGNATURE_CHARS = 999, 120

SELF = frozenset({"this", "self", "cls", "@this"})
OPAQUE = "()"

_C_LEX = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTES = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_REST = r"[A-Za-z_$\u00a1-\uffff][\w$\u00a1-\uffff]*[?!]?(?=\s*\()|[A-Za-z_$\u00a1-\uffff][\w$\u00a1-\uffff]*|\d[\w.]*|=>|->|::|\?\.|\?\?|&&|\|\||[=!<>]=+|:=|\+\+|--|\.\.\.?|\S"


@dataclass
class Spec:
    """What the scope tracker needs to know of a brace language."""

    types: dict = field(default_factory=dict)  # word -> kind of the named scope it opens
    funcs: frozenset = frozenset()  # words that introduce a function
    bare: bool = False  # name(...) { declares without such a word
    bare_top: bool = False  # also outside of classes
    vars: frozenset = frozenset()  # words that introduce a variable
    typed_vars: bool = False  # type name = or type name ;
    imports: str = ""  # one expression; groups module, name, alias
    import_kind: str = "value"
    exported: str = "public"  # rule
    strings: str = _QUOTES
    comments: str = _C_LEX
    decisions: frozenset = frozenset({"if", "for", "while", "case", "catch", "&&", "||", "?"})
    loops: frozenset = frozenset({"for", "while", "do"})
    extension: frozenset = frozenset()  # words whose scope belongs to the named type
    receiver_first: bool = False  # func (r *T) name
    ctor: str = ""  # method name that stands for the class
    stop: frozenset = frozenset()  # callees never recorded


def _w(text: str) -> frozenset:
    return frozenset(text.split())


#: Words of the languages, by the role they play here.
SPECS: dict[str, Spec] = {
    "typescript": Spec({"class": "class", "interface": "interface", "enum": "enum", "namespace": "module", "module": "module"}, _w("function"), bare=True, vars=_w("const let var"), exported="export", strings=_QUOTES + r"|`(?:\\.|[^`\\])*`",
                       imports=r"import\s+(?:type\s+)?(?P<clause>[^'\";]*?)\s*(?:from\s*)?['\"](?P<module>[^'\"]+)['\"]", decisions=_w("if for while case catch && || ? ??"), stop=_w("require super")),
    "java": Spec({"class": "class", "interface": "interface", "enum": "enum", "record": "class"}, bare=True, typed_vars=True, exported="public", ctor="constructor", imports=r"^\s*import\s+(?:static\s+)?(?P<module>[\w.]+?)\.(?P<name>\w+|\*)\s*;", stop=_w("super this")),
    "go": Spec({}, _w("func"), vars=_w("var const"), exported="upper", receiver_first=True, import_kind="module", imports=r"^\s*(?:import\s+)?(?:(?P<alias>[\w.]+)\s+)?\"(?P<module>[^\"]+)\"\s*$", strings=_QUOTES + r"|`[^`]*`", decisions=_w("if for case && ||"),
               stop=_w("make len cap append new panic print println copy delete close min max recover complex real imag clear")),
    "rust": Spec({"struct": "class", "union": "class", "enum": "enum", "trait": "interface", "mod": "module", "impl": "impl"}, _w("fn"), vars=_w("const static"), exported="pub", extension=_w("impl"), imports=r"^\s*(?:pub\s+)?use\s+(?P<module>[\w:]+?)(?:::(?P<name>\w+|\*|\{[^}]*\}))?(?:\s+as\s+(?P<alias>\w+))?\s*;",
                 strings=r"r#*\"[^\"]*\"#*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", decisions=_w("if for while loop && || ? =>"), loops=_w("for while loop")),
    "swift": Spec({"class": "class", "struct": "class", "actor": "class", "enum": "enum", "protocol": "interface", "extension": "impl"}, _w("func init deinit subscript"), vars=_w("let var"), exported="notprivate", extension=_w("extension"), imports=r"^[ \t]*(?:@\w+[ \t]+)?import[ \t]+(?:\w+[ \t]+)?(?P<module>[\w.]+)",
                  import_kind="module", decisions=_w("if for while case catch guard repeat ?")),
    "kotlin": Spec({"class": "class", "object": "class", "interface": "interface"}, _w("fun constructor"), vars=_w("val var"), exported="notprivate", imports=r"^[ \t]*import[ \t]+(?P<module>[\w.]+?)\.(?P<name>\w+|\*)(?:[ \t]+as[ \t]+(?P<alias>\w+))?[ \t;]*$", decisions=_w("if for while catch && || ?: ->")),
    "dart": Spec({"class": "class", "mixin": "class", "enum": "enum", "extension": "impl"}, bare=True, bare_top=True, typed_vars=True, vars=_w("final const var late"), exported="underscore", extension=_w("extension"), imports=r"import\s+['\"](?P<module>[^'\"]+)['\"](?:\s+as\s+(?P<alias>\w+))?(?:\s+show\s+(?P<names>[\w, ]+))?", decisions=_w("if for while case catch && || ? ??")),
    "csharp": Spec({"class": "class", "struct": "class", "record": "class", "interface": "interface", "enum": "enum", "namespace": "module"}, bare=True, typed_vars=True, exported="public", ctor="constructor", imports=r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:(?P<alias>\w+)\s*=\s*)?(?P<module>[\w.]+)\s*;", import_kind="namespace", strings=r"@\"(?:\"\"|[^\"])*\"|\$?" + _QUOTES,
                   decisions=_w("if for foreach while case catch && || ? ?? and or"), loops=_w("for foreach while do"), stop=_w("nameof base")),
    "php": Spec({"class": "class", "trait": "class", "interface": "interface", "enum": "enum"}, _w("function"), vars=_w("const"), exported="notprivate", imports=r"^\s*use\s+(?:function\s+|const\s+)?(?P<module>[\w\\]+?)\\?(?P<name>\w+)(?:\s+as\s+(?P<alias>\w+))?\s*;", comments=r"#(?!\[)[^\n]*|" + _C_LEX,
                decisions=_w("if elseif for foreach while case catch && || ? ?? and or"), loops=_w("for foreach while do"), stop=_w("isset empty unset array list exit die echo print")),
    "c": Spec({"struct": "class", "union": "class", "enum": "enum"}, bare=True, bare_top=True, typed_vars=True, exported="notstatic", imports=r"^\s*#\s*include\s*[<\"](?P<module>[^>\"]+)[>\"]", import_kind="wildcard", stop=_w("sizeof defined __attribute__ _Alignof")),
    "cpp": Spec({"class": "class", "struct": "class", "union": "class", "enum": "enum", "namespace": "module"}, bare=True, bare_top=True, typed_vars=True, exported="notstatic", imports=r"^\s*#\s*include\s*[<\"](?P<module>[^>\"]+)[>\"]", import_kind="wildcard", strings=r"R\"\((?:.|\n)*?\)\"|" + _QUOTES, stop=_w("sizeof alignof decltype noexcept static_cast dynamic_cast const_cast reinterpret_cast static_assert")),
    "objc": Spec({"struct": "class", "enum": "enum", "@interface": "class", "@implementation": "class", "@protocol": "interface"}, bare=True, bare_top=True, typed_vars=True, exported="notstatic", imports=r"^\s*[#@]\s*(?:import|include)\s*[<\"]?(?P<module>[^>\";\s]+)", import_kind="wildcard", strings=r"@?" + _QUOTES),
}
SPECS["javascript"] = SPECS["tsx"] = SPECS["typescript"]

_CONTROL = _w("if for while switch catch do else return try finally new throw case typeof instanceof delete void sizeof default function class")
#: Further words of a language that a parenthesis may follow without a call.
_EXTRA = {
    "typescript": _w("await yield of in async with"), "java": _w("synchronized assert yield"), "go": _w("go defer select range func chan map"), "rust": _w("match loop unsafe await as in impl fn where"),
    "swift": _w("guard repeat defer await as is in where func"), "kotlin": _w("when fun as is in val var"), "dart": _w("await yield in is as"), "csharp": _w("foreach lock using fixed await when not and or is as in checked unchecked"),
    "php": _w("foreach elseif match fn use and or xor"), "cpp": _w("co_await co_return alignas requires"), "c": _w(""), "objc": _w(""),
}
_EXTRA["javascript"] = _EXTRA["tsx"] = _EXTRA["typescript"]
_HEAD_STOP = _w("; { } ( ) [ ] , = . => -> :: ? & | ! < > + - * / return new throw case else await yield goto typeof in instanceof".replace("* ", "").replace("< > ", "").replace(") ", "").replace("] ", "").replace("& ", ""))


def symbol_id(file: str, name: str, kind: str, signature: str, qualifier: str | None = None) -> str:
    parts = [file, name, kind, signature] + ([qualifier] if qualifier else [])
    return hashlib.sha1("\0".join(parts).encode()).hexdigest()[:16]


def normalize_signature(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def comment_doc_line(comment: str) -> str | None:
    """The first line of a comment that is not empty once its marks are gone."""
    for line in re.sub(r"^/\*+!?|\*+/$", "", comment.strip()).splitlines():
        line = re.sub(r"^\s*(?:///?!?|\*|#+)?\s?", "", line).strip()
        if line:
            return line
    return None


def outline(path: str, text: str, language: str) -> dict:
    """{symbols, calls, imports} of a text, as lists of dicts; empty lists for other languages."""
    if language == "python":
        out = _python(text)
    elif language == "ruby":
        out = _ruby(text)
    elif language in SPECS:
        out = _braces(text, SPECS[language], language)
    else:
        return {"symbols": [], "calls": [], "imports": []}
    seen: Counter = Counter()
    for s in out["symbols"]:
        base = (s["name"], s["kind"], s["signature"], s["qualifier"])
        seen[base] += 1
        n = seen[base]
        q = (s["qualifier"] or "") + (f"#{n}" if n > 1 else "")
        s["id"] = symbol_id(path, s["name"], s["kind"], s["signature"], q or None)
        s["fqn"] = f"{path}:{s['qualifier']}.{s['name']}" if s["qualifier"] else f"{path}:{s['name']}"
        s["signature"] = s["signature"][:SIGNATURE_CHARS]
        c = s.pop("cyc", 1), s.pop("cog", 0)
        callable_ = s["kind"] in ("function", "method")
        s["complexity"] = min(c[0], MAX_METRIC) if callable_ and c[0] > 1 else None
        s["cognitive"] = min(c[1], MAX_METRIC) if callable_ and c[1] > 0 else None
        s["language"] = language
    for c in out["calls"]:
        i = c.pop("source")
        c["source_id"] = out["symbols"][i]["id"] if i is not None else None
    return out


# ------------------------------------------------------------------ Python


_BLOCK = re.compile(r"[^\s#)\]}]")
_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b")
_MENDS = 4  # lines of a block that may be left out


def _python_tree(text: str):
    """The tree of a text, or the line of its first error (0 where there is no telling)."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text)
    except SyntaxError as e:
        return e.lineno or 0
    except (ValueError, RecursionError, MemoryError):
        return 0


def _python_top(text: str) -> list:
    """Statements of a file. Of a broken one, those of its top-level blocks that parse, up to ``_MENDS`` lines of each left out."""
    tree = _python_tree(text)
    if not isinstance(tree, int):
        return tree.body
    lines = text.splitlines()
    starts, decorated = [], False
    for i, line in enumerate(lines):
        if _BLOCK.match(line) and not _GOES_ON.match(line):
            if not decorated:
                starts.append(i)
            decorated = line[0] == "@"
    out = []
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        block = lines[a:b]
        for _ in range(_MENDS + 1):
            tree = _python_tree("\n".join(block))
            if not isinstance(tree, int):
                out += ast.increment_lineno(tree, a).body
                break
            if not 1 < tree <= len(block):  # the head itself, or what lies beyond
                break
            block[tree - 1] = " " * (len(block[tree - 1]) - len(block[tree - 1].lstrip())) + "pass"
    return out


def _python(text: str) -> dict:
    symbols, calls, imports = [], [], []
    top = _python_top(text)
    lines = text.splitlines()
    listed = None
    for n in top:
        if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)):
            listed = {e.value for e in n.value.elts if isinstance(e, ast.Constant)}

    def visible(name):
        return name in listed if listed is not None else not name.startswith("_")

    def add(name, kind, node, qualifier, signature, doc, exported, cyc=1, cog=0):
        symbols.append({"name": name, "kind": kind, "qualifier": qualifier, "signature": normalize_signature(signature), "doc": comment_doc_line(doc) if doc else None, "exported": exported,
                        "start_line": node.lineno, "end_line": node.end_lineno, "cyc": cyc, "cog": cog})
        return len(symbols) - 1

    def head(node):
        last = max(node.lineno, node.body[0].lineno - 1) if node.body[0].lineno > node.lineno else node.lineno
        return re.sub(r":\s*(?:#.*)?$", "", " ".join(lines[node.lineno - 1 : last]).split("  # ")[0]) if last <= node.lineno + 20 else lines[node.lineno - 1]

    def visit(body, qualifier, source, exported):
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                if source is not None and symbols[source]["kind"] in ("function", "method"):
                    walk_calls(n, source)
                    continue
                cyc, cog = _python_metrics(n)
                i = add(n.name, "method" if qualifier else "function", n, qualifier, head(n), ast.get_docstring(n), exported and (visible(n.name) if not qualifier else not n.name.startswith("_") or n.name.startswith("__")), cyc, cog)
                for d in n.decorator_list:
                    walk_calls(d, None)
                for b in n.body:
                    walk_calls(b, i)
            elif isinstance(n, ast.ClassDef):
                i = add(n.name, "class", n, qualifier, head(n), ast.get_docstring(n), exported and visible(n.name))
                for d in n.decorator_list:
                    walk_calls(d, None)
                visit(n.body, n.name, i, symbols[i]["exported"])
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                take_import(n)
            elif isinstance(n, (ast.Assign, ast.AnnAssign)):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name) and t.id != "__all__" and not qualifier:
                        add(t.id, "variable", n, None, lines[n.lineno - 1], None, visible(t.id))
                walk_calls(n, None)
            elif isinstance(n, (ast.If, ast.Try, ast.With)):
                for part in ("body", "orelse", "finalbody"):
                    visit(getattr(n, part, []), qualifier, source, exported)
                for h in getattr(n, "handlers", []):
                    visit(h.body, qualifier, source, exported)
                for e in ast.iter_child_nodes(n):
                    if isinstance(e, ast.expr):
                        walk_calls(e, None)
            else:
                walk_calls(n, None)

    def take_import(n):
        if isinstance(n, ast.Import):
            for a in n.names:
                imports.append({"module": a.name, "name": a.name, "alias": a.asname, "kind": "module", "line": n.lineno})
        else:
            mod = "." * n.level + (n.module or "")
            for a in n.names:
                imports.append({"module": mod, "name": a.name, "alias": a.asname, "kind": "module" if n.level and not n.module else "value", "line": n.lineno})

    def walk_calls(node, source):
        for n in ast.walk(node):
            if isinstance(n, (ast.Import, ast.ImportFrom)):
                take_import(n)
            if not isinstance(n, ast.Call):
                continue
            f = n.func
            if isinstance(f, ast.Name) and f.id != "super":
                calls.append({"source": source, "target_name": f.id, "receiver": None, "self_receiver": None, "line": n.lineno})
            elif isinstance(f, ast.Attribute):
                v = f.value
                if isinstance(v, ast.Call) and isinstance(v.func, ast.Name) and v.func.id == "super":
                    continue
                r = v.id if isinstance(v, ast.Name) else OPAQUE
                calls.append({"source": source, "target_name": f.attr, "receiver": r, "self_receiver": True if r in ("self", "cls") else None, "line": n.lineno})

    visit(top, None, None, True)
    return {"symbols": symbols, "calls": calls, "imports": imports}


def _python_metrics(fn) -> tuple[int, int]:
    """(cyclomatic, cognitive) of a function; nested functions belong to it."""
    cyc, cog = 1, 0

    def walk(n, depth, is_elif=False):
        nonlocal cyc, cog
        if isinstance(n, (ast.If, ast.IfExp, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler)):
            cyc += 1
            cog += 1 if is_elif else 1 + depth
        if isinstance(n, ast.If):
            walk(n.test, depth)
            for b in n.body:
                walk(b, depth + 1)
            if len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If):
                walk(n.orelse[0], depth, True)
            else:
                cog += bool(n.orelse)
                for b in n.orelse:
                    walk(b, depth + 1)
            return
        if isinstance(n, ast.BoolOp):
            cyc += len(n.values) - 1
            cog += 1
        elif isinstance(n, ast.comprehension):
            cyc += 1 + len(n.ifs)
        elif isinstance(n, ast.Match):
            cyc += len(n.cases)
            cog += 1 + depth
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == fn.name:
            cog += 1
        deeper = depth + isinstance(n, (ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.Match, ast.IfExp, ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda))
        if isinstance(n, (ast.While, ast.For, ast.AsyncFor)) and n.orelse:
            cog += 1
        for c in ast.iter_child_nodes(n):
            walk(c, deeper)

    for b in fn.body:
        walk(b, 0)
    return cyc, cog


# ------------------------------------------------------------------ Ruby


def _ruby(text: str) -> dict:
    symbols, calls, imports, stack = [], [], [], []
    private, comment = {}, []
    opener = re.compile(r"^\s*(?:def|class|module|if|unless|while|until|case|for|begin)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*(?:if|case|begin|unless)\b")
    for no, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", '""', raw)
        s = re.sub(r"(?<!\S)#.*$", "", line).strip()
        if raw.strip().startswith("#"):
            comment.append(raw.strip())
            continue
        owner = "::".join(x[1] for x in stack if x[0] in ("class", "module") and x[1]) or None
        if m := re.match(r"require(?:_relative)?\s*\(?\s*['\"]([^'\"]+)", raw.strip()):
            imports.append({"module": m.group(1), "name": "*", "alias": None, "kind": "wildcard", "line": no})
        entry = None
        if m := re.match(r"(class|module)\s+([A-Z][\w:]*)", s):
            symbols.append(_row(m.group(2), m.group(1), owner, s, comment, True, no))
            entry = (m.group(1), m.group(2), len(symbols) - 1)
        elif m := re.match(r"def\s+(?:self\.)?([\w]+[?!=]?|[^\s(]+)", s):
            symbols.append(_row(m.group(1), "method" if owner else "function", owner, s, comment, not private.get(owner), no))
            entry = ("def", m.group(1), len(symbols) - 1)
            if re.match(r"def\s+[^=]*\)\s*=\s|def\s+\w+\s*=\s", s):
                symbols[-1]["end_line"] = no
                entry = None
        elif m := re.match(r"attr_(?:accessor|reader|writer)\s+(.*)", s):
            for a in re.findall(r":(\w+)", m.group(1)):
                symbols.append(_row(a, "method", owner, s, comment, not private.get(owner), no))
                symbols[-1]["end_line"] = no
        elif s in ("private", "protected"):
            private[owner] = True
        elif s == "public":
            private[owner] = False
        elif (m := re.match(r"([A-Z]\w*)\s*=[^=]", s)) and not any(x[0] == "def" for x in stack):
            symbols.append(_row(m.group(1), "variable", owner, s, comment, True, no))
            symbols[-1]["end_line"] = no
        comment = []
        inside = next((x[2] for x in reversed(stack) if x[0] == "def"), None)
        if inside is not None or entry is None:
            for m in re.finditer(r"(?:(\w+|[)\]}@])\s*(?:&?\.))?\b([a-z_]\w*[?!]?)\s*\(", s):
                r = m.group(1)
                calls.append({"source": inside, "target_name": m.group(2), "receiver": OPAQUE if r in (")", "]", "}") else r, "self_receiver": True if r == "self" else None, "line": no})
        if inside is not None:
            words = re.findall(r"\b(?:if|unless|elsif|while|until|for|when|rescue|and|or)\b|&&|\|\||\?(?=\s)", s)
            symbols[inside]["cyc"] += len(words)
            depth = sum(1 for x in stack if x[0] == "block")
            symbols[inside]["cog"] += sum(1 if w in ("elsif", "and", "or", "&&", "||") else 0 if w == "when" else 1 + depth for w in words) + (s == "else")
        if entry:
            stack.append(entry)
        elif opener.search(s) and not re.search(r"\bend\b", s):
            stack.append(("block", None, None))
        if re.match(r"end\b", s) and stack:
            top = stack.pop()
            if top[2] is not None:
                symbols[top[2]]["end_line"] = no
    return {"symbols": symbols, "calls": calls, "imports": imports}


def _row(name, kind, qualifier, signature, comment, exported, line):
    doc = comment_doc_line("\n".join(comment)) if comment else None
    return {"name": name, "kind": kind, "qualifier": qualifier, "signature": normalize_signature(signature), "doc": doc, "exported": bool(exported), "start_line": line, "end_line": line, "cyc": 1, "cog": 0}


# ------------------------------------------------------------------ brace languages


_LEXERS: dict = {}


def _tokens(text: str, spec: Spec):
    key = (spec.comments, spec.strings)
    if key not in _LEXERS:
        _LEXERS[key] = re.compile(f"(?P<c>{spec.comments})|(?P<s>{spec.strings})|(?P<t>@?(?:{_REST}))", re.S)
    toks, comments, line, at = [], {}, 1, 0
    for m in _LEXERS[key].finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        if m.lastgroup == "c":
            end = line + m.group().count("\n")
            first, prior = line, comments.pop(line - 1, None)
            if prior and m.group().startswith("//") and prior[1].startswith("//"):
                comments[end] = (prior[0], prior[1] + "\n" + m.group())
            else:
                comments[end] = (first, m.group())
        else:
            toks.append(('""' if m.lastgroup == "s" else m.group(), line, m.start()))
    return toks, comments


def _is_name(t: str) -> bool:
    return bool(t) and (t[0].isalpha() or t[0] in "_$" or ord(t[0]) > 160)


def _braces(text: str, spec: Spec, language: str) -> dict:
    toks, comments = _tokens(text, spec)
    words = [t for t, _, _ in toks]
    control = _CONTROL | _EXTRA[language]
    n = len(words)
    jump, stack = {}, []
    pairs = {"(": ")", "[": "]", "{": "}"}
    for i, t in enumerate(words):
        if t in pairs:
            stack.append(i)
        elif t in (")", "]", "}"):
            while stack and pairs[words[stack[-1]]] != t:
                stack.pop()
            if stack:
                jump[stack.pop()] = i
    symbols, calls, bodies, imports = [], [], [], []
    text_lines = text.split("\n")
    if spec.imports:
        for m in re.finditer(spec.imports, text, re.M):
            g, line = m.groupdict(), text.count("\n", 0, m.start("module")) + 1
            if language == "go" and not re.match(r"\s*import\b", m.group()) and not _in_go_import(text, m.start()):
                continue
            imports += [{"module": g["module"], "name": a, "alias": b, "kind": k, "line": line} for a, b, k in _import_names(g, m.group(), spec)]

    def doc_above(line):
        c = comments.get(line - 1)
        return comment_doc_line(c[1]) if c else None

    def start_of(i):
        """Index of the first token of the declaration that holds token i."""
        j = i
        while j > 0 and words[j - 1] not in (";", "{", "}", ",") and not (words[j - 1] == ")" and toks[j - 1][1] < toks[j][1] and j <= i and not _annotated(j - 1)):
            j -= 1
            if words[j] == ")" and j in back:
                j = back[j]
        return j

    back = {b: a for a, b in jump.items()}

    def _annotated(j):
        k = back.get(j, j) - 1
        return k > 0 and (words[k].startswith("@") or words[k - 1] == "@")

    def exported(mods, name, owner_ok):
        rule = spec.exported
        if rule == "export":
            return owner_ok if owner_ok is not None else "export" in mods
        if rule == "public":
            return (owner_ok is not False) and ("public" in mods or "protected" in mods)
        if rule == "upper":
            return name[:1].isupper()
        if rule == "pub":
            return any(m.startswith("pub") for m in mods) or name == "main"
        if rule == "underscore":
            return not name.startswith("_")
        if rule == "notstatic":
            return "static" not in mods and "private" not in mods
        return "private" not in mods and "fileprivate" not in mods

    def add(name, kind, qualifier, first, sig_end, last, owner_ok):
        mods = words[first : sig_end + 1]
        line = toks[first][1]
        stop = toks[sig_end][2]
        r = _row(name, kind, qualifier, text[toks[first][2] : stop], [], exported(mods[: max(1, mods.index(name) if name in mods else len(mods))], name, owner_ok), line)
        r["doc"], r["end_line"] = doc_above(line), toks[min(last, n - 1)][1]
        symbols.append(r)
        return len(symbols) - 1

    def header_end(i):
        """Index of the body's { after a declaration head, or of ; or => that ends it without one."""
        while i < n:
            t = words[i]
            if t in ("{", ";", "=>", "}"):
                return i
            if t == "=" and spec.bare:
                return i
            if language == "go" and i + 1 < n and toks[i + 1][1] > toks[i][1] and t not in (",", "("):
                return i + 1
            i = jump[i] + 1 if t in ("(", "[") and i in jump else i + 1
        return n - 1

    def scan(i, end, qualifier, owner_ok, in_class):
        while i < end:
            t = words[i]
            prev = words[i - 1] if i else ""
            if t in ("(", "[") and i in jump:
                calls_in(i, jump[i] + 1, None)
                i = jump[i] + 1
                continue
            if t in spec.types and prev not in (".", "::") and i + 1 < end and (_is_name(words[i + 1]) or t == "impl" or language in ("kotlin", "swift")):
                i = take_type(i, end, qualifier, owner_ok)
                continue
            if language in ("typescript", "javascript", "tsx") and t == "type" and i + 2 < end and _is_name(words[i + 1]) and words[i + 2] in ("=", "<"):
                j = i
                while j < end and words[j] != ";" and not (j > i + 3 and toks[j][1] > toks[j - 1][1] and words[j] not in ("|", "&", "}") and words[j - 1] not in ("|", "&", "=", "{")):
                    j = jump[j] + 1 if words[j] in pairs and j in jump else j + 1
                add(words[i + 1], "type", qualifier, start_of(i), min(j, n - 1), j - 1, owner_ok)
                i = j
                continue
            if language == "go" and t == "type" and i + 2 < end and _is_name(words[i + 1]):
                kind = {"struct": "class", "interface": "interface"}.get(words[i + 2], "type")
                j = next((k for k in range(i + 2, min(i + 12, end)) if words[k] == "{"), None)
                last = jump.get(j, i + 2) if j is not None and kind != "type" else i + 2
                add(words[i + 1], kind, None, i, j if j is not None and kind != "type" else min(i + 3, n - 1), last, None)
                i = last + 1
                continue
            if t in spec.funcs and prev not in (".", "?."):
                j, q, name = i + 1, qualifier, None
                if spec.receiver_first and j < end and words[j] == "(":
                    names = [w for w in words[j + 1 : jump.get(j, j)] if _is_name(w)]
                    q, j = (names[1] if len(names) > 1 else names[0] if names else None), jump.get(j, j) + 1
                if t in ("init", "deinit", "subscript", "constructor"):
                    name, j = t, i
                while j < end and words[j] in ("*", "<", "&"):
                    if words[j] == "<":
                        while j < end and words[j] != ">":
                            j += 1
                    j += 1
                if name is None and j < end and _is_name(words[j]):
                    name = words[j]
                    if language == "kotlin" and j + 2 < end and words[j + 1] == ".":
                        q, name, j = words[j], words[j + 2], j + 2
                if name is None:
                    i += 1
                    continue
                i = take_function(i, j, name.rstrip("?!") if language != "ruby" else name, q, owner_ok, in_class or bool(q))
                continue
            if t in spec.vars and i + 1 < end and _is_name(words[i + 1]) and words[i + 1] not in spec.funcs and words[i + 1] not in spec.types:
                i = take_variable(i, i + 1, end, qualifier, owner_ok)
                continue
            if spec.bare and (in_class or spec.bare_top) and _is_name(t) and i + 1 < end and t not in control and prev not in (".", "->", "=", "return", "new", "?."):
                k = i + 1
                if words[k] == "<" and language in ("typescript", "java", "csharp", "dart", "tsx", "javascript"):
                    while k < end and words[k] not in (">", ";", "{"):
                        k += 1
                    k += 1
                if k < end and words[k] == "(" and k in jump:
                    j = jump[k] + 1
                    h = header_end(j)
                    ok = h < n and words[h] in ("{", "=>") and not any(w in ("+", "-", "/", "&&", "||", "==", ")") for w in words[j:h] if w != ")" or True and w not in ("(", ")"))
                    if language in ("c", "cpp", "objc") and (prev in ("", ";", "}", "{") and not qualifier):
                        ok = False
                    if ok or (in_class and words[h] == ";" and spec.exported in ("export", "public", "notstatic") and prev not in (";", "{", "}") and language != "typescript"):
                        q = qualifier
                        if language == "cpp" and prev == "::" and i > 1:
                            q = words[i - 2]
                        name = spec.ctor if spec.ctor and t == qualifier else t
                        i = take_function(i, i, name, q, owner_ok, bool(q))
                        continue
            if spec.typed_vars and (in_class or spec.bare_top) and _is_name(t) and i + 1 < end and words[i + 1] in ("=", ";", "[") and (_is_name(prev) or prev in (">", "]", "*", "&", "?")) and prev not in control and prev not in ("import", "package", "using", "namespace", "goto"):
                i = take_variable(i, i, end, qualifier, owner_ok)
                continue
            if t == "{" and i in jump:
                scan(i + 1, jump[i], qualifier, owner_ok, in_class)
                i = jump[i] + 1
                continue
            if in_class and language in ("typescript", "tsx", "javascript") and _is_name(t) and i + 1 < end and words[i + 1] in ("=", ":", ";") and prev in (";", "{", "}", "readonly", "private", "public", "protected", "static") and qualifier:
                i = take_variable(i, i, end, qualifier, owner_ok)
                continue
            i += 1

    def take_type(i, end, qualifier, owner_ok):
        word, kind = words[i], spec.types[words[i]]
        h = i + 1
        while h < end and words[h] not in ("{", ";") and not (language in ("objc",) and word.startswith("@") and h > i + 1 and toks[h][1] > toks[i][1]):
            if words[h] == "=" and language == "rust":
                break
            h = jump[h] + 1 if words[h] in ("(", "[") and h in jump else h + 1
        names = [w for w in words[i + 1 : h] if _is_name(w) and w not in ("class", "companion", "for", "where", "on", "dyn", "mut", "unsafe")]
        name = names[0] if names else ("Companion" if language == "kotlin" else None)
        if name is None:
            return i + 1
        if word == "enum" and words[i + 1] == "class" and names:
            name = names[0]
        if word == "class" and i and words[i - 1] == "enum":
            kind = "enum"
        if word in spec.extension:
            inner = words[i + 1 : h]
            name = next((w for w in inner[inner.index("for") + 1 :] if _is_name(w)), name) if "for" in inner else next((w for w in inner[inner.index("on") + 1 :] if _is_name(w)), name) if "on" in inner else name
            if word == "impl" and "for" not in inner and "<" in inner[:1]:
                name = next((w for w in inner[inner.index(">") + 1 :] if _is_name(w)), name)
        if language in ("objc",) and word.startswith("@"):
            stop = next((k for k in range(h, n) if words[k] == "@end" or words[k] == "end" and words[k - 1] == "@"), n - 1)
            if not any(s["name"] == name and s["kind"] == kind for s in symbols):
                add(name, kind, None, i, min(h, n - 1), stop, None)
            k = h
            while k < stop:
                if words[k] in ("-", "+") and words[k + 1] == "(":
                    e = next((x for x in range(k, stop) if words[x] in ("{", ";")), stop)
                    sel = [words[x] for x in range(k + 1, e) if _is_name(words[x]) and (words[x + 1] == ":" or words[x - 1] == ")")]
                    parts = [words[x] + ":" for x in range(k + 1, e) if _is_name(words[x]) and words[x + 1] == ":"]
                    method = "".join(parts) or (sel[0] if sel else "")
                    last = jump.get(e, e)
                    if method and words[e] == "{":
                        s = add(method, "method", name, k, e, last, None)
                        bodies.append((s, e, last))
                        calls_in(e, last, s)
                    k = last + 1
                    continue
                k += 1
            return stop + 1
        last = jump.get(h, h) if h < n and words[h] == "{" else h
        ok = None
        if kind not in ("impl",):
            if not (language in ("c", "cpp", "objc") and words[h : h + 1] != ["{"]):
                s = add(name, kind, qualifier if kind != "module" else None, start_of(i), min(h, n - 1), min(last, n - 1), owner_ok if spec.exported == "export" else None)
                ok = symbols[s]["exported"]
        if h < n and words[h] == "{":
            if kind == "enum" and language in ("typescript", "javascript", "c", "cpp", "objc", "tsx"):
                return last + 1
            if kind == "module":
                scan(h + 1, last, None, None, False)
            else:
                scan(h + 1, last, name, ok if spec.exported in ("export", "public") else None, True)
        return last + 1

    def take_function(first, at, name, qualifier, owner_ok, member):
        h = header_end(at + 1)
        kind = "method" if member and qualifier else "function"
        if h < n and words[h] == "{" and h in jump:
            last = jump[h]
        elif h < n and words[h] in ("=>", "="):
            last = h
            while last < n - 1 and words[last] != ";" and not (toks[last + 1][1] > toks[last][1] and language == "kotlin" and last > h):
                last = jump[last] if words[last] in pairs and last in jump and jump[last] > last else last
                last += 1
        else:
            last = h
        s = add(name, kind, qualifier, start_of(first), min(h, n - 1), min(last, n - 1), owner_ok)
        if last > h:
            bodies.append((s, h, last))
            calls_in(h, last, s)
        return max(last, at) + 1

    def take_variable(first, at, end, qualifier, owner_ok):
        j = at + 1
        depth_end = None
        while j < end and words[j] not in (";",):
            if words[j] == "=" and depth_end is None:
                depth_end = j
            if j > at + 1 and toks[j][1] > toks[j - 1][1] and language in ("typescript", "javascript", "tsx", "go", "kotlin", "swift", "rust", "php") and words[j] not in (".", "?.", ")", "]", "}", "|", "&", "+", "?", ":") and words[j - 1] not in ("=", "=>", ",", "(", "[", "{", "|", "&", "+", ".", "?", ":"):
                break
            j = jump[j] + 1 if words[j] in pairs and j in jump else j + 1
        e = depth_end if depth_end is not None else j
        value = words[e + 1 : j] if depth_end is not None else []
        arrow = value[:1] in (["function"], ["async"]) or (value[:1] == ["("] or len(value) > 1 and value[1] == "=>") and "=>" in value
        kind = ("method" if qualifier else "function") if arrow and language in ("typescript", "javascript", "tsx") else "variable"
        if language == "go" and value[:1] == ["func"]:
            kind = "function"
        s = add(words[at], kind, qualifier, start_of(first), min(e, n - 1), min(j, n - 1) if j < n and words[min(j, n - 1)] == ";" else j - 1, owner_ok)
        if kind in ("function", "method"):
            bodies.append((s, e + 1, min(j, n - 1)))
        calls_in(e, min(j, n), s if kind in ("function", "method") else None)
        return max(j, at + 1)

    def calls_in(a, b, source):
        for i in range(a, min(b, n - 1)):
            if words[i + 1] == "(" and _is_name(words[i]) and words[i].rstrip("?!") not in control and words[i] not in spec.stop and words[i] not in spec.funcs:
                prev = words[i - 1] if i else ""
                recv = None
                if prev in (".", "->", "?.", "::"):
                    p = words[i - 2] if i > 1 else ""
                    recv = p if _is_name(p) and not (i > 2 and words[i - 3] in (".", "->", "?.")) else OPAQUE
                    if recv in ("super", "base", "parent"):
                        continue
                elif _is_name(prev) and prev not in control and prev not in ("new", "await", "throw", "export", "default", "let", "const", "var") and language in ("c", "cpp", "java", "csharp", "dart", "objc"):
                    continue
                calls.append({"source": source, "target_name": words[i].rstrip("?!"), "receiver": recv, "self_receiver": True if recv in SELF else None, "line": toks[i][1]})

    scan(0, n, None, None, False)
    for s, a, b in bodies:
        symbols[s]["cyc"], symbols[s]["cog"] = _metrics(words, jump, a, b, spec, symbols[s]["name"], language)
    return {"symbols": symbols, "calls": calls, "imports": imports}


_PY_WORDS = re.compile(r"\b(?:if|elif|for|while|except|case|and|or)\b")
_RUBY_WORDS = re.compile(r"\b(?:if|unless|elsif|while|until|for|when|rescue|and|or)\b|&&|\|\||\?(?=\s)")
_HASH_NOISE = re.compile(r"\"{3}.*?\"{3}|'{3}.*?'{3}|" + _QUOTES + r"|#[^\n]*", re.S)


def body_complexity(code: str, language: str) -> int | None:
    """Cyclomatic complexity of the lines of one function or method; null where trivial or for other languages."""
    if language == "python":
        n = 1 + _python_decisions(code)
    elif language == "ruby":
        n = 1 + len(_RUBY_WORDS.findall(_HASH_NOISE.sub(" ", code)))
    elif language in SPECS:
        words = [t for t, _, _ in _tokens(code, SPECS[language])[0]]
        n = 1 + _decisions(words, 0, len(words), SPECS[language])
    else:
        return None
    return min(n, MAX_METRIC) if n > 1 else None


def _python_decisions(code: str) -> int:
    """Branches, loops, handlers, cases, conditions of comprehensions and joined operands; by words where the lines are no function."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse("if 1:\n" + code if code[:1] in (" ", "\t") else code)
        fn = next(x for x in ast.walk(tree) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)))
    except (SyntaxError, ValueError, RecursionError, MemoryError, StopIteration):
        return len(_PY_WORDS.findall(_HASH_NOISE.sub(" ", code)))
    n = 0
    for x in (x for b in fn.body for x in ast.walk(b)):
        n += isinstance(x, (ast.If, ast.IfExp, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler))
        n += len(x.values) - 1 if isinstance(x, ast.BoolOp) else len(x.ifs) if isinstance(x, ast.comprehension) else 1 + (x.guard is not None) if isinstance(x, ast.match_case) else 0
    return n


def _decisions(words, a, b, spec: Spec) -> int:
    return sum(1 for i in range(a, b) if words[i] in spec.decisions and not (words[i] == "?" and words[i + 1 : i + 2] in ([":"], [")"], [","], [";"])))


def _metrics(words, jump, a, b, spec: Spec, name: str, language: str) -> tuple[int, int]:
    """(cyclomatic, cognitive) of the tokens a..b: decisions, and structures weighed by nesting."""
    cyc = 1 + _decisions(words, a, b, spec)
    cog, ends, bool_op = 0, [], None
    structural = {"if", "switch", "catch", "match", "when", "select", "guard"} | set(spec.loops)
    i = a
    while i < b:
        t = words[i]
        while ends and i > ends[-1]:
            ends.pop()
        if t == "else":
            cog += 1
            if words[i + 1 : i + 2] == ["if"]:
                h = next((k for k in range(i + 2, b) if words[k] == "{" and not _inside(jump, k, i)), None)
                if h in jump:
                    ends.append(jump[h])
                i += 2
                continue
            if words[i + 1 : i + 2] == ["{"] and i + 1 in jump:
                ends.append(jump[i + 1])
        elif t in structural and not (t == "while" and i and words[i - 1] == "}" and _closes_do(words, jump, i - 1)):
            cog += 1 + len(ends)
            k, h = i + 1, None
            while k < b and words[k] not in (";",):
                if words[k] == "{":
                    h = k
                    break
                k = jump[k] + 1 if words[k] == "(" and k in jump else k + 1
            if h in jump:
                ends.append(jump[h])
        elif t == "?" and words[i + 1 : i + 2] not in ([":"], [")"], [","], [";"], ["."]) and language not in ("rust", "kotlin", "swift", "go"):
            cog += 1 + len(ends)
        elif t in ("&&", "||"):
            cog += t != bool_op
            bool_op = t
        elif t in (";", "{", "}", ",", "="):
            bool_op = None
        elif t in ("break", "continue", "goto") and words[i + 1 : i + 2] and _is_name(words[i + 1]) and language in ("java", "go", "rust", "typescript", "javascript", "kotlin", "swift", "c", "cpp"):
            cog += 1
        elif t == name and words[i + 1 : i + 2] == ["("] and words[i - 1] not in (".", "->", "::") and i > a:
            cog += 1
        i += 1
    return cyc, cog


def _inside(jump, k, start):
    return any(start < x < k < y for x, y in jump.items() if x > start and x < k)


def _closes_do(words, jump, close):
    back = next((x for x, y in jump.items() if y == close), None)
    return back is not None and back > 0 and words[back - 1] == "do"


def _in_go_import(text: str, at: int) -> bool:
    block = text.rfind("import (", 0, at)
    return block >= 0 and ")" not in text[block:at]


def _import_names(g: dict, whole: str, spec: Spec):
    """(name, alias, kind) of one import match."""
    kind = spec.import_kind
    if "clause" in g:
        clause, only_type = (g["clause"] or "").strip(), bool(re.match(r"import\s+type\b", whole))
        base = "type" if only_type else "value"
        out = []
        if m := re.search(r"\*\s*as\s+([\w$]+)", clause):
            out.append(("*", m.group(1), "namespace"))
        if m := re.search(r"\{([^}]*)\}", clause):
            for part in filter(None, (p.strip() for p in m.group(1).split(","))):
                k = "type" if part.startswith("type ") else base
                a, _, b = part.removeprefix("type ").partition(" as ")
                out.append((a.strip(), b.strip() or None, k))
        if m := re.match(r"([\w$]+)\s*(?:,|$)", clause):
            out.append(("default", m.group(1), base))
        return out
    if g.get("names"):
        return [(x.strip(), None, "value") for x in g["names"].split(",")]
    name = g.get("name")
    if kind == "wildcard":
        return [("*", None, "value")]
    if name and name.startswith("{"):
        return [(x.strip().split(" as ")[0], (x.split(" as ")[1].strip() if " as " in x else None), "value") for x in name.strip("{}").split(",") if x.strip()]
    if name is None:
        tail = re.split(r"[./:\\]+", g["module"])[-1]
        if spec.import_kind == "module" and re.fullmatch(r"v\d+", tail):
            tail = re.split(r"/", g["module"])[-2]
        alias = g.get("alias")
        return [("*" if alias == "." else tail, None if alias == "." else alias, kind)]
    return [(name, g.get("alias"), "value")]
