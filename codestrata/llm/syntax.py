"""Problem 6: source files that do not parse.

Table-driven parsers, built from the bundled grammars, take every token of a file and
report the first one no parse can take. Tables are built once at the driver (they depend
on the grammars alone, a few hundred kB) and sent to the workers.

Defined results: a null text, or an extension without a grammar, is not judged; an empty
or blank text is judged like any other (valid for all but Go, which needs a package
clause); of repeated rows of a path any failure counts; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import grammars
from codestrata.llm.glr import Grammar, Parser, build_tables
from codestrata.llm.registry import query
from codestrata.llm.tokens import slices
from codestrata.session import load

EXTENSIONS = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "java": "java", "c": "c", "h": "c", "go": "go",
}

_GRAMMARS = {
    "javascript": (grammars.SCRIPT, frozenset({"js"})), "typescript": (grammars.SCRIPT, frozenset({"ts"})), "python": (grammars.PYTHON, frozenset()),
    "java": (grammars.JAVA, frozenset()), "c": (grammars.C, frozenset()), "go": (grammars.GO, frozenset()),
}


def _classes(**groups: str) -> dict[str, str]:
    return {w: name for name, words in groups.items() for w in words.split()}


_CLASS = {
    "javascript": _classes(OP="|| && ?? ^ == != === !== <= << % **", OPSET="+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??=", INCR="++ --"),
    "python": _classes(OP="% // == != <= >= << >> & ^", OPSET="+= -= *= /= //= %= **= >>= <<= &= |= ^= @="),
    "java": _classes(OP="|| && ^ == != <= << / %", OPSET="+= -= *= /= %= <<= &= |= ^=", INCR="++ --", PRIM="int long short byte char boolean float double", LIT="true false null"),
    "c": _classes(
        OP="|| && | ^ == != < > <= >= << >> / %", OPSET="+= -= *= /= %= <<= >>= &= |= ^=", INCR="++ --", BUILTIN="void char short int long float double signed unsigned _Bool _Complex __int128 __signed__",
        QUAL="const volatile restrict static extern register auto inline typedef _Noreturn _Thread_local __inline __inline__ __restrict __restrict__ __const __volatile__",
        ATTR="__attribute__ __attribute", ASM="asm __asm__ __asm", TYPEOF="typeof __typeof__ __typeof", ATOMIC="_Atomic", ALIGNAS="_Alignas", SIZEOF="sizeof _Alignof __alignof__",
        GENERIC="_Generic", STATIC_ASSERT="_Static_assert", extension="__extension__",
    ),
    "go": _classes(OP="|| && == != < <= > >= / % << >> &^", OPSET="+= -= *= /= %= <<= >>= &= |= ^= &^=", INCR="++ --"),
}
_CLASS["typescript"] = _CLASS["javascript"]

_NUM = r"(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][-+]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][-+]?\d+)?)[a-zA-Z]{0,3}"
_ID = r"[^\W\d]\w*"
_DQ, _SQ = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"', r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
_SLASH = r"(?P<C>//[^\n]*|/\*[\s\S]*?\*/)"
_BLANK, _INLINE = r"[\s\ufeff]*", r"[ \t\r\f\v\x1c-\x1f\x85\xa0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"


def _lexer(blank: str, *parts: str):
    """(pattern of a token after blanks, pattern that names a token's class). An unknown character is class BAD."""
    named = "|".join(parts) + r"|(?P<BAD>[\s\S])"
    bare = re.sub(r"\?P<\w+>", "?:", named)
    return re.compile(rf"{blank}({bare})"), re.compile(named)


_LEX = {
    "javascript": _lexer(
        _INLINE, r"(?P<N>(?:[^\W\d]|\$)[\w$]*)", r"(?P<L>\n\s*)", _SLASH, rf"(?P<STR>{_DQ}|{_SQ})",
        r"(?P<PRIV>#(?:[^\W\d]|\$)[\w$]*)", r"(?P<NUM>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][-+]?\d+)?)n?)", r"(?P<T>`)",
        r"(?P<P>\.\.\.|=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|==|!=|<=|>=|<<|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])",
    ),
    "java": _lexer(
        _BLANK, _SLASH, rf'(?P<LIT>"""[\s\S]*?(?<!\\)"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.[0-7a-fA-Fu]*)\'|{_NUM})', r"(?P<NONSEALED>non-sealed\b)", r"(?P<N>(?:[^\W\d]|\$)[\w$]*)",
        r"(?P<P>\.\.\.|->|::|<<=|==|!=|<=|>=|<<|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~?:=.@])",
    ),
    "c": _lexer(
        r"[\s\ufeff]*(?:\\\r?\n[\s\ufeff]*)*", _SLASH, r'(?P<STR>(?:L|u8|u|U)?"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*")', r"(?P<CHAR>(?:L|u8|u|U)?'(?:[^'\\\n]|\\.)+')", rf"(?P<NUM>{_NUM})", rf"(?P<N>{_ID})",
        r"(?P<P>\.\.\.|<<=|>>=|->|==|!=|<=|>=|<<|>>|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~?:=.])",
    ),
    "go": _lexer(
        _INLINE, r"(?P<L>\n\s*)", _SLASH, r"(?P<STR>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[\\'\"abfnrtv]|\\[0-7]{3}|\\x[\da-fA-F]{2}|\\u[\da-fA-F]{4}|\\U[\da-fA-F]{8})')", r"(?P<NUM>(?:0[xX][\da-fA-F_.]+(?:[pP][-+]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][-+]?\d+)?)i?)",
        rf"(?P<N>{_ID})", r"(?P<P>\.\.\.|<<=|>>=|&\^=|:=|<-|==|!=|<=|>=|<<|>>|&&|\|\||&\^|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~:=.])",
    ),
    "python": _lexer(
        r"[ \t\f]*(?:\\\r?\n[ \t\f]*)*", r"(?P<L>\r?\n(?:[ \t\f]*(?:#[^\n]*)?\r?\n)*[ \t\f]*)", r"(?P<C>#[^\n]*?(?=\r?\n|\Z))",
        r"(?P<STR>(?:[rRbBuUfFtT]{0,2})(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"(?!\"\")|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'(?!'')|\"\"|''))",
        r"(?P<NUM>(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][-+]?\d(?:_?\d)*)?[jJ]?))", rf"(?P<N>{_ID})",
        r"(?P<P>\.\.\.|\*\*=|//=|>>=|<<=|->|:=|==|!=|<=|>=|<<|>>|//|\*\*|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[{}()\[\];,<>+\-*/%&|^~:=.@])",
    ),
}
_LEX["typescript"] = _LEX["javascript"]
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_DIRECTIVE = re.compile(r"(?m)^[ \t]*#(?:[^\n\\]|\\(?:\r\n|[\s\S]))*")
_COND = re.compile(r"[ \t]*#[ \t]*(ifdef|ifndef|if|elif|else|endif)\b[ \t]*([01](?!\w))?")
_HASHBANG = re.compile(r"\A\ufeff?#![^\n]*")
_FSTRING = re.compile(r"(?:[fFtT][rR]?|[rR][fFtT])(?=[\"'])")

# Codes of tokens that a scanner handles itself. Kinds of the grammars lie below; keywords of scripts have _WORD added.
_WORD = 1 << 12
_SKIP, _BREAK, _OPEN, _CLOSE, _DIVIDE, _TICK, _STEP, _FORMAT = (n << 14 for n in range(1, 9))
_INDENT = 1 << 20


class _Kinds(dict):
    """Token text -> code, worked out once per distinct text; emptied when it holds ``LIMIT`` texts."""

    LIMIT = 100_000

    def __init__(self, classify):
        super().__init__()
        self.classify = classify

    def __missing__(self, text):
        code = self.classify(text)
        if len(text) < 200:  # long comments and strings seldom come again
            if len(self) >= self.LIMIT:
                self.clear()
            self[text] = code
        return code


class Language:
    """Lexer and parser of one language."""

    def __init__(self, name: str, ids: dict[str, int], tables):
        self.name, self.ids = name, ids
        self.kind = dict(ids)
        for word, cls in _CLASS[name].items():
            if cls in ids:
                self.kind[word] = ids[cls]
        self.bad = len(ids) + 1
        get = ids.get
        self.script = name in ("javascript", "typescript")
        self.semi = get(";", -1) if self.script or name == "go" else -1
        self.parser = Parser(tables, self.semi if name != "go" else -1)
        self.closers = frozenset({get("}")})
        self.lex, self.classes = _LEX[name]
        self.codes = _Kinds(self._code)
        self.scan = self._scan_script if self.script else {"python": self._scan_python, "go": self._scan_go}.get(name, self._scan_plain)
        if self.script:
            self.value_end = frozenset(x for x in (get(w) for w in ("NAME", "NUM", "STR", "TPL", "TPL_TAIL", "REGEX", ")", "]", "}", "this", "super", "null", "true", "false", "INCR", "PRIV", "async", "of", "get", "set", "static", "from", "as", "type", "accessor")) if x is not None)
        if name == "go":
            self.line_end = frozenset(get(w) for w in ("NAME", "NUM", "STR", ")", "]", "}", "INCR", "break", "continue", "fallthrough", "return"))
        self.known: dict[bytes, tuple | None] = {}

    def _code(self, text: str) -> int:
        m = self.classes.match(text)
        cls = m.lastgroup if m.end() == len(text) else "BAD"
        if cls == "C":
            return _BREAK if "\n" in text and (self.script or self.name == "go") else _SKIP
        if cls == "L":
            if self.name != "python":
                return _BREAK
            width = 0
            for c in text[text.rindex("\n") + 1 :]:
                width = width + 1 if c == " " else (width // 8 + 1) * 8 if c == "\t" else 0
            return _INDENT + width
        if cls == "BAD":
            return _SKIP if self.name != "python" and (text == "\ufeff" or text.isspace()) or text in "\f\t \r" and self.name == "python" else self.bad
        if cls == "T":
            return _TICK
        if cls == "N":
            k = self.kind.get(text, self.ids.get("NAME"))
            return k + _WORD if self.script and k != self.ids["NAME"] else k
        if cls == "P":
            if self.script:
                special = {"{": _OPEN, "}": _CLOSE, "/": _DIVIDE, "/=": _DIVIDE, "++": _STEP, "--": _STEP}.get(text)
            else:
                special = (_OPEN if text in "([{" else _CLOSE if text in ")]}" else None) if self.name == "python" else None
            return special or self.kind.get(text, self.bad)
        if cls == "STR" and self.name == "python" and _FSTRING.match(text):
            return _FORMAT
        return self.ids.get(cls, self.bad)

    # A scanner gives kinds, what places them (see _place) and, for scripts, whether a line break came before.

    def _scan_plain(self, text):
        return [k for k in map(self.codes.__getitem__, self.lex.findall(text)) if k < _WORD], None, None

    def _scan_go(self, text):
        kinds, at = [], []
        semi, ends = self.semi, self.line_end
        last = -1
        for j, k in enumerate(map(self.codes.__getitem__, self.lex.findall(text))):
            if k >= _WORD:
                if k == _SKIP or last not in ends:
                    continue
                k = semi
            kinds.append(k)
            at.append(j)
            last = k
        if last in ends:
            kinds.append(semi)
            at.append(-1)
        return kinds, at, None

    def _scan_script(self, text):
        kinds, at, breaks = [], [], []
        kind, ids, bad, codes = self.kind, self.ids, self.bad, self.codes
        name, value_end = ids["NAME"], self.value_end
        incr, before_incr, dots = ids["INCR"], ids["PREINCR"], (ids["."], ids["?."])
        opened, depth, last = [], 0, -1  # opened: brace depth at each open template
        m = _HASHBANG.match(text)
        end, nl = len(text), False
        step = self.lex.scanner(text, m.end() if m else 0).match
        while (m := step()) is not None:
            k = codes[m[1]]
            if k >= _WORD:
                if k < _SKIP:
                    k = name if last in dots else k - _WORD
                elif k == _SKIP:
                    continue
                elif k == _BREAK:
                    nl = True
                    continue
                elif k == _OPEN:
                    k = ids["{"]
                    depth += 1
                elif k == _STEP:
                    k = before_incr if nl else incr
                elif k == _DIVIDE:
                    k = kind.get(m[1], bad)
                    if last not in value_end and (r := _REGEX.match(text, m.start(1))):
                        k = ids["REGEX"]
                        step = self.lex.scanner(text, r.end()).match
                elif k == _TICK or opened and opened[-1] == depth:
                    t = _TEMPLATE.match(text, m.end())
                    if t is None:
                        k, step = bad, self.lex.scanner(text, end).match
                    else:
                        step = self.lex.scanner(text, t.end()).match
                        done = t.group(1) == "`"
                        if k == _TICK:
                            k = ids["TPL" if done else "TPL_HEAD"]
                            if not done:
                                opened.append(depth)
                        else:
                            k = ids["TPL_TAIL" if done else "TPL_MID"]
                            if done:
                                opened.pop()
                else:
                    k = ids["}"]
                    depth -= 1
            kinds.append(k)
            at.append(m.start(1))
            breaks.append(nl)
            nl = False
            last = k
        return kinds, at, breaks

    def _scan_python(self, text):
        kinds, at = [], []
        ids, bad = self.ids, self.bad
        newline, indent, dedent, string = ids["NEWLINE"], ids["INDENT"], ids["DEDENT"], ids["STR"]
        levels, depth, fresh, width = [0], 0, True, 0
        tokens = self.lex.findall("\n" + text.removeprefix("\ufeff"))  # the line end in front makes a token of the first indentation
        for j, k in enumerate(map(self.codes.__getitem__, tokens)):
            if k == _SKIP:
                continue
            if k >= _INDENT:
                if not depth:
                    if not fresh:
                        kinds.append(newline)
                        at.append(j)
                    fresh, width = True, k - _INDENT
                continue
            if fresh:
                fresh = False
                if width != levels[-1]:
                    if width > levels[-1]:
                        levels.append(width)
                        kinds.append(indent)
                        at.append(j)
                    else:
                        while width < levels[-1]:
                            levels.pop()
                            kinds.append(dedent)
                            at.append(j)
                        if width != levels[-1]:
                            kinds.append(bad)
                            at.append(j)
            if k >= _WORD:
                if k == _FORMAT:
                    k = string if self._fields_hold(tokens[j]) else bad
                else:
                    depth = depth + 1 if k == _OPEN else max(0, depth - 1)
                    k = ids[tokens[j]]
            kinds.append(k)
            at.append(j)
        if not fresh:
            kinds.append(newline)
            at.append(-1)
        for _ in levels[1:]:
            kinds.append(dedent)
            at.append(-1)
        return kinds, at, None

    def _fields_hold(self, token: str) -> bool:
        """Whether each replacement field of a formatted string holds an expression."""
        body = token[_FSTRING.match(token).end() :]
        quote = 3 if body[:3] in ('"""', "'''") else 1
        return all(self._holds(e) for e in fields(body[quote:-quote]))

    def _holds(self, field: str | None) -> bool:
        if field is None or not field.strip():
            return False
        kinds, _, _ = self._scan_python(f"({field.strip()}\n)\n")
        return self.parser.first_error(kinds) < 0

    def _place(self, text: str, at, i: int) -> int:
        """Offset in ``text`` of token ``i``."""
        if self.script:
            return at[i] if i < len(at) else len(text)
        python = self.name == "python"
        starts = [(m.start(1), m[1]) for m in self.lex.finditer("\n" + text.removeprefix("\ufeff") if python else text)]
        if at is None:
            starts = [s for s in starts if self.codes[s[1]] < _WORD]
            return starts[i][0] if i < len(starts) else len(text)
        return max(0, starts[at[i]][0] - python + (python and text.startswith("\ufeff"))) if i < len(at) and at[i] >= 0 else len(text)

    def first_error(self, text: str) -> tuple[int, str] | None:
        """(line from 1, offending text) of the first unrecoverable error, None where there is none.

        C is judged with its conditionals resolved in as many ways as it takes to see every branch.
        """
        ways, wrong = branch_texts(text) if self.name == "c" else ((text,), 0)
        found = [(wrong, text.split("\n")[wrong - 1].strip()[:40])] if wrong else []
        for way in ways:
            kinds, at, breaks = self.scan(way)
            i = self.parser.first_error(kinds, breaks, self.closers)
            if i >= 0:
                pos = self._place(way, at, i)
                found.append((way.count("\n", 0, pos) + 1, way[pos : pos + 40].split("\n", 1)[0]))
        return min(found) if found else None

    def judge(self, text: str) -> tuple[int, str] | None:
        """:meth:`first_error`, once for texts that come again within a task."""
        key = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key not in self.known:
            if len(self.known) >= _Kinds.LIMIT:
                self.known.clear()
            self.known[key] = self.first_error(text)
        return self.known[key]


def fields(body: str):
    """Expressions of the replacement fields of a formatted string's body; None for a field that is not closed."""
    at, end = 0, len(body)
    while at < end:
        c = body[at]
        at += 1
        if c == "\\" and body[at : at + 2] == "N{":
            at = body.find("}", at) + 1 or end
        elif c in "{}" and body[at : at + 1] == c:
            at += 1
        elif c == "}":
            yield None
        elif c == "{":
            start, depth, quote = at, 0, ""
            while at < end:
                c = body[at]
                if quote:
                    quote = "" if c == quote else quote
                elif c in "'\"":
                    quote = c
                elif not depth and (c in "}:" or c == "!" and body[at + 1 : at + 2] != "="):
                    break
                else:
                    depth += (c in "([{") - (c in ")]}")
                at += 1
            if at >= end:
                yield None
                return
            yield re.sub(r"(?<![=!<>])=\s*\Z", "", body[start:at])
            if body[at] == "!":
                at = min((x for x in (body.find(":", at), body.find("}", at)) if x >= 0), default=end - 1)
            start, depth = at, 0
            while at < end and (depth or body[at] != "}"):
                depth += (body[at] == "{") - (body[at] == "}")
                at += 1
            if at >= end:
                yield None
                return
            if "{" in body[start:at]:
                yield from fields(body[start:at])
            at += 1


def branch_texts(text: str) -> tuple[list[str], int]:
    """C texts without preprocessor lines that together show every branch; the line of an unpaired conditional, or 0.

    Lines keep their numbers. The branch of ``#if 0`` and those after ``#if 1`` are never compiled and not shown.
    """
    if "#" not in text:
        return [text], 0
    parts: list[str] = []
    conds: list[list] = []  # [owner, owner's branch, first part of each branch, last part, branches to show, all that count]
    open_: list[int] = []
    last, line, wrong = 0, 1, 0
    for m in _DIRECTIVE.finditer(text):
        parts += [text[last : m.start()], "\n" * m.group().count("\n")]
        line += parts[-2].count("\n")
        last = m.end()
        c = _COND.match(m.group())
        word, constant = (c.group(1), c.group(2)) if c else ("", None)
        if word in ("if", "ifdef", "ifndef"):
            owner = open_[-1] if open_ else -1
            conds.append([owner, len(conds[owner][2]) - 1 if open_ else 0, [len(parts)], 0, [] if word == "if" and constant == "0" else [0], word == "if" and constant == "1", line])
            open_.append(len(conds) - 1)
        elif word and not open_:
            wrong = wrong or line
        elif word == "endif":
            conds[open_.pop()][3] = len(parts)
        elif word:
            now = conds[open_[-1]]
            if not now[5] and not (word == "elif" and constant == "0"):
                now[4].append(len(now[2]))
            now[2].append(len(parts))
        line += parts[-1].count("\n")
    parts.append(text[last:])
    for n in open_:
        conds[n][3] = len(parts)
        wrong = min(wrong or conds[n][6], conds[n][6])
    live = [list(c[4]) for c in conds]
    texts: list[str] = []
    while not texts or any(c[0] < 0 and c[4] for c in conds):
        shown = list(parts)
        picks: list[int | None] = []
        for n, (owner, branch, starts, end, left, _, _) in enumerate(conds):
            seen = owner < 0 or picks[owner] == branch
            pick = (left or live[n] or [-1])[0] if seen else None
            picks.append(pick)
            edges = [*starts, end]
            for b in range(len(starts) if seen else 0):
                if b != pick:
                    shown[edges[b] : edges[b + 1]] = ["\n" * p.count("\n") for p in parts[edges[b] : edges[b + 1]]]
        waiting = set()
        for n in range(len(conds) - 1, -1, -1):
            owner, branch, _, _, left, _, _ = conds[n]
            if picks[n] is not None and left and (n, picks[n]) not in waiting:
                left.remove(picks[n])
            if picks[n] is not None and left:
                waiting.add((owner, branch))
        texts.append("".join(shown))
    return texts, wrong


def build_all() -> dict:
    """Language -> (terminal ids, tables)."""
    out = {}
    for name, (text, tags) in _GRAMMARS.items():
        g = Grammar(text, tags)
        out[name] = (g.ids, build_tables(g))
    return out


_TABLES: dict = {}


def tables() -> dict:
    if not _TABLES:
        _TABLES.update(build_all())
    return _TABLES


_LANGUAGES: dict = {}


def language(name: str, source: dict) -> Language:
    if name not in _LANGUAGES:
        _LANGUAGES[name] = Language(name, *source[name])
    return _LANGUAGES[name]


def language_of(path: str) -> str | None:
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


_OUT = "path string, language string, line int, near string"


def parse_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, language, line, near) of every judged row; line and near are null where the text is valid."""
    source = files.sparkSession.sparkContext.broadcast(tables())

    def run(batches):
        for b in batches:
            ps, ts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in slices(ts, 1 << 20):
                rows = []
                for p, t in zip(ps[i:j], ts[i:j]):
                    name = language_of(p)
                    if name is not None:
                        rows.append((p, name, *(language(name, source.value).judge(t) or (None, None))))
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["path", "language", "line", "near"])

    src = files.select(F.col(path).alias("path"), F.col(content).alias("content")).where("path is not null and content is not null")
    return src.mapInArrow(run, _OUT)


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_files(load(spark, d, "source_texts")).where("line is not null").select("path").distinct()


@query("p6_errors")
def p6_errors(spark: SparkSession, d: str) -> DataFrame:
    """The first error of each file that does not parse."""
    e = parse_files(load(spark, d, "source_texts")).where("line is not null")
    return e.groupBy("path", "language").agg(F.min(F.struct("line", "near")).alias("e")).select("path", "language", "e.line", "e.near")


@query("p6_rates")
def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """Judged and failing files of each repository and language."""
    per = parse_files(load(spark, d, "source_texts")).groupBy("path", "language").agg(F.max(F.when(F.col("line").isNotNull(), 1).otherwise(0)).alias("bad"))
    repos = load(spark, d, "files").groupBy("path").agg(F.max("repo").alias("repo"))
    per = per.join(repos, "path", "left")
    return per.groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum("bad").alias("invalid"), F.round(F.sum("bad") / F.count("*"), 6).alias("rate"))
