"""Problem 2: functions paired with their documentation.

For every file the comments of its text and the descriptions the index holds are the
candidates of one matching. A candidate is scored against the functions near it: parameter
tags that name the function's parameters, words of its name, distance in lines, and, for an
indexed description, the index's own word, which counts less where its tags name other
parameters only and more where the text has it next to the function. Links below
``PLAUSIBLE`` are rejected; the rest is solved as a maximum-weight bipartite assignment, so
each candidate documents one function. Pairs whose description says nothing are dropped.

A file is matched whole. Functions of a file without a text cannot share a comment, so such
files, and only they, are split by a hash where they hold more than ``HOT_FILE`` functions.

Defined results: of repeated ids the least row counts; a null id is dropped; kinds compare
without case and outer white space; functions of files without text are judged by their
indexed description alone; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.registry import query
from codestrata.session import load

HOT_FILE = 20_000
INDEXED, MISFIT, AGREED, PLAUSIBLE = 3.5, 3.0, 3.0, 1.5

# ---------------------------------------------------------------- does a description say anything

_INVISIBLE = re.compile("[\u00ad\u061c\u200b-\u200f\u2028-\u202e\u2060-\u206f\ufeff]")
_MARKS = re.compile(r'^(?:\s|/\*+!?|\*+/|\*(?!\*)|//+[!<]?|#+!?(?!\w)|#(?!region|endregion|pragma)|<!--|-->|"""|\'\'\'|;;+|--+(?=\s))+|(?:\s|\*+/|-->|"""|\'\'\')+$')
_DECORATION = re.compile(r"[\W_]*")
#: Directives to tools, licence lines, region marks, stock phrases and fillers.
_DIRECTIVE = re.compile(
    r"(?i)^(?:noqa\b|type:\s*ignore|nolint|nosec\b|noinspection\b|eslint[-\s]|prettier-ignore|istanbul ignore|c8 ignore|v8 ignore|pragma\b|#pragma\b|clang-(?:format|tidy)|pylint:|flake8:|mypy:|pyright:|isort:|fmt:\s*(?:on|off)|yapf:"
    r"|jshint\b|jslint\b|tslint:|biome-ignore|@ts-|ts-ignore|@formatter:|checkstyle|codecov|coverage:|lint:|go:\w+|\+build\b|-\*-|vim?:|webpack\w+:|@?suppress(?:warnings)?\b|lgtm\b|sonar\b|cspell:|spell-checker:|rubocop:|swiftlint:|stylelint-|shellcheck\b|dprint-ignore|deno-(?:lint|fmt)-|nopep8|export_on_save)"
)
_LICENCE = re.compile(r"(?i)^(?:copyright\b|\(c\)\s|©|spdx-|licen[sc]ed (?:under|to)\b|all rights reserved|distributed under the\b|permission is hereby|released under the\b|this (?:file|code|source code|program) is (?:licen|subject to|part of|free software)|see (?:the )?licen[sc]e\b|@license\b|@copyright\b|use of this source code is governed)")
_REGION = re.compile(r"(?i)^(?:#?\s*(?:end)?region\b|mark:|pragma mark\b|<(?:/)?editor-fold|end of \w+$|begin \w+$|[=\-~*#_+/<>.\s]{3,}[\w ]{0,40}[=\-~*#_+/<>.\s]{3,}$)")
_STOCK = re.compile(
    r"(?i)^(?:(?:todo:?\s*)?(?:auto-?generated|generated|automatically generated)\b.{0,30}\b(?:stub|method|constructor|catch block|block)\b.*|\(non-javadoc\).*|\{?@inheritdoc\}?|see (?:parent|super|base|interface|above|below)\b.{0,20}|(?:creates?|constructs?|initiali[sz]es?) (?:a |an |the )?(?:new )?(?:instance|object)(?: of (?:the |this )?class)?"
    r"|(?:no|missing) (?:description|documentation|docs?|comment)\b.{0,20}|(?:add|write|insert|put|enter|fill in) (?:a |the |some |your )?(?:description|docs?|documentation|comment|summary)(?: here)?|(?:please )?document (?:me|this)|undocumented|not documented|description (?:here|goes here|of \w+)|your (?:description|text|comment) here|lorem ipsum.*|it works|self[- ]explanatory|does (?:stuff|things|something|the thing)|work in progress|wip|fix ?me|to be (?:done|documented|written|determined))\W*$"
)
_TASK = re.compile(r"(?i)^@?(?:todo|fixme|xxx|hack|tbd|bug)\b(?:\s*\([^)]*\))?[\s:\-–—.!]*")
_TAG = re.compile(r"^(?:@|\\|:)(\w+)")
_PARAM_TAG = re.compile(r"^(?:[@\\]|:)(?:param|arg|argument|parameter|property|prop|tparam|keyword|type|typeparam|template)\b\s*:?\s*(\{[^}]*\})?\s*(\[?[\w$.]+(?:=[^\]]*)?\]?)?\s*:?\s*[-–:]?\s*")
_VALUE_TAG = re.compile(r"^(?:[@\\]|:)(?:returns?|rtype|yields?|throws?|raises?|exception)\b\s*(\{[^}]*\})?\s*:?\s*")
_TYPE_ONLY_TAG = re.compile(r"^:(?:rtype|type)\b")
_TEXT_TAG = re.compile(r"^[@\\](?:deprecated|note|warning|remarks?|summary|brief|description|desc|details|classdesc|implnote|apinote|implspec|pre|post|invariant|attention|since|important)\b\s*:?\s*")
_ANY_TAG = re.compile(r"^(?:[@\\]\w[\w.-]*|:\w+[^:]*:)")
_SECTION = re.compile(r"(?i)^(?:args?|arguments|param(?:eter)?s?|returns?|yields?|raises?|throws?|exceptions?|notes?|examples?|usage|attributes|see also|description|summary|details)\s*:?$")
_CODE = re.compile(
    r"^(?:(?:return|throw|raise|yield|await|del|assert|import|from|export|package|goto)\b[^.!?]*(?:[;()\[\]=]|\.\w)|(?:if|for|while|switch|elif|catch|foreach)\s*\(.*\).*[;{})]?$|(?:if|for|while|elif|with|def|class|try|except|else)\b[^.!?]*:$"
    r"|(?:const|let|var|final|static|public|private|protected|int|long|float|double|char|bool|boolean|void|auto|func|fn|def|function)\s+[\w$<>\[\],\s*&]+(?:[=;({:].*)$|[\w$.\[\]\"'>-]+\s*(?:[-+*/%&|^]|<<|>>|\|\||&&|:)?=(?!=)\s*\S.*$|[\w$.>-]+\([^)]*\)(?:\.\w+\([^)]*\))*\s*[;{]?$|.*;\s*$(?<=[)\w\]\"'];)|[{}()\[\];,]+$|</?\w+[^>]*>$|@\w+\(.*\)$)"
)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z\u00df-\u00f6\u00f8-\u024f]+(?:['’][a-z]+)?|\d+(?:\.\d+)?|[^\W\d_A-Za-z\u00c0-\u024f]+|[A-Z\u00c0-\u024f][a-z\u00c0-\u024f]*")
_WIDE = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
#: Words that carry no information of their own in a description.
_GENERIC = frozenset(
    """a an the this that these those of for to in on at by with from and or is are be it its as into if not no do does
    function functions method methods func fn helper helpers utility util utils private public protected internal static constructor ctor
    destructor getter setter accessor getters setters get set gets sets init initialize initializer main class object instance member procedure routine
    subroutine callback handler impl implementation wrapper return returns returned param params parameter parameters arg args argument
    arguments value values type types void none null nil undefined any unknown description desc summary doc docs documentation comment
    test tests testing foo bar baz qux abc asdf qwerty xxx yyy zzz blah bla todo fixme tbd hack wip na placeholder example sample
    here describe write add document insert something stuff thing things code call calls called name new default self cls misc various
    simple basic generic generated auto stub override overrides inherited hidden see section region endregion begin end start""".split()
)


def clean_lines(doc: str) -> list[str]:
    """Lines of a comment without marks, decoration and invisible characters."""
    out = []
    for raw in _INVISIBLE.sub("", doc).replace("\r", "\n").split("\n"):
        before = None
        s = raw.strip()
        while s != before:
            before, s = s, _MARKS.sub("", s).strip()
        if s and not _DECORATION.fullmatch(s):
            out.append(s)
    return out


def stem(w: str) -> str:
    w = w.lower()
    for end, put in (("ies", "y"), ("ied", "y"), ("ing", ""), ("ers", ""), ("es", ""), ("ed", ""), ("er", ""), ("s", "")):
        if w.endswith(end) and len(w) - len(end) + len(put) >= 3:
            w = w[: len(w) - len(end)] + put
            break
    if len(w) > 3 and w[-1] == w[-2]:
        w = w[:-1]
    return w[:-1] if len(w) > 3 and w[-1] == "e" else w


def text_words(s: str) -> list[str]:
    return _WORDS.findall(s.replace("_", " "))


def known_stems(*names: str | None) -> set[str]:
    out = set()
    for n in names:
        if n:
            ws = text_words(unicodedata.normalize("NFC", _INVISIBLE.sub("", n)))
            out |= {stem(w) for w in ws} | {w.lower() for w in ws} | {"".join(ws).lower()}
    return out


def _content(s: str, known: set[str]) -> int:
    """Number of informative words of a line; wide scripts count by characters."""
    n = 0
    for w in text_words(s):
        low = w.lower()
        if _WIDE.search(w):
            n += max(1, len(w) // 2)
        elif low not in _GENERIC and low not in known and stem(w) not in known and (len(w) > 1 or w.isdigit()):
            n += 1
    return n


def says_something(doc: str | None, *names: str | None) -> bool:
    """Whether a description tells something about what the code named ``names`` does or needs."""
    if not doc or not doc.strip():
        return False
    known, total = known_stems(*names), 0
    for s in clean_lines(doc):
        if _DIRECTIVE.match(s) or _LICENCE.match(s) or _REGION.match(s) or _STOCK.match(s) or _SECTION.match(s):
            continue
        local = known
        m = _PARAM_TAG.match(s)
        if m:
            if _TYPE_ONLY_TAG.match(s):
                continue
            local = known | known_stems(m.group(2))
            s = s[m.end() :]
        elif v := _VALUE_TAG.match(s):
            if _TYPE_ONLY_TAG.match(s):
                continue
            s = s[v.end() :]
            if len(text_words(s)) < 2:
                continue
        elif t := _TEXT_TAG.match(s):
            s = s[t.end() :]
        elif t := _TASK.match(s):
            s = s[t.end() :]
            if _content(s, known) < 4:
                continue
        elif _ANY_TAG.match(s):
            continue
        elif _CODE.match(s) and not _WIDE.search(s):
            continue
        if s and not _STOCK.match(s):
            total += _content(s, local)
    return total >= 2


# ---------------------------------------------------------------- candidates and links

_COMMENT_C = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`|(/\*.*?\*/|//[^\n]*(?:\n[ \t]*//[^\n]*)*)', re.S)
_COMMENT_PY = re.compile(r'("""(?:.|\n)*?"""|\'\'\'(?:.|\n)*?\'\'\'|\#[^\n]*(?:\n[ \t]*\#[^\n]*)*)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'')
_TAG_NAMES = re.compile(r"(?m)(?:[@\\]param|:param)\s+(?:\{[^}]*\}\s*)?\[?(\w+)")
_PARAMS = re.compile(r"[\w$]+")
_SQUEEZE = re.compile(r"[\W_]+")


def comments_of(text: str, python: bool) -> list[tuple[int, int, str]]:
    """(first line, last line, raw) of each comment or docstring, lines from 1."""
    out, line, at = [], 1, 0
    for m in (_COMMENT_PY if python else _COMMENT_C).finditer(text):
        raw = m.group(1)
        if raw is None:
            continue
        line += text.count("\n", at, m.start())
        at = m.start()
        out.append((line, line + raw.count("\n"), raw))
    return out


def signature_params(signature: str | None) -> set[str]:
    if not signature or "(" not in signature:
        return set()
    return set(_PARAMS.findall(signature[signature.index("(") :]))


def match_key(doc: str) -> str:
    return _SQUEEZE.sub("", " ".join(clean_lines(doc))).lower()


def max_assignment(weight: dict[tuple[int, int], float]) -> dict[int, int]:
    """Maximum-weight bipartite matching left -> right of a sparse weight map (Hungarian method per component)."""
    best: dict[int, tuple[float, int]] = {}
    for (i, j), w in weight.items():
        if i not in best or (w, -j) > (best[i][0], -best[i][1]):
            best[i] = (w, j)
    if len({j for _, j in best.values()}) == len(best):
        return {i: j for i, (_, j) in best.items()}
    group: dict = {}

    def root(x):
        while group.setdefault(x, x) != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for i, j in weight:
        group[root(("l", i))] = root(("r", j))
    parts: dict = {}
    for i, j in weight:
        parts.setdefault(root(("l", i)), []).append((i, j))
    out = {}
    for edges in parts.values():
        left, right = sorted({i for i, _ in edges}), sorted({j for _, j in edges})
        if len(left) == 1:
            out[left[0]] = best[left[0]][1]
            continue
        flip = len(left) > len(right)  # rows are the smaller side, so the work follows it
        rows, cols = (right, left) if flip else (left, right)
        gain = np.zeros((len(rows), len(cols) + len(rows)))  # a spare column each: staying unmatched gains nothing
        at_row, at_col = {x: k for k, x in enumerate(rows)}, {x: k for k, x in enumerate(cols)}
        gain[:, : len(cols)] = -1e9
        for i, j in edges:
            a, b = (j, i) if flip else (i, j)
            gain[at_row[a], at_col[b]] = weight[i, j]
        for r, c in enumerate(_hungarian(-gain)):
            if c < len(cols):
                i, j = (cols[c], rows[r]) if flip else (rows[r], cols[c])
                if (i, j) in weight:
                    out[i] = j
    return out


def _hungarian(cost: np.ndarray) -> list[int]:
    """Column of each row in a cheapest full assignment of the rows; needs rows <= columns."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match, way = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            free = np.where(used[1:], np.inf, least[1:])
            j1 = int(free.argmin()) + 1
            delta = free[j1 - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def tag_fit(tags: set[str], params: set[str]) -> float:
    """Share of the tags that name parameters; -1 where there are tags and none does."""
    if not tags:
        return 0.0
    return len(tags & params) / len(tags) or -1.0


def link_file(path: str | None, text: str | None, funcs: list[dict]) -> list[tuple]:
    """(index of function, description, origin, score) of the accepted links of a file.

    Candidates are the indexed descriptions and the comments of the text, in one matching. A comment
    that repeats the indexed description of a function next to it is the same candidate. ``origin``:
    'index' for a function's own indexed description, 'moved' for that of another, 'text' for a comment.
    """
    python = bool(path) and path.endswith(".py")
    own = [known_stems(f["name"]) for f in funcs]
    params = [signature_params(f["signature"]) for f in funcs]
    keys = [match_key(f["doc"]) if f["doc"] else "" for f in funcs]
    cands: list[str] = []
    weight: dict[tuple[int, int], float] = {}
    indexed: dict[int, int] = {}  # candidate -> function whose index row holds it
    order = sorted((i for i, f in enumerate(funcs) if f["start_line"] is not None), key=lambda i: funcs[i]["start_line"])
    place = {i: at for at, i in enumerate(order)}
    for i, f in enumerate(funcs):
        if not f["doc"]:
            continue
        tags, j = set(_TAG_NAMES.findall(f["doc"])), len(cands)
        fit = tag_fit(tags, params[i])
        words = known_stems(f["doc"])
        weight[i, j] = INDEXED + 0.5 * len(own[i] & words) / max(1, len(own[i])) + (fit if fit >= 0 else -MISFIT)
        if fit < 0 and text and i in place:  # it may belong to a neighbour without one
            for k in order[max(0, place[i] - 1) : place[i] + 2]:
                if k != i and not funcs[k]["doc"] and tag_fit(tags, params[k]) > 0:
                    weight[k, j] = PLAUSIBLE + 0.5 + tag_fit(tags, params[k])
        indexed[j] = i
        cands.append(f["doc"])
    of = {i: j for j, i in indexed.items()}
    if text:
        starts = [funcs[i]["start_line"] for i in order]
        for first, last, raw in comments_of(text, python):
            doc_string = raw[0] in "\"'"
            lo, hi = (first - 6, first) if doc_string else (last - 4, last + 8)
            near = order[bisect_left(starts, lo) : bisect_right(starts, hi)]
            if not near:
                continue
            tags, names, edges, same = set(_TAG_NAMES.findall(raw)), None, {}, None
            key = match_key(raw) if any(keys[i] for i in near) else ""
            for i in near:
                gap = first - funcs[i]["start_line"] - 1 if doc_string else funcs[i]["start_line"] - last - 1
                score = 1.0 / (1 + gap) if gap >= 0 else 0.3 / (1 - gap)
                if key and keys[i] and key.startswith(keys[i]) and (same is None or score > same[0]):
                    same = score, i
                if gap > 0 or score < 1:
                    names = known_stems(raw) if names is None else names
                    score += 0.5 * len(own[i] & names) / max(1, len(own[i]))
                fit = tag_fit(tags, params[i])
                edges[i] = score + fit if fit >= 0 else score - 0.6
            if same:
                j = of[same[1]]
                weight[same[1], j] += AGREED * same[0]
                edges.pop(same[1])
            else:
                j = len(cands)
                cands.append(raw)
            for i, score in edges.items():
                if score >= 0.5:
                    weight[i, j] = max(score, weight.get((i, j), 0.0))
    weight = {(i, j): w for (i, j), w in weight.items() if w >= (PLAUSIBLE if j in indexed and indexed[j] == i else 0.5)}
    out = []
    for i, j in sorted(max_assignment(weight).items()):
        f = funcs[i]
        origin = "text" if j not in indexed else "index" if indexed[j] == i else "moved"
        if says_something(cands[j], f["name"], (f["fqn"] or "").rsplit(":", 1)[-1].rsplit(".", 1)[-1]):
            out.append((i, "\n".join(clean_lines(cands[j])), origin, weight[i, j]))
    return out


_PAIRS = "id string, file string, name string, kind string, signature string, description string, code string, origin string, score double"


def _pair_batches(with_code):
    def run(batches):
        for b in batches:
            rows = []
            for path, text, funcs in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), b.column("funcs").to_pylist()):
                lines = None
                for i, doc, origin, score in link_file(path, text, funcs):
                    f, code = funcs[i], None
                    if with_code and text and f["start_line"] and f["end_line"]:
                        lines = lines or text.split("\n")
                        code = "\n".join(lines[max(0, f["start_line"] - 1) : f["end_line"]])
                    rows.append((f["id"], path, f["name"], f["kind"], f["signature"], doc, code, origin, score))
            cols = list(zip(*rows)) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols[:8]] + [pa.array(cols[8], pa.float64())], names=[x.split()[0] for x in _PAIRS.split(", ")])

    return run


def doc_pairs(symbols: DataFrame, texts: DataFrame, with_code: bool = True) -> DataFrame:
    """One row per function or method with an informative description linked to it."""
    kind = F.regexp_replace(F.lower(F.regexp_replace("kind", "\\p{Cf}", "")), "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")
    cols = ["file", "name", "fqn", "start_line", "end_line", "signature", "doc"]
    f = symbols.withColumn("kind", kind).where(F.col("kind").isin("function", "method") & F.col("id").isNotNull()).select("id", "kind", *cols)
    f = f.groupBy("id").agg(F.min(F.struct("kind", *cols)).alias("s")).select("id", "s.*")
    text = texts.where("path is not null").groupBy("path").agg(F.max("content").alias("content"))
    hot = f.groupBy("file").agg(F.count("*").alias("c")).where(F.col("c") > HOT_FILE)
    hot = hot.join(texts.select(F.col("path").alias("file")), "file", "left_anti")
    hot = hot.select(F.col("file").alias("hf"), F.ceil(F.col("c") / HOT_FILE).alias("parts"))
    f = f.join(hot, F.col("file").eqNullSafe(F.col("hf")), "left")
    f = f.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)))
    grouped = f.groupBy("file", "salt").agg(F.sort_array(F.collect_list(F.struct("id", "kind", *cols[1:]))).alias("funcs"))
    return grouped.join(text, F.col("file") == F.col("path"), "left").select("file", "content", "funcs").mapInArrow(_pair_batches(with_code), _PAIRS)


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = doc_pairs(load(spark, d, "symbols"), load(spark, d, "source_texts").select("path", "content"), with_code=False)
    return pairs.where("origin = 'index'").select("id").distinct()


@query("p2_pairs")
def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return doc_pairs(load(spark, d, "symbols"), load(spark, d, "source_texts").select("path", "content"))
