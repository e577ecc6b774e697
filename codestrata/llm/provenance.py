"""Problem 4: generated, minified, vendored files and data wrapped as code.

Third-party copies. Every file becomes a set of line hashes: three consecutive lines that
carry text, without white space at their ends. Files with the same set are one form. The
inverted index leads from a hash to the forms that hold it. A hash is rare if at most ``RARE``
forms have it, or if a form that several repositories hold whole has it, however widely it is
copied. A file is vendored if one single form of another repository contains at least
``CONTAINED`` of its hashes as rare ones, or at least ``ALIKE`` of its hashes, rare or not: so the
lines that everyone has do not make a copy of a file with work of its own, but a text that very many
repositories keep, each with changes of its own, is still found. All forms count as sources, not only
those that the index proposes. So a file that is put together from idioms of many repositories is
no copy, and nothing is ever paired within a group.

A text of fewer than ``MIN_HASHES`` such passages but at least ``SOLID`` characters has one
hash, that of all its lines; shorter ones (a stock script, an error page) are nobody's work in
particular and are left to the rules. All copies are cases: which repository had the text
first cannot be seen from the texts.

Remaining files go through token-composition rules: a tool's mark in the leading comment,
definitions of one shape with running numbers (accessors from a tool), long dense lines
(minified), literals that outweigh everything else (data), a comment at the top that gives the file's own name
with a version (a library's banner).

Defined results: null or empty texts are no case; of repeated rows of a path any case
counts; the folder's name is never looked at, but for the repository, which is the path's
first segment; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.llm.registry import query
from codestrata.llm.skew import join_by_key, salted_join
from codestrata.session import cut, load, shuffle_width

LINES, MIN_HASHES, SOLID, CONTAINED, ALIKE, RARE = 3, 8, 400, 0.5, 2 / 3, 16
#: Only chooses the cheaper of two ways to the same counts.
WHOLE = 4

_STR = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
_LEX_C = re.compile(rf"/\*.*?(?:\*/|\Z)|//[^\n]*|{_STR}|`(?:\\.|[^`\\])*`", re.S)
_LEX_PY = re.compile(rf'(?m:^)[ \t]*"""(?:.|\n)*?(?:"""|\Z)|"""(?:.|\n)*?(?:"""|\Z)|#[^\n]*|{_STR}')
_IDENT = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"\b\d[\w.]*")
_IMPORT = re.compile(r"(?:import|from|package|using|include|#\s*include|use|require)\b|#include")
_CONTROL = re.compile(r"(?:if|for|while|switch|else|elif|return|catch|try|do|case|with)\b")
_DEFINES = re.compile(r"[^=]*\w\s*\([^;]*\)[^;=]*[{:]")
_SIGNS = re.compile(r"^(?:/\*+|\*+/?|//+[/!]?|#+!?|<!--|--+|;+)\s*")
#: How tools mark their output, at the start of a comment line or anywhere in one.
_MARKER = re.compile(
    r"(?i)(?:@generated\b|<auto-?generated\b|(?:this (?:file|code) (?:was|is|has been) )?(?:code |file )?(?:auto-?|automatically )?generated (?:file|by|from|with|code|using)\b"
    r"|auto-?generated\b(?! method| stub)|this file was (?:produced|created|made) (?:by|with)\b|code generated by\b|output of the \w+ (?:compiler|generator)\b"
    r"|do not (?:edit|modify|change)\s*(?:$|[^\w\s]|(?:this|the) (?:file|code)\b|by hand\b|manually\b|directly\b)"
    r"|automatisch (?:erzeugt|generiert)\b|fichier généré\b|généré automatiquement\b|generado automáticamente\b|archivo generado\b|自动生成)"
)
_MARK_WITHIN = re.compile(r"(?i)\b(?:generated|produced|created) (?:by|from|with|using)\b.*\bdo not (?:edit|modify|change)\b|\bdo not (?:edit|modify|change)\b.*\bgenerated\b")
#: How libraries head their files.
_BANNER = re.compile(r"(?i)^\S+ v?\d+\.\d+(?:\.\d+)*\s*(?:\||-)\s*(?:\(c\)|copyright\b|released under\b|licensed under\b|(?:mit|bsd|apache)\b)")
_VERSION = r"[\s,@:-]+(?:v|version |release )?\d+\.\d+"
_NAMED = re.compile(r"[A-Za-z_]\w*?(\d+)\s*\(")


def code_lines(text: str) -> list[str]:
    return [s for s in (x.strip() for x in text.splitlines()) if len(s) > 3]


def _signed(value) -> int:
    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


def passages(text: str) -> set[int]:
    """The hashes by which a text is compared: of its passages, or of all its lines where it has few but long ones."""
    got = line_hashes(text)
    if len(got) >= MIN_HASHES:
        return got
    whole = "\n".join(code_lines(text))
    return {_signed(whole)} if len(whole) >= SOLID else set()


def line_hashes(text: str) -> set[int]:
    """Signed 64-bit hashes of each LINES consecutive lines with text."""
    ls = code_lines(text)
    return {_signed("\n".join(ls[i : i + LINES])) for i in range(len(ls) - LINES + 1)}


def leading_comments(text: str, python: bool) -> list[str]:
    """All comment lines before the first line of code, without their signs."""
    out = []
    for raw in text.splitlines():
        s = raw.strip()
        if not s:
            continue
        if not (s.startswith("#") if python else s.startswith(("//", "/*", "*"))):
            break
        out.append(_SIGNS.sub("", s).strip())
    return out


def split_code(text: str, python: bool) -> tuple[str, int]:
    """(code with strings as "" and without comments, characters in string literals)."""
    chars = 0

    def swap(m):
        nonlocal chars
        s = m.group(0)
        if python:
            if s[0] == "#" or s.lstrip()[:3] == '"""' and (s[0] in " \t" or m.start() == 0 or text[m.start() - 1] == "\n"):
                return " "
        elif s[:2] in ("/*", "//"):
            return " "
        chars += len(s)
        return '""'

    return (_LEX_PY if python else _LEX_C).sub(swap, text), chars


def composition(path: str, text: str) -> str | None:
    """``generated``, ``minified``, ``data``, ``vendored`` or None, from one file alone."""
    python = path.endswith(".py")
    head = leading_comments(text, python)
    if any(_MARKER.match(h) or _MARK_WITHIN.search(h) for h in head):
        return "generated"
    stem = path.rsplit("/", 1)[-1].split(".", 1)[0]
    named = re.compile(rf"(?i)\b{re.escape(stem)}{_VERSION}") if len(stem) > 3 else None
    if any(_BANNER.match(h) or named and named.search(h) for h in head[:3]):
        return "vendored"
    code, strings = split_code(text, python)
    lines = [s for s in (x.strip() for x in code.splitlines()) if s]
    if not lines:
        return None
    literal = strings + sum(map(len, _NUMBER.findall(code)))
    solid = sum(map(len, "".join(lines).split())) + strings
    if literal >= 200 and literal > 0.62 * solid:
        return "data"
    size = sum(map(len, lines))
    if size >= 200 and size / len(lines) >= 120 and sum(x.count(" ") for x in lines) < 0.12 * size:
        return "minified"
    shapes, members, numbers = Counter(), Counter(), {}
    for s in lines:
        if not _IMPORT.match(s) and _IDENT.search(s):
            shape = _NUMBER.sub("0", _IDENT.sub("a", s))
            shapes[shape] += 1
            if _DEFINES.match(s) and not _CONTROL.match(s):
                members[shape] += 1
                if m := _NAMED.search(s):
                    numbers.setdefault(shape, []).append(int(m.group(1)))
    # a tool's members: definitions of one shape whose names count upwards, and little besides them and one line of body
    if members:
        shape, n = members.most_common(1)[0]
        steps = sum(y == x + 1 for x, y in zip(numbers.get(shape, []), numbers.get(shape, [])[1:]))
        if n >= 8 and steps >= 0.8 * (n - 1) and sum(k for _, k in shapes.most_common(2)) >= 0.8 * sum(shapes.values()):
            return "generated"
    return None


def _rows(batches):
    for b in batches:
        ps, ts = b.column(0).to_pylist(), b.column(1).to_pylist()
        sets = [sorted(passages(t)) for t in ts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ps, pa.string()), pa.array([_signed(p.split("/", 1)[0]) for p in ps], pa.int64()), pa.array([composition(p, t) for p, t in zip(ps, ts)], pa.string()),
                pa.array([_signed(np.array(s, np.int64).tobytes()) if s else None for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64())),
            ],
            names=["path", "repo", "kind", "form", "hashes"],
        )


_ROWS = "path string, repo long, kind string, form long, hashes array<long>"


def _copied():
    """Whether a source that holds ``held`` of the ``size`` hashes of a form, ``rare`` of them rare, makes it a copy."""
    return (F.col("rare") >= CONTAINED * F.col("size")) | (F.col("held") >= ALIKE * F.col("size"))


def containment(rows: DataFrame) -> DataFrame:
    """(form, files, contained) of each form of a text that one form of another repository contains.

    A form is a set of hashes; files with equal sets are one form, and one found in several repositories is
    a copy of itself (1.0). The index proposes up to three sources for a hash, which settles the forms that
    most copies of a text are. Every other form meets all forms that can contain it: such a form misses so
    few of its shared hashes that it has one of the most seldom few. ``contained`` is the share of all hashes in
    one source that suffices, the fullest of those compared; there may be a fuller one.
    """
    forms = rows.where("form is not null").groupBy("form").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi"), F.count("*").alias("files"), F.first("hashes").alias("hashes"))
    forms = forms.select("form", "files", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("repo"), "hashes")
    posts = forms.select("form", "files", "repo", F.size("hashes").alias("size"), F.explode("hashes").alias("hash"))
    known = posts.groupBy("hash").agg(F.count("*").alias("df"), F.max(F.col("repo").isNull()).alias("library"), F.min("repo").alias("lo"), F.max("repo").alias("hi"))
    known = known.where("df > 1 and (library or lo <> hi)").select("hash", "df", (F.col("library") | (F.col("df") <= RARE)).cast("int").alias("rare"))
    posts = cut(join_by_key(posts, known, ["hash"], F.col("df")))  # what is found in one form or one repository only is gone
    source = F.struct("form", "repo")
    first = F.struct(F.col("repo").isNull(), "files", "form", "repo")  # the most copied form: a library before a file
    index = posts.groupBy("hash").agg(F.max("df").alias("df"), F.max(F.struct(first.alias("o"), source.alias("s"))).alias("a"), F.min(F.struct("repo", source.alias("s"))).alias("b"), F.max(F.struct("repo", source.alias("s"))).alias("c"))
    index = index.select("hash", "df", F.array("a.s", "b.s", "c.s").alias("sources"))
    own = posts.where("repo is not null")
    sums = F.first("size").alias("size"), F.sum("rare").alias("rare"), F.count("*").alias("held")
    votes = join_by_key(own.drop("df"), index, ["hash"], F.col("df")).select("form", "size", "rare", F.col("repo").alias("home"), F.explode(F.array_distinct("sources")).alias("s"))
    votes = votes.where("s.form <> form and (s.repo is null or s.repo <> home)").groupBy("form", F.col("s.form").alias("source")).agg(*sums).where(_copied())
    settled = cut(votes.groupBy("form").agg(F.max(F.struct("held", "source")).alias("m")).select("form", "m.source"))
    # of the rest, those that all others together could contain; a source has ``need`` of such a form's hashes
    rest = own.groupBy("form").agg(*sums).where(_copied()).join(settled, "form", "left_anti")
    half, most = F.ceil(CONTAINED * F.col("size")), F.ceil(ALIKE * F.col("size"))
    rest = rest.select("form", (F.col("rare") - half).alias("few_rare"), (F.col("held") - most).alias("few"), F.when(F.col("rare") >= half, half).otherwise(most).alias("need"))
    seldom = Window.partitionBy("form").orderBy("df", "hash").rowsBetween(Window.unboundedPreceding, 0)
    lead = F.expr("i <= few or rare = 1 and j <= few_rare")
    begin = own.join(rest, "form").repartition(shuffle_width(rows.sparkSession), "form")  # few rows that meet very many
    begin = begin.withColumn("i", F.count("*").over(seldom) - 1).withColumn("j", F.sum("rare").over(seldom) - 1).withColumn("lead", lead)
    # where the seldom ones are met about as often as all, all are counted at once; else the pairs they find are compared
    led = F.sum(F.when(F.col("lead"), F.col("df"))).over(Window.partitionBy("form"))
    begin = begin.withColumn("whole", F.sum("df").over(Window.partitionBy("form")) <= WHOLE * led)
    begin = cut(begin.where("lead or whole").select("form", "files", "size", "rare", F.col("repo").alias("home"), "need", "whole", "hash"))
    theirs = posts.select(F.col("form").alias("source"), F.col("repo").alias("there"), F.col("size").alias("has"), "hash")
    met = salted_join(begin, theirs, ["hash"]).where("source <> form and has >= need and (there is null or there <> home)")
    met = cut(met.groupBy("form", "files", "source", "whole").agg(*sums).where(~F.col("whole") | _copied()))
    pairs = settled.unionByName(met.where(~F.col("whole")).select("form", "source"))
    full = pairs.join(own.select("form", "files", "size", "rare", "hash"), "form").join(theirs.select("source", "hash"), ["source", "hash"])
    full = full.groupBy("form", "files", "source").agg(*sums).where(_copied()).unionByName(met.where("whole").drop("whole"))
    found = full.groupBy("form", "files").agg(F.max(F.col("held") / F.col("size")).alias("contained"))
    return found.unionByName(forms.where("repo is null").select("form", "files", F.lit(1.0).alias("contained")))


def provenance(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, kind, containment) of every file that is not hand-written."""
    texts = files.select(F.col(path).alias("path"), F.col(content).alias("content")).where("path is not null and content <> ''")
    rows = cut(texts.mapInArrow(_rows, _ROWS))
    copies = join_by_key(rows.where("form is not null").select("path", "form"), cut(containment(rows)), ["form"], F.col("files"))
    cases = copies.select("path", F.lit("vendored").alias("kind"), "contained").unionByName(rows.where("kind is not null").select("path", "kind", F.lit(0.0).alias("contained")))
    best = F.max(F.struct("contained", "kind")).alias("m")
    return cases.groupBy("path").agg(best).select("path", F.col("m.kind").alias("kind"), F.round("m.contained", 6).alias("containment"))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance(load(spark, d, "source_texts")).select("path")


@query("p4_kinds")
def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Files, symbols and mean complexity of each language and kind of origin."""
    found = provenance(load(spark, d, "source_texts"))
    syms = load(spark, d, "symbols").groupBy("file", "id").agg(F.max(F.coalesce("complexity", F.lit(1))).alias("cx"))
    per = syms.groupBy("file").agg(F.count("*").alias("n"), F.sum("cx").alias("cx"))
    lang = F.lower(F.regexp_extract("path", "\\.([A-Za-z]+)$", 1))
    return (
        found.join(per, F.col("path") == F.col("file"), "left").groupBy(lang.alias("extension"), "kind")
        .agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"), F.round(F.sum("cx") / F.sum("n"), 6).alias("mean_complexity"))
    )
