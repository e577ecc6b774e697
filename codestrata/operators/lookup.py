"""Point lookups, scopes, line containment and path tests (equi-joins, filters and ranked windows)."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.plans.views import class_of, dirname

#: File extension -> language.
LANGUAGES = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "java": "java", "go": "go", "rs": "rust", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "dart": "dart", "cs": "csharp",
    "php": "php", "rb": "ruby", "c": "c", "h": "cpp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "m": "objc", "mm": "objc",
}


def detect_language(path):
    """Language of a path column by its extension, ``unknown`` for others."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(path, "\\.([A-Za-z]+)$", 1))), F.lit("unknown"))


def refine_header(language, path, head):
    """``.h`` files: Objective-C where the first 8 KiB have its markers, else C++."""
    marks = "(?m)^\\s*(@interface|@protocol|@implementation|@class|@property|#import)\\b"
    return F.when(F.lower(path).endswith(".h") & F.substring(head, 1, 8192).rlike(marks), "objc").otherwise(language)


def is_binary(head):
    return F.instr(F.substring(head, 1, 8192), "\0") > 0


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression over whole paths: ``**`` crosses folders, ``*`` and ``?`` do not, braces alternate."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in pattern[i:]:
            j = pattern.index("]", i)
            out, i = out + "[" + pattern[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        elif c == "{" and "}" in pattern[i:]:
            j = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x) for x in pattern[i + 1 : j].split(",")) + ")", j + 1
        else:
            out, i = out + re.escape(c), i + 1
    return out


def exclude_regex(patterns: list[str]) -> str:
    """One expression for all exclude patterns; a bare name excludes the entry and all below it, anywhere."""
    alts = []
    for p in patterns:
        p = p.strip().rstrip("/")
        if not p:
            continue
        if not re.search(r"[*?\[{/]", p):
            alts += [p, f"{p}/**", f"**/{p}", f"**/{p}/**"]
        else:
            alts += [p] if "/" in p else [p, f"**/{p}"]
    return "^(?:" + "|".join(dict.fromkeys(glob_regex(a) for a in alts)) + ")$" if alts else "(?!)"


def excluded(path, patterns: list[str]):
    return path.rlike(exclude_regex(patterns))


def shallow_first(df: DataFrame, path: str = "path", limit: int | None = None) -> DataFrame:
    out = df.orderBy(F.size(F.split(path, "/")), path)
    return out.limit(limit) if limit else out


def in_scope(symbols: DataFrame, kind: str | None = None, scope: str | None = None) -> DataFrame:
    """Symbols of a kind in a scope; a scope that ends in ``/`` is a folder, else one file."""
    if kind:
        symbols = symbols.where(F.col("kind") == kind)
    if scope:
        symbols = symbols.where(F.startswith("file", F.lit(scope)) if scope.endswith("/") else F.col("file") == scope)
    return symbols


def normalize_path(path: str) -> str | None:
    """A project-relative path, or None where it leaves the project."""
    p = posixpath.normpath(path.replace("\\", "/").lstrip("/") or ".")
    return None if p == ".." or p.startswith("../") else p


def normalize_scope(scopes: DataFrame, files: DataFrame, column: str = "scope") -> DataFrame:
    """``scopes`` with ``normal``: a file of the index or a path that ends in ``/`` as it is, else a folder; null and empty stay null."""
    known = files.select(F.col("path").alias("_p")).distinct()
    c = F.col(column)
    normal = F.when(c.isNull() | (c == ""), None).when(c.endswith("/") | F.col("_p").isNotNull(), c).otherwise(F.concat(c, F.lit("/")))
    return scopes.join(known, c == F.col("_p"), "left").withColumn("normal", normal).drop("_p")


#: ``file[:symbol[:line]]``: the file ends at the first colon after its last separator.
ANCHOR_FILE, ANCHOR_TAIL = r"(?s)^((?:.*[/\\])?[^:/\\]*)(?::.*)?$", r"(?s)^(?:.*[/\\])?[^:/\\]*:(.*)$"


def parse_anchor(raw) -> dict:
    """Columns file, symbol and line of an anchor column.

    A trailing number is a line; of two (``file:line:column``) the first. ``:0`` is no line. A blank anchor has no file.
    """
    bare = lambda c: F.regexp_replace(c, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")
    t = bare(raw)
    tail, last = F.regexp_extract(t, ANCHOR_TAIL, 1), r"(?s)^(.*):(\d+)$"
    end, rest = F.regexp_extract(tail, last, 2), F.when(tail.rlike(last), F.regexp_extract(tail, last, 1)).otherwise(tail)
    number = lambda c: F.when(c.rlike("^\\d{1,9}$") & (c.cast("int") >= 1), c.cast("int"))
    is_line = rest.rlike("^\\d+$")
    symbol = bare(F.when(is_line, "").otherwise(rest))
    file = bare(F.regexp_extract(t, ANCHOR_FILE, 1))
    return {"file": F.when(t != "", file), "symbol": F.when(symbol != "", symbol), "line": F.coalesce(F.when(is_line, number(rest)), number(end))}


def find_symbols(symbols: DataFrame, name: str, limit: int = 10, kind: str | None = None, scope: str | None = None) -> DataFrame:
    """Exact matches first, filled up by case-insensitive prefix matches; (exported, depth, file, name, line) order."""
    hit = in_scope(symbols, kind, scope).where(F.startswith(F.lower("name"), F.lit(name.lower())))
    hit = hit.withColumn("is_exact", (F.col("name") == name).cast("int")).withColumn("depth", F.size(F.split("file", "/")))
    order = [F.desc("is_exact"), F.desc(F.coalesce(F.col("exported"), F.lit(False)).cast("int")), F.col("depth"), F.col("file"), F.col("name"), F.col("start_line"), F.col("id")]
    return hit.orderBy(*order).limit(limit)


def innermost(sites: DataFrame, spans: DataFrame, key: list[str], line: str = "line", nearest: bool = False, stretch: int = 64) -> DataFrame:
    """Each site (``key`` + file + line) with the smallest span of its file around it.

    With ``nearest`` a site outside all spans gets the span that starts nearest, of equally near ones the upper.
    """
    sp = spans.select(F.col("file").alias("_f"), F.col("id").alias("span_id"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    # spans meet sites per stretch of lines, so a file with very many of both isn't a product
    cells = sp.where("_b >= _a").withColumn("_s", F.explode(F.sequence(F.floor(F.col("_a") / stretch), F.floor(F.col("_b") / stretch))))
    j = sites.withColumn("_l", F.floor(F.col(line) / stretch)).join(cells, (F.col("file") == F.col("_f")) & (F.col("_l") == F.col("_s")))
    j = j.where((F.col(line) >= F.col("_a")) & (F.col(line) <= F.col("_b")))
    got = j.groupBy(*key).agg(F.min(F.struct((F.col("_b") - F.col("_a")).alias("cost"), F.col("_a").alias("a"), "span_id")).alias("m")).select(*key, "m.span_id")
    if not nearest:
        return got
    # one pass down and one up the lines of a file: the last start before a site and the first after it
    starts = sp.where("_a is not null").groupBy(F.col("_f").alias("file"), F.col("_a").alias("_at")).agg(F.min("span_id").alias("span_id"))
    rest = sites.where(F.col(line).isNotNull()).join(got.select(*key), key, "left_anti")
    both = rest.select(*key, "file", F.col(line).alias("_at"), F.lit(1).alias("_site"), F.lit(None).cast("string").alias("span_id")).unionByName(
        starts.select(*[F.lit(None).cast(sites.schema[k].dataType).alias(k) for k in key if k != "file"], "file", "_at", F.lit(0).alias("_site"), "span_id")
    )
    mark = F.when(F.col("_site") == 0, F.struct(F.col("_at").alias("a"), "span_id"))
    seen = lambda *order: F.last(mark, ignorenulls=True).over(W.partitionBy("file").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    both = both.withColumn("_up", seen("_at", "_site")).withColumn("_down", seen(F.desc("_at"), "_site")).where("_site = 1")
    away = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("_at") - F.col(f"{c}.a")).alias("d"), F.col(f"{c}.a").alias("a"), F.col(f"{c}.span_id").alias("span_id")))
    near = both.withColumn("m", F.least(away("_up"), away("_down"))).where("m is not null").groupBy(*key).agg(F.min("m").alias("m"))
    return got.unionByName(near.select(*key, "m.span_id"))


def with_class(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("class_name", class_of(F.col("fqn"))).withColumn("is_member", class_of(F.col("fqn")).isNotNull())


def directory_groups(symbols: DataFrame, files: DataFrame, top: int = 7, kinds: int = 3) -> DataFrame:
    """Folders (two path segments) by symbols, each with its most frequent kinds."""
    seg = F.array_join(F.slice(F.split(dirname(F.col("file")), "/"), 1, 2), "/")
    per = symbols.join(files.select("path"), F.col("file") == F.col("path"), "left_semi").groupBy(seg.alias("dir"), "kind").agg(F.count("*").alias("n"))
    total = per.groupBy("dir").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "dir").limit(top)
    rank = F.row_number().over(W.partitionBy("dir").orderBy(F.desc("n"), "kind"))
    return per.join(F.broadcast(total), "dir").withColumn("rank", rank).where(F.col("rank") <= kinds).select("dir", "total", "kind", "n", "rank")


#: Fixed value: names of files that start a program.
ENTRY = "^(index|main|app|server|cli|__main__|__init__)\\.(ts|tsx|js|mjs|cjs|jsx|py|java|go|rs|swift|kt|kts|dart|cs|php|rb|cpp|cc|cxx|c|m)$"


def entry_points(files: DataFrame, symbols: DataFrame, texts: DataFrame, named_first: DataFrame | None = None, limit: int = 15) -> DataFrame:
    """(path, tier): 1 what a package names (``named_first``, path), 2 files named like a start, 3 Python main guards, 4 index files, 5 most exporting files."""
    f = files.select("path", F.lower(F.regexp_extract("path", "[^/]*$", 0)).alias("base"))
    barrel = F.col("base").rlike("^(index|__init__)\\.")
    named = f.where(F.col("base").rlike(ENTRY) & ~barrel).select("path", F.lit(2).alias("tier"))
    guarded = texts.where(F.col("path").endswith(".py") & F.col("content").rlike("(?m)^if __name__ *== *[\"']__main__[\"']"))
    guard = guarded.join(f.select("path"), "path", "left_semi").select("path", F.lit(3).alias("tier"))
    top = symbols.where("exported").groupBy(F.col("file").alias("path")).agg(F.count("*").alias("c")).join(f.select("path"), "path", "left_semi")
    top = top.orderBy(F.desc("c"), "path").limit(limit).select("path", F.lit(5).alias("tier"))
    u = named.unionByName(guard).unionByName(f.where(barrel).select("path", F.lit(4).alias("tier"))).unionByName(top)
    if named_first is not None:
        u = u.unionByName(named_first.join(f.select("path"), "path", "left_semi").select("path", F.lit(1).alias("tier")))
    return u.groupBy("path").agg(F.min("tier").alias("tier")).orderBy("tier", F.size(F.split("path", "/")), "path").limit(limit)
