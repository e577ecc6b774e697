"""Per-language rules of call resolution, as a table that joins the calls of a language's files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.plans.views import NON_CALLABLE_KINDS, SYMBOL_KINDS, class_of

_DEFAULT = " ".join(k for k in SYMBOL_KINDS if k not in NON_CALLABLE_KINDS)
#: Predeclared names that would flood an index of calls.
_GO_BUILTINS = (
    "append cap clear close complex copy delete imag len make max min new panic print println real recover "
    "any bool byte comparable complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr"
)
#: Fixed values, a row a language: whether a bare call may mean a method of the caller's own class, kinds a bare call
#: may reach, kinds a construction may reach, kinds of types whose repeated names are ambiguous, whether repeated
#: function names are ambiguous, and callees that are left out where nothing in the file has their name.
RULES = {
    "typescript": (False, _DEFAULT, "", "", False, ""),
    "tsx": (False, _DEFAULT, "", "", False, ""),
    "javascript": (False, _DEFAULT, "", "", False, ""),
    "python": (False, _DEFAULT, "", "", False, ""),
    "java": (True, "", "class interface", "class interface enum", False, ""),
    "go": (False, "function", "class type", "class interface type", False, _GO_BUILTINS),
    "rust": (False, "function", "class", "class interface enum type", False, "Some Ok Err"),
    "swift": (True, "function class", "", "class interface enum type", False, ""),
    "kotlin": (True, "function class", "", "class interface enum type", False, ""),
    "dart": (True, "function class", "", "class enum type", False, ""),
    "csharp": (True, "", "class", "class interface enum", False, "nameof"),
    "php": (False, "function", "class", "class", True, ""),
    "ruby": (True, "function method", "class", "class module", True, ""),
    "c": (True, "function", "class", "class", False, ""),
    "cpp": (True, "function", "class", "class", False, ""),
    "objc": (False, "function", "", "class", False, ""),
}
_NAMES = ("own_class", "bare_kinds", "made_kinds", "type_kinds", "once_only", "ignored")


def _table() -> list:
    return [(lang, own, bare.split(), made.split(), types.split(), once, ignored.split()) for lang, (own, bare, made, types, once, ignored) in RULES.items()]


def rule_table(like: DataFrame) -> DataFrame:
    kind = "language string, own_class boolean, bare_kinds array<string>, made_kinds array<string>, type_kinds array<string>, once_only boolean, ignored array<string>"
    return like.sparkSession.createDataFrame(_table(), kind)


def rules_as_values() -> str:
    """The table as SQL."""
    word = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    rows = [f"('{a}', {b}, {word(c)}, {word(d)}, {word(e)}, {f}, {word(g)})" for a, b, c, d, e, f, g in _table()]
    return f"ru(language, {', '.join(_NAMES)}) AS (VALUES " + ",\n  ".join(rows) + ")"


def resolve_by_rules(calls: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_id, resolved_id) of calls (ref_id, source_id, target_name, file, receiver, self_receiver, is_new).

    Everything is looked up in the call's own file: a construction among the kinds that can be
    made, a bare call among the methods of the caller's class where the language has an implicit
    self, then among the kinds it may reach, a member call among the methods of the class it names
    or, on self, of the caller's. Names that could mean two things resolve to nothing. Unresolved
    bare calls of ignored names are left out. Files of other languages follow the default.
    """
    r = F.broadcast(rule_table(calls))
    lang = files.select(F.col("path").alias("file"), F.col("language").alias("l")).join(r, F.col("l") == F.col("language"), "left").drop("l", "language")
    s = symbols.where("name is not null").select("id", "name", "kind", "file", "start_line", class_of(F.col("fqn")).alias("cls")).join(lang, "file", "left")
    first = F.min(F.struct("start_line", "id")).alias("m")
    in_ = lambda c: F.array_contains(F.coalesce(c, F.array().cast("array<string>")), F.col("kind"))
    types = s.where(in_(F.col("type_kinds"))).groupBy("file", "name").agg(F.count("*").alias("n")).where("n > 1").select("file", "name")
    twice = s.where("once_only and kind = 'function'").groupBy("file", "name").agg(F.count("*").alias("n")).where("n > 1").select("file", "name")
    bare = s.where(in_(F.coalesce("bare_kinds", F.array(*[F.lit(k) for k in _DEFAULT.split()])))).join(twice, ["file", "name"], "left_anti")
    bare = bare.groupBy("file", F.col("name").alias("target_name")).agg(first).select("file", "target_name", F.col("m.id").alias("bare_id"))
    made = s.where(in_(F.col("made_kinds"))).join(types, ["file", "name"], "left_anti").groupBy("file", F.col("name").alias("target_name")).agg(first).select("file", "target_name", F.col("m.id").alias("made_id"))
    methods = s.where("kind = 'method' and cls is not null").join(types.withColumnRenamed("name", "cls"), ["file", "cls"], "left_anti")
    methods = methods.groupBy("file", "cls", F.col("name").alias("target_name")).agg(first).select("file", F.col("cls").alias("owner"), "target_name", F.col("m.id").alias("method_id"))
    caller = s.where("cls is not null").select(F.col("id").alias("sid"), F.col("cls").alias("caller_cls"))
    # calls at module level have no caller: a key of their own keeps them apart
    key = F.coalesce("source_id", F.concat(F.lit("\0"), F.col("ref_id").cast("string")))
    c = calls.join(caller, key == F.col("sid"), "left").join(lang.select("file", "own_class", "ignored"), "file", "left")
    new, on_self = F.coalesce("is_new", F.lit(False)), F.coalesce("self_receiver", F.lit(False))
    implicit = F.col("receiver").isNull() & F.coalesce("own_class", F.lit(False))
    c = c.withColumn("owner", F.when(on_self | implicit, F.col("caller_cls")).otherwise(F.col("receiver")))
    c = c.join(bare, ["file", "target_name"], "left").join(made, ["file", "target_name"], "left").join(methods, ["file", "owner", "target_name"], "left")
    got = F.when(F.col("receiver").isNotNull(), F.col("method_id")).when(new, F.col("made_id")).otherwise(F.coalesce("method_id", "bare_id"))
    noise = F.col("receiver").isNull() & ~new & F.array_contains(F.coalesce("ignored", F.array().cast("array<string>")), F.col("target_name"))
    return c.withColumn("resolved_id", got).where(F.col("resolved_id").isNotNull() | ~F.coalesce(noise, F.lit(False))).select("ref_id", "resolved_id")
