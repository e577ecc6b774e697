"""Cleaned views over the raw index tables, and the same views as SQL for the checks.

Raw tables repeat rows and carry rows of older runs; each view has one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import load

#: The kinds of symbols, and those that a bare call cannot reach.
SYMBOL_KINDS = ("function", "class", "interface", "type", "variable", "method", "module", "enum")
NON_CALLABLE_KINDS = ("method", "interface", "type", "enum", "module")


def plain(c):
    """Lower case, without outer white space and format characters."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, "\\p{Cf}", "")), "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")


def dirname(c):
    return F.regexp_replace(c, "/?[^/]*$", "")


def class_of(fqn):
    """The class part of ``file:Class.member``; null for top-level names."""
    c = F.regexp_extract(fqn, "^[^:]*:([^.]+)\\.", 1)
    return F.when(c != "", c)


def files(spark: SparkSession, d: str) -> DataFrame:
    """The latest row per path; the commit count is carried over from the last run that had one."""
    raw = load(spark, d, "files").where("path is not null")
    rest = ["last_indexed", "repo", "language", "size", "last_modified", "symbol_count", "content_hash"]
    known = F.when(F.col("commit_frequency").isNotNull(), F.struct("last_indexed", "commit_frequency"))
    got = raw.groupBy("path").agg(F.max(F.struct(*rest)).alias("m"), F.max(known).alias("c"))
    return got.select(
        "path", "m.repo", plain(F.col("m.language")).alias("language"), "m.size", "m.last_modified", "m.last_indexed", "m.symbol_count",
        "m.content_hash", F.col("c.commit_frequency").alias("commit_frequency"),
    )


def symbols(spark: SparkSession, d: str) -> DataFrame:
    raw = load(spark, d, "symbols").where("id is not null")
    cols = [c for c in raw.columns if c != "id"]
    one = raw.groupBy("id").agg(*[F.max(c).alias(c) for c in cols])
    return one.withColumn("kind", plain(F.col("kind"))).withColumn("language", plain(F.col("language")))


def refs(spark: SparkSession, d: str, keep=lambda df: df) -> DataFrame:
    """One row per reference; an endpoint that lies in another file is demoted to null. ``keep`` is applied to what is made on the way."""
    raw = load(spark, d, "symbol_refs").where("ref_id is not null")
    one = keep(raw.groupBy("ref_id").agg(*[F.max(c).alias(c) for c in raw.columns if c != "ref_id"]))
    where = symbols(spark, d).select("id", "file")
    src, dst = where.toDF("sid", "sfile"), where.toDF("tid", "tfile")

    def spread(c):  # most endpoints are null: each gets a key of its own that no id has, so they do not meet in one task
        return F.coalesce(F.col(c), F.concat(F.lit("\0"), F.col("ref_id").cast("string")))

    one = keep(one.join(src, spread("source_id") == F.col("sid"), "left").withColumn("source_id", F.when(F.col("sfile") == F.col("file"), F.col("source_id"))).drop("sid", "sfile"))
    return one.join(dst, spread("target_id") == F.col("tid"), "left").withColumn("target_id", F.when(F.col("tfile") == F.col("file"), F.col("target_id"))).drop("tid", "tfile")


def bindings(spark: SparkSession, d: str) -> DataFrame:
    """One row per imported name; ``local`` is the name it has in the file, (line, source_module, pos) its order."""
    raw = load(spark, d, "file_imports").where("file is not null").dropDuplicates(["file", "source_module", "line", "imported_names"])
    n = raw.select("file", "source_module", "line", F.posexplode("imported_names").alias("pos", "n"))
    return n.select(
        "file", "source_module", "line", "pos", F.col("n.name").alias("name"), F.col("n.alias").alias("alias"),
        F.coalesce("n.kind", F.lit("value")).alias("bind"), F.coalesce("n.alias", "n.name").alias("local"),
    ).distinct()


def commits(spark: SparkSession, d: str, max_files: int | None = 30) -> DataFrame:
    """One row (commit_ord, repo, ts, files) per commit with 1..max_files cleaned, distinct, sorted paths."""
    path = lambda c: F.regexp_replace(F.regexp_replace(c, "\\r$", ""), "^\\./", "")
    tidy = F.array_sort(F.array_distinct(F.filter(F.transform("files", path), lambda x: x.isNotNull() & (x != ""))))
    c = load(spark, d, "raw_commits").where("commit_ord is not null").select("commit_ord", "repo", "ts", tidy.alias("files"))
    c = c.groupBy("commit_ord").agg(F.max("repo").alias("repo"), F.max("ts").alias("ts"), F.max("files").alias("files")).where(F.size("files") > 0)
    return c.where(F.size("files") <= max_files) if max_files else c


_PLAIN = "regexp_replace(lower(regexp_replace({0}, '\\p{{Cf}}', '', 'g')), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
SQL = f"""WITH
f1 AS (SELECT path, max(last_indexed) AS li FROM files WHERE path IS NOT NULL GROUP BY path),
f AS (SELECT x.path, max(repo) AS repo, {_PLAIN.format('max(language)')} AS language, max(size) AS size, max(last_modified) AS last_modified, max(last_indexed) AS last_indexed,
  max(symbol_count) AS symbol_count, max(content_hash) AS content_hash,
  (SELECT max(y.last_indexed * 100000 + y.commit_frequency) % 100000 FROM files y WHERE y.path = x.path)::INT AS commit_frequency
  FROM files x JOIN f1 ON x.path = f1.path AND x.last_indexed = li GROUP BY x.path),
s AS (SELECT id, max(name) AS name, max(fqn) AS fqn, {_PLAIN.format('max(kind)')} AS kind, max(file) AS file, max(start_line) AS start_line, max(end_line) AS end_line,
  max(signature) AS signature, max(doc) AS doc, max(exported::INT) = 1 AS exported, {_PLAIN.format('max(language)')} AS language, max(complexity) AS complexity, max(cognitive) AS cognitive
  FROM symbols WHERE id IS NOT NULL GROUP BY id),
r0 AS (SELECT ref_id, max(source_id) AS source_id, max(target_id) AS target_id, max(target_name) AS target_name, max(kind) AS kind, max(file) AS file, max(line) AS line,
  max(receiver) AS receiver, max(self_receiver::INT) = 1 AS self_receiver FROM symbol_refs WHERE ref_id IS NOT NULL GROUP BY ref_id),
r AS (SELECT r0.* EXCLUDE (source_id, target_id), CASE WHEN a.file = r0.file THEN source_id END AS source_id, CASE WHEN b.file = r0.file THEN target_id END AS target_id
  FROM r0 LEFT JOIN s a ON a.id = source_id LEFT JOIN s b ON b.id = target_id),
b0 AS (SELECT DISTINCT file, source_module, line, generate_subscripts(imported_names, 1) - 1 AS pos, unnest(imported_names) AS n FROM file_imports WHERE file IS NOT NULL),
b AS (SELECT DISTINCT file, source_module, line, pos, n.name AS name, n.alias AS alias, coalesce(n.kind, 'value') AS bind, coalesce(n.alias, n.name) AS local FROM b0),
c0 AS (SELECT commit_ord, max(repo) AS repo, max(ts) AS ts, max(list_sort(list_distinct(list_filter(list_transform(files, lambda p: regexp_replace(regexp_replace(p, '\\r$', ''), '^\\./', '')),
  lambda p: p IS NOT NULL AND p <> '')))) AS files FROM raw_commits WHERE commit_ord IS NOT NULL GROUP BY commit_ord),
c AS (SELECT * FROM c0 WHERE len(files) BETWEEN 1 AND 30),
cf AS (SELECT commit_ord, repo, ts, unnest(files) AS path FROM c)
"""


def sql(text: str) -> str:
    """``text`` (CTEs after the views, then SELECT) with the views before it."""
    t = text.strip()
    return SQL + (t if t.upper().startswith("SELECT") else "," + t)
