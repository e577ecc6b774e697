"""Queries over files, symbols and commits: lookups, statistics, history, maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions import expressions as X
from codestrata.operators import history, lookup, maintain
from codestrata.plans import call_queries, views
from codestrata.plans.catalog import query
from codestrata.plans.views import sql
from codestrata.session import load


@query("index_stats_by_language", sql("SELECT language, count(*) AS files, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM f GROUP BY language"))
def index_stats_by_language(spark: SparkSession, d: str) -> DataFrame:
    f = views.files(spark, d)
    total = f.count()
    return f.groupBy("language").agg(F.count("*").alias("files")).withColumn("share", F.round(F.lit(100.0) * F.col("files") / F.lit(total), 6))


@query("symbols_by_kind_dense", sql("""k(kind) AS (VALUES ('function'), ('class'), ('interface'), ('type'), ('variable'), ('method'), ('module'), ('enum'))
SELECT k.kind, count(s.id) AS symbols, count(*) FILTER (WHERE s.exported) AS exported FROM k LEFT JOIN s ON s.kind = k.kind GROUP BY k.kind"""))
def symbols_by_kind_dense(spark: SparkSession, d: str) -> DataFrame:
    n = views.symbols(spark, d).groupBy("kind").agg(F.count("*").alias("symbols"), F.count_if("exported").alias("exported"))
    kinds = spark.createDataFrame([(k,) for k in views.SYMBOL_KINDS], "kind string")
    return kinds.join(n, "kind", "left").fillna(0, ["symbols", "exported"])


@query("directory_groups_top", sql("""
p AS (SELECT array_to_string(string_split(regexp_replace(file, '/?[^/]*$', ''), '/')[1:2], '/') AS dir, kind, count(*) AS n FROM s WHERE file IN (SELECT path FROM f) GROUP BY ALL),
t AS (SELECT dir, sum(n)::BIGINT AS total FROM p GROUP BY dir ORDER BY total DESC, dir LIMIT 7)
SELECT * FROM (SELECT dir, total, kind, n, row_number() OVER (PARTITION BY dir ORDER BY n DESC, kind) AS rank FROM p JOIN t USING (dir)) WHERE rank <= 3"""))
def directory_groups_top(spark: SparkSession, d: str) -> DataFrame:
    return lookup.directory_groups(views.symbols(spark, d), views.files(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


_ENTRY = lookup.ENTRY


@query("entry_point_tiers", sql(f"""
n AS (SELECT path, lower(regexp_extract(path, '[^/]*$')) AS base FROM f),
ex AS (SELECT file AS path, count(*) AS c FROM s WHERE exported GROUP BY file),
u AS (SELECT path, 2 AS tier FROM n WHERE regexp_matches(base, '{_ENTRY}') AND NOT regexp_matches(base, '^(index|__init__)\\.')
  UNION SELECT st.path, 3 FROM source_texts st JOIN n USING (path) WHERE ends_with(st.path, '.py') AND regexp_matches(st.content, '(?m)^if __name__ *== *["'']__main__["'']')
  UNION SELECT path, 4 FROM n WHERE regexp_matches(base, '^(index|__init__)\\.') UNION (SELECT path, 5 FROM ex JOIN n USING (path) ORDER BY c DESC, path LIMIT 15))
SELECT path, min(tier) AS tier FROM u GROUP BY path ORDER BY tier, len(string_split(path, '/')), path LIMIT 15"""))
def entry_point_tiers(spark: SparkSession, d: str) -> DataFrame:
    return lookup.entry_points(views.files(spark, d), views.symbols(spark, d), load(spark, d, "source_texts"))


@query("exporter_ranking", sql("SELECT file, count(*) AS exports FROM s WHERE exported AND file IN (SELECT path FROM f) GROUP BY file ORDER BY exports DESC, file LIMIT 20"))
def exporter_ranking(spark: SparkSession, d: str) -> DataFrame:
    s = views.symbols(spark, d).where("exported").join(views.files(spark, d).select(F.col("path").alias("file")), "file", "left_semi")
    return s.groupBy("file").agg(F.count("*").alias("exports")).orderBy(F.desc("exports"), "file").limit(20)


@query("find_exact_then_prefix", sql("""SELECT id, name, kind, file, start_line, (name = 'parse')::INT AS is_exact FROM s WHERE starts_with(lower(name), 'parse')
ORDER BY is_exact DESC, coalesce(exported, false)::INT DESC, len(string_split(file, '/')), file, name, start_line, id LIMIT 100"""))
def find_exact_then_prefix(spark: SparkSession, d: str) -> DataFrame:
    return lookup.find_symbols(views.symbols(spark, d), "parse", 100).select("id", "name", "kind", "file", "start_line", "is_exact")


@query("scope_filter_prefix", sql("SELECT id, name, file FROM s WHERE kind = 'method' AND starts_with(file, 'amber-forge/')"))
def scope_filter_prefix(spark: SparkSession, d: str) -> DataFrame:
    return lookup.in_scope(views.symbols(spark, d), "method", "amber-forge/").select("id", "name", "file")


_NEAR = """
j AS (SELECT r.ref_id, s.id AS span_id, s.start_line AS a, s.end_line AS b, r.line FROM r JOIN s ON s.file = r.file WHERE s.start_line IS NOT NULL {0}),
q AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY (NOT (line BETWEEN a AND b))::INT, CASE WHEN line BETWEEN a AND b THEN b - a ELSE abs(line - a) END, a, span_id) AS rn FROM j)
SELECT ref_id, span_id FROM q WHERE rn = 1"""


@query("innermost_enclosing", sql(_NEAR.format("AND r.line BETWEEN s.start_line AND s.end_line")))
def innermost_enclosing(spark: SparkSession, d: str) -> DataFrame:
    return lookup.innermost(views.refs(spark, d), views.symbols(spark, d).where("start_line is not null"), ["ref_id"])


@query("pick_by_line_fallback", sql(_NEAR.format("")))
def pick_by_line_fallback(spark: SparkSession, d: str) -> DataFrame:
    return lookup.innermost(views.refs(spark, d), views.symbols(spark, d).where("start_line is not null"), ["ref_id"], nearest=True)


@query("fqn_class_parse", sql("SELECT id, nullif(regexp_extract(fqn, '^[^:]*:([^.]+)\\.', 1), '') AS class_name, coalesce(regexp_extract(fqn, '^[^:]*:([^.]+)\\.', 1) <> '', false) AS is_member FROM s"))
def fqn_class_parse(spark: SparkSession, d: str) -> DataFrame:
    return lookup.with_class(views.symbols(spark, d)).select("id", "class_name", "is_member")


EXCLUDES = ["node_modules", "vendor", "*.min.js", "**/generated/**", "lib/*/tiny*"]


@query("exclude_glob_filter", sql("""SELECT path FROM f WHERE NOT regexp_matches(path, '(^|/)(node_modules|vendor)(/|$)') AND NOT regexp_matches(path, '(^|/)[^/]*\\.min\\.js$')
AND NOT regexp_matches(path, '(^|/)generated/') AND NOT regexp_matches(path, '^lib/[^/]*/tiny[^/]*$')"""))
def exclude_glob_filter(spark: SparkSession, d: str) -> DataFrame:
    return views.files(spark, d).where(~lookup.excluded(F.col("path"), EXCLUDES)).select("path")


@query("language_detection", sql("""SELECT path, CASE WHEN ext IN ('ts', 'mts', 'cts') THEN 'typescript' WHEN ext IN ('js', 'mjs', 'cjs', 'jsx') THEN 'javascript' WHEN ext IN ('py', 'pyi') THEN 'python'
WHEN ext IN ('java', 'go', 'c') THEN ext WHEN ext = 'h' THEN 'cpp' ELSE 'unknown' END AS detected FROM (SELECT path, lower(regexp_extract(path, '\\.([A-Za-z]+)$', 1)) AS ext FROM f)"""))
def language_detection(spark: SparkSession, d: str) -> DataFrame:
    return views.files(spark, d).select("path", lookup.detect_language(F.col("path")).alias("detected"))


@query("unknown_extensions", sql("SELECT lower(regexp_extract(path, '\\.([A-Za-z]+)$', 1)) AS extension, count(*) AS files FROM f WHERE language = 'unknown' GROUP BY 1 ORDER BY files DESC, extension LIMIT 5"))
def unknown_extensions(spark: SparkSession, d: str) -> DataFrame:
    f = views.files(spark, d).where("language = 'unknown'")
    return f.groupBy(F.lower(F.regexp_extract("path", "\\.([A-Za-z]+)$", 1)).alias("extension")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "extension").limit(5)


@query("shallow_first", sql("SELECT path, len(string_split(path, '/')) AS depth FROM f ORDER BY depth, path LIMIT 100"))
def shallow_first(spark: SparkSession, d: str) -> DataFrame:
    return lookup.shallow_first(views.files(spark, d).select("path", F.size(F.split("path", "/")).cast("bigint").alias("depth")), limit=100)


@query("content_hash_dups", sql("SELECT substring(sha1(content), 1, 16) AS hash, count(DISTINCT path) AS paths, min(path) AS first_path FROM source_texts WHERE content <> '' GROUP BY 1 HAVING count(DISTINCT path) > 1"))
def content_hash_dups(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "source_texts").where("content <> ''").select("path", maintain.content_hash(F.col("content")).alias("hash"))
    return t.groupBy("hash").agg(F.count_distinct("path").alias("paths"), F.min("path").alias("first_path")).where("paths > 1")


@query("commit_counts", sql("SELECT repo, path, count(*) AS commits FROM cf GROUP BY ALL"))
def commit_counts(spark: SparkSession, d: str) -> DataFrame:
    return history.commit_counts(views.commits(spark, d))


@query("commit_counts_hotspots", sql("SELECT path, repo, count(*) AS commits FROM cf WHERE path IN (SELECT path FROM f) GROUP BY ALL ORDER BY commits DESC, path LIMIT 50"))
def commit_counts_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return history.hotspots(history.commit_counts(views.commits(spark, d)), views.files(spark, d)).select("path", "repo", "commits")


_PAIRS = """
n AS (SELECT repo, path, count(*) AS k FROM cf GROUP BY ALL),
pr AS (SELECT x.repo, x.path AS file_a, y.path AS file_b, count(*) AS shared, max(x.ts) AS last_seen FROM cf x JOIN cf y ON x.commit_ord = y.commit_ord AND x.path < y.path GROUP BY ALL HAVING count(*) >= 3),
cp AS (SELECT pr.repo, file_a, file_b, shared, round(shared / a.k, 9) AS conf_ab, round(shared / b.k, 9) AS conf_ba, last_seen FROM pr JOIN n a ON a.repo = pr.repo AND a.path = file_a JOIN n b ON b.repo = pr.repo AND b.path = file_b
  WHERE file_a IN (SELECT path FROM f) OR file_b IN (SELECT path FROM f)),
d2 AS (SELECT repo, file_a AS file, file_b AS partner, shared, conf_ab AS conf FROM cp UNION ALL SELECT repo, file_b, file_a, shared, conf_ba FROM cp),
pa AS (SELECT *, greatest(1, floor(conf * 100 + 0.5))::INT AS pct, row_number() OVER (PARTITION BY repo, file ORDER BY shared DESC, partner) AS rk FROM d2)"""


@query("cochange_pairs", sql(_PAIRS + " SELECT * FROM cp"))
def cochange_pairs(spark: SparkSession, d: str) -> DataFrame:
    return history.cochange(views.commits(spark, d), views.files(spark, d))


@query("cochange_partners_topk", sql(_PAIRS + """ SELECT file, partner, shared, pct, rank FROM (SELECT file, partner, shared, pct, row_number() OVER (PARTITION BY repo, file ORDER BY pct DESC, shared DESC, partner) AS rank FROM pa WHERE rk <= 20) WHERE rank <= 5"""))
def cochange_partners_topk(spark: SparkSession, d: str) -> DataFrame:
    return history.partners(history.cochange(views.commits(spark, d), views.files(spark, d)), 20, 5).select("file", "partner", "shared", "pct", "rank").withColumn("rank", F.col("rank").cast("bigint"))


@query("cochange_missing_partner", sql(_PAIRS + """,
ch AS (SELECT DISTINCT path FROM cf WHERE commit_ord IN (SELECT commit_ord FROM c ORDER BY ts DESC NULLS LAST, commit_ord DESC LIMIT 20)),
ms AS (SELECT file, partner, shared, pct, row_number() OVER (PARTITION BY file ORDER BY pct DESC, shared DESC, partner) AS rank FROM pa WHERE rk <= 20 AND pct >= 50 AND file IN (SELECT path FROM ch) AND partner NOT IN (SELECT path FROM ch))
SELECT * FROM ms WHERE rank <= 2"""))
def cochange_missing_partner(spark: SparkSession, d: str) -> DataFrame:
    c = views.commits(spark, d)
    changes = history.newest(c, 20).select(F.explode("files").alias("path"))
    return history.missing_partners(changes, history.cochange(c, views.files(spark, d))).withColumn("rank", F.col("rank").cast("bigint"))


@query("recent_commits", sql("SELECT repo, path, commit_ord, ts, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY ts DESC NULLS LAST, commit_ord DESC) AS rank FROM cf) WHERE rank <= 5"))
def recent_commits(spark: SparkSession, d: str) -> DataFrame:
    return history.recent(views.commits(spark, d)).select("repo", "path", "commit_ord", "ts", "rank").withColumn("rank", F.col("rank").cast("bigint"))


@query("history_window", sql("SELECT repo, count(*) AS commits, sum(len(files))::BIGINT AS touched FROM c WHERE ts >= (SELECT max(ts) FROM c) - INTERVAL 180 DAY GROUP BY repo"))
def history_window(spark: SparkSession, d: str) -> DataFrame:
    c = views.commits(spark, d)
    now = c.agg(F.max("ts")).first()[0]
    return history.window_of(c, now).groupBy("repo").agg(F.count("*").alias("commits"), F.sum(F.size("files")).alias("touched"))


_OLD = "o AS (SELECT path, size, last_modified, language, commit_frequency FROM f WHERE length(path) % 5 <> 0), nw AS (SELECT path, size + (length(path) % 3 = 0)::INT AS size, last_modified, language, NULL::INT AS commit_frequency FROM f WHERE length(path) % 7 <> 0)"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the file table: by path length some files are new, gone or resized."""
    f = views.files(spark, d).select("path", "size", "last_modified", "language", "commit_frequency")
    n = F.char_length("path")
    new = f.where(n % 7 != 0).withColumn("size", F.col("size") + (n % 3 == 0).cast("int")).withColumn("commit_frequency", F.lit(None).cast("int"))
    return f.where(n % 5 != 0), new


@query("index_diff_full_outer", sql(_OLD + """ SELECT coalesce(o.path, nw.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN nw.path IS NULL THEN 'deleted'
WHEN o.size IS NOT DISTINCT FROM nw.size AND o.last_modified IS NOT DISTINCT FROM nw.last_modified AND o.language IS NOT DISTINCT FROM nw.language THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN nw ON o.path = nw.path"""))
def index_diff_full_outer(spark: SparkSession, d: str) -> DataFrame:
    return maintain.index_diff(*_versions(spark, d))


@query("upsert_files", sql(_OLD + """ SELECT o.* FROM o WHERE path NOT IN (SELECT path FROM nw) UNION ALL
SELECT nw.path, nw.size, nw.last_modified, nw.language, coalesce(nw.commit_frequency, o.commit_frequency) FROM nw LEFT JOIN o ON o.path = nw.path"""))
def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    return maintain.upsert_files(*_versions(spark, d))


@query("remove_cascade", sql("""
g AS (SELECT path FROM f WHERE length(path) % 7 = 0), ls AS (SELECT id FROM s WHERE file IN (SELECT path FROM g)),
kr AS (SELECT ref_id, CASE WHEN target_id IN (SELECT id FROM ls) THEN NULL ELSE target_id END AS target_id FROM r WHERE file NOT IN (SELECT path FROM g))
SELECT 'symbols' AS what, count(*) AS n FROM s WHERE file NOT IN (SELECT path FROM g) UNION ALL SELECT 'calls', count(*) FROM kr UNION ALL SELECT 'resolved', count(target_id) FROM kr
UNION ALL SELECT 'imports', count(*) FROM b WHERE file NOT IN (SELECT path FROM g)"""))
def remove_cascade(spark: SparkSession, d: str) -> DataFrame:
    gone = views.files(spark, d).where(F.char_length("path") % 7 == 0)
    s, r, b = maintain.remove_files(gone, views.symbols(spark, d), views.refs(spark, d), views.bindings(spark, d))
    one = lambda df, what, c: df.agg(F.count(c).alias("n")).select(F.lit(what).alias("what"), "n")
    return one(s, "symbols", F.lit(1)).unionByName(one(r, "calls", F.lit(1))).unionByName(one(r, "resolved", F.col("target_id"))).unionByName(one(b, "imports", F.lit(1)))


@query("apply_history", sql("n AS (SELECT path, count(*) AS k FROM cf GROUP BY path) SELECT f.path, coalesce(k, 0)::INT AS commit_frequency FROM f LEFT JOIN n USING (path)"))
def apply_history(spark: SparkSession, d: str) -> DataFrame:
    return maintain.apply_history(views.files(spark, d), history.commit_counts(views.commits(spark, d))).select("path", "commit_frequency")


@query("working_set_rank", sql(call_queries._SCOPES + """,
ch AS (SELECT DISTINCT path FROM cf WHERE commit_ord IN (SELECT commit_ord FROM c ORDER BY ts DESC NULLS LAST, commit_ord DESC LIMIT 20)),
cl AS (SELECT id AS target_id, count(*) AS calls FROM e GROUP BY 1),
sy AS (SELECT s.file, s.id, s.name, coalesce(calls, 0) AS calls, row_number() OVER (PARTITION BY s.file ORDER BY coalesce(calls, 0) DESC, start_line, s.id) AS rank FROM s LEFT JOIN cl ON cl.target_id = s.id WHERE s.file IN (SELECT path FROM ch)),
fm AS (SELECT file, max(calls) AS best FROM sy GROUP BY file ORDER BY best DESC, file LIMIT 10)
SELECT file, id, name, calls, rank, best FROM sy JOIN fm USING (file) WHERE rank <= 3"""))
def working_set_rank(spark: SparkSession, d: str) -> DataFrame:
    """The changed files of the newest commits with their most called symbols."""
    ch = history.newest(views.commits(spark, d), 20).select(F.explode("files").alias("file")).distinct()
    calls = call_queries.scoped(spark, d).fan_in().withColumnRenamed("callers", "calls")
    s = views.symbols(spark, d).join(ch, "file", "left_semi").join(calls, "id", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))
    s = s.withColumn("rank", F.row_number().over(W.partitionBy("file").orderBy(F.desc("calls"), "start_line", "id")))
    best = s.groupBy("file").agg(F.max("calls").alias("best")).orderBy(F.desc("best"), "file").limit(10)
    return s.where("rank <= 3").join(F.broadcast(best), "file").select("file", "id", "name", "calls", "rank", "best").withColumn("rank", F.col("rank").cast("bigint"))


@query("limit_with_omitted", sql("t AS (SELECT id, name, file FROM s WHERE exported AND kind = 'function'), k AS (SELECT *, (SELECT count(*) FROM t) - 20 AS omitted FROM t ORDER BY name NULLS FIRST, file, id LIMIT 20) SELECT * FROM k"))
def limit_with_omitted(spark: SparkSession, d: str) -> DataFrame:
    s = views.symbols(spark, d).where("exported and kind = 'function'").select("id", "name", "file")
    total = s.count()
    return s.orderBy("name", "file", "id").limit(20).withColumn("omitted", F.lit(total - 20).cast("bigint"))


@query("symbol_sanity", """
WITH k AS (SELECT id, count(*) AS n, count(DISTINCT file) AS files FROM symbols WHERE id IS NOT NULL GROUP BY id)
SELECT (SELECT count(*) FROM symbols) AS n_rows, (SELECT count(*) FROM k) AS ids, (SELECT count(*) FROM k WHERE n > 1) AS repeated, (SELECT count(*) FROM k WHERE files > 1) AS moved,
  (SELECT count(*) FROM symbols WHERE name IS NULL OR trim(name) = '') AS unnamed, (SELECT count(*) FROM symbols WHERE end_line < start_line) AS reversed""")
def symbol_sanity(spark: SparkSession, d: str) -> DataFrame:
    """Ground truth: repeated ids, unnamed symbols and reversed ranges of the raw table."""
    s = load(spark, d, "symbols")
    k = s.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))
    a = k.agg(F.count("*").alias("ids"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("files") > 1).alias("moved")).first()
    b = s.agg(F.count("*").alias("n_rows"), F.count_if(F.col("name").isNull() | (F.trim("name") == "")).alias("unnamed"), F.count_if(F.col("end_line") < F.col("start_line")).alias("reversed"))
    return b.select("n_rows", *[F.lit(a[c]).cast("bigint").alias(c) for c in ("ids", "repeated", "moved")], "unnamed", "reversed")


@query("seeded_selection", sql("SELECT id, name, file FROM s WHERE name IS NOT NULL AND kind IN ('function', 'method') ORDER BY md5(id || '-7'), id LIMIT 50"))
def seeded_selection(spark: SparkSession, d: str) -> DataFrame:
    """A repeatable selection of inputs for spot checks: the order is a hash of id and seed."""
    s = views.symbols(spark, d).where("name is not null and kind in ('function', 'method')")
    return s.orderBy(F.md5(F.concat("id", F.lit("-7"))), "id").limit(50).select("id", "name", "file")


@query("scope_normalised", sql("""
sc AS (SELECT path AS scope FROM f UNION SELECT regexp_replace(path, '/?[^/]*$', '') FROM f UNION SELECT regexp_replace(path, '/?[^/]*$', '') || '/' FROM f)
SELECT scope, CASE WHEN scope = '' THEN NULL WHEN ends_with(scope, '/') OR scope IN (SELECT path FROM f) THEN scope ELSE scope || '/' END AS normal FROM sc"""))
def scope_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Every path, folder and folder with a slash as a scope."""
    f = views.files(spark, d)
    folder = views.dirname(F.col("path"))
    scopes = f.select(F.col("path").alias("scope")).union(f.select(folder)).union(f.select(F.concat(folder, F.lit("/")))).distinct()
    return lookup.normalize_scope(scopes, f).select("scope", "normal")


#: What an anchor cannot spell: separators or colons in the name, a name that is a number.
_SPELT = "file IS NOT NULL AND name IS NOT NULL AND start_line IS NOT NULL AND instr(file, ':') = 0 AND instr(name, ':') = 0 AND instr(name, '/') = 0 AND instr(name, chr(92)) = 0"


@query("anchors_parsed", sql(rf"""
k AS (SELECT id, start_line % 7 AS n, file, nullif(regexp_replace(name, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '') AS name, start_line AS l FROM s WHERE {_SPELT} AND NOT regexp_full_match(name, '[\s\d]*\d[\s\d]*'))
SELECT id, file, CASE WHEN n IN (1, 2, 6) THEN name END AS symbol, (CASE WHEN n IN (2, 3, 4) AND l >= 1 THEN l END)::INT AS line FROM k"""))
def anchors_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Anchors written in each accepted form, by start line: file, file:symbol, file:symbol:line, file:line, file:line:column, with blanks around, file:symbol:0."""
    s = views.symbols(spark, d).where(_SPELT).where(~F.col("name").rlike(r"^[\s\d]*\d[\s\d]*$"))
    n, line = F.col("start_line") % 7, F.col("start_line").cast("string")
    tail = F.when(n == 1, F.concat(F.lit(":"), "name")).when(n == 2, F.concat(F.lit(":"), "name", F.lit(":"), line)).when(n == 3, F.concat(F.lit(":"), line)).when(n == 4, F.concat(F.lit(":"), line, F.lit(":9")))
    tail = tail.when(n == 6, F.concat(F.lit(":"), "name", F.lit(":0"))).otherwise("")
    raw = F.when(n == 5, F.concat(F.lit("  "), "file", F.lit(" "))).otherwise(F.concat("file", tail))
    return s.select("id", *[c.alias(k) for k, c in lookup.parse_anchor(raw).items()])


@query("complexity_labels", sql("""
SELECT id, CASE WHEN complexity IS NULL AND cognitive IS NULL THEN NULL ELSE concat_ws(' / ', 'cyc ' || complexity, 'cog ' || cognitive) END AS label FROM s"""))
def complexity_labels(spark: SparkSession, d: str) -> DataFrame:
    return views.symbols(spark, d).select("id", X.complexity_label(F.col("complexity"), F.col("cognitive")).alias("label"))
