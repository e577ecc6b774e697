"""Queries over calls: resolution, fan-in, caller edges, graphs and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import graph, resolve, rules
from codestrata.plans import views
from codestrata.plans.catalog import query
from codestrata.plans.views import sql
from codestrata.session import cut, discard, load, store

_NORM = "regexp_replace({0}, '(^|/)(\\./)+', '\\1', 'g')"
for _ in range(5):
    _NORM = f"regexp_replace({_NORM}, '(^|/)([^/.][^/]*|\\.[^/.][^/]*)/\\.\\.(/|$)', '\\1')"
_DIR = "regexp_replace({0}, '/?[^/]*$', '')"


def _list(suffixes: list[str]) -> str:
    return "[" + ", ".join(f"'{s}'" for s in ["", *suffixes]) + "]"


_IMPORTS = f"""
bm AS (SELECT *, CASE WHEN bind = 'module' AND regexp_full_match(source_module, '\\.+') AND name <> source_module THEN source_module || name ELSE source_module END AS sm FROM b),
sp AS (SELECT DISTINCT x.file, x.sm, f.language, CASE
    WHEN language = 'python' THEN CASE WHEN regexp_full_match(sm, '\\.+[^.].*') THEN repeat('../', length(regexp_extract(sm, '^\\.+')) - 1) || replace(regexp_replace(sm, '^\\.+', ''), '.', '/') END
    WHEN NOT starts_with(sm, '.') THEN NULL WHEN language = 'javascript' THEN sm WHEN ends_with(sm, '.jsx') THEN sm[:-5] WHEN ends_with(sm, '.js') THEN sm[:-4] ELSE sm END AS spec,
  CASE WHEN language = 'python' THEN {_list(resolve._PY)} WHEN language = 'javascript' THEN {_list(resolve._with_index(resolve._JS))}
    WHEN ends_with(sm, '.jsx') THEN {_list(resolve._with_index(resolve._FROM_JSX))} WHEN ends_with(sm, '.js') THEN {_list(resolve._with_index(resolve._FROM_JS))} ELSE {_list(resolve._with_index(resolve._TS))} END AS cands
  FROM (SELECT file, sm FROM bm UNION SELECT file, source_module FROM bm) x JOIN f ON f.path = x.file),
tr AS (SELECT file, sm, {_NORM.format(_DIR.format('file') + " || '/' || spec")} AS stem, unnest(cands) AS suffix, generate_subscripts(cands, 1) AS rank FROM sp WHERE spec IS NOT NULL),
res AS (SELECT sp.file, sp.sm, m.target FROM sp LEFT JOIN (SELECT tr.file, tr.sm, arg_min(f.path, rank) AS target FROM tr JOIN f ON f.path = rtrim(stem, '/') || suffix GROUP BY ALL) m ON m.file = sp.file AND m.sm = sp.sm)"""

_SCOPES = f"""{_IMPORTS},
t AS (SELECT id, name, kind, file, language, coalesce(exported, false) AS exported, start_line, regexp_extract(fqn, '^[^:]*:([^.]+)\\.', 1) <> '' AS member, {_DIR.format('file')} AS dir,
  kind NOT IN ('method', 'interface', 'type', 'enum', 'module') AS bare_ok FROM s WHERE name IS NOT NULL),
u AS (SELECT r.*, f.language AS fl, f.path IS NOT NULL AS idx, {_DIR.format('r.file')} AS dir FROM r LEFT JOIN f ON f.path = r.file WHERE target_id IS NULL AND length(target_name) >= 4),
nb AS (SELECT b.*, target, alias IS NOT NULL AND alias <> name AND name NOT IN ('default', '*') AS ren, name = '*' AND alias IS NULL AS wild FROM b LEFT JOIN res ON res.file = b.file AND res.sm = b.source_module),
dec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, local ORDER BY line, source_module, pos, ren, target NULLS FIRST) AS rn FROM nb WHERE NOT wild AND bind = 'value' AND (ren OR target IS NOT NULL)) WHERE rn = 1),
opn AS (SELECT DISTINCT file, local FROM nb WHERE NOT wild AND bind = 'value' AND NOT ren AND target IS NULL),
ky AS (SELECT DISTINCT u.file, target_name, idx, dec.line AS dl, dec.source_module AS dm, dec.pos AS dp, dec.ren, dec.target, opn.file IS NOT NULL AS opened FROM u LEFT JOIN dec ON dec.file = u.file AND dec.local = target_name
  LEFT JOIN opn ON opn.file = u.file AND opn.local = target_name WHERE receiver IS NULL),
kw AS (SELECT ky.file, target_name, nb.target, dl FROM ky JOIN nb ON nb.file = ky.file AND wild WHERE dl IS NULL OR (nb.line, nb.source_module, nb.pos) < (dl, dm, dp)),
adm AS (SELECT file, target_name, target FROM ky WHERE dl IS NOT NULL AND NOT ren UNION SELECT file, target_name, target FROM kw WHERE target IS NOT NULL),
anyk AS (SELECT file, target_name FROM ky WHERE NOT idx OR (dl IS NULL AND opened) UNION SELECT file, target_name FROM kw WHERE dl IS NULL AND target IS NULL),
mf AS (SELECT * FROM (SELECT bm.file, local, CASE WHEN bind IN ('namespace', 'module') THEN CASE WHEN target IS NULL THEN 'top' ELSE 'file' END WHEN bind = 'type' THEN 'none' ELSE 'all' END AS reach, target,
  row_number() OVER (PARTITION BY bm.file, local ORDER BY bm.line, bm.source_module, bm.pos, CASE WHEN bind IN ('namespace', 'module') THEN CASE WHEN target IS NULL THEN 'top' ELSE 'file' END WHEN bind = 'type' THEN 'none' ELSE 'all' END) AS rn
  FROM bm LEFT JOIN res ON res.file = bm.file AND res.sm = bm.sm) WHERE rn = 1),
mem AS (SELECT u.*, CASE WHEN receiver = '()' OR NOT idx OR reach IS NULL THEN 'all' ELSE reach END AS reach, mf.target AS mt FROM u LEFT JOIN mf ON mf.file = u.file AND mf.local = receiver WHERE receiver IS NOT NULL AND NOT coalesce(self_receiver, false)),
ali AS (SELECT DISTINCT r.ref_id, r.source_id, r.file, r.line, nb.name AS export, nb.target FROM r JOIN nb ON nb.file = r.file AND nb.alias = r.target_name AND ren AND NOT wild WHERE receiver IS NULL AND target_id IS NULL AND r.file IN (SELECT path FROM f)),
e0 AS (
  SELECT t.id, ref_id, source_id, u.file, line, receiver, t.name, t.dir FROM u JOIN t ON t.name = target_name LEFT JOIN anyk ON anyk.file = u.file AND anyk.target_name = u.target_name
    LEFT JOIN adm ON adm.file = u.file AND adm.target_name = u.target_name AND adm.target = t.file
    WHERE receiver IS NULL AND (source_id IS NULL OR source_id <> t.id) AND ((bare_ok AND (anyk.file IS NOT NULL OR adm.target IS NOT NULL OR coalesce(fl = 'go' AND t.language = 'go' AND u.dir = t.dir AND NOT member, false)))
      OR (t.kind = 'type' AND coalesce(fl = 'go' AND t.language = 'go' AND u.dir = t.dir AND NOT member, false)))
  UNION SELECT t.id, ref_id, source_id, m.file, line, receiver, t.name, t.dir FROM mem m JOIN t ON t.name = target_name
    WHERE (source_id IS NULL OR source_id <> t.id) AND (bare_ok OR t.kind = 'method') AND (reach = 'all' OR (NOT member AND (reach = 'top' OR (reach = 'file' AND mt = t.file))))
      AND (m.file = t.file OR exported OR (member AND t.language = 'go' AND ends_with(m.file, '.go') AND m.dir = t.dir))
  UNION SELECT t.id, ref_id, source_id, a.file, line, NULL, t.name, t.dir FROM ali a JOIN t ON t.name = export WHERE (source_id IS NULL OR source_id <> t.id) AND bare_ok AND length(t.name) >= 4 AND (a.target IS NULL OR a.target = t.file)),
inm AS (SELECT DISTINCT file, unnest([name, alias]) AS n FROM b),
wf AS (SELECT DISTINCT file FROM b WHERE name = '*' AND alias IS NULL),
ns AS (SELECT DISTINCT file, local FROM b WHERE bind IN ('namespace', 'module')),
e AS (
  SELECT id, ref_id, source_id, e0.file, line, CASE WHEN receiver IS NULL THEN CASE WHEN inm.n IS NOT NULL OR wf.file IS NOT NULL OR {_DIR.format('e0.file')} = dir THEN 'import-connected' ELSE 'name-match' END
    WHEN receiver <> '()' AND ns.file IS NOT NULL THEN 'import-connected' ELSE 'weak-member' END AS strength
  FROM e0 LEFT JOIN inm ON inm.file = e0.file AND inm.n = e0.name LEFT JOIN wf ON wf.file = e0.file LEFT JOIN ns ON ns.file = e0.file AND ns.local = receiver
  UNION SELECT target_id, ref_id, source_id, file, line, 'resolved' FROM r WHERE target_id IS NOT NULL AND (source_id IS NULL OR source_id <> target_id) AND target_id IN (SELECT id FROM t))"""


_KEPT: dict = {}


def scoped(spark: SparkSession, d: str) -> resolve.Scoped:
    """The scoped calls of a folder; those of the folder asked for last are kept, as an index keeps its edges.

    Kept only while the session and the input files, by name, length and time, are the same.
    """
    stamp = [spark.sparkContext.applicationId, d]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for t in ("symbol_refs", "symbols", "file_imports", "files"):
        at = hadoop(f"{d}/{t}.parquet")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        stamp += [(x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(at)]
    key = tuple(stamp)
    if key not in _KEPT:
        _KEPT.clear()
        made: list[DataFrame] = []

        def keep(df):
            made.append(store(df))
            return made[-1]

        _KEPT[key] = resolve.Scoped(views.refs(spark, d, keep), views.symbols(spark, d), views.bindings(spark, d), views.files(spark, d))
        discard(*made)
    return _KEPT[key]


@query("import_candidates_first_match", sql(_IMPORTS + " SELECT DISTINCT r.file, r.sm AS source_module, target FROM res r JOIN b ON b.file = r.file AND b.source_module = r.sm"))
def import_candidates(spark: SparkSession, d: str) -> DataFrame:
    return resolve.import_targets(views.bindings(spark, d), views.files(spark, d))


@query("fan_in", sql(_SCOPES + " SELECT id, count(*) AS callers FROM e GROUP BY id"))
def fan_in(spark: SparkSession, d: str) -> DataFrame:
    return scoped(spark, d).fan_in()


@query("fan_out", sql("SELECT source_id AS id, count(DISTINCT target_id) AS callees FROM r WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1"))
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    r = views.refs(spark, d).where("source_id is not null and target_id is not null")
    return r.groupBy(F.col("source_id").alias("id")).agg(F.count_distinct("target_id").alias("callees"))


@query("edge_strength_tiers", sql(_SCOPES + f""" SELECT id, strength, count(*) AS sites, count(DISTINCT file) AS files FROM e GROUP BY ALL"""))
def edge_strength_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Call sites and files of every symbol by strength."""
    return graph.count_strengths(scoped(spark, d).split())


@query("reference_ranks", sql(_SCOPES + f""",
k AS (SELECT e.*, CASE WHEN strength = 'weak-member' THEN 5 WHEN {_DIR.format('e.file')} = t.dir THEN 1 WHEN strength IN ('import-connected', 'resolved') THEN 2
  WHEN {_DIR.format(_DIR.format('e.file'))} = {_DIR.format('t.dir')} OR {_DIR.format('e.file')} = {_DIR.format('t.dir')} THEN 3 ELSE 4 END AS tier FROM e JOIN t USING (id)),
w AS (SELECT *, row_number() OVER (PARTITION BY id, tier = 5 ORDER BY tier, file, line, ref_id) AS rw FROM k),
x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, file, line, ref_id) AS rank FROM w WHERE tier < 5 OR rw <= 8)
SELECT id, ref_id, file, line, tier, rank FROM x WHERE rank <= 20"""))
def reference_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Callers of every symbol by nearness, weak member calls last and at most 8."""
    s = scoped(spark, d)
    return graph.rank_references(graph.leading_references(s.split()), s.symbols).withColumn("rank", F.col("rank").cast("bigint"))


@query("caller_edges_min_line", sql("""
m AS (SELECT target_id AS id, source_id, s.file, s.start_line AS line FROM r JOIN s ON s.id = source_id WHERE target_id IS NOT NULL AND source_id IS NOT NULL
  UNION SELECT target_id, NULL, file, min(line) FROM r WHERE target_id IS NOT NULL AND source_id IS NULL GROUP BY target_id, file) SELECT * FROM m"""))
def caller_edges_min_line(spark: SparkSession, d: str) -> DataFrame:
    return graph.strict_callers(views.refs(spark, d), views.symbols(spark, d))


@query("resolution_rate", sql("""
SELECT coalesce(f.language, 'unknown') AS language, CASE WHEN receiver IS NULL THEN 'bare' WHEN self_receiver THEN 'self' ELSE 'member' END AS form, count(*) AS calls,
  round(avg((target_id IS NOT NULL)::INT), 6) AS rate FROM r LEFT JOIN f ON f.path = r.file WHERE kind = 'calls' GROUP BY ALL"""))
def resolution_rate(spark: SparkSession, d: str) -> DataFrame:
    f = views.files(spark, d).select("path", "language")
    form = F.when(F.col("receiver").isNull(), "bare").when(F.col("self_receiver"), "self").otherwise("member")
    r = views.refs(spark, d).where("kind = 'calls'").join(f, F.col("file") == F.col("path"), "left")
    return r.groupBy(F.coalesce("language", F.lit("unknown")).alias("language"), form.alias("form")).agg(
        F.count("*").alias("calls"), F.round(F.avg(F.col("target_id").isNotNull().cast("int")), 6).alias("rate")
    )


#: Hops by name: every edge gives a caller, those that are import-connected or resolved lead on.
_NAMED = sql(_SCOPES + """,
one AS (SELECT id, coalesce(source_id, 'm:' || file) AS caller, file, bool_or(strength IN ('resolved', 'import-connected')) AS walked FROM e GROUP BY ALL),
two AS (SELECT a.id, z.caller, z.file FROM one a JOIN one z ON z.id = a.caller WHERE a.walked),
hp AS (SELECT id, caller, file, min(depth) AS depth FROM (SELECT id, caller, file, 1 AS depth FROM one UNION ALL SELECT id, caller, file, 2 FROM two) GROUP BY ALL)
""")


@query("risk_hotspots", _NAMED + """,
fi AS (SELECT id, count(*) AS callers FROM e GROUP BY id),
hot AS (SELECT path, commit_frequency AS churn FROM f WHERE commit_frequency > 0 ORDER BY churn DESC, path LIMIT 40),
bst AS (SELECT * FROM (SELECT t.id, t.name, hot.path AS file, churn, callers, coalesce(s.cognitive, s.complexity - 1, 0) AS cx, row_number() OVER (PARTITION BY hot.path ORDER BY callers DESC, t.start_line, t.id) AS rn
  FROM hot JOIN t ON t.file = hot.path JOIN s ON s.id = t.id JOIN fi ON fi.id = t.id) WHERE rn = 1)
, tp AS (SELECT id, name, file, churn, callers, cx, round(ln(1 + churn) * ln(1 + callers) * (1 + ln(1 + cx)), 6) AS score FROM bst ORDER BY score DESC, file LIMIT 10),
bl AS (SELECT id, count(*) AS blast_callers, count(DISTINCT file) AS blast_files, max(depth) AS blast_depth FROM hp GROUP BY id)
SELECT tp.*, blast_callers, blast_files, blast_depth FROM tp LEFT JOIN bl USING (id)""")
def risk_hotspots(spark: SparkSession, d: str) -> DataFrame:
    """The riskiest symbols, each with its callers by name within two hops."""
    s = scoped(spark, d)
    top = cut(graph.risk_hotspots(views.files(spark, d), views.symbols(spark, d), s.fan_in()))
    return top.join(graph.blast_of(s, top), "id", "left")


_STRICT = """
e1 AS (SELECT DISTINCT target_id AS dst, source_id AS src FROM r WHERE target_id IS NOT NULL AND source_id IS NOT NULL AND source_id <> target_id),
e2 AS (SELECT a.dst, b.src FROM e1 a JOIN e1 b ON b.dst = a.src),
lv AS (SELECT dst, src, 1 AS depth FROM e1 UNION ALL SELECT dst, src, 2 FROM e2 WHERE src <> dst),
mn AS (SELECT dst, src, min(depth) AS depth FROM lv GROUP BY ALL)"""


_STRICT_BLAST = sql(_STRICT + " SELECT dst AS id, count(*) AS callers, count(DISTINCT s.file) AS files, max(depth) AS depths FROM mn JOIN s ON s.id = src GROUP BY dst")
_STRICT_HOPS = sql(_STRICT + " SELECT dst AS id, depth, count(*) AS callers FROM mn GROUP BY ALL")


@query("blast_radius_depth2", _NAMED + "SELECT id, count(*) AS callers, count(DISTINCT file) AS files, max(depth) AS depths FROM hp GROUP BY id")
def blast_radius_depth2(spark: SparkSession, d: str) -> DataFrame:
    """Distinct transitive callers by name, two hops, of every symbol."""
    return graph.named_blast_radius(scoped(spark, d).split())


@query("impact_by_hop", _NAMED + "SELECT id, depth, count(*) AS callers FROM hp GROUP BY ALL")
def impact_by_hop(spark: SparkSession, d: str) -> DataFrame:
    """Callers by name of every symbol per hop."""
    return graph.named_callers_by_hop(scoped(spark, d).split())


@query("blast_radius_resolved", _STRICT_BLAST)
def blast_radius_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Distinct transitive callers over resolved calls, two hops, of every symbol."""
    e = graph.call_edges(views.refs(spark, d))
    return graph.blast_radius(e, views.symbols(spark, d), 2)


@query("impact_by_hop_resolved", _STRICT_HOPS)
def impact_by_hop_resolved(spark: SparkSession, d: str) -> DataFrame:
    return graph.callers_by_hop(graph.call_edges(views.refs(spark, d)), 2).groupBy(F.col("dst").alias("id"), "depth").agg(F.count("*").alias("callers"))


@query("caller_groups", sql(_SCOPES + f""",
g AS (SELECT id, coalesce(source_id, 'm:' || file) AS caller, count(*) AS sites, min(line) AS first_line, max(CASE strength WHEN 'resolved' THEN 3 WHEN 'import-connected' THEN 2 WHEN 'name-match' THEN 1 ELSE 0 END) AS rank
  FROM e GROUP BY ALL) SELECT * FROM g"""))
def caller_groups(spark: SparkSession, d: str) -> DataFrame:
    """Call sites of every symbol, one row per calling symbol or, at module level, file."""
    return graph.group_all_callers(scoped(spark, d).split())


@query("distinct_callers", sql(_SCOPES + f""",
g AS (SELECT id, coalesce(source_id, 'm:' || file) AS caller, any_value(file) AS file, max(CASE strength WHEN 'resolved' THEN 3 WHEN 'import-connected' THEN 2 WHEN 'name-match' THEN 1 ELSE 0 END) AS rank FROM e GROUP BY ALL)
SELECT id, count(*) AS callers, count(DISTINCT file) AS files, count(*) FILTER (WHERE rank = 3) AS structural, count(*) FILTER (WHERE rank IN (1, 2)) AS name_match, count(*) FILTER (WHERE rank = 0) AS weak_member FROM g GROUP BY id"""))
def distinct_callers(spark: SparkSession, d: str) -> DataFrame:
    """Distinct callers of every symbol by tier."""
    return graph.count_callers(scoped(spark, d).split())


@query("caller_tree_capped")
def caller_tree_capped(spark: SparkSession, d: str) -> DataFrame:
    """Capped caller trees of the five symbols with most callers; checked against a plain model in the tests."""
    s = scoped(spark, d)
    roots = s.fan_in().join(s.symbols.select("id").alias("x"), "id").orderBy(F.desc("callers"), "id").limit(5).select("id")
    return graph.caller_trees(s, roots)


@query("export_callers_set", sql("""
im AS (SELECT DISTINCT r.file AS used_in, s.file AS file, s.name FROM r JOIN b ON b.file = r.file AND b.local = r.target_name AND b.bind = 'value' JOIN s ON s.name = b.name AND s.exported WHERE r.receiver IS NULL AND r.target_id IS NULL AND s.file <> r.file AND length(s.name) >= 4)
SELECT file, used_in, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM im GROUP BY ALL"""))
def export_callers_set(spark: SparkSession, d: str) -> DataFrame:
    """Per defining and using file, the exported names that the using file imports and calls."""
    b = views.bindings(spark, d).where("bind = 'value'").select("file", F.col("local").alias("target_name"), F.col("name").alias("export")).distinct()
    r = views.refs(spark, d).where("receiver is null and target_id is null").select("file", "target_name").distinct()
    s = views.symbols(spark, d).where("exported and char_length(name) >= 4").select(F.col("file").alias("def_file"), F.col("name").alias("export"))
    j = r.join(b, ["file", "target_name"]).join(s, "export").where("def_file <> file")
    return j.groupBy(F.col("def_file").alias("file"), F.col("file").alias("used_in")).agg(F.array_join(F.array_sort(F.collect_set("export")), ",").alias("names"))


@query("alias_join", sql(_SCOPES + " SELECT DISTINCT ref_id, export, target AS to_file FROM ali"))
def alias_join(spark: SparkSession, d: str) -> DataFrame:
    return scoped(spark, d).alias.where("target_id is null").select("ref_id", "export", F.col("to").alias("to_file")).distinct()


@query("same_file_resolution", sql("""
w AS (SELECT *, nullif(regexp_extract(fqn, '^[^:]*:([^.]+)\\.', 1), '') AS cls FROM s WHERE name IS NOT NULL),
top AS (SELECT file, name, arg_min(id, (start_line, id)) AS bare_id FROM w WHERE kind NOT IN ('method', 'interface', 'type', 'enum', 'module') GROUP BY ALL),
tw AS (SELECT file, name FROM w WHERE kind IN ('class', 'type') GROUP BY ALL HAVING count(*) > 1),
me AS (SELECT file, cls, name, arg_min(id, (start_line, id)) AS member_id FROM w WHERE cls IS NOT NULL AND kind = 'method' AND (file, cls) NOT IN (SELECT (file, name) FROM tw) GROUP BY ALL),
q AS (SELECT r.*, CASE WHEN coalesce(self_receiver, false) THEN x.cls ELSE receiver END AS owner FROM r LEFT JOIN w x ON x.id = source_id WHERE r.kind = 'calls')
SELECT ref_id, CASE WHEN receiver IS NULL THEN bare_id ELSE member_id END AS resolved_id FROM q LEFT JOIN top ON top.file = q.file AND top.name = target_name LEFT JOIN me ON me.file = q.file AND me.cls = owner AND me.name = target_name"""))
def same_file_resolution(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_same_file(views.refs(spark, d).where("kind = 'calls'"), views.symbols(spark, d)).select("ref_id", "resolved_id")


@query("language_rules_resolution", sql(rules.rules_as_values() + f""",
x AS (SELECT s.*, nullif(regexp_extract(fqn, '^[^:]*:([^.]+)\\.', 1), '') AS cls, ru.own_class, ru.bare_kinds, ru.made_kinds, ru.type_kinds, ru.once_only FROM s LEFT JOIN f ON f.path = s.file LEFT JOIN ru ON ru.language = f.language WHERE name IS NOT NULL),
ty AS (SELECT file, name FROM x WHERE list_contains(type_kinds, kind) GROUP BY ALL HAVING count(*) > 1),
tw AS (SELECT file, name FROM x WHERE once_only AND kind = 'function' GROUP BY ALL HAVING count(*) > 1),
ba AS (SELECT file, name, arg_min(id, (start_line, id)) AS bare_id FROM x WHERE list_contains(coalesce(bare_kinds, {rules._DEFAULT.split()}), kind) AND (file, name) NOT IN (SELECT (file, name) FROM tw) GROUP BY ALL),
ma AS (SELECT file, name, arg_min(id, (start_line, id)) AS made_id FROM x WHERE list_contains(made_kinds, kind) AND (file, name) NOT IN (SELECT (file, name) FROM ty) GROUP BY ALL),
me AS (SELECT file, cls, name, arg_min(id, (start_line, id)) AS method_id FROM x WHERE kind = 'method' AND cls IS NOT NULL AND (file, cls) NOT IN (SELECT (file, name) FROM ty) GROUP BY ALL),
q AS (SELECT r.*, coalesce(f.language = 'java' AND receiver IS NULL AND regexp_matches(target_name, '^[A-Z]'), false) AS is_new, ru.own_class, ru.ignored,
  CASE WHEN coalesce(self_receiver, false) OR (receiver IS NULL AND coalesce(ru.own_class, false)) THEN c.cls ELSE receiver END AS owner
  FROM r LEFT JOIN f ON f.path = r.file LEFT JOIN ru ON ru.language = f.language LEFT JOIN x c ON c.id = source_id WHERE r.kind = 'calls'),
z AS (SELECT ref_id, CASE WHEN receiver IS NOT NULL THEN method_id WHEN is_new THEN made_id ELSE coalesce(method_id, bare_id) END AS resolved_id, receiver IS NULL AND NOT is_new AND coalesce(list_contains(ignored, target_name), false) AS noise
  FROM q LEFT JOIN ba ON ba.file = q.file AND ba.name = target_name LEFT JOIN ma ON ma.file = q.file AND ma.name = target_name LEFT JOIN me ON me.file = q.file AND me.cls = owner AND me.name = target_name)
SELECT ref_id, resolved_id FROM z WHERE resolved_id IS NOT NULL OR NOT noise"""))
def language_rules_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Same-file resolution by each language's rules; in Java a bare callee with a capital is taken for a construction."""
    f = views.files(spark, d)
    r = views.refs(spark, d).where("kind = 'calls'").join(f.select(F.col("path").alias("_p"), F.col("language").alias("_l")), F.col("file") == F.col("_p"), "left")
    r = r.withColumn("is_new", F.coalesce((F.col("_l") == "java") & F.col("receiver").isNull() & F.col("target_name").rlike("^[A-Z]"), F.lit(False))).drop("_p", "_l")
    return rules.resolve_by_rules(r, views.symbols(spark, d), f)


@query("resolved_target_kinds", sql("SELECT coalesce(s.language, 'unknown') AS language, s.kind, count(*) AS calls, count(DISTINCT target_id) AS targets FROM r JOIN s ON s.id = target_id GROUP BY ALL"))
def resolved_target_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Ground truth: resolved calls by the language and kind of what they reach."""
    s = views.symbols(spark, d).select(F.col("id").alias("target_id"), F.coalesce("language", F.lit("unknown")).alias("language"), F.col("kind").alias("k"))
    r = views.refs(spark, d).where("target_id is not null").join(s, "target_id")
    return r.groupBy("language", F.col("k").alias("kind")).agg(F.count("*").alias("calls"), F.count_distinct("target_id").alias("targets"))


@query("calls_seen_in_text", sql("""
tx AS (SELECT path, list_distinct(regexp_split_to_array(max(content), '[^\\p{L}\\p{N}_$]+')) AS ws FROM source_texts WHERE content IS NOT NULL GROUP BY path)
SELECT coalesce(f.language, 'unknown') AS language, count(*) AS calls, count(*) FILTER (WHERE list_contains(ws, target_name)) AS seen FROM r JOIN tx ON tx.path = r.file LEFT JOIN f ON f.path = r.file WHERE target_name IS NOT NULL GROUP BY ALL"""))
def calls_seen_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Ground truth: how many calls name a whole word of their file's text."""
    t = load(spark, d, "source_texts").where("content is not null").groupBy(F.col("path").alias("file")).agg(F.max("content").alias("content"))
    words = t.select("file", F.explode(F.array_distinct(F.split("content", "[^\\p{L}\\p{N}_$]+"))).alias("target_name"), F.lit(1).alias("there"))
    f = views.files(spark, d).select(F.col("path").alias("_p"), "language")
    r = views.refs(spark, d).where("target_name is not null").groupBy("file", "target_name").agg(F.count("*").alias("n")).join(t.select("file"), "file")
    j = r.join(words, ["file", "target_name"], "left").join(f, F.col("file") == F.col("_p"), "left")
    seen = F.when(F.col("there") == 1, F.col("n")).otherwise(0)
    return j.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.sum("n").alias("calls"), F.sum(seen).alias("seen"))
