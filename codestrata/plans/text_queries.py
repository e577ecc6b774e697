"""Queries over words: search, suggestions, patterns, notes, budgets, debounced events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import history, lookup, notes, search
from codestrata.plans import views
from codestrata.plans.catalog import query
from codestrata.plans.views import sql
from codestrata.session import load
from codestrata.streaming import debounce

WORDS = ["lease", "graph", "render"]


def _terms(c: str) -> str:
    apart = f"regexp_replace(regexp_replace(coalesce({c}, ''), '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array(lower({apart}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _weight(t: str, w: str, size: int | str) -> str:
    """A term's weight for a word: 1 if equal, less if it begins with it or is within a fifth of its length in edits."""
    reach = f"least(6, round(0.2 * {size}))"
    return (
        f"CASE WHEN {t} = {w} THEN 1.0 WHEN starts_with({t}, {w}) THEN 0.375 * length({t}) / (length({t}) + 0.3 * (length({t}) - {size}))"
        f" WHEN abs(length({t}) - {size}) <= {reach} AND levenshtein({t}, {w}) <= {reach} THEN 0.45 * length({t}) / (length({t}) + levenshtein({t}, {w})) ELSE 0.0 END"
    )


def _bm25_sql(where: str = "") -> str:
    fields = list(search.BOOSTS)
    tok = ", ".join(f"{_terms(f)} AS t_{f}" for f in fields)
    q = ", ".join(f"('{w}')" for w in WORDS)
    long = " UNION ALL ".join(f"SELECT id, '{f}' AS field, {search.BOOSTS[f]} AS boost, t_{f} AS toks FROM tk" for f in fields)
    return f"""
tk AS (SELECT id, name, file, exported, {tok} FROM s {where}),
lg AS ({long}), q(w) AS (VALUES {q}),
tf AS (SELECT id, field, boost, len(toks) AS dl, w, coalesce(list_sum(list_transform(toks, lambda t: ({_weight('t', 'w', 'length(w)')})::DOUBLE)), 0) AS tf FROM lg, q),
st AS (SELECT field, w, count(*) AS n, avg(dl) AS al, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY ALL),
sc AS (SELECT id, sum(boost * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))) AS score FROM tf JOIN st USING (field, w) WHERE tf > 0 GROUP BY id)"""


@query("search_bm25_top", sql(_bm25_sql() + """,
h AS (SELECT id, name, file, round(score * CASE WHEN exported THEN 1.5 ELSE 1 END, 6) AS score FROM sc JOIN tk USING (id))
SELECT *, (SELECT count(*) FROM h) AS total FROM h ORDER BY score DESC, file, name, id LIMIT 20"""))
def search_bm25_top(spark: SparkSession, d: str) -> DataFrame:
    return search.search_symbols(views.symbols(spark, d), WORDS)


@query("search_language_filter", sql(_bm25_sql("WHERE language IN ('typescript', 'tsx')") + """,
h AS (SELECT id, name, file, round(score * CASE WHEN exported THEN 1.5 ELSE 1 END, 6) AS score FROM sc JOIN tk USING (id))
SELECT *, (SELECT count(*) FROM h) AS total FROM h ORDER BY score DESC, file, name, id LIMIT 20"""))
def search_language_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.search_symbols(views.symbols(spark, d), WORDS, languages=search.languages_of("ts"))


@query("search_churn_boosted", sql(_bm25_sql() + """,
ch AS (SELECT path, count(*) AS k FROM cf GROUP BY path),
h AS (SELECT id, name, file, round(score * CASE WHEN exported THEN 1.5 ELSE 1 END * (1 + 0.5 * ln(1 + coalesce(k, 0)) / ln(1 + (SELECT max(k) FROM ch))), 6) AS score FROM sc JOIN tk USING (id) LEFT JOIN ch ON ch.path = file)
SELECT *, (SELECT count(*) FROM h) AS total FROM h ORDER BY score DESC, file, name, id LIMIT 20"""))
def search_churn_boosted(spark: SparkSession, d: str) -> DataFrame:
    churn = history.commit_counts(views.commits(spark, d)).groupBy("path").agg(F.sum("commits").alias("commits"))
    return search.search_symbols(views.symbols(spark, d), WORDS, churn=churn)


@query("suggest_fuzzy", sql(f"""
k AS (SELECT id, name, file, lower(name) AS low, {_terms('name')} AS tn, {_terms('fqn')} AS tq FROM s WHERE name IS NOT NULL),
h AS (SELECT id, name, file, round(greatest(
  CASE WHEN low = 'resolv' THEN 4.0 WHEN starts_with(low, 'resolv') THEN 2.0 + 6 / length(name) WHEN levenshtein(low, 'resolv') <= 1 THEN 1.0 - levenshtein(low, 'resolv') / 6 ELSE 0 END,
  2.0 * coalesce(list_max(list_transform(tn, lambda t: ({_weight('t', "'resolv'", 6)})::DOUBLE)), 0), coalesce(list_max(list_transform(tq, lambda t: ({_weight('t', "'resolv'", 6)})::DOUBLE)), 0)), 6) AS score FROM k)
SELECT * FROM h WHERE score > 0 ORDER BY score DESC, name, file, id LIMIT 10"""))
def suggest_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return search.suggest(views.symbols(spark, d), "resolv")


@query("pattern_match_lines")
def pattern_match_lines(spark: SparkSession, d: str) -> DataFrame:
    """Matches of a structural pattern with their innermost symbol."""
    t = load(spark, d, "source_texts").where(F.col("path").rlike("\\.(ts|js|mjs|cjs)$")).groupBy("path").agg(F.max("content").alias("content"))
    m = search.pattern_matches(t, "let $A = $F($B, $C[$D]);").withColumnRenamed("path", "file")
    s = lookup.innermost(m.select("file", "line").distinct(), views.symbols(spark, d).where("start_line is not null"), ["file", "line"])
    return m.join(s, ["file", "line"], "left").select("file", "line", "snippet", F.col("span_id").alias("symbol_id"))


_NOTES = """
nt AS (SELECT id, doc AS text, start_line AS created_at, name, file, signature FROM s WHERE length(doc) > 40),
an AS (SELECT id AS note_id, CASE WHEN length(name) % 11 = 0 THEN 'gone/' || nt.file ELSE nt.file END AS file, CASE WHEN length(name) % 5 = 0 THEN name || 'Old' ELSE name END AS symbol,
  CASE length(name) % 4 WHEN 0 THEN 'changed' WHEN 1 THEN NULL ELSE content_hash END AS file_hash, CASE WHEN length(name) % 3 = 0 THEN signature || '?' ELSE signature END AS signature
  FROM nt LEFT JOIN f ON f.path = nt.file WHERE length(name) % 13 <> 0),
sg AS (SELECT file, name, min(signature) AS lo, max(signature) AS hi FROM s WHERE name IS NOT NULL GROUP BY ALL),
vd AS (SELECT note_id, an.file, symbol, CASE WHEN f.path IS NULL THEN 'missing' WHEN file_hash IS NULL OR content_hash IS NULL THEN 'unverified' WHEN file_hash = content_hash THEN 'fresh' ELSE 'stale' END AS verdict,
  CASE WHEN symbol IS NULL THEN 'file changed' WHEN sg.file IS NULL THEN 'symbol renamed or removed' WHEN an.signature IS NOT DISTINCT FROM lo OR an.signature IS NOT DISTINCT FROM hi THEN 'signature intact' ELSE 'signature changed' END AS d0
  FROM an LEFT JOIN f ON f.path = an.file LEFT JOIN sg ON sg.file = an.file AND sg.name = an.symbol)"""


def sample_notes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Notes and anchors made from long docs; by name length some anchors are outdated."""
    n = F.char_length("name")
    s = views.symbols(spark, d).where("char_length(doc) > 40").select("id", F.col("doc").alias("text"), F.col("start_line").alias("created_at"), "name", "file", "signature")
    f = views.files(spark, d).select("path", "content_hash")
    a = s.where(n % 13 != 0).join(f, F.col("file") == F.col("path"), "left").select(
        F.col("id").alias("note_id"), F.when(n % 11 == 0, F.concat(F.lit("gone/"), "file")).otherwise(F.col("file")).alias("file"),
        F.when(n % 5 == 0, F.concat("name", F.lit("Old"))).otherwise(F.col("name")).alias("symbol"),
        F.when(n % 4 == 0, "changed").when(n % 4 == 1, None).otherwise(F.col("content_hash")).alias("file_hash"),
        F.when(n % 3 == 0, F.concat("signature", F.lit("?"))).otherwise(F.col("signature")).alias("signature"),
    )
    return s.select("id", "text", "created_at"), a


@query("anchor_verdicts", sql(_NOTES + " SELECT note_id, file, symbol, verdict, CASE WHEN verdict = 'stale' THEN d0 END AS detail FROM vd"))
def anchor_verdicts(spark: SparkSession, d: str) -> DataFrame:
    _, a = sample_notes(spark, d)
    return notes.anchor_verdicts(a, views.files(spark, d), views.symbols(spark, d)).select("note_id", "file", "symbol", "verdict", "detail")


@query("recall_summary", sql(_NOTES + """, w AS (SELECT note_id, max(CASE verdict WHEN 'fresh' THEN 0 WHEN 'unverified' THEN 1 WHEN 'stale' THEN 2 ELSE 3 END) AS r, count(*) AS anchors FROM vd GROUP BY 1)
SELECT id, ['fresh', 'unverified', 'stale', 'missing'][coalesce(r, 1) + 1] AS verdict, coalesce(anchors, 0) AS anchors FROM nt LEFT JOIN w ON note_id = id"""))
def recall_summary(spark: SparkSession, d: str) -> DataFrame:
    n, a = sample_notes(spark, d)
    return notes.note_verdicts(n, notes.anchor_verdicts(a, views.files(spark, d), views.symbols(spark, d))).select("id", "verdict", F.col("anchor_count").alias("anchors"))


@query("knowledge_counts", sql(_NOTES + " SELECT count(*) FILTER (WHERE id IN (SELECT note_id FROM an)) AS anchored, count(*) FILTER (WHERE id NOT IN (SELECT note_id FROM an)) AS unanchored, (SELECT count(DISTINCT file) FROM an) AS files FROM nt"))
def knowledge_counts(spark: SparkSession, d: str) -> DataFrame:
    return notes.knowledge_counts(*sample_notes(spark, d))


@query("suspect_notes", sql(_NOTES + """, sv AS (SELECT * FROM vd WHERE verdict IN ('stale', 'missing') AND file IN (SELECT path FROM f))
SELECT file, count(DISTINCT note_id) AS suspects, (SELECT count(DISTINCT note_id) FROM sv) AS suspects_in_all FROM sv GROUP BY file"""))
def suspect_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes on each file whose anchors no longer hold, and on all files together."""
    _, a = sample_notes(spark, d)
    f = views.files(spark, d)
    return notes.suspect_notes(notes.anchor_verdicts(a, f, views.symbols(spark, d)), f)


@query("notes_of_context", sql(_NOTES + """,
lv AS (SELECT s.id AS target_id, note_id, min(CASE WHEN symbol IS NULL THEN 1 ELSE 0 END)::INT AS level FROM s JOIN an ON an.file = s.file AND (symbol IS NULL OR regexp_extract(symbol, '[^.#:]*$') = s.name) WHERE s.name IS NOT NULL GROUP BY ALL),
rk AS (SELECT lv.*, row_number() OVER (PARTITION BY target_id ORDER BY level, created_at DESC NULLS LAST, note_id)::INT AS place, greatest(count(*) OVER (PARTITION BY target_id) - 3, 0)::BIGINT AS omitted FROM lv JOIN nt ON nt.id = note_id)
SELECT * FROM rk WHERE place <= 3"""))
def notes_of_context(spark: SparkSession, d: str) -> DataFrame:
    """The notes shown with each symbol."""
    n, a = sample_notes(spark, d)
    return notes.notes_of_context(n, a, views.symbols(spark, d).where("name is not null").select(F.col("id").alias("target_id"), "file", "name"))


@query("note_keyword_rank", sql(_NOTES + """,
x AS (SELECT id, text, created_at, coalesce(an.file || ' ' || symbol, '') AS anc FROM nt LEFT JOIN an ON note_id = id),
y AS (SELECT id, created_at, """ + " + ".join(f"CASE WHEN contains(lower(anc), '{w}') THEN 2 WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in WORDS) + """ AS score FROM x)
SELECT id, score FROM y WHERE score > 0 ORDER BY score DESC, created_at DESC NULLS LAST, id LIMIT 20"""))
def note_keyword_rank(spark: SparkSession, d: str) -> DataFrame:
    n, a = sample_notes(spark, d)
    t = a.select(F.col("note_id").alias("id"), F.concat("file", F.lit(" "), "symbol").alias("anchor_text"))
    return search.search_notes(n.join(t, "id", "left").fillna("", ["anchor_text"]), WORDS).select("id", "score")


@query("recall_filtered", sql(_NOTES + " SELECT id FROM nt WHERE id IN (SELECT note_id FROM an WHERE starts_with(file, 'amber-')) AND (contains(lower(text), 'lease') OR contains(lower(text), 'cache')) ORDER BY created_at DESC NULLS LAST, id LIMIT 10"))
def recall_filtered(spark: SparkSession, d: str) -> DataFrame:
    n, a = sample_notes(spark, d)
    a = a.where(F.startswith("file", F.lit("amber-")))
    return notes.recall(n.join(a.select(F.col("note_id").alias("id")), "id", "left_semi"), a, ["lease", "cache"]).select("id")


@query("token_budget_prefix", """
WITH k AS (SELECT doc_id, coalesce(project, '') AS project, doc_kind, ceil(length(coalesce(text, '')) / 4)::BIGINT AS cost FROM documents),
w AS (SELECT *, sum(cost) OVER (PARTITION BY project, doc_kind ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent, row_number() OVER (PARTITION BY project, doc_kind ORDER BY doc_id) AS place FROM k)
SELECT doc_id, project, doc_kind, cost, spent FROM w WHERE spent <= 3000 OR place <= 1""")
def token_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "documents").withColumn("project", F.coalesce("project", F.lit("")))
    return search.within_budget(b, ["project", "doc_kind"], ["doc_id"], "text").select("doc_id", "project", "doc_kind", "cost", "spent")


@query("debounce_batches", """
WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS batch FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events, count(DISTINCT event_type) AS keys FROM b GROUP BY user_id, batch""")
def debounce_batches(spark: SparkSession, d: str) -> DataFrame:
    return debounce.quiet_batches(load(spark, d, "events"), ["user_id"], "ts", "event_type", "6 hours")


@query("debounce_deadline", """
WITH RECURSIVE o AS (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events WHERE ts IS NOT NULL),
w AS (SELECT user_id, ts, event_type, rn, ts AS first_ts, 1 AS batch FROM o WHERE rn = 1
  UNION ALL SELECT o.user_id, o.ts, o.event_type, o.rn, CASE WHEN o.ts - w.ts > INTERVAL 6 HOUR OR o.ts - w.first_ts > INTERVAL 24 HOUR THEN o.ts ELSE w.first_ts END,
    CASE WHEN o.ts - w.ts > INTERVAL 6 HOUR OR o.ts - w.first_ts > INTERVAL 24 HOUR THEN w.batch + 1 ELSE w.batch END FROM w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1)
SELECT user_id, first_ts, max(ts) AS last_ts, count(*) AS events, count(DISTINCT event_type)::INT AS keys FROM w GROUP BY user_id, batch, first_ts""")
def debounce_deadline(spark: SparkSession, d: str) -> DataFrame:
    """Batches with a quiet gap and a hard deadline."""
    return debounce.deadline_batches(load(spark, d, "events"), "user_id", "ts", "event_type", gap_s=6 * 3600, max_s=24 * 3600)
