"""Queries over source texts: ids, signatures, doc lines, complexity, outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions import expressions as X
from codestrata.operators import extract
from codestrata.plans import views
from codestrata.plans.catalog import query
from codestrata.plans.views import class_of, sql
from codestrata.session import load


@query("signature_normalise", sql("SELECT id, trim(regexp_replace(signature, '\\s+', ' ', 'g')) AS signature FROM s"))
def signature_normalise(spark: SparkSession, d: str) -> DataFrame:
    return views.symbols(spark, d).select("id", X.normalize_signature(F.col("signature")).alias("signature"))


@query("comment_doc_line", sql("""SELECT id, list_filter(list_transform(string_split(doc, chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[\\s\\p{Z}]', ' ', 'g'), '^ *(/\\*+|\\*+/|///?|\\*|#+) ?', ''), ' *\\*+/ *$', ''), '^ +| +$', '', 'g')), lambda x: x <> '')[1] AS line FROM s WHERE doc IS NOT NULL"""))
def comment_doc_line(spark: SparkSession, d: str) -> DataFrame:
    return views.symbols(spark, d).where("doc is not null").select("id", X.doc_line(F.col("doc")).alias("line"))


@query("symbol_ids", sql("""
q AS (SELECT id, file, name, kind, trim(regexp_replace(coalesce(signature, ''), '\\s+', ' ', 'g')) AS sg, coalesce(nullif(regexp_extract(fqn, '^[^:]*:([^.]+)\\.', 1), ''), '') AS cls, start_line FROM s WHERE name IS NOT NULL AND kind IS NOT NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY file, name, kind, sg, cls ORDER BY start_line, id) AS nth FROM q),
z AS (SELECT *, cls || CASE WHEN nth > 1 THEN '#' || nth ELSE '' END AS tail FROM w)
SELECT id, substring(sha1(file || chr(0) || name || chr(0) || kind || chr(0) || sg || CASE WHEN tail <> '' THEN chr(0) || tail ELSE '' END), 1, 16) AS derived FROM z"""))
def symbol_ids(spark: SparkSession, d: str) -> DataFrame:
    s = views.symbols(spark, d).where("name is not null and kind is not null").withColumn("sg", X.normalize_signature(F.coalesce("signature", F.lit("")))).withColumn("cls", F.coalesce(class_of(F.col("fqn")), F.lit("")))
    nth = F.row_number().over(W.partitionBy("file", "name", "kind", "sg", "cls").orderBy("start_line", "id"))
    return s.withColumn("nth", nth).select("id", X.symbol_hash(F.col("file"), F.col("name"), F.col("kind"), F.col("sg"), F.col("cls"), F.col("nth")).alias("derived"))


@query("cyclomatic_counts")
def cyclomatic_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every function and method of a known language; SQL cannot tell strings from code in most of them, so a plain model checks it in the tests."""
    t = load(spark, d, "source_texts").where(F.col("content").isNotNull() & extract.known_language(F.col("path"))).groupBy(F.col("path").alias("file")).agg(F.max("content").alias("content"))
    s = views.symbols(spark, d).where("kind in ('function', 'method') and start_line >= 1 and end_line >= start_line").select("id", "file", "start_line", "end_line")
    code = s.join(t, "file").select("id", "file", X.code_slice(F.col("content"), F.col("start_line"), F.col("end_line")).alias("code"))
    plain = F.col("file").rlike("\\.(java|c)$")
    return code.where(plain).select("id", X.cyclomatic(F.col("code")).alias("complexity")).unionByName(extract.complexities(code.where(~plain)))


@query("body_slice_lengths", sql("""
tx AS (SELECT path, string_split(max(content), chr(10)) AS ln FROM source_texts WHERE content IS NOT NULL GROUP BY path)
SELECT s.id, length(array_to_string(ln[start_line:end_line], chr(10)))::INT AS chars FROM s JOIN tx ON tx.path = s.file WHERE start_line >= 1 AND end_line >= start_line AND start_line <= len(ln)"""))
def body_slice_lengths(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "source_texts").where("content is not null").groupBy(F.col("path").alias("file")).agg(F.max("content").alias("content"))
    s = views.symbols(spark, d).where("start_line >= 1 and end_line >= start_line").select("id", "file", "start_line", "end_line").join(t, "file").where(F.col("start_line") <= F.size(F.split("content", "\n")))
    return s.select("id", F.char_length(X.code_slice(F.col("content"), F.col("start_line"), F.col("end_line"))).alias("chars"))


def _outlines(spark: SparkSession, d: str) -> DataFrame:
    return extract.outlines(load(spark, d, "source_texts").groupBy("path").agg(F.max("content").alias("content")))


@query("extracted_symbols")
def extracted_symbols(spark: SparkSession, d: str) -> DataFrame:
    return extract.symbols_of(_outlines(spark, d))


@query("extracted_calls")
def extracted_calls(spark: SparkSession, d: str) -> DataFrame:
    return extract.calls_of(_outlines(spark, d))


@query("extracted_imports")
def extracted_imports(spark: SparkSession, d: str) -> DataFrame:
    return extract.imports_of(_outlines(spark, d))


@query("cognitive_sum")
def cognitive_sum(spark: SparkSession, d: str) -> DataFrame:
    """Complexity of each file's functions and methods, added up."""
    s = extract.symbols_of(_outlines(spark, d)).where("kind in ('function', 'method')")
    return s.groupBy("file", "language").agg(F.sum(F.coalesce("complexity", F.lit(1))).alias("cyclomatic"), F.sum(F.coalesce("cognitive", F.lit(0))).alias("cognitive"), F.count("*").alias("functions"))


@query("extraction_agreement")
def extraction_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Per language, how many of the index's symbols the outlines find under the same name and kind."""
    got = extract.symbols_of(_outlines(spark, d)).select("file", "name", "kind").distinct().withColumn("found", F.lit(1))
    t = load(spark, d, "source_texts").where("content is not null").select(F.col("path").alias("file")).distinct()
    s = views.symbols(spark, d).where("name is not null").join(t, "file", "left_semi").select("file", "name", "kind", "language").distinct().join(got, ["file", "name", "kind"], "left")
    return s.groupBy("language").agg(F.count("*").alias("indexed"), F.count("found").alias("found"), F.round(F.count("found") / F.count("*"), 6).alias("share"))
