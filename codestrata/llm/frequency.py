"""Problem 3: how often every distinct value or term n-gram occurs, and in how many records.

Suffix-sorted counting. Every record is a sequence of terms. All its suffixes, truncated
to ``max_n`` terms, are routed by (field, first term) and sorted in reverse lexicographic
order, so a longer suffix comes before its prefixes. One pass with a stack then gives each
n-gram's occurrences and its set of records. Equal (suffix, record) rows are combined
before routing; a first term with more than ``hot_rows`` such rows is split by a hash of
the record, which keeps record sets disjoint, so sums over the splits stay exact.

Defined results: null values, null terms and empty sequences count nothing; a null record
still counts occurrences but no record; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.registry import query
from codestrata.session import cut, load

_GRAMS = "field string, gram array<string>, occurrences bigint, records bigint"
_OUT = pa.schema([("field", pa.string()), ("gram", pa.list_(pa.string())), ("occurrences", pa.int64()), ("records", pa.int64())])


def _stack_count(batches):
    """Stack pass over rows (field, salt, suffix, record, n), sorted by the first three."""
    stack: list = []  # [term, occurrences, records]
    here = None
    out: list = []

    def close(depth):
        while len(stack) > depth:
            gram = [x[0] for x in stack]
            _, n, recs = stack.pop()
            out.append((here[0], gram, n, len(recs)))
            if stack:
                stack[-1][1] += n
                if len(stack[-1][2]) < len(recs):
                    stack[-1][2], recs = recs, stack[-1][2]
                stack[-1][2] |= recs

    def flush():
        cols = list(zip(*out)) if out else [[], [], [], []]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _OUT)], schema=_OUT)

    for b in batches:
        field, salt, suffix, record, n = (b.column(c).to_pylist() for c in ("field", "salt", "suffix", "record", "n"))
        for i in range(len(n)):
            s, at = suffix[i], (field[i], salt[i])
            if at != here:
                close(0)
                here = at
            k, most = 0, min(len(stack), len(s))
            while k < most and stack[k][0] == s[k]:
                k += 1
            close(k)
            for t in s[k:]:
                stack.append([t, 0, set()])
            stack[-1][1] += n[i]
            if record[i] is not None:
                stack[-1][2].add(record[i])
        if len(out) > 5000:
            yield flush()
    if here is not None:
        close(0)
    yield flush()


def ngram_counts(seqs: DataFrame, max_n: int = 1, hot_rows: int = 200_000) -> DataFrame:
    """Counts of every n-gram of up to ``max_n`` terms.

    ``seqs``: columns field, record, terms (array<string>). Returns field, gram,
    occurrences, records (number of distinct records).
    """
    if max_n == 1:
        suffixes = F.transform("terms", lambda t: F.array(t))
    else:
        suffixes = F.transform("terms", lambda t, i: F.slice("terms", i + 1, max_n))
    rows = cut(
        seqs.where(F.size("terms") > 0).select("field", "record", F.explode(suffixes).alias("suffix"))
        .groupBy("field", "suffix", "record").agg(F.count("*").alias("n"))
    ).withColumn("head", F.col("suffix")[0])
    hot = rows.groupBy("field", "head").agg(F.count("*").alias("c")).where(F.col("c") > hot_rows)
    hot = hot.select(F.col("field").alias("hf"), F.col("head").alias("hh"), F.ceil(F.col("c") / hot_rows).cast("int").alias("parts"))
    # at most rows / hot_rows first terms are hot
    routed = rows.join(F.broadcast(hot), (F.col("field") == F.col("hf")) & (F.col("head") == F.col("hh")), "left").withColumn(
        "salt", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("record"), F.col("parts")).cast("int"))
    )
    ordered = (
        routed.repartition("field", "head", "salt")
        .sortWithinPartitions("field", "salt", F.col("suffix").desc())
        .select("field", "salt", "suffix", "record", "n")
    )
    return ordered.mapInArrow(_stack_count, _GRAMS).groupBy("field", "gram").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")
    )


_CF_FREE = re.compile("[^\x20-\x7e]")


def canonical(value: str | None) -> str | None:
    """NFC, without characters of category Cf, without outer white space of any kind."""
    if value is None:
        return None
    if _CF_FREE.search(value):
        value = unicodedata.normalize("NFC", value)
        value = "".join(c for c in value if unicodedata.category(c) != "Cf")
    return value.strip()


def _canon_batches(batches):
    for b in batches:
        cols = []
        for c in b.columns:
            d = c.dictionary_encode()
            table = pa.array([canonical(v) for v in d.dictionary.to_pylist()], pa.string())
            cols.append(table.take(d.indices))
        yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)


def canonical_columns(df: DataFrame, *names: str) -> DataFrame:
    """``names`` of string columns in canonical form; each distinct value is handled once per batch."""
    return df.mapInArrow(
        lambda it: (
            pa.RecordBatch.from_arrays(
                [c if n not in names else next(_canon_batches([pa.RecordBatch.from_arrays([c], names=[n])])).column(0) for n, c in zip(b.schema.names, b.columns)],
                names=b.schema.names,
            )
            for b in it
        ),
        df.schema,
    )


def _mark(records, files: int, rare_max: int = 2, common_one_in: int = 10):
    """``rare`` for few records, ``common`` for more than one in ``common_one_in`` of all, else null."""
    return F.when(records <= rare_max, "rare").when(records * common_one_in > files, "common")


def value_frequencies(symbols: DataFrame, rare_max: int = 2, common_one_in: int = 10, hot_rows: int = 200_000) -> DataFrame:
    """Occurrences and files of each distinct name and kind, marked ``rare``, ``common`` or null."""
    files = symbols.agg(F.count_distinct("file")).first()[0]
    tidy = canonical_columns(symbols.select(F.col("file").alias("record"), "name", "kind"), "name", "kind")
    pairs = F.array(
        F.struct(F.lit("name").alias("field"), F.col("name").alias("value")),
        F.struct(F.lit("kind").alias("field"), F.lower("kind").alias("value")),
    )
    seqs = tidy.select("record", F.explode(pairs).alias("p")).where("p.value is not null").select("p.field", "record", F.array("p.value").alias("terms"))
    mark = _mark(F.col("records"), files, rare_max, common_one_in)
    return ngram_counts(seqs, 1, hot_rows).select("field", F.col("gram")[0].alias("value"), "occurrences", F.col("records").alias("files"), mark.alias("mark"))


#: Characters of category Cf and all white space, as classes of the SQL engine's regular expressions.
_VAL = "regexp_replace(regexp_replace(regexp_replace(nfc_normalize({0}), '\\p{{Cf}}', '', 'g'), '^[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x{{85}}]+', ''), '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x{{85}}]+$', '')"
_FREQ = f"""
WITH v AS (SELECT 'name' AS field, {_VAL.format('name')} AS value, file FROM symbols
  UNION ALL SELECT 'kind', lower({_VAL.format('kind')}), file FROM symbols),
c AS (SELECT field, value, count(*) AS occurrences, count(DISTINCT file) AS files FROM v WHERE value IS NOT NULL GROUP BY ALL),
m AS (SELECT *, CASE WHEN files <= 2 THEN 'rare' WHEN 10 * files > (SELECT count(DISTINCT file) FROM symbols) THEN 'common' END AS mark FROM c)
"""


@query("p3_found", _FREQ + "SELECT field, value, mark FROM m WHERE mark IS NOT NULL")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return value_frequencies(load(spark, d, "symbols").select("name", "kind", "file")).where("mark is not null").select("field", "value", "mark")


@query("p3_values", _FREQ + "SELECT * FROM m")
def p3_values(spark: SparkSession, d: str) -> DataFrame:
    return value_frequencies(load(spark, d, "symbols").select("name", "kind", "file"))


def name_terms(c):
    """The lower-case words of an identifier: runs of letters, marks or digits of any script, split at case changes."""
    apart = F.regexp_replace(F.regexp_replace(c, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.lower(apart), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")


@query("p3_terms", rf"""
WITH n AS (SELECT file, {_VAL.format('name')} AS name FROM symbols WHERE name IS NOT NULL),
s AS (SELECT file, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda t: t <> '') AS w FROM n),
g AS (SELECT file, unnest(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(1, least(3, len(w) - i + 1) + 1), lambda n: array_to_string(w[i:i + n - 1], ' '))))) AS term FROM s),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT file) AS files FROM g GROUP BY ALL)
SELECT *, CASE WHEN files <= 2 THEN 'rare' WHEN 10 * files > (SELECT count(DISTINCT file) FROM symbols) THEN 'common' END AS mark FROM c""")
def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the word n-grams of names, up to three words, with the marks of p3_values."""
    symbols = load(spark, d, "symbols").select("name", "file")
    files = symbols.agg(F.count_distinct("file")).first()[0]
    tidy = canonical_columns(symbols.where("name is not null"), "name")
    s = tidy.select(F.lit("name").alias("field"), F.col("file").alias("record"), name_terms(F.col("name")).alias("terms"))
    return ngram_counts(s, 3).select(F.array_join("gram", " ").alias("term"), "occurrences", F.col("records").alias("files"), _mark(F.col("records"), files).alias("mark"))
