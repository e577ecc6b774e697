"""Problem 5: items that appear together in the same basket more often than chance.

Baskets are cleaned and deduplicated, each basket emits its ordered pairs once, counts
are combined map-side, and the marginals give lift and pointwise mutual information.

Defined results: baskets without a key, a null or empty item list, and null or empty items
are ignored; an item counts once per basket; of several deliveries of one basket the
least (group, items) is taken; a null group is a group of its own; an empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.registry import query
from codestrata.llm.skew import salted_join
from codestrata.session import cut, load


def clean_path(c):
    """A path without one trailing CR and one leading ``./``."""
    return F.regexp_replace(F.regexp_replace(c, "\\r$", ""), "^\\./", "")


def baskets(rows: DataFrame, key: str, group: str, items: str, clean=clean_path, max_items: int | None = 30) -> DataFrame:
    """One row (basket, grp, items) per key, with sorted distinct non-empty items.

    Baskets over ``max_items`` distinct items are left out: that gate is part of the
    definition of a co-change, not a cap against skew.
    """
    tidy = F.array_sort(F.array_distinct(F.filter(F.transform(F.col(items), clean), lambda x: x.isNotNull() & (x != ""))))
    df = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("basket"), F.col(group).alias("grp"), tidy.alias("items"))
    df = df.groupBy("basket").agg(F.min(F.struct("grp", "items")).alias("m")).select("basket", "m.grp", "m.items")
    df = df.where(F.size("items") > 0)
    return df.where(F.size("items") <= max_items) if max_items else df


def _group_key(name: str):
    """A group as text that is never null, so that a null group joins like any other."""
    return F.when(F.col(name).isNull(), "").otherwise(F.concat(F.lit("="), F.col(name).cast("string")))


def pair_counts(b: DataFrame, min_pair: int = 1, min_lift: float = 0.0) -> DataFrame:
    """Pairs (grp, item_a < item_b) with counts, lift and PMI in bits.

    Only pairs that reach ``min_pair`` meet the marginals, so the joins see a small side.
    ``min_lift`` is compared without division: pair_n * baskets >= min_lift * n_a * n_b.
    """
    pairs = F.expr(
        "flatten(transform(sequence(1, size(items) - 1), i -> transform(slice(items, i + 1, size(items)), y -> struct(items[i - 1] AS item_a, y AS item_b))))"
    )
    counted = (
        b.where(F.size("items") > 1).select("grp", F.explode(pairs).alias("p"))
        .groupBy("grp", "p.item_a", "p.item_b").agg(F.count("*").alias("pair_n")).where(F.col("pair_n") >= min_pair)
    )
    singles = b.select("grp", F.explode("items").alias("item")).groupBy("grp", "item").agg(F.count("*").alias("n"))
    # a group may hold most pairs: groups go to every task if they are few, else the pairs of a large one are spread
    totals = cut(b.groupBy(_group_key("grp").alias("gt")).agg(F.count("*").alias("baskets")))
    a = singles.select(F.col("grp").alias("ga"), F.col("item").alias("ia"), F.col("n").alias("n_a"))
    z = singles.select(F.col("grp").alias("gb"), F.col("item").alias("ib"), F.col("n").alias("n_b"))
    met = (
        counted.join(a, F.col("grp").eqNullSafe(F.col("ga")) & (F.col("item_a") == F.col("ia")))
        .join(z, F.col("grp").eqNullSafe(F.col("gb")) & (F.col("item_b") == F.col("ib")))
        .withColumn("gt", _group_key("grp"))
    )
    out = (
        salted_join(met, totals, ["gt"])
        .where(F.col("pair_n") * F.col("baskets") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    )
    lift = F.col("pair_n") * F.col("baskets") / (F.col("n_a") * F.col("n_b"))
    return out.select(
        "grp", "item_a", "item_b", "pair_n", "n_a", "n_b", "baskets",
        F.round(lift, 6).alias("lift"), F.round(F.log(lift) / F.log(F.lit(2.0)), 6).alias("pmi"),
    )


_BASKETS = """
WITH cleaned AS (
  SELECT commit_ord, repo, list_sort(list_distinct(list_filter(list_transform(files,
    lambda f: regexp_replace(regexp_replace(f, '\\r$', ''), '^\\./', '')), lambda f: f IS NOT NULL AND f <> ''))) AS items
  FROM raw_commits WHERE commit_ord IS NOT NULL AND files IS NOT NULL),
b AS (SELECT commit_ord, any_value(repo) AS repo, any_value(items) AS items FROM cleaned GROUP BY commit_ord),
g AS (SELECT * FROM b WHERE len(items) BETWEEN 1 AND 30),
one AS (SELECT repo, commit_ord, unnest(items) AS item FROM g),
n1 AS (SELECT repo, item, count(*) AS n FROM one GROUP BY ALL),
nt AS (SELECT repo, count(*) AS baskets FROM g GROUP BY ALL),
pr AS (SELECT x.repo, x.item AS a, y.item AS b, count(*) AS s FROM one x JOIN one y
       ON x.commit_ord = y.commit_ord AND x.item < y.item GROUP BY ALL HAVING count(*) >= 4),
res AS (SELECT pr.repo, a, b, s, na.n AS n_a, nb.n AS n_b, baskets FROM pr
  JOIN n1 na ON na.repo = pr.repo AND na.item = a JOIN n1 nb ON nb.repo = pr.repo AND nb.item = b
  JOIN nt ON nt.repo = pr.repo WHERE s * baskets >= 3 * na.n * nb.n)
"""


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return pair_counts(baskets(load(spark, d, "raw_commits"), "commit_ord", "repo", "files"), min_pair=4, min_lift=3)


@query("p5_found", _BASKETS + "SELECT DISTINCT a AS file_a, b AS file_b FROM res")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select(F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b")).distinct()


@query("p5_pairs", _BASKETS + """SELECT repo, a AS file_a, b AS file_b, s AS together, n_a AS commits_a, n_b AS commits_b, baskets AS commits,
  round(s * baskets / (n_a * n_b), 6) AS lift, round(log2(s * baskets / (n_a * n_b)), 6) AS pmi FROM res""")
def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select(
        F.col("grp").alias("repo"), F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"), F.col("pair_n").alias("together"),
        F.col("n_a").alias("commits_a"), F.col("n_b").alias("commits_b"), F.col("baskets").alias("commits"), "lift", "pmi",
    )
