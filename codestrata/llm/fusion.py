"""Problem 1: one ranking from several scores on different scales.

Each score is standardised robustly, z = (x - median) / (1.4826 * MAD), squashed by the
logistic function into (0, 1), and the bounded values are combined by a weighted geometric
mean. No score can dominate through its range, and outliers saturate.

All statistics are exact and computed on *cells*, the distinct score combinations with
their row counts, so one map-side combined pass sees the rows.

Defined results: a null score counts as the median (0.5 after squashing), so it neither lifts
nor sinks a row; a row without any score gets a null fused value and a null rank; where the
MAD is 0, 1.2533 times the mean absolute deviation stands in, and where that is 0 as well,
z is 0. NaN counts as null. The rank is taken from the logarithm of the mean, to ten places,
before ``fused`` is rounded for display; rows that saturate to the same value there are
ordered by the weighted sum of z. Ties share a rank, as in SQL's RANK.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.llm.registry import query
from codestrata.session import cut, load


FEW_CELLS, HOT_CELL = 500_000, 1_000_000  # a cell is about 50 bytes


def exact_median(cells: DataFrame, value, weight: str = "n", limit: int = 100_000) -> float | None:
    """The exact interpolated median of ``value`` with row counts ``weight``.

    Narrows a bracket around the middle by approximate quantiles until it holds at most
    ``limit`` distinct values; only those reach the driver.
    """
    v = cells.select(value.cast("double").alias("v"), F.col(weight).alias("w")).where("v is not null").groupBy("v").agg(F.sum("w").alias("w"))
    total, lo, hi = v.agg(F.sum("w"), F.min("v"), F.max("v")).first()
    if not total:
        return None
    want = sorted({(total - 1) // 2, total // 2})
    below = 0
    while True:
        inside = v.where((F.col("v") >= lo) & (F.col("v") <= hi))
        rows = inside.limit(limit + 1).count()
        if rows <= limit:
            break
        n = inside.agg(F.sum("w")).first()[0]
        f0, f1 = (want[0] - below) / n, (want[-1] - below + 1) / n
        q = inside.agg(F.expr(f"percentile_approx(v, array({max(0.0, f0 - 0.01)}D, {min(1.0, f1 + 0.01)}D), 10000)")).first()[0]
        at = v.where(F.col("v") < q[0]).agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
        top = v.where(F.col("v") <= q[1]).agg(F.sum("w")).first()[0]
        # percentile_approx weighs distinct values, not rows: keep an end that would cut off the middle
        nlo = q[0] if at <= want[0] else lo
        nhi = q[1] if top > want[-1] else hi
        if (nlo, nhi) == (lo, hi):
            mid = inside.agg(F.expr("percentile_approx(v, 0.5D, 10000)")).first()[0]
            up_to = v.where(F.col("v") <= mid).agg(F.sum("w")).first()[0]
            if up_to > want[-1]:
                nhi = mid
            elif up_to <= want[0]:
                nlo = mid
            else:
                return (mid + v.where(F.col("v") > mid).agg(F.min("v")).first()[0]) / 2
        below = v.where(F.col("v") < nlo).agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
        lo, hi = nlo, nhi
    got, seen = [], below
    for x, w in sorted((r[0], r[1]) for r in inside.collect()):
        seen += w
        while len(got) < len(want) and seen > want[len(got)]:
            got.append(x)
    return sum(got) / len(got)


def robust_stats(cells: DataFrame, column: str) -> tuple[float, float]:
    """(median, scale) of a column; scale 0 where all values are equal."""
    med = exact_median(cells, F.col(column))
    if med is None:
        return 0.0, 0.0
    dev = F.abs(F.col(column) - F.lit(med))
    mad = exact_median(cells, dev)
    if mad:
        return med, 1.4826 * mad
    mean = cells.where(F.col(column).isNotNull()).agg(F.sum(dev * F.col("n")) / F.sum("n")).first()[0]
    return med, 1.2533 * (mean or 0.0)


def global_rank(cells: DataFrame, keys: list[str], weight: str = "n", buckets: int = 200) -> DataFrame:
    """``cells`` with ``rank``: 1 + the number of rows with greater ``keys`` (compared in turn), without one global sort.

    Values of the first key fall into quantile buckets; bucket totals (at most ``buckets`` + 1
    numbers) give the offsets, and windows rank inside each bucket. Cells with a null first key get none.
    """
    first = F.col(keys[0])
    cuts = cells.agg(F.percentile_approx(first, [i / buckets for i in range(1, buckets)], 10000)).first()[0] or []
    bounds = F.array(*[F.lit(float(x)) for x in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    s = cut(cells.withColumn("__bucket", F.when(first.isNotNull(), F.size(F.filter(bounds, lambda b: b <= first)))))
    sums = sorted(((r[0], r[1]) for r in s.where(first.isNotNull()).groupBy("__bucket").agg(F.sum(weight)).collect()), reverse=True)
    offset, pairs = 0, []
    for b, n in sums:
        pairs += [F.lit(b), F.lit(offset)]
        offset += n
    start = F.element_at(F.create_map(*pairs), F.col("__bucket")) if pairs else F.lit(0)
    up_to = F.sum(weight).over(W.partitionBy("__bucket").orderBy(*[F.col(k).desc() for k in keys]).rangeBetween(W.unboundedPreceding, W.currentRow))
    peers = F.sum(weight).over(W.partitionBy("__bucket", *keys))
    return s.withColumn("rank", F.when(first.isNotNull(), (start + up_to - peers + 1).cast("bigint"))).drop("__bucket")


def fuse(df: DataFrame, scores: dict[str, float], round_to: int = 6) -> DataFrame:
    """``df`` with ``fused`` in (0, 1) and ``rank`` in place of any such columns; ``scores``: column -> weight."""
    names = list(scores)
    plain = df.drop("fused", "rank")
    for c in names:
        plain = plain.withColumn(c, F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c)))
    inner = {c: f"__score_{i}" for i, c in enumerate(names)}
    cells = cut(plain.groupBy(*[F.col(c).alias(a) for c, a in inner.items()]).agg(F.count("*").alias("n")))
    logs, raws = F.lit(0.0), F.lit(0.0)
    for c, a in inner.items():
        med, scale = robust_stats(cells, a)
        z = F.coalesce((F.col(a) - F.lit(med)) / F.lit(scale), F.lit(0.0)) if scale else F.lit(0.0)  # unknown: as the median
        logs = logs - F.lit(float(scores[c])) * F.log1p(F.exp(F.least(F.lit(700.0), -z)))
        raws = raws + F.lit(float(scores[c])) * z
    known = F.coalesce(*[F.col(a).cast("double") for a in inner.values()]).isNotNull()
    total = float(sum(scores.values()))
    cells = cells.withColumn("__log", F.when(known, F.round(logs, 10))).withColumn("__raw", F.round(raws, 6))
    table = global_rank(cells, ["__log", "__raw"]).withColumn("fused", F.round(F.exp(F.col("__log") / total), round_to))
    return _spread_back(plain, table.select(*inner.values(), "n", "fused", "rank"), inner)


def _spread_back(plain: DataFrame, table: DataFrame, inner: dict[str, str]) -> DataFrame:
    """The columns of each cell beside its rows. Few cells go to every task; else a cell of many rows is split."""
    n, hot = F.col("n"), F.col("n") > HOT_CELL
    if table.count() <= FEW_CELLS:
        on = [plain[c].eqNullSafe(F.col(a)) for c, a in inner.items()]
        return plain.join(F.broadcast(table), on, "left").drop("n", *inner.values())
    # at most rows / HOT_CELL cells are hot
    parts = table.where(hot).select(*[F.col(a).alias(f"{a}h") for a in inner.values()], F.ceil(n / HOT_CELL).alias("__parts"))
    salted = plain.join(F.broadcast(parts), [plain[c].eqNullSafe(F.col(f"{a}h")) for c, a in inner.items()], "left")
    salted = salted.withColumn("__salt", F.floor(F.rand(7) * F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts", *[f"{a}h" for a in inner.values()])
    table = table.withColumn("__part", F.explode(F.sequence(F.lit(0), F.when(hot, F.ceil(n / HOT_CELL)).otherwise(1).cast("int") - 1)))
    on = [salted[c].eqNullSafe(F.col(a)) for c, a in inner.items()] + [F.col("__salt") == F.col("__part")]
    return salted.join(table, on, "left").drop("n", "__salt", "__part", *inner.values())


def callable_scores(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, name, file, complexity, commit_frequency) of each function or method.

    Repeated ids count once. Complexity null means 1. Of a file's index rows the latest
    counts, and a known commit count before an unknown one.
    """
    s = symbols.where(F.trim(F.lower(F.regexp_replace("kind", "[\\s\\p{Z}]+", " "))).isin("function", "method"))
    s = s.groupBy("id").agg(*[F.max(c).alias(c) for c in ("name", "file", "complexity")])
    latest = F.max(F.struct("last_indexed", "commit_frequency")).alias("m")
    f = files.groupBy("path").agg(latest).select("path", F.col("m.commit_frequency").alias("commit_frequency"))
    return s.join(f, F.col("file") == F.col("path"), "left").select(
        "id", "name", "file", F.coalesce("complexity", F.lit(1)).alias("complexity"), "commit_frequency"
    )


_RANK_SQL = """
WITH s AS (SELECT id, max(name) AS name, max(file) AS file, max(complexity) AS complexity FROM symbols
  WHERE trim(lower(regexp_replace(kind, '[\\s\\p{Z}]+', ' ', 'g'))) IN ('function', 'method') GROUP BY id),
f AS (SELECT path, arg_max(commit_frequency, (last_indexed, coalesce(commit_frequency, -1))) AS cf0, max(last_indexed) AS li FROM files GROUP BY path),
ff AS (SELECT f.path, max(x.commit_frequency) AS commit_frequency FROM f JOIN files x ON x.path = f.path AND x.last_indexed = f.li GROUP BY f.path),
b AS (SELECT id, name, file, coalesce(complexity, 1) AS complexity, commit_frequency FROM s LEFT JOIN ff ON file = path),
m AS (SELECT median(complexity) AS mc, median(commit_frequency) AS mf FROM b),
d AS (SELECT median(abs(complexity - mc)) AS dc, avg(abs(complexity - mc)) AS ac, median(abs(commit_frequency - mf)) AS df, avg(abs(commit_frequency - mf)) AS af FROM b, m),
z AS (SELECT b.*, (complexity - mc) / (CASE WHEN dc > 0 THEN 1.4826 * dc ELSE 1.2533 * ac END) AS zc,
  (commit_frequency - mf) / (CASE WHEN df > 0 THEN 1.4826 * df ELSE 1.2533 * af END) AS zf FROM b, m, d),
r AS (SELECT id, name, file, complexity, commit_frequency,
  round(-ln(1 + exp(least(700.0, -zc))) - ln(1 + exp(least(700.0, -coalesce(zf, 0)))), 10) AS l, round(zc + coalesce(zf, 0), 6) AS w FROM z)
SELECT id, name, file, complexity, commit_frequency, round(exp(l / 2), 6) AS fused, rank() OVER (ORDER BY l DESC, w DESC) AS rank FROM r"""


@query("p1_ranking", _RANK_SQL)
def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    base = callable_scores(
        load(spark, d, "symbols").select("id", "name", "file", "kind", "complexity"),
        load(spark, d, "files").select("path", "last_indexed", "commit_frequency"),
    )
    return fuse(base, {"complexity": 1.0, "commit_frequency": 1.0})
