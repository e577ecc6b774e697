"""Commit history: counts, hotspots, co-change pairs and partners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def window_of(commits: DataFrame, now, days: int = 180) -> DataFrame:
    """Commits of the last ``days`` before ``now`` (timestamp literal or column)."""
    return commits.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def newest(commits: DataFrame, cap: int = 10_000) -> DataFrame:
    """The newest ``cap`` commits, a semantic limit of the analysis."""
    return commits.orderBy(F.desc_nulls_last("ts"), F.desc("commit_ord")).limit(cap)


def commit_counts(commits: DataFrame) -> DataFrame:
    return commits.select("repo", F.explode("files").alias("path")).groupBy("repo", "path").agg(F.count("*").alias("commits"))


def hotspots(counts: DataFrame, files: DataFrame, keep: int = 50) -> DataFrame:
    """Indexed paths by commits, then path."""
    return counts.join(files.select("path"), "path", "left_semi").orderBy(F.desc("commits"), "path").limit(keep)


def cochange(commits: DataFrame, files: DataFrame | None = None, min_shared: int = 3) -> DataFrame:
    """(repo, file_a < file_b, shared, conf_ab, conf_ba, last_seen); one side at least is indexed where ``files`` is given.

    Pairs come from each commit's sorted array, so no self-join shuffles; the count is combined map-side.
    """
    pair = F.expr("flatten(transform(sequence(1, size(files) - 1), i -> transform(slice(files, i + 1, size(files)), y -> struct(files[i - 1] AS file_a, y AS file_b))))")
    p = commits.where(F.size("files") > 1).select("repo", "ts", F.explode(pair).alias("p"))
    p = p.groupBy("repo", "p.file_a", "p.file_b").agg(F.count("*").alias("shared"), F.max("ts").alias("last_seen")).where(F.col("shared") >= min_shared)
    n = commit_counts(commits)
    a = n.select(F.col("repo").alias("ra"), F.col("path").alias("pa"), F.col("commits").alias("ca"))
    b = n.select(F.col("repo").alias("rb"), F.col("path").alias("pb"), F.col("commits").alias("cb"))
    p = p.join(a, F.col("repo").eqNullSafe(F.col("ra")) & (F.col("file_a") == F.col("pa"))).join(b, F.col("repo").eqNullSafe(F.col("rb")) & (F.col("file_b") == F.col("pb")))
    p = p.select("repo", "file_a", "file_b", "shared", F.round(F.col("shared") / F.col("ca"), 9).alias("conf_ab"), F.round(F.col("shared") / F.col("cb"), 9).alias("conf_ba"), "last_seen")
    if files is None:
        return p
    known = files.select("path").distinct()
    ka, kb = known.withColumnRenamed("path", "ka"), known.withColumnRenamed("path", "kb")
    return p.join(ka, F.col("file_a") == F.col("ka"), "left").join(kb, F.col("file_b") == F.col("kb"), "left").where("ka is not null or kb is not null").drop("ka", "kb")


def partners(pairs: DataFrame, keep: int = 20, top: int | None = None) -> DataFrame:
    """Both directions of each pair: the best partners of a file. ``pct`` is seen from the file, 1 at least."""
    a = pairs.select("repo", F.col("file_a").alias("file"), F.col("file_b").alias("partner"), "shared", F.col("conf_ab").alias("conf"))
    b = pairs.select("repo", F.col("file_b").alias("file"), F.col("file_a").alias("partner"), "shared", F.col("conf_ba").alias("conf"))
    both = a.unionByName(b).withColumn("pct", F.greatest(F.lit(1), F.floor(F.col("conf") * 100 + 0.5)).cast("int"))
    w = W.partitionBy("repo", "file")
    kept = both.withColumn("rank", F.row_number().over(w.orderBy(F.desc("shared"), "partner"))).where(F.col("rank") <= keep)
    if top is None:
        return kept
    best = F.row_number().over(w.orderBy(F.desc("pct"), F.desc("shared"), "partner"))
    return kept.withColumn("rank", best).where(F.col("rank") <= top)


def missing_partners(changes: DataFrame, pairs: DataFrame, min_pct: int = 50, keep: int = 2) -> DataFrame:
    """Usual partners of changed files that are not among the changes themselves."""
    p = partners(pairs, 20).where(F.col("pct") >= min_pct).join(changes.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    out = p.join(changes.select(F.col("path").alias("partner")).distinct(), "partner", "left_anti")
    w = W.partitionBy("file").orderBy(F.desc("pct"), F.desc("shared"), "partner")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select("file", "partner", "shared", "pct", "rank")


def recent(commits: DataFrame, n: int = 5) -> DataFrame:
    """The newest ``n`` commits of each path."""
    e = commits.select("repo", "commit_ord", "ts", F.explode("files").alias("path"))
    w = W.partitionBy("repo", "path").orderBy(F.desc_nulls_last("ts"), F.desc("commit_ord"))
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
