"""Index maintenance: diffs, upserts, removals, content hashes, git annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_hash(text):
    return F.substring(F.sha1(text), 1, 16)


def index_diff(old: DataFrame, new: DataFrame, complete: bool = True) -> DataFrame:
    """(path, change): new, changed, same or deleted by (modified, size, language); deletions only after a complete scan."""
    o = old.select("path", F.struct("last_modified", "size", "language").alias("o"))
    n = new.select("path", F.struct("last_modified", "size", "language").alias("n"))
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(F.col("o").eqNullSafe(F.col("n")), "same").otherwise("changed")
    out = o.join(n, "path", "full_outer").select("path", change.alias("change"))
    return out if complete else out.withColumn("change", F.when(F.col("change") == "deleted", "same").otherwise(F.col("change")))


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows replace those of the same path and inherit a commit count they lack."""
    kept = old.select(F.col("path").alias("_p"), F.col("commit_frequency").alias("_c"))
    fresh = new.join(kept, F.col("path") == F.col("_p"), "left").withColumn("commit_frequency", F.coalesce("commit_frequency", "_c")).select(*old.columns)
    return old.join(new.select("path"), "path", "left_anti").select(*old.columns).unionByName(fresh)


def remove_files(gone: DataFrame, symbols: DataFrame, refs: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables without what the files own; calls from other files survive, unresolved where their target went."""
    g = gone.select(F.col("path").alias("file")).distinct()
    lost = symbols.join(g, "file", "left_semi").select(F.col("id").alias("_lost"))
    r = refs.join(g, "file", "left_anti").join(lost, F.col("target_id") == F.col("_lost"), "left")
    r = r.withColumn("target_id", F.when(F.col("_lost").isNull(), F.col("target_id"))).drop("_lost")
    return symbols.join(g, "file", "left_anti"), r, imports.join(g, "file", "left_anti")


def apply_history(files: DataFrame, counts: DataFrame) -> DataFrame:
    """``commit_frequency`` replaced: 0 for analysed files without commits."""
    c = counts.groupBy(F.col("path").alias("_p")).agg(F.sum("commits").cast("int").alias("_n"))
    return files.join(c, F.col("path") == F.col("_p"), "left").withColumn("commit_frequency", F.coalesce("_n", F.lit(0))).drop("_p", "_n")


def clear_history(files: DataFrame) -> DataFrame:
    return files.withColumn("commit_frequency", F.lit(None).cast("int"))


def stale_analysis(meta: DataFrame, head: str, window_days: int, now_ms: int, max_age_ms: int = 86_400_000) -> DataFrame:
    """Why a stored analysis is stale (``reason`` null where it is fresh)."""
    reason = F.when(F.col("head") != head, "head moved").when(F.col("window_days") != window_days, "window changed").when(F.lit(now_ms) - F.col("analyzed_at") > max_age_ms, "too old")
    return meta.withColumn("reason", reason)
