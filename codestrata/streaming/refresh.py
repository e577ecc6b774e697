"""Live refresh: batches of changed files applied to all index tables, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.operators import extract, lookup, maintain, rules
from codestrata.session import cut

#: A batch of events: ``content`` null with ``deleted`` false is a file that could not be read.
EVENT = "path string, ts timestamp, seq long, deleted boolean, content string, size long, last_modified double"


def latest_per_path(batch: DataFrame) -> DataFrame:
    """One event per path: the newest; deletions lose against a later change."""
    w = W.partitionBy("path").orderBy(F.desc("ts"), F.desc("seq"))
    return batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def apply_batch(files: DataFrame, batch: DataFrame) -> DataFrame:
    """``files`` after a batch (path, ts, seq, deleted, and file columns).

    Deletions go first. A change whose content hash is the indexed one is an echo and
    changes nothing.
    """
    one = latest_per_path(batch)
    gone = one.where("deleted").select("path")
    kept = files.join(gone, "path", "left_anti")
    known = kept.select(F.col("path").alias("_p"), F.col("content_hash").alias("_h"))
    fresh = one.where("not deleted").join(known, F.col("path") == F.col("_p"), "left").where(F.col("_h").isNull() | ~F.col("_h").eqNullSafe(F.col("content_hash")))
    return maintain.upsert_files(kept, fresh.select(*files.columns))


def rows_of(texts: DataFrame) -> dict[str, DataFrame]:
    """The tables symbols, refs and imports of texts (path, content); calls are resolved in their file by its language's rules."""
    out = cut(extract.outlines(texts))
    symbols = extract.symbols_of(out)
    calls = extract.calls_of(out).withColumn("ref_id", F.xxhash64("file", "ord"))
    lang = out.select("path", "language")
    target = rules.resolve_by_rules(calls.withColumn("is_new", F.lit(False)), symbols, lang).withColumnRenamed("resolved_id", "target_id")
    refs = calls.join(target, "ref_id").select("ref_id", "source_id", "target_id", "target_name", "kind", "file", "line", "receiver", "self_receiver")
    return {"symbols": symbols, "refs": refs, "imports": extract.imports_of(out)}


class LiveIndex:
    """Index tables under ``root``, in ``buckets`` partitions by path. A batch rewrites the buckets of its paths only.

    The files table is written last and alone decides what counts as an echo, so a batch that
    broke off is applied again in full, and one applied twice changes nothing.
    """

    TABLES = {"symbols": "file", "refs": "file", "imports": "file", "files": "path"}
    SCHEMAS = {
        "symbols": "id string, name string, fqn string, kind string, start_line int, end_line int, signature string, doc string, exported boolean, complexity int, cognitive int, file string, language string",
        "refs": "ref_id long, source_id string, target_id string, target_name string, kind string, file string, line int, receiver string, self_receiver boolean",
        "imports": "file string, pos int, source_module string, line int, name string, alias string, kind string",
        "files": "path string, repo string, language string, size long, last_modified double, last_indexed long, symbol_count int, content_hash string, commit_frequency int",
    }

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, max_bytes: int = 1_048_576):
        self.spark, self.root, self.buckets, self.max_bytes = spark, root.rstrip("/"), buckets, max_bytes

    def _exists(self, table: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, table: str) -> DataFrame | None:
        return self._stored(table).drop("bucket") if self._exists(table) else None

    def _stored(self, table: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMAS[table] + ", bucket int").parquet(f"{self.root}/{table}")

    def _bucket(self, column: str):
        return F.pmod(F.xxhash64(F.col(column)), F.lit(self.buckets)).cast("int")

    def _touched(self, table: str, buckets: list[int]) -> DataFrame | None:
        return self._stored(table).where(F.col("bucket").isin(*buckets)).drop("bucket") if self._exists(table) else None

    def _rewrite(self, table: str, buckets: list[int], gone: DataFrame, new: DataFrame) -> None:
        key = self.TABLES[table]
        old = self._touched(table, buckets)
        new = new.select(*[c.split()[0] for c in self.SCHEMAS[table].split(", ")])
        if old is not None:
            new = old.join(gone.select(F.col("path").alias(key)), key, "left_anti").unionByName(new)
        full = cut(new.withColumn("bucket", self._bucket(key)))
        full.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/{table}")
        left = {r[0] for r in full.select("bucket").distinct().collect()}
        for b in set(buckets) - left:  # an emptied bucket has no rows that would overwrite it
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/bucket={b}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def outcomes(self, batch: DataFrame) -> DataFrame:
        """The batch's newest event of each path with its outcome: deleted, unread, too large, echo, new or changed."""
        one = latest_per_path(batch).withColumn("content_hash", maintain.content_hash(F.col("content")))
        files = self.read("files")
        if files is None:
            one = one.withColumn("_h", F.lit(None).cast("string")).withColumn("_there", F.lit(False))
        else:
            one = one.join(files.select("path", F.col("content_hash").alias("_h"), F.lit(True).alias("_there")), "path", "left")
        change = F.when(F.col("_there"), "changed").otherwise("new")
        same = F.col("_h").eqNullSafe(F.col("content_hash")) & F.coalesce("_there", F.lit(False))
        outcome = F.when(F.col("deleted"), "deleted").when(F.col("content").isNull(), "unread").when(F.col("size") > self.max_bytes, "too large").when(same, "echo").otherwise(change)
        return one.withColumn("outcome", outcome).drop("_h", "_there")

    def apply(self, batch: DataFrame) -> DataFrame:
        """Applies a batch (:data:`EVENT`) and gives (path, outcome)."""
        seen = cut(self.outcomes(batch))
        work = seen.where("outcome in ('deleted', 'new', 'changed', 'too large')")
        buckets = [r[0] for r in work.select(self._bucket("path").alias("b")).distinct().collect()]
        if buckets:
            gone = work.select("path")
            fresh = work.where("outcome in ('new', 'changed')")
            tables = rows_of(fresh.select("path", "content"))
            count = tables["symbols"].groupBy(F.col("file").alias("path")).agg(F.count("*").cast("int").alias("symbol_count"))
            tables["files"] = fresh.join(count, "path", "left").select(
                "path", F.split("path", "/")[0].alias("repo"), lookup.detect_language(F.col("path")).alias("language"), "size", "last_modified",
                F.unix_millis("ts").alias("last_indexed"), F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"), "content_hash", F.lit(None).cast("int").alias("commit_frequency"),
            )
            for table in self.TABLES:
                self._rewrite(table, buckets, gone, tables[table])
        return seen.select("path", "outcome")


def start(spark: SparkSession, events: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """A query that applies each micro-batch to a files table. ``write`` gets the batch's number, so a repeated batch can be told."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write(apply_batch(read(), batch), number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
