"""Notes anchored to code, and whether they still hold."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEVERITY = ("fresh", "unverified", "stale", "missing")


def anchor_verdicts(anchors: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each anchor (note_id, file, symbol, file_hash, signature) with verdict and detail.

    missing: the file is not indexed; unverified: no hash was kept; fresh: the hash is the
    same; stale: it differs, in detail by what became of the symbol.
    """
    f = files.select(F.col("path").alias("_p"), F.col("content_hash").alias("_h"))
    s = symbols.where("name is not null").groupBy(F.col("file").alias("_sf"), F.col("name").alias("_sn")).agg(F.min("signature").alias("_lo"), F.max("signature").alias("_hi"))
    j = anchors.join(f, F.col("file") == F.col("_p"), "left").join(s, (F.col("file") == F.col("_sf")) & (F.col("symbol") == F.col("_sn")), "left")
    verdict = F.when(F.col("_p").isNull(), "missing").when(F.col("file_hash").isNull() | F.col("_h").isNull(), "unverified").when(F.col("file_hash") == F.col("_h"), "fresh").otherwise("stale")
    same = F.col("signature").eqNullSafe(F.col("_lo")) | F.col("signature").eqNullSafe(F.col("_hi"))
    detail = F.when(F.col("symbol").isNull(), "file changed").when(F.col("_sf").isNull(), "symbol renamed or removed").when(same, "signature intact").otherwise("signature changed")
    return j.withColumn("verdict", verdict).withColumn("detail", F.when(F.col("verdict") == "stale", detail)).drop("_p", "_h", "_sf", "_sn", "_lo", "_hi")


def note_verdicts(notes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The worst verdict over a note's anchors; unverified without anchors."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(SEVERITY) for x in (v, i)]), F.col("verdict"))
    w = verdicts.groupBy(F.col("note_id").alias("_n")).agg(F.max(rank).alias("_r"), F.count("*").alias("_k"))
    names = F.array(*[F.lit(v) for v in SEVERITY])
    out = notes.join(w, F.col("id") == F.col("_n"), "left")
    return out.withColumn("verdict", F.get(names, F.coalesce("_r", F.lit(1)))).withColumn("anchor_count", F.coalesce("_k", F.lit(0))).drop("_n", "_r", "_k")


def suspect_notes(verdicts: DataFrame, files: DataFrame) -> DataFrame:
    """(file, suspects, suspects_in_all): notes with a stale or missing anchor on each file of ``files`` (path), and on all together, each once."""
    v = verdicts.where(F.col("verdict").isin("stale", "missing")).join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    all_ = v.agg(F.count_distinct("note_id").alias("suspects_in_all"))
    return v.groupBy("file").agg(F.count_distinct("note_id").alias("suspects")).crossJoin(F.broadcast(all_))


def notes_of_context(notes: DataFrame, anchors: DataFrame, targets: DataFrame, shown: int = 3) -> DataFrame:
    """(target_id, note_id, place, omitted) of each target (target_id, file, name): notes on the symbol, then on the file, newest first.

    A note with several anchors counts once, by its best; ``omitted`` is how many are not shown.
    """
    simple = F.element_at(F.split("symbol", "[.#:]+"), -1)
    a = anchors.select(F.col("file").alias("_f"), simple.alias("_s"), "note_id")
    j = targets.select("target_id", "file", "name").join(a, (F.col("file") == F.col("_f")) & (F.col("_s").isNull() | (F.col("_s") == F.col("name"))))
    j = j.groupBy("target_id", "note_id").agg(F.min(F.when(F.col("_s").isNull(), 1).otherwise(0)).alias("level"))
    j = j.join(notes.select(F.col("id").alias("note_id"), "created_at"), "note_id")
    w = W.partitionBy("target_id")
    j = j.withColumn("place", F.row_number().over(w.orderBy("level", F.desc("created_at"), "note_id"))).withColumn("omitted", F.greatest(F.count("*").over(w) - shown, F.lit(0)))
    return j.where(F.col("place") <= shown).select("target_id", "note_id", "level", "place", "omitted")


def knowledge_counts(notes: DataFrame, anchors: DataFrame) -> DataFrame:
    a = anchors.groupBy("note_id").agg(F.count("*").alias("n"))
    n = notes.join(a, F.col("id") == F.col("note_id"), "left").agg(F.count_if(F.col("n").isNotNull()).alias("anchored"), F.count_if(F.col("n").isNull()).alias("unanchored"))
    return n.withColumn("files", F.lit(anchors.select("file").distinct().count()).cast("bigint"))


def recall(notes: DataFrame, anchors: DataFrame, query: list[str] | None = None, file: str | None = None, symbol: str | None = None, limit: int = 10) -> DataFrame:
    """Notes by file, symbol (qualified or simple) and words (any), newest first."""
    if file or symbol:
        a = anchors
        if file:
            a = a.where(F.startswith("file", F.lit(file)) if file.endswith("/") else F.col("file") == file)
        if symbol:
            simple = F.element_at(F.split("symbol", "[.#:]+"), -1)
            a = a.where((F.col("symbol") == symbol) | (simple == symbol))
        notes = notes.join(a.select(F.col("note_id").alias("id")).distinct(), "id", "left_semi")
    if query:
        hit = F.lit(False)
        for q in query:
            hit = hit | F.contains(F.lower("text"), F.lit(q.lower()))
        notes = notes.where(hit)
    return notes.orderBy(F.desc("created_at"), "id").limit(limit)


class NoteStore:
    """Notes as versioned Parquet folders; the newest complete version counts."""

    VERSION = 1

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        top = self._path("")
        if not self._fs.exists(top):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(top)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and self._fs.exists(self._path(f"{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        """The newest version that can be read; one that is damaged or foreign is put aside under ``.bad-``."""
        for v in reversed(self.versions()):
            df, state = self._open(v)
            if state != "damaged":
                return df
            self._fs.rename(self._path(f"v{v}"), self._path(f".bad-v{v}-{uuid.uuid4().hex[:8]}"))
        return None

    def _open(self, v: int) -> tuple[DataFrame | None, str]:
        """(table, ``ok``, ``newer`` or ``damaged``) of a version."""
        try:
            df = self.spark.read.parquet(f"{self.root}/v{v}")
            if not {"id", "text", "created_at", "anchors", "schema_version"} <= set(df.columns):
                return None, "damaged"
            top = df.agg(F.max("schema_version")).first()[0]
        except (AnalysisException, PySparkException):
            return None, "damaged"
        return df, "newer" if (top or 0) > self.VERSION else "ok"

    def read_only(self) -> bool:
        """Whether the newest version was written by a later release: it may be read, not replaced."""
        v = self.versions()
        return bool(v) and self._open(v[-1])[1] == "newer"

    def write(self, df: DataFrame) -> int:
        """A new version: written aside, then renamed, so a reader never sees half of it."""
        if self.read_only():
            raise PermissionError("these notes were written by a later release")
        v = (self.versions() or [0])[-1] + 1
        aside = f".tmp-{uuid.uuid4().hex}"
        df.withColumn("schema_version", F.lit(self.VERSION)).write.parquet(f"{self.root}/{aside}")
        if not self._fs.rename(self._path(aside), self._path(f"v{v}")):
            raise OSError(f"could not publish version {v}")
        return v

    def remember(self, text: str, anchors: list[dict], created_at: str, max_chars: int = 4000) -> str:
        if not text.strip() or len(text) > max_chars:
            raise ValueError("a note has 1 to 4000 characters")
        note = uuid.uuid4().hex[:16]
        kind = "id string, text string, created_at string, anchors array<struct<file string, symbol string, file_hash string, signature string>>"
        row = self.spark.createDataFrame([(note, text, created_at, [(a.get("file"), a.get("symbol"), a.get("file_hash"), a.get("signature")) for a in anchors])], kind)
        old = self.read()
        self.write(row if old is None else old.drop("schema_version").unionByName(row))
        return note

    def forget(self, note: str) -> bool:
        old = self.read()
        if old is None or not old.where(F.col("id") == note).limit(1).count():
            return False
        self.write(old.drop("schema_version").where(F.col("id") != note))
        return True
