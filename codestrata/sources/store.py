"""The index on disk: Parquet tables in versioned folders with a schema stamp."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
#: Sort columns that give scans of a name or a file narrow row groups.
SORT = {"symbols": ["file", "start_line"], "refs": ["target_name", "file"], "files": ["path"], "imports": ["file"], "commits": ["repo", "ts"]}


class IndexStore:
    """A disposable index: any mismatch of schema or project means a rebuild."""

    def __init__(self, spark: SparkSession, root: str, project: str):
        self.spark, self.root, self.project = spark, root.rstrip("/"), project

    def _hadoop(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._hadoop("")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def save(self, tables: dict[str, DataFrame]) -> int:
        v = (self.versions() or [0])[-1] + 1
        aside = f".tmp-{uuid.uuid4().hex}"
        for name, df in tables.items():
            out = df.sortWithinPartitions(*[c for c in SORT.get(name, []) if c in df.columns]) if name in SORT else df
            out.write.parquet(f"{self.root}/{aside}/{name}")
        meta = self.spark.createDataFrame([(SCHEMA_VERSION, self.project)], "schema_version int, project string")
        meta.coalesce(1).write.parquet(f"{self.root}/{aside}/_meta_table")
        (a, fs), (b, _) = self._hadoop(aside), self._hadoop(f"v{v}")
        if not fs.rename(a, b):
            raise OSError(f"could not publish version {v}")
        return v

    def load(self, name: str) -> DataFrame | None:
        """A table of the newest version, or None where there is none that fits."""
        for v in reversed(self.versions()):
            at = f"{self.root}/v{v}"
            try:
                ok = self.spark.read.parquet(f"{at}/_meta_table").where((F.col("schema_version") == SCHEMA_VERSION) & (F.col("project") == self.project)).count()
            except Exception:
                continue
            return self.spark.read.parquet(f"{at}/{name}") if ok else None
        return None
