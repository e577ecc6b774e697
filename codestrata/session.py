"""Session helpers: table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, as Parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, as in tests, gets a
    temporary folder where that is unset; it is removed when the process ends.
    """
    sc = spark.sparkContext
    here = sc.getCheckpointDir()
    if here:
        return here
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="codestrata-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_all(*dfs: DataFrame) -> list[DataFrame]:
    """:func:`cut` of several tables that do not depend on each other, side by side."""
    ensure_checkpoint_dir(dfs[0].sparkSession)
    with ThreadPoolExecutor(len(dfs)) as pool:
        return list(pool.map(inheritable_thread_target(dfs[0].sparkSession)(lambda df: df.checkpoint(eager=True)), dfs))


def _store(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path, compression="zstd")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def store_all(*dfs: DataFrame) -> list[DataFrame]:
    """Several tables computed side by side and kept in the checkpoint folder as compressed Parquet, until the process ends.

    For tables that grow with the input: the rows that :func:`cut` writes are several times as large. The shuffle
    files behind them are of no more use; the driver's garbage collector is called, so that they go now.
    """
    spark = dfs[0].sparkSession
    ensure_checkpoint_dir(spark)
    with ThreadPoolExecutor(len(dfs)) as pool:
        out = list(pool.map(inheritable_thread_target(spark)(_store), dfs))
    spark._jvm.System.gc()
    return out


def store(df: DataFrame) -> DataFrame:
    return store_all(df)[0]


def discard(*dfs: DataFrame) -> None:
    """Removes the files of stored tables that nothing reads any more."""
    for df in dfs:
        spark = df.sparkSession
        for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def builder(app: str = "codestrata", cores: str | int = "*"):
    """A builder with the settings this engine is tuned for; master only where none is given."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return b if os.environ.get("MASTER") else b.master(f"local[{cores}]")
