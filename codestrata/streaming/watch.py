"""A source tree as a stream of changes, and what keeps a watcher going: rescans, retries, generations, shutdown."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import maintain
from codestrata.session import cut
from codestrata.sources import scan
from codestrata.streaming import refresh

#: Attempts of a partial rescan, entries of a memo, seconds of a shutdown.
ATTEMPTS, MEMO, SHUTDOWN = 5, 256, 10.0


def changes(spark: SparkSession, root: str, index: refresh.LiveIndex, config: scan.Config | None = None) -> DataFrame:
    """Events (:data:`refresh.EVENT`) for what differs between a tree and the index by time, size and language.

    Only files that are new or differ are opened. What is missing counts as deleted only where the listing is complete.
    """
    config = config or scan.Config()
    found, complete = scan.listing(spark, root, config)
    found = found.where("language <> 'unknown'")
    old = index.read("files")
    if old is None:
        old = spark.createDataFrame([], index.SCHEMAS["files"])
    diff = cut(maintain.index_diff(old, found, complete).where("change <> 'same'"))
    read = scan.read_files(spark, root, found.join(diff.where("change <> 'deleted'").select("path"), "path", "left_semi"))
    none = lambda kind: F.lit(None).cast(kind)
    made = read.select("path", F.current_timestamp().alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit(False).alias("deleted"), F.decode("data", "UTF-8").alias("content"), "size", "last_modified")
    gone = diff.where("change = 'deleted'").select("path", F.current_timestamp().alias("ts"), F.lit(1).cast("long").alias("seq"), F.lit(True).alias("deleted"), none("string").alias("content"), none("long").alias("size"), none("double").alias("last_modified"))
    return made.unionByName(gone)


def start(spark: SparkSession, root: str, index: refresh.LiveIndex, checkpoint: str, every: str = "1 second", config: scan.Config | None = None):
    """A query that keeps ``index`` in step with a tree: each tick applies :func:`changes`, with retries."""

    def tick(batch: DataFrame, number: int) -> None:
        with_retries(lambda: index.apply(changes(spark, root, index, config)))

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def with_retries(action: Callable, attempts: int = ATTEMPTS, wait: float = 0.1):
    """The result of ``action``; Spark and file errors are tried again, ``attempts`` times in all, after a growing pause."""
    for n in range(1, attempts + 1):
        try:
            return action()
        except (PySparkException, OSError):
            if n == attempts:
                raise
            time.sleep(wait * n)


class Generation:
    """Values remembered until :meth:`advance`, at most ``size`` of them, the least recently used going first."""

    def __init__(self, size: int = MEMO):
        self.number, self._size, self._memo, self._lock = 0, size, OrderedDict(), threading.Lock()

    def advance(self) -> int:
        with self._lock:
            self.number += 1
            self._memo.clear()
            return self.number

    def get(self, key, make: Callable):
        with self._lock:
            born = self.number
            if key in self._memo:
                self._memo.move_to_end(key)
                return self._memo[key]
        value = make()
        with self._lock:
            if born == self.number:  # a value made before the last advance is not kept
                self._memo[key] = value
                while len(self._memo) > self._size:
                    self._memo.popitem(last=False)
        return value


def shutdown(*queries, seconds: float = SHUTDOWN) -> bool:
    """Lets running queries finish what has arrived and stops them; False where that took longer than ``seconds``."""
    end = time.monotonic() + seconds

    def drain():
        for q in queries:
            if q.isActive:
                q.processAllAvailable()
            q.stop()

    t = threading.Thread(target=drain, daemon=True)
    t.start()
    t.join(max(0.0, end - time.monotonic()))
    if not t.is_alive():
        return True
    for q in queries:
        q.stop()
    return False
