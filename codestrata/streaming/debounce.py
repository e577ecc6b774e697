"""Debounced batches of change events: trailing quiet gap, hard deadline, keys once per batch."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def quiet_batches(events: DataFrame, group: list[str], ts: str, key: str, gap: str) -> DataFrame:
    """Batches that end at a gap of more than ``gap``, with their number of events and distinct keys."""
    w = W.partitionBy(*group).orderBy(ts, *([c for c in ("event_id",) if c in events.columns]))
    fresh = F.when(F.col(ts) - F.lag(ts).over(w) <= F.expr(f"INTERVAL {gap}"), 0).otherwise(1)
    b = events.withColumn("_fresh", fresh).withColumn("_batch", F.sum("_fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return b.groupBy(*group, "_batch").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("events"), F.count_distinct(key).alias("keys")).drop("_batch")


def deadline_batches(events: DataFrame, group: str, ts: str, key: str, gap_s: float, max_s: float) -> DataFrame:
    """Batches that end after ``gap_s`` of quiet or ``max_s`` after their first event, whichever is first.

    Events go past in order, a group after the other, and only the open batch is kept: nothing
    is collected, and a group of any length is one pass. A null key counts as no key.
    """
    gap, most = int(gap_s * 1e6), int(max_s * 1e6)
    kind = events.schema[group].dataType.simpleString()
    e = events.where(F.col(ts).isNotNull()).select(F.col(group).alias("grp"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(key).cast("string").alias("k"))

    def run(batches):
        here = first = last = None
        n, keys = 0, set()
        for b in batches:
            done = []
            for g, t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if n and (g != here or t - last > gap or t - first > most):
                    done.append((here, first, last, n, len(keys)))
                    n, keys = 0, set()
                if not n:
                    here, first = g, t
                last, n = t, n + 1
                if k is not None:
                    keys.add(k)
            if done:
                yield _closed(done, b.column(0).type)
        if n:
            yield _closed([(here, first, last, n, len(keys))], b.column(0).type)

    out = e.repartition("grp").sortWithinPartitions("grp", "t").mapInArrow(run, f"grp {kind}, first bigint, last bigint, events bigint, keys int")
    return out.select(F.col("grp").alias(group), F.timestamp_micros("first").alias("first_ts"), F.timestamp_micros("last").alias("last_ts"), "events", "keys")


def _closed(rows, kind):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:4]], pa.array(cols[4], pa.int32())], names=["grp", "first", "last", "events", "keys"])


def debounce_stream(events: DataFrame, group: str, ts: str, key: str, gap_s: float = 0.1, max_s: float = 1.0) -> DataFrame:
    """The streaming form: state (first, last, keys) per group; a batch leaves when the watermark passes last + gap or first + max.

    ``events`` needs a watermark on ``ts``. Late events below the watermark are dropped by Spark.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = events.schema[group].dataType.simpleString()
    gap, most = int(gap_s * 1000), int(max_s * 1000)

    def run(name, frames, state):
        first, last, n, keys = state.get if state.exists else (None, None, 0, [])
        seen = set(keys or [])
        done = []

        def flush():
            done.append((name[0], first, last, n, len(seen)))

        if state.hasTimedOut:
            flush()
            state.remove()
        else:
            rows = sorted((int(t.timestamp() * 1000), str(k)) for f in frames for t, k in zip(f[ts], f[key]))
            for t, k in rows:
                if first is not None and (t - last > gap or t - first > most):
                    flush()
                    first, n, seen = None, 0, set()
                first = t if first is None else first
                last, n = t, n + 1
                seen.add(k)
            state.update((first, last, n, sorted(seen)))
            state.setTimeoutTimestamp(max(min(last + gap, first + most) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["grp", "first_ms", "last_ms", "events", "keys"])

    return events.groupBy(group).applyInPandasWithState(
        run, f"grp {kind}, first_ms long, last_ms long, events long, keys long", "first long, last long, n long, keys array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )
