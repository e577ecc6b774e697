"""Problem 9: long exact spans shared between records.

Content-defined chunking. A gear rolling hash over the last 16 code points gives every
position a value; the lowest value of each 64 positions (the rightmost of equals) cuts, so
chunks vary, never exceed 64 code points, and the same text is cut alike wherever it
stands. Any span of 300 equal code points therefore holds a common cut within its first
80, and the chunks from it that end within the next 156 are equal. Then:

1. the digests of these runs of chunks are counted; a Bloom filter of those met more than
   once keeps the other cuts of the corpus from ever leaving their task;
2. of the cuts left, those whose chunks another record has go on (exact);
3. a record whose 300 code points from such a cut are in another record is certain;
4. elsewhere every 300-wide window that starts at most 80 before such a cut is digested.
   A shared window has a common cut that near its start, so this is exact.

Groups of equal digests are only ever aggregated (least and greatest record, count), never
collected or paired; the rows of one with very many are not shuffled.

Texts are chunked twice, once for the counts and once for the cuts that pass the filter: that is
cheaper than to write all cuts down.

Defined results: null and short texts share nothing; rows with the same key are one
record; a repeat inside one record is no case; a null key is ignored; an empty table
gives no rows; lengths are code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codestrata.llm.bloom import bloom_filter, contains
from codestrata.llm.registry import query
from codestrata.llm.skew import join_by_key
from codestrata.llm.tokens import slices
from codestrata.session import cut, load

GEAR, WINDOW = 16, 64
REACH = GEAR + WINDOW
FEW_RECORDS = 20_000
_U = np.uint64


def _mix(x):
    """splitmix64 of an array."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.size = base, pow(base, -1, 1 << 64), 0

    def upto(self, n):
        if n > self.size:
            self.size = n + n // 2
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    a = np.full(self.size, b, np.uint64)
                    a[0] = 1
                    setattr(self, name, np.cumprod(a))
        return self.up[:n], self.down


_P1, _P2 = _Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F)


class Chunked:
    """Cuts and window digests of several texts at once."""

    def __init__(self, texts: list[str]):
        gap = "\0" * WINDOW
        raw = np.frombuffer(gap.join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes + WINDOW)[:-1]])
        self.end = self.begin + sizes
        n = len(raw)
        self.code = raw.astype(np.uint64)
        with np.errstate(over="ignore"):
            h = (_mix(self.code) & _U(0xFFFFFFFF)).astype(np.uint32)
            for k in (1, 2, 4, 8):
                h[k:] = h[k:] + (h[:-k] << np.uint32(2 * k))
        key = (h.astype(np.uint64) << _U(32)) | (_U(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
        mask = np.zeros(n + 1, np.int32)
        ok = sizes >= GEAR
        np.add.at(mask, self.begin[ok] + GEAR - 1, 1)
        np.add.at(mask, self.end[ok], -1)
        none = _U(0xFFFFFFFFFFFFFFFF)
        key[np.cumsum(mask[:-1]) == 0] = none
        low = key
        for k in (1, 2, 4, 8, 16, 32):
            if len(low) > k:
                low = np.minimum(low[:-k], low[k:])
        low = np.unique(low[low != none])
        self.cuts = np.sort((_U(0xFFFFFFFF) - (low & _U(0xFFFFFFFF))).astype(np.int64))
        self.owner = np.searchsorted(self.begin, self.cuts, "right") - 1
        self.prefix = []
        for p, salt in ((_P1, 1), (_P2, 2)):
            up, _ = p.upto(n + 1)
            with np.errstate(over="ignore"):
                self.prefix.append(np.concatenate([[_U(0)], np.cumsum(_mix(self.code + _U(salt << 40)) * up[:n])]))

    def digest(self, start, stop, which: int):
        p = (_P1, _P2)[which]
        q = self.prefix[which]
        with np.errstate(over="ignore"):
            return _mix((q[stop] - q[start]) * p.down[start]).view(np.int64)


def _texts(batch):
    keys, texts = batch.column(0), batch.column(1).to_pylist()
    for i, j in slices(texts, 1 << 19):
        yield keys.slice(i, j - i), texts[i:j]


def _chunks(c: Chunked, span: int):
    """(cut, record, digest of the chunks from it) of each cut with ``span`` - REACH code points after it.

    The chunks are those that end within ``span`` - REACH - WINDOW code points: their ends do not depend on what follows.
    """
    keep = c.cuts + (span - REACH) <= c.end[c.owner]
    at = c.cuts[keep]
    last = c.cuts[np.searchsorted(c.cuts, at + (span - REACH - WINDOW), "right") - 1]
    return keep, at, c.owner[keep], c.digest(at, last, 0)


def _digest_batches(span):
    def run(batches):
        for b in batches:
            for _, texts in _texts(b):
                _, _, own, digest = _chunks(Chunked(texts), span)
                # once a text: np.unique of (owner, digest)
                pairs = np.unique(np.stack([own, digest]), axis=1) if len(own) else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1])], names=["chunk"])

    return run


def _near_batches(span, seen):
    def run(batches):
        for b in batches:
            for keys, texts in _texts(b):
                c = Chunked(texts)
                keep, at, own, digest = _chunks(c, span)
                before = np.concatenate([[-1], c.cuts[:-1]])[keep]
                near = contains(seen.value, digest)
                at, own, digest, before = at[near], own[near], digest[near], before[near]
                begin, whole = c.begin[own], at + span <= c.end[own]
                linked = whole & (before >= begin)
                stop = np.where(whole, at + span, at)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(own)), pa.array(at - begin), pa.array(c.end[own] - begin), pa.array(digest), pa.array(c.digest(np.where(linked, before, at), stop, 1), mask=~linked),
                        pa.array(c.digest(at, stop, 0), mask=~whole), pa.array(c.digest(at, stop, 1), mask=~whole),
                    ],
                    names=["rec", "pos", "chars", "chunk", "link", "whole_a", "whole_b"],
                )

    return run


def _window_batches(span):
    def run(batches):
        for b in batches:
            for rec, text, places in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw, starts = text.encode("utf-32-le", "surrogatepass"), set()
                for p in places:
                    starts.update(range(max(0, p - REACH), min(p, len(text) - span) + 1))
                starts = sorted(starts)
                if starts:
                    got = [xxhash.xxh3_128_digest(raw[4 * s : 4 * (s + span)]) for s in starts]
                    yield pa.RecordBatch.from_arrays([pa.array([rec.as_py()] * len(got), b.column(0).type), pa.array(starts, pa.int64()), pa.array(got, pa.binary())], names=["rec", "start", "window"])

    return run


def _in_several(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``df`` whose keys occur in at least two records; ``df`` is read three times."""
    held = df.groupBy(*keys).agg(F.min("rec").alias("lo"), F.max("rec").alias("hi"), F.count("*").alias("n")).where("lo < hi").select(*keys, "n")
    return join_by_key(df, held, list(keys), F.col("n"))


class _Shared:
    """The cuts of the records whose chunks another record has, and the windows over them."""

    def __init__(self, docs: DataFrame, key: str, text: str, span: int):
        if span < REACH + 2 * WINDOW:
            raise ValueError(f"span must be at least {REACH + 2 * WINDOW}")
        self.span, self.kind = span, docs.schema[key].dataType.simpleString()
        self.src = docs.select(F.col(key).alias("rec"), F.col(text).alias("txt")).where(F.col("rec").isNotNull() & (F.char_length("txt") >= span))
        digests = self.src.mapInArrow(_digest_batches(span), "chunk long").groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1").select("chunk")
        seen = docs.sparkSession.sparkContext.broadcast(bloom_filter(cut(digests), "chunk"))
        near = self.src.mapInArrow(_near_batches(span, seen), f"rec {self.kind}, pos long, chars long, chunk long, link long, whole_a long, whole_b long")
        self.near = cut(_in_several(cut(near), "chunk"))
        whole = cut(self.near.where("whole_a is not null").select("rec", "pos", "chars", "whole_a", "whole_b"))
        self.whole = cut(_in_several(whole, "whole_a", "whole_b").select("rec", "pos", "chars").distinct())

    def windows(self, cuts: DataFrame) -> DataFrame:
        """(rec, start) of the windows that another record has, of those that start at most REACH before a cut."""
        places = cut(cuts.groupBy("rec").agg(F.collect_set("pos").alias("places")))
        few = places.limit(FEW_RECORDS + 1).count() <= FEW_RECORDS
        joined = self.src.join(F.broadcast(places) if few else places, "rec").select("rec", "txt", "places")
        made = cut(joined.mapInArrow(_window_batches(self.span), f"rec {self.kind}, start long, window binary"))
        return _in_several(made, "window").select("rec", "start").distinct()


def sharing_records(docs: DataFrame, key: str, text: str, span: int = 300) -> DataFrame:
    """Distinct ``key`` of the records with ``span`` consecutive code points that another record has too."""
    s = _Shared(docs, key, text, span)
    sure = s.whole.select("rec").distinct()
    # a chunk of an undecided record: its windows are made in every record that has it
    unsure = cut(s.near.join(sure, "rec", "left_anti").groupBy("chunk").agg(F.first("n").alias("n")))
    found = sure.unionByName(s.windows(join_by_key(s.near.drop("n"), unsure, ["chunk"], F.col("n"))).select("rec")).distinct()
    return found.select(F.col("rec").alias(key))


def shared_amount(docs: DataFrame, key: str, text: str, span: int = 300) -> DataFrame:
    """(key, n_chars, shared_chars, shared_share) of each record with a shared span.

    ``shared_chars`` counts exactly the code points that lie in some stretch of ``span`` which another record has.
    """
    s = _Shared(docs, key, text, span)
    starts = s.whole.select("rec", F.col("pos").alias("start"))
    w = W.partitionBy("rec").orderBy("start")
    # where all records of a chunk agree from the cut before it to the end of its window, these two windows cover what lies between
    mixed = s.near.groupBy("chunk").agg(F.first("n").alias("n"), F.count("*").alias("all"), F.count("link").alias("linked"), F.min("link").alias("lo"), F.max("link").alias("hi"))
    mixed = cut(mixed.where(~(F.col("all").eqNullSafe(F.col("linked")) & F.col("lo").eqNullSafe(F.col("hi")))).select("chunk", "n"))
    every = cut(starts.unionByName(s.windows(join_by_key(s.near.drop("n"), mixed, ["chunk"], F.col("n")))).distinct())
    step = F.least(F.lit(span), F.coalesce(F.lead("start").over(w) - F.col("start"), F.lit(span)))
    amount = every.withColumn("n", step).groupBy("rec").agg(F.sum("n").alias("shared_chars"))
    sizes = s.near.groupBy("rec").agg(F.max("chars").alias("n_chars"))
    return amount.join(sizes, "rec").select(F.col("rec").alias(key), "n_chars", "shared_chars", F.round(F.col("shared_chars") / F.col("n_chars"), 6).alias("shared_share"))


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sharing_records(load(spark, d, "documents"), "doc_id", "text")


@query("p9_shared")
def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    return shared_amount(load(spark, d, "documents"), "doc_id", "text")
