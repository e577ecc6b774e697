"""Problem 8: held-out test items that leak into a large corpus.

MinHash containment search. Each item's own words (without instructions shared by several
items) form overlapping passages of three-word shingles. Items are partitioned by size:

* under 20 own words only 12 words in a row can leak: a passage's signature is the least of
  its 10 shingle hashes;
* longer items also leak by 20 words and more with one word in five changed, added or
  dropped: a passage's signature is the 15 least of its 18 hashes. Four changes leave at
  least six shingles, so some of them are in the signature, and of an item without repeated
  shingles at least two.

The signatures are a table keyed by shingle. The corpus is read once: a document of any
length stays only where some 44 shingles in a row hold six of any item (a Bloom filter of
bounded size tells, whatever the number of items), and only with those shingles. They are
joined to the table and counted per item; candidates are then verified exactly: 12 words in sequence, or an
alignment of the words, which looks at passages of 20 to 39 words (a longer one contains
one of these) and gives up at the eighth change. By these bounds no true pair is lost.

Prompts, signatures and candidates stay in tables; the driver sees counts and the filter.

Words: NFKC, case-folded, without characters of category Cf and without markup tags;
runs of letters and digits, joined over inner hyphens, underscores and apostrophes.

Defined results: null or empty prompts and texts match nothing; items with fewer than 12
own words cannot match; of repeated rows of an item the greatest prompt counts; repeated
rows of a document are reported once; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.bloom import bloom_filter, contains
from codestrata.llm.registry import query
from codestrata.llm.skew import salted_join
from codestrata.llm.tokens import slices
from codestrata.session import cut, load

RUN, PASSAGE, EDITS_IN, SHINGLE = 12, 20, 5, 3
SKETCH, LONGEST = 15, 39
MOST_EDITS = LONGEST // EDITS_IN
_U = np.uint64
STRETCH = LONGEST + MOST_EDITS - SHINGLE + 1
SURVIVE = PASSAGE - SHINGLE + 1 - SHINGLE * (PASSAGE // EDITS_IN)
_WORD = re.compile(r"[^\W_]+(?:[-_'’]+[^\W_]+)*")
_INNER = re.compile(r"[\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,120}>|&(?:nbsp|amp|lt|gt|quot|#\d+);")
_SENTENCE = re.compile(r"(?<=[.?!;:。？！])\s+|\n+")
_ODD = re.compile("[^\x00-\x7f]")


def words(text: str) -> list[str]:
    if _ODD.search(text):
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if c.isascii() or unicodedata.category(c) != "Cf")
    text = _TAG.sub(" ", text) if "<" in text or "&" in text else text
    return [_INNER.sub("", w) if not w.isalnum() else w for w in _WORD.findall(text.casefold())]


def _hash_words(ws: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in ws], np.uint64)


def _mix(x):
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def _shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the shingles that start at each word; needs SHINGLE words at least."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            out = _mix(out * np.uint64(3) + h[k : len(h) - SHINGLE + 1 + k])
        return out


def signature(ws: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(distinct shingles of an item, which of them are in a passage's signature, least number of these in a leak)."""
    sh = _shingles(_hash_words(ws))
    size, keep = (RUN, 1) if len(ws) < PASSAGE else (PASSAGE, SKETCH)
    rank = _mix(sh)
    chosen: set = set()
    for at in range(len(ws) - size + 1):
        part, where = np.unique(rank[at : at + size - SHINGLE + 1], return_index=True)
        chosen.update((where[:keep] + at).tolist())
    every = np.unique(sh)
    return every, np.isin(every, sh[sorted(chosen)]), 2 if size == PASSAGE and len(every) == len(sh) else 1


def _ids(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both texts as numbers of the words of ``a``; -1 for other words."""
    ids = {w: k for k, w in enumerate(dict.fromkeys(a))}
    return np.array([ids[w] for w in a], np.int64), np.array([ids.get(w, -1) for w in b], np.int64)


def _common(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At which words of ``x`` and of ``y`` a run of ``n`` words starts that the other has."""
    if len(x) < n or len(y) < n:
        return np.zeros(0, bool), np.zeros(0, bool)
    sides = []
    for z in (x, y):
        h = np.zeros(len(z) - n + 1, np.uint64)
        for k in range(n):
            h = _mix(h * _U(3) + z[k : len(h) + k].view(np.uint64))
        sides.append(h)
    return np.isin(sides[0], sides[1]), np.isin(sides[1], sides[0])


def has_run(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether RUN consecutive words of ``x`` are in ``y``."""
    known = np.convolve(y >= 0, np.ones(RUN, np.int64)) if len(y) else np.zeros(1)
    return bool((known >= RUN).any() and _common(x, y, RUN)[0].any())


def close_passage(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether some passage of at least PASSAGE words of ``x`` is in ``y`` with at most one edit per EDITS_IN words.

    A passage of 40 words or more has a half that does as well, so those of 20 to 39 words decide. Exact
    shingle containment comes first: they keep SURVIVE common shingles within LONGEST words of ``x`` and
    within STRETCH shingles of ``y``; only such places are aligned.
    """
    if len(x) < PASSAGE:
        return False
    in_x, in_y = _common(x, y, SHINGLE)
    if in_x.sum() < SURVIVE:
        return False
    total = np.concatenate([[0], np.cumsum(in_x)])
    stop = np.minimum(np.arange(len(in_x)) + LONGEST - SHINGLE + 1, len(in_x))
    starts = np.flatnonzero(total[stop] - total[:-1] >= SURVIVE)
    starts = starts[starts <= len(x) - PASSAGE]
    total = np.concatenate([[0], np.cumsum(in_y)])
    stop = np.minimum(np.arange(len(in_y)) + STRETCH, len(in_y))
    dense = np.flatnonzero(total[stop] - total[:-1] >= SURVIVE)
    if not len(dense) or not len(starts):
        return False
    mark = np.zeros(len(y) + 1, np.int64)
    np.add.at(mark, dense, 1)
    np.add.at(mark, np.minimum(dense + STRETCH + SHINGLE - 1, len(y)), -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(mark[:-1]) > 0).astype(np.int64), [0]])))
    for lo, hi in zip(edge[::2], edge[1::2]):
        part = y[lo:hi]
        col = np.arange(len(part) + 1)
        for start in starts:
            row = np.zeros(len(part) + 1, np.int64)
            for n, w in enumerate(x[start : start + LONGEST], 1):
                up = row + 1
                up[1:] = np.minimum(up[1:], row[:-1] + (part != w))
                row = np.minimum.accumulate(up - col) + col
                edits = row.min()
                if edits * EDITS_IN <= n and n >= PASSAGE:
                    return True
                if edits > MOST_EDITS:
                    break
    return False


def leaks(item: list[str], doc: list[str]) -> bool:
    """Exact verification: RUN consecutive words, or a close passage."""
    x, y = _ids(item, doc)
    return has_run(x, y) or close_passage(x, y)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def own_words(items: DataFrame) -> DataFrame:
    """(item, words) of items (item, prompt): the words of the sentences that no other prompt has."""
    kind = items.schema["item"].dataType.simpleString()

    def sentences(batches):
        for b in batches:
            rows = []
            for k, p in enumerate(b.column(1).to_pylist()):
                for at, s in enumerate(_SENTENCE.split(p)):
                    ws = words(s)
                    if ws:
                        rows.append((k, at, xxhash.xxh3_128_digest("\0".join(ws)), ws))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.string()))], names=["item", "at", "digest", "words"])

    said = items.mapInArrow(sentences, f"item {kind}, at int, digest binary, words array<string>")
    said = said.groupBy("digest", "item").agg(F.collect_list("at").alias("at"), F.first("words").alias("words"))
    said = said.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("item", "at", "words")).alias("s")).where("n = 1").select("s.*")
    said = said.select("item", F.explode("at").alias("at"), "words").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("s"))
    return said.select("item", F.flatten("s.words").alias("words")).where(F.size("words") >= RUN)


def item_shingles(own: DataFrame) -> DataFrame:
    """(item, shingle, signed, least) of each own shingle of an item; ``signed``: it is in a passage's signature."""
    kind = own.schema["item"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for k, ws in enumerate(b.column(1).to_pylist()):
                every, chosen, least = signature(ws)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k] * len(every), pa.int64())), pa.array(_signed(every)), pa.array(chosen), pa.array(np.full(len(every), least, np.int32))], names=["item", "shingle", "signed", "least"])

    return own.select("item", "words").mapInArrow(run, f"item {kind}, shingle long, signed boolean, least int")


def _probe(filter_):
    """Batches of documents -> (doc, txt, hits) of those with SURVIVE known shingles in some STRETCH in a row."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts, 1 << 19):
                hashes: dict = {}
                kept, hits = [], []
                for k in range(i, j):
                    ws = words(texts[k])
                    if len(ws) < RUN:
                        continue
                    for w in ws:
                        if w not in hashes:
                            hashes[w] = xxhash.xxh3_64_intdigest(w)
                    sh = _shingles(np.array([hashes[w] for w in ws], np.uint64))
                    known = contains(filter_.value, sh).astype(np.int64)
                    total = np.concatenate([[0], np.cumsum(known)])
                    stop = np.minimum(np.arange(len(sh)) + STRETCH, len(sh))
                    dense = np.flatnonzero(total[stop] - total[:-1] >= SURVIVE)
                    if not len(dense):
                        continue
                    mark = np.zeros(len(sh) + 1, np.int64)
                    np.add.at(mark, dense, 1)
                    np.add.at(mark, stop[dense], -1)
                    kept.append(k)
                    hits.append(_signed(np.unique(sh[(known > 0) & (np.cumsum(mark[:-1]) > 0)])))
                if kept:
                    take = pa.array(kept, pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(hits, pa.list_(pa.int64()))], names=["doc", "txt", "hits"])

    return run


def _verify(batches):
    last, ws = None, []
    for b in batches:
        texts, items = b.column(2).to_pylist(), b.column(1).to_pylist()
        keep = []
        for t, item in zip(texts, items):
            if t != last:
                last, ws = t, words(t)
            keep.append(leaks(item, ws))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(3).filter(mask)], names=["item", "doc"])


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, prompt: str, few: int = 500_000) -> DataFrame:
    """Distinct (item, key) of documents that hold a passage of an item. ``few``: see :func:`salted_join`."""
    spark = docs.sparkSession
    kinds = [items.schema[item].dataType.simpleString(), docs.schema[key].dataType.simpleString()]
    said = items.select(F.col(item).alias("item"), F.col(prompt).alias("prompt")).where("item is not null and prompt is not null")
    own = cut(own_words(said.groupBy("item").agg(F.max("prompt").alias("prompt"))))
    shingles = cut(item_shingles(own))
    seen = spark.sparkContext.broadcast(bloom_filter(shingles.select("shingle").distinct(), "shingle"))
    src = docs.select(F.col(key).alias("doc"), F.col(text).alias("txt")).where("doc is not null and txt is not null")
    near = src.mapInArrow(_probe(seen), f"doc {kinds[1]}, txt string, hits array<long>")
    near = cut(near.withColumn("tid", F.xxhash64("txt")))
    hits = near.select("doc", "tid", F.explode("hits").alias("shingle"))
    found = salted_join(hits, shingles.where("signed").select("shingle", "item", "least"), ["shingle"], few=few)
    found = found.groupBy("doc", "tid", "item").agg(F.count("*").alias("n"), F.max("least").alias("least")).where("n >= least").select("doc", "tid", "item")
    pairs = salted_join(cut(found), own, ["item"], few=few // 100)
    checked = pairs.join(near.select("doc", "tid", "txt"), ["doc", "tid"]).select("item", "words", "txt", "doc").sortWithinPartitions("doc", "txt").mapInArrow(_verify, f"item {kinds[0]}, doc {kinds[1]}")
    return checked.distinct().select(F.col("item").alias(item), F.col("doc").alias(key))


@query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(load(spark, d, "documents"), "doc_id", "text", load(spark, d, "eval_items"), "item_id", "prompt")


@query("p8_documents")
def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each leaking document with the items it gives away."""
    return p8_found(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.count("*").alias("n_items"))
