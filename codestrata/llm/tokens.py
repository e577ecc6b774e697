"""Problem 7: byte-level BPE of a whole corpus with a public vocabulary.

Distinct pre-tokens that a worker has not met are put, by byte length, into padded numpy
matrices. Each round every row finds its lowest-ranked adjacent pair through a hashed pair
table and merges it, leftmost first; finished rows leave the matrix and the rest is
compacted. Equal pairs further right are merged in the same round where the ranks of all
pairs that arise show that the one-by-one order would do the same.

Defined results: a null or empty text has an empty list; text that looks like a special
token is ordinary text; every row gives one row; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.registry import query
from codestrata.session import load

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the byte_bpe_50k vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> merged id, as open addressing in numpy; the id is the rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        keys, ids = [], []
        for tok, r in ranks.items():
            for i in range(1, len(tok)):
                a, b = ranks.get(tok[:i]), ranks.get(tok[i:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    ids.append(r)
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ids = np.full(1 << self.bits, _NONE, np.int32)
        key, val = np.array(keys, np.int64), np.array(ids, np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = first[free[first]]
            self.keys[slot[put]] = key[put]
            self.ids[slot[put]] = val[put]
            left = np.ones(len(key), bool)
            left[put] = False
            key, val, slot = key[left], val[left], (slot[left] + 1) & self.mask

    def _slot(self, key):
        return ((key.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a, b):
        """Merged ids of the pairs; ``_NONE`` where there is none or a side is padding."""
        out = np.full(a.shape, _NONE, np.int32)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        key = (a.ravel()[at].astype(np.int64) << 32) | b.ravel()[at]
        slot, flat = self._slot(key), out.ravel()
        while len(at):
            there = self.keys[slot]
            hit = there == key
            flat[at[hit]] = self.ids[slot[hit]]
            go = ~hit & (there != -1)
            at, key, slot = at[go], key[go], (slot[go] + 1) & self.mask
        return flat.reshape(a.shape)


def _shift(m, by, fill):
    out = np.full_like(m, fill)
    if by > 0:
        out[:, by:] = m[:, :-by]
    elif m.shape[1] > -by:
        out[:, :by] = m[:, -by:]
    return out


def merge_rows(table: PairTable, t: np.ndarray) -> list[np.ndarray]:
    """Token ids of each row of a padded (-1) matrix of byte ids."""
    done: list = [None] * len(t)
    rows = np.arange(len(t))
    r = table.rank(t, _shift(t, -1, -1))
    while len(rows):
        low = r.min(axis=1)
        over = low == _NONE
        if over.any():
            for i in np.flatnonzero(over):
                done[rows[i]] = t[i][t[i] >= 0]
            keep = ~over
            rows, t, r, low = rows[keep], t[keep], r[keep], low[keep]
            if not len(rows):
                break
        width = t.shape[1]
        hit = r == low[:, None]
        pos = np.broadcast_to(np.arange(width), hit.shape)
        start = np.where(hit & ~_shift(hit, 1, False), pos, 0)
        hit &= ((pos - np.maximum.accumulate(start, axis=1)) & 1) == 0
        ri, ci = np.nonzero(hit)
        new = low[ri]
        # the pairs that arise when hits are merged one by one from the left
        before = np.where(ci > 0, t[ri, ci - 1], -1)
        joined = (ci > 1) & hit[ri, ci - 2]
        before = np.where(joined, new, before)
        after = np.where(ci + 2 < width, t[ri, np.minimum(ci + 2, width - 1)], -1)
        if len(ri) > len(rows):
            early = (table.rank(before, new) <= new) | (table.rank(new, after) <= new)
            if early.any():
                one = np.zeros(len(rows), bool)
                one[ri[early]] = True
                first = hit.argmax(axis=1)
                hit[one] = False
                hit[one, first[one]] = True
                ri, ci = np.nonzero(hit)
                new = low[ri]
        t[ri, ci] = new
        keep = t >= 0
        keep[ri, ci + 1] = False
        size = keep.sum(axis=1)
        wide = int(size.max())
        kr, kc = np.nonzero(keep)
        to = np.cumsum(keep, axis=1)[kr, kc] - 1
        t2 = np.full((len(rows), wide), -1, t.dtype)
        r2 = np.full((len(rows), wide), _NONE, np.int32)
        t2[kr, to] = t[kr, kc]
        r2[kr, to] = r[kr, kc]
        at = np.cumsum(keep, axis=1)[ri, ci] - 1
        right = np.where(at + 1 < wide, t2[ri, np.minimum(at + 1, wide - 1)], -1)
        r2[ri, at] = table.rank(t2[ri, at], right)
        has = at > 0
        r2[ri[has], at[has] - 1] = table.rank(t2[ri[has], at[has] - 1], t2[ri[has], at[has]])
        t, r = t2, r2
    return done


class Encoder:
    """Encodes batches of texts; keeps the ids of pre-tokens met so far, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, keep: int = 400_000, cells: int = 1 << 20):
        self.table, self.find, self.known = PairTable(ranks), regex.compile(pattern).findall, {}
        self.keep, self.cells = keep, cells

    def _learn(self, words):
        by_size: dict[int, list] = {}
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            by_size.setdefault(len(b) if len(b) < 16 else 1 << (len(b) - 1).bit_length(), []).append((w, b))
        for size, group in by_size.items():
            step = max(1, self.cells // size)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                t = np.full((len(part), max(len(b) for _, b in part)), -1, np.int32)
                for j, (_, b) in enumerate(part):
                    t[j, : len(b)] = self.table.byte_ids[np.frombuffer(b, np.uint8)]
                for (w, _), ids in zip(part, merge_rows(self.table, t)):
                    self.known[w] = ids.tolist()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of the texts."""
        pieces = [self.find(x) if x else [] for x in texts]
        fresh = set().union(*pieces).difference(self.known) if pieces else set()
        if len(self.known) + len(fresh) > self.keep:
            self.known = {}
            fresh = set().union(*pieces)
        self._learn(fresh)
        known, flat, ends = self.known, [], [0]
        for p in pieces:
            for w in p:
                flat += known[w]
            ends.append(len(flat))
        return np.array(flat, np.int32), np.array(ends, np.int32)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def slices(texts: list, chars: int = 1 << 20):
    """Index ranges of consecutive texts of about ``chars`` characters together."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


_ENCODERS: dict = {}


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, ids array<int>) of every row. The vocabulary file, below 2 MB, is sent to the workers."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches):
        name = (vocabulary, pattern)
        enc = _ENCODERS.get(name)
        if enc is None:
            enc = _ENCODERS[name] = Encoder(ranks.value, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                flat, ends = enc.encode(texts[i:j])
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


@query("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(load(spark, d, "documents"), "doc_id", "text")
