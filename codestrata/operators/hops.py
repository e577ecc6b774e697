"""Callers by name of every symbol at one and two hops, counted without listing them.

The callers of all symbols are a product of calls and symbols by name, those at two hops
more than that. So they are counted in blocks: a task gets the callers once per (class,
name), what single symbols add and lack, and the edges that are walked, all as numbers, and
forms the union of each symbol's callers in arrays. What is shuffled grows with calls and
symbols, times a few blocks; no row per symbol and caller exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.session import store, store_all

#: Rows of callers, and of symbols, that a block has about: it sets the number of blocks, never what is counted.
BLOCK = 4_000_000
SYMBOL, CALLED, ADDED, LACKED, LEADS, LEADS_ONE, LACKS_LEAD = range(7)
_COUNTS = "sno long, one long, two long, files long"


def _count_block(table):
    """Counts of a block's symbols. Rows by tag: SYMBOL (symbol, name, counted here), CALLED (name, caller, file), ADDED
    (symbol, caller, file), LACKED (symbol, caller), LEADS (name, calling symbol, caller), LEADS_ONE (symbol, calling symbol), LACKS_LEAD (symbol, caller)."""
    import numpy as np
    import pyarrow as pa

    tag = table["tag"].to_numpy()
    columns = [table[c].to_numpy() for c in "abc"]
    of = lambda t: [c[tag == t] for c in columns]
    symbol, name, counted = of(SYMBOL)
    called, added, lacked, leads, leads_one, lacks_lead = (of(t) for t in (CALLED, ADDED, LACKED, LEADS, LEADS_ONE, LACKS_LEAD))

    # callers by number, those of a file side by side, so that files of sorted callers are counted by their changes
    pairs = np.unique(np.stack([np.concatenate([called[2], added[2]]), np.concatenate([called[1], added[1]])], 1), axis=0) if len(called[0]) + len(added[0]) else np.empty((0, 2), np.int64)
    by_number = np.argsort(pairs[:, 1], kind="stable")
    place = lambda c: by_number[np.searchsorted(pairs[:, 1], c, sorter=by_number)]
    file = np.unique(pairs[:, 0], return_inverse=True)[1].reshape(-1)

    def grouped(keys, values):
        order = np.lexsort((values, keys))
        keys, values = keys[order], values[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        return dict(zip(keys[starts].tolist(), zip(starts.tolist(), np.r_[starts[1:], len(keys)].tolist()))), values

    def getter(keys, values):
        at, values = grouped(keys, values)
        none = values[:0]

        def get(k):
            span = at.get(k)
            return none if span is None else values[span[0] : span[1]]

        return get

    callers, more, less = getter(called[0], place(called[1])), getter(added[0], place(added[1])), getter(lacked[0], place(lacked[1]))
    walks_one, lacks = getter(leads_one[0], leads_one[1]), getter(lacks_lead[0], lacks_lead[1])
    lead_at, lead_row = grouped(leads[0], np.arange(len(leads[0])))
    names = dict(zip(symbol.tolist(), name.tolist()))
    seen, dropped, seen_file = np.zeros(len(pairs), bool), np.zeros(len(pairs), bool), np.zeros(int(file.max()) + 1 if len(file) else 0, bool)

    def files(c):
        f = file[c]
        return f[np.r_[True, f[1:] != f[:-1]]] if len(f) else f

    def direct(s):
        """The callers of a symbol, in two parts that have none in common."""
        c, x = callers(names.get(s, -1)), less(s)
        if len(x):
            dropped[x] = True
            c = c[~dropped[c]]
            dropped[x] = False
        return c, more(s)

    def union(parts):
        """Sorted callers of all parts; each part has a caller once."""
        fresh = []
        for p in parts:
            p = p[~seen[p]]
            seen[p] = True
            fresh.append(p)
        out = np.sort(np.concatenate(fresh)) if fresh else np.empty(0, np.int64)
        seen[out] = False
        return out

    def further(first, second):
        """How many of ``second`` are not in ``first``, and the files of both."""
        f = [files(c) for c in first]
        for c, x in zip(first, f):
            seen[c] = True
            seen_file[x] = True
        rest = second[~seen[second]]
        g = files(rest)
        g = g[~seen_file[g]]
        for c, x in zip(first, f):
            seen[c] = False
            seen_file[x] = False
        return len(rest), len(g)

    here = np.flatnonzero(counted == 1)
    here = here[np.argsort(name[here], kind="stable")]
    rows, last, whole = [], None, None
    for s, k in zip(symbol[here].tolist(), name[here].tolist()):
        if k != last:  # what all symbols of a name share
            last, every, whole = k, callers(k), None
            every_files = len(files(every))
            span = lead_at.get(k)
            on, on_caller = (leads[1][lead_row[span[0] : span[1]]], leads[2][lead_row[span[0] : span[1]]]) if span else (leads[1][:0], leads[2][:0])
            shared = None
        x, y, out = more(s), less(s), lacks(s)
        one, n_files, two = len(every) - len(y) + len(x), every_files - len(files(y)) + len(files(x)), 0
        own = walks_one(s)
        if len(on) or len(own):
            plain = not (len(x) or len(y) or len(out) or len(own))
            if plain and shared is not None:
                two, added_files = shared
            else:
                left = on[~np.isin(on_caller, out)] if len(out) else on
                if len(left) == len(on) and len(on):
                    whole = union([c for m in on.tolist() for c in direct(m)]) if whole is None else whole
                    second = union([whole, *[c for m in own.tolist() for c in direct(m)]]) if len(own) else whole
                else:
                    second = union([c for m in [*left.tolist(), *own.tolist()] for c in direct(m)])
                two, added_files = further(direct(s), second)
                if plain:
                    shared = two, added_files
            n_files += added_files
        if one or two:
            rows.append((s, one, two, n_files))
    got = np.array(rows, np.int64).reshape(-1, 4)
    return pa.table({c: got[:, i] for i, c in enumerate(("sno", "one", "two", "files"))})


def named_hops(split) -> DataFrame:
    """(id, one, two, files): distinct callers by name of every symbol at one hop, those that two hops add, and the files of both.

    Hops are walked where a caller tree grows: from calling symbols over edges that are resolved
    or import-connected; others count as callers but lead no further. A symbol that calls
    itself through another is its own caller, as in a tree. At module level, callers are files.
    """
    spark = split.general.sparkSession
    caller = F.coalesce("source_id", F.concat(F.lit("m:"), "file")).alias("caller")
    leads = F.max(F.col("strength").isin("resolved", "import-connected")).alias("leads")
    key = ["cls", "name"]
    general, exact = store_all(split.general.groupBy(*key, "file", caller).agg(leads), split.exact.groupBy("id", "file", caller).agg(leads))
    # numbers: exact, and kept in tables, so that they stay the same
    number = F.monotonically_increasing_id()
    who, names, symbols = store_all(
        general.select("file", "caller").unionByName(exact.select("file", "caller")).distinct().withColumn("cno", number),
        general.select(*key).distinct().withColumn("kno", number),
        split.members.select("id", *key).unionByName(exact.select("id").distinct().join(split.members, "id", "left_anti").select("id", F.lit("").alias("cls"), F.lit("").alias("name"))).withColumn("sno", number),
    )
    who = who.withColumn("fno", F.min("cno").over(W.partitionBy("file"))).join(symbols.select(F.col("id").alias("caller"), F.col("sno").alias("mid")), "caller", "left")
    who, symbols = store_all(who, symbols.join(names, key, "left").select("id", "sno", *key, F.coalesce("kno", F.lit(-1)).alias("kno")))
    mid = F.when(F.col("leads"), F.col("mid")).alias("mid")
    called = general.join(who, ["file", "caller"]).join(names, key).select("kno", *key, "file", "cno", "fno", mid)
    added = exact.join(who, ["file", "caller"]).join(symbols.select("id", "sno"), "id").select("sno", "cno", "fno", mid)
    called, added = store_all(called, added)
    pairs = split.pairs.select("id", *key, "file").join(called.drop("kno", "fno"), [*key, "file"]).join(symbols.select("id", "sno"), "id")
    lacked = store(pairs.select("sno", "cno", "mid"))
    numbers, size = symbols.select("sno", "kno"), max(called.count(), symbols.count(), 1)
    called = called.drop(*key, "file")

    # callers are split by file, symbols by number; the counts add up
    spans = -(-size // BLOCK)
    shares = max(spans, -(-2 * spark.sparkContext.defaultParallelism // spans))
    target = numbers.withColumn("p", F.pmod(F.xxhash64("sno"), F.lit(shares)).cast("int"))
    by_name = called.where("mid is not null").select("kno", "mid", "cno")
    by_symbol = added.where("mid is not null").select("sno", "mid").distinct()
    lead = target.join(by_symbol, "sno").select("p", "mid").unionByName(target.select("p", "kno").distinct().join(by_name, "kno").select("p", "mid"))
    need = target.select("p", "sno", F.lit(1).alias("n")).unionByName(lead.select("p", F.col("mid").alias("sno"), F.lit(0).alias("n")))
    need = store(need.groupBy("p", "sno").agg(F.max("n").cast("long").alias("counted")).join(numbers, "sno"))
    of_name, of_symbol, none = need.where("kno >= 0").select("p", "kno").distinct(), need.select("p", "sno"), F.lit(None).cast("long")
    here = target.select("p", "sno")

    def rows(tag, df, a, b, c, span=None):
        if span is None:
            span = F.explode(F.sequence(F.lit(0), F.lit(spans - 1)))
        return df.select("p", span.alias("q"), F.lit(tag).alias("tag"), F.col(a).alias("a"), F.col(b).alias("b"), c.alias("c"))

    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(spans)).cast("int")
    files = who.select("cno", "fno")
    sent = [
        rows(SYMBOL, need, "sno", "kno", F.col("counted")),
        rows(CALLED, called.join(of_name, "kno"), "kno", "cno", F.col("fno"), spread("fno")),
        rows(ADDED, added.join(of_symbol, "sno"), "sno", "cno", F.col("fno"), spread("fno")),
        rows(LACKED, lacked.join(of_symbol, "sno").join(files, "cno"), "sno", "cno", none, spread("fno")),
        rows(LEADS, by_name.join(target.select("p", "kno").distinct(), "kno"), "kno", "mid", F.col("cno")),
        rows(LEADS_ONE, by_symbol.join(here, "sno"), "sno", "mid", none),
        rows(LACKS_LEAD, lacked.where("mid is not null").join(here, "sno"), "sno", "cno", none),
    ]
    every = sent[0]
    for x in sent[1:]:
        every = every.unionByName(x)
    every = every.withColumns({c: F.coalesce(c, F.lit(-1)) for c in "abc"})
    counts = every.groupBy("p", "q").applyInArrow(_count_block, _COUNTS).groupBy("sno").agg(*[F.sum(c).alias(c) for c in ("one", "two", "files")])
    return counts.where("one > 0").join(symbols.select("id", "sno"), "sno").select("id", "one", "two", "files")
