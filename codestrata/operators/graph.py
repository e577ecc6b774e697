"""The call graph: callers by hop, blast radius, capped caller trees, reference ranks, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.operators import hops
from codestrata.plans.views import dirname
from codestrata.session import cut

#: Weight and order of the edge classes, and the walk's limits.
WEIGHT = {"resolved": 1.0, "import-connected": 0.8, "name-match": 0.5, "weak-member": 0.3}
RANK = {"resolved": 3, "import-connected": 2, "name-match": 1, "weak-member": 0}
DECAY, FLOOR, DEPTH, BREADTH, NODES = 0.85, 0.35, 3, 25, 200


def _table(values: dict):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def strength_rank(c):
    return F.element_at(_table(RANK), c)


def call_edges(refs: DataFrame) -> DataFrame:
    """Distinct (dst, src) of resolved calls between different symbols."""
    r = refs.where("source_id is not null and target_id is not null and source_id <> target_id")
    return r.select(F.col("target_id").alias("dst"), F.col("source_id").alias("src")).distinct()


def callers_by_hop(edges: DataFrame, depth: int = 2) -> DataFrame:
    """(dst, src, depth): each transitive caller at its least distance. Resolved edges stay inside a file, so levels stay bounded."""
    known = level = edges.withColumn("depth", F.lit(1))
    back = edges.select(F.col("dst").alias("mid"), F.col("src").alias("far"))
    for k in range(2, depth + 1):
        nxt = level.join(back, F.col("src") == F.col("mid")).where("far <> dst").select("dst", F.col("far").alias("src")).distinct()
        level = cut(nxt.join(known.select("dst", "src"), ["dst", "src"], "left_anti").withColumn("depth", F.lit(k)))
        known = known.unionByName(level)
    return known


def blast_radius(edges: DataFrame, symbols: DataFrame, depth: int = 2) -> DataFrame:
    h = callers_by_hop(edges, depth).join(symbols.select(F.col("id").alias("src"), "file"), "src")
    return h.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"), F.count_distinct("file").alias("files"), F.max("depth").alias("depths"))


def named_callers_by_hop(split) -> DataFrame:
    """(id, depth, callers): distinct callers by name of every symbol, each at its least distance."""
    hop = F.explode(F.array(*[F.struct(F.lit(k).alias("depth"), F.col(c).alias("callers")) for k, c in ((1, "one"), (2, "two"))]))
    return hops.named_hops(split).select("id", hop.alias("h")).select("id", "h.depth", "h.callers").where("callers > 0")


def named_blast_radius(split) -> DataFrame:
    """Distinct callers by name of every symbol within two hops, their files and depths."""
    return hops.named_hops(split).select("id", (F.col("one") + F.col("two")).alias("callers"), "files", F.when(F.col("two") > 0, 2).otherwise(1).alias("depths"))


def strict_callers(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Resolved callers: distinct symbols, and module-level sites by their first line in a file."""
    r = refs.where("target_id is not null")
    s = symbols.select(F.col("id").alias("source_id"), F.col("file").alias("sf"), F.col("start_line").alias("sl"))
    named = r.where("source_id is not null").select("target_id", "source_id").distinct().join(s, "source_id").select(F.col("target_id").alias("id"), "source_id", F.col("sf").alias("file"), F.col("sl").alias("line"))
    top = r.where("source_id is null").groupBy(F.col("target_id").alias("id"), "file").agg(F.min("line").alias("line"))
    return named.unionByName(top.select("id", F.lit(None).cast("string").alias("source_id"), "file", "line"))


def group_callers(edges: DataFrame) -> DataFrame:
    """One row per target and caller: sites, first line and the strongest edge's rank."""
    caller = F.coalesce("source_id", F.concat(F.lit("m:"), "file"))
    return edges.groupBy("id", caller.alias("caller")).agg(F.count("*").alias("sites"), F.min("line").alias("first_line"), F.max(strength_rank(F.col("strength"))).alias("rank"))


def group_all_callers(split) -> DataFrame:
    """:func:`group_callers` for every symbol: general calls are grouped before they meet the symbols of their name."""
    caller = F.coalesce("source_id", F.concat(F.lit("m:"), "file"))
    g = split.general.groupBy("cls", "name", "file", caller.alias("caller")).agg(F.count("*").alias("sites"), F.min("line").alias("first_line"), F.max(strength_rank(F.col("strength"))).alias("rank"))
    return split.meet(g).select("id", "caller", "sites", "first_line", "rank").unionByName(group_callers(split.exact))


def count_callers(split) -> DataFrame:
    """Distinct callers and files of every symbol, by tier of the strongest edge."""

    def per_file(edges, keys):
        caller = F.coalesce("source_id", F.concat(F.lit("m:"), "file"))
        g = edges.groupBy(*keys, "file", caller.alias("caller")).agg(F.max(strength_rank(F.col("strength"))).alias("rank"))
        return g.groupBy(*keys, "file").agg(
            F.count("*").alias("callers"), F.lit(1).cast("bigint").alias("files"), F.count_if(F.col("rank") == 3).alias("structural"),
            F.count_if(F.col("rank").isin(1, 2)).alias("name_match"), F.count_if(F.col("rank") == 0).alias("weak_member"),
        )

    return split.sums(per_file, ["callers", "files", "structural", "name_match", "weak_member"])


def count_strengths(split) -> DataFrame:
    """Call sites and files of every symbol by strength."""

    def per_file(edges, keys):
        return edges.groupBy(*keys, "file", "strength").agg(F.count("*").alias("sites"), F.lit(1).cast("bigint").alias("files"))

    return split.sums(per_file, ["sites", "files"], ("strength",))


def leading_references(split, limit: int = 20) -> DataFrame:
    """Edges of every symbol, enough of them for :func:`rank_references` with ``limit``.

    Of the general calls, the first ``limit`` of each strength and of each folder near by go to all
    symbols of their name. A call that gets a better tier for some symbol leaves the others'
    places as they are; for the calls that a symbol makes itself, as many more are kept.
    """
    order = ["file", "line", "ref_id"]
    g = split.general.withColumn("here", dirname(F.col("file"))).withColumn("_by", F.coalesce("source_id", F.concat(F.lit("r:"), F.col("ref_id").cast("string"))))

    def first(df, *keys):
        one, all_ = W.partitionBy(*keys, "_by").orderBy(*order), W.partitionBy(*keys).orderBy(*order)
        df = df.withColumn("_n", F.row_number().over(one)).where(F.col("_n") <= limit)
        df = df.withColumn("_r", F.row_number().over(all_)).withColumn("_m", F.max("_n").over(all_.rowsBetween(W.unboundedPreceding, W.currentRow)))
        return df.where(F.col("_r") - F.col("_m") <= limit)

    t = split.members.select("id", "cls", "name", F.col("dir").alias("tdir"))
    up = t.withColumn("tup", dirname(F.col("tdir")))
    plain = g.where("strength = 'name-match'").withColumn("tup", dirname(F.col("here")))
    cols = ["id", "ref_id", "source_id", "file", "line", "here", "tdir", "strength"]
    got = first(g, "cls", "name", "strength").join(t, ["cls", "name"]).select(*cols)
    got = got.unionByName(first(plain, "cls", "name", "tup").join(up, ["cls", "name", "tup"]).select(*cols))
    got = got.unionByName(first(plain.drop("tup"), "cls", "name", "here").join(up.withColumn("here", F.col("tup")), ["cls", "name", "here"]).select(*cols))
    got = got.where(~F.coalesce(F.col("source_id") == F.col("id"), F.lit(False)))
    close = (F.col("strength") == "name-match") & (F.col("here") == F.col("tdir"))
    got = got.withColumn("strength", F.when(close, "import-connected").otherwise(F.col("strength"))).drop("here", "tdir")
    return got.unionByName(split.exact).distinct()


def rank_references(edges: DataFrame, targets: DataFrame, limit: int = 20, weak: int = 8) -> DataFrame:
    """Callers by tier: same folder, import-connected, sibling or parent folder, other, weak member."""
    e = edges.join(targets.select("id", F.col("dir").alias("tdir")), "id")
    here, up = dirname(F.col("file")), dirname(F.col("tdir"))
    tier = (
        F.when(F.col("strength") == "weak-member", 5).when(here == F.col("tdir"), 1).when(F.col("strength").isin("import-connected", "resolved"), 2)
        .when((dirname(here) == up) | (here == up), 3).otherwise(4)
    )
    order = ["tier", "file", "line", "ref_id"]
    e = e.withColumn("tier", tier).withColumn("_w", F.row_number().over(W.partitionBy("id", F.col("tier") == 5).orderBy(*order))).where((F.col("tier") < 5) | (F.col("_w") <= weak))
    return e.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(*order))).where(F.col("rank") <= limit).select("id", "ref_id", "file", "line", "tier", "rank")


def blast_of(scoped, roots: DataFrame) -> DataFrame:
    """(id, blast_callers, blast_files, blast_depth) of a stated set of roots (id): distinct callers by name within two hops."""
    caller = F.coalesce("source_id", F.concat(F.lit("m:"), "file"))

    def callers(ids):
        e = scoped.edges(scoped.symbols.join(ids, "id", "left_semi"))
        return e.groupBy("id", "file", caller.alias("caller")).agg(F.max(strength_rank(F.col("strength"))).alias("rank"))

    one = cut(callers(roots.select("id")))
    walked = one.where(F.col("rank") >= RANK["import-connected"]).select(F.col("id").alias("root"), F.col("caller").alias("id"))
    two = walked.join(callers(walked.select("id").distinct()), "id").select(F.col("root").alias("id"), "caller", "file", F.lit(2).alias("depth"))
    hops = one.select("id", "caller", "file", F.lit(1).alias("depth")).unionByName(two).groupBy("id", "caller", "file").agg(F.min("depth").alias("depth"))
    return hops.groupBy("id").agg(F.count("*").alias("blast_callers"), F.count_distinct("file").alias("blast_files"), F.max("depth").alias("blast_depth"))


def caller_summary(trees: DataFrame) -> DataFrame:
    """Per root of :func:`caller_trees`: distinct callers and files, callers by tier of their strongest edge, and whether a limit cut the walk short."""
    caller = F.coalesce("symbol_id", F.concat(F.lit("m:"), "file"))
    per = trees.groupBy("root", caller.alias("caller")).agg(F.max(strength_rank(F.col("strength"))).alias("rank"), F.first("file").alias("file"), F.min("depth").alias("depth"), F.max("depth_capped").alias("capped"))
    return per.groupBy("root").agg(
        F.count("*").alias("callers"), F.count_distinct("file").alias("files"), F.max("depth").alias("depths"), F.max("capped").alias("depth_capped"),
        F.count_if(F.col("rank") == 3).alias("structural"), F.count_if(F.col("rank").isin(1, 2)).alias("name_match"), F.count_if(F.col("rank") == 0).alias("weak_member"),
    )


def risk_hotspots(files: DataFrame, symbols: DataFrame, fan_in: DataFrame, candidates: int = 40, top: int = 10) -> DataFrame:
    """The most churned files' most called symbols by log1p(churn) * log1p(callers) * (1 + log1p(complexity))."""
    hot = files.where("commit_frequency > 0").orderBy(F.desc("commit_frequency"), "path").limit(candidates).select(F.col("path").alias("file"), F.col("commit_frequency").alias("churn"))
    s = symbols.where("name is not null").join(F.broadcast(hot), "file").join(fan_in, "id")
    best = F.row_number().over(W.partitionBy("file").orderBy(F.desc("callers"), "start_line", "id"))
    cx = F.coalesce("cognitive", F.col("complexity") - 1, F.lit(0))
    one = s.withColumn("rn", best).where("rn = 1").withColumn("cx", cx)
    score = F.round(F.log1p("churn") * F.log1p("callers") * (1 + F.log1p("cx")), 6)
    return one.select("id", "name", "file", "churn", "callers", "cx", score.alias("score")).orderBy(F.desc("score"), "file").limit(top)


def caller_trees(scoped, roots: DataFrame, depth: int = DEPTH, breadth: int = BREADTH, nodes: int = NODES, include_weak: bool = False) -> DataFrame:
    """Upstream trees of a stated set of roots, breadth first, with breadth and node caps.

    One row per node: root, node (its place in breadth-first order), parent, depth,
    symbol_id (null at module level), file, line, strength, confidence, via, is_cycle,
    leaf_by_policy, depth_capped. A level is one join of the frontier with the edges of
    its symbols; it is cut, so lineage does not grow with depth.
    """
    info = scoped.symbols.select("id", F.col("name").alias("s_name"), F.col("file").alias("s_file"), F.col("start_line").alias("s_line"))
    frontier = cut(roots.join(info, "id").select(F.col("id").alias("root"), F.lit(0).cast("long").alias("node"), "id", F.col("s_name").alias("name"), F.lit(1.0).alias("confidence"), F.array("id").alias("path"), F.lit(0).cast("long").alias("used")))
    out = None
    for level in range(1, depth + 1):
        targets = scoped.symbols.join(frontier.select("id").distinct(), "id", "left_semi")
        g = scoped.edges(targets).withColumn("r", strength_rank(F.col("strength")))
        key = F.coalesce("source_id", F.concat(F.lit("m:"), "file"))
        g = g.groupBy("id", key.alias("caller")).agg(F.max("source_id").alias("source_id"), F.min("file").alias("file"), F.min("line").alias("line"), F.max(F.struct("r", "strength")).alias("m"))
        c = frontier.select("root", F.col("node").alias("parent"), "id", F.col("name").alias("via"), F.col("confidence").alias("pc"), "path", "used").join(g, "id").drop("id")
        c = c.join(info, F.col("source_id") == F.col("id"), "left").select(
            "root", "parent", F.when(F.lit(level) > 1, F.col("via")).alias("via"), "path", "used", F.col("id").alias("symbol_id"), F.col("s_name").alias("name"),
            F.coalesce("s_file", "file").alias("file"), F.coalesce("s_line", "line").alias("line"), F.col("m.strength").alias("strength"), F.col("m.r").alias("r"),
            (F.col("pc") * F.element_at(_table(WEIGHT), F.col("m.strength")) * DECAY).alias("confidence"),
        )
        order = [F.desc("confidence"), F.desc("r"), F.col("file"), F.col("line"), F.col("symbol_id")]
        c = c.withColumn("b", F.row_number().over(W.partitionBy("root", "parent").orderBy(*order))).where(F.col("b") <= breadth)
        c = c.withColumn("node", F.col("used") + F.row_number().over(W.partitionBy("root").orderBy("parent", "b"))).where(F.col("node") <= nodes)
        cyclic = F.coalesce(F.array_contains("path", F.col("symbol_id")), F.lit(False))
        ok = F.lit(True) if include_weak else F.col("strength").isin("resolved", "import-connected") & (F.col("confidence") >= FLOOR)
        grows = F.col("symbol_id").isNotNull() & ~cyclic & ok
        c = cut(c.withColumn("depth", F.lit(level)).withColumn("is_cycle", cyclic).withColumn("leaf_by_policy", F.col("symbol_id").isNotNull() & ~cyclic & ~ok).withColumn("depth_capped", grows & F.lit(level == depth)).withColumn("grows", grows))
        rows = c.select("root", "node", "parent", "depth", "symbol_id", "file", "line", "strength", F.round("confidence", 9).alias("confidence"), "via", "is_cycle", "leaf_by_policy", "depth_capped")
        out = rows if out is None else out.unionByName(rows)
        if level < depth:
            count = c.groupBy("root").agg(F.max("node").alias("n"))
            frontier = cut(c.where("grows").join(count, "root").select("root", "node", F.col("symbol_id").alias("id"), "name", "confidence", F.array_append("path", F.col("symbol_id")).alias("path"), F.col("n").alias("used")))
    return out
