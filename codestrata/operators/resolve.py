"""Call resolution: imports to files, scoping of calls, caller edges, fan-in.

A call is attributed to a symbol by name, and scoped by what the calling file imports.
Scoping depends on (file, name) or (file, receiver) only, so it is decided once per such
pair and never per pair of call and symbol; fan-in then needs sums by name and by
(file, name), not the product of all calls and all symbols that share a name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.plans.views import NON_CALLABLE_KINDS, class_of, dirname
from codestrata.session import store, store_all

SHORT_NAME = 4
OPAQUE = "()"

#: Suffixes tried, in order, after the path itself.
_PY = ["/__init__.py", ".py"]
_JS = [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"]
_TS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
_FROM_JSX = [".tsx", ".jsx", ".ts", ".js", ".mjs", ".cjs"]
_FROM_JS = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"]


def _with_index(suffixes):
    return suffixes + [f"/index{s}" for s in suffixes]


def _literals(suffixes):
    return F.array(*[F.lit(s) for s in ["", *suffixes]])


def normalized(path):
    """A path column without ``.`` and ``name/..`` steps."""

    def step(acc, x):
        up = (x == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != "..")
        return F.when(x.isin("", "."), acc).when(up, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array_append(acc, x))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def import_targets(bindings: DataFrame, files: DataFrame) -> DataFrame:
    """(file, source_module, target): the indexed file a relative specifier names, null where none does."""
    m = F.col("source_module")
    imports = bindings.select("file", "source_module").distinct().join(files.select(F.col("path").alias("_p"), "language"), F.col("file") == F.col("_p"))
    dots, rest = F.regexp_extract(m, "^(\\.+)(.*)$", 1), F.regexp_extract(m, "^(\\.+)(.*)$", 2)
    python = F.col("language") == "python"
    js, jsx = m.endswith(".js"), m.endswith(".jsx")
    spec = (
        F.when(python, F.when((dots != "") & (rest != ""), F.concat(F.repeat(F.lit("../"), F.length(dots) - 1), F.replace(rest, F.lit("."), F.lit("/")))))
        .when(~m.startswith("."), None).when(F.col("language") == "javascript", m)
        .when(jsx, F.expr("substring(source_module, 1, length(source_module) - 4)")).when(js, F.expr("substring(source_module, 1, length(source_module) - 3)")).otherwise(m)
    )
    cands = (
        F.when(python, _literals(_PY)).when(F.col("language") == "javascript", _literals(_with_index(_JS)))
        .when(jsx, _literals(_with_index(_FROM_JSX))).when(js, _literals(_with_index(_FROM_JS))).otherwise(_literals(_with_index(_TS)))
    )
    base = imports.select("file", "source_module", normalized(F.concat_ws("/", dirname(F.col("file")), spec)).alias("stem"), spec.alias("spec"), cands.alias("cands"))
    tries = base.where("spec is not null").select("file", "source_module", "stem", F.posexplode("cands").alias("rank", "suffix"))
    hits = tries.withColumn("cand", F.concat("stem", "suffix")).join(files.select(F.col("path").alias("_t")), F.col("cand") == F.col("_t"))
    best = hits.groupBy("file", "source_module").agg(F.min(F.struct("rank", "cand")).alias("m")).select("file", "source_module", F.col("m.cand").alias("target"))
    return base.select("file", "source_module").join(best, ["file", "source_module"], "left")


def _order():
    return F.struct("line", "source_module", "pos")


def wildcard():
    return (F.col("name") == "*") & F.col("alias").isNull()


def renaming():
    return F.col("alias").isNotNull() & (F.col("alias") != F.col("name")) & ~F.col("name").isin("default", "*")


def bare_scopes(calls: DataFrame, bindings: DataFrame, targets: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scoping of bare calls: ((file, name) any, (file, name, target) admitted).

    ``calls``: distinct (file, name). In import order the first decisive binding of the
    name ends the search: a renamed one drops the call, a resolved one admits its file.
    Wildcards before it admit theirs. Without a decisive binding an unresolvable one
    admits every file; so does a file that is not indexed.
    """
    b = bindings.join(targets, ["file", "source_module"], "left")
    named = b.where(~wildcard() & (F.col("bind") == "value")).select("file", F.col("local").alias("call"), _order().alias("o"), renaming().alias("renamed"), "target")
    decisive = F.col("renamed") | F.col("target").isNotNull()
    per = named.join(calls, ["file", "call"], "left_semi").groupBy("file", "call").agg(
        F.min(F.when(decisive, F.struct("o", "renamed", "target"))).alias("d"), F.max(~decisive).alias("open")
    )
    state = calls.join(per, ["file", "call"], "left").join(files.select(F.col("path").alias("_p")), F.col("file") == F.col("_p"), "left")
    wild = b.where(wildcard()).select("file", _order().alias("wo"), F.col("target").alias("wt"))
    w = state.join(wild, "file").where(F.col("d").isNull() | (F.col("wo") < F.col("d.o")))
    admitted = (
        state.where("d is not null and not d.renamed").select("file", "call", F.col("d.target").alias("target"))
        .unionByName(w.where("wt is not null").select("file", "call", F.col("wt").alias("target"))).distinct()
    )
    any_ = (
        state.where("_p is null or (d is null and open)").select("file", "call")
        .unionByName(w.where("d is null and wt is null").select("file", "call")).distinct()
    )
    return any_, admitted


def member_scopes(calls: DataFrame, bindings: DataFrame, targets: DataFrame, files: DataFrame) -> DataFrame:
    """(file, receiver, reach, target): ``all``, ``top`` (top-level symbols), ``file`` (those of target) or ``none``."""
    mod = (F.col("bind") == "module") & F.col("source_module").rlike("^\\.+$") & (F.col("name") != F.col("source_module"))
    spec = bindings.withColumn("source_module", F.when(mod, F.concat("source_module", "name")).otherwise(F.col("source_module")))
    t = import_targets(spec, files)
    first = bindings.withColumn("o", _order()).withColumn("source_module", F.when(mod, F.concat("source_module", "name")).otherwise(F.col("source_module"))).join(t, ["file", "source_module"], "left")
    module = F.col("bind").isin("namespace", "module")
    reach = F.when(module & F.col("target").isNull(), "top").when(module, "file").when(F.col("bind") == "type", "none").otherwise("all")
    first = first.groupBy("file", "local").agg(F.min(F.struct("o", reach.alias("reach"), F.when(module, F.col("target")).alias("target"))).alias("m"))
    first = first.select("file", F.col("local").alias("receiver"), "m.reach", "m.target")
    got = calls.join(first, ["file", "receiver"], "left").join(files.select(F.col("path").alias("_p")), F.col("file") == F.col("_p"), "left")
    free = (F.col("receiver") == OPAQUE) | F.col("_p").isNull() | F.col("reach").isNull()
    return got.select("file", "receiver", F.when(free, "all").otherwise(F.col("reach")).alias("reach"), F.when(~free, F.col("target")).alias("target"))


class Scoped:
    """Unresolved calls with their scopes; the base of fan-in and of caller edges."""

    def __init__(self, refs: DataFrame, symbols: DataFrame, bindings: DataFrame, files: DataFrame):
        self._split = None
        t = symbols.where("name is not null")
        t = t.select(
            "id", "name", "kind", "file", "language", F.coalesce("exported", F.lit(False)).alias("exported"), class_of(F.col("fqn")).isNotNull().alias("member"), "start_line",
            dirname(F.col("file")).alias("dir"), (~F.col("kind").isin(*NON_CALLABLE_KINDS)).alias("bare_ok"),
        )
        # one after the other, so that the shuffle files of one are gone before the next
        self.refs = refs = store(refs)
        self.files, self.bindings, self.symbols = files, bindings, _ = store_all(files, bindings, t)
        self.targets = store(import_targets(bindings, files))
        lang = files.select(F.col("path").alias("_lp"), F.col("language").alias("file_language"))
        u = refs.where(F.col("target_id").isNull() & (F.char_length("target_name") >= SHORT_NAME)).join(lang, F.col("file") == F.col("_lp"), "left").drop("_lp")
        bare = u.where("receiver is null")
        any_, self.admitted = store_all(*bare_scopes(bare.select("file", F.col("target_name").alias("call")).distinct(), bindings, self.targets, files))
        flag = any_.select("file", F.col("call").alias("target_name"), F.lit(True).alias("open"))
        bare = bare.join(flag, ["file", "target_name"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
        member = u.where("receiver is not null and not coalesce(self_receiver, false)")
        member = member.join(member_scopes(member.select("file", "receiver").distinct(), bindings, self.targets, files), ["file", "receiver"], "left")
        ren = bindings.where(renaming() & ~wildcard()).select("file", F.col("alias").alias("target_name"), "source_module", F.col("name").alias("export")).join(self.targets, ["file", "source_module"], "left")
        a = refs.where("receiver is null").join(ren.drop("source_module"), ["file", "target_name"]).join(files.select(F.col("path").alias("_p")), F.col("file") == F.col("_p"), "left_semi")
        alias = a.select("ref_id", "source_id", "target_id", "file", "line", "export", F.col("target").alias("to")).distinct()
        here = dirname(F.col("file"))
        self.bare, self.member, self.alias = store(bare.withColumn("dir", here)), store(member.withColumn("dir", here)), store(alias)

    def fan_in(self) -> DataFrame:
        """(id, callers): call sites per symbol; symbols without any are left out.

        Each call counts once under every (tag, place, name) that could reach it, each
        symbol looks up the keys its kind may be called through: one aggregate, one join.
        """

        def key(tag, place=F.lit("")):
            return F.struct(F.lit(tag).alias("tag"), place.alias("place"))

        def some(*pairs):
            return F.filter(F.array(*[F.when(cond, k) for cond, k in pairs]), lambda x: x.isNotNull())

        def keyed(df, pairs, name):
            return df.select(F.explode(some(*pairs)).alias("k"), F.col(name).alias("name")).select("k.tag", "k.place", "name")

        yes, file, folder = F.lit(True), F.col("file"), F.col("dir")
        go_file = F.coalesce(F.col("file_language") == "go", F.lit(False))
        bare = keyed(self.bare, [(F.col("open"), key("any")), (~F.col("open") & go_file, key("go", folder)), (go_file, key("gotype", folder))], "target_name")
        adm = self.bare.where("not open").join(self.admitted.withColumnRenamed("call", "target_name"), ["file", "target_name"])
        adm = keyed(adm, [(yes, key("file", F.col("target")))], "target_name")
        every, top, one = (F.col("reach") == x for x in ("all", "top", "file"))
        member = keyed(
            self.member,
            [(every, key("m_all")), (every, key("m_file_all", file)), (every & file.endswith(".go"), key("m_dir_all", folder)), (top, key("m_top")), (top, key("m_file_top", file)),
             (one, key("m_to", F.col("target"))), (one & (file == F.col("target")), key("m_file_to", file))],
            "target_name",
        )
        al = self.alias.where("target_id is null")
        free = al.where("to is null").select("ref_id", "export").distinct()
        tied = al.where("to is not null").select("ref_id", "export", F.col("to").alias("file")).distinct().join(free, ["ref_id", "export"], "left_anti")
        alias = keyed(free, [(yes, key("any_alias"))], "export").unionByName(keyed(tied, [(yes, key("file_alias", file))], "export"))
        counts = bare.unionByName(adm).unionByName(member).unionByName(alias).groupBy("tag", "place", "name").agg(F.count("*").alias("n"))
        ok, go = F.col("bare_ok") | (F.col("kind") == "method"), F.coalesce(F.col("language") == "go", F.lit(False))
        b, seen, mem = F.col("bare_ok"), F.col("exported"), F.col("member")
        reach = some(
            (b, key("any")), (b, key("file", file)), (b, key("any_alias")), (b, key("file_alias", file)), (b & go & ~mem, key("go", folder)),
            ((F.col("kind") == "type") & go & ~mem, key("gotype", folder)), (ok & seen, key("m_all")), (ok & seen & ~mem, key("m_top")), (ok & seen & ~mem, key("m_to", file)),
            (ok & ~seen & ~(go & mem), key("m_file_all", file)), (ok & ~seen & go & mem, key("m_dir_all", folder)), (ok & ~seen & ~mem, key("m_file_top", file)), (ok & ~seen & ~mem, key("m_file_to", file)),
        )
        wants = self.symbols.where(F.char_length("name") >= SHORT_NAME).select("id", "name", F.explode(reach).alias("k")).select("id", "name", "k.tag", "k.place")
        named = wants.join(counts, ["tag", "place", "name"]).select("id", "n")
        res = self.refs.where("target_id is not null and not coalesce(source_id = target_id, false)").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"))
        res = res.join(self.symbols.select("id"), "id", "left_semi")
        own = self._own_calls().select("id", F.lit(-1).cast("long").alias("n"))
        total = res.unionByName(named).unionByName(own).groupBy("id").agg(F.sum("n").alias("callers"))
        return total.where("callers > 0")

    def _own_calls(self) -> DataFrame:
        """(id, ref_id): unresolved calls inside a symbol that would count as calls of itself."""
        return self.edges(self.symbols, own=True).select("id", "ref_id")

    def split(self) -> "Split":
        """The edges of all symbols in parts that grow with calls and symbols, not with their product; made once."""
        if self._split is None:
            self._split = Split(self)
        return self._split

    def edges(self, targets: DataFrame, own: bool = False, pairs: DataFrame | None = None, keep=lambda df: df) -> DataFrame:
        """(id, ref_id, source_id, file, line, strength) of the calls of given symbols.

        For a stated set of targets; calls meet them by name. ``own`` gives unresolved
        recursion alone, which meets on the calling symbol. With ``pairs`` (id, file), unresolved
        calls meet a symbol only from its files there. ``keep`` is applied to what is found on the way.
        """
        t = targets.select(*[F.col(c).alias(f"t_{c}") for c in self.symbols.columns])
        long = t.where(F.char_length("t_name") >= SHORT_NAME)
        if pairs is not None:
            long = keep(long.join(pairs.select(F.col("id").alias("t_id"), F.col("file").alias("t_from")), "t_id"))

        def meet(refs, name="target_name"):
            on = F.col(name) == F.col("t_name")
            if pairs is not None:
                on = on & (F.col("file") == F.col("t_from"))
            self_call = F.coalesce(F.col("source_id") == F.col("t_id"), F.lit(False))
            return refs.join(long, on & (F.col("source_id") == F.col("t_id"))) if own else refs.join(long, on & ~self_call)

        same_dir = F.col("dir") == F.col("t_dir")
        b = meet(self.bare).join(
            self.admitted.select(F.col("file").alias("af"), F.col("call").alias("ac"), F.col("target").alias("at")),
            (F.col("file") == F.col("af")) & (F.col("target_name") == F.col("ac")) & (F.col("t_file") == F.col("at")), "left",
        )
        go = (F.col("file_language") == "go") & (F.col("t_language") == "go") & same_dir & ~F.col("t_member")
        go = F.coalesce(go, F.lit(False))
        b = b.where((F.col("t_bare_ok") & (F.col("open") | F.col("at").isNotNull() | go)) | ((F.col("t_kind") == "type") & go))
        m = meet(self.member)
        ok = F.col("t_bare_ok") | (F.col("t_kind") == "method")
        near = (F.col("file") == F.col("t_file")) | F.col("t_exported") | (F.col("t_member") & (F.col("t_language") == "go") & F.col("file").endswith(".go") & same_dir)
        reach = (F.col("reach") == "all") | (~F.col("t_member") & ((F.col("reach") == "top") | ((F.col("reach") == "file") & (F.col("target") == F.col("t_file")))))
        m = m.where(ok & F.coalesce(near, F.lit(False)) & reach)
        a = meet(self.alias.where("target_id is null"), "export").where(F.col("t_bare_ok") & (F.col("to").isNull() | (F.col("to") == F.col("t_file"))))
        cols = [F.col("t_id").alias("id"), F.col("t_name").alias("name"), F.col("t_dir").alias("tdir"), "ref_id", "source_id", "file", "line"]
        found = b.select(*cols, F.lit(None).cast("string").alias("receiver"))
        found = found.unionByName(m.select(*cols, "receiver")).unionByName(a.select(*cols, F.lit(None).cast("string").alias("receiver"))).distinct()
        if own:
            return found
        out = self.classed(keep(found), dirname(F.col("file")) == F.col("tdir")).select("id", "ref_id", "source_id", "file", "line", "strength")
        hit = self.refs.where("target_id is not null and not coalesce(source_id = target_id, false)").join(t.select("t_id"), F.col("target_id") == F.col("t_id"))
        return out.unionByName(hit.select(F.col("t_id").alias("id"), "ref_id", "source_id", "file", "line", F.lit("resolved").alias("strength")).distinct())

    def classed(self, found: DataFrame, near=None) -> DataFrame:
        """``found`` (file, name, receiver, ...) with the strength of its unresolved edges; ``near`` are bare calls from the symbol's folder."""
        imported = self.bindings.select(F.col("file").alias("f1"), F.explode(F.array("name", "alias")).alias("n1")).where("n1 is not null").distinct()
        wild = self.bindings.where(wildcard()).select(F.col("file").alias("f2")).distinct()
        spaces = self.bindings.where(F.col("bind").isin("namespace", "module")).select(F.col("file").alias("f3"), F.col("local").alias("l3")).distinct()
        found = (
            found.join(imported, (F.col("file") == F.col("f1")) & (F.col("name") == F.col("n1")), "left")
            .join(wild, F.col("file") == F.col("f2"), "left")
            .join(spaces, (F.col("file") == F.col("f3")) & (F.col("receiver") == F.col("l3")), "left")
        )
        bare_near = F.col("f1").isNotNull() | F.col("f2").isNotNull() | (F.lit(False) if near is None else near)
        strength = (
            F.when(F.col("receiver").isNull(), F.when(bare_near, "import-connected").otherwise("name-match"))
            .when((F.col("receiver") != OPAQUE) & F.col("f3").isNotNull(), "import-connected").otherwise("weak-member")
        )
        return found.withColumn("strength", strength).drop("f1", "n1", "f2", "f3", "l3")


class Split:
    """The caller edges of all symbols in two parts, so that a hot name costs a sum and not a product.

    Most calls reach every symbol of a name that may be called in their way, wherever it
    stands: ``general`` has these once per (cls, name), and ``members`` the symbols of each.
    What depends on the place (own, resolved and admitted calls, the symbol's file and folder)
    is decided for (symbol, calling file) in ``pairs``, and ``exact`` has all edges of those.
    A caller lies in one file, so a symbol's figures are those of its (cls, name), less its
    pairs' share in them, plus those of ``exact``.
    """

    def __init__(self, s: Scoped):
        b, m = F.col("bare_ok"), (F.col("bare_ok") | (F.col("kind") == "method")) & F.col("exported")
        cls = F.concat(F.when(b, "b").otherwise(""), F.when(m, "m").otherwise(""), F.when(m & ~F.col("member"), "p").otherwise(""))
        self.members = store(s.symbols.where(F.char_length("name") >= SHORT_NAME).select("id", "name", "file", "dir", cls.alias("cls")))
        cols, none = ["ref_id", "source_id", "file", "line"], F.lit(None).cast("string").alias("receiver")

        def reaching(df, name, receiver, *classes):
            return df.select(*cols, F.col(name).alias("name"), receiver, F.array(*[F.lit(c) for c in classes]).alias("_of"))

        alias = s.alias.where("target_id is null")
        found = (
            reaching(s.bare.where("open"), "target_name", none, "b", "bm", "bmp").unionByName(reaching(alias.where("to is null"), "export", none, "b", "bm", "bmp"))
            .unionByName(reaching(s.member.where("reach = 'all'"), "target_name", F.col("receiver"), "bm", "bmp", "m", "mp"))
            .unionByName(reaching(s.member.where("reach = 'top'"), "target_name", F.col("receiver"), "bmp", "mp"))
        )
        found = found.join(self.members.select("cls", "name").distinct(), "name").where(F.array_contains("_of", F.col("cls"))).drop("_of").distinct()
        self.general = store(s.classed(found).select("cls", "name", *cols, "strength"))
        called = s.bare.select("file", F.col("target_name").alias("name")).unionByName(s.member.select("file", F.col("target_name").alias("name"))).unionByName(alias.select("file", F.col("export").alias("name"))).distinct()
        there = self.members.select("id", "cls", "name", F.col("file").alias("at"), F.col("dir").alias("in"))
        tied = (
            s.admitted.select("file", F.col("call").alias("name"), F.col("target").alias("at")).unionByName(alias.select("file", F.col("export").alias("name"), F.col("to").alias("at")))
            .unionByName(s.member.where("reach = 'file'").select("file", F.col("target_name").alias("name"), F.col("target").alias("at"))).where("at is not null").distinct()
        )
        near = called.withColumn("in", dirname(F.col("file"))).join(there, ["in", "name"]).select("id", "cls", "name", "file", F.col("in").alias("dir"))
        near = near.unionByName(tied.join(there, ["at", "name"]).select("id", "cls", "name", "file", F.col("in").alias("dir")))
        hit = s.refs.where("target_id is not null").select(F.col("target_id").alias("id"), F.col("file").alias("from")).distinct()
        near = near.unionByName(hit.join(self.members, "id").select("id", "cls", "name", F.col("from").alias("file"), "dir"))
        self.pairs = store(near.distinct())
        self.exact = store(s.edges(s.symbols, pairs=self.pairs, keep=store))

    def meet(self, g: DataFrame, some: int = 4_000_000, most: int = 64) -> DataFrame:
        """Rows of ``g`` (cls, name, file, caller, ...) with every symbol (id) of their class and name, pairs left out.

        These rows are a product, so nothing is shuffled behind this join: pairs are told by the folder, those of
        other folders come along with the row of ``g``. A name with more than ``some`` rows to come is split into
        up to ``most`` tasks; it has over the root of ``some`` calls or symbols, so there are few such names.
        """
        key = ["cls", "name"]
        far = self.pairs.where(F.col("dir") != dirname(F.col("file"))).groupBy(*key, "file").agg(F.collect_set("id").alias("_far"))
        g = store(g.join(far, [*key, "file"], "left"))
        m = self.members.select("id", *key, F.col("dir").alias("_in"))
        both = g.groupBy(*key).agg(F.count("*").alias("_a")).join(m.groupBy(*key).agg(F.count("*").alias("_b")), key).withColumn("_n", F.ceil(F.col("_a") * F.col("_b") / some))
        hot = F.broadcast(store(both.where("_n > 1").select(*key, F.least("_n", F.lit(most)).cast("int").alias("_n"), (F.col("_a") >= F.col("_b")).alias("_wide"))))

        def dealt(df, split, *by):
            one, each = F.array(F.pmod(F.xxhash64(*by), F.col("_n")).cast("int")), F.sequence(F.lit(0), F.col("_n") - 1)
            part = F.when(F.col("_n").isNull(), F.array(F.lit(0))).when(split, one).otherwise(each)
            return df.join(hot, key, "left").withColumn("_part", F.explode(part)).drop("_n", "_wide")

        pair = (F.col("_in") == dirname(F.col("file"))) | F.coalesce(F.array_contains("_far", F.col("id")), F.lit(False))
        return dealt(g, F.col("_wide"), "file", "caller").join(dealt(m, ~F.col("_wide"), "id"), [*key, "_part"]).where(~pair).drop("_part", "_in", "_far")

    def sums(self, per_file, numbers: list[str], by: tuple[str, ...] = ()) -> DataFrame:
        """(id, *by, *numbers) of all symbols; ``per_file`` turns edges and key columns into ``numbers`` per key, file and ``by``."""
        g = store(per_file(self.general, ["cls", "name"]))
        add = lambda df, sign=1: df.select("id", *by, *[(sign * F.col(n)).alias(n) for n in numbers])
        whole = g.groupBy("cls", "name", *by).agg(*[F.sum(n).alias(n) for n in numbers])
        parts = add(self.members.join(whole, ["cls", "name"])).unionByName(add(self.pairs.join(g, ["cls", "name", "file"]), -1)).unionByName(add(per_file(self.exact, ["id"])))
        return parts.groupBy("id", *by).agg(*[F.sum(n).alias(n) for n in numbers]).where(F.col(numbers[0]) > 0)


def resolve_same_file(calls: DataFrame, symbols: DataFrame, types: tuple[str, ...] = ("class", "type")) -> DataFrame:
    """Same-file resolution of bare and member calls (file, ref_id, target_name, receiver, self_receiver, source_id).

    A bare call takes the file's first callable of that name, a member call on ``self`` the
    method of the caller's class, on a class name that class's method. Type names declared
    twice in a file resolve nothing.
    """
    s = symbols.where("name is not null").withColumn("cls", class_of(F.col("fqn")))
    first = F.min(F.struct("start_line", "id")).alias("m")
    top = s.where(~F.col("kind").isin(*NON_CALLABLE_KINDS)).groupBy("file", F.col("name").alias("target_name")).agg(first).select("file", "target_name", F.col("m.id").alias("bare_id"))
    twice = s.where(F.col("kind").isin(*types)).groupBy("file", "name").agg(F.count("*").alias("n")).where("n > 1").select("file", F.col("name").alias("cls"))
    methods = s.where("cls is not null and kind = 'method'").join(twice, ["file", "cls"], "left_anti").groupBy("file", "cls", F.col("name").alias("target_name")).agg(first)
    methods = methods.select("file", F.col("cls").alias("owner"), "target_name", F.col("m.id").alias("member_id"))
    caller = s.select(F.col("id").alias("source_id"), F.col("cls").alias("caller_cls"))
    c = calls.join(caller, "source_id", "left").withColumn("owner", F.when(F.coalesce("self_receiver", F.lit(False)), F.col("caller_cls")).otherwise(F.col("receiver")))
    c = c.join(top, ["file", "target_name"], "left").join(methods, ["file", "owner", "target_name"], "left")
    return c.withColumn("resolved_id", F.when(F.col("receiver").isNull(), F.col("bare_id")).otherwise(F.col("member_id"))).drop("owner", "bare_id", "member_id", "caller_cls")
