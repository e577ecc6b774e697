"""The endpoints over one index: each takes plain arguments and returns tables, ranked and limited."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions import expressions as X
from codestrata.operators import graph, history, lookup, notes, resolve, search
from codestrata.plans import views
from codestrata.session import cut
from codestrata.sources import git, scan


class Index:
    """An index over a folder of tables."""

    def __init__(self, spark: SparkSession, folder: str, note_store: notes.NoteStore | None = None):
        self.spark, self.folder, self.store = spark, folder, note_store

    @cached_property
    def files(self) -> DataFrame:
        return views.files(self.spark, self.folder)

    @cached_property
    def symbols(self) -> DataFrame:
        return views.symbols(self.spark, self.folder)

    @cached_property
    def scoped(self) -> resolve.Scoped:
        return resolve.Scoped(views.refs(self.spark, self.folder), self.symbols, views.bindings(self.spark, self.folder), self.files)

    @cached_property
    def fan_in(self) -> DataFrame:
        return cut(self.scoped.fan_in())

    @cached_property
    def commits(self) -> DataFrame:
        return views.commits(self.spark, self.folder)

    @cached_property
    def pairs(self) -> DataFrame:
        return history.cochange(self.commits, self.files)

    @cached_property
    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/source_texts.parquet").groupBy("path").agg(F.max("content").alias("content"))

    def _notes(self) -> tuple[DataFrame, DataFrame] | None:
        """(notes, anchors) of the store, None where there are none."""
        n = self.store.read() if self.store else None
        return None if n is None else (n.select("id", "text", "created_at"), n.select(F.col("id").alias("note_id"), F.explode("anchors").alias("a")).select("note_id", "a.*"))

    def _verdicts(self, anchors: DataFrame) -> DataFrame:
        return notes.anchor_verdicts(anchors, self.files, self.symbols)

    def overview(self, path: str | None = None, root: str | None = None) -> dict:
        """``root``: the project on disk, for what its ``package.json`` names and for the branch."""
        f = self.files.where(F.startswith("path", F.lit(path))) if path else self.files
        s = self.symbols.join(f.select(F.col("path").alias("file")), "file", "left_semi")
        named = None
        if root is not None:
            entries = scan.package_entries(scan.read_text(root, "package.json") or "")
            named = self.spark.createDataFrame([(e,) for e in entries], "path string")
        held = self._notes()
        return {
            "entry_points": lookup.entry_points(f, s, self.texts, named),
            "knowledge": notes.knowledge_counts(*held) if held else None,
            "branch": git.branch_summary(root) if root is not None else None,
            "languages": f.groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language"),
            "kinds": s.groupBy("kind").agg(F.count("*").alias("symbols")).orderBy(F.desc("symbols"), "kind"),
            "folders": lookup.directory_groups(s, f),
            "hotspots": history.hotspots(history.commit_counts(self.commits), f, 10),
            "risk": graph.risk_hotspots(f, s, self.fan_in),
        }

    def find_symbol(self, name: str, kind: str | None = None, scope: str | None = None, limit: int = 10) -> DataFrame:
        """Matches in order with callers and callees; a scope that is no file is a folder. Where there are none, :meth:`suggestions` may help."""
        if scope and not scope.endswith("/") and not self.files.where(F.col("path") == scope).limit(1).count():
            scope += "/"
        hit = lookup.find_symbols(self.symbols, name, min(limit, 100), kind, scope)
        out = hit.join(self.fan_in, "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
        called = self.scoped.refs.where("target_id is not null").groupBy(F.col("source_id").alias("id")).agg(F.count_distinct("target_id").alias("callees"))
        out = out.join(called, "id", "left").withColumn("callees", F.coalesce("callees", F.lit(0))).withColumn("complexity_label", X.complexity_label(F.col("complexity"), F.col("cognitive")))
        return out.orderBy(F.desc("is_exact"), F.desc(F.coalesce(F.col("exported"), F.lit(False)).cast("int")), "depth", "file", "name", "start_line", "id")

    def suggestions(self, name: str, kind: str | None = None, scope: str | None = None, limit: int = 5) -> DataFrame:
        return search.suggest(lookup.in_scope(self.symbols, kind, scope), name, limit)

    def _pick(self, file: str, symbol: str, line: int | None = None) -> DataFrame:
        path = lookup.normalize_path(file)
        simple = symbol.rsplit(".", 1)[-1]
        got = self.scoped.symbols.where((F.col("file") == (path or "")) & (F.col("name") == simple))
        return got if line is None else got.orderBy(F.abs(F.col("start_line") - line), "id").limit(1)

    def get_context(self, file: str, symbol: str | None = None, line: int | None = None, max_tokens: int = 3000) -> dict[str, DataFrame]:
        path = lookup.normalize_path(file) or ""
        out = {
            "symbols": self.symbols.where(F.col("file") == path).orderBy("start_line", "id"),
            "imports": views.bindings(self.spark, self.folder).where(F.col("file") == path).orderBy("line", "pos"),
            "partners": history.partners(self.pairs, 20, 5).where(F.col("file") == path),
            "recent": history.recent(self.commits, 5).where(F.col("path") == path),
        }
        if symbol:
            t = self._pick(path, symbol, line)
            refs = self.scoped.refs
            full = self.symbols.join(t.select("id"), "id", "left_semi")
            out["symbol"] = full.withColumn("complexity_label", X.complexity_label(F.col("complexity"), F.col("cognitive")))
            body = full.join(self.texts, F.col("file") == F.col("path")).select("id", X.code_slice(F.col("content"), F.col("start_line"), F.col("end_line")).alias("body"))
            # a body that does not fit is cut at a whole character; four of them count as a token
            out["body"] = body.select("id", F.substring("body", 1, 4 * max_tokens).alias("body"), (F.char_length("body") > 4 * max_tokens).alias("truncated"))
            out["callers"] = graph.strict_callers(refs, self.symbols).join(t.select("id"), "id", "left_semi")
            called = refs.where("target_id is not null").join(t.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
            out["callees"] = self.symbols.join(called, "id", "left_semi").select("id", "name", "kind", "file", "start_line")
            trees = graph.caller_trees(self.scoped, t.select("id"), 2)
            out["coupling"] = graph.caller_summary(trees)
        else:
            own = out["symbols"].where("exported and name is not null").select("id", "name")
            names = self.scoped.symbols.join(own.select("id"), "id", "left_semi")
            out["export_callers"] = self.scoped.edges(names).where(F.col("file") != path).join(own, "id").groupBy("file").agg(F.array_sort(F.collect_set("name")).alias("names"))
        held = self._notes()
        if held:
            at = out["symbol"] if symbol else out["symbols"].limit(1).withColumn("name", F.lit(None).cast("string"))
            shown = notes.notes_of_context(*held, at.select(F.col("id").alias("target_id"), "file", "name"))
            text = shown.join(held[0].select(F.col("id").alias("note_id"), "text"), "note_id")
            out["notes"] = notes.note_verdicts(text.withColumn("id", F.col("note_id")), self._verdicts(held[1]))
        budget = out["symbols"].withColumn("block", F.concat_ws("\n", "signature", "doc"))
        out["budgeted"] = search.within_budget(budget, ["file"], ["start_line", "id"], "block", max_tokens)
        return out

    def find_references(self, file: str, symbol: str, line: int | None = None, limit: int = 20) -> DataFrame:
        t = self._pick(file, symbol, line)
        return graph.rank_references(self.scoped.edges(t), t, min(limit, 100))

    def impact(self, file: str, symbol: str, line: int | None = None, depth: int = 3, include_weak: bool = False, max_tokens: int | None = None) -> DataFrame:
        """The caller tree in breadth-first order; with ``max_tokens`` as many rows as fit, 25 tokens each."""
        tree = graph.caller_trees(self.scoped, self._pick(file, symbol, line).select("id"), min(depth, 5), include_weak=include_weak)
        return tree if max_tokens is None else tree.where(F.col("node") <= max(1, max_tokens // 25))

    def impact_totals(self, file: str, symbol: str, line: int | None = None, depth: int = 3, include_weak: bool = False) -> DataFrame:
        """Distinct callers and files of :meth:`impact`, by tier, and whether a limit cut the walk short."""
        return graph.caller_summary(self.impact(file, symbol, line, depth, include_weak))

    def changes(self, changed: DataFrame | None = None, limit: int = 10, root: str | None = None, ref: str | None = None) -> dict[str, DataFrame]:
        """``changed``: (path, status, orig_path), or the working tree of ``root``, against ``ref`` if given.

        Symbols of a renamed file are looked up under its old path too. ``symbols`` has the three most called of
        each file shown, with their callers within two hops; ``suspects`` the notes that no longer hold.
        """
        changed = git.working_set(self.spark, root, ref) if changed is None else changed
        own = self.symbols.join(changed.select(F.col("path").alias("file")), "file", "left_semi")
        lost = changed.join(own.select(F.col("file").alias("path")).distinct(), "path", "left_anti").where("orig_path is not null")
        old = self.symbols.join(lost.select(F.col("orig_path").alias("file"), F.col("path").alias("now")), "file").withColumn("file", F.col("now")).drop("now")
        s = own.unionByName(old).join(self.fan_in, "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
        per = s.groupBy("file").agg(F.max("callers").alias("callers"), F.count("*").alias("symbols"))
        ranked = changed.select(F.col("path").alias("file"), "status").join(per, "file", "left").fillna(0, ["callers", "symbols"]).orderBy(F.desc("callers"), "file").limit(min(limit, 30))
        best = s.join(F.broadcast(ranked.select("file")), "file").withColumn("place", F.row_number().over(W.partitionBy("file").orderBy(F.desc("callers"), "start_line", "id"))).where("place <= 3")
        touched = changed.select("path").unionByName(changed.where("orig_path is not null").select(F.col("orig_path").alias("path")))
        out = {"files": ranked, "symbols": best.join(graph.blast_of(self.scoped, best.select("id")), "id", "left"), "missing": history.missing_partners(touched, self.pairs)}
        held = self._notes()
        if held:
            out["suspects"] = notes.suspect_notes(self._verdicts(held[1]), touched)
        return out

    def search_structure(self, query: str | None = None, pattern: str | None = None, language: str | None = None, limit: int = 20) -> DataFrame:
        if (query is None) == (pattern is None):
            raise ValueError("give a query or a pattern")
        langs = search.languages_of(language) if language else None
        if query is not None:
            churn = history.commit_counts(self.commits).groupBy("path").agg(F.sum("commits").alias("commits"))
            words = [w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()]
            return search.search_symbols(self.symbols, words, min(limit, 100), langs, churn)
        t = self.texts.where(lookup.detect_language(F.col("path")).isin(*(langs or ["typescript", "tsx", "javascript"])))
        m = search.pattern_matches(t, pattern)
        return m.orderBy(F.size(F.split("path", "/")), "path", "line").limit(limit)

    def remember(self, note: str, anchors: list[dict | str], created_at: str) -> str:
        """Anchors, as dicts or ``file[:symbol[:line]]``, keep the hash of the indexed file and the signature of the symbol.

        A symbol that the file does not have leaves an anchor on the file alone.
        """
        full = []
        for a in anchors:
            if isinstance(a, str):
                one = self.spark.createDataFrame([(a,)], "raw string").select(*[c.alias(k) for k, c in lookup.parse_anchor(F.col("raw")).items()]).first()
                if one.file is None:
                    raise ValueError("an anchor names a file")
                a = one.asDict()
            path = lookup.normalize_path(a["file"])
            f = self.files.where(F.col("path") == (path or "")).select("content_hash").first()
            s = self.symbols.where((F.col("file") == (path or "")) & (F.col("name") == a["symbol"].rsplit(".", 1)[-1])).orderBy(F.abs(F.col("start_line") - (a.get("line") or 0)), "id").select("signature").first() if a.get("symbol") else None
            full.append({"file": path, "symbol": a.get("symbol") if s or "." in (a.get("symbol") or "") else None, "file_hash": f[0] if f else None, "signature": s[0] if s else None})
        return self.store.remember(note, full, created_at)

    def recall(self, query: str | None = None, file: str | None = None, symbol: str | None = None, limit: int = 10, max_tokens: int = 3000) -> DataFrame:
        """Notes with their verdicts, newest first, as many as ``limit`` and ``max_tokens`` let through, one at least."""
        n = self.store.read()
        a = n.select(F.col("id").alias("note_id"), F.explode("anchors").alias("a")).select("note_id", "a.*")
        got = notes.recall(n.select("id", "text", "created_at"), a, query.lower().split() if query else None, file, symbol, min(limit, 50))
        got = search.within_budget(got.withColumn("_all", F.lit(1)), ["_all"], [F.desc("created_at"), "id"], "text", max_tokens).drop("_all", "cost", "spent", "place")
        return notes.note_verdicts(got, self._verdicts(a)).orderBy(F.desc("created_at"), "id")

    def forget(self, note: str) -> bool:
        return self.store.forget(note)
