"""Extraction of symbols, calls and imports from source texts, as tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions import outline as O
from codestrata.operators.lookup import LANGUAGES

_KIND = (
    "path string, language string, symbols array<struct<id string, name string, fqn string, kind string, start_line int, end_line int, signature string, doc string, exported boolean, complexity int, cognitive int>>, "
    "calls array<struct<source_id string, target_name string, receiver string, self_receiver boolean, line int>>, imports array<struct<source_module string, line int, name string, alias string, kind string>>"
)
_SYMBOL = pa.struct([("id", pa.string()), ("name", pa.string()), ("fqn", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("doc", pa.string()), ("exported", pa.bool_()), ("complexity", pa.int32()), ("cognitive", pa.int32())])
_CALL = pa.struct([("source_id", pa.string()), ("target_name", pa.string()), ("receiver", pa.string()), ("self_receiver", pa.bool_()), ("line", pa.int32())])
_IMPORT = pa.struct([("source_module", pa.string()), ("line", pa.int32()), ("name", pa.string()), ("alias", pa.string()), ("kind", pa.string())])


def _language(path: str) -> str:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower(), "unknown") if "." in path else "unknown"


def _run(batches):
    for b in batches:
        paths, langs, syms, calls, imps = [], [], [], [], []
        for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            lang = _language(p)
            o = O.outline(p, t, lang)
            paths.append(p)
            langs.append(lang)
            syms.append([{f.name: s.get(f.name) for f in _SYMBOL} for s in o["symbols"]])
            calls.append([{f.name: c.get(f.name) for f in _CALL} for c in o["calls"]])
            imps.append([{"source_module": i["module"], "line": i["line"], "name": i["name"], "alias": i["alias"], "kind": i["kind"]} for i in o["imports"]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(langs, pa.string()), pa.array(syms, pa.list_(_SYMBOL)), pa.array(calls, pa.list_(_CALL)), pa.array(imps, pa.list_(_IMPORT))],
            names=["path", "language", "symbols", "calls", "imports"],
        )


def outlines(texts: DataFrame) -> DataFrame:
    """One row per file with its symbols, calls and imports nested; one pass over each text."""
    return texts.where("path is not null and content is not null").select("path", "content").mapInArrow(_run, _KIND)


def _complexities(batches):
    for b in batches:
        n = [O.body_complexity(c, _language(p)) for p, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["id", "complexity"])


def known_language(path):
    """Whether a path is of a language whose decisions are known."""
    end = F.lower(F.regexp_extract(path, "\\.([^./]*)$", 1))
    return end.isin(*[e for e, lang in LANGUAGES.items() if lang in O.SPECS or lang in ("python", "ruby")])


def complexities(bodies: DataFrame) -> DataFrame:
    """(id, complexity) of function bodies (id, file, code), by the language of the file."""
    return bodies.select("id", "file", "code").mapInArrow(_complexities, "id string, complexity int")


def symbols_of(out: DataFrame) -> DataFrame:
    return out.select(F.col("path").alias("file"), "language", F.explode("symbols").alias("s")).select("s.*", "file", "language")


def calls_of(out: DataFrame) -> DataFrame:
    return out.select(F.col("path").alias("file"), F.posexplode("calls").alias("ord", "c")).select("file", "ord", "c.*", F.lit("calls").alias("kind"))


def imports_of(out: DataFrame) -> DataFrame:
    return out.select(F.col("path").alias("file"), F.posexplode("imports").alias("pos", "i")).select("file", "pos", "i.*")
