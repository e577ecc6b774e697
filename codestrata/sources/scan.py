"""Source trees as tables: a distributed read of files, the caps and filters of a project scan, configuration."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import lookup, maintain
from codestrata.session import cut

#: Defaults of a project's configuration.
DEFAULT_EXCLUDES = ("node_modules", ".git", "dist", "build", "vendor", "target", "__pycache__")


@dataclass(frozen=True)
class Config:
    exclude: tuple[str, ...] = DEFAULT_EXCLUDES
    max_files: int = 100_000
    max_bytes: int = 1_048_576
    git_window_days: int = 180
    languages: tuple[str, ...] = field(default=())


def load_config(root: str, env: dict | None = None, overrides: dict | None = None) -> Config:
    """Defaults, then ``.codestrata/config.json``, then CODESTRATA_* variables, then overrides; bad values are ignored."""
    layers = []
    try:
        got = json.loads(Path(root, ".codestrata", "config.json").read_text("utf-8"))
        layers.append(got if isinstance(got, dict) else {})
    except (OSError, ValueError):
        pass
    env = os.environ if env is None else env
    layers.append({f.name: env[f"CODESTRATA_{f.name.upper()}"] for f in fields(Config) if f"CODESTRATA_{f.name.upper()}" in env})
    layers.append(overrides or {})
    out = Config()
    for layer in layers:
        for f in fields(Config):
            v = layer.get(f.name)
            if isinstance(getattr(out, f.name), tuple):
                v = v.split(",") if isinstance(v, str) else v
                if isinstance(v, (list, tuple)) and all(isinstance(x, str) and x.strip() for x in v):
                    out = replace(out, **{f.name: tuple(x.strip() for x in v)})
            elif v is not None and not isinstance(v, bool):
                try:
                    n = int(v)
                except (TypeError, ValueError):
                    continue
                if n > 0:
                    out = replace(out, **{f.name: n})
    return out


def relative(path, root: str):
    """A column of full paths or URIs, relative to ``root``."""
    base = (os.path.realpath(root) if "://" not in root else root).rstrip("/") + "/"
    plain = F.regexp_replace(path, "^file:/+", "/")
    return F.regexp_replace(F.when(path.startswith("file:"), F.expr("url_decode(replace(path, '+', '%2B'))")).otherwise(plain), "^.*?" + re.escape(base), "")


def _walk(root: str, exclude: list[str]):
    """((path, length, time in ms) of each file, complete) of a local tree; links and excluded folders are not entered."""
    skip, out, complete, todo = re.compile(lookup.exclude_regex(exclude)), [], True, [""]
    while todo:
        at = todo.pop()
        try:
            with os.scandir(os.path.join(root, at)) as entries:
                for e in entries:
                    rel = f"{at}/{e.name}" if at else e.name
                    if e.is_symlink() or skip.match(rel):
                        continue
                    if e.is_dir():
                        todo.append(rel)
                    elif e.is_file():
                        s = e.stat()
                        out.append((rel, s.st_size, s.st_mtime_ns / 1e6))
        except OSError:
            complete = False
    return out, complete


def listing(spark: SparkSession, root: str, config: Config | None = None) -> tuple[DataFrame, bool]:
    """((path, size, last_modified, language) of the files that a scan takes, complete): no file is read.

    Files of a known language take the slots under ``max_files`` first, shallow ones before deep
    ones; the cap is a limit of the project, not a safeguard against size. A local tree is walked by
    the driver, as it may be on the driver's disk only; another file system is listed by Spark. ``complete`` is
    false where a folder could not be read: what is missing then may still be there.
    """
    config = config or Config()
    if "://" in root:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(relative(F.col("path"), root).alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1000.0).alias("last_modified"))
        f, complete = f.where(~lookup.excluded(F.col("path"), list(config.exclude))), True
    else:
        rows, complete = _walk(os.path.realpath(root), list(config.exclude))
        f = spark.createDataFrame(rows, "path string, size long, last_modified double")
    f = f.where(F.col("size") <= config.max_bytes).withColumn("language", lookup.detect_language(F.col("path")))
    if config.languages:
        f = f.where(F.col("language").isin(*config.languages, "unknown"))
    order = [(F.col("language") == "unknown").cast("int"), F.size(F.split("path", "/")), F.col("path")]
    return f.orderBy(*order).limit(config.max_files), complete


def read_files(spark: SparkSession, root: str, found: DataFrame) -> DataFrame:
    """``found`` (path, size, last_modified, language) with ``data``, read by the workers; what cannot be read is left out."""
    base = (os.path.realpath(root) if "://" not in root else root).rstrip("/")

    def read(batches):
        for b in batches:
            fs, top = FileSystem.from_uri(base) if "://" in base else (LocalFileSystem(), base)
            data = []
            for p in b.column(0).to_pylist():
                try:
                    with fs.open_input_stream(f"{top}/{p}") as f:
                        data.append(f.read())
                except OSError:
                    data.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], names=[*b.schema.names, "data"])

    f = cut(found.select("path", "size", "last_modified", "language")).repartition("path")
    return f.mapInArrow(read, "path string, size long, last_modified double, language string, data binary").where("data is not null")


def scan(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """(path, language, size, last_modified, content_hash, content) of the files of a tree, see :func:`listing`.

    Only the files that the listing keeps are opened; of those of no known language the first 8 KiB tell binary ones.
    """
    config = config or Config()
    f = read_files(spark, root, listing(spark, root, config)[0])
    known = F.col("language") != "unknown"
    f = f.where(known | ~F.hex(F.substring("data", 1, 8192)).rlike("^(..)*00"))
    f = f.withColumn("content", F.when(known, F.decode("data", "UTF-8")))
    f = f.withColumn("language", lookup.refine_header(F.col("language"), F.col("path"), F.coalesce("content", F.lit(""))))
    return f.select("path", "language", "size", "last_modified", maintain.content_hash(F.col("data")).alias("content_hash"), "content")


def package_entries(text: str) -> list[str]:
    """Entry files a ``package.json`` names: main, bin and exports, without types and wildcards."""
    try:
        data = json.loads(text)
    except ValueError:
        return []
    if not isinstance(data, dict):
        return []
    out: list[str] = []

    def take(v):
        if isinstance(v, str):
            if "*" not in v:
                out.append(v.removeprefix("./"))
        elif isinstance(v, dict):
            for k, x in v.items():
                if k != "types" and "*" not in k:
                    take(x)
        elif isinstance(v, list):
            for x in v:
                take(x)

    for key in ("main", "bin", "exports"):
        take(data.get(key))
    return list(dict.fromkeys(out))


def read_text(root: str, path: str, max_bytes: int = 1_048_576) -> str | None:
    """A file's text, or None for links, other than files, too large ones and paths outside the root."""
    p = Path(root, path)
    base = Path(root).resolve()
    try:
        if p.is_symlink() or not p.is_file() or p.stat().st_size > max_bytes or base not in p.resolve().parents:
            return None
        return p.read_text("utf-8", errors="replace")
    except OSError:
        return None
