"""Git as a source: commit log, status and branch facts, by one subprocess each, parsed into rows."""

from __future__ import annotations

import os
import re
import subprocess
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

_SAFE = ["-c", "core.quotePath=false", "-c", "core.fsmonitor=false", "-c", "log.showSignature=false", "-c", "color.ui=false"]
_REF = re.compile(r"^(?!-)[\w./@{}^~-]{1,200}$")
COMMITS = "commit_ord long, repo string, ts timestamp, files array<string>"


class GitError(RuntimeError):
    """``kind`` is one of missing, not-a-repo, timeout, failed."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}".strip(": "))
        self.kind = kind


def safe_ref(ref: str) -> bool:
    return bool(_REF.match(ref)) and ".." not in ref


def run(root: str, *args: str, timeout: float = 30.0) -> str:
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")} | {"GIT_TERMINAL_PROMPT": "0", "GIT_OPTIONAL_LOCKS": "0", "LC_ALL": "C"}
    try:
        got = subprocess.run(["git", *_SAFE, *args], cwd=root, env=env, capture_output=True, timeout=timeout)
    except FileNotFoundError:
        raise GitError("missing") from None
    except subprocess.TimeoutExpired:
        raise GitError("timeout", " ".join(args[:2])) from None
    err = got.stderr.decode("utf-8", "replace")
    if got.returncode:
        raise GitError("not-a-repo" if "not a git repository" in err else "failed", err.strip()[:200])
    return got.stdout.decode("utf-8", "replace")


def parse_log(text: str) -> list[tuple[int, datetime, list[str]]]:
    """Records ``NUL seconds newline path newline ...``; a record without a numeric time is dropped."""
    out = []
    for rec in text.split("\0")[1:]:
        first, *rest = rec.replace("\r\n", "\n").split("\n")
        if first.strip().isdigit():
            out.append((len(out), datetime.fromtimestamp(int(first), timezone.utc), [p for p in rest if p]))
    return out


def log(spark: SparkSession, root: str, repo: str, days: int = 180, cap: int = 10_000, now: datetime | None = None) -> DataFrame:
    """The newest ``cap`` commits without merges of the last ``days``, as the commit table."""
    since = int((now or datetime.now(timezone.utc)).timestamp()) - days * 86_400
    text = run(root, "log", "--no-merges", "--no-renames", "--name-only", f"--max-count={cap}", f"--since=@{since}", "--pretty=format:%x00%ct", "--", ".")
    rows = parse_log(text)
    return spark.createDataFrame([(len(rows) - i, repo, t.replace(tzinfo=None), f) for i, t, f in rows], COMMITS)


_WORDS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "type changed", "U": "conflicted", "?": "untracked"}


def parse_status(text: str) -> list[tuple[str, str, str | None]]:
    """(path, status, original path) of ``status --porcelain -z``."""
    out, parts, i = [], text.split("\0"), 0
    while i < len(parts):
        rec, i = parts[i], i + 1
        if len(rec) < 4:
            continue
        xy, path, orig = rec[:2], rec[3:], None
        if xy[0] in "RC":
            orig, i = parts[i] if i < len(parts) else None, i + 1
        code = "U" if "U" in xy or xy in ("AA", "DD") else next((c for c in xy if c != " "), "M")
        out.append((path, _WORDS.get(code, "modified"), orig))
    return out


def working_set(spark: SparkSession, root: str, ref: str | None = None) -> DataFrame:
    """Changed files of the working tree, or against ``ref``."""
    if ref is None:
        rows = parse_status(run(root, "status", "--porcelain", "-z", "--untracked-files=all", timeout=15.0))
    else:
        if not safe_ref(ref):
            raise ValueError(f"unsafe ref {ref!r}")
        rows = [(p, "modified", None) for p in run(root, "diff", "--name-only", "-z", f"{ref}...HEAD", timeout=15.0).split("\0") if p]
    return spark.createDataFrame(rows, "path string, status string, orig_path string")


def head(root: str) -> str | None:
    try:
        return run(root, "rev-parse", "--short", "HEAD", timeout=3.0).strip() or None
    except GitError:
        return None


def branch_summary(root: str) -> dict:
    """Branch, default branch, commits ahead of it, changed files; None where git cannot tell."""

    def ask(*args):
        try:
            return run(root, *args, timeout=3.0).strip()
        except GitError:
            return None

    default = (ask("symbolic-ref", "--short", "refs/remotes/origin/HEAD") or "").removeprefix("origin/") or None
    default = default or next((b for b in ("main", "master") if ask("rev-parse", "--verify", "--quiet", f"refs/heads/{b}")), None)
    ahead = ask("rev-list", "--count", f"{default}..HEAD") if default else None
    status = ask("status", "--porcelain", "-z")
    return {"branch": ask("rev-parse", "--abbrev-ref", "HEAD"), "default": default, "ahead": int(ahead) if ahead else 0 if default else None, "changed": len(parse_status(status)) if status is not None else None}


def recent_commits(root: str, path: str, n: int = 5) -> list[tuple[str, str, str]]:
    """(hash, date, subject) of the newest commits of a path."""
    text = run(root, "log", f"--max-count={n}", "--pretty=format:%h%x00%cs%x00%s", "--", path, timeout=3.0)
    return [tuple(x.split("\0", 2)) for x in text.splitlines() if x.count("\0") == 2]
