"""Keyword search over symbols and notes, suggestions, structural patterns, text budgets."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.session import cut

#: Field boosts of the symbol search and the usual BM25 constants.
BOOSTS = {"name": 3.0, "signature": 1.5, "doc": 1.0, "fqn": 1.0}
EXPORTED, K1, B = 1.5, 1.2, 0.75

#: Edits allowed per letter of a word, and the weight of terms that only begin with it or are near it.
FUZZY, MOST_EDITS, PREFIX_WEIGHT, FUZZY_WEIGHT = 0.2, 6, 0.375, 0.45

#: Names users give to languages.
LANGUAGE_ALIASES = {
    "ts": ["typescript", "tsx"], "typescript": ["typescript", "tsx"], "tsx": ["tsx"], "js": ["javascript"], "jsx": ["javascript"], "javascript": ["javascript"], "py": ["python"], "python": ["python"],
    "java": ["java"], "go": ["go"], "golang": ["go"], "rs": ["rust"], "rust": ["rust"], "swift": ["swift"], "kt": ["kotlin"], "kotlin": ["kotlin"], "dart": ["dart"], "cs": ["csharp"], "c#": ["csharp"], "csharp": ["csharp"],
    "php": ["php"], "rb": ["ruby"], "ruby": ["ruby"], "c": ["c"], "cpp": ["cpp"], "c++": ["cpp"], "objc": ["objc"], "objective-c": ["objc"], "m": ["objc"],
}


def languages_of(name: str) -> list[str]:
    """Language ids of an alias; an unknown one is an error."""
    try:
        return LANGUAGE_ALIASES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown language {name!r}") from None


def terms(c):
    """Lower-case words of an identifier or text; camel case and snake case split."""
    apart = F.regexp_replace(F.regexp_replace(c, "([\\p{Ll}\\p{N}])(\\p{Lu})", "$1 $2"), "(\\p{Lu})(\\p{Lu}\\p{Ll})", "$1 $2")
    return F.filter(F.split(F.lower(F.coalesce(apart, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def term_weight(t, word: str, fuzzy: float = FUZZY):
    """1 for the word itself, less for terms that begin with it or lie within ``fuzzy`` of its length in edits, else 0."""
    n, reach = F.char_length(t), min(MOST_EDITS, round(fuzzy * len(word)))
    dist = F.levenshtein(t, F.lit(word))
    prefix = PREFIX_WEIGHT * n / (n + 0.3 * (n - len(word)))
    near = F.when((F.abs(n - len(word)) <= reach) & (dist <= reach), FUZZY_WEIGHT * n / (n + dist)).otherwise(0.0)
    return F.when(t == word, 1.0).when(F.startswith(t, F.lit(word)), prefix).otherwise(near)


def bm25(docs: DataFrame, query: list[str], boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """``docs`` with ``score`` added, rows without a hit left out.

    Terms count in full if equal to a word of the query, at a discount if they begin with it
    or are near it. The query is short: term counts are taken from the rows' own token arrays, so one
    scan gives the collection's figures and another the scores, without a postings shuffle.
    """
    tok = docs.withColumns({f"_t_{f}": terms(F.col(f)) for f in boosts})

    def times(field, word):
        return F.aggregate(f"_t_{field}", F.lit(0.0), lambda n, t: n + term_weight(t, word))

    tf = {(f, q): times(f, q) for f in boosts for q in query}
    stats = tok.agg(
        F.count("*").alias("n"), *[F.avg(F.size(f"_t_{f}")).alias(f"l_{f}") for f in boosts],
        *[F.count_if(c > 0).alias(f"d_{f}_{i}") for f in boosts for i, c in enumerate(tf[f, q] for q in query)],
    ).first()
    if not stats["n"]:
        return docs.withColumn("score", F.lit(0.0)).limit(0)
    score = F.lit(0.0)
    for f, w in boosts.items():
        for i, q in enumerate(query):
            df = stats[f"d_{f}_{i}"]
            idf = F.log(F.lit(1.0) + (F.lit(float(stats["n"])) - df + 0.5) / (F.lit(float(df)) + 0.5))
            norm = K1 * (1 - B + B * F.size(f"_t_{f}") / F.lit(float(stats[f"l_{f}"] or 1.0)))
            score = score + F.lit(w) * idf * tf[f, q] * (K1 + 1) / (tf[f, q] + norm)
    return tok.withColumn("score", score).where("score > 0").drop(*[f"_t_{f}" for f in boosts])


def search_symbols(symbols: DataFrame, query: list[str], limit: int = 20, languages: list[str] | None = None, churn: DataFrame | None = None) -> DataFrame:
    """Ranked symbols: BM25, times 1.5 if exported, times the churn boost of the file; ``total`` hits before the limit."""
    if languages:
        symbols = symbols.where(F.col("language").isin(*languages))
    hit = bm25(symbols, query).withColumn("score", F.col("score") * F.when(F.col("exported"), EXPORTED).otherwise(1.0))
    if churn is not None:
        top = churn.agg(F.max("commits")).first()[0] or 0
        c = churn.select(F.col("path").alias("_p"), F.col("commits").alias("_c"))
        boost = 1 + 0.5 * F.log1p(F.coalesce("_c", F.lit(0))) / F.log1p(F.lit(float(max(top, 1))))
        hit = hit.join(c, F.col("file") == F.col("_p"), "left").withColumn("score", F.col("score") * boost)
    hit = cut(hit.withColumn("score", F.round("score", 6)).select("id", "name", "file", "score"))
    total = hit.count()
    return hit.orderBy(F.desc("score"), "file", "name", "id").limit(limit).withColumn("total", F.lit(total).cast("bigint"))


def suggest(symbols: DataFrame, query: str, limit: int = 10, fuzzy: float = FUZZY) -> DataFrame:
    """Symbols near a query: the whole name equal, begun by it, or within ``fuzzy`` of its length in edits; else a term of the name (twice) or fqn; filters come before the limit."""
    q = query.lower()
    reach = max(1, round(fuzzy * len(q)))
    low = F.lower("name")
    dist = F.levenshtein(low, F.lit(q))
    whole = F.when(low == q, 4.0).when(F.startswith(low, F.lit(q)), 2.0 + len(q) / F.char_length("name")).when(dist <= reach, 1.0 - dist / len(q)).otherwise(0.0)
    best = lambda f: F.coalesce(F.array_max(F.transform(terms(F.col(f)), lambda t: term_weight(t, q, fuzzy))), F.lit(0.0))
    hit = symbols.where("name is not null").withColumn("score", F.round(F.greatest(whole, 2.0 * best("name"), best("fqn")), 6)).where("score > 0")
    return hit.orderBy(F.desc("score"), "name", "file", "id").limit(limit).select("id", "name", "file", "score")


def search_notes(notes: DataFrame, query: list[str], limit: int = 20) -> DataFrame:
    """Per word 2 if an anchor holds it, else 1 if the text does; score, recency, id order."""
    score = sum((F.when(F.contains(F.lower("anchor_text"), F.lit(q)), 2).when(F.contains(F.lower("text"), F.lit(q)), 1).otherwise(0) for q in query), F.lit(0))
    return notes.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("created_at"), "id").limit(limit)


def within_budget(blocks: DataFrame, group: list[str], order: list[str], text: str, budget: int = 3000, floor: int = 1) -> DataFrame:
    """The blocks of each group that fit a token budget, in order; stops at the first that does not. ``floor`` blocks stay anyway."""
    cost = F.ceil(F.char_length(F.coalesce(text, F.lit(""))) / 4)
    w = W.partitionBy(*group).orderBy(*order)
    run = F.sum("cost").over(w.rowsBetween(W.unboundedPreceding, 0))
    return blocks.withColumn("cost", cost).withColumn("spent", run).withColumn("place", F.row_number().over(w)).where((F.col("spent") <= budget) | (F.col("place") <= floor))


_LEX = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|\$\$\$\w*|\$[A-Z_]\w*|[A-Za-z_$][\w$]*|\d[\w.]*|=>|[=!<>]=+|&&|\|\||\+\+|--|\S", re.S)
_CLOSE = {"(": ")", "[": "]", "{": "}"}


def tokens_of(text: str) -> list[tuple[str, int]]:
    return [(m.group(), m.start()) for m in _LEX.finditer(text) if not m.group().startswith(("//", "/*"))]


def compile_pattern(pattern: str) -> list[str]:
    """Tokens of a structural pattern; brackets must balance."""
    toks, depth = [t for t, _ in tokens_of(pattern)], []
    for t in toks:
        if t in _CLOSE:
            depth.append(_CLOSE[t])
        elif t in _CLOSE.values() and (not depth or depth.pop() != t):
            raise ValueError(f"unbalanced pattern {pattern!r}")
    if depth or not toks:
        raise ValueError(f"unbalanced or empty pattern {pattern!r}")
    return toks


def match_pattern(toks: list[tuple[str, int]], pat: list[str]) -> list[int]:
    """Positions where the pattern matches: ``$X`` one operand with its member, call and index tail, ``$$$`` any balanced run."""
    words, jump, stack = [t for t, _ in toks], {}, []
    for i, t in enumerate(words):
        if t in _CLOSE:
            stack.append(i)
        elif t in _CLOSE.values() and stack and _CLOSE[words[stack[-1]]] == t:
            jump[stack.pop()] = i
    n = len(words)

    def unit(i):
        """End of the balanced unit at i, or -1."""
        if i >= n or words[i] in ")]},;":
            return -1
        return jump.get(i, -2) + 1 if words[i] in _CLOSE else i + 1

    def go(i, k, seen):
        if k == len(pat):
            return i
        p = pat[k]
        if p.startswith("$$$"):
            while True:
                e = go(i, k + 1, seen)
                if e >= 0:
                    return e
                if i < n and words[i] == ",":
                    i += 1
                    continue
                j = unit(i)
                if j < 0:
                    return -1
                i = j
        if p[0] == "$" and len(p) > 1 and p[1].isupper():
            j = unit(i)
            while j >= 0:
                val = " ".join(words[i:j])
                if seen.get(p, val) == val:
                    e = go(j, k + 1, seen | {p: val})
                    if e >= 0:
                        return e
                if j < n and words[j] in ".+-*/%<>=&|?!:" or j < n and words[j] in "([":
                    j = unit(j)
                elif j < n and words[j - 1] in ".+-*/%<>=&|?!:":
                    j = unit(j)
                else:
                    return -1
            return -1
        return go(i + 1, k + 1, seen) if i < n and words[i] == p else -1

    return [i for i in range(n) if go(i, 0, {}) >= 0]


def pattern_matches(texts: DataFrame, pattern: str, snippet: int = 120) -> DataFrame:
    """(path, line, snippet) of every match of a structural pattern."""
    pat = compile_pattern(pattern)

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                toks = tokens_of(text)
                for i in match_pattern(toks, pat):
                    at = toks[i][1]
                    rows.append((path, text.count("\n", 0, at) + 1, re.split(r"[\r\n]", text[at:], maxsplit=1)[0][:snippet]))
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["path", "line", "snippet"])

    return texts.where("path is not null and content is not null").select("path", "content").mapInArrow(run, "path string, line int, snippet string")
