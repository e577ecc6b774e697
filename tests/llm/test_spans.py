import random

from codestrata.llm import spans as S


def brute(texts, n):
    seen = {}
    for k, t in texts.items():
        for i in range(len(t) - n + 1):
            seen.setdefault(t[i : i + n], set()).add(k)
    return {k for v in seen.values() if len(v) > 1 for k in v}


def amounts(texts, n):
    """Plain version: code points of each record inside some stretch of ``n`` that another record has."""
    seen = {}
    for k, t in texts.items():
        for i in range(len(t) - n + 1):
            seen.setdefault(t[i : i + n], set()).add(k)
    out = {}
    for k, t in texts.items():
        covered = {j for i in range(len(t) - n + 1) if len(seen[t[i : i + n]]) > 1 for j in range(i, i + n)}
        if covered:
            out[k] = len(covered)
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcde 中🙂\n") for _ in range(n))
    notice, texts = word(1000), {}
    for k in range(120):
        n = r.choice([150, 219, 220, 250, 285, 295, 298, 299, 300, 301, 305, 320, 379, 380, 381, 450])
        at = r.randint(0, 1000 - n)
        texts[k] = word(r.choice([0, 1, 7, 60, 200])) + notice[at : at + n] + word(r.choice([0, 1, 9, 300]))
    texts[500] = "=" * 700
    texts[501] = "x" + "=" * 300
    texts[502] = "-" * 900  # repeats only itself
    texts[503] = "ab" * 150 + "q"
    texts[504] = "z" + "ab" * 150
    texts[505] = "cd" * 149 + "c"
    texts[506] = "!" + "cd" * 149 + "c"
    return texts


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        rows = list(texts.items()) + [(900, None), (901, ""), (502, "-" * 900)]
        df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, rec string, part int").repartition(4)
        got = {r.doc_id for r in S.sharing_records(df, "doc_id", "text").collect()}
        assert got == brute(texts, 300)
        rows = S.shared_amount(df, "doc_id", "text").collect()
        assert {r.doc_id: r.shared_chars for r in rows} == amounts(texts, 300) and len(rows) == len(got)
        assert all(r.n_chars == len(texts[r.doc_id]) and r.shared_chars >= 300 for r in rows)


def test_empty_and_amount(spark):
    df = spark.createDataFrame([(1, "abcdefgh" * 3 + "".join(chr(97 + i * i % 23) for i in range(900)) + "tail one"), (2, "".join(chr(97 + i * i % 23) for i in range(900))), (3, "other")], "doc_id long, text string")
    assert S.sharing_records(df.limit(0), "doc_id", "text").count() == 0
    rows = {r.doc_id: r for r in S.shared_amount(df, "doc_id", "text").collect()}
    assert set(rows) == {1, 2} and all(r.shared_chars == 900 for r in rows.values())


def test_very_common_notice(spark, monkeypatch):
    """A notice that most records carry, with the limits of a hot key and of a broadcast far below it."""
    import codestrata.llm.skew as K

    monkeypatch.setattr(K.join_by_key, "__defaults__", (10,))
    monkeypatch.setattr(S, "FEW_RECORDS", 3)
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    notice = word(500)
    texts = {k: word(r.randint(0, 90)) + (notice if k % 3 else notice[:290]) + word(50) for k in range(200)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.doc_id: x.shared_chars for x in S.shared_amount(df, "doc_id", "text").collect()} == amounts(texts, 300)
