import random
import time
from collections import Counter

from codestrata.llm import leakage as L


def edit_model(a, b):
    """Plain version of the rule: some passage of >= 20 words within one edit per five words."""
    for i in range(len(a) - 19):
        row = [0] * (len(b) + 1)
        for n, w in enumerate(a[i:], 1):
            new = [row[0] + 1]
            for j, x in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != w)))
            row = new
            if n >= 20 and 5 * min(row) <= n:
                return True
    return False


def run_model(a, b):
    return any(a[i : i + 12] == b[j : j + 12] for i in range(len(a) - 11) for j in range(len(b) - 11))


def own_words(prompts):
    """Plain version: id -> words of the prompt's sentences that no other prompt has."""
    cut = {i: [tuple(L.words(s)) for s in L._SENTENCE.split(p)] for i, p in prompts.items() if p}
    often = Counter(s for ss in cut.values() for s in set(ss))
    return {i: [w for s in ss if often[s] < 2 for w in s] for i, ss in cut.items()}


def make(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    items = {i: " ".join(r.choice(vocab) for _ in range(r.randint(14, 40))) + ". Reply with one line only." for i in range(40)}
    docs = {}
    for d in range(250):
        ws = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        src = items[r.randrange(40)].split()[:-5]
        n = r.randint(8, len(src))
        at = r.randint(0, len(src) - n)
        part = src[at : at + n]
        for _ in range(r.choice([0, 0, n // 6, n // 5, n // 5 + 1, n // 4])):
            k = r.randrange(len(part))
            what = r.random()
            if what < 0.5:
                part[k] = "zz"
            elif what < 0.75:
                part.insert(k, "yy")
            elif len(part) > 1:
                del part[k]
        k = r.randint(0, len(ws))
        docs[d] = " ".join(ws[:k] + part + ws[k:])
    return items, docs


def test_against_brute_force(spark, monkeypatch):
    items, docs = make(3)
    docs |= {900: "", 901: items[0].upper().replace(" ", "\n// "), 902: "​".join(items[1]), 903: "Reply with one line only. " * 9, 904: "<b>" + items[2].replace(" ", "</b> **") + "**"}
    own = own_words(items)
    want = {(i, d) for i, a in own.items() for d, t in docs.items() if t and (run_model(a, L.words(t)) or edit_model(a, L.words(t)))}
    df = spark.createDataFrame([(d, t, "x") for d, t in docs.items()] + [(905, None, "x"), (901, docs[901], "x")], "doc_id long, text string, item string")
    it = spark.createDataFrame([(i, p) for i, p in items.items()] + [(99, None), (98, ""), (97, "too short")], "item_id long, prompt string")
    for few in (500_000, 0):
        monkeypatch.setattr(L.salted_join, "__defaults__", (5, 500_000))
        rows = L.find_leaks(df, "doc_id", "text", it, "item_id", "prompt", few=few).collect()
        assert {(r.item_id, r.doc_id) for r in rows} == want and len(rows) == len(want)
    assert {(0, 901), (1, 902), (2, 904)} <= want and not any(d == 903 for _, d in want)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    it = spark.createDataFrame([], "item_id long, prompt string")
    assert L.find_leaks(df, "doc_id", "text", it, "item_id", "prompt").count() == 0


def test_alignment_like_the_plain_model():
    r = random.Random(11)
    for size in (3, 8, 40):
        vocab = [f"v{i}" for i in range(size)]
        for _ in range(60):
            a = [r.choice(vocab) for _ in range(r.randint(18, 45))]
            b = [r.choice(vocab) for _ in range(5)] + [w if r.random() > 0.17 else r.choice(vocab) for w in a if r.random() > 0.03] + [r.choice(vocab) for _ in range(5)]
            assert L.close_passage(*L._ids(a, b)) == edit_model(a, b)
            assert L.has_run(*L._ids(a, b)) == run_model(a, b)


def test_signatures_lose_no_leak():
    """A passage with one change in five keeps enough signature shingles, wherever the changes are."""
    r = random.Random(12)
    for n in (20, 25, 30, 35, 39, 60):
        ws = [f"u{r.randint(0, 999)}" for _ in range(n)]
        every, chosen, least = L.signature(ws)
        signed = set(every[chosen].tolist())
        for _ in range(200):
            size = r.randint(20, min(n, 39))
            at = r.randint(0, n - size)
            part = list(ws[at : at + size])
            for k in r.sample(range(size), size // 5):
                part[k] = "zz"
            got = set(L._shingles(L._hash_words(part)).tolist())
            assert len(got & signed) >= least and len(got & set(every.tolist())) >= min(L.SURVIVE, len(every))
    short = [f"u{i}" for i in range(15)]
    every, chosen, _ = L.signature(short)
    assert chosen.sum() < len(every) / 2 and all(set(L._shingles(L._hash_words(short[i : i + 12])).tolist()) & set(every[chosen].tolist()) for i in range(4))


def test_long_texts_of_few_words_are_cheap():
    r = random.Random(13)
    vocab = [f"w{i}" for i in range(30)]
    a, b = [r.choice(vocab) for _ in range(1600)], [r.choice(vocab) for _ in range(3000)]
    began = time.process_time()
    L.close_passage(*L._ids(a, b))
    assert time.process_time() - began < 8
