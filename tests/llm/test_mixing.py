import hashlib

from pyspark.sql import functions as F

from pixelloom.llm import mixing as M

from .conftest import TEXTS


def fill(budget, children):
    """Water level by bisection: children are (weight, cap)."""
    if budget >= sum(c for _, c in children):
        return [c for _, c in children]
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(c, w * mid) for w, c in children) < budget else (lo, mid)
    return [min(c, w * lo) for w, c in children]


def slow(docs, weights, budget, epochs, seed):
    words = lambda t: len((t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) - (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ").count("")
    leaves = {}
    for i, t, *path in docs:
        leaves.setdefault(tuple(path), []).append((i, words(t)))
    supply = {p: sum(n for _, n in v) for p, v in leaves.items()}
    shares = {(): budget * sum(supply.values())}
    for depth in range(3):
        for node in [n for n in shares if len(n) == depth]:
            kids = sorted({p[: depth + 1] for p in supply if p[:depth] == node})
            caps = [epochs * sum(s for p, s in supply.items() if p[: depth + 1] == k) for k in kids]
            own = weights.get(M.LEVELS[depth], {})
            for k, b in zip(kids, fill(shares[node], [(own.get(k[-1], 1.0), c) for k, c in zip(kids, caps)])):
                shares[k] = b
    out = []
    for p, v in leaves.items():
        e, left = 0, shares[p]
        while supply[p] and left > 1e-6:
            at = 0
            for i, n in sorted(v, key=lambda d: (hashlib.md5(f"{seed}|{e}|{'' if d[0] is None else d[0]}".encode()).hexdigest(), d[0] or 0)):
                if at < left - 1e-6:
                    out.append((i, *p, e, at))
                at += n
            left -= supply[p]
            e += 1
    return out


def test_equals_brute_force(spark):
    rows = []
    for i in range(300):
        domain, lang = "ab"[i % 2], ("en", "de", "fr")[i % 3]
        rows.append((i, "w " * (i * 7 % 23 + 1), domain, lang, f"s{(i * i) % 5 if lang == 'en' else i % 2}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, d string, lang string, source string").selectExpr("*", "1 AS tokens", "2 AS epoch").repartition(3)
    for weights, budget, epochs in (({"domain": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.8, "de": 0.2, "fr": 0.0001}}, 0.8, 2.0), ({}, 1.5, 3.0), ({"source": {"s0": 50.0}}, 5.0, 1.5)):
        out = M.select(df, weights, F.col("d"), F.col("lang"), F.col("source"), budget=budget, max_epochs=epochs, seed=11).collect()
        assert sorted((r.id, r.domain, r.lang, r.source, r.epoch, r.start) for r in out) == sorted(slow(rows, weights, budget, epochs, 11))


def test_odd_rows(docs, no_docs):
    out = M.select(docs, {}, F.lit("x"), F.col("lang"), F.col("source"), max_epochs=1.0).collect()
    ids = [r.id for r in out]
    with_words = [i for i, t in TEXTS if t and t.strip()]
    assert set(with_words) <= set(ids) and ids.count(3) == 2 and all(r.epoch == 0 for r in out)
    assert M.select(no_docs, {}, F.lit("x"), F.col("lang"), F.col("source")).count() == 0
