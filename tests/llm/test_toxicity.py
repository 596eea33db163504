import random
import re

import numpy as np

from pixelloom.llm import toxicity as X


def corpus(rng, n, first=0):
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    docs, labels = [], []
    for i in range(first, first + n):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(rng.randrange(2, 9))]
        bad = i % 4 == 0
        if bad:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(["zzuugh", "zzuuxx", "qqwert"])
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_and_spans(spark):
    rng = random.Random(4)
    docs, labels = corpus(rng, 320)
    train_docs = spark.createDataFrame(docs, "doc_id long, text string")
    train_labels = spark.createDataFrame(labels + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    model = X.train(train_docs, train_labels)
    fresh, truth = corpus(rng, 200, 1000)
    odd = [(1, None), (2, ""), (3, "zzuugh"), (None, "ok. zzuuyy here! fine"), (5, "a" * 100_000), (6, "mail x.qqwert@a.b")]
    df = spark.createDataFrame(fresh + odd, "doc_id long, text string").selectExpr("*", "'x' AS score", "0 AS id", "1 AS predicted")
    out = {r.id: r for r in X.score(df, model).collect()}
    wrong = sum(out[i].predicted != y for i, y in truth)
    assert wrong <= 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    assert out[1].score == out[2].score == 0 and out[3].predicted == 1
    text = "ok. zzuuyy here! fine"
    assert [text[s.start : s.end].strip() for s in out[None].offending] == ["zzuuyy here!"]


def test_noisy_or():
    m = X.Model({"=bad": 0.0}, 0.0)
    p, spans = m.score("bad. good. bad!", {})
    assert abs(p - 0.75) < 1e-12 and len(spans) == 2


def test_one_class_only(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    model = X.train(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    assert [r.score for r in X.score(docs, model).collect()] == [0, 0]
    assert X.score(docs.limit(0), model).count() == 0


def slow_score(text, weights, bias):
    """The noisy-or, sentence by sentence and letter by letter."""
    none, spans, at = 1.0, [], 0
    for part in re.findall(r"[^.!?\n]+|[.!?\n]", text or ""):
        known = set()
        for word in part.split():
            w = "".join(c for c in word if c.isalpha()).lower()
            known |= {f"={w}", *(f"^{w[:k]}" for k in (4, 5, 6) if len(w) >= k)} & weights.keys()
        if known:
            p = 1 / (1 + np.exp(-(bias + sum(weights[f] for f in known))))
            none *= 1 - p
            spans.append((text[at : at + len(part)].strip(), p))
        at += len(part)
    return 1 - none, spans


def test_scores_equal_brute_force():
    rng = random.Random(11)
    words = ["bad", "badly", "Worse!", "worst", "fine", "a.b", "x-y", "ÉTÉ", "12", "wor5se", "ok?", "no\n", "..."]
    m = X.Model({"=bad": 1.5, "^badl": 0.7, "^wors": 0.9, "=été": 2.0, "=ok": 0.1, "=b": 0.4}, -1.2)
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))
        p, spans = m.score(text, {})
        want, parts = slow_score(text, m.weights, m.bias)
        assert abs(p - want) < 1e-12 and [(text[a:b].strip(".!? \n"), round(q, 9)) for a, b, q in spans] == [(t, round(float(q), 9)) for t, q in parts], text


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    bags = X.Bags([(int(rng.random() < 0.4), [sorted(rng.choice(6, rng.integers(1, 4), replace=False).tolist()) for _ in range(rng.integers(0, 4))]) for _ in range(40)])
    x, weight = rng.normal(0, 1, 7), rng.random(40) + 0.5
    plain = 0.0
    for b in range(40):
        none = np.prod([1 - 1 / (1 + np.exp(-(x[-1] + sum(x[f] for f in bags.feature[bags.which == i])))) for i in np.flatnonzero(bags.bag == b)])
        plain -= weight[b] * np.log(max(1 - none, 1e-6) if bags.label[b] else none) / 40
    value, grad = bags.loss(x, weight, 0.01)
    assert abs(value - plain - 0.005 * (x[:-1] ** 2).sum()) < 1e-9
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        assert abs((bags.loss(x + step, weight, 0.01)[0] - bags.loss(x - step, weight, 0.01)[0]) / 2e-6 - grad[k]) < 1e-5


def test_one_text_of_an_id_trains(spark):
    docs = spark.createDataFrame([(1, f"hot zzuugh {i}") for i in range(500)] + [(k, "quite plain words") for k in range(2, 9)] + [(k, "zzuugh again") for k in range(10, 16)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k in (1, *range(10, 16)))) for k in range(1, 16)], "doc_id long, toxic int")
    a, b = X.train(docs, labels), X.train(docs.repartition(3), labels)
    assert a.weights == b.weights and "=zzuugh" in a.weights
