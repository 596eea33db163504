import itertools
import random

import numpy as np

from pixelloom.llm import language as G


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    texts = [rng.normal(0, 3, (n, 3)).astype(np.float32) for n in (1, 4, 6, 0, 5, 6)]
    for scores, got in zip(texts, G.viterbi(texts, 2.0)):
        n = len(scores)
        best = max((sum(float(scores[t][p[t]]) for t in range(n)) - 2.0 * sum(a != b for a, b in zip(p, p[1:])) for p in itertools.product(range(3), repeat=n)), default=0.0)
        value = sum(float(scores[t][got[t]]) for t in range(n)) - 2.0 * sum(a != b for a, b in zip(got, got[1:]))
        assert len(got) == n and abs(best - value) < 1e-4


def test_scores_equal_the_plain_sum():
    counts = {"aa": {"^h": 5, "he": 3, "el": 2, "hel": 4, "lo$": 1}, "bb": {"he": 1, "^ö": 9, "ö$": 4, "^hel": 2}}
    m = G.Model(counts, {"aa": {"latin": 10}, "bb": {"latin": 10}})
    known = sorted({g for c in counts.values() for g in c})
    for w in ("hello", "ö", "x", "日本"):
        rows = [m.weights[known.index(g) if g in known else len(known)] for g in G.grams(w)]
        want = np.sum(rows, 0) / np.sqrt(len(rows)) if w != "日本" else 0
        assert np.allclose(m.score([w])[0], want, atol=1e-5)
    assert m.score([""])[0].tolist() == [0, 0]


ALPHABETS = {"ga": "aeioulmn", "gb": "bcdfgkpt", "cy": "абвгдежз"}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randrange(3, 8))) for _ in range(n))


def test_held_out_and_spans(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, lang, 30), lang) for i, lang in enumerate(list(ALPHABETS) * 15)] + [(90, "skip me", None), (91, None, "ga"), (92, "", "gb")]
    model = G.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(ALPHABETS)
    test = [(i, sentence(rng, lang, 20)) for i, lang in enumerate(list(ALPHABETS) * 5)]
    mixed = sentence(rng, "ga", 30) + " " + sentence(rng, "gb", 12)
    odd = [(100, None), (101, ""), (102, " 12 !? 3\n"), (None, mixed), (104, "日本 語"), (105, "x" * 50_000), (105, "x" * 50_000)]
    df = spark.createDataFrame(test + odd, "doc_id long, text string").selectExpr("*", "'zz' AS lang", "1 AS score", "2 AS id")
    out = G.predict(df, model).collect()
    got = {r.id: r for r in out}
    assert len(out) == len(test) + len(odd) and all(0 <= r.score <= 1 for r in out)
    assert all(got[i].lang_pred == list(ALPHABETS)[i % 3] for i, _ in test)
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[104].lang_pred in ALPHABETS
    spans = got[None].spans
    assert got[None].lang_pred == "ga" and [(s.lang) for s in spans] == ["ga", "gb"] and abs(spans[0].end - 30) <= 1


def test_words_without_letters(spark):
    model = G.Model({"aa": {"^h": 5}, "bb": {"^k": 5}}, {"aa": {"latin": 9}, "bb": {"latin": 9}})
    for text in ("½ ² 12", "## $ 5#", "_ - 1", "①", ""):
        assert G.label([text], model)[0] == ("und", 0.0, [])
    assert G.label(["#h5 h"], model)[0][0] == "aa"


def test_more_languages_than_a_byte_holds(spark):
    rng = random.Random(7)
    langs = [f"l{k:03d}" for k in range(150)]
    words = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for x in langs}
    rows = [(i, " ".join(rng.choices(words[x], k=20)), x) for i, x in enumerate(langs * 3)]
    model = G.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = spark.createDataFrame([(i, " ".join(rng.choices(words[x], k=15))) for i, x in enumerate(langs)], "doc_id long, text string")
    got = {r.id: r.lang_pred for r in G.predict(test, model).collect()}
    assert model.languages == langs and [got[i] for i in range(150)] == langs


def test_the_sample_is_bounded_when_ids_repeat(spark):
    rng = random.Random(8)
    rows = [(5, "hot row of one id", "ga")] * 400 + [(5, sentence(rng, "ga", 5) + f" n{i}", "ga") for i in range(400)] + [(i, sentence(rng, "gb", 8), "gb") for i in range(300)]
    found = G.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), sample_docs=40, top_grams=50)
    again = G.train(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string").repartition(2), sample_docs=40, top_grams=50)
    assert found.languages == ["ga", "gb"] and (found.weights == again.weights).all()


def test_no_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = G.train(empty)
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert G.predict(df, model).first().lang_pred == "und" and G.predict(empty, model).count() == 0
