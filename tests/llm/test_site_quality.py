import numpy as np
from pyspark.sql import functions as F

from pixelloom.llm import site_quality as S


def test_fit_separates():
    rng = np.random.default_rng(0)
    x = np.c_[np.ones(200), rng.normal(0, 1, (200, 2))]
    y = (x[:, 1] > 0).astype(float)
    assert ((x @ S.fit(x, y) > 0) == (y == 1)).mean() > 0.95
    assert not S.fit(x, np.ones(200)).any()


def strength(groups):
    """Documents that the level above counts for: the variance within groups over that between them (analysis of variance)."""
    groups = [np.array(g) for g in groups]
    n, k = sum(map(len, groups)), len(groups)
    mu = np.concatenate(groups).mean()
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (n - k)
    spread = sum(len(g) * (g.mean() - mu) ** 2 for g in groups) / (k - 1)
    between = max(0.0, (spread - within) * (k - 1) / (n - sum(len(g) ** 2 for g in groups) / n))
    return min(10000.0, max(1.0, within / max(between, 1e-9)))


def test_shape():
    text = "Ab CDE ab ab | $5!\nx\nx\n\n"
    words = ["Ab", "CDE", "ab", "ab", "|", "$5!", "x", "x"]
    want = [1, np.log1p(8) / 5, 1, sum(map(len, words)) / 8 / 10, 1 / 8, 1 / 8, 1 / 8, 1 / 8, 2 / 8, 6 / 8, 1 - 2 / 3, 1 / len(text)]
    assert np.allclose(S.shape(text), want) and S.shape(None) == S.shape(" \n") == [1.0] + [0.0] * 11


def test_sites_move_doubtful_texts(spark):
    """Of equally doubtful texts those of good sites stay; a site of a single text stays near the whole."""
    rng = np.random.default_rng(3)
    x = {"good": 2.0, "bad": -2.0}
    rows, w = [], np.zeros(12)
    w[0], w[4] = 2.0, -12.0  # by the share of signs alone
    for host in x:
        for i in range(200):
            signs = max(0, int(rng.normal(1 if host == "good" else 8, 1)))
            rows.append((len(rows), " ".join(["#"] * signs + [f"w{k}" for k in range(30 - signs)]), host, "p"))
    doubtful = " ".join(["#"] * 5 + [f"w{k}" for k in range(25)])
    rows += [(1000, doubtful, "good", "p"), (1001, doubtful, "bad", "p"), (1002, doubtful, "lone", "p")]
    out = {r.id: r for r in S.classify(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), w, F.col("source"), F.col("lang")).collect()}
    assert out[1000].evidence == out[1001].evidence and out[1000].kept and not out[1001].kept
    assert abs(out[1002].posterior - out[1002].evidence) < abs(out[1001].posterior - out[1001].evidence) / 3


def test_one_text_of_an_id_trains(spark):
    docs = spark.createDataFrame([(1, f"hot {i} ###") for i in range(500)] + [(2, "plain words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1)], "doc_id long, quality int")
    a, b = S.train(docs, labels), S.train(docs.repartition(3), labels)
    assert np.array_equal(a, b) and a.any()


def test_posteriors_equal_plain_sums(spark):
    junk, good = "### $$$ %%% " * 10, "plain words of quite an ordinary text that goes on for some time without any odd sign in it at all"
    rows = [(i, junk if i % 5 < 2 else good, f"h{i % 3}" if i % 7 else None, "en" if i % 2 else None) for i in range(60)]
    rows += [(None, None, "h0", "en"), (100, "", "h9", "en"), (100, "", "h9", "en"), (101, good * 2000, "h1", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "'x' AS host", "1 AS p", "2 AS kept")
    labels = spark.createDataFrame([(i, int(i % 5 >= 2)) for i in range(0, 60, 2)] + [(1, None)], "doc_id long, quality int")
    w = S.train(docs, labels)
    out = S.classify(docs, w, F.col("source"), F.col("lang")).collect()
    assert len(out) == len(rows)
    assert all(r.kept == (r.id % 5 >= 2) for r in out if r.id is not None and r.id < 60)
    # Path means by hand.
    ev = S.evidence(docs, w, F.col("source"), F.col("lang"), row_col=None).collect()
    p = {}
    for r in ev:
        p.setdefault((r.host, r.path), []).append(r.p)
    hosts = {}
    for (h, _), v in p.items():
        hosts.setdefault(h, []).extend(v)
    kh, kp = strength(hosts.values()), strength(p.values())
    every = [x for v in hosts.values() for x in v]
    mu = (sum(every) + 1) / (len(every) + 2)
    key = {r.row: (r.host, r.path, r.p) for r in ev}
    for r in out:
        h, path, own = key[r.row]
        host_mean = (sum(hosts[h]) + kh * mu) / (len(hosts[h]) + kh)
        v = p[h, path]
        assert abs(r.host_mean - host_mean) < 1e-9 and abs(r.path_mean - (sum(v) - own + kp * host_mean) / (len(v) - 1 + kp)) < 1e-9
        logit = lambda q: np.log(max(q, 1e-6) / max(1 - q, 1e-6))
        shift = logit(r.path_mean) - np.log(mu / (1 - mu))
        assert abs(r.posterior - 1 / (1 + np.exp(-(logit(r.evidence) + shift)))) < 1e-9


def test_no_labels_and_empty_table(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    w = S.train(no_docs, labels)
    assert not np.any(w) and S.classify(no_docs, w, F.col("source"), F.col("lang")).count() == 0
