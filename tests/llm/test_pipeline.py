"""Each stage of the pipeline against a brute-force version, on what the stage before has kept."""

import hashlib
import random

import pytest

import corpus_pipeline
from pixelloom.llm import common as C
from pixelloom.llm import queries as Q

from .conftest import DOCS
from .test_mixing import slow as slow_mix
from .test_packing import check as check_packing
from .test_simhash_bands import classes


def tables(rng):
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(90):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(60, 160)))
        bad = i % 6 == 0
        if bad:
            text = "".join(f"{w}{s} " for w, s in zip(text.split(), "### $$$ %%% &&& ***".split() * 99))
        docs.append((i, text, "en" if i % 3 else "fr", f"s{i % 4}"))
        labels.append((i, int(not bad), 0))
    for i in (1, 2, 2, 3):  # copies that differ in white space, and one longer by a space
        docs.append((100 + len(docs), docs[i][1].replace(" ", "\n", 3) + " " * (i == 3), "en", "s1"))
    for i in (4, 5, 7):  # near copies
        w = docs[i][1].split()
        docs.append((200 + i, " ".join([*w[:-1], w[-1] + "q"]), "en", "s0"))
    docs += [(None, docs[8][1], None, None), (8, docs[8][1], "en", "s0"), (300, docs[10][1] + " tail" * 900, "en", "s2")]
    return [(*d, len(d[1])) for d in docs], labels


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs, labels = tables(random.Random(9))
    spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' AS kept", "1 AS row").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mix", "pack"]
    docs = C.read(spark, sf, "documents")
    columns = docs.columns
    rows = lambda df: [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]
    order = lambda v: sorted(v, key=str)

    before = rows(docs)
    docs, _ = C.cut(stages["quality"](spark, docs, sf), "test")
    kept = rows(docs)
    junk = [r for r in before if "###" in r[1]]
    assert docs.columns == columns and order(kept) == order(r for r in before if r not in junk) and len(junk) == 15

    docs, _ = C.cut(stages["exact_dedup"](spark, docs, sf), "test")
    groups = {}
    for r in kept:
        groups.setdefault("".join(r[1].split()), []).append(r)
    kept = rows(docs)
    assert docs.columns == columns and order(kept) == order(min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0])) for g in groups.values())

    docs, _ = C.cut(stages["near_dedup"](spark, docs, sf), "test")
    same = classes([r[1] for r in kept])
    groups = {}
    for k, r in enumerate(kept):
        groups.setdefault(same[k], []).append(r)
    assert len(groups) < len(kept)
    kept = rows(docs)
    assert docs.columns == columns and order(kept) == order(min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values())

    docs, _ = C.cut(stages["mix"](spark, docs, sf), "test")
    leaf = lambda r: ("a" if hashlib.md5((r[3] or "").encode()).hexdigest() < "8" else "b", r[2] or "<null>", r[3] or "<null>")
    want = [w[0] for w in slow_mix([(r[0], r[1], *leaf(r)) for r in kept], Q.MIX, Q.MIX_BUDGET, Q.MIX_EPOCHS, Q.MIX_SEED)]
    kept = rows(docs)
    assert docs.columns == columns and order(r[0] for r in kept) == order(want)

    packed = stages["pack"](spark, docs, sf).withColumnRenamed("doc_id", "id").collect()
    check_packing(packed, [(r[0], r[1]) for r in kept], 2048)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 50


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
