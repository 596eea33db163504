import random

import numpy as np
import pytest
import xxhash

from pixelloom.llm import simhash
from pixelloom.llm.components import components

from .conftest import TEXTS


def slow_fingerprint(text, shingle=3):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in text.encode().split()]
    grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_classes(items, most=3):
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i][1] ^ items[j][1]).count("1") <= most:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(items)):
        groups.setdefault(find(i), []).append(items[i][0])
    return {i: min((x for x in g if x is not None), default=None) for i, g in ((find(k), groups[find(k)]) for k in range(len(items)))}, find


def test_texts(docs):
    out = simhash.classes(docs).collect()
    items = [(i, slow_fingerprint(t)) for i, t in TEXTS]
    names, find = slow_classes(items)
    want = sorted(((i or -1, f, names[find(k)]) for k, (i, f) in enumerate(items)), key=str)
    assert sorted(((r.id or -1, r.fp % 2**64, r.component_id) for r in out), key=str) == want
    assert sum(r.kept for r in out) == len(set(find(k) for k in range(len(items))))


@pytest.mark.parametrize("segments, most", [(64, 3), (32, 3), (16, 3), (32, 2), (16, 2), (32, 5)])
def test_links_equal_brute_force(spark, segments, most):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    hot = rng.getrandbits(64)
    for _ in range(200):
        f = rng.choice([hot, *list(fps)[:20]])
        for b in rng.sample(range(64), rng.randrange(1, 7)):
            f ^= 1 << b
        fps.add(f)
    for _ in range(60):
        fps.add(hot ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long").repartition(4)
    links = simhash.near_links(frame, segments, most)
    pairs = links.collect()
    assert all(bin((a ^ b) % 2**64).count("1") <= most for a, b in pairs)
    roots = {r.node % 2**64: r.root for r in components(links).collect()}
    _, find = slow_classes([(0, f) for f in fps], most)
    slow, fast = {}, {}
    for k, f in enumerate(fps):
        slow.setdefault(find(k), set()).add(f)
        fast.setdefault(roots.get(f, f"alone{f}"), set()).add(f)
    assert sorted(map(sorted, slow.values())) == sorted(map(sorted, fast.values()))


def test_long_chain(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000)], "a long, b long")
    out = components(links).collect()
    assert len(out) == n + 1 and len({r.root for r in out}) == 1


def test_empty_table(no_docs):
    assert simhash.classes(no_docs).count() == 0


def test_odd_links(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (5, None), (None, None)], "a long, b long").selectExpr("*", "9 AS node", "8 AS root")
    assert sorted((r.node, r.root) for r in components(links).collect()) == [(1, 1), (2, 1)]
    assert components(links.limit(0)).count() == 0
