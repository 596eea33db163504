import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pixelloom.llm import packing
from pixelloom.llm.tokens import tokenizer

from .conftest import TEXTS


def library():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def test_ids_equal_the_library():
    rng = random.Random(3)
    parts = ["the", "The", "don't", "we'll", "ÉTÉ", "straße", "İstanbul", "x́y", "ŉ", "№5", "a b", "a\x1cb", "a\x0bb", "3.14", "<|endoftext|>", "</w>", "日本語", "🙂", "foo_bar", "ﬁne", "Σίσυφος", "...", "'s", "a'S", "ſ", "\x00", "€uro"]
    for _ in range(200):
        parts.append("".join(rng.choice("abcdefghinorstuéèêçäöüßñíó.,!'#%|") for _ in range(rng.randrange(1, 25))))
    texts = [rng.choice(["", " ", "\n"]) + "".join(rng.choice(parts) + rng.choice([" ", "  ", "\n", "\t", ""]) for _ in range(rng.randrange(30))) for _ in range(300)]
    slow = library()
    for t, raw in zip(texts, tokenizer(packing.TOKENIZER).ids(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == slow.encode(t, add_special_tokens=False).ids, t


def check(rows, texts, most, max_docs=None, max_cost=None):
    slow, want = library(), []
    for i, t in texts:
        ids = slow.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), most)):
            part = ids[s : s + most]
            want.append((i, k, s, len(part), crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= most and len(b) <= (max_docs or most)
        assert sum(n * n for _, n in b) <= (max_cost or most**2) or len(b) == 1
    return len(bins), sum(w[3] for w in want)


def test_whole_documents(docs):
    for most, max_docs, max_cost in ((2048, None, None), (64, None, None), (64, 3, None), (64, None, 700), (64, 3, 700)):
        rows = packing.pack(docs, max_tokens=most, max_docs=max_docs, max_cost=max_cost).collect()
        check(rows, TEXTS, most, max_docs, max_cost)


def test_few_sequences():
    rng = random.Random(1)
    for rule in ("norm", "dot"):
        counts = defaultdict(int)
        for _ in range(20000):
            counts[min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1)] += 1
        ranges = packing.plan(counts, rule=rule)
        used = defaultdict(int)
        placed = defaultdict(int)
        for length, rank, each, first, offset in ranges:
            assert rank == placed[length]
            later = [r for n, r, *_ in ranges if n == length and r > rank]
            n = (min(later) if later else counts[length]) - rank
            placed[length] += n
            for k in range(n):
                s = first + k // each
                assert used[s] == offset + k % each * length
                used[s] += length
        assert placed == counts and max(used.values()) <= 2048
        assert len(used) <= 1.01 * sum(n * c for n, c in counts.items()) / 2048 + 1


def test_empty_table(no_docs):
    assert packing.pack(no_docs).count() == 0
