import random
import re
from collections import Counter

from pixelloom.llm import repetition as R

from .conftest import TEXTS


def slow(words, k=8):
    """Marked words of repeated k-word windows, and the longest repeat of at least k words."""
    n = len(words)
    seen = Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
    mark = [False] * n
    for i in range(n - k + 1):
        if seen[tuple(words[i : i + k])] > 1:
            mark[i : i + k] = [True] * k
    most = 0
    for i in range(n):
        for j in range(i + 1, n):
            m = 0
            while j + m < n and words[i + m] == words[j + m]:
                m += 1
            most = max(most, m)
    return mark, most if most >= k else 0


def test_repetition_equals_brute_force():
    rng = random.Random(0)
    texts = [[bytes([97 + rng.randrange(a)]) * rng.randrange(1, 3) for _ in range(rng.randrange(0, 60))] for a in (1, 2, 3, 5) * 12]
    texts.append(["é".encode(), b"x"] * 12)
    for words, got in zip(texts, zip(*R.repetition(texts))):
        mark, most = slow(words)
        letters = [len(w.decode()) for w in words]
        covered = sum(n for n, m in zip(letters, mark) if m) / max(1, sum(letters))
        assert (got[0], got[2]) == (sum(mark), most) and abs(got[1] - covered) < 1e-12


def test_maximal_repeats():
    words = [x.encode() for x in "a b c d e a b c x b c".split()]
    found = {(" ".join(w.decode() for w in words[s[0] : s[0] + n]), tuple(s)) for n, s in R.maximal_repeats(words, 2)}
    assert found == {("a b c", (0, 5)), ("b c", (1, 6, 9))}
    assert R.maximal_repeats([], 2) == [] and R.maximal_repeats([b"a"] * 3, 2) == [(2, [0, 1])]


def test_base_counts(docs):
    got = {(r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in R.rules(docs).collect()}
    want = set()
    for i, t in [*TEXTS]:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        mark = set()
        for k in range(len(words) - 7):
            if windows[tuple(words[k : k + 8])] > 1:
                mark |= set(range(k, k + 8))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.add((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(mark), len(words) < 20 or 100 * len(mark) > 30 * len(words)))
    assert got == want


def test_verdict():
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    once, part = prose(400), prose(50)
    long = prose(70)
    out = R.assess([once, once + " " + part + " " + prose(600) + " " + part, long + " " + prose(900) + " " + long, "#$%\na\na\n\n \na", None])
    assert [o[-1] for o in out] == [True, True, False, False, False]
    assert out[3][:4] == (4, 6, 3, 2)


def test_empty_table(no_docs):
    assert R.rules(no_docs).count() == 0
