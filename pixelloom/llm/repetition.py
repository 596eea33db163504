"""Quality rules with suffix-array repetition.

The words of a text are its alphabet. Its suffixes are sorted by doubling the
compared prefix, for all texts of a batch at once and only where ties are left;
ranks of each doubling give the common prefix of neighbours in the suffix
array. Runs of neighbours with a common prefix of length l or more are the
intervals whose prefixes are the maximal repeated substrings; their spans,
united, give the covered share of the text's letters. A text is dropped if that
share or the longest repeat is over its limit, or if it fails the base rules.

Scale: one pass without a shuffle. A batch of short texts or one long text is
held at a time, in arrays of a few integers a word for each doubling.

Cases: null and empty texts have no words, counts of zero, and fail the base
rules, like all texts of fewer than min_words words; repeated rows get equal
results; a null id stays null; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MAX_COVERED, MAX_LONGEST = 0.25, 60
SYMBOLS = "#*$%&|<>"
_BATCH_WORDS = 200_000


def suffix_ranks(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts of the texts in the row of all words, the end of each word's text, and the ranks of all suffixes after 1, 2, 4, ... words.

    At each level two suffixes have equal ranks if both are as long as the level and their first words are equal.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    n = int(starts[-1])
    ends = np.repeat(starts[1:], sizes)
    if not n:
        return starts, ends, []
    codes, _ = pd.factorize(np.array([w for t in words for w in t], object))
    key = np.repeat(np.arange(len(words)), sizes) * (int(codes.max()) + 1) + codes  # texts share no rank
    order = np.argsort(key, kind="stable")
    heads = np.r_[True, key[order][1:] != key[order][:-1]]
    at = np.flatnonzero(heads)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(at, np.diff(np.r_[at, n]))
    size = np.diff(np.r_[at, n])
    open_ = order[np.repeat(size > 1, size)]  # suffixes of tied groups, in their order
    levels, k = [rank.copy()], 1
    while len(open_):
        there = open_ + k
        inside = there < ends[open_]
        second = np.where(inside, rank[np.minimum(there, n - 1)] + 1, 0)
        # Suffixes that end here differ from all others of their group, which are longer or shorter.
        key = rank[open_] * (n + 1) + second
        sort = np.argsort(key, kind="stable")
        open_, key = open_[sort], key[sort]
        old = rank[open_]
        heads = np.r_[True, key[1:] != key[:-1]]
        at = np.flatnonzero(heads)
        size = np.diff(np.r_[at, len(key)])
        group = np.r_[True, old[1:] != old[:-1]]
        first = np.repeat(np.flatnonzero(group), np.diff(np.r_[np.flatnonzero(group), len(key)]))
        new = old + np.repeat(at, size) - first
        rank[open_] = new
        levels.append(rank.copy())
        open_ = open_[np.repeat(size > 1, size)]
        k *= 2
    return starts, ends, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The common prefix, in words, of each suffix in the suffix array with the one before it."""
    n = len(order)
    a, b, out = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    live = np.arange(1, n)
    for level in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[ok] = levels[level][a[ok]] == levels[level][b[ok]]
        out[live[same]] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    return out


def repeat_intervals(prefix: np.ndarray, least: int = WINDOW) -> list[tuple[int, int, int, list[int]]]:
    """(length, left, right, own) of each interval left..right-1 of the suffix array whose suffixes have `least` or more words in common.

    own are the places in it that stand in no interval of a longer prefix. Inner intervals come first.
    """
    hits = np.flatnonzero(prefix >= least)
    out: list[tuple[int, int, int, list[int]]] = []
    for run in np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1) if len(hits) else ():
        stack: list[tuple[int, int, list[int]]] = []
        for i, length in enumerate([*prefix[run].tolist(), 0], int(run[0])):
            placed, left = bool(stack) and stack[-1][0] >= length, i - 1
            if placed:
                stack[-1][2].append(i - 1)
            while stack and stack[-1][0] > length:
                l, left, own = stack.pop()
                out.append((l, left, i, own))
            if length and (not stack or stack[-1][0] < length):
                stack.append((length, left, [] if placed else [i - 1]))
    return out


def maximal_repeats(words: list[bytes], least: int = WINDOW) -> list[tuple[int, list[int]]]:
    """(length, starts) of each repeated substring of at least `least` words that no longer one with as many starts extends to the right."""
    _, _, levels = suffix_ranks([words])
    if not levels:
        return []
    order = np.argsort(levels[-1], kind="stable")
    found = repeat_intervals(common_prefixes(order, levels), least)
    return sorted(((l, sorted(order[a:b].tolist())) for l, a, b, _ in found), key=lambda r: (-r[0], r[1]))


def _union(n: int, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def repetition(words: list[list[bytes]], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: words in repeated windows, share of letters in repeats of at least a window, longest repeat in words."""
    starts, ends, levels = suffix_ranks(words)
    none = np.zeros(len(words))
    if len(levels) <= 1:
        return none.astype(np.int64), none, none.astype(np.int64)
    order = np.argsort(levels[-1], kind="stable")
    prefix = common_prefixes(order, levels)
    # Each suffix is in the span of the longest repeat that begins with it.
    repeats = repeat_intervals(prefix, window)
    hits = order[np.array([i for *_, own in repeats for i in own], np.int64)]
    length = np.repeat(np.array([r[0] for r in repeats], np.int64), [len(r[3]) for r in repeats])
    covered = _union(len(order), hits, length)
    letters = np.array([len(w) - sum(1 for c in w if c & 0xC0 == 0x80) if not w.isascii() else len(w) for t in words for w in t], np.int64)
    sums = [np.r_[0, np.cumsum(x)] for x in (covered, letters * covered, letters)]
    per = [s[starts[1:]] - s[starts[:-1]] for s in sums]
    most = np.zeros(len(words), np.int64)
    np.maximum.at(most, np.searchsorted(starts, hits, "right") - 1, length)
    return per[0], per[1] / np.maximum(per[2], 1), most


_OUT = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("covered", pa.float64()), ("longest", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())])
_OUT_SQL = "row long, id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered double, longest long, base_failed boolean, kept boolean"


def assess(texts: list[str | None], window: int = WINDOW, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> list[tuple]:
    """The result columns of each text, after row and id."""
    texts = [t or "" for t in texts]
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    repeats = []
    at = 0
    while at < len(texts):
        end, held = at + 1, len(words[at])
        while end < len(texts) and held + len(words[end]) <= _BATCH_WORDS:
            held += len(words[end])
            end += 1
        repeats += zip(*(x.tolist() for x in repetition(words[at:end], window)))
        at = end
    out = []
    for text, w, (again, covered, longest) in zip(texts, words, repeats):
        lines = [x for x in text.split("\n") if x.strip(C.SPACES)] if "\n" in text else []
        failed = len(w) < min_words or 100 * again > max_repeat_percent * len(w)
        kept = not failed and covered <= max_covered and longest <= max_longest
        out.append((len(w), len(text) - sum(map(text.count, C.SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), again, covered, longest, failed, kept))
    return out


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, **limits) -> DataFrame:
    """One row per row of docs: the base counts, covered, longest, base_failed and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows, ids, texts = (c.to_pylist() for c in batch.slice(at, 512).columns)
                cols = list(zip(*assess(texts, **limits)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([rows, ids, *cols], _OUT)], schema=_OUT)

    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return docs.select(row.cast("long").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _OUT_SQL)
