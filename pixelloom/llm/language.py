"""Language spans of mixed texts: script ranges, then Viterbi over per-word scores.

Every word gets a score for each language: the log-probability of its character
n-grams among the training words of that language. Only
languages whose training letters use the word's script at least now and then
are candidates; a word without letters scores alike for all. A Viterbi pass
finds the labels of all words with the best sum of scores, less a penalty for
each switch; runs of equal labels are the spans. The language of the text is
the one that most of its letters are labelled with.

Scale: training counts n-grams with grouped sums over a bounded sample of about
sample_docs texts a language and keeps top_grams of them, and as many counts of
letters as there are scripts; prediction is one
pass without a shuffle. Words are scored once a batch, and the Viterbi steps
run over all texts of a batch side by side.

Cases: null texts and those without a letter are `und` with score 0; if no
candidate is left for a text's scripts, or two languages have equally many
letters, the first in the alphabet wins; a table without a labelled row yields
`und` everywhere; equal texts get equal results; a null id stays null; other
columns, lang included, are never read for a prediction; an empty table gives
an empty result.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS, TOP_GRAMS, MAX_LANGUAGES = 1000, 20_000, 1000
LONGEST_GRAM, SWITCH = 4, 8.0
_BATCH_CELLS = 400_000

#: First code points of ranges of letters, and their script; "" starts a range of anything else.
RANGES = [
    (0x41, "latin"), (0x250, "latin"), (0x2B0, ""), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x700, "syriac"), (0x750, "arabic"), (0x780, "thaana"), (0x7C0, "nko"), (0x800, ""), (0x8A0, "arabic"), (0x900, "devanagari"), (0x980, "bengali"),
    (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, "oriya"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"), (0xD80, "sinhala"),
    (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"),
    (0x1400, "canadian"), (0x1680, ""), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, ""), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, ""),
    (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C60, "latin"), (0x2C80, "coptic"), (0x2D00, "georgian"), (0x2D30, "tifinagh"), (0x2D80, "ethiopic"),
    (0x2DE0, "cyrillic"), (0x2E00, ""), (0x2E80, "han"), (0x3000, ""), (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"), (0x3190, ""),
    (0x31F0, "kana"), (0x3200, ""), (0x3400, "han"), (0x4DC0, ""), (0x4E00, "han"), (0xA000, "yi"), (0xA4D0, ""), (0xA640, "cyrillic"),
    (0xA6A0, ""), (0xA720, "latin"), (0xA800, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"), (0xFF00, ""), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, ""), (0x20000, "han"),
]
_STARTS = [s for s, _ in RANGES]


def script(letter: str) -> str:
    at = bisect.bisect(_STARTS, ord(letter)) - 1
    return RANGES[at][1] if at >= 0 else ""


def letters_of(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def grams(word: str) -> list[str]:
    """Character n-grams of a word with its ends marked."""
    w = f"^{word}$"
    return [w[i : i + n] for n in range(2, LONGEST_GRAM + 1) for i in range(len(w) - n + 1)]


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _codes(letters: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code of the n letters from each place on."""
    m = len(letters) - n + 1
    out = np.full(max(m, 0), n, np.uint64)
    for k in range(n):
        out = (out ^ letters[k : k + m]) * _FACTOR
        out ^= out >> np.uint64(29)
    return out


class Model:
    """languages in alphabetical order; counts[lang][gram]; scripts[lang][script]: letters."""

    def __init__(self, counts: dict[str, dict[str, int]], scripts: dict[str, dict[str, int]]):
        self.languages = sorted(counts)
        known = sorted({g for c in counts.values() for g in c})
        place = {g: i for i, g in enumerate(known)}
        self.weights = np.zeros((len(known) + 1, len(self.languages)), np.float32)  # the last row is for unknown n-grams
        for k, lang in enumerate(self.languages):
            total = sum(counts[lang].values())
            base = math.log(0.5 / (total + 0.5 * (len(known) + 1)))
            self.weights[:, k] = base
            for g, n in counts[lang].items():
                self.weights[place[g], k] = math.log((n + 0.5) / (total + 0.5 * (len(known) + 1)))
        self.weights -= self.weights.max(1, keepdims=True) if self.languages else 0
        self.weights = np.maximum(self.weights, -6.0)
        codes = np.array([_codes(np.array(list(map(ord, g)), np.uint64), len(g))[0] for g in known], np.uint64)
        self.keys = np.r_[codes, np.uint64(0)]
        self.table = np.full(1 << 20, len(known), np.int32)
        at = codes >> np.uint64(44)
        self.table[at] = np.arange(len(known))
        lost = np.flatnonzero(self.table[at] != np.arange(len(known)))  # codes whose place another one took
        self.rest = {int(codes[i]): int(i) for i in lost}
        self.crowded = np.zeros(1 << 20, bool)
        self.crowded[at[lost]] = True
        names = sorted({s for c in scripts.values() for s in c})
        self.uses = {s: np.array([scripts.get(l, {}).get(s, 0) >= 0.001 * max(1, sum(scripts.get(l, {}).values())) for l in self.languages]) for s in names}

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        at = codes >> np.uint64(44)
        row = self.table[at]
        miss = self.keys[row] != codes
        row[miss] = len(self.keys) - 1
        for i in np.flatnonzero(miss & self.crowded[at]):
            row[i] = self.rest.get(int(codes[i]), len(self.keys) - 1)
        return row

    def score(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word; words hold letters only, or nothing."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        some = [i for i, w in enumerate(words) if w]
        if not some or not self.languages:
            return out
        row = "".join([f"^{words[i]}$" for i in some])
        letters = np.frombuffer(row.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        sizes = np.array([len(words[i]) + 2 for i in some])
        owner = np.repeat(np.arange(len(some)), sizes)
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(letters))  # letters to the word's end
        sums, n_grams = np.zeros((len(some), len(self.languages)), np.float32), np.zeros(len(some))
        for n in range(2, LONGEST_GRAM + 1):
            inside = np.flatnonzero(room >= n)
            if not len(inside):
                continue
            rows, whose = self._rows(_codes(letters, n)[inside]), owner[inside]
            starts = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
            sums[whose[starts]] += np.add.reduceat(self.weights[rows], starts, axis=0)
            n_grams += np.bincount(whose, minlength=len(some))
        out[some] = sums / np.sqrt(n_grams)[:, None]
        for i in some:
            w = words[i]
            if not w.isascii():
                kind = Counter(map(script, w)).most_common(1)[0][0]
                if kind == "latin":
                    continue
            elif "latin" in self.uses and self.uses["latin"].all():
                continue
            else:
                kind = "latin"
            may = self.uses.get(kind)
            out[i] = np.where(may, out[i], -50.0) if may is not None and may.any() else 0.0
        return out


class WordScores:
    """Letters and scores of words, kept by number from one batch to the next."""

    def __init__(self, model: Model, most_kept: int = 300_000):
        self.model, self.most_kept = model, most_kept
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.letters = np.zeros(1024, np.int64)
        self.scores = np.zeros((1024, len(self.model.languages)), np.float32)

    def of(self, words: list[list[str]]) -> list[np.ndarray]:
        """The number of each word of each text."""
        if len(self.number) > self.most_kept:
            self._reset()
        new = set()
        for w in words:
            new.update(w)
        new = list(new.difference(self.number))
        at, end = len(self.number), len(self.number) + len(new)
        if end > len(self.letters):
            size = max(end, 2 * len(self.letters))
            self.letters, self.scores = np.resize(self.letters, size), np.resize(self.scores, (size, self.scores.shape[1]))
        plain = [letters_of(w) for w in new]
        kinds = list(dict.fromkeys(plain))
        place = {w: i for i, w in enumerate(kinds)}
        self.scores[at:end] = self.model.score(kinds)[[place[w] for w in plain]] if new else 0
        self.letters[at:end] = list(map(len, plain))
        self.number.update(zip(new, range(at, end)))
        get = self.number.__getitem__
        return [np.fromiter(map(get, w), np.int64, len(w)) for w in words]


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The best labels of each text: scores[d] has a row for each word and a column for each language."""
    sizes = [len(s) for s in scores]
    out: list[np.ndarray] = [np.zeros(n, np.int32) for n in sizes]
    order = [d for d in sorted(range(len(scores)), key=lambda d: -sizes[d]) if sizes[d]]
    if not order:
        return out
    k, longest = scores[order[0]].shape[1], sizes[order[0]]
    counts = np.searchsorted(-np.array([sizes[d] for d in order]), -np.arange(longest), "left")  # texts that have a word t
    grid = np.zeros((longest, len(order), k), np.float32)
    for j, d in enumerate(order):
        grid[: sizes[d], j] = scores[d]
    stay = np.zeros((longest, len(order), k), bool)
    top = np.zeros((longest, len(order)), np.int32)
    best = grid[0].astype(np.float64)
    for t in range(1, longest):
        n = counts[t]
        now = best[:n]
        at = now.argmax(1)
        jump = now[np.arange(n), at][:, None] - switch
        same = now >= jump
        stay[t, :n], top[t, :n] = same, at
        best[:n] = np.where(same, now, jump) + grid[t, :n]
    label = best.argmax(1)
    labels = np.zeros((longest, len(order)), np.int32)
    for t in range(longest - 1, -1, -1):
        n = counts[t]
        labels[t, :n] = label[:n]
        if t:
            label[:n] = np.where(stay[t, np.arange(n), label[:n]], label[:n], top[t, :n])
    for j, d in enumerate(order):
        out[d] = labels[: sizes[d], j]
    return out


def label(texts: list[str | None], model: Model, switch: float = SWITCH, known: WordScores | None = None) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Of each text: language, score, and spans (first word, end, language)."""
    known = known or WordScores(model)
    words = [(t or "").split() for t in texts]
    numbers = known.of(words)
    letters = [known.letters[n] for n in numbers]
    scores = [known.scores[n] for n in numbers]
    k = len(model.languages)
    labels: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
    todo = sorted(range(len(texts)), key=lambda d: -len(words[d])) if k else []
    while todo:
        n = max(1, 4 * _BATCH_CELLS // max(1, k * len(words[todo[0]])))
        part, todo = todo[:n], todo[n:]
        for d, x in zip(part, viterbi([scores[d] for d in part], switch)):
            labels[d] = x
    out = []
    for d, ws in enumerate(words):
        total = int(letters[d].sum())
        if not total or not k:
            out.append(("und", 0.0, []))
            continue
        share = np.bincount(labels[d], weights=letters[d], minlength=k)
        at = int(share.argmax())
        edges = np.r_[0, np.flatnonzero(np.diff(labels[d])) + 1, len(ws)]
        spans = [(int(a), int(b), model.languages[labels[d][a]]) for a, b in zip(edges, edges[1:])]
        out.append((model.languages[at], float(share[at] / total), spans))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, top_grams: int = TOP_GRAMS, max_languages: int = MAX_LANGUAGES) -> Model:
    """A model from about sample_docs different labelled texts a language, chosen by a hash, for the max_languages commonest languages."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    share = spark.createDataFrame([(r["lang"], min(1.0, sample_docs / r["n"])) for r in counts], "lang string, share double")  # max_languages rows
    # A share of the range of a hash, so no text moves to be chosen; equal rows are chosen together, and then count as one.
    key = F.xxhash64("id", "text")
    chosen = rows.withColumn("key", key).join(F.broadcast(share), "lang").where(F.pmod("key", F.lit(1 << 40)) < F.col("share") * (1 << 40))
    sample = chosen.groupBy("lang", "id", "key").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], int] = Counter()
            per: dict[str, Counter] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                per.setdefault(lang, Counter()).update(text.split())
            for lang, words in per.items():
                for w, n in words.items():
                    w = letters_of(w)
                    for g in grams(w) if w else ():
                        found[lang, g] += n
                    for c in w:
                        found[lang, "#" + script(c)] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "gram", "n"])

    counts = sample.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Counts of scripts, whose names begin with a number sign, aren't n-grams and are all kept.
    place = F.row_number().over(Window.partitionBy("lang", F.col("gram").startswith("#")).orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("at", place).where((F.col("at") <= top_grams) | F.col("gram").startswith("#"))
    got, scripts = {}, {}
    for lang, gram, n in best.select("lang", "gram", "n").collect():
        (scripts if gram.startswith("#") else got).setdefault(lang, {})[gram[1:] if gram.startswith("#") else gram] = n
    return Model({k: got.get(k, {}) for k in {*got, *scripts}}, scripts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """One row per row of docs: id, lang_pred, score, spans (first word, end, lang)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordScores(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, texts = (c for c in batch.slice(at, 512).columns)
                out = label(texts.to_pylist(), sent.value, switch, known)
                spans = [[{"start": a, "end": b, "lang": l} for a, b, l in o[2]] for o in out]
                yield pa.RecordBatch.from_arrays([ids, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))], names=["id", "lang_pred", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>")
