"""Main text of HTML pages as the maximum-scoring run of words and tags.

A page is a row of tokens. A word scores above zero, the more the likelier its
place is content, and a tag scores below zero, the more the likelier it isn't;
the main text is the contiguous run of the largest sum, found by one linear
scan. Both chances are logistic and learned from pages that label themselves:
what their only <article> or <main> holds is content, the rest isn't. A word's
place is told by its block (length, share of links, last sign, tag, length of
the blocks around) and by the names of the elements around it, a tag's by the
tag and these names; one that breaks no line costs what half a word gains. Each labelled page
is learned from three times: as it is, without its names, and without names and
tags, so that pages of other templates are read by what is left. Well-known names start with the counts of a few words,
which a few pages overrule. Of names around a word the worst decides, unless its
element wraps the whole page. Elements that score below zero as a whole (menus,
adverts, forms, comments) are left out of the run, so that the run can pass over
those around it at a bounded cost.

Scale: scores come from a bounded sample of pages (2 * sample_pages) and from
its top_names commonest names, counted where the pages are; extraction is one
pass without a shuffle, a page at a time. Reading a page takes time and memory
in proportion to its length, however broken or nested it is.

Cases: null and empty html, pages without a word, and pages whose best run has
only words that are named something else give empty text; of runs with equal sums that which ends first wins, then the shortest; unclosed and
stray tags are tolerated, and what looks like a tag but never ends is text;
equal rows get equal results; a null id or url stays null; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as H
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES, TOP_NAMES = 2000, 4000
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TAG = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_QUOTE = re.compile(r"=\s*([\"'])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_BLOCK_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements without words for the reader: the first run to the end of the page if they aren't closed, the others are skipped only if they are.
_RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
_HIDDEN = frozenset("canvas math noscript object select svg template".split())
#: Tags that are told apart; any other counts as "div".
_KNOWN = frozenset("a article aside b blockquote br dd dl dt em figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr i img li main nav ol p pre section span strong table td th tr ul".split())
#: Elements that say what they hold, beside the names in class, id and role.
_SECTIONS = frozenset("article aside button dialog footer form head header main nav".split())
#: Names that mean content, and names that mean something else, on any site.
CONTENT = "article main content post entry story body text".split()
OTHER = frozenset("nav navigation navbar menu menubar header masthead footer foot sidebar aside complementary contentinfo banner ad ads advert adverts advertisement sponsor sponsored promo promotion notice cookie consent alert popup modal dialog form search subscribe newsletter signup login button comment comments reply replies respond disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager widget toolbar copyright legal head tags skip".split())
#: Words that a well-known name counts for before any page is read.
_PRIOR = 10
_MOST = 4.0
#: An element with at least this share of a page's words is the page, and its bad names don't count.
_WRAPS, _NEVER_WRAPS = 0.95, frozenset("aside button dialog footer nav".split())
#: What leaving out an element costs a run at most.
_SKIP, _TINY = 1.0, 1e-9
#: How sharply scores turn from nothing to the log-odds; 1 would be -log(1 - p) and log(p).
_SHARP = 2.0


class Page:
    """The tokens of a page, and the elements they stand in.

    tokens: (kind, value, element), kind "text", "open", "close", or "alone" for
    a tag that opens and closes nothing; value is a text, or the tag. Of element e, parent[e] is the one around it, tag[e] its
    tag, names[e] what it calls itself, span[e] its first token and the one
    after its last, and words[e] its words.
    """

    def __init__(self, page: str):
        self.tokens: list[tuple[str, str, int]] = []
        self.parent, self.tag, self.names, self.span, self.words = [-1], [""], [frozenset()], [[0, 0]], [0]
        self._read(page)
        for e in range(len(self.parent) - 1, 0, -1):
            self.words[self.parent[e]] += self.words[e]

    def _read(self, page: str) -> None:
        found: dict[str, tuple[int, int]] = {}

        def find(what: str, at: int) -> int:
            """The first place of what from at on, or -1; places only grow, so the page is passed once for each what."""
            asked, place = found.get(what, (-1, -2))
            if asked <= at and (place == -1 or place >= at):
                return place
            place = page.find(what, at)
            found[what] = (at, place)
            return place

        def closer(tag: str, at: int) -> int:
            key = "</" + tag
            asked, place = found.get(key, (-1, -2))
            if asked <= at and (place == -1 or place >= at):
                return place
            m = re.compile(key + r"(?![a-z0-9:-])", re.I | re.A).search(page, at)
            place = m.start() if m else -1
            found[key] = (at, place)
            return place

        block = ["div"]  # the innermost element that isn't inline, of each open element
        stack, open_ = [0], Counter()
        at = text = 0
        size = len(page)

        def pop() -> None:
            e = stack.pop()
            block.pop()
            open_[self.tag[e]] -= 1
            self.span[e][1] = len(self.tokens)

        def flush(to: int) -> None:
            if to > text:
                value = page[text:to]
                self.tokens.append(("text", value, stack[-1]))
                self.words[stack[-1]] += len(value.split())

        while True:
            at = page.find("<", at)
            if at < 0:
                flush(size)
                break
            if page.startswith("<!--", at):
                flush(at)
                ends = [x + n for x, n in ((find("-->", at + 4), 3), (find("--!>", at + 4), 4)) if x >= 0]
                at = text = min(ends) if ends else size
                continue
            if page.startswith(("<!", "<?"), at):
                flush(at)
                to = find(">", at)
                at = text = to + 1 if to >= 0 else size
                continue
            ending = page.startswith("/", at + 1)
            m = _TAG.match(page, at + 1 + ending)
            to = find(">", at) if m else -1
            if to < 0:  # no tag
                at += 1
                continue
            flush(at)
            tag, inner = m[0].lower(), m.end()
            look, first = inner, to
            while q := _QUOTE.search(page, look, to):  # a quoted value may hold the sign that ends a tag
                end = find(q[1], q.end())
                later = find(">", end) if end >= to else to
                if end < 0 or later < 0:
                    to = first
                    break
                look, to = end + 1, later
            attributes = page[inner:to]
            at = text = to + 1
            if ending:
                if open_[tag]:
                    while self.tag[stack[-1]] != tag:
                        pop()
                    e = stack[-1]
                    self.tokens.append(("close", tag, e))
                    pop()
                else:
                    self.tokens.append(("alone", tag, stack[-1]))
                continue
            if (tag in _RAW or tag in _HIDDEN) and not (tag in _HIDDEN and attributes.endswith("/")):
                end = closer(tag, at)
                if end >= 0:
                    to = find(">", end)
                    at = text = to + 1 if to >= 0 else size
                elif tag in _RAW:
                    at = text = size
                continue
            if tag == "body":
                while len(stack) > 1:
                    pop()
            if tag in _BLOCK_ENDS_P and block[-1] == "p":  # such a tag ends an open paragraph, and inline elements left open in it
                while self.tag[stack[-1]] != "p":
                    pop()
                pop()
            if tag == "li" and block[-1] == "li":
                while self.tag[stack[-1]] != "li":
                    pop()
                pop()
            if tag in _VOID:
                self.tokens.append(("alone", tag, stack[-1]))
                continue
            e = len(self.parent)
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.names.append(_names(tag, attributes))
            self.span.append([len(self.tokens), 0])
            self.words.append(0)
            self.tokens.append(("open", tag, e))
            if attributes.endswith("/") and tag not in _KNOWN:
                self.span[e][1] = len(self.tokens)
                continue
            block.append(block[-1] if tag in _INLINE else tag)
            stack.append(e)
            open_[tag] += 1
        while len(stack) > 1:
            pop()
        self.span[0][1] = len(self.tokens)


def _names(tag: str, attributes: str) -> frozenset[str]:
    """What an element calls itself: its tag if that says so, and the words of class, id and role."""
    out = {tag} & _SECTIONS
    for _, value in _NAMES.findall(attributes) if "=" in attributes else ():
        for x in H.unescape(value.strip("\"'")).replace("_", " ").replace("-", " ").split():
            out.update(p.lower() for p in _PART.findall(x))
    return frozenset(out) if tag not in ("html", "body") else frozenset()


def _bucket(words: int) -> int:
    return min(6, max(0, words).bit_length())


def blocks(page: Page) -> tuple[list[int], list[tuple[int, int, int, int, str]]]:
    """The block of each token, and of each block: length, share of links, last sign, length of its longest neighbour (all in steps), and tag.

    A block is a row of tokens without a tag that breaks lines.
    """
    linked, breaks = [False], [""]
    for e in range(1, len(page.parent)):
        tag, up = page.tag[e], page.parent[e]
        linked.append(tag == "a" or linked[up])
        breaks.append(breaks[up] if tag in _INLINE else tag if tag in _KNOWN else "div")
    of, words, links, last, tags = [], [0], [0], [""], ["div"]
    for kind, value, e in page.tokens:
        if kind == "text":
            n = len(value.split())
            if n:
                words[-1] += n
                links[-1] += n * linked[e]
                last[-1], tags[-1] = value.rstrip()[-1], breaks[e] or "div"
        elif value not in _INLINE and words[-1]:
            words.append(0)
            links.append(0)
            last.append("")
            tags.append("div")
        of.append(len(words) - 1)
    out = []
    for b, n in enumerate(words):
        near = max(words[b - 1] if b else 0, words[b + 1] if b + 1 < len(words) else 0)
        share = links[b] / n if n else 0
        out.append((_bucket(n), (share > 0) + (share > 0.5), int(last[b] in ".!?…:;»”\""), min(2, near // 8), tags[b]))
    return of, out


def name_scores(page: Page, odds: dict[str, float]) -> list[float]:
    """Of each element: what the names around its words say, from -4 (something else) to 4 (content)."""
    worst, best, out = [0.0], [0.0], [0.0]
    whole = page.words[0]
    for e in range(1, len(page.parent)):
        own, up = [odds.get(n, 0.0) for n in page.names[e]], page.parent[e]
        low, high = worst[up], best[up]
        if own:
            high = max(high, *own)
            if page.words[e] < _WRAPS * whole or page.tag[e] in _NEVER_WRAPS:
                low = min(low, *own)
        worst.append(low)
        best.append(high)
        value = low if low < -1 else high
        out.append(round(2 * max(-_MOST, min(_MOST, value))) / 2)
    return out


def labelled(page: Page) -> list[bool] | None:
    """Of each element, whether its words are content, if the page labels itself, else None."""
    label = next((t for t in ("article", "main") if page.tag.count(t) == 1), None)
    if not label:
        return None
    out = [False]
    for e in range(1, len(page.parent)):
        # Adverts and forms within an article aren't the article.
        out.append(page.tag[e] == label or (out[page.parent[e]] and not page.names[e] & OTHER))
    return out


def inside(page: Page, label: list[bool], kind: str, element: int) -> bool:
    """Whether a token is content; the tags of the element that holds it stand at its edge, outside."""
    return label[element] and (kind in ("text", "alone") or label[page.parent[element]])


def count_names(page: Page) -> Counter:
    """Words by (name, content or not) on a page that labels itself; an element's words count once for each name."""
    label, out = labelled(page), Counter()
    if label is None:
        return out
    for inside in (True, False):
        words = [0] * len(page.parent)
        for kind, value, e in page.tokens:
            if kind == "text" and label[e] == inside:
                words[e] += len(value.split())
        for e in range(len(page.parent) - 1, 0, -1):
            words[page.parent[e]] += words[e]
            for name in page.names[e] if words[e] else ():
                out[name, inside] += words[e]
    return out


def name_odds(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of content for words in elements of each name."""
    out = {}
    for name in {n for n, _ in counts} | set(CONTENT) | OTHER:
        yes, no = counts.get((name, True), 0), counts.get((name, False), 0)
        start = _PRIOR * (0.99 if name in CONTENT else 0.01 if name in OTHER else 0.5)
        value = math.log((yes + start + 0.1) / (no + _PRIOR - start + 0.1))
        out[name] = max(-_MOST, min(_MOST, value))
    return out


Key = tuple[str, int, int, int, int, str, float]


def keys(page: Page, odds: dict[str, float]) -> list[tuple[Key | None, int]]:
    """What a token's score depends on, and how many words it has; None for text without a word.

    A tag that breaks no line costs half of what a word of its block gains, so that none splits a sentence.
    """
    names = name_scores(page, odds)
    of, kinds = blocks(page)
    out: list[tuple[Key | None, int]] = []
    for (kind, value, e), b in zip(page.tokens, of):
        if kind != "text" and value in _INLINE:
            out.append((("inline", *kinds[b], names[e]), 1))
        elif kind != "text":
            out.append((("tag", 0, 0, 0, 0, value if value in _KNOWN else "div", names[e]), 1))
        else:
            n = len(value.split())
            out.append((("word", *kinds[b], names[e]) if n else None, n))
    return out


def _vector(key: Key, tags: dict[str, int]) -> np.ndarray:
    """One place for each step of each part of the key; the last two are for a name and for content's names alone."""
    kind, length, links, sign, near, tag, name = key
    out = np.zeros(16 + len(tags) + 2)
    out[0] = 1
    if kind != "tag":
        out[[1 + length, 8 + links, 11 + sign, 13 + near]] = 1
    out[16 + tags[tag]] = 1
    out[-2:] = min(name, 0), max(name, 0)
    return out


def _logistic(rows: list[tuple[Key, bool, float]], tags: dict[str, int], ridge: float = 3e-3, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic model; both classes weigh alike."""
    start = np.zeros(16 + len(tags) + 2)
    start[-2:] = 2, 1  # until pages show otherwise, bad names count double: what they name also stands within content
    w = start.copy()
    n = {y: sum(c for _, z, c in rows if z == y) for y in (True, False)}
    if not n[True] or not n[False]:
        return w
    x = np.stack([_vector(k, tags) for k, _, _ in rows])
    y = np.array([z for _, z, _ in rows], float)
    c = np.array([c / n[z] / 2 for _, z, c in rows])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (c * (p - y)) + ridge * (w - start)
        hess = (x.T * (c * p * (1 - p))) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(1e-9, abs(step).max()))
    return w


def _views(key: Key) -> list[Key]:
    """The key as it is, without names, and without names and tag."""
    return [key, (*key[:6], 0.0), (*key[:5], "div", 0.0)]


class Scores:
    """Gains of words and costs of tags, from counts of words by name and of tokens by key."""

    def __init__(self, names: dict[tuple[str, bool], int] | None = None, tokens: dict[tuple[Key, bool], float] | None = None):
        self.odds = name_odds(names or {})
        self.tags = {t: i for i, t in enumerate(sorted(_KNOWN | {"div"}))}
        rows: dict[str, Counter] = {"word": Counter(), "tag": Counter()}
        for (key, inside), n in sorted((tokens or {}).items()):
            for view in _views(key) if key[0] in rows else ():
                rows[key[0]][view, inside] += n
        self.weights = {kind: _logistic([(k, y, n) for (k, y), n in sorted(c.items())], self.tags) for kind, c in rows.items()}
        self.known: dict[Key, float] = {}

    def of(self, key: Key) -> float:
        """The gain of a word, near its log-odds of content if they are high, or the cost of a tag, near these if they are low; near nothing otherwise; half a word's gain for a tag that breaks no line."""
        gain = self.known.get(key)
        if gain is None:
            z = max(-6.0, min(6.0, float(_vector(key, self.tags) @ self.weights["tag" if key[0] == "tag" else "word"])))
            up, down = (math.log1p(math.exp(x * _SHARP)) / _SHARP for x in (z, -z))
            gain = self.known[key] = {"word": up, "tag": -down, "inline": -up / 2}[key[0]]
        return gain


def scored(page: Page, scores: Scores) -> list[float]:
    """The score of each token."""
    return gains_of(keys(page, scores.odds), scores)


def gains_of(row: list[tuple[Key | None, int]], scores: Scores) -> list[float]:
    return [scores.of(key) * n if key else 0.0 for key, n in row]


def best_run(gains: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of the largest sum; of equals that which ends first, then the shortest."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, gain in enumerate(gains):
        total += gain
        if total > best + _TINY:
            best, span = total, (start, i + 1)
        elif total <= _TINY:
            total, start = 0.0, i + 1
    return span


def _weak(page: Page, gains: np.ndarray, seed: tuple[int, int]) -> list[tuple[int, int]]:
    """The outermost elements beside the run seed, or within it, whose tokens add up to less than nothing; inline ones don't count."""
    sums, out, end = np.r_[0.0, np.cumsum(gains)], [], 0
    for e in range(1, len(page.parent)):  # in page order, outer ones first
        x, y = page.span[e]
        apart = y <= seed[0] or seed[1] <= x or (seed[0] <= x and y <= seed[1] and (x, y) != seed)
        if x >= end and apart and page.tag[e] not in _INLINE and sums[y] - sums[x] < -_TINY:
            out.append((x, y))
            end = y
    return out


def regions(page: Page, gains: list[float]) -> tuple[tuple[int, int], list[tuple[int, int]]]:
    """The run of tokens with the main text, and the spans in it that are left out.

    The best run of all tokens is the seed. Elements around it that score below
    zero can be left out, so none of them counts for less than -_SKIP, and the
    run is looked for once more.
    """
    row = np.array(gains, float)
    seed = best_run(gains)
    for x, y in _weak(page, row, seed):
        if y <= seed[0] or seed[1] <= x:
            row[x], row[x + 1 : y] = max(-_SKIP, float(row[x:y].sum())), 0.0
    a, b = run = best_run(row.tolist())
    return run, [(x, y) for x, y in _weak(page, np.array(gains, float), run) if a <= x and x < b]


def extract(html: str | None, scores: Scores) -> str:
    """The main text: its blocks in page order, joined by one space."""
    page = Page(html or "")
    row = keys(page, scores.odds)
    gains = gains_of(row, scores)
    (a, b), without = regions(page, gains)
    out = np.zeros(len(gains) + 1, np.int64)
    for x, y in without:
        out[x] += 1
        out[y] -= 1
    out = np.cumsum(out)
    parts, open_, fine = [], [], False
    for i in range(a, b):
        kind, value, _ = page.tokens[i]
        if kind != "text":
            if value not in _INLINE and open_:
                parts.append("".join(open_))
                open_ = []
        elif not out[i]:
            open_.append(H.unescape(value))
            fine = fine or (row[i][0] is not None and row[i][0][-1] >= -1)
    parts.append("".join(open_))
    if not fine:
        return ""
    return " ".join(" ".join(p.split()) for p in parts if p and not p.isspace())


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES, top_names: int = TOP_NAMES) -> Scores:
    """Scores from the pages of a sample of about sample_pages, and twice as many at most, taken by a hash of the id, that label themselves.

    Names beyond the top_names commonest ones of the sample are unknown.
    """
    total = pages.count()
    rows = pages.where(F.col(html_col).isNotNull())
    if total > sample_pages:  # a share of the hash range, so that no page moves to be chosen; the limit only matters if ids repeat
        key = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 40))
        rows = rows.where(key < int((1 << 40) * sample_pages / total)).limit(2 * sample_pages)
    sample = rows.select(F.col(html_col).cast("string").alias("html"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for html in batch.column(0):
                found.update(count_names(Page(html.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.bool_()), pa.array(list(found.values()), pa.int64())], names=["name", "inside", "n"])

    counts = sample.mapInArrow(tally, "name string, inside boolean, n long").groupBy("name").agg(*(F.sum(F.when(F.col("inside") == x, F.col("n")).otherwise(0)).alias(str(x)) for x in (True, False)))
    top = counts.orderBy(F.desc(F.col("True") + F.col("False")), "name").limit(top_names).collect()
    names = {(r["name"], x): r[str(x)] for r in top for x in (True, False)}
    odds = name_odds(names)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for html in batch.column(0):
                page = Page(html.as_py())
                label = labelled(page)
                if label is None:
                    continue
                for (key, n), (kind, _, e) in zip(keys(page, odds), page.tokens):
                    if key and key[0] != "inline":
                        found[key, inside(page, label, kind, e)] += min(n, 30)
        cols = list(zip(*((*k, y, n) for (k, y), n in found.items()))) or [()] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    names_of = ["kind", "length", "links", "sign", "near", "tag", "name", "inside", "n"]
    schema = pa.schema(list(zip(names_of, [pa.string(), *[pa.int32()] * 4, pa.string(), pa.float64(), pa.bool_(), pa.int64()])))
    found = sample.mapInArrow(tokens, "kind string, length int, links int, sign int, near int, tag string, name double, inside boolean, n long").groupBy(names_of[:-1]).agg(F.sum("n").alias("n"))
    # As many rows as there are keys: steps of each part, known tags, and names in half steps.
    return Scores(names, {(tuple(r)[:7], r["inside"]): r["n"] for r in found.collect()})


def main_texts(pages: DataFrame, scores: Scores, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(x.as_py(), scores) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
