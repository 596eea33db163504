"""Token ids of whole texts from a public tokenizer file, as columns.

A tokenizer that drops white space gives a text the ids of its words, one after
the other. So the words of a batch are split and told apart in Arrow, each
distinct word is encoded once, and the ids are gathered back. Words of plain
letters, with a sign after them or not, are merged side by side, and what they
give is kept for the batches to come; any other word, and any word if the file
isn't of the known kind, goes to the library.

Cases: null and empty texts have no ids; white space is the six ASCII
characters, and all other characters are the library's matter; bytes that
aren't UTF-8 count as U+FFFD; a word of any length costs no more than the
library takes for it; equal texts have equal ids; an empty batch has none.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that lower-casing and normalisation treat one by one: ASCII, Latin-1 letters and Latin Extended-A without U+0130 and U+0149.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ſ"
_PLAIN = re.compile(rf"[!-~{_LETTERS}]+")
#: Signs that stand alone after letters, whatever the letters are.
_SIGNS = ".,;:!?|"
#: Bytes of the longest word that is merged here; each step of a merge passes over the whole word.
_LONGEST = 48
_NONE = np.int64(1 << 40)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], ..., starts[i] + sizes[i] - 1 for each i, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of strings."""
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


class _Merges:
    """Byte-pair merges of many words at once."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.end = model["end_of_word_suffix"]
        self.keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs] + [-1], np.int64)
        merged = [vocab[a + b] for a, b in pairs]
        self.made = np.array([*merged, 0], np.int64)
        kept = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))  # fixed values: the printable bytes of byte-level vocabularies
        signs, spare = {b: chr(b) for b in kept}, 256
        for b in range(256):
            if b not in signs:
                signs[b] = chr(spare)
                spare += 1
        self.inner = np.array([vocab[signs[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[signs[b] + self.end] for b in range(256)], np.int64)
        self._build()

    def _build(self) -> None:
        self.tables, left = [], np.arange(len(self.keys) - 1)
        odd = 0x9E3779B97F4A7C15
        while len(left):
            odd = (odd * 6364136223846793005 + 1442695040888963407) % (1 << 64) | 1
            table = np.full(1 << 20, len(self.keys) - 1, np.int32)
            at = (self.keys[left].view(np.uint64) * np.uint64(odd)) >> np.uint64(44)
            table[at] = left
            self.tables.append((np.uint64(odd), table))
            left = left[table[at] != left]

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, _NONE)
        for odd, table in self.tables:
            e = table[(keys.view(np.uint64) * odd) >> np.uint64(44)]
            hit = self.keys[e] == keys
            out[hit] = e[hit]
        return out

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and the number of each word's ids."""
        at, data = _bytes_of(words)
        starts, lengths = at[:-1], np.diff(at)
        order = np.argsort(lengths, kind="stable")
        room, sizes = np.zeros(int(lengths.sum()), np.uint32), np.zeros(len(lengths), np.int64)
        own = starts - (at[0] if len(at) else 0)
        edges = np.searchsorted(lengths[order], np.arange(1, int(lengths.max(initial=0)) + 2))
        for n, (a, b) in enumerate(zip(edges, edges[1:]), 1):
            step = max(1, 200_000 // n)
            for k in range(a, b, step):
                some = order[k : min(b, k + step)]
                raw = data[starts[some][:, None] + np.arange(n)]
                ids = self.inner[raw]
                ids[:, -1] = self.last[raw[:, -1]]
                self._merge(ids, some, own, room, sizes)
        return room[_runs(own, sizes)], sizes

    def _merge(self, ids: np.ndarray, who: np.ndarray, own: np.ndarray, room: np.ndarray, sizes: np.ndarray) -> None:
        rank = self.ranks((ids[:, :-1] << 20) | ids[:, 1:])
        while True:
            n = ids.shape[1]
            if n > 1:
                best = rank.argmin(1)
                least = rank[np.arange(len(ids)), best]
                more = least < _NONE
            else:
                more = np.zeros(len(ids), bool)
            done = who[~more]
            if len(done):
                room[own[done][:, None] + np.arange(n)] = ids[~more]
                sizes[done] = n
            if len(done) == len(who):
                return
            if len(done):
                ids, rank, who, best, least = ids[more], rank[more], who[more], best[more], least[more]
            row = np.arange(len(ids))
            ids[row, best] = self.made[least]
            keep = np.ones(ids.shape, bool)
            keep[row, best + 1] = False
            ids = ids[keep].reshape(len(ids), n - 1)
            # Only the pairs around the merged one have changed.
            keep = np.ones(rank.shape, bool)
            keep[row, best] = False
            rank = rank[keep].reshape(len(ids), n - 2)
            for place in (best - 1, best):
                some = np.flatnonzero((place >= 0) & (place < n - 2))
                at = place[some]
                rank[some, at] = self.ranks((ids[some, at] << 20) | ids[some, at + 1])


class _Store:
    """Ids by number: those of entry i are ids[starts[i] : starts[i] + sizes[i]]."""

    def __init__(self) -> None:
        self.ids, self.starts, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.count = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Appends entries and returns the number of the first one."""
        used, count, first = self.used + len(ids), self.count + len(sizes), self.count
        if used > len(self.ids):
            self.ids = np.resize(self.ids, 2 * used)
        if count > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * count), np.resize(self.sizes, 2 * count)
        self.ids[self.used : used] = ids
        self.starts[first:count] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first:count] = sizes
        self.used, self.count = used, count
        return first


class WordTokenizer:
    """encode(texts): the ids of all texts in a row, without special tokens, and where each text's ids begin and end."""

    def __init__(self, path: str, most_kept: int = 100_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.most_kept = most_kept
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)").search
        self.merges = None
        steps = [s.get("type") for s in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        if steps == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in split] == ["Split", "ByteLevel"] and split[0].get("invert") and split[0].get("behavior") == "Removed" and spec["model"].get("end_of_word_suffix") and not spec["model"].get("dropout"):
            import regex

            self.merges = _Merges(spec["model"])
            self.parts = regex.compile(split[0]["pattern"]["Regex"]).findall
        self._reset()

    def _reset(self) -> None:
        self.store = _Store()
        self.store.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))  # entry 0: nothing
        self.pieces: dict[str, int] = {}  # runs of letters in lower case, and parts of signs
        self.others: dict[bytes, int] = {}  # words that need the library's own rules

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, at = self.encode(pa.array([(t or "").encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(at, at[1:])]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = pc.ascii_split_whitespace(texts.fill_null(""))
        known = rows.flatten().dictionary_encode()
        at = rows.offsets.to_numpy()
        if self.store.count > self.most_kept:
            self._reset()
        starts, sizes, ids = self._words(known.dictionary)
        code = known.indices.to_numpy(zero_copy_only=False)
        per = sizes[code]
        ends = np.r_[0, np.cumsum(per)]
        return ids[_runs(starts[code], per)], ends[at - at[0]]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and number of the ids of each word, and the ids."""
        first, second = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)  # entries of the store
        left = np.asarray(pc.greater(pc.binary_length(words), 0)).astype(bool)
        if self.merges is not None:
            short = pc.less_equal(pc.binary_length(words), _LONGEST)
            plain = pc.and_(pc.match_substring_regex(words, f"^[{_LETTERS}]+$"), short)
            signed = pc.and_(pc.match_substring_regex(words, f"^[{_LETTERS}]+[{_SIGNS}]$"), short)
            a, b = np.flatnonzero(plain), np.flatnonzero(signed)
            with_sign = words.filter(signed)
            kinds = pa.concat_arrays([pc.utf8_lower(words.filter(plain)), pc.utf8_lower(pc.utf8_slice_codeunits(with_sign, 0, -1)), pc.utf8_slice_codeunits(with_sign, -1)]).dictionary_encode()
            entry = self._pieces(kinds.dictionary)[kinds.indices.to_numpy(zero_copy_only=False)]
            first[a], first[b], second[b] = entry[: len(a)], entry[len(a) : len(a) + len(b)], entry[len(a) + len(b) :]
            left[a] = left[b] = False
        rest = np.flatnonzero(left)
        if len(rest):
            raw = words.take(pa.array(rest)).cast(pa.binary()).to_pylist()
            self._others({w for w in raw if w not in self.others})
            first[rest] = [self.others[w] for w in raw]
        both = np.stack([first, second], 1).ravel()
        per = self.store.sizes[both]
        ids = self.store.ids[_runs(self.store.starts[both], per)]
        sizes = per[::2] + per[1::2]
        return np.cumsum(sizes) - sizes, sizes, ids

    def _pieces(self, words: pa.Array) -> np.ndarray:
        get = self.pieces.get
        names = words.to_pylist()
        entry = np.fromiter((get(w, 0) for w in names), np.int64, len(names))
        new = np.flatnonzero(entry == 0)
        if len(new):
            entry[new] = np.arange(len(new)) + self.store.add(*self.merges.encode(words.take(pa.array(new))))
            self.pieces.update(zip([names[i] for i in new], entry[new].tolist()))
        return entry

    def _others(self, new: set[bytes]) -> None:
        odd, several = [], []
        for raw in new:
            w = raw.decode("utf-8", "replace")
            if self.merges is None or len(raw) > _LONGEST or not _PLAIN.fullmatch(w) or self.special(w):
                odd.append((raw, w))
            else:
                several.append((raw, self.parts(w.lower())))
        if several:
            parts = [p for _, ps in several for p in ps]
            kinds = pa.array(parts, pa.string()).dictionary_encode()
            entry = self._pieces(kinds.dictionary)[kinds.indices.to_numpy(zero_copy_only=False)]
            n = np.array([len(ps) for _, ps in several])
            per, ends = self.store.sizes[entry], np.cumsum(n)
            ids = self.store.ids[_runs(self.store.starts[entry], per)]
            sums = np.r_[0, np.cumsum(per)]
            at = self.store.add(ids, sums[ends] - sums[ends - n])
            self.others.update((raw, at + i) for i, (raw, _) in enumerate(several))
        for at in range(0, len(odd), 1000):
            some = odd[at : at + 1000]
            found = [e.ids for e in self.library.encode_batch([w for _, w in some], add_special_tokens=False)]
            first = self.store.add(np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64))
            self.others.update((raw, first + i) for i, (raw, _) in enumerate(some))


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, loaded once in each worker. path: a file name, or a name that public_tokenizers knows."""
    if path not in _LOADED:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        where = path
        if not os.path.isabs(path):
            import public_tokenizers

            where = public_tokenizers.path(path)
        _LOADED[path] = WordTokenizer(where)
    return _LOADED[path]
