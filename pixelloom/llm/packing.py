"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum
of squared lengths). What a piece takes of all three follows from its length,
so the packer needs only how many pieces each length has: a table of at most
max_tokens rows, whatever the input. Lengths are placed from long to short.
Among groups of equal open sequences that have room in every capacity, the one
with the smallest weighted norm of what would be left (rule "norm") or the
largest weighted dot product of need and room (rule "dot") takes as many pieces
as fit; a capacity weighs as much as the whole input needs of it. Unless they
are given, max_docs and max_cost are what a sequence of max_tokens tokens can
hold at most, so tokens alone bind then, as in the registered query.

Scale: the plan is a list of ranges (length, first rank, sequences, offset);
each piece finds its place from its rank among pieces of its length. Ranks come
from counts for each task and length, so no length is gathered in one task.

Cases: null text is empty; every document ends with the id `end`, so an empty
one is a piece of one token; only a document longer than a sequence is cut, and
only its last piece may be shorter; a piece that is over a capacity of its own
(max_cost below its squared length) has a sequence to itself; repeated rows and
ids are documents of their own; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import tokenizer

TOKENIZER = "word_bpe_49k.json"
MAX_TOKENS = 2048
#: Texts are encoded side by side in slices of about this many bytes; a longer text is a slice of its own.
_SLICE_BYTES = 4 << 20
_PIECE = "row long, id long, piece int, start long, length long, ids_crc32 long, task int, turn long"


def _by_bytes(batch: pa.RecordBatch, most: int = _SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `most` bytes together, and one row at least."""
    sizes = pc.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False)
    sums, at = np.r_[0, np.cumsum(sizes, dtype=np.int64)], 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _turns(length: np.ndarray, before: np.ndarray) -> np.ndarray:
    """How often each length has stood before, counting on from `before`, which is brought up to date."""
    order = np.argsort(length, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0]) if len(length) else np.zeros(0, np.int64)
    size = np.diff(np.r_[heads, len(length)])
    out = np.empty(len(length), np.int64)
    out[order] = np.arange(len(length)) - np.repeat(heads, size) + before[length[order]]
    before += np.bincount(length, minlength=len(before))
    return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, path: str = TOKENIZER, max_tokens: int = MAX_TOKENS, end: int = 0) -> DataFrame:
    """The token pieces of each document; turn counts the pieces of one length in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turns, own, last = TaskContext.get().partitionId(), np.zeros(max_tokens + 1, np.int64), tokenizer(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            for part in _by_bytes(batch):
                ids, at = own.encode(part.column(2))
                raw, sizes = ids.astype("<u4", copy=False).view(np.uint8), np.diff(at) + 1
                many = -(-sizes // max_tokens)
                doc = np.repeat(np.arange(len(many)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * max_tokens
                length = np.minimum(max_tokens, sizes[doc] - start)
                ends = piece == many[doc] - 1
                a, b = at[doc] + start, at[doc] + start + length - ends
                sums = [crc32(last, crc32(raw[4 * x : 4 * y])) if z else crc32(raw[4 * x : 4 * y]) for x, y, z in zip(a.tolist(), b.tolist(), ends.tolist())]
                turn = _turns(length, turns)
                rows = pa.array(doc)
                del ids, raw
                pa.default_memory_pool().release_unused()  # several workers share an executor's memory
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(turn)], names=names)

    names = [p.split()[0] for p in _PIECE.split(", ")]
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return docs.select(row.cast("long").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECE)


def plan(counts: dict[int, int], max_tokens: int = MAX_TOKENS, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """Ranges (length, first rank, pieces a sequence, first sequence, offset) that place all pieces."""
    caps = np.array([max_tokens, max_docs or max_tokens, max_cost or max_tokens**2], float)
    lengths = np.array(sorted(counts, reverse=True), float)
    many = np.array([counts[int(n)] for n in lengths], float)
    needs = np.stack([lengths, np.ones_like(lengths), lengths**2], 1) / caps
    weights = (needs * many[:, None]).sum(0)
    weights /= max(weights.sum(), 1e-300)
    room, first, size, used = np.zeros((0, 3)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out, sequences = [], 0
    for need, length in zip(needs, lengths.astype(int).tolist()):
        left, rank = counts[length], 0
        while left:
            fits = np.flatnonzero((room >= need - 1e-12).all(1))
            if len(fits):
                rest = room[fits] - need
                at = fits[np.argmin((weights * rest**2).sum(1)) if rule == "norm" else np.argmax((weights * need * room[fits]).sum(1))]
            else:
                n = max(1, int(np.floor(1 / need + 1e-9).min()))
                grown = -(-left // n)
                room, first = np.vstack([room, np.ones((1, 3))]), np.r_[first, sequences]
                size, used = np.r_[size, grown], np.r_[used, 0]
                sequences += grown
                at = len(size) - 1
            fit = max(1, int(np.floor(room[at] / need + 1e-9).min()))
            each = min(fit, left)
            taken = min(int(size[at]), left // each)
            out.append((length, rank, each, int(first[at]), int(used[at])))
            rank, left = rank + taken * each, left - taken * each
            if taken < size[at]:  # the rest of the group stays as it was
                room, first = np.vstack([room, room[at]]), np.r_[first, first[at] + taken]
                size, used = np.r_[size, size[at] - taken], np.r_[used, used[at]]
            room[at] -= each * need
            size[at], used[at] = taken, used[at] + each * length
            if len(size) > 64 and (full := used >= max_tokens).mean() > 0.25:
                room, first, size, used = room[~full], first[~full], size[~full], used[~full]
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, path: str = TOKENIZER, max_tokens: int = MAX_TOKENS, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", end: int = 0) -> DataFrame:
    """One row per piece: row, id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut, _ = C.cut(pieces(docs, id_col, text_col, row_col, path, max_tokens, end), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_tokens rows at most
    ranges = sorted(plan(counts, max_tokens, max_docs, max_cost, rule))
    table = np.array(ranges, np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = table[np.searchsorted(keys, (length << 44) | rank, "right") - 1]
            k = rank - at[:, 1]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            cols += [pa.array(at[:, 3] + k // at[:, 2]), pa.array(at[:, 4] + k % at[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    ranked = cut.join(ranks, ["task", "length"]).select("row", "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("turn")).alias("rank"))
    return ranked.mapInArrow(place, "row long, id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
