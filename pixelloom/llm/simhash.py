"""SimHash near-dedup over a grid of segment popcounts.

The 64 bits of a fingerprint are cut into short segments, and each segment is
mapped to the number of its set bits. Every differing bit moves one of these
counts by one at most, so the Manhattan distance of two count vectors is a
lower bound of the Hamming distance. The vectors are cut into two halves; of a
pair within max_distance, one half is within max_distance // 2. So each
fingerprint stands in the grid cell of each half and is also sent to the cells
around it, on one side only, since the other one of a pair does the rest.
Fingerprints that meet in a cell are compared exactly, bit by bit.

Scale: equal fingerprints are one node, whatever the number of their texts.
With segments of one bit, 34 rows for each fingerprint on average, an unrelated
one meets it with a chance of 66 in 2^32 (with two bits, 26 rows and 300
times that chance). In a cell of many near copies only a spanning forest of the
links is returned, never all pairs; no cell is cut short.

Cases: null and empty texts and those without a word have fingerprint zero and
are linked like any other; texts of fewer words than a shingle are one
shingle; a text with a bit in exactly half of its hashes has it unset; long
texts are hashed in slices; repeated rows are equal texts; a null id never
names a component that holds another id; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

SHINGLE, MAX_DISTANCE, SEGMENTS = 3, 3, 64
SEED = 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SLICE = 20_000
#: Runs of up to this many fingerprints in a cell are compared by shifting whole columns.
_SHORT_RUN = 12


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text as an unsigned integer."""
    import xxhash

    one = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        part = words[at : at + _SLICE + shingle - 1]
        rows = zip(*(part[k:] for k in range(shingle))) if len(words) >= shingle else [part]
        hashes = np.array([one(b" ".join(r), SEED) for r in rows], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, shingle: int = SHINGLE) -> DataFrame:
    """(row, id, fp) for each row of docs; fp is the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([text_fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["row", "id", "fp"])

    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return docs.select(row.cast("long").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "row long, id long, fp long")


def popcounts(fps: np.ndarray, segments: int) -> np.ndarray:
    """The embedding: a row of segment popcounts for each fingerprint."""
    width = 64 // segments
    shifts = (np.arange(segments) * width).astype(np.uint64)
    parts = (fps.view(np.uint64)[:, None] >> shifts) & np.uint64(((1 << width) - 1) & (2**64 - 1))
    return np.bitwise_count(parts).astype(np.int8)


def _steps(dims: int, radius: int) -> list[np.ndarray]:
    """The grid steps of Manhattan length 1 to radius whose first move is upward."""
    found = {}
    for parts in range(1, radius + 1):
        for places in combinations(range(dims), parts):
            for sizes in np.ndindex(*(2 * radius + 1,) * parts):
                moves = np.array(sizes) - radius
                if moves[0] > 0 and (moves != 0).all() and abs(moves).sum() <= radius:
                    step = np.zeros(dims, np.int8)
                    step[list(places)] = moves
                    found[step.tobytes()] = step
    return list(found.values())


def _to_cells(segments: int, max_distance: int):
    dims, width = segments // 2, 64 // segments
    steps = _steps(dims, max_distance // 2)
    digit = int(width).bit_length()
    weights = np.array([1 << (digit * i) for i in range(dims)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                counts = popcounts(fps, segments)
                for half in (0, 1):
                    own = counts[:, half * dims : (half + 1) * dims]
                    cells, whose, home = [own @ weights], [fps], [np.ones(len(fps), bool)]
                    for step in steps:
                        there = own + step
                        ok = ((there >= 0) & (there <= width)).all(1)
                        cells.append(there[ok] @ weights)
                        whose.append(fps[ok])
                        home.append(np.zeros(int(ok.sum()), bool))
                    cell = np.concatenate(cells)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), half, np.int8)), pa.array(cell), pa.array(np.concatenate(whose)), pa.array(np.concatenate(home))], names=["half", "cell", "fp", "home"])

    return run


def _forest(fps: np.ndarray, home: np.ndarray, most: int) -> tuple[list, list]:
    """A spanning forest of the links of one cell."""
    left, a, b = np.arange(len(fps)), [], []
    while len(left):
        ahead, left = [left[0]], left[1:]
        while ahead and len(left):
            x = ahead.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= most
            if not home[x]:
                near &= home[left]
            if near.any():
                got = left[near]
                a.append(np.full(len(got), fps[x]))
                b.append(fps[got])
                ahead.extend(got)
                left = left[~near]
    return a, b


def _compare(most: int):
    """Links between fingerprints of a cell; the rows come sorted by cell."""

    def links(half: np.ndarray, cell: np.ndarray, fps: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        if len(fps):
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (half[1:] != half[:-1])])
            sizes = np.diff(np.r_[starts, len(fps)])
            run = np.repeat(np.arange(len(starts)), sizes)
            short = np.repeat(sizes <= _SHORT_RUN, sizes)
            for k in range(1, min(_SHORT_RUN, len(fps))):
                near = (run[k:] == run[:-k]) & short[k:] & (home[k:] | home[:-k])
                near &= np.bitwise_count(fps[k:] ^ fps[:-k]) <= most
                a.append(fps[:-k][near])
                b.append(fps[k:][near])
            for s, n in zip(starts[sizes > _SHORT_RUN], sizes[sizes > _SHORT_RUN]):
                x, y = _forest(fps[s : s + n], home[s : s + n], most)
                a += x
                b += y
        a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            half, cell, fps, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            held.append([half, cell, fps.astype(np.int64).view(np.uint64), home.astype(bool)])
            same = (cell == cell[-1]) & (half == half[-1])
            last = len(cell) - int(np.argmin(same[::-1])) if not same.all() else 0
            if last == 0 and (len(held) == 1 or (held[0][0][-1], held[0][1][-1]) == (half[-1], cell[-1])):
                continue  # one cell so far
            whole = [np.concatenate(x) for x in zip(*held)]
            n = len(whole[0]) - (len(cell) - last)
            yield links(*(x[:n] for x in whole))
            held = [[x[n:] for x in whole]]
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return run


def near_links(fps: DataFrame, segments: int = SEGMENTS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (a, b) that connect all pairs of distinct fingerprints fps(fp) within max_distance bits."""
    cells = fps.select("fp").mapInArrow(_to_cells(segments, max_distance), "half byte, cell long, fp long, home boolean")
    spark = fps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(n, "half", "cell").sortWithinPartitions("half", "cell")
    return dealt.mapInArrow(_compare(max_distance), "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, shingle: int = SHINGLE, segments: int = SEGMENTS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per row of docs: row, id, fp, component_id (the smallest id of its class), kept (the first row of that id)."""
    rows, _ = C.cut(fingerprints(docs, id_col, text_col, row_col, shingle), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    nodes, p1 = C.cut(rows.groupBy("fp").agg(first), "nodes")
    roots = components(near_links(nodes, segments, max_distance))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted, p2 = C.cut(rooted, "rooted")
    # A table of its own, so that the join can split a class that holds much of all fingerprints.
    heads, p3 = C.cut(rooted.groupBy("root").agg(F.min("first").alias("head")), "heads")
    named, _ = C.cut(rooted.join(heads, "root").select("fp", "head"), "classes")
    C.drop(docs.sparkSession, p1, p2, p3)
    return rows.join(named, "fp").select("row", "id", "fp", F.col("head.id").alias("component_id"), (F.col("row") == F.col("head.row")).alias("kept"))
