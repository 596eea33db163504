"""Exact dedup by deterministic block naming.

A text without its ASCII white space is cut into blocks of block_bytes bytes.
Equal blocks get one integer, the name; then the names of adjacent pairs are
named in the same way, round after round, until each text has a single name.
Two texts are equal exactly if they took equally many rounds and end on equal
names: a name stands for one byte sequence, never for a hash of it.

Scale: each task first names its own blocks, so that a block crosses the
network once for each task and not once for each copy; a group of copies of
any size reaches the sort as one row a task. After that only integers move.

Cases: null and empty texts, and those of white space only, are equal to each
other; of equal rows with equal length and id any one stays, and exactly one;
a null id is larger than any id; other columns, whatever their names, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BLOCK_BYTES = 8192
#: A task forgets its local names after this many bytes of distinct blocks.
LOCAL_BYTES = 48 << 20
_DELETE = C.SPACES.encode()


def _local_names(block_bytes: int, local_bytes: int):
    """Rows of (row, id, n_chars, sha, seq) for texts and (local, block) for the blocks they name."""
    import hashlib

    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("chars", pa.int64()), ("sha", pa.string()), ("seq", pa.list_(pa.int64())), ("local", pa.int64()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, used, held = TaskContext.get().partitionId() << 36, 0, 0
        known: dict[bytes, int] = {}
        for batch in batches:
            docs, blocks, size = [], [], 0
            for row, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode("utf-8", "surrogatepass").translate(None, _DELETE)
                seq = []
                for at in range(0, max(1, len(raw)), block_bytes):
                    block = raw[at : at + block_bytes]
                    name = known.get(block)
                    if name is None:
                        if held > local_bytes:
                            known.clear()
                            held = 0
                        name = known[block] = base + used
                        used += 1
                        held += len(block)
                        size += len(block)
                        blocks.append((name, block))
                    seq.append(name)
                docs.append((row, key, len(text or ""), hashlib.sha256(raw).hexdigest(), seq))
                if size > 8 << 20:
                    yield _batch(schema, docs, blocks)
                    docs, blocks, size = [], [], 0
            yield _batch(schema, docs, blocks)

    return run, "row long, id long, chars long, sha string, seq array<long>, local long, block binary"


def _batch(schema: pa.Schema, docs: list, blocks: list) -> pa.RecordBatch:
    rows = [(*d, None, None) for d in docs] + [(None,) * 5 + b for b in blocks]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, block_bytes: int = BLOCK_BYTES, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """One row per row of docs: row, id, chars, sha, rounds, name; (rounds, name) is the identity of its text."""
    spark = docs.sparkSession
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    run, schema = _local_names(block_bytes, local_bytes)
    local, p0 = C.cut(docs.select(row.cast("long").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema), "blocks")

    # The sort: equal blocks stand together and take the smallest of their local names.
    run_of_equals = Window.partitionBy("block")
    names = local.where("local is not null").select("local", F.min("local").over(run_of_equals).alias("name"))
    docs_cols = ["row", "id", "chars", "sha"]
    items = local.where("row is not null").select(*docs_cols, F.size("seq").alias("n"), F.posexplode("seq").alias("pos", "local"))
    now, path = C.cut(items.join(names, "local").select(*docs_cols, "n", "pos", "name"), "names")
    C.drop(spark, p0)

    done, rounds = [], 0
    while True:
        done.append(now.where("n = 1").select(*docs_cols, F.lit(rounds).alias("rounds"), "name"))
        rest = now.where("n > 1")
        if rest.isEmpty():
            break
        # Adjacent pairs; -1 stands for the missing right half of the last one.
        pairs = rest.groupBy(*docs_cols, "n", F.expr("pos div 2").cast("int").alias("pos")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        pairs, p1 = C.cut(pairs, "pairs")
        named, p2 = C.cut(pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id()), "pair-names")
        now, path = C.cut(pairs.join(named, ["a", "b"]).select(*docs_cols, F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name"), "names")
        C.drop(spark, p1, p2)
        rounds += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, **options) -> DataFrame:
    """One row per row of docs: row, id, keep_row, keep_id, group_size, kept, sha.

    Of equal texts the row with the most code points stays, then the smallest id.
    """
    ids = identities(docs, id_col, text_col, row_col, **options)
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")
    # A table of its own, so that the join can split a group that holds much of all rows.
    groups, _ = C.cut(ids.groupBy("rounds", "name").agg(best, F.count(F.lit(1)).alias("group_size")), "groups")
    return ids.join(groups, ["rounds", "name"]).select("row", "id", F.col("best.row").alias("keep_row"), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "sha")
