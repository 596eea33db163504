"""Mixing sources to target weights in a tree of domain, language and source.

The budget of tokens flows from the root down. At every node the children share
it by weight; a child whose documents, taken max_epochs times, are too few for
its share takes all it can use, and its siblings share the shortage by weight.
Only what no sibling can use is left to the level above, since a node's own
limit is the sum of its children's. Each leaf then reads its documents in
seeded epochs: every epoch has an order of its own, and the leaf takes the
prefix of that endless row whose tokens meet its budget.

Scale: supplies are sums by leaf; shares are window sums over the children of
a node, so neither leaves nor documents reach the driver. The order within a
leaf is the md5 of seed, epoch and id: tokens are summed for ranges of it first,
as many as leave a thousand rows or fewer in each, and these sums are added up
sixteen at a time; so no leaf, whatever its share of the rows, is sorted or summed in one task.

Cases: null and empty texts have no words and are taken where their turn comes,
at no cost; a null domain, language or source is a value of its own; a weight
that isn't given is default_weight, and a child of weight zero gets what its
siblings can't use; a document is taken if its first token is within the
budget, so a leaf exceeds it by less than a document; rows that repeat an id
have neighbouring places; a leaf without a word gives nothing; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LEVELS = ("domain", "lang", "source")
_TINY = 1e-9
#: Rows of the largest leaf in each range of the hash, on average and at most.
PART_ROWS = 1000


def word_count(text: Column) -> Column:
    """Words of a text: runs of characters other than the six ASCII spaces."""
    plain = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(F.coalesce(F.length(plain), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(plain, " +"))).cast("long")


def _weight(level: str, weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for value, w in weights.items():
        out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
    return F.greatest(out, F.lit(_TINY))


def share(children: DataFrame, parent: list[str]) -> DataFrame:
    """children(..., weight, cap, budget of the parent) with budget: the child's part, by weight and at most cap."""
    by_need = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), *LEVELS)
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    after = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("parent_budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    full = F.col("cap") <= F.col("weight") * F.col("level")
    # Children that can't use their share come first; the first one that can sets the level for all after it.
    first = F.min(F.when(~full, F.struct("place", "level"))).over(Window.partitionBy(*parent))
    ranked = children.withColumn("level", level).withColumn("place", F.row_number().over(by_need)).withColumn("open", first)
    budget = F.when(F.col("open").isNull() | (F.col("place") < F.col("open.place")), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("open.level")))
    return ranked.withColumn("budget", budget).drop("level", "place", "open", "parent_budget")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], budget: float, max_epochs: float = 2.0, default_weight: float = 1.0) -> DataFrame:
    """leaves(domain, lang, source, supply) with budget."""
    caps = leaves.select(*LEVELS, "supply", (F.col("supply") * float(max_epochs)).alias("cap"))
    whole = leaves.agg(F.sum("supply").alias("supply")).first()["supply"] or 0
    above, keys = None, []
    for depth in range(1, len(LEVELS) + 1):
        own = list(LEVELS[:depth])
        children = caps.groupBy(*own).agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
        children = children.select(*own, *(F.lit("").alias(x) for x in LEVELS[depth:]), "cap", "supply", _weight(LEVELS[depth - 1], weights.get(LEVELS[depth - 1], {}), default_weight).alias("weight"))
        children = children.join(above, keys) if keys else children.withColumn("parent_budget", F.lit(budget * float(whole)))
        parts = share(children, keys or [F.lit(0)])
        keys = own
        above = parts.select(*own, F.col("budget").alias("parent_budget"))
    return parts.select(*LEVELS, "supply", "budget")


def _starts(sums: DataFrame, leaf: list[str], digits: int) -> DataFrame:
    """sums(leaf, part, n) with before: the tokens of all parts of the leaf ahead of this one.

    Parts are told by hexadecimal digits, and are summed digit by digit: a window holds the sixteen parts of one digit.
    """
    out = None
    for k in range(1, digits + 1):
        level = sums.groupBy(*leaf, F.substring("part", 1, k).alias("part")).agg(F.sum("n").alias("n")) if k < digits else sums
        level = level.withColumn("up", F.substring("part", 1, k - 1) if k > 1 else F.lit(""))
        before = Window.partitionBy(*leaf, "up").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(*leaf, "part", "up", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        if out is not None:
            level = level.join(out.withColumnsRenamed({"part": "up", "before": "ahead"}), [*leaf, "up"]).withColumn("before", F.col("before") + F.col("ahead"))
        out = level.select(*leaf, "part", "before")
    return out


def select(docs: DataFrame, weights: dict[str, dict[str, float]], domain: Column, lang: Column, source: Column, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, budget: float = 1.0, max_epochs: float = 2.0, seed: int = 7, default_weight: float = 1.0) -> DataFrame:
    """One row per document taken: row, id, domain, lang, source, epoch, start (in its leaf's row of tokens), tokens.

    budget is a multiple of the tokens of all documents.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    key = [F.coalesce(c.cast("string"), F.lit("<null>")).alias(n) for n, c in zip(LEVELS, (domain, lang, source))]
    sized, _ = C.cut(docs.select(row.cast("long").alias("row"), F.col(id_col).cast("long").alias("id"), *key, word_count(F.col(text_col)).alias("tokens")), "sizes")
    leaves, p1 = C.cut(sized.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"), F.count(F.lit(1)).alias("rows")), "leaves")
    most = leaves.agg(F.max("rows").alias("rows")).first()["rows"] or 0
    digits = max(1, math.ceil(math.log(max(1, most / PART_ROWS), 16)))
    parts, _ = C.cut(budgets(leaves, weights, budget, max_epochs, default_weight), "budgets")
    C.drop(docs.sparkSession, p1)

    # Epochs that each leaf reads, the last one in part.
    epochs = parts.where("budget > 0").select(*LEVELS, "supply", "budget", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("budget") / F.col("supply")).cast("int") - 1))).alias("epoch"))
    epochs = epochs.withColumn("left", F.col("budget") - F.col("epoch") * F.col("supply")).where("left > 0").select(*LEVELS, "epoch", "left")
    turn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    placed = sized.join(epochs, list(LEVELS)).withColumn("turn", turn).withColumn("part", F.substring("turn", 1, digits))
    leaf = [*LEVELS, "epoch"]
    starts = _starts(placed.groupBy(*leaf, "part").agg(F.sum("tokens").alias("n")), leaf, digits)
    within = Window.partitionBy(*leaf, "part").orderBy("turn", "id", "row").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("inside", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(starts, [*leaf, "part"])
    out = ordered.withColumn("start", F.col("before") + F.col("inside")).where("start < left")
    return out.select("row", "id", *LEVELS, "epoch", "start", "tokens")
