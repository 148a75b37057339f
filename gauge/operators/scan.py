"""Running values of ordered rows, in slabs: no key's rows need to sit in one task.

A slab is a stretch of a key's order: rows of a smaller slab come before those of a larger one. Windows run within a
key's slabs, which tasks hold apart; one row a slab tells what it passes on, windows over those rows make what
each slab starts from, and a join by key and slab brings it to the rows. Where a slab is cut changes no result, only
how much a task has at once. The order must have no ties within a key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class Running:
    """How a column is made: within a slab, what a slab passes on, how that is carried, and both together."""

    within: Callable[[W], Column]
    passed: Callable[[Column], Column]
    carried: Callable[[Column, W], Column]
    both: Callable[[Column, Column, Column], Column]
    #: From a key's end to its start: the windows given are in descending order.
    backwards: bool = False


def total(value: Column | str) -> Running:
    """The sum of the values so far, this row's included."""
    value = F.col(value) if isinstance(value, str) else value
    return Running(
        lambda w: F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)),
        lambda order: F.sum(value),
        lambda part, w: F.sum(part).over(w),
        lambda own, carry, first: F.coalesce(carry, F.lit(0)) + F.coalesce(own, F.lit(0)),
    )


def last(value: Column | str) -> Running:
    """The last value so far that is not null, this row's included."""
    value = F.col(value) if isinstance(value, str) else value
    return Running(
        lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)),
        lambda order: F.max_by(value, F.when(value.isNotNull(), order)),
        lambda part, w: F.last(part, ignorenulls=True).over(w),
        lambda own, carry, first: F.coalesce(own, carry),
    )


def previous(value: Column | str) -> Running:
    """The value of the row before, null for a key's first row."""
    value = F.col(value) if isinstance(value, str) else value
    return Running(
        lambda w: F.lag(value).over(w),
        lambda order: F.max_by(F.struct(value.alias("v")), order),  # a struct, so that a last value that is null is passed on
        lambda part, w: F.last(part).over(w),
        lambda own, carry, first: F.when(first, carry["v"]).otherwise(own),
    )


def following(value: Column | str) -> Running:
    """The first value after this row that is not null."""
    value = F.col(value) if isinstance(value, str) else value
    return Running(
        lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)),  # a frame that only grows
        lambda order: F.min_by(value, F.when(value.isNotNull(), order)),
        lambda part, w: F.last(part, ignorenulls=True).over(w),
        lambda own, carry, first: F.coalesce(own, carry),
        backwards=True,
    )


def scan(rows: DataFrame, by: list[str], order: list[str], slab: Column, **columns: Running) -> DataFrame:
    """``rows`` with a column for each of ``columns``, running within each key's order."""
    # structs, in which nulls are equal: a null is a key, too
    key, columns_before = F.struct(*by) if by else F.struct(F.lit(0).alias("all")), rows.columns
    rows = rows.withColumn("_at", F.struct(key.alias("key"), slab.alias("slab")))
    at, back = (W.partitionBy("_at").orderBy(*o) for o in (order, [F.desc(c) for c in order]))
    own = rows.withColumns({f"_{n}": c.within(back if c.backwards else at) for n, c in columns.items()} | {"_first": F.row_number().over(at) == 1})
    sequence = F.struct(*order)
    parts = rows.groupBy("_at").agg(*(c.passed(sequence).alias(f"_p_{n}") for n, c in columns.items()))
    before, after = (W.partitionBy("_at.key").orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in ("_at.slab", F.desc("_at.slab")))
    carry = parts.select("_at", *(c.carried(F.col(f"_p_{n}"), after if c.backwards else before).alias(f"_c_{n}") for n, c in columns.items()))
    return own.join(carry, "_at").select(*columns_before, *(c.both(F.col(f"_{n}"), F.col(f"_c_{n}"), F.col("_first")).alias(n) for n, c in columns.items()))


def blocks(rows: DataFrame, by: list[str], pos: str, header: str, slab: Column, none: str) -> DataFrame:
    """Data rows with their block, from rows of which those with a ``header`` start one.

    ``block`` is the header before a row, or ``none``; ``occurrence`` counts how often that header came up to then, 0
    before any; ``idx`` numbers the rows of a block from 1. Slabs are passed on as in ``scan``, all at once.
    """
    own, names = rows.withColumn("_at", F.struct(F.struct(*by).alias("key"), slab.alias("slab"))), rows.columns
    at = W.partitionBy("_at").orderBy(pos)
    so_far = at.rowsBetween(W.unboundedPreceding, 0)
    is_head = F.col(header).isNotNull()
    # within a slab: how many data rows there are so far, the last header, its number, and the data rows before it
    own = own.withColumns({"_n": F.count_if(~is_head).over(so_far), "_turn": F.when(is_head, F.row_number().over(W.partitionBy("_at", header).orderBy(pos)))})
    own = own.withColumns({"_head": F.last(header, True).over(so_far), "_seen": F.last("_turn", True).over(so_far), "_base": F.last(F.when(is_head, F.col("_n")), True).over(so_far)})
    # how often each header of a slab came in earlier ones
    before = lambda *key: W.partitionBy(*key).orderBy("_at.slab").rowsBetween(W.unboundedPreceding, -1)
    times = own.where(is_head).groupBy("_at", F.col(header).alias("_head")).agg(F.count(F.lit(1)).alias("_times"))
    times = times.select("_at", "_head", F.coalesce(F.sum("_times").over(before("_at.key", "_head")), F.lit(0)).alias("_times"))
    # what a slab starts from: the last row of each tells what it passes on
    ends = own.groupBy("_at").agg(F.max_by(F.struct("_n", "_head", "_seen", "_base"), pos).alias("e")).select("_at", "e.*")
    ends = ends.join(times, ["_at", "_head"], "left").withColumn("_sum", F.coalesce(F.sum("_n").over(before("_at.key")), F.lit(0)))
    last_ = lambda c: F.last(c, True).over(before("_at.key"))
    starts = ends.select("_at", "_sum", last_(F.col("_head")).alias("_head_0"), last_(F.col("_seen") + F.col("_times")).alias("_seen_0"), last_(F.col("_sum") + F.col("_base")).alias("_base_0"))
    data = own.where(~is_head).join(starts, "_at").join(times, ["_at", "_head"], "left")
    here = F.col("_head").isNotNull()
    found = {
        "block": F.coalesce("_head", "_head_0", F.lit(none)),
        "occurrence": F.when(here, F.col("_seen") + F.col("_times")).otherwise(F.coalesce("_seen_0", F.lit(0))).cast("int"),
        "idx": F.when(here, F.col("_n") - F.col("_base")).otherwise(F.col("_sum") + F.col("_n") - F.coalesce("_base_0", F.lit(0))).cast("int"),
    }
    return data.select(*(c for c in names if c != header), *(v.alias(k) for k, v in found.items()))
