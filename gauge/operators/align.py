"""Alignment of measurements across samples and cavities, and what changed between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gauge.operators import scan


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that several rows have, with their number; alignment needs that there are none."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def once(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row a key; an error where several rows have it. The key's rows meet where a join on it needs them anyway."""
    single = F.count(F.lit(1)) > 1
    error = F.raise_error(F.concat(F.lit("repeated key "), F.first(F.col(key).cast("string"))))
    checked = [F.when(single, error.cast(dict(df.dtypes)[c])).otherwise(F.first(c)).alias(c) for c in columns]
    return df.groupBy(key).agg(*checked)


def align(reference: DataFrame, other: DataFrame, key: str, value: str, name: str | None = None) -> DataFrame:
    """One row for each of the reference's keys: its columns and the other's value, null where it has none.

    A key that the other has twice is an error, also where the reference lacks it.
    """
    name = name or f"{value}_other"
    return reference.join(once(other, key, value).withColumnRenamed(value, name), key, "left")


def opposite(points: DataFrame, by: str, angle: str, value: str, step: float = 1.0) -> DataFrame:
    """Largest and smallest distance between opposite points: values at an angle and half a turn further, in cells of ``step`` degrees."""
    cell = F.pmod(F.round(F.col(angle) / step), F.lit(360 / step)).cast("int")
    cells = points.select(by, cell.alias("cell"), F.col(value).alias("v")).groupBy(by, "cell").agg(F.avg("v").alias("v"))
    other = cells.select(by, F.pmod(F.col("cell") + int(180 / step), F.lit(int(360 / step))).alias("cell"), F.col("v").alias("w"))
    return cells.join(other, [by, "cell"]).groupBy(by).agg(F.max(F.col("v") + F.col("w")).alias("most"), F.min(F.col("v") + F.col("w")).alias("least"))


def reference(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """The reference of each group: its smallest cavity, or earliest sample."""
    return df.groupBy(*by).agg(F.min(name).alias("reference"))


def tree(df: DataFrame, by: str, item: str, order: str, payload: str) -> DataFrame:
    """(by, items): the items of each group with their payload, by name; of a repeated item the last one counts."""
    last = df.groupBy(by, item).agg(F.max_by(payload, order).alias(payload))
    return last.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(item, payload))).alias("items"))


def ranges(df: DataFrame, key: str, value: str) -> DataFrame:
    """Largest minus smallest value of each key; missing values are left out."""
    return df.groupBy(key).agg((F.max(value) - F.min(value)).alias("range"), F.count(value).alias("n"))


def top_movers(df: DataFrame, key: str, value: str, n: int = 15) -> DataFrame:
    """The keys that moved most; ties by key."""
    return ranges(df, key, value).orderBy(F.col("range").desc_nulls_last(), key).limit(n)


def evolution(df: DataFrame, key: str, sample: str, value: str, samples: list) -> DataFrame:
    """Matrix of keys by samples; the samples are given, so there is one job."""
    return df.groupBy(key).pivot(sample, samples).agg(F.first(value))


def several_samples(df: DataFrame, key: str, sample: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(sample).alias("samples")).where("samples > 1")


def deltas(df: DataFrame, key: str, sample: str, value: str) -> DataFrame:
    """Change of each key from one of its samples to the next."""
    order = W.partitionBy(key).orderBy(sample)
    found = df.select(key, sample, value, F.lead(sample).over(order).alias("next"), (F.lead(value).over(order) - F.col(value)).alias("delta"))
    return found.where(F.col("next").isNotNull())


def threshold_counts(changes: DataFrame, by: list[str], limits: dict[str, float]) -> DataFrame:
    """How many changes reach each limit, and the largest."""
    size = F.abs("delta")
    return changes.groupBy(*by).agg(*(F.count_if(size >= v).alias(n) for n, v in limits.items()), F.max(size).alias("largest"))


def next_matching(df: DataFrame, key: str, order: list[str], wanted: Column, value: str, slab: Column | None = None) -> DataFrame:
    """For each row the value of the next row of its key for which ``wanted`` holds, or null.

    ``slab`` cuts a key's order into stretches that tasks hold apart; it changes no result.
    """
    return scan.scan(df, [key], order, F.lit(0) if slab is None else slab, **{f"next_{value}": scan.following(F.when(wanted, F.col(value)))})


def all_out(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Keys that are out of tolerance wherever they were measured."""
    return df.groupBy(key).agg(F.bool_and(flag).alias("all_out"), F.count_if(flag).alias("out"))


def difference(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Each key of two sets: only in the first (resolved), in both (persisting), only in the second (new)."""
    a, b = (x.select(key).distinct().withColumn(n, F.lit(True)) for x, n in ((one, "a"), (two, "b")))
    state = F.when(F.col("b").isNull(), "resolved").when(F.col("a").isNull(), "new").otherwise("persisting")
    return a.join(b, key, "full").select(key, state.alias("state"))


def stale_copies(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups whose values are, in number and size, exactly another group's: (group, first of its copies)."""
    block = F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), "|"), 256)
    named = df.groupBy(group).agg(block.alias("block"))
    first = named.groupBy("block").agg(F.min(group).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return named.join(first, "block").select(group, "first", "n")
