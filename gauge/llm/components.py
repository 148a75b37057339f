"""Connected components of an undirected graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauge.llm.common import Tables


def components(links: DataFrame, tables: Tables | None = None, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(id, component) for every end of ``links`` (a, b): the smallest id that can be reached.

    A hub's neighbours are never gathered: each round only takes minima over them. Loops, repeated links
    and links in both directions are allowed; null ends are left out. The result reads the table ``name``.
    """
    tables = tables or Tables(links.sparkSession, "components")
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null").distinct()
    edges = tables.keep(name, edges)
    for _ in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.max("v").alias("most"))
        # done when an id that has a smaller neighbour has no other one
        if low.where("m < u and most > m").isEmpty():
            break
        large = both.join(low.drop("most"), "u").where(F.col("v") >= F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").distinct()
        edges = tables.keep(name, small)
    else:
        raise RuntimeError("components did not settle")
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("component")).withColumnRenamed("u", "id")


def extended(state: DataFrame, links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """Components (id, component) after further links (a, b); an id without a row stands for itself.

    Only links between different components count, so the rounds run over what is new.
    """
    one, two = (state.select(F.col("id").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
    ends = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    ends = tables.keep(f"{name}-ends", ends.distinct())
    if ends.isEmpty():
        tables.drop(f"{name}-ends")
        return state
    new = components(ends, tables, f"{name}-new").withColumnsRenamed({"id": "root", "component": "top"})
    moved = state.join(new, state["component"] == new["root"], "left").select("id", F.coalesce("top", "component").alias("component"))
    alone = new.join(state, new["root"] == state["id"], "left_anti").select(F.col("root").alias("id"), F.col("top").alias("component"))
    out = tables.keep(name, moved.union(alone))
    tables.drop(f"{name}-ends", f"{name}-new")
    return out
