"""The knowledge base: search with composable conditions, pages with totals, nested documents, snapshots.

Tables: ``feature`` (id, name, description, category, tags, created_at), ``part`` (id, code, name), ``asset``
(id, feature_id, part_id, kind, position) and ``link`` (feature_id, part_id). Mutations are functions from
tables to tables: files are immutable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gauge.sources.folders import cut


@dataclass
class Catalog:
    feature: DataFrame
    part: DataFrame
    asset: DataFrame
    link: DataFrame


def pattern(text: str) -> str:
    """A contains-pattern: ``%`` and ``_`` stay wildcards, a backslash counts only before one of them or itself."""
    out, i = [], 0
    while i < len(text):
        if text[i] == "\\":
            if i + 1 < len(text) and text[i + 1] in "%_\\":
                out.append(text[i : i + 2])
                i += 2
                continue
            i += 1
            continue
        out.append(text[i])
        i += 1
    return f"%{''.join(out)}%"


def _like(column: Column, text: str) -> Column:
    return F.coalesce(column.ilike(pattern(text)), F.lit(False))


def features_of(tables: Catalog, parts: DataFrame) -> DataFrame:
    """Ids of features that have one of the parts by an asset or by a link, each once."""
    ids = parts.select(F.col("id").alias("part_id"))
    used = tables.asset.select("feature_id", "part_id").unionByName(tables.link.select("feature_id", "part_id"))
    return used.join(ids, "part_id", "left_semi").select(F.col("feature_id").alias("id")).distinct()


def search(tables: Catalog, q: str | None = None, category: str | None = None, tag: str | None = None, part: object = None) -> DataFrame:
    """Features that meet all conditions given; ``q`` looks in name, description, tags, and codes and names of parts."""
    found = tables.feature
    if category is not None:
        found = found.where(F.col("category") == category)
    if tag is not None:
        found = found.where(F.array_contains("tags", tag))
    if part is not None:
        found = found.join(features_of(tables, tables.part.where(F.col("id") == part)), "id", "left_semi")
    if q:
        parts = tables.part.where(_like(F.col("code"), q) | _like(F.col("name"), q))
        hit = features_of(tables, parts).withColumn("hit", F.lit(True))
        own = _like(F.col("name"), q) | _like(F.col("description"), q) | _like(F.array_join("tags", " "), q)
        found = found.join(hit, "id", "left").where(own | F.col("hit").isNotNull()).drop("hit")
    return found


def page(found: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """Newest first, null dates before all, ties by id."""
    return found.orderBy(F.col("created_at").desc_nulls_first(), "id").offset(skip).limit(limit)


def total(found: DataFrame) -> DataFrame:
    """The number of rows that meet the conditions, whatever page is shown."""
    return found.agg(F.count(F.lit(1)).alias("total"))


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in an order without ties: counted in ranges of it, so no task orders all rows."""
    # ranges come from a sample that is drawn anew each time, so what is read twice is kept
    parts = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    within = F.col("_row") - F.shiftleft(F.col("_part").cast("long"), 33) + 1
    parts = parts.withColumn("_within", within)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row a range
    ahead = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    return parts.join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + F.col("_within")).drop("_part", "_row", "_within", "_ahead")


def collated(rows: DataFrame, column: str, order: str = "UNICODE", same: str = "UTF8_LCASE") -> DataFrame:
    """Distinct texts with their place by a collation, ties by their bytes, and how many another collation takes as equal to each."""
    placed = numbered(rows.select(column), [F.collate(column, order), F.col(column)])
    alike = rows.groupBy(F.collate(column, same).alias("_same")).agg(F.count(F.lit(1)).alias("alike"))
    return placed.join(alike, F.collate(column, same) == F.col("_same")).select(column, "place", "alike")


def nested(features: DataFrame, tables: Catalog) -> DataFrame:
    """Features with arrays of their assets in position order and of their linked parts in code order."""
    assets = tables.asset.groupBy(F.col("feature_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("position", "kind", "part_id"))).alias("assets"))
    parts = tables.link.join(tables.part.withColumnRenamed("id", "part_id"), "part_id").groupBy(F.col("feature_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("code", "part_id"))).alias("parts"))
    out = features.join(assets, "id", "left").join(parts, "id", "left")
    empty = {c: F.coalesce(c, F.array().cast(dict(out.dtypes)[c])) for c in ("assets", "parts")}
    return out.withColumns(empty)


def categories(tables: Catalog) -> DataFrame:
    return tables.feature.where("category is not null").select("category").distinct()


def all_tags(tables: Catalog) -> DataFrame:
    return tables.feature.select(F.explode("tags").alias("tag")).distinct()


def used_parts(tables: Catalog) -> DataFrame:
    """Parts that some asset or link has."""
    used = tables.asset.where("part_id is not null").select("part_id").union(tables.link.select("part_id")).distinct()
    return tables.part.join(used.withColumnRenamed("part_id", "id"), "id", "left_semi")


def union_parts(tables: Catalog) -> DataFrame:
    """Parts of each feature, once each; one that an asset has counts as the asset's."""
    both = tables.asset.where("part_id is not null").select("feature_id", "part_id", F.lit(0).alias("rank")).union(tables.link.select("feature_id", "part_id", F.lit(1)))
    best = both.groupBy("feature_id", "part_id").agg(F.min("rank").alias("rank"))
    return best.select("feature_id", "part_id", F.when(F.col("rank") == 0, "asset").otherwise("link").alias("origin"))


def matrix(tables: Catalog, kinds: list[str]) -> DataFrame:
    """Numbers of assets by part and kind; parts without assets stay, and assets without a part are one more row."""
    counted = tables.asset.groupBy("part_id").pivot("kind", kinds).agg(F.count(F.lit(1)))
    rows = tables.part.select(F.col("id").alias("part_id")).join(counted, "part_id", "left").unionByName(counted.where("part_id is null"))
    filled = rows.select("part_id", *(F.coalesce(F.col(k), F.lit(0)).alias(k) for k in kinds))
    return filled.withColumn("total", sum((F.col(k) for k in kinds), F.lit(0)))


def file_matrix(tables: Catalog, kinds: list[str]) -> DataFrame:
    """Lists of assets (feature_id, position) by part and kind, in order, with their number; parts without assets, and assets without a part as one more row."""
    files = F.array_sort(F.collect_list(F.struct("feature_id", "position")))
    listed = tables.asset.groupBy("part_id").pivot("kind", kinds).agg(files)
    rows = tables.part.select(F.col("id").alias("part_id")).join(listed, "part_id", "left").unionByName(listed.where("part_id is null"))
    filled = rows.select("part_id", *(F.coalesce(F.col(k), F.array().cast(dict(listed.dtypes)[k])).alias(k) for k in kinds))
    return filled.withColumn("total", sum((F.size(k) for k in kinds), F.lit(0)))


def visible(items: DataFrame, user: object, superuser: bool) -> DataFrame:
    """What a user may see: all, or only their own."""
    return items if superuser else items.where(F.col("owner_id") == user)


def may_change(item_owner: Column, user: object, superuser: bool) -> Column:
    """Whether a user may read, change or delete an item: its owner, or a superuser; nobody else owns one without owner."""
    return F.lit(True) if superuser else F.coalesce(item_owner == user, F.lit(False))


def public(users: DataFrame, secret: tuple[str, ...] = ("hashed_password",), me: object = None) -> DataFrame:
    """Users without what must not be shown, and which of them is the one who asks."""
    return users.drop(*secret).withColumn("is_current_user", F.col("id").eqNullSafe(F.lit(me)))


def of_kind(children: DataFrame, kind: str) -> DataFrame:
    return children.where(F.col("kind") == kind)


def files_of_parts(tables: Catalog) -> DataFrame:
    """Number of assets of each part of each feature, parts without any included."""
    declared = tables.link.select("feature_id", "part_id").union(tables.asset.where("part_id is not null").select("feature_id", "part_id")).distinct()
    counted = tables.asset.where("part_id is not null").groupBy("feature_id", "part_id").agg(F.count(F.lit(1)).alias("n"))
    return declared.join(counted, ["feature_id", "part_id"], "left").select("feature_id", "part_id", F.coalesce("n", F.lit(0)).alias("files"))


def insert_new(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """The table with the rows whose key, of one column or more, it lacks; of equal new keys one is added."""
    return table.unionByName(rows.dropDuplicates([*key]).join(table.select(*key), [*key], "left_anti").select(*table.columns))


def update(table: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """Sets the columns of ``changes`` (key, column names in ``set``, values); what is not named stays, null clears."""
    new = changes.select(F.col(key).alias("_key"), F.col("set").alias("_set"), *(F.col(c).alias(f"_{c}") for c in changes.columns if c not in (key, "set")))
    joined = table.join(new, F.col(key) == F.col("_key"), "left")
    put = [F.when(F.coalesce(F.array_contains("_set", c), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if f"_{c}" in new.columns and c != key else F.col(c) for c in table.columns]
    return joined.select(*put)


def conflicts(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """New rows whose unique key is taken."""
    return rows.join(table.select(key), key, "left_semi")


def unknown(rows: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """Rows that refer to nothing in the table; a null refers to nothing and is allowed."""
    return rows.where(F.col(key).isNotNull()).join(table.select(F.col(table_key).alias(key)), key, "left_anti")


def link(links: DataFrame, new: DataFrame) -> DataFrame:
    return links.unionByName(new).dropDuplicates()


def unlink(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone, links.columns, "left_anti")


def delete(table: DataFrame, gone: DataFrame, key: str, foreign: str | None = None) -> DataFrame:
    """Rows left after the rows with these keys go, in the table itself or in one that refers to it and goes too."""
    on = foreign or key
    return table.join(gone.select(F.col(key).alias(on)), on, "left_anti").select(*table.columns)


def set_null(table: DataFrame, foreign: str, gone: DataFrame, key: str) -> DataFrame:
    """All rows, with references to what goes set to null."""
    lost = gone.select(F.col(key).alias("_lost")).distinct()
    out = table.join(lost, F.col(foreign) == F.col("_lost"), "left")
    return out.select(*(F.when(F.col("_lost").isNull(), F.col(c)).alias(c) if c == foreign else F.col(c) for c in table.columns))


@dataclass(frozen=True)
class Reference:
    """Rows of ``child`` refer by ``column`` to the ``key`` of ``parent``: when that goes, they go (``cascade``) or lose the reference (``null``)."""

    child: str
    column: str
    parent: str
    key: str
    rule: str


def deletion_order(references: list[Reference], start: str) -> list[str]:
    """The tables that a deletion from ``start`` reaches, each after all that it depends on; a cycle of them is an error."""
    reached, todo = {start}, [start]
    while todo:
        now = todo.pop()
        for r in references:
            if r.parent == now and r.child not in reached:
                reached.add(r.child)
                if r.rule == "cascade":
                    todo.append(r.child)
    out: list[str] = []
    while len(out) < len(reached):
        ready = sorted(t for t in reached - set(out) if all(r.parent in out or r.parent not in reached for r in references if r.child == t))
        if not ready:
            raise ValueError(f"tables refer to one another in a cycle: {sorted(reached - set(out))}")
        out += ready
    return out


def delete_through(tables: dict[str, DataFrame], references: list[Reference], start: str, gone: Column) -> dict[str, DataFrame]:
    """All tables after the rows of ``start`` for which ``gone`` holds are deleted, with what their references ask for."""
    for r in references:
        if r.rule not in ("cascade", "null"):
            raise ValueError(f"no rule is called {r.rule}")
    out, lost = dict(tables), {}
    for name in deletion_order(references, start):
        rows, columns = tables[name], tables[name].columns
        flag = F.coalesce(gone, F.lit(False)) if name == start else F.lit(False)
        rows = rows.withColumn("_gone", flag)
        values: dict[str, Column] = {}
        for i, r in enumerate(r for r in references if r.child == name and r.parent in lost):
            keys = lost[r.parent].select(F.col(r.key).alias(f"_key{i}")).where(F.col(f"_key{i}").isNotNull()).distinct()
            rows = rows.join(keys, F.col(r.column) == F.col(f"_key{i}"), "left")
            hit = F.col(f"_key{i}").isNotNull()
            if r.rule == "cascade":
                rows = rows.withColumn("_gone", F.col("_gone") | hit)
            else:
                values[r.column] = F.when(hit, F.lit(None)).otherwise(values.get(r.column, F.col(r.column)))
        lost[name] = rows.where("_gone").select(*columns)
        out[name] = rows.where("not _gone").select(*(values[c].alias(c) if c in values else F.col(c) for c in columns))
    return out


def remapped(table: DataFrame, foreign: str, keys: DataFrame, old: str, new: str) -> DataFrame:
    """References replaced by new keys; null where there is none."""
    found = keys.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return table.join(found, F.col(foreign) == F.col("_old"), "left").select(*(F.col("_new").alias(c) if c == foreign else F.col(c) for c in table.columns))


def most_common(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the one seen first, then the smaller."""
    counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counted.groupBy(key).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), "first", value)).alias("b"))
    return best.select(key, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n"))


def backfilled(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts from the free references of old assets (id, name, kind, part_ref), and the assets that refer to them.

    Parts are known by code; the id is the code. A part's name is the most common rest of its references.
    """
    from gauge.functions import names

    code, rest = names.split_reference(F.col("part_ref"))
    split = assets.withColumns({"code": F.when(F.trim("part_ref") != "", code), "rest": F.when(F.trim("part_ref") != "", rest)})
    named = most_common(split.where("code is not null and rest <> ''"), "code", "rest", "id").select("code", F.col("rest").alias("chosen"))
    parts = split.where("code is not null").select("code").distinct().join(named, "code", "left").select(F.substring("code", 1, 64).alias("code"), F.substring("chosen", 1, 255).alias("name"))
    told = F.when(F.col("code").isNull(), F.col("name")).otherwise(names.with_rest(F.col("name"), F.col("rest"), F.col("chosen")))
    moved = split.join(named, "code", "left").select("id", told.alias("name"), names.reclassified(F.col("kind"), told).alias("kind"), F.col("code").alias("part_code"))
    return parts, moved
