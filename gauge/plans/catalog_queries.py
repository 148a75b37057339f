"""Queries on the knowledge base: parts stand for features, suppliers for parts, line items for assets and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from gauge.functions import names
from gauge.operators import catalog
from gauge.plans.measurements import table
from gauge.plans.registry import query
from gauge.sources import reports


def tables(spark, sf_dir) -> catalog.Catalog:
    part, supplier, nation, item = (table(spark, sf_dir, n) for n in ("part", "supplier", "nation", "lineitem"))
    brand = F.col("p_brand")
    feature = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("description"), F.when(F.col("p_size") % 5 != 0, brand).alias("category"), F.split("p_name", " ").alias("tags"), F.when(F.col("p_size") % 9 != 0, F.col("p_size")).alias("created_at"))
    code = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("code"), F.col("n_name").alias("name"))
    asset = item.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("feature_id"), F.when(F.col("l_linenumber") != 7, F.col("l_suppkey")).alias("part_id"), F.col("l_linestatus").alias("kind"), F.col("l_linenumber").alias("position"))
    link = item.where("l_returnflag = 'R' and l_quantity < 5").select(F.col("l_partkey").alias("feature_id"), F.col("l_suppkey").alias("part_id")).distinct()
    return catalog.Catalog(feature, code, asset, link)


T = """WITH feature AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 4 <> 0 THEN p_type END AS description, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS category, string_split(p_name, ' ') AS tags, CASE WHEN p_size % 9 <> 0 THEN p_size END AS created_at FROM part),
 code AS (SELECT s_suppkey AS id, s_name AS code, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 asset AS (SELECT l_orderkey AS id, l_partkey AS feature_id, CASE WHEN l_linenumber <> 7 THEN l_suppkey END AS part_id, l_linestatus AS kind, l_linenumber AS position FROM lineitem WHERE l_returnflag = 'A'),
 link AS (SELECT DISTINCT l_partkey AS feature_id, l_suppkey AS part_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 5)
"""
S = "SELECT id, name, description, category FROM feature WHERE "


def _shown(df):
    return df.select("id", "name", "description", "category")


def _q(q):
    like = lambda c: f"{c} ILIKE '%{q}%' ESCAPE '\\'"
    parts = f"(SELECT id FROM code WHERE {like('code')} OR {like('name')})"
    return f"({like('name')} OR {like('description')} OR {like("array_to_string(tags, ' ')")} OR id IN (SELECT feature_id FROM asset WHERE part_id IN {parts}) OR id IN (SELECT feature_id FROM link WHERE part_id IN {parts}))"


@query(T + S + _q("bolt"))
def f1_global_search(spark, sf_dir):
    return _shown(catalog.search(tables(spark, sf_dir), q="bolt"))


@query(T + S + _q("e r"))
def f2_tags_text(spark, sf_dir):
    return _shown(catalog.search(tables(spark, sf_dir), q="e r"))


@query(T + S + "category = 'Brand#3'")
def f3_category(spark, sf_dir):
    return _shown(catalog.search(tables(spark, sf_dir), category="Brand#3"))


@query(T + S + "list_contains(tags, 'small')")
def f4_tag(spark, sf_dir):
    return _shown(catalog.search(tables(spark, sf_dir), tag="small"))


@query(T + S + "id IN (SELECT feature_id FROM asset WHERE part_id = 3) OR id IN (SELECT feature_id FROM link WHERE part_id = 3)")
def f5_part(spark, sf_dir):
    return _shown(catalog.search(tables(spark, sf_dir), part=3))


@query(T + "SELECT count(*) AS total FROM feature WHERE list_contains(tags, 'small') AND " + _q("000"))
def f6_combined(spark, sf_dir):
    return catalog.total(catalog.search(tables(spark, sf_dir), q="000", tag="small"))


@query("SELECT o_orderkey, o_custkey AS owner_id FROM orders WHERE o_custkey = 7")
def f8_row_security(spark, sf_dir):
    return catalog.visible(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("owner_id")), 7, False)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 3")
def f10_lookup(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where("s_suppkey = 3").select("s_suppkey", "s_name").limit(1)


@query(T + "SELECT id FROM feature WHERE id IN (SELECT feature_id FROM asset WHERE part_id < 4) OR id IN (SELECT feature_id FROM link WHERE part_id < 4)")
def j1_disjunctive_in(spark, sf_dir):
    t = tables(spark, sf_dir)
    return t.feature.join(catalog.features_of(t, t.part.where("id < 4")), "id", "left_semi").select("id")


@query(T + "SELECT id FROM feature WHERE id IN (SELECT feature_id FROM asset WHERE part_id IN (SELECT id FROM code WHERE name ILIKE '%on\\_1%' ESCAPE '\\')) OR id IN (SELECT feature_id FROM link WHERE part_id IN (SELECT id FROM code WHERE name ILIKE '%on\\_1%' ESCAPE '\\'))")
def j2_nested_semi(spark, sf_dir):
    t = tables(spark, sf_dir)
    return t.feature.join(catalog.features_of(t, t.part.where(F.col("name").ilike("%on\\_1%"))), "id", "left_semi").select("id")


@query(T + "SELECT f.id, coalesce(a.s, '') AS assets, coalesce(l.s, '') AS parts FROM feature f LEFT JOIN (SELECT feature_id, string_agg(position || ':' || kind, ',' ORDER BY position, kind) AS s FROM asset GROUP BY 1) a ON f.id = a.feature_id LEFT JOIN (SELECT feature_id, string_agg(code.code, ',' ORDER BY code.code) AS s FROM link JOIN code ON part_id = code.id GROUP BY 1) l ON f.id = l.feature_id")
def j4_nested_children(spark, sf_dir):
    t = tables(spark, sf_dir)
    n = catalog.nested(t.feature, t)
    return n.select("id", F.array_join(F.transform("assets", lambda a: F.concat_ws(":", a["position"], a["kind"])), ",").alias("assets"), F.array_join(F.transform("parts", lambda p: p["code"]), ",").alias("parts"))


@query(T + "SELECT feature.id, code.code FROM feature JOIN link ON feature.id = link.feature_id JOIN code ON link.part_id = code.id")
def j5_many_to_many(spark, sf_dir):
    t = tables(spark, sf_dir)
    return t.feature.select("id").join(t.link, F.col("id") == F.col("feature_id")).join(t.part.select(F.col("id").alias("part_id"), "code"), "part_id").select("id", "code")


@query("SELECT l_orderkey, l_linenumber, coalesce(p_name, 'unknown') AS lot FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey")
def j7_lookup_default(spark, sf_dir):
    lots = table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return table(spark, sf_dir, "lineitem").join(lots, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.lit("unknown")).alias("lot"))


@query("SELECT count(*) AS total FROM customer")
def a1_count(spark, sf_dir):
    return catalog.total(table(spark, sf_dir, "customer"))


@query(T + "SELECT count(*) AS total FROM feature WHERE " + _q("ring"))
def a2_total(spark, sf_dir):
    return catalog.total(catalog.search(tables(spark, sf_dir), q="ring"))


@query(T + "SELECT DISTINCT category FROM feature WHERE category IS NOT NULL ORDER BY 1")
def a3_categories(spark, sf_dir):
    return catalog.categories(tables(spark, sf_dir)).orderBy("category")


@query(T + "SELECT DISTINCT unnest(tags) AS tag FROM feature ORDER BY 1")
def a4_tags(spark, sf_dir):
    return catalog.all_tags(tables(spark, sf_dir)).orderBy("tag")


@query(T + ", c AS (SELECT part_id, count(*) FILTER (kind = 'F') AS \"F\", count(*) FILTER (kind = 'O') AS \"O\" FROM asset GROUP BY 1) SELECT code.id AS part_id, coalesce(\"F\", 0) AS \"F\", coalesce(\"O\", 0) AS \"O\", coalesce(\"F\" + \"O\", 0) AS total FROM code LEFT JOIN c ON code.id = c.part_id UNION ALL SELECT NULL, \"F\", \"O\", \"F\" + \"O\" FROM c WHERE part_id IS NULL")
def a11_matrix(spark, sf_dir):
    return catalog.matrix(tables(spark, sf_dir), ["F", "O"])


@query(T + "SELECT (SELECT count(*) FROM code) AS parts, (SELECT count(*) FROM asset) AS files")
def a12_totals(spark, sf_dir):
    m = catalog.matrix(tables(spark, sf_dir), ["F", "O"])
    return m.agg(F.count("part_id").alias("parts"), F.sum("total").cast("long").alias("files"))


@query(T + "SELECT id, created_at FROM feature ORDER BY created_at DESC NULLS FIRST, id LIMIT 5")
def l1_recent(spark, sf_dir):
    return catalog.page(tables(spark, sf_dir).feature, limit=5).select("id", "created_at")


@query(T + "SELECT id, code FROM code ORDER BY code")
def l2_by_code(spark, sf_dir):
    return tables(spark, sf_dir).part.select("id", "code").orderBy("code")


@query(T + "SELECT id, created_at FROM feature ORDER BY created_at DESC NULLS FIRST, id LIMIT 50 OFFSET 20")
def l3_page(spark, sf_dir):
    return catalog.page(tables(spark, sf_dir).feature, 20, 50).select("id", "created_at")


@query("SELECT c, row_number() OVER (ORDER BY TRY_CAST(c AS BIGINT) NULLS LAST, c) AS place FROM (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS c FROM part)")
def l10_numeric_code(spark, sf_dir):
    codes = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string")).alias("c")).distinct()
    return catalog.numbered(codes, names.code_order(F.col("c"))).select("c", "place")


@query(T + ", s AS (SELECT feature_id, list_sort(list(part_id)) AS ids FROM link GROUP BY 1) SELECT feature_id, array_to_string(ids[1:3], ',') AS first_codes, greatest(len(ids) - 3, 0) AS more FROM s")
def l11_first_codes(spark, sf_dir):
    ids = tables(spark, sf_dir).link.groupBy("feature_id").agg(F.array_sort(F.collect_list("part_id")).alias("ids"))
    return ids.select("feature_id", F.array_join(F.slice("ids", 1, 3), ",").alias("first_codes"), F.greatest(F.size("ids") - 3, F.lit(0)).cast("long").alias("more"))


@query(T + "SELECT feature_id, part_id, CASE WHEN min(rank) = 0 THEN 'asset' ELSE 'link' END AS origin FROM (SELECT feature_id, part_id, 0 AS rank FROM asset WHERE part_id IS NOT NULL UNION ALL SELECT feature_id, part_id, 1 FROM link) GROUP BY 1, 2")
def u1_union_parts(spark, sf_dir):
    return catalog.union_parts(tables(spark, sf_dir))


@query(T + "SELECT id, code FROM code WHERE id IN (SELECT part_id FROM asset) OR id IN (SELECT part_id FROM link)")
def u2_used_parts(spark, sf_dir):
    return catalog.used_parts(tables(spark, sf_dir)).select("id", "code")


@query("SELECT p_partkey, CASE WHEN coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END, ''), '') <> '' THEN p_brand || ' - ' || p_name ELSE p_brand END AS label FROM part")
def p18_label(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.part_label(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("")).alias("label"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', ' ,, '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM part")
def p19_parse_tags(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names.tags(F.replace("p_name", F.lit(" "), F.lit(" ,, "))), "|").alias("tags"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE CAST(floor(n_chars / 1024 + 0.5) AS BIGINT) || ' KB' END AS size FROM documents")
def p33_file_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", names.file_size(F.col("n_chars")).alias("size"))


@query("SELECT p_partkey, upper(array_to_string(list_transform(string_split(p_name, ' ')[1:2], lambda w: w[1]), '')) AS initials FROM part")
def p33_initials(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.initials(F.col("p_name")).alias("initials"))


@query("SELECT p_partkey AS id, p_name AS name FROM part UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier")
def m1_insert(spark, sf_dir):
    """Suppliers are new, whatever numbers parts have: a key is the kind and the number. Three parts are there already."""
    have = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    new = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), (F.col("s_suppkey") + 1000000).alias("id"), F.col("s_name").alias("name"))
    return catalog.insert_new(have, new.union(have.limit(3)), "kind", "id").select("id", "name")


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 1 THEN 'new' ELSE p_name END AS p_name, CASE WHEN p_partkey % 10 < 2 THEN NULL ELSE p_brand END AS p_brand FROM part")
def m2_partial_update(spark, sf_dir):
    have = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    sets = F.when(F.col("p_partkey") % 10 == 1, F.array(F.lit("p_name"), F.lit("p_brand"))).otherwise(F.array(F.lit("p_brand")))
    changes = have.where("p_partkey % 10 < 2").select("p_partkey", sets.alias("set"), F.lit("new").alias("p_name"), F.lit(None).cast("string").alias("p_brand"))
    return catalog.update(have, "p_partkey", changes)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)")
def m3_unique(spark, sf_dir):
    have, new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey")), table(spark, sf_dir, "customer").select("c_custkey")
    return catalog.conflicts(have, new, "c_custkey")


@query(T + "SELECT feature_id, part_id FROM link WHERE feature_id % 2 = 0 UNION SELECT id, 1 FROM feature WHERE id % 2 = 0")
def m4_link(spark, sf_dir):
    """Links every feature with the first part, again where it has that link, and unlinks those with odd ids."""
    t = tables(spark, sf_dir)
    first = t.feature.select(F.col("id").alias("feature_id"), F.lit(1).cast("long").alias("part_id"))
    added = catalog.link(t.link, first)
    return catalog.unlink(added, added.where("feature_id % 2 = 1"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def m5_cascade(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return catalog.delete(item, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_orderkey", "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey END AS l_suppkey FROM lineitem")
def m6_set_null(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    gone = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0")
    all_ids = item.select(F.col("l_suppkey").alias("s_suppkey")).where("s_suppkey % 4 = 0").union(gone.select("s_suppkey"))
    return catalog.set_null(item, "l_suppkey", all_ids, "s_suppkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def m7_referential(spark, sf_dir):
    return catalog.unknown(table(spark, sf_dir, "lineitem"), "l_partkey", table(spark, sf_dir, "part").where("p_size < 40"), "p_partkey").select("l_orderkey", "l_linenumber")


@query("WITH o AS (SELECT l_orderkey AS id, l_orderkey * 10 AS n FROM lineitem GROUP BY 1), c AS (SELECT l_partkey AS key, l_suppkey AS value, count(*) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2) SELECT key, value, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, first, value) AS r FROM c) WHERE r = 1")
def a13_mode(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("value"), "l_orderkey")
    return catalog.most_common(item, "key", "value", "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, 'S' || s.s_suppkey AS l_suppkey FROM lineitem LEFT JOIN supplier s ON l_suppkey = s.s_suppkey")
def j8_key_remap(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("new"))
    return catalog.remapped(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", keys, "s_suppkey", "new")


@query("SELECT l_orderkey, l_linenumber, trim(p_brand || ' ' || coalesce(p_name, '')) AS part_ref FROM lineitem JOIN part ON l_partkey = p_partkey")
def j10_update_from(spark, sf_dir):
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), names.rebuilt_reference(F.col("p_brand"), F.col("p_name")).alias("part_ref"))
    return table(spark, sf_dir, "lineitem").join(named, "l_partkey").select("l_orderkey", "l_linenumber", "part_ref")


@query(T + S + _q("l_%"))
def f1_wildcards(spark, sf_dir):
    return _shown(catalog.search(tables(spark, sf_dir), q="l_%"))


@query(T + S + _q("N\\_2"))
def f1_escaped(spark, sf_dir):
    return _shown(catalog.search(tables(spark, sf_dir), q="N\\_2"))


@query("SELECT o_orderkey, o_custkey AS owner_id FROM orders")
def f8_superuser(spark, sf_dir):
    return catalog.visible(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("owner_id")), 7, True)


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_custkey END = 7, false) AS mine FROM orders")
def f9_ownership(spark, sf_dir):
    owner = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", catalog.may_change(owner, 7, False).alias("mine"))


@query(T + "SELECT feature_id, position FROM asset WHERE kind = 'O'")
def f12_kind(spark, sf_dir):
    return catalog.of_kind(tables(spark, sf_dir).asset, "O").select("feature_id", "position")


@query(T + ", d AS (SELECT feature_id, part_id FROM link UNION SELECT feature_id, part_id FROM asset WHERE part_id IS NOT NULL) SELECT d.feature_id, d.part_id, count(asset.feature_id) AS files FROM d LEFT JOIN asset ON d.feature_id = asset.feature_id AND d.part_id = asset.part_id GROUP BY 1, 2")
def a12_files_of_parts(spark, sf_dir):
    return catalog.files_of_parts(tables(spark, sf_dir))


@query("SELECT p_partkey, substr(p_type || ' ' || p_name || ' of the ' || p_brand || ' line, made to order and tested', 1, 60) AS label FROM part")
def p16_shortened(spark, sf_dir):
    text = F.concat_ws(" ", "p_type", "p_name", F.lit("of the"), "p_brand", F.lit("line, made to order and tested"))
    return table(spark, sf_dir, "part").select("p_partkey", names.shortened(text).alias("label"))


@query("SELECT c_custkey AS id, c_name AS full_name, c_custkey = 7 AS is_current_user FROM customer")
def p17_public(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("hashed_password"))
    return catalog.public(users, me=7)


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_name END, ''), 'N/A') AS shown FROM part")
def p20_defaults(spark, sf_dir):
    text = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", names.or_else(text, "N/A").alias("shown"))


@query("SELECT p_partkey, nullif(CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END, '') AS q, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN p_brand END AS category FROM part")
def p21_parameters(spark, sf_dir):
    size = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("")
    known = F.when(names.given(F.col("p_brand")).isin("Brand#1", "Brand#2"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", names.given(size).alias("q"), known.alias("category"))


@query("SELECT p_partkey, trim(p_brand || ' ') AS code, nullif(trim(CASE WHEN p_size % 2 = 0 THEN ' ' || p_name ELSE '  ' END), '') AS name FROM part")
def p34_new_part(spark, sf_dir):
    typed = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise("  ")
    code, name = names.new_part(F.concat("p_brand", F.lit(" ")), typed)
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), name.alias("name"))


@query("WITH f AS (SELECT p_partkey AS id, unnest([CAST(p_size AS VARCHAR), CAST(p_size + 1 AS VARCHAR)]) AS nr FROM part) SELECT f.id, f.nr, l_orderkey, l_linenumber FROM f JOIN lineitem ON CAST(CAST(l_quantity AS INT) AS VARCHAR) = f.nr")
def j14_features_by_number(spark, sf_dir):
    """Every part beside all line items of the quantities that its size and the next one name: many to many."""
    features = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string")).alias("n_numbers"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").cast("string").alias("nr"), "l_orderkey", "l_linenumber")
    return reports.of_dimensions(features, rows)


@query("SELECT o_orderkey AS path, CAST(o_custkey AS VARCHAR) AS lot, event_id AS sample FROM orders JOIN events ON o_custkey = user_id AND event_type = 'purchase'")
def j16_lots(spark, sf_dir):
    """Orders as scans and purchases as samples of a customer's lot."""
    scans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").cast("string").alias("lot"))
    samples = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("sample"), F.col("user_id").cast("string").alias("lot"))
    return reports.of_lots(scans, samples).select("path", "lot", "sample")


CODES = "SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN upper(p_brand) ELSE p_brand END || '-' || CASE WHEN p_size % 3 = 0 THEN '0' ELSE '' END || p_size || p_name[1:3] AS code FROM part"
RUNS = "array_to_string(list_transform(regexp_extract_all(lower(code), '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN chr(1) || lpad(CAST(len(ltrim(r, '0')) AS VARCHAR), 4, '0') || ltrim(r, '0') ELSE r END), '')"


@query(f"SELECT code, row_number() OVER (ORDER BY {RUNS}, code) AS place FROM ({CODES})")
def l10_natural(spark, sf_dir):
    """Codes of brands, sizes and names by the value of the numbers in them."""
    size, brand = F.col("p_size"), F.when(F.col("p_size") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    code = F.concat(brand, F.lit("-"), F.when(size % 3 == 0, "0").otherwise(""), size.cast("string"), F.substring("p_name", 1, 3))
    codes = table(spark, sf_dir, "part").select(code.alias("code")).distinct()
    return catalog.numbered(codes, [names.natural_key(F.col("code")), F.col("code")]).select("code", "place")


@query("WITH t AS (SELECT DISTINCT unnest(regexp_split_to_array(text[1:200], '[^\\p{L}]+')) AS t FROM documents) SELECT t, row_number() OVER (ORDER BY t COLLATE en, t) AS place, count(*) OVER (PARTITION BY lower(t)) AS alike FROM t WHERE t <> ''")
def l2_collated(spark, sf_dir):
    """The first words of texts in four languages, by a collation; and how many differ in case alone."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.left("text", F.lit(200)), r"[^\p{L}]+")).alias("t")).where("t <> ''").distinct()
    return catalog.collated(words, "t")


GONE = "WITH c AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)) "
REFERENCES = [
    catalog.Reference("orders", "o_custkey", "customer", "c_custkey", "cascade"),
    catalog.Reference("lineitem", "l_orderkey", "orders", "o_orderkey", "cascade"),
    catalog.Reference("lineitem", "l_partkey", "part", "p_partkey", "cascade"),
    catalog.Reference("events", "user_id", "customer", "c_custkey", "null"),
]


def without_builders(spark, sf_dir):
    all_ = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "events", "part")}
    return catalog.delete_through(all_, REFERENCES, "customer", F.col("c_mktsegment") == "BUILDING")


@query(GONE + "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM c)")
def m5_graph_customers(spark, sf_dir):
    return without_builders(spark, sf_dir)["customer"].select("c_custkey")


@query(GONE + "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)")
def m5_graph_orders(spark, sf_dir):
    return without_builders(spark, sf_dir)["orders"].select("o_orderkey", "o_custkey")


@query(GONE + "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)")
def m5_graph_items(spark, sf_dir):
    return without_builders(spark, sf_dir)["lineitem"].select("l_orderkey", "l_linenumber", "l_quantity")


@query(GONE + "SELECT event_id, CASE WHEN user_id NOT IN (SELECT c_custkey FROM c) THEN user_id END AS user_id FROM events")
def m6_graph_events(spark, sf_dir):
    return without_builders(spark, sf_dir)["events"].select("event_id", "user_id")


@query(T + ", c AS (SELECT part_id, list(feature_id || ':' || position ORDER BY feature_id, position) FILTER (kind = 'F') AS f, list(feature_id || ':' || position ORDER BY feature_id, position) FILTER (kind = 'O') AS o, count(*) FILTER (kind IN ('F', 'O')) AS total FROM asset GROUP BY 1) SELECT code.id AS part_id, coalesce(array_to_string(f, ','), '') AS \"F\", coalesce(array_to_string(o, ','), '') AS \"O\", coalesce(total, 0) AS total FROM code LEFT JOIN c ON code.id = c.part_id UNION ALL SELECT NULL, coalesce(array_to_string(f, ','), ''), coalesce(array_to_string(o, ','), ''), total FROM c WHERE part_id IS NULL")
def a11_file_matrix(spark, sf_dir):
    """The files themselves, by part and kind."""
    m = catalog.file_matrix(tables(spark, sf_dir), ["F", "O"])
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["feature_id"], x["position"])), ",").alias(c)
    return m.select("part_id", told("F"), told("O"), F.col("total").cast("long").alias("total"))
