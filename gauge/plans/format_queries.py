"""Queries on names, lines, cells and slides in the formats' shape, made from rows of the given tables.

The SQL states what is to be found from the parts that a name or line was made of, not by taking it apart.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gauge.functions import names
from gauge.operators import catalog, search
from gauge.plans.measurements import table
from gauge.plans.registry import query
from gauge.sources import reports

# files: one a part, in six shapes of path
FILES = """WITH p AS (SELECT p_partkey AS k, p_size AS s, 12 + p_size % 6 AS c, p_partkey % 6 AS shape FROM part), f AS (SELECT *,
 CASE shape WHEN 0 THEN 'r/support intern.' || (s % 12) || '/3212_' || CASE WHEN s % 10 = 0 THEN 'totes' ELSE 'c' || c END || '.csv' WHEN 1 THEN 'r/support.intern.0' || (s % 10) || '/' || c || '_3212.csv' WHEN 2 THEN 'r/none/c' || c || '/3212_Cav_.txt'
  WHEN 3 THEN 'r/INTERN ' || s || '/PUNTS_NOUS_c' || c || '.txt' WHEN 4 THEN 'r/intern.5/Cav_' || c || '/punts.txt' ELSE 'r/intern.7/C' || c || '/PA_' || s || '.pdf' END AS path,
 CASE shape WHEN 0 THEN lpad(CAST(s % 12 AS VARCHAR), 2, '0') WHEN 1 THEN '0' || (s % 10) WHEN 2 THEN '??' WHEN 3 THEN lpad(CAST(s AS VARCHAR), 2, '0') WHEN 4 THEN '05' ELSE '07' END AS sample,
 shape = 0 AND s % 10 = 0 AS totes, CASE WHEN c BETWEEN 13 AND 16 AND NOT (shape = 0 AND s % 10 = 0) THEN 'c' || c END AS cavity, CASE shape WHEN 3 THEN 'nous' WHEN 4 THEN 'punts' ELSE 'perfil' END AS family FROM p) """


def paths(spark, sf_dir):
    """A path a part. The table is few bytes a row, so it is read in few partitions: paths are dealt to all cores before they are taken apart."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"), (12 + F.col("p_size") % 6).alias("c"), (F.col("p_partkey") % 6).alias("shape"))
    s, c, said = F.col("s"), F.col("c").cast("string"), lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    stem = F.when(s % 10 == 0, "totes").otherwise(said("c", c))
    made = [said("r/support intern.", s % 12, "/3212_", stem, ".csv"), said("r/support.intern.0", s % 10, "/", c, "_3212.csv"), said("r/none/c", c, "/3212_Cav_.txt"), said("r/INTERN ", s, "/PUNTS_NOUS_c", c, ".txt"), said("r/intern.5/Cav_", c, "/punts.txt"), said("r/intern.7/C", c, "/PA_", s, ".pdf")]
    return part.select("k", "s", "c", F.element_at(F.array(*made), (F.col("shape") + 1).cast("int")).alias("path"), F.lit(1).alias("length"), F.lit(b"x").alias("content")).repartition(2 * spark.sparkContext.defaultParallelism)


@query(FILES + "SELECT k, path, sample FROM f")
def p1_sample(spark, sf_dir):
    return paths(spark, sf_dir).select("k", "path", names.sample_number(F.col("path")).alias("sample"))


def _cavities(spark, sf_dir, kind):
    return paths(spark, sf_dir).select("k", "path", names.cavity(F.col("path"), kind).alias("cavity"))


@query(FILES + "SELECT k, path, CASE WHEN shape <> 4 THEN cavity END AS cavity FROM f")
def p2_cavity_csv(spark, sf_dir):
    return _cavities(spark, sf_dir, "report")


@query(FILES + "SELECT k, path, cavity FROM f")
def p2_cavity_txt(spark, sf_dir):
    return _cavities(spark, sf_dir, "cloud")


@query(FILES + "SELECT k, path, cavity FROM f")
def p2_cavity_pdf(spark, sf_dir):
    return _cavities(spark, sf_dir, "contour")


@query(FILES + "SELECT k, path, family FROM f")
def p3_family(spark, sf_dir):
    return paths(spark, sf_dir).select("k", "path", names.family(F.col("path")).alias("family"))


@query(FILES + ", g AS (SELECT *, CASE WHEN totes THEN 'all cavities' WHEN cavity IS NULL OR shape = 4 THEN 'no cavity' END AS reason FROM f) SELECT path, CASE WHEN reason IS NULL THEN sample END AS sample, CASE WHEN reason IS NULL THEN cavity END AS cavity, reason FROM g")
def s2_reports(spark, sf_dir):
    found = paths(spark, sf_dir)
    kept = reports.discover_reports(found).select("path", "sample", "cavity", F.lit(None).cast("string").alias("reason"))
    return kept.union(reports.skipped_reports(found).select("path", F.lit(None), F.lit(None), "reason"))


@query(FILES + "SELECT path, sample, cavity, family, CASE family WHEN 'perfil' THEN 0 WHEN 'punts' THEN 1 ELSE 2 END AS rank FROM f WHERE cavity IS NOT NULL")
def s3_clouds(spark, sf_dir):
    return reports.discover_clouds(paths(spark, sf_dir)).select("path", "sample", "cavity", "family", "rank")


@query(FILES + "SELECT path, sample FROM f WHERE family = 'punts' AND cavity IN ('c15', 'c16')")
def f7_chosen(spark, sf_dir):
    return reports.chosen(reports.discover_clouds(paths(spark, sf_dir)), ["1", "5"], ["C15", "c16"], "punts").select("path", "sample")


@query(FILES + "SELECT path, sample, cavity, 'PA_' || s AS element FROM f WHERE shape = 5")
def s4_contours(spark, sf_dir):
    return reports.discover_contours(paths(spark, sf_dir)).select("path", "sample", "cavity", names.element(F.col("profile"), F.col("index")).alias("element"))


@query(FILES + "SELECT k, 'PA_' || s AS name, 'PA_' || s AS element FROM f WHERE shape = 5")
def p15_element(spark, sf_dir):
    return reports.discover_contours(paths(spark, sf_dir)).select("k", names.stem(F.col("path")).alias("name"), names.element(F.col("profile"), F.col("index")).alias("element"))


@query("SELECT p_partkey AS k, p_brand || ' ' || p_name AS project, p_brand AS code, p_size AS length FROM part WHERE p_partkey % 3 = 0")
def s5_drawings(spark, sf_dir):
    place = F.when(F.col("p_partkey") % 3 == 0, "/1-2D y 3D Pieza/plan.pdf").when(F.col("p_partkey") % 3 == 1, "/1-2D y 3D Pieza/old/plan.pdf").otherwise("/other/plan.pdf")
    found = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("file:/r/"), "p_brand", F.lit(" "), "p_name", place).alias("path"), F.col("p_size").alias("length"))
    return found.join(reports.discover_drawings(found).select("path", "project", "code").distinct(), "path").select("k", "project", "code", "length")


@query("SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS triangles, p_partkey % 4 <> 0 AS whole FROM part")
def d_s22_mesh(spark, sf_dir):
    size = F.col("p_size")
    body = F.when(F.col("p_partkey") % 4 == 0, 50 * size - 7).otherwise(50 * size)
    content = F.unhex(F.concat(F.repeat(F.lit("00"), 80), F.lpad(F.hex(size), 2, "0"), F.lit("000000"), F.repeat(F.lit("00"), body)))
    found = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), content.alias("content"), (84 + body).cast("long").alias("length"))
    return reports.mesh_headers(found).select(F.col("path").cast("long").alias("k"), F.col("triangles").cast("long").alias("triangles"), "whole")


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN '3212' ELSE CAST(3000 + p_size AS VARCHAR) END AS project, CASE WHEN p_partkey % 2 = 0 THEN CAST(300000 + p_partkey AS VARCHAR) END AS lot, CASE WHEN p_partkey % 2 = 0 THEN 'c' || (10 + p_size) ELSE 'C' || (p_size % 10) END AS cavity, CASE WHEN p_partkey % 2 = 1 THEN '09-12-20' || (10 + p_size) END AS date FROM part")
def d_p32_scan_name(spark, sf_dir):
    text = lambda c: c.cast("string")
    size, key = F.col("p_size"), F.col("p_partkey")
    one = F.concat(F.lit("r/3212-"), text(300000 + key), F.lit("-c"), text(10 + size), F.lit(".stl"))
    two = F.concat(F.lit("r/09-12-20"), text(10 + size), F.lit("_C"), text(size % 10), F.lit("-"), text(3000 + size), F.lit(".stl"))
    found = table(spark, sf_dir, "part").select(key.alias("k"), F.when(key % 2 == 0, one).otherwise(two).alias("path"))
    return found.select("k", names.scan_name(F.col("path")).alias("s")).select("k", "s.project", "s.lot", "s.cavity", "s.date")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 7) THEN l_quantity WHEN l_linenumber = 4 THEN -l_quantity END AS value FROM lineitem")
def p4_tolerant_cast(spark, sf_dir):
    q, n = F.col("l_quantity").cast("string"), F.col("l_linenumber")
    said = F.when(n == 1, F.concat(F.lit(" "), q, F.lit(" "))).when(n == 2, "").when(n == 3, "abc").when(n == 4, F.concat(F.lit("-"), q)).when(n == 5, F.concat(q, F.lit("d"))).when(n == 6, F.concat(F.lit("1_"), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("+"), q))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", names.number(said).alias("value"))


# report lines: one an event
LINES = """WITH e AS (SELECT event_id AS pos, user_id, event_type AS characteristic, event_id % 9 AS kind, event_id % 50 AS nominal, CASE WHEN event_id % 19 = 0 THEN -(event_id % 50) ELSE event_id % 60 END AS measured, {file} AS file FROM events),
 l AS (SELECT *, CASE WHEN kind = 0 THEN 'N' || (pos % 4) || ' PLAN. H=' || (pos % 7) || '.5' END AS header FROM e WHERE kind NOT IN (1, 2, 3)),
 h AS (SELECT pos, file, row_number() OVER (PARTITION BY file, header ORDER BY pos) AS seen FROM l WHERE header IS NOT NULL),
 k AS (SELECT l.*, last_value(header IGNORE NULLS) OVER w AS block, last_value(seen IGNORE NULLS) OVER w AS occurrence, count(header) OVER w AS block_no FROM l LEFT JOIN h USING (pos, file) WINDOW w AS (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING)),
 b AS (SELECT file, pos, coalesce(block, '(sin bloque)') AS block, CAST(coalesce(occurrence, 0) AS INT) AS occurrence, CAST(row_number() OVER (PARTITION BY file, block_no ORDER BY pos) AS INT) AS idx, CAST(pos % 100 AS VARCHAR) AS cmm_id, characteristic, CAST(nominal AS DOUBLE) AS nominal, CAST(measured AS DOUBLE) AS measured, CASE WHEN pos % 13 = 0 THEN 0.7::DOUBLE END AS excess, pos % 13 = 0 OR pos % 17 = 0 AS nok, pos % 19 = 0 AND nominal > 1 AS sign_suspect, user_id FROM k WHERE header IS NULL) """
FIVE = LINES.replace("{file}", "'f' || (user_id % 5)")


def line():
    e, text = F.col("event_id"), lambda c: c.cast("string")
    measured = F.when(e % 19 == 0, -(e % 50)).otherwise(e % 60)
    data = F.concat_ws(";", text(e % 100), "event_type", F.lit(""), text(e % 50), F.lit("0.5"), F.lit("-0.5"), text(measured), text(measured - e % 50), F.when(e % 13 == 0, "0.7").otherwise(" "), F.when(e % 17 == 0, "<<--").otherwise("--*--"))
    head = F.concat(F.lit("N"), text(e % 4), F.lit(" PLAN. H="), text(e % 7), F.lit(".5;; "))
    return F.when(e % 9 == 0, head).when(e % 9 == 1, "****").when(e % 9 == 2, ";;;;").when(e % 9 == 3, "////x").otherwise(data)


def parsed(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string")).alias("file"), F.col("event_id").alias("pos"), line().alias("line"))
    return reports.parse_blocks(own)


@query(FIVE + "SELECT file, pos, block, occurrence, idx, cmm_id, characteristic, nominal, measured, excess, nok, sign_suspect FROM b")
def s6_block_parse(spark, sf_dir):
    return parsed(spark, sf_dir).select("file", "pos", "block", "occurrence", "idx", "cmm_id", "characteristic", "nominal", "measured", "excess", "nok", "sign_suspect")


@query(FIVE + "SELECT file, pos, block, occurrence, idx FROM b")
def w1_occurrence(spark, sf_dir):
    return parsed(spark, sf_dir).select("file", "pos", "block", "occurrence", "idx")


@query(FIVE + "SELECT file, pos, block FROM b")
def w2_header_fill(spark, sf_dir):
    return parsed(spark, sf_dir).select("file", "pos", "block")


@query(FIVE + "SELECT file, pos, idx FROM b")
def w3_block_index(spark, sf_dir):
    return parsed(spark, sf_dir).select("file", "pos", "idx")


@query(FIVE + "SELECT file, pos, block || '  [' || idx || '] ' || characteristic || '  #' || cmm_id AS label FROM b")
def p9_label(spark, sf_dir):
    return parsed(spark, sf_dir).select("file", "pos", "label")


@query(FIVE + "SELECT file, pos, block || '#' || occurrence || '||' || idx AS key FROM b")
def p10_key(spark, sf_dir):
    return parsed(spark, sf_dir).select("file", "pos", "key")


@query(LINES.replace("{file}", "user_id") + ", n AS (SELECT event_id AS pos, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line FROM events) SELECT b.user_id, n.line AS pos, '0' || (b.user_id % 10) AS sample, 'c' || (13 + b.user_id % 4) AS cavity, block || '#' || occurrence || '||' || idx AS key, measured, nok FROM b JOIN n USING (pos, user_id)")
def s6_read_reports(spark, sf_dir):
    """A report a user, its lines in one file's content."""
    user, text = F.col("user_id"), lambda c: c.cast("string")
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line().alias("line")))), lambda x: x["line"]), "\r\n").alias("text"))
    path = F.concat(F.lit("r/support intern."), text(user % 10), F.lit("/c"), text(13 + user % 4), F.lit("/"), text(user + 1000), F.lit(".csv"))
    found = reports.measured_in(own.select(path.alias("path"), F.encode("text", "ISO-8859-1").alias("content")))
    number = F.regexp_extract("file", r"/(\d+)\.csv$", 1).cast("long") - 1000
    return found.select(number.alias("user_id"), "pos", "sample", "cavity", "key", "measured", "nok")


POINTS = "SELECT event_id, user_id, CAST(printf('%+010.4f', value) AS DOUBLE) AS x, CAST(printf('%+010.4f', value * 2) AS DOUBLE) AS y, CAST(event_id % 97 AS DOUBLE) AS z FROM events"


def point_line():
    return F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.concat(F.lit(" "), F.format_string("%+010.4f", "value"), F.lit(" "), F.format_string("%+010.4f", F.col("value") * 2), F.lit("\t"), (F.col("event_id") % 97).cast("string")))


@query(POINTS.replace("SELECT event_id, user_id", "SELECT event_id AS pos") + " WHERE event_id % 7 <> 0")
def s7_cloud(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.lit("a").alias("file"), F.col("event_id").alias("pos"), point_line().alias("line"))
    return reports.parse_cloud(own).select("pos", "x", "y", "z")


@query(f"WITH p AS ({POINTS}), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM p) SELECT user_id, 'c' || (13 + user_id % 4) AS cavity, 'nous' AS family, pos, x, y, z FROM n WHERE event_id % 7 <> 0")
def s7_read_clouds(spark, sf_dir):
    """A cloud a user, its points in one file's content."""
    user, text = F.col("user_id"), lambda c: c.cast("string")
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", point_line().alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    path = F.concat(F.lit("r/intern.01/"), text(user + 1000), F.lit("/Cav_"), text(13 + user % 4), F.lit("/PUNTS_NOUS.txt"))
    found = reports.points_in(own.select(path.alias("path"), F.encode("text", "ISO-8859-1").alias("content")))
    return found.select((F.regexp_extract("file", r"/(\d+)/Cav", 1).cast("long") - 1000).alias("user_id"), "cavity", "family", "pos", "x", "y", "z")


@query("SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS contour, CAST(p_partkey % 50 AS VARCHAR) AS nominal, -0.03::DOUBLE AS tol_inf, -p_size / 1000 AS infr_inf, 0.025::DOUBLE AS tol_sup, 0.0::DOUBLE AS infr_sup, p_size / 100 AS mean, 0.5::DOUBLE AS ld, '10:15' AS time, 'PERFIL_A' AS profile_name FROM part")
def s8_contour(spark, sf_dir):
    """A page a part; of two rows of one kind the last one counts."""
    said = ["concat('Contorno (', p_size, ') -0.030 -0.242 ', format_string('%.3f', -p_size / 1000))", "concat('CONTORN (', p_partkey % 50, ') 0.025 -0.038 0.000')", "concat('YZ(X) ', format_string('%.2f', p_size / 100))", "'LD=0.5 12.03.2024 10:15'", "'PERFIL_A'"]
    lines = F.expr(f"array('Contorno (99) 1.0 1.0 1.0', {', '.join(said)})")
    words = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), F.posexplode(lines).alias("at", "line")).select("file", (F.col("at") * 20.0).alias("y0"), F.posexplode(F.split("line", " ")).alias("x0", "word"))
    found = reports.parse_contours(reports.anchor_rows(words.select("file", F.col("x0").cast("double").alias("x0"), "y0", "word")))
    return found.select(F.col("file").cast("long").alias("k"), "contour", "nominal", "tol_inf", "infr_inf", "tol_sup", "infr_sup", "mean", "ld", "time", "profile_name")


def scattered(spark, sf_dir):
    """Five words a page, at heights 1, 3.5, 4.2, 9 and 9 to 14."""
    said = ((2.0, F.lit(1.0), F.lit("b")), (1.0, F.lit(3.5), F.lit("a")), (0.0, F.lit(4.2), F.lit("c")), (0.0, F.lit(9.0), F.lit("d")), (5.0, 9 + F.col("p_size") / 10, F.concat(F.lit("w"), F.col("p_size").cast("string"))))
    words = F.array(*(F.struct(F.lit(x).alias("x0"), y.alias("y0"), w.alias("word")) for x, y, w in said))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), F.explode(words).alias("w")).select("file", "w.*")


@query("SELECT CAST(p_partkey AS VARCHAR) AS file, row, text FROM (SELECT p_partkey, unnest([1, 2, 3]) AS row, unnest(['a b', 'c', CASE WHEN p_size > 30 THEN 'd' ELSE 'd w' || p_size END]) AS text FROM part UNION ALL SELECT p_partkey, 4, 'w' || p_size FROM part WHERE p_size > 30)")
def w5_anchor_rows(spark, sf_dir):
    return reports.anchor_rows(scattered(spark, sf_dir)).select("file", "row", "text")


@query("SELECT CAST(p_partkey AS VARCHAR) AS file, CASE WHEN p_size > 30 THEN 4 ELSE 3 END AS lines FROM part")
def w5_contour_lines(spark, sf_dir):
    return reports.anchor_rows(scattered(spark, sf_dir)).groupBy("file").agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT p_partkey AS page, p_name AS t, 'exact' AS mode, 0.0::DOUBLE AS x, round(5 + (p_size % 10) * 0.25 - 0.5 + 2, 6) AS w FROM part WHERE p_name = 'small ring' AND (p_size % 10) * 0.25 - 0.5 BETWEEN -0.3 AND 1.6 AND (p_partkey % 8) * 0.125 <= 0.7")
def j6_phrase(spark, sf_dir):
    """Each part's name as two words of a page, some too far apart or too far down."""
    gap, down = (F.col("p_size") % 10) * 0.25 - 0.5, (F.col("p_partkey") % 8) * 0.125
    both = F.array(F.struct(F.lit(0).alias("i"), F.get(F.split("p_name", " "), F.lit(0)).alias("t"), F.lit(0.0).alias("x"), F.lit(1.0).alias("y"), F.lit(5.0).alias("w")), F.struct(F.lit(1).alias("i"), F.get(F.split("p_name", " "), F.lit(1)).alias("t"), (5.0 + gap).alias("x"), (1.0 + down).alias("y"), F.lit(2.0).alias("w")))
    words = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.explode(both).alias("w")).select("page", "w.*", F.lit(1.0).alias("h"))
    return search.phrase(words, ["small", "ring"], "page").select("page", "t", "mode", "x", F.round("w", 6).alias("w"))


@query("WITH p AS (SELECT p_partkey % 5 AS file, 14 + p_partkey AS row, CASE WHEN p_partkey % 3 = 0 THEN 'N' || p_partkey END AS nr, p_size AS s, p_partkey AS k FROM part WHERE p_partkey % 10 <> 0) SELECT file, row, last_value(nr IGNORE NULLS) OVER (PARTITION BY file ORDER BY row ROWS UNBOUNDED PRECEDING) AS nr, CAST(s AS DOUBLE) AS nominal, -0.1::DOUBLE AS tol_inf, s + 0.5::DOUBLE AS c13, k % 7 = 0 AS nok FROM p")
def d_s20_cells(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    cells = F.array(*(F.struct(F.lit(c).alias("col"), v.alias("text")) for c, v in (("A", F.when(key % 3 == 0, F.concat(F.lit("N"), key.cast("string")))), ("D", size), ("F", F.lit("-0,10")), ("H", F.concat(size, F.lit(",5"))), ("L", F.when(key % 7 == 0, "X")))))
    own = table(spark, sf_dir, "part").select((key % 5).alias("file"), F.when(key % 10 == 0, "COVER").otherwise("DR(3D)").alias("sheet"), (14 + key).alias("row"), F.explode(cells).alias("c")).select("file", "sheet", "row", "c.*").where("text is not null")
    return reports.dimension_rows(own).select("file", "row", "nr", "nominal", "tol_inf", "c13", "nok")


@query("SELECT p_partkey AS slide, CAST(p_size AS INT) AS correction, '3212' AS project, '14/03/2024' AS date, p_partkey || ',' || (p_partkey + 1) AS numbers, CAST('0.0' || (p_size % 9 + 1) AS DOUBLE) AS magnitude_mm, '+' AS sign, p_partkey % 2 = 0 AS done FROM part")
def d_s21_slides(spark, sf_dir):
    said = F.expr("array(concat('P3212 Tool correction nº', p_size, ' 14/03/2024'), concat('DIM. Nr.', p_partkey, ' and DIM. Nr ', p_partkey + 1), concat('Reduir el ferro 0,0', p_size % 9 + 1, ' mm'), if(p_partkey % 2 = 0, 'OK', 'not OK yet'))")
    found = reports.corrections(table(spark, sf_dir, "part").select(F.lit("a").alias("file"), F.col("p_partkey").alias("slide"), F.posexplode(said).alias("pos", "text")))
    return found.select("slide", "correction", "project", "date", F.array_join("n_numbers", ",").alias("numbers"), "magnitude_mm", "sign", "done")


@query("WITH e AS (SELECT user_id % 5 AS file, event_id AS row, CASE WHEN event_id % 10 = 0 THEN event_id % 8 END AS title, event_type AS responsible FROM events), k AS (SELECT *, count(title) OVER w AS block, last_value(title IGNORE NULLS) OVER w AS report FROM e WINDOW w AS (PARTITION BY file ORDER BY row ROWS UNBOUNDED PRECEDING)) SELECT file, row, block, CAST(report AS INT) AS report, '12/03/2024' AS date, responsible, 'x' AS remarks FROM k WHERE title IS NULL AND report IS NOT NULL AND row % 3 = 0")
def d_w9_history(spark, sf_dir):
    e = F.col("event_id")
    a = F.when(e % 10 == 0, F.concat(F.lit("INFORME "), (e % 8).cast("string"))).when(e % 3 == 0, "12/03/2024").otherwise("n/a")
    return reports.history(table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("file"), e.alias("row"), a.alias("a"), F.col("event_type").alias("e"), F.lit("x").alias("f")))


@query("SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'min/max' WHEN 1 THEN 'max' WHEN 2 THEN 'min' END AS role FROM part")
def d_p28_role(spark, sf_dir):
    k = F.col("p_partkey")
    header = F.when(k % 4 == 0, F.concat(F.lit("N"), k.cast("string"), F.lit(" BOLT MIN/MAX H=5.0"))).when(k % 4 == 1, F.concat(F.lit("N"), k.cast("string"), F.lit(" PLAN. 0.10 MAX."))).when(k % 4 == 2, "GN MIN.").otherwise("N1 MINIMUM")
    return table(spark, sf_dir, "part").select(k.alias("k"), names.role(header).alias("role"))


@query("SELECT p_partkey AS k, p_partkey || ',' || (p_partkey + 1) AS numbers, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS height FROM part")
def d_p27_n_number(spark, sf_dir):
    header = F.expr("concat('N', p_partkey, ', N', p_partkey + 1, ' PLAN', if(p_partkey % 3 = 0, '', concat(' H=', p_size, '.0 mm')))")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(names.dimensions(header), ",").alias("numbers"), names.height(header).alias("height"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 7 IN (0, 1) THEN '+' WHEN p_partkey % 7 IN (2, 3) THEN '-' WHEN p_partkey % 7 IN (4, 5) THEN '0' END AS sign FROM part")
def d_p31_sign(spark, sf_dir):
    said = ["Fer créixer el plàstic", "Reduir el ferro", "incrementar acer", "Reduir plàstic", "Polir", "No fer res", "altres"]
    action = F.concat(F.element_at(F.array(*map(F.lit, said)), (F.col("p_partkey") % 7 + 1).cast("int")), F.lit(" "), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), names.action_sign(action).alias("sign"))


# free references of old assets, in four shapes
OLD = """WITH o AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'scan of ' || p_name WHEN 1 THEN p_name || '.STL' ELSE p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'part' ELSE 'drawing' END AS kind, p_partkey % 4 AS shape,
 CASE p_partkey % 4 WHEN 2 THEN p_name WHEN 3 THEN '' ELSE CAST(3000 + p_size AS VARCHAR) END AS code, CASE WHEN p_partkey % 4 < 2 THEN p_name ELSE '' END AS rest FROM part) """


def old_assets(spark, sf_dir):
    k, name, code = F.col("p_partkey"), F.col("p_name"), (3000 + F.col("p_size")).cast("string")
    told = F.when(k % 3 == 0, F.concat(F.lit("scan of "), name)).when(k % 3 == 1, F.concat(name, F.lit(".STL"))).otherwise(name)
    ref = F.when(k % 4 == 0, F.concat(code, F.lit(" "), name)).when(k % 4 == 1, F.concat(code, F.lit(".- "), name)).when(k % 4 == 2, name).otherwise(" ")
    return table(spark, sf_dir, "part").select(k.alias("id"), told.alias("name"), F.when(k % 2 == 0, "part").otherwise("drawing").alias("kind"), ref.alias("part_ref"))


@query(OLD + "SELECT id, code, rest FROM o")
def p22_split_ref(spark, sf_dir):
    code, rest = names.split_reference(F.col("part_ref"))
    return old_assets(spark, sf_dir).select("id", code.alias("code"), rest.alias("rest"))


@query(OLD + "SELECT id, CASE WHEN kind = 'part' AND id % 3 < 2 THEN 'scan' ELSE kind END AS kind FROM o")
def p23_reclassify(spark, sf_dir):
    return old_assets(spark, sf_dir).select("id", names.reclassified(F.col("kind"), F.col("name")).alias("kind"))


@query("SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_name || ' - Lote ' || p_partkey ELSE p_name END AS told FROM part")
def p24_append_rest(spark, sf_dir):
    k = F.col("p_partkey")
    rest = F.when(k % 4 == 0, F.concat(F.lit("Lote "), k.cast("string"))).when(k % 4 == 1, "").when(k % 4 == 2, F.upper("p_name")).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select(k.alias("k"), names.with_rest(F.col("p_name"), rest, F.col("p_brand")).alias("told"))


CHOSEN = OLD.replace(" FROM part) ", " FROM part), q AS (SELECT id, name, kind, nullif(code, '') AS code, rest FROM o), n AS (SELECT code, rest, count(*) AS n, min(id) AS first FROM q WHERE code IS NOT NULL AND rest <> '' GROUP BY 1, 2), c AS (SELECT code, rest AS chosen FROM n QUALIFY row_number() OVER (PARTITION BY code ORDER BY n DESC, first, rest) = 1) ")


@query(CHOSEN + "SELECT id, CASE WHEN told IS NOT NULL THEN told ELSE name END AS name, CASE WHEN kind = 'part' AND id % 3 < 2 THEN 'scan' ELSE kind END AS kind, code AS part_code FROM (SELECT q.*, CASE WHEN q.code IS NOT NULL AND rest <> '' AND rest IS DISTINCT FROM chosen AND NOT contains(lower(name), lower(rest)) THEN name || ' - ' || rest END AS told FROM q LEFT JOIN c ON q.code = c.code)")
def m8_backfill(spark, sf_dir):
    return catalog.backfilled(old_assets(spark, sf_dir))[1]


@query(CHOSEN + "SELECT DISTINCT q.code, chosen AS name FROM q LEFT JOIN c ON q.code = c.code WHERE q.code IS NOT NULL")
def m8_backfilled_parts(spark, sf_dir):
    return catalog.backfilled(old_assets(spark, sf_dir))[0]
