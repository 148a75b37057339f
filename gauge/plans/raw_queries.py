"""Queries on raw formats whose files, boxes and lines stand for rows of the given tables; tables that are written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from gauge.plans.measurements import M, NOK, measurements, nok, table
from gauge.plans.registry import query
from gauge.sources import folders, reports


@query("WITH a AS (SELECT l_orderkey AS file, l_linenumber AS image, CAST(l_quantity AS INT) AS w, CAST(l_suppkey AS INT) AS h FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY w * h DESC, image) AS turn FROM a) SELECT file, image, w * h AS area FROM b WHERE turn = 1")
def s9_largest_image(spark, sf_dir):
    images = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("image"), F.col("l_quantity").cast("int").alias("w"), F.col("l_suppkey").cast("int").alias("h"))
    return reports.largest_image(images).select("file", "image", (F.col("w") * F.col("h")).alias("area"))


@query("SELECT l_orderkey, l_linenumber, trim(l_returnflag) AS t, round_even(l_quantity / 200 * 100, 3) AS x, round_even(l_suppkey / 1000 * 100, 3) AS y, CAST(l_linenumber * 10 AS INT) AS c FROM lineitem WHERE l_linenumber * 10 >= 30")
def s10_boxes(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    read = item.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("left"), F.col("l_suppkey").cast("double").alias("top"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"), (F.col("l_linenumber") * 10).alias("conf"), F.concat(F.lit(" "), "l_returnflag").alias("text"), F.lit(200.0).alias("page_w"), F.lit(1000.0).alias("page_h"))
    return reports.normalised_words(read, also=("l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber", "t", "x", "y", "c")


BOXES = "WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS width, l_linenumber * 10 AS height, l_quantity * l_linenumber AS area, l_returnflag AS f FROM lineitem) "


def boxes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit(100.0).alias("left"), F.lit(50.0).alias("top"), F.col("l_quantity").alias("width"), (F.col("l_linenumber") * 10).alias("height"), (F.col("l_quantity") * F.col("l_linenumber")).alias("area"), F.col("l_returnflag").alias("f"), F.lit(1000.0).alias("page_w"), F.lit(1000.0).alias("page_h"))


@query(BOXES + "SELECT l_orderkey, l_linenumber, l_partkey, round_even(width / 10, 3) AS w, round_even(height / 10, 3) AS h, f FROM b WHERE area >= 150 AND width BETWEEN 15 AND 900 AND height BETWEEN 15 AND 900")
def s11_balloons(spark, sf_dir):
    return reports.balloon_boxes(boxes(spark, sf_dir), also=("l_orderkey", "l_linenumber", "l_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "w", "h", "f")


@query(BOXES + "SELECT f, count(*) AS n FROM b WHERE area >= 150 AND width BETWEEN 15 AND 900 AND height BETWEEN 15 AND 900 GROUP BY 1")
def f15_box_filter(spark, sf_dir):
    return reports.by_colour(reports.balloon_boxes(boxes(spark, sf_dir)))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def s12_cache(spark, sf_dir):
    """The second call reads what the first one wrote, as the table's size and time are the same."""
    at, signature = f"{folders.fresh(spark, 'cache')}/brands", {"input": folders.stat(spark, f"{sf_dir}/part.parquet"), "what": "brands"}
    compute = lambda: table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    reports.cached(spark, at, signature, compute)
    return reports.cached(spark, at, signature, lambda: spark.range(0))


@query(M + f"SELECT sample, cavity, count(*) FILTER ({NOK}) AS nok FROM m GROUP BY ALL")
def s15_tables(spark, sf_dir):
    at = folders.fresh(spark, "tables")
    index = measurements(spark, sf_dir).groupBy("sample", "cavity").agg(F.count_if(nok()).alias("nok"))
    reports.write_tables({"index": index}, at)
    return spark.read.parquet(f"{at}/index")
