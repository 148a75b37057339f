"""Queries on measurements: line items stand for measured characteristics, years for samples.

Measured is the quantity, nominal the part's size; tolerances depend on the size, so that zero and missing
ones occur. A key is a part, and its value in a sample the sum of its quantities in that year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gauge.functions import names, tolerance
from gauge.operators import align, points, scan
from gauge.plans.registry import query
from gauge.sources import reports

YEARS = [str(y) for y in range(1995, 2002)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    item, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    size, nominal = F.col("p_size"), F.col("p_size").cast("double")
    upper = F.when(size % 7 == 0, 0.0).when(size % 13 != 0, 5.0)
    lower = F.when(size % 11 == 0, 0.0).when(size % 5 != 0, -3.0)
    deviation = F.col("l_quantity") - nominal
    out = item.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("key"), F.year("l_shipdate").cast("string").alias("sample"), F.col("l_returnflag").alias("cavity"), nominal.alias("nominal"), F.col("l_quantity").alias("measured"), deviation.alias("deviation"), upper.alias("tol_sup"), lower.alias("tol_inf"))
    return out.withColumns({"excess": F.when(F.col("deviation") > 20, F.col("deviation") - 20), "bar": F.when(F.col("deviation") < -20, "<<---").otherwise("--*--")})


M = """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey AS key, CAST(year(l_shipdate) AS VARCHAR) AS sample, l_returnflag AS cavity, CAST(p_size AS DOUBLE) AS nominal, l_quantity AS measured, l_quantity - p_size AS deviation,
 CASE WHEN p_size % 7 = 0 THEN 0.0::DOUBLE WHEN p_size % 13 <> 0 THEN 5.0::DOUBLE END AS tol_sup, CASE WHEN p_size % 11 = 0 THEN 0.0::DOUBLE WHEN p_size % 5 <> 0 THEN -3.0::DOUBLE END AS tol_inf,
 CASE WHEN l_quantity - p_size > 20 THEN l_quantity - p_size - 20 END AS excess, CASE WHEN l_quantity - p_size < -20 THEN '<<---' ELSE '--*--' END AS bar
 FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
NOK = "(excess IS NOT NULL OR regexp_matches(bar, '<<|>>'))"
FRACTION = "CASE WHEN deviation >= 0 AND tol_sup IS NULL THEN NULL WHEN coalesce(CASE WHEN deviation >= 0 THEN tol_sup ELSE abs(tol_inf) END, 0) = 0 THEN CASE WHEN deviation = 0 THEN 0.0 WHEN deviation > 0 THEN 3.0 ELSE -3.0 END ELSE deviation / (CASE WHEN deviation >= 0 THEN tol_sup ELSE abs(tol_inf) END) END"
SUSPECT = "(abs(nominal) > 1 AND nominal * turned < 0 AND abs(abs(turned) - abs(nominal)) < 0.5)"
V = M + ", v AS (SELECT key, sample, sum(measured) AS value FROM m GROUP BY ALL) "


def nok():
    return tolerance.out_of_tolerance(F.col("excess"), F.col("bar"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements(spark, sf_dir).groupBy("key", "sample").agg(F.sum("measured").alias("value"))


@query(M + f"SELECT l_orderkey, l_linenumber, key, measured, {NOK} AS nok FROM m")
def p5_nok(spark, sf_dir):
    return measurements(spark, sf_dir).select("l_orderkey", "l_linenumber", "key", "measured", nok().alias("nok"))


def _turned(spark, sf_dir):
    """Every third part's measurements have the other sign."""
    return measurements(spark, sf_dir).withColumn("turned", F.when(F.col("key") % 3 == 0, -F.col("measured")).otherwise(F.col("measured")))


@query(M + f", t AS (SELECT *, CASE WHEN key % 3 = 0 THEN -measured ELSE measured END AS turned FROM m) SELECT l_orderkey, l_linenumber, key, turned, {SUSPECT} AS suspect FROM t")
def p6_sign_suspect(spark, sf_dir):
    return _turned(spark, sf_dir).select("l_orderkey", "l_linenumber", "key", "turned", tolerance.sign_suspect(F.col("nominal"), F.col("turned")).alias("suspect"))


@query(M + f", t AS (SELECT *, CASE WHEN key % 3 = 0 THEN -measured ELSE measured END AS turned FROM m) SELECT l_orderkey, l_linenumber, key, CASE WHEN {SUSPECT} THEN -turned ELSE turned END AS fixed, CASE WHEN {SUSPECT} THEN -turned - nominal ELSE deviation END AS fixed_deviation FROM t")
def p7_sign_fix(spark, sf_dir):
    fixed, deviation = tolerance.sign_fixed(F.col("nominal"), F.col("turned"), F.col("deviation"))
    return _turned(spark, sf_dir).select("l_orderkey", "l_linenumber", "key", fixed.alias("fixed"), deviation.alias("fixed_deviation"))


@query(M + f", f AS (SELECT *, CAST({FRACTION} AS DOUBLE) AS fraction FROM m) SELECT l_orderkey, l_linenumber, key, round(fraction, 6) AS fraction, CASE WHEN fraction IS NOT NULL THEN round(greatest(least(fraction, 3.0), -3.0), 6) END AS clipped FROM f")
def p8_fraction(spark, sf_dir):
    f = measurements(spark, sf_dir).withColumn("fraction", tolerance.fraction(F.col("deviation"), F.col("tol_sup"), F.col("tol_inf")))
    return f.select("l_orderkey", "l_linenumber", "key", F.round("fraction", 6).alias("fraction"), F.round(tolerance.clipped(F.col("fraction")), 6).alias("clipped"))


@query(M + "SELECT l_orderkey, l_linenumber, key, greatest(abs(coalesce(tol_inf, 0)), abs(coalesce(excess, 0))) AS worst, greatest(abs(coalesce(tol_inf, 0)), abs(coalesce(excess, 0))) <> 0 AS infraction FROM m")
def p11_worst_infraction(spark, sf_dir):
    pair = F.col("tol_inf"), F.col("excess")
    return measurements(spark, sf_dir).select("l_orderkey", "l_linenumber", "key", tolerance.worst_infraction(*pair).alias("worst"), tolerance.has_infraction(*pair).alias("infraction"))


@query(M + "SELECT l_orderkey, l_linenumber, key, abs(deviation) <= coalesce(nullif(tol_sup, 0), 0.025) AS inside FROM m")
def p12_in_band(spark, sf_dir):
    return measurements(spark, sf_dir).select("l_orderkey", "l_linenumber", "key", tolerance.in_band(F.col("deviation"), F.col("tol_sup")).alias("inside"))


@query(M + f", f AS (SELECT *, CAST({FRACTION} AS DOUBLE) AS fraction FROM m) SELECT sample, cavity, count(*) AS n, count(*) FILTER ({NOK}) AS nok, count(*) FILTER ({SUSPECT.replace('turned', '(CASE WHEN key % 3 = 0 THEN -measured ELSE measured END)')}) AS suspect, round(avg(greatest(least(fraction, 3.0), -3.0)) FILTER (fraction IS NOT NULL), 6) AS mean_use FROM f GROUP BY ALL")
def a5_nok_by_sample_cavity(spark, sf_dir):
    use = tolerance.clipped(tolerance.fraction(F.col("deviation"), F.col("tol_sup"), F.col("tol_inf")))
    suspect = tolerance.sign_suspect(F.col("nominal"), F.col("turned"))
    return _turned(spark, sf_dir).groupBy("sample", "cavity").agg(F.count(F.lit(1)).alias("n"), F.count_if(nok()).alias("nok"), F.count_if(suspect).alias("suspect"), F.round(F.avg(use), 6).alias("mean_use"))


@query(M + f"SELECT sample, cavity, count(*) FILTER ({NOK}) AS out, bool_and({NOK}) AS every FROM m GROUP BY ALL")
def a10_out_by_sample_cavity(spark, sf_dir):
    return measurements(spark, sf_dir).groupBy("sample", "cavity").agg(F.count_if(nok()).alias("out"), F.bool_and(nok()).alias("every"))


@query(V + "SELECT r.key, r.value, o.value AS value_other FROM (SELECT * FROM v WHERE sample = '1995') r LEFT JOIN (SELECT * FROM v WHERE sample = '1997') o ON r.key = o.key")
def j3_align(spark, sf_dir):
    v = values(spark, sf_dir)
    return align.align(v.where("sample = '1995'").drop("sample"), v.where("sample = '1997'"), "key", "value")


@query(V + "SELECT key, max(value) - min(value) AS range, count(value) AS n FROM v GROUP BY key")
def a8_range(spark, sf_dir):
    return align.ranges(values(spark, sf_dir), "key", "value")


@query(V + "SELECT key, max(value) - min(value) AS range, count(value) AS n FROM v GROUP BY key ORDER BY range DESC NULLS LAST, key LIMIT 15")
def l6_top_movers(spark, sf_dir):
    return align.top_movers(values(spark, sf_dir), "key", "value")


@query(V + "SELECT key, " + ", ".join(f"max(value) FILTER (sample = '{y}') AS \"{y}\"" for y in YEARS) + " FROM v GROUP BY key")
def w7_evolution_matrix(spark, sf_dir):
    return align.evolution(values(spark, sf_dir), "key", "sample", "value", YEARS)


@query(V + "SELECT r.key, r.value, a.value AS value_1996, b.value AS value_1997 FROM (SELECT * FROM v WHERE sample = '1995') r LEFT JOIN (SELECT * FROM v WHERE sample = '1996') a ON r.key = a.key LEFT JOIN (SELECT * FROM v WHERE sample = '1997') b ON r.key = b.key")
def u5_column_bind(spark, sf_dir):
    v = values(spark, sf_dir)
    out = v.where("sample = '1995'").select("key", "value")
    for year in ("1996", "1997"):
        out = align.align(out, v.where(F.col("sample") == year), "key", "value", f"value_{year}")
    return out


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING n > 1")
def a14_duplicate_keys(spark, sf_dir):
    return align.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(V + "SELECT key, count(DISTINCT sample) AS samples FROM v GROUP BY key HAVING samples > 1")
def f17_multi_sample(spark, sf_dir):
    return align.several_samples(values(spark, sf_dir), "key", "sample")


@query("SELECT list_aggregate(list_sort(list(DISTINCT CAST(year(l_shipdate) AS VARCHAR))), 'string_agg', ',') AS samples, count(DISTINCT year(l_shipdate)) AS n FROM lineitem")
def a15_samples(spark, sf_dir):
    year = F.year("l_shipdate").cast("string")
    return table(spark, sf_dir, "lineitem").agg(F.array_join(F.array_sort(F.collect_set(year)), ",").alias("samples"), F.count_distinct(year).alias("n"))


@query(V + ", o AS (SELECT *, lead(sample) OVER w AS next, lead(value) OVER w - value AS delta FROM v WINDOW w AS (PARTITION BY key ORDER BY sample)) SELECT sample, next, count(*) FILTER (abs(delta) >= 10) AS ten, count(*) FILTER (abs(delta) >= 50) AS fifty, count(*) FILTER (abs(delta) >= 100) AS hundred, max(abs(delta)) AS largest FROM o WHERE next IS NOT NULL GROUP BY ALL")
def d_a20_thresholds(spark, sf_dir):
    changes = align.deltas(values(spark, sf_dir), "key", "sample", "value")
    return align.threshold_counts(changes, ["sample", "next"], {"ten": 10, "fifty": 50, "hundred": 100})


@query(V + ", o AS (SELECT *, lead(sample) OVER w AS next, lead(value) OVER w - value AS delta FROM v WINDOW w AS (PARTITION BY key ORDER BY sample)) SELECT key, sample, value, next, delta FROM o WHERE next IS NOT NULL")
def d_j11_delta(spark, sf_dir):
    return align.deltas(values(spark, sf_dir), "key", "sample", "value")


@query(M + "SELECT sample, cavity, round(avg(excess), 6) AS mean, max(excess) AS largest FROM m GROUP BY ALL")
def d_a19_mean_infraction(spark, sf_dir):
    return measurements(spark, sf_dir).groupBy("sample", "cavity").agg(F.round(F.avg("excess"), 6).alias("mean"), F.max("excess").alias("largest"))


@query(M + f"SELECT key, bool_and({NOK}) AS all_out, count(*) FILTER ({NOK}) AS out FROM m GROUP BY key")
def d_a24_all_cavities(spark, sf_dir):
    return align.all_out(measurements(spark, sf_dir).withColumn("nok", nok()), "key", "nok")


@query(M + f", a AS (SELECT DISTINCT key FROM m WHERE sample = '1996' AND {NOK}), b AS (SELECT DISTINCT key FROM m WHERE sample = '1997' AND {NOK}) SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'resolved' WHEN a.key IS NULL THEN 'new' ELSE 'persisting' END AS state FROM a FULL JOIN b ON a.key = b.key")
def d_u6_diff(spark, sf_dir):
    bad = measurements(spark, sf_dir).where(nok())
    return align.difference(bad.where("sample = '1996'"), bad.where("sample = '1997'"), "key")


@query("WITH n AS (SELECT l_orderkey, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '|' ORDER BY CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS block FROM lineitem GROUP BY 1), f AS (SELECT block, min(l_orderkey) AS first, count(*) AS n FROM n GROUP BY 1 HAVING count(*) > 1) SELECT l_orderkey, first, f.n FROM n JOIN f USING (block)")
def d_a23_stale_copy(spark, sf_dir):
    return align.stale_copies(table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_quantity").cast("long")), "l_orderkey", "v")


@query(M + "SELECT l_orderkey, l_linenumber, key, least(tol_sup - deviation, deviation - tol_inf) AS margin FROM m WHERE tol_sup IS NOT NULL AND tol_inf IS NOT NULL")
def d_p30_margin(spark, sf_dir):
    return measurements(spark, sf_dir).where("tol_sup is not null and tol_inf is not null").select("l_orderkey", "l_linenumber", "key", tolerance.margin(F.col("deviation"), F.col("tol_sup"), F.col("tol_inf")).alias("margin"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(2 * sqrt(l_discount * l_discount + l_tax * l_tax), 6) AS position FROM lineitem")
def d_p29_position(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(tolerance.position(F.col("l_discount"), F.col("l_tax")), 6).alias("position"))


@query(V + ", o AS (SELECT key, sample, value, lead(value) OVER (PARTITION BY key ORDER BY sample) AS after FROM v) SELECT key, sample, (value > 120 AND after < 60) OR (value < 60 AND after > 120) AS over FROM o WHERE after IS NOT NULL")
def d_p35_overcorrection(spark, sf_dir):
    d = align.deltas(values(spark, sf_dir), "key", "sample", "value")
    return d.select("key", "sample", tolerance.overcorrected(F.col("value"), F.col("value") + F.col("delta"), F.lit(120.0), F.lit(60.0)).alias("over"))


@query(M + "SELECT key, min(measured) < 10 AND max(measured) > 40 AS oval FROM m GROUP BY key")
def d_p36_ovality(spark, sf_dir):
    return measurements(spark, sf_dir).groupBy("key").agg(tolerance.oval(F.min("measured"), F.max("measured"), F.lit(40.0), F.lit(10.0)).alias("oval"))


@query(M + "SELECT key, max(measured) AS gx, min(measured) AS gn, max(measured) - min(measured) AS spread FROM m GROUP BY key")
def d_a21_evaluators(spark, sf_dir):
    return measurements(spark, sf_dir).groupBy("key").agg(F.max("measured").alias("gx"), F.min("measured").alias("gn"), (F.max("measured") - F.min("measured")).alias("spread"))


@query(V + ", o AS (SELECT key, lead(value) OVER (PARTITION BY key ORDER BY sample) - value AS delta FROM v) SELECT key, sign(delta) AS sign, count(*) AS n FROM o WHERE delta IS NOT NULL GROUP BY ALL")
def d_a25_reaction(spark, sf_dir):
    return align.deltas(values(spark, sf_dir), "key", "sample", "value").groupBy("key", F.signum("delta").cast("int").alias("sign")).agg(F.count(F.lit(1)).alias("n"))


@query(V + ", o AS (SELECT key, lead(value) OVER (PARTITION BY key ORDER BY sample) - value AS delta FROM v) SELECT o.key, p_retailprice - 950 AS requested, delta, sign(delta) = sign(p_retailprice - 950) AS agrees FROM o JOIN part ON key = p_partkey WHERE delta IS NOT NULL")
def d_j15_requested(spark, sf_dir):
    d = align.deltas(values(spark, sf_dir), "key", "sample", "value")
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), (F.col("p_retailprice") - 950).alias("requested"))
    return d.join(asked, "key").select("key", "requested", "delta", (F.signum("delta") == F.signum("requested")).alias("agrees"))


EVENTS = "WITH e AS (SELECT user_id, value, floor(value / 10) AS x, epoch_us(ts) AS t, event_id, ts, event_type FROM events) "


def event_points(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.col("value").alias("x"), (F.col("value") * 2).alias("y"), (F.col("event_id") % 97).cast("double").alias("z"))


@query("SELECT user_id, min(value) AS x_min, max(value) AS x_max, min(value * 2) AS y_min, max(value * 2) AS y_max, min(CAST(event_id % 97 AS DOUBLE)) AS z_min, max(CAST(event_id % 97 AS DOUBLE)) AS z_max, count(*) AS n FROM events GROUP BY 1")
def a6_bbox(spark, sf_dir):
    return points.extents(event_points(spark, sf_dir), "user_id")


@query("WITH s AS (SELECT user_id, value, coalesce(CAST(value - lag(value) OVER w > 0.3 AS INT), 0) AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value)), l AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY value ROWS UNBOUNDED PRECEDING) AS level FROM s) SELECT user_id, CAST(level AS BIGINT) AS level, round(avg(value), 6) AS mean, count(*) AS n FROM l GROUP BY ALL")
def a7_levels(spark, sf_dir):
    return points.levels(table(spark, sf_dir, "events"), "user_id", "value").withColumn("mean", F.round("mean", 6))


@query("WITH k AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS total FROM events), w AS (SELECT DISTINCT total, CAST(i * (total - 1) // 4 AS BIGINT) AS at FROM (SELECT DISTINCT total FROM k), range(5) r(i)) SELECT event_id, user_id FROM k WHERE total <= 5 OR EXISTS (SELECT 1 FROM w WHERE w.total = k.total AND w.at = k.k)")
def w6_subsample(spark, sf_dir):
    return points.strided(event_points(spark, sf_dir), "user_id", ["ts", "event_id"], 5, F.date_trunc("week", "ts")).select("event_id", "user_id")


@query("SELECT event_id, round_even(value * 1000, 0) / 1000 AS rounded FROM events")
def p13_round(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", points.rounded(F.col("value")).alias("rounded"))


@query("SELECT user_id, event_id, value AS across, CAST(event_id % 97 AS DOUBLE) AS along, value * 2 AS up FROM events")
def p14_axes(spark, sf_dir):
    return points.upright(event_points(spark, sf_dir).drop("ts", "event_type"))


@query("SELECT event_id, user_id, (SELECT arg_min(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts > e.ts OR (p.ts = e.ts AND p.event_id > e.event_id))) AS next_event_id FROM events e WHERE event_type = 'error'")
def d_j12_next_sample(spark, sf_dir):
    found = align.next_matching(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", "event_id", F.date_trunc("day", "ts"))
    return found.where("event_type = 'error'").select("event_id", "user_id", "next_event_id")


@query("SELECT event_id, p_partkey AS name FROM events JOIN part ON abs(sqrt(value * value + CAST(event_id % 97 AS DOUBLE) * CAST(event_id % 97 AS DOUBLE)) - p_size * 4) < 3 AND abs(value * 2 - (p_retailprice - 900) * 3) < 3")
def d_j13_anchor(spark, sf_dir):
    nominal = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), (F.col("p_size") * 4).cast("double").alias("radius"), ((F.col("p_retailprice") - 900) * 3).alias("height"))
    return points.anchored(event_points(spark, sf_dir), nominal, 3.0).select("event_id", "name")


@query("WITH e AS (SELECT user_id, value AS x, CAST(event_id % 97 AS DOUBLE) AS z FROM events), c AS (SELECT user_id, x - avg(x) OVER w AS u, z - avg(z) OVER w AS v, avg(x) OVER w AS mx, avg(z) OVER w AS mz FROM e WINDOW w AS (PARTITION BY user_id)), s AS (SELECT user_id, first(mx) AS mx, first(mz) AS mz, count(*) AS n, sum(u*u) AS uu, sum(v*v) AS vv, sum(u*v) AS uv, sum(u*u*u+u*v*v) AS p, sum(v*v*v+v*u*u) AS q FROM c GROUP BY 1), k AS (SELECT *, (p*vv-q*uv)/(2*(uu*vv-uv*uv)) AS cx, (q*uu-p*uv)/(2*(uu*vv-uv*uv)) AS cz FROM s WHERE n > 5) SELECT user_id, round(mx + cx, 3) AS x, round(mz + cz, 3) AS z, round(sqrt(cx*cx+cz*cz+(uu+vv)/n), 3) AS radius, n FROM k")
def d_a22_circle(spark, sf_dir):
    found = points.circle(event_points(spark, sf_dir), "user_id").where("n > 5")
    return found.select("user_id", *(F.round(c, 3).alias(c) for c in ("x", "z", "radius")), "n")


@query(M + "SELECT l_orderkey, l_linenumber, key, round(50 + 50 * deviation / (greatest(4 * coalesce(nullif(tol_sup, 0), 0.025), abs(coalesce(tol_inf, 0)), abs(coalesce(excess, 0))) * 1.15), 6) AS place FROM m")
def p12_scaled(spark, sf_dir):
    place = tolerance.scaled(F.col("deviation"), F.col("tol_sup"), F.col("tol_inf"), F.col("excess"))
    return measurements(spark, sf_dir).select("l_orderkey", "l_linenumber", "key", F.round(place, 6).alias("place"))


@query(V + "SELECT key, string_agg(sample || '=' || CAST(CAST(value AS BIGINT) AS VARCHAR), ',' ORDER BY sample) AS items FROM v GROUP BY key")
def a9_tree(spark, sf_dir):
    found = align.tree(values(spark, sf_dir), "key", "sample", "sample", "value")
    return found.select("key", F.array_join(F.transform("items", lambda x: F.concat(x["sample"], F.lit("="), x["value"].cast("long").cast("string"))), ",").alias("items"))


@query("SELECT source, count(*) AS files, round(sum(n_chars) / 1048576.0, 6) AS mb FROM documents GROUP BY 1")
def a18_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("n_chars") / 1048576, 6).alias("mb"))


@query(V + "SELECT key, min(sample) AS reference FROM v GROUP BY key")
def l12_reference(spark, sf_dir):
    return align.reference(values(spark, sf_dir), ["key"], "sample")


@query("WITH s AS (SELECT user_id, value, coalesce(CAST(value - lag(value) OVER w > 0.3 AS INT), 0) AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value)), l AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY value ROWS UNBOUNDED PRECEDING) AS level FROM s), c AS (SELECT user_id, level, avg(value) AS mean, count(*) AS n FROM l GROUP BY ALL) SELECT user_id, count(*) AS levels, CASE WHEN count(*) <= 8 THEN string_agg(printf('Y=%.1f (%d pts)', mean, n), ', ' ORDER BY level) ELSE 'continuous' END AS said FROM c GROUP BY 1")
def a7_summary(spark, sf_dir):
    return points.level_summary(points.levels(table(spark, sf_dir, "events"), "user_id", "value"), "user_id")


@query(M + "SELECT sample, " + ", ".join(f"round(avg(excess) FILTER (cavity = '{c}'), 6) AS \"{c}\"" for c in "ANR") + " FROM m GROUP BY 1")
def d_a19_by_cavity(spark, sf_dir):
    return measurements(spark, sf_dir).groupBy("sample").pivot("cavity", list("ANR")).agg(F.round(F.avg("excess"), 6))


@query(V + ", o AS (SELECT key, sample, lead(value) OVER (PARTITION BY key ORDER BY sample) - value AS delta FROM v) SELECT key, sample, abs(delta) >= 0.1 AS reworked FROM o WHERE delta IS NOT NULL")
def d_f18_rework(spark, sf_dir):
    d = align.deltas(values(spark, sf_dir), "key", "sample", "value")
    return d.select("key", "sample", tolerance.reworked(F.col("delta")).alias("reworked"))


@query("WITH c AS (SELECT user_id, CAST(event_id % 360 AS INT) AS cell, avg(value) AS v FROM events GROUP BY 1, 2) SELECT a.user_id, round(max(a.v + b.v), 6) AS most, round(min(a.v + b.v), 6) AS least FROM c a JOIN c b ON a.user_id = b.user_id AND b.cell = (a.cell + 180) % 360 GROUP BY 1")
def d_a21_opposite(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("angle", (F.col("event_id") % 360).cast("double"))
    return align.opposite(e, "user_id", "angle", "value").select("user_id", F.round("most", 6).alias("most"), F.round("least", 6).alias("least"))


@query(V + f", y AS (SELECT unnest({YEARS}) AS sample), k AS (SELECT DISTINCT key FROM v) SELECT k.key, y.sample AS cavity, v.value FROM k CROSS JOIN y LEFT JOIN v ON v.key = k.key AND v.sample = y.sample")
def d_s19_wide(spark, sf_dir):
    wide = align.evolution(values(spark, sf_dir), "key", "sample", "value", YEARS)
    return reports.wide_cavities(wide, "key")


@query("SELECT event_id, CAST(CASE WHEN r > h OR (r = h AND q % 2 <> 0) THEN q + 1 ELSE q END AS DOUBLE) / 1000 AS rounded FROM (SELECT event_id, n // u AS q, n % u AS r, u // 2 AS h FROM (SELECT event_id, CAST(abs(value) * 1180591620717411303424::DOUBLE AS HUGEINT) * 1000 AS n, 1180591620717411303424::HUGEINT AS u FROM events))")
def p13_round_exactly(spark, sf_dir):
    """Rounding by the exact value of the double; the SQL has it as a whole number of 2^-70."""
    return table(spark, sf_dir, "events").select("event_id", points.rounded_exactly(F.abs("value")).alias("rounded"))


BLOCKS = "WITH e AS (SELECT event_id, user_id % 3 AS file, CASE WHEN event_id % 11 = 0 THEN event_type END AS header FROM events), h AS (SELECT event_id, row_number() OVER (PARTITION BY file, header ORDER BY event_id) AS seen FROM e WHERE header IS NOT NULL), k AS (SELECT e.*, last_value(header IGNORE NULLS) OVER w AS block, last_value(seen IGNORE NULLS) OVER w AS occurrence, count(header) OVER w AS block_no FROM e LEFT JOIN h USING (event_id) WINDOW w AS (PARTITION BY file ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, file, coalesce(block, 'none') AS block, CAST(coalesce(occurrence, 0) AS INT) AS occurrence, CAST(row_number() OVER (PARTITION BY file, block_no ORDER BY event_id) AS INT) AS idx FROM k WHERE header IS NULL"


@query(BLOCKS)
def w1_w3_blocks(spark, sf_dir):
    """Events of three long files, each eleventh a header: block, occurrence and index, scanned in slabs of 1,000 rows."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("file"), F.when(F.col("event_id") % 11 == 0, F.col("event_type")).alias("header"))
    return scan.blocks(e, ["file"], "event_id", "header", F.floor(F.col("event_id") / 1000), "none")


@query("WITH e AS (SELECT event_id, value, ts FROM events) SELECT event_id, sum(CAST(floor(value) AS BIGINT)) OVER w AS so_far, lag(value) OVER (ORDER BY ts, event_id) AS before, last_value(CASE WHEN event_id % 50 = 0 THEN event_id END IGNORE NULLS) OVER w AS mark FROM e WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def w_running(spark, sf_dir):
    """Sum, row before and last mark over one order of all events, which no task holds."""
    e = table(spark, sf_dir, "events").select("event_id", "value", "ts")
    found = scan.scan(e, [], ["ts", "event_id"], F.date_trunc("day", "ts"), so_far=scan.total(F.floor("value")), before=scan.previous("value"), mark=scan.last(F.when(F.col("event_id") % 50 == 0, F.col("event_id"))))
    return found.select("event_id", "so_far", "before", "mark")


@query("WITH e AS (SELECT user_id AS file, value FROM events UNION ALL SELECT user_id + 1000000, value + 64 FROM events WHERE user_id % 3 = 0 UNION ALL SELECT user_id + 2000000, value * 2 FROM events WHERE user_id % 5 = 0), d AS (SELECT file, CAST(round((value - min(value) OVER (PARTITION BY file)) / 1e-6) AS BIGINT) AS q FROM e), s AS (SELECT file, string_agg(q, ',' ORDER BY q) AS whole FROM d GROUP BY 1), f AS (SELECT file, min(file) OVER w AS first, count(*) OVER w AS sets FROM s WINDOW w AS (PARTITION BY whole)) SELECT * FROM f WHERE sets > 1")
def d_s23_same_sets(spark, sf_dir):
    """Each user's values, some again a constant offset away and some at twice the size: which are the same set."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), "value")
    moved = e.where("file % 3 = 0").select((F.col("file") + 1000000).alias("file"), (F.col("value") + 64).alias("value"))
    scaled = e.where("file % 5 = 0").select((F.col("file") + 2000000).alias("file"), (F.col("value") * 2).alias("value"))
    return points.same_sets(e.union(moved).union(scaled), "file", "value")
