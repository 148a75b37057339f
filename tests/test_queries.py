"""Every query of the engine beside its SQL twin in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import difflib
import math
import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from gauge.functions import text
from gauge.operators import align, search
from gauge.plans import all_queries, all_sql
from gauge.sources import reports

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int | float | decimal.Decimal):
        return round(float(v), 6) + 0.0 if math.isfinite(v) else str(v)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def same_rows(found, names, wanted, wanted_names):
    assert sorted(names) == sorted(wanted_names)
    a = sorted((tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in found), key=repr)
    b = sorted((tuple(plain(r[wanted_names.index(n)]) for n in sorted(names)) for r in wanted), key=repr)
    assert a == b


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_sql(spark, duck, name):
    df = all_queries()[name](spark, SMALL)
    cursor = duck.execute(all_sql()[name])
    wanted_names = [d[0] for d in cursor.description]
    found = [tuple(r) for r in df.collect()]
    same_rows(found, df.columns, cursor.fetchall(), wanted_names)
    assert found  # two empty results would compare nothing


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_query_without_sql_runs(spark, name):
    assert all_queries()[name](spark, SMALL).collect()


def test_approximate_words_equal_a_plain_loop(spark):
    words = {w for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() for w in re.split("[ \n\t]+", r.text or "") if w}
    forms = {r.t: r.v for r in spark.createDataFrame([(w,) for w in words], "t string").select("t", text.variants(F.col("t")).alias("v")).collect()}
    theirs, wanted = ["thingz"], {}
    for w, own in forms.items():
        if set(own) & set(theirs):
            wanted[w] = ("exact", 3.0)
        elif any(len(f) >= 3 and (f in o or o in f) for f in own for o in theirs):
            wanted[w] = ("partial", 2.0)
        elif (best := max((difflib.SequenceMatcher(None, f, o).ratio() for f in own for o in theirs), default=0)) >= 0.78:
            wanted[w] = ("approximate", round(best, 6))
    assert {r.t: (r["mode"], r.score) for r in all_queries()["difflib"](spark, SMALL).collect()} == wanted
    assert any(mode == "approximate" for mode, _ in wanted.values())


def test_phrases_equal_a_plain_loop(spark):
    r = random.Random(4)
    words = [("p", i, r.choice(["red", "lid", "rod"]), r.uniform(0, 30), r.uniform(0, 6), r.uniform(0.5, 4), r.uniform(0.3, 2)) for i in range(400)]
    fits = lambda t, term: t == term
    wanted = {}
    for _, i, t, x, y, w, h in words:
        if not fits(t, "red"):
            continue
        near = [(b[3], b[1]) for b in words if fits(b[2], "lid") and -0.3 <= b[3] - (x + w) <= 1.6 and abs(b[4] - y) <= 0.7 * h]
        if near:
            wanted[i] = min(near)[1]
    found = search.phrase(spark.createDataFrame(words, "page string, i int, t string, x double, y double, w double, h double"), ["red", "lid"], "page").collect()
    at = {b[1]: b for b in words}
    assert {f.i0 for f in found} == set(wanted)
    for f in found:
        a, b = at[f.i0], at[wanted[f.i0]]
        assert f.w == pytest.approx(max(a[3] + a[5], b[3] + b[5]) - min(a[3], b[3])) and f.y == pytest.approx(min(a[4], b[4]))


def test_alignment_refuses_repeated_keys(spark):
    one, two = spark.createDataFrame([(1, 2.0)], "k int, v double"), spark.createDataFrame([(1, 3.0), (1, 4.0)], "k int, v double")
    assert align.align(one, two.limit(1), "k", "v").collect()[0].v_other == 3.0
    with pytest.raises(Exception, match="repeated key 1"):
        align.align(one, two, "k", "v").collect()


def test_no_file_left_is_an_error(spark):
    found = spark.createDataFrame([("01", "c13", "nous")], "sample string, cavity string, family string")
    assert reports.chosen(found, ["1"], ["C13"], "nous").count() == 1
    with pytest.raises(ValueError, match="no file"):
        reports.chosen(found, ["2"])
