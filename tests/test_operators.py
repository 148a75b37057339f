"""Operators of the engine against plain loops, on small tables with nulls and ties."""

from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from gauge.functions import names, text
from gauge.operators import align, catalog, points, scan, search
from gauge.sources import folders, reports


def test_running_values_equal_a_plain_loop(spark):
    """Whatever the slabs: keys that are null, values that are null, long keys over many slabs."""
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, 1, 2, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, pos int, v int").repartition(5)
    wanted = {}
    state: dict = {}
    for k, i, v in rows:
        total, last, before = state.get(k, (0, None, None))
        state[k] = total + (v or 0), v if v is not None else last, v
        wanted[i] = state[k][0], state[k][1], before
    for width in (1, 7, 1000):
        found = scan.scan(df, ["k"], ["pos"], F.floor(F.col("pos") / width), total=scan.total("v"), last=scan.last("v"), before=scan.previous("v"))
        assert {x.pos: (x.total, x.last, x.before) for x in found.collect()} == wanted
        downs = reports.filled_down(df, ["k"], ["pos"], "v", F.floor(F.col("pos") / width))
        assert downs.columns == df.columns and {x.pos: x.v for x in downs.collect()} == {i: w[1] for i, w in wanted.items()}
    assert scan.scan(df.limit(0), ["k"], ["pos"], F.col("pos"), total=scan.total("v")).collect() == []


def test_next_matching_equals_a_plain_loop(spark):
    """Whatever the slabs: null keys and values, rows after the last match, equal first parts of the order."""
    r = random.Random(7)
    rows = [(r.choice(["a", "b", None]), i // 3, i, r.choice([None, 1, 2, 5])) for i in range(240)]
    df = spark.createDataFrame(rows, "k string, day int, pos int, v int").repartition(5)
    wanted, ahead = {}, {}
    for k, _, i, v in reversed(rows):
        wanted[i] = ahead.get(k)
        if v is not None and v > 1:
            ahead[k] = v
    for slab in (None, F.col("day"), F.floor(F.col("day") / 30)):
        found = align.next_matching(df, "k", ["day", "pos"], F.col("v") > 1, "v", slab)
        assert found.columns == [*df.columns, "next_v"] and {x.pos: x.next_v for x in found.collect()} == wanted
    assert align.next_matching(df.limit(0), "k", ["day", "pos"], F.col("v") > 1, "v").collect() == []


def test_blocks_equal_a_plain_loop(spark):
    r = random.Random(2)
    rows = [(r.choice("xy"), i, r.choice(["A", "B", None, None, None])) for i in range(200)]
    wanted, seen, now = {}, {}, {}
    for f, i, h in rows:
        if h is not None:
            seen[f, h] = seen.get((f, h), 0) + 1
            now[f] = [h, seen[f, h], 0]
        else:
            own = now.setdefault(f, ["none", 0, 0])
            own[2] += 1
            wanted[i] = tuple(own)
    df = spark.createDataFrame(rows, "file string, pos int, header string").repartition(4)
    for width in (3, 50):
        found = scan.blocks(df, ["file"], "pos", "header", F.floor(F.col("pos") / width), "none").collect()
        assert {x.pos: (x.block, x.occurrence, x.idx) for x in found} == wanted


def test_levels_do_not_depend_on_slabs(spark):
    r = random.Random(3)
    rows = [(k, round(r.uniform(0, 40), 1)) for k in (1, 2) for _ in range(150)] + [(3, 5.0)] * 9
    df = spark.createDataFrame(rows, "cloud int, y double")
    found = {tuple(x) for x in points.levels(df, "cloud", "y", slab_gaps=1).select("cloud", "level", F.round("mean", 9), "n").collect()}
    assert found == {tuple(x) for x in points.levels(df, "cloud", "y", slab_gaps=10_000).select("cloud", "level", F.round("mean", 9), "n").collect()}
    assert (3, 0, 5.0, 9) in found and sum(x[3] for x in found) == len(rows)


def test_a_ratio_never_exceeds_its_bound(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdé3.") for _ in range(r.randint(0, 9))) for _ in range(400)]
    for other in ("abcde", "b3", "aaab."):
        bounds = {x.w: x.most for x in spark.createDataFrame([(w,) for w in words], "w string").select("w", search.reach(F.col("w"), other).alias("most")).collect()}
        assert all(difflib.SequenceMatcher(None, w, other).ratio() <= bounds[w] + 1e-12 for w in words if w)


def test_many_terms_equal_one_at_a_time(spark):
    r = random.Random(5)
    words = sorted({"".join(r.choice("ab9.") for _ in range(r.randint(1, 7))) for _ in range(300)})
    terms = ["ab", "aba", "9.ba", "b", "d9", "", "bbb9a."]
    vocabulary = spark.createDataFrame([(w,) for w in words], "t string")
    found = {(x.term, x.t): x.score for x in search.many_terms(vocabulary, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    wanted = {}
    for t in terms:
        theirs = search.spellings(spark, t)
        for x in vocabulary.withColumn("m", text.match(text.variants(F.col("t")), F.array(*map(F.lit, theirs)).cast("array<string>"))).where("m is not null").collect():
            wanted[t, x.t] = 3.0 if x.m == "exact" else 2.0
    assert found == wanted and 2.0 in wanted.values() and 3.0 in wanted.values()


def test_rounding_is_by_the_exact_value(spark):
    r = random.Random(6)
    values = [0.0005, 0.0015, 2.0675, 2.675, 1.0005, -0.0005, 1e-320, 0.0, 1e300, 2.0**43 + 0.5, 8796093022207.999, float("inf"), 0.125, 0.0625, 0.3125, 1.0625]
    values += [r.uniform(-100, 100) for _ in range(3000)] + [round(r.uniform(0, 50), 3) + 0.0005 for _ in range(3000)] + [r.uniform(1e9, 1e13) for _ in range(500)] + [k / 16 + j for k in range(16) for j in range(50)]
    found = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("w", points.rounded_exactly(F.col("v"))).collect()
    assert [x.w for x in sorted(found)] == [round(v, 3) for v in values]


def test_same_sets_stand_a_constant_offset_apart(spark):
    sets = {1: [1.0, 2.5, 2.5, 9.0], 2: [11.0, 12.5, 12.5, 19.0], 3: [1.0, 2.5, 9.0, 9.0], 4: [9.0, 2.5, 1.0, 2.5], 5: [7.0], 6: [8.0], 7: [1.0, 2.5, 9.0]}
    rows = [(k, v) for k, vs in sets.items() for v in vs]
    found = {tuple(x) for x in points.same_sets(spark.createDataFrame(rows, "file int, v double"), "file", "v").collect()}
    assert found == {(1, 1, 3), (2, 1, 3), (4, 1, 3), (5, 5, 2), (6, 5, 2)}


def test_natural_order(spark):
    codes = ["A10", "a2", "A2", "B1", "3212", "3051", "212", "A02", "a", "", "A2b10", "A2b9"]
    found = [x.c for x in spark.createDataFrame([(c,) for c in codes], "c string").orderBy(names.natural_key(F.col("c")), "c").collect()]
    assert found == ["", "212", "3051", "3212", "a", "A02", "A2", "a2", "A2b9", "A2b10", "A10", "B1"]


def test_inline_marks(spark):
    lines = ["plain **bold** *it* `co*de`", "* item **b**", "- two", "", "**x", "***", "a ** b"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc int, pos int, line string")
    found = [(x.kind, x.part, x.at, x.mark, x.text) for x in search.inline_marks(search.line_islands(df, "doc")).orderBy("first", "part", "at").collect()]
    assert found[:8] == [("text", 0, 0, "plain", "plain "), ("text", 0, 1, "bold", "bold"), ("text", 0, 2, "plain", " "), ("text", 0, 3, "italic", "it"), ("text", 0, 4, "plain", " "), ("text", 0, 5, "code", "co*de"), ("list", 0, 0, "plain", "item "), ("list", 0, 1, "bold", "b")]
    assert ("list", 1, 0, "plain", "two") in found and [x for x in found if x[0] == "text"][6:]
    assert [(x["kind"], x.n) for x in search.line_islands(df, "doc").orderBy("first").collect()] == [("text", 1), ("list", 2), ("text", 4)]


def test_deletions_reach_all_levels_and_refuse_cycles(spark):
    t = {
        "a": spark.createDataFrame([(1,), (2,)], "id int"),
        "b": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, a int"),
        "c": spark.createDataFrame([(100, 10, 1), (101, 11, 1), (102, 12, 2), (103, None, 2)], "id int, b int, a int"),
    }
    R = catalog.Reference
    references = [R("b", "a", "a", "id", "cascade"), R("c", "b", "b", "id", "null"), R("c", "a", "a", "id", "cascade")]
    out = catalog.delete_through(t, references, "a", F.col("id") == 1)
    assert {tuple(x) for x in out["b"].collect()} == {(11, 2), (12, None)} and {tuple(x) for x in out["c"].collect()} == {(102, 12, 2), (103, None, 2)}
    out = catalog.delete_through(t, references[:2], "a", F.col("id") == 1)
    assert {tuple(x) for x in out["c"].collect()} == {(100, None, 1), (101, 11, 1), (102, 12, 2), (103, None, 2)}
    with pytest.raises(ValueError, match="cycle"):
        catalog.delete_through(t, [*references, R("a", "id", "c", "id", "cascade")], "a", F.col("id") == 1)


def test_cache_is_made_anew_when_it_must(spark, tmp_path):
    calls, at = [], f"file://{tmp_path}/cache"

    def compute():
        calls.append(1)
        return spark.range(len(calls) + 2).select(F.col("id").alias("v"))

    get = lambda signature, **more: reports.cached(spark, at, signature, compute, **more).count()
    assert get({"bytes": 5}) == 3 and get({"bytes": 5}) == 3 and len(calls) == 1  # none yet, then kept
    assert get({"bytes": 6}) == 4 and len(calls) == 2  # unequal
    assert get({"bytes": 6}, force=True) == 5  # forced
    data = next(p for p in tmp_path.glob("cache/data-*/part-*.parquet") if p.parent.name == folders.read_json(spark, f"{at}/manifest.json")["data"])
    data.unlink()
    assert get({"bytes": 6}) == 6  # files are missing
    (tmp_path / "cache/manifest.json").write_text('{"signature": {"by')
    (tmp_path / "cache/.manifest.json.crc").unlink()
    assert get({"bytes": 6}) == 7 and get({"bytes": 6}) == 7  # a manifest that is torn


def test_places_equal_a_sort(spark):
    r = random.Random(7)
    values = r.sample(range(100_000), 5000)
    found = catalog.numbered(spark.createDataFrame([(v, "x" * (v % 50)) for v in values], "v int, more string").repartition(7), [F.col("v")]).collect()
    assert {x.v: x.place for x in found} == {v: i for i, v in enumerate(sorted(values), 1)}
