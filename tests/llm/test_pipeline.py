"""The corpus pipeline over the smallest tables."""

from __future__ import annotations

import random

import corpus_pipeline
from gauge.llm import lsm_dedup, source_mix

SMALL = "/root/testdata/sf0.001"


def test_stages_are_named_and_ordered():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix_sources", "packing"]


def test_each_stage_acts_on_what_is_left(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids.append({r.doc_id for r in docs.collect()})
        assert ids[-1] and ids[-1] <= ids[-2]
    assert ids[-1] == ids[-2]
    texts = [r.text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for r in spark.read.parquet(str(tmp_path / "near_dedup")).collect()]
    assert len(texts) == len(set(texts))


def test_mixing_meets_the_targets(spark):
    stage = dict(corpus_pipeline.STAGES)["mix_sources"]
    words = [f"w{i}" for i in range(97)]
    # long and short documents of sources whose targets are below, above and far above their sizes
    sizes = {"a": [40, 300] * 6, "b": [20, 900, 3000] * 8, "c": [50, 2500, 6000] * 8}
    rows = [(f"{source}{i}", source, "\n ".join(words[(i + j) % 97] for j in range(n))) for source, ns in sizes.items() for i, n in enumerate(ns)]
    rows = [(k, text, "en", source, len(text)) for k, (_, source, text) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out, given = stage(spark, docs, SMALL).collect(), {r[0]: r for r in rows}
    target = {r.source: (r.target, r.source_size) for r in source_mix.taken_words(docs).select("source", "target", "source_size").distinct().collect()}
    assert any(t < 0.5 * s for t, s in target.values()) and any(t > 1.5 * s for t, s in target.values())
    for source, (wanted, _) in target.items():
        assert abs(sum(len(r.text.split()) for r in out if r.source == source) - wanted) <= 2 * source_mix.BLOCK_WORDS
    taken = {r.doc_id: r.taken for r in source_mix.taken_words(docs).collect()}
    for doc_id, (_, text, *_) in given.items():
        own = [r for r in out if r.doc_id == doc_id]
        assert sum(len(r.text.split()) for r in own) == taken[doc_id]
        assert all(r.text in text and r.n_chars == len(r.text) and r.lang == "en" for r in own)


def test_passages():
    assert source_mix.passages([]) == []
    assert source_mix.passages([(0, 5, 1), (5, 64, 1), (69, 3, 1)]) == [(0, 72)]
    assert source_mix.passages([(0, 5, 2), (5, 64, 1), (133, 3, 2)]) == [(0, 69), (133, 136), (0, 5), (133, 136)]


def test_repeated_rows_and_rows_without_id(spark):
    stages, rng = dict(corpus_pipeline.STAGES), random.Random(3)
    text = [" ".join(f"word{rng.randrange(5000)}" for _ in range(150)) for _ in range(7)]
    near = text[5] + " end"
    rows = [(1, text[0]), (1, text[0]), (1, text[0]), (2, text[1]), (2, text[2]), (None, text[3]), (None, text[3].upper()), (None, text[4]), (3, text[5]), (None, text[5]), (None, near), (None, text[6]), (None, text[6] + " end"), (4, text[0].upper())]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = stages["exact_dedup"](spark, docs, SMALL).localCheckpoint()
    got = sorted((r.doc_id or 0, r.text.lower()) for r in exact.collect())
    assert got == sorted([(4, text[0]), (2, text[1]), (2, text[2]), (0, text[3]), (0, text[4]), (3, text[5]), (0, near), (0, text[6]), (0, text[6] + " end")])
    same = lsm_dedup.dedup(docs).where("kept").count()
    assert len(got) == same
    for given in (docs, exact):
        found = [(r.doc_id or 0, r.text.lower()) for r in stages["near_dedup"](spark, given, SMALL).collect()]
        assert len(found) == 7 and {(1 if i == 4 else i, t) for i, t in found if t not in (text[6], text[6] + " end")} == {(1, text[0]), (2, text[1]), (2, text[2]), (0, text[3]), (0, text[4]), (3, text[5])}
    # one source is taken in full: each row once, equal rows as often as they stand there
    mixed = stages["mix_sources"](spark, docs, SMALL).localCheckpoint()
    wanted, words = sum(len(t.split()) for _, t in rows), sum(len(r.text.split()) for r in mixed.collect())
    assert abs(words - wanted) <= source_mix.BLOCK_WORDS
    assert sorted((r.doc_id or 0, r.text) for r in mixed.collect()) == sorted((i or 0, t) for i, t in rows)
    assert stages["packing"](spark, mixed, SMALL).where("start = 0").count() == len(rows)
