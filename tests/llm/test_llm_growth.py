"""Steps of the corpus operators whose size Spark judges wrongly, and what they store: what only shows in larger tables."""

from __future__ import annotations

import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gauge.llm import content_store, jpeg_media, ngram_group_join, source_mix
from gauge.llm.common import Tables
from gauge.llm.tokens import WordEncoder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joins_of_blocks(df):
    """The kinds of the joins on a block's number, as they ran."""
    df.collect()
    return set(re.findall(r"(\w+Join) \[[^\]]*block_no", plan(df).partition("== Initial Plan ==")[0]))


def test_slots_of_the_mix_are_not_sent_to_all(spark):
    """the blocks' uses, a row a block, passed through the driver."""
    documents = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.repeat(F.lit("a word "), 50).alias("text"))
    for mixed in (source_mix.taken_words, source_mix.taken_texts, source_mix.mixed_texts):
        assert joins_of_blocks(mixed(documents)) == {"SortMergeJoin"}


def test_media_of_texts_are_small():
    """op5_jpeg_media: a space was a coefficient of seven bits, a letter one of up to five; media took 9 bits a byte."""
    texts = [t.encode() for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t]
    filled = [t.ljust(-(-len(t) // jpeg_media.UNIT) * jpeg_media.UNIT) for t in texts]
    media = jpeg_media.encode(np.frombuffer(b"".join(filled), np.uint8), np.cumsum([0, *map(len, filled)]))
    assert 8 * sum(map(len, media)) < 7 * sum(map(len, texts))
    assert [jpeg_media.payload(*x) for x in jpeg_media.decode(media[:50])] == filled[:50]


def test_every_byte_has_a_coefficient_of_its_own():
    assert sorted(jpeg_media._BYTE[jpeg_media._COEFFICIENT.astype(int) + 128]) == list(range(256)) and len(set(jpeg_media._COEFFICIENT)) == 256
    assert jpeg_media._COEFFICIENT[jpeg_media.ORIGIN] == 0


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_one_text_of_a_pair_travels_to_the_other(spark, monkeypatch, most):
    """op6_ngram_group_join: the texts of both ends were dealt out, and then those of one end once more."""
    documents = spark.createDataFrame([(i, f"a b c d e f g h i j {'x' if i == 3 else 'k'}") for i in range(4)], "doc_id long, text string")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3)], "a long, b long")
    plans, keep = {}, Tables.keep

    def kept(self, name, df):
        plans[name] = plan(df)
        return keep(self, name, df)

    monkeypatch.setattr(Tables, "keep", kept)
    monkeypatch.setattr(ngram_group_join, "BROADCAST_IDS", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where pairs are too many for Spark to send them by itself
    try:
        found = ngram_group_join.verified(pairs, documents, Tables(spark, "near"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, found.collect())) == [(0, 1), (0, 2), (1, 2)]
    if most:
        assert "[a#" in plans["found"] and plans["found"].count("hashpartitioning(") == 2 and "hashpartitioning(a#" not in plans["found"]


def test_store_encodes_known_letters_without_python(monkeypatch):
    """Finding 3: each distinct word of a group was put together in Python, also of letters and marks that the worker knew."""
    own, merged = WordEncoder(content_store.vocabulary(), spaced=True, words=10), []
    merge = own._merged
    monkeypatch.setattr(own, "_merged", lambda x, lead: (merged.extend(map(str, x)), merge(x, lead))[1])
    for marks in (".", ",", ";", "!", "?", ""):
        for other in "bcdfgh":
            text = f"a Wort{marks}\nZeile{marks} {other * 7}"
            assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert merged.count("Wort") == merged.count("Zeile") == 1
