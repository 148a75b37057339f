"""The corpus pipeline: toxicity, exact dedup, near duplicates, mixing sources, packing.

Each stage takes the documents that its predecessor kept, as a DataFrame of the columns of ``documents``,
and is written as Parquet and read again before the next one.

Defined results: a row without doc_id is a document of its own. Toxicity, mixing and packing treat repeated rows
as documents of their own; of rows that repeat a text, or nearly, the dedup stages keep one, also where they carry
one doc_id. A doc_id goes before none: a row without one only stays if no row of its text, or near it, has one.

A stage's result is lazy and holds whole texts, so each stage sets the session's Arrow batches to ``BATCH_ROWS`` rows
at most; ``run`` puts the session's setting back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gauge.llm import lsm_dedup, ngram_group_join, nnls_packing, source_mix, toxicity_ftrl
from gauge.llm.common import BATCH_ROWS, BATCHES, Tables, read_table, remove, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows that go, at most, whose keys are sent to the documents; beyond, both are joined by a shuffle.
BROADCAST_KEYS = 2_000_000


def _few_rows_a_batch(spark: SparkSession) -> None:
    """Python and the JVM hold a batch of texts each; of long texts one of the usual size is large."""
    now = int(spark.conf.get(BATCHES))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(BATCHES, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict to be toxic; it learns from their labelled part."""
    _few_rows_a_batch(spark)
    model = toxicity_ftrl.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity_ftrl.without_toxic(docs.select(*COLUMNS), model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the one with the largest doc_id."""
    _few_rows_a_batch(spark)
    docs, repeats = _keyed(docs, largest=True)
    found = lsm_dedup.dedup(_by_key(docs))
    return _kept(docs, found.select(F.col("doc_id").alias("key"), "kept"), repeats)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: the one with the smallest doc_id."""
    _few_rows_a_batch(spark)
    docs, repeats = _keyed(docs, largest=False)
    found = ngram_group_join.near_duplicates(_by_key(docs))
    return _kept(docs, found.select(F.col("doc_id").alias("key"), (F.col("doc_id") == F.col("component_id")).alias("kept")), repeats)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, so that each source has the words of its target: a row for each passage of a document.

    A document of which the mix takes every block stays whole, once for each time; of others the passages stay
    that are taken, with the document's doc_id and their own n_chars. Texts without words are never taken.
    """
    _few_rows_a_batch(spark)
    docs, repeats = _keyed(docs, largest=False)
    sizes = docs.select(F.col("key").alias("doc_id"), "source", "text")
    texts = docs.dropDuplicates(["key"]) if repeats else docs
    taken = source_mix.taken_texts(sizes, texts.withColumnRenamed("doc_id", "own_id").withColumnRenamed("key", "doc_id"))
    taken = taken.drop("doc_id").withColumnRenamed("own_id", "doc_id")
    length = F.when(F.col("whole"), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return taken.withColumn("n_chars", length).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece of a document."""
    _few_rows_a_batch(spark)
    return nnls_packing.pack(docs)


def _keyed(docs: DataFrame, largest: bool) -> tuple[DataFrame, bool]:
    """``docs`` with a ``key`` that stands for doc_id in an operator, and whether rows can share one.

    The key is the doc_id where each row has one of its own. Otherwise one row of each doc_id, with all rows equal
    to it, keeps the doc_id; the others, and rows without one, get a number made from their columns, which only
    equal rows share. It is beyond those that doc_id has: below where the ``largest`` stays, else above.
    """
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn("key", F.col("doc_id").cast("long")), False
    docs = docs.withColumn("number", F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)))
    first = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first")).where("n > 1")
    docs = docs.join(first.drop("n"), "doc_id", "left")
    number = F.col("number").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
    own = F.col("doc_id").isNotNull() & (F.coalesce("first", "number") == F.col("number"))
    return docs.select(*COLUMNS, F.when(own, F.col("doc_id").cast("long")).otherwise(-number if largest else number).alias("key")), True


def _by_key(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("key").alias("doc_id"), "text")


def _kept(docs: DataFrame, found: DataFrame, repeats: bool) -> DataFrame:
    """The rows of ``docs`` whose key has a row in ``found`` that is kept; one row of each key."""
    if repeats:
        return docs.join(found.where("kept").select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)
    # each row has a key of its own, so the rows that go name what is left out; few enough, they are sent to the documents
    gone = Tables(docs.sparkSession, "gone").keep("keys", found.where("not kept").select("key"))
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, "key", "left_anti").select(*COLUMNS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("packing", pack),
]

#: The stages hold a trained model, a random mix and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read_table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last, batches = None, spark.conf.get(BATCHES)
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if last:  # nothing reads it any more
                remove(spark, last)
            last = f"{folder}/{name}"
    finally:
        spark.conf.set(BATCHES, batches)
    return docs
