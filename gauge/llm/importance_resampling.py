"""Quality selection by importance resampling: a target and a raw model of hashed n-grams, and Gumbel top-k.

Both models are bags of hashed words, punctuation runs and pairs of neighbours. A document's log weight is
the log ratio of its probability under the target model (documents labelled good) and under the raw model
(all documents). Adding Gumbel noise, a fixed function of seed and doc_id, and keeping the k largest draws k
documents without replacement in proportion to their weights. k is a share of all documents: by default the
share of good ones among the labelled.

Labels are learned from rows whose crc32(doc_id as text) mod 4 is not 2. The target model counts a bounded
sample of labelled documents; the raw model counts every document.

Defined results: null and empty texts have the log weight 0; null labels are not used; without good labels
all weights are 0; ties go to the smallest doc_id, rows without one first, then to any of the repeated rows, which
are documents of their own, so that exactly k rows are selected; an empty table gives an empty result; further columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauge.llm.common import Words, binary_column, cut_lineage, mix, runs, text_bytes, trimmed
from gauge.operators.catalog import numbered

#: log2 of the number of n-gram buckets; labelled documents that the target model counts, in expectation; pseudocount.
BITS, TARGET_DOCUMENTS, PSEUDOCOUNT = 16, 50_000, 1.0
#: Parts of the count tables that are summed apart; width of the histogram that finds the k-th key.
SLICES, LEVELS = 16, 1024

_ALNUM, _MARKS = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
_MARKS[0x21:0x7F] = ~_ALNUM[0x21:0x7F]


def buckets(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of all n-grams, a run of texts at a time: words, punctuation runs and neighbours of both kinds."""
    shift = np.uint64(64 - bits)
    for lo, hi in runs(offsets):
        own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        words, marks = Words(own, at, _ALNUM), Words(own, at, _MARKS)
        h = np.concatenate([words.hashes()[0], mix(marks.hashes()[0] + np.uint64(1))])
        text, start = np.concatenate([words.text, marks.text]), np.concatenate([words.start, marks.start])
        order = np.argsort(start, kind="stable")
        h, text = h[order], text[order]
        pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[text[:-1] == text[1:]]
        yield np.concatenate([text, text[:-1][text[:-1] == text[1:]]]) + lo, (np.concatenate([h, pair]) >> shift).astype(np.int64)


def counts(texts: DataFrame, bits: int = BITS) -> np.ndarray:
    """How often each bucket occurs in a column of byte strings. Each task sends one table, in slices."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, b in buckets(*binary_column(batch.column(0)), bits):
                total += np.bincount(b, minlength=1 << bits)
        parts = total.reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(parts.tolist(), pa.list_(pa.int64()))], names=["slice", "n"])

    tables = texts.mapInArrow(count, "slice int, n array<bigint>").select("slice", F.posexplode("n").alias("at", "n")).where("n > 0")
    # the sums have one row a bucket
    found = tables.groupBy("slice", "at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits, np.int64)
    out[found["slice"].to_numpy(np.int64) * ((1 << bits) // SLICES) + found["at"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def fit(documents: DataFrame, labels: DataFrame, n_documents: int = TARGET_DOCUMENTS) -> tuple[np.ndarray, float]:
    """Log ratio of each bucket, and the share of good documents among the labelled ones that may be learned."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    state = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good")).first()
    share = state["good"] / state["n"] if state["n"] else 1.0
    part = int(min(1.0, n_documents / max(state["good"], 1)) * (1 << 20))
    target = known.where((F.col("quality") == 1) & (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("target")), F.lit(1 << 20)) < part)).select("doc_id")
    raw = counts(documents.select(text_bytes().alias("text")))
    # the sample has a bound, so it is sent to the documents
    good = counts(documents.join(F.broadcast(target), "doc_id", "left_semi").select(text_bytes().alias("text")))
    if not good.sum():
        return np.zeros(len(raw)), share
    return np.log((good + PSEUDOCOUNT) / (good + PSEUDOCOUNT).sum()) - np.log((raw + PSEUDOCOUNT) / (raw + PSEUDOCOUNT).sum()), share


def weigh(documents: DataFrame, ratio: np.ndarray, seed: int = 3) -> DataFrame:
    """doc_id, log_weight, n_grams and key, the log weight with Gumbel noise."""
    shared = documents.sparkSession.sparkContext.broadcast(ratio)

    @trimmed
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        bits = len(ratio).bit_length() - 1
        for batch in batches:
            weight, n = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for text, b in buckets(*binary_column(batch.column(1)), bits):
                weight += np.bincount(text, weights=ratio[b], minlength=len(batch))
                n += np.bincount(text, minlength=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(weight, 6)), pa.array(n)], names=["doc_id", "log_weight", "n_grams"])

    rated = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(rate, "doc_id long, log_weight double, n_grams long")
    uniform = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return rated.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of a column ``key`` of doubles, by histograms that narrow in on it; no sort of all rows."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while high > low:
        width = (high - low) / LEVELS
        if width == 0 or low + width == low:
            break
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        level = F.least(F.floor((F.col("key") - low) / width).cast("int"), F.lit(LEVELS - 1))
        rows = inside.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("level")).collect()
        for r in rows:
            if r["n"] >= k:
                break
            k -= r["n"]
        low, high = r["lo"], r["hi"]
    return low


def resample(documents: DataFrame, ratio: np.ndarray, share: float, seed: int = 3) -> DataFrame:
    """Every row: doc_id, log_weight, n_grams, key and selected, true for the round(share * rows) largest keys."""
    # rows are numbered once: the checkpoint keeps the numbers
    rated = cut_lineage(weigh(documents, ratio, seed).withColumn("row", F.monotonically_increasing_id()))
    n = rated.count()
    k = min(n, round(share * n))
    if not k:
        return rated.drop("row").withColumn("selected", F.lit(False))
    least = kth_largest(rated.select("key"), k)
    room = k - rated.where(F.col("key") > least).count()
    # rows that tie with the k-th key: as many as there is room for, smallest doc_id first, then by the row's number
    ties = numbered(rated.where(F.col("key") == least), [F.col("doc_id").asc_nulls_first(), F.col("row").asc()])
    others = rated.where(F.col("key") != least).withColumn("selected", F.col("key") > least)
    return others.unionByName(ties.withColumn("selected", F.col("place") <= room).drop("place")).drop("row")
