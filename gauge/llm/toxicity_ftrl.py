"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are which hashes occur in it: words, two-word n-grams, two-word skip-grams over one
word, and word beginnings of four to six bytes (so that inflected forms share a feature). Per-coordinate
rates and an L1 penalty leave few weights, which are broadcast: at most one a bucket.

Labels come from a bounded sample of labelled documents, chosen by hash. Each of a few shards of it
trains its own weights and the shards' weights are averaged.

Defined results: null and empty texts get the model's prior; repeated rows repeat their result; labels
that are null are not used; a document labelled twice counts as toxic if any label says so; without any
label every score is 0; an empty table gives an empty result; further columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauge.llm.common import Words, binary_column, mix, runs, text_bytes, trimmed

#: log2 of the number of buckets; labelled documents used at most, in expectation; documents of a shard.
BITS, TRAINING_DOCUMENTS, SHARD_DOCUMENTS = 20, 24_000, 8_000
PASSES, ALPHA, BETA, L1, L2 = 3, 1.0, 1.0, 6.0, 0.5
THRESHOLD = 0.3
PRIOR = 1 << BITS  # the position of the prior's weight

#: Letters and digits; all bytes of other alphabets count as letters.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x30:0x3A] = LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct buckets of its features."""
    shift = np.uint64(64 - bits)
    for lo, hi in runs(offsets):
        words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], LETTERS)
        whole, four, five, six = words.hashes(4, 5, 6)
        one, k = mix(whole * np.uint64(3)) >> shift, np.uint64(0x9E3779B97F4A7C15)
        starts = [mix(x + np.uint64(i)) >> shift for i, x in ((4, four), (5, five), (6, six))]
        two = mix(whole[:-1] * k + whole[1:]) >> shift
        skip = mix(whole[:-2] * k + whole[2:] + np.uint64(77)) >> shift
        bound = np.searchsorted(words.text, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            a, b = bound[i], bound[i + 1]
            yield np.unique(np.concatenate([one[a:b], *(x[a:b] for x in starts), two[a : max(a, b - 1)], skip[a : max(a, b - 2)]])).astype(np.int64)


def margin(weights: np.ndarray, x: np.ndarray) -> float:
    return float(weights[x].sum() + weights[PRIOR])


def train_shard(rows: list[tuple[np.ndarray, int]], passes: int = PASSES) -> np.ndarray:
    """Weights of one shard: FTRL-proximal with a rate of its own for each coordinate."""
    z, n, w = np.zeros(PRIOR + 1), np.zeros(PRIOR + 1), np.zeros(PRIOR + 1)
    order = np.random.default_rng(11)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            x, y = rows[i]
            x = np.append(x.astype(np.int64), PRIOR)
            own_z, own_n = z[x], n[x]
            step = (BETA + np.sqrt(own_n)) / ALPHA
            own_w = np.where(np.abs(own_z) <= L1, 0.0, (np.sign(own_z) * L1 - own_z) / (step + L2))
            p = 1 / (1 + np.exp(-np.clip(own_w.sum(), -30, 30)))
            g = p - y
            sigma = (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / ALPHA
            z[x], n[x] = own_z + g - sigma * own_w, own_n + g * g
    on = np.abs(z) > L1
    w[on] = (np.sign(z[on]) * L1 - z[on]) / ((BETA + np.sqrt(n[on])) / ALPHA + L2)
    return w


def learnable() -> F.Column:
    """Rows whose labels may be learned."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2


def fit(documents: DataFrame, labels: DataFrame, n_documents: int = TRAINING_DOCUMENTS) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the weights that are not 0."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(learnable())
    total = known.count()
    chosen = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("ftrl")), F.lit(1 << 20)) < int(min(1.0, n_documents / max(total, 1)) * (1 << 20)))
    shards = max(1, -(-min(total, n_documents) // SHARD_DOCUMENTS))
    texts = documents.select("doc_id", text_bytes().alias("text"))
    # the sample has a bound, so it can be sent to the documents instead of these to it
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")

    @trimmed
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [f.astype(np.int32).tobytes() for f in features(*binary_column(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), batch.column(2)], names=["doc_id", "x", "toxic"])

    def shard(rows: pa.Table) -> pa.Table:
        # the features stay where Arrow has them; only their order is made
        x = [np.frombuffer(b.as_buffer(), np.int32) for c in rows["x"].chunks for b in c]
        y, order = rows["toxic"].to_pylist(), np.argsort(rows["doc_id"].to_numpy(), kind="stable").tolist()
        w = train_shard([(x[i], y[i]) for i in order])
        on = np.flatnonzero(w)
        return pa.table({"position": pa.array(on, pa.int64()), "weight": pa.array(w[on])})

    ready = rows.mapInArrow(hashed, "doc_id long, x binary, toxic int").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    weights = ready.groupBy("shard").applyInArrow(shard, "position long, weight double").groupBy("position").agg((F.sum("weight") / shards).alias("weight"))
    found = weights.orderBy("position").toPandas()
    return found["position"].to_numpy(np.int64), found["weight"].to_numpy(np.float64)


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if the score reaches ``threshold``) for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @trimmed
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions, values = shared.value
        weights = np.zeros(PRIOR + 1)
        weights[positions] = values
        for batch in batches:
            m = np.array([margin(weights, x) for x in features(*binary_column(batch.column(1)))]) if len(positions) else np.full(len(batch), -np.inf)
            p = np.round(1 / (1 + np.exp(-np.clip(m, -700, 700))), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p if len(positions) else np.zeros(len(batch)), pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(rate, "doc_id long, score double, predicted int")


def without_toxic(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` whose score stays below ``threshold``; rows are scored where they are, without a join."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @trimmed
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions, values = shared.value
        weights = np.zeros(PRIOR + 1)
        weights[positions] = values
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            text = pa.array([b"" if x is None else x for x in text.to_pylist()], pa.binary()) if text.null_count else text
            m = np.array([margin(weights, x) for x in features(*binary_column(text))])
            low = 1 / (1 + np.exp(-np.clip(m, -700, 700))) < threshold if len(positions) else np.ones(len(batch), bool)
            yield batch.filter(pa.array(low))

    return documents.mapInArrow(keep, documents.schema)
