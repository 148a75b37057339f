"""One query per corpus operator, over its whole table; each derives its columns from the operator's result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gauge.llm import content_store, hard_negatives, importance_resampling, jpeg_media, lsm_dedup, ngram_group_join, nnls_packing, periodic_runs, personal_data, secret_crf, source_mix, toxicity_ftrl, wrapper_induction
from gauge.llm.common import read_table


def op1_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    found = secret_crf.scan(documents, secret_crf.fit(documents))

    def joined(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in secret_crf.KINDS]
    base = joined(F.filter("spans", lambda s: s["kind"] != "crf"))
    return found.select("doc_id", *counts[:3], F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), counts[3])


def op2_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = toxicity_ftrl.fit(documents, read_table(spark, sf_dir, "labels"))
    return toxicity_ftrl.score(documents, model).select("doc_id", (~toxicity_ftrl.learnable()).alias("held_out"), "score", "predicted")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken_words(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_lsm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lsm_dedup.dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.media_features(jpeg_media.stored(read_table(spark, sf_dir, "documents")))


def op6_ngram_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_group_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnls_packing.pack(read_table(spark, sf_dir, "documents")).drop("copy")


def op8_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = content_store.new_folder(spark)
    content_store.write(read_table(spark, sf_dir, "documents"), folder)
    return content_store.read(spark, folder)


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return importance_resampling.resample(documents, *importance_resampling.fit(documents, read_table(spark, sf_dir, "labels")))


def op10_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_induction.main_texts(read_table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(read_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(read_table(spark, sf_dir, "documents"))

    def joined(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in personal_data.KINDS]
    spans = F.concat_ws(",", F.nullif(joined(F.col("base")), F.lit("")), F.nullif(joined(F.col("more")), F.lit("")))
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), F.size("more").cast("long").alias("n_context"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op")}
    return found


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can express the operator; tests hold the others against brute force."""
    return {
        "op4_lsm_dedup": """
            WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM d WINDOW w AS (PARTITION BY t)
        """,
        "op12_hard_negatives": """
            WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
                       FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
            p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
            n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
                  FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
            SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
        """,
    }
