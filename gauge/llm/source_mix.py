"""Mixing sources to target weights with fixed-length blocks drawn per output shard.

The words of a source, its documents in a fixed pseudorandom order, are packed into blocks of one length.
Every output shard draws multinomial counts of blocks per source against what is left of each source's
budget, so that the totals end on the targets. A source's k-th slot maps to block ``perm(k mod blocks)``
of its own pseudorandom permutation, so that no block is used again before all others are; slots and
blocks then meet in a join on (source, block).

Defined results: null and empty texts have size 0 and are never taken; a null source is a source of its
own, sorted last; repeated rows, rows that share a doc_id and rows without one are documents of their own; an
empty table gives an empty result; further columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gauge.llm.common import Words, binary_column, cut_lineage, runs, text_bytes, trimmed

#: Weights of the sources in code-point order, repeating; how many times its size a source may be taken.
WEIGHTS, MOST_REPEATS = (5.0, 2.0, 1.0), 3
#: Words of a block at most, and blocks of a source at least (small sources get shorter blocks).
BLOCK_WORDS, LEAST_BLOCKS = 64, 256
#: Slots that one row of the plan is spread to at once.
SLOTS_EACH = 1 << 16
#: Slots of an output shard at least; shards at most; rows of the plan (shards x sources) at most.
SHARD_SLOTS, MOST_SHARDS, MOST_PLAN_ROWS = 4096, 4096, 4_000_000
#: Documents of a bucket when sizes are summed up along a source.
BUCKET_DOCUMENTS = 20_000


def word_count(column: str = "text") -> F.Column:
    """Number of runs without ASCII white space; null: 0."""
    words = F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(words, " \t\n\x0b\x0c\r", "")).cast("long")


def water_fill(sizes: np.ndarray, weights: np.ndarray, total: float, repeats: float = MOST_REPEATS) -> np.ndarray:
    """Shares of ``total`` by weight, none above ``repeats`` times its size; an excess goes to the others by weight."""
    caps = repeats * sizes.astype(np.float64)
    target, full = np.zeros(len(sizes)), np.zeros(len(sizes), bool)
    while True:
        left = total - caps[full].sum()
        free = weights[~full].sum()
        target = np.where(full, caps, left * weights / free if free else 0.0)
        above = ~full & (target > caps)
        if not above.any():
            return target
        full |= above


def permuted(k: F.Column, n: F.Column, key: F.Column, rounds: int = 4) -> F.Column:
    """A pseudorandom permutation of 0 .. n-1 for each key: a Feistel network over the least square a * a >= n.

    Values beyond n walk on. Fewer than 2a + 1 values lie there, so 24 steps end every walk of n up to 121;
    beyond that a step fails with a probability below 0.2, and a walk that has not ended by then raises an error.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")

    def once(x: F.Column) -> F.Column:
        left, right = F.floor(x / a).cast("long"), x % a
        for r in range(rounds):
            left, right = right, (left + F.pmod(F.xxhash64(right, key, F.lit(r)), a)) % a
        return left * a + right

    found = F.aggregate(F.sequence(F.lit(1), F.lit(24)), once(k), lambda acc, _: F.when(acc < n, acc).otherwise(once(acc)))
    # in a loop over one value the walk is made once
    checked = F.transform(F.array(found), lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a permutation's walk did not end")).cast("long")))
    return F.element_at(checked, 1)


def plan_sources(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> list[dict]:
    """Per source, in order: number, size, target, block length, blocks and slots. One row a source is collected."""
    rows = sorted(sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r.source is None, r.source or ""))
    size = np.array([r["size"] for r in rows], dtype=np.int64)
    w = np.array([weights[i % len(weights)] for i in range(len(rows))])
    target = water_fill(size, w, float(size.sum())) if len(rows) else size
    out = []
    for i, r in enumerate(rows):
        block = int(max(1, min(BLOCK_WORDS, r["size"] // LEAST_BLOCKS)))
        blocks = -(-int(r["size"]) // block)
        out.append({"source": r.source, "sid": i, "source_size": int(r["size"]), "target": float(target[i]), "block": block, "blocks": blocks, "slots": min(MOST_REPEATS * blocks, int(target[i] / block + 0.5)), "n": r.n})
    return out


def draw_shards(slots: np.ndarray, seed: int = 5) -> np.ndarray:
    """Counts per output shard and source: multinomial draws by what is left of each source, whose sums are ``slots``."""
    n = int(min(MOST_SHARDS, max(1, MOST_PLAN_ROWS // max(1, len(slots))), -(-int(slots.sum()) // SHARD_SLOTS))) or 1
    left, rng, out = slots.astype(np.int64).copy(), np.random.default_rng(seed), np.zeros((n, len(slots)), np.int64)
    for shard in range(n):
        need = int(left.sum()) if shard == n - 1 else -(-int(left.sum()) // (n - shard))
        while need:  # a draw above what a source has left is drawn again from the others
            took = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[shard] += took
            left -= took
            need -= int(took.sum())
    return out


def pieces(documents: DataFrame, plan: DataFrame, n_documents: int) -> DataFrame:
    """Documents cut at block borders: doc_id, row, sid, block_no, block_word, first_word, words; none for an empty document.

    ``documents`` needs doc_id, source and size. Sums along a source are taken within buckets and over
    buckets, so that no source is ordered in one task.
    """
    buckets = max(1, n_documents // BUCKET_DOCUMENTS)
    own = documents.join(plan, documents["source"].eqNullSafe(plan["p_source"])).drop("p_source")
    own = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit("order")), F.lit(buckets)))
    within = W.partitionBy("sid", "bucket").orderBy("doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    sums = own.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = sums.select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    placed = own.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(ahead, ["sid", "bucket"]).withColumn("at", F.col("ahead") + F.col("inner"))
    first, last = F.floor(F.col("at") / F.col("block")).cast("long"), F.floor((F.col("at") + F.col("size") - 1) / F.col("block")).cast("long")
    cut = placed.where(F.col("size") > 0).withColumn("block_no", F.explode(F.sequence(first, last)))
    begin, end = F.greatest(F.col("at"), F.col("block_no") * F.col("block")), F.least(F.col("at") + F.col("size"), (F.col("block_no") + 1) * F.col("block"))
    return cut.select("doc_id", "row", "m1", "m2", "sid", "block_no", (begin - F.col("block_no") * F.col("block")).alias("block_word"), (begin - F.col("at")).alias("first_word"), (end - begin).alias("words"))


def mix(documents: DataFrame, seed: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, pieces, slots): documents with source figures, pieces of blocks, and the mix as (shard, sid, slot, block_no)."""
    spark = documents.sparkSession
    sizes = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), *text_marks())
    sizes = cut_lineage(sizes.withColumn("row", F.monotonically_increasing_id()))
    plan = plan_sources(sizes)
    table = spark.createDataFrame([(p["source"], p["sid"], p["source_size"], p["target"], p["block"], p["blocks"]) for p in plan], "p_source string, sid int, source_size long, target double, block long, blocks long")
    if len(plan) <= 10_000:
        table = F.broadcast(table)
    counts = draw_shards(np.array([p["slots"] for p in plan], dtype=np.int64), seed) if plan else np.zeros((0, 0), np.int64)
    before = np.concatenate([np.zeros((1, len(plan)), np.int64), np.cumsum(counts, axis=0)])[:-1] if len(counts) else counts
    drawn = [(int(s), int(i), int(before[s, i]), int(counts[s, i]), int(plan[i]["blocks"])) for s in range(len(counts)) for i in np.flatnonzero(counts[s])]
    shards = spark.createDataFrame(drawn, "shard int, sid int, first_slot long, n long, blocks long").repartition(max(1, min(len(drawn), spark.sparkContext.defaultParallelism * 4)))
    # a shard's slots are counted out in parts of a bounded size
    parts = shards.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLOTS_EACH).cast("long")))).withColumn("from", F.col("first_slot") + F.col("k") * SLOTS_EACH)
    slots = parts.withColumn("slot", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + SLOTS_EACH, F.col("first_slot") + F.col("n")) - 1)))
    turn = F.floor(F.col("slot") / F.col("blocks")).cast("long")
    slots = slots.select("shard", "sid", "slot", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.concat_ws(":", F.lit(seed), "sid", turn)).alias("block_no"))
    return sizes.join(table, sizes["source"].eqNullSafe(F.col("p_source"))).drop("p_source", "block", "blocks"), pieces(sizes, table.select("p_source", "sid", "block"), sum(p["n"] for p in plan)), slots


def times_used(slots: DataFrame) -> DataFrame:
    """How often the mix takes each block: sid, block_no and times.

    Spark judges slots by the few rows of the plan that they are spread from and would send all of them through the
    driver, so these rows only meet others by sorting both sides.
    """
    return slots.groupBy("sid", "block_no").agg(F.count(F.lit(1)).alias("times")).hint("merge")


def taken_words(documents: DataFrame, seed: int = 5) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken, the words that the mix takes of it."""
    sizes, cut, slots = mix(documents, seed)
    taken = cut.join(times_used(slots), ["sid", "block_no"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return sizes.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "row")


def text_marks() -> list[F.Column]:
    """Two hashes that tell texts of one doc_id apart."""
    return [F.xxhash64("text", F.lit(i)).alias(f"m{i}") for i in (1, 2)]


def mixed_texts(documents: DataFrame, seed: int = 5) -> DataFrame:
    """The mix itself: shard, sid, slot and text, the block's words joined by single spaces."""
    _, cut, slots = mix(documents, seed)
    words = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *text_marks(), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"))
    words = words.dropDuplicates(["doc_id", "m1", "m2"])
    part = F.array_join(F.slice("w", F.col("first_word").cast("int") + 1, F.col("words").cast("int")), " ")
    same = [cut[c].eqNullSafe(words[c]) for c in ("m1", "m2", "doc_id")]
    parts = cut.join(words, same).select("sid", "block_no", F.struct("block_word", part.alias("part")).alias("p"))
    # a block holds at most BLOCK_WORDS words, so the pieces collected for it are as few
    blocks = parts.groupBy("sid", "block_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]), " ").alias("text"))
    return slots.hint("merge").join(blocks, ["sid", "block_no"]).select("shard", "sid", "slot", "text")


def passages(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Ranges of words (first, end) that together hold each word as often as its piece is taken, as few as that allows.

    ``pieces`` are (first word, words, times) in order; pieces that follow one another without a gap are joined.
    """
    out = []
    for turn in range(max((times for _, _, times in pieces), default=0)):
        at = None
        for first, words, times in pieces:
            if times <= turn:
                continue
            if at is not None and at[1] == first:
                at = (at[0], first + words)
                continue
            if at is not None:
                out.append(at)
            at = (first, first + words)
        if at is not None:
            out.append(at)
    return out


def taken_texts(documents: DataFrame, texts: DataFrame | None = None, seed: int = 5) -> DataFrame:
    """What the mix takes of each document: its columns, a row for each passage, and ``whole``: whether it is the whole text.

    A passage keeps the white space between its words, and a whole text all of it. The columns come from ``texts``,
    or from ``documents``: there each doc_id stands once. Rows of ``documents`` that share a doc_id are alike.
    """
    _, cut, slots = mix(documents, seed)
    texts = documents if texts is None else texts
    # a document has as many pieces as blocks that it meets
    pieces_of = cut.join(times_used(slots), ["sid", "block_no"]).groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("first_word", "words", F.col("times").cast("int").alias("times")))).alias("pieces")).drop("row")

    @trimmed
    def passage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, taken = batch.schema.get_field_index("text"), batch.schema.get_field_index("pieces")
            names = [n for n in batch.schema.names if n not in ("text", "pieces")]
            data, offsets = binary_column(batch.column(text))
            for lo, hi in runs(offsets):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                bound = np.searchsorted(words.text, np.arange(hi - lo + 1))
                rows, texts, whole = [], [], []
                for i in range(lo, hi):
                    a, n = bound[i - lo], bound[i - lo + 1] - bound[i - lo]
                    for first, end in passages([(p["first_word"], p["words"], p["times"]) for p in batch.column(taken)[i].as_py()]):
                        full = first == 0 and end == n
                        begin, stop = (offsets[i], offsets[i + 1]) if full else (offsets[lo] + words.start[a + first], offsets[lo] + words.end[a + end - 1])
                        rows.append(i), texts.append(data[begin:stop].tobytes()), whole.append(full)
                own = [batch.column(batch.schema.get_field_index(n)).take(pa.array(rows, pa.int64())) for n in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.binary()), pa.array(whole, pa.bool_())], names=[*names, "text", "whole"])

    rest = [c for c in texts.columns if c != "text"]
    rows = texts.select(*rest, text_bytes().alias("text")).join(pieces_of, "doc_id").select(*rest, "text", "pieces")
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    found = rows.mapInArrow(passage, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "text binary", "whole boolean"]))
    return found.withColumn("text", F.col("text").cast("string")).select(*texts.columns, "whole")
