"""Exact dedup with a log-structured merge index of text digests.

Memtables: each task gathers the digests of its rows and, whenever its table is full and at its end, flushes it
as a sorted run: a digest, the row that stays, the number of rows. No shuffle comes before. Compaction merges
runs into a sorted one without overlaps and keeps one identifier a digest. Each compacted run has a filter of the
digests that several rows have: a lookup consults it first, so most rows are answered where they are, and only
probable hits are looked up in the run. Hits are verified byte by byte: of each digest, the least and the
greatest text must be the same. Texts are reduced to those two before they are shuffled, however many copies
there are. A digest with unlike texts is decided by its texts.

Defined results: null counts as the empty text; texts are equal if identical after lower-casing A-Z; rows with a
null doc_id go after all others; repeated rows count as copies; an empty table gives an empty result; further
columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gauge.llm.common import Tables, trimmed

#: Rows of a memtable; log2 of the bits of a filter at most; its hash functions.
MEMTABLE_ROWS, FILTER_BITS, HASHES = 1 << 18, 25, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "digest binary, keep_id long, keep_row long, group_size long"


def folded(text: str = "text") -> F.Column:
    """A text with A-Z lower-cased; null is empty."""
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)


def digest_of(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def memtables(rows: DataFrame, size: int = MEMTABLE_ROWS) -> DataFrame:
    """Sorted runs of (digest, keep_id, keep_row, group_size) from (doc_id, row, digest); a task flushes one for each ``size`` rows."""

    def flush(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        # of a digest, the row that stays comes first: the one that ranks first, without doc_id last, then the smallest row
        table = table.sort_by([("digest", "ascending"), ("last", "ascending"), ("rank", "ascending"), ("row", "ascending")]).combine_chunks()
        digest = table["digest"].combine_chunks().dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(table)]]))
        kept = table.take(pa.array(first))
        columns = [kept[c].combine_chunks() for c in ("digest", "doc_id", "row")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], names=["digest", "keep_id", "keep_row", "group_size"])

    @trimmed
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= size:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return rows.select("digest", "doc_id", "row", F.col("doc_id").isNull().alias("last"), "rank").mapInArrow(runs, RUN)


def _bits(digests: pa.Array, n_bits: int) -> np.ndarray:
    """The places of digests in a filter: HASHES columns."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), ">u4").reshape(len(digests), -1)
    return raw[:, np.arange(HASHES) % raw.shape[1]].astype(np.int64) & (n_bits - 1)


class DigestIndex:
    """Runs below one folder: ``flushed`` ones as tasks wrote them, which overlap, and one that compaction merged from all."""

    def __init__(self, spark: SparkSession, tables: Tables, largest: bool = True):
        self.spark, self.tables, self.largest = spark, tables, largest
        self.flushed: list[str] = []
        self.filter: np.ndarray | None = None

    def flush(self, rows: DataFrame, size: int = MEMTABLE_ROWS) -> None:
        """Adds the runs of a load of (doc_id, row, digest)."""
        rank = -F.col("doc_id") if self.largest else F.col("doc_id")
        name = f"runs-{len(self.flushed)}"
        self.tables.keep(name, memtables(rows.withColumn("rank", rank), size))
        self.flushed.append(name)

    def compact(self) -> DataFrame:
        """Merges all runs, flushed and merged ones, into one, sorted by digest, and makes its filter."""
        old = [*self.flushed, *(["merged"] if "merged" in self.tables.paths else [])]
        rows = self.spark.read.schema(RUN).parquet(*(self.tables.paths[n] for n in old))
        rank = -F.col("keep_id") if self.largest else F.col("keep_id")
        first = F.min(F.struct(F.col("keep_id").isNull(), rank.alias("rank"), "keep_row", "keep_id")).alias("first")
        merged = rows.groupBy("digest").agg(first, F.sum("group_size").cast("long").alias("group_size"))
        merged = merged.select("digest", "first.keep_id", "first.keep_row", "group_size").sortWithinPartitions("digest")
        merged = self.tables.keep("merged", merged)
        self.tables.drop(*self.flushed)
        self.flushed = []
        self.filter = hit_filter(merged)
        return merged

    def hits(self) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(self.tables.paths["merged"]).where("group_size > 1")

    def probable(self, rows: DataFrame) -> DataFrame:
        """``rows``, which have a digest, with ``may``: false if the filter knows that no other row has it."""
        shared = self.spark.sparkContext.broadcast(self.filter)

        @trimmed
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = shared.value
            for batch in batches:
                at = _bits(batch.column(batch.schema.get_field_index("digest")), len(bits) * 64)
                may = (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).all(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(may)], names=[*batch.schema.names, "may"])

        return rows.mapInArrow(ask, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "may boolean"]))


def hit_filter(merged: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter of the digests that several rows have, as 64-bit words; never above FILTER_BITS.

    With more hits than it has room for it lets more rows through, which the lookup then answers.
    """
    hits = merged.where("group_size > 1").select("digest")
    bits = 1 << max(10, min(FILTER_BITS, (HASHES * 4 * hits.count()).bit_length()))

    @trimmed
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            at = _bits(batch.column(0), bits).ravel()
            np.bitwise_or.at(own, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        on = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(own[on].view(np.int64))], names=["word", "bits"])

    found, out = hits.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas(), np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def unlike(documents: DataFrame, index: DigestIndex) -> DataFrame:
    """Digests that texts with different bytes share. Each task sends two texts of a digest at most."""
    texts = documents.select(folded().alias("t")).select(digest_of(F.col("t")).alias("digest"), "t")
    some = index.probable(texts).where("may").groupBy("digest").agg(F.min("t").alias("least"), F.max("t").alias("most"))
    return some.where("least <> most").select("digest")


def by_texts(rows: DataFrame, largest: bool = True) -> DataFrame:
    """Result of rows (doc_id, row, digest, t) whose digests tell nothing: they are grouped by their texts."""
    rank = -F.col("doc_id") if largest else F.col("doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), rank.alias("rank"), "row", "doc_id")).alias("first")
    groups = rows.groupBy("digest", "t").agg(first, F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["digest", "t"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "digest", "row")


def dedup(documents: DataFrame, largest: bool = True, size: int = MEMTABLE_ROWS) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, digest, row. ``kept`` is true for one row of each text.

    The row that stays is known by its doc_id; where several equal rows carry that doc_id, one of them stays.
    """
    spark = documents.sparkSession
    tables = Tables(spark, "dedup")
    index = DigestIndex(spark, tables, largest)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), folded().alias("t"))
    rows = tables.keep("rows", texts.select("doc_id", digest_of(F.col("t")).alias("digest"), F.monotonically_increasing_id().alias("row")))
    index.flush(rows, size)
    index.compact()
    asked = index.probable(rows)
    alone = asked.where("not may").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", "row")
    found = asked.where("may").drop("may").join(index.hits(), "digest", "left")
    one = F.col("group_size").isNull()
    found = found.select("doc_id", F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (one | (F.col("row") == F.col("keep_row"))).alias("kept"), "digest", "row")
    bad = tables.keep("unlike", unlike(documents, index))
    if not bad.isEmpty():
        again = texts.withColumns({"digest": digest_of(F.col("t")), "row": F.monotonically_increasing_id()}).join(bad, "digest", "left_semi")
        found = found.join(bad, "digest", "left_anti").select(*alone.columns).union(by_texts(again, largest).select(*alone.columns))
    return alone.union(found)
