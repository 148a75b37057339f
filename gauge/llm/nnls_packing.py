"""Packing by non-negative least squares over combinations of lengths.

Documents longer than a window are cut into whole windows and a rest. Lengths are counted in bins. Every
combination of up to three bins that fills a window is a column; non-negative least squares finds how often
to repeat each so that together they use up the histogram. The counts are rounded down, and what the
rounding leaves is packed greedily, longest first, still as combinations with repeat counts. Only the
histogram (one count a bin) reaches the driver; pieces find their sequence by their rank within their bin.

Defined results: null and empty texts are one piece, of the end id alone; repeated rows are pieces of their
own, told apart by the column ``copy``; an empty table gives an empty result; further columns pass by unread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gauge.llm.common import cut_lineage, small_batches, text_bytes, trimmed
from gauge.llm.tokens import encoder, groups

WINDOW, BIN, END_ID = 2048, 8, 1
#: Rows of a bucket, about, when pieces are ranked within a bin.
BUCKET_ROWS = 1024
#: Words that a worker's cache keeps, about; bytes of text encoded at once.
CACHED, ENCODED_BYTES = 100_000, 1 << 20


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(documents: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Documents as token ids with the end id, cut into windows: doc_id, start, length, ids_crc32, doc_tokens."""
    path = path or vocabulary()
    end = END_ID.to_bytes(4, "little")

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, spaced=False, words=CACHED)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo, hi, texts in groups(batch.column(1), ENCODED_BYTES):
                rows = []
                for doc_id, ids in zip(doc_ids[lo:hi], encode.ids(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    rows += [(doc_id, at, min(window, n - at), zlib.crc32(ids[4 * at : 4 * (at + window)]), n) for at in range(0, n, window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(bins: int) -> np.ndarray:
    """All (a, b, c) with a >= b >= c >= 0 and a + b + c = bins; 0 is no piece."""
    b, c = np.meshgrid(np.arange(bins + 1), np.arange(bins + 1), indexing="ij")
    a = bins - b - c
    good = (a >= b) & (b >= c)
    return np.stack([a[good], b[good], c[good]], axis=1)


def least_squares(columns: np.ndarray, histogram: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, by accelerated projected gradients.

    A has a column for each combination, with the number of its pieces per bin.
    """
    bins = len(histogram)
    on = columns > 0
    flat, weight = columns.ravel(), on.ravel().astype(np.float64)

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, weights=np.repeat(x, columns.shape[1]) * weight, minlength=bins)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[columns] * on).sum(axis=1)

    v = np.ones(len(columns))
    for _ in range(30):
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(times(y) - histogram) / (norm * 1.01))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(histogram: np.ndarray, rounds: int = 3000) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a sequence, longest first; repeats): together they use every piece of ``histogram`` once.

    ``histogram[b]`` counts pieces of b bins; the last bin fills a window alone.
    """
    left, out = histogram.astype(np.int64).copy(), []
    full = len(histogram) - 1
    if left[full]:
        out.append(((full,), int(left[full])))
        left[full] = 0
    columns = combinations(full)
    usable = ((left[columns] > 0) | (columns == 0)).all(axis=1)
    columns = columns[usable]
    if len(columns):
        x = least_squares(columns, left.astype(np.float64), rounds)
        for j in np.argsort(-x, kind="stable"):
            bins, need = np.unique(columns[j][columns[j] > 0], return_counts=True)
            repeats = int(min(np.floor(x[j] + 1e-6), (left[bins] // need).min()))
            if repeats > 0:
                left[bins] -= need * repeats
                out.append((tuple(int(b) for b in columns[j] if b), repeats))
    while left.any():  # greedy: the longest piece, then always the longest that fits
        room, chosen = full, []
        for b in np.flatnonzero(left)[::-1]:
            n = min(int(left[b]), room // int(b))
            chosen += [int(b)] * n
            room -= n * int(b)
        bins, need = np.unique(chosen, return_counts=True)
        repeats = int((left[bins] // need).min())
        left[bins] -= need * repeats
        out.append((tuple(chosen), repeats))
    return out


def ranked(rows: DataFrame, key: str, order: list[str], sizes: dict[int, int]) -> DataFrame:
    """``rows`` with ``rank``, from 0, within ``key``, counted in buckets, the more the larger a key is: no key is ordered in one task.

    ``sizes`` has the number of rows of each key; there are few keys.
    """
    table = rows.sparkSession.createDataFrame([(k, max(1, n // BUCKET_ROWS)) for k, n in sizes.items()], f"{key} int, buckets long")
    rows = rows.join(F.broadcast(table), key).withColumn("bucket", F.pmod(F.xxhash64(*order), F.col("buckets"))).drop("buckets")
    counts = rows.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select(key, "bucket", F.coalesce(F.sum("n").over(W.partitionBy(key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = F.row_number().over(W.partitionBy(key, "bucket").orderBy(*order)) - 1
    return rows.withColumn("within", within).join(ahead, [key, "bucket"]).withColumn("rank", F.col("ahead") + F.col("within")).drop("bucket", "within", "ahead")


def pack(documents: DataFrame, path: str | None = None, window: int = WINDOW, bin_size: int = BIN) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, copy.

    ``copy`` tells repeated rows apart. Sequences hold at most ``window`` tokens; offsets have no gaps.
    """
    with small_batches(documents.sparkSession):
        rows = cut_lineage(pieces(documents, path, window).withColumn("row", F.monotonically_increasing_id()))
    rows = rows.withColumn("bin", F.ceil(F.col("length") / bin_size).cast("int"))
    counts = {r["bin"]: r["count"] for r in rows.groupBy("bin").count().collect()}
    histogram = np.array([counts.get(b, 0) for b in range(window // bin_size + 1)], dtype=np.int64)
    chosen = plan(histogram)
    # for each bin: from which rank on which combination takes its pieces, how many a sequence, from which sequence on
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    taken, sequence = np.zeros(len(histogram), np.int64), 0
    for combination, repeats in chosen:
        for b, n in zip(*np.unique(combination, return_counts=True), strict=True):
            ranges.setdefault(int(b), []).append((int(taken[b]), int(n), sequence))
            taken[b] += int(n) * repeats
        sequence += repeats
    table = {b: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for b, r in ranges.items()}

    @trimmed
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, ranks = batch.column(batch.schema.get_field_index("bin")).to_numpy(), batch.column(batch.schema.get_field_index("rank")).to_numpy()
            out = np.zeros(len(batch), np.int64)
            for b in np.unique(bins):
                first, each, base = table[int(b)]
                own = bins == b
                at = np.searchsorted(first, ranks[own], side="right") - 1
                out[own] = base[at] + (ranks[own] - first[at]) // each[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "sequence_id"])

    ordered = ranked(rows, "bin", ["doc_id", "start", "row"], counts)
    placed = ordered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", "bin", "rank").mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long, bin int, rank long, sequence_id long")
    # a sequence has at most window / bin_size pieces
    before = W.partitionBy("sequence_id").orderBy(F.desc("bin"), "rank").rowsBetween(W.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), F.col("row").alias("copy"))
