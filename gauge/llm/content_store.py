"""Content-addressed store of token ids: unique chunks, document recipes, Merkle manifests.

A rolling hash over the ids cuts each document's stream where it meets a mark, so equal passages give equal
chunks. A chunk's address is the SHA-256 of its stored bytes; each address is stored once. A recipe lists a
document's chunks in order; its root is the SHA-256 of their addresses. The manifest lists documents in
ascending doc_id order with the place of their first id and their root; slices of it are hashed, and the
store's root is the hash of those hashes.

Layout below a folder: ``chunks/`` (address, ids, and rows that only refer to an address: which recipe holds
it where), ``recipes`` being those references, ``manifest/`` (doc_id, start, n_tokens, root), ``slices/`` (the
hash of each slice of the manifest) and ``root/``.

Defined results: null and empty texts are the end id alone; repeated rows are documents of their own, one
after another; rows without doc_id come first; an empty table gives an empty result; further columns pass by
unread. Reading raises an error if an address, a recipe, a slice or the store's root differs from what the
stored bytes give.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gauge.llm.common import cut_lineage, mix, shared_folder, small_batches, text_bytes, trimmed
from gauge.llm.tokens import encoder, groups

END_ID = 2
#: Ids that the rolling hash sees; a mark comes every 2 ** MARK_BITS ids in the mean; ids of a chunk at most.
ROLL, MARK_BITS, MOST_IDS = 16, 9, 8192
#: Bytes of texts whose distinct words are looked up together; words that a worker keeps.
GROUP_BYTES, KEPT_WORDS = 1 << 22, 300_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _drawn() -> np.ndarray:
    """A pseudorandom number for each of 65,536 ids."""
    return mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def chunk_ends(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where chunks end in documents laid one after another: at marks, documents' ends, and MOST_IDS at the latest.

    The rolling hash is the sum of the last ROLL ids' hashes, of one document alone.
    """
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(_drawn()[ids & 0xFFFF] + ids, out=total[1:], dtype=np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    from_ = np.maximum(np.arange(1 - ROLL, len(ids) + 1 - ROLL), np.repeat(starts, ends - starts))
    marks = ((total[1:] - total[from_]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - MARK_BITS)) == 0
    marks[ends - 1] = True
    out = np.flatnonzero(marks) + 1
    gaps = np.diff(np.concatenate([[0], out]))
    if (gaps > MOST_IDS).any():
        more = [np.arange(e - g + MOST_IDS, e, MOST_IDS) for e, g in zip(out[gaps > MOST_IDS], gaps[gaps > MOST_IDS], strict=True)]
        out = np.unique(np.concatenate([out, *more]))
    return out


def _encoded(documents: DataFrame, path: str) -> DataFrame:
    """Rows of two kinds: 1, a document (doc_id, digest = root, n = ids); 0, its chunks (digest, root, at, rest, n, ids).

    A task gives the ids of an address, and the chunks of a root, only when it first meets them.
    """
    end = END_ID.to_bytes(4, "little")
    names = ["kind", "place", "doc_id", "digest", "root", "seq", "rest", "n", "ids"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    @trimmed
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, spaced=True, words=KEPT_WORDS)
        wide = encode.tokenizer.get_vocab_size() > 1 << 16
        width, mark = (4, b"\x04") if wide else (2, b"\x02")
        roots, addresses = set(), set()

        def new(known: set, keys: list[bytes]) -> np.ndarray:
            out = []
            for i, k in enumerate(keys):
                if k not in known:
                    known.add(k)
                    out.append(i)
            return np.array(out, np.int64)

        def batch_of(rows: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(rows, k) for c, k in zip(names, kinds, strict=True)], names=names)

        for batch in batches:
            doc_ids = batch.column(0)
            for lo, hi, texts in groups(batch.column(1), GROUP_BYTES):
                raw = encode.ids(texts)
                ids = np.frombuffer(end.join(raw) + end, "<u4")
                ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) // 4 + 1)
                cuts = chunk_ends(ids, ends)
                begins = np.concatenate([[0], cuts[:-1]])
                last = np.searchsorted(cuts, ends, side="right")
                first = np.concatenate([[0], last[:-1]])
                # a stored chunk: its width in bytes, then its ids
                data = memoryview(ids.tobytes() if wide else ids.astype("<u2").tobytes())
                spans = list(zip((begins * width).tolist(), (cuts * width).tolist(), strict=True))
                digests = [hashlib.sha256(mark + data[x:y]).digest() for x, y in spans]
                hexes = [d.hex() for d in digests]
                own = [hashlib.sha256("".join(hexes[x:y]).encode()).digest() for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                yield batch_of(hi - lo, kind=np.ones(hi - lo, np.int32), place=np.frombuffer(b"".join(own), "<i8")[::4] ^ np.arange(hi - lo), doc_id=doc_ids[lo:hi], digest=own, n=ends - np.concatenate([[0], ends[:-1]]))
                some = new(roots, own)
                if not len(some):
                    continue
                many = (last - first)[some]
                seq = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                at = np.repeat(first[some], many) + seq
                picked = [digests[i] for i in at.tolist()]
                kept = new(addresses, picked)
                stored: list[bytes | None] = [None] * len(at)
                for i, j in zip(kept.tolist(), at[kept].tolist(), strict=True):
                    stored[i] = mark + data[spans[j][0] : spans[j][1]]
                # rows with ids meet by address; others only refer to it, and go anywhere
                root = np.repeat(some, many)
                place = np.frombuffer(b"".join(own), "<i8")[::4][root] ^ seq
                place[kept] = np.frombuffer(b"".join(picked), "<i8")[::4][kept]
                yield batch_of(len(at), kind=np.zeros(len(at), np.int32), place=place, digest=picked, root=[own[i] for i in root.tolist()], seq=seq, rest=(np.repeat(ends, last - first) - cuts)[at], n=(cuts - begins)[at], ids=stored)
                if len(addresses) > 500_000:  # bounds a task's memory; an address given twice is stored once all the same
                    roots.clear(), addresses.clear()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(encode, "kind int, place long, doc_id long, digest binary, root binary, seq long, rest long, n long, ids binary")


def write(documents: DataFrame, folder: str, path: str | None = None) -> None:
    """Encodes and stores ``documents`` below ``folder``."""
    spark = documents.sparkSession

    rows = _encoded(documents, path or vocabulary())
    # rows with the ids of one address have one place; the first of them keeps the ids. Each task gave an address once or so
    first = F.row_number().over(W.partitionBy("place", "kind", "digest").orderBy(F.col("ids").isNull()))
    once = rows.repartition("place").withColumn("ids", F.when(first == 1, F.col("ids")))
    with small_batches(spark):
        once.drop("place").write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/chunks")
    stored = _stored(spark, folder).where("kind = 1").select("doc_id", "n", F.col("digest").alias("root"))
    ordered = cut_lineage(stored.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root").withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}))
    parts = ordered.groupBy("part").agg(F.sum("n").alias("n"))
    # one row a part
    ahead = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    manifest = ordered.withColumn("before", before).join(F.broadcast(ahead), "part")
    manifest.select("part", "row", "doc_id", (F.col("ahead") + F.col("before")).cast("long").alias("start"), F.col("n").alias("n_tokens"), "root").sortWithinPartitions("part", "row").write.parquet(f"{folder}/manifest")
    _slices(spark, folder).write.parquet(f"{folder}/slices")
    spark.createDataFrame([(merkle_root(spark, folder),)], "h string").coalesce(1).write.parquet(f"{folder}/root")


def _shift_tables() -> np.ndarray:
    """For each power of two: how that many zero bytes change a CRC-32, as four tables of a byte each."""
    table = np.array([int.from_bytes(zlib.crc32(bytes([i])).to_bytes(4, "little"), "little") for i in range(256)], np.uint32)
    table = table ^ table[0]
    x = np.arange(256, dtype=np.uint32)
    one = np.stack([(v >> np.uint32(8)) ^ table[v & np.uint32(255)] for v in (x << np.uint32(8 * j) for j in range(4))])
    out = [one]
    for _ in range(47):
        last = out[-1]
        out.append(np.stack([_shift(last, last[j]) for j in range(4)]))
    return np.stack(out)


def _shift(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def crc_before(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a part with this CRC-32 adds (by exclusive or) to the CRC of a text in which so many bytes follow it."""
    tables, crc = _shift_tables(), crc.astype(np.uint32)
    for j in range(48):
        on = (n_bytes >> j) & 1 == 1
        if on.any():
            crc[on] = _shift(tables[j], crc[on])
    return crc


def _ids_of(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u2" if stored[0] == 2 else "<u4", offset=1).astype("<u4")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the stored files: doc_id, start, n_tokens, ids_crc32, root, n_chunks. All addresses and roots are verified.

    A chunk's checksum is taken where its bytes lie, and documents join checksums, so no ids are shuffled.
    """
    stored = _stored(spark, folder).where("kind = 0")
    was, now = spark.read.schema(SLICES).parquet(f"{folder}/slices"), _slices(spark, folder)
    same = was.alias("x").join(now.alias("y"), ["part", "slice"], "full").where(~F.col("x.h").eqNullSafe(F.col("y.h")))
    if not same.isEmpty() or spark.read.schema("h string").parquet(f"{folder}/root").first()["h"] != merkle_root(spark, folder):
        raise ValueError("the manifest is damaged")

    @trimmed
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for address, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = _ids_of(raw)
                if hashlib.sha256(raw).digest() != address or len(ids) != n:
                    raise ValueError(f"chunk {address.hex()} is damaged")
                crcs.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64())], names=["digest", "crc"])

    @trimmed
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = crc_before(batch.column(4).to_numpy(), 4 * batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc.astype(np.int64))], names=["root", "seq", "digest", "n", "crc"])

    chunks = stored.where("ids is not null").select("digest", "n", "ids").mapInArrow(check, "digest binary, crc long")
    recipes = stored.select("root", "seq", "digest", "n", "rest").distinct()
    parts = recipes.join(chunks, "digest", "left").select("root", "seq", "digest", "n", F.coalesce("crc", F.raise_error(F.lit("a chunk is missing")).cast("long")).alias("crc"), "rest")
    parts = parts.mapInArrow(follow, "root binary, seq long, digest binary, n long, crc long")
    # the chunks of one recipe: as many as one document has
    order = F.array_sort(F.collect_list(F.struct("seq", F.lower(F.hex("digest")).alias("d"))))
    whole = parts.groupBy("root").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_chunks"), F.sha2(F.array_join(F.transform(order, lambda x: x["d"]), "").cast("binary"), 256).alias("again"))
    manifest = _manifest(spark, folder)
    both = manifest.join(whole, "root", "left")
    good = (F.lower(F.hex("root")) == F.col("again")) & (F.col("n") == F.col("n_tokens"))
    checked = F.when(good, F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a recipe is damaged")).cast("long"))
    return both.select("doc_id", "start", "n_tokens", checked.alias("ids_crc32"), F.lower(F.hex("root")).alias("root"), "n_chunks")


SLICES = "part int, slice long, row long, h string"


def _slices(spark: SparkSession, folder: str) -> DataFrame:
    """The hash of each 4096 rows of the manifest, made from its files."""
    line = F.concat_ws(":", "doc_id", "start", "n_tokens", F.hex("root"))
    manifest = _manifest(spark, folder).withColumn("slice", F.floor(F.col("row") / 4096))
    return manifest.groupBy("part", "slice").agg(F.min("row").alias("row"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("row", line.alias("x")))).getField("x"), "\n").cast("binary"), 256).alias("h"))


def merkle_root(spark: SparkSession, folder: str) -> str:
    """The root over the whole store: of the hashes of the manifest's slices, in order."""
    slices, at = spark.read.schema(SLICES).parquet(f"{folder}/slices"), F.struct("row", "h")
    while (n := slices.count()) > 1:  # about 4096 hashes become one in each round
        parts = -(-n // 4096)
        bounds = slices.approxQuantile("row", [i / parts for i in range(1, parts)], 0.0) if parts > 1 else []
        own = F.lit(0) if not bounds else F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("row")))
        slices = slices.groupBy(own.alias("part")).agg(F.min("row").alias("row"), F.sha2(F.array_join(F.array_sort(F.collect_list(at)).getField("h"), "").cast("binary"), 256).alias("h"))
        slices = cut_lineage(slices)
    found = slices.first()
    return found["h"] if found else hashlib.sha256(b"").hexdigest()


def restore(spark: SparkSession, folder: str, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of the documents named by ``doc_ids``, put together from their chunks."""
    stored = _stored(spark, folder).where("kind = 0")
    wanted = _manifest(spark, folder).join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    chunks = stored.where("ids is not null").select("digest", "ids")
    recipes = stored.select("root", "seq", "digest").distinct().join(wanted.select("root").distinct(), "root", "left_semi").join(chunks, "digest")
    whole = recipes.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("parts"))

    @trimmed
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([_ids_of(p["ids"]) for p in parts]).astype(np.int64) for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return wanted.join(whole, "root").select("doc_id", "start", "parts").mapInArrow(join, "doc_id long, start long, ids array<bigint>")


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id long, digest binary, root binary, seq long, rest long, n long, ids binary, kind int").parquet(f"{folder}/chunks")


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part int, row long, doc_id long, start long, n_tokens long, root binary").parquet(f"{folder}/manifest")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
