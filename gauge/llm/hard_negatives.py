"""Hard-negative mining: exact inner products behind an orthogonal rotation to principal components.

Vectors become whole numbers. A rotation to the principal components of a bounded sample puts most of a product
into the leading components: a pair's product over them, plus or minus the product of what remains of both
norms and a slack for rounding, bounds its score. Pairs that cannot enter any list go after a quarter or half of
the components; the rest are verified by integer products. The rotation only decides what is verified: results
do not depend on it.

Anchors are taken in groups of bounded size, which are broadcast; for each group all rows are read twice, once for
the positives, whose scores bound the negatives, and once for the negatives. Tasks keep the best of what they
read, and windows merge those. Each group's result is a table in the shared folder.

Defined results: rows without vec_id take no part, nor do vectors of another length than most have (ties: the
longer), nor those whose whole numbers have a norm of 2^31 or more, as their scores may not fit a long. Repeated
rows are rows of their own, so a repeated anchor gives its rows again, with its copy among its positives. An
empty table gives an empty result; further columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gauge.llm.common import Tables, trimmed

SCALE, RELABEL, LABELS, ANCHORS_EVERY = 256, 7, 10, 100
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
#: Rows that the rotation is fitted to, in expectation; anchors of a group, and bytes of their vectors, at most.
FITTED_ROWS, GROUP_ANCHORS, GROUP_BYTES = 65_536, 8192, 1 << 23
#: Rows and anchors whose products are made at once; parts of the components after which pairs are dropped.
BLOCK_ROWS, BLOCK_ANCHORS, STAGES = 2048, 512, (0.25, 0.5)

_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def rows_of(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and vector of the rows that take part, whatever their vectors' length."""
    number = F.col("vec_id").cast("long")
    label = F.col("label").cast("long")
    label = F.when(number % RELABEL == 0, (label + 1) % LABELS).otherwise(label)
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) * SCALE + 1, F.lit(2.0)))
    return embeddings.select(number.alias("vec_id"), label.alias("label"), vector.alias("vector")).where("vec_id is not null and label is not null and vector is not null").where(finite).where(norm < float(1 << 62))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of one length as whole numbers in doubles."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size) * SCALE)


def rotation(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The length of most vectors, and an orthogonal matrix whose columns are principal components, largest first."""
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return 0, np.zeros((0, 0))
    d, n = lengths
    part = int(min(1.0, FITTED_ROWS / n) * (1 << 20))
    sample = rows.where((F.size("vector") == d) & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < part))

    @trimmed
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            v = _matrix(batch.column(0), d)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "m"])

    sums = sample.select("vector").mapInArrow(moments, "i int, m array<double>").select("i", F.posexplode("m").alias("j", "m")).groupBy("i", "j").agg(F.sum("m").alias("m"))
    found, total = sums.toPandas(), np.zeros((d, d))  # a row for each pair of components
    total[found["i"], found["j"]] = found["m"]
    return d, np.linalg.eigh((total + total.T) / 2)[1][:, ::-1].copy() if d else np.zeros((0, 0))


class Side:
    """Vectors with what bounds need: rotated components, and the norms of all that follow each stage."""

    def __init__(self, whole: np.ndarray, turn: np.ndarray):
        d = whole.shape[1]
        self.whole, self.turned = whole, whole @ turn
        self.cuts = sorted({max(1, round(d * s)) for s in STAGES} & set(range(1, d)))
        self.tails = [np.sqrt((self.turned[:, k:] ** 2).sum(axis=1)) for k in self.cuts]
        self.norm = np.sqrt((whole**2).sum(axis=1))

    def part(self, chosen: np.ndarray | slice) -> Side:
        out = object.__new__(Side)
        out.whole, out.turned, out.cuts, out.norm = self.whole[chosen], self.turned[chosen], self.cuts, self.norm[chosen]
        out.tails = [t[chosen] for t in self.tails]
        return out


def verified(one: Side, two: Side, low: np.ndarray, high: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the allowed pairs whose score may lie between ``low`` and ``high`` of i; scores are exact."""
    d = one.whole.shape[1]
    slack = 64 * d * np.finfo(float).eps
    pairs, partial, done = None, None, 0
    for k, tail_one, tail_two in zip(one.cuts, one.tails, two.tails, strict=True):
        if pairs is None:
            partial = one.turned[:, :k] @ two.turned[:, :k].T
            rest = np.outer(tail_one, tail_two) + slack * np.outer(one.norm, two.norm) + 1e-6
            pairs = np.nonzero(allowed & (partial + rest >= low[:, None]) & (partial - rest <= high[:, None]))
            partial = partial[pairs]
        else:
            i, j = pairs
            partial += np.einsum("nd,nd->n", one.turned[i, done:k], two.turned[j, done:k])
            rest = tail_one[i] * tail_two[j] + slack * one.norm[i] * two.norm[j] + 1e-6
            keep = (partial + rest >= low[i]) & (partial - rest <= high[i])
            pairs, partial = (i[keep], j[keep]), partial[keep]
        done = k
    i, j = np.nonzero(allowed) if pairs is None else pairs
    exact = d * np.abs(one.whole).max(initial=0) * np.abs(two.whole).max(initial=0) < 2.0**53
    kind = np.float64 if exact else np.int64  # sums of whole numbers below 2^53 are exact in doubles
    a, b = one.whole.astype(kind), two.whole.astype(kind)
    score = np.concatenate([np.einsum("nd,nd->n", a[i[s : s + 65536]], b[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
    return i, j, score.astype(np.int64)


class Best:
    """For each of ``n`` lists the ``size`` first entries (score, id) by falling score, then rising id."""

    def __init__(self, n: int, size: int):
        self.n, self.size = n, size
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: The score of each list's last entry where the list is full.
        self.least = np.full(n, np.iinfo(np.int64).min)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = score >= self.least[key]
        if not better.any():
            return
        key, score, ids = (np.concatenate([x, y[better]]) for x, y in ((self.key, key), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.searchsorted(key, np.arange(self.n))
        place = np.arange(len(key)) - first[key]
        full = place == self.size - 1
        self.least[key[full]] = score[full]
        keep = place < self.size
        self.key, self.score, self.id = key[keep], score[keep], ids[keep]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.key, self.score, self.id)], names=["list", "score", "id"])


def _search(rows: DataFrame, d: int, n: int, size: int, prepare: Callable[[], Callable[[Best, np.ndarray, np.ndarray, np.ndarray], None]]) -> DataFrame:
    """Merged lists (list, score, id, rank) of what a task's function, made once, adds for blocks of rows: ids, labels, vectors."""

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, look = Best(n, size), prepare()
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                look(best, part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), d))
        yield best.batch()

    rank = F.row_number().over(W.partitionBy("list").orderBy(F.desc("score"), "id"))
    return rows.mapInArrow(work, "list long, score long, id long").withColumn("rank", rank).where(F.col("rank") <= size)


def _group(rows: DataFrame, d: int, turn: np.ndarray, anchors: list) -> DataFrame:
    """The result for some anchors: (row, vec_id, label, vector) each."""
    context = rows.sparkSession.sparkContext
    whole = np.floor(np.array([a.vector for a in anchors], dtype=float).reshape(len(anchors), d) * SCALE)
    ids, labels = np.array([a.vec_id for a in anchors], np.int64), np.array([a.label for a in anchors], np.int64)
    shared = context.broadcast((whole, labels))

    def positives() -> Callable:
        all_, wanted = Side(shared.value[0], turn), shared.value[1]

        def look(best: Best, numbers: np.ndarray, own: np.ndarray, vectors: np.ndarray) -> None:
            for label in np.intersect1d(own, wanted):
                mine, chosen = np.flatnonzero(own == label), np.flatnonzero(wanted == label)
                two = Side(vectors[mine], turn)
                for s in range(0, len(chosen), BLOCK_ANCHORS):
                    c = chosen[s : s + BLOCK_ANCHORS]
                    i, j, score = verified(all_.part(c), two, best.least[c].astype(float), np.full(len(c), np.inf), np.ones((len(c), len(mine)), bool))
                    best.add(c[i], score, numbers[mine[j]])

        return look

    # an anchor itself may be among the first rows of its label
    lists: list[list[tuple[int, int]]] = [[] for _ in anchors]
    for r in _search(rows, d, len(anchors), POSITIVES + 1, positives).orderBy("list", "rank").collect():  # at most 6 a list
        lists[r["list"]].append((r["score"], r["id"]))
    self_score = (whole.astype(np.int64) ** 2).sum(axis=1).tolist()
    for i, entries in enumerate(lists):
        if (self_score[i], int(ids[i])) in entries:
            entries.remove((self_score[i], int(ids[i])))
        del entries[POSITIVES:]
    low, high = np.full((len(anchors), POSITIVES), np.iinfo(np.int64).max), np.full((len(anchors), POSITIVES), np.iinfo(np.int64).min)
    told = []
    for i, entries in enumerate(lists):
        for p, (score, number) in enumerate(entries):
            low[i, p], high[i, p] = -(-LEAST * score // 100), MOST * score // 100
            told.append((i * POSITIVES + p, int(ids[i]), number, score))
    limits = context.broadcast((low, high))

    def negatives() -> Callable:
        all_, wanted, (low, high) = Side(shared.value[0], turn), shared.value[1], limits.value

        def look(best: Best, numbers: np.ndarray, own: np.ndarray, vectors: np.ndarray) -> None:
            two = Side(vectors, turn)
            for s in range(0, len(wanted), BLOCK_ANCHORS):
                c = np.arange(s, min(s + BLOCK_ANCHORS, len(wanted)))
                lo, hi = low[c], high[c]
                need = np.maximum(lo, best.least.reshape(-1, POSITIVES)[c])
                need = np.where(lo <= hi, need, np.iinfo(np.int64).max).min(axis=1)
                i, j, score = verified(all_.part(c), two, need.astype(float), hi.max(axis=1).astype(float), wanted[c][:, None] != own[None])
                for p in range(POSITIVES):
                    ok = (score >= lo[i, p]) & (score <= hi[i, p])
                    best.add(c[i[ok]] * POSITIVES + p, score[ok], numbers[j[ok]])

        return look

    found = _search(rows, d, len(anchors) * POSITIVES, NEGATIVES, negatives).withColumnsRenamed({"score": "negative_score", "id": "negative_id"})
    told = rows.sparkSession.createDataFrame(told, "list long, anchor_id long, positive_id long, positive_score long")
    # at most 5 rows for each anchor of the group
    return found.join(F.broadcast(told), "list").select(*(c.split()[0] for c in _RESULT.split(", ")))


def mine(embeddings: DataFrame) -> DataFrame:
    """For each anchor and positive the hard negatives with their rank, ids and scores."""
    spark = embeddings.sparkSession
    rows = rows_of(embeddings)
    d, turn = rotation(rows)
    rows = rows.where(F.size("vector") == d)
    tables = Tables(spark, "negatives")
    anchors = tables.keep("anchors", rows.where(F.col("vec_id") % ANCHORS_EVERY == 0).withColumn("row", F.monotonically_increasing_id()))
    most = max(256, min(GROUP_ANCHORS, GROUP_BYTES // (8 * max(d, 1))))
    n = anchors.count()
    groups = -(-n // most)
    found = spark.createDataFrame([], _RESULT)
    for g in range(groups):
        some = anchors.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).orderBy("row").collect()
        if some:
            found = found.unionByName(tables.keep(f"found-{g}", _group(rows, d, turn, some)))
    return found
