"""n-gram Jaccard join in groups: documents with identical prefixes and size are one group while candidates are found.

1. Equal shingle sets are collapsed to one representative each.
2. Shingles get a global order: those that many documents share last. A document's prefix is its first
   ``n - ceil(t n) + 1`` shingles; two documents that reach the similarity t share a prefix shingle.
3. Representatives with identical prefix and size form a group. Groups that share a prefix shingle meet in
   that shingle's block, where size and position filters pass group pairs.
4. Pairs are expanded to members and verified on whole shingle sets.

In a block above ``SMALL_BLOCK`` members pairs are not enumerated: its members are first compared with a few
pivots, whose links are united to components. Then only members of different components are paired, and
only where the shingles that they share with any other document of a large block could still reach t.
Pairs of small blocks and pivots are verified together, in two waves; the second one, and the pairs that
are left in large blocks, only hold pairs whose ends are still apart.

Results: per document its number of shingles and the smallest doc_id reachable by links. Defined results:
null and empty texts have no shingles and stand alone; texts with fewer words than a shingle have one, of
all their words; a row without doc_id links as any other, and gets null if no row of its component has a
doc_id; rows that share a doc_id but not a text link each by its own text; repeated rows repeat their
result; an empty table gives an empty result; further columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gauge.llm.common import Tables, binary_column, runs, set_digest, shingle_sets, text_bytes, trimmed
from gauge.llm.components import components, extended

#: Words of a shingle; the least similarity, in percent.
WORDS, PERCENT = 5, 80
#: Frequent shingles that the order knows, at most (they are broadcast); members of a block that are all paired.
FREQUENT, SMALL_BLOCK = 1_000_000, 48
#: Ends of pairs whose ids are broadcast to select their texts; beyond, the texts are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Rounds of pivots at most; pairs for each member of large blocks beyond which another round comes before pairing; blocks that a document remembers ahead of each of its blocks.
PIVOT_ROUNDS, PAIRS_EACH, BEFORE = 4, 8, 32

#: Bytes of texts that are verified at once; pairs up to which texts are sent without a look at their sketches.
VERIFIED_BYTES, FEW_PAIRS = 2 << 20, 1000

_LONGS = pa.list_(pa.int64())


def _long_lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32), pa.array(flat))


def shingle_digests(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n, d1, d2) of every row, and in rows without n the shingles that one task met in several texts: (h, times)."""

    @trimmed
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("h", pa.int64()), ("times", pa.int64())])
        met, held, often = [], 0, []
        seen: set[tuple[int, int]] = set()

        def counted() -> None:
            if met:
                h, times = np.unique(np.concatenate(met), return_counts=True)
                often.append((h[times > 1], times[times > 1]))
                met.clear()

        for batch in batches:
            sizes, digests = [], []
            for s in shingle_sets(*binary_column(batch.column(1)), words):
                d = set_digest(s)
                sizes.append(len(s)), digests.append(d)
                if d not in seen and len(s):
                    seen.add(d)
                    met.append(s)
                    held += len(s)
                    if held > 2_000_000:  # bounds the memory of a task; a shingle is then counted in parts
                        counted()
                        held = 0
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)
        counted()
        for h, times in often:
            n = len(h)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) for _ in range(4)), pa.array(h.view(np.int64)), pa.array(times.astype(np.int64))], schema=schema)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(digest, "doc_id long, n long, d1 long, d2 long, h long, times long")


def frequent(met: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent of the shingles that single tasks met in several texts, at most ``most``, with their counts.

    The list only orders shingles. What it lacks costs larger blocks, never a link.
    """
    times = met.groupBy("h").agg(F.sum("times").alias("times")).where("times >= 3")
    levels = sorted(times.groupBy(F.floor(F.log2("times") * 4).cast("int").alias("level")).count().collect(), reverse=True)
    total, least = 0, None
    for level, n in levels:  # at most 4 x 63 levels
        if total + n > most:
            break
        total, least = total + n, level
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = times.where(F.floor(F.log2("times") * 4).cast("int") >= least).toPandas()
    h, t = found["h"].to_numpy(np.int64).view(np.uint64), found["times"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], t[order]


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def prefixes(documents: DataFrame, known: tuple[np.ndarray, np.ndarray], words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, prefix): the first shingles of each row in the global order (count where known, else 0; hash)."""
    shared = documents.sparkSession.sparkContext.broadcast(known)

    @trimmed
    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = shared.value
        for batch in batches:
            out, sizes = [], []
            for s in shingle_sets(*binary_column(batch.column(1)), words):
                k = prefix_size(len(s), percent)
                sizes.append(len(s))
                if len(often) and len(s):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    count = np.where(often[at] == s, times[at], 0)
                    if np.count_nonzero(count) and len(s) - np.count_nonzero(count) < k:
                        s = s[np.lexsort((s, count))]
                    else:
                        s = s[count == 0]
                out.append(s[:k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), _long_lists(out)], names=["doc_id", "n", "prefix"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(prefix, "doc_id long, n long, prefix array<bigint>")


def texts_of(documents: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """(doc_id, text) of the rows named by ``ids``, which may repeat, texts as bytes; ``n_ids`` bounds their number."""
    ids = F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids.distinct()
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(ids.select("doc_id"), "doc_id", "left_semi")


def sets_of(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, shingles) of rows of (doc_id, text): sorted hashes, made anew from the texts."""

    @trimmed
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _long_lists(list(shingle_sets(*binary_column(batch.column(1)), words)))], names=["doc_id", "shingles"])

    return texts.mapInArrow(shingles, "doc_id long, shingles array<bigint>")


def _sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The shingle set of each text; of equal texts it is made once."""
    coded = texts.dictionary_encode()
    sets = list(shingle_sets(*binary_column(coded.dictionary), words))
    return [sets[i] for i in coded.indices.to_numpy()]


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall in each range of hashes, 2 to 4 in the mean, a byte a range; empty if a byte can't hold one."""
    bits = max(6, len(shingles).bit_length() - 2)
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_reach(x: bytes, y: bytes, percent: int = PERCENT) -> bool:
    """False only if no sets with these sketches reach the similarity: they share at most the lesser count of each range."""
    if not x or not y:
        return True
    p, q = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    n = min(len(p), len(q))
    p, q = p.reshape(n, -1).sum(axis=1), q.reshape(n, -1).sum(axis=1)
    both = int(np.minimum(p, q).sum())
    return 100 * both >= percent * (int(p.sum() + q.sum()) - both)


def likely(pairs: DataFrame, documents: DataFrame, n_ids: int, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule out the similarity; a sketch has a small part of its text's bytes."""

    @trimmed
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(s) for s in shingle_sets(*binary_column(batch.column(1)), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "sketch"])

    @trimmed
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([may_reach(x, y, percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    one, two = (texts_of(documents, pairs.select(F.col(k).alias("doc_id")), n_ids).mapInArrow(sketches, "doc_id long, sketch binary").select(F.col("doc_id").alias(k), F.col("sketch").alias(f"{k}_sketch")) for k in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "a_sketch", "b_sketch").mapInArrow(compare, "a long, b long")


def verified(pairs: DataFrame, documents: DataFrame, tables: Tables, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the similarity, from a table.

    Texts travel to their pairs, not shingle sets: they are smaller, and repeats of one text compress. Pairs that
    meet by chance grow faster than the documents do, so sketches travel first, and rule out most of them.
    """
    pairs = tables.keep("pairs", pairs)
    n_ids = 2 * pairs.count()
    if n_ids > 2 * FEW_PAIRS:
        pairs = tables.keep("likely", likely(pairs, documents, n_ids, words, percent))
        tables.drop("pairs")
        n_ids = 2 * pairs.count()

    @trimmed
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for lo, hi in runs(binary_column(batch.column(2))[1] + binary_column(batch.column(3))[1], VERIFIED_BYTES):
                for i, p, q in zip(range(lo, hi), _sets(batch.column(2)[lo:hi], words), _sets(batch.column(3)[lo:hi], words), strict=True):
                    both = len(p) + len(q) - len(np.union1d(p, q))
                    good[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    if n_ids <= BROADCAST_IDS:  # few pairs are sent to the texts of a, which then only travel to those of b
        whole = documents.select(F.col("doc_id").cast("long").alias("a"), text_bytes().alias("a_text"))
        left, others = whole.join(F.broadcast(pairs), "a"), pairs.select(F.col("b").alias("doc_id"))
    else:
        others = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
        left = pairs.join(texts_of(documents, others, n_ids).select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
    right = texts_of(documents, others, n_ids).select(F.col("doc_id").alias("b"), F.col("text").alias("b_text"))
    return tables.keep("found", left.join(right, "b").select("a", "b", "a_text", "b_text").mapInArrow(check, "a long, b long"))


def _fits(n: Column, m: Column, percent: int) -> Column:
    """Sizes that can reach the similarity."""
    return (100 * F.least(n, m)) >= percent * F.greatest(n, m)


def candidates(rows: DataFrame, tables: Tables, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, n, prefix): all pairs that meet in a small block, and the members of the large ones.

    Pairs are (a, b, first), where ``first`` marks the smallest a of each b. Members are (doc_id, n, h, at):
    at is the place of the block's shingle h in the prefix.
    """
    rows = tables.keep("rows", rows.withColumns({"p1": F.xxhash64("prefix"), "p2": F.xxhash64("prefix", F.lit("second"))}))
    groups = rows.groupBy("n", "p1", "p2").agg(F.min("doc_id").alias("g"), F.count(F.lit(1)).alias("members"))
    members = tables.keep("members", rows.join(groups, ["n", "p1", "p2"]).select("doc_id", "n", "g", "members", F.when(F.col("doc_id") == F.col("g"), F.col("prefix")).alias("prefix")))
    tables.drop("rows")
    heads = members.where("prefix is not null").select("g", "n", "members", F.posexplode("prefix").alias("at", "h"))
    members = members.drop("prefix")
    blocks = heads.groupBy("h").agg(F.count(F.lit(1)).alias("groups"), F.sum("members").alias("size")).where("groups > 1").drop("groups")
    postings = tables.keep("postings", heads.drop("members").join(blocks, "h"))
    small = postings.where(F.col("size") <= SMALL_BLOCK)
    x, y = small.alias("x"), small.alias("y")
    # an upper bound of the overlap: the shared shingle, and what can precede and follow it in both
    most = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) + F.least("x.at", "y.at")
    close = (100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n"))
    pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.g") < F.col("y.g")) & _fits(F.col("x.n"), F.col("y.n"), percent) & close).select(F.col("x.g").alias("ga"), F.col("y.g").alias("gb")).distinct()
    # group pairs are expanded to their members, and the members of a small group are paired
    one, two = (members.select(F.col("g").alias(f"g{k}"), F.col("doc_id").alias(k)) for k in "ab")
    few = members.where((F.col("members") > 1) & (F.col("members") <= SMALL_BLOCK))
    expanded = pairs.join(one, "ga").join(two, "gb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    expanded = expanded.union(few.alias("x").join(few.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.doc_id") < F.col("y.doc_id"))).select("x.doc_id", "y.doc_id"))
    # a pair of groups, and a pair of members, comes once, so no pair is repeated
    expanded = tables.keep("expanded", expanded)
    firsts = expanded.groupBy("b").agg(F.min("a").alias("first"))
    close_pairs = expanded.join(firsts, "b").select("a", "b", (F.col("a") == F.col("first")).alias("first"))
    large = postings.where(F.col("size") > SMALL_BLOCK).select("g", "h", "at").join(members, "g").select("doc_id", "n", "h", "at")
    # members of a large group meet in a block of their own, which comes before all others
    large = tables.keep("large", large.union(members.where(F.col("members") > SMALL_BLOCK).select("doc_id", "n", F.xxhash64("g", F.lit("group")).alias("h"), F.lit(-1))))
    tables.drop("members", "postings")
    return close_pairs, large


def bounded(large: DataFrame, documents: DataFrame, tables: Tables, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Members of large blocks that can have a link there, with bounds.

    ``own``: shingles that no other of these documents has; ``reach``: the size of a partner at most; ``before``:
    the blocks just ahead of a block. Two documents need only be paired in the block of the first shingle that
    both prefixes have, so a pair that meets in one of those is left to it. Pairs that meet first in a small
    block are among the candidates there.
    """
    ids = large.select("doc_id").distinct()
    shingles = sets_of(texts_of(documents, ids, large.count()), words).select("doc_id", F.explode("shingles").alias("s"))
    own = shingles.groupBy("s").agg(F.count(F.lit(1)).alias("times"), F.min("doc_id").alias("doc_id")).where("times = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))
    docs = large.join(own, "doc_id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    # the overlap is at most n - own, so the other document's size is at most this
    docs = docs.withColumn("reach", F.floor((100 + percent) * (F.col("n") - F.col("own")) / percent) - F.col("n")).where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
    return tables.keep("bounded", docs.withColumn("before", F.collect_list("h").over(W.partitionBy("doc_id").orderBy("at").rowsBetween(-BEFORE, -1))))


def _open_blocks(docs: DataFrame, state: DataFrame | None, tables: Tables) -> DataFrame:
    """Members, with their component c, of the blocks that hold several components and can still have links."""
    named = docs.withColumn("c", F.col("doc_id"))
    if state is not None:
        named = docs.join(state, docs["doc_id"] == state["id"], "left").select(*docs.columns, F.coalesce("component", "doc_id").alias("c"))
    least = named.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("least"), F.max("reach").alias("farthest"))
    # a document that reaches no size of its block, or whose size none reaches, is alone there
    some = named.join(least, "h").where((F.col("lo") < F.col("hi")) & (F.col("reach") >= F.col("least")) & (F.col("farthest") >= F.col("n")))
    return tables.keep("open", some.select(*docs.columns, "c"))


def _follow(x: str, y: str, percent: int) -> Column:
    """Whether what follows a common shingle, the first one of both, can reach the similarity."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    return (100 + percent) * F.least(n - F.col(f"{x}at"), m - F.col(f"{y}at")) >= percent * (n + m)


def _stars(named: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of each block's members with its pivot."""
    # the pivot: first the document with the fewest shingles of its own, then one of a component drawn by hash
    order = ["own", F.xxhash64("doc_id").alias("x")] if not turn else [F.xxhash64("c", F.lit(turn)).alias("x"), "own"]
    pivots = named.groupBy("h").agg(F.min(F.struct(*order, "doc_id", "c", "n", "reach", "at")).alias("p"))
    fit = (F.col("c") != F.col("p.c")) & (F.col("n") <= F.col("p.reach")) & (F.col("p.n") <= F.col("reach")) & _fits(F.col("n"), F.col("p.n"), percent)
    return named.join(pivots, "h").where(fit & _follow("", "p.", percent)).select(F.least("doc_id", "p.doc_id").alias("a"), F.greatest("doc_id", "p.doc_id").alias("b"))


def _across(named: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of a block's members in different components that bounds let through."""
    x, y = named.alias("x"), named.alias("y")
    fit = (F.col("x.c") != F.col("y.c")) & (F.col("x.n") <= F.col("y.reach")) & (F.col("y.n") <= F.col("x.reach")) & _fits(F.col("x.n"), F.col("y.n"), percent)
    rest = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.doc_id") < F.col("y.doc_id")) & fit & _follow("x.", "y.", percent) & ~F.arrays_overlap("x.before", "y.before"))
    return rest.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))


def _many(named: DataFrame) -> bool:
    """Whether pairs across components, without further bounds, are many for each member."""
    k = named.groupBy("h", "c").agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy("h").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("same"))
    found = k.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs"), F.sum("n").alias("n")).first()
    return (found["pairs"] or 0) > PAIRS_EACH * (found["n"] or 0)


def joined(documents: DataFrame, rows: DataFrame, tables: Tables, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Components (id, component) of the documents in ``rows`` (doc_id, n, prefix) that have links."""
    pairs, large = candidates(rows, tables, percent)
    blocks = None if large.isEmpty() else bounded(large, documents, tables, words, percent)
    tables.drop("large")
    pairs = tables.keep("close", pairs)
    tables.drop("expanded")
    # first wave: each document and its smallest partner, and the pivots of large blocks
    wave = pairs.where("first").select("a", "b")
    if blocks is not None:
        wave = wave.union(_stars(_open_blocks(blocks, None, tables), 0, percent)).distinct()
    state = tables.keep("state", components(verified(wave, documents, tables, words, percent), tables))
    tables.drop("components")
    # second wave: what is still apart
    one, two = (state.select(F.col("id").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
    wave = pairs.where("not first").join(one, "a", "left").join(two, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    if blocks is not None:
        wave = wave.union(_stars(_open_blocks(blocks, state, tables), 1, percent)).distinct()
    state = extended(state, verified(wave, documents, tables, words, percent), tables, "state2")
    tables.drop("close")
    if blocks is None:
        return state
    for turn in range(2, PIVOT_ROUNDS + 1):
        named = _open_blocks(blocks, state, tables)
        if named.isEmpty():
            return state
        if turn == PIVOT_ROUNDS or not _many(named):
            break
        found = verified(_stars(named, turn, percent).distinct(), documents, tables, words, percent)
        if found.isEmpty():  # pivots join no more
            break
        state = extended(state, found, tables, f"state{turn + 1}")
    # what is left is paired in full across components
    return extended(state, verified(_across(named, percent).distinct(), documents, tables, words, percent), tables, "last")


def keyed(documents: DataFrame, rows: DataFrame, tables: Tables, words: int = WORDS) -> tuple[DataFrame, DataFrame, bool]:
    """Texts as (doc_id, text) and rows (doc_id, n, d1, d2) with a ``key`` in place of doc_id, one for each text's set.

    The key is the doc_id, unless rows share it with other shingles, or have none: those get numbers beyond all
    doc_ids. The flag tells whether there are such rows.
    """
    rows = rows.withColumn("own_id", F.col("doc_id"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"), F.countDistinct("n", "d1", "d2").alias("sets"))
    repeated = ids.where("times > 1 or doc_id is null")
    if repeated.isEmpty():
        return texts, rows, False
    odd = tables.keep("odd", repeated.where("sets > 1 or doc_id is null").select("doc_id"))
    if odd.isEmpty():
        return texts.dropDuplicates(["doc_id"]), rows, False
    match = lambda x, y, columns: [x[c].eqNullSafe(y[c]) for c in columns]
    base = (rows.agg(F.max("doc_id")).first()[0] or 0) + 1
    sets = rows.join(odd, match(rows, odd, ["doc_id"]), "left_semi").select("doc_id", "n", "d1", "d2").distinct()
    sets = tables.keep("sets", sets.withColumn("key", F.lit(base) + F.monotonically_increasing_id()))
    columns = ["doc_id", "n", "d1", "d2"]
    new_rows = rows.join(sets, match(rows, sets, columns), "left").select(F.coalesce(sets["key"], rows["doc_id"]).alias("doc_id"), rows["n"], rows["d1"], rows["d2"], "own_id")
    some = texts.join(odd, match(texts, odd, ["doc_id"]), "left_semi")

    @trimmed
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), *set_digest(s)) for s in shingle_sets(*binary_column(batch.column(1)), words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[i] for f in found], pa.int64()) for i in range(3))], names=["doc_id", "text", "n", "d1", "d2"])

    some = some.select("doc_id", text_bytes().alias("text")).mapInArrow(digest, "doc_id long, text binary, n long, d1 long, d2 long")
    some = some.join(sets, match(some, sets, columns)).select("key", some["text"]).dropDuplicates(["key"])
    rest = texts.join(odd, match(texts, odd, ["doc_id"]), "left_anti").dropDuplicates(["doc_id"])
    texts = rest.select("doc_id", text_bytes().alias("text")).union(some)
    return tables.keep("texts", texts), new_rows, True


def near_duplicates(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, the smallest doc_id reachable by links."""
    tables = Tables(documents.sparkSession, "near")
    both = tables.keep("digests", shingle_digests(documents, words))
    rows = both.where("n is not null").select("doc_id", "n", "d1", "d2")
    known = frequent(both.where("n is null").select("h", "times"))
    texts, rows, odd = keyed(documents, rows, tables, words)
    representatives = tables.keep("representatives", rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")))
    heads = prefixes(texts, known, words, percent).where("n > 0").join(representatives.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    state = joined(texts, heads, tables, words, percent)
    named = representatives.join(state, representatives["rep"] == state["id"], "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    if odd:  # a component's smallest key may stand for a row without a doc_id of its own
        found = rows.join(named, ["n", "d1", "d2"]).select("own_id", "n", "d1", "d2", "component_id")
        least = found.groupBy("component_id").agg(F.min("own_id").alias("least"))
        named = named.join(least, "component_id").select("n", "d1", "d2", F.col("least").alias("component_id"))
    alone = F.when(F.col("n") == 0, F.col("own_id")).otherwise(F.col("component_id"))
    return rows.join(named, ["n", "d1", "d2"], "left").select(F.col("own_id").alias("doc_id"), F.col("n").alias("n_shingles"), alone.alias("component_id"))
