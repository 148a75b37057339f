"""Search in words with boxes: exact, partial and approximate tiers, phrases by position, reading order."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gauge.functions import text
from gauge.sources.folders import cut

#: Gap between neighbours of a phrase, in percent of the page; vertical shift in heights of a word.
GAP_LEAST, GAP_MOST, SHIFT = -0.3, 1.6, 0.7
#: Side of the cells by which words meet, in percent of the page; what rounding may add.
CELL, SLACK = 2.0, 1e-6
#: Distinct words whose matches are sent to all tasks, at most.
SENT_WORDS = 200_000


def spellings(spark: SparkSession, term: str) -> list[str]:
    """The few spellings of a query's word, as values; a Column of them would be worked out for every row."""
    return spark.range(1).select(text.variants(F.lit(term))).first()[0]


def literal_variants(spark: SparkSession, term: str) -> Column:
    return F.array(*map(F.lit, spellings(spark, term))).cast("array<string>")


def block_ratio(ours: list[str], theirs: list[str]) -> float:
    """Best matching-block ratio between two lists of spellings; built-ins have no such measure."""
    return max((difflib.SequenceMatcher(None, f, o).ratio() for f in ours for o in theirs), default=0.0)


def reach(form: Column, other: str) -> Column:
    """What the matching-block ratio of a spelling and another can be at most: by the characters that both have, with repeats."""
    common = F.lit(0)
    for c in sorted(set(other)):
        common = common + F.least(F.length(form) - F.length(F.replace(form, F.lit(c), F.lit(""))), F.lit(other.count(c)))
    return F.try_divide(2.0 * common, F.length(form) + len(other))


def points(form: Column, theirs: list[str]) -> Column:
    """3 where a spelling is one of others, 2 where one contains the other and both are long enough, else null."""
    inside = F.lit(False)
    for o in theirs:
        if len(o) >= text.PARTIAL_LENGTH:
            inside = inside | form.contains(o) | F.lit(o).contains(form)
    return F.when(form.isin(*theirs), 3.0).when((F.length(form) >= text.PARTIAL_LENGTH) & inside, 2.0)


def sent(rows: DataFrame) -> DataFrame:
    """``rows``, kept; few enough, they are sent to what they are joined with, which then is not dealt anew."""
    kept = cut(rows)
    return F.broadcast(kept) if kept.count() <= SENT_WORDS else kept


def may_match(word: Column, theirs: list[str]) -> Column:
    """Whether a word could match one of some spellings: by plain expressions, which work out none of its own.

    A word's spellings are parts of it, or ``d`` before one; a part of a spelling is at most four characters shorter
    than its word.
    """
    base, may = F.translate(F.lower(word), ",ø⌀Ø ", ".ddd"), F.lit(False)
    size = F.length(F.translate(base, "\t\n\x0b\f\r", ""))
    for o in theirs:
        parts = {o[i : i + text.PARTIAL_LENGTH] for i in range(max(1, len(o) - text.PARTIAL_LENGTH + 1))}
        for whole, pieces in ((True, {o}), (False, parts)):
            for piece in sorted({q for p in pieces for q in (p, p[1:] if p[0] == "d" else p)}):
                found = base.contains(piece)
                may = may | (found if whole else found & (size <= len(o) + 4))
    return may


def hit(words: DataFrame, theirs: list[str]) -> DataFrame:
    """Words that match, with ``score``: 3 for an exact, 2 for a partial match.

    Each word is judged where it is: a vocabulary would be dealt out, and the matching part of it joined, and that
    part grows with the texts.
    """
    score = F.array_max(F.transform(text.variants(F.col("t")), lambda f: points(f, theirs)))
    # a generator's column is worked out once, below the filter
    return words.where(may_match(F.col("t"), theirs)).select("*", F.explode(F.array(score)).alias("score")).where("score is not null")


def placed(words: DataFrame, found: DataFrame) -> DataFrame:
    """Words with what was found of each distinct one; few enough, that is sent to the words, which stay where they are."""
    return words.join(F.broadcast(found) if found.count() <= SENT_WORDS else found, "t")


def matched(distinct: DataFrame, theirs: list[str]) -> DataFrame:
    """(t, v, score, most): words with their spellings, 3 for an exact, 2 for a partial match, else null, and what an approximate one can reach.

    Spellings are rows, so each is made once and compared by plain expressions.
    """
    f = F.col("f")
    forms = distinct.select("t", F.explode(text.variants(F.col("t"))).alias("f"))
    most = F.greatest(*(reach(f, o) for o in theirs), F.lit(0.0), F.lit(0.0))
    return forms.groupBy("t").agg(F.collect_list("f").alias("v"), F.max(points(f, theirs)).alias("score"), F.max(most).alias("most"))


def _similar(words: DataFrame, theirs: list[str], fuzzy: str) -> DataFrame:
    """Words that match, also approximately, with ``score``."""
    # a vocabulary is far smaller than its text: each distinct word is compared once
    found = matched(words.select("t").distinct(), theirs)
    if fuzzy == "blocks":

        def similar(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                bare = frame["score"].isna()
                frame.loc[bare, "score"] = [block_ratio(v, theirs) for v in frame.loc[bare, "v"]]
                yield frame[["t", "score"]]

        near = found.where(F.col("score").isNotNull() | (F.col("most") >= text.SIMILAR - 1e-9))
        found = near.select("t", "v", "score").mapInPandas(similar, "t string, score double")
    elif fuzzy == "dice":
        best = F.array_max(F.flatten(F.transform("v", lambda a: F.array(*(text.dice(a, F.lit(o)) for o in theirs)))))
        found = found.select("t", F.coalesce("score", best).alias("score"))
    return placed(words, cut(found.where(F.col("score") >= text.SIMILAR).select("t", "score")))


def tiers(words: DataFrame, query: str, by: list[str], fuzzy: str | None = "blocks") -> DataFrame:
    """Hits of one word, best tier of each group of ``by`` only: exact, else partial, else approximate.

    ``words`` needs t. ``fuzzy``: blocks (Python on words that match in no other way and have enough characters in
    common with the query), dice or None. A query or word without spellings matches nothing.
    """
    theirs = spellings(words.sparkSession, query)
    hits = hit(words, theirs) if fuzzy is None else _similar(words, theirs, fuzzy)
    tier = F.when(F.col("score") == 3, 1).when(F.col("score") == 2, 2).otherwise(3)
    best = hits.withColumn("tier", tier).withColumn("best", F.min("tier").over(W.partitionBy(*by))).where("tier = best")
    mode = F.when(F.col("tier") == 1, "exact").when(F.col("tier") == 2, "partial").otherwise("approximate")
    return best.withColumn("mode", mode).drop("tier", "best")


def ranked(hits: DataFrame, n: int = 10, ties: tuple[str, ...] = ("i",)) -> DataFrame:
    """The first hits by score, then from the top of the page, then by ``ties``."""
    return hits.orderBy(F.desc("score"), "y", *ties).limit(n)


def marked(hits: DataFrame, by: str, width: int, height: int, n: int = 10) -> DataFrame:
    """The first ``n`` hits of each page with their rank, whether they are the best, and their boxes in whole pixels."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "y", "i"))
    px = lambda c, of: (F.col(c) / 100 * of).cast("int").alias(f"{c}_px")
    return hits.withColumn("rank", rank).where(F.col("rank") <= n).select(by, "i", "t", "rank", (F.col("rank") == 1).alias("best"), px("x", width), px("y", height), px("w", width), px("h", height))


def phrase(words: DataFrame, terms: list[str], by: str) -> DataFrame:
    """Chains of words that match the terms one after another, with the box around each chain.

    Words (by, i, t, x, y, w, h). From each word that matches the first term the nearest one on the same line
    that matches the next is taken, and so on; a chain that cannot go on is dropped. One join a term, on the page
    and on cells that a neighbour can lie in, so only words near one another meet.
    """
    spark = words.sparkSession
    chain = None
    for term in terms:
        fit = hit(words, spellings(spark, term)).withColumn("m", F.when(F.col("score") == 3, "exact").otherwise("partial"))
        if chain is None:
            chain = fit.select(by, F.col("i").alias("i0"), "i", "x", "y", "w", "h", F.col("t").alias("found"), (F.col("m") == "exact").alias("exact"), F.col("x").alias("left"), F.col("y").alias("top"), (F.col("x") + F.col("w")).alias("right"), (F.col("y") + F.col("h")).alias("bottom"))
            continue
        after = fit.select(by, *(F.col(c).alias(f"n_{c}") for c in ("i", "t", "x", "y", "w", "h", "m")))
        gap = F.col("n_x") - (F.col("x") + F.col("w"))
        cell = lambda v: F.floor(v / CELL).cast("int")
        across = F.sequence(cell(F.col("x") + F.col("w") + GAP_LEAST - SLACK), cell(F.col("x") + F.col("w") + GAP_MOST + SLACK))
        down = F.sequence(cell(F.col("y") - F.col("h") * SHIFT - SLACK), cell(F.col("y") + F.col("h") * SHIFT + SLACK))
        after = after.withColumns({"cell": cell(F.col("n_x")), "band": cell(F.col("n_y"))})
        near = chain.withColumn("cell", F.explode(across)).withColumn("band", F.explode(down)).join(after, [by, "cell", "band"]).where(gap.between(GAP_LEAST, GAP_MOST) & (F.abs(F.col("n_y") - F.col("y")) <= F.col("h") * SHIFT))
        first = F.row_number().over(W.partitionBy(by, "i0").orderBy("n_x", "n_i"))
        near = near.withColumn("turn", first).where("turn = 1")
        chain = near.select(by, "i0", F.col("n_i").alias("i"), F.col("n_x").alias("x"), F.col("n_y").alias("y"), F.col("n_w").alias("w"), F.col("n_h").alias("h"), F.concat_ws(" ", "found", "n_t").alias("found"), (F.col("exact") & (F.col("n_m") == "exact")).alias("exact"), F.least("left", "n_x").alias("left"), F.least("top", "n_y").alias("top"), F.greatest("right", F.col("n_x") + F.col("n_w")).alias("right"), F.greatest("bottom", F.col("n_y") + F.col("n_h")).alias("bottom"))
    return chain.select(by, "i0", F.col("found").alias("t"), F.when(F.col("exact"), "exact").otherwise("partial").alias("mode"), F.col("left").alias("x"), F.col("top").alias("y"), (F.col("right") - F.col("left")).alias("w"), (F.col("bottom") - F.col("top")).alias("h"))


def reading_order(of: Callable[[str], Column] = F.col) -> list[Column]:
    """Sort keys: bands of half a percent from the top, then from the left; ``of`` gives a word's fields."""
    return [F.bround(of("y") * 2), of("x")]


def printed(of: Callable[[str], Column] = F.col) -> Column:
    """A word's line in the text dump: confidence, place, word."""
    return F.format_string("%3d  %6.2f %6.2f   %s", *map(of, "cxyt"))


LIST_MARK = r"^\s*[-*]\s+"
#: Bold, italic and code in light markup; fixed.
INLINE = r"\*\*[^*]+\*\*|\*[^*]+\*|`[^`]+`"


def line_islands(lines: DataFrame, by: str) -> DataFrame:
    """Runs of lines of one kind: (by, first, kind, n, lines); kinds are list and text."""
    kind = F.when(F.col("line").rlike(LIST_MARK), "list").otherwise("text")
    order = W.partitionBy(by).orderBy("pos")
    seen = lines.withColumn("kind", kind)
    start = F.when(F.lag("kind").over(order) == F.col("kind"), 0).otherwise(1)
    numbered = seen.withColumn("start", start).withColumn("island", F.sum("start").over(order.rowsBetween(W.unboundedPreceding, 0)))
    own = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return numbered.groupBy(by, "island").agg(F.min("pos").alias("first"), F.first("kind").alias("kind"), F.count(F.lit(1)).alias("n"), own.alias("lines")).drop("island")


def inline_marks(islands: DataFrame) -> DataFrame:
    """Marked and plain pieces of runs of lines: the columns of ``islands`` but lines, and part, at, mark and text.

    A run of text is one part, its lines joined; in a list each line is one, without its mark. ``at`` numbers the
    pieces of a part; empty ones are left out. A piece that starts and ends as a marked one counts as marked.
    """
    parts = F.when(F.col("kind") == "list", F.transform("lines", lambda x: F.regexp_replace(x, LIST_MARK, ""))).otherwise(F.array(F.array_join("lines", "\n")))
    rest = [c for c in islands.columns if c != "lines"]
    own = islands.select(*rest, F.posexplode(parts).alias("part", "whole"))
    own = own.withColumns({"plain": F.split("whole", INLINE, -1), "marked": F.regexp_extract_all("whole", F.lit(INLINE), F.lit(0))})
    pieces = F.flatten(F.transform(F.arrays_zip("plain", "marked"), lambda z: F.array(z["plain"], z["marked"])))
    found = own.select(*rest, "part", F.posexplode(F.filter(pieces, lambda x: x.isNotNull())).alias("at", "piece"))
    both = lambda m: F.col("piece").startswith(m) & F.col("piece").endswith(m)
    mark = F.when(both("**"), "bold").when(both("`"), "code").when(both("*"), "italic").otherwise("plain")
    width = F.when(both("**"), 2).when(both("`") | both("*"), 1).otherwise(0)
    text_ = F.substr("piece", width + 1, F.greatest(F.length("piece") - 2 * width, F.lit(0)))
    return found.where("piece <> ''").select(*rest, "part", "at", mark.alias("mark"), text_.alias("text"))


def grams(form: Column) -> Column:
    """The distinct three-character pieces of a spelling of three characters or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(form) - 2), lambda i: F.substr(form, i, F.lit(3))))


def _contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(s, l): spellings s of ``short`` (s) within spellings l of ``long`` (l), both distinct and long enough.

    What contains a spelling has all its pieces of three characters: a spelling with a piece that no long one has goes
    at once, so of many short and few long spellings only those remain that can match. The piece of the others that
    fewest of the long spellings have leads to those, and only they are verified.
    """
    postings = long.where(F.length("l") >= text.PARTIAL_LENGTH).select("l", F.explode(grams(F.col("l"))).alias("g"))
    counts = sent(postings.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    pieces = short.where(F.length("s") >= text.PARTIAL_LENGTH).select("s", grams(F.col("s")).alias("all"))
    asked = pieces.select("s", F.size("all").alias("pieces"), F.explode("all").alias("g"))
    known = asked.join(counts, "g").groupBy("s", "pieces").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("n", "g")).alias("best"))
    best = sent(known.where("found = pieces").select("s", F.col("best.g").alias("g")))
    return best.join(postings, "g").where(F.col("l").contains(F.col("s"))).select("s", "l")


def many_terms(vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, t, score): every word t that matches a term, 3 for an exact, 2 for a partial match.

    ``vocabulary`` has t, ``terms`` term, both distinct. Spellings meet by equality; containment, either way, by
    pieces of three characters. No term is compared with words that share none of them. The spellings are kept, as
    six steps read them.
    """
    ours = cut(vocabulary.select("t", F.explode(text.variants(F.col("t"))).alias("f")))
    theirs = cut(terms.select("term", F.explode(text.variants(F.col("term"))).alias("o")))
    exact = ours.join(theirs, F.col("f") == F.col("o")).select("term", "t", F.lit(3.0).alias("score"))
    f, o = ours.select("f").distinct(), theirs.select("o").distinct()
    inner = _contained(o.withColumnRenamed("o", "s"), f.withColumnRenamed("f", "l")).select(F.col("s").alias("o"), F.col("l").alias("f"))
    outer = _contained(f.withColumnRenamed("f", "s"), o.withColumnRenamed("o", "l")).select(F.col("l").alias("o"), F.col("s").alias("f"))
    partial = inner.union(outer).distinct().join(theirs, "o").join(ours, "f").select("term", "t", F.lit(2.0).alias("score"))
    return exact.union(partial).groupBy("term", "t").agg(F.max("score").alias("score"))


def many_hits(words: DataFrame, terms: DataFrame, by: list[str]) -> DataFrame:
    """Words that match the terms, with term, score and mode: of each term and group of ``by`` the best tier only."""
    hits = words.join(sent(many_terms(words.select("t").distinct(), terms)), "t")
    best = hits.groupBy("term", *by).agg(F.max("score").alias("score"))
    return hits.join(best, ["term", *by, "score"], "left_semi").withColumn("mode", F.when(F.col("score") == 3, "exact").otherwise("partial"))


#: Between the documents of a text file: no document has an empty line, or one of a form feed.
NEXT_DOCUMENT = "\n\f\n"


def _line(of: Callable[[str], Column]) -> Column:
    """A word's line below its place in the reading order."""
    return F.struct(*(c.alias(f"k{i}") for i, c in enumerate(reading_order(of))), printed(of).alias("line"))


def _write(documents: DataFrame, by: str, lines: Column, folder: str) -> None:
    text = F.array_join(F.transform(F.array_sort(lines), lambda x: x["line"]), "\n")
    # one without lines goes as a text is taken from an array of one: a filter would make the texts twice
    whole = documents.select(by, F.explode(F.filter(F.array(text), lambda t: t != "")).alias("text"))
    whole.select(F.concat_ws("\n", F.to_json(F.struct(by)), "text").alias("value")).write.options(lineSep=NEXT_DOCUMENT, compression="gzip").text(folder)


def write_text(words: DataFrame, by: str, folder: str) -> None:
    """Each document's words as text in reading order, below a line with its id: many documents a file, a file a task.

    A folder a document would be as many folders to make and to list as there are documents. A document is one row
    when it is written, so its lines keep their order. Lines are several times as long as their words: files are packed.
    """
    _write(words.groupBy(by).agg(F.collect_list(_line(F.col)).alias("_lines")), by, F.col("_lines"), folder)


def write_documents(documents: DataFrame, by: str, words: str, folder: str) -> None:
    """As ``write_text``, of documents whose words are in an array of theirs: nothing travels. Those without words are left out."""
    _write(documents, by, F.transform(words, lambda w: _line(lambda c: w[c])), folder)


def read_text(spark: SparkSession, by: str, folder: str) -> DataFrame:
    """(by, pos, line) of the texts that were written; ids are text."""
    whole = spark.read.option("lineSep", NEXT_DOCUMENT).text(folder)
    told = whole.select(F.from_json(F.substring_index("value", "\n", 1), f"`{by}` string")[by].alias(by), F.regexp_replace("value", r"\A[^\n]*\n", "").alias("value"))
    return told.select(by, F.posexplode(F.split("value", "\n", -1)).alias("pos", "line"))
