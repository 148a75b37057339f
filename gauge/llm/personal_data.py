"""Personal data: fixed patterns, and contexts that they induce, scored over the graph of patterns and instances.

All of it is built-in functions. Matches of the fixed patterns are the seeds. Any stretch of words with a digit or
an at sign is a candidate, and has three contexts: the two words before it, the words on both sides, and the word
before it with its own shape. Contexts (patterns) and candidates' texts (instances) form a graph of distinct edges.
In each round a pattern's confidence in a kind of data is the confidence of its instances over their number plus
one, and patterns above a threshold, with enough instances that are known, lend theirs to instances that are no
seeds. Patterns that are sure after the last round mark unseen identifiers wherever they stand.

Texts are read once; what is found in them goes to a table in the shared folder, and so does every round. A
pattern or instance may have a large part of all edges: sums are partial before they are shuffled, and joins
are on the key and a part of the edge's other end.

Defined results: null and empty texts have no spans; repeated rows repeat their result; a row without doc_id has
the spans of its text; an empty table gives an empty result; further columns pass by unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gauge.llm.common import Tables

KINDS = ("email", "ip", "card", "phone")
#: What starts a match goes on from the match before it, or starts where no earlier character could: each run is tried once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TOKEN = r"[^\s0-9@]*+[0-9@]\S*+"
CANDIDATE = rf"(?<!\S){_TOKEN}(?:\x20{_TOKEN})*+"
#: Characters around a candidate that are not its own.
LEADING, TRAILING = "\"'<[{", "\"'>]},.;:!?*$%"
#: Characters of a neighbouring word that count; digits that a candidate has at least, unless it has an at sign.
CONTEXT, LEAST_DIGITS = 48, 4
#: Rounds; least confidence of a pattern, and of an instance; known instances that a pattern needs at least.
ROUNDS, SURE, BELIEVED, SUPPORT = 3, 0.6, 0.5, 3
#: Parts of a hot pattern's or instance's edges; sure patterns whose table is sent to the candidates, at most.
PARTS, SENT_PATTERNS = 16, 200_000


def spots(pieces: Column, found: Column) -> Column:
    """What lies between matches, and the matches, as an array of (start, match, before, after); start in code points."""
    none = F.array().cast("array<struct<start:int,match:string,before:string,after:string>>")
    steps = F.arrays_zip(pieces.alias("before"), found.alias("match"), F.slice(pieces, F.lit(2), F.size(pieces)).alias("after"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["before"])
        own = F.struct(start.alias("start"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct((start + F.length(x["match"])).alias("at"), F.concat(state["out"], F.array(own)).alias("out"))

    with_match = F.filter(steps, lambda x: x["match"].isNotNull())  # the last piece has none
    return F.aggregate(with_match, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def accepted(kind: str, match: Column) -> Column:
    """Whether a match of a fixed pattern counts."""
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.length(digits(match)).between(13, 19) & F.call_function("luhn_check", digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


#: Texts without it have no match of the kind.
_MAY = {"email": "@", "ip": r"\.[0-9]+\.", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}


def _matched(rows: DataFrame, name: str, pattern: str, may: str) -> DataFrame:
    """``rows`` with the pieces between the matches in ``text``, and the matches; null where there can be none."""
    some = F.col("text").rlike(may)
    return rows.withColumns({f"{name}_pieces": F.when(some, F.split("text", pattern, -1)), f"{name}_found": F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))})


def with_base(rows: DataFrame) -> DataFrame:
    """``rows``, which have ``text``, with ``base``: spans of the fixed patterns (kind, start, end), by kind as listed, then start."""
    for kind in KINDS:  # columns of their own, so that each is made once
        rows = _matched(rows, kind, PATTERNS[kind], _MAY[kind])
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def own(kind: str) -> Column:
        good = F.filter(spots(F.col(f"{kind}_pieces"), F.col(f"{kind}_found")), lambda m: accepted(kind, m["match"]))
        spans = F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["match"])).alias("end")))
        return F.when(F.size(f"{kind}_found") > 0, spans).otherwise(none)

    return rows.withColumn("base", F.concat(*map(own, KINDS))).drop(*(f"{k}_{x}" for k in KINDS for x in ("pieces", "found")))


def shape(core: Column) -> Column:
    """A candidate's form: letters as one a, digits as 9, up to three of them as one."""
    plain = F.regexp_replace(F.regexp_replace(core, r"\p{L}+", "a"), "[0-9]", "9")
    return F.left(F.regexp_replace(plain, "(?<!9)9{1,3}(?!9)", "9"), F.lit(64))


def candidates(pieces: Column, found: Column) -> Column:
    """Candidates (start, end, instance, patterns) from what lies between them and themselves; patterns are the contexts they stand in."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    words = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    some = lambda c: F.nullif(c, F.lit(""))

    # a step at a time: what a step makes is a field, made once
    def bare(m: Column) -> Column:
        inner = F.ltrim(m["match"], F.lit(LEADING))
        return F.struct((m["start"] + F.length(m["match"]) - F.length(inner)).alias("start"), F.rtrim(inner, F.lit(TRAILING)).alias("core"), m["before"].alias("before"), m["after"].alias("after"))

    def placed(m: Column) -> Column:
        return F.struct(m["start"], m["core"], words(F.right(m["before"], F.lit(2 * CONTEXT))).alias("before"), words(F.left(m["after"], F.lit(2 * CONTEXT))).alias("after"), shape(m["core"]).alias("shape"))

    def near(m: Column) -> Column:
        one, two, after = F.element_at(m["before"], -1), F.try_element_at(m["before"], F.lit(-2)), F.get(m["after"], F.lit(0))
        return F.struct(m["start"], m["core"], m["shape"], some(plain(F.right(one, F.lit(CONTEXT)))).alias("one"), some(plain(F.right(two, F.lit(CONTEXT)))).alias("two"), some(plain(F.left(after, F.lit(CONTEXT)))).alias("after"))

    def described(m: Column) -> Column:
        patterns = F.array(F.concat(F.lit("before "), m["two"], F.lit(" "), m["one"]), F.concat(F.lit("around "), m["one"], F.lit(" | "), m["after"]), F.concat(F.lit("shape "), m["one"], F.lit(" | "), m["shape"]))
        instance = F.when(F.length(m["core"]) <= 64, m["core"]).otherwise(F.sha2(m["core"].cast("binary"), 256))
        return F.struct(m["start"], (m["start"] + F.length(m["core"])).alias("end"), instance.alias("instance"), F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"))

    cores = F.filter(F.transform(spots(pieces, found), bare), lambda m: m["core"].contains("@") | (F.length(digits(m["core"])) >= LEAST_DIGITS))
    return F.transform(F.transform(F.transform(cores, placed), near), described)


def scanned(documents: DataFrame) -> DataFrame:
    """doc_id, a key of the row's id and text, its base spans and its candidates, with the kinds of base spans each touches."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = _matched(own, "any", CANDIDATE, "[0-9@]").withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")))
    own = with_base(own).select("doc_id", "key", "base", F.when(F.size("any_found") > 0, candidates(F.col("any_pieces"), F.col("any_found"))).alias("found"))

    def touching(c: Column, kind: str) -> Column:
        return F.exists("base", lambda b: (b["kind"] == kind) & (b["start"] < c["end"]) & (c["start"] < b["end"])).cast("double").alias(kind)

    return own.withColumn("found", F.transform("found", lambda c: F.struct(c["start"], c["end"], c["instance"], c["patterns"], *(touching(c, k) for k in KINDS))))


def _parted(df: DataFrame, key: str, other: str) -> DataFrame:
    """Edges with a part, by their other end, so that a hot key's edges are in several."""
    return df.withColumn("part", F.pmod(F.xxhash64(other), F.lit(PARTS)).cast("int"))


def _in_parts(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))


def learned(found: DataFrame, tables: Tables, rounds: int = ROUNDS) -> DataFrame:
    """Sure patterns with their confidence in each kind, from occurrences of candidates (instance, patterns, kinds).

    An instance that is a seed of some kind anywhere keeps that confidence in all rounds.
    """
    pairs = found.select("instance", F.explode("patterns").alias("pattern"), *KINDS)
    edges = tables.keep("edges", pairs.groupBy("pattern", "instance").agg(*(F.max(k).alias(k) for k in KINDS)))
    state, good = edges, None
    for r in range(rounds):
        known = F.greatest(*(F.col(k) for k in KINDS)) > 0
        sums = state.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_if(known).alias("known"), *(F.sum(k).alias(k) for k in KINDS))
        scored = sums.where(F.col("known") >= SUPPORT).select("pattern", *((F.col(k) / (F.col("n") + 1)).alias(k) for k in KINDS))
        good = tables.keep("good", scored.where(F.greatest(*(F.col(k) for k in KINDS)) >= SURE))
        if r == rounds - 1:
            break
        # what sure patterns say of each instance: it is wrong only if all of them are
        lent = _in_parts(good.select("pattern", *(F.when(F.col(k) >= SURE, F.log1p(-F.col(k))).otherwise(0.0).alias(f"not_{k}") for k in KINDS)))
        said = _parted(edges.select("pattern", "instance"), "pattern", "instance").join(lent, ["pattern", "part"])
        told = said.groupBy("instance").agg(*((1 - F.exp(F.sum(f"not_{k}"))).alias(f"said_{k}") for k in KINDS))
        told = told.where(F.greatest(*(F.col(f"said_{k}") for k in KINDS)) >= BELIEVED)
        seed = F.greatest(*(F.col(k) for k in KINDS)) > 0
        joined = _parted(edges, "instance", "pattern").join(_in_parts(told), ["instance", "part"], "left")
        state = tables.keep("state", joined.select("pattern", "instance", *(F.when(seed, F.col(k)).otherwise(F.coalesce(f"said_{k}", F.lit(0.0))).alias(k) for k in KINDS)))
    tables.drop("edges", "state")
    return good


def find(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, base spans and further spans (kind, start, end) of every row; a further span's kind is context_ and the pattern's."""
    tables = Tables(documents.sparkSession, "private")
    rows = tables.keep("rows", scanned(documents))
    occurrences = rows.select("key", F.explode("found").alias("c")).select("key", "c.*")
    good = learned(occurrences, tables, rounds)
    best = F.array_max(F.array(*(F.struct(F.col(k).alias("p"), F.lit(k).alias("kind")) for k in KINDS)))
    named = good.select("pattern", best.alias("best"))
    fresh = occurrences.where(F.greatest(*(F.col(k) for k in KINDS)) == 0).select("key", "start", "end", F.explode("patterns").alias("pattern"))
    if good.count() <= SENT_PATTERNS:
        hits = fresh.join(F.broadcast(named), "pattern")
    else:
        hits = _parted(fresh, "pattern", "key").join(_in_parts(named), ["pattern", "part"])
    kinds = hits.groupBy("key", "start", "end").agg(F.max("best").alias("best"))
    more = kinds.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("context_"), "best.kind").alias("kind"), "start", "end"))).alias("more"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return rows.select("doc_id", "key", "base").join(more, "key", "left").select("doc_id", "base", F.coalesce("more", none).alias("more"))
