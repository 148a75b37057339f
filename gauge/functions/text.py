"""Matching of recognised words: sets of spellings, exact and partial matches, bigram similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a diameter sign is read as; least length of partial matches; least similarity; fixed values.
AMBIGUOUS, PARTIAL_LENGTH, SIMILAR = "9@$0oO©¢%&", 3, 0.78


def canon(text: Column) -> Column:
    """Lower case, no spaces, decimal points, and ``d`` for a diameter sign."""
    t = F.regexp_replace(F.lower(text), r"^\s+|\s+$", "")
    return F.translate(t, ",ø⌀Ø ", ".ddd")


def variants(text: Column) -> Column:
    """The spellings that a word may stand for, as an array; empty for an empty word."""
    base = canon(text)
    rest = F.substr(base, F.lit(2))
    doubtful = F.translate(F.substring(base, 1, 1), AMBIGUOUS, "").eqNullSafe(F.lit("")) & F.substring(base, 2, 1).rlike(r"^\d$")
    bare = F.regexp_replace(base, "(mm|deg|°)$", "")
    forms = F.array(base, F.when(doubtful, F.concat(F.lit("d"), rest)), F.when(doubtful | base.startswith("d"), rest), bare)
    return F.array_distinct(F.filter(forms, lambda f: f.isNotNull() & (f != "")))


def match(ours: Column, theirs: Column) -> Column:
    """``exact`` if two arrays of variants share one, ``partial`` if one long enough contains another, else null."""
    long = lambda f: F.length(f) >= PARTIAL_LENGTH
    inside = F.exists(ours, lambda f: long(f) & F.exists(theirs, lambda o: long(o) & (f.contains(o) | o.contains(f))))
    return F.when(F.arrays_overlap(ours, theirs), "exact").when(inside, "partial")


def dice(a: Column, b: Column) -> Column:
    """Similarity of two words by the bigrams that they share, counted with repeats."""
    def grams(s: Column) -> Column:
        return F.when(F.length(s) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(2))))

    def times(all_: Column, g: Column) -> Column:
        return F.size(F.filter(all_, lambda x: x == g))

    ga, gb = grams(a), grams(b)
    shared = F.aggregate(F.array_distinct(ga), F.lit(0), lambda n, g: n + F.least(times(ga, g), times(gb, g)))
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(F.try_divide(2.0 * shared, F.length(a) + F.length(b) - 2))
