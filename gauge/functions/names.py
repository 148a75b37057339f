"""What paths, codes and labels say: samples, cavities, references, tags. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cavities of the mould; names of files that hold all of them at once; fixed values.
CAVITIES, ALL_CAVITIES = ("13", "14", "15", "16"), "totes"
#: Words of an asset name that mean a scan; fixed pattern.
SCAN = r"(?i)escane|scan|\.stl|\bstl\b"
#: A dimension's number as it is typed; fixed pattern.
DIMENSION = r"(?i)^n?\s*\d{3}(\s*[.\-]\s*[0-9tT])?$"
#: What to do to a mould, and what that does to the part: grows (+), shrinks (-), neither; fixed vocabulary.
ACTIONS = {"+": "cr[eé]ixer|incrementar pl[aà]stic|reduir el ferro|erosionar", "-": "incrementar acer|reduir pl[aà]stic", "0": "polir|n[uú]vol de punts|no fer res|no tocar"}


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def number(text: Column) -> Column:
    """A double, or null where the text is none."""
    t = trimmed(text)
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def padded(digits: Column) -> Column:
    return F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)


def sample_number(path: Column) -> Column:
    """Digits after ``intern`` in the first part of a path that has them; else ``??``."""
    digits = F.regexp_extract(path, r"(?i)intern[.\s]*(\d+)", 1)
    return F.when(digits == "", "??").otherwise(padded(digits))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def cavity(path: Column, kind: str = "report") -> Column:
    """``c13`` to ``c16`` from the file's name or its folder's, or null. ``kind``: report, cloud or contour."""
    letter = r"[cC][._\s]?(\d{2})" if kind == "report" else r"[cC](?:av)?[._\s]?(\d{2})"
    patterns = [r"^(\d{2})[_\s]", letter]
    order = ["stem", "parent"]
    if kind == "contour":
        patterns, order = patterns[::-1], order[::-1]

    def said(places: Column) -> Column:
        found = F.array(*(F.regexp_extract(places[place], pattern, 1) for place in order for pattern in patterns))
        return F.concat(F.lit("c"), F.get(F.filter(found, lambda x: x.isin(*CAVITIES)), F.lit(0)))

    # in a loop over one value the file's and the folder's names are made once, not for each pattern
    return F.get(F.transform(F.array(F.struct(stem(path).alias("stem"), parent(path).alias("parent"))), said), F.lit(0))


def family(path: Column) -> Column:
    """Kind of a point cloud by its name."""
    name = F.upper(stem(path))
    return F.when(name.contains("PUNTS_NOUS"), "nous").when(name.contains("PUNTS"), "punts").otherwise("perfil")


def label(block: Column, idx: Column, characteristic: Column, cmm_id: Column) -> Column:
    tail = F.when(F.coalesce(cmm_id, F.lit("")) != "", F.concat(F.lit("  #"), cmm_id)).otherwise("")
    return F.concat(block, F.lit("  ["), idx.cast("string"), F.lit("] "), characteristic, tail)


def alignment_key(block: Column, occurrence: Column, idx: Column) -> Column:
    return F.concat(block, F.lit("#"), occurrence.cast("string"), F.lit("||"), idx.cast("string"))


def split_reference(reference: Column) -> tuple[Column, Column]:
    """(code, rest) of a free reference: three to five leading digits and what follows, else all of it and nothing."""
    pattern = r"^\s*(\d{3,5})\b[\s.\-_]*(.*)$"
    coded = reference.rlike(pattern)
    code = F.when(coded, F.regexp_extract(reference, pattern, 1)).otherwise(trimmed(reference))
    return code, F.when(coded, trimmed(F.regexp_extract(reference, pattern, 2))).otherwise("")


def reclassified(kind: Column, name: Column) -> Column:
    """Kind ``part`` becomes ``scan`` where the name tells of one."""
    return F.when((kind == "part") & F.coalesce(name.rlike(SCAN), F.lit(False)), "scan").otherwise(kind)


def with_rest(name: Column, rest: Column, chosen: Column) -> Column:
    """A name with what its reference said besides the part's name, unless it already has that."""
    add = (rest != "") & ~rest.eqNullSafe(chosen) & ~F.lower(name).contains(F.lower(rest))
    return F.when(add, F.substring(F.concat(name, F.lit(" - "), rest), 1, 255)).otherwise(name)


def rebuilt_reference(code: Column, name: Column) -> Column:
    return F.trim(F.concat(code, F.lit(" "), F.coalesce(name, F.lit(""))))


def part_label(code: Column, name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(code, F.lit(" - "), name)).otherwise(code)


def tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")


def dimensions(header: Column) -> Column:
    """Numbers of all dimensions that a header names."""
    return F.regexp_extract_all(header, F.lit(r"N(\d+)"), F.lit(1))


def height(header: Column) -> Column:
    """The height that a header states as ``H=``, or null."""
    return number(F.nullif(F.regexp_extract(header, r"H=\s*(-?[\d.]+)", 1), F.lit("")))


def action_sign(action: Column) -> Column:
    """``+``, ``-`` or ``0`` for what an action does to the part, null for an unknown one."""
    found = F.when(F.lit(False), "")
    for sign, pattern in ACTIONS.items():
        found = found.when(action.rlike(f"(?i){pattern}"), sign)
    return found


def looks_like_dimension(query: Column) -> Column:
    return F.trim(query).rlike(DIMENSION)


def code_order(code: Column) -> list[Column]:
    """Sort keys by which numbers come in numeric order, before other codes."""
    return [code.try_cast("long").asc_nulls_last(), code.asc()]


def file_size(n: Column) -> Column:
    """Bytes for people: B, KB without decimals, MB with one."""
    kb = F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" KB"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, kb).otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))


def initials(name: Column) -> Column:
    return F.upper(F.array_join(F.transform(F.slice(F.split(name, " "), 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def scan_name(path: Column) -> Column:
    """(project, lot, cavity, date) of a scan named ``project-lot-cavity``, or ``day-month-year_cavity-project``; fixed patterns."""
    name, dated = stem(path), r"^(\d{2}-\d{2}-\d{4})_([^-]+)-(.+)$"
    parts, other = F.split(name, "-"), name.rlike(dated)
    from_date = lambda k: F.regexp_extract(name, dated, k)
    part = lambda k: F.get(parts, F.lit(k))
    return F.struct(F.when(other, from_date(3)).otherwise(part(0)).alias("project"), F.when(~other, part(1)).alias("lot"), F.when(other, from_date(2)).otherwise(part(2)).alias("cavity"), F.when(other, from_date(1)).alias("date"))


def element(profile: Column, index: Column) -> Column:
    """Name of a contour's element, such as ``PA_3``."""
    return F.concat(F.lit("P"), profile, F.lit("_"), index.cast("string"))


def shortened(text: Column, most: int = 60) -> Column:
    return F.substring(text, 1, most)


def role(header: Column) -> Column:
    """Whether a header's dimension is a smallest or largest value, or both."""
    least, most = header.rlike(r"\bMIN\b"), header.rlike(r"\bMAX\b")
    return F.when(least & most, "min/max").when(least, "min").when(most, "max")


def or_else(text: Column, default: str) -> Column:
    """A text to show: the default where it is missing or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def given(value: Column) -> Column:
    """A search parameter as text; an empty one is none."""
    return F.nullif(value.cast("string"), F.lit(""))


def new_part(code: Column, name: Column) -> tuple[Column, Column]:
    """Code and name as typed, without white space around them; an empty name is none."""
    return F.trim(code), F.nullif(F.trim(name), F.lit(""))


def natural_key(code: Column) -> Column:
    """A text that sorts codes with numbers in them by the numbers' value, and letters in either case alike: ``A2`` before ``a10``.

    A run of digits becomes a mark that is smaller than any letter, its number of digits without leading zeros, and
    those digits; ties are the caller's.
    """
    runs = F.regexp_extract_all(F.lower(code), F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def part(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+", "")
        return F.when(run.rlike("^[0-9]"), F.concat(F.lit("\x01"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(run)

    return F.array_join(F.transform(runs, part), "")
