"""Raw files as tables: block-structured reports, point clouds, contour records from extracted words.

Files are read whole (``binaryFile``), one row each, so their lines keep their order; every operator that
needs it orders by ``pos``. Files without lines give no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gauge.functions import names, tolerance
from gauge.operators import scan
from gauge.sources import folders

#: Fields of a data line at least; the block of rows before any header; fixed values.
LEAST_FIELDS, NO_BLOCK = 8, "(sin bloque)"
#: Lines of a file that a task has at once, at most.
SLAB_LINES = 1 << 16
#: Features whose ids travel together, at most; shares of a number's measurements that tasks hold apart.
BLOCK, SHARES = 1 << 16, 16
#: Vertical distance at which words are on different lines.
ROW_GAP = 3.0


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, length and content of all files below ``root`` whose names match a glob."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", "content")


def decode_windows(content: Column) -> Column:
    """Text of Windows-1252 bytes; the five undefined bytes become U+FFFD."""
    high = bytes(range(0x80, 0xA0))
    return F.translate(F.decode(content, "ISO-8859-1"), high.decode("latin-1"), high.decode("cp1252", "replace"))


def lines(text: DataFrame) -> DataFrame:
    """(file, text) to (file, pos, line), without line ends."""
    split = text.select("file", F.posexplode(F.split("text", "\r\n|\r|\n", -1)).alias("pos", "line"))
    return split.select("file", F.col("pos").cast("long").alias("pos"), "line")


def told(found: DataFrame, keep: Callable[[Column], Column], **columns: Column) -> DataFrame:
    """Rows with what their paths say, where ``keep`` holds of that.

    It is worked out once a row: a filter on such columns would be moved below them and work them out again.
    """
    said = F.array(F.struct(*(c.alias(n) for n, c in columns.items())))
    return found.select(*(c for c in found.columns if c not in columns), F.inline(F.filter(said, keep)))


def discover_reports(found: DataFrame) -> DataFrame:
    """Reports by sample and cavity; files of all cavities and of no known one are left out."""
    totals = F.lower(names.stem(F.col("path"))).contains(names.ALL_CAVITIES)
    return told(found.where(~totals), lambda x: x["cavity"].isNotNull(), sample=names.sample_number(F.col("path")), cavity=names.cavity(F.col("path")))


def skipped_reports(found: DataFrame) -> DataFrame:
    """Reports that are not read, and why."""
    totals = F.lower(names.stem(F.col("path"))).contains(names.ALL_CAVITIES)
    reason = F.when(totals, "all cavities").when(names.cavity(F.col("path")).isNull(), "no cavity")
    return told(found.select("path"), lambda x: x["reason"].isNotNull(), reason=reason)


def discover_clouds(found: DataFrame) -> DataFrame:
    """Point clouds of known cavities, with the rank by which the kinds of one cavity are ordered; the rows are in no order."""
    path = F.col("path")
    named = told(found, lambda x: x["cavity"].isNotNull(), sample=names.sample_number(path), cavity=names.cavity(path, "cloud"), family=names.family(path))
    return named.withColumn("rank", F.when(F.col("family") == "perfil", 0).when(F.col("family") == "punts", 1).otherwise(2))


def chosen(found: DataFrame, samples: list[str] | None = None, cavities: list[str] | None = None, family: str | None = None) -> DataFrame:
    """Files of some samples (``8`` is ``08``), cavities (in either case) and one kind; an error if there are none."""
    if samples:
        found = found.where(F.col("sample").isin(*(s.zfill(2) for s in samples)))
    if cavities:
        found = found.where(F.col("cavity").isin(*(c.lower() for c in cavities)))
    if family:
        found = found.where(F.col("family") == family)
    if found.isEmpty():
        raise ValueError("no file is left")
    return found


def discover_contours(found: DataFrame) -> DataFrame:
    """Contour files, with profile and index from names like ``PA_3``."""
    pattern = r"^P([AB])_(\d+)$"
    kept = found.where(names.stem(F.col("path")).rlike(pattern))
    return kept.withColumns({"sample": names.sample_number(F.col("path")), "cavity": names.cavity(F.col("path"), "contour"), "profile": F.regexp_extract(names.stem(F.col("path")), pattern, 1), "index": F.regexp_extract(names.stem(F.col("path")), pattern, 2).cast("int")})


def discover_drawings(found: DataFrame, folder: str = "1-2D y 3D Pieza") -> DataFrame:
    """Drawings in the projects' drawing folders, with size and the code that begins the project's name."""
    project = F.regexp_extract("path", rf"([^/]+)/{folder}/[^/]+$", 1)
    return found.where(F.col("path").rlike(rf"/{folder}/[^/]+$")).select("path", "length", project.alias("project"), F.get(F.split(project, " "), F.lit(0)).alias("code"))


def parse_blocks(rows: DataFrame) -> DataFrame:
    """Measurements of (file, pos, line): a header starts a block, whose data lines are numbered from 1.

    A header's occurrence counts its repeats within the file. Long files are scanned in slabs of lines. Separator lines and lines of nothing but
    semicolons are skipped; a line of too few fields, or without a characteristic, is a header.
    """
    line, fields = F.col("line"), F.split("line", ";", -1)
    used = rows.where((F.regexp_replace(line, r"[;\s]", "") != "") & ~line.startswith("****") & ~line.startswith("////"))
    is_data = (F.size(fields) >= LEAST_FIELDS) & (names.trimmed(F.get(fields, F.lit(1))) != "")
    used = used.withColumns({"f": fields, "header": F.when(~is_data, F.regexp_replace(line, r"[; \t]+$", ""))})
    filled = scan.blocks(used, ["file"], "pos", "header", F.floor(F.col("pos") / SLAB_LINES), NO_BLOCK)
    text = lambda i: F.coalesce(F.get("f", F.lit(i)), F.lit(""))
    parsed = filled.select("file", "pos", "block", "occurrence", "idx", names.trimmed(text(0)).alias("cmm_id"), names.trimmed(text(1)).alias("characteristic"), *(names.number(text(i)).alias(n) for i, n in ((3, "nominal"), (4, "tol_sup"), (5, "tol_inf"), (6, "measured"), (7, "deviation"), (8, "excess"))), names.trimmed(text(9)).alias("bar"))
    return parsed.withColumns({
        "nok": tolerance.out_of_tolerance(F.col("excess"), F.col("bar")),
        "sign_suspect": tolerance.sign_suspect(F.col("nominal"), F.col("measured")),
        "label": names.label(F.col("block"), F.col("idx"), F.col("characteristic"), F.col("cmm_id")),
        "key": names.alignment_key(F.col("block"), F.col("occurrence"), F.col("idx")),
    })


def measured_in(found: DataFrame) -> DataFrame:
    """All measurements of the reports among some files (path, length, content), with sample and cavity."""
    found = discover_reports(found)
    parsed = parse_blocks(lines(found.select(F.col("path").alias("file"), decode_windows(F.col("content")).alias("text"))))
    return parsed.join(found.select(F.col("path").alias("file"), "sample", "cavity"), "file")


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """All measurements of the reports below a folder."""
    return measured_in(files(spark, root, "*.[cC][sS][vV]"))


def parse_cloud(rows: DataFrame) -> DataFrame:
    """Points of (file, pos, line): three numbers a line, in the order of measurement."""
    f = F.split(names.trimmed(F.col("line")), r"\s+")
    xyz = [names.number(F.get(f, F.lit(i))).alias(n) for i, n in enumerate("xyz")]
    return rows.where(names.trimmed(F.col("line")) != "").select("file", "pos", *xyz)


def points_in(found: DataFrame) -> DataFrame:
    """The points of the clouds among some files (path, length, content), with sample, cavity and family."""
    points = parse_cloud(lines(found.select(F.col("path").alias("file"), decode_windows(F.col("content")).alias("text"))))
    path = F.col("file")
    return points.withColumns({"sample": names.sample_number(path), "cavity": names.cavity(path, "cloud"), "family": names.family(path)}).where("cavity is not null")


def read_clouds(spark: SparkSession, root: str) -> DataFrame:
    return points_in(files(spark, root, "*.[tT][xX][tT]"))


def anchor_rows(words: DataFrame, gap: float = ROW_GAP) -> DataFrame:
    """Lines of text from words (file, x0, y0, word): a word further than ``gap`` from its line's first one starts another.

    The reference place is the first word's, not the one before, so it is a fold over one page's words. A page's words
    are brought together once and joined with nothing: a table of lines, small as it looks to Spark, would be sent to all.
    """
    known = words.where(F.col("file").isNotNull() & F.col("y0").isNotNull())
    page = known.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "word"))).alias("words"))
    kind = "struct<anchor:double,starts:array<double>>"
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<double>").alias("starts")).cast(kind)

    def step(acc: Column, y: Column) -> Column:
        same = acc["anchor"].isNotNull() & (F.abs(y - acc["anchor"]) <= gap)
        return F.when(same, acc).otherwise(F.struct(y.alias("anchor"), F.concat(acc["starts"], F.array(y)).alias("starts")).cast(kind))

    # only where rows begin is carried along; a word's row is the number of beginnings down to it
    begun = page.select("file", "words", F.aggregate("words.y0", start, step)["starts"].alias("starts"))
    placed = begun.select("file", "starts", F.explode("words").alias("w")).select("file", F.size(F.filter("starts", lambda s: s <= F.col("w.y0"))).alias("row"), "w.x0", "w.word")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word"))), lambda p: p["word"]), " ")
    return placed.groupBy("file", "row").agg(joined.alias("text"))


def parse_contours(rows: DataFrame) -> DataFrame:
    """One record a file from its lines (file, row, text); of several lines of a kind the last one counts."""
    text, value = F.col("text"), r"\s+(-?[\d.]+)"

    def last(pattern: str, group: int) -> Column:
        found = F.max(F.when(text.rlike(pattern), F.struct("row", F.regexp_extract(text, pattern, group).alias("v"))))
        return found["v"]

    lower, upper = (rf"^{word} \((\d+)\)" + 3 * value for word in ("Contorno", "CONTORN"))
    aggs = {"contour": last(lower, 1), "nominal": last(upper, 1), "time": last(r"(\d{2}\.\d{2}\.\d{4}) (\d{2}:\d{2})", 2)}
    for i, what in enumerate(("tol", "dev", "infr"), 2):
        aggs |= {f"{what}_inf": names.number(last(lower, i)), f"{what}_sup": names.number(last(upper, i))}
    aggs |= {"mean": names.number(last(r"^YZ\(X\)" + value, 1)), "band": names.number(last(r"^Tolerancia:([\d.]+)", 1)), "ld": names.number(last(r"LD=(-?[\d.]+)", 1)), "profile_name": names.trimmed(last(r"^(PERFIL_.*)$", 1))}
    return rows.groupBy("file").agg(*(c.alias(n) for n, c in aggs.items()))


def normalised_words(words: DataFrame, least: int = 30, also: tuple[str, ...] = ()) -> DataFrame:
    """Recognised words (page_w, page_h, left, top, width, height, conf, text) with boxes in percent of the page."""
    kept = words.where((F.col("conf") >= least) & (names.trimmed(F.col("text")) != ""))
    share = lambda c, of: F.bround(F.col(c) / F.col(of) * 100, 3)
    return kept.select(*also, names.trimmed(F.col("text")).alias("t"), share("left", "page_w").alias("x"), share("top", "page_h").alias("y"), share("width", "page_w").alias("w"), share("height", "page_h").alias("h"), F.col("conf").cast("int").alias("c"))


def balloon_boxes(boxes: DataFrame, area: float = 150, least: float = 15, most: float = 900, also: tuple[str, ...] = ()) -> DataFrame:
    """Boxes of the size of balloons, in percent of the page."""
    kept = boxes.where((F.col("area") >= area) & F.col("width").between(least, most) & F.col("height").between(least, most))
    share = lambda c, of: F.bround(F.col(c) / F.col(of) * 100, 3)
    return kept.select(*also, share("left", "page_w").alias("x"), share("top", "page_h").alias("y"), share("width", "page_w").alias("w"), share("height", "page_h").alias("h"), "f")


def mesh_headers(found: DataFrame) -> DataFrame:
    """Triangles that a binary mesh states (four bytes at 80, lowest first), and whether its length agrees."""
    n = F.conv(F.hex(F.reverse(F.substring("content", 81, 4))), 16, 10).cast("long")
    return found.select("path", n.alias("triangles"), (F.col("length") == 84 + 50 * n).alias("whole"))


def wide_cavities(wide: DataFrame, key: str) -> DataFrame:
    """One value column a cavity to rows (key, cavity, value)."""
    return wide.unpivot(key, [c for c in wide.columns if c != key], "cavity", "value")


def filled_down(cells: DataFrame, by: list[str], order: list[str], column: str, slab: Column | None = None) -> DataFrame:
    """A column that only the first row of a group states, carried down to the others; ``slab`` as in ``scan``."""
    found = scan.scan(cells, by, order, F.lit(0) if slab is None else slab, _down=scan.last(column))
    return found.withColumn(column, F.col("_down")).drop("_down")


def latest(versions: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last version of each, by the columns that rank them."""
    at = W.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    return versions.withColumn("turn", F.row_number().over(at)).where("turn = 1").drop("turn")


def by_colour(boxes: DataFrame) -> DataFrame:
    """Number of balloons of each colour family."""
    return boxes.groupBy("f").agg(F.count(F.lit(1)).alias("n"))


def largest_image(images: DataFrame) -> DataFrame:
    """Of the images (file, image, w, h) of each page the one with the largest area; of equal ones the first."""
    best = F.max_by(F.struct("image", "w", "h"), F.struct(F.col("w") * F.col("h"), -F.col("image")))
    return images.groupBy("file").agg(best.alias("b")).select("file", "b.image", "b.w", "b.h")


def history(cells: DataFrame) -> DataFrame:
    """Rows of a history sheet (file, row, a, e, f) below each ``INFORME n`` of column a: there can be several."""
    title = F.nullif(F.regexp_extract("a", r"INFORME\s+(\d+)", 1), F.lit(""))
    named = scan.scan(cells.withColumn("title", title), ["file"], ["row"], F.floor(F.col("row") / SLAB_LINES), block=scan.total(F.when(F.col("title").isNotNull(), 1)), report=scan.last("title"))
    kept = named.where(F.col("title").isNull() & F.col("report").isNotNull() & F.col("a").rlike(r"\d{1,2}/\d{1,2}/\d{4}"))
    return kept.select("file", "row", "block", F.col("report").cast("int").alias("report"), F.col("a").alias("date"), F.col("e").alias("responsible"), F.col("f").alias("remarks"))


def dimension_rows(cells: DataFrame, first_row: int = 14) -> DataFrame:
    """Rows of the sheets named ``DR*`` from cells (file, sheet, row, col, text): the number is carried down."""
    columns = {"A": "nr", "B": "ltr", "C": "type", "D": "nominal", "E": "tol_sup", "F": "tol_inf", "H": "c13", "I": "c14", "J": "c15", "K": "c16", "L": "nok", "M": "comment"}
    wide = cells.where(F.col("sheet").like("DR%") & (F.col("row") >= first_row)).groupBy("file", "sheet", "row").pivot("col", list(columns)).agg(F.first("text"))
    named = wide.select("file", "sheet", "row", *(F.col(c).alias(n) for c, n in columns.items()))
    numbers = [names.number(F.translate(n, ",", ".")).alias(n) for n in ("nominal", "tol_sup", "tol_inf", "c13", "c14", "c15", "c16")]
    filled = filled_down(named, ["file", "sheet"], ["row"], "nr", F.floor(F.col("row") / SLAB_LINES))
    return filled.select("file", "sheet", "row", "nr", "ltr", "type", *numbers, F.coalesce(F.col("nok") == "X", F.lit(False)).alias("nok"), "comment")


def corrections(paragraphs: DataFrame) -> DataFrame:
    """Fields of each slide from its paragraphs (file, slide, pos, text), whose runs are joined."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]), "\n")
    said = paragraphs.groupBy("file", "slide").agg(whole.alias("text"))
    one = lambda pattern, group=1: F.nullif(F.regexp_extract("text", pattern, group), F.lit(""))
    return said.select(
        "file", "slide", one(r"Tool correction nº\s*(\d+)").cast("int").alias("correction"), one(r"P(\d{4})").alias("project"), one(r"(\d{2}/\d{2}/\d{4})").alias("date"),
        F.regexp_extract_all("text", F.lit(r"DIM\.\s*Nr\.?\s*(\d+)"), F.lit(1)).alias("n_numbers"), names.number(F.translate(one(r"([\d,.]+)\s*mm"), ",", ".")).alias("magnitude_mm"),
        names.action_sign(F.col("text")).alias("sign"), F.col("text").rlike(r"(^|\n)OK(\n|$)").alias("done"),
    )


def of_dimensions(features: DataFrame, rows: DataFrame) -> DataFrame:
    """Features (id, n_numbers) beside the measurements (nr, ...) of the dimensions that they name.

    Few numbers can have many features and many measurements each, and far more rows come out than go in. So
    measurements are dealt by number and one of ``SHARES`` shares of it, into as many tasks as a shuffle has, whatever
    their size; features meet each share in blocks of ids, at most those of ``BLOCK`` features, which come apart last.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = features.select("id", "n_numbers", F.floor(F.monotonically_increasing_id() / BLOCK).alias("_block"))
    named = named.select("_block", F.explode("n_numbers").alias("nr"), F.struct("id").alias("_id")).where("nr is not null")
    blocks = named.groupBy("nr", "_block").agg(F.collect_list("_id").alias("_ids"))
    blocks = blocks.select("nr", "_ids", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share"))
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64(*rows.columns), F.lit(SHARES)).cast("int")).repartition(tasks, "nr", "_share")
    met = dealt.join(blocks.hint("merge"), ["nr", "_share"])
    return met.select("nr", F.inline("_ids"), *(c for c in rows.columns if c != "nr"))


def of_lots(scans: DataFrame, samples: DataFrame) -> DataFrame:
    """Scans (path, lot) beside the samples (sample, lot) of their lot, of which there can be several; lots are text."""
    return scans.join(samples, "lot")


def cached(spark: SparkSession, folder: str, signature: dict, compute: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table that ``compute`` gives, kept in ``folder`` beside a manifest with its signature and the size of its files.

    It is made anew where there is none, where the signature differs, where its files are not those that the manifest
    states, and where that is forced. The manifest is written last, so a broken write has none. A signature names
    what the table depends on: the size and time of its input (``folders.stat``) and the parameters.
    """
    manifest = f"{folder}/manifest.json"
    known = folders.read_json(spark, manifest)
    wanted = json.loads(json.dumps(signature))
    if not force and known is not None and known.get("signature") == wanted and folders.stat(spark, f"{folder}/{known['data']}") == known["files"]:
        return spark.read.parquet(f"{folder}/{known['data']}")
    data = f"data-{uuid.uuid4().hex}"  # readers of the old table keep it
    compute().write.parquet(f"{folder}/{data}")
    found = {"signature": wanted, "data": data, "files": folders.stat(spark, f"{folder}/{data}")}
    folders.write_bytes(spark, manifest, json.dumps(found).encode())
    return spark.read.parquet(f"{folder}/{data}")


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """The tables behind the pages of a report, each as Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
