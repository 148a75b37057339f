"""The formats' own cases: fixture files and rows that the documents give, with the rows that are to be found.

Each case is a function of a session, with SQL that states its rows; ``test_formats.py`` compares them.
"""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import functions as F

from gauge.functions import names
from gauge.operators import catalog, search
from gauge.sources import folders, reports

CASES: dict = {}


def query(sql):
    def register(f):
        CASES[f.__name__] = f, sql
        return f

    return register


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


PATHS = ["r/support intern.01/3212_c13.csv", "r/support.intern.8/13_3212.csv", "r/support.intern.05/c15/3212_Cav_.txt", "r/C16/PA_3.pdf", "r/INTERN 3/3212c14.csv", "r/intern.01/3212_totes.csv", "r/intern.02/3212_c17.csv", "r/none/PUNTS_NOUS_c13.txt", "r/Cav_14/punts.txt"]


def _values(names_, found):
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in found)}) v({', '.join(names_)})"


@query(_values(["path", "sample"], zip(PATHS, ["01", "08", "05", "??", "03", "01", "02", "??", "??"], strict=True)))
def p1_sample(spark, sf_dir):
    return rows(spark, [(p,) for p in PATHS], "path string").select("path", names.sample_number(F.col("path")).alias("sample"))


def _cavities(kind):
    return lambda spark: rows(spark, [(p,) for p in PATHS], "path string").select("path", names.cavity(F.col("path"), kind).alias("cavity"))


@query(_values(["path", "cavity"], zip(PATHS, ["c13", "c13", "c15", "c16", "c14", None, None, "c13", None], strict=True)))
def p2_cavity_csv(spark, sf_dir):
    return _cavities("report")(spark)


@query(_values(["path", "cavity"], zip(PATHS, ["c13", "c13", "c15", "c16", "c14", None, None, "c13", "c14"], strict=True)))
def p2_cavity_txt(spark, sf_dir):
    return _cavities("cloud")(spark)


@query(_values(["path", "cavity"], zip(PATHS, ["c13", "c13", "c15", "c16", "c14", None, None, "c13", "c14"], strict=True)))
def p2_cavity_pdf(spark, sf_dir):
    return _cavities("contour")(spark)


@query(_values(["path", "family"], zip(PATHS, ["perfil"] * 7 + ["nous", "punts"], strict=True)))
def p3_family(spark, sf_dir):
    return rows(spark, [(p,) for p in PATHS], "path string").select("path", names.family(F.col("path")).alias("family"))


NUMBERS = [" 1.5 ", "", "abc", "-0.25", "+3", "1d", "1_0", ".5", "1e3", "1.", "-"]


@query(_values(["text", "value"], zip(NUMBERS, [1.5, None, None, -0.25, 3.0, None, None, 0.5, 1000.0, 1.0, None], strict=True)).replace("SELECT *", "SELECT text, CAST(value AS DOUBLE) AS value"))
def p4_tolerant_cast(spark, sf_dir):
    return rows(spark, [(n,) for n in NUMBERS], "text string").select("text", names.number(F.col("text")).alias("value"))


REPORT = ["r/a.csv", "orphan;Pla;;1.0;0.1;-0.1;1.05;0.05\r\n****\r\nN178 PLAN. 0.10 MAX.;;\r\n11;Planitud;;0.000;0.100;0.000;0.061;0.061; ;-----**----\r\n*** POS H=5.0 ***\r\n31;Pos X;;31.000;0.100;-0.100;-30.990;-61.990;61.89;<<---\r\n32;Pos Z; ;x;0.1;-0.1;5.0;0.0;;--*--;extra\r\n;;;;\r\n////\r\nN178 PLAN. 0.10 MAX.\r\n;Planitud;;0.000;0.100;0.000;0.2;0.2;0.1;\r\n7;seven;;1;2;3;4\r\n8; ;;1;2;3;4;5"]
BLOCKS = [
    (0, "(sin bloque)", 0, 1, "orphan", "Pla", 1.0, 1.05, None, False, False), (3, "N178 PLAN. 0.10 MAX.", 1, 1, "11", "Planitud", 0.0, 0.061, None, False, False),
    (5, "*** POS H=5.0 ***", 1, 1, "31", "Pos X", 31.0, -30.99, 61.89, True, True), (6, "*** POS H=5.0 ***", 1, 2, "32", "Pos Z", None, 5.0, None, False, False), (10, "N178 PLAN. 0.10 MAX.", 2, 1, "", "Planitud", 0.0, 0.2, 0.1, True, False),
]


def report(spark):
    return reports.parse_blocks(reports.lines(rows(spark, [REPORT], "file string, text string")))


@query("SELECT pos, block, occurrence, idx, cmm_id, characteristic, CAST(nominal AS DOUBLE) AS nominal, CAST(measured AS DOUBLE) AS measured, CAST(excess AS DOUBLE) AS excess, nok, sign_suspect FROM (" + _values(["pos", "block", "occurrence", "idx", "cmm_id", "characteristic", "nominal", "measured", "excess", "nok", "sign_suspect"], BLOCKS) + ")")
def s6_block_parse(spark, sf_dir):
    return report(spark).select("pos", "block", "occurrence", "idx", "cmm_id", "characteristic", "nominal", "measured", "excess", "nok", "sign_suspect")


@query(_values(["pos", "block", "occurrence", "idx"], [b[:4] for b in BLOCKS]))
def w1_occurrence(spark, sf_dir):
    return report(spark).select("pos", "block", "occurrence", "idx")


@query(_values(["pos", "label"], [(b[0], f"{b[1]}  [{b[3]}] {b[5]}" + (f"  #{b[4]}" if b[4] else "")) for b in BLOCKS]))
def p9_label(spark, sf_dir):
    return report(spark).select("pos", "label")


@query(_values(["pos", "key"], [(b[0], f"{b[1]}#{b[2]}||{b[3]}") for b in BLOCKS]))
def p10_key(spark, sf_dir):
    return report(spark).select("pos", "key")


@query("SELECT pos, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM (" + _values(["pos", "x", "y", "z"], [(0, 0.0392, 0.0203, 27.739), (2, -1.5, 2.0, 3.0)]) + ")")
def s7_cloud(spark, sf_dir):
    own = rows(spark, [("a", "+0000.0392 +0000.0203 +0027.7390\n\n -0001.5\t2 3")], "file string, text string")
    return reports.parse_cloud(reports.lines(own)).select("pos", "x", "y", "z")


CONTOUR_WORDS = [(w, float(x), y) for y, line in ((1.0, "Contorno (21) -0.025 -0.242 -0.217"), (20.0, "CONTORN (10) 0.025 -0.038 0.000"), (40.5, "YZ(X) 0.181"), (60.0, "LD=0.5 12.03.2024 10:15"), (80.0, "PERFIL_A"), (90.0, "Contorno (22) -0.030 -0.1 -0.2")) for x, w in enumerate(line.split())]


@query("SELECT '22' AS contour, '10' AS nominal, -0.03::DOUBLE AS tol_inf, -0.2::DOUBLE AS infr_inf, 0.025::DOUBLE AS tol_sup, 0.0::DOUBLE AS infr_sup, 0.181::DOUBLE AS mean, 0.5::DOUBLE AS ld, '10:15' AS time, 'PERFIL_A' AS profile_name")
def s8_contour(spark, sf_dir):
    own = rows(spark, [("a", x, y, w) for w, x, y in CONTOUR_WORDS], "file string, x0 double, y0 double, word string")
    return reports.parse_contours(reports.anchor_rows(own)).select("contour", "nominal", "tol_inf", "infr_inf", "tol_sup", "infr_sup", "mean", "ld", "time", "profile_name")


@query(_values(["row", "text"], [(1, "a b"), (2, "c"), (3, "d")]))
def w5_anchor_rows(spark, sf_dir):
    own = rows(spark, [("f", 2.0, 1.0, "b"), ("f", 1.0, 3.5, "a"), ("f", 0.0, 4.2, "c"), ("f", 0.0, 9.0, "d")], "file string, x0 double, y0 double, word string")
    return reports.anchor_rows(own).select("row", "text")


PHRASE = [(0, "PRESSURE", 0.0, 1.0, 5.0, 1.0), (1, "TEST", 6.6, 1.7, 2.0, 1.0), (2, "TEST", 4.7, 1.0, 1.0, 1.0), (3, "pressure", 20.0, 1.0, 5.0, 1.0), (4, "test", 26.61, 1.0, 2.0, 1.0), (5, "PRESSURES", 40.0, 5.0, 5.0, 1.0), (6, "TEST", 45.5, 5.71, 2.0, 1.0), (7, "TESTS", 45.5, 5.5, 2.0, 1.0)]


@query("SELECT i0, t, mode, CAST(x AS DOUBLE) AS x, CAST(w AS DOUBLE) AS w FROM (" + _values(["i0", "t", "mode", "x", "w"], [(0, "PRESSURE TEST", "exact", 0.0, 5.7), (5, "PRESSURES TESTS", "partial", 40.0, 7.5)]) + ")")
def j6_phrase(spark, sf_dir):
    own = rows(spark, [("p", *w) for w in PHRASE], "page string, i int, t string, x double, y double, w double, h double")
    return search.phrase(own, ["pressure", "test"], "page").select("i0", "t", "mode", "x", F.round("w", 6).alias("w"))


OLD = [(1, "scan of lid", "part", "3212 Pump Housing"), (2, "model", "part", "3212 Pump Housing"), (3, "drawing", "drawing", "3212 lote 315346"), (4, "flow", "moldflow", "Valve"), (5, "none", "part", None), (6, "file.stl", "part", " ")]


@query(_values(["id", "name", "kind", "part_code"], [(1, "scan of lid", "scan", "3212"), (2, "model", "part", "3212"), (3, "drawing - lote 315346", "drawing", "3212"), (4, "flow", "moldflow", "Valve"), (5, "none", "part", None), (6, "file.stl", "scan", None)]))
def m8_backfill(spark, sf_dir):
    return catalog.backfilled(rows(spark, OLD, "id int, name string, kind string, part_ref string"))[1]


@query(_values(["code", "name"], [("3212", "Pump Housing"), ("Valve", None)]))
def m8_backfilled_parts(spark, sf_dir):
    return catalog.backfilled(rows(spark, OLD, "id int, name string, kind string, part_ref string"))[0]


ACTIONS = [("Fer créixer el plàstic", "+"), ("Reduir el ferro", "+"), ("incrementar acer", "-"), ("Reduir plàstic", "-"), ("Polir", "0"), ("No fer res", "0"), ("altres", None)]


@query(_values(["action", "sign"], ACTIONS))
def d_p31_sign(spark, sf_dir):
    return rows(spark, [(a,) for a, _ in ACTIONS], "action string").select("action", names.action_sign(F.col("action")).alias("sign"))


@query(_values(["header", "numbers", "height"], [("N170 BOLT 1 MIN/MAX H=5.0 mm", "170", 5.0), ("N12, N13 PLAN", "12,13", None)]).replace("SELECT *", "SELECT header, numbers, CAST(height AS DOUBLE) AS height"))
def d_p27_n_number(spark, sf_dir):
    own = rows(spark, [("N170 BOLT 1 MIN/MAX H=5.0 mm",), ("N12, N13 PLAN",)], "header string")
    return own.select("header", F.array_join(names.dimensions(F.col("header")), ",").alias("numbers"), names.height(F.col("header")).alias("height"))


def folder(spark, files: dict[str, bytes], name: str) -> str:
    """A folder with these files, written by Hadoop's file system: below the cluster's shared folder, or a temporary one."""
    root = f"{folders.shared(spark)}/gauge-{name}-{hashlib.sha256(repr(sorted(files.items())).encode()).hexdigest()[:16]}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for path, content in files.items():
        at = hadoop.Path(f"{root}/{path}")
        if not system.exists(at):
            out = system.create(at)
            out.write(bytearray(content))
            out.close()
    return root


def below(column: str, name: str) -> F.Column:
    """A path below the fixtures' folder."""
    return F.regexp_extract(column, rf"gauge-{name}-[0-9a-f]+/(.*)$", 1).alias("file")


LINES = REPORT[1].encode("cp1252")
REPORTS = {"support intern.01/c13/3212_c13.csv": LINES, "support intern.08/14_3212.csv": "N1 Ø;\r\n1;Posición;;1.0;0.1;-0.1;1.2;0.2;0.1;--->>".encode("cp1252"), "support intern.01/3212_totes.csv": LINES, "support intern.02/3212_c17.csv": LINES, "none/3212_c16.csv": b"\n"}


def report_files(spark):
    return reports.files(spark, folder(spark, REPORTS, "reports"), "*.[cC][sS][vV]")


@query(_values(["file", "sample", "cavity", "reason"], [("support intern.01/c13/3212_c13.csv", "01", "c13", None), ("support intern.08/14_3212.csv", "08", "c14", None), ("none/3212_c16.csv", "??", "c16", None), ("support intern.01/3212_totes.csv", None, None, "all cavities"), ("support intern.02/3212_c17.csv", None, None, "no cavity")]))
def s2_reports(spark, sf_dir):
    found = report_files(spark)
    kept = reports.discover_reports(found).orderBy("sample", "cavity").select(below("path", "reports"), "sample", "cavity", F.lit(None).cast("string").alias("reason"))
    return kept.union(reports.skipped_reports(found).select(below("path", "reports"), F.lit(None), F.lit(None), "reason"))


READ = [("01", "c13", b[0], f"{b[1]}#{b[2]}||{b[3]}", b[7], b[9]) for b in BLOCKS] + [("08", "c14", 1, "N1 Ø#1||1", 1.2, True)]


@query("SELECT sample, cavity, pos, key, CAST(measured AS DOUBLE) AS measured, nok FROM (" + _values(["sample", "cavity", "pos", "key", "measured", "nok"], READ) + ")")
def s6_read_reports(spark, sf_dir):
    return reports.read_reports(spark, folder(spark, REPORTS, "reports")).select("sample", "cavity", "pos", "key", "measured", "nok")


@query(_values(["pos", "block"], [(b[0], b[1]) for b in BLOCKS]))
def w2_header_fill(spark, sf_dir):
    return reports.read_reports(spark, folder(spark, REPORTS, "reports")).where("cavity = 'c13'").select("pos", "block")


@query(_values(["pos", "idx"], [(b[0], b[3]) for b in BLOCKS]))
def w3_block_index(spark, sf_dir):
    return reports.read_reports(spark, folder(spark, REPORTS, "reports")).where("cavity = 'c13'").select("pos", "idx")


CLOUDS = {"intern.01/c13/PUNTS_NOUS.txt": b"+0000.0392 +0000.0203 +0027.7390\n\n -0001.5\t2 3", "intern.01/c13/perfil.txt": b"1 2 3\r\n4 5 6\r\n", "intern.5/Cav_15/punts.txt": b"7 8 9", "intern.05/notes.txt": b"1 2 3"}


@query(_values(["file", "sample", "cavity", "family", "rank"], [("intern.01/c13/PUNTS_NOUS.txt", "01", "c13", "nous", 2), ("intern.01/c13/perfil.txt", "01", "c13", "perfil", 0), ("intern.5/Cav_15/punts.txt", "05", "c15", "punts", 1)]))
def s3_clouds(spark, sf_dir):
    found = reports.discover_clouds(reports.files(spark, folder(spark, CLOUDS, "clouds"), "*.[tT][xX][tT]"))
    return found.select(below("path", "clouds"), "sample", "cavity", "family", "rank")


@query("SELECT cavity, family, pos, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM (" + _values(["cavity", "family", "pos", "x", "y", "z"], [("c13", "nous", 0, 0.0392, 0.0203, 27.739), ("c13", "nous", 2, -1.5, 2.0, 3.0), ("c13", "perfil", 0, 1, 2, 3), ("c13", "perfil", 1, 4, 5, 6), ("c15", "punts", 0, 7, 8, 9)]) + ")")
def s7_read_clouds(spark, sf_dir):
    return reports.read_clouds(spark, folder(spark, CLOUDS, "clouds")).select("cavity", "family", "pos", "x", "y", "z")


@query(_values(["file", "sample"], [("intern.5/Cav_15/punts.txt", "05")]))
def f7_chosen(spark, sf_dir):
    found = reports.discover_clouds(reports.files(spark, folder(spark, CLOUDS, "clouds"), "*.[tT][xX][tT]"))
    return reports.chosen(found, ["1", "5"], ["C15", "c16"], "punts").select(below("path", "clouds"), "sample")


CONTOURS = {"intern.03/C14/PA_3.pdf": b"x", "intern.03/C14/PB_12.pdf": b"x", "intern.03/C14/PC_1.pdf": b"x", "intern.03/C14/PA_3 copy.pdf": b"x"}


@query(_values(["file", "sample", "cavity", "element"], [("intern.03/C14/PA_3.pdf", "03", "c14", "PA_3"), ("intern.03/C14/PB_12.pdf", "03", "c14", "PB_12")]))
def s4_contours(spark, sf_dir):
    found = reports.discover_contours(reports.files(spark, folder(spark, CONTOURS, "contours"), "*.pdf"))
    return found.select(below("path", "contours"), "sample", "cavity", names.element(F.col("profile"), F.col("index")).alias("element"))


@query(_values(["name", "element"], [("PA_3", "PA_3"), ("PB_12", "PB_12")]))
def p15_element(spark, sf_dir):
    found = reports.discover_contours(reports.files(spark, folder(spark, CONTOURS, "contours"), "*.pdf"))
    return found.select(names.stem(F.col("path")).alias("name"), names.element(F.col("profile"), F.col("index")).alias("element"))


DRAWINGS = {"3212 Pump/1-2D y 3D Pieza/plan.pdf": b"12345", "3051/1-2D y 3D Pieza/plan b.pdf": b"1", "3051/other/plan.pdf": b"1"}


@query(_values(["project", "code", "length"], [("3212 Pump", "3212", 5), ("3051", "3051", 1)]))
def s5_drawings(spark, sf_dir):
    found = reports.files(spark, folder(spark, DRAWINGS, "drawings"), "*.pdf")
    return reports.discover_drawings(found).select("project", "code", "length")


MESHES = {"3212-315346-c13.stl": b"\0" * 80 + struct.pack("<I", 2) + b"\0" * 100, "09-12-2024_C1-3051.stl": b"\0" * 80 + struct.pack("<I", 70000) + b"\0" * 10}


@query(_values(["file", "triangles", "whole"], [("3212-315346-c13.stl", 2, True), ("09-12-2024_C1-3051.stl", 70000, False)]))
def d_s22_mesh(spark, sf_dir):
    found = reports.mesh_headers(reports.files(spark, folder(spark, MESHES, "meshes"), "*.stl"))
    return found.select(below("path", "meshes"), "triangles", "whole")


@query(_values(["file", "project", "lot", "cavity", "date"], [("3212-315346-c13.stl", "3212", "315346", "c13", None), ("09-12-2024_C1-3051.stl", "3051", None, "C1", "09-12-2024")]))
def d_p32_scan_name(spark, sf_dir):
    found = reports.files(spark, folder(spark, MESHES, "meshes"), "*.stl")
    return found.select(below("path", "meshes"), names.scan_name(F.col("path")).alias("s")).select("file", "s.*")


HISTORY = [("09", 6, "Date", "Responsable", "Remarks"), ("09", 7, "INFORME 1", None, None), ("09", 8, "12/03/2024", "DB", "FOT Batch 315252"), ("09", 9, None, None, "no date"), ("09", 12, "INFORME  8", None, None), ("09", 13, "02/04/2025", "MH", "ICL"), ("09", 14, "04/04/2025", "KK", "Update to 5 pcs"), ("09", 17, "INFORME 8", None, None), ("09", 18, "05/04/2025", "NV", None)]


@query(_values(["row", "block", "report", "date", "responsible", "remarks"], [(8, 1, 1, "12/03/2024", "DB", "FOT Batch 315252"), (13, 2, 8, "02/04/2025", "MH", "ICL"), (14, 2, 8, "04/04/2025", "KK", "Update to 5 pcs"), (18, 3, 8, "05/04/2025", "NV", None)]))
def d_w9_history(spark, sf_dir):
    return reports.history(rows(spark, HISTORY, "file string, row int, a string, e string, f string")).drop("file")


CELLS = [("DR(3D)", 13, "A", "Nr"), ("DR(3D)", 14, "A", "N178"), ("DR(3D)", 14, "D", "4"), ("DR(3D)", 14, "F", "-0,10"), ("DR(3D)", 14, "H", "3,95"), ("DR(3D)", 15, "B", "max"), ("DR(3D)", 15, "H", "4,2"), ("DR(3D)", 15, "L", "X"), ("DR(3D)", 16, "A", "242"), ("DR(3D)", 16, "K", "n/a"), ("COVER", 14, "A", "N1")]


@query("SELECT row, nr, CAST(nominal AS DOUBLE) AS nominal, CAST(tol_inf AS DOUBLE) AS tol_inf, CAST(c13 AS DOUBLE) AS c13, nok FROM (" + _values(["row", "nr", "nominal", "tol_inf", "c13", "nok"], [(14, "N178", 4.0, -0.1, 3.95, False), (15, "N178", None, None, 4.2, True), (16, "242", None, None, None, False)]) + ")")
def d_s20_cells(spark, sf_dir):
    cells = rows(spark, [("a", *c) for c in CELLS], "file string, sheet string, row int, col string, text string")
    return reports.dimension_rows(cells).select("row", "nr", "nominal", "tol_inf", "c13", "nok")


SLIDES = [(1, 0, "P3212 Tool correction nº1 14/03/2024"), (1, 1, "DIM. Nr.170 and DIM. Nr 117"), (1, 2, "Reduir el ferro 0,05 mm"), (1, 3, "OK"), (2, 0, "DIM. Nr.XX"), (2, 1, "Polir")]


@query("SELECT slide, correction, project, date, numbers, CAST(magnitude_mm AS DOUBLE) AS magnitude_mm, sign, done FROM (" + _values(["slide", "correction", "project", "date", "numbers", "magnitude_mm", "sign", "done"], [(1, 1, "3212", "14/03/2024", "170,117", 0.05, "+", True), (2, None, None, None, "", None, "0", False)]) + ")")
def d_s21_slides(spark, sf_dir):
    found = reports.corrections(rows(spark, [("a", *s) for s in SLIDES], "file string, slide int, pos int, text string"))
    return found.select("slide", "correction", "project", "date", F.array_join("n_numbers", ",").alias("numbers"), "magnitude_mm", "sign", "done")


@query(_values(["header", "role"], [("N170 BOLT MIN/MAX H=5.0", "min/max"), ("N178 PLAN. 0.10 MAX.", "max"), ("GN MIN.", "min"), ("N1 MINIMUM", None)]))
def d_p28_role(spark, sf_dir):
    own = rows(spark, [("N170 BOLT MIN/MAX H=5.0",), ("N178 PLAN. 0.10 MAX.",), ("GN MIN.",), ("N1 MINIMUM",)], "header string")
    return own.select("header", names.role(F.col("header")).alias("role"))


@query(_values(["id", "code", "rest"], [(1, "3212", "Pump Housing"), (2, "3212", "Pump Housing"), (3, "3212", "lote 315346"), (4, "Valve", ""), (5, None, ""), (6, "", "")]))
def p22_split_ref(spark, sf_dir):
    code, rest = names.split_reference(F.col("part_ref"))
    return rows(spark, OLD, "id int, name string, kind string, part_ref string").select("id", code.alias("code"), rest.alias("rest"))


@query(_values(["id", "kind"], [(1, "scan"), (2, "part"), (3, "drawing"), (4, "moldflow"), (5, "part"), (6, "scan")]))
def p23_reclassify(spark, sf_dir):
    return rows(spark, OLD, "id int, name string, kind string, part_ref string").select("id", names.reclassified(F.col("kind"), F.col("name")).alias("kind"))


RESTS = [("lid", "Lote 9", "Pump"), ("lid lote 9", "Lote 9", "Pump"), ("lid", "Pump", "Pump"), ("x" * 250, "rest that is cut", None), ("lid", "", "Pump")]


@query(_values(["name", "rest", "told"], [("lid", "Lote 9", "lid - Lote 9"), ("lid lote 9", "Lote 9", "lid lote 9"), ("lid", "Pump", "lid"), ("x" * 250, "rest that is cut", "x" * 250 + " - re"), ("lid", "", "lid")]))
def p24_append_rest(spark, sf_dir):
    own = rows(spark, RESTS, "name string, rest string, chosen string")
    return own.select("name", "rest", names.with_rest(F.col("name"), F.col("rest"), F.col("chosen")).alias("told"))


@query(_values(["file", "lines"], [("a", 6)]))
def w5_contour_lines(spark, sf_dir):
    own = rows(spark, [("a", x, y, w) for w, x, y in CONTOUR_WORDS], "file string, x0 double, y0 double, word string")
    return reports.anchor_rows(own).groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
