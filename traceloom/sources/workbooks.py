"""Workbooks of traces: every sheet's columns as samples.

Files are listed and read by Spark (``binaryFile``); a task parses one workbook into cells, and everything after that, the time
column, the units, the pairing of raw and corrected columns, is expressed over the cells.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.scalars import canonical_name

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

# Names of time columns, best first, and of columns that only number the frames (letters and digits only).
TIME_NAMES = ("time", "time_s", "time_ms", "time (s)", "time (ms)", "t", "timestamp")
FRAME_NAMES = ("frame", "frames", "framenumber", "frameindex", "frameid", "framecorrected", "framenumbercorrected")


def _column_number(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference).group():
        n = 26 * n + ord(c) - 64
    return n


def cells_of(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """``(sheet, row, column, text)`` of the filled cells of a workbook, rows and columns from 1."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_LINK)].lstrip("/")
            for cell in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}c"):
                kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                elif value is None or value.text is None:
                    continue
                else:
                    text = shared[int(value.text)] if kind == "s" else value.text
                reference = cell.get("r")
                yield sheet.get("name"), int(re.search(r"\d+", reference).group()), _column_number(reference), text


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sheet, row, column, text)`` of all workbooks under a path; unreadable files give no cells."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows = [(p, *c) for c in cells_of(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows = []
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "column", "text"])

    return files.mapInPandas(run, "path string, sheet string, row bigint, column bigint, text string")


def time_rank(name: Column) -> Column:
    """How well a column's name fits a time column: smaller is better."""
    plain = F.lower(F.trim(name))
    listed = F.array_position(F.array(*map(F.lit, TIME_NAMES)), plain)
    return F.when(listed > 0, listed).when(plain.contains("time") | plain.startswith("t(") | plain.startswith("t_"), 50).otherwise(100)


def workbook_samples(cells: DataFrame) -> DataFrame:
    """``(path, trace_id, idx, t, raw, corrected_source, time_header)``: one trace per sheet and column.

    The time column is the best by name, the first of equals; rows without a finite time are dropped, sheets with fewer than
    two times or without any positive step are skipped, frame numbers are no traces, and ``X_corrected`` goes with ``X``, each
    standing in for the other where only one is there.
    """
    keys = ["path", "sheet"]
    heads = cells.where("row = 1").select(*keys, "column", F.col("text").alias("name"))
    best = heads.groupBy(*keys).agg(F.min_by(F.struct("column", "name"), F.struct(time_rank(F.col("name")), "column")).alias("t"))
    numbers = cells.where("row > 1").select(*keys, "row", "column", F.col("text").try_cast("double").alias("v"))
    times = numbers.join(best, keys).where("column = t.column and v is not null and not isnan(v) and abs(v) < double('infinity')").select(*keys, "row", F.col("v").alias("t"), F.col("t.name").alias("time_header"))
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("row")
    times = times.withColumn("idx", (F.row_number().over(order) - 1).cast("bigint")).withColumn("step", F.col("t") - F.lag("t").over(order))
    usable = times.groupBy(*keys).agg(F.count("*").alias("n"), F.max("step").alias("up")).where("n >= 2 and up > 0").select(*keys)
    times = times.join(usable, keys).drop("step")
    corrected = F.lower(F.trim("name")).rlike(r"[ _-]corrected$")
    base = F.regexp_replace(F.trim("name"), r"(?i)[ _-]corrected$", "")
    traces = heads.join(best, keys).where(F.col("column") != F.col("t.column")).where(~canonical_name(F.col("name")).isin(*FRAME_NAMES)).select(*keys, "column", base.alias("roi"), corrected.alias("is_corrected"))
    values = numbers.join(traces, [*keys, "column"]).groupBy(*keys, "row", "roi").agg(F.max(F.when(~F.col("is_corrected"), F.col("v"))).alias("raw"), F.max(F.when(F.col("is_corrected"), F.col("v"))).alias("c"))
    return times.join(values, [*keys, "row"]).select(
        "path", F.concat_ws(" | ", "sheet", "roi").alias("trace_id"), "idx", "t", F.coalesce("raw", "c").alias("raw"), F.coalesce("c", "raw").alias("corrected_source"), "time_header"
    )


def write_workbook(path: str, sheets: dict[str, list[list]]) -> None:
    """A small workbook of the given rows per sheet; for reports, whose size is bounded, not for bulk data."""
    escape = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

    def letters(n: int) -> str:
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out

    def cell(r: int, c: int, v) -> str:
        at = f'r="{letters(c)}{r}"'
        if v is None:
            return ""
        return f"<c {at}><v>{v!r}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c {at} t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    head = '<?xml version="1.0" encoding="UTF-8"?>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n)[:31]}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row, 1))}</row>' for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
