"""Spreadsheets (.xlsx) as cells, read on the executors; a workbook is a zip of XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import scalar

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REFERENCE = re.compile(r"([A-Z]+)(\d+)")


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def cells_of(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """sheet, row, column (both from 0) and text of every cell with something in it, sheets in the workbook's order."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            part = targets[sheet.get(f"{_REL}id")].lstrip("/")
            part = part if part.startswith("xl/") else f"xl/{part}"
            with book.open(part) as stream:
                for _, cell in ElementTree.iterparse(stream):
                    if cell.tag == f"{_MAIN}row":
                        cell.clear()
                    if cell.tag != f"{_MAIN}c":
                        continue
                    at = _REFERENCE.fullmatch(cell.get("r") or "")
                    value = cell.find(f"{_MAIN}v")
                    if cell.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif value is None or value.text is None:
                        continue
                    else:
                        text = shared[int(value.text)] if cell.get("t") == "s" else value.text
                    if at and text != "":
                        yield sheet.get("name"), int(at[2]) - 1, _column(at[1]), text


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, row, column, text of every filled cell of every workbook under path; one that can't be opened raises.

    Each workbook is read by one task; workbooks are small by nature (2 GB is the
    limit of a file).
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = [(name.rsplit("/", 1)[-1], *c) for c in cells_of(bytes(content))]
                yield pd.DataFrame(rows, columns=["file", "sheet", "row", "column", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(read, "file string, sheet string, row int, column int, text string")


def serial_date(text: Column) -> Column:
    """Date of a spreadsheet's day number, or of an ISO date; else null."""
    number = text.try_cast("double")
    return F.coalesce(
        F.when(number.between(1, 2_958_465), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number).cast("int"))),
        F.to_date(F.try_to_timestamp(text)),
    )


def sheet_rows(cells: DataFrame, columns: Mapping[str, int], skip: int) -> DataFrame:
    """file, sheet, row and the named columns as text, one row for each row of a sheet from skip on."""
    wanted = cells.where((F.col("row") >= skip) & F.col("column").isin(list(columns.values())))
    return wanted.groupBy("file", "sheet", "row").agg(*[F.max(F.when(F.col("column") == c, F.col("text"))).alias(n) for n, c in columns.items()])


def vintage_sheets(cells: DataFrame, layouts: Mapping[int, Mapping[str, int]], skip: int, date_column: int = 0) -> DataFrame:
    """vintage, obs_day, id, value from workbooks whose sheets named like 2020Q1 are whole vintages.

    The width of a sheet picks its layout of figures by column; a vintage of a width
    without layout raises. Sheets of other names are left out, rows without a date
    too; of a repeated date the last row counts. A vintage ends with its quarter:
    later rows are cut. Unreadable figures are null.
    """
    sheets = cells.where(F.col("sheet").rlike(r"^\d{4}Q[1-4]$"))
    width = sheets.groupBy("file", "sheet").agg((F.max("column") + 1).alias("width"))
    known = F.col("width").isin(list(layouts))
    checked = F.when(known, F.col("width")).otherwise(F.raise_error(F.concat(F.lit("no layout for "), F.col("sheet"), F.lit(" of width "), F.col("width"))).cast("int"))
    placed = sheets.join(width, ["file", "sheet"]).withColumn("width", checked).where(F.col("row") >= skip)
    names = F.lit(None).cast("string")
    for w, layout in layouts.items():
        for name, c in layout.items():
            names = F.when((F.col("width") == w) & (F.col("column") == c), name).otherwise(names)
    dates = placed.where(F.col("column") == date_column).select("file", "sheet", "row", serial_date(F.col("text")).alias("obs_day")).where("obs_day is not null")
    last = dates.groupBy("file", "sheet", "obs_day").agg(F.max("row").alias("row"))
    figures = placed.select("file", "sheet", "row", names.alias("id"), F.col("text").try_cast("double").alias("value")).where("id is not null")
    return last.join(figures, ["file", "sheet", "row"]).where(F.col("obs_day") <= scalar.vintage_end(F.col("sheet"))).select(
        F.col("sheet").alias("vintage"), "obs_day", "id", "value"
    )


def net_positions(cells: DataFrame, long_columns: list[int], short_columns: list[int], header: int = 3) -> DataFrame:
    """obs_date and net of a positions sheet with its header in row header and data from the next row on: longs less shorts, absent cells 0."""
    columns = {f"c{c}": c for c in [0, *long_columns, *short_columns]}
    rows = sheet_rows(cells, columns, header + 1)
    number = lambda c: F.coalesce(F.col(f"c{c}").try_cast("double"), F.lit(0.0))
    net = sum((number(c) for c in long_columns), F.lit(0.0)) - sum((number(c) for c in short_columns), F.lit(0.0))
    return rows.select(serial_date(F.col("c0")).alias("obs_date"), net.alias("net"), "row").where("obs_date is not null").groupBy("obs_date").agg(
        F.max_by("net", "row").alias("net")
    )
