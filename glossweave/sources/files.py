"""Files as tables: spreadsheets, word-processor documents, web pages, plain text.

Container files are read whole by ``binaryFile`` and taken apart on the executors,
so the files of a folder spread over the cluster; everything after that is
DataFrame work.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SHEET_ROWS = "file string, sheet string, row int, cells array<string>"
LINES = "file string, line int, text string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _number(raw: str) -> str:
    """A cell's number as text; whole numbers without a fraction."""
    try:
        x = float(raw)
    except ValueError:
        return raw
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else raw


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row, cells) of a workbook, sheet by sheet; rows that the file leaves out come as empty ones."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_MAIN}t")))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = rels[sheet.get(f"{_REL}id")].lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            last = -1
            with z.open(path) as f:
                for _, element in ElementTree.iterparse(f):
                    if element.tag != f"{_MAIN}row":
                        continue
                    number = int(element.get("r", last + 2)) - 1
                    cells: list[str | None] = []
                    for c in element.iter(f"{_MAIN}c"):
                        i = _column(c.get("r", "")) if c.get("r") else len(cells)
                        cells += [None] * (i + 1 - len(cells))
                        kind, value = c.get("t", "n"), c.find(f"{_MAIN}v")
                        if kind == "inlineStr":
                            cells[i] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                        elif value is not None and value.text is not None:
                            cells[i] = shared[int(value.text)] if kind == "s" else _number(value.text) if kind == "n" else value.text
                    for empty in range(last + 1, number):
                        yield sheet.get("name"), empty, []
                    yield sheet.get("name"), number, cells
                    last = number
                    element.clear()


def document_paragraphs(content: bytes) -> list[str]:
    """Filled paragraphs of a word-processor document, white space collapsed."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    texts = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))
    return [x for x in (html.unescape(" ".join(t.split())) for t in texts) if x]


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "content")


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, cells) of all workbooks at a path."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part["file"], part["content"]):
                rows = [(file, *r) for r in workbook_rows(content)]
                yield pd.DataFrame(rows, columns=["file", "sheet", "row", "cells"])

    return _files(spark, path, "*.xlsx").mapInPandas(run, SHEET_ROWS)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): the filled paragraphs of all documents at a path."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part["file"], part["content"]):
                yield pd.DataFrame([(file, i, t) for i, t in enumerate(document_paragraphs(content))], columns=["file", "line", "text"])

    return _files(spark, path, "*.docx").mapInPandas(run, LINES)


def html_lines(pages: DataFrame, file: str, content: str) -> DataFrame:
    """(file, line, text): filled lines of pages; blocks and breaks end a line, other markup is a space."""

    @F.pandas_udf("string")
    def unescape(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    c: Column = F.col(content)
    for pattern, to in (
        (r"(?is)<script[^>]*>.*?</script>", " "), (r"(?is)<style[^>]*>.*?</style>", " "), (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</(?:p|div|li|tr|td|th|h[1-6]|section|article)>", "\n"), (r"(?s)<[^>]+>", " "),
    ):
        c = F.regexp_replace(c, pattern, to)
    broken = F.split(unescape(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)
    lines = F.filter(F.transform(broken, T.collapse), lambda x: x != "")
    return pages.select(F.col(file).cast("string").alias("file"), F.posexplode(lines).alias("line", "text"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    pages = _files(spark, path, "*.htm*").select("file", F.decode("content", "UTF-8").alias("html"))
    return html_lines(pages, "file", "html")


def read_xls(spark: SparkSession, path: str) -> DataFrame:
    """The old spreadsheet format needs the xlrd package on the executors; without it the files have to be converted first."""
    import importlib.util

    if importlib.util.find_spec("xlrd") is None:
        raise RuntimeError("reading .xls needs the xlrd package; convert the files to .xlsx")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xlrd

        for part in parts:
            for file, content in zip(part["file"], part["content"]):
                sheet = xlrd.open_workbook(file_contents=content).sheet_by_index(0)
                rows = [(file, sheet.name, i, [_number(str(v)) if isinstance(v, float) else str(v) for v in sheet.row_values(i)]) for i in range(sheet.nrows)]
                yield pd.DataFrame(rows, columns=["file", "sheet", "row", "cells"])

    return _files(spark, path, "*.xls").mapInPandas(run, SHEET_ROWS)


def first_sheet(rows: DataFrame) -> DataFrame:
    """The rows of each file's first sheet, as importers take them."""
    first = rows.groupBy(F.col("file").alias("f")).agg(F.min_by("sheet", F.struct("row", "sheet")).alias("s"))
    return rows.join(first, (F.col("file") == F.col("f")) & (F.col("sheet") == F.col("s"))).select("file", "row", "cells")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Sectioned lists in whatever format the suffix names."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "docx":
        return read_docx(spark, path)
    if suffix in ("html", "htm"):
        return read_html(spark, path)
    if suffix in ("xlsx", "xls"):
        from ..operators.registry import row_text

        rows = first_sheet(read_xlsx(spark, path) if suffix == "xlsx" else read_xls(spark, path))
        return rows.select("file", F.col("row").alias("line"), row_text(F.col("cells")).alias("text"))
    raise ValueError(f"no reader for .{suffix} lists")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def newest(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """Of (path, modificationTime, length) the one file to use: by preferred suffix, then newest, then largest."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    place = F.array_position(T.lits(suffixes), suffix)
    ranked = files.withColumn("rank", -place).where(place > 0)
    return ranked.agg(F.max_by(F.struct("path", "modificationTime", "length"), F.struct("rank", "modificationTime", "length")).alias("f")).where("f IS NOT NULL").select("f.*")
