"""The workbook of manual tables: five sheets, read as tables and written anew."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import SHEETS, Manual
from .files import read_xlsx
from .snapshots import exists, write_bytes

_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _sheet(rows: list[list[str]]) -> str:
    def cell(value: str) -> str:
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    body = "".join(f"<row>{''.join(map(cell, row))}</row>" for row in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>'


def workbook(sheets: dict[str, list[list[str]]]) -> bytes:
    """A workbook of text cells."""
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
    names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{names}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>',
    } | {f"xl/worksheets/sheet{i}.xml": _sheet(rows) for i, rows in enumerate(sheets.values(), 1)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def write_manual(manual: Manual, path: str) -> None:
    """All manual tables in one workbook, overwritten; the change log starts anew.  Hand-edited tables, so the driver writes them."""
    sheets: dict[str, list[list[str]]] = {}
    for name, columns in SHEETS.items():
        rows: list[list[str]] = []
        if name != "change_log":
            df = getattr(manual, name)
            df = df.orderBy("ord") if "ord" in df.columns else df
            rows = [[r[c] or "" for c in columns] for r in df.select(*columns).toLocalIterator()]
        sheets[name] = [columns, *rows]
    write_bytes(manual.cards.sparkSession, path, workbook(sheets))


def read_manual(spark: SparkSession, path: str) -> Manual:
    """The manual tables of a workbook, which is made with headers only if it isn't there; rows without a value go."""
    if not exists(spark, path):
        write_bytes(spark, path, workbook({n: [c] for n, c in SHEETS.items()}))
    rows = read_xlsx(spark, path).where("row > 0")

    def table(name: str) -> DataFrame:
        columns = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(SHEETS[name])]
        filled = rows.where((F.col("sheet") == name) & F.exists("cells", lambda c: c.isNotNull() & (c != "")))
        return filled.select(*columns, *([] if name == "cards" else [F.col("row").cast("long").alias("ord")]))

    return Manual(*(table(n) for n in list(SHEETS)[:4]))
