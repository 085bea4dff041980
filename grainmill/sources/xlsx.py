"""Excel workbooks: read on executors, a task for each file, and made of tables.

A workbook is a zip of XML parts.  Spark's binary file reader brings the files from any
store it knows; tasks walk through the first sheet row by row, so beside a file and its
shared texts a task holds no more than a batch of rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 5000
#: Fixed names of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
TEXT, INLINE, VALUE = (f"{MAIN}{tag}" for tag in ("t", "is", "v"))
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows a sheet may have.
MOST_ROWS = 1_048_576
#: Signs that XML cannot hold, and what could be taken for an escape.
UNWRITABLE = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


def _text(node: ElementTree.Element) -> str:
    """Texts of all runs; phonetic hints are none."""
    if len(node) == 1 and node[0].tag == TEXT:
        plain = node[0].text or ""
    else:
        plain = "".join(t.text or "" for run in [node, *node.findall(f"{MAIN}r")] for t in run.findall(TEXT))
    return _plain(plain)


def _plain(raw: str) -> str:
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), raw) if "_x" in raw else raw


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets/{MAIN}sheet")
    if sheet is None:
        raise ValueError("the workbook has no sheet")
    for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if link.get("Id") == sheet.get(LINK):
            target = link.get("Target")
            return target[1:] if target.startswith("/") else f"xl/{target}"
    raise ValueError("the workbook's first sheet is missing")


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag == f"{MAIN}si":
                out.append(_text(node))
                node.clear()
    return out


def _ended(f, tag: str, parent: str) -> Iterator[ElementTree.Element]:
    """Elements of a tag as they end, each forgotten by its parent when the next is asked for."""
    steps = ElementTree.iterparse(f, ("start", "end"))
    inside = next((node for event, node in steps if event == "start" and node.tag == parent), None)
    for event, node in steps:
        if event == "end" and node.tag == tag:
            yield node
            inside.clear()


def _place(name: str) -> int:
    """The column of a cell's name, A being 0."""
    at = 0
    for ch in name:
        if not "A" <= ch <= "Z":
            break
        at = at * 26 + ord(ch) - 64
    return at - 1


def _number(raw: str) -> str:
    """A number as its shortest text; whole ones without a point."""
    value = float(raw)
    return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)


def _cell(node: ElementTree.Element, shared: list[str]) -> str | None:
    kind = node.get("t", "n")
    if kind == "inlineStr":
        inner = node.find(INLINE)
        return (_text(inner) if inner is not None else "") or None
    raw = node.findtext(VALUE)
    if not raw:
        return None
    if kind == "s":
        return shared[int(raw)] or None
    if kind == "b":
        return "true" if raw == "1" else "false"
    return _number(raw) if kind == "n" else _plain(raw)


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet of a workbook with a value in some cell; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared(book)
        with book.open(_first_sheet(book)) as f:
            for node in _ended(f, f"{MAIN}row", f"{MAIN}sheetData"):
                row: list[str | None] = []
                for cell in node:
                    name = cell.get("r")
                    at = _place(name) if name else len(row)
                    row += [None] * (at + 1 - len(row))
                    row[at] = _cell(cell, shared)
                if any(v is not None for v in row):
                    yield row


def header(row: list[str | None]) -> list[str]:
    """Names of columns: an empty one is ``column_`` and its number, a repeated one gets a number."""
    out: list[str] = []
    seen: set[str] = set()
    for i, v in enumerate(row):
        stem = name = v or f"column_{i + 1}"
        n = 1
        while name.lower() in seen:
            name = f"{stem}_{n}"
            n += 1
        seen.add(name.lower())
        out.append(name)
    return out


def sheets(workbooks: DataFrame) -> DataFrame:
    """Rows of the first sheets of ``workbooks(path, content)``, all values texts, empty ones null.

    The first row of each sheet names its columns; a column that one workbook has and
    another has not is null there.  Columns come in the order of the workbook whose path
    is smallest, then the others' by name.  Rows of a workbook keep their order.  A
    table of workbooks without any row below a header is an error.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = sheet_rows(content.as_py())
                first, more = next(rows, None), next(rows, None)
                names = header(first) if first and more else []
                n = len(names)
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(names, pa.string())], names=["path", "at", "name"])

    files = workbooks.select("path", "content")
    # a row for each different name, with the first place it has in any workbook
    found = files.mapInArrow(heads, "path string, at int, name string").groupBy("name").agg(F.min(F.struct("path", "at")).alias("first")).collect()
    if not found:
        raise ValueError("the sheet is empty")
    least = min(r["first"]["path"] for r in found)
    names = [r["name"] for r in sorted(found, key=lambda r: (r["first"]["path"] != least, r["first"]["at"] if r["first"]["path"] == least else 0, r["name"]))]
    place = {name: i for i, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[list[str | None]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows = sheet_rows(content.as_py())
                to = [place.get(n) for n in header(next(rows, []))]
                held: list[list[str | None]] = []
                for row in rows:
                    wide: list[str | None] = [None] * len(names)
                    for at, v in zip(to, row):  # noqa: B905  (cells beyond the header have no name)
                        if at is not None:
                            wide[at] = v
                    held.append(wide)
                    if len(held) == BATCH_ROWS:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    quoted = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return files.select("content").mapInArrow(run, quoted)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, or of all workbooks of a folder; see :func:`sheets`."""
    return sheets(spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path))


def _letters(at: int) -> str:
    out = ""
    while at >= 0:
        out, at = chr(65 + at % 26) + out, at // 26 - 1
    return out


#: Fixed parts of a workbook with one sheet.
PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def workbook(names: list[str], rows: Iterator[list[str | None]]) -> bytes:
    """A workbook of one sheet with a header and texts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, part in PARTS.items():
            book.writestr(name, part)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
            for i, row in enumerate([names, *rows], 1):
                cells = (f'<c r="{_letters(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(UNWRITABLE.sub(lambda m: f"_x{ord(m[0]):04X}_", v))}</t></is></c>' for j, v in enumerate(row) if v is not None)
                sheet.write(f'<row r="{i}">{"".join(cells)}</row>'.encode("utf-8", "replace"))
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()


def workbooks(df: DataFrame, rows_a_book: int = 100_000) -> DataFrame:
    """(path, content): ``df`` as workbooks of texts, made by the tasks that hold the rows.

    Names are ``sheet-<partition>-<number>.xlsx`` and, in order, keep the rows' order.
    """
    if not 0 < rows_a_book < MOST_ROWS:
        raise ValueError(f"a sheet holds less than {MOST_ROWS} rows")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[str | None]] = []
        part = number = 0

        def made(rows: list[list[str | None]]) -> pa.RecordBatch:
            name = f"sheet-{part:05d}-{number:05d}.xlsx"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([workbook(names, rows)], pa.binary())], names=["path", "content"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            part = columns[-1][0] if columns[-1] else part
            for row in zip(*columns[:-1], strict=True):
                held.append(list(row))
                if len(held) == rows_a_book:
                    yield made(held)
                    held, number = [], number + 1
        if held:
            yield made(held)

    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(names)], F.spark_partition_id().alias("_part"))
    return texts.mapInArrow(run, "path string, content binary")
