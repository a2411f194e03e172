"""S3: ``.xlsx`` workbooks (first sheet, first non-blank row is the header).

Workbooks are read with Spark's ``binaryFile`` source and parsed inside the
tasks (one workbook never spans tasks; many workbooks spread over the
cluster). A task holds a workbook's compressed bytes and its shared strings in
one buffer; rows are streamed and leave in batches of bounded size. The parser is a small reader of the sheet XML from
the standard library: cell values become strings (numbers keep their stored
text, booleans become ``True``/``False``), fully blank rows are skipped, and
the missing-value tokens are mapped as for CSV. Dates stay as Excel serial
numbers. Legacy ``.xls`` files are not supported.
"""

from __future__ import annotations

import io
import re
import zipfile
from array import array
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from convolytics.schema import SchemaError, check_unique_names
from convolytics.session import workers_see_library
from convolytics.sources.csv import normalize_null_tokens

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PKG_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_CELL_REF = re.compile(r"([A-Z]+)(\d+)")
# characters that XML cannot hold, or would change, are written by their code
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_TO_ESCAPE = re.compile("[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")
BATCH_ROWS = 4096


def _column_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _text(el) -> str:
    # text of a shared/inline string: plain <t> and rich-text runs, without
    # phonetic hints
    if el is None:
        return ""
    parts = []
    for child in el:
        if child.tag == MAIN + "t":
            parts.append(child.text or "")
        elif child.tag == MAIN + "r":
            t = child.find(MAIN + "t")
            parts.append((t.text or "") if t is not None else "")
    return _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), "".join(parts))


def _first_sheet_path(zf: zipfile.ZipFile) -> str:
    wb = ET.fromstring(zf.read("xl/workbook.xml"))
    sheet = wb.find(f"{MAIN}sheets/{MAIN}sheet")
    if sheet is None:
        raise SchemaError("The workbook has no sheet")
    rid = sheet.get(REL + "id")
    rels = ET.fromstring(zf.read("xl/_rels/workbook.xml.rels"))
    for rel in rels.iter(PKG_REL + "Relationship"):
        if rel.get("Id") == rid:
            target = rel.get("Target")
            return target.lstrip("/") if target.startswith("/") else "xl/" + target
    raise SchemaError("The workbook's first sheet cannot be found")


class _Strings:
    """A workbook's shared strings: their text in one buffer, by place. Holds
    the bytes of the strings and eight more for each, whatever their number."""

    def __init__(self, zf: zipfile.ZipFile):
        self.buffer, self.ends = bytearray(), array("q", [0])
        if "xl/sharedStrings.xml" in zf.namelist():
            with zf.open("xl/sharedStrings.xml") as f:
                for si in _elements(f, "si"):
                    self.buffer += _text(si).encode("utf-8", "surrogatepass")
                    self.ends.append(len(self.buffer))

    def __getitem__(self, i: int) -> str:
        return self.buffer[self.ends[i] : self.ends[i + 1]].decode("utf-8", "surrogatepass")


def _elements(f, name: str) -> Iterator[ET.Element]:
    """The elements of a name, one at a time; those before are freed."""
    depth: list[ET.Element] = []
    for event, el in ET.iterparse(f, events=("start", "end")):
        if event == "start":
            depth.append(el)
            continue
        depth.pop()
        if el.tag == MAIN + name:
            yield el
            if depth:
                depth[-1].clear()


def workbook_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as lists of strings (None for empty cells),
    blank rows skipped. The sheet is inflated and read as a stream."""
    with zipfile.ZipFile(io.BytesIO(content)) as zf:
        shared = _Strings(zf)
        with zf.open(_first_sheet_path(zf)) as sheet:
            for el in _elements(sheet, "row"):
                cells: dict[int, str] = {}
                for pos, c in enumerate(el.iter(MAIN + "c")):
                    ref = c.get("r")
                    idx = _column_index(_CELL_REF.match(ref).group(1)) if ref else pos
                    kind = c.get("t", "n")
                    v = c.find(MAIN + "v")
                    raw = v.text if v is not None else None
                    if kind == "s" and raw is not None:
                        val = shared[int(raw)]
                    elif kind == "inlineStr":
                        val = _text(c.find(MAIN + "is"))
                    elif kind == "b" and raw is not None:
                        val = "True" if raw.strip() == "1" else "False"
                    else:
                        val = raw
                    if val is not None and val != "":
                        cells[idx] = val
                if cells:
                    width = max(cells) + 1
                    yield [cells.get(i) for i in range(width)]


def _header_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            first = next(workbook_rows(content), None)
            yield pd.DataFrame({"path": [path], "names": [first]})


def read_xlsx_header(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    files = _binary(spark, path).limit(1)
    out = files.mapInPandas(
        _header_of, StructType([StructField("path", StringType()), StructField("names", ArrayType(StringType()))])
    ).collect()
    if not out or not out[0].names:
        raise SchemaError("The workbook is empty: no header row")
    names = list(out[0].names)
    if any(n is None for n in names):
        raise SchemaError("The header row has an empty cell")
    check_unique_names(names)
    return names


def _binary(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(paths).select("path", "content")


def read_xlsx(spark: SparkSession, path: str | Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Workbook(s) to a table of nullable strings. Every workbook must have
    the same header (names, order); rows longer than the header fail."""
    names = list(names) if names is not None else read_xlsx_header(spark, path)
    return parse_workbooks(_binary(spark, path), names)


def parse_workbooks(books: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows of workbooks given as ``path, content``."""
    workers_see_library(books.sparkSession)
    names = list(names)
    width = len(names)

    def batch(rows: list[list[str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=[f"c{i}" for i in range(width)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for wb_path, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = workbook_rows(content.as_py())
                header = next(rows, None)
                if header != names:
                    raise ValueError(f"{wb_path}: header {header} differs from {names}")
                body = []
                for r in rows:
                    if len(r) > width:
                        raise ValueError(f"{wb_path}: a row has more than {width} cells")
                    body.append(r + [None] * (width - len(r)))
                    if len(body) == BATCH_ROWS:
                        yield batch(body)
                        body = []
                if body:
                    yield batch(body)

    schema = StructType([StructField(f"c{i}", StringType(), True) for i in range(width)])
    parsed = books.select("path", "content").mapInArrow(parse, schema)
    return normalize_null_tokens(parsed.toDF(*names), names)


_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_RNS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_PARTS = {
    "[Content_Types].xml": (
        '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
        "</Types>"
    ),
    "_rels/.rels": (
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
        'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    ),
    "xl/workbook.xml": f'<workbook {_NS} {_RNS}><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": (
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
        'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
    ),
}


class WorkbookWriter:
    """One workbook with one sheet, written as a stream; only its compressed
    bytes are held."""

    def __init__(self, header: Sequence[str]):
        self.out = io.BytesIO()
        self.zf = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        for name, body in _PARTS.items():
            self.zf.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + body)
        self.sheet = self.zf.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet {_NS}><sheetData>'.encode())
        self.rows = 0
        self.add(header)

    def add(self, values: Sequence[str | None]) -> None:
        self.rows += 1
        cells = "".join(
            f'<c r="{_column_letters(i)}{self.rows}" t="inlineStr"><is><t xml:space="preserve">{_escaped(v)}</t></is></c>'
            for i, v in enumerate(values)
            if v is not None and v != ""
        )
        self.sheet.write(f'<row r="{self.rows}">{cells}</row>'.encode("utf-8", "surrogatepass"))

    def close(self) -> bytes:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.zf.close()
        return self.out.getvalue()


def _escaped(text: str) -> str:
    return escape(_TO_ESCAPE.sub(lambda m: f"_x{ord(m.group()):04X}_", text))


def _column_letters(index: int) -> str:
    out, n = "", index + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def make_workbooks(df: DataFrame, book_rows: int = 100_000) -> DataFrame:
    """``path, content``: the rows as ``.xlsx`` workbooks of at most
    ``book_rows`` rows, made in the tasks that hold them; values as text."""
    workers_see_library(df.sparkSession)
    names = df.columns
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(names)])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, book = TaskContext.get().partitionId(), 0, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{made:05d}.xlsx"]), pa.array([book.close()], pa.binary())], names=["path", "content"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                book = book or WorkbookWriter(names)
                book.add(row)
                if book.rows > book_rows:
                    yield done()
                    made, book = made + 1, None
        if book:
            yield done()

    return texts.mapInArrow(make, "path string, content binary")
