"""Spreadsheets (zip members of XML): cells as rows, shared strings as a join, columns with types.

A workbook is read by Spark as one binary file and parsed as a stream of cells, so a task holds the packed file and one
batch of cells; a sheet has 1,048,576 rows at most by its format.  Document type declarations are refused, so no
entities are expanded.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import staged
from .tables import write_bytes

#: Cells of one batch.
BATCH = 20_000
#: Number formats that show dates or times.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
CELLS = "file string, sheet string, row long, col int, kind string, value string"


def _events(data, start: Callable[[str, dict], None], end: Callable[[str], None], text: Callable[[str], None]) -> Iterator[None]:
    """Parse a stream; yields between pieces of it."""
    parser = expat.ParserCreate()
    local = lambda name: name.rpartition(":")[2]

    def refuse(*_) -> None:
        raise ValueError("a document type declaration is not allowed")

    parser.StartDoctypeDeclHandler = refuse
    parser.StartElementHandler = lambda name, at: start(local(name), at)
    parser.EndElementHandler = lambda name: end(local(name))
    parser.CharacterDataHandler = text
    while piece := data.read(1 << 16):
        parser.Parse(piece, False)
        yield
    parser.Parse(b"", True)
    yield


class Workbook:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        targets, self.sheets, self.late = {}, [], False
        self._all("xl/_rels/workbook.xml.rels", lambda n, at: targets.update({at["Id"]: at["Target"]}) if n == "Relationship" else None)

        def book(name: str, at: dict) -> None:
            if name == "sheet":
                to = targets[next(v for k, v in at.items() if k.rpartition(":")[2] == "id" and k != "sheetId")]
                self.sheets.append((at["name"], to.lstrip("/") if to.startswith("/") else f"xl/{to}"))
            elif name == "workbookPr":
                self.late = at.get("date1904", "0") in ("1", "true")

        self._all("xl/workbook.xml", book)
        self.dates = self._date_styles()

    def _all(self, member: str, start: Callable[[str, dict], None]) -> None:
        if member in self.zip.namelist():
            with self.zip.open(member) as data:
                for _ in _events(data, start, lambda n: None, lambda t: None):
                    pass

    def _date_styles(self) -> set[int]:
        """Numbers of the cell styles that show dates."""
        own, styles, inside = {}, [], [False]

        def start(name: str, at: dict) -> None:
            if name == "numFmt":
                own[int(at["numFmtId"])] = bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", at["formatCode"]), re.I))
            elif name in ("cellXfs", "cellStyleXfs"):
                inside[0] = name == "cellXfs"
            elif name == "xf" and inside[0]:
                styles.append(int(at.get("numFmtId", 0)))

        self._all("xl/styles.xml", start)
        return {i for i, f in enumerate(styles) if own.get(f, f in DATE_FORMATS)}

    def shared(self) -> Iterator[tuple[int, str]]:
        """(number, text) of the shared strings; phonetic readings do not belong to the text."""
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return
        done, parts, state = [], [], {"n": -1, "t": False, "rPh": False}

        def start(name: str, at: dict) -> None:
            state["n"] += name == "si"
            state["rPh"] = state["rPh"] or name == "rPh"
            state["t"] = name == "t" and not state["rPh"]

        def end(name: str) -> None:
            state["t"] = False
            state["rPh"] = state["rPh"] and name != "rPh"
            if name == "si":
                done.append((state["n"], "".join(parts)))
                parts.clear()

        with self.zip.open("xl/sharedStrings.xml") as data:
            for _ in _events(data, start, end, lambda t: parts.append(t) if state["t"] else None):
                yield from done
                done.clear()

    def cells(self, member: str) -> Iterator[tuple[int, int, str, str]]:
        """(row, column, kind, value), both from 1; kinds: number, date, bool, text, shared.  Cells without a value are left out."""
        done, parts, now = [], [], {"row": 0, "col": 0, "kind": "n", "style": 0, "in": False}

        def start(name: str, at: dict) -> None:
            if name == "row":
                now["row"], now["col"] = int(at.get("r", now["row"] + 1)), 0
            elif name == "c":
                place = re.match(r"([A-Z]+)(\d+)", at.get("r", ""))
                now["col"] = _column(place[1]) if place else now["col"] + 1
                now["kind"], now["style"] = at.get("t", "n"), int(at.get("s", 0))
                parts.clear()
            elif name in ("v", "t"):
                now["in"] = True

        def end(name: str) -> None:
            if name in ("v", "t"):
                now["in"] = False
            elif name == "c" and parts:
                value, kind = "".join(parts), now["kind"]
                kinds = {"s": "shared", "str": "text", "inlineStr": "text", "b": "bool", "d": "date", "e": "error"}
                told = kinds.get(kind, "date" if now["style"] in self.dates else "number")
                if told != "error":
                    done.append((now["row"], now["col"], told if kind != "d" else "iso", value))

        with self.zip.open(member) as data:
            for _ in _events(data, start, end, lambda t: parts.append(t) if now["in"] else None):
                yield from done
                done.clear()


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _name(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, col, kind, value) of all cells with a value of the workbooks at ``path``; kinds are number, bool, text and
    date, whose values are days since 1899-12-30 (1900 has its well-known extra day), or ISO text of kind iso."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "sheet", "row", "col", "kind", "value"])

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                book, held = Workbook(content.as_py()), []
                for n, text in book.shared():
                    held.append((file, None, n, 0, "string", text))
                    if len(held) >= BATCH:
                        yield out(held)
                        held = []
                for name, member in book.sheets:
                    for row, col, kind, value in book.cells(member) if member in book.zip.namelist() else ():
                        if kind == "date":
                            value = repr(float(value) + (1462 if book.late else 1 if float(value) < 60 else 0))
                        held.append((file, name, row, col, kind, value))
                        if len(held) >= BATCH:
                            yield out(held)
                            held = []
                if held:
                    yield out(held)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = staged(files.mapInArrow(parse, CELLS), "cells")
    texts = rows.where("kind = 'string'").select("file", F.col("row").cast("string").alias("value"), F.col("value").alias("said"))
    told = rows.where("kind <> 'string'").alias("c").join(texts.withColumn("kind", F.lit("shared")), ["file", "kind", "value"], "left")
    shared = F.col("kind") == "shared"
    return told.select("file", "sheet", "row", "col", F.when(shared, "text").otherwise(F.col("kind")).alias("kind"), F.when(shared, F.col("said")).otherwise(F.col("value")).alias("value"))


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet of one workbook (the first by name order if none is told) as a table, with ``row_number`` of the sheet.

    The first row with a value has the names: blank ones become ``Unnamed: k``, repeated ones get ``.1`` and so on.  A column is
    bigint, double, boolean or timestamp if all its values are, else string.  Rows without a value between others stay, as nulls.
    """
    cells = staged(read_cells(spark, path), "sheet-cells")
    if sheet is None:
        sheet = cells.agg(F.min("sheet")).first()[0]
    mine = cells.where(F.col("sheet") == F.lit(sheet))
    head, last, width = mine.agg(F.min("row"), F.max("row"), F.max("col")).first()
    if head is None:
        return spark.createDataFrame([], "row_number long")
    said = {r["col"]: r["value"] for r in mine.where(F.col("row") == head).select("col", "value").collect()}
    names: list[str] = []
    for c in range(1, width + 1):
        name, k = said.get(c) or f"Unnamed: {c - 1}", 0
        while (name if not k else f"{name}.{k}") in names:
            k += 1
        names.append(name if not k else f"{name}.{k}")
    body = mine.where(F.col("row") > head)
    whole = (F.col("kind") == "number") & (F.col("value").try_cast("double") % 1 == 0)
    date = F.col("kind").isin("date", "iso")
    kinds = body.groupBy("col").agg(
        F.min((F.col("kind") == "number").cast("int")).alias("number"), F.min(F.coalesce(whole, F.lit(False)).cast("int")).alias("whole"),
        F.min((F.col("kind") == "bool").cast("int")).alias("bool"), F.min(date.cast("int")).alias("date"),
    ).collect()
    kind = {r["col"]: "bigint" if r["whole"] else "double" if r["number"] else "boolean" if r["bool"] else "timestamp" if r["date"] else "string" for r in kinds}
    wide = body.groupBy("row").agg(*[F.max(F.when(F.col("col") == c, F.struct("kind", "value"))).alias(f"c{c}") for c in range(1, width + 1)])
    rows = spark.range(head + 1, last + 1).withColumnRenamed("id", "row").join(wide, "row", "left")
    return rows.select(F.col("row").alias("row_number"), *[_typed(F.col(f"c{c}"), kind.get(c, "string")).alias(n) for c, n in enumerate(names, 1)])


def _typed(cell: Column, kind: str) -> Column:
    value = cell["value"]
    day = F.timestamp_micros(F.round(value.try_cast("double") * 86_400_000_000 - F.lit(25_569 * 86_400_000_000)).cast("bigint"))
    when = F.when(cell["kind"] == "iso", F.try_to_timestamp(value)).otherwise(day)
    number = value.try_cast("double")
    if kind == "timestamp":
        return when
    if kind == "boolean":
        return value == "1"
    if kind in ("bigint", "double"):
        return number.cast(kind)
    flag = F.when(value == "1", "true").otherwise("false")
    plain = F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(value)
    return F.when(cell["kind"] == "bool", flag).when(cell["kind"] == "date", day.cast("string")).when(cell["kind"] == "number", plain).otherwise(value)


def write_workbook(spark: SparkSession, sheets: dict[str, DataFrame], path: str, most: int = 10_000) -> None:
    """A workbook of small tables, ``most`` rows each, which pass through the driver; larger ones are refused."""
    told = {}
    for name, df in sheets.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"a sheet written here has at most {most} rows")
        told[name] = (df.columns, [tuple(r) for r in rows])
    write_bytes(workbook(told), path, spark)


def workbook(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """A small workbook of sheets (names, rows) of texts, numbers, flags, dates and None, made in memory."""
    import datetime

    texts: dict[str, int] = {}

    def cell(value, place: str) -> str:
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{place}"><v>{value!r}</v></c>'
        if isinstance(value, (datetime.datetime, datetime.date)):
            at = value if isinstance(value, datetime.datetime) else datetime.datetime(value.year, value.month, value.day)
            return f'<c r="{place}" s="1"><v>{(at - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)!r}</v></c>'
        return f'<c r="{place}" t="s"><v>{texts.setdefault(str(value), len(texts))}</v></c>'

    space, out = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', io.BytesIO()
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        listed, links = "", ""
        for k, (name, (names, rows)) in enumerate(sheets.items(), 1):
            body = "".join(
                f'<row r="{i}">{"".join(cell(v, f"{_name(c)}{i}") for c, v in enumerate(row, 1))}</row>' for i, row in enumerate([tuple(names), *rows], 1) if any(v is not None for v in row)
            )
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>")
            listed += f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>'
            links += f'<Relationship Id="r{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>'
        z.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {space}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        said = "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in texts)
        z.writestr("xl/sharedStrings.xml", f"<sst {space}>{said}</sst>")
    return out.getvalue()
