"""Spreadsheets: written cells come back."""

import datetime
import io
import zipfile

import pytest

from pairloom.sources import sheets as SH

DAY = datetime.datetime(2024, 2, 29, 13, 30)


def written(tmp_path, data, name="book.xlsx"):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path / name)


def test_types_dates_and_blanks_come_back(spark, tmp_path):
    names = ["id", "text", "x", "when", "flag", "mixed", None, "text"]
    rows = [
        (1, "a & <b>", 0.5, DAY, True, 1, None, "q"), (2, None, 2, datetime.date(1970, 1, 1), False, "z", None, " two  blanks "), (None,) * 8,
        (4, "漢字\U0001f600", -1e-9, None, None, True, None, ""), (5, "a & <b>", 3.25, datetime.datetime(2100, 1, 1), None, DAY, 7, "q"),
    ]
    path = written(tmp_path, SH.workbook({"Zweite": (["k"], [("v",)]), "Erste": (names, rows)}))
    df = SH.read_sheet(spark, path)
    assert df.columns == ["row_number", "id", "text", "x", "when", "flag", "mixed", "Unnamed: 6", "text.1"]
    assert [t for _, t in df.dtypes] == ["bigint", "bigint", "string", "double", "timestamp", "boolean", "string", "bigint", "string"]
    got = [tuple(r) for r in df.orderBy("row_number").collect()]
    assert [r[0] for r in got] == [2, 3, 4, 5, 6] and got[2][1:] == (None,) * 8
    assert [r[2] for r in got] == ["a & <b>", None, None, "漢字\U0001f600", "a & <b>"] and [r[3] for r in got] == [0.5, 2.0, None, -1e-9, 3.25]
    assert [r[4] for r in got] == [DAY, datetime.datetime(1970, 1, 1), None, None, datetime.datetime(2100, 1, 1)] and [r[5] for r in got] == [True, False, None, None, None]
    assert [r[6] for r in got] == ["1", "z", None, "true", str(DAY)] and [r[8] for r in got] == ["q", " two  blanks ", None, "", "q"]
    assert [tuple(r) for r in SH.read_sheet(spark, path, "Zweite").collect()] == [(2, "v")]


def odd(sheet, strings="", styles="", book=""):
    out, s = io.BytesIO(), 'xmlns="m" xmlns:r="o"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<x:workbook xmlns:x="m" xmlns:r="o">{book}<x:sheets><x:sheet name="S" sheetId="9" r:id="a"/><x:sheet name="gone" sheetId="3" r:id="b"/></x:sheets></x:workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="a" Target="/xl/w/one.xml"/><Relationship Id="b" Target="none.xml"/></R>')
        z.writestr("xl/w/one.xml", f"<worksheet {s}><sheetData>{sheet}</sheetData></worksheet>" if not sheet.startswith("<!") else sheet)
        z.writestr("xl/sharedStrings.xml", f"<sst {s}>{strings}</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {s}>{styles}</styleSheet>")
    return out.getvalue()


def test_rich_texts_inline_texts_errors_and_own_formats(spark, tmp_path):
    strings = "<si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si><si><t/></si>"
    styles = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0 &quot;days&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs>'
    styles += '<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
    sheet = '<row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>in</t></is></c><c><v>3</v></c><c/></row>'
    sheet += '<row r="5"><c r="A5" s="1"><v>61</v></c><c r="B5" s="2"><v>61</v></c><c r="C5" t="e"><v>#N/A</v></c><c r="AB5" t="str"><f>1+1</f><v>two</v></c></row>'
    cells = {(r["row"], r["col"]): (r["kind"], r["value"]) for r in SH.read_cells(spark, written(tmp_path, odd(sheet, strings, styles))).collect()}
    assert cells == {(1, 1): ("text", "rich"), (1, 2): ("text", "in"), (1, 3): ("number", "3"), (5, 1): ("date", "61.0"), (5, 2): ("number", "61"), (5, 28): ("text", "two")}
    late = {r["col"]: r["value"] for r in SH.read_cells(spark, written(tmp_path, odd(sheet, strings, styles, '<x:workbookPr date1904="1"/>'), "late.xlsx")).where("row = 5").collect()}
    assert late[1] == "1523.0"


def test_refused_and_empty_books(spark, tmp_path):
    assert SH.read_sheet(spark, written(tmp_path, SH.workbook({"S": ([], [])}))).collect() == []
    bomb = '<!DOCTYPE x [<!ENTITY a "aaaa">]><worksheet><sheetData><row><c t="str"><v>&a;</v></c></row></sheetData></worksheet>'
    with pytest.raises(Exception, match="document type declaration"):
        SH.read_cells(spark, written(tmp_path, odd(bomb), "bomb.xlsx")).collect()


def test_tables_beyond_the_bound_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="3 rows"):
        SH.write_workbook(spark, {"S": spark.range(4)}, str(tmp_path / "big.xlsx"), most=3)
    SH.write_workbook(spark, {"S": spark.range(3)}, str(tmp_path / "fits.xlsx"), most=3)
    assert [tuple(r) for r in SH.read_sheet(spark, str(tmp_path / "fits.xlsx")).orderBy("id").collect()] == [(2, 0), (3, 1), (4, 2)]
