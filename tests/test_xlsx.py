import io
import zipfile

import pytest

from grainmill.sources import files, xlsx

SHEET = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>0</v></c></row>
<row r="3"><c r="A3"><v>1.0</v></c><c r="B3" t="s"><v>2</v></c><c r="C3" t="b"><v>1</v></c><c r="D3"><f>A3/8</f><v>0.125</v></c><c r="E3"><v>9</v></c></row>
<row r="4"/><row r="5"><c r="B5" t="str"><v>made</v></c><c r="AA5"><v>5</v></c></row>
<row r="6"><c r="A6" t="e"><v>#DIV/0!</v></c><c r="B6" t="inlineStr"><is><t></t></is></c></row></sheetData></worksheet>"""
SHARED = """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si><si><t>what</t></si>
<si><r><t>two </t></r><r><t xml:space="preserve">runs_x000D_</t></r><rPh><t>hint</t></rPh></si></sst>"""


def foreign() -> bytes:
    """A workbook as other programs write it: shared texts, gaps, formulas; the first sheet is sheet7.xml."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", xlsx.PARTS["xl/workbook.xml"].replace("</sheets>", '<sheet name="b" sheetId="2" r:id="rId9"/></sheets>'))
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId9" Target="worksheets/sheet1.xml"/><Relationship Id="rId1" Target="/xl/worksheets/sheet7.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", SHARED)
        book.writestr("xl/worksheets/sheet7.xml", SHEET)
    return out.getvalue()


def test_cells_of_other_programs(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(foreign())
    df = files.load(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["name", "what", "column_3", "name_1"]
    assert [tuple(r) for r in df.collect()] == [("1", "two runs\r", "true", "0.125"), (None, "made", None, None), ("#DIV/0!", None, None, None)]


def test_a_folder_of_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(xlsx.workbook(["x", "y"], [["1", "a"], [None, None], ["2", None]]))
    (tmp_path / "b.XLSX").write_bytes(xlsx.workbook(["z", "x"], [["q", "3"]]))
    (tmp_path / "c.xlsx").write_bytes(xlsx.workbook(["only a header"], []))
    (tmp_path / "notes.txt").write_text("no workbook")
    df = files.read_xlsx(spark, str(tmp_path))
    assert df.columns == ["x", "y", "z"]
    assert sorted(map(tuple, df.collect()), key=str) == [("1", "a", None), ("2", None, None), ("3", None, "q")]


def test_texts_come_back(spark, tmp_path):
    texts = ["a", " b ", "<&>\"'", "line\nbreak", "tab\tand\rreturn", "_x0041_", "\x01\x1f", "köln \U0001f600", "", None, "0012"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string").coalesce(1)
    books = xlsx.workbooks(df, 4).collect()
    assert [b["path"] for b in books] == [f"sheet-00000-{i:05d}.xlsx" for i in range(3)]
    for b in books:
        (tmp_path / b["path"]).write_bytes(bytes(b["content"]))
    got = files.ingest(spark, str(tmp_path / "sheet-00000-00000.xlsx"), "xlsx")
    assert [r["_cs_id"] for r in got.orderBy("_cs_id").collect()] == [100, 200, 300, 400]
    back = {int(r["n"]): r["t"] for r in files.read_xlsx(spark, str(tmp_path)).collect()}
    assert back == {i: t or None for i, t in enumerate(texts)}


def test_more_than_a_batch_of_rows(spark):
    books = xlsx.workbooks(spark.range(12_345).coalesce(1).selectExpr("id", "id % 3 AS m"))
    df = xlsx.sheets(books)
    assert df.selectExpr("count(*)", "sum(int(id))", "count(DISTINCT id)").first()[:] == (12_345, 12_344 * 12_345 // 2, 12_345)


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(xlsx.workbook(["x"], []))
    with pytest.raises(ValueError):
        files.read_xlsx(spark, str(tmp_path))
    with pytest.raises(ValueError):
        xlsx.workbooks(spark.range(1), 2_000_000)
    assert xlsx.workbooks(spark.range(0)).count() == 0


@pytest.mark.parametrize("at", [0, 25, 26, 701, 702, 16383])
def test_names_of_columns(at):
    assert xlsx._place(xlsx._letters(at) + "7") == at
