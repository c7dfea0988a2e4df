import io
import zipfile

import pytest

from tessera.sources import sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(sheet, shared="", styles="", workbook='<workbookPr/>'):
    out = io.BytesIO()
    links = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} {links}>{workbook}<sheets><sheet name="One &amp; Only" sheetId="1" r:id="a"/><sheet name="Gone" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="/xl/worksheets/s.xml"/><Relationship Id="b" Target="worksheets/none.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {MAIN}><sheetData>{sheet}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{shared}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")
    return out.getvalue()


def test_cells_of_every_kind():
    shared = "<si><t>plain</t></si><si><r><t>rich </t></r><r><rPr><b/></rPr><t>text</t></r><rPh><t>hint</t></rPh></si>"
    styles = '<numFmts><numFmt numFmtId="164" formatCode="yyyy&quot;d&quot;"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="21"/></cellXfs>'
    row = (
        '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="C3" t="s"><v>1</v></c><c t="inlineStr"><is><t>in &lt;line</t></is></c><c r="E3" t="b"><v>1</v></c><c r="F3" t="e"><v>#N/A</v></c>'
        '<c r="G3" t="str"><f>A1&amp;"x"</f><v>said</v></c><c r="H3"><f>1+1</f><v>2</v></c><c r="I3" s="1"><v>45351</v></c><c r="J3" s="2"><v>45351.75</v></c><c r="K3" s="3"><v>1.5</v></c>'
        '<c r="L3" s="4"><v>0.5</v></c><c r="M3"/><c r="AA3"><v>1e3</v></c><c r="AB3" t="s"><v>9</v></c></row><row><c><v>-7</v></c></row><row r="9"/>'
    )
    got = list(sheets.rows_of(book(row, shared, styles)))
    one = ["plain", None, "rich text", "in <line", "TRUE", None, "said", "2", "2024-02-29", "2024-02-29 18:00:00", "1.5", "12:00:00", None, *[None] * 13, "1000", None]
    assert got == [("One & Only", 2, one), ("One & Only", 3, ["-7"]), ("One & Only", 8, [])]
    old = book('<row r="1"><c r="A1" s="1"><v>0.5</v></c><c r="B1" s="1"><v>1</v></c></row>', "", styles, '<workbookPr date1904="1"/>')
    assert list(sheets.rows_of(old)) == [("One & Only", 0, ["12:00:00", "1904-01-02"])]


@pytest.mark.parametrize("k,name", [(0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA")])
def test_columns(k, name):
    assert sheets._letters(k) == name and sheets.column_of(name) == k


def test_files_and_broken_ones(spark, tmp_path):
    rows = [["a", None, " b & <c> \n\té\r", ""], [], ["😀", '"q"']]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/good.xlsx").write_bytes(sheets.workbook({"S": rows, "T": [["x"]]}))
    whole = sheets.workbook({"S": [["x" * 999]]})
    for name, raw in {"empty": b"", "text": b"no zip", "cut": whole[: len(whole) // 2], "zip": None}.items():
        if raw is None:
            with zipfile.ZipFile(tmp_path / "zip.xlsx", "w") as z:
                z.writestr("a", "b")
        else:
            (tmp_path / f"{name}.xlsx").write_bytes(raw)
    (tmp_path / "notes.txt").write_text("left alone")
    got = sheets.read_sheets(spark, str(tmp_path)).collect()
    good = sorted((r.sheet, r.row, r.cells) for r in got if r.error is None)
    assert good == [("S", 0, rows[0]), ("S", 1, []), ("S", 2, rows[2]), ("T", 0, ["x"])]
    assert sorted(r.path.rpartition("/")[2] for r in got if r.error) == ["cut.xlsx", "text.xlsx", "zip.xlsx"]
