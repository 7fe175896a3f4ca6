"""Workbooks built here by hand, cell by cell."""

from __future__ import annotations

import os

import io
import zipfile

from loregrid.operators import sheets
from loregrid.sources.workbooks import cell_place, visible_sheets

PNG = b"\x89PNG\r\n\x1a\n....."
MAIN, REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def letters(col):
    return chr(65 + col)


def page(rows, merges=(), drawing=False):
    body = ""
    for i, row in enumerate(rows):
        cells = ""
        for j, v in enumerate(row):
            at = f'r="{letters(j)}{i + 1}"'
            if v is None:
                continue
            if isinstance(v, tuple):
                cells += f'<c {at} s="{v[1]}"><v>{v[0]}</v></c>'
            elif isinstance(v, (int, float)):
                cells += f"<c {at}><v>{v}</v></c>"
            else:
                cells += f'<c {at} t="inlineStr"><is><t>{v}</t></is></c>'
        body += f'<row r="{i + 1}">{cells}</row>'
    merged = f"<mergeCells>{''.join(f'<mergeCell ref="{m}"/>' for m in merges)}</mergeCells>" if merges else ""
    return f'<worksheet xmlns="{MAIN}" xmlns:r="{REL}"><sheetData>{body}</sheetData>{merged}{"<drawing r:id=\"rId1\"/>" if drawing else ""}</worksheet>'


def book(pages, hidden=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = list(pages)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"{" state=\"hidden\"" if n in hidden else ""}/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, n in enumerate(names):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", pages[n])
            if "<drawing" in pages[n]:
                z.writestr(f"xl/worksheets/_rels/sheet{i + 1}.xml.rels", '<Relationships><Relationship Id="rId1" Target="../drawings/d.xml"/></Relationships>')
                z.writestr("xl/drawings/d.xml", f'<wsDr xmlns:a="a" xmlns:r="{REL}"><oneCellAnchor><from><col>0</col><row>1</row></from><pic><a:blip r:embed="rId9"/></pic></oneCellAnchor></wsDr>')
                z.writestr("xl/drawings/_rels/d.xml.rels", '<Relationships><Relationship Id="rId9" Target="../media/a.png"/></Relationships>')
                z.writestr("xl/media/a.png", PNG)
    return out.getvalue()


def test_reader():
    data = book({"一": page([["a", 1, 2.5, (45000, 1)], [None, "x"]], ["A1:A2"]), "藏": page([["z"]])}, hidden=("藏",))
    [s] = visible_sheets(data)
    assert s.rows == [["a", "1", "2.5", "2023-03-15 00:00:00"], ["a", "x", "", ""]]
    assert s.merges == [(0, 0, 1, 0)]
    assert cell_place("AB12") == (11, 27)


def test_cleaning_and_merges():
    rows, cols, kept = sheets.clean([["", "", ""], ["a", "", "b"], ["", "", ""], ["", "", ""], ["c", "", ""], ["", "", ""]])
    assert (rows, cols, kept) == ([["a", "b"], ["", ""], ["c", ""]], [0, 2], [1, 2, 4])
    assert sheets.moved_merges([(1, 0, 1, 2), (0, 0, 0, 2)], cols, kept) == [(0, 0, 0, 1)]
    assert sheets.collapsed(0, ["a", "a", "b"], [(0, 0, 0, 1)]) == ["a", "b"]
    assert sheets.clean([]) == ([], [], [])


def test_types():
    kind = sheets.sheet_type
    assert kind("版本记录", []) == "version_log"
    assert kind("Config", []) == "config_table"
    assert kind("枚举", []) == "enum_table"
    assert kind("x", []) == "document"
    assert kind("x", [["名", "1"], ["乙", "2"], ["丙", "3"]]) == "config_table"
    assert kind("x", [["编号", "名", "说", "注"], ["1", "a", "b", "c"], ["2", "a", "b", "c"], ["3", "a", "b", "c"]]) == "enum_table"
    assert kind("x", [["a", "1", "2", "3"], ["b", "1", "2", "3"], ["c", "1", "2", "3"], ["d", "x", "y", "z"]]) == "data_table"
    assert kind("x", [["a", "", "", ""], ["", "b", "", ""]]) == "document"


def test_rendering():
    assert sheets.as_table([["h", "i"], ["", ""], ["1", "2"]], [], {0: ["{P}"], -1: ["{Q}"]}) == "{Q}\n| h | i |\n| --- | --- |\n{P}\n| 1 | 2 |"
    assert sheets.as_outline([["A", ""], ["", "b"], ["", ""], ["C", "d"]], [0, 3], [], {}) == "A\n  b\n\nC | d"
    assert sheets.as_markdown("S", "document", "A\n  b\n\n- c\n    d") == "## S\n\n### A\n- b\n\n- c\n  - d"


def test_sheet_table(spark):
    data = book({"表": page([["名", "值"], ["甲", 1], ["乙", 2]], drawing=True), "空": page([])})
    files = spark.createDataFrame([("d/表.xlsx", data), ("bad.xlsx", b"no")], "source string, content binary")
    rows = sheets.sheets(files)
    got = {(r["source"], r["sheet_index"]): r for r in rows.collect()}
    assert got["d/表.xlsx", 0]["type"] == "config_table"
    assert got["d/表.xlsx", 1]["content"] == sheets.EMPTY
    assert got["bad.xlsx", None]["error"]
    [picture] = sheets.images(rows).collect()
    assert (picture["path"], bytes(picture["data"]), picture["row"]) == ("images/表_0.png", PNG, 1)
    [doc] = sheets.converted(rows).collect()
    assert doc["target"] == "表/表[xlsx转换].md"
    assert "| 甲 | 1 |\n![表](images/表_0.png)\n| 乙 | 2 |" in doc["text"] and doc["text"].startswith("# 表\n\n## 表")


def test_split_content():
    text = "\n\n".join(f"p{i} " + "x" * 30 + "\n" + "y" * 20 for i in range(9))
    parts = sheets.split_content(text, 100)
    assert all(len(p) <= 100 for p in parts) and "\n\n".join(parts) == text
    long = "\n".join("z" * 30 for _ in range(9))
    assert all(len(p) <= 100 for p in sheets.split_content(long, 100)) and "\n".join(sheets.split_content(long, 100)) == long
    assert sheets.split_content("short") == ["short"]


def test_formatters_are_tried_again(spark, tmp_path):
    rows = spark.createDataFrame([("a.xlsx", 0, "s", "data_table", "c" * 25, "old", 1, 1, [], None)], sheets.SHEETS)
    log = str(tmp_path / "calls")

    def formatter(kind):
        def call(name, sheet_type, piece):
            with open(log, "a") as f:
                f.write("x")
            if kind == "never" or kind == "late" and os.path.getsize(log) < 3:
                raise OSError("busy")
            if kind == "denied":
                raise PermissionError("key")
            return f"[{len(piece)}]"

        return call

    for kind, want, calls in (("late", "[25]", 3), ("never", "old", 3), ("denied", "old", 1)):
        got = sheets.formatted(rows, formatter(kind), (0, 0, 0)).first()["markdown"]
        assert (got, os.path.getsize(log)) == (want, calls)
        os.remove(log)
