"""Workbooks against the CSV of the same rows."""

from __future__ import annotations

import csv
import zipfile
from xml.sax.saxutils import escape

import pytest

from tidemark.sources.workbook import workbook, workbook_rows

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def letters(n):
    return (chr(64 + n // 26) if n >= 26 else "") + chr(65 + n % 26)


def write_book(path, sheets, shared=True, styles=""):
    """Sheets by name, each a list of rows of texts, numbers, truth values, None or raw cells (as tuples of attributes and inner XML)."""
    strings: dict[str, int] = {}

    def cell(at, v):
        if v is None:
            return ""
        if isinstance(v, tuple):
            return f'<c r="{at}" {v[0]}>{v[1]}</c>'
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, str):
            return f'<c r="{at}" t="s"><v>{strings.setdefault(v, len(strings))}</v></c>' if shared else f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        return f'<c r="{at}"><v>{v}</v></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{k}">' + "".join(cell(f"{letters(j)}{k}", v) for j, v in enumerate(row)) + "</row>" for k, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r><rPh><t>no</t></rPh></si>" for s in strings) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')


def test_two_sheets_equal_their_csv(spark, tmp_path, data):
    rows = {n: [tuple(r) for r in spark.read.parquet(f"{data}/{n}.parquet").limit(2_500).select(*c).collect()] for n, c in {"orders": ("o_orderkey", "o_orderstatus", "o_custkey"), "part": ("p_partkey", "p_name", "p_size")}.items()}
    for shared in (True, False):
        write_book(tmp_path / f"{shared}.xlsx", {n: [("key", "text", "n"), *r] for n, r in rows.items()}, shared)
        for n, r in rows.items():
            with open(tmp_path / f"{n}.csv", "w", newline="") as file:
                csv.writer(file).writerows([("key", "text", "n"), *r])
            schema = "key long, text string, n int"
            got = workbook(spark, str(tmp_path / f"{shared}.xlsx"), schema, n).drop("file", "sheet", "row")
            want = spark.read.csv(str(tmp_path / f"{n}.csv"), header=True, schema=schema)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_kinds_of_cells(spark, tmp_path):
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;x&quot;mm"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    odd = [('s="1"', "<v>45000</v>"), ('s="2"', "<v>45000.25</v>"), ('s="3"', "<v>3.5</v>"), ('t="e"', "<v>#N/A</v>"), ('t="str"', "<f>A1</f><v>made</v>"), ("", "<f>1+1</f>")]
    write_book(tmp_path / "a.xlsx", {"One & only": [["a", None, " b ", "a"], [], [True, None, "x<&>y", 7, None], odd], "empty": []}, styles=styles)
    got = {r.row: r.cells for r in workbook_rows(spark, str(tmp_path)).collect()}
    assert got == {1: ["a", None, " b ", "a"], 3: ["true", None, "x<&>y", "7"], 4: ["2023-03-15", "2023-03-15 06:00:00", "3.5", None, "made"]}
    table = workbook(spark, [str(tmp_path / "a.xlsx")], "b string, a date, none int", "One & only").collect()
    assert sorted((r.row, r.b, str(r.a), r.none) for r in table) == [(3, "x<&>y", "None", None), (4, "3.5", "2023-03-15", None)]
    assert workbook_rows(spark, str(tmp_path), "missing").count() == 0
    (tmp_path / "b.xlsx").write_text("no zip")
    with pytest.raises(Exception, match="not a workbook"):
        workbook_rows(spark, str(tmp_path / "b.xlsx")).collect()
