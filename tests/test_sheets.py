"""Workbooks, delimited tables and texts of any encoding."""

import io
import zipfile

import pytest

from sifthouse.sources import sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _workbook(tables):
    """A workbook of ``{sheet: rows}``: texts shared and in place, numbers, a date, a boolean and gaps."""
    out, shared = io.BytesIO(), []
    with zipfile.ZipFile(out, "w") as z:
        rels = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(tables)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        named = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(tables))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{named}</sheets></workbook>')
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="0.00 &quot;days&quot;"/><numFmt numFmtId="171" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        for i, rows in enumerate(tables.values()):
            body = ""
            for r, row in enumerate(rows, 1):
                cells = ""
                for c, v in enumerate(row):
                    at = f'r="{chr(65 + c)}{r}"'
                    if v is None:
                        continue
                    if isinstance(v, bool):
                        cells += f'<c {at} t="b"><v>{int(v)}</v></c>'
                    elif isinstance(v, tuple):
                        cells += f'<c {at} s="{v[0]}"><v>{v[1]}</v></c>'
                    elif isinstance(v, (int, float)):
                        cells += f'<c {at}><v>{v}</v></c>'
                    elif v.startswith("="):
                        cells += f'<c {at} t="inlineStr"><is><t>{v[1:]}</t></is></c>'
                    else:
                        shared.append(v)
                        cells += f'<c {at} t="s"><v>{len(shared) - 1}</v></c>'
                body += f'<row r="{r}">{cells}</row>'
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f'<sst {MAIN}>' + "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r><rPh><t>aside</t></rPh></si>" for s in shared) + "</sst>")
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("books")
    many = [["id", "name", None, "when"]] + [[i, f"name {i}", None, (1, 45_000 + i)] for i in range(3_000)]
    (where / "a.xlsx").write_bytes(_workbook({"First": [[None, None], ["head", "=in place"], [1, 2.5, None, True], [(3, 1.5), (2, 7)]], "Many": many, "Empty": []}))
    (where / "broken.xlsx").write_bytes(b"no archive")
    return where


def test_rows_of_every_sheet(spark, folder):
    rows = sheets.read_workbooks(spark, str(folder)).collect()
    first = {r["n"]: r["cells"] for r in rows if r["sheet"] == "First"}
    assert first == {0: [], 1: ["head", "in place"], 2: ["1", "2.5", None, "True"], 3: ["1899-12-31 12:00:00", "7"]}
    many = {r["n"]: r["cells"] for r in rows if r["sheet"] == "Many"}
    assert len(many) == 3_001 and many[3] == ["2", "name 2", None, "2023-03-17 00:00:00"]
    broken = [r for r in rows if r["sheet"] is None]
    assert len(broken) == 1 and broken[0]["path"].endswith("broken.xlsx") and broken[0]["cells"] is None


def test_blocks_under_their_header(spark, folder):
    rows = sheets.read_workbooks(spark, str(folder))
    got = {(r["heading"], r["block"]): r["text"] for r in sheets.table_blocks(rows).collect()}
    assert got["Sheet: First", 0] == "head | in place\n1 | 2.5 | True\n1899-12-31 12:00:00 | 7"
    many = [got[k] for k in sorted(got) if k[0] == "Sheet: Many"]
    assert all(t.startswith("id | name | when\n") and len(t) <= 1_600 for t in many) and not any(k[0] == "Sheet: Empty" for k in got)
    assert [x for t in many for x in t.split("\n")[1:]] == [f"{i} | name {i} | {sheets._date(45_000 + i)}" for i in range(3_000)]


def test_delimited_files_of_any_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿name,note\n"Müller, A","two\nlines"\n,\nlong,'.encode() + b"x" * 5_000)
    (tmp_path / "b.csv").write_bytes("größe,é\n1,2\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes("alone,header".encode("utf-16"))
    rows = sheets.read_delimited(spark, str(tmp_path))
    got = {(r["heading"], r["block"]): r["text"] for r in sheets.table_blocks(rows).collect()}
    assert got["a.csv", 0] == "name | note\nMüller, A | two\nlines" and got["a.csv", 1] == "name | note\n" + ("long | " + "x" * 5_000)[:1_600]
    assert got["b.csv", 0] == "größe | é\n1 | 2" and got["c.csv", 0] == "alone | header" and len(got) == 4


def test_texts_in_pieces(spark, tmp_path):
    text = "\n".join(f"line {i} ü" for i in range(4_000))
    (tmp_path / "u.txt").write_bytes(text.encode())
    (tmp_path / "w.txt").write_bytes("naïve – test".encode("cp1252"))
    (tmp_path / "one.txt").write_bytes(b"x" * 25_000)
    (tmp_path / "empty.txt").write_bytes(b" \n ")
    rows = sheets.read_texts(spark, str(tmp_path), size=5_000).collect()
    of = lambda name: [r["text"] for r in sorted(rows, key=lambda r: r["piece"]) if r["path"].endswith(name)]
    assert "\n".join(of("u.txt")) == text and all(len(p) <= 5_000 for p in of("u.txt"))
    assert of("w.txt") == ["naïve – test"] and of("empty.txt") == []
    assert "".join(of("one.txt")) == "x" * 25_000 and max(map(len, of("one.txt"))) == 10_000
    # a character cut at the end of what is looked at is still UTF-8
    assert sheets.encoding_of(("a" * 10 + "é").encode()[:-1], False) == "utf-8" and sheets.encoding_of(b"caf\xe9", True) == "cp1252"
