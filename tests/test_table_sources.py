"""Workbooks, separated text and reference files through spark.read."""

import json
import zipfile

import pytest

from wellframe.sources import files, tables

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, sheets):
    """A minimal workbook: {name: rows of cells}, text shared or inline, numbers as they are, None for no cell."""
    shared: list[str] = []

    def cell(r, c, v, i):
        at = f'r="{chr(65 + c)}{r + 1}"'
        if isinstance(v, str) and i % 2:
            return f'<c {at} t="inlineStr"><is><t>{v}</t></is></c>'
        if isinstance(v, str):
            shared.append(v)
            return f'<c {at} t="s"><v>{len(shared) - 1}</v></c>'
        return f"<c {at}><v>{v}</v></c>"

    with zipfile.ZipFile(path, "w") as z:
        for n, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v, r + c) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared) + "</sst>")
        rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f"<workbook {NS} {rel}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i > 1 else ""}worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")


def test_workbooks(spark, tmp_path):
    tables.register(spark)
    workbook(tmp_path / "s.xlsx", {"Survey": [[None], ["MD (ft)", "Inclination (deg)", "Azimuth (deg)"], [2000, 20, 95], [0, 0, 0], ["1,000", None, 5], [None, None, None]], "Tops": [["Formation", "Top MD (m)"], ["Tipam Sst", "2,310.5"], ["Barail", 2850]]})
    survey = spark.read.format("sheet").load(f"{tmp_path}/s.xlsx")
    assert [(round(r.md_m, 1), r.inc_deg, r.azi_deg) for r in files.survey_table(survey).collect()] == [(0.0, 0.0, 0.0), (609.6, 20.0, 95.0)]
    tops = spark.read.format("sheet").option("sheet", "Tops").load(f"file://{tmp_path}/s.xlsx")
    assert {(r.formation, r.top_md_m) for r in files.tops_table(tops).collect()} == {("Tipam Sst", 2310.5), ("Barail", 2850.0)}
    with pytest.raises(Exception, match="no sheet"):
        spark.read.format("sheet").option("sheet", "None").load(f"{tmp_path}/s.xlsx").collect()


def test_folders_of_separated_text(spark, tmp_path):
    tables.register(spark)
    (tmp_path / "a.csv").write_text("﻿MD,Inc,Azi\n100,1,2\n\n", encoding="utf-8")
    (tmp_path / "b.tsv").write_text('Inc\tMD\n3\t"20\t0"\n')
    (tmp_path / "c.txt").write_text("not read")
    df = spark.read.format("sheet").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 2 and {tuple(r) for r in df.collect()} == {("100", "1", "2"), ("20\t0", "3", None)}
    assert [tuple(r) for r in spark.read.format("sheet").load(f"{tmp_path}/b*").collect()] == [("3", "20\t0")]
    with pytest.raises(Exception, match="no .*file at"):
        spark.read.format("sheet").load(f"{tmp_path}/nothing*").collect()


def test_reference_files(spark, tmp_path):
    tables.register(spark)
    (tmp_path / "a.json").write_text(json.dumps([{"name": "Tipam", "order": 1, "aliases": ["T", "Tp"]}, {"name": "Barail", "deep": True}]))
    got = {tuple(r) for r in spark.read.format("reference").load(f"{tmp_path}/a.json").collect()}
    assert got == {("Tipam", "1", '["T", "Tp"]', None), ("Barail", None, None, "true")}
    typed = spark.read.format("reference").schema("name string, order string").load(f"{tmp_path}/a.json")
    assert {(r.name, r.order) for r in typed.collect()} == {("Tipam", "1"), ("Barail", None)}
    pytest.importorskip("yaml")
    (tmp_path / "b.yaml").write_text("losses:\n  weight: 0.5\n  on: [a, b]\nkick: 3\n")
    rows = {r.risk: r.asDict() for r in spark.read.format("reference").option("key", "risk").load(f"{tmp_path}/b.yaml").collect()}
    assert rows["losses"]["weight"] == "0.5" and rows["kick"]["value"] == "3"
