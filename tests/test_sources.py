import random
import zipfile

from pyspark.sql import functions as F

from tabloom.operators import headers, union
from tabloom.plans import consolidate
from tabloom.sources import decode, pieces, sheets, sinks
from tabloom.streaming import incremental


def workbook(path, content, pivot=(), chart=(), hidden=()):
    """A small OOXML file; numbers as numbers, ('date', n) as dated cells."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rels = lambda items: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/{k}" Target="{t}"/>' for i, k, t in items) + "</Relationships>"

    def cell(r, c, v):
        at = f'r="{chr(65 + c)}{r}"'
        if v is None:
            return ""
        if isinstance(v, tuple):
            return f'<c {at} s="1"><v>{v[1]}</v></c>'
        if isinstance(v, bool):
            return f'<c {at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c {at}><v>{v}</v></c>"
        return f'<c {at} t="inlineStr"><is><t>{v}</t></is></c>'

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("_rels/.rels", rels([(1, "officeDocument", "xl/workbook.xml")]))
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"' + (' state="hidden"' if n in hidden else "") + "/>" for i, n in enumerate(content, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", rels([(i, "worksheet", f"worksheets/s{i}.xml") for i in range(1, len(content) + 1)]))
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, (name, rows) in enumerate(content.items(), 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1) if row)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
            more = [(1, "pivotTable", "../p.xml")] * (name in pivot) + [(2, "drawing", "../drawings/d.xml")] * (name in chart)
            if more:
                z.writestr(f"xl/worksheets/_rels/s{i}.xml.rels", rels(more))
        z.writestr("xl/drawings/_rels/d.xml.rels", rels([(1, "chart", "../charts/c.xml")]))


def consolidation_folder(tmp_path):
    head = ["Per Num", "Pat Name", "Enc Num", "Enc Dt", "Payer Name"]
    workbook(tmp_path / "alpha.xlsx", {
        "Data1": [head, [1001, "Ann Alpha", "E-1", ("d", 46027), "P1"], [1002, "Bob Bravo", "E-2", "2026-01-06", "P1"], [1003, "Cara Charlie", "E-3", "2026-01-07", "P2"]],
        "Data2": [["Person Number", "Patient Name", "Encounter", "Servc Dt", "Payer Name"], [" 1001.0 ", "ann alpha", "e-1", "01/05/2026", "P1"], [1004, "Dan Delta", "E-4", "01/08/2026", "P1"], [1005, "Eve Echo", "E-5", "2026-01-09", "P3"]],
        "Hidden": [head, [1006, "Fay Foxtrot", "E-6", "2026-01-10", "P1"]],
        "WithChart": [head, [9001, "DECOY", "E-9", "2026-01-10", "DECOY"]],
        "WithPivot": [head, [9002, "DECOY", "E-9", "2026-01-10", "DECOY"]],
        "TitleFirst": [["A title"], head, [9003, "DECOY", "E-9", "2026-01-10", "DECOY"]],
        "BlankTop": [[], [], head, [9004, "DECOY", "E-9", "2026-01-10", "DECOY"]],
        "Numbers": [[1, 2, 3], [4, 5, 6]],
    }, pivot={"WithPivot"}, chart={"WithChart"}, hidden={"Hidden"})
    workbook(tmp_path / "bravo.xlsx", {"Sheet1": [["Per Nbr", "Pt.Name", "Enc Number", "Encounter Dt", "Payer Name", "Location"], [1003, "Cara Charlie", "E-3", "2026-01-07", "P2", "L1"], [1007, "Gus Golf", "E-7", "2026-01-11", "P1", "L1"], [1008, "Hal Hotel", "E-8", "2026-01-12", "P1", "L2"], [1008, "Hal Hotel", "E-8", "2026-01-12", "P1", "L2"]]})
    (tmp_path / "charlie.csv").write_text("PERSON NUM;PATIENT NAME;ENCOUNTER NUMBER;DATE OF SERVICE;Payer Name\n1007;Gus Golf;E-7;2026-01-11;P1\n1009;Ida \"\"India;E-9;2026-01-13;P1\n")
    (tmp_path / "~$alpha.xlsx").write_text("lock")
    (tmp_path / "broken.xlsx").write_bytes(b"PK broken")


def test_folder_to_one_table(spark, tmp_path):
    consolidation_folder(tmp_path)
    rows, report = consolidate.combined(spark, str(tmp_path))
    assert rows.columns == ["Person Number", "Patient Name", "Encounter Number", "Date of Service", "Payer Name", "Location", "Source File", "Source Sheet"]
    found = rows.collect()
    assert sorted(int(float(r["Person Number"])) for r in found) == list(range(1001, 1010))
    assert not any("DECOY" in str(v) for r in found for v in r)
    said = {(r.file, r.sheet): (r.action, r.detail) for r in report.collect()}
    assert {s for (f, s), (a, _) in said.items() if a == "used"} == {"Data1", "Data2", "Hidden", "Sheet1", ""}
    assert "row 2" not in said["alpha.xlsx", "TitleFirst"][1] and "row 1" in said["alpha.xlsx", "TitleFirst"][1] and "row 3" in said["alpha.xlsx", "BlankTop"][1]
    assert said["alpha.xlsx", "WithPivot"] == ("skipped", "holds a pivot table") and said["alpha.xlsx", "WithChart"][0] == "skipped" and said["broken.xlsx", None][0] == "error"


def test_data_source_pushes_filters(spark, tmp_path):
    consolidation_folder(tmp_path)
    sheets.register(spark)
    df = spark.read.format("sheet_cells").load(str(tmp_path))
    assert df.filter("sheet = 'Hidden'").select("cells").collect()[1].cells[1] == "Fay Foxtrot"
    assert {r.visibility for r in df.filter("visibility = 'hidden'").collect()} == {"hidden"}
    a = sorted(map(str, df.filter("error is null").collect()))
    assert a == sorted(map(str, sheets.sheet_cells(spark, str(tmp_path)).filter("error is null").collect()))


def test_other_formats():
    xml = b'<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet ss:Name="S"><Table><Row><Cell><Data ss:Type="String">a</Data></Cell><Cell ss:Index="3"><Data ss:Type="Number">2.0</Data></Cell></Row><Row ss:Index="4"><Cell><Data ss:Type="Boolean">1</Data></Cell></Row></Table></Worksheet></Workbook>'
    assert [tuple(s)[:3] for s in decode.sheets(xml)] == [("S", "visible", [(1, ["a", None, "2"]), (4, ["TRUE"])])]
    html = b"<html><table><tr><th>A&nbsp;x</th><th colspan=2>B</th></tr><tr><td>1<table><tr><td>in</td></tr></table></td><td>2</table></html>"
    assert [s.rows for s in decode.sheets(html)] == [[(1, ["A x", "B", ""]), (2, ["1", "2"])], [(1, ["in"])]]
    assert [s.rows for s in decode.sheets("a\tb\n1\t2,5\n".encode("utf-16"))] == [[(1, ["a", "b"]), (2, ["1", "2,5"])]]
    assert decode.sniff(b"\xd0\xcf\x11\xe0\xa1") == "biff" and decode.sniff(b"") == "empty" and decode.sniff(b"a\x00b") == "unknown"
    assert decode.separator("a;b,c\nd;e\nf;g,h\n") == ";"


def test_no_cell_and_no_file_is_lost(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2,3,4\n5\n")
    (tmp_path / "B.TXT").write_text("x,y\n6,7\n")
    workbook(tmp_path / "C.Xlsx", {"S": [["x", "y"], [8, 9]]})
    (tmp_path / "d.xlsb").write_bytes(b"PK\x03\x04 not a package")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "~$f.xlsx").write_text("lock")
    rows = consolidate.merged(spark, str(tmp_path), ["x", "y"])
    assert rows.columns == ["file", "sheet", "row_no", "x", "y", "Extra_3", "Extra_4"]
    found = {(r.file, r.row_no): tuple(r)[3:] for r in rows.collect()}
    assert found["a.csv", 2] == ("1", "2", "3", "4") and found["a.csv", 3] == ("5", "", "", "") and found["B.TXT", 2] == ("6", "7", "", "") and found["C.Xlsx", 2] == ("8", "9", "", "")
    cells = sheets.sheet_cells(spark, str(tmp_path))
    assert [r.file for r in cells.filter("error is not null").collect()] == ["d.xlsb"]
    assert {(r["name"], r.reason) for r in sheets.skipped_files(spark, str(tmp_path)).collect()} >= {("e.pdf", "no table format"), ("~$f.xlsx", "a lock file")}
    assert {(r.file, r.rows, r.columns, r.width) for r in consolidate.sizes(cells).collect()} == {("a.csv", 3, 4, 4), ("B.TXT", 2, 2, 4), ("C.Xlsx", 2, 2, 4)}


def test_large_text_is_never_read_whole(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("k,v\n" + "".join(f"{i},v{i}\n" for i in range(3000)))
    monkeypatch.setattr(sheets, "LARGE", 1000)

    def refused(rows):
        raise AssertionError("a large text was read whole")

    monkeypatch.setattr(sheets, "_decoded", lambda batches: (refused(b) for b in batches if b.num_rows))
    rows = consolidate.merged(spark, str(tmp_path), ["k", "v"]).orderBy("row_no").collect()
    assert [(r.row_no, r.k, r.v) for r in rows] == [(1, "k", "v"), *[(i + 2, str(i), f"v{i}") for i in range(3000)]]


def test_pieces_give_the_rows_of_the_whole_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "LARGE", 20)
    monkeypatch.setattr(pieces, "PIECE", 40)
    r, expected = random.Random(5), {}
    plain, quotes, other = [b"a", b"bc", b",", b";", b"\n", b"\r\n", b"\r", b"\n\n"], [b'"', b'""', b'"x\n'], [b"\xc3\xa9", b"\xe2\x80\xa8", b"\x0b"]
    for i in range(24):
        data = (b"\xef\xbb\xbf" if i % 5 == 0 else b"") + b"".join(r.choices(plain * 3 + (quotes if i % 4 else []) + (other if i % 2 else []) + ([b"\xff", b"\x85"] if i % 6 == 0 else []) + ([b"\x81"] if i == 12 else []), k=r.randint(60, 300)))
        data = data + b"\0" if i == 22 else data.decode("latin-1").encode("utf-16") if i == 23 else data
        (tmp_path / f"f{i} [x].{('csv', 'TXT')[i % 2]}").write_bytes(data)
        expected |= {repr(x): 1 for x in sheets.file_rows(f"f{i} [x].{('csv', 'TXT')[i % 2]}", data)}
    split = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(split)
    spark.conf.set(split, "300")
    try:
        found = [repr(tuple(x)) for x in sheets.sheet_cells(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set(split, before)
    assert len(found) == len(expected) and set(found) == set(expected)


def test_long_cells_of_text():
    assert [s.rows for s in decode.sheets(b"a,b\n" + b"x" * 200_000 + b",1\n")] == [[(1, ["a", "b"]), (2, ["x" * 200_000, "1"])]]


def test_long_cells_over_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "LARGE", 1000)
    monkeypatch.setattr(pieces, "PIECE", 1000)
    long = "a\nb" * 60_000
    (tmp_path / "a.csv").write_text(f'k,v\n1,"{long}"\n2,x\n')
    assert [r.cells for r in sheets.sheet_cells(spark, str(tmp_path)).orderBy("row_no").collect()] == [["k", "v"], ["1", long], ["2", "x"]]


def test_open_documents_and_fallbacks(tmp_path):
    ns = 'xmlns:office="o" xmlns:table="t" xmlns:text="x"'
    body = '<table:table table:name="S"><table:table-row><table:table-cell office:value-type="string"><text:p>a</text:p></table:table-cell><table:table-cell table:number-columns-repeated="2"/><table:table-cell office:value-type="float" office:value="2.0"><text:p>2</text:p></table:table-cell><table:table-cell table:number-columns-repeated="900"/></table:table-row><table:table-row table:number-rows-repeated="3"/><table:table-row table:number-rows-repeated="2"><table:table-cell office:value-type="date" office:date-value="2024-02-01"/></table:table-row></table:table>'
    with zipfile.ZipFile(tmp_path / "a.ods", "w") as z:
        z.writestr("content.xml", f"<office:document {ns}>{body}</office:document>")
    assert [tuple(s)[:3] for s in decode.sheets((tmp_path / "a.ods").read_bytes())] == [("S", "visible", [(1, ["a", None, None, "2"]), (5, ["2024-02-01"]), (6, ["2024-02-01"])])]
    broken = b'<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet"><a><table><tr><td>1</td></tr></table>'
    assert [s.rows for s in decode.sheets(broken)] == [[(1, ["1"])]]
    try:
        list(decode.sheets(b"\xd0\xcf\x11\xe0\x00 nothing"))
    except decode.Unsupported as e:
        assert "biff" in str(e) and " | " in str(e)


def test_header_rules(spark):
    grid = spark.createDataFrame([("f", "s", i, c) for i, c in enumerate([["Report"], ["EmployeeName", "PeriodStart"], ["", None], ["Employee Name", "Id", "Pay", "Date"], ["Ann", "1", "2", "3"], ["Bob", "4", "5", "6"], ["Cyd", "7", "8", "9"]], 1)], "file string, sheet string, row_no int, cells array<string>")
    assert headers.by_keyword(grid).first().header_row == 4
    assert headers.by_targets(grid, ("id", "pay", "date")).first().header_row == 4
    assert headers.by_score(grid).first().header_row == 4
    assert headers.first_filled(grid).first().header_row == 1
    names = spark.createDataFrame([("f", "s", ["A", "a", "", "A"])], "file string, sheet string, cells array<string>")
    assert [[r.name for r in headers.cleaned_names(names, s).orderBy("pos").collect()] for s in ("underscore", "paren", "dot")] == [["A", "a_2", "Column_3", "A_3"], ["A", "a (2)", "Column C", "A (3)"], ["A", "a.1", "Column_3", "A.2"]]


def test_realign_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("2024-04-01", "007", "1500.5", "Rao, \"A\"", "123-45-6789")], "Joined string, `Emp ID` string, Amount string, Name string, SSN string")
    out = union.realigned(df, ["Emp ID", "Name", "Amount", "Joined", "SSN"])
    sinks.write_csv(out, str(tmp_path / "o"), masked=("SSN",))
    text = max((f.read_bytes().decode() for f in (tmp_path / "o").glob("*.csv")), key=len)
    assert text.splitlines()[0] == '"Emp ID","Name","Amount","Joined","SSN"' and '"007"' in text and "***-**-6789" in text and "\r\n" in text
    assert union.realigned(df, ["X"], "skip") is None and union.mismatch(["b", "a"], ["a", "c"]) == {"missing": ["c"], "extra": ["b"], "moved": ["a"]}
    assert sinks.schema_match(["a", "X"], ["A", "b"]) == {"map": {"a": "A"}, "unmatched": ["X"], "missing": ["b"], "narrow": []}


def test_csv_keeps_long_cells(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("x" * 40_000,)], "a string"), str(tmp_path / "o"))
    assert max(f.read_text() for f in (tmp_path / "o").glob("*.csv")) == '"a"\n"' + "x" * 40_000 + '"\n'


def test_incremental_runs_read_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y\n1,2\n")
    run = lambda: incremental.run_once(incremental.new_rows(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    run()
    run()
    (tmp_path / "in" / "b.csv").write_text("x,y\n3,4\n5,6\n")
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("file").agg(F.count("*").alias("n")).collect()
    assert {r.file: r.n for r in rows} == {"a.csv": 2, "b.csv": 3}


def test_stream_carries_open_records(spark, tmp_path):
    kind = "file string, page int, name string, dob string"
    for i, rows in enumerate([[("f", 1, "Ann", ""), ("g", 1, "Bob", "1")], [("f", 2, "", "2"), ("f", 2, "Cyd", ""), ("g", 3, "Dan", "")]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    q = incremental.carried(stream, ["name", "dob"]).writeStream.format("memory").queryName("carried_pages").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert {(r.file, r["name"], r.dob) for r in spark.table("carried_pages").collect()} == {("f", "Ann", "2"), ("g", "Bob", "1")}


def test_session_blocks(spark):
    df = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:20:00"), ("u", "2024-01-01 02:00:00")], "user string, t string").select("user", F.to_timestamp("t").alias("t"))
    assert sorted(r.n for r in incremental.sessions(df, "user", "t", "30 minutes", "1 hour").collect()) == [1, 2]
