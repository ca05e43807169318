import pytest
from pyspark.sql import functions as F

from tabloom.operators import extract as ex
from tabloom.operators import joins, lines, recon

JITTER = [0.0, 0.9, 0.3, 1.1, 0.2, 0.7]


def page(spark, *pages):
    """Monospaced pages of text as words: 4.8 points a character, 12 a line, heights jittered."""
    rows = []
    for number, text in enumerate(pages, 1):
        n = 0
        for i, line in enumerate(text.split("\n")):
            at = 0
            for word in line.split():
                at = line.index(word, at)
                top = 40 + 12.0 * i + JITTER[n % 6]
                rows.append(("doc", number, 20 + 4.8 * at, 20 + 4.8 * (at + len(word)), top, top + 9, word))
                at += len(word)
                n += 1
    return spark.createDataFrame(rows, "file string, page int, x0 double, x1 double, top double, bottom double, text string").repartition(3)


def lined(spark, *pages):
    return lines.page_lines(page(spark, *pages), ["file", "page"], "anchor", 4.0)


def test_lines_rejoin_jittered_words(spark):
    found = lined(spark, "one two three four\nfive six").orderBy("line_no").collect()
    assert [r.text for r in found] == ["one two three four", "five six"]
    by_mean = lines.page_lines(page(spark, "one two three four\nfive six"), ["file", "page"], "mean").orderBy("line_no").collect()
    assert [r.text for r in by_mean] == ["one two three four", "five six"]


def test_id_lines(spark):
    got = {r.ssn: r for r in ex.id_lines(lined(spark, "ID       NAME\n1234506 Mroz Dana K 555-12-4599 Half time or more\n12 Oak St\nDover, DE 19901-4412\n1234508 XXX-XX-4511 Dr. Priya Nair 9 Elm Rd\n1234509 555-12-4600")).collect()}
    assert (got["555-12-4599"].name, got["555-12-4599"].student_id, got["555-12-4599"].address) == ("Mroz Dana K", "1234506", "12 Oak St, Dover, DE 19901-4412")
    assert (got["XXX-XX-4511"].name, got["XXX-XX-4511"].address, got["XXX-XX-4511"].address_source, got["XXX-XX-4511"].notes) == ("Priya Nair", "9 Elm Rd", "same line", "masked")
    assert got["555-12-4600"].notes == "no name" and len(got) == 3


def test_banded_rows_continue_and_inherit(spark):
    head = "ID        NAME              SSN\n"
    first = "1001      Ann Very          111-11-1111\n          Longname\n1002      Bob               222-22-2222"
    got = ex.banded_rows(lined(spark, head + first, "1003      Cyd               333-33-3333"), {"id": ("ID",), "name": ("NAME",), "ssn": ("SSN",)}).collect()
    assert {(r.page, r.id, r["name"], r.ssn) for r in got} == {(1, "1001", "Ann Very Longname", "111-11-1111"), (1, "1002", "Bob", "222-22-2222"), (2, "1003", "Cyd", "333-33-3333")}


def test_label_blocks_carry_over_pages(spark):
    labels = ("NAME", "PART ID", "DOB")
    pages = ("NAME: ACKERMAN, KENTON PART ID: 12345\nDOB: 01/15/1963\n\n\nNAME: CHILDERS, MORGAN", "PART ID: 777 DOB: 02/02/1970\n\n\nNAME: SMITH, JOHN PART ID: 888")
    records = ex.labelled_blocks(lined(spark, *pages), labels, 20.0)
    got = ex.carried_over_pages(records, ["name", "part_id", "dob"], ["page", "block"]).collect()
    assert {(r["name"], r.part_id, r.dob) for r in got} == {("ACKERMAN, KENTON", "12345", "01/15/1963"), ("CHILDERS, MORGAN", "777", "02/02/1970"), ("SMITH, JOHN", "888", "")}


def test_boxed_forms(spark):
    text = "a Employee's social security number\n123-45-6789\nb FED ID 45-1234567\ne Employee's first name\nJOHN A SAMPLE\n456 OAK AVENUE\nSPRINGFIELD, IL 62704\n900-00-0002 decoy"
    (r,) = ex.boxed_forms(lined(spark, text), "social security number", "first name").collect()
    assert (r.ssn, r.name, r.address.street, r.address.city, r.address.zip) == ("123-45-6789", "JOHN A SAMPLE", "456 OAK AVENUE", "SPRINGFIELD", "62704")


def test_each_form_has_its_own_number(spark):
    form = "Employee's social security number\n{}\nEmployee's first name\n{}\n1 Main St\nDover, DE 19901\n\n\n"
    got = ex.boxed_forms(lined(spark, form.format("111-22-3333", "Ann Rao") + form.format("444-55-6666", "Bob Lee")), "social security number", "first name").orderBy("line_no").collect()
    assert [(r.ssn, r.name) for r in got] == [("111-22-3333", "Ann Rao"), ("444-55-6666", "Bob Lee")]
    (r,) = ex.boxed_forms(lined(spark, "social security number\n111-22-3333"), "social security number", "first name").collect()
    assert (r.ssn, r.name) == ("111-22-3333", "")


def test_wage_pages_by_grid_and_list(spark):
    two = lambda a, b: f"{a:<40}{b}"
    rows = lambda a, b, m, n: "\n".join([two("social security number", "social security number"), two(a, b), two("first name", "first name"), two(m, n), two("1 Elm St", "2 Oak St"), two("Dover, DE 19901", "Reno, NV 89501")])
    grid = rows("111-11-1111", "222-22-2222", "Ann Rao", "Bob Lee") + "\n\n\n" + rows("333-33-3333", "444-44-4444", "Cyd Fox", "Dan Poe")
    lists = "D. SSN  E. EMPLOYEE NAME (FIRST) (M.I.) (LAST NAME)\n555-55-5555      EVE            Q        STONE\n134 133 11\n666-66-6666 Fay Gold\n99 1"
    got = {(r.page, r.cell, r.ssn, r.name) for r in ex.wage_pages(page(spark, grid, lists), 400.0).collect()}
    assert got == {(1, "TopLeft", "111-11-1111", "Ann Rao"), (1, "TopRight", "222-22-2222", "Bob Lee"), (1, "BottomLeft", "333-33-3333", "Cyd Fox"), (1, "BottomRight", "444-44-4444", "Dan Poe"), (2, "List", "555-55-5555", "EVE Q STONE"), (2, "List", "666-66-6666", "Fay Gold")}


def test_records_over_three_pages_and_two_people(spark):
    kind = "file string, page int, block int, name string, part_id string, dob string"
    rows = [("f", 1, 0, "Ann", "", ""), ("f", 2, 0, "", "7", ""), ("f", 3, 0, "", "", "1/1/70"), ("g", 1, 0, "Bob", "8", ""), ("g", 2, 0, "Cyd", "", ""), ("h", 1, 0, "Dan", "9", ""), ("h", 2, 0, "", "", "2/2/80")]
    got = ex.carried_over_pages(spark.createDataFrame(rows, kind), ["name", "part_id", "dob"], ["page", "block"], ("name", "part_id")).collect()
    assert {(r.file, r.page, r["name"], r.part_id, r.dob) for r in got} == {("f", 1, "Ann", "7", "1/1/70"), ("g", 1, "Bob", "8", ""), ("g", 2, "Cyd", "", ""), ("h", 1, "Dan", "9", "2/2/80")}


def test_donors_fill_once_and_columns_win(spark):
    kind = "ssn string, sid string, address string, origin string"
    target = spark.createDataFrame([("1", "", "", ""), ("2", "b", "old", "below"), ("", "c", "x", "column")], kind)
    donor = spark.createDataFrame([("1", "", "new", "column", 2), ("1", "", "first", "line", 1), ("2", "", "better", "column", 1), ("", "c", "y", "column", 1)], kind + ", n int")
    got = joins.fill_from_donor(target, donor, ["ssn", "sid"], ["address"], ["n"], ("address", "origin", "column")).collect()
    assert {(r.ssn, r.address, r.origin, r.filled_from) for r in got} == {("1", "first", "line", "ssn"), ("2", "better", "column", "ssn"), ("", "x", "column", "sid")}


def test_panes_part_at_the_gutter(spark):
    words = page(spark, "left words here               right side text\nmore left                     more right")
    got = ex.panes(words, 300.0).groupBy("pane").agg(F.count("*").alias("n")).collect()
    assert {r.pane: r.n for r in got} == {0: 5, 1: 5}


def test_partner_forms(spark):
    text = "Part II\nPartner's identifying number\n11-1111111\nName, address of partner\nSAMPLE VENTURE I LLC\n1 Main St\nDover, DE 19901\nType of entity of partner? Partnership"
    (r,) = ex.partner_forms(lined(spark, text)).collect()
    assert (r.tin.value, r.tin.type, r.name, r.parts["first"], r.parts["last"], r.entity_type, r.address.city) == ("11-1111111", "EIN", "SAMPLE VENTURE I LLC", "", "SAMPLE VENTURE I LLC", "Partnership", "Dover")


def test_lists(spark):
    got = ex.status_list(lined(spark, "Ann Alpha APPROVED\nfoo\nFile: 77-A\nBob Bravo DENIED"), ("APPROVED", "DENIED")).orderBy("line_no").collect()
    assert [(r.name, r.file_number, r.status) for r in got] == [("Ann Alpha", "77-A", "APPROVED"), ("Bob Bravo", "NOT FOUND", "DENIED")]
    (a, b) = ex.academic_records(lined(spark, "Ann Alpha 111-11-1111\nProgram: Law GPA: 3.5\nSAP: Met\nBob Bravo 222-22-2222\nProgram: Art")).orderBy("block").collect()
    assert (a.ssn, a.name, a.program, a.gpa, a.sap, b.program, b.gpa) == ("111-11-1111", "Ann Alpha", "Law", "3.5", "Met", "Art", "")
    got = ex.payroll_list(lined(spark, "111-11-1111 Ann B Alpha\nTOTAL 5\n333-33-3333 x")).collect()
    assert [(r.ssn, r.name) for r in got] == [("111-11-1111", "Ann B Alpha")]


def test_course_rows_and_gap_cells(spark):
    row = spark.range(1).select(ex.course_row(F.lit("☐ 680 E OL70 CRIM 232 Intro to Law 3 75 $825.00")).alias("r"), ex.course_row(F.lit("too short")).alias("none")).first()
    assert (row.r.head, row.r.title, row.r.tail, row.none) == (["680", "E", "OL70", "CRIM", "232"], "Intro to Law", ["3", "75", "$825.00"], None)
    got = lined(spark, "42 Rideout Ct        Fort Wood      MO   65473").select(ex.gap_cells(F.col("words"), 14.0).alias("c")).first().c
    assert got == ["42 Rideout Ct", "Fort Wood", "MO 65473"] or got == ["42 Rideout Ct", "Fort Wood", "MO", "65473"]


def test_paired_rows_use_each_once(spark):
    rows = [("f", 1, "id", 10.0, "1"), ("f", 1, "id", 22.0, "2"), ("f", 1, "name", 11.0, "A"), ("f", 1, "name", 24.0, "B"), ("f", 1, "name", 60.0, "C"), ("f", 1, "id", 34.0, "3")]
    got = ex.paired_rows(spark.createDataFrame(rows, "file string, page int, kind string, y double, text string")).orderBy("y").collect()
    assert [(r.id, r["name"]) for r in got] == [("1", "A"), ("2", "B"), ("3", "")]


def test_people_once_and_lists_yield_to_forms(spark):
    rows = [("f", "1", "Ann"), ("f", "1", "Ann A"), ("f", "", "Bob"), ("f", " ", "bob"), ("f", "", ""), ("f", None, None), ("g", "1", "Ann")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "file string, ssn string, name string, i int")
    assert sorted(r.i for r in ex.unique_people(df, ["i"]).collect()) == [0, 2, 4, 5, 6]
    forms = spark.createDataFrame([("f", "1", "Ann")], "file string, ssn string, name string")
    assert sorted(r.i for r in joins.without_listed(df, forms, ["file", "ssn"]).collect()) == [2, 3, 4, 5, 6]


def test_diagnostics_are_masked(spark):
    shown = ex.explained(lined(spark, "NAME: Ann 123-45-6789"), ("NAME:",)).first()
    assert shown.text == "NAME: Xxx ###-##-####"


def test_reconciliation_and_best_reading(spark):
    e = spark.createDataFrame([("a",), ("a",), ("b",)], "file string")
    p = spark.createDataFrame([("a",)], "file string")
    assert {tuple(r) for r in recon.reconciled(e, p, "file").collect()} == {("a", 2, 1, 1, False), ("b", 1, 0, 1, False)}
    r = spark.createDataFrame([("f", "x", 1, 5), ("f", "y", 1, 7), ("g", "x", 1, 1), ("g", "y", 1, 1)], "file string, method string, a int, b int")
    assert {tuple(x) for x in recon.best_reading(r, ["file"], ["a", "b"], "method").collect()} == {("f", "y"), ("g", "x")}


@pytest.mark.parametrize("when,expected", [("populated", ["S", "", "U"]), ("blank", ["T", "S", "U"])])
def test_conditional_update(spark, when, expected):
    t = spark.createDataFrame([(1, "T"), (2, ""), (3, "U")], "k int, v string")
    s = spark.createDataFrame([(1, "S"), (2, "S")], "k int, v string")
    assert [r.v for r in joins.conditional_update(t, s, "k", ["v"], when).orderBy("k").collect()] == expected


def test_field_fallback_crops_merges_and_layouts(spark):
    r = spark.createDataFrame([("f", 1, "", "x"), ("f", 2, "", "y")], "file string, page int, name string, other string")
    w = spark.createDataFrame([("f", 1, "Student Name", " Ann "), ("f", 1, "dob", "1/1/70")], "file string, page int, field string, value string")
    assert [tuple(x) for x in ex.filled_from_fields(r, w, {"name": ("studentname",)}).orderBy("page").collect()] == [("f", 1, "Ann", "x"), ("f", 2, "", "y")]
    assert ex.cropped_text(page(spark, "left            right"), 60, 400).first().text == "right"
    rows = [("f", 1, "id", 10.0, "1"), ("f", 1, "name", 12.0, "A"), ("f", 1, "name", 30.0, "B"), ("f", 1, "id", 50.0, "2")]
    got = ex.merged_by_height(spark.createDataFrame(rows, "file string, page int, kind string, y double, text string")).orderBy("y").collect()
    assert [(x.id, x["name"]) for x in got] == [("1", "A"), ("", "B"), ("2", "")]
    found = ex.layouts(lined(spark, "Wage and tax\nstatement", "other page"), {"w2": ("WAGE AND TAX", "STATEMENT"), "list": ("OTHER", "NONE")}).orderBy("page").collect()
    assert [x.layout for x in found] == ["w2", None]
