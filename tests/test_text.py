import random
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom.functions import text as tx
from tabloom.operators import parts


def values(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_identifiers(spark):
    assert values(spark, tx.norm_ssn, "123-45-6789", "123456789", "123‐45‐6789", "xxx-xx-6789", " a  b ") == ["123-45-6789", "123-45-6789", "123-45-6789", "XXX-XX-6789", "A B"]
    assert values(spark, tx.mask_ssn, "123-45-6789") == ["***-**-6789"]
    assert values(spark, tx.find_ssn, "id 123-45-6789 x", "zip 19901-4412", "n 123456789.", "1234567890", "XXX-XX-1234", None) == ["123-45-6789", None, "123456789", None, "XXX-XX-1234", None]
    assert values(spark, tx.ssn_key, "123-45-6789", "123 45 6789", "(123)45.6789", "null", "NULL", " ") == ["123456789"] * 3 + [None] * 3
    kinds = values(spark, lambda c: tx.tin(c, F.lit("INDIVIDUAL")), "123-45-6789", "12-3456789", "XXX-XX-1234", "123456789", "l23-45-678g", "none")
    assert [k and (k.value, k.type) for k in kinds] == [("123-45-6789", "SSN"), ("12-3456789", "EIN"), ("XXX-XX-1234", "SSN"), ("123456789", "SSN"), ("123-45-6789", "SSN"), None]


def test_dates(spark):
    assert values(spark, tx.norm_date, "01/15/1963", "1/5/63", "on 1-5-07", "02/31/2001", "13/01/2001", "x") == ["01/15/1963", "01/05/1963", "01/05/2007", "02/31/2001", None, None]
    assert values(spark, tx.serial_date, "45292", "19999", "45292.5", "text") == ["01/01/2024", "19999", "01/01/2024", "text"]
    assert values(spark, tx.date_value, "1/5/2026", "2026-01-05", "soon ") == ["2026-01-05", "2026-01-05", "SOON"]


def test_names(spark):
    got = values(spark, tx.split_comma_name, "ACKERMAN, KENTON CLYDE", "CHILDERS,MORGAN N", "SMITH JR, JOHN A", "JOHN A SMITH", "Cher")
    assert [tuple(g) for g in got] == [("ACKERMAN", "KENTON", "CLYDE", ""), ("CHILDERS", "MORGAN", "N", ""), ("SMITH", "JOHN", "A", "JR"), ("SMITH", "JOHN", "A", ""), ("", "Cher", "", "")]
    assert values(spark, tx.strip_honorific, "Mroz Dana K", "Mrs.Dana Mroz", "Dr. Mr. X Y") == ["Mroz Dana K", "Dana Mroz", "X Y"]
    assert values(spark, tx.looks_like_name, "Dana Mroz", "Dr.", "A", "x1 yy") == [True, False, False, False]
    assert tuple(values(spark, tx.split_initial_name, "Mroz Dana K")[0]) == ("Mroz", "Dana", "K", "")


def test_headers_and_cells(spark):
    assert values(spark, tx.canonical_header, "Per Nbr", "Pt.Name", "Enc Num", "Servc Dt", "Payer Name", "Encounter Dt", "Plan Number", "pers num", "pt nm", "encntr num", "enc #", "dos date") == ["Person Number", "Patient Name", "Encounter Number", "Date of Service", None, "Date of Service", None, "Person Number", "Patient Name", "Encounter Number", "Encounter Number", "Date of Service"]
    assert values(spark, tx.safe_file_name, 'a<b>:"c', "x. ", " ", None) == ["a_b___c", "x", "(blank)", "(blank)"]
    assert values(spark, lambda c: tx.text_cell(c, "empty"), " a ", "NaN", None) == ["a", "", ""]
    assert values(spark, tx.normal_value, " 1001.0 ", "ann  alpha") == ["1001", "ANN ALPHA"]
    assert values(spark, tx.is_blank, "   ", "\t", None, "x") == [True, True, True, False]
    assert values(spark, lambda c: tx.column_letter(c.cast("int")), "1", "26", "27", "52") == ["A", "Z", "AA", "AZ"]


def test_safe_cells_are_whole(spark):
    long = "\x01" + "x" * 40_000
    assert values(spark, tx.safe_cell, long, "a\x00b", None) == ["x" * 40_000, "ab", None]
    assert values(spark, lambda c: tx.safe_cell(c, tx.WORKBOOK_CELL), long, "\x01" + "x" * 32_767) == ["x" * 32_764 + "...", "x" * 32_767]


def test_addresses_and_labels(spark):
    a = tx.address_parts(F.array(F.lit("789 ELM STREET APT 2B"), F.lit("RIVERSIDE, CA 92501")))
    assert tuple(spark.range(1).select(a.alias("a")).first().a) == ("789 ELM STREET", "APT 2B", "RIVERSIDE", "CA", "92501")
    assert values(spark, tx.looks_like_address, "12 Oak St", "PO Box 9", "Dover, DE 19901-4412", "Dana Mroz") == [True, True, True, False]
    assert values(spark, lambda c: tx.label_value(c, "NAME", ("SSN",)), "NAME: Ann Alpha SSN: 1", "FUND: x\nNAME: Bob", "none") == ["Ann Alpha", "Bob", ""]


def test_whole_blocks_against_all_capacities(spark):
    rng = random.Random(9)
    for limit in (50, 200, 600):
        sizes = [rng.randint(0, 500) for _ in range(30)]
        df = spark.createDataFrame(list(enumerate(sizes)), "k int, n long").withColumnRenamed("n", "size").repartition(3)
        got = sorted(tuple(r) for r in parts.whole_blocks(df, ["k"], "size", limit).select("k", "chunk", "first", "n", "part").collect())
        chunks = [(k, c + 1, c * limit, min(n - c * limit, limit)) for k, n in enumerate(sizes) for c in range(max(1, -(-n // limit)))]
        assert [r[:4] for r in got] == chunks

        def filled(capacity):
            out, load = [1], 0
            for i, (*_, n) in enumerate(chunks):
                if i and load + n > capacity:
                    out.append(out[-1] + 1)
                    load = 0
                elif i:
                    out.append(out[-1])
                load += n
            return out

        fewest = filled(limit)[-1]
        best = min(c for c in range(max(n for *_, n in chunks), limit + 1) if filled(c)[-1] <= fewest)
        assert [r[4] for r in got] == filled(best)


@pytest.mark.parametrize("text", ["123-45-6789", "Ann Alpha 987654321", "é1"])
def test_masks_leak_no_digit(spark, text):
    assert not any(ch.isdigit() for ch in values(spark, tx.mask_shape, text)[0])


def test_lists_tokens_and_counts(spark):
    assert [p and tuple(p) for p in values(spark, tx.pasted_pair, "a b\tc", "Ann, f1", "Bob  f 2", "lonely", "")] == [("a b", "c"), ("Ann", "f1"), ("Bob", "f 2"), None, None]
    word = F.struct(F.lit(0.0).alias("x0"), F.lit(30.0).alias("x1"), F.lit("Ann123-45-6789").alias("text"))
    got = spark.range(1).select(tx.split_glued(word).alias("w")).first().w
    assert [w.text for w in got] == ["Ann", "123-45-6789"] and got[0].x0 == 0 and got[0].x1 == got[1].x0 and got[1].x1 == pytest.approx(30)
    assert values(spark, tx.dash_counts, "a-b‐c-", "none") == [{"U+002D": 2, "U+2010": 1}, {}]
    assert tuple(values(spark, tx.ssn_shapes, "123-45-6789 123‐45‐6789 123456789")[0]) == (1, 2, 1)
    assert tuple(spark.range(1).select(tx.status_fields(F.lit("|| Ann  Lee"), F.lit("7-A1")).alias("s")).first().s) == ("|| Ann Lee", "7-A1")


def test_more_name_rules_and_shapes(spark):
    got = values(spark, tx.split_second_initial_name, "JOHN A VAN DYKE", "JOHN A", "ANN MARIE LEE", "", None)
    assert [tuple(g) for g in got] == [("VAN DYKE", "JOHN", "A", ""), ("A", "JOHN", "", ""), ("LEE", "ANN", "MARIE", ""), ("", "", "", ""), ("", "", "", "")]
    words = F.array(*[F.struct(F.lit(x).alias("x0"), F.lit(t).alias("text")) for x, t in ((120.0, "DYKE"), (10.0, "JOHN"), (40.0, "A"), (100.0, "VAN"), (200.0, "JR"))])
    row = spark.range(1).select(tx.split_name_by_columns(words, 100.0, 180.0).alias("a"), tx.split_name_by_columns(words, 100.0).alias("b")).first()
    assert tuple(row.a) == ("VAN DYKE", "JOHN", "A", "JR") and tuple(row.b) == ("VAN DYKE JR", "JOHN", "A", "")
    assert values(spark, tx.value_shape, "12 34", "-1,200.50", "12.", "O'Hara", "--", "", None) == ["id", "decimal", None, "name", None, None, None]
    assert values(spark, tx.pasted_pair, "a b\tc", "a b , c", " a   b c", "alone", "x,", None) == [("a b", "c"), ("a b", "c"), ("a", "b c"), None, None, None]


def test_schema_match_reports_narrow_columns(spark):
    from tabloom.sources import sinks

    df = spark.createDataFrame([("abc", "x"), (None, "long text")], "Name string, extra string")
    got = sinks.schema_match(df.columns, ["NAME", "Other"], {"NAME": 2}, sinks.text_lengths(df))
    assert got == {"map": {"Name": "NAME"}, "unmatched": ["extra"], "missing": ["Other"], "narrow": ["NAME"]}
    assert sinks.schema_match(df.columns, ["name"], {"name": 3}, sinks.text_lengths(df))["narrow"] == []


def test_repeated_headers_and_containment(spark):
    from tabloom.operators import headers, joins

    rows = [("f", "s", 1, ["note"]), ("f", "s", 2, ["Name", "Id"]), ("f", "s", 3, ["a", "1"]), ("f", "s", 4, ["NAME ", "id", ""]), ("f", "s", 5, [None, "2"])]
    grid = spark.createDataFrame(rows, "file string, sheet string, row_no int, cells array<string>").withColumn("header_row", F.lit(2))
    assert sorted(r.row_no for r in headers.without_repeated_headers(grid).collect()) == [3, 5]
    events = spark.createDataFrame([("p", i, t) for i, t in enumerate(["x", "open A", "y", "stop", "z", "open B", "open C", "w"])], "page string, y int, t string")
    got = joins.contained(events, ["page"], ["y"], F.col("t").startswith("open"), F.col("t") == "stop", F.substring("t", -1, 1)).collect()
    assert sorted((r.t, r.within) for r in got) == [("w", "C"), ("y", "A")]


def test_first_fit_lines_take_any_order(spark):
    from tabloom.operators import lines

    ys = F.array(*[F.lit(float(y)) for y in (10, 30, 13, 16, 28, 10)])
    assert spark.range(1).select(lines.first_fit_lines(ys, 5.0).alias("v")).first().v == [0, 1, 0, 2, 1, 0]
