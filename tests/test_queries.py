"""Every query with SQL gives the rows of that SQL; the others run."""

import pytest
from conftest import alike

from tabloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    if name not in registry.oracle_sql():
        assert found.count() > 0
        return
    order, expected = duck(registry.oracle_sql()[name], SF)
    assert sorted(found.columns) == order
    assert alike(found.select(*order).collect()) == alike(expected)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_tin_type_ladder_reads_every_document(spark):
    import re

    sf = "/root/testdata/sf0.1"
    found = {r.doc_id: r.kind for r in registry.queries()["tin_type_ladder"](spark, sf).collect()}
    ids = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    assert max(ids) >= 9000 and set(found) == set(ids)
    for i in ids:
        text = f"no {100 + i % 900}{('-12-', '-', ' ')[i % 3]}{1000 + i % 9000}.{10 + i % 80}-{1000000 + i % 9000000}"
        ssn, ein = (re.search(rf"(?<!\d){x}(?!\d)", text) for x in (r"\d{3}-\d{2}-\d{4}", r"\d{2}-\d{7}"))
        assert found[i] == ("SSN" if ssn else "EIN" if ein else None)


def test_safe_names_and_cells_of_long_texts(spark, duck, tmp_path):
    texts = [(3, "x" * 32_768, "s"), (7, "y" * 50_000, "s"), (11, None, "s"), (4, "z" * 40_000, "s")]
    spark.createDataFrame(texts, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    name = "safe_names_and_cells"
    order, expected = duck(registry.oracle_sql()[name], str(tmp_path))
    assert alike(registry.queries()[name](spark, str(tmp_path)).select(*order).collect()) == alike(expected)
