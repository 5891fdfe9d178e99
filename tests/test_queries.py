"""Every registered query against its SQL; a query that is empty on the smallest tables is compared on larger ones."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES = {n: f for m in entry.MODULES if ".llm" not in m.__name__ for n, f in m.QUERIES.items()}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return {d: duck(d) for d in (SF, LARGER)}


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_equals_sql(spark, con, name):
    said = difference(spark, con[SF], SF, QUERIES[name], SQL[name])
    if said == "empty":
        said = difference(spark, con[LARGER], LARGER, QUERIES[name], SQL[name])
    assert said == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and (df.count() or QUERIES[name](spark, LARGER).count()) > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["entity_id", "field_name", "sequence", "value"]


def test_nothing_imports_llm():
    import os
    import re

    root = os.path.dirname(entry.__file__)
    for folder, _, files in os.walk(os.path.join(root, "ledgerline")):
        for f in files:
            if f.endswith(".py") and "llm" not in folder:
                assert not re.search(r"import.*\bllm\b|ledgerline\.llm", open(os.path.join(folder, f)).read())
