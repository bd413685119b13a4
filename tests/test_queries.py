"""Every registered query with an oracle against DuckDB on the smallest tables; entry() and imports."""

import os

import duckdb
import pytest

from spanloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        return "NULL" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF), duck.execute(catalog.ORACLES[name])
    assert plain(got.columns, got.collect()) == plain([d[0] for d in want.description], want.fetchall())


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_core_does_not_import_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "spanloom"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"spanloom\.llm|from \.+llm", p.read_text())]
