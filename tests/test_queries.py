"""Every registered query of the engine against its DuckDB counterpart, as the driver compares them."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from umbra.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(frame, columns):
    def plain(v):
        return "" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return Counter(tuple(plain(v) for v in row) for row in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_duckdb(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert _rows(got, columns) == _rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_rule_has_a_query():
    from umbra.plans import rulebook as book

    assert len(book.RULE_FAMILY) == 86
    assert all(f"rule_{r.name.replace('-', '_')}" in ORACLE for r in book.RULES)
