"""Every registered query of the core library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from fieldglass.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = [tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in (r[i] for i in order)) for r in rows]
    return sorted(columns), sorted(shown)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    theirs = duck.execute(ORACLES[name])
    assert _rows(ours.columns, ours.collect()) == _rows([d[0] for d in theirs.description], theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
