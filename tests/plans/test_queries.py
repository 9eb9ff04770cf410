import math

import duckdb
import pytest

from panelloom.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([r[i] for i in order] for r in rows), key=lambda r: [(x is None, round(x, 3) if isinstance(x, float) else x) for x in r])


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    rows = frame.collect()
    assert rows and len(set(frame.columns)) == len(frame.columns)
    if frame.columns == ["id", "cluster"]:
        assert len({r.id for r in rows}) == len(rows) and {r.cluster for r in rows} == set(range(max(r.cluster for r in rows) + 1))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    cursor = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    assert sorted(frame.columns) == sorted(columns)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)), (a, b)
