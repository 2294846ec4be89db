import duckdb
import pytest

import __spark_entry__ as entry
from helixframe.plans import queries as own

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda x: None if x is None else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_equals_sql(spark, duck, name):
    df = own.QUERIES[name](spark, DATA)
    rel = duck.execute(own.SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(rel.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.SQL)))
def test_runs(spark, name):
    assert own.QUERIES[name](spark, DATA).columns


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
