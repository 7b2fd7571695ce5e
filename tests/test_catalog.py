import duckdb
import pytest

import __spark_entry__ as entry
from leakloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [*catalog.queries()])
def test_query_against_its_oracle(spark, small, duck, name):
    df = catalog.queries()[name](spark, small)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if sql := catalog.oracle_sql().get(name):
        result = duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({sql})")
        assert canonical(rows) == canonical(result.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
