import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "tolist"):
        return str(v.tolist())
    return f"{float(v):.5f}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op")))
def test_oracles(spark, engine, name):
    df = __spark_entry__.queries()[name](spark, SF)
    cursor = engine.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    theirs = sorted(tuple(str(plain(r[columns.index(c)])) for c in sorted(columns)) for r in cursor.fetchall())
    ours = sorted(tuple(str(plain(r[c])) for c in sorted(columns)) for r in df.collect())
    assert ours == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
