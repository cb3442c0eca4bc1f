import duckdb
import pytest

from graphloom.llm import op3, op7, op8, oracles

CASES = {"op3": (op3.op3_substring_dedup, oracles.OP3), "op7": (op7.op7_jaccard_join, oracles.OP7), "op8": (op8.op8_secret_scan, oracles.op8())}


@pytest.mark.parametrize("name", CASES)
def test_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    query, sql = CASES[name]
    df = query(spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(sql)
    assert sorted(c[0] for c in cur.description) == cols
    at = [[c[0] for c in cur.description].index(c) for c in cols]
    assert sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str) == sorted((tuple(r) for r in df.select(cols).collect()), key=str)
