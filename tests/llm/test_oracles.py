import duckdb
import pytest

from postresp.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op7_near_duplicates", "op10_quality_rules", "op11_collocations"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    res = con.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    expected = sorted(tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in res.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in sorted(names)) for r in df.collect()) == expected
