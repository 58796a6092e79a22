"""Driver contract: entry, queries/oracle wiring, oracle agreement on small data."""
import os

import duckdb
import pytest

from tests.conftest import SF_SMALL

import __spark_entry__ as E

FAST_ORACLE = ["a1_posts", "c8_strip", "c10_content_tokens", "c11_plain_words", "c15_clean_posts",
               "e1_cut_points", "e2_label_counts", "b3_row_number", "f1_folds", "f2_f3_splits",
               "j3_mcc", "k3_anova"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"target", "label", "n"}


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return repr(v)


@pytest.mark.parametrize("name", FAST_ORACLE)
def test_oracle_agreement(spark, name):
    con = duckdb.connect()
    for t in ("documents", "orders", "lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    cols = df.columns
    s = sorted(tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in res.description]
    idx = [dcols.index(c) for c in sorted(cols)]
    d = sorted(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert sorted(cols) == sorted(dcols) and s == d
