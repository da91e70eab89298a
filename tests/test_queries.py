import os

import duckdb
import pytest

from knotwork.queries import ORACLES, QUERIES

#: One of each kind; all of them run with ALL_QUERIES=1.
SOME = ["er_records", "er_truth", "addr_state_map", "leet_fix", "block_union", "rare_token_block", "retrieve_topk", "number_features", "expected_f05", "macro_f05", "write_grouped"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("ALL_QUERIES") else SOME)
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))
    assert order(df.select(columns).collect()) == order(duck.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
