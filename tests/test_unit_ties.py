"""Which of a unit's equally good chunks is its best."""

import duckdb
import pandas as pd
import pytest

from lexlake.plans import registry, retrieval

#: Orders of one query and one parent with the best score twice, in the order of the table; as text, the later one's key comes first.
ORDERS = [(99_851, 5000.0), (100_001, 5000.0), (151, 100.0), (249, 900.0), (549, 800.0), (849, 700.0)]


@pytest.mark.parametrize("name", ["score_threshold", "content_budget"])
def test_best_of_equal_chunks_is_the_first_of_the_table(spark, tmp_path, name):
    orders = pd.DataFrame([(k, 3, "O", p, pd.Timestamp("1995-01-01"), "5-LOW") for k, p in ORDERS], columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    orders.astype({"o_orderdate": "datetime64[us]"}).to_parquet(tmp_path / "orders.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = sorted(con.execute(registry.SQL[name]).fetchall())
    assert sorted(map(tuple, retrieval.__dict__[name](spark, str(tmp_path)).collect())) == want


def test_best_follows_the_column_named(spark):
    from lexlake.operators import fusion

    rows = spark.createDataFrame([(1, "c100", "p", 0.5, 100), (1, "c99", "p", 0.5, 99), (1, "c1", "p", 0.4, 1)], "query_id int, chunk_id string, parent_id string, ordering_score double, place int")
    best = lambda **named: [(r.best, r.members) for r in fusion.merge_parents(rows, **named).collect()]
    assert best() == [("c100", ["c100", "c99", "c1"])] and best(first="place") == [("c99", ["c100", "c99", "c1"])]
