"""Rounding and weights as the DuckDB twins have them."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from lexlake.operators import fusion
from lexlake.plans import registry

#: Halves at three digits after a division, those that a product makes exact and those that it doesn't; 130232.5 / 1000 is one that differed.
PRICES = [130232.5, *(n + 0.5 for n in range(100_000, 140_000))]


def test_views_round_as_duckdb(spark):
    t = pd.DataFrame({"o_totalprice": PRICES})
    sql = "SELECT o_totalprice, round(o_totalprice / 1000, 3) AS y FROM {t}"
    expected = duckdb.sql(sql.replace("{t}", "t")).df().sort_values("o_totalprice")["y"].tolist()
    found = spark.sql(registry._rounded(sql), t=spark.createDataFrame(t)).orderBy("o_totalprice").toPandas()["y"].tolist()
    assert found == expected


def test_tidy_rounds_as_duckdb(spark):
    t = pd.DataFrame({"x": [*(n / 1e6 + 5e-7 for n in range(20_000)), -2.5e-6, 1e308, 0.0]})
    expected = duckdb.sql("SELECT x, round(x, 6) AS y FROM t").df().sort_values("x")["y"].tolist()
    found = registry.tidy(spark.createDataFrame(t).withColumn("y", F.col("x")).select(F.struct("x").alias("k"), "y")).orderBy("k").toPandas()["y"].tolist()
    assert found == expected


def test_hybrid_weights_are_those_of_the_twin(spark):
    rows = [(0, 0.5, 3.0), (0, 0.1, 1.0), (0, 0.2, 2.3)]
    got = fusion.hybrid_order(spark.createDataFrame(rows, "query_id int, rerank_score double, bm25_score double"), 0.7, 0.3).collect()
    assert sorted(r.hybrid_score for r in got) == sorted(0.7 * a + 0.3 * ((b - 1.0) / 2.0) for _, a, b in rows)
