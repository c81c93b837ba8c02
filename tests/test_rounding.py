"""Numbers in reports are rounded as their SQL rounds them."""

import random

import duckdb
from compare import same
from pyspark.sql import functions as F

from voxdose.operators import tables
from voxdose.plans import oracle, queries


def test_binary_text(spark):
    """Ties and long numbers as printf writes them, without a Python worker."""
    draw = random.Random(1)
    values = [1.005, 112.345, -0.001, 0.0, 966499442287859.88, 2.0**53 - 1, 2.0**60 + 256, -4.5e13 - 0.996] + [draw.randrange(10**7) / 1000 for _ in range(2000)] + [draw.uniform(0, 10 ** draw.randrange(1, 16)) for _ in range(2000)]
    x = spark.createDataFrame([(v,) for v in values], "x double").select("x", tables.two_decimals(F.col("x"), binary=True).alias("text"), tables.two_decimals(F.col("x"), compat=True).alias("compat"))
    assert "Python" not in x._jdf.queryExecution().executedPlan().toString()
    assert all(r["text"] == r["compat"] == f"{r['x']:.2f}" for r in x.collect())
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(tables.two_decimals(F.col("x"), compat=True))
    assert [r[0] for r in odd.collect()] == ["nan", "inf", None]


def test_reports_round_as_their_sql(spark, tmp_path):
    """A copy of sf0.1 with shifted keys holds a study with an activity of 167.625, which printf rounds to even."""
    con = duckdb.connect()
    for name, shifted in (("supplier", "s_suppkey = 851"), ("lineitem", "l_suppkey = 851")):
        con.execute(f"COPY (SELECT *{' REPLACE (l_partkey + 7 AS l_partkey)' if name == 'lineitem' else ''} FROM '/root/testdata/sf0.1/{name}.parquet' WHERE {shifted}) TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    for name in ("report_relative", "report_files", "report_relative_compat"):
        same(con, queries.queries()[name](spark, str(tmp_path)), oracle.oracle_sql()[name])
