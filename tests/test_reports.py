"""The report sink: names, retries and failures."""

import pytest
from pyspark.sql import functions as F

from voxdose.operators import tables
from voxdose.sources import reports


def found(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file()}


def named(spark, names):
    x = spark.createDataFrame([(n, f"text of {n}\\line\n") for n in names], "name string, report string").repartition(3)
    return x.select(tables.report_path(F.col("name")).alias("path"), "report")


def test_names(spark, tmp_path):
    reports.write_named(named(spark, ["one", "two.RTF", "ward/three.rtf"]), str(tmp_path))
    assert found(tmp_path) == {"one.rtf": "text of one\\line\n", "two.RTF": "text of two.RTF\\line\n", "ward/three.rtf": "text of ward/three.rtf\\line\n"}
    reports.write_named(named(spark, ["one"]).withColumn("report", F.lit(None).cast("string")), f"file://{tmp_path}")
    assert found(tmp_path)["one.rtf"] == "" and not [p for p in tmp_path.iterdir() if p.name.startswith("_aside")]


def test_failed_job_leaves_nothing(spark, tmp_path):
    many = spark.range(40).select(F.concat(F.lit("study"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 33, F.raise_error(F.lit("no"))).otherwise("text").alias("report")).repartition(4)
    for rows in (many, named(spark, ["a", "b", "a"]), named(spark, ["a", "../b"]), spark.createDataFrame([("a", "x"), (None, "y")], "path string, report string")):
        with pytest.raises(Exception):
            reports.write_named(rows, str(tmp_path))
        assert found(tmp_path) == {}
