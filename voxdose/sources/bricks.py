"""Voxels in storage form: bricks, one array per box of the grid, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def voxels_from_bricks(bricks: DataFrame, size: int = 4) -> DataFrame:
    """study_id, volume_id, i, j, k, value of every stored voxel. Arrays run k slowest, i fastest."""
    at = bricks.select("study_id", "volume_id", "bi", "bj", "bk", F.posexplode("values").alias("p", "value"))
    return at.select(
        "study_id",
        "volume_id",
        (F.col("bi") * size + F.col("p") % size).cast("int").alias("i"),
        (F.col("bj") * size + F.floor(F.col("p") / size) % size).cast("int").alias("j"),
        (F.col("bk") * size + F.floor(F.col("p") / (size * size))).cast("int").alias("k"),
        F.col("value").cast("double").alias("value"),
    )


def bricks_from_voxels(voxels: DataFrame, size: int = 4) -> DataFrame:
    """One row per box with voxels; absent voxels are 0. A box has size ** 3 voxels at most, so groups are bounded."""
    box = [F.floor(F.col(c) / size).cast("int").alias(f"b{c}") for c in "ijk"]
    place = (F.col("i") % size + size * (F.col("j") % size) + size * size * (F.col("k") % size)).cast("int")
    cells = voxels.select("study_id", "volume_id", *box, place.alias("p"), "value")
    held = cells.groupBy("study_id", "volume_id", "bi", "bj", "bk").agg(F.map_from_entries(F.collect_list(F.struct("p", "value"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(size**3 - 1)), lambda p: F.coalesce(F.col("m")[p], F.lit(0.0)).cast("float"))
    return held.select("study_id", "volume_id", "bi", "bj", "bk", values.alias("values"))


def write_voxels(voxels: DataFrame, path: str) -> None:
    voxels.write.partitionBy("study_id").parquet(path)


#: What voxel and segment tables are joined on.
PLACE = ("study_id", "i", "j", "k")


def write_copartitioned(df: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """A voxel or segment table stored in buckets of places, sorted within them, and read again.

    Tables of the same number of buckets are joined on places without a shuffle, so masks and segment sums of a stored cohort
    move only what they sum up. Choose buckets so that one fits in a task's memory: their number is fixed until the table is rewritten.
    """
    writer = df.repartition(buckets, *PLACE).write.format("parquet").mode("overwrite").bucketBy(buckets, *PLACE).sortBy(*PLACE)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)
