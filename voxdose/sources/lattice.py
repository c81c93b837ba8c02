"""Adapters that read imaging tables out of the benchmark's star-schema tables.

``lineitem`` and ``supplier`` give a sparse count image per supplier on a 16 x 16 x 7 grid with
five segments; ``events`` gives a calibrated image per user; ``embeddings`` gives bricks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import spread

DIMS = (16, 16, 7)
NAMES = ("liver", "tumor", "lungs", "edge", "ghost")
PARAMS = {"activity_mbq": 1000.0, "lsf_percent": 10.0, "conv_factor": 49.67, "lung_mass_g": 1000.0, "density_g_ml": 1.05, "target_dose_gy": 120.0, "hours": 24.0, "half_life_h": 64.2}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def voxels(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    at = [F.col("l_suppkey").alias("study_id"), (F.col("l_partkey") % 16).cast("int").alias("i"), (F.col("l_orderkey") % 16).cast("int").alias("j"), (F.col("l_linenumber") - 1).cast("int").alias("k")]
    return x.groupBy(*at).agg(F.sum("l_quantity").alias("value")).withColumn("volume_id", F.lit("nm"))


def volumes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    sx = (F.lit(2) + F.col("s_nationkey") % 3).cast("double")
    zero, four, one = F.lit(0.0), F.lit(4.0), F.lit(1.0)
    ox = -(F.col("s_suppkey") % 5).cast("double")
    return s.select(
        F.col("s_suppkey").alias("study_id"),
        F.lit("nm").alias("volume_id"),
        F.lit("SPECT").alias("modality"),
        F.array(*map(F.lit, DIMS)).alias("dims"),
        F.array(sx, four, four).alias("spacing"),
        F.array(sx, zero, zero, ox, zero, four, zero, F.lit(2.0), zero, zero, four, F.lit(-3.0), zero, zero, zero, one).alias("ijk_to_ras"),
        F.col("s_name").alias("name"),
        F.create_map(F.lit("source"), F.lit("supplier")).alias("attributes"),
    )


def grid(spark: SparkSession, d: str) -> DataFrame:
    axis = lambda a: F.explode(F.sequence(F.lit(0), F.lit(DIMS[a] - 1)))
    x = spread(table(spark, d, "supplier").select(F.col("s_suppkey").alias("study_id"), axis(2).alias("k")), F.lit(DIMS[0] * DIMS[1]), "study_id", "k")
    return x.withColumn("i", axis(0)).withColumn("j", axis(1)).select("study_id", "i", "j", "k")


def segments(spark: SparkSession, d: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(n).alias("segment_id"), F.lit(n).alias("name"), F.lit(k + 1).alias("ord")) for k, n in enumerate(NAMES)])
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("study_id"), F.explode(each).alias("s")).select("study_id", "s.*")


def segment_voxels(spark: SparkSession, d: str) -> DataFrame:
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    di, dj, dk = i - 4 - F.col("study_id") % 3, j - 8, k - 3
    inside = {"liver": i <= 9, "tumor": di * di + dj * dj + dk * dk <= 9, "lungs": i >= 11, "edge": i.between(8, 12)}
    names = F.array(*[F.when(c, F.lit(n)) for n, c in inside.items()])
    return grid(spark, d).select("study_id", F.explode(names).alias("segment_id"), "i", "j", "k").where("segment_id IS NOT NULL")


def params(spark: SparkSession, d: str) -> DataFrame:
    ids = {"liver_segment_id": "liver", "lung_segment_id": "lungs", "target_segment_id": "tumor"}
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("study_id"), *[F.lit(v).alias(k) for k, v in (ids | PARAMS).items()])


def event_voxels(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events")
    return x.select(F.col("user_id").alias("study_id"), F.col("event_id").alias("i"), F.col("event_type").alias("segment_id"), F.col("value").alias("mbq_ml"))


def event_params(spark: SparkSession, d: str) -> DataFrame:
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).cast("double")
    hours = span / 3.6e9 * 0.2
    out = table(spark, d, "events").groupBy(F.col("user_id").alias("study_id")).agg(hours.alias("hours"), F.count("*").alias("n_grid"))
    return out.select("study_id", "hours", "n_grid", F.lit(64.2).alias("half_life_h"), F.lit(49.67).alias("conv_factor"), F.lit(1.05).alias("density_g_ml"), F.lit(0.064).alias("v"))


def bricks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").cast("bigint").alias("study_id"), F.lit("brick").alias("volume_id"), F.col("vec_id").cast("int").alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("bk"), F.col("embedding").alias("values"))
