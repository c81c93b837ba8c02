"""Values and segments carried to other grids, against the lookup of every target voxel; and what the plans shuffle."""

import numpy as np
from pyspark.sql import functions as F

from voxdose.operators import masks, registration

VOLUME = "study_id long, dims array<int>, ijk_to_ras array<double>"


def grids(spark):
    a = np.radians(25)
    turned = [3 * np.cos(a), -2 * np.sin(a), 0, 4.0, 3 * np.sin(a), 2 * np.cos(a), 0.3, -6.0, 0.1, 0, 4.0, 1.0, 0, 0, 0, 1]
    plain = [2.0, 0, 0, -3.0, 0, 2.5, 0, -8.0, 0, 0, 3.0, -2.0, 0, 0, 0, 1]
    volumes = lambda m, dims: spark.createDataFrame([(s, dims, [float(x) for x in m]) for s in (1, 2)], VOLUME)
    return volumes(turned, [17, 12, 9]), volumes(plain, [20, 23, 14])


def test_carried_like_looked_up(spark):
    source, target = grids(spark)
    rng = np.random.default_rng(4)
    rows = [(s, i, j, k, float(rng.integers(0, 9))) for s in (1, 2) for i, j, k in np.ndindex(17, 12, 9) if rng.random() < 0.4]
    voxels = spark.createDataFrame(rows, "study_id long, i int, j int, k int, value double")
    looked = masks.lattice_lookup(source, target).join(voxels, masks.AT).select("study_id", F.col("ti").alias("i"), F.col("tj").alias("j"), F.col("tk").alias("k"), "value")
    got = sorted(map(tuple, registration.resample_to_grid(voxels, source, target).collect()))
    assert got == sorted(map(tuple, looked.collect())) and len(got) > 1000
    segments = voxels.where("value < 6").select("study_id", F.when(F.col("value") < 3, "a").otherwise("b").alias("segment_id"), "i", "j", "k")
    looked = masks.lattice_lookup(source, target).join(segments, masks.AT).select("study_id", "segment_id", F.col("ti").alias("i"), F.col("tj").alias("j"), F.col("tk").alias("k"))
    assert sorted(map(tuple, masks.rasterize_segment(segments, source, target).collect())) == sorted(map(tuple, looked.collect()))


def test_nothing_is_generated_far_from_a_segment(spark):
    """A segment of one box on a grid of a million voxels."""
    grid = lambda n: spark.createDataFrame([(1, [n, n, n], [float(x) for x in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)])], VOLUME)
    segment = spark.range(64).select(F.lit(1).cast("bigint").alias("study_id"), F.lit("s").alias("segment_id"), (F.col("id") % 4 + 8).cast("int").alias("i"), (F.floor(F.col("id") / 4) % 4 + 8).cast("int").alias("j"), (F.floor(F.col("id") / 16) + 8).cast("int").alias("k"))
    boxes = masks.boxed(segment, F.lit(1.0), "segment_id")
    assert boxes.count() == 1
    df = masks.carried(boxes, grid(100), grid(100), "segment_id")
    assert df.count() == 64
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("MapInPandas") : plan.index("ObjectHashAggregate")]
    assert "hashpartitioning" not in above and "SortMergeJoin" not in above  # nothing is shuffled above the boxes


def test_no_voxels(spark):
    source, target = grids(spark)
    none = spark.createDataFrame([], "study_id long, i int, j int, k int, value double")
    assert registration.resample_to_grid(none, source, target).count() == 0
    flat = target.withColumn("dims", F.array(F.lit(0), F.lit(5), F.lit(5)))
    some = spark.createDataFrame([(1, 0, 0, 0, 1.0), (3, 0, 0, 0, 1.0)], "study_id long, i int, j int, k int, value double")
    assert registration.resample_to_grid(some, source, flat).count() == 0
