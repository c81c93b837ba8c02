"""Dose maps, segment statistics, and the activity that reaches a target dose.

No dose map is needed for a statistic: mean(c * x) is c * sum(x) / n, so one aggregate over
masked voxels serves all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .masks import AT, mask_volume, masked_sums, segment_of, small


def isotope_factor(studies: DataFrame) -> DataFrame:
    """conv_factor and half_life_h of each study's isotope; NULL for one that is not listed."""
    rows = [(k, c, h) for k, (c, h) in S.ISOTOPES.items()]
    known = studies.sparkSession.createDataFrame(rows, "isotope string, conv_factor double, half_life_h double")
    return studies.join(F.broadcast(known), "isotope", "left")


def liver_sums(voxels: DataFrame, segment_voxels: DataFrame, params: DataFrame) -> DataFrame:
    liver = segment_of(segment_voxels, params, "liver")
    return mask_volume(voxels, liver).groupBy("study_id").agg(F.sum("value").alias("liver_sum"))


def relative_factors(volumes: DataFrame, params: DataFrame, sums: DataFrame) -> DataFrame:
    """factor: dose per count, and status, one row per study."""
    x = params.join(volumes.select("study_id", S.voxel_volume_ml(F.col("spacing")).alias("v_ml")), "study_id").join(sums, "study_id", "left")
    factor = S.relative_factor(*[F.col(c) for c in ("activity_mbq", "lsf_percent", "conv_factor", "v_ml", "density_g_ml", "liver_sum")])
    status = F.when(F.coalesce("liver_sum", F.lit(0.0)) == 0, "zero_signal").when(F.col("density_g_ml") == 0, "zero_density").when(factor.isNull(), "no_factor").otherwise("ok")
    return x.withColumn("factor", factor).withColumn("status", status)


def dose_map_relative(voxels: DataFrame, segment_voxels: DataFrame, volumes: DataFrame, params: DataFrame) -> DataFrame:
    """Dose of each voxel in the liver; all others are 0 and left out."""
    masked = mask_volume(voxels, segment_of(segment_voxels, params, "liver"))
    factors = relative_factors(volumes, params, masked.groupBy("study_id").agg(F.sum("value").alias("liver_sum")))
    return masked.join(small(factors.select("study_id", "factor"), params), "study_id").select(*AT, (F.col("value") * F.col("factor")).alias("dose"))


def _statistics(sums: DataFrame, factor: Column, v: Column) -> list[Column]:
    dose = factor * S.over(F.col("total"), F.col("n").cast("double"))
    volume = v * F.col("n")
    return [dose.alias("dose_gy"), volume.alias("volume_ml"), S.segment_activity(volume, dose, F.col("conv_factor"), F.col("density_g_ml")).alias("activity_mbq")]


def segment_stats_relative(segments: DataFrame, segment_voxels: DataFrame, voxels: DataFrame, volumes: DataFrame, params: DataFrame) -> DataFrame:
    """Mean dose, volume, activity per segment. Outside the liver is 0 Gy; an empty segment has NULL dose."""
    sums = masked_sums(segments, segment_voxels, voxels, params)
    ids = sums.join(params.select("study_id", F.col("liver_segment_id").alias("_liver")), "study_id")
    liver = F.max(F.when(F.col("segment_id") == F.col("_liver"), F.col("total"))).over(Window.partitionBy("study_id"))  # the sums are made once
    x = relative_factors(volumes, params, ids.withColumn("liver_sum", liver)).where("segment_id IS NOT NULL")
    return x.select("study_id", "ord", "segment_id", "name", *_statistics(x, F.col("factor"), F.col("v_ml")), "status")


def absolute_factors(params: DataFrame) -> DataFrame:
    return params.withColumn("factor", S.absolute_factor(*[F.col(c) for c in ("hours", "half_life_h", "conv_factor", "density_g_ml")]))


def dose_map_absolute(voxels: DataFrame, params: DataFrame) -> DataFrame:
    """Dose of each calibrated voxel (Bq/mL): a projection, no mask, no shunt; it works on streams too."""
    return voxels.join(small(absolute_factors(params).select("study_id", "factor"), params), "study_id").withColumn("dose", F.col("value") * F.col("factor")).drop("factor")


def total_activity(sums: DataFrame, params: DataFrame) -> DataFrame:
    """total_mbq during imaging and decay_corrected_mbq, from study_id, total (sum of Bq/mL) and v_ml."""
    total = F.col("total") * F.col("v_ml") / 1e6
    x = sums.join(params.select("study_id", "hours", "half_life_h"), "study_id").withColumn("total_mbq", total)
    return x.select("study_id", "total_mbq", S.decayed(F.col("total_mbq"), F.col("hours"), F.col("half_life_h")).alias("decay_corrected_mbq"))


def activity_for_target(volumes: DataFrame, params: DataFrame, sums: DataFrame) -> DataFrame:
    """Activity that gives the target segment its target dose; 1000 MBq where that is 0.

    The dose is linear in the activity, so one mean at 1000 MBq is enough. ``sums`` are segment sums over the
    liver's voxels. A target without dose gives NULL and a status. The reported value ends where the slider does.
    """
    roles = sums.join(params.select("study_id", "liver_segment_id", "target_segment_id"), "study_id")
    per = roles.groupBy("study_id").agg(
        F.sum(F.when(F.col("segment_id") == F.col("liver_segment_id"), F.col("total"))).alias("liver_sum"),
        F.sum(F.when(F.col("segment_id") == F.col("target_segment_id"), F.col("total"))).alias("target_sum"),
        F.sum(F.when(F.col("segment_id") == F.col("target_segment_id"), F.col("n"))).alias("target_n"),
    )
    at = relative_factors(volumes, params.withColumn("activity_mbq", F.lit(S.REFERENCE_ACTIVITY)), per)
    mean = F.col("factor") * S.over(F.col("target_sum"), F.col("target_n").cast("double"))
    needed = F.when(F.col("target_dose_gy") > 0, S.over(F.col("target_dose_gy"), mean) * S.REFERENCE_ACTIVITY).otherwise(S.REFERENCE_ACTIVITY)
    x = at.withColumn("dose_at_1000_gy", mean).withColumn("activity_mbq", needed)
    status = F.when(F.col("activity_mbq").isNull(), F.when(F.col("status") != "ok", F.col("status")).otherwise("no_target_dose")).otherwise("ok")
    return x.select("study_id", "dose_at_1000_gy", "activity_mbq", F.least("activity_mbq", F.lit(S.SLIDER_END)).alias("activity_reported_mbq"), status.alias("status"))
