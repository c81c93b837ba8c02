"""Checks of inputs, of studies, and of parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import RANGES, grid_size, voxel_volume_ml

# Input labels by column.
LABELS = {"has_volume": "Input SPECT/PET Volume", "has_segmentation": "Segmentation", "has_liver": "Whole Liver Segment", "has_output": "Output Volume"}


# Labels of the absolute mode, and the one message of the other modes with the inputs that each needs.
LABELS_ABSOLUTE = {"has_volume": "Input PET Volume", "has_segmentation": "Segmentation", "has_output": "Output Volume"}
MESSAGES = {
    "shunt": (("has_volume", "has_segmentation"), "Please select valid input nodes."),
    "target": (("has_volume", "has_segmentation", "has_liver", "has_output"), "Please select valid input and output nodes, and ensure the liver segment is specified."),
    "registration": (("has_volume", "has_reference"), "Please select both SPECT CT and Reference CT volumes before registration."),
}


def mode_message(presence: DataFrame, mode: str) -> DataFrame:
    """The one message of a mode where any of its inputs is missing; else empty text."""
    needs, message = MESSAGES[mode]
    have = F.lit(True)
    for c in needs:
        have = have & F.coalesce(F.col(c), F.lit(False))
    return presence.select("study_id", F.lit(mode).alias("mode"), F.when(have, "").otherwise(message).alias("message"))


def missing_inputs(presence: DataFrame, labels: dict[str, str] | None = None, separator: str = ", ") -> DataFrame:
    """What each study lacks, from boolean columns; empty text where nothing is missing."""
    labels = labels or LABELS
    lacking = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(n)) for c, n in labels.items()]))
    return presence.select("study_id", F.array_join(lacking, separator).alias("missing"))


def presence(studies: DataFrame, volumes: DataFrame, segments: DataFrame, params: DataFrame) -> DataFrame:
    """Whether each study has an image, any segment, and the segment that is named as its liver."""
    have = lambda df, name: df.select("study_id").distinct().withColumn(name, F.lit(True))
    liver = segments.join(params.select("study_id", F.col("liver_segment_id").alias("segment_id")), ["study_id", "segment_id"])
    out = studies
    for df, name in ((volumes, "has_volume"), (segments, "has_segmentation"), (liver, "has_liver")):
        out = out.join(have(df, name), "study_id", "left")
    return out.select("study_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_volume", "has_segmentation", "has_liver")])


def study_status(studies: DataFrame, volumes: DataFrame, voxels: DataFrame, strict: bool = False) -> DataFrame:
    """ok, no_volume, zero_volume, or no_voxels; ``strict`` raises instead."""
    sized = volumes.select("study_id", (grid_size(F.col("dims")) * voxel_volume_ml(F.col("spacing"))).alias("total_ml"))
    counted = voxels.groupBy("study_id").agg(F.count("*").alias("stored"))
    x = studies.join(sized, "study_id", "left").join(counted, "study_id", "left")
    status = F.when(F.col("total_ml").isNull(), "no_volume").when(F.col("total_ml") <= 0, "zero_volume").when(F.col("stored").isNull(), "no_voxels").otherwise("ok")
    x = x.select("study_id", status.alias("status"))
    return x.withColumn("status", F.when(F.col("status") == "ok", "ok").otherwise(F.raise_error(F.concat(F.lit("study "), F.col("study_id").cast("string"), F.lit(": "), F.col("status"))))) if strict else x


def param_violations(params: DataFrame) -> DataFrame:
    """Names of the parameters outside their range, comma-joined."""
    own = [c for c in RANGES if c in params.columns]
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c).between(*RANGES[c]), F.lit(False)), F.lit(c)) for c in own]))
    return params.select("study_id", F.array_join(bad, ",").alias("violations"))
