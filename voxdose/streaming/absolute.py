"""The absolute dose map on a stream of calibrated voxels.

Its closed form has no state: each micro-batch is a projection with one row of parameters a study.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.dosimetry import dose_map_absolute


def dose_stream(voxels: DataFrame, params: DataFrame) -> DataFrame:
    """Doses of a streaming table of voxels (study_id, i, j, k, value)."""
    return dose_map_absolute(voxels, params)


def write_dose_stream(doses: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return doses.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
