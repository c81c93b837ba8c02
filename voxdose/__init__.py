"""Cohort-scale voxel dosimetry as Spark DataFrame operators."""
