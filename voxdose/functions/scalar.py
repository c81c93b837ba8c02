"""Dosimetry formulas and affine geometry as column expressions.

A zero divisor gives NULL, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Isotopes with their conversion factors in J/GBq; half-life in hours where it is given.
ISOTOPES = {"Y-90": (49.67, 64.2), "Ho-166": (14.85, None)}
# Parameter, least and largest value.
RANGES = {
    "activity_mbq": (0.0, 10000.0),
    "lsf_percent": (0.0, 100.0),
    "conv_factor": (0.0, 100.0),
    "lung_mass_g": (0.0, 5000.0),
    "density_g_ml": (0.0, 10.0),
    "target_dose_gy": (0.0, 1000.0),
    "hours": (0.0, 200.0),
    "half_life_h": (0.1, 200.0),
}
REFERENCE_ACTIVITY, SLIDER_END = 1000.0, 10000.0


def over(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def voxel_volume_ml(spacing: Column) -> Column:
    return spacing[0] * spacing[1] * spacing[2] / 1000.0


def grid_size(dims: Column) -> Column:
    return dims[0].cast("bigint") * dims[1] * dims[2]


def shunted(activity: Column, lsf: Column) -> Column:
    return activity * (1.0 - lsf / 100.0)


def relative_factor(activity: Column, lsf: Column, conv: Column, v: Column, density: Column, liver_sum: Column) -> Column:
    """Dose per count: the grid's size cancels out of mean and total volume."""
    return over(shunted(activity, lsf) * conv, v * density * liver_sum)


def decayed(activity: Column, hours: Column, half_life: Column) -> Column:
    """Activity at treatment from activity at imaging."""
    return activity * F.pow(F.lit(2.0), over(hours, half_life))


def absolute_factor(hours: Column, half_life: Column, conv: Column, density: Column) -> Column:
    """Dose per Bq/mL: the image's mean cancels out."""
    return over(F.pow(F.lit(2.0), over(hours, half_life)) * conv, density * 1e6)


def segment_activity(volume_ml: Column, dose: Column, conv: Column, density: Column) -> Column:
    return over(volume_ml * dose, conv) * density


def lung_dose(activity: Column, lsf: Column, conv: Column, mass: Column) -> Column:
    return over(activity * lsf * 0.01 * conv, mass)


def placed(matrix: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """A point through a row-major 4x4 matrix."""
    return [matrix[4 * r] * x + matrix[4 * r + 1] * y + matrix[4 * r + 2] * z + matrix[4 * r + 3] for r in range(3)]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cells(x, y) -> list:
    """The sixteen entries of the product of two row-major 4x4 matrices, whose entries are columns or arrays."""
    return [x[4 * r] * y[c] + x[4 * r + 1] * y[4 + c] + x[4 * r + 2] * y[8 + c] + x[4 * r + 3] * y[12 + c] for r in range(4) for c in range(4)]


def product(a: Column, b: Column) -> Column:
    """Product of two row-major 4x4 matrices."""
    return bound(a, lambda x: bound(b, lambda y: F.array(*cells(x, y))))


def inverse(m: Column) -> Column:
    """Inverse of an affine 4x4 matrix; NULL entries where it has none."""

    def of(e: Column) -> Column:
        at = lambda r, c: e[4 * (r % 3) + c % 3]
        minor = lambda r, c: at(r + 1, c + 1) * at(r + 2, c + 2) - at(r + 1, c + 2) * at(r + 2, c + 1)

        def with_det(det: Column) -> Column:
            rows = []
            for r in range(3):
                turn = [over(minor(c, r), det) for c in range(3)]
                rows += [*turn, -(turn[0] * e[3] + turn[1] * e[7] + turn[2] * e[11])]
            return F.array(*rows, *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])

        return bound(at(0, 0) * minor(0, 0) + at(0, 1) * minor(0, 1) + at(0, 2) * minor(0, 2), with_det)

    return bound(m, of)


def nearest(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")
