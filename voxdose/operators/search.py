"""Registration by a search of its own for each study: several starts, an image pyramid, and a step that halves when nothing improves.

A transform is given by ``NAMES`` about the centre of the fixed image: shifts in mm, tangents of half the turns about the three
axes, growth along the axes, shear. Rigid uses the first six, Affine all twelve. It takes points of the fixed image to
points of the moving one; its inverse, as a matrix, lays the moving volumes on the fixed one (``matrices``), through ``apply_linear_transform``, on all volumes of a study.

Starts: as it lies, centres laid on each other (``geometry_align``), centres of mass laid on each other, and each of these turned about each
axis both ways. All are scored on the coarsest level; the best ``keep`` go on. In each round a start tries staying, one step of each
parameter both ways, and the mix of all steps that improved in its last round. It goes where the mutual information, rounded, is highest (ties: the first
candidate); if that is where it is, its step halves; once that is below the level's least step, it drops out of the round's table. After the coarsest level each study's best start
goes on with finer ones. A step is in mm; turns, growth and shear are scaled so that they move the middle of the box's sides as far.

Places are sampled a little off the middle of their voxels (``dithered``). The levels are block means, so coarse rounds read a 64th or an 8th of the voxels; values are stored as bricks, looked up by one join per point and candidate.
Between rounds one row for each start is kept. A study without places, or without a moving volume, has no row.

A study that one task can hold goes through all rounds of a level there; others, of any size, through tables. A table of studies looks small to Spark, which counts
neither its arrays nor what it is exploded into: joins with one have a merge hint, so that no parameters or matrices of all studies pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bound, cells, inverse, nearest, product
from ..sources.store import settled, stored
from . import gathered
from .gathered import POINT, VOXEL
from .masks import AT, bounds, sampled_values, small, volume_center
from .registration import MAPS, STATE, binned, mutual_information

NAMES = ("tx", "ty", "tz", "rx", "ry", "rz", "sx", "sy", "sz", "hxy", "hxz", "hyz")
#: Parameters of each method.
METHODS = {"Rigid": 6, "Affine": 12}
#: Rows of candidates, each with a matrix, up to which they are broadcast.
BROADCAST = 20_000
BRICK = 8
#: More than a start has candidates.
MOST = 100


class Plan(NamedTuple):
    """How to search: bins of the values, share of places sampled, levels, first and least step in mm, rounds of a level at most, starts kept, tangent of half the starts' turn."""

    width: float
    bins: int
    share: float = 0.002
    levels: tuple[int, ...] = (4, 2, 1)
    first: float = 16.0
    least: float = 0.5
    rounds: int = 16
    keep: int = 3
    turn: float = 0.1


def parameters_matrix(p: Column, center: Column) -> Column:
    """The row-major 4x4 matrix of twelve parameters about a centre: growth and shear, then turns about the first, second and third axis, then shifts."""
    turned = bound(F.array(*_halves(F.slice(p, 4, 3))), lambda x: F.array(*_turns(*[x[n] for n in range(6)])))
    return bound(bound(turned, lambda r: F.array(*_grown(r, p))), lambda a: F.array(*_about(a, p, center), *map(F.lit, (0.0, 0.0, 0.0, 1.0))))


def _halves(t) -> list:
    """Cosines and sines of the turns of which ``t`` are half the tangents; of columns or of arrays, as are the next three."""
    return [(1.0 - t[n] * t[n]) / (1.0 + t[n] * t[n]) for n in range(3)] + [2.0 * t[n] / (1.0 + t[n] * t[n]) for n in range(3)]


def _turns(c1, c2, c3, s1, s2, s3) -> list:
    return [c3 * c2, c3 * s2 * s1 - s3 * c1, c3 * s2 * c1 + s3 * s1, s3 * c2, s3 * s2 * s1 + c3 * c1, s3 * s2 * c1 - c3 * s1, -s2, c2 * s1, c2 * c1]


def _grown(r, p) -> list:
    rows = [(r[3 * n] * (1.0 + p[6]), r[3 * n] * p[9] + r[3 * n + 1] * (1.0 + p[7]), r[3 * n] * p[10] + r[3 * n + 1] * p[11] + r[3 * n + 2] * (1.0 + p[8])) for n in range(3)]
    return [x for row in rows for x in row]


def _about(a, p, center) -> list:
    rows = [(a[3 * n], a[3 * n + 1], a[3 * n + 2], center[n] + p[n] - (a[3 * n] * center[0] + a[3 * n + 1] * center[1] + a[3 * n + 2] * center[2])) for n in range(3)]
    return [x for row in rows for x in row]


def pyramid(voxels: DataFrame, volumes: DataFrame, factor: int) -> tuple[DataFrame, DataFrame]:
    """Voxels and volumes of a coarser level: means of blocks of factor ** 3 places (fewer at the far ends of the grid), absent voxels being 0; voxels beyond the grid are left out."""
    inside = voxels.select(*AT, "value").join(small(volumes.select("study_id", "dims"), volumes), "study_id").where(" AND ".join(f"{c} BETWEEN 0 AND dims[{a}] - 1" for a, c in enumerate("ijk")))
    if factor == 1:
        return inside.select(*AT, "value"), volumes
    at = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in "ijk"]
    held = lambda c, a: F.least(F.lit(factor), F.col("dims")[a] - F.floor(F.col(c) / factor).cast("int") * factor)
    sums = inside.select("study_id", *at, "value", (held("i", 0) * held("j", 1) * held("k", 2)).alias("n")).groupBy(*AT).agg(F.sum("value").alias("value"), F.first("n").alias("n"))
    m, back = F.col("ijk_to_ras"), (factor - 1) / 2
    cell = lambda n: m[n] * float(factor) if n % 4 < 3 and n < 12 else m[n] + (m[n - 3] + m[n - 2] + m[n - 1]) * back if n < 12 else m[n]
    coarse = volumes.withColumn("dims", F.transform("dims", lambda d: F.ceil(d / factor).cast("int"))).withColumn("ijk_to_ras", F.array(*[cell(n) for n in range(16)]))
    return sums.select(*AT, (F.col("value") / F.col("n")).alias("value")), coarse


def bricks(voxels: DataFrame, size: int = BRICK) -> DataFrame:
    """study_id, bi, bj, bk, values: boxes of the grid as arrays, i fastest; at most size ** 3 values in a group."""
    box = [F.floor(F.col(c) / size).cast("int").alias(f"b{c}") for c in "ijk"]
    inside = lambda c: F.pmod(c, F.lit(size))
    place = (inside("i") + size * inside("j") + size * size * inside("k")).cast("int")
    held = voxels.select("study_id", *box, F.struct(place.alias("p"), "value").alias("v")).groupBy("study_id", "bi", "bj", "bk").agg(F.map_from_entries(F.collect_list("v")).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(size**3 - 1)), lambda p: F.coalesce(F.col("m")[p], F.lit(0.0)))
    return held.select("study_id", "bi", "bj", "bk", values.alias("values"))


def scores(points: DataFrame, tried: DataFrame, n_tried: int, moving: DataFrame, plan: Plan, digits: int = 6) -> DataFrame:
    """mi, rounded, of each candidate (study_id, start, cand, m): m takes places of the fixed grid to places of the moving one, whose bricks give the values."""
    at = points.join(F.broadcast(tried) if n_tried <= BROADCAST else tried.hint("merge"), "study_id")
    m = F.col("m")
    place = [nearest(m[4 * r] * F.col("i") + m[4 * r + 1] * F.col("j") + m[4 * r + 2] * F.col("k") + m[4 * r + 3]) for r in range(3)]
    key = F.col("start") * MOST + F.col("cand")
    at = at.select("study_id", key.alias("cand"), "fbin", *[p.alias(f"m{c}") for p, c in zip(place, "ijk", strict=True)])
    box = [F.floor(F.col(f"m{c}") / BRICK).cast("int").alias(f"b{c}") for c in "ijk"]
    inside = (F.pmod("mi", F.lit(BRICK)) + BRICK * F.pmod("mj", F.lit(BRICK)) + BRICK * BRICK * F.pmod("mk", F.lit(BRICK))).cast("int")
    met = at.select("study_id", "cand", "fbin", *box, inside.alias("p")).join(moving.hint("merge"), ["study_id", "bi", "bj", "bk"], "left")
    found = mutual_information(met.select("study_id", "cand", "fbin", binned(F.coalesce(F.get("values", F.col("p")), F.lit(0.0)), plan.width, plan.bins).alias("mbin")))
    return found.select("study_id", F.floor(F.col("cand") / MOST).cast("int").alias("start"), (F.col("cand") % MOST).alias("cand"), F.round("mi", digits).alias("mi"))


def dithered() -> list[Column]:
    """i, j, k of a place, each moved by the sum of two even numbers from -0.5 to 0.5, made by arithmetic on the place.

    Nearest voxels then blur alike wherever the grids lie to each other. Without it the score peaks where two grids coincide, whatever their content.
    """
    mixed = F.col("i").cast("bigint") * 7919 + F.col("j").cast("bigint") * 104729 + F.col("k").cast("bigint") * 1299709 + F.pmod("study_id", F.lit(1_000_003)) * 15485863
    even = lambda m, n: F.pmod(mixed * m, F.lit(n)) - n // 2
    return [(F.col(c) + even(m, 1009) / 1009.0 + even(m + 90, 997) / 997.0).alias(c) for c, m in zip("ijk", (1, 331, 659), strict=True)]


def through(whole: DataFrame, level_fixed: DataFrame, level_moving: DataFrame) -> DataFrame:
    """study_id, center and reach (half the mean side) of the whole fixed box, to (places of a level's fixed grid to space), back (space to places of its moving grid)."""
    box = bounds(whole).select("study_id", F.zip_with("lo", "hi", lambda a, b: (a + b) / 2).alias("center"), ((F.col("hi")[0] - F.col("lo")[0] + F.col("hi")[1] - F.col("lo")[1] + F.col("hi")[2] - F.col("lo")[2]) / 6).alias("reach"))
    return box.join(level_fixed.select("study_id", F.col("ijk_to_ras").alias("to")).hint("merge"), "study_id").join(level_moving.select("study_id", inverse(F.col("ijk_to_ras")).alias("back")).hint("merge"), "study_id")


def _in_grids(p: Column) -> Column:
    return product(product(F.col("back"), parameters_matrix(p, F.col("center"))), F.col("to"))


def mass_center(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """study_id, mass: the centre of the values, in patient space."""
    total = F.sum("value")
    per = voxels.groupBy("study_id").agg(total.alias("n"), *[F.sum(F.col("value") * F.col(c)).alias(c) for c in "ijk"]).where("n > 0")
    x = per.join(volumes.select("study_id", "ijk_to_ras").hint("merge"), "study_id")
    m = F.col("ijk_to_ras")
    return x.select("study_id", F.array(*[m[4 * r] * (F.col("i") / F.col("n")) + m[4 * r + 1] * (F.col("j") / F.col("n")) + m[4 * r + 2] * (F.col("k") / F.col("n")) + m[4 * r + 3] for r in range(3)]).alias("mass"))


def starts(fixed: DataFrame, fixed_volumes: DataFrame, moving: DataFrame, moving_volumes: DataFrame, turn: float) -> DataFrame:
    """study_id, start, p: 21 starts, numbered placement by placement."""
    both = volume_center(fixed_volumes).select("study_id", F.col("center").alias("a")).join(volume_center(moving_volumes).select("study_id", F.col("center").alias("b")).hint("merge"), "study_id")
    both = both.join(mass_center(fixed, fixed_volumes).withColumnRenamed("mass", "ma").hint("merge"), "study_id", "left").join(mass_center(moving, moving_volumes).withColumnRenamed("mass", "mb").hint("merge"), "study_id", "left")
    less = lambda x, y: F.zip_with(x, y, lambda u, v: v - u)
    shift = F.array(F.array(*[F.lit(0.0)] * 3), less("a", "b"), F.coalesce(less("ma", "mb"), less("a", "b")))
    turns = [(0.0, 0.0, 0.0)] + [tuple(sign * turn if a == b else 0.0 for a in range(3)) for b in range(3) for sign in (1.0, -1.0)]
    turned = F.array(*[F.array(*map(F.lit, t)) for t in turns])
    each = both.select("study_id", F.posexplode(shift).alias("placement", "t")).select("study_id", "placement", "t", F.posexplode(turned).alias("n", "r"))
    return each.select("study_id", (F.col("placement") * len(turns) + F.col("n")).alias("start"), F.concat("t", "r", F.array(*[F.lit(0.0)] * 6)).alias("p"))


def _moves(n: int) -> Column:
    """The candidates' directions: none, each of n parameters up and down, the mix that improved last."""
    rows = [[0.0] * 12] + [[sign * (m == k) for m in range(12)] for k in range(n) for sign in (1.0, -1.0)]
    return F.concat(F.array(*[F.array(*map(F.lit, map(float, r))) for r in rows]), F.array("pull"))


def next_state(state: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """State (study_id, start, p, step, pull, unit) after a round's scores."""
    per = found.groupBy("study_id", "start").agg(F.max_by("cand", F.struct("mi", -F.col("cand"))).alias("best"), F.max("mi").alias("mi"), F.map_from_entries(F.collect_list(F.struct("cand", "mi"))).alias("of"))  # 2 n + 2 candidates
    x = state.drop("mi").join(per.hint("merge"), ["study_id", "start"])
    of = lambda c: F.col("of")[c]
    pull = [F.when((of(2 * k + 1) > of(0)) & (of(2 * k + 1) >= of(2 * k + 2)), 1.0).when(of(2 * k + 2) > of(0), -1.0).otherwise(0.0) for k in range(n)] + [F.lit(0.0)] * (12 - n)
    went = F.zip_with(F.get(_moves(n), F.col("best")), "unit", lambda d, u: d * u)
    return x.select("study_id", "start", F.zip_with("p", went, lambda a, d: a + d * F.col("step")).alias("p"), F.when(F.col("best") == 0, F.col("step") / 2).otherwise(F.col("step")).alias("step"), F.array(*pull).alias("pull"), "unit", "mi")


def search(fixed: DataFrame, fixed_volumes: DataFrame, moving: DataFrame, moving_volumes: DataFrame, plan: Plan, method: str = "Rigid", most: int = gathered.WHOLE) -> DataFrame:
    """study_id, method, p (``NAMES``), mi, fit (mi over the fixed image's entropy, 0 to 1) of each study's best transform.

    Studies whose grids have at most ``most`` places are searched by one task each; others, and those with odd volumes, through tables.
    """
    return settled(fixed.sparkSession, lambda: _search(fixed, fixed_volumes, moving, moving_volumes, plan, method, most))


def _level(fixed: DataFrame, fixed_volumes: DataFrame, moving: DataFrame, moving_volumes: DataFrame, plan: Plan, factor: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points (with fbin), moving voxels, and what maps them, of one level."""
    f, fv = pyramid(fixed, fixed_volumes, factor)
    m, mv = pyramid(moving, moving_volumes, factor)
    points = sampled_values(fv, f, min(1.0, plan.share * factor**3)).select("study_id", *dithered(), binned(F.col("value"), plan.width, plan.bins).alias("fbin"))
    return points, m, through(fixed_volumes, fv, mv)


def _tried(state: DataFrame, maps: DataFrame, n: int) -> DataFrame:
    each = state.select("study_id", "start", "p", "step", "unit", F.posexplode(_moves(n)).alias("cand", "d"))
    each = each.select("study_id", "start", "cand", F.zip_with("p", F.zip_with("d", "unit", lambda d, u: d * u), lambda a, d: a + d * F.col("step")).alias("p"))
    return each.join(maps.select("study_id", "center", "to", "back").hint("merge"), "study_id").select("study_id", "start", "cand", _in_grids(F.col("p")).alias("m"))


def _search(fixed: DataFrame, fixed_volumes: DataFrame, moving: DataFrame, moving_volumes: DataFrame, plan: Plan, method: str, most: int) -> DataFrame:
    if not plan.levels:
        raise ValueError("no levels")
    held = stored(gathered.held_by_one(fixed_volumes, moving_volumes, most))
    tables, n = (fixed, fixed_volumes, moving, moving_volumes), held.count()
    if not n:
        return _search_tables(*tables, plan, method)
    paired = fixed_volumes.select("study_id").distinct().join(moving_volumes.select("study_id").hint("merge"), "study_id", "left_semi")
    if paired.count() == n:
        return _search_whole(*tables, plan, method)
    cut = lambda how: [x.join(small(held) if voxels else held.hint("merge"), "study_id", how) for x, voxels in zip(tables, (True, False, True, False), strict=True)]
    return _search_whole(*cut("left_semi"), plan, method).unionByName(_search_tables(*cut("left_anti"), plan, method))


def _rounds(plan: Plan, factor: int, n: int, first: bool):
    """The rounds of a level, for studies gathered with their starts (``STATE``: start, step, mi, p) and ``MAPS``: center, reach, to, back."""
    moves = np.concatenate([np.zeros((1, 12)), *[sign * np.eye(12)[k : k + 1] for k in range(n) for sign in (1.0, -1.0)]])

    def of_studies(x: gathered.Some, maps: np.ndarray, state: np.ndarray) -> np.ndarray:
        """start, step, mi, p of each study's starts, and the entropy of its fixed image; arrays of studies, starts and numbers."""
        center, reach, to, back = (list(maps[:, lo:hi].T[:, :, None]) for lo, hi in ((0, 3), (3, 4), (4, 20), (20, 36)))

        def scores(p: np.ndarray) -> np.ndarray:
            """mi, rounded, of candidates of twelve parameters."""
            cands, p = p.shape[1], list(np.moveaxis(p, 2, 0))
            a = [*_about(_grown(_turns(*_halves(p[3:6])), p), p, center), 0.0, 0.0, 0.0, 1.0]
            m = [c[:, :, None] for c in cells(cells(back, a), to)[:12]]

            def near(some: slice) -> list[np.ndarray]:
                i, j, k = (c[:, None, some] for c in x.points)
                return [m[4 * r] * i + m[4 * r + 1] * j + m[4 * r + 2] * k + m[4 * r + 3] for r in range(3)]

            return gathered.rounded(x.informed(cands, near))

        def best_of(number: int, *of: np.ndarray) -> list[np.ndarray]:
            best = np.lexsort((start, -mi), axis=1)[:, :number]
            return [np.take_along_axis(c, best if c.ndim == 2 else best[:, :, None], axis=1) for c in of]

        start, step, mi, p = state[:, :, 0], state[:, :, 1], state[:, :, 2], state[:, :, 3:15]
        if first:
            mi = scores(p)
            start, mi, p = best_of(plan.keep, start, mi, p)
            step = np.full(start.shape, plan.first)
        else:
            step = step * 2
        unit = np.concatenate([np.broadcast_to(c, (x.n, k)) for c, k in ((1.0, 3), (0.5 / reach[0], 3), (1.0 / reach[0], 6))], axis=1)[:, None, None]
        pull = np.zeros(p.shape)
        for _ in range(plan.rounds):
            live = step >= plan.least * factor
            if not live.any():
                break
            went = np.concatenate([np.broadcast_to(moves, (*start.shape, *moves.shape)), pull[:, :, None]], axis=2) * unit
            tried = p[:, :, None] + went * step[:, :, None, None]
            of = scores(tried.reshape(x.n, -1, 12)).reshape(*tried.shape[:3])
            best, up, down = of.argmax(axis=2), of[:, :, 1 : 2 * n + 1 : 2], of[:, :, 2 : 2 * n + 1 : 2]
            improved = np.where((up > of[:, :, :1]) & (up >= down), 1.0, np.where(down > of[:, :, :1], -1.0, 0.0))
            pull[:, :, :n] = np.where(live[:, :, None], improved, pull[:, :, :n])
            p = np.where(live[:, :, None], np.take_along_axis(tried, best[:, :, None, None], axis=2)[:, :, 0], p)
            mi, step = np.where(live, of.max(axis=2), mi), np.where(live & (best == 0), step / 2, step)
        if first:
            start, step, mi, p = best_of(1, start, step, mi, p)
        return np.concatenate([np.stack([start, step, mi], axis=2), p, np.broadcast_to(x.entropy()[:, None, None], (*start.shape, 1))], axis=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered.whole_studies(batches):
            for ids, found in gathered.searched(b, MAPS, STATE, min(0, plan.bins - 1), (21 if first else 1) * plan.bins * (plan.bins + 1), of_studies):
                some = np.repeat(np.arange(len(ids)), found.shape[1])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(list(found.reshape(-1, found.shape[2])), pa.list_(pa.float64()))], names=["study_id", "s"])

    return run


def _search_whole(fixed: DataFrame, fixed_volumes: DataFrame, moving: DataFrame, moving_volumes: DataFrame, plan: Plan, method: str) -> DataFrame:
    """The search of studies that one task can hold: a level's points, moving voxels and starts meet by one shuffle, and its rounds need no other."""
    state, kind = None, fixed_volumes.schema["study_id"].dataType.simpleString()
    for at, factor in enumerate(plan.levels):
        points, m, maps = _level(fixed, fixed_volumes, moving, moving_volumes, plan, factor)
        if state is None:
            begun = starts(fixed, fixed_volumes, moving, moving_volumes, plan.turn).select("study_id", F.concat(F.array(F.col("start").cast("double"), F.lit(0.0), F.lit(0.0)), "p").alias("s"))
        rows = [
            points.select(*gathered.row(POINT, F.col("fbin"), [F.col(c) for c in "ijk"])),
            m.select(*gathered.row(VOXEL, binned(F.coalesce("value", F.lit(0.0)), plan.width, plan.bins), [F.col(c) for c in "ijk"])),
            (begun if state is None else state).select(*gathered.row(STATE, s=F.col("s"))),
            maps.select(*gathered.row(MAPS, s=F.concat("center", F.array("reach"), "to", "back"))),
        ]
        rounds = _rounds(plan, factor, METHODS[method], at == 0)
        state = stored(gathered.by_study(reduce(DataFrame.unionByName, rows)).mapInArrow(rounds, f"study_id {kind}, s array<double>"))
    found = state.select("study_id", F.lit(method).alias("method"), F.slice("s", 4, 12).alias("p"), F.col("s")[2].alias("mi"), F.col("s")[15].alias("entropy"))
    return found.select("study_id", "method", "p", "mi", F.coalesce(F.try_divide("mi", "entropy"), F.lit(0.0)).alias("fit"))


def _search_tables(fixed: DataFrame, fixed_volumes: DataFrame, moving: DataFrame, moving_volumes: DataFrame, plan: Plan, method: str) -> DataFrame:
    """The search through tables, one row of points for each candidate: for studies of any size."""
    n, state = METHODS[method], None
    for at, factor in enumerate(plan.levels):
        points, m, maps = _level(fixed, fixed_volumes, moving, moving_volumes, plan, factor)
        points, values, maps = stored(points), stored(bricks(m)), stored(maps)
        if state is None:
            begun = stored(starts(fixed, fixed_volumes, moving, moving_volumes, plan.turn).join(maps.hint("merge"), "study_id").withColumn("cand", F.lit(0)))
            found = scores(points, begun.select("study_id", "start", "cand", _in_grids(F.col("p")).alias("m")), begun.count(), values, plan)
            rank = F.row_number().over(Window.partitionBy("study_id").orderBy(F.col("mi").desc(), "start"))
            best = found.withColumn("rank", rank).where(F.col("rank") <= plan.keep).select("study_id", "start", "mi")
            unit = F.concat(F.array(*[F.lit(1.0)] * 3), F.array(*[0.5 / F.col("reach")] * 3), F.array(*[1.0 / F.col("reach")] * 6))
            state = stored(begun.join(best.hint("merge"), ["study_id", "start"]).select("study_id", "start", "p", F.lit(plan.first).alias("step"), F.array(*[F.lit(0.0)] * 12).alias("pull"), unit.alias("unit"), "mi"))
        else:
            state = stored(state.withColumn("step", F.col("step") * 2).withColumn("pull", F.array(*[F.lit(0.0)] * 12)))
        going = F.col("step") >= plan.least * factor
        for _ in range(plan.rounds):
            live = state.where(going)
            rows = live.count()
            if not rows:
                break
            found = scores(points, _tried(live, maps, n), rows * (2 * n + 2), values, plan)
            state = stored(state.where(~going).unionByName(next_state(live, found, n)))
        if at == 0:
            best = Window.partitionBy("study_id").orderBy(F.col("mi").desc(), "start")
            state = stored(state.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank"))
    share = points.groupBy("study_id", "fbin").count().withColumn("q", F.col("count") / F.sum("count").over(Window.partitionBy("study_id")))
    entropy = share.groupBy("study_id").agg(F.sum(-F.col("q") * F.ln("q")).alias("entropy"))
    return state.join(entropy.hint("merge"), "study_id").select("study_id", F.lit(method).alias("method"), "p", "mi", F.coalesce(F.try_divide("mi", "entropy"), F.lit(0.0)).alias("fit"))


def matrices(found: DataFrame, fixed_volumes: DataFrame, least_fit: float = 0.0) -> DataFrame:
    """study_id, method, matrix: what lays the moving volumes on the fixed one; studies whose fit is below ``least_fit`` are refused and have no row."""
    x = found.where(F.col("fit") >= least_fit).join(volume_center(fixed_volumes).select("study_id", "center").hint("merge"), "study_id")
    return x.select("study_id", "method", inverse(parameters_matrix(F.col("p"), F.col("center"))).alias("matrix"))


def chained(transforms: DataFrame) -> DataFrame:
    """study_id, matrix: each study's transforms (study_id, ord, matrix) one after another, the lowest ``ord`` first; ``ord`` is a number of steps a person made."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("ord", "matrix"))), lambda s: s["matrix"])
    one = F.array(*[F.lit(float(n % 5 == 0)) for n in range(16)])
    return transforms.groupBy("study_id").agg(steps.alias("steps")).select("study_id", F.aggregate("steps", one, lambda acc, m: product(m, acc)).alias("matrix"))
