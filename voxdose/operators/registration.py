"""Transforms, and registration scored by mutual information over candidates.

An absent voxel is 0, and so is what a transform brings in from outside the image.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scalar import inverse, nearest, placed, product
from ..sources.store import settled, spread, stored
from . import gathered
from .gathered import POINT, VOXEL
from .masks import AT, BROADCAST, boxed, carried, sampled, small, volume_center

#: Parameters of a candidate: shifts in mm, tangents of half the turns about the three axes, and growth.
PARAMETERS = ("tx", "ty", "tz", "rx", "ry", "rz", "g")
#: Their steps in the first round; each round halves them.
STEPS = (4.0, 4.0, 4.0, 0.08, 0.08, 0.08, 0.1)
#: Side of the boxes of cells that points of a spline are dealt by, and of the control points that move places in one.
CELLS = 8
NEAR = CELLS + 3
#: Side of the bricks that moving voxels are looked up in.
BRICK = 8
#: Most lookups of a study in a round for which its joint histogram is made in one task.
WHOLE = 10_000_000
#: Kinds of further rows of a gathered study: where a search is, and what maps its grids.
STATE, MAPS = 2, 3


def apply_linear_transform(volumes: DataFrame, transforms: DataFrame) -> DataFrame:
    """Bake each study's 4x4 matrix into its volumes' geometry; volumes of studies without one stay as they are."""
    x = volumes.join(transforms.select("study_id", "matrix").hint("merge"), "study_id", "left")  # matrices look small to Spark, which would send all through the driver
    return x.withColumn("ijk_to_ras", F.when(F.col("matrix").isNotNull(), product(F.col("matrix"), F.col("ijk_to_ras"))).otherwise(F.col("ijk_to_ras"))).drop("matrix")


def geometry_align(fixed: DataFrame, moving: DataFrame) -> DataFrame:
    """The shift that lays the centre of the moving volume on that of the fixed one."""
    a, b = volume_center(fixed).select("study_id", F.col("center").alias("a")), volume_center(moving).select("study_id", F.col("center").alias("b"))
    return a.join(b, "study_id").select("study_id", F.zip_with("a", "b", lambda x, y: x - y).alias("shift"))


def resample_to_grid(voxels: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Values on another grid, each from the nearest source voxel."""
    return carried(boxed(voxels, F.col("value")), source, target)


def _weights(u):
    """The four weights along an axis, of columns or of arrays."""
    return [(1 - u) * (1 - u) * (1 - u) / 6, (3 * u * u * u - 6 * u * u + 4) / 6, (-3 * u * u * u + 3 * u * u + 3 * u + 1) / 6, u * u * u / 6]


def _bent(kept: list[str]):
    """Displacements of the points of each box, whose control points come before them; some rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, near = None, np.zeros((3, NEAR**3))  # of the box that the last rows ended in
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                keys = [b.column(c).to_numpy(zero_copy_only=False) for c in ("study_id", "bx", "by", "bz")]
                new = np.any([np.concatenate([[key is None or k[0] != key[n]], k[1:] != k[:-1]]) for n, k in enumerate(keys)], axis=0)
                box, key = np.cumsum(new), [k[-1] for k in keys]
                p, d = b.column("p").to_numpy(), [b.column(c).to_numpy() for c in ("a", "b", "c")]
                control, size = p >= 0, (box[-1] + 1) * NEAR**3
                listed = np.stack([np.bincount(box[control] * NEAR**3 + p[control], x[control], size) for x in d], dtype=float)
                listed[:, : NEAR**3] += near
                near = listed[:, -(NEAR**3) :].copy()
                cell = -1 - p[~control]
                lost = cell == CELLS**3
                cell[lost] = 0
                at = box[~control] * NEAR**3 + cell % CELLS + NEAR * (cell // CELLS % CELLS) + NEAR**2 * (cell // CELLS**2)
                w, moved = [_weights(x[~control]) for x in d], np.zeros((3, len(at)))
                for s in range(64):
                    t = (s % 4, s // 4 % 4, s // 16)
                    weight, place = w[0][t[0]] * w[1][t[1]] * w[2][t[2]], at + (t[0] + NEAR * t[1] + NEAR**2 * t[2])
                    for n in range(3):
                        moved[n] += weight * listed[n][place]
                moved[:, lost] = 0.0
                points = b.filter(pa.array(~control))
                yield pa.RecordBatch.from_arrays([*[points.column(c) for c in kept], *map(pa.array, moved)], names=[*kept, "dx", "dy", "dz"])

    return run


def apply_bspline(points: DataFrame, grid: DataFrame, control: DataFrame, *keep: str) -> DataFrame:
    """Displacement (dx, dy, dz) of each point (study_id, i, j, k, x, y, z) under a cubic B-spline grid.

    Points and control points are dealt by boxes of ``CELLS`` ** 3 cells. A control point moves places in 64 cells, but is sent
    to the one to eight boxes that hold them; those of a box, at most ``NEAR`` ** 3 places, are held while its points pass in batches. ``keep``
    names columns of the points to carry along. Control points that are not listed, and those beyond the border, count as 0, as do points without a place.
    """
    x = points.join(small(grid.select("study_id", "origin", "spacing")), "study_id")
    for a, c in enumerate("xyz"):
        u = (F.col(c) - F.col("origin")[a]) / F.col("spacing")[a]
        x = x.withColumn(f"n{c}", F.floor(u).cast("int")).withColumn(f"u{c}", u - F.floor(u))
    box = [F.floor(F.col(f"n{c}") / CELLS).cast("int") for c in "xyz"]
    cell = sum((F.pmod(f"n{c}", F.lit(CELLS)) * CELLS**a for a, c in enumerate("xyz")), F.lit(0)).cast("int")
    x = x.select(*AT, *keep, *[F.coalesce(v, F.lit(0)).alias(f"b{c}") for v, c in zip(box, "xyz", strict=True)], (-1 - F.coalesce(cell, F.lit(CELLS**3))).alias("p"), *[F.coalesce(f"u{m}", F.lit(0.0)).alias(d) for m, d in zip("xyz", "abc", strict=True)])
    each = control.where(" AND ".join(f"{c} IS NOT NULL" for c in ("study_id", "ci", "cj", "ck")))
    for m, c in zip("xyz", ("ci", "cj", "ck"), strict=True):  # moves the cells c - 2 to c + 1
        each = each.withColumn(f"b{m}", F.explode(F.sequence(F.floor((F.col(c) - 2) / CELLS).cast("int"), F.floor((F.col(c) + 1) / CELLS).cast("int"))))
    place = sum(((F.col(c) - CELLS * F.col(f"b{m}") + 1) * NEAR**a for a, (m, c) in enumerate(zip("xyz", ("ci", "cj", "ck"), strict=True))), F.lit(0)).cast("int")
    each = each.select("study_id", "bx", "by", "bz", place.alias("p"), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(d) for v, d in zip(("dx", "dy", "dz"), "abc", strict=True)])
    key = ["study_id", "bx", "by", "bz"]
    met = x.unionByName(each, allowMissingColumns=True).repartition(*key).sortWithinPartitions(*key, F.desc("p"))
    kept = [*AT, *keep]
    schema = StructType([*[StructField(c, x.schema[c].dataType) for c in kept], *[StructField(d, DoubleType()) for d in ("dx", "dy", "dz")]])
    return met.mapInArrow(_bent(kept), schema)


def lattice_points(volumes: DataFrame) -> DataFrame:
    """Every voxel of each volume's grid with its centre (x, y, z) in patient space."""
    axis = lambda a: F.explode(F.when(F.col("dims")[a] > 0, F.sequence(F.lit(0), F.col("dims")[a] - 1)))
    slabs = spread(volumes.select("study_id", "dims", "ijk_to_ras", axis(2).alias("k")), F.col("dims")[0].cast("bigint") * F.col("dims")[1], "study_id", "k")
    g = slabs.withColumn("i", axis(0)).withColumn("j", axis(1))
    return g.select(*AT, *[p.alias(n) for p, n in zip(placed(F.col("ijk_to_ras"), F.col("i"), F.col("j"), F.col("k")), "xyz", strict=True)])


def looked_up(points: DataFrame, volumes: DataFrame, voxels: DataFrame, *keep: str) -> DataFrame:
    """``value`` of the voxel nearest to each point (study_id, x, y, z); 0 where there is none."""
    back = volumes.select("study_id", inverse(F.col("ijk_to_ras")).alias("_m"))
    at = points.join(small(back, volumes), "study_id")
    at = at.select("study_id", *keep, *[nearest(p).alias(f"_{c}") for p, c in zip(placed(F.col("_m"), F.col("x"), F.col("y"), F.col("z")), "ijk", strict=True)])
    source = voxels.select("study_id", *[F.col(c).alias(f"_{c}") for c in "ijk"], "value")
    return at.join(source, ["study_id", "_i", "_j", "_k"], "left").select("study_id", *keep, F.coalesce("value", F.lit(0.0)).alias("value"))


def harden_bspline(voxels: DataFrame, volumes: DataFrame, grid: DataFrame, control: DataFrame) -> DataFrame:
    """The voxels moved by a B-spline grid: each voxel takes the value at its centre plus the displacement there. Voxels of 0 are left out."""
    moved = apply_bspline(lattice_points(volumes), grid, control, "x", "y", "z").select(*AT, *[(F.col(c) + F.col(f"d{c}")).alias(c) for c in "xyz"])
    return looked_up(moved, volumes, voxels, "i", "j", "k").where("value <> 0").select(*AT, "value")


def apply_methods(volumes: DataFrame, voxels: DataFrame, transforms: DataFrame, grid: DataFrame, control: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each study by its method (study_id, method, matrix): Rigid and Affine move the geometry, BSpline the voxels, others nothing."""
    linear = transforms.where(F.col("method").isin("Rigid", "Affine"))
    bent = transforms.where(F.col("method") == "BSpline").select("study_id")
    of_bent = lambda df: df.join(small(bent, transforms), "study_id", "left_semi")
    moved = harden_bspline(of_bent(voxels), of_bent(volumes), grid, of_bent(control))
    rest = voxels.join(small(bent, transforms), "study_id", "left_anti").select(*AT, "value")
    return apply_linear_transform(volumes, linear), rest.unionByName(moved)


def mutual_information(pairs: DataFrame) -> DataFrame:
    """mi per (study_id, cand) from rows (study_id, cand, fbin, mbin), through the joint histogram."""
    joint = pairs.groupBy("study_id", "cand", "fbin", "mbin").agg(F.count("*").cast("double").alias("n"))
    joint = joint.repartition("study_id", "cand")  # serves all three windows and the sum, which else are shuffled one by one
    over = lambda *c: F.sum("n").over(Window.partitionBy("study_id", "cand", *c))
    x = joint.select("study_id", "cand", "n", over("fbin").alias("nf"), over("mbin").alias("nm"), over().alias("t"))
    term = F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nf") * F.col("nm")))
    return x.groupBy("study_id", "cand").agg(F.sum(term).alias("mi"))


def binned(value, width: float, bins: int):
    return F.least(F.floor(value / width), F.lit(bins - 1)).cast("int")


def score_candidates(fixed: DataFrame, moving: DataFrame, shifts: list[tuple[int, int, int]], width: float, bins: int) -> DataFrame:
    """Mutual information of every candidate shift, in voxels, for every study; ``cand`` is its number in the list.

    Lines of voxels along i meet, not voxels: a line is sent once for all candidates that shift it alike along j and k. A place listed twice in the moving table pairs twice.
    """
    lines = sorted({shift[1:] for shift in shifts})
    entry = lambda line: F.struct(F.lit(line[0]).alias("sj"), F.lit(line[1]).alias("sk"), F.array(*[F.struct(F.lit(n).alias("cand"), F.lit(s[0]).alias("si")) for n, s in enumerate(shifts) if s[1:] == line]).alias("along"))
    f = fixed.select(*AT, binned(F.col("value"), width, bins).alias("fbin")).groupBy("study_id", "j", "k").agg(F.collect_list(F.struct("i", "fbin")).alias("at"))  # a line of the image
    f = f.select("study_id", "j", "k", "at", F.explode(F.array(*map(entry, lines))).alias("c"))
    at = f.select("study_id", (F.col("j") + F.col("c.sj")).alias("j"), (F.col("k") + F.col("c.sk")).alias("k"), "at", F.col("c.along").alias("along"))
    m = moving.where("i IS NOT NULL").select(*AT, binned(F.coalesce("value", F.lit(0.0)), width, bins).alias("mbin")).groupBy("study_id", "j", "k").agg(F.collect_list(F.struct("i", "mbin")).alias("all"))
    keys = F.array_distinct("all.i")
    twice = F.map_from_arrays(keys, F.transform(keys, lambda i: F.transform(F.filter("all", lambda e: e["i"] == i), lambda e: e["mbin"])))
    m = m.select("study_id", "j", "k", F.when(F.size(keys) == F.size("all"), F.map_from_arrays(F.col("all.i"), F.transform("all", lambda e: F.array(e["mbin"])))).otherwise(twice).alias("held"))
    met = at.hint("merge").join(m, ["study_id", "j", "k"], "left").select("study_id", "along", "held", F.explode("at").alias("p")).select("study_id", "held", "p", F.explode("along").alias("c"))
    empty = F.array(binned(F.lit(0.0), width, bins))
    return mutual_information(met.select("study_id", "c.cand", "p.fbin", F.explode(F.coalesce(F.try_element_at("held", F.col("p.i") + F.col("c.si")), empty)).alias("mbin")))


def best_candidate(scores: DataFrame, digits: int = 6) -> DataFrame:
    """The candidate of the highest score; ties, after rounding, go to the smallest."""
    x = scores.withColumn("mi", F.round("mi", digits))
    return x.groupBy("study_id").agg(F.max_by("cand", F.struct("mi", -F.col("cand"))).alias("cand"), F.max("mi").alias("mi"))


def moved_point(p: dict[str, Column], c: list[Column], x: list[Column]) -> list[Column]:
    """A point turned about the three axes and grown, all about a centre, then shifted."""
    x, y, z = (a - b for a, b in zip(x, c, strict=True))

    def turn(t: Column, u: Column, v: Column) -> tuple[Column, Column]:
        d = 1.0 + t * t
        cos, sin = (1.0 - t * t) / d, 2.0 * t / d
        return cos * u - sin * v, sin * u + cos * v

    y, z = turn(p["rx"], y, z)
    z, x = turn(p["ry"], z, x)
    x, y = turn(p["rz"], x, y)
    return [a * (1.0 + p["g"]) + b + p[t] for a, b, t in zip((x, y, z), c, ("tx", "ty", "tz"), strict=True)]


def candidate_steps(turn: int) -> list[tuple[float, ...]]:
    """The steps of a round's candidates: none, then every mix of shifts along the axes, then each turn and the growth up and down."""
    signs = (0.0, 1.0, -1.0)
    out = [(a * STEPS[0], b * STEPS[1], c * STEPS[2], 0.0, 0.0, 0.0, 0.0) for a in signs for b in signs for c in signs]
    for n in range(3, len(PARAMETERS)):
        out += [tuple(sign * STEPS[n] if m == n else 0.0 for m in range(len(PARAMETERS))) for sign in signs[1:]]
    return [tuple(x / 2**turn for x in step) for step in out]


def _layered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bins of bricks (study_id, bi, bj, bk, v) by place, null where none is listed; a place listed again is in a further layer of its brick."""
    for b in batches:
        listed = b.column("v").flatten()
        p, mbin = (listed.field(c).to_numpy() for c in ("p", "mbin"))
        row = np.repeat(np.arange(b.num_rows), b.column("v").value_lengths().to_numpy())
        order = np.lexsort((p, row))
        p, mbin, row, n = p[order], mbin[order], row[order], np.arange(len(p))
        again = np.concatenate([[False], (row[1:] == row[:-1]) & (p[1:] == p[:-1])])
        layer = n - np.maximum.accumulate(np.where(again, 0, n))
        (brick, of_layer), at = np.unique(np.stack([row, layer]), axis=1, return_inverse=True) if again.any() else (np.stack([np.arange(b.num_rows), np.zeros(b.num_rows, int)]), row)
        bins, absent = np.zeros((len(brick), BRICK**3), np.int32), np.ones((len(brick), BRICK**3), bool)
        bins[at.reshape(-1), p], absent[at.reshape(-1), p] = mbin, False
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(brick) + 1) * BRICK**3, pa.int32()), pa.array(bins.reshape(-1), mask=absent.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(brick)) for c in ("study_id", "bi", "bj", "bk")], pa.array(of_layer, pa.int32()), lists], names=["study_id", "bi", "bj", "bk", "layer", "bins"])


def _tried(steps: list[tuple[float, ...]]):
    """The places of the moving grid that candidates take each point to: a row for each brick that holds some, with number of the candidate * BRICK ** 3 + place in the brick."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                of = lambda c: b.column(c).to_numpy(zero_copy_only=False)[:, None]  # noqa: B023, E731
                moved = moved_point({p: of(p) + np.array(d) for p, d in zip(PARAMETERS, zip(*steps, strict=True), strict=True)}, [of(f"c{n}") for n in range(3)], [of(c) for c in "xyz"])
                at = np.floor(np.stack(placed([of(f"m{n}") for n in range(12)], *moved)).reshape(3, -1) + 0.5)
                at = np.where(np.all(np.abs(at) < 2**31, axis=0), at, -(2.0**31)).astype(np.int64)  # without a place: where no voxel is
                row, cand = np.divmod(np.arange(at.shape[1]), len(steps))
                box, inside = np.divmod(at, BRICK)
                code = cand * BRICK**3 + inside[0] + BRICK * inside[1] + BRICK**2 * inside[2]
                order = np.lexsort((*box, row))
                box, row = box[:, order], row[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | np.any(box[:, 1:] != box[:, :-1], axis=0)]))
                codes = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(code[order], pa.int32()))
                point = b.select(["study_id", "fbin"]).take(pa.array(row[first]))
                yield pa.RecordBatch.from_arrays([*point.columns, *[pa.array(x[first], pa.int32()) for x in box], codes], names=["study_id", "fbin", "bi", "bj", "bk", "codes"])

    return run


def _informed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``mutual_information`` of rows (study_id, fbin, codes, mbin) that come study by study; counts alone are held."""
    key, held = ["study_id", "cand", "fbin", "mbin"], None

    def scored(x: pd.DataFrame) -> pd.DataFrame:
        over = lambda *c: x.groupby(["study_id", "cand", *c])["n"].transform("sum")
        t = over()
        x = x.assign(mi=x["n"] / t * np.log(x["n"] * t / (over("fbin") * over("mbin"))))
        return x.groupby(["study_id", "cand"], as_index=False)["mi"].sum()

    for b in batches:
        if not len(b):
            continue
        size, codes = b["codes"].map(len), np.concatenate(b["codes"].tolist())
        pairs = pd.DataFrame({"study_id": np.repeat(b["study_id"].to_numpy(), size), "cand": codes // BRICK**3, "fbin": np.repeat(b["fbin"].to_numpy(), size), "mbin": np.concatenate(b["mbin"].tolist())})
        joint = pairs.groupby(key).size().astype(float).reset_index(name="n")  # without the nulls of further layers
        joint = joint if held is None else pd.concat([held, joint]).groupby(key, as_index=False)["n"].sum()
        ends = joint["study_id"] == b["study_id"].iloc[-1]
        held = joint[ends]
        yield scored(joint[~ends])
    if held is not None:
        yield scored(held)


def _candidate_scores(points: DataFrame, best: DataFrame, moving: DataFrame, steps: list[tuple[float, ...]], empty: Column, whole: bool) -> DataFrame:
    """mi per (study_id, cand). Points are sent to the few bricks that candidates take them to, not to a voxel for each candidate; ``whole``: a study's counts are made in one task."""
    kind = points.schema["study_id"].dataType.simpleString()
    tried = points.join(best, "study_id").mapInArrow(_tried(steps), f"study_id {kind}, fbin int, bi int, bj int, bk int, codes array<int>")
    met = tried.join(moving, ["study_id", "bi", "bj", "bk"], "left")
    absent = F.when(F.coalesce("layer", F.lit(0)) == 0, empty)
    met = met.select("study_id", "fbin", "codes", F.transform("codes", lambda c: F.coalesce(F.get("bins", c % BRICK**3), absent)).alias("mbin"))
    if whole:
        return met.repartition("study_id").sortWithinPartitions("study_id").mapInPandas(_informed, f"study_id {kind}, cand int, mi double")
    pairs = met.select("study_id", "fbin", F.explode(F.arrays_zip("codes", "mbin")).alias("c")).where("c.mbin IS NOT NULL")
    return mutual_information(pairs.select("study_id", F.floor(F.col("c.codes") / BRICK**3).cast("int").alias("cand"), "fbin", "c.mbin"))


def _rounds(rounds: int, empty: int, bins: int):
    """The rounds of ``register`` for studies gathered with ``MAPS`` (center, places of the fixed grid to space, space to places of the moving grid) and ``STATE`` (``PARAMETERS`` to begin at)."""

    def of_studies(x: gathered.Some, maps: np.ndarray, state: np.ndarray) -> np.ndarray:
        center, to, back = (list(maps[:, lo:hi].T[:, :, None, None]) for lo, hi in ((0, 3), (3, 15), (15, 27)))
        points, p, mi = placed(to, *[c[:, None] for c in x.points]), state[:, 0], np.zeros(x.n)
        for turn in range(rounds):
            steps = np.array(candidate_steps(turn))
            tried = p[:, None] + steps
            named = {name: tried[:, :, n, None] for n, name in enumerate(PARAMETERS)}
            scores = gathered.rounded(x.informed(len(steps), lambda some: placed(back, *moved_point(named, center, [c[:, :, some] for c in points]))))  # noqa: B023
            best = scores.argmax(axis=1)
            p, mi = tried[np.arange(x.n), best], scores.max(axis=1)
        return np.column_stack([p, mi])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered.whole_studies(batches):
            for ids, found in gathered.searched(b, MAPS, STATE, empty, len(candidate_steps(0)) * bins * (bins + 1), of_studies, again=True):
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, found.T)], names=["study_id", *PARAMETERS, "mi"])

    return run


def register(fixed: DataFrame, fixed_volumes: DataFrame, moving: DataFrame, moving_volumes: DataFrame, width: float, bins: int, share: float = 0.002, rounds: int = 3, most: int = WHOLE, start: DataFrame | None = None) -> DataFrame:
    """``PARAMETERS`` and mi of the best transform from the fixed to the moving image of each study, from coarse to fine.

    Sampled fixed voxels are looked up in the moving image through every candidate; each round starts at the best
    candidate of the one before, with half the steps; the first at ``start`` (study_id, tx, ty, tz), if given, else at 0. Ties go to the first candidate. Studies without a
    sampled voxel have no row. A study with at most ``most`` lookups in a round and a moving image that one task can hold goes through all rounds there. Others are kept as bricks of bins, and each round's
    result, one row a study, is stored; where none of them has more than ``most`` lookups in a round, each one's joint histogram is made in one task, from a stream; else it is made by partial sums.
    """
    return settled(fixed.sparkSession, lambda: _registered(fixed, fixed_volumes, moving, moving_volumes, width, bins, share, rounds, most, start))


def _registered(fixed: DataFrame, fixed_volumes: DataFrame, moving: DataFrame, moving_volumes: DataFrame, width: float, bins: int, share: float, rounds: int, most: int, start: DataFrame | None) -> DataFrame:
    points = sampled(fixed, share).select(*AT, binned(F.col("value"), width, bins).alias("fbin"))
    listed = moving.where("i IS NOT NULL AND j IS NOT NULL AND k IS NOT NULL").select(*AT, binned(F.coalesce("value", F.lit(0.0)), width, bins).alias("mbin"))
    begun = fixed_volumes.select("study_id", *[F.lit(0.0).alias(p) for p in PARAMETERS])
    if start is not None:
        begun = fixed_volumes.select("study_id").join(start.select("study_id", *PARAMETERS[:3]).hint("merge"), "study_id", "left")
        begun = begun.select("study_id", *[F.coalesce(F.col(p).cast("double"), F.lit(0.0)).alias(p) for p in PARAMETERS[:3]], *[F.lit(0.0).alias(p) for p in PARAMETERS[3:]])
    per = points.groupBy("study_id").agg((F.count("*") * len(candidate_steps(0))).alias("n"), F.every(F.col("fbin").isNotNull()).alias("full"))
    sides = [F.max(c).cast("double") - F.min(c) + 1 for c in "ijk"]
    box = listed.groupBy("study_id").agg((F.greatest(F.count("*"), sides[0] * sides[1] * sides[2]) <= gathered.WHOLE).alias("fits"))
    held = per.where(F.col("full") & (F.col("n") <= most)).join(gathered.held_by_one(fixed_volumes, moving_volumes).hint("merge"), "study_id").join(box.hint("merge"), "study_id", "left").where("fits IS NULL OR fits")
    held = stored(held.select("study_id"))
    whole, n = held.count(), per.count()
    if not whole:
        return _by_tables(points, fixed_volumes, listed, moving_volumes, begun, width, bins, rounds, most)
    few, studies = small(held), held.hint("merge")
    cut = lambda how, *of: [x.join(few if x in (points, listed) else studies, "study_id", how) if whole < n else x for x in of]
    p, m, at = cut("left_semi", points, listed, begun)
    maps = fixed_volumes.select("study_id", F.slice("ijk_to_ras", 1, 12).alias("to")).join(volume_center(fixed_volumes).select("study_id", "center").hint("merge"), "study_id")
    maps = maps.join(moving_volumes.select("study_id", F.slice(inverse(F.col("ijk_to_ras")), 1, 12).alias("back")).hint("merge"), "study_id").join(studies, "study_id", "left_semi")
    rows = [
        p.select(*gathered.row(POINT, F.col("fbin"), [F.col(c) for c in "ijk"])),
        m.select(*gathered.row(VOXEL, F.col("mbin"), [F.col(c) for c in "ijk"])),
        at.join(studies, "study_id", "left_semi").select(*gathered.row(STATE, s=F.array(*PARAMETERS))),
        maps.select(*gathered.row(MAPS, s=F.concat("center", "to", "back"))),
    ]
    kind = fixed_volumes.schema["study_id"].dataType.simpleString()
    found = gathered.by_study(reduce(DataFrame.unionByName, rows)).mapInArrow(_rounds(rounds, min(0, bins - 1), bins), f"study_id {kind}, {', '.join(f'{c} double' for c in (*PARAMETERS, 'mi'))}")
    if whole == n:
        return found
    p, m, at, *volumes = cut("left_anti", points, listed, begun, fixed_volumes, moving_volumes)
    return found.unionByName(_by_tables(p, volumes[0], m, volumes[1], at, width, bins, rounds, most))


def _by_tables(points: DataFrame, fixed_volumes: DataFrame, listed: DataFrame, moving_volumes: DataFrame, best: DataFrame, width: float, bins: int, rounds: int, most: int) -> DataFrame:
    """The rounds through tables, for studies of any size."""
    m = fixed_volumes.select("study_id", F.col("ijk_to_ras").alias("_to")).join(volume_center(fixed_volumes).select("study_id", F.col("center").alias("_c")), "study_id")
    points = points.join(small(m, fixed_volumes), "study_id")
    points = points.join(small(moving_volumes.select("study_id", inverse(F.col("ijk_to_ras")).alias("_m")), moving_volumes), "study_id")
    at = zip(placed(F.col("_to"), F.col("i"), F.col("j"), F.col("k")), "xyz", strict=True)
    points = stored(points.select("study_id", "fbin", *[p.alias(c) for p, c in at], *[F.col("_c")[n].alias(f"c{n}") for n in range(3)], *[F.col("_m")[n].alias(f"m{n}") for n in range(12)]))
    box = [F.floor(F.col(c) / BRICK).cast("int").alias(f"b{c}") for c in "ijk"]
    place = sum((F.pmod(c, F.lit(BRICK)) * BRICK**n for n, c in enumerate("ijk")), F.lit(0)).cast("int")
    held = listed.select("study_id", *box, F.struct(place.alias("p"), "mbin").alias("v"))
    held = held.groupBy("study_id", "bi", "bj", "bk").agg(F.collect_list("v").alias("v"))  # of BRICK ** 3 places
    bricks = stored(held.mapInArrow(_layered, f"study_id {listed.schema['study_id'].dataType.simpleString()}, bi int, bj int, bk int, layer int, bins array<int>"))
    lookups = (points.groupBy("study_id").count().agg(F.max("count")).first()[0] or 0) * len(candidate_steps(0))
    few = fixed_volumes.count() <= BROADCAST
    for turn in range(rounds):
        steps = candidate_steps(turn)
        scores = _candidate_scores(points, F.broadcast(best) if few else best, bricks, steps, binned(F.lit(0.0), width, bins), lookups <= most)
        moved = [(F.col(p) + F.get(F.array(*map(F.lit, d)), F.col("cand"))).alias(p) for p, d in zip(PARAMETERS, zip(*steps, strict=True), strict=True)]
        best = stored(best.join(best_candidate(scores), "study_id").select("study_id", *moved, *(["mi"] if turn == rounds - 1 else [])))
    return best
