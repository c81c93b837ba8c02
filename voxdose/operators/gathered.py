"""Studies that one task can hold: their points and moving voxels gathered by a shuffle, and their candidates scored by numpy, study by study.

Rows come as (study_id, kind, b, x, y, z, s): ``POINT`` and ``VOXEL`` with their bin and place, others with numbers in ``s``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import grid_size, inverse

#: Most places of a study's grids for which it is held by one task.
WHOLE = 1 << 21
#: Lookups at a time, points of some studies with padding, counts of their joint histograms, and rows of whole studies.
LOOKUPS, PADDED, COUNTS, ROWS = 1 << 16, 1 << 15, 1 << 20, 60_000
POINT, VOXEL = 0, 1


def held_by_one(fixed_volumes: DataFrame, moving_volumes: DataFrame, most: int = WHOLE) -> DataFrame:
    """study_id of the studies with one fixed and one moving volume, both of at most ``most`` places and with a matrix that has an inverse."""

    def fit(volumes: DataFrame) -> DataFrame:
        full = lambda c: F.forall(c, lambda x: x.isNotNull())
        grid = (F.size("dims") == 3) & full("dims") & F.forall("dims", lambda d: d > 0) & F.coalesce(grid_size(F.col("dims")) <= most, F.lit(False))
        matrix = (F.size("ijk_to_ras") == 16) & full("ijk_to_ras") & full(inverse(F.col("ijk_to_ras")))
        return volumes.where("study_id IS NOT NULL").groupBy("study_id").agg(F.count("*").alias("n"), F.every(F.coalesce(grid & matrix, F.lit(False))).alias("fit")).where("n = 1 AND fit").select("study_id")

    return fit(fixed_volumes).join(fit(moving_volumes).hint("merge"), "study_id")


def row(kind: int, b: Column | None = None, place: list[Column] | None = None, s: Column | None = None) -> list[Column]:
    x, y, z = [c.cast("double") for c in place] if place else [F.lit(0.0)] * 3
    return [F.col("study_id"), F.lit(kind).alias("kind"), (F.lit(0) if b is None else b).alias("b"), x.alias("x"), y.alias("y"), z.alias("z"), (F.lit(None) if s is None else s).cast("array<double>").alias("s")]


def by_study(rows: DataFrame) -> DataFrame:
    return rows.repartition("study_id").sortWithinPartitions("study_id")


def whole_studies(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.Table]:
    """Tables of all rows of some studies, of batches whose rows come study by study; at most ``rows`` and those of one study."""
    parts, n = [], 0
    for b in batches:
        ids = b.column("study_id").to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        if parts and ids[0] != last:
            cuts = np.append(0, cuts)
        last, lo = ids[-1], 0
        for cut in cuts:
            if n + cut - lo >= rows or cut == cuts[-1] and n + len(ids) - lo > rows:
                yield pa.Table.from_batches([*parts, b.slice(lo, cut - lo)])
                parts, n, lo = [], 0, cut
        parts.append(b.slice(lo))
        n += len(ids) - lo
    if parts:
        yield pa.Table.from_batches(parts)


class Some:
    """Some studies, as arrays of one row each: points (f, their bins as codes; x, y, z; ``width`` at most), padded with places that pair with nothing, and moving voxels, in a box (lo, dims) each.

    ``layers``: the codes of the voxels by place, that of an absent voxel last; a voxel listed again is in a further layer, where other places pair with nothing.
    """

    def __init__(self, points: list[np.ndarray], f: np.ndarray, n_points: np.ndarray, voxels: list[np.ndarray], m: np.ndarray, n_voxels: np.ndarray, lo: np.ndarray, dims: np.ndarray, empty: int):
        self.n, width = len(n_points), n_points.max()
        real = np.arange(width) < n_points[:, None]
        laid = lambda v, kind: _laid(real, v, kind)
        codes, f = np.unique(f, return_inverse=True)
        self.n_f, self.f, self.points = len(codes), laid(f, np.int64), [laid(v, float) for v in points]
        codes, m = np.unique(np.append(m, empty), return_inverse=True)
        self.n_m, self.real, self.width, self.counts, size = len(codes), real, width, n_points, dims.prod(axis=1)
        base, of = np.cumsum(size) - size, np.repeat(np.arange(self.n), n_voxels)
        inside = [v - lo[of, a] for a, v in enumerate(voxels)]
        at, codes = (base[of] + inside[0] + dims[of, 0] * (inside[1] + dims[of, 1] * inside[2])).astype(np.int64), m[:-1]
        self.lo, self.dims, self.base, self.layers, rest = lo[:, :, None, None], dims[:, :, None, None], base[:, None, None], [], m[-1]
        while not self.layers or len(at):
            self.layers.append(np.full(size.sum() + 1, rest, np.int32))
            _, first = np.unique(at, return_index=True)
            self.layers[-1][at[first]], rest = codes[first], self.n_m
            at, codes = np.delete(at, first), np.delete(codes, first)

    def informed(self, cands: int, near: Callable[[slice], list[np.ndarray]]) -> np.ndarray:
        """Mutual information of each study's candidates; ``near`` gives i, j, k in the moving grid of each study, candidate and point of a slice."""
        pairs, joint = self.n_m + 1, np.zeros(self.n * cands * self.n_f * (self.n_m + 1))
        first, step = np.arange(self.n * cands).reshape(self.n, cands, 1) * (self.n_f * pairs), max(1, LOOKUPS // (self.n * cands))
        for lo in range(0, self.width, step):
            some = slice(lo, lo + step)
            at = [np.floor(c + 0.5) - self.lo[:, a] for a, c in enumerate(near(some))]
            inside = np.logical_and.reduce([(c >= 0) & (c < self.dims[:, a]) for a, c in enumerate(at)])
            place = np.where(inside, self.base + at[0] + self.dims[:, 0] * (at[1] + self.dims[:, 1] * at[2]), len(self.layers[0]) - 1).astype(np.int64)
            for layer in self.layers:
                m = np.where(self.real[:, None, some], layer[place], self.n_m)
                joint += np.bincount((first + self.f[:, None, some] * pairs + m).ravel(), minlength=len(joint))
        n = joint.reshape(self.n, cands, self.n_f, pairs)[..., : self.n_m]
        t, nf, nm = n.sum(axis=(2, 3), keepdims=True), n.sum(axis=3, keepdims=True), n.sum(axis=2, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            return (n / t * np.log(np.where(n > 0, n * t / (nf * nm), 1.0))).sum(axis=(2, 3))

    def entropy(self) -> np.ndarray:
        """Of the points' bins."""
        n = np.bincount((np.arange(self.n)[:, None] * self.n_f + self.f)[self.real], minlength=self.n * self.n_f).reshape(self.n, self.n_f)
        q = n / self.counts[:, None]
        return np.sum(-q * np.log(np.where(n > 0, q, 1.0)), axis=1)


def _laid(real: np.ndarray, values: np.ndarray, kind: type) -> np.ndarray:
    out = np.zeros(real.shape, kind)
    out[real] = values
    return out


def some_at_a_time(n_points: np.ndarray, places: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Numbers of studies with about as many points each, at most ``most`` studies, ``PADDED`` points with padding and ``WHOLE`` places of grids, unless one alone has more."""
    order = np.argsort(n_points, kind="stable")
    lo = 0
    while lo < len(order):
        hi, held = lo + 1, places[order[lo]]
        while hi < len(order) and hi - lo < most and (hi + 1 - lo) * n_points[order[hi]] <= PADDED and n_points[order[hi]] <= 2 * n_points[order[lo]] and held + places[order[hi]] <= WHOLE:
            held, hi = held + places[order[hi]], hi + 1
        yield order[lo:hi]
        lo = hi


def rounded(mi: np.ndarray, digits: int = 6) -> np.ndarray:
    return np.round(mi, digits) + 0.0  # no negative 0


def searched(b: pa.Table, maps: int, state: int, empty: int, counts: int, search: Callable[[Some, np.ndarray, np.ndarray], np.ndarray], again: bool = False) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and what ``search`` makes of some studies at a time: of their points and voxels, the numbers of their one row of kind ``maps``, and of those of kind ``state``.

    Studies without a row of these kinds or without a point are left out. ``counts``: of a study's joint histograms, about. ``again``: a voxel may be listed again.
    """
    ids, kind = (b.column(c).to_numpy() for c in ("study_id", "kind"))
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
    columns = {c: b.column(c).to_numpy() for c in "bxyz"}
    at = {k: np.flatnonzero(kind == k) for k in (POINT, VOXEL, maps, state)}
    n = {k: np.bincount(of[v], minlength=len(first)) for k, v in at.items()}
    begin = {k: np.cumsum(v) - v for k, v in n.items()}
    numbers = lambda k: b.column("s").take(pa.array(at[k])).combine_chunks().flatten().to_numpy().reshape(len(at[k]), -1)
    full = np.flatnonzero((n[POINT] > 0) & (n[maps] > 0) & (n[state] > 0))
    if not len(full):
        return
    of_maps, of_state, some = numbers(maps), numbers(state), n[VOXEL] > 0
    lo, dims = np.zeros((2, len(first), 3), np.int64)  # the box of the voxels
    if some.any():
        lo[some], hi = (np.stack([f.reduceat(columns[c][at[VOXEL]], begin[VOXEL][some]) for c in "xyz"], axis=1).astype(np.int64) for f in (np.minimum, np.maximum))
        dims[some] = hi - lo[some] + 1
    for starts in np.unique(n[state][full]):
        alike = full[n[state][full] == starts]
        for some in some_at_a_time(n[POINT][alike], dims[alike].prod(axis=1), max(1, COUNTS // counts)):
            some = np.sort(alike[some])
            rows = lambda k: at[k][np.concatenate([np.arange(begin[k][s], begin[k][s] + n[k][s]) for s in some])]  # noqa: B023, E731
            points, voxels = rows(POINT), rows(VOXEL)
            x = Some([columns[c][points] for c in "xyz"], columns["b"][points], n[POINT][some], [columns[c][voxels] for c in "xyz"], columns["b"][voxels], n[VOXEL][some], lo[some], dims[some], empty)
            if len(x.layers) > 1 and not again:
                raise ValueError("a moving voxel is listed twice")
            s = of_state[begin[state][some][:, None] + np.arange(starts)]
            yield b.column("study_id").take(pa.array(first[some])).combine_chunks(), search(x, of_maps[begin[maps][some]], s)
