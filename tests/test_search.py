"""Registration end to end: the pyramid, the search, matrices, and hardening."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_spread import _sent

from voxdose.operators import gathered, masks, registration, search

VOLUME = "study_id long, volume_id string, dims array<int>, ijk_to_ras array<double>"
VOXEL = "study_id long, i int, j int, k int, value double"


def body(x, y, z):
    """An uneven body: lobes of different size and height, about the origin."""
    lobes = [((0, 0, 0), (56, 26, 36), 60.0), ((32, 6, 8), (18, 12, 22), 110.0), ((-34, -8, -8), (16, 14, 20), 150.0), ((4, 14, 16), (22, 9, 12), 190.0)]
    out = np.zeros(np.shape(x))
    for c, r, v in lobes:
        inside = ((x - c[0]) / r[0]) ** 2 + ((y - c[1]) / r[1]) ** 2 + ((z - c[2]) / r[2]) ** 2 <= 1
        out = np.where(inside, v, out)
    return out


def image(study, dims, matrix, warp=np.eye(4), centre=(0.0, 0.0, 0.0)):
    """Voxels of the body moved by ``warp`` (new to old points), on a grid."""
    m = np.array(matrix, float).reshape(4, 4)
    ijk = np.stack(np.meshgrid(*[np.arange(d) for d in dims], indexing="ij"), -1).reshape(-1, 3)
    at = ijk @ m[:3, :3].T + m[:3, 3]
    old = at @ warp[:3, :3].T + warp[:3, 3] - np.array(centre)
    values = body(*old.T)
    return [(study, *map(int, p), float(v)) for p, v in zip(ijk, values, strict=True) if v]


GRID = [float(x) for x in (4, 0, 0, -62, 0, 4, 0, -62, 0, 0, 4, -46, 0, 0, 0, 1)]
DIMS = (32, 32, 24)


def turned(degrees, shift):
    a = np.radians(degrees)
    return np.array([[np.cos(a), -np.sin(a), 0, shift[0]], [np.sin(a), np.cos(a), 0, shift[1]], [0, 0, 1, shift[2]], [0, 0, 0, 1.0]])


def test_pyramid(spark):
    rng = np.random.default_rng(1)
    grid = rng.integers(0, 9, (7, 5, 6)).astype(float)
    voxels = spark.createDataFrame([(1, *map(int, at), float(v)) for at, v in np.ndenumerate(grid) if v], VOXEL)
    volumes = spark.createDataFrame([(1, "v", [7, 5, 6], [float(x) for x in (2, 0, 0, 10, 0, -3, 0, 20, 0, 0, 4, 30, 0, 0, 0, 1)])], VOLUME)
    for factor in (2, 4):
        coarse, where = search.pyramid(voxels, volumes, factor)
        got = {(r["i"], r["j"], r["k"]): r["value"] for r in coarse.collect()}
        dims = where.first()["dims"]
        assert dims == [-(-n // factor) for n in (7, 5, 6)]
        for i, j, k in np.ndindex(*dims):
            block = grid[i * factor : (i + 1) * factor, j * factor : (j + 1) * factor, k * factor : (k + 1) * factor]
            assert np.isclose(got.get((i, j, k), 0.0), block.mean())
        assert coarse.count() <= np.prod(dims)  # what a coarse round reads
    m = search.pyramid(voxels, volumes, 2)[1].first()["ijk_to_ras"]
    assert m[:4] == [4, 0, 0, 11] and m[4:8] == [0, -6, 0, 18.5] and m[8:12] == [0, 0, 8, 32]


def test_lattice_sample(spark):
    volumes = spark.createDataFrame([(1, "v", [9, 8, 7], GRID), (2, "v", [3, 1, 1], GRID), (3, "v", [0, 4, 4], GRID)], VOLUME)
    some = [tuple(r) for r in masks.lattice_sample(volumes, 0.1).collect()]
    assert len(set(some)) == len(some) == 51 + 1 and {s for s, *_ in some} == {1, 2}
    assert all(0 <= i < 9 and 0 <= j < 8 and 0 <= k < 7 for _, i, j, k in some)
    whole = {tuple(r)[1:] for r in masks.lattice_sample(volumes.where("study_id = 1"), 1.0).collect()}
    assert whole == set(np.ndindex(9, 8, 7))
    sparse = spark.createDataFrame([(1, 0, 0, 0, 5.0), (1, 3, 3, 3, 7.0)], VOXEL)
    dense = volumes.where("study_id = 1").select("study_id").join(masks.lattice_sample(volumes, 1.0), "study_id").join(sparse, masks.AT, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    a, b = (sorted(map(tuple, masks.sampled_values(volumes.where("study_id = 1"), v, 0.3).collect())) for v in (sparse, dense))
    assert a == b and len(a) == 152


def test_matrix_of_parameters(spark):
    p = [3.0, -2.0, 1.0, 0.1, -0.2, 0.05, 0.1, -0.1, 0.2, 0.03, -0.04, 0.05]
    c = [5.0, 6.0, 7.0]
    m = np.array(spark.range(1).select(search.parameters_matrix(F.array(*map(F.lit, p)), F.array(*map(F.lit, c)))).first()[0]).reshape(4, 4)
    rot = np.eye(3)
    for axis, t in enumerate(p[3:6]):
        a, (u, v) = 2 * np.arctan(t), [(1, 2), (2, 0), (0, 1)][axis]
        r = np.eye(3)
        r[u, u], r[u, v], r[v, u], r[v, v] = np.cos(a), -np.sin(a), np.sin(a), np.cos(a)
        rot = r @ rot
    a = rot @ np.array([[1.1, 0.03, -0.04], [0, 0.9, 0.05], [0, 0, 1.2]])
    x = np.array([1.0, 2.0, 3.0])
    assert np.allclose(m[:3, :3] @ x + m[:3, 3], a @ (x - c) + c + p[:3])


def test_chain(spark):
    one, two = turned(30, (1, 2, 3)), turned(-70, (4, 0, 9))
    rows = [(1, 2, two.ravel().tolist()), (1, 1, one.ravel().tolist()), (2, 5, one.ravel().tolist())]
    got = {r["study_id"]: np.array(r["matrix"]).reshape(4, 4) for r in search.chained(spark.createDataFrame(rows, "study_id long, ord int, matrix array<double>")).collect()}
    assert np.allclose(got[1], two @ one) and np.allclose(got[2], one)


@pytest.fixture(scope="module")
def apart(spark):
    """The same body on two grids, the second 60 mm and 12 degrees away; the scanner of the second has another origin."""
    warp = turned(12, (0, 0, 0))
    there = list(GRID)
    for a, s in zip((3, 7, 11), (48.0, -36.0, 0.0), strict=True):
        there[a] += s
    fixed, moving = image(1, DIMS, GRID), image(1, DIMS, there, warp, warp[:3, :3] @ np.array([48.0, -36.0, 0.0]))
    frame = lambda rows: spark.createDataFrame(rows, VOXEL)
    volume = lambda m, v: spark.createDataFrame([(1, v, list(DIMS), m)], VOLUME)
    return frame(fixed), volume(GRID, "ct"), frame(moving), volume(there, "ct2"), warp


PLAN = search.Plan(width=25.0, bins=8, share=0.4, levels=(2, 1), first=8.0, least=1.0, rounds=10, keep=1)


def test_rigid_end_to_end(spark, apart):
    fixed, fixed_volumes, moving, moving_volumes, warp = apart
    found = search.search(fixed, fixed_volumes, moving, moving_volumes, PLAN)
    row = found.first()
    assert row["method"] == "Rigid" and row["fit"] > 0.6 and row["p"][6:] == [0.0] * 6
    transform = search.matrices(found, fixed_volumes, least_fit=0.5)
    m = np.array(transform.first()["matrix"]).reshape(4, 4)
    angle = np.degrees(np.arctan2(m[1, 0], m[0, 0]))
    centre = m[:3, :3] @ np.array([48.0, -36.0, 0.0]) + m[:3, 3]
    assert abs(angle - 12) < 2.5 and np.abs(centre).max() < 4  # within a voxel
    # both volumes of the study are moved, and then nothing is left to do
    both = moving_volumes.unionByName(moving_volumes.withColumn("volume_id", F.lit("spect")))
    hardened = registration.apply_linear_transform(both, transform)
    assert hardened.count() == 2 and hardened.select("ijk_to_ras").distinct().count() == 1
    again = search.search(fixed, fixed_volumes, moving, hardened.where("volume_id = 'ct2'"), PLAN._replace(levels=(1,), first=4.0, rounds=4)).first()
    assert np.abs(again["p"][:3]).max() <= 4 and np.abs(again["p"][3:6]).max() < 0.06
    # the finest level alone, from where the coarse ones ended, goes no higher: the pyramid found the same optimum
    assert again["mi"] <= row["mi"] + 0.05


def test_affine_finds_shear(spark):
    shear = np.eye(4)
    shear[0, 1], shear[0, 0] = 0.3, 1.15
    fixed, moving = image(1, DIMS, GRID), image(1, DIMS, GRID, shear)
    frame = lambda rows: spark.createDataFrame(rows, VOXEL)
    volumes = spark.createDataFrame([(1, "ct", list(DIMS), GRID)], VOLUME)
    plan = PLAN._replace(rounds=12)
    affine, rigid = (search.search(frame(fixed), volumes, frame(moving), volumes, plan, m) for m in ("Affine", "Rigid"))
    a, r = affine.first(), rigid.first()
    assert a["fit"] > r["fit"] + 0.1
    limit = (a["fit"] + r["fit"]) / 2
    assert search.matrices(rigid, volumes, limit).count() == 0
    m = np.array(search.matrices(affine, volumes, limit).first()["matrix"]).reshape(4, 4)
    assert abs(m[0, 1] - 0.3) < 0.08 and abs(m[0, 0] - 1.15) < 0.08


def _body_studies(spark):
    """Four studies of a small body: two plain ones on grids of different size, one whose moving matrix has a null, one with two moving volumes."""
    small, there = (9, 8, 5), [float(x) for x in (8, 0, 0, -28, 0, 8, 0, -30, 0, 0, 8, -20, 0, 0, 0, 1)]
    away = [x + 11 if n == 3 else x for n, x in enumerate(there)]
    fixed, moving, fv, mv = [], [], [], []
    for s in (1, 2, 3, 4):
        dims = (11, 8, 6) if s == 2 else small
        fixed += image(s, dims, there)
        moving += image(s, dims, away, turned(4.0 * s, (3.0 * s, -2.0, 1.0)))
        fv.append((s, "ct", list(dims), there))
        mv.append((s, "ct2", list(dims), [None if s == 3 and n == 5 else x for n, x in enumerate(away)]))
    mv.append((4, "ct3", list(small), there))
    fv.append((None, "ct", list(small), there))
    moving += [(5, 0, 0, 0, 9.0)]
    frame = lambda rows: spark.createDataFrame(rows, VOXEL)
    return frame(fixed), spark.createDataFrame(fv, VOLUME), frame(moving), spark.createDataFrame(mv, VOLUME)


SHORT = search.Plan(width=25.0, bins=8, share=0.3, levels=(2, 1), first=8.0, least=2.0, rounds=2, keep=2)


@pytest.mark.parametrize(("method", "levels", "others"), [("Rigid", (2, 1), (9 * 8 * 5,)), ("Affine", (1,), (0,))])
def test_whole_studies_are_searched_as_through_tables(spark, method, levels, others):
    fixed, fixed_volumes, moving, moving_volumes = _body_studies(spark)
    few = lambda df: df.where("study_id < 3")
    assert {r[0] for r in gathered.held_by_one(fixed_volumes, moving_volumes).collect()} == {1, 2}
    assert {r[0] for r in gathered.held_by_one(fixed_volumes, moving_volumes, 9 * 8 * 5).collect()} == {1}
    by = [search.search(few(fixed), few(fixed_volumes), few(moving), few(moving_volumes), SHORT._replace(levels=levels), method, most).collect() for most in (gathered.WHOLE, *others)]
    one, *rest = ({r["study_id"]: r for r in rows} for rows in by)
    assert set(one) == {1, 2}
    for other in rest:
        assert set(other) == {1, 2}
        for s in (1, 2):
            assert one[s]["p"] == other[s]["p"] and one[s]["mi"] == other[s]["mi"] and one[s]["fit"] == pytest.approx(other[s]["fit"], abs=1e-12)


def test_rounds_send_no_row_for_each_candidate(spark):
    """Points and moving voxels pass few shuffles; through tables, each start and candidate sends every point."""
    fixed, fixed_volumes, moving, moving_volumes = (df.where("study_id < 3") for df in _body_studies(spark))
    run = lambda most: _sent(spark, lambda: search.search(fixed, fixed_volumes, moving, moving_volumes, SHORT._replace(levels=(1,), rounds=0), most=most).collect())
    points = sum(math.ceil(0.3 * math.prod(r["dims"])) for r in fixed_volumes.collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert run(gathered.WHOLE) < 21 * points < run(0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_of_studies_pass_no_driver(spark):
    """Parameters and matrices of all studies look small to Spark, which does not count arrays; they are not broadcast."""
    fixed, fixed_volumes, moving, moving_volumes = _body_studies(spark)
    maps = search.through(fixed_volumes, fixed_volumes, moving_volumes)
    found = spark.createDataFrame([(1, "Rigid", [0.0] * 12, 1.0, 1.0)], "study_id long, method string, p array<double>, mi double, fit double")
    transforms = search.matrices(found, fixed_volumes)
    state = spark.createDataFrame([(1, 0, [0.0] * 12, 8.0, [0.0] * 12, [1.0] * 12, 0.5)], "study_id long, start int, p array<double>, step double, pull array<double>, unit array<double>, mi double")
    found = spark.createDataFrame([(1, 0, 0, 0.5)], "study_id long, start int, cand int, mi double")
    tables = [search.starts(fixed, fixed_volumes, moving, moving_volumes, 0.1), maps, transforms, registration.apply_linear_transform(moving_volumes, transforms), search._tried(state, maps, 6), search.next_state(state, found, 6)]
    assert not [t for t in tables if "BroadcastExchange" in t._jdf.queryExecution().executedPlan().toString()]
    points = fixed.select("study_id", "i", "j", "k", F.lit(1).alias("fbin"))
    tried = spark.createDataFrame([(1, 0, 0, GRID)], "study_id long, start int, cand int, m array<double>")
    plan = lambda n: search.scores(points, tried, n, search.bricks(moving), SHORT)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan(1) and "BroadcastExchange" not in plan(10**6)


def test_a_moving_voxel_listed_twice_is_refused(spark):
    fixed, fixed_volumes, moving, moving_volumes = (df.where("study_id < 3") for df in _body_studies(spark))
    with pytest.raises(Exception, match="listed twice"):
        search.search(fixed, fixed_volumes, moving.unionByName(moving), moving_volumes, SHORT._replace(levels=(1,)))


def test_studies_come_whole():
    """Batches cut anywhere, studies of one row and of more rows than a table is to have."""
    ids = [1] * 3 + [2] + [4] * 25 + [5] * 2 + [9] * 7
    t = pa.table({"study_id": ids, "n": list(range(len(ids)))})
    for size in (1, 2, 5, 7, 100):
        for rows in (1, 4, 10, 1000):
            tables = list(gathered.whole_studies(iter(t.to_batches(max_chunksize=size)), rows))
            assert pa.concat_tables(tables).to_pydict() == t.to_pydict()
            of = [set(x["study_id"].to_pylist()) for x in tables]
            assert sum(map(len, of)) == 5 and all(x.num_rows <= rows + 25 for x in tables)
