"""Work on few studies with many voxels is dealt over tasks."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from compare import DATA
from pyspark.sql import functions as F

from voxdose.operators import masks, registration
from voxdose.plans import queries
from voxdose.sources import lattice, nrrd, store


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _joins(plan: str, kind: str) -> list[str]:
    return [line for line in plan.splitlines() if kind in line]


def test_grid_is_dealt(spark):
    """1,000 studies, a file of one task, stand for 1.8 million places."""
    assert lattice.grid(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() >= 7


def test_spread(spark):
    one = spark.range(4).coalesce(1)
    assert store.spread(one, F.lit(store.PER_TASK), "id").rdd.getNumPartitions() == 4
    assert store.spread(one.where("id > 9"), F.lit(1), "id").count() == 0


@pytest.mark.parametrize("name", ["mask_volume", "dose_map_relative", "rescale_factor"])
def test_mask_is_not_broadcast(spark, name):
    """Its voxels come from a small file, so Spark takes them for few."""
    plan = _plan(queries.queries()[name](spark, DATA))
    assert not [line for line in _joins(plan, "BroadcastHashJoin") if line.count("#") > 4]  # by study, or by study and segment
    assert [line for line in _joins(plan, "SortMergeJoin") if "LeftSemi" in line]


def test_masked_sums_make_one_join_of_voxels(spark):
    plan = _plan(queries.queries()["segment_stats_rel"](spark, DATA))
    assert "collect_list" not in plan and len([line for line in _joins(plan, "SortMergeJoin") if " i#" in line]) == 1


def test_a_place_listed_twice_counts_twice(spark):
    segments = spark.createDataFrame([(1, "a", "a", 1), (1, "b", "b", 2), (1, "c", "c", 3)], "study_id long, segment_id string, name string, ord int")
    places = spark.createDataFrame([(1, "a", 0, 0, 0), (1, "a", 1, 0, 0), (1, "b", 0, 0, 0), (1, "b", 0, 0, 0), (1, "b", 5, 0, 0)], "study_id long, segment_id string, i int, j int, k int")
    voxels = spark.createDataFrame([(1, 0, 0, 0, 3.0), (1, 5, 0, 0, 7.0)], "study_id long, i int, j int, k int, value double")
    params = spark.createDataFrame([(1, "a")], "study_id long, liver_segment_id string")
    rows = lambda df: {r["segment_id"]: (r["n"], r["total"]) for r in df.collect()}
    assert rows(masks.segment_sums(segments, places, voxels)) == {"a": (2, 3.0), "b": (3, 13.0), "c": (0, 0.0)}
    assert rows(masks.masked_sums(segments, places, voxels, params)) == {"a": (2, 3.0), "b": (3, 6.0), "c": (0, 0.0)}


def test_points_are_dealt(spark):
    volumes = lattice.volumes(spark, "/root/testdata/sf0.1")
    assert registration.lattice_points(volumes).rdd.getNumPartitions() >= 7
    assert masks.lattice_sample(volumes, 1.0).rdd.getNumPartitions() >= 7


def test_control_points_of_bent_studies_alone(spark):
    """Voxels, volumes and control points are cut to the studies that a spline moves, before each control point goes to 64 cells."""
    assert len([line for line in _joins(_plan(queries.queries()["register_methods_voxels"](spark, DATA)), "LeftSemi") if "Join" in line]) == 4  # volumes are read twice


def test_control_points_go_to_boxes(spark):
    """A control point is sent to the boxes of cells that it moves, not to 64 cells; few control points of one box are sent once."""
    plan = _plan(queries.queries()["apply_bspline"](spark, DATA))
    assert "LeftOuter" not in plan and len(_joins(plan, "MapInArrow")) == 1


def test_spline_over_many_boxes(spark):
    """Places on both sides of the first cell, in many boxes and batches, with one control point listed twice, one without a number, and a place without one."""
    control = [(s, a, b, c, float(a * b - c), float(s), None if a == 5 else float(b)) for s in (1, 2) for a in range(-12, 22, s) for b in range(-3, 12) for c in range(0, 3)] + [(1, 0, 0, 0, 4.0, 0.5, 0.25)]
    points = [(s, n, 0, 0, (n % 331) / 4.0 - 40.0, (n % 47) - 10.0, n % 11 - 2.0) for s in (1, 2) for n in range(6000)] + [(1, -1, 0, 0, None, 1.0, 1.0), (3, 0, 0, 0, 1.0, 1.0, 1.0)]
    grid = spark.createDataFrame([(1, [-1.0, 0.0, 0.0], [2.0, 2.0, 4.0]), (2, [0.0, 0.0, -3.0], [2.5, 3.0, 1.0])], "study_id long, origin array<double>, spacing array<double>")
    axes = {1: ((-1.0, 2.0), (0.0, 2.0), (0.0, 4.0)), 2: ((0.0, 2.5), (0.0, 3.0), (-3.0, 1.0))}
    near = {}
    for s, a, b, c, *d in control:
        near.setdefault((s, a, b, c), []).append([x or 0.0 for x in d])
    out = registration.apply_bspline(
        spark.createDataFrame(points, "study_id long, i int, j int, k int, x double, y double, z double"), grid, spark.createDataFrame(control, "study_id long, ci int, cj int, ck int, dx double, dy double, dz double"), "x"
    )
    got = {(r["study_id"], r["i"]): r for r in out.collect()}
    assert len(got) == len(points) - 1 and [got[1, -1][d] for d in ("x", "dx", "dy", "dz")] == [None, 0.0, 0.0, 0.0]
    weights = lambda u: ((1 - u) ** 3 / 6, (3 * u**3 - 6 * u * u + 4) / 6, (-3 * u**3 + 3 * u * u + 3 * u + 1) / 6, u**3 / 6)
    for s, i, _, _, *at in points[0 : len(points) - 2 : 7]:
        u = [(v - o) / w for v, (o, w) in zip(at, axes[s], strict=True)]
        n, w = [math.floor(v) for v in u], [weights(v - math.floor(v)) for v in u]
        want = [0.0, 0.0, 0.0]
        for t in itertools.product(range(4), repeat=3):
            for d in near.get((s, *[m + x - 1 for m, x in zip(n, t, strict=True)]), []):
                want = [a + w[0][t[0]] * w[1][t[1]] * w[2][t[2]] * b for a, b in zip(want, d, strict=True)]
        assert [got[s, i][d] for d in ("dx", "dy", "dz")] == pytest.approx(want, abs=1e-9)


def _sent(spark, run) -> int:
    """Rows that the jobs of ``run`` send through shuffles."""
    of = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    listed = lambda x: {x.apply(n).stageId(): x.apply(n).shuffleWriteRecords() for n in range(x.size())}
    known = listed(of())
    run()
    return sum(n for stage, n in listed(of()).items() if stage not in known)


IDENTITY = [4.0, 0.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_candidates_share_the_bricks_they_are_looked_up_in(spark):
    """A point is sent once for each brick that a round's 35 candidates take it to, and not once for each candidate."""
    volumes = spark.createDataFrame([(1, "v", [16, 16, 8], IDENTITY)], "study_id long, volume_id string, dims array<int>, ijk_to_ras array<double>")
    voxels = spark.createDataFrame([(1, i, j, k, float(i * j * k % 97)) for i in range(16) for j in range(16) for k in range(8)], "study_id long, i int, j int, k int, value double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert 2048 < _sent(spark, lambda: registration.register(voxels, volumes, voxels, volumes, 25.0, 8, share=1.0, rounds=1).collect()) < 16 * 2048
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("most", [registration.WHOLE, 0])
def test_candidates_score_as_pairs_one_by_one(spark, most):
    """Negative places and values, places listed twice and three times, a study without moving voxels and one whose matrix has no inverse, by both ways of counting."""
    rng = random.Random(3)
    fixed = [(s, i, j, k, rng.uniform(-60.0, 250.0)) for s in (1, 2, 3) for i in range(-3, 9) for j in range(6) for k in range(3) if s == 1 or j < 2]
    moving = [(s, i + 1, j, k, v if rng.random() < 0.9 else None) for s, i, j, k, v in fixed if s != 2 and rng.random() < 0.8]
    moving += moving[::9] + moving[::27]
    turned = [0.0, -4.0, 0.0, 10.0, 4.0, 0.0, 0.0, -2.0, *IDENTITY[8:]]
    matrix = {1: (IDENTITY, turned), 2: (IDENTITY, IDENTITY), 3: (IDENTITY, [0.0] * 16)}
    frame = lambda rows: spark.createDataFrame(rows, "study_id long, i int, j int, k int, value double")
    volumes = lambda n: spark.createDataFrame([(s, "v", [9, 6, 3], m[n]) for s, m in matrix.items()], "study_id long, volume_id string, dims array<int>, ijk_to_ras array<double>")
    got = {r["study_id"]: r for r in registration.register(frame(fixed), volumes(0), frame(moving), volumes(1), 25.0, 8, share=1.0, rounds=1, most=most).collect()}
    assert set(got) == {1, 2, 3}
    binned = lambda v: min(math.floor((v or 0.0) / 25.0), 7)
    at = {}
    for s, *place, v in moving:
        at.setdefault((s, *place), []).append(binned(v))
    for s, (to, back) in matrix.items():
        center, best = [16.0, 10.0, 4.0], None
        m = np.linalg.inv(np.array(back).reshape(4, 4)).reshape(-1).tolist() if s < 3 else None
        for cand, step in enumerate(registration.candidate_steps(0)):
            pairs = []
            for _, *place, v in (f for f in fixed if f[0] == s):
                x = registration.moved_point(dict(zip(registration.PARAMETERS, step, strict=True)), center, registration.placed(to, *place))
                to_place = [math.floor(x + 0.5) for x in registration.placed(m, *x)] if m else [None]
                pairs += [(binned(v), b) for b in at.get((s, *to_place), [0])]
            n, t = Counter(pairs), len(pairs)
            f, g = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
            mi = sum(c / t * math.log(c * t / (f[a] * g[b])) for (a, b), c in n.items())
            best = max(best or (-1.0, 0, 0.0), (round(mi, 6), -cand, mi))
        step = registration.candidate_steps(0)[-best[1]]
        assert [got[s][p] for p in registration.PARAMETERS] == list(step) and got[s]["mi"] == pytest.approx(best[2], abs=1e-6)


def test_few_files_at_a_time():
    assert [len(x) for x in nrrd._few(iter([pd.DataFrame({"n": range(200)})]))] == [96, 96, 8]


def test_register_candidates_goes_on_to_turns_and_growth(spark):
    """The best shift in voxels is where the rounds of shifts, turns and growth begin; here the moving image is a copy shifted by whole voxels, so no round finds better."""
    got = {r["study_id"]: r for r in queries.queries()["register_candidates"](spark, DATA).collect()}
    spacing = {r["study_id"]: r["spacing"] for r in lattice.volumes(spark, DATA).collect()}
    assert len(got) == 10 and {r["cand"] for r in got.values()} == {0, 3, 6}
    for s, r in got.items():
        assert [r[p] for p in registration.PARAMETERS] == [queries.SEARCH[r["cand"]][0] * spacing[s][0], *[0.0] * 6]
        assert r["fine_mi"] == r["mi"]
