"""Segments pass the shuffle as bits of boxes, not place by place."""

import math
from collections import Counter

import pytest
from compare import DATA

from voxdose.operators import masks, registration
from voxdose.plans import queries
from voxdose.sources import lattice, nrrd


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_boxes_hold_the_places(spark):
    places = lattice.segment_voxels(spark, DATA)
    boxes = masks.bit_boxes(places)
    assert boxes.count() * 8 < places.count()
    assert boxes.selectExpr("sum(n)", "sum(bit_count(mask))").first()[:] == (places.count(),) * 2


@pytest.mark.parametrize("name", ["segment_counts", "segment_stats_rel", "segment_dedup", "rasterize_segment"])
def test_places_are_not_shuffled_one_by_one(spark, name):
    """They are folded by a native aggregate: before the plan, which reads the masks, or below its first exchange."""
    plan = _plan(queries.queries()[name](spark, DATA))
    assert "collect_set" not in plan and "collect_list" not in plan
    assert "partial_bit_or" in plan if name == "rasterize_segment" else "mask#" in plan


def test_places_beyond_the_first_box_and_below_zero(spark):
    """Places of both signs, listed up to three times; one without a coordinate counts as a row but has no value."""
    rows = [(1, "a", -1, 0, 0), (1, "a", -1, 0, 0), (1, "a", -1, 0, 0), (1, "a", 4, 9, 0), (1, "a", 5, 9, 0), (1, "a", 5, 9, 0), (1, "a", None, 0, 0), (1, "b", 4, 9, 0)]
    places = spark.createDataFrame(rows, "study_id long, segment_id string, i int, j int, k int")
    segments = spark.createDataFrame([(1, "a", "a", 1), (1, "b", "b", 2), (2, "a", "a", 1)], "study_id long, segment_id string, name string, ord int")
    voxels = spark.createDataFrame([(1, -1, 0, 0, 2.0), (1, 4, 9, 0, 10.0), (1, 5, 9, 0, 100.0), (1, 6, 9, 0, 1000.0), (2, 0, 0, 0, 1.0)], "study_id long, i int, j int, k int, value double")
    params = spark.createDataFrame([(1, "b"), (2, "b")], "study_id long, liver_segment_id string")
    got = lambda df: {(r["study_id"], r["segment_id"]): (r["n"], r["total"]) for r in df.collect()}
    assert got(masks.segment_sums(segments, places, voxels)) == {(1, "a"): (7, 216.0), (1, "b"): (1, 10.0), (2, "a"): (0, 0.0)}
    assert got(masks.masked_sums(segments, places, voxels, params)) == {(1, "a"): (7, 10.0), (1, "b"): (1, 10.0), (2, "a"): (0, 0.0)}


def test_files_are_dealt_over_tasks(spark):
    """1,000 studies, whose masks Spark would bring together in a task."""
    files = queries._segmentations(queries._Lattice(spark, "/root/testdata/sf0.1"))
    assert "REPARTITION_BY_NUM" in _plan(files) and "partial_bit_or" in _plan(files)


def test_unreadable_files_beside_others(spark):
    """Rows of many files share frames; an unreadable file keeps its row of nulls, and a file without segments has none."""
    member = "members array<struct<segment_id:string,name:string,label_value:int,layer:int,places:array<int>>>"
    eye = [float(n % 5 == 0) for n in range(16)]
    made = spark.createDataFrame([(f"{n}.nrrd", [4, 4, 4], eye, [("a", "A", 1, 0, [0, 5]), ("b", "B", 2, 1, [5]), ("c", "C", 3, 1, [])]) for n in range(3)], f"path string, dims array<int>, ijk_to_ras array<double>, {member}")
    files = nrrd.export_segmentation(made).unionByName(spark.createDataFrame([("bad", bytearray(b"none"))], "path string, content binary")).coalesce(1)
    got = sorted(map(tuple, nrrd.segment_voxels(files).collect()), key=str)
    each = [("a", 0, 0, 0), ("a", 1, 1, 0), ("b", 1, 1, 0)]
    assert [r for r in got if r[5] == "ok"] == sorted([(f"{n}.nrrd", *r, "ok") for n in range(3) for r in each], key=str)
    assert [r[:5] for r in got if r[5] != "ok"] == [("bad", None, None, None, None)]
    assert {(r["segment_id"], r["name"], r["ord"], r["label_value"], r["layer"]) for r in nrrd.segments(files).where("status = 'ok'").collect()} == {("a", "A", 1, 1, 0), ("b", "B", 2, 2, 1), ("c", "C", 3, 3, 1)}


def test_joint_histograms_are_shuffled_once_more(spark):
    """One exchange counts the pairs, one more serves all windows over them."""
    pairs = spark.range(64).selectExpr("id % 2 AS study_id", "id % 3 AS cand", "id % 5 AS fbin", "id % 7 AS mbin")
    assert _plan(registration.mutual_information(pairs)).count("Exchange hashpartitioning") == 2


def test_lines_meet_not_voxels(spark):
    """Candidates along all axes, out of order and one of them twice, against plain Python."""
    shifts = [(0, 0, 0), (1, 0, 0), (-1, 1, 0), (1, 0, -1), (0, 1, 0), (1, 0, 0)]
    value = lambda n, i, j, k: float((n * 7 + i * 5 + j * 3 + k * 11 + i * j) % 40)
    images = [{(n, i, j, k): value(m + n, i, j, k) for n in range(2) for i in range(5) for j in range(4) for k in range(3) if (i + j + k + m) % 4} for m in range(2)]
    frames = [spark.createDataFrame([(*at, v) for at, v in x.items()], "study_id long, i int, j int, k int, value double") for x in images]
    scores = registration.score_candidates(*frames, shifts, 10.0, 3)
    assert not [line for line in _plan(scores).splitlines() if "SortMergeJoin" in line and " i#" in line]
    found = {(r["study_id"], r["cand"]): r["mi"] for r in scores.collect()}
    for n in range(2):
        for c, s in enumerate(shifts):
            pairs = Counter((min(v // 10, 2), min(images[1].get((n, *(a + b for a, b in zip(at[1:], s, strict=True))), 0.0) // 10, 2)) for at, v in images[0].items() if at[0] == n)
            f, m, t = Counter(), Counter(), sum(pairs.values())
            for (a, b), q in pairs.items():
                f[a] += q
                m[b] += q
            assert found[n, c] == pytest.approx(sum(q / t * math.log(q * t / (f[a] * m[b])) for (a, b), q in pairs.items()))
    assert len(found) == 12


def test_a_moving_place_listed_twice_pairs_twice(spark):
    schema = "study_id long, i int, j int, k int, value double"
    fixed = spark.createDataFrame([(1, 0, 0, 0, 1.0), (1, 1, 0, 0, 11.0)], schema)
    moving = spark.createDataFrame([(1, 0, 0, 0, 1.0), (1, 0, 0, 0, 11.0), (1, 1, 0, 0, 11.0)], schema)
    found = registration.score_candidates(fixed, moving, [(0, 0, 0)], 10.0, 3).collect()
    third = 1 / 3
    assert found[0]["mi"] == pytest.approx(third * math.log(3 / 2) + third * math.log(3 / 4) + third * math.log(3 / 2))
