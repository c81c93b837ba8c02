"""A small study worked out by hand, and properties that hold for any study."""

import bz2
import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxdose.functions import scalar as S
from voxdose.operators import dosimetry, masks, registration, tables, validate
from voxdose.sources import bricks, nrrd
from voxdose.streaming import absolute

COUNTS = [10.0, 20.0, 30.0, 40.0, 5.0, 5.0, 0.0, 90.0]
INSIDE = {"liver": [0, 1, 2, 3], "tumor": [2, 3], "lung": [4, 5], "edge": [3, 4], "ghost": []}
EYE = [4.0, 0.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 0.0, 1.0]


@pytest.fixture(scope="module")
def study(spark):
    make = spark.createDataFrame
    params = (1, "liver", "lung", "tumor", 1000.0, 10.0, 49.67, 1000.0, 1.05, 120.0, 24.0, 64.2)
    return {
        "voxels": make([(1, i, 0, 0, v) for i, v in enumerate(COUNTS)], "study_id long, i int, j int, k int, value double"),
        "volumes": make([(1, "nm", [8, 1, 1], [4.0, 4.0, 4.0], EYE, "n", {"a": "b"})], "study_id long, volume_id string, dims array<int>, spacing array<double>, ijk_to_ras array<double>, name string, attributes map<string,string>"),
        "segments": make([(1, s, s, n + 1) for n, s in enumerate(INSIDE)], "study_id long, segment_id string, name string, ord int"),
        "segment_voxels": make([(1, s, i, 0, 0) for s, x in INSIDE.items() for i in x], "study_id long, segment_id string, i int, j int, k int"),
        "params": make([params], "study_id long, liver_segment_id string, lung_segment_id string, target_segment_id string, activity_mbq double, lsf_percent double, conv_factor double, lung_mass_g double, density_g_ml double, target_dose_gy double, hours double, half_life_h double"),
    }


def stats(study, **changed):
    x = study | changed
    rows = dosimetry.segment_stats_relative(x["segments"], x["segment_voxels"], x["voxels"], x["volumes"], x["params"]).collect()
    return {r["segment_id"]: (r["dose_gy"], r["volume_ml"], r["activity_mbq"]) for r in rows}


def test_shunt(study):
    sums = masks.segment_sums(study["segments"], study["segment_voxels"], study["voxels"])
    r = masks.lung_shunt(sums, study["params"]).first()
    assert (r["lung_counts"], r["liver_counts"]) == (10, 100)
    assert r["lsf_percent"] == pytest.approx(9.090909090909092)


def test_relative_statistics(study):
    got = stats(study)
    assert got["liver"] == pytest.approx((166305.80357142855, 0.256, 900))
    assert got["tumor"] == pytest.approx((232828.125, 0.128, 630))
    assert got["lung"] == pytest.approx((0, 0.128, 0))
    assert got["edge"] == pytest.approx((133044.64285714284, 0.128, 360))
    assert got["ghost"] == (None, 0, None)


def test_relative_map(study):
    rows = dosimetry.dose_map_relative(study["voxels"], study["segment_voxels"], study["volumes"], study["params"]).collect()
    assert {r["i"]: r["dose"] for r in rows} == pytest.approx({0: 66522.32142857, 1: 133044.64285714, 2: 199566.96428571, 3: 266089.28571429})


def test_dense_and_sparse_agree(study):
    assert stats(study, voxels=study["voxels"].where("value <> 0")) == stats(study)


def test_dose_is_linear_in_activity(study):
    twice = stats(study, params=study["params"].withColumn("activity_mbq", F.lit(2000.0)))
    assert twice["tumor"][0] == pytest.approx(2 * stats(study)["tumor"][0])


def target(study, **changed):
    x = study | changed
    masked = masks.mask_volume(x["voxels"], masks.segment_of(x["segment_voxels"], x["params"], "liver"))
    return dosimetry.activity_for_target(x["volumes"], x["params"], masks.segment_sums(x["segments"], x["segment_voxels"], masked)).first()


def test_target_dose_is_reached(study):
    a = target(study)["activity_mbq"]
    assert a == pytest.approx(0.515401650895913)
    assert stats(study, params=study["params"].withColumn("activity_mbq", F.lit(a)))["tumor"][0] == pytest.approx(120)
    assert target(study, params=study["params"].withColumn("target_dose_gy", F.lit(0.0)))["activity_mbq"] == 1000
    outside = target(study, params=study["params"].withColumn("target_segment_id", F.lit("lung")))
    assert outside["activity_mbq"] is None and outside["status"] == "no_target_dose"
    much = target(study, params=study["params"].withColumn("target_dose_gy", F.lit(1e9)))
    assert much["activity_reported_mbq"] == 10000 < much["activity_mbq"]


@pytest.mark.parametrize(("column", "value"), [("density_g_ml", 0.0), ("conv_factor", 0.0)])
def test_zero_divisors_give_null(study, column, value):
    assert stats(study, params=study["params"].withColumn(column, F.lit(value)))["tumor"][2] is None


def test_absent_liver_and_empty_image(study):
    assert stats(study, params=study["params"].withColumn("liver_segment_id", F.lit("none")))["liver"][0] is None
    assert stats(study, voxels=study["voxels"].where("false"))["liver"][0] is None


def test_lung_dose_and_decay(spark):
    x = spark.range(1).select(S.lung_dose(*map(F.lit, (1000.0, 10.0, 49.67, 1000.0))).alias("lung"), S.lung_dose(*map(F.lit, (1.0, 1.0, 1.0, 0.0))).alias("none"), S.decayed(*map(F.lit, (3.0, 64.2, 64.2))).alias("twice")).first()
    assert x["lung"] == pytest.approx(4.967) and x["none"] is None and x["twice"] == pytest.approx(6)


def test_absolute(study, spark, tmp_path):
    calibrated = study["voxels"].withColumn("value", F.col("value") * 1e5)
    doses = {r["i"]: r["dose"] for r in dosimetry.dose_map_absolute(calibrated, study["params"]).collect()}
    assert np.mean([doses[i] for i in INSIDE["liver"]]) == pytest.approx(153.24257726139015)
    assert np.mean([doses[i] for i in INSIDE["edge"]]) == pytest.approx(137.91831953525113)
    whole = calibrated.groupBy("study_id").agg(F.sum("value").alias("total"), F.lit(0.064).alias("v_ml"))
    r = dosimetry.total_activity(whole, study["params"]).first()
    assert (r["total_mbq"], r["decay_corrected_mbq"]) == pytest.approx((1.28, 1.658611023469365))
    calibrated.write.parquet(str(tmp_path / "in"))
    stream = absolute.dose_stream(spark.readStream.schema(calibrated.schema).parquet(str(tmp_path / "in")), study["params"])
    absolute.write_dose_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {r["i"]: r["dose"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == pytest.approx(doses)


def test_crop_twice_is_crop(study):
    rois = study["volumes"].select("study_id", F.array(*map(F.lit, (14.0, 0.0, 0.0))).alias("center"), F.array(*map(F.lit, (12.0, 8.0, 8.0))).alias("size"))
    once = masks.crop_roi(study["voxels"], study["volumes"], rois)
    new = masks.crop_volume(study["volumes"], rois)
    assert sorted((r["i"], r["value"]) for r in once.collect()) == [(0, 30.0), (1, 40.0), (2, 5.0), (3, 5.0)]  # voxels 2 to 5, renumbered
    assert new.first()["dims"] == [4, 1, 1] and new.first()["ijk_to_ras"][3] == 8.0
    assert sorted(map(tuple, masks.crop_roi(once, new, rois).collect())) == sorted(map(tuple, once.collect()))


def test_transform_and_inverse(spark, study):
    m = [0.0, -1.0, 0.0, 5.0, 1.5, 0.0, 0.0, -2.0, 0.0, 0.0, 2.0, 7.0, 0.0, 0.0, 0.0, 1.0]
    t = spark.createDataFrame([(1, m)], "study_id long, matrix array<double>")
    there = registration.apply_linear_transform(study["volumes"], t)
    back = registration.apply_linear_transform(there, t.withColumn("matrix", S.inverse(F.col("matrix"))))
    assert back.first()["ijk_to_ras"] == pytest.approx(EYE)
    same = masks.rasterize_segment(study["segment_voxels"], study["volumes"], study["volumes"])
    assert same.count() == study["segment_voxels"].count()


def test_bricks_round_trip(study):
    v = study["voxels"].withColumn("volume_id", F.lit("nm"))
    back = bricks.voxels_from_bricks(bricks.bricks_from_voxels(v)).where("value <> 0")
    assert {r["i"]: r["value"] for r in back.collect()} == {i: v for i, v in enumerate(COUNTS) if v}


def test_duplicate_names(study):
    x = dosimetry.segment_stats_relative(study["segments"].withColumn("name", F.when(F.col("segment_id") == "edge", "tumor").otherwise(F.col("name"))), study["segment_voxels"], study["voxels"], study["volumes"], study["params"])
    rows = {r["name"]: r for r in tables.last_of_name(x).collect()}
    assert rows["tumor"]["ord"] == 2 and rows["tumor"]["segment_id"] == "edge"


def test_two_decimals(spark):
    x = spark.createDataFrame([(0.125,), (2.675,), (None,)], "x double")
    assert [r[0] for r in x.select(tables.two_decimals(F.col("x"))).collect()] == ["0.13", "2.68", None]
    assert [r[0] for r in x.select(tables.two_decimals(F.col("x"), compat=True)).collect()] == ["0.12", "2.67", None]


def test_status_and_ranges(study, spark):
    assert validate.study_status(study["volumes"].select("study_id"), study["volumes"], study["voxels"]).first()["status"] == "ok"
    assert validate.param_violations(study["params"].withColumn("hours", F.lit(201.0))).first()["violations"] == "hours"
    with pytest.raises(Exception, match="study 1: no_voxels"):
        validate.study_status(study["volumes"].select("study_id"), study["volumes"], study["voxels"].where("false"), strict=True).collect()


@pytest.mark.parametrize("kind", ["uint8", "short", "float", "double"])
def test_nrrd(spark, kind, tmp_path):
    values = np.arange(24)
    for name, pack in (("raw", bytes), ("gzip", gzip.compress)):
        head = f"NRRD0004\n# made here\ntype: {kind}\ndimension: 3\nsizes: 4 3 2\nencoding: {name}\nendian: big\nkey:=x\n\n"
        (tmp_path / f"{name}.nrrd").write_bytes(head.encode() + pack(values.astype(">" + nrrd.TYPES[kind]).tobytes()))
    (tmp_path / "bad.nrrd").write_bytes(b"no image")
    rows = nrrd.ingest(nrrd.read_files(spark, str(tmp_path))).collect()
    ok = [r for r in rows if r["status"] == "ok"]
    assert len(ok) == 2 * 23 and all(r["value"] == r["i"] + 4 * r["j"] + 12 * r["k"] for r in ok)
    assert [r["i"] for r in rows if r["status"] != "ok"] == [None]


def test_bspline_of_constant_grid(spark, study):
    grid = spark.createDataFrame([(1, [-8.0, -8.0, -8.0], [8.0, 8.0, 8.0])], "study_id long, origin array<double>, spacing array<double>")
    control = spark.createDataFrame([(1, a, b, c, 3.0, 0.0, -1.0) for a in range(-1, 9) for b in range(-1, 5) for c in range(-1, 5)], "study_id long, ci int, cj int, ck int, dx double, dy double, dz double")
    points = study["voxels"].select(*masks.AT, *[(F.col(a) * 4.0).alias(n) for a, n in zip("ijk", "xyz", strict=True)])
    for r in registration.apply_bspline(points, grid, control).collect():
        assert (r["dx"], r["dy"], r["dz"]) == pytest.approx((3.0, 0.0, -1.0))


def test_deriving_twice(spark):
    v = spark.createDataFrame([(1, "nm", {"a": "b"}), (2, "nm", {"DicomRtImport.DoseVolume": "0"}), (3, "nm", None)], "study_id long, volume_id string, attributes map<string,string>")
    twice = masks.derive_volume(masks.derive_volume(v, "dose"), "again")
    assert {r["study_id"]: r["attributes"] for r in twice.collect()} == {1: {"a": "b", "DicomRtImport.DoseVolume": "1"}, 2: {"DicomRtImport.DoseVolume": "1"}, 3: {"DicomRtImport.DoseVolume": "1"}}


def test_report_rounds_like_python(spark):
    table = spark.createDataFrame([(1, 1, "a", 0.125, 2.675, None), (1, 2, "b", None, 1.005, 0.5)], "study_id long, ord int, name string, dose_gy double, volume_ml double, activity_mbq double")
    heads = spark.createDataFrame([(1, "t", "now", ["p"])], "study_id long, title string, stamp string, parameters array<string>")
    text = tables.report(table, heads, compat=True).first()["report"]
    assert "Segment: a, Dose = 0.12 Gy, Volume = 2.67 mL\\line\\n Segment: b, Volume = 1.00 mL, Activity = 0.50 MBq\\line\\n " in text
    assert "Dose = 0.13 Gy, Volume = 2.68 mL\\line\n" in tables.report(table, heads).first()["report"]


MATRIX = [0.0, -2.0, 0.0, 5.0, 3.0, 0.0, 0.0, -1.0, 0.0, 0.0, 4.0, 7.0, 0.0, 0.0, 0.0, 1.0]


def test_images(spark):
    """Spaces, line ends, type names, encodings, detached data, layers on any axis, and files that cannot be read."""
    grid = np.arange(24, dtype="<i2").reshape(4, 3, 2)  # k, j, i
    head = lambda *more: "\r\n".join(["NRRD0005", "# note", "dimension: 3", "sizes: 2 3 4", "type: signed short int", *more, "", ""]).encode()
    directions = "space directions: (0,3,0) (-2,0,0) (0,0,4)"
    files = [
        ("d/ras.nrrd", head("space: right-anterior-superior", directions, "space origin: (5,-1,7)", "endian: little", "encoding: raw") + grid.tobytes()),
        ("d/lps.nrrd", head("space: LPS", "space directions: (0,-3,0) (2,0,0) (0,0,4)", "space origin: (-5,1,7)", "encoding: ascii") + " ".join(map(str, grid.ravel())).encode()),
        ("d/plain.nrrd", head("spacings: 2 3 4", "endian: big", "encoding: bzip2") + bz2.compress(grid.astype(">i2").tobytes())),
        ("d/apart.nhdr", head("encoding: raw", "data file: ./apart.raw")[:-4]),
        ("d/apart.raw", grid.tobytes()),
        ("d/layers.nrrd", b"NRRD0004\ndimension: 4\nsizes: 2 3 4 2\ntype: uint8\nencoding: raw\nspace directions: (1,0,0) (0,1,0) (0,0,1) none\nSegment0_ID:=S1\nSegment0_LabelValue:=2\nSegment0_Layer:=1\nSegment1_ID:=S2\nSegment1_Name:=two\n\n" + bytes([1] + [0] * 23 + [2, 0, 2] + [0] * 21)),
        ("d/empty.nrrd", b""),
        ("d/short.nrrd", head("encoding: raw") + b"12"),
        ("d/odd.nrrd", b"NRRD0004\nsizes: 2 2\ntype: block\nencoding: raw\n\n1234"),
    ]
    whole = nrrd.attached(spark.createDataFrame(files, "path string, content binary"))
    volumes = {r["path"]: r for r in nrrd.volumes(whole).collect()}
    assert "d/apart.raw" not in volumes and volumes["d/empty.nrrd"]["status"].startswith("error") and volumes["d/odd.nrrd"]["status"].startswith("error")
    for name in ("d/ras.nrrd", "d/lps.nrrd"):
        assert volumes[name]["ijk_to_ras"] == MATRIX and volumes[name]["dims"] == [2, 3, 4] and volumes[name]["spacing"] == [3.0, 2.0, 4.0]
    assert volumes["d/plain.nrrd"]["spacing"] == [2.0, 3.0, 4.0] and volumes["d/layers.nrrd"]["layers"] == 2
    voxels = nrrd.ingest(whole).collect()
    want = {(i, j, k, float(grid[k, j, i])) for i in range(2) for j in range(3) for k in range(4) if grid[k, j, i]}
    for name in ("d/ras.nrrd", "d/lps.nrrd", "d/plain.nrrd", "d/apart.nhdr"):
        assert {(r["i"], r["j"], r["k"], r["value"]) for r in voxels if r["path"] == name} == want
    assert {r["status"] for r in voxels if r["path"] == "d/short.nrrd"} == {"error: ValueError"}
    segments = {r["segment_id"]: (r["name"], r["ord"], r["label_value"], r["layer"]) for r in nrrd.segments(whole).where("segment_id is not null").collect()}
    assert segments == {"S1": ("S1", 1, 2, 1), "S2": ("two", 2, 1, 0)}
    inside = {(r["segment_id"], r["i"], r["j"], r["k"]) for r in nrrd.segment_voxels(whole).where("segment_id is not null").collect()}
    assert inside == {("S1", 0, 0, 0), ("S1", 0, 1, 0), ("S2", 0, 0, 0)}


def test_crop_of_turned_and_missed_boxes(spark):
    volumes = spark.createDataFrame([(1, [10, 10, 10], MATRIX), (2, [10, 10, 10], MATRIX)], "study_id long, dims array<int>, ijk_to_ras array<double>")
    rois = spark.createDataFrame([(1, [-1.0, 8.0, 15.0], [8.0, 12.0, 8.0]), (2, [900.0, 0.0, 0.0], [1.0, 1.0, 1.0])], "study_id long, center array<double>, size array<double>")
    voxels = spark.createDataFrame([(s, i, j, k, float(100 * i + 10 * j + k + 1)) for s in (1, 2) for i in range(10) for j in range(10) for k in range(10)], "study_id long, i int, j int, k int, value double")
    want = {}
    for i in range(10):
        for j in range(10):
            for k in range(10):
                x, y, z = -2.0 * j + 5, 3.0 * i - 1, 4.0 * k + 7
                if abs(x + 1) <= 4 and abs(y - 8) <= 6 and abs(z - 15) <= 4:
                    want[x, y, z] = float(100 * i + 10 * j + k + 1)
    new = {r["study_id"]: r for r in masks.crop_volume(volumes, rois).collect()}
    m = new[1]["ijk_to_ras"]
    got = {}
    for r in masks.crop_roi(voxels, volumes, rois).collect():
        assert r["study_id"] == 1 and all(0 <= r[c] < n for c, n in zip("ijk", new[1]["dims"], strict=True))
        got[tuple(m[4 * a] * r["i"] + m[4 * a + 1] * r["j"] + m[4 * a + 2] * r["k"] + m[4 * a + 3] for a in range(3))] = r["value"]
    assert got == want and 0 in new[2]["dims"]


def test_registration_finds_a_shift_and_a_scale(spark):
    rng = np.random.default_rng(0)
    blob = {(i, j, k): float(rng.integers(1, 200)) for i in range(12) for j in range(12) for k in range(6)}
    identity = [4.0, 0.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    volumes = spark.createDataFrame([(1, "v", [12, 12, 6], identity)], "study_id long, volume_id string, dims array<int>, ijk_to_ras array<double>")
    frame = lambda d: spark.createDataFrame([(1, *at, v) for at, v in d.items()], "study_id long, i int, j int, k int, value double")
    moved = {(i + 1, j, k - 1): v for (i, j, k), v in blob.items()}
    best = registration.register(frame(blob), volumes, frame(moved), volumes, 25.0, 8, share=1.0).first()
    assert (round(best["tx"]), best["ty"], round(best["tz"])) == (4, 0.0, -4) and best["mi"] > 1
    stretched = [x * 1.1 if n % 5 == 0 and n < 15 else x for n, x in enumerate(identity)]
    center = [5.5 * 4, 5.5 * 4, 2.5 * 4]
    for a in range(3):
        stretched[4 * a + 3] = -0.1 * center[a]
    scaled = volumes.withColumn("ijk_to_ras", F.array(*map(F.lit, stretched)))
    best = registration.register(frame(blob), volumes, frame(blob), scaled, 25.0, 8, share=1.0).first()
    assert abs(best["g"] - 0.1) < 1e-9 and best["tx"] == 0.0


def test_hardening_shifts_by_a_constant_field(spark):
    """All control points alike: the sum of weights is 1, so every voxel moves by the same displacement."""
    identity = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    volumes = spark.createDataFrame([(1, [6, 6, 6], identity)], "study_id long, dims array<int>, ijk_to_ras array<double>")
    grid = spark.createDataFrame([(1, [-4.0] * 3, [4.0] * 3)], "study_id long, origin array<double>, spacing array<double>")
    control = spark.createDataFrame([(1, a, b, c, 1.0, 0.0, -2.0) for a in range(6) for b in range(6) for c in range(6)], "study_id long, ci int, cj int, ck int, dx double, dy double, dz double")
    voxels = spark.createDataFrame([(1, i, 2, 1, float(i + 1)) for i in range(6)], "study_id long, i int, j int, k int, value double")
    out = {(r["i"], r["j"], r["k"]): r["value"] for r in registration.harden_bspline(voxels, volumes, grid, control).collect()}
    assert out == {(i - 1, 2, 3): float(i + 1) for i in range(1, 6)}


def test_rounds_begin_at_a_start(spark):
    """A shift beyond the reach of the rounds is found from a start near it; a study that the start leaves out begins at 0."""
    rng = np.random.default_rng(0)
    blob = {(i, j, k): float(rng.integers(1, 200)) for i in range(12) for j in range(12) for k in range(6)}
    identity = [4.0, 0.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    volumes = spark.createDataFrame([(n, "v", [12, 12, 6], identity) for n in (1, 2)], "study_id long, volume_id string, dims array<int>, ijk_to_ras array<double>")
    frame = lambda by: spark.createDataFrame([(n, i + by, j, k - 1, v) for n in (1, 2) for (i, j, k), v in blob.items()], "study_id long, i int, j int, k int, value double")
    start = spark.createDataFrame([(1, 20.0, 0.0, None)], "study_id long, tx double, ty double, tz double")
    fixed = frame(0).withColumn("k", F.col("k") + 1)
    for most in (registration.WHOLE, 0):
        got = {r["study_id"]: r for r in registration.register(fixed, volumes, frame(6), volumes, 25.0, 8, share=1.0, most=most, start=start).collect()}
        assert (round(got[1]["tx"]), got[1]["ty"], round(got[1]["tz"])) == (24, 0.0, -4) and got[1]["mi"] > 1
        assert abs(got[2]["tx"]) <= 7 and got[2]["mi"] < 1
