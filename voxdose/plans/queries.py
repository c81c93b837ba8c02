"""The registered queries of the dosimetry library, over the adapters of ``sources.lattice``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.scalar import grid_size
from ..operators import dosimetry, masks, registration, search, tables, validate
from ..sources import bricks, lattice, nrrd, nrrd_split, reports
from ..sources.store import settled, shared_dir, stored, tasks

STAMP = "2024-01-01 00:00:00"
SHIFTS = [(s, 0, 0) for s in (0, -1, 1)]
SEARCH = [(a, b, 0) for a in (0, -1, 1) for b in (0, -1, 1)]
WIDTH, BINS = 25.0, 8


def _r(c: str, name: str | None = None):
    return F.round(c, 6).alias(name or c)


class _Lattice:
    """The tables of the count images, read when asked for."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(lattice, name)(self.spark, self.d)


def _voxels_from_bricks(t: _Lattice) -> DataFrame:
    return bricks.voxels_from_bricks(t.bricks).select("study_id", "i", "j", "k", _r("value"))


def _bricks_from_voxels(t: _Lattice) -> DataFrame:
    b = bricks.bricks_from_voxels(t.voxels)
    return b.select("study_id", "bi", "bj", "bk", F.array_join(F.transform("values", lambda x: x.cast("int").cast("string")), ",").alias("values"))


def _derive_volume(t: _Lattice) -> DataFrame:
    v = masks.derive_volume(t.volumes, "dose")
    return v.select("study_id", "volume_id", "name", F.col("spacing")[0].alias("sx"), F.col("attributes")["DicomRtImport.DoseVolume"].alias("dose_volume"))


def _grid(*columns: str) -> Callable[[_Lattice], DataFrame]:
    return lambda t: masks.grid_stats(t.volumes, t.voxels).select("study_id", *[_r(c) for c in columns])


def _xyz(df: DataFrame, column: str) -> DataFrame:
    return df.select("study_id", *[F.round(F.col(column)[a], 6).alias(n) for a, n in enumerate("xyz")])


def _default_roi(t: _Lattice) -> DataFrame:
    r = masks.default_roi(t.volumes)
    return r.select("study_id", *[F.round(F.col("center")[a], 6).alias(n) for a, n in enumerate("xyz")], *[F.col("size")[a].alias(f"s{n}") for a, n in enumerate("xyz")])


def _roi(t: _Lattice) -> DataFrame:
    return masks.default_roi(t.volumes, (20.0, 30.0, 16.0))


def _crop_volume(t: _Lattice) -> DataFrame:
    v = masks.crop_volume(t.volumes, _roi(t))
    return v.select("study_id", *[F.col("dims")[a].alias(f"n{c}") for a, c in enumerate("ijk")], *[F.round(F.col("ijk_to_ras")[4 * a + 3], 6).alias(c) for a, c in enumerate("xyz")])


def _target_grid(t: _Lattice) -> DataFrame:
    three = F.array(*map(F.lit, (3.0, 0.0, 0.0, 0.0, 0.0, 3.0, 0.0, 2.0, 0.0, 0.0, 3.0, -3.0, 0.0, 0.0, 0.0, 1.0)))
    return t.volumes.withColumn("dims", F.array(*map(F.lit, (12, 20, 8)))).withColumn("ijk_to_ras", three)


def _rasterize(t: _Lattice) -> DataFrame:
    x = masks.rasterize_segment(t.segment_voxels, t.volumes, _target_grid(t))
    return x.groupBy("study_id", "segment_id").agg(F.count("*").alias("n"), F.sum("i").alias("si"), F.sum("j").alias("sj"), F.sum("k").alias("sk"))


def _sums(t: _Lattice) -> DataFrame:
    return masks.segment_sums(t.segments, t.segment_voxels, t.voxels)


def _rel(t: _Lattice) -> DataFrame:
    return dosimetry.segment_stats_relative(t.segments, t.segment_voxels, t.voxels, t.volumes, t.params)


def _stats(df: DataFrame) -> DataFrame:
    return df.select("study_id", "ord", "name", _r("dose_gy"), _r("volume_ml"), _r("activity_mbq"))


def _event_sums(t: _Lattice, *keys: str) -> DataFrame:
    x = t.event_voxels.groupBy("study_id", *keys)
    return x.agg(F.sum(F.col("mbq_ml").cast("decimal(18,2)")).cast("double").alias("sum_mbq_ml"), F.count("*").alias("n"))


def _stats_abs(t: _Lattice) -> DataFrame:
    x = _event_sums(t, "segment_id").join(masks.small(dosimetry.absolute_factors(t.event_params)), "study_id")
    x = x.withColumn("total", F.col("sum_mbq_ml") * 1e6)
    order = F.array_position(F.array_sort(F.collect_set("segment_id").over(_by_study())), F.col("segment_id")).cast("int")
    return x.select("study_id", order.alias("ord"), "segment_id", F.col("segment_id").alias("name"), *dosimetry._statistics(x, F.col("factor"), F.col("v")))


def _by_study():
    from pyspark.sql import Window

    return Window.partitionBy("study_id")


def _activity_abs(t: _Lattice) -> DataFrame:
    p = t.event_params
    sums = _event_sums(t).join(p.select("study_id", "v"), "study_id").select("study_id", (F.col("sum_mbq_ml") * 1e6).alias("total"), F.col("v").alias("v_ml"))
    return dosimetry.total_activity(sums, p)


def _dose_map_absolute(t: _Lattice) -> DataFrame:
    v = t.event_voxels.select("study_id", "i", (F.col("mbq_ml") * 1e6).alias("value"))
    return dosimetry.dose_map_absolute(v, t.event_params).select("study_id", "i", _r("dose"))


def _isotope(t: _Lattice) -> DataFrame:
    s = t.volumes.select("study_id", F.when(F.col("study_id") % 3 == 0, "Y-90").when(F.col("study_id") % 3 == 1, "Ho-166").otherwise("other").alias("isotope"))
    return dosimetry.isotope_factor(s).select("study_id", "isotope", "conv_factor", "half_life_h")


def _varied(t: _Lattice) -> DataFrame:
    """Parameters that differ between studies."""
    p, s = t.params, F.col("study_id")
    return p.withColumn("lsf_percent", (s % 120).cast("double")).withColumn("activity_mbq", (s % 7 * 2000).cast("double")).withColumn("lung_mass_g", F.when(s % 11 == 0, 0.0).otherwise(1000.0))


def _rescale(t: _Lattice) -> DataFrame:
    """Mean output dose over mean masked input: the stepwise form of the factor."""
    stats = masks.grid_stats(t.volumes, masks.mask_volume(t.voxels, masks.segment_of(t.segment_voxels, t.params, "liver")))
    x = stats.join(t.params, "study_id")
    mean_dose = S.over(S.shunted(F.col("activity_mbq"), F.col("lsf_percent")), F.col("total_ml") * F.col("density_g_ml")) * F.col("conv_factor")
    return x.select("study_id", F.round(mean_dose, 6).alias("mean_dose_gy"), F.round(S.over(mean_dose, F.col("mean")), 6).alias("factor"))


def _lung(t: _Lattice) -> DataFrame:
    return t.params.select("study_id", S.lung_dose(*[F.col(c) for c in ("activity_mbq", "lsf_percent", "conv_factor", "lung_mass_g")]).alias("lung_dose_gy"))


def _target(t: _Lattice) -> DataFrame:
    p = t.params.withColumn("target_dose_gy", (F.col("study_id") % 4 * 5000).cast("double"))
    x = dosimetry.activity_for_target(t.volumes, p, masks.masked_sums(t.segments, t.segment_voxels, t.voxels, t.params))
    return x.select("study_id", _r("dose_at_1000_gy"), _r("activity_mbq"), _r("activity_reported_mbq"), "status")


def _renamed(t: _Lattice) -> DataFrame:
    return _rel(t).withColumn("name", F.when(F.col("segment_id") == "edge", "tumor").otherwise(F.col("name")))


def _table_rel(t: _Lattice) -> DataFrame:
    return tables.dose_table(_renamed(t), _lung(t))


def _report_rel(t: _Lattice, compat: bool = False) -> DataFrame:
    two = lambda c, label, unit: F.concat(F.lit(f"{label}: "), tables.two_decimals(F.col(c), unit, compat, binary=True))
    lines = F.array(two("activity_mbq", "Activity", " MBq"), two("lsf_percent", "Lung Shunt", "%"), two("conv_factor", "Conversion Factor", " Gy/MBq/g"), two("lung_mass_g", "Lung Mass", " g"), two("density_g_ml", "Liver Density", " g/mL"))
    heads = t.params.select("study_id", F.lit("Patient Relative Quantification").alias("title"), F.lit(STAMP).alias("stamp"), lines.alias("parameters"))
    return tables.report(_table_rel(t), heads, compat, binary=True)


def _report_files(t: _Lattice) -> DataFrame:
    """Reports written as named files, and what is found in their folder."""
    folder = f"{shared_dir(t.spark)}/reports-{uuid.uuid4().hex}"
    tables.write_reports(_report_rel(t).join(t.volumes.select("study_id", F.regexp_replace("name", "#", "-").alias("name")), "study_id"), folder)
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("sha256"))


def _report_abs(t: _Lattice) -> DataFrame:
    two = lambda c, label, unit: F.concat(F.lit(f"{label}: "), tables.two_decimals(F.col(c), unit, binary=True))
    x = _activity_abs(t).join(t.event_params.select("study_id", "conv_factor", "density_g_ml"), "study_id")
    lines = F.array(two("total_mbq", "Activity During Imaging", " MBq"), two("decay_corrected_mbq", "Decay Corrected Activity", " MBq"), two("conv_factor", "Conversion Factor", " Gy/MBq/g"), two("density_g_ml", "Liver Density", " g/mL"))
    heads = x.select("study_id", F.lit("Absolute Quantification").alias("title"), F.lit(STAMP).alias("stamp"), lines.alias("parameters"))
    return tables.report(tables.dose_table(_stats_abs(t)), heads, binary=True)


def _format(t: _Lattice) -> DataFrame:
    x = masks.lung_shunt(_sums(t), t.params)
    return x.select("study_id", tables.two_decimals(F.col("liver_counts"), binary=True).alias("liver"), tables.two_decimals(F.col("lung_counts"), binary=True).alias("lung"), tables.two_decimals(F.col("lsf_percent"), "%", binary=True).alias("lsf"))


def _some_missing(t: _Lattice) -> DataFrame:
    s = F.col("study_id")
    p = t.params.withColumn("liver_segment_id", F.when(s % 7 == 0, "absent").otherwise("liver"))
    x = validate.presence(t.volumes.select("study_id"), t.volumes.where(s % 2 == 0), t.segments.where(s % 3 > 0), p)
    return validate.missing_inputs(x.withColumn("has_output", s % 5 > 0))


def _presence(t: _Lattice) -> DataFrame:
    s = F.col("study_id")
    x = validate.presence(t.volumes.select("study_id"), t.volumes.where(s % 2 == 0), t.segments.where(s % 3 > 0), t.params)
    return x.withColumn("has_output", s % 5 > 0).withColumn("has_reference", s % 7 > 0)


def _mode_messages(t: _Lattice) -> DataFrame:
    x = _presence(t)
    return reduce(DataFrame.unionByName, [validate.mode_message(x, mode) for mode in validate.MESSAGES])


def _status(t: _Lattice) -> DataFrame:
    s = F.col("study_id")
    flat = t.volumes.where(s % 4 > 0).withColumn("dims", F.when(s % 4 == 1, F.array(F.lit(16), F.lit(0), F.lit(7))).otherwise(F.col("dims")))
    return validate.study_status(t.volumes.select("study_id"), flat, t.voxels.where(s % 4 != 2))


#: A quarter turn about the third axis, a stretch, and a shift.
TURN = [0.0, -1.0, 0.0, 5.0, 1.5, 0.0, 0.0, -2.0, 0.0, 0.0, 1.0, 7.0, 0.0, 0.0, 0.0, 1.0]


def _turned(t: _Lattice) -> DataFrame:
    m = t.volumes.where(F.col("study_id") % 2 == 0).select("study_id", F.array(*map(F.lit, TURN)).alias("matrix"))
    return registration.apply_linear_transform(t.volumes, m)


def _linear(t: _Lattice) -> DataFrame:
    return _turned(t).select("study_id", F.array_join(F.transform("ijk_to_ras", lambda x: F.format_string("%.3f", x)), " ").alias("matrix"))


def _splines(t: _Lattice) -> tuple[DataFrame, DataFrame]:
    g = t.volumes.select("study_id", F.array(*map(F.lit, (-8.0, -8.0, -8.0))).alias("origin"), F.array(*map(F.lit, (16.0, 16.0, 16.0))).alias("spacing"))
    c = t.voxels.where((F.col("i") < 6) & (F.col("j") < 7)).select("study_id", F.col("i").alias("ci"), F.col("j").alias("cj"), F.col("k").alias("ck"), (F.col("value") / 64).alias("dx"), (F.col("value") / 128).alias("dy"), (-F.col("value") / 64).alias("dz"))
    return g, c


def _bspline(t: _Lattice) -> DataFrame:
    p = t.voxels.select(*masks.AT, *[(F.col(a) * 4.0).alias(n) for a, n in zip("ijk", "xyz", strict=True)])
    return registration.apply_bspline(p, *_splines(t)).select(*masks.AT, *[_r(d) for d in ("dx", "dy", "dz")])


def _mi(t: _Lattice) -> DataFrame:
    v = t.voxels
    return registration.score_candidates(v, v, SHIFTS, WIDTH, BINS).select("study_id", "cand", _r("mi"))


def _candidates(t: _Lattice) -> DataFrame:
    """The best shift in voxels and its score, and from there the best of shifts, turns and growth, from coarse to fine, over all voxels."""

    def found() -> DataFrame:
        v = stored(t.voxels.select(*masks.AT, "value"))  # is read for each search, as both images
        moved = v.withColumn("i", F.col("i") + F.col("study_id").cast("int") % 3 - 1)
        best = stored(registration.best_candidate(registration.score_candidates(v, moved, SEARCH, WIDTH, BINS)))
        by, m = F.get(F.array(*[F.array(*map(F.lit, s)) for s in SEARCH]), F.col("cand")), F.col("ijk_to_ras")
        x = best.join(t.volumes.hint("merge"), "study_id").withColumn("by", by)
        start = x.select("study_id", *[(m[4 * r] * F.col("by")[0] + m[4 * r + 1] * F.col("by")[1] + m[4 * r + 2] * F.col("by")[2]).alias(p) for r, p in enumerate(registration.PARAMETERS[:3])])
        fine = registration.register(v, t.volumes, moved, t.volumes, WIDTH, BINS, share=1.0, start=start)
        one = fine.groupBy("study_id").agg(F.max(F.struct(F.col("mi").alias("fine_mi"), *registration.PARAMETERS)).alias("f")).select("study_id", "f.*")  # of several volumes the best
        return best.join(one.hint("merge"), "study_id", "left")

    return settled(t.spark, found).select("study_id", "cand", "mi", *[_r(p) for p in registration.PARAMETERS], "fine_mi")


def _applied(t: _Lattice) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Methods, and the volumes and voxels after each study's method: Rigid and Affine move the geometry, BSpline the voxels, none nothing."""
    method = F.element_at(F.array(*map(F.lit, ("Rigid", "Affine", "BSpline", "none"))), (F.col("study_id") % 4 + 1).cast("int"))
    x = t.volumes.select("study_id", method.alias("method"), F.array(*map(F.lit, TURN)).alias("matrix"))
    return x.select("study_id", "method"), *registration.apply_methods(t.volumes, t.voxels, x, *_splines(t))


def _methods(t: _Lattice) -> DataFrame:
    x, volumes, _ = _applied(t)
    return x.join(masks.volume_center(volumes), "study_id").select("study_id", "method", *[F.round(F.col("center")[a], 6).alias(n) for a, n in enumerate("xyz")])


def _methods_voxels(t: _Lattice) -> DataFrame:
    x, _, voxels = _applied(t)
    sums = voxels.groupBy("study_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), *[F.sum(F.col("value") * F.col(c)).alias(f"s{c}") for c in "ijk"])
    return x.join(sums, "study_id")


def _register(t: _Lattice) -> DataFrame:
    v = t.voxels
    moved = v.withColumn("i", F.col("i") + F.col("study_id").cast("int") % 3 - 1)
    x = registration.register(v, t.volumes, moved, t.volumes, WIDTH, BINS, share=0.1)
    return x.select("study_id", *[_r(p) for p in registration.PARAMETERS], _r("mi"))


#: A short search: two levels, three rounds each.
SEARCH_PLAN = search.Plan(WIDTH, BINS, share=0.1, levels=(2, 1), first=8.0, least=2.0, rounds=3, keep=1)


def _moved_scanner(t: _Lattice) -> DataFrame:
    """The volumes as from another scanner: the origin of every second study lies 60 mm away."""
    m = F.col("ijk_to_ras")
    return t.volumes.withColumn("ijk_to_ras", F.array(*[m[n] + F.when(F.col("study_id") % 2 == 0, 60.0).otherwise(0.0) if n == 3 else m[n] for n in range(16)]))


def _rigid(t: _Lattice) -> DataFrame:
    def found() -> DataFrame:
        v = stored(t.voxels.select(*masks.AT, "value"))  # is read for each level, as both images
        moved = v.withColumn("i", F.col("i") + F.col("study_id").cast("int") % 3 - 1)
        return search.search(v, t.volumes, moved, _moved_scanner(t), SEARCH_PLAN)

    return settled(t.spark, found)


def _register_rigid(t: _Lattice) -> DataFrame:
    return _rigid(t).select("study_id", "method", *[F.round(F.col("p")[n], 6).alias(p) for n, p in enumerate(search.NAMES[:6])], _r("mi"), _r("fit"))


def _register_and_harden(t: _Lattice) -> DataFrame:
    """Both volumes of the moving study, laid on the fixed one where the fit is good enough."""
    both = _moved_scanner(t).withColumn("volume_id", F.explode(F.array(F.lit("ct"), F.lit("nm"))))
    hardened = registration.apply_linear_transform(both, search.matrices(_rigid(t), t.volumes, least_fit=0.3))
    return masks.volume_center(hardened).select("study_id", "volume_id", *[F.round(F.col("center")[a], 6).alias(n) for a, n in enumerate("xyz")])


def _pyramid(t: _Lattice) -> DataFrame:
    return search.pyramid(t.voxels, t.volumes, 2)[0].select(*masks.AT, _r("value"))


def _chained(t: _Lattice) -> DataFrame:
    """A quarter turn with a stretch and a shift, then a shift that differs between studies."""
    second = F.array(*[(F.col("study_id") % 5).cast("double") if n == 3 else F.lit(float(n % 5 == 0)) for n in range(16)])
    x = t.volumes.select("study_id", F.lit(2).alias("ord"), second.alias("matrix")).unionByName(t.volumes.select("study_id", F.lit(1).alias("ord"), F.array(*map(F.lit, TURN)).alias("matrix")))
    return search.chained(x).select("study_id", F.array_join(F.transform("matrix", lambda v: F.format_string("%.3f", v)), " ").alias("matrix"))


def _files(t: _Lattice) -> DataFrame:
    place = (F.col("i") + 16 * F.col("j") + 256 * F.col("k")).cast("int")
    per = t.voxels.groupBy("study_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "value"))).alias("cells"))  # a grid of 1792 places
    x = per.select(F.format_string("study_%06d.nrrd", "study_id").alias("path"), F.array(*map(F.lit, lattice.DIMS)).alias("dims"), F.transform("cells", lambda c: c["p"]).alias("places"), F.transform("cells", lambda c: c["value"]).alias("values"), "study_id")
    return nrrd.export(x.join(t.volumes.select("study_id", "ijk_to_ras"), "study_id", "left"))


def _study(column: str = "path"):
    return F.regexp_extract(column, "([0-9]+)", 1).cast("bigint").alias("study_id")


def _volumes_read(t: _Lattice) -> DataFrame:
    x = nrrd.volumes(_files(t))
    numbers = {"n": "dims", "s": "spacing"}
    x = x.select(_study(), *[F.col(c)[a].alias(f"{k}{d}") for k, c in numbers.items() for a, d in enumerate("ijk")], *[F.col("ijk_to_ras")[4 * a + 3].alias(f"o{d}") for a, d in enumerate("xyz")], "layers", "status")
    return x.join(t.volumes.select("study_id"), "study_id", "left_semi")


def _segmentations(t: _Lattice) -> DataFrame:
    """Files of segments that overlap: liver and lungs in one layer, tumor and edge in one each."""
    layer = F.when(F.col("segment_id") == "tumor", 1).when(F.col("segment_id") == "edge", 2).otherwise(0)
    held = masks.bit_boxes(t.segment_voxels).groupBy("study_id", "segment_id").agg(F.collect_list(F.struct("i", "j", "k", "mask")).alias("b"))
    each = t.segments.join(held, ["study_id", "segment_id"], "left")
    member = F.struct("ord", "segment_id", "name", F.col("ord").alias("label_value"), layer.alias("layer"), F.coalesce("b", F.array()).alias("b"))
    x = each.groupBy("study_id").agg(F.array_sort(F.collect_list(member)).alias("members")).join(t.volumes.select("study_id", "dims", "ijk_to_ras"), "study_id")
    x = x.repartition(tasks(t.volumes, grid_size(F.col("dims"))), "study_id")  # masks look small to Spark, which would make all files in few tasks
    places = lambda m: masks.listed_places(m["b"], lambda i, j, k: i + 16 * j + 256 * k)
    x = x.withColumn("members", F.transform("members", lambda m: m.withField("places", places(m)).dropFields("b")))  # of a grid of 1792 places
    return nrrd.export_segmentation(x.withColumn("path", F.format_string("study_%06d.seg.nrrd", "study_id")))


def _segment_voxels_read(t: _Lattice) -> DataFrame:
    x = nrrd.segment_voxels(_segmentations(t)).where("status = 'ok'")
    return x.groupBy(_study(), "segment_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{c}") for c in "ijk"])


def _ingest(t: _Lattice) -> DataFrame:
    x = nrrd.ingest(_files(t))
    return x.select(_study(), "i", "j", "k", "value", "status")


def _ingest_split(t: _Lattice) -> DataFrame:
    """The files written to the shared folder and read by several tasks each, where they are raw."""
    folder = f"{shared_dir(t.spark)}/images-{uuid.uuid4().hex}"
    reports.write_files(_files(t), folder)
    x = nrrd_split.read_voxels(t.spark, folder, split_bytes=4096, partition_bytes=1 << 16)
    return x.withColumn("path", F.element_at(F.split("path", "/"), -1)).select(_study(), "i", "j", "k", "value", "status")


def _manifest(t: _Lattice) -> DataFrame:
    files, s = _files(t), F.regexp_extract("path", "([0-9]+)", 1).cast("bigint")
    listed = files.select(F.col("path").alias("file_name"), F.when(s % 3 == 1, F.sha2(F.col("path"), 256)).otherwise(F.concat(F.lit("SHA256:"), F.sha2("content", 256))).alias("sha256"))
    return nrrd.verify_manifest(files.where(s % 3 < 2), listed)


QUERIES: dict[str, Callable[[_Lattice], DataFrame]] = {
    "voxels_from_bricks": _voxels_from_bricks,
    "bricks_from_voxels": _bricks_from_voxels,
    "verify_manifest": _manifest,
    "ingest_nrrd": _ingest,
    "ingest_split": _ingest_split,
    "ingest_volumes": _volumes_read,
    "ingest_segments": lambda t: nrrd.segments(_segmentations(t)).select(_study(), "segment_id", "name", "ord", "label_value", "layer", "status"),
    "ingest_segment_voxels": _segment_voxels_read,
    "derive_volume": _derive_volume,
    "voxel_volume": _grid("v_ml"),
    "total_volume": _grid("total_ml"),
    "volume_center": lambda t: _xyz(masks.volume_center(t.volumes), "center"),
    "default_roi": _default_roi,
    "crop_roi": lambda t: masks.crop_roi(t.voxels, t.volumes, _roi(t)),
    "crop_volume": _crop_volume,
    "segment_list": lambda t: masks.segment_list(t.segments),
    "mask_volume": lambda t: masks.mask_volume(t.voxels, masks.segment_of(t.segment_voxels, t.params, "liver")).select(*masks.AT, "value"),
    "rasterize_segment": _rasterize,
    "threshold_volume": lambda t: masks.threshold_volume(t.voxels, 40.0).select(*masks.AT, "value"),
    "threshold_volume_inverted": lambda t: masks.threshold_volume(t.voxels, 40.0, inverted=True).select(*masks.AT, "value"),
    "segment_counts": lambda t: _sums(t).select("study_id", "segment_id", "n", "total"),
    "lsf_percent": lambda t: masks.lung_shunt(_sums(t), t.params).select("study_id", "liver_counts", "lung_counts", _r("lsf_percent")),
    "grid_mean": _grid("mean"),
    "max_dose": _grid("max"),
    "segment_stats_rel": lambda t: _stats(_rel(t)),
    "segment_stats_abs": lambda t: _stats(_stats_abs(t)),
    "isotope_factor": _isotope,
    "shunt_corrected_activity": lambda t: _varied(t).select("study_id", F.round(S.shunted(F.col("activity_mbq"), F.col("lsf_percent")), 6).alias("activity_mbq")),
    "rescale_factor": _rescale,
    "dose_map_relative": lambda t: dosimetry.dose_map_relative(t.voxels, t.segment_voxels, t.volumes, t.params).select(*masks.AT, _r("dose")),
    "dose_map_absolute": _dose_map_absolute,
    "total_activity": lambda t: _activity_abs(t).select("study_id", _r("total_mbq")),
    "decay_corrected_activity": lambda t: _activity_abs(t).select("study_id", _r("decay_corrected_mbq")),
    "lung_dose": lambda t: _varied(t).select("study_id", F.round(S.lung_dose(*[F.col(c) for c in ("activity_mbq", "lsf_percent", "conv_factor", "lung_mass_g")]), 6).alias("lung_dose_gy")),
    "activity_for_target": _target,
    "segment_dedup": lambda t: tables.last_of_name(_renamed(t)).select("study_id", "ord", "name", "segment_id", _r("dose_gy"), _r("volume_ml"), _r("activity_mbq")),
    "dose_table_relative": lambda t: _stats(_table_rel(t)),
    "dose_table_absolute": lambda t: _stats(tables.dose_table(_stats_abs(t))),
    "format_counts": _format,
    "report_relative": _report_rel,
    "report_relative_compat": lambda t: _report_rel(t, compat=True),
    "report_absolute": _report_abs,
    "report_files": _report_files,
    "report_path": lambda t: t.volumes.select("study_id", tables.report_path(F.when(F.col("study_id") % 2 == 0, F.concat("name", F.lit(".RTF"))).otherwise(F.col("name"))).alias("path")),
    "missing_inputs": _some_missing,
    "missing_inputs_absolute": lambda t: validate.missing_inputs(_presence(t), validate.LABELS_ABSOLUTE, "\n"),
    "mode_messages": _mode_messages,
    "study_status": _status,
    "param_violations": lambda t: validate.param_violations(_varied(t).withColumn("hours", (F.col("study_id") % 9 * 50).cast("double"))),
    "apply_linear_transform": _linear,
    "apply_bspline": _bspline,
    "geometry_align": lambda t: _xyz(registration.geometry_align(_turned(t), t.volumes), "shift"),
    "mi_score": _mi,
    "register_candidates": _candidates,
    "harden_bspline": lambda t: registration.harden_bspline(t.voxels, t.volumes, *_splines(t)),
    "register_affine": _register,
    "register_rigid": _register_rigid,
    "register_and_harden": _register_and_harden,
    "image_pyramid": _pyramid,
    "chain_transforms": _chained,
    "sample_lattice": lambda t: masks.sampled_values(t.volumes, t.voxels, 0.1),
    "register_methods": _methods,
    "register_methods_voxels": _methods_voxels,
    "resample_to_grid": lambda t: registration.resample_to_grid(t.voxels, t.volumes, _target_grid(t)),
    "sample_voxels": lambda t: masks.sampled(t.voxels).select(*masks.AT, "value"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, d, f=f: f(_Lattice(spark, d))) for name, f in QUERIES.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["segment_stats_rel"](_Lattice(spark, d))
