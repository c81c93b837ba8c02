"""The reader that splits image files, against the one that reads whole files."""

import bz2
import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxdose.sources import nrrd, nrrd_split

HEAD = "NRRD0004\n# made here\ntype: {type}\ndimension: {n}\nsizes: {sizes}\nendian: {endian}\nencoding: {encoding}\n{more}\n"


def header(values, encoding, endian="little", more="", kind="short"):
    return HEAD.format(type=kind, n=values.ndim, sizes=" ".join(map(str, values.shape[::-1])), endian=endian, encoding=encoding, more=more).encode()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("images"), np.random.default_rng(3)
    grid = rng.integers(-3, 4, (9, 11, 13)).astype("<i2")
    layers = rng.integers(0, 3, (5, 6, 7, 2)).astype("<i2")  # layers first in the file
    (at / "raw.nrrd").write_bytes(header(grid, "raw") + grid.tobytes())
    (at / "big.nrrd").write_bytes(header(grid, "raw", "big").replace(b"\n", b"\r\n") + grid.astype(">i2").tobytes())
    (at / "layers.nrrd").write_bytes(header(layers, "raw", more="space directions: none (1,0,0) (0,1,0) (0,0,1)\n") + layers.tobytes())
    (at / "packed.nrrd").write_bytes(header(grid, "gzip") + gzip.compress(grid.tobytes()))
    (at / "bz.nrrd").write_bytes(header(grid, "bzip2") + bz2.compress(grid.tobytes()))
    (at / "text.nrrd").write_bytes(header(grid, "ascii") + " ".join(map(str, grid.ravel())).encode())
    (at / "ward").mkdir()
    (at / "ward" / "apart.nhdr").write_bytes(header(grid, "raw", more="data file: apart.raw\n"))
    (at / "ward" / "apart.raw").write_bytes(grid.tobytes())
    (at / "zero.nrrd").write_bytes(header(grid, "raw") + bytes(grid.nbytes))
    (at / "long.nrrd").write_bytes(header(grid, "raw", more="".join(f"mark{n}:={'x' * 900}\n" for n in range(100))) + grid.tobytes())
    (at / "note.txt").write_text("no image")
    return at


BAD = {"empty.nrrd": b"", "odd.nrrd": b"no image", "lost.nhdr": b"NRRD0004\ntype: short\nsizes: 2 2 2\nencoding: raw\ndata file: none.raw\n\n", "kind.nrrd": b"NRRD0004\ntype: block\nsizes: 2 2 2\nencoding: raw\n\n12"}


def rows(df, folder):
    """All rows, with a file's path as seen from the folder."""
    x = df.withColumn("path", F.regexp_replace("path", f"^(file:)?/*{str(folder).lstrip('/')}/", ""))
    return sorted(map(tuple, x.select("path", "layer", "i", "j", "k", "value", "status").collect()), key=str)


@pytest.mark.parametrize("split", [1 << 27, 512, 101, 7])
def test_same_voxels(spark, folder, split):
    whole = nrrd.attached(nrrd.read_files(spark, str(folder)).union(nrrd.read_files(spark, str(folder / "ward"))))
    want = [r for r in rows(nrrd.ingest(whole), folder) if r[0] != "note.txt"]
    got = nrrd_split.read_voxels(spark, str(folder), split, split * 64)
    assert rows(got, folder) == want and {r[0] for r in want} == {"raw.nrrd", "big.nrrd", "layers.nrrd", "packed.nrrd", "bz.nrrd", "text.nrrd", "long.nrrd", "ward/apart.nhdr"}


def test_one_file_by_four_tasks(spark, folder, tmp_path):
    (tmp_path / "raw.nrrd").write_bytes((folder / "raw.nrrd").read_bytes())
    size = (tmp_path / "raw.nrrd").stat().st_size
    x = nrrd_split.read_voxels(spark, f"file://{tmp_path}", -(-size // 4), -(-size // 4))
    assert x.rdd.getNumPartitions() == 4 and x.select(F.spark_partition_id()).distinct().count() == 4


def test_bad_files(spark, folder, tmp_path):
    for name, content in BAD.items():
        (tmp_path / name).write_bytes(content)
    raw = (folder / "raw.nrrd").read_bytes()
    (tmp_path / "short.nrrd").write_bytes(raw[:-1])
    (tmp_path / "packed.nrrd").write_bytes((folder / "packed.nrrd").read_bytes()[:-20])
    for split in (1 << 27, 100):
        got = rows(nrrd_split.read_voxels(spark, str(tmp_path), split, 300), tmp_path)
        assert all(r[6] != "ok" for r in got) and sorted(r[0] for r in got) == sorted([*BAD, "short.nrrd", "packed.nrrd"])
        assert all(r[1:6] == (None,) * 5 and r[6].startswith("error: ") for r in got)
    (tmp_path / "none").mkdir()
    assert nrrd_split.read_voxels(spark, str(tmp_path / "none")).count() == 0


def test_skipped_bytes(spark, folder, tmp_path):
    grid = np.arange(1, 61, dtype="<i2").reshape(3, 4, 5)
    for name, skip in (("some.nrrd", 6), ("end.nrrd", -1)):
        (tmp_path / name).write_bytes(header(grid, "raw", more=f"byte skip: {skip}\n") + b"abcdef" + grid.tobytes())
    got = nrrd_split.read_voxels(spark, str(tmp_path), 50, 100).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("k", "j", "i", "value"))).alias("v")).collect()
    assert len(got) == 2 and all([r["value"] for r in x["v"]] == list(range(1, 61)) for x in got)
