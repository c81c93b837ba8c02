"""A reader of image files that cuts raw payloads by byte range, so that several tasks share one file of any size.

``spark.read.format("nrrd_voxels").load(folder)``, after ``register(spark)``, gives the rows of ``nrrd.ingest``: path, layer, i, j, k, value of
the non-zero voxels, and ``status``. Planning lists the folder and reads the detached headers (``*.nhdr``); all else is read by the tasks, in
blocks of bounded size. Pieces of ``split_bytes`` are dealt out to tasks of about ``partition_bytes``, pieces of one file to different tasks.
Compressed and text payloads are one piece; so is a detached payload that a header of another name points to.

A file that cannot be read gives one row with its error as status. A raw payload that is too short gives that row alone; a compressed one
gives the voxels before its break as well. An empty folder gives no rows. Files of other names are left alone.
"""

from __future__ import annotations

import bz2
import gzip
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .nrrd import ERRORS, TEXTS, TYPES, Image
from .reports import _files

FORMAT = "nrrd_voxels"
SPLIT = 128 << 20
#: Values read at a time; bytes of a header at first, and at most.
BLOCK, HEAD, LONGEST = 1 << 20, 1 << 16, 1 << 24
ROWS = pa.schema([("path", pa.string()), ("layer", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("k", pa.int32()), ("value", pa.float64()), ("status", pa.string())])
STREAMS = {"gzip": gzip.open, "gz": gzip.open, "bzip2": bz2.open, "bz2": bz2.open}


@dataclass(frozen=True)
class Piece:
    """Bytes lo to hi of the file that holds the payload of ``path``."""

    path: str
    data: str
    lo: int
    hi: int
    size: int


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


def _head(files, path: str) -> tuple[Image, int]:
    """A file's header, and the place of its first byte of payload."""
    with files.open_input_stream(path) as f:
        content = more = f.read(HEAD)
        while more and content.startswith(b"NRRD") and b"\n\n" not in content and b"\n\r\n" not in content and len(content) < LONGEST:
            more = f.read(HEAD)
            content += more
    image = Image(content)
    return image, len(content) - len(image.payload) if image.payload else len(content)


def _beside(path: str, image: Image) -> str | None:
    """The file that a detached header names, in its own folder."""
    name = image.fields.get("datafile", "").removeprefix("./")
    return f"{path.rpartition('/')[0]}/{name}" if name else None


def _frame(path: str, image: Image, first: int, flat: np.ndarray) -> pa.RecordBatch:
    """The non-zero values among ``flat``, whose first is value ``first`` of the payload."""
    at = np.flatnonzero(flat)
    places = np.unravel_index(at + first, image.sizes[::-1])[::-1]
    other = [n for n in range(len(image.sizes)) if n not in image.axes]
    layer = places[other[0]] if other else np.zeros(len(at))
    columns = [layer, *(places[n] for n in image.axes)]
    same = lambda x: pa.array([x] * len(at), pa.string())
    return pa.record_batch([same(path), *(pa.array(c.astype("i4")) for c in columns), pa.array(flat[at].astype("f8")), same("ok")], schema=ROWS)


class VoxelReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.split = int(options.get("split_bytes", SPLIT))
        self.bundle = int(options.get("partition_bytes", SPLIT))

    def partitions(self) -> list[Pieces]:
        from pyarrow import fs

        files, root = _files(self.folder)
        sizes = {x.path: x.size for x in files.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File}

        def payload(path: str) -> str:
            try:
                return _beside(path, _head(files, path)[0]) or path
            except ERRORS:
                return path  # its task says what is wrong

        apart = [p for p in sizes if p.lower().endswith(".nhdr")]
        with ThreadPoolExecutor(16) as pool:
            of = {p: p for p in sizes if p.lower().endswith(".nrrd")} | dict(zip(apart, pool.map(payload, apart), strict=True))
        pieces = []
        for path, data in sorted(of.items()):
            size = sizes.get(data, 0)
            pieces += [Piece(path, data, lo, min(lo + self.split, size), size) for lo in range(0, max(size, 1), self.split)]
        tasks = min(len(pieces), -(-sum(p.hi - p.lo for p in pieces) // self.bundle)) or 1
        return [Pieces(pieces[n::tasks]) for n in range(tasks)]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        files, _ = _files(self.folder)
        for piece in partition.pieces:
            try:
                yield from self._voxels(files, piece)
            except ERRORS as why:
                if piece.lo == 0:
                    row = dict.fromkeys(ROWS.names) | {"path": piece.path, "status": f"error: {type(why).__name__}"}
                    yield pa.RecordBatch.from_pylist([row], schema=ROWS)

    def _voxels(self, files, piece: Piece) -> Iterator[pa.RecordBatch]:
        image, start = _head(files, piece.path)
        code, encoding, total = TYPES[image.fields["type"]], image.fields["encoding"].lower(), int(np.prod(image.sizes))
        kind = np.dtype((">" if image.fields.get("endian", "little") == "big" else "<") + code)
        data = _beside(piece.path, image) or piece.path
        if data != piece.path:
            start = 0
        planned = data == piece.data
        if not planned and piece.lo:
            return
        size = piece.size if planned else files.get_file_info(data).size or 0
        lo, hi = (piece.lo, piece.hi) if planned else (0, size)
        start = size - total * kind.itemsize if (skip := int(image.fields.get("byteskip", "0"))) < 0 else start + skip
        if encoding == "raw":
            if start < 0 or size - start < total * kind.itemsize:
                raise ValueError("payload is too short")
            first, last = (min(total, max(0, -(-(x - start) // kind.itemsize))) for x in (lo, hi))
            with files.open_input_file(data) as f:
                f.seek(start + first * kind.itemsize)
                for n in range(first, last, BLOCK):
                    count = min(BLOCK, last - n)
                    yield _frame(piece.path, image, n, np.frombuffer(f.read(count * kind.itemsize), kind, count))
        elif lo == 0:
            with files.open_input_file(data) as f:
                f.seek(start)
                if encoding in TEXTS:
                    flat = np.array(f.read().split(), dtype=code)
                    if len(flat) != total:
                        raise ValueError("another number of values")
                    yield from (_frame(piece.path, image, n, flat[n : n + BLOCK]) for n in range(0, total, BLOCK))
                else:
                    with STREAMS[encoding](f) as unpacked:
                        for n in range(0, total, BLOCK):
                            count = min(BLOCK, total - n)
                            yield _frame(piece.path, image, n, np.frombuffer(unpacked.read(count * kind.itemsize), kind, count))


class VoxelSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, layer int, i int, j int, k int, value double, status string"

    def reader(self, schema: StructType) -> VoxelReader:
        return VoxelReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VoxelSource)


def read_voxels(spark: SparkSession, folder: str, split_bytes: int = SPLIT, partition_bytes: int = SPLIT) -> DataFrame:
    """The voxels of all image files of a folder and its subfolders."""
    register(spark)
    return spark.read.format(FORMAT).option("split_bytes", split_bytes).option("partition_bytes", partition_bytes).load(folder)
