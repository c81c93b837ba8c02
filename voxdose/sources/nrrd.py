"""Image files of the NRRD format, one file a row: geometry, voxels, and the segments of segmentation files.

A fourth axis holds layers: segments that overlap lie in different ones. Patient space is right, anterior, superior;
files in another space are turned. A file that cannot be read gives one row with its error as status.
"""

from __future__ import annotations

import bz2
import gzip
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The format's names of each type, of its encodings, and of the axes' other ends.
NAMES = {
    "i1": "signed char|int8|int8_t",
    "u1": "uchar|unsigned char|uint8|uint8_t",
    "i2": "short|short int|signed short|signed short int|int16|int16_t",
    "u2": "ushort|unsigned short|unsigned short int|uint16|uint16_t",
    "i4": "int|signed int|int32|int32_t",
    "u4": "uint|unsigned int|uint32|uint32_t",
    "i8": "longlong|long long|long long int|signed long long|signed long long int|int64|int64_t",
    "u8": "ulonglong|unsigned long long|unsigned long long int|uint64|uint64_t",
    "f4": "float",
    "f8": "double",
}
TYPES = {name: code for code, names in NAMES.items() for name in names.split("|")}
UNPACK = {"raw": bytes, "gzip": gzip.decompress, "gz": gzip.decompress, "bzip2": bz2.decompress, "bz2": bz2.decompress}
TEXTS = ("ascii", "text", "txt")
TURNED = ("left", "posterior", "inferior")
ERRORS = (ValueError, KeyError, OSError, EOFError, IndexError, TypeError)


class Image:
    """A file's header: ``dims`` of the grid, ``layers``, ``matrix`` from voxels to patient space, and key-value marks."""

    def __init__(self, content: bytes):
        blank = re.search(rb"\r?\n\r?\n", content)
        head, self.payload = (content[: blank.start()], content[blank.end() :]) if blank else (content, b"")
        lines = head.decode("utf-8", "replace").splitlines()
        if not lines or not lines[0].startswith("NRRD"):
            raise ValueError("no NRRD header")
        lines = [x for x in lines[1:] if not x.startswith("#")]
        self.marks = dict(x.split(":=", 1) for x in lines if ":=" in x)
        pairs = (x.split(":", 1) for x in lines if ":=" not in x and ":" in x)
        self.fields = {k.strip().lower().replace(" ", ""): v.strip() for k, v in pairs}
        self.sizes = [int(x) for x in self.fields["sizes"].split()]
        vectors = [None if "none" in v else [float(x) for x in v.strip("()").split(",")] for v in re.findall(r"none|\([^)]*\)", self.fields.get("spacedirections", ""))]
        if not vectors:
            spacings = [float(x) for x in self.fields.get("spacings", "").split()] or [1.0] * len(self.sizes)
            spacings = [1.0 if x != x else x for x in spacings]
            last = len(self.sizes) - 3
            vectors = [None if n < last else [spacings[n] if r == n - last else 0.0 for r in range(3)] for n in range(len(self.sizes))]
        self.axes = [n for n, v in enumerate(vectors) if v is not None]
        if len(vectors) != len(self.sizes) or len(self.axes) != 3 or len(self.sizes) > 4:
            raise ValueError("not a grid of three axes, with layers at most")
        self.dims = [self.sizes[n] for n in self.axes]
        self.layers = int(np.prod(self.sizes)) // max(1, int(np.prod(self.dims))) if all(self.dims) else 1
        origin = [float(x) for x in self.fields.get("spaceorigin", "(0,0,0)").strip("()").split(",")]
        space = self.fields.get("space", "").lower()
        space = space.split("-") if "-" in space else ["left" if "l" in space[:1] else "", "posterior" if "p" in space[1:2] else "", ""]
        sign = [-1.0 if space[r : r + 1] == [TURNED[r]] else 1.0 for r in range(3)]
        self.matrix = [sign[r] * x + 0.0 for r in range(3) for x in (*(vectors[n][r] for n in self.axes), origin[r])] + [0.0, 0.0, 0.0, 1.0]
        self.spacing = [float(np.linalg.norm(vectors[n])) for n in self.axes]

    def values(self) -> np.ndarray:
        """All values as (layer, k, j, i)."""
        code, encoding = TYPES[self.fields["type"]], self.fields["encoding"].lower()
        if encoding in TEXTS:
            flat = np.array(self.payload.split(), dtype=code)
        else:
            order = ">" if self.fields.get("endian", "little") == "big" else "<"
            flat = np.frombuffer(UNPACK[encoding](self.payload), dtype=np.dtype(order + code), count=int(np.prod(self.sizes)))
        whole = flat.reshape(self.sizes[::-1])
        other = [n for n in range(len(self.sizes)) if n not in self.axes]
        place = lambda n: len(self.sizes) - 1 - n
        return whole.transpose([place(n) for n in (*other, *self.axes[::-1])]).reshape(self.layers, *self.dims[::-1])

    def segments(self) -> list[tuple[str, str, int, int, int]]:
        """Id, name, order, label and layer of each segment of a segmentation file."""
        out = []
        while f"Segment{len(out)}_ID" in self.marks:
            n = len(out)
            of = lambda key, other="": self.marks.get(f"Segment{n}_{key}", other).strip()  # noqa: B023, E731
            out.append((of("ID"), of("Name", of("ID")), n + 1, int(of("LabelValue", "1")), int(of("Layer", "0"))))
        return out


def encode(values: np.ndarray, sizes: list[int], compress: bool, matrix: list[float] | None = None, marks: dict[str, object] | None = None, feed: str = "\n") -> bytes:
    """A file of doubles (of bytes where there are marks); with a matrix, its header says left, posterior, superior. A fourth size comes first and holds layers."""
    head = ["NRRD0004", f"type: {'uint8' if marks else 'double'}", f"dimension: {len(sizes)}"]
    if matrix:
        row = lambda c: "(" + ",".join(repr(float(s * matrix[4 * r + c] + 0.0)) for r, s in enumerate((-1, -1, 1))) + ")"
        none = "none " * (len(sizes) - 3)
        head += ["space: left-posterior-superior", f"space directions: {none}{row(0)} {row(1)} {row(2)}", f"space origin: {row(3)}"]
    head += [f"sizes: {' '.join(map(str, sizes))}", f"encoding: {'gzip' if compress else 'raw'}", "endian: little", *(f"{k}:={v}" for k, v in (marks or {}).items())]
    data = np.ascontiguousarray(values, dtype="<u1" if marks else "<f8").tobytes()
    return (feed.join(head) + 2 * feed).encode() + (gzip.compress(data, mtime=0) if compress else data)


def read_files(spark, path: str) -> DataFrame:
    """path, content of image files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def attached(files: DataFrame) -> DataFrame:
    """Files with the data of detached headers (``data file: name``) behind them; data files themselves are left out.

    Header and data are matched by folder and name; contents pass through joins, which ``nrrd_split`` spares large files.
    """
    folder = F.regexp_extract("path", "^(.*/)?", 0)
    head = F.decode(F.substring("content", 1, 65536), "ISO-8859-1")
    name = F.when(head.startswith("NRRD"), F.regexp_extract(head, r"(?im)^data ?file: *(?:\./)?([^\r\n]+?) *\r?$", 1))
    x = files.withColumn("_data", F.when(name != "", F.concat(folder, name)))
    data = files.select(F.col("path").alias("_data"), F.col("content").alias("_rest"))
    fields = F.encode(F.regexp_extract(F.decode("content", "ISO-8859-1"), r"(?s)^(.*?)(?:\r?\n\r?\n|$)", 1), "ISO-8859-1")  # a blank line may end them
    rest = F.concat(fields, F.lit(b"\n\n"), F.col("_rest"))
    whole = x.join(data, "_data", "left").withColumn("content", F.when(F.col("_rest").isNotNull(), rest).otherwise(F.col("content")))
    return whole.join(x.select(F.col("_data").alias("path")), "path", "left_anti").select("path", "content")


#: Rows of a frame, gathered over files.
ROWS = 1 << 17


def _frame(parts: list[dict]) -> pd.DataFrame:
    whole = lambda cells: np.concatenate(cells) if isinstance(cells[0], np.ndarray) else [x for some in cells for x in some]
    return pd.DataFrame({c: whole([p[c] for p in parts]) for c in parts[0]})


def _rows(files: DataFrame, schema: str, of) -> DataFrame:
    """``of`` (Image) yields columns of some rows; an unreadable file gives a row of nulls with its error as status. Rows of many files share a frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        parts: list[dict] = []
        held = 0
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    for x in of(Image(content)):
                        n = len(x[names[-1]])
                        if not n:
                            continue
                        parts.append({**{c: x[c] if c in x else np.full(n, path, object) for c in names}, "status": np.full(n, "ok", object)})
                        held += n
                        if held >= ROWS:
                            yield _frame(parts)
                            parts, held = [], 0
                except ERRORS as why:
                    yield pd.DataFrame([{**dict.fromkeys(names), "path": path, "status": f"error: {type(why).__name__}"}]).astype(object)
            if parts:
                yield _frame(parts)
                parts, held = [], 0

    return files.select("path", "content").mapInPandas(run, f"{schema}, status string")


def _voxel_columns(grid: np.ndarray, at: np.ndarray, most: int = 1 << 20) -> Iterator[dict]:
    """i, j, k, value of the listed places of one layer, in parts of bounded size."""
    flat, (nj, ni) = grid.reshape(-1), grid.shape[1:]
    for lo in range(0, len(at), most):
        some = at[lo : lo + most]
        a, rest = some % ni, some // ni
        yield {"i": a, "j": rest % nj, "k": rest // nj, "value": flat[some].astype("f8")}


def volumes(files: DataFrame) -> DataFrame:
    """path, dims, spacing, ijk_to_ras, layers, status."""

    def of(image: Image) -> Iterator[dict]:
        yield {"dims": [image.dims], "spacing": [image.spacing], "ijk_to_ras": [image.matrix], "layers": [image.layers]}

    return _rows(files, "path string, dims array<int>, spacing array<double>, ijk_to_ras array<double>, layers int", of)


def ingest(files: DataFrame) -> DataFrame:
    """path, layer, i, j, k, value of the non-zero voxels, and ``status``."""

    def of(image: Image) -> Iterator[dict]:
        for layer, grid in enumerate(image.values()):
            yield from ({**x, "layer": np.full(len(x["i"]), layer)} for x in _voxel_columns(grid, np.flatnonzero(grid)))

    return _rows(files, "path string, layer int, i int, j int, k int, value double", of)


def segments(files: DataFrame) -> DataFrame:
    """path, segment_id, name, ord, label_value, layer of the segments of segmentation files, and ``status``."""

    def of(image: Image) -> Iterator[dict]:
        rows = image.segments()
        yield {c: [r[n] for r in rows] for n, c in enumerate(("segment_id", "name", "ord", "label_value", "layer"))}

    return _rows(files, "path string, segment_id string, name string, ord int, label_value int, layer int", of)


def segment_voxels(files: DataFrame) -> DataFrame:
    """path, segment_id, i, j, k of every voxel of every segment, and ``status``."""

    def of(image: Image) -> Iterator[dict]:
        layers = image.values()
        for segment, _, _, label, layer in image.segments():
            yield from ({**x, "segment_id": np.full(len(x["i"]), segment, object)} for x in _voxel_columns(layers[layer], np.flatnonzero(layers[layer] == label)))

    return _rows(files, "path string, segment_id string, i int, j int, k int", of)


#: Files made at a time.
FEW = 96


def _few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut short, as the files made of one are held together until they are handed on."""
    for b in batches:
        yield from (b.iloc[lo : lo + FEW] for lo in range(0, len(b), FEW))


def export(volumes: DataFrame) -> DataFrame:
    """path, content of each volume (path, dims, places, values, and ijk_to_ras if known): places are voxel numbers, i fastest."""
    known = "ijk_to_ras" in volumes.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _few(batches):
            out = []
            for dims, places, values, matrix in zip(b["dims"], b["places"], b["values"], b["ijk_to_ras"] if known else [None] * len(b), strict=True):
                grid = np.zeros(int(np.prod(dims)))
                grid[np.asarray(places, dtype=np.int64)] = values
                out.append(encode(grid, list(dims), len(out) % 2 == 0, None if matrix is None else list(matrix), feed="\n" if len(out) % 3 else "\r\n"))
            yield pd.DataFrame({"path": b["path"], "content": out})

    return volumes.select("path", "dims", "places", "values", *(["ijk_to_ras"] if known else [])).mapInPandas(run, "path string, content binary")


def export_segmentation(studies: DataFrame) -> DataFrame:
    """path, content of each segmentation (path, dims, ijk_to_ras, members: array of segment_id, name, label_value, layer, places).

    Members reach the workers as flat arrays, places as one array a study: nested ones become Python objects, place by place.
    """
    fields = {"ids": "segment_id", "names": "name", "labels": "label_value", "at": "layer"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _few(batches):
            out = []
            for dims, matrix, ids, names, labels, at, sizes, places in zip(*[b[c] for c in ("dims", "ijk_to_ras", *fields, "sizes", "places")], strict=True):
                layers = 1 + int(max(at))
                grid = np.zeros((int(np.prod(dims)), layers), dtype=np.uint8)
                marks: dict[str, object] = {}
                ends = np.cumsum(sizes)
                for n in range(len(ids)):
                    grid[np.asarray(places[ends[n] - sizes[n] : ends[n]], dtype=np.int64), at[n]] = labels[n]
                    marks |= {f"Segment{n}_ID": ids[n], f"Segment{n}_Name": names[n], f"Segment{n}_LabelValue": labels[n], f"Segment{n}_Layer": at[n]}
                out.append(encode(grid, [layers, *dims], True, list(matrix), marks))
            yield pd.DataFrame({"path": b["path"], "content": out})

    flat = [F.col(f"members.{c}").alias(n) for n, c in fields.items()]
    sizes = F.transform("members", lambda m: F.size(m["places"])).alias("sizes")
    places = F.flatten("members.places").alias("places")
    return studies.select("path", "dims", "ijk_to_ras", *flat, sizes, places).mapInPandas(run, "path string, content binary")


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """file_name, status of each listed file: ok, checksum differs, missing."""
    seen = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("found"))
    wanted = F.lower(F.regexp_replace("sha256", "(?i)^sha256:", ""))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") == wanted, "ok").otherwise("checksum differs")
    return manifest.join(seen, "file_name", "left").select("file_name", status.alias("status"))
