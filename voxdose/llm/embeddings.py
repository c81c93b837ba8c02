"""Near-duplicate vectors by products of int8 tiles with rigorous error bounds.

Equal vectors form one class. Classes are dealt into tiles of about ``TILE``, and tiles side by side form strips. A
task gets two strips, so a tile is copied once for each strip and not for each tile, and it holds int8
entries alone. A vector, scaled to length 1, is x = scale * q + e with int8 entries q; so for two vectors
|x . y - scale scale' q . q'| <= |e| + (1 + |e|) |e'|, with each vector's own error. The
products of int8 entries are summed exactly. Pairs whose quantised cosine plus that bound, and a slack for the rounding
of the scaling (``slack``), stays below the threshold cannot be links. Only rows with a pair that may be one are sent in
full, and such pairs are recomputed in double precision. A task returns link counts and a spanning
forest of the links, never the pairs.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Rows
without vec_id have no component and are kept, and link with nothing. Vectors of different lengths are not compared.
Repeated rows count as vectors of their own. Other columns of the table are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import roots
from .minhash import forest

TILE = 1024
#: Tiles side by side, at most, and entries of a strip, about.
STRIP, ENTRIES = 8, 1 << 23
#: Columns whose int8 products are summed in one float32: 127 * 127 * 1024 < 2 ** 24, so the sum is exact.
EXACT = 1024


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 entries, scale and norm of the error of each unit row."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def slack(dim: int) -> float:
    """More than rounding can lose: some six steps in single precision on values up to 1.1, some 2 * dim in double precision on values up to 1."""
    return 12 * 2.0**-24 + 8 * dim * 2.0**-53


def int_product(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows; float64 if there are more than ``EXACT`` columns."""
    parts = (q[:, k : k + EXACT].astype(np.float32) @ r[:, k : k + EXACT].astype(np.float32).T for k in range(0, q.shape[1], EXACT))
    if q.shape[1] <= EXACT:
        return next(parts)
    out = np.zeros((len(q), len(r)))
    for part in parts:
        out += part
    return out


def may_link(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Which pairs of rows of two tiles (q, scale, error) can reach the threshold, each by its own bound."""
    (q, s, e), (r, t, f) = ([np.asarray(x[0]), *(np.asarray(y, dtype=np.float32) for y in x[1:])] for x in (a, b))
    upper = int_product(q, r)
    upper *= s[:, None]
    upper *= t[None, :]
    upper += np.outer(1 + e, f)
    upper += e[:, None]
    return upper >= threshold - slack(q.shape[1])


def links(x: np.ndarray, y: np.ndarray, maybe: np.ndarray, threshold: float) -> np.ndarray:
    """The matrix of links between rows of two matrices, among those that may be one, in double precision."""
    sure = np.zeros_like(maybe)
    rows, cols = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
    if len(rows):
        u, v, some = unit(x[rows]), unit(y[cols]), maybe[np.ix_(rows, cols)]
        if some.mean() > 0.05:  # one product of what is left costs less than so many single ones
            sure[np.ix_(rows, cols)] = some & (u @ v.T >= threshold)
        else:
            i, j = np.nonzero(some)
            sure[rows[i], cols[j]] = np.einsum("ij,ij->i", u[i], v[j]) >= threshold
    return sure


def _pairs(tiles: list[int], p: int, q: int, strip: int) -> Iterator[tuple[int, int]]:
    """Pairs of tiles of strips p and q that a task compares."""
    return ((a, b) for a in tiles for b in tiles if a // strip == p and b // strip == q and (p != q or a <= b))


def _dealt(rows: DataFrame, strips: int) -> DataFrame:
    """Each row once for every strip that its own meets: columns p and q."""
    own = F.floor(F.col("tile") / F.col("strip")).cast("int")
    met = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.floor(F.lit(strips - 1) / F.col("strip")).cast("int"))))
    return met.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("own", "other")


def _survivors(classes: DataFrame, tiles: int, threshold: float, wide: bool) -> DataFrame:
    """(dim, strip, p, q, cid) of each class with a pair in strips p and q that may be a link."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for dim, tile, strip, members in zip(b["dim"], b["tile"], b["strip"], b["members"], strict=True):
                q, scale, error = quantised(unit(np.array([m["embedding"] for m in members], dtype=np.float64 if wide else np.float32)))
                out.append((dim, tile, strip, np.array([m["cid"] for m in members], dtype=np.int64).tobytes(), q.tobytes(), scale.astype(np.float32).tobytes(), _upward(error).tobytes()))
            yield pd.DataFrame(out, columns=["dim", "tile", "strip", "ids", "small", "scale", "error"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, strip, p, q, members in zip(b["dim"], b["strip"], b["p"], b["q"], b["members"], strict=True):
                ids = {m["tile"]: np.frombuffer(m["ids"], dtype=np.int64) for m in members}
                small = {m["tile"]: (np.frombuffer(m["small"], dtype=np.int8).reshape(-1, dim), *(np.frombuffer(m[k], dtype=np.float32) for k in ("scale", "error"))) for m in members}
                met = {t: np.zeros(len(x), dtype=bool) for t, x in ids.items()}
                for t, u in _pairs(sorted(ids), p, q, strip):
                    maybe = may_link(small[t], small[u], threshold)
                    if t == u:
                        np.fill_diagonal(maybe, False)
                    met[t] |= maybe.any(axis=1)
                    met[u] |= maybe.any(axis=0)
                found = np.concatenate([ids[t][m] for t, m in met.items()])
                yield pd.DataFrame({"dim": dim, "strip": strip, "p": p, "q": q, "cid": found}, columns=["dim", "strip", "p", "q", "cid"])

    each = classes.groupBy("dim", "tile", "strip").agg(F.collect_list(F.struct("cid", "embedding")).alias("members"))
    small = each.mapInPandas(packed, "dim int, tile int, strip int, ids binary, small binary, scale binary, error binary")
    met = _dealt(small, tiles).groupBy("dim", "strip", "p", "q").agg(F.collect_list(F.struct("tile", "ids", "small", "scale", "error")).alias("members"))
    return met.mapInPandas(run, "dim int, strip int, p int, q int, cid bigint")


def _upward(x: np.ndarray) -> np.ndarray:
    """Single-precision values, none below its double one."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _compared(classes: DataFrame, tiles: int, threshold: float, wide: bool) -> DataFrame:
    """a, b: an edge; or b null: ``links`` more vectors for class a."""
    kind = np.float64 if wide else np.float32

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for strip, p, q, members in zip(b["strip"], b["p"], b["q"], b["members"], strict=True):
                tile = np.array([m["tile"] for m in members])
                of = {int(t): np.flatnonzero(tile == t) for t in np.unique(tile)}
                ids, n = (np.array([m[k] for m in members], dtype=np.int64) for k in ("cid", "n"))
                full = np.array([m["embedding"] for m in members], dtype=kind)
                small = {t: (lambda x: (x[0], x[1].astype(np.float32), _upward(x[2])))(quantised(unit(full[x]))) for t, x in of.items()}
                count, edges = np.zeros(len(ids), dtype=np.int64), []
                for t, u in _pairs(sorted(of), p, q, strip):
                    maybe = may_link(small[t], small[u], threshold)
                    if t == u:
                        np.fill_diagonal(maybe, False)
                    sure = links(full[of[t]], full[of[u]], maybe, threshold)
                    count[of[t]] += sure @ n[of[u]]
                    if t != u:
                        count[of[u]] += n[of[t]] @ sure
                    i, j = np.flatnonzero(sure.any(axis=1)), np.flatnonzero(sure.any(axis=0))
                    both = np.zeros((len(i) + len(j),) * 2, dtype=bool)
                    both[: len(i), len(i) :] = sure[np.ix_(i, j)]
                    both |= both.T
                    edges += forest(np.concatenate((ids[of[t]][i], ids[of[u]][j])), both)
                have = np.flatnonzero(count)
                a = [*ids[have].tolist(), *(e[0] for e in edges)]
                yield pd.DataFrame({"a": pd.array(a, dtype="Int64"), "b": pd.array([*[None] * len(have), *(e[1] for e in edges)], dtype="Int64"), "links": pd.array([*count[have].tolist(), *[0] * len(edges)], dtype="Int64")})

    some = stored(_survivors(classes, tiles, threshold, wide))
    full = some.select("strip", "p", "q", "cid", "dim").join(classes.drop("strip", "dim"), "cid")
    return full.groupBy("dim", "strip", "p", "q").agg(F.collect_list(F.struct("cid", "n", "tile", "embedding")).alias("members")).mapInPandas(run, "a bigint, b bigint, links bigint")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    wide = "double" in dict(vectors.dtypes)["embedding"]
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>" if wide else "array<float>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    ok = F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()
    classes = stored(rows.where(ok).groupBy("embedding").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n")))
    tiles = max(1, -(-classes.count() // tile))
    strip = F.greatest(F.least(F.lit(STRIP), F.floor(F.lit(ENTRIES) / (tile * F.col("dim"))).cast("int")), F.lit(1))
    dealt = classes.withColumn("dim", F.size("embedding")).withColumn("tile", F.pmod(F.xxhash64("cid"), F.lit(tiles)).cast("int")).withColumn("strip", strip)
    met = stored(_compared(dealt, tiles, threshold, wide))
    counts = met.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    found = roots(met.where("b is not null").select("a", "b"))
    label = (
        classes.join(counts, F.col("cid") == F.col("a"), "left")
        .join(found, F.col("cid") == F.col("node"), "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("component_id"))
    )
    own = rows.withColumn("_key", F.when(ok, F.col("embedding"))).join(label.withColumnRenamed("embedding", "_key"), "_key", "left")
    out = own.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
