"""Near-duplicates by a chosen-path set similarity join over word shingles.

A document's set is its distinct word shingles; documents with equal sets form one class, and one
member stands for it. Each tree sends every class down paths: a node chooses one or two of its tree's
own minwise places that the path has not used, and classes that agree on a chosen token share a child.
Nodes of up to ``SMALL`` classes are compared exhaustively on their signatures, larger ones branch
again, down to ``DEPTH``. What looks alike is gathered into candidate clusters, whose full sets are compared.

Nodes and clusters that are large hold near copies. They are settled (``settled``): members are compared
in blocks, then all blocks with the pivots, one block's members of the largest component found; only what still stands
outside the largest component is compared with all others. Pairs within one component need no comparison, so
work and rows grow with the members, and with the square only of those that stay apart. A task emits
at most one edge for each component that it joins to another. A node that keeps most of its parent's members is
settled at once, since branching does not part its members.

``trees_for`` takes the number of trees from the target recall: a pair at the threshold meets in a tree with
a chance of at least ``s * (1 - TWO) + (1 - (1 - s) ** 2) * TWO`` a level, for ``DEPTH`` levels, nearly; most pairs
meet higher up. Trees use minwise places of their own, so they fail independently.

Null and empty texts have an empty set and link with nothing. Repeated rows are in one class.
Rows of one doc_id count as one document. A row without doc_id has no component and is kept.
Very long texts are one set like all others. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of
from .components import roots

SIGNATURE, DEPTH, SMALL = 64, 3, 192
#: Share of nodes that choose two places; least chance that a pair at the threshold meets in some tree, even at the deepest level.
TWO, RECALL = 0.18, 0.9999
#: A candidate pair agrees in at least so many signature places as a pair at the threshold has, less so many standard deviations.
DEVIATIONS = 5.5
#: Classes in a block whose full sets are compared; columns of a block's incidence matrix at a time.
BLOCK, COLUMNS = 64, 4096
#: Most turns of pivots; they end earlier where a turn no longer halves what stands outside.
TURNS = 12
#: Blocks outside the largest component up to which no further turn is taken.
FEW_BLOCKS = 16
#: Most bytes of pivots, or of members outside, that are broadcast; parts of a group beyond that.
BROADCAST_BYTES, SALTS = 1 << 26, 32
#: Most candidate documents whose ids are broadcast.
BROADCAST = 1_000_000
SALT = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True


def shingled(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of some texts, and where each text's begin (with the end as last)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    text_end = np.cumsum([len(t) + 1 for t in texts])
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))  # starts and ends in turn
    start, stop = edge[::2], edge[1::2]
    words = len(start)
    # a word's hash: its bytes, each mixed with its place in the word, summed
    length = stop - start
    inside = np.flatnonzero(~blank)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
    value = _mixed((_LOWER[data[inside]].astype(np.uint64) + np.uint64(1)) + (place.astype(np.uint64) << np.uint64(8)) + SALT)
    word = _mixed(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64)) if words else np.empty(0, np.uint64)
    first = np.concatenate(([0], np.searchsorted(start, text_end)))  # each text's first word
    count = np.diff(first)
    shingles = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    bounds = np.concatenate(([0], np.cumsum(shingles)))
    at = np.repeat(first[:-1] - bounds[:-1], shingles) + np.arange(bounds[-1])
    have = np.repeat(np.minimum(count, width), shingles)
    out = have.astype(np.uint64)
    for j in range(width):
        here = np.where(j < have, word[np.minimum(at + j, max(words - 1, 0))] if words else 0, np.uint64(0))
        out = _mixed(out * np.uint64(31) + here)
    return out, bounds


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, sorted."""
    which = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, which))
    h, w = hashes[order], which[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    return h[new], np.searchsorted(w[new], np.arange(len(bounds)))


_A = _mixed(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * SALT) | np.uint64(1)


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minwise tokens, one row per non-empty text."""
    out = np.empty((SIGNATURE, len(bounds) - 1), dtype=np.uint32)
    work, top = np.empty_like(h), np.empty(len(h), dtype=np.uint32)
    for i, a in enumerate(_A):
        np.multiply(h ^ (a >> np.uint64(7)), a, out=work)
        np.right_shift(work, np.uint64(32), out=work)
        top[:] = work
        out[i] = np.minimum.reduceat(top, bounds[:-1])
    return out.T


def _slices(column: pd.Series, most: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of rows with about ``most`` bytes of text, so that work space stays small."""
    texts, lo, held = [], 0, 0
    for i, t in enumerate(column):
        texts.append(t)
        held += len(t)
        if held >= most:
            yield lo, i + 1, texts
            texts, lo, held = [], i + 1, 0
    if texts:
        yield lo, lo + len(texts), texts


def described(docs: DataFrame, width: int, column: str = "text") -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit fingerprint, and its signature (null for an empty set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo, hi, texts in _slices(b["bytes"]):
                h, bounds = distinct(*shingled(texts, width))
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                print_a, print_b = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64)
                sig: list = [None] * len(n)
                if len(full):
                    starts = np.append(bounds[full], bounds[-1])
                    print_a[full] = np.add.reduceat(_mixed(h), starts[:-1])
                    print_b[full] = np.add.reduceat(_mixed(h ^ SALT), starts[:-1])
                    for k, s in zip(full, signatures(h, starts).view(np.int32), strict=True):
                        sig[k] = s
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[lo:hi].array, "n_shingles": n, "print_a": print_a.view(np.int64), "print_b": print_b.view(np.int64), "sig": sig})

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(F.col(column)).cast("binary").alias("bytes"))
    return source.mapInPandas(run, "doc_id bigint, n_shingles bigint, print_a bigint, print_b bigint, sig array<int>")


def trees_for(percent: int) -> int:
    """Trees that reach ``RECALL`` for pairs at the threshold, if all nodes branch down to ``DEPTH``."""
    s = percent / 100
    meet = (s * (1 - TWO) + (1 - (1 - s) ** 2) * TWO) ** DEPTH
    return min(math.ceil(math.log(1 - RECALL) / math.log(1 - meet)) if meet < RECALL else 1, SIGNATURE // DEPTH)


def _children(node: Column, left: Column, sig: Column) -> Column:
    """One child, now and then two, by the tokens at places that the node chooses among those that its path has left."""
    pick = lambda k, a: F.get(a, F.pmod(F.xxhash64(node, F.lit(k)), F.size(a)).cast("int"))
    child = lambda place: F.struct(F.xxhash64(node, place, F.get(sig, place)).alias("node"), F.array_remove(left, place).alias("left"))
    first = pick(0, left)
    two = (F.size(left) > 1) & (F.pmod(F.xxhash64(node, F.lit("two")), F.lit(100)) < int(100 * TWO))
    return F.when(two, F.array(child(first), child(pick(1, F.array_remove(left, first))))).otherwise(F.array(child(first)))


def forest(ids: np.ndarray, alike: np.ndarray) -> list[tuple[int, int]]:
    """Edges (larger, smaller) that connect what a symmetric matrix of links connects."""
    left, out = np.ones(len(ids), dtype=bool), []
    for k in np.argsort(ids, kind="stable"):
        if left[k]:
            left[k] = False
            reach = np.zeros(len(ids), dtype=bool)
            front = alike[k] & left
            while front.any():
                reach |= front
                left &= ~front
                front = alike[front].any(axis=0) & left
            out += [(int(x), int(ids[k])) for x in ids[reach]]
    return out


def _joins(few: np.ndarray, every: np.ndarray, alike: np.ndarray) -> list[tuple[int, int]]:
    """Edges between the labels of rows and columns that links join, no more than connect them."""
    i, j = np.nonzero(alike & (few[:, None] != every[None, :]))
    if not len(i):
        return []
    pairs = np.unique(np.stack((few[i], every[j]), axis=1), axis=0)
    ids, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(-1, 2)
    both = np.zeros((len(ids), len(ids)), dtype=bool)
    both[at[:, 0], at[:, 1]] = both[at[:, 1], at[:, 0]] = True
    return forest(ids, both)


def _small_groups(rows: DataFrame, group: str, column: str, alike: Callable) -> DataFrame:
    """Edges (a, b) of each whole group of rows (group, rep, column)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for members in b["members"]:
                own = [m[column] for m in members]
                out += forest(np.array([m["rep"] for m in members], dtype=np.int64), alike(own, own))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy(group).agg(F.collect_list(F.struct("rep", column)).alias("members")).mapInPandas(run, "a bigint, b bigint")


MEMBERS = "members array<struct<rep:bigint,label:bigint,value:{}>>"


def _in_blocks(rows: DataFrame, size: int, kind: str, alike: Callable) -> DataFrame:
    """Rows (grp, n, rep, value) in blocks (grp, n, block, members), labelled by the least rep that links within the block reach."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for members in b["members"]:
                own = [m["value"] for m in members]
                low = dict(forest(np.array([m["rep"] for m in members], dtype=np.int64), alike(own, own)))
                out.append([{"rep": m["rep"], "label": low.get(m["rep"], m["rep"]), "value": m["value"]} for m in members])
            yield b.assign(members=out)

    block = F.pmod(F.xxhash64("rep", "grp"), F.ceil(F.col("n") / size)).cast("int").alias("block")
    dealt = rows.groupBy("grp", "n", block).agg(F.collect_list(F.struct("rep", "value")).alias("members"))
    return dealt.mapInPandas(run, f"grp bigint, n bigint, block int, {MEMBERS.format(kind)}")


def _beside(blocks: DataFrame, some: DataFrame, size_of: Callable[[Column], Column]) -> DataFrame:
    """Blocks with each list ``some`` of their group: broadcast if it is small, else a group's blocks are dealt into parts."""
    total = some.agg(F.sum(F.aggregate("some", F.lit(0).cast("bigint"), lambda acc, m: acc + 32 + size_of(m["value"])))).first()[0] or 0
    if total <= BROADCAST_BYTES:
        return blocks.join(F.broadcast(some), "grp")
    salted = some.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return blocks.withColumn("salt", F.pmod("block", F.lit(SALTS))).join(salted, ["grp", "salt"]).drop("salt")


def _drawn(pairs: DataFrame, kind: str, alike: Callable) -> DataFrame:
    """Blocks whose members bear the pivots' label (top) where their own label has a link with a pivot (some)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for top, members, some in zip(b.pop("top"), b["members"], b.pop("some"), strict=True):
                rest = [m for m in members if m["label"] != top]
                linked = alike([m["value"] for m in rest], [m["value"] for m in some]).any(axis=1) if rest else ()
                hit = {m["label"] for m, yes in zip(rest, linked, strict=True) if yes}
                out.append([m | {"label": top} if m["label"] in hit else m for m in map(dict, members)])
            yield b.assign(members=out)

    return pairs.select("grp", "n", "block", "members", "top", "some").mapInPandas(run, f"grp bigint, n bigint, block int, {MEMBERS.format(kind)}")


def _between(pairs: DataFrame, alike: Callable) -> DataFrame:
    """Edges (a, b) between labels by the links of some members with all of a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for members, some in zip(b["members"], b["some"], strict=True):
                label = lambda x: np.array([m["label"] for m in x], dtype=np.int64)
                out += _joins(label(some), label(members), alike([m["value"] for m in some], [m["value"] for m in members]))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return pairs.select("members", "some").mapInPandas(run, "a bigint, b bigint")


def _largest(blocks: DataFrame, size: int, turn: int) -> DataFrame:
    """Of each group: its largest component (top), a block that holds many of it, another one each turn, and how many stand outside."""
    sizes = blocks.select("grp", "block", F.explode("members.label").alias("label")).groupBy("grp", "label", "block").count()
    filled = F.struct(F.least(F.col("count"), F.lit(size // 2)), F.xxhash64("block", F.lit(turn)))
    each = sizes.groupBy("grp", "label").agg(F.sum("count").alias("m"), F.max_by("block", filled).alias("block"))
    best = each.groupBy("grp").agg(F.max(F.struct("m", "label", "block")).alias("best"), F.sum("m").alias("all"))
    return best.select("grp", F.col("best.label").alias("top"), F.col("best.block").alias("block"), (F.col("all") - F.col("best.m")).alias("outside"))


def settled(rows: DataFrame, group: str, size: int, column: str, size_of: Callable[[Column], Column], alike: Callable) -> DataFrame:
    """Edges (a, b) that connect what links within each group of rows (group, n, rep, column) connect.

    ``alike`` gives the matrix of links between two lists of values, ``size_of`` the bytes of a value.
    """
    kind = dict(rows.dtypes)[column]
    rows = stored(rows.select(F.col(group).alias("grp"), "n", "rep", F.col(column).alias("value")))
    edges = _small_groups(rows.where(F.col("n") <= size), "grp", "value", alike)
    large = rows.where(F.col("n") > size)
    if large.isEmpty():
        return edges
    blocks = stored(_in_blocks(large, size, kind, alike))
    before, turn = None, 0
    while True:
        top = stored(_largest(blocks, size, turn))
        outside, most = top.agg(F.sum("outside"), F.max("outside")).first()
        if not outside or turn == TURNS or before is not None and (2 * outside > before or most <= FEW_BLOCKS * size):
            break
        pivots = blocks.join(F.broadcast(top) if top.count() <= BROADCAST else top, ["grp", "block"]).select("grp", "top", F.filter("members", lambda m: m["label"] == F.col("top")).alias("some"))
        blocks = stored(_drawn(_beside(blocks, stored(pivots), size_of), kind, alike))
        before, turn = outside, turn + 1
    own = blocks.select(F.explode("members").alias("m")).select(F.col("m.rep").alias("a"), F.col("m.label").alias("b")).where("a <> b")
    if not outside:
        return edges.unionByName(own)
    top = top.where("outside > 0")
    few = F.broadcast(top) if top.count() <= BROADCAST else top
    rest = blocks.join(few.drop("block"), "grp").select("grp", "outside", F.explode(F.filter("members", lambda m: m["label"] != F.col("top"))).alias("m"))
    pile = F.pmod(F.xxhash64("m.rep", "grp", F.lit("pile")), F.ceil(F.col("outside") / size)).cast("int").alias("pile")
    piles = stored(rest.groupBy("grp", pile).agg(F.collect_list("m").alias("some")))
    return edges.unionByName(own).unionByName(_between(_beside(blocks, piles, size_of), alike))


def _look_alike(sigs: list, others: list, agree: int) -> np.ndarray:
    s, o = np.asarray(sigs, dtype=np.int32), np.asarray(others, dtype=np.int32)
    if sigs is others and len(s) == 2:
        yes = np.count_nonzero(s[0] == s[1]) >= agree
        return np.array([[False, yes], [yes, False]])
    n = np.zeros((len(s), len(o)), dtype=np.uint8)
    for k in range(SIGNATURE):
        n += s[:, k, None] == o[None, :, k]
    return n >= agree


def overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over the hashes that occur twice or more."""
    both = sets if others is None else [*sets, *others]
    every, where, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    use = times[where] > 1
    row, col = row[use], shared[where[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    upto, since = (len(sets), 0) if others is None else (len(sets), len(sets))
    out = np.zeros((upto, len(both) - since))
    width = int(col[-1]) + 1 if len(col) else 0
    for lo in range(0, width, COLUMNS):
        a, z = np.searchsorted(col, [lo, lo + COLUMNS])
        m = np.zeros((len(both), min(COLUMNS, width - lo)), dtype=np.float32)
        m[row[a:z], col[a:z] - lo] = 1
        out += m[:upto] @ m[since:].T
    return out.astype(np.int64)


def candidates(classes: DataFrame, percent: int, trees: int | None = None) -> DataFrame:
    """Edges (a, b) that connect classes (rep, sig) which look alike, by the trees."""
    s = percent / 100
    trees = trees or trees_for(percent)
    agree = int(SIGNATURE * s - DEVIATIONS * (SIGNATURE * s * (1 - s)) ** 0.5)
    own = SIGNATURE // trees  # places of one tree
    roots_ = F.array(*[F.struct(F.xxhash64(F.lit("tree"), F.lit(t)).alias("node"), F.array(*map(F.lit, range(t * own, (t + 1) * own))).alias("left")) for t in range(trees)])
    rows = classes.select("rep", F.lit(None).cast("bigint").alias("up"), F.explode(F.flatten(F.transform(roots_, lambda r: _children(r["node"], r["left"], F.col("sig"))))).alias("c"))
    ready = None
    for level in range(1, DEPTH + 1):
        rows = rows.select("rep", "up", "c.node", "c.left")  # up: members of the parent
        # written apart, so that a very common node's rows can be split among tasks where they are joined
        counts = stored(rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"))
        inner = stored(rows.join(counts, "node"))
        branch = F.coalesce((F.col("n") > SMALL) & (2 * F.col("n") <= F.col("up")), F.col("n") > SMALL) if level < DEPTH else F.lit(False)
        done = inner.where(~branch).select("rep", "node", "n")
        ready = done if ready is None else ready.unionByName(done)
        if level < DEPTH:
            wide = inner.where(branch).join(classes, "rep")
            rows = wide.select("rep", F.col("n").alias("up"), F.explode(_children(F.col("node"), F.col("left"), F.col("sig"))).alias("c"))
    # nodes of the same members need one comparison only
    same = ready.groupBy("node").agg(F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"), F.first("n").alias("n"))
    one = same.groupBy("who", "n").agg(F.min("node").alias("node")).select("node")
    return settled(ready.join(one, "node").join(classes, "rep"), "node", SMALL, "sig", lambda v: 4 * F.size(v), lambda x, y: _look_alike(x, y, agree))


def confirmed(docs: DataFrame, clusters: DataFrame, width: int, percent: int, column: str = "text") -> DataFrame:
    """Edges (a, b) that connect documents of one candidate cluster (rep, cluster, n) whose full sets are alike enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo, hi, texts in _slices(b["bytes"]):
                h, bounds = distinct(*shingled(texts, width))
                sets = [h[i:j].view(np.int64).tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                yield b[["rep", "cluster", "n"]].iloc[lo:hi].assign(hashes=sets)

    def linked(blobs: list[bytes], others: list[bytes]) -> np.ndarray:
        sets = [np.frombuffer(x, dtype=np.int64) for x in blobs]
        more = sets if others is blobs else [np.frombuffer(x, dtype=np.int64) for x in others]
        both = overlaps(sets, None if others is blobs else more)
        size, other = (np.array([len(s) for s in x], dtype=np.int64) for x in (sets, more))
        out = 100 * both >= percent * (size[:, None] + other[None, :] - both)
        if others is blobs:
            np.fill_diagonal(out, False)
        return out

    some = clusters if clusters.count() > BROADCAST else F.broadcast(clusters)
    text = docs.select(F.col("doc_id").cast("bigint").alias("rep"), text_of(F.col(column)).cast("binary").alias("bytes")).join(some, "rep")
    sets = text.mapInPandas(run, "rep bigint, cluster bigint, n bigint, hashes binary").where(F.octet_length("hashes") > 0)
    return settled(sets, "cluster", BLOCK, "hashes", F.octet_length, linked)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, column: str = "text", trees: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    each = stored(described(docs, width, column))
    classes = stored(each.where("n_shingles > 0 and doc_id is not null").groupBy("print_a", "print_b").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    lone = classes.select("rep", "sig")
    found = roots(candidates(lone, percent, trees))
    members = found.select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
    members = members.unionByName(found.select(F.col("root").alias("rep"), F.col("root").alias("cluster")).distinct())
    sized = stored(members.join(members.groupBy("cluster").agg(F.count("*").alias("n")), "cluster"))
    links = roots(confirmed(docs, sized, width, percent, column))
    final = classes.join(links, F.col("rep") == F.col("node"), "left").select("print_a", "print_b", F.coalesce("root", "rep").alias("component_id"))
    own = each.drop("sig").join(final, ["print_a", "print_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, column: str = "text") -> DataFrame:
    """The documents without near duplicates of smaller doc_id; rows of one doc_id stay or go together."""
    gone = near_duplicates(docs.select("doc_id", column), width, percent, column).where(~F.col("kept")).select("doc_id").distinct()
    gone = stored(gone)
    small = gone.count() <= BROADCAST
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti")


def op6(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"), width=3, percent=85)
