"""Deduplication (2, 4, 6) against brute force, with odd rows added."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import DATA, connect, same
from pyspark.sql import functions as F

from voxdose.llm import components, embeddings, entries, minhash, repeats


class Union(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def add(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


@pytest.mark.parametrize("name", ["op2_suffix_array_dedup", "op4_embedding_near_dedup", "op6_minhash_near_dedup"])
def test_sql(spark, name):
    same(connect(DATA), entries.queries()[name](spark, DATA), entries.oracle_sql()[name])


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3), (7, None)]
    union = Union()
    for a, b in edges:
        if a is not None and b is not None:
            union.add(a, b)
    got = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: union.root(x) for x in union if union.root(x) != x}


def test_matching_statistics():
    rng = random.Random(5)
    for trial in range(40):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 50))) for _ in range(rng.randint(1, 6))]
        if trial % 3 == 0:
            parts += [parts[0], b"a" * 40]
        size = [len(p) for p in parts]
        end = np.cumsum(size)
        stop, start = np.repeat(end, size), np.repeat(end - size, size)
        raw = b"".join(parts)
        tails = [raw[i : stop[i]] for i in range(len(raw))]

        def common(a, b):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n

        want = [max((common(x, y) for j, y in enumerate(tails) if j != i), default=0) for i, x in enumerate(tails)]
        got = repeats.matching_statistics(np.frombuffer(raw, dtype=np.uint8) + np.uint8(1), stop, start)
        assert got.tolist() == want


def odd_texts(x):
    return [
        (-1, "ab" * 400), (-2, None), (-3, ""), (-4, "z" * 199), (-5, "q" * 201), (-6, "é" * 150), (-7, x[:300]), (-8, "hello " + x[100:350] + "é" * 40),
        (None, x[50:400]), (-9, "w" * 200), (-10, "w" * 200), (-11, x[:150] + "Q" + x[:150]), (-12, "".join(chr(200 + i % 50) + "y" for i in range(400))), (-13, "same row " * 50), (-13, "same row " * 50),
    ]


@pytest.mark.parametrize("wide", [20_000, 2])
def test_repeats(spark, monkeypatch, wide):
    monkeypatch.setattr(repeats, "WIDE", wide)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60)
    docs = spark.createDataFrame(docs.collect() + odd_texts(docs.orderBy("doc_id").first()["text"]), "doc_id long, text string")
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    seen = Counter(b[k : k + 200] for _, b in rows for k in range(len(b) - 199))
    want = Counter()
    for i, b in rows:
        gone = np.zeros(len(b) + 1, dtype=np.int8)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = 1
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        want[(i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone))) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(map(tuple, repeats.op2(docs).collect())) == want
    clean = {r["doc_id"]: r["text"] for r in repeats.without_repeats(docs).collect()}
    assert clean[-2] is None and clean[-3] == "" and clean[-9] == "" and clean[-4] == "z" * 199


def shingles(text, width):
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    rng = random.Random(width)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    docs += [(-1, "One two"), (-2, None), (-3, ""), (-4, "one  TWO"), (-5, "x"), (-6, " \n ")]
    word = ["w%d" % i for i in range(5000)]
    for g in range(6):  # chains of edits
        t = rng.sample(word, 150)
        for k in range(20):
            t = list(t)
            t[rng.randrange(150)] = rng.choice(word)
            docs.append((10_000 + 100 * g + k, " ".join(t)))
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width, percent).collect()
    sets = {i: shingles(t or "", width) for i, t in docs}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    union = Union()
    for pair in {(a, b) for ids in by.values() for a in ids for b in ids if a < b}:
        a, b = (sets[x] for x in pair)
        if 100 * len(a & b) >= percent * len(a | b):
            union.add(*pair)
    want = {i: (len(s), union.root(i), union.root(i) == i) for i, s in sets.items()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == want


def variants(n, changes, seed, tag=""):
    rng = random.Random(seed)
    base = [f"{tag}v{i}" for i in range(120)]
    out = []
    for k in range(n):
        t = list(base)
        for at in rng.sample(range(120), changes):
            t[at] = f"{tag}u{k}_{at}"
        out.append(" ".join(t))
    return out


def test_large_groups_of_near_copies(spark, monkeypatch):
    """More members than a node or a block holds: rows grow with the members, and components equal those of all pairs."""
    made = []
    plain = minhash.settled

    def counted(*args):
        edges = minhash.stored(plain(*args))
        made.append(edges.count())
        return edges

    monkeypatch.setattr(minhash, "settled", counted)
    for n in (500, 1500):
        close, apart, loose = variants(n, 1, 1), variants(n, 5, 2, "a"), variants(300, 9, 3, "b")  # all linked; some pairs linked; hardly any
        texts = close + apart + loose
        rows = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).collect()
        sets = [np.unique(minhash.shingled([t.encode()], 3)[0]) for t in texts]
        union, size = Union(), np.array([len(x) for x in sets])
        for lo, hi in ((0, n), (n, 2 * n), (2 * n, len(texts))):
            both = np.concatenate([minhash.overlaps(sets[lo:hi][i : i + 200], sets[lo:hi]) for i in range(0, hi - lo, 200)])
            linked = 100 * both >= 85 * (size[lo:hi, None] + size[None, lo:hi] - both)
            for i, j in zip(*np.nonzero(linked), strict=True):
                if i != j:
                    union.add(lo + int(i), lo + int(j))
        assert {r["doc_id"]: r["component_id"] for r in rows} == {i: union.root(i) for i in range(len(texts))}
    assert made[2] <= 4 * made[0] and made[3] <= 4 * made[1]


def test_settled_groups(spark):
    """Every mix of links: chains, stars, lone members, by turns of pivots and by what stands outside."""
    rng = random.Random(8)
    values = {g: [rng.randrange(0, 40 * (g + 1)) for _ in range(n)] for g, n in enumerate((1, 5, 40, 200, 700))}
    rows = [(g, len(v), 1000 * g + i, [x]) for g, v in values.items() for i, x in enumerate(v)]
    alike = lambda a, b: np.abs(np.array(a).reshape(-1, 1) - np.array(b).reshape(1, -1)) == 3
    edges = minhash.settled(spark.createDataFrame(rows, "g long, n long, rep long, x array<int>"), "g", 16, "x", lambda v: 4 * F.size(v), alike)
    got, want = Union(), Union()
    for e in edges.collect():
        got.add(e["a"], e["b"])
    for g, v in values.items():
        for i, x in enumerate(v):
            for j, y in enumerate(v):
                if abs(x - y) == 3:
                    want.add(1000 * g + i, 1000 * g + j)
    assert all(got.root(r[2]) == want.root(r[2]) for r in rows)


@pytest.mark.parametrize("broadcast", [0, 1 << 26])
def test_settled_beside(spark, monkeypatch, broadcast):
    monkeypatch.setattr(minhash, "BROADCAST_BYTES", broadcast)
    test_settled_groups(spark)


def test_more_trees_for_lower_similarity():
    assert minhash.trees_for(85) < minhash.trees_for(80) < minhash.trees_for(75) and minhash.trees_for(100) == 1


def test_rows_without_id_and_repeated_rows(spark):
    rows = minhash.near_duplicates(spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (9, "a b c d")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in rows if r["doc_id"]) == [(3, 3, True), (3, 3, True), (9, 3, False)]
    assert [r["kept"] for r in rows if r["doc_id"] is None] == [True]


@pytest.mark.parametrize("tile", [64, 4096])
def test_vectors(spark, tile):
    rng = np.random.default_rng(2)
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").limit(200).collect()]
    first = rows[0][1]
    rows += [(1000 + k, [float(x) for x in first + rng.normal(0, 0.03, 64)]) for k in range(90)]
    rows += [(-1, first), (-2, None), (-3, [0.0] * 64), (-4, [float("nan"), *first[1:]]), (-5, [None, *first[1:]]), (-6, [float("inf")] * 64), (-7, [1.0, 2.0]), (-8, [2.0, 4.0]), (-9, []), (-10, [1e-30 * x for x in first]), (None, first)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    union, links, fine = Union(), Counter(), []
    for i, e in ((r["vec_id"], r["embedding"]) for r in df.collect()):
        if i is not None and e and None not in e and np.isfinite(e).all() and any(e):
            x = np.array(e, dtype=np.float64)
            fine.append((i, x / np.linalg.norm(x)))
    for i, x in fine:
        for j, y in fine:
            if i < j and len(x) == len(y) and x @ y >= 0.9:
                links.update((i, j))
                union.add(i, j)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df, tile=tile).collect()}
    assert got.pop(None) == (0, None, True)
    assert got == {i: (links[i], union.root(i), union.root(i) == i) for i, _ in rows if i is not None}


@pytest.mark.parametrize("dim", [64, 1024, 1500])
def test_quantisation_bound(dim):
    """No pair at the threshold is lost, and hardly any far below it is recomputed."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, dim))
    x = embeddings.unit(np.concatenate([base + rng.normal(0, w, size=(40, dim)) for w in (0.3, 0.33, 0.36, 1.0)]))
    q, scale, error = embeddings.quantised(x)
    small = q * scale[:, None]
    exact = x @ x.T
    assert (np.abs(exact - small @ small.T) <= error[:, None] + (1 + error[:, None]) * error[None, :] + 1e-12).all()
    assert (embeddings.int_product(q, q) == q.astype(np.int64) @ q.astype(np.int64).T).all()
    packed = (q, scale.astype(np.float32), embeddings._upward(error))
    for threshold in (0.9, float(np.sort(exact, axis=None)[-700])):
        maybe = embeddings.may_link(packed, packed, threshold)
        assert maybe[exact >= threshold].all() and not maybe[exact < threshold - 2.2 * error.max()].any()
        assert (embeddings.links(x, x, maybe, threshold) == (exact >= threshold)).mean() > 0.9999


def test_vectors_of_many_dimensions(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 1024))
    x = np.concatenate((base, base + rng.normal(0, 0.4, base.shape), base + rng.normal(0, 0.5, base.shape)))
    rows = [(i, [float(v) for v in e], "same", i) for i, e in enumerate(x)]
    u = embeddings.unit(x)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cid string, tile int"), tile=32).collect()}
    assert got == dict(enumerate(linked.sum(axis=1).tolist())) and sum(got.values())


@pytest.mark.parametrize("op", [repeats.op2, minhash.op6, repeats.without_repeats, minhash.keep_one])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], "doc_id long, text string, n_chars long")).count() == 0


def test_empty_vectors(spark):
    assert embeddings.op4(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
