"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Random indexing. A word (a run of letters, digits and underscores, or a run of other signs; case counts) has an index vector of ``NONZERO`` entries +1 or -1 at
places that its hash gives. A word's vector is the sum of the index vectors of the words within ``WINDOW`` places around it, over
the whole corpus. Words are hashed to ``ROWS`` rows, a fixed number, and words of one row share a vector, in which the frequent one prevails; so
the table has the same size for any corpus, and no word is left out. Each task sums its texts in integers and writes its
rows as blocks; blocks are added as they stream by, so neither tasks nor groups hold more than the table. Rows are scaled to length 1, the mean
vector is taken off, and they are scaled again.

Pooling. A document is the mean of all its words' vectors, each weighted by SMOOTH / (SMOOTH + its share of the corpus), with the length of
that mean (near 1 if few words make up the text), the mean weight,
the mean products of vectors one and two words apart (near 1 if words are repeated), and the logarithm of the number of words. A document's sums are made in pieces from its start, so they do not depend on the partitions.

The network has one hidden layer of tanh units. It is fitted in the driver, with a fixed seed, on at most ``SAMPLE`` labelled documents, those with the smallest hash
of doc_id; a fifth of these are kept from the fit, to choose the epoch and the temperature that divides the logits.

Labels: a document's label is 1 where the mean of its labels is 0.5 or more; null labels and null ids are ignored, so are rows held out (crc32 of the
decimal doc_id divisible by 5; a null doc_id counts as held out). Without labels of both kinds, every document's score is the smoothed share of
label 1. Null and empty texts have no words and get the score of an empty mean. Repeated rows are scored each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

#: Rows and entries of the table of word vectors; index entries of a word; words on each side that count as near.
ROWS, SIZE, NONZERO, WINDOW = 1 << 15, 64, 4, 2
#: Rows of the table in one block; words that are handled at once; words of a piece of a document.
BLOCK, CHUNK, PIECE = 256, 1 << 17, 1 << 13
#: Labelled documents of a fit at most; hidden units; epochs; the weights' smoothing.
SAMPLE, HIDDEN, EPOCHS, SMOOTH = 20_000, 32, 60, 1e-3
WORD = re.compile(r"\w+|[^\w\s]+")


class Network(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _hashes(texts: Iterator[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all words of many texts, and the texts' numbers of words, for as many whole texts as have ``CHUNK`` words."""
    words: list[str] = []
    sizes: list[int] = []

    def hashed():
        return (pd.util.hash_array(np.array(words, dtype=object)) if words else np.zeros(0, np.uint64)), np.array(sizes, np.int64)

    for text in texts:
        found = WORD.findall(text)
        words += found
        sizes.append(len(found))
        if len(words) >= CHUNK:
            yield hashed()
            words, sizes = [], []
    if sizes:
        yield hashed()


def _row(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(ROWS)).astype(np.int64)


def _entries(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place and sign of each of the index entries of words."""
    for k in range(NONZERO):
        bits = (h >> np.uint64(20 + 10 * k)).astype(np.int64)
        yield bits % SIZE, 1 - 2 * ((bits >> 9) & 1)


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks (block, counts, table) of one partition's sums that are not all 0."""
    table, counts = np.zeros(ROWS * SIZE, np.int64), np.zeros(ROWS, np.int64)
    for b in batches:
        for h, sizes in _hashes(b["text"]):
            rows, text = _row(h), np.repeat(np.arange(len(sizes)), sizes)
            counts += np.bincount(rows, minlength=ROWS)
            for place, sign in _entries(h):
                for step in range(1, WINDOW + 1):
                    near = np.flatnonzero(text[step:] == text[:-step])
                    for me, other in ((near, near + step), (near + step, near)):
                        table += np.bincount(rows[me] * SIZE + place[other], weights=sign[other], minlength=ROWS * SIZE).astype(np.int64)
    yield _blocks(counts, table)


def _blocks(counts: np.ndarray, table: np.ndarray) -> pd.DataFrame:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    counts, table = counts.reshape(-1, BLOCK), table.reshape(-1, BLOCK * SIZE)
    some = np.flatnonzero(counts.any(axis=1))
    return pd.DataFrame({"block": some, "counts": [pack.compress(counts[n].tobytes()) for n in some], "table": [pack.compress(table[n].tobytes()) for n in some]})


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of blocks; all blocks together are no more than the table."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    counts, table = np.zeros((ROWS // BLOCK, BLOCK), np.int64), np.zeros((ROWS // BLOCK, BLOCK * SIZE), np.int64)
    for b in batches:
        for n, c, t in zip(b["block"], b["counts"], b["table"], strict=True):
            counts[n] += np.frombuffer(unpack.decompress(c), np.int64)
            table[n] += np.frombuffer(unpack.decompress(t), np.int64)
    yield _blocks(counts.ravel(), table.ravel())


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The table of word vectors (ROWS x SIZE) and the weight of each row, from all texts."""
    import zstandard

    unpack, schema = zstandard.ZstdDecompressor(), "block int, counts binary, table binary"
    parts = docs.select(text_of().alias("text")).mapInPandas(_contexts, schema)
    counts, table = np.zeros((ROWS // BLOCK, BLOCK), np.int64), np.zeros((ROWS // BLOCK, BLOCK * SIZE), np.int64)
    for r in parts.repartition("block").mapInPandas(_added, schema).toLocalIterator():  # ROWS / BLOCK blocks
        counts[r["block"]] = np.frombuffer(unpack.decompress(r["counts"]), np.int64)
        table[r["block"]] = np.frombuffer(unpack.decompress(r["table"]), np.int64)
    counts, vectors = counts.ravel().astype(float), table.reshape(ROWS, SIZE).astype(float)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    vectors = unit(vectors)
    share = counts / max(1.0, counts.sum())
    vectors = unit(vectors - (vectors * share[:, None]).sum(axis=0))
    return np.round(vectors, 6).astype(np.float32), SMOOTH / (SMOOTH + share)


def pooled(texts: Iterator[str], vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row a text: weighted mean of its words' vectors, the mean's length, the mean weight, mean products of vectors 1 and 2 words apart, log of the number of words."""
    out = []
    for h, sizes in _hashes(texts):
        rows = _row(h)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        text = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.zeros((len(sizes), SIZE + 3))
        # pieces of a text, from its start: whole pieces are summed, then a text's pieces in order
        cuts = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(starts[:-1], starts[1:], strict=True)] + [np.zeros(0, np.int64)]).astype(np.int64)
        ends = np.append(cuts[1:], len(rows))
        at = 0
        while at < len(cuts):
            to = max(at + 1, int(np.searchsorted(ends, cuts[at] + CHUNK // 4, side="right")))
            lo, hi = cuts[at], ends[to - 1]
            v, w = vectors[rows[lo : hi + 2]], weights[rows[lo:hi]]
            x = np.zeros((hi - lo, SIZE + 3))
            np.multiply(v[: hi - lo], w[:, None], out=x[:, :SIZE])
            x[:, SIZE] = w
            for step in (1, 2):
                n = min(hi - lo, len(rows) - step - lo)
                if n > 0:
                    x[:n, SIZE + step] = np.where(text[lo : lo + n] == text[lo + step : lo + step + n], np.einsum("ij,ij->i", v[:n], v[step : step + n]), 0)
            np.add.at(sums, text[cuts[at:to]], np.add.reduceat(x, cuts[at:to] - lo, axis=0))
            at = to
        n = np.maximum(sizes, 1)[:, None]
        mean = sums[:, :SIZE] / np.maximum(sums[:, SIZE : SIZE + 1], 1e-12)
        out.append(np.hstack([mean, np.linalg.norm(mean, axis=1, keepdims=True), sums[:, SIZE:] / n, np.log1p(sizes)[:, None]]))
    return np.concatenate(out) if out else np.zeros((0, SIZE + 5))


def fit_network(x: np.ndarray, y: np.ndarray, kept_out: np.ndarray) -> Network:
    """Two layers by Adam; the epoch with the least loss on the rows kept out, and the temperature that lowers that loss most."""
    rng = np.random.default_rng(12)
    mean, scale = x[~kept_out].mean(axis=0), x[~kept_out].std(axis=0) + 1e-9
    z, t = (x - mean) / scale, y.astype(float)
    own = np.flatnonzero(~kept_out)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step, best = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0, (np.inf, p)
    loss = lambda logit, label: float(np.mean(np.logaddexp(0, logit) - label * logit))
    check = np.flatnonzero(kept_out) if kept_out.any() else own
    for _ in range(EPOCHS):
        order = rng.permutation(own)
        for lo in range(0, len(order), 128):
            rows = order[lo : lo + 128]
            hidden = np.tanh(z[rows] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30))) - t[rows]) / len(rows)
            back = np.outer(error, p[2]) * (1 - hidden**2)
            grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(axis=0), hidden.T @ error + 1e-4 * p[2], np.array([error.sum()])]
            step += 1
            for n, g in enumerate(grads):
                m[n], v[n] = 0.9 * m[n] + 0.1 * g, 0.999 * v[n] + 0.001 * g * g
                p[n] = p[n] - 3e-3 * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
        now = loss(np.tanh(z[check] @ p[0] + p[1]) @ p[2] + p[3], t[check])
        if now < best[0]:
            best = (now, [a.copy() for a in p])
    w1, b1, w2, b2 = best[1]
    logit = np.tanh(z[check] @ w1 + b1) @ w2 + b2
    temperature = min(np.exp(np.linspace(-1.5, 1.5, 121)), key=lambda s: loss(logit / s, t[check]))
    return Network(mean, scale, w1, b1, w2, float(b2[0]), float(temperature))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _frame(vectors, weights):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"order": b["order"], "tie": b["tie"], "fold": b["fold"], "label": b["label"], "x": list(pooled(iter(b["text"]), vectors.value, weights.value))})

    return run


def fit(docs: DataFrame, labels: DataFrame, vectors, weights, most: int = SAMPLE) -> Network | float:
    """The network, or the smoothed share of label 1 where there are not both labels on both sides."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    marked = marked.select("doc_id", "label", F.xxhash64("doc_id").alias("order"), fold(F.col("doc_id")).cast("int").alias("fold")).where("fold <> 0")
    chosen = stored(marked.orderBy("order", "doc_id").limit(most))
    met = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows
    rows = met.select("order", F.xxhash64("text").alias("tie"), "fold", "label", "text").mapInPandas(_frame(vectors, weights), "order bigint, tie bigint, fold int, label int, x array<double>")
    got = stored(rows).orderBy("order", "tie").limit(most).collect()  # a doc_id may stand in many rows
    y, kept_out = np.array([r["label"] for r in got], int), np.array([r["fold"] == 1 for r in got], bool)
    if len(set(y[~kept_out])) < 2 or len(set(y[kept_out])) < 2:
        return (float(y.sum()) + 1) / (len(y) + 2)
    return fit_network(np.array([r["x"] for r in got]), y, kept_out)


def scored(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score."""
    context = docs.sparkSession.sparkContext
    vectors, weights = map(context.broadcast, word_vectors(docs))
    model = context.broadcast(fit(docs, labels, vectors, weights, most))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            score = np.full(len(b), m) if isinstance(m, float) else m.probability(pooled(iter(b["text"]), vectors.value, weights.value))
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": score})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), text_of().alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, held_out boolean, score double")


def op12(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
