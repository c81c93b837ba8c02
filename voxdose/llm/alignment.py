"""Alignment of two tokenizers over the same bytes, with counts of linked ids over the whole corpus.

A text's tokens by A and by B cover the same bytes; an A token and a B token are linked where their bytes overlap. Every link
ends where a token of either side ends, so the union of both sides' ends lists all links.

Counting spills outside memory. Texts are taken in slices. Each slice's (pair, document) records are dealt into ``RADIX`` parts by
the A id, sorted side-major (A id, B id, document), and written as runs compressed with zstd: a run's head has its pairs and how
many documents hold each, its tail the documents. The heads of a part are merged by a k-way heap over frames of
runs; as pairs come out A id by A id, each A id's highest count is known when its last pair has passed. Then the runs stream by once more, behind
their part's counts, and give each document of their slice its share of links with the highest count and of the counts' sum.
Only runs are shuffled: a pair that stands in every document is one entry in each run's head. Parts are dealt
over groups of ``fan_in`` slices, so a part of a large corpus is merged and streamed by many tasks. What a task holds is bounded by a slice's
runs of one part, and by the pairs of ids of a part.

Texts that are null, empty, or that a tokenizer does not give back byte by byte have no tokens: zeros and ''. Each row is a document of its own, repeated rows and
rows with a null doc_id too; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import SURE, encoding
from .common import stored, text_of

#: Documents of a slice at most; parts by the A id; entries of a frame, and of what is held before it is summed.
DOCS, RADIX, FRAME, HELD = 1 << 15, 128, 1 << 12, 1 << 18


class Sizes(NamedTuple):
    """Code points and documents of a slice beyond which the next one begins; runs that are merged at once."""

    points: int = 1 << 21
    docs: int = DOCS
    fan_in: int = 256


Run = tuple[np.ndarray, np.ndarray]


@lru_cache(maxsize=1)
def _exact(path: str):
    """A by its own library: for texts with characters that libraries may class in different ways."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=1)
def _pieces(path: str):
    import sentencepiece

    b = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    as_bytes = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode() for x in names]
    return b, as_bytes


def _digits(n: int) -> np.ndarray:
    """The decimal digits of 0 to n - 1, in rows of bytes that end in zeros, with room for a separator."""
    width = len(str(n - 1)) + 1
    return np.array([str(i) for i in range(n)], dtype=f"S{width}").view("u1").reshape(n, width)


class Pair:
    """Two tokenizers: A by its JSON file and the same vocabulary as ranks, B by its model."""

    _odd = re.compile(f"[^{SURE.pattern[1:-1]} \t\n\r]")

    def __init__(self, a_json: str, a_ranks: str, pattern: str, b_model: str):
        self.a_json, self.a = a_json, encoding(a_ranks, pattern)
        self.b, self.b_bytes = _pieces(b_model)
        self.a_size, self.b_size = self.a.n_vocab, len(self.b_bytes)
        self.a_lengths = np.zeros(self.a_size, dtype=np.int64)
        for token in self.a.token_byte_values():
            self.a_lengths[self.a.encode_single_token(token)] = len(token)
        self.b_lengths = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.a_digits, self.b_digits = _digits(self.a_size), _digits(self.b_size)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids by A and by B, or None where either side's bytes are not the text's, after a space."""
        if not text:
            return None
        spaced = " " + text
        raw = spaced.encode()
        b = self.b.encode(text, num_threads=1)
        if b"".join([self.b_bytes[i] for i in b]) != raw:
            return None
        a = np.array(_exact(self.a_json).encode(spaced, add_special_tokens=False).ids if self._odd.search(text) else self.a.encode_ordinary(spaced), dtype=np.int64)
        return (a, np.array(b, dtype=np.int64)) if self.a_lengths[a].sum() == len(raw) else None


@lru_cache(maxsize=1)
def _pair(*files: str) -> Pair:
    return Pair(*files)


def aligned(pair: Pair, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """For each text n_a, n_b, n_groups, n_links, groups_sha256; and the sorted (part, A, B, text) records of all links, as ``key`` makes them, with their numbers."""
    coded = [pair.encode(t) for t in texts]
    some = [n for n, x in enumerate(coded) if x is not None]
    rows: list[tuple] = [(0, 0, 0, 0, "")] * len(texts)
    if not some:
        return rows, np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate([coded[n][side] for n in some]) for side in (0, 1))
    n_a, n_b = (np.array([len(coded[n][side]) for n in some]) for side in (0, 1))
    del coded
    a_end, b_end = np.cumsum(pair.a_lengths[a]), np.cumsum(pair.b_lengths[b])
    text_end = a_end[np.cumsum(n_a) - 1]
    a_ends, b_ends = np.zeros(a_end[-1] + 1, bool), np.zeros(a_end[-1] + 1, bool)
    a_ends[a_end], b_ends[b_end] = True, True
    both = a_ends & b_ends
    a_so_far, b_so_far, g_so_far = (np.cumsum(x, dtype=np.int32) for x in (a_ends, b_ends, both))
    cut = np.flatnonzero(a_ends | b_ends)
    of = np.searchsorted(text_end, cut)
    linked_a, linked_b = a[a_so_far[cut] - a_ends[cut]], b[b_so_far[cut] - b_ends[cut]]
    key = (((linked_a % RADIX) * (pair.a_size // RADIX + 1) + linked_a // RADIX) * pair.b_size + linked_b) * DOCS + np.array(some)[of]
    records, times = np.unique(key, return_counts=True)

    met = np.flatnonzero(both)
    a_until, b_until = a_so_far[met], b_so_far[met]
    a_group, b_group = g_so_far[a_end] - both[a_end], g_so_far[b_end] - both[b_end]
    at_a = np.arange(len(a)) + np.concatenate([[0], b_until])[a_group]
    at_b = np.arange(len(b)) + a_until[b_group]
    width = max(pair.a_digits.shape[1], pair.b_digits.shape[1])
    out = np.zeros((len(a) + len(b), width), np.uint8)
    out[at_a, : pair.a_digits.shape[1]], out[at_b, : pair.b_digits.shape[1]] = pair.a_digits[a], pair.b_digits[b]
    out[at_a, -1], out[at_b, -1] = np.where(both[a_end], ord("|"), ord(",")), np.where(both[b_end], ord(";"), ord(","))
    out[at_b[np.cumsum(n_b) - 1], -1] = 0
    stays = out != 0
    ends = np.cumsum(stays.sum(axis=1))[np.cumsum(n_a + n_b) - 1]
    line = out[stays].tobytes()
    links = np.bincount(of, minlength=len(some))
    groups = np.diff(g_so_far[text_end], prepend=0)
    for m, n in enumerate(some):
        digest = hashlib.sha256(line[ends[m - 1] if m else 0 : ends[m]]).hexdigest()
        rows[n] = (int(n_a[m]), int(n_b[m]), int(groups[m]), int(links[m]), digest)
    return rows, records, times


def _packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(x.astype("<u4").tobytes() for x in arrays))


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype="<u4").astype(np.int64).reshape(n, -1)


def _head(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    return _packed(np.diff(pairs, prepend=0), counts & 0xFFFFFFFF, counts >> 32)


def _read_head(blob: bytes) -> Run:
    steps, low, high = _unpacked(blob, 3)
    return np.cumsum(steps), low + (high << 32)


def runs(pair: Pair, records: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, head, tail) of each part that has records; pairs are numbered within their part."""
    per_part = (pair.a_size // RADIX + 1) * pair.b_size * DOCS
    starts = np.searchsorted(records, np.arange(RADIX + 1) * per_part)
    for part in range(RADIX):
        lo, hi = starts[part], starts[part + 1]
        if lo < hi:
            x = records[lo:hi] - part * per_part
            pairs, counts = np.unique(x // DOCS, return_counts=True)
            yield part, _head(pairs, counts), _packed(x % DOCS, times[lo:hi])


def _summed(held: list[Run]) -> Run:
    pairs, counts = (np.concatenate([x[n] for x in held]) for n in (0, 1))
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(counts, first)


def heap_merged(runs: list[Run], frame: int = FRAME, most: int = HELD) -> Iterator[Run]:
    """The runs' pairs in order, with summed counts. A heap gives the frame with the smallest first pair; what lies before the first pair of all other frames is final."""
    heap = [(int(p[0]), n, 0) for n, (p, _) in enumerate(runs) if len(p)]
    heapq.heapify(heap)
    held, size, limit = [], 0, most
    while heap:
        _, n, at = heapq.heappop(heap)
        p, c = runs[n]
        held.append((p[at : at + frame], c[at : at + frame]))
        size += len(held[-1][0])
        if at + frame < len(p):
            heapq.heappush(heap, (int(p[at + frame]), n, at + frame))
        if size >= limit or not heap:
            p, c = _summed(held)
            cut = int(np.searchsorted(p, heap[0][0])) if heap else len(p)
            yield p[:cut], c[:cut]
            held, size = [(p[cut:], c[cut:])], len(p) - cut
            limit = max(most, 2 * size)


def _whole(runs: list[Run]) -> Run:
    frames = list(heap_merged(runs))
    return tuple(np.concatenate([x[n] for x in frames]) for n in (0, 1))  # type: ignore[return-value]


def _merge(batches: Iterator[pd.DataFrame], fan_in: int) -> Iterator[pd.DataFrame]:
    """One head for each (part, salt) in place of many, from rows in order of these. At most ``fan_in`` runs are open at once."""
    at, open_ = None, []

    def closed():
        return pd.DataFrame([(*at, _head(*_whole(open_)))], columns=["part", "salt", "head"])

    for b in batches:
        for part, salt, head in zip(b["part"], b["salt"], b["head"], strict=True):
            if (part, salt) != at:
                if at is not None:
                    yield closed()
                at, open_ = (part, salt), []
            open_.append(_read_head(head))
            if len(open_) >= fan_in:
                open_ = [_whole(open_)]
    if at is not None:
        yield closed()


def _shares(b_size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """From rows in order of (part, salt, slice), each part's counts (slice -1) before its runs, to the shares of a run's documents."""
        pairs = counts = best = None
        for b in batches:
            out = []
            for slice_, head, tail in zip(b["slice"], b["head"], b["tail"], strict=True):
                p, c = _read_head(head)
                if slice_ < 0:
                    pairs, counts = p, c
                    firsts = np.flatnonzero(np.diff(p // b_size, prepend=-1))
                    best = counts == np.repeat(np.maximum.reduceat(counts, firsts), np.diff(firsts, append=len(p)))
                    continue
                docs, times = _unpacked(tail, 2)
                at = np.repeat(np.searchsorted(pairs, p), c)
                n_best, total = np.zeros(DOCS, np.int64), np.zeros(DOCS, np.int64)
                np.add.at(n_best, docs, times * best[at])
                np.add.at(total, docs, times * counts[at])
                held = np.flatnonzero(total)
                out.append((slice_, _packed(held, n_best[held], total[held] & 0xFFFFFFFF, total[held] >> 32)))
            if out:
                yield pd.DataFrame(out, columns=["slice", "share"])

    return run


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of a slice's shares, by place, from rows in order of the slice."""
    at, sums = None, None
    for b in batches:
        out = []
        for slice_, share in zip(b["slice"], b["share"], strict=True):
            if slice_ != at:
                if at is not None:
                    out.append((at, *_short(sums)))
                at, sums = slice_, np.zeros((2, DOCS), np.int64)
            held, n_best, low, high = _unpacked(share, 4)
            sums[0, held] += n_best
            sums[1, held] += low + (high << 32)
        if out:
            yield pd.DataFrame(out, columns=["slice", "n_best", "count_sum"])
    if at is not None:
        yield pd.DataFrame([(at, *_short(sums))], columns=["slice", "n_best", "count_sum"])


def _short(sums: np.ndarray) -> tuple[list[int], list[int]]:
    n = int(np.flatnonzero(sums[1])[-1]) + 1
    return sums[0, :n].tolist(), sums[1, :n].tolist()


DOC = "struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>"


def _slices(batches: Iterator[pa.RecordBatch], sizes: Sizes) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= sizes.points or len(ids) >= sizes.docs:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def spilled(docs: DataFrame, files: tuple[str, ...], sizes: Sizes) -> DataFrame:
    """Runs (slice, part, head, tail), and for each slice a row with its documents (part null)."""
    struct = pa.struct([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())])
    schema = pa.schema([("slice", pa.int64()), ("part", pa.int32()), ("head", pa.binary()), ("tail", pa.binary()), ("docs", pa.list_(struct))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = _pair(*files), TaskContext.get().partitionId() << 32
        for ids, texts in _slices(batches, sizes):
            rows, records, times = aligned(pair, texts)
            told = [dict(zip(struct.names, (i, *r), strict=True)) for i, r in zip(ids, rows, strict=True)]
            out = [(number, None, None, None, told), *((number, *x, None) for x in runs(pair, records, times))]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            number += 1

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(run, f"slice bigint, part int, head binary, tail binary, docs array<{DOC}>")


def align(docs: DataFrame, a_json: str, a_ranks: str, pattern: str, b_model: str, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum for each row."""
    written = stored(spilled(docs, (a_json, a_ranks, pattern, b_model), sizes))
    made = written.where("part IS NOT NULL")
    salts = max(1, -(-made.count() // (RADIX * sizes.fan_in)))
    salted = made.withColumn("salt", F.pmod(F.xxhash64("slice"), F.lit(salts)).cast("int"))
    keys = ["part", "salt"]
    merged = lambda x: x.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(lambda b: _merge(b, sizes.fan_in), "part int, salt int, head binary")
    counts = stored(merged(merged(salted.select(*keys, "head")).withColumn("salt", F.lit(0))))
    told = counts.select("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).cast("bigint").alias("slice"), "head", F.lit(None).cast("binary").alias("tail"))
    stream = told.unionByName(salted.select(*told.columns)).repartition(*keys).sortWithinPartitions(*keys, "slice")
    shares = stream.mapInPandas(_shares(len(_pieces(b_model)[1])), "slice bigint, share binary")
    sums = shares.repartition("slice").sortWithinPartitions("slice").mapInPandas(_added, "slice bigint, n_best array<bigint>, count_sum array<bigint>")
    each = written.where("part IS NULL").select("slice", "docs").join(sums, "slice", "left").select(F.posexplode("docs").alias("at", "d"), "n_best", "count_sum")
    return each.select("d.*", *[F.coalesce(F.get(c, F.col("at")), F.lit(0).cast("bigint")).alias(c) for c in ("n_best", "count_sum")])


def op13(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    import public_tokenizers as public

    return align(docs.select("doc_id", "text"), public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, public.path("piece_bpe_32k.model"), sizes)
