"""Packing token pieces into sequences: dominance reduction, then best fit.

Texts are tokenised where they lie, each distinct word of a slice of them once; a document
longer than ``capacity`` is cut. Only the histogram of piece lengths (at most ``capacity``
rows) reaches the driver. There, by the dominance rules of Martello and Toth, sets that
provably belong to some best packing are fixed: a piece that no other fits beside, two that
fill a sequence exactly, and a piece with the largest one beside it where no third could fit.
What is left is packed by best fit, longest first. All of this works on counts, and yields runs: so many equal sequences, so
many pieces of one length in each. Every piece finds its place from its length and its rank
among pieces of that length; ranks are counted in salted groups, so that a very common length
is spread over many tasks.

Null and empty texts are one piece of one token, the closing id. Repeated rows are packed each on
its own; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import os
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

CAPACITY, CLOSE = 2048, 0
#: Bytes of text whose distinct words are looked for together, and bytes of words in one call of the tokenizer, about.
SLICE, CALL = 1 << 24, 1 << 16
#: Characters that a word of letters may end with: ASCII punctuation, no letter and no number. Blanks beyond ASCII below U+0250.
MARKS = string.punctuation
BLANKS = str.maketrans("\x85\xa0", "  ")
IDS = pa.large_binary()
#: Rows in a salted group, about, and most runs that are broadcast.
GROUP, BROADCAST = 20_000, 200_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import numpy as np

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    # the same model for words of lower-case letters alone, which nothing changes and only white space parts
    letters = Tokenizer(tokenizer.model)
    letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    closing = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    closing[[i for token, i in tokenizer.get_vocab().items() if token.endswith(tokenizer.model.end_of_word_suffix or "</w>")]] = True
    return tokenizer, closing, letters


def _low(text: str) -> bool:
    """Whether all characters are below U+0250."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return max(text) < "ɐ"
    return True


def _plain(text: str) -> bool:
    """Whether words can be encoded apart and in lower case: no token string, no separator that libraries differ on."""
    return "<|" not in text and _low(text) and not any(c in text for c in "\x1c\x1d\x1e\x1f")


def _slices(rows, sizes: pa.Array, most: int) -> Iterator:
    """Adjacent rows with about ``most`` bytes at a time."""
    ends = pc.cumulative_sum(sizes.cast(pa.int64())).to_numpy()
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, bisect.bisect_right(ends, (ends[lo - 1] if lo else 0) + most))
        yield rows.slice(lo, hi - lo)
        lo = hi


def _of_letters(words: pa.LargeStringArray, path: str) -> pa.LargeBinaryArray:
    """Ids of words of letters alone: each ends with its only token that closes a word."""
    import numpy as np

    _, closing, tokenizer = _tokenizer(path)
    out = [pa.array([], IDS)]
    for some in _slices(words, pc.binary_length(words), CALL):
        ids = np.asarray(tokenizer.encode_batch_fast([" ".join(some.to_pylist())], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = 4 * (np.flatnonzero(closing[ids]) + 1)
        out.append(_cut(ids, stops) if len(stops) == len(some) else _of_any(some, path))
    return pa.concat_arrays(out)


def _of_any(words: pa.LargeStringArray, path: str) -> pa.LargeBinaryArray:
    """Ids of any words, told apart by the places of their tokens."""
    import numpy as np

    out = [pa.array([], IDS)]
    for some in map(pa.Array.to_pylist, _slices(words, pc.binary_length(words), CALL)):
        coded = _tokenizer(path)[0].encode(" ".join(some), add_special_tokens=False)
        stop_at = np.cumsum([len(w) + 1 for w in some])
        at = np.searchsorted(stop_at, np.fromiter((o[0] for o in coded.offsets), dtype=np.int64, count=len(coded.offsets)), side="right")
        out.append(_cut(np.asarray(coded.ids, dtype="<u4"), 4 * np.searchsorted(at, np.arange(len(some)), side="right")))
    return pa.concat_arrays(out)


def _cut(data, stops, kind: pa.DataType = IDS) -> pa.Array:
    """Adjacent pieces of a buffer that end at the given bytes."""
    import numpy as np

    return pa.Array.from_buffers(kind, len(stops), [None, pa.py_buffer(np.concatenate([[0], stops]).astype("<i8")), pa.py_buffer(data)])


def _of_words(words: pa.StringArray, path: str) -> pa.LargeBinaryArray:
    """Ids of distinct words in lower case. Letters and the marks after them are encoded apart, as the tokenizer does too; each distinct part once."""
    import numpy as np

    core = pc.utf8_rtrim(words, characters=MARKS)
    size = pc.binary_length(words).to_numpy().astype("<i8")
    ends = np.cumsum(size)
    marks = np.where(pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False), size - pc.binary_length(core).to_numpy(), 0)
    halves = _cut(words.buffers()[2] or b"", np.column_stack([ends - marks, ends]).ravel(), pa.large_string()).dictionary_encode()
    parts = halves.dictionary
    letters = pc.utf8_is_alpha(parts)
    ids = pa.concat_arrays([_of_letters(parts.filter(letters), path), _of_any(parts.filter(pc.invert(letters)), path)])
    is_letters = letters.to_numpy(zero_copy_only=False)
    place = np.where(is_letters, np.cumsum(is_letters), is_letters.sum() + np.cumsum(~is_letters)) - 1
    ids = ids.take(pa.array(place).take(halves.indices))
    return _cut(ids.buffers()[2] or b"", np.frombuffer(ids.buffers()[1], dtype="<i8")[2 : len(ids) + 1 : 2])


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, by a tokenizer that drops white space.

    Each distinct word of the texts is encoded once; no word is kept for the next call.
    """
    import numpy as np

    plain = [_plain(t) for t in texts]
    split = pc.ascii_split_whitespace(pa.array([t.lower().translate(BLANKS) if "\x85" in t or "\xa0" in t else t.lower() for t, p in zip(texts, plain, strict=True) if p], pa.string()))
    bounds, words = split.offsets.to_numpy(), split.values.dictionary_encode()
    del split  # its words are as large as the texts
    ids = _of_words(words.dictionary, path).take(words.indices)  # of all words, in order
    data = memoryview(ids.buffers()[2] or b"")
    stops = iter(np.frombuffer(ids.buffers()[1], dtype="<i8")[bounds].tolist())
    at, out = next(stops, 0), []
    for t, p in zip(texts, plain, strict=True):
        if p:
            start, at = at, next(stops)
            out.append(data[start:at].tobytes())
        else:
            out.append(np.asarray(_tokenizer(path)[0].encode_batch_fast([t], add_special_tokens=False)[0].ids, dtype="<u4").tobytes())
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, column: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, one row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close = CLOSE.to_bytes(4, "little")
        for b in batches:
            for part in _slices(b, pc.binary_length(b.column(1)), SLICE):
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist(), path), strict=True):
                    ids += close
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        for to, x in zip(out, (doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                            to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), text_of(F.col(column)).alias("text")).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Plan:
    """Runs of a packing: (length, first rank, pieces per sequence, sequences, first sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {k: n for k, n in histogram.items() if n}
        self.rank = dict.fromkeys(self.left, 0)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self._reduce()
        self._best_fit()

    def _take(self, length: int, each: int, sequences: int, first: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], each, sequences, first, offset))
        self.rank[length] += each * sequences
        self.left[length] -= each * sequences

    def _fix(self, a: int, b: int | None, sequences: int) -> None:
        if a == b:
            self._take(a, 2, sequences, self.sequences, 0)
        else:
            self._take(a, 1, sequences, self.sequences, 0)
            if b is not None:
                self._take(b, 1, sequences, self.sequences, a)
        self.sequences += sequences

    def _reduce(self) -> None:
        lengths = sorted(self.left)
        for a in reversed(lengths):
            while self.left[a]:
                room = self.capacity - a
                lengths = [x for x in lengths if self.left[x]]
                beside = [x for x in lengths[: bisect.bisect_right(lengths, room)] if x != a or self.left[a] > 1]
                if not beside:  # nothing fits beside it
                    self._fix(a, None, self.left[a])
                    continue
                b = beside[-1]
                n = self.left[a] // 2 if a == b else min(self.left[a], self.left[b])
                spare = self.left[beside[0]] - (beside[0] == a)
                third = 2 * beside[0] if spare > 1 else beside[0] + beside[1] if len(beside) > 1 else room + 1
                if a + b == self.capacity or third > room:  # an exact fill; or no set of three holds it, and b is the largest second
                    if third > room and a + b < self.capacity and a == b and self.left[a] % 2 and n == 0:
                        break
                    self._fix(a, b, n)
                    continue
                break

    def _best_fit(self) -> None:
        open_: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, sequences)
        rooms: list[int] = []

        def put(room: int, first: int, n: int) -> None:
            if n and room:
                if room not in open_:
                    bisect.insort(rooms, room)
                open_.setdefault(room, []).append((first, n))

        for length in sorted(self.left, reverse=True):
            while self.left[length]:
                i = bisect.bisect_left(rooms, length)
                if i < len(rooms):
                    room = rooms[i]
                    first, n = open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[i]
                else:
                    room, first = self.capacity, self.sequences
                    n = -(-self.left[length] // (room // length))
                    self.sequences += n
                each = room // length
                full = min(n, self.left[length] // each)
                if full:
                    self._take(length, each, full, first, self.capacity - room)
                    put(room - each * length, first, full)
                first, n = first + full, n - full
                if n and self.left[length]:  # fewer than would fill one more
                    some = self.left[length]
                    self._take(length, some, 1, first, self.capacity - room)
                    put(room - some * length, first, 1)
                    first, n = first + 1, n - 1
                put(room, first, n)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for every row of ``pieces``."""
    rows = stored(rows)
    spark = rows.sparkSession
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = Plan(histogram, capacity)
    salts = max(64, sum(histogram.values()) // GROUP)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)))
    group = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    earlier = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("earlier"))
    ranked = salted.withColumn("nth", F.row_number().over(group) - 1).join(earlier, ["length", "salt"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    runs = spark.createDataFrame(plan.runs, "length bigint, rank0 bigint, each bigint, sequences bigint, sequence0 bigint, offset0 bigint")
    if len(plan.runs) <= BROADCAST:
        runs = F.broadcast(runs)
    nth = F.col("rank") - F.col("rank0")
    placed = ranked.join(runs, (ranked["length"] == runs["length"]) & (nth >= 0) & (nth < F.col("each") * F.col("sequences")))
    return placed.select(
        *[rows[c] for c in rows.columns],
        (F.col("sequence0") + F.floor(nth / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("offset0") + nth % F.col("each") * rows["length"]).cast("bigint").alias("offset"),
    )


def op10(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
