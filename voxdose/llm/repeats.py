"""Removal of long strings that occur more than once, by a run-length index.

A byte goes if some string of ``length`` bytes that covers it also starts anywhere else in
the corpus. Every such string holds an anchor: the place of the least ``GRAM``-byte hash among
its own, which depends on nothing but the string. So all places of a repeated string meet under one anchor:

1. anchors of all texts are counted, and those that occur once are dropped;
2. around each other anchor the context that a repeated string could span is taken; equal
   contexts are stored once, with their number, and need no search if they are all there is;
3. the different contexts of an anchor are indexed together: a run-compressed
   Burrows-Wheeler transform with the suffixes at both ends of each run. Longest matches with the
   neighbours in suffix order are measured at run ends alone. Within a run the match of the next place is
   one shorter, so matching statistics stream over the text from sample to sample;
4. places whose match is long enough mark their bytes, in every place of the context.

Anchors with more than ``WIDE`` different contexts are not gathered: there the hashes of all their strings are
counted by Spark instead, which gives the same marks.

Null and empty texts stay as they are. Repeated rows are copies of each other, so from ``length`` bytes on
they go entirely. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of
from .minhash import SALT, _mixed, _slices

LENGTH, GRAM = 200, 32
#: Bytes indexed together, about; most contexts of an indexed anchor; most documents whose keys are broadcast.
INDEXED, WIDE, BROADCAST = 1 << 19, 20_000, 1_000_000
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * SALT)


def _joined_hash(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    out = a * np.uint64(0xD6E8FEB86659FD93 + 2 * step)
    out ^= out >> np.uint64(29)
    out += b
    return out


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes (a power of two) from each place on."""
    h, step = _BYTE[data], 1
    while step < width:
        h = _joined_hash(h[:-step], h[step:], step)
        step *= 2
    return _mixed(h)


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: each anchor's text, place, hash, and hash of its context."""
    none = np.empty(0, np.int64)
    long = np.flatnonzero(end - begin >= length)
    if not len(long):
        return none, none, none, none
    h = rolling(data, GRAM)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    low, span, wide = key, 1, length - GRAM + 1
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    starts = end[long] - length + 1 - begin[long]
    text = np.repeat(long, starts)
    place = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts) + begin[text]
    chosen = (np.uint64(0xFFFFFFFF) - (low[place] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    new = np.ones(len(chosen), dtype=bool)
    new[1:] = chosen[1:] != chosen[:-1]
    chosen, text = chosen[new], text[new]
    left, right = np.maximum(chosen + GRAM - length, begin[text]), np.minimum(chosen + length, end[text])
    context = _mixed(((chosen - left).astype(np.uint64) << np.uint64(32)) + (right - chosen).astype(np.uint64))
    for at in range(0, 2 * length - GRAM, GRAM):
        context = _mixed(context * np.uint64(31) + h[np.minimum(left + at, right - GRAM)])
    return text, chosen - begin[text], h[chosen].view(np.int64), context.view(np.int64)


def suffix_order(text: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes in order, each ending at its ``stop``, and the ranks by their first 8, 16, 32 ... symbols.

    Symbols are above 0; an end sorts before all symbols, and equal suffixes by place.
    """
    n = len(text)
    place = np.arange(n)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | np.where(place + j < stop, padded[j : n + j], 0).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.ones(n, dtype=bool)
    first[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, place, 0))
    levels, depth = [(8, rank)], 8
    while True:
        tied = np.ones(n, dtype=bool)  # in order: not alone in its rank
        tied[:-1] = first[:-1] & first[1:]
        tied[:-1] = ~tied[:-1]
        tied[-1] = not first[-1]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        some = order[at]
        after = some + depth
        live = after < stop[some]
        if not live.any():
            break
        second = np.where(live, rank[np.minimum(after, n - 1)] + 1, 0)
        pair = (rank[some].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(pair, kind="stable")
        some, pair = some[by], pair[by]
        order[at] = some
        new = np.ones(len(some), dtype=bool)
        new[1:] = pair[1:] != pair[:-1]
        first[at] = new
        rank = rank.copy()
        rank[some] = np.maximum.accumulate(np.where(new, at, 0))
        depth *= 2
        levels.append((depth, rank))
    return order, levels


def common_prefix(a: np.ndarray, b: np.ndarray, stop: np.ndarray, levels: list[tuple[int, np.ndarray]], text: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes."""
    out = np.zeros(len(a), dtype=np.int64)
    most = np.minimum(stop[a] - a, stop[b] - b)
    last = len(text) - 1
    for depth, rank in reversed(levels):
        for _ in range(2 if depth == levels[-1][0] else 1):
            x, y = a + out, b + out
            same = (out + depth <= most) & (rank[np.minimum(x, last)] == rank[np.minimum(y, last)])
            out += depth * same
    for _ in range(8):
        x, y = np.minimum(a + out, last), np.minimum(b + out, last)
        out += (out < most) & (text[x] == text[y])
    return out


def matching_statistics(text: np.ndarray, stop: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each place of some strings laid end to end, the longest match with another place.

    ``stop`` and ``start`` give each place its own string's end and beginning.
    """
    n = len(text)
    order, levels = suffix_order(text, stop)
    before = np.where(order > start[order], text[order - 1], 0)  # the transform; 0 where a string begins
    edge = np.ones(n + 1, dtype=bool)
    edge[1:-1] = (before[1:] != before[:-1]) | (before[1:] == 0)
    best = np.zeros(n, dtype=np.int64)
    for ends, shift in ((edge[:-1], -1), (edge[1:], 1)):  # heads of runs against what precedes, tails against what follows
        at = np.flatnonzero(ends)
        other = at + shift
        has = (other >= 0) & (other < n)
        value = np.zeros(len(at), dtype=np.int64)
        value[has] = common_prefix(order[at[has]], order[other[has]], stop, levels, text)
        sampled = np.zeros(n, dtype=bool)
        reach = np.zeros(n, dtype=np.int64)
        sampled[order[at]] = True
        reach[order[at]] = order[at] + value
        since = np.maximum.accumulate(np.where(sampled, np.arange(n), 0))
        best = np.maximum(best, reach[since] - np.arange(n))
    return np.minimum(np.maximum(best, 0), stop - np.arange(n))


def marked(members: list, length: int) -> list[tuple[int, int, int, int]]:
    """(anchor, context, from, to): bytes, counted from each context's beginning, of strings that occur elsewhere in the batch.

    Members are (anchor, context, n, text, at, bytes). Contexts that overlap in their text are laid together first,
    so that no place is there twice.
    """
    members = sorted(members, key=lambda m: (m[3], m[4]))
    parts, origin, offset, filled, last = [], [], [], 0, None
    for _, _, _, text, at, data in members:
        if last is not None and last[0] == text and at <= last[1]:
            fresh = data[last[1] - at :]
            offset.append(filled - (last[1] - at))
            if fresh:
                parts.append(fresh)
                origin[-1] += len(fresh)
                filled += len(fresh)
            last = (text, max(last[1], at + len(data)))
        else:
            offset.append(filled)
            parts.append(data)
            origin.append(len(data))
            filled += len(data)
            last = (text, at + len(data))
    symbols = np.frombuffer(b"".join(parts), dtype=np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
    ends = np.cumsum(origin)
    stop, start = np.repeat(ends, origin), np.repeat(ends - origin, origin)
    found = np.flatnonzero(matching_statistics(symbols, stop, start) >= length)
    out = []
    for (anchor, context, n, _, _, data), at in zip(members, offset, strict=True):
        if n > 1:
            out.append((anchor, context, 0, len(data)))
            continue
        i, j = np.searchsorted(found, [at, at + len(data) - length + 1])
        begins = found[i:j] - at
        if len(begins):
            cut = np.flatnonzero(np.diff(begins) > length) + 1
            for run in np.split(begins, cut):
                out.append((anchor, context, int(run[0]), int(run[-1]) + length))
    return out


MARK = "anchor bigint, context bigint, lo int, hi int"


def _keyed(docs: DataFrame, column: str) -> DataFrame:
    text = text_of(F.col(column))
    return docs.withColumn("_text", text).withColumn("k1", F.xxhash64("doc_id", "_text")).withColumn("k2", F.xxhash64("_text", F.length("_text"), "doc_id"))


def _only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows with their keys' columns; a short list of keys spares the shuffle of other rows' texts."""
    if keys.count() <= BROADCAST:
        rows = rows.join(F.broadcast(keys.select("k1", "k2")), ["k1", "k2"], "left_semi")
    return rows.join(keys.hint("shuffle_hash"), ["k1", "k2"])


def _contexts(rows: DataFrame, length: int) -> DataFrame:
    """(anchor, context, n, text, at, bytes) of the listed places (pos, anchor, context, n) of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k1, data, places in zip(b["k1"], b["data"], b["places"], strict=True):
                for p in places:
                    left = max(p["pos"] + GRAM - length, 0)
                    out.append((p["anchor"], p["context"], p["n"], k1, left, data[left : p["pos"] + length]))
            yield pd.DataFrame(out, columns=["anchor", "context", "n", "text", "at", "bytes"])

    return rows.select("k1", F.col("_text").cast("binary").alias("data"), "places").mapInPandas(run, "anchor bigint, context bigint, n bigint, text bigint, at int, bytes binary")


def _indexed(groups: DataFrame, length: int) -> DataFrame:
    """Marks of the contexts (members) of each anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            out = []
            for anchor, members in zip(b["anchor"], b["members"], strict=True):
                for m in members:
                    held.append((anchor, m["context"], m["n"], m["text"], m["at"], m["bytes"]))
                    size += len(m["bytes"])
                if size >= INDEXED:
                    out += marked(held, length)
                    held, size = [], 0
            yield pd.DataFrame(out, columns=["anchor", "context", "lo", "hi"])
        if held:
            yield pd.DataFrame(marked(held, length), columns=["anchor", "context", "lo", "hi"])

    return groups.mapInPandas(run, MARK)


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """The same marks for anchors with very many contexts: hashes of all strings of a context, counted."""
    each = contexts.select("anchor", "context", "n", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - length)).alias("lo"), "bytes", "at", "pos")
    windows = each.select("anchor", "context", "n", "lo", F.xxhash64(F.substring("bytes", F.col("lo") + 1, F.lit(length)), F.col("pos") - F.col("at") - F.col("lo")).alias("w"))
    twice = windows.groupBy("anchor", "w").agg(F.sum("n").alias("all")).where("all > 1").select("anchor", "w")
    return windows.join(twice, ["anchor", "w"]).select("anchor", "context", "lo", (F.col("lo") + length).alias("hi"))


def spans(docs: DataFrame, length: int = LENGTH, column: str = "text") -> DataFrame:
    """k1, k2, ``cut``: bytes to remove, as merged (lo, hi), of each document that has any."""
    keyed = _keyed(docs.select("doc_id", F.col(column).alias("text")), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo, hi, texts in _slices(b["data"]):
                data = np.frombuffer(b"".join(texts), dtype=np.uint8)
                end = np.cumsum([len(t) for t in texts])
                begin = np.concatenate(([0], end[:-1]))
                text, pos, anchor, context = anchors(data, begin, end, length)
                yield pd.DataFrame({"k1": b["k1"].to_numpy()[lo:hi][text], "k2": b["k2"].to_numpy()[lo:hi][text], "pos": pos.astype(np.int32), "anchor": anchor, "context": context})

    source = keyed.where(F.octet_length("_text") >= length).select("k1", "k2", F.col("_text").cast("binary").alias("data"))
    places = stored(source.mapInPandas(run, "k1 bigint, k2 bigint, pos int, anchor bigint, context bigint"))
    # written apart, so that a very common anchor's rows can be split among tasks where they are joined
    often = stored(places.groupBy("anchor").agg(F.count("*").alias("total")).where("total > 1").select("anchor"))
    places = stored(places.join(often, "anchor"))
    kinds = places.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("one"))
    kinds = stored(kinds)
    several = stored(kinds.groupBy("anchor").agg(F.count("*").alias("contexts")))
    kinds = stored(kinds.join(several, "anchor"))
    whole = kinds.where("contexts = 1").select("anchor", "context", F.lit(0).alias("lo"), F.lit(None).cast("int").alias("hi"))  # null: its whole length
    listed = kinds.where("contexts > 1").groupBy(F.col("one.k1").alias("k1"), F.col("one.k2").alias("k2")).agg(F.collect_set(F.struct(F.col("one.pos").alias("pos"), "anchor", "context", "n")).alias("places"))
    found = stored(_contexts(_only(keyed.select("k1", "k2", "_text"), stored(listed)), length).dropDuplicates(["anchor", "context"]))
    wide = several.where(F.col("contexts") > WIDE).select("anchor")
    narrow = found.join(wide, "anchor", "left_anti")
    marks = _indexed(narrow.groupBy("anchor").agg(F.collect_list(F.struct("context", "n", "text", "at", "bytes")).alias("members")), length).unionByName(whole)
    if wide.limit(1).count():
        rest = found.join(wide, "anchor").join(kinds.select("anchor", "context", F.col("one.pos").alias("pos")), ["anchor", "context"])
        marks = marks.unionByName(_counted(rest, length))
    begin = F.greatest(F.col("pos") + GRAM - length, F.lit(0))
    cut = places.join(marks, ["anchor", "context"]).select("k1", "k2", F.struct((begin + F.col("lo")).alias("lo"), F.coalesce(begin + F.col("hi"), F.col("pos") + length).alias("hi")).alias("span"))
    return cut.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("span")).alias("cut"))


def _merged(cut: list, size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in cut:
        lo, hi = s["lo"], min(s["hi"], size)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for lo, hi in runs:
        parts.append(data[at:lo])
        at = hi
    return b"".join([*parts, data[at:]])


def removed(docs: DataFrame, length: int = LENGTH, column: str = "text") -> DataFrame:
    """k1, k2, n_removed, n_spans, kept (bytes) of each document that loses any."""
    keyed = _keyed(docs.select("doc_id", F.col(column).alias("text")), "text").select("k1", "k2", "_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            runs = [_merged(c, len(d)) for c, d in zip(b["cut"], b["data"], strict=True)]
            yield pd.DataFrame({
                "k1": b["k1"], "k2": b["k2"], "n_removed": [sum(hi - lo for lo, hi in r) for r in runs], "n_spans": [len(r) for r in runs],
                "kept": [_kept(d, r) for d, r in zip(b["data"], runs, strict=True)],
            })

    rows = _only(keyed, stored(spans(docs, length, column))).select("k1", "k2", F.col("_text").cast("binary").alias("data"), "cut")
    return rows.mapInPandas(run, "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH, column: str = "text") -> DataFrame:
    """The same rows with the repeated bytes cut out of the text, and ``n_chars`` brought up to date.

    A character that loses some of its bytes goes too.
    """
    own = docs.columns
    rows = _keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_doc"), F.col("doc_id"), F.col(column).alias("text")), "text").drop("_text", "text")
    cut = removed(docs, length, column)
    clean = cut.select("k1", "k2", _valid("kept").alias("_new")).dropDuplicates(["k1", "k2"])
    out = rows.join(clean, ["k1", "k2"], "left")
    text = F.coalesce("_new", F.col("_doc").getField(column))
    new = {column: text, **({"n_chars": F.when(F.col("_new").isNotNull(), F.length("_new").cast("bigint")).otherwise(F.col("_doc.n_chars"))} if "n_chars" in own else {})}
    return out.select(*[new.get(c, F.col("_doc").getField(c)).alias(c) for c in own])


def _valid(column: str):
    """UTF-8 text of bytes; what is not valid goes."""
    return F.regexp_replace(F.try_validate_utf8(F.make_valid_utf8(F.col(column).cast("string"))), "�", "")


def op2(docs: DataFrame) -> DataFrame:
    rows = stored(_keyed(docs.select("doc_id", "text"), "text").select("doc_id", "k1", "k2", F.octet_length("_text").cast("bigint").alias("n_bytes"), F.sha2(F.col("_text").cast("binary"), 256).alias("whole")))
    cut = removed(docs.select("doc_id", "text")).select("k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("part")).dropDuplicates(["k1", "k2"])
    return rows.join(cut, ["k1", "k2"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("part", "whole").alias("kept_sha256"),
    )
