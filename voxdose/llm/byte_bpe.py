"""Byte-level BPE: overlapping chunk encoding, and decoding.

A text of up to ``CHUNK`` code points is one piece. A longer one is cut into chunks that
overlap by ``OVERLAP``; chunks are pre-tokenised in parallel, wherever they are. Neighbours
are stitched at the first place in their overlap where both begin a pre-token: from there on
both cut alike. Only places between characters that all libraries class alike (``SURE``) count: ASCII, and the
long-standing letters and marks of Latin, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, Japanese, Chinese and Korean text.
Chunks whose cuts never meet there, such as one word of thousands of letters, stay one piece. Pieces are encoded in
parallel and their ids are strung together. Decoding concatenates the tokens' bytes.

Null and empty texts have no ids. Repeated rows are encoded each on its own; an empty table
gives an empty result; other columns pass through, but for a column that bears the result's name (``ids``, ``decoded``), which it replaces.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

CHUNK, OVERLAP = 1 << 15, 1 << 10


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Characters that all libraries class alike, other than white space: letters, digits, marks and signs of old standing.
SURE = re.compile(
    "[!-~\u00a1-\u00ac\u00ae-\u0220\u0391-\u03a1\u03a3-\u03ce\u0401\u0410-\u044f\u0451\u05d0-\u05ea\u060c\u061b\u061f\u0621-\u063a\u0641-\u064a\u0905-\u0939\u0964\u0e01-\u0e2e"
    "\u2013\u2014\u2018-\u201e\u2026\u3001\u3002\u300a-\u3011\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f]"
)


def pre_token_starts(text: str, pattern: str) -> list[int]:
    """Places where a pre-token begins after a sure character, with a sure one, a space or a line feed; all libraries agree there."""
    import regex

    starts = (m.start() for m in regex.finditer(pattern, text))
    return [s for s in starts if s and SURE.match(text, s - 1) and (text[s] in " \n" or SURE.match(text, s))]


def _parts(batches: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    """The same rows in short frames, so that little is held beside a batch."""
    return (b.iloc[lo : lo + rows].copy() for b in batches for lo in range(0, len(b), rows))


def _encoded(docs: DataFrame, column: str, path: str, pattern: str) -> DataFrame:
    """``ids``, little-endian unsigned 32-bit integers, in place of a text column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        coder = encoding(path, pattern)
        for b in _parts(batches):
            ids = [np.asarray(coder.encode_ordinary(t), dtype="<u4").tobytes() for t in b.pop(column)]
            yield b.assign(ids=ids)

    rest = [f for f in docs.schema if f.name != column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", ids binary"
    return docs.select(*[f.name for f in rest], column).mapInPandas(run, schema)


def _pieces(chunks: DataFrame, pattern: str) -> DataFrame:
    """From chunks (_row, no, part) to pieces (_row, piece, part) that can be encoded apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            starts = [pre_token_starts(t, pattern) for t in b["part"]]
            near_end = len  # a pre-token that touches a chunk's end may be cut short there
            yield b.assign(
                head=[[s for s in x if s < OVERLAP - 64] for x in starts],
                tail=[[s - CHUNK for s in x if CHUNK <= s < near_end(t) - 64] for x, t in zip(starts, b["part"], strict=True)],
            )

    cut = stored(chunks.mapInPandas(run, "_row bigint, no int, part string, head array<int>, tail array<int>"))
    along = Window.partitionBy("_row").orderBy("no")  # over places alone; the chunks' texts stay where they are
    met = cut.select("_row", "no", "head", "tail").withColumn("cut", F.array_min(F.array_intersect("tail", F.lead("head").over(along))))  # null: the piece goes on
    owned = met.withColumn("from", F.lag("cut").over(along)).withColumn("piece", F.count("from").over(along).cast("int")).withColumn("ends", F.lead("no").over(along).isNull())
    parts = cut.select("_row", "no", "part").join(owned.select("_row", "no", "cut", "from", "piece", "ends"), ["_row", "no"])
    first = F.coalesce("from", F.lit(0))
    last = F.when(F.col("ends"), F.length("part")).otherwise(F.coalesce(F.col("cut"), F.lit(0)) + CHUNK)
    parts = parts.withColumn("mine", F.substring("part", first + 1, last - first))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "mine"))), lambda x: x["mine"]), "")
    return parts.groupBy("_row", "piece").agg(text.alias("part"))


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """All columns but the text, and ``ids``: little-endian unsigned 32-bit integers."""
    rest = [c for c in docs.columns if c not in (column, "ids")]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_rest"), text_of(F.col(f"`{column}`")).alias("_text"))
    short = _encoded(rows.where(F.length("_text") <= CHUNK), "_text", path, pattern)
    long = rows.where(F.length("_text") > CHUNK).withColumn("_row", F.monotonically_increasing_id())
    chunk = F.transform(F.sequence(F.lit(0), ((F.length("_text") - 1) / CHUNK).cast("int")), lambda i: F.substring(F.col("_text"), i * CHUNK + 1, F.lit(CHUNK + OVERLAP)))
    chunks = stored(long.select("_row", "_rest", F.posexplode(chunk).alias("no", "part")))
    spread = chunks.select("_row", "no", "part").repartition(F.col("_row"), F.col("no"))
    coded = _encoded(_pieces(spread, pattern), "part", path, pattern)

    def string(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_row": b["_row"], "ids": [b"".join(x) for x in b["all"]]})

    by_row = coded.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"]).alias("all"))
    whole = chunks.where("no = 0").select("_row", "_rest").join(by_row.mapInPandas(string, "_row bigint, ids binary"), "_row")
    return short.select("_rest", "ids").unionByName(whole.select("_rest", "ids")).select(*[F.col("_rest").getField(c).alias(c) for c in rest], "ids")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns, and ``decoded``: the bytes of the tokens of ``ids``, one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        coder = encoding(path, pattern)
        for b in _parts(batches):
            yield b.assign(decoded=[coder.decode_bytes(np.frombuffer(x, dtype="<u4").tolist()) for x in b["ids"]])

    coded = coded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInPandas(run, f"{schema}, decoded binary")


def op5(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return decode(encode(docs.select("doc_id", "text"), path, pattern), path, pattern).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
