"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in the word contracts: space, tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _scan(numbers: Column) -> Column:
    start = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("a"))
    return F.aggregate(
        numbers,
        start,
        lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")),
        lambda acc: acc["a"],
    )


def before(numbers: Column, block: int = 256) -> Column:
    """Sums of all earlier items of a non-empty bigint array, in blocks so that long arrays stay cheap."""

    def blocks(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda b: F.slice(a, b * block + 1, block))
        return let(
            parts,
            lambda p: let(
                _scan(F.transform(p, total)),
                lambda offsets: F.flatten(F.transform(p, lambda part, b: F.transform(_scan(part), lambda v: v + F.get(offsets, b)))),
            ),
        )

    return let(numbers, blocks)


SPAN = "array<struct<kind:string,start:bigint,end:bigint,hit:string,left:string,right:string>>"


def spans(text: Column, kind: str, pattern: str, keep: Callable[[Column], Column] | None = None, context: int = 0) -> Column:
    """All leftmost non-overlapping matches of a pattern, with code-point places.

    The text between matches and the matches themselves give the places, so
    nothing but built-in functions runs. ``keep`` drops failing matches.
    ``context`` carries so many code points left and right of a match, up to the next match.
    """
    nothing = F.array().cast(SPAN)

    def placed(hits: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            steps = F.transform(hits, lambda h, i: (F.length(h) + F.length(F.get(gaps, i))).cast("bigint"))
            return let(
                before(steps),
                lambda at: F.transform(
                    hits,
                    lambda h, i: F.struct(
                        F.lit(kind).alias("kind"),
                        (F.get(at, i) + F.length(F.get(gaps, i))).alias("start"),
                        (F.get(at, i) + F.length(F.get(gaps, i)) + F.length(h)).alias("end"),
                        h.alias("hit"),
                        (F.right(F.get(gaps, i), F.lit(context)) if context else F.lit("")).alias("left"),
                        (F.left(F.get(gaps, i + 1), F.lit(context)) if context else F.lit("")).alias("right"),
                    ),
                ),
            )

        found = let(F.split(text, pattern, -1), with_gaps)
        if keep is not None:
            found = F.filter(found, lambda s: keep(s["hit"]))
        return F.when(F.size(hits) == 0, nothing).otherwise(found.cast(SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def joined(items: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the given order."""
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where all run on one machine, as in tests, one of its own is made if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-shared-"))
    return named


_own: dict[str, str] = {}
#: The tables of the running call of ``stored_alone``, in this thread or task; others that run meanwhile have lists of their own.
_running: ContextVar[list[str] | None] = ContextVar("tables of the running call", default=None)
#: Tables of all running calls that are still to be deleted.
_tables: set[str] = set()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    tables = _running.get()
    if tables is not None:
        tables.append(path)
        _tables.add(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, stored; the tables that it stored on the way are deleted, since nothing else reads them, also when it fails."""
    tables: list[str] = []
    token = _running.set(tables)
    try:
        out = stored(make())
        _tables.discard(tables.pop())
        return out
    finally:
        _running.reset(token)
        for path in tables:
            _tables.discard(path)
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
