"""Secret scan: fixed patterns, and character Markov models for random strings.

Two first-order character models are trained from labelled samples of the
corpus itself: strings inside spans of the fixed patterns are random; candidate tokens
found at least ``OFTEN`` times are ordinary identifiers, since a random string hardly is. Every other
candidate token with a letter is scored (digits alone are a number); those whose log-likelihood ratio reaches
``THRESHOLD``, and ``PER_CHAR`` for each character, are reported as kind ``markov``. Such a ratio needs
some twelve characters.

Null and empty texts have no spans. Repeated rows are scanned alike; an empty
table gives an empty result; without samples of both kinds no span is added.
Columns that bear names of helpers here are carried along untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, let, spans, stored, text_of

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Candidate tokens of the Markov models.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}+"
KINDS = ("assign", "access", "hex", "markov")
#: Distinct strings of each label, at most, that the models are trained on.
SAMPLE = 4000
#: Least log-likelihood ratio, in nats, of a reported token, and least of it for each character.
THRESHOLD, PER_CHAR = 14.0, 0.8
#: Least number of places where an ordinary token is found.
OFTEN = 5
#: Weight of single characters in a pair's estimate; bounds of one pair's log-likelihood ratio.
BACKED, LEAST, MOST = 5.0, -4.0, 3.0
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(SYMBOLS) + 1  # 0: none of them, or the start


def base(text: Column) -> Column:
    """Spans of the fixed patterns, sorted by start, then by kind as listed."""

    def all_kinds(t: Column) -> Column:
        found = F.concat(
            spans(t, "assign", ASSIGN, lambda h: F.length(F.regexp_extract(h, ASSIGN, 1)) >= 6),
            spans(t, "access", ACCESS, lambda h: F.length(h) >= 20),
            spans(t, "hex", HEX),
        )
        return in_order(found)

    return let(text, all_kinds)


def in_order(found: Column) -> Column:
    rank = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s.alias("span")))
    return F.transform(F.array_sort(rank), lambda s: s["span"])


def candidates(text: Column) -> Column:
    return let(text, lambda t: spans(t, "markov", TOKEN))


def scanned(docs: DataFrame, column: str = "text") -> DataFrame:
    """``_base`` and ``_more``, the fixed spans and the other candidate tokens of each row."""
    t = text_of(F.col(column))
    rows = docs.withColumn("_base", base(t)).withColumn("_all", candidates(t))
    apart = lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    return rows.withColumn("_more", F.when(F.size("_base") == 0, F.col("_all")).otherwise(F.filter("_all", apart))).drop("_all")


def _sample(rows: DataFrame, strings: Column, label: int, times: int) -> DataFrame:
    """Distinct strings found so many times, the first by a hash."""
    each = rows.select(F.explode(strings).alias("s")).where(F.length("s") >= 8).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= times).select("s")
    return each.orderBy(F.xxhash64("s"), "s").limit(SAMPLE).withColumn("label", F.lit(label))


def _states(s: Column) -> Column:
    """0 for the start, then each character's state."""
    return F.transform(F.concat(F.array(F.lit("")), F.split(s, "")), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(SYMBOLS), c)))


def fit(rows: DataFrame) -> str | None:
    """Log-likelihood ratios of all character pairs, comma-joined by state pair; None without samples of both labels."""
    secret = _sample(rows, F.transform("_base", lambda b: F.regexp_replace(b["hit"], r"^(?i:password|passwd|secret|token|api_?key)[^A-Za-z0-9]*", "")), 1, 1)
    plain = _sample(rows, F.transform("_more", lambda m: m["hit"]), 0, OFTEN).join(secret.select("s"), "s", "left_anti")
    pairs = secret.unionByName(plain).select(
        "label",
        F.explode(let(_states("s"), lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - 2), lambda i: F.get(a, i) * STATES + F.get(a, i + 1)))).alias("pair"),
    )
    seen: list[dict[int, int]] = [{}, {}]
    for r in pairs.groupBy("label", "pair").count().collect():  # at most 2 x STATES ** 2 rows
        seen[r["label"]][r["pair"]] = r["count"]
    if not all(seen):
        return None

    def log_p(count: dict[int, int], uniform: float) -> list[float]:
        """Pairs, backed by single characters where a pair's first is rare, backed by the uniform share."""
        single = [sum(count.get(a * STATES + b, 0) for a in range(STATES)) for b in range(STATES)]
        single = [(x + 0.1) / (sum(single) + 0.1 * STATES) for x in single]
        out = []
        for a in range(STATES):
            n = [count.get(a * STATES + b, 0) for b in range(STATES)]
            out += [math.log((1 - uniform) * (x + BACKED * s) / (sum(n) + BACKED) + uniform / STATES) for x, s in zip(n, single, strict=True)]
        return out

    # any symbol may follow any other in a random string; no single pair decides
    pairs = zip(log_p(seen[1], 0.5), log_p(seen[0], 0.0), strict=True)
    return ",".join(f"{max(LEAST, min(MOST, r - o)):.3f}" for r, o in pairs)


def ratio(s: Column, model: str) -> Column:
    """Log-likelihood ratio of a string, random against ordinary."""
    table = F.split(F.lit(model), ",").cast("array<double>")

    def summed(a: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(a) - 2), F.lit(0.0), lambda acc, i: acc + F.get(table, F.get(a, i) * STATES + F.get(a, i + 1)))

    return let(_states(s), summed)


def with_spans(rows: DataFrame, model: str | None) -> DataFrame:
    """``_spans``: the fixed spans and the candidates that the models call random."""
    if model is None:
        return rows.withColumn("_spans", F.col("_base"))
    random = lambda m: m["hit"].rlike("[A-Za-z]") & let(ratio(m["hit"], model), lambda x: (x >= THRESHOLD) & (x >= PER_CHAR * F.length(m["hit"])))
    return rows.withColumn("_spans", F.when(F.size("_more") == 0, F.col("_base")).otherwise(in_order(F.concat("_base", F.filter("_more", random)))))


def redact(docs: DataFrame, column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows with each secret replaced by ``mark`` in the text, and ``n_chars`` brought up to date."""
    own = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_doc"), F.col(f"`{column}`").alias("_text"))
    rows = stored(scanned(inner, "_text"))
    found = with_spans(rows, fit(rows))

    def cut(span: Column) -> Column:  # overlapping spans count as one
        merged = F.aggregate(
            span,
            F.array().cast("array<struct<s:bigint,e:bigint>>"),
            lambda acc, x: F.when(
                (F.size(acc) > 0) & (F.element_at(acc, F.when(F.size(acc) > 0, -1).otherwise(1))["e"] > x["start"]),
                F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["s"].alias("s"), F.greatest(F.get(acc, F.size(acc) - 1)["e"], x["end"]).alias("e")))),
            ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("s"), x["end"].alias("e"))))),
        )

        def put(m: Column) -> Column:
            gaps = F.transform(m, lambda x, i: F.concat(F.substring(F.col("_text"), (F.coalesce(F.get(m, i - 1)["e"], F.lit(0)) + 1).cast("int"), (x["s"] - F.coalesce(F.get(m, i - 1)["e"], F.lit(0))).cast("int")), F.lit(mark)))
            tail = F.substring(F.col("_text"), (F.element_at(m, -1)["e"] + 1).cast("int"), F.length("_text"))
            return F.concat(F.array_join(gaps, ""), tail)

        return let(merged, put)

    text = F.when(F.size("_spans") == 0, F.col("_text")).otherwise(cut(F.col("_spans")))
    out = found.select("_doc", text.alias("_text"))
    kept = {column: F.col("_text"), **({"n_chars": F.when(F.col("_text").isNotNull(), F.length("_text").cast("bigint"))} if "n_chars" in own else {})}
    return out.select(*[kept.get(c, F.col("_doc").getField(c)).alias(c) for c in own])


def op7(docs: DataFrame) -> DataFrame:
    rows = stored(scanned(docs.select("doc_id", "text")).drop("text"))
    count = lambda kind: F.size(F.filter("_base", lambda b: b["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return with_spans(rows, fit(rows)).select(
        "doc_id",
        *[count(k) for k in ("assign", "access", "hex")],
        F.sha2(joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("_spans")).alias("spans"),
    )


