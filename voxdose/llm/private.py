"""Personal data: fixed patterns, and bootstrapped contextual extraction.

Spans of the fixed patterns are seed entities. The words before and after an entity form
lexical patterns (left, right, both); the corpus's other words with a digit, without the
punctuation at their edges, and runs of several numbers are candidate instances. Scores go
round the pattern-instance graph: a pattern's score is the sum of its instances' scores over all places where its words
stand, beside instances or anything else (of two words the rarer one), shrunk for few places; so words that stand beside everything speak for nothing. A candidate's score is the noisy-or of its patterns, raised by the score
of its shape where its patterns speak for it. Each round asks anew which patterns have
enough instances that are seeds or have a high score, so found instances support new
patterns: instances of a second generation need ``ROUNDS`` of two or three, of a third one more. Candidates that end with a high score are reported as kind ``context``; such
spans may overlap. Identifiers without a digit are not candidates. The words beside an instance are looked for in
the ``CONTEXT`` code points on each side, as far as they belong to no other match of its kind; where
they are longer or missing, that side gives no pattern. A pattern's instances may be a third of all: its row is
broadcast, or copied to ``SALTS`` parts of them.

Null and empty texts have no spans. Repeated rows are scanned alike (each counts in the graph); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, let, spans, stored, text_of, total

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Words with a digit.
TOKEN = r"(?<![^\x20\x09-\x0D])[^0-9\x20\x09-\x0D]*+[0-9][^\x20\x09-\x0D]*+"
#: Two numbers or more beside each other.
RUN = r"(?<![0-9().,/+\p{L}-])\+?[(]*+[0-9][0-9().,/-]*+(?:\x20{1,3}+[0-9(][0-9().,/-]*+)++"
KINDS = ("email", "ip", "card", "phone", "context")
CONTEXT = 40
#: Rounds over the graph; least score of a reported candidate; least number of distinct seeds or found instances behind a pattern.
ROUNDS, LEAST, SEEDS = 4, 0.8, 3
#: A shape's weight beside the patterns, where these alone give at least ``LIKELY``.
SHAPE, LIKELY = 0.5, 0.5
SHRINK = 2.0
#: Most patterns that are broadcast, and parts of a pattern's instances beyond that.
BROADCAST, SALTS = 500_000, 32


def _digits(h: Column) -> Column:
    return F.regexp_replace(h, "[^0-9]", "")


def _luhn(h: Column) -> Column:
    """Whether the digits pass: every second from the right doubled, less 9 above 9."""

    def check(d: Column) -> Column:
        return total(F.transform(d, lambda c, i: F.when(i % 2 == 0, c).when(c > 4, 2 * c - 9).otherwise(2 * c).cast("bigint"))) % 10 == 0

    return let(F.split(F.reverse(_digits(h)), "").cast("array<int>"), check)


def base(text: Column) -> Column:
    """Spans of the fixed patterns, by kind as listed, then by start."""
    card = lambda h: F.when(F.length(_digits(h)).between(16, 19), _luhn(h)).otherwise(F.lit(False))
    return let(
        text,
        lambda t: F.concat(
            spans(t, "email", EMAIL, context=CONTEXT),
            spans(t, "ip", IP, lambda h: h.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"), context=CONTEXT),
            spans(t, "card", CARD, card, context=CONTEXT),
            spans(t, "phone", PHONE, lambda h: F.length(_digits(h)).between(8, 15), context=CONTEXT),
        ),
    )


def _shape(hit: Column) -> Column:
    """Runs of digits as 9, of letters as a."""
    return F.regexp_replace(F.regexp_replace(hit, "[0-9]+", "9"), r"\p{L}+", "a")


def _patterns(left: Column, right: Column) -> Column:
    """The word before, the word after, and both, lower-cased, with digits as 9."""
    word = lambda c, p: F.regexp_replace(F.lower(F.regexp_extract(c, p, 1)), "[0-9]+", "9")
    sides = F.struct(word(left, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$").alias("l"), word(right, r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)").alias("r"))
    three = let(
        sides,
        lambda w: F.array(
            F.when(w["l"] != "", F.concat(w["l"], F.lit(" _"))),
            F.when(w["r"] != "", F.concat(F.lit("_ "), w["r"])),
            F.when((w["l"] != "") & (w["r"] != ""), F.concat(w["l"], F.lit(" _ "), w["r"])),
        ),
    )
    return F.array_compact(three)


def _trimmed(found: Column) -> Column:
    """Candidates without a name and sign before them (``id:``) and without punctuation at the edges."""

    def cut(s: Column) -> Column:
        lead = F.regexp_extract(s["hit"], r"^(?:\p{L}++[:=#]++)*+[^\p{L}\p{N}+]*+", 0)

        def cut_right(x: Column) -> Column:
            core = F.regexp_extract(F.substring(s["hit"], F.length(x) + 1, F.length(s["hit"])), r"(?s)^(.*[\p{L}\p{N}])", 1)
            return let(
                core,
                lambda c: F.struct(
                    s["kind"].alias("kind"),
                    (s["start"] + F.length(x)).cast("bigint").alias("start"),
                    (s["start"] + F.length(x) + F.length(c)).cast("bigint").alias("end"),
                    c.alias("hit"),
                    F.concat(s["left"], x).alias("left"),
                    F.concat(F.substring(s["hit"], F.length(x) + F.length(c) + 1, F.length(s["hit"])), s["right"]).alias("right"),
                ),
            )

        return let(lead, cut_right)

    return F.filter(F.transform(found, cut), lambda s: s["hit"].rlike("[0-9]"))


def scanned(docs: DataFrame, column: str = "text") -> DataFrame:
    """``_base`` and ``_more``, the seeds and the candidates of each row."""
    t = text_of(F.col(column))
    both = lambda x: F.concat(spans(x, "context", TOKEN, context=CONTEXT), spans(x, "context", RUN, context=CONTEXT))
    rows = docs.withColumn("_base", base(t)).withColumn("_all", _trimmed(let(t, both)))
    apart = lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    return rows.withColumn("_more", F.when(F.size("_base") == 0, F.col("_all")).otherwise(F.filter("_all", apart))).drop("_all")


def graph(rows: DataFrame) -> DataFrame:
    """Distinct (pattern, instance) edges with how often they occur; ``seed`` is 1 for instances of the fixed patterns."""
    each = rows.select(F.explode(F.concat("_base", "_more")).alias("s"))
    edges = each.select(F.explode(_patterns(F.col("s.left"), F.col("s.right"))).alias("pattern"), F.col("s.hit").alias("instance"), "s.kind")
    return edges.groupBy("pattern", "instance").agg(F.max((F.col("kind") != "context").cast("double")).alias("seed"), F.count("*").alias("times"))


def fillers(docs: DataFrame, edges: DataFrame, column: str = "text") -> DataFrame:
    """(pattern, n): how often the words of a pattern stand anywhere, beside whatever; of two words the rarer one.

    A word that stands nowhere was cut from a longer one by the end of the context: its patterns have no row.
    """
    plain = F.regexp_replace(F.lower(text_of(F.col(column))), "[0-9]+", "9")
    words = docs.select(F.explode(F.split(plain, r"[^\p{L}\p{N}]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    sides = edges.select("pattern").distinct().withColumn("words", F.array_remove(F.split("pattern", " "), "_"))
    met = sides.select("pattern", F.size("words").alias("of"), F.explode("words").alias("word")).join(words, "word")
    return met.groupBy("pattern", "of").agg(F.min("n").alias("n"), F.count("*").alias("known")).where("known = of").select("pattern", "n")


def _under(edges: DataFrame, pattern: DataFrame) -> DataFrame:
    if pattern.count() <= BROADCAST:
        return edges.join(F.broadcast(pattern), "pattern")
    copies = pattern.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("instance"), F.lit(SALTS)).cast("int")).join(copies, ["pattern", "salt"])


def found(edges: DataFrame, n: DataFrame) -> DataFrame:
    """Instances beside the seeds whose score is high, by the rounds described above; ``n`` as ``fillers`` gives it."""
    n = stored(n)
    score = edges.groupBy("instance").agg(F.max("seed").alias("seed")).withColumn("score", F.col("seed"))
    for _ in range(ROUNDS):
        support = F.sum((F.col("score") >= LEAST).cast("int"))
        held = edges.select("pattern", "instance", "times").join(score, "instance").groupBy("pattern").agg(F.sum(F.col("score") * F.col("times")).alias("held"), support.alias("support")).where(F.col("support") >= SEEDS)
        pattern = stored(held.join(n, "pattern").select("pattern", "support", (F.col("held") / (F.col("n") + SHRINK)).alias("trust")))
        shape = score.groupBy(_shape(F.col("instance")).alias("shape")).agg((F.sum("score") / (F.count("*") + SHRINK)).alias("of_shape"))
        scored = _under(edges, pattern).groupBy("instance").agg(F.max("seed").alias("_seed"), F.sum(F.log1p(-F.least(F.col("trust"), F.lit(0.999)))).alias("miss"))
        by_words = 1 - F.exp(F.coalesce("miss", F.lit(0.0)))
        raised = F.when(by_words >= LIKELY, 1 - (1 - by_words) * (1 - SHAPE * F.col("of_shape"))).otherwise(by_words)
        old = score.select("instance", "seed", _shape(F.col("instance")).alias("shape"))
        score = stored(old.join(scored, "instance", "left").join(shape, "shape").select("instance", "seed", F.when(F.col("seed") == 1, 1.0).otherwise(raised).alias("score")))
    return score.where((F.col("seed") == 0) & (F.col("score") >= LEAST)).select("instance")


def op3(docs: DataFrame) -> DataFrame:
    text = text_of()
    rows = stored(scanned(docs.select("doc_id", "text")).select("doc_id", F.xxhash64(text, F.length(text)).alias("_same"), "_base", "_more"))
    unseen = rows.where(F.size("_more") > 0).select("doc_id", "_same", F.explode("_more").alias("s"))
    edges = stored(graph(rows))
    more = (
        unseen.join(found(edges, fillers(docs, edges)), unseen["s.hit"] == F.col("instance"), "left_semi")
        .groupBy("doc_id", "_same")
        .agg(F.array_sort(F.collect_set(F.struct("s.kind", "s.start", "s.end"))).alias("_new"))
        .withColumnsRenamed({"doc_id": "_id", "_same": "_text"})
    )
    count = lambda kind: F.size(F.filter("_base", lambda b: b["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return rows.join(more, rows["doc_id"].eqNullSafe(more["_id"]) & (rows["_same"] == more["_text"]), "left").select(
        "doc_id",
        *[count(k) for k in ("email", "ip", "card", "phone")],
        F.sha2(joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.size("_base") > 0, joined(F.col("_base"))), joined(F.col("_new"))).alias("spans"),
    )
