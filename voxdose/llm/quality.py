"""Quality rules combined by weak supervision.

Each rule votes good (1), bad (0) or abstains (-1). Expectation-maximisation over
the counts of the vote patterns (at most 3 ** rules of them, whatever the corpus)
estimates how often each rule calls a good document bad, and how often it finds bad ones; a document
stays when its posterior probability of being good reaches ``threshold``.

Rules are strong or weak. A strong rule's bad vote is about defects that good documents hardly have; a weak one
(``WEAK``) marks what is unusual: few short words, few or many marks between words, lines without an end (not of text that has no marks at all), words without letters.
A lone weak vote is outvoted by the others; of texts below fifty words, whose shares say little, weak rules abstain.

Bad documents are of several kinds, each caught by few rules, so bad is a mixture: one kind for each strong rule,
which starts as what that rule finds, and one that the weak rules find together; each takes its own rates from the counts. No estimate is held within bounds.
By counts alone a kind that one rule finds cannot be told from that rule's false alarms; there the
starting values decide, which trust the rule. ``labels`` settle it where there are any: at most ``LABELLED`` labelled documents,
which count as much as all others together, so that a rule that fires on clean text is learned to be inaccurate.

Null and empty texts have no words and fail the base rules. Repeated rows are
judged alike; an empty table gives an empty result; other columns pass through, but for those that bear the name
of a result, which it replaces. Labels that are null, neither 0 nor 1, contradictory or without a document are not used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, stored, text_of, total

WINDOW = 8
#: Words of a window over which distinct words are counted.
SPREAD = 256
#: Most labelled documents that the estimates use, the first by a hash.
LABELLED = 20_000
#: Starting values: share of good documents; how often a rule calls good documents bad, bad ones of its own kind, of another kind.
GOOD, FALSE_ALARM, FINDS, FINDS_OTHERS = 0.8, 0.005, 0.9, 0.05
#: The same of weak rules: how often they call good documents bad, and bad ones of the kind that they find together.
WEAK_FALSE_ALARM, WEAK_FINDS = 0.05, 0.5
STRONG = ("length", "word_length", "symbols", "repeats", "lines", "capitals", "variety", "marks", "echoes")
WEAK = ("short_words", "pauses", "line_ends", "letters")
RULES = STRONG + WEAK


def _repeated(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the text."""

    def of_hashes(h: Column) -> Column:
        def of_windows(w: Column) -> Column:
            def of_sorted(s: Column) -> Column:
                twice = F.filter(s, lambda e, i: (F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))) | (F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))))
                starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
                return let(starts, lambda a: total(F.transform(a, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(a, i + 1), x + WINDOW) - x).cast("bigint"))))

            ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(let(ordered, of_sorted))

        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))
        return let(windows, of_windows)

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("bigint")).otherwise(let(F.transform(words, lambda x: F.xxhash64(x)), of_hashes))


def _spread(words: Column) -> Column:
    """Distinct words, summed over windows of ``SPREAD`` words side by side; the last is filled up from before it."""
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(words) - 1) / SPREAD).cast("int"), F.lit(0)))
    first = lambda i: F.greatest(F.least(i * SPREAD, F.size(words) - SPREAD), F.lit(0)) + 1
    return total(F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(words, first(i), SPREAD))).cast("bigint")))


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")


def features(text: Column) -> Column:
    """A struct of all counts that the rules use."""
    words = F.array_remove(F.split(text, f"{SPACE}+", -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE[1:-1]}]"))
    by_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _repeated(w).alias("n_repeat_words"),
            _spread(w).alias("n_distinct"),
            F.when(F.size(w) <= SPREAD, F.size(w)).otherwise(F.ceil(F.size(w) / SPREAD) * SPREAD).cast("bigint").alias("n_spread"),
            F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))).cast("bigint").alias("n_echoes"),
            F.size(F.filter(w, lambda x: F.length(x) <= 3)).cast("bigint").alias("n_short"),
        ),
    )
    by_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: y.rlike(r"\p{Po}[\p{Pe}\p{Pf}\x22\x27]?[\x20\x09-\x0D]*\z"))).cast("bigint").alias("n_ended"),
        ),
    )
    return let(
        text,
        lambda t: F.struct(
            by_words.alias("w"),
            by_lines.alias("l"),
            _count(t, "[#*$%&|<>]").alias("n_symbols"),
            _count(t, "[A-Z]").alias("n_capitals"),
            _count(t, "(?<=[!?.,;])[!?.,;]").alias("n_marks"),
            _count(t, r"[\p{Po}&&[^#*%&]](?=[\x20\x09-\x0D]|\z)").alias("n_pauses"),
            _count(t, r"[^\p{L}\p{M}\x20\x09-\x0D]").alias("n_other"),
        ),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def votes(q: Column) -> Column:
    """The vote of each of ``RULES``, in order."""
    n, chars, lines = q["w"]["n_words"], q["w"]["word_chars"], q["l"]["n_lines"]
    return F.array(
        _vote(n >= 50, n < 20),
        _vote((2 * chars >= 7 * n) & (chars <= 7 * n) & (n > 0), (chars < 3 * n) | (chars > 8 * n)),
        _vote(100 * q["n_symbols"] <= n, 10 * q["n_symbols"] > n),
        _vote(20 * q["w"]["n_repeat_words"] <= n, 10 * q["w"]["n_repeat_words"] > 3 * n),
        _vote(10 * q["l"]["n_dup_lines"] <= lines, (q["l"]["n_dup_lines"] >= 3) & (10 * q["l"]["n_dup_lines"] > 3 * lines)),
        _vote(10 * q["n_capitals"] <= chars, 10 * q["n_capitals"] > 3 * chars),
        _vote(5 * q["w"]["n_distinct"] >= 2 * q["w"]["n_spread"], 5 * q["w"]["n_distinct"] < q["w"]["n_spread"]),
        _vote(20 * q["n_marks"] <= n, 5 * q["n_marks"] > n),
        _vote(50 * q["w"]["n_echoes"] <= n, 5 * q["w"]["n_echoes"] > n),
        F.when(n >= 50, _vote(4 * q["w"]["n_short"] >= n, 5 * q["w"]["n_short"] < n)).otherwise(-1),
        F.when(n >= 50, _vote((20 * q["n_pauses"] >= n) & (5 * q["n_pauses"] <= n), (50 * q["n_pauses"] < n) | (4 * q["n_pauses"] > n))).otherwise(-1),
        F.when(n >= 50, _vote(10 * q["l"]["n_ended"] >= 9 * lines, (4 * q["l"]["n_ended"] < 3 * lines) & (50 * q["n_pauses"] >= n))).otherwise(-1),
        F.when(n >= 50, _vote(10 * q["n_other"] <= chars, 6 * q["n_other"] > chars)).otherwise(-1),
    )


def base_failed(q: Column) -> Column:
    n = q["w"]["n_words"]
    return (n < 20) | (100 * q["w"]["n_repeat_words"] > 30 * n)


def _likelihood(votes: np.ndarray, prior: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Posterior of each class (good, then the kinds of bad) of each vote vector; ``bad`` holds P(votes bad | class) of each rule."""
    x = np.tile(np.log(prior), (len(votes), 1))
    for j in range(votes.shape[1]):
        x[votes[:, j] == 0] += np.log(bad[:, j])
        x[votes[:, j] == 1] += np.log1p(-bad[:, j])
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def estimate(patterns: list[tuple[list[int], int, int, int]], rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the classes and P(votes bad | class) of each rule, by expectation-maximisation.

    ``patterns`` are vote vectors with the number of documents, and of those labelled good and bad. Pseudo-counts of
    at most a hundred documents keep rare rules near their starting values.
    """
    votes = np.array([v for v, *_ in patterns], dtype=np.int8).reshape(-1, len(RULES))
    n, n_good, n_bad = np.array([x for _, *x in patterns], dtype=np.float64).reshape(-1, 3).T
    labelled = (n_good + n_bad).sum()
    weight = max(1.0, (n.sum() - labelled) / labelled) if labelled else 0.0
    strong, k = len(STRONG), len(RULES)
    kinds = strong + 1
    prior = np.array([GOOD, *[(1 - GOOD) / kinds] * kinds])  # pseudo-counts, below: a kind that no strong rule finds is taken to be rare
    start = np.array([8.0, *[1.0] * strong, 0.2])
    bad = np.full((kinds + 1, k), FINDS_OTHERS)
    bad[0, :strong], bad[0, strong:] = FALSE_ALARM, WEAK_FALSE_ALARM
    bad[np.arange(1, kinds), np.arange(strong)] = FINDS
    bad[kinds, strong:] = WEAK_FINDS
    trust = np.array([100.0, *[10.0] * kinds])[:, None]
    fired, seen = trust * bad, np.repeat(trust, k, axis=1)
    for _ in range(rounds):
        share = _likelihood(votes, prior, bad)
        of_bad = share[:, 1:] / share[:, 1:].sum(axis=1, keepdims=True).clip(1e-300)
        mass = share * (n - n_good - n_bad)[:, None]
        mass[:, 0] += weight * n_good
        mass[:, 1:] += of_bad * (weight * n_bad)[:, None]
        prior = (mass.sum(axis=0) + start) / (mass.sum() + start.sum())
        for j in range(k):
            bad[:, j] = (fired[:, j] + mass[votes[:, j] == 0].sum(axis=0)) / (seen[:, j] + mass[votes[:, j] >= 0].sum(axis=0))
    return prior, bad


def code(vote: Column) -> Column:
    """A vote vector as one number."""
    return F.aggregate(vote, F.lit(0), lambda acc, v: acc * 3 + v + 1)


def _decoded(number: int) -> list[int]:
    out = []
    for _ in RULES:
        number, v = divmod(number, 3)
        out.append(v - 1)
    return out[::-1]


def fit(votes_of: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """From (_code) of each document, and its doc_id where there are labels, to (_code, posterior): a row for each vote pattern."""
    if labels is None:
        counts = votes_of.groupBy("_code").agg(F.count("*").alias("n"), F.lit(0).alias("good"), F.lit(0).alias("bad"))
    else:
        sure = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        some = sure.where("low = high").select("doc_id", F.col("low").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
        of = lambda q: F.count(F.when(F.col("quality") == q, 1))
        counts = votes_of.join(F.broadcast(some), "doc_id", "left").groupBy("_code").agg(F.count("*").alias("n"), of(1).alias("good"), of(0).alias("bad"))
    rows = sorted(tuple(r) for r in counts.collect())  # at most 3 ** rules
    patterns = [(_decoded(c), *n) for c, *n in rows]
    out = []
    if patterns:
        prior, bad = estimate(patterns)
        good = _likelihood(np.array([v for v, *_ in patterns], dtype=np.int8), prior, bad)[:, 0]
        out = [(c, float(p)) for (c, *_), p in zip(rows, good, strict=True)]
    return F.broadcast(votes_of.sparkSession.createDataFrame(out, "_code int, posterior double"))


def judged(docs: DataFrame, column: str = "text", threshold: float = 0.5, labels: DataFrame | None = None) -> DataFrame:
    """One row per document, without its text: the other columns, ``_q``, ``posterior``, ``base_failed``, ``kept``."""
    results = ("_q", "posterior", "base_failed", "kept")
    own = [c for c in docs.columns if c not in (column, *results)]
    inner = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in own]).alias("_doc"), *(["doc_id"] if labels is not None else []), features(text_of(F.col(f"`{column}`"))).alias("_q"))
    rows = stored(inner.withColumn("_code", code(votes(F.col("_q")))))
    out = rows.join(fit(rows, labels), "_code").withColumn("base_failed", base_failed(F.col("_q"))).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    return out.select(*[F.col("_doc").getField(c).alias(c) for c in own], *results)


def keep_good(docs: DataFrame, column: str = "text", threshold: float = 0.5, labels: DataFrame | None = None) -> DataFrame:
    """The documents that pass, with the columns they came with. Rows are stored with their votes, so that texts are scanned once."""
    own = docs.columns
    votes_and_base = let(features(text_of(F.col(f"`{column}`"))), lambda q: F.struct(code(votes(q)).alias("code"), base_failed(q).alias("failed")))
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_doc"), *(["doc_id"] if labels is not None else []), votes_and_base.alias("_v"))
    rows = stored(inner.withColumn("_code", F.col("_v.code")))
    passed = rows.where("not _v.failed").join(fit(rows.drop("_doc", "_v"), labels), "_code").where(F.col("posterior") >= threshold)
    return passed.select(*[F.col("_doc").getField(c).alias(c) for c in own])


def op9(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    q = F.col("_q")
    return judged(docs.select("doc_id", "text"), labels=labels).select(
        "doc_id",
        q["w"]["n_words"].alias("n_words"),
        q["w"]["word_chars"].alias("word_chars"),
        q["n_symbols"].alias("n_symbols"),
        q["l"]["n_dup_lines"].alias("n_dup_lines"),
        q["w"]["n_repeat_words"].alias("n_repeat_words"),
        "base_failed",
        "kept",
        F.round("posterior", 6).alias("posterior"),
    )
