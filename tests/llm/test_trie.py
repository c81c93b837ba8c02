"""The prefix trie (11) against its SQL and against a trie built in plain Python, with odd rows added."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from compare import DATA, connect, same
from pyspark.sql import functions as F

from voxdose.llm import entries, trie

SCHEMA = "turn bigint, conv_id bigint, role string, text string, owner string, depth string"


def plain(rows):
    """All nodes of the rebuilt conversations, by walking down from the root."""
    own = defaultdict(list)
    for turn, c, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(first, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        kids = [n for n in members if len(n) == len(node) + 1 and n[:-1] == node]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        ends = sorted(c for c in members[node] if built[c] == node)
        out[node] = (
            min(members[node]),
            len(node),
            min(members[node[:-1]]) if node else None,
            len(members[node]),
            len(kids),
            sum(out[k][5] for k in kids) or 1,
            (len(members[node]) - 1) * words + sum(out[k][6] for k in kids),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


def got(spark, rows):
    return sorted((tuple(r) for r in trie.op11(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_sql(spark):
    same(connect(DATA), entries.queries()["op11_conversation_trie"](spark, DATA), entries.oracle_sql()["op11_conversation_trie"])


def test_plain(spark):
    rng = random.Random(11)
    rows = [(t, c, rng.choice(["user", "system"]), rng.choice(["a b", "c\td e", "f"])) for c in range(-45, 60) if c % 7 for t in range(rng.randint(1, 6))]
    rows += [(t, c, "user", f"deep {t} word") for c in (100, 101, 102, 7000) for t in range(70)]  # one long path, shared
    rows += [(t, 7001, "user", f"deep {t} word" if t < 40 else "other") for t in range(60)]
    rows += [(None, 3, "user", "first"), (2, 4, None, None), (2, 4, None, None), (2, 4, "user", ""), (1, None, "user", "lost"), (5, 9, "b", "tie"), (5, 9, "a", "tie"), (0, 5000000000, "user", "only"), (0, 5000000003, None, "x")]
    rows += [(0, 21, "user", "x " * 30000)]
    rows = [(*r, "clash", "clash") for r in rows]
    rng.shuffle(rows)
    assert got(spark, rows) == plain(rows)


def test_no_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, "user", "lost", None, None)]) == []


def test_long_lists_of_ends(spark):
    ids = [*range(0, 9000), -5, -4097]
    ends = spark.createDataFrame([(1, 2, c) for c in ids] + [(1, 3, 7)], "owner bigint, depth bigint, conv_id bigint")
    digests = {(r["owner"], r["depth"]): r["ends_sha256"] for r in trie.end_digests(ends.orderBy(F.rand(1))).collect()}
    assert digests == {(1, 2): hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), (1, 3): hashlib.sha256(b"7").hexdigest()}


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """A path of 400 nodes is rolled up in rounds of at most log2(400) + 2, each with four tables."""
    made = []
    keep = trie.stored
    monkeypatch.setattr(trie, "stored", lambda df: made.append(1) or keep(df))
    nodes = spark.range(400).select(F.lit(0).cast("bigint").alias("owner"), F.col("id").alias("depth"), (400 - F.col("id")).alias("weight"), F.lit(1).cast("bigint").alias("leaves"), F.col("id").alias("saved"))
    paths = spark.range(1, 400).select(F.lit(0).cast("bigint").alias("conv_id"), F.col("id").alias("depth"), F.lit(0).cast("bigint").alias("owner"), F.lit(0).cast("bigint").alias("up"))
    sums = {r["depth"]: (r["leaves"], r["saved"]) for r in trie.rolled_up(nodes, paths).collect()}
    assert sums == {d: (400 - d, sum(range(d, 400))) for d in range(400)}
    assert len(made) <= 4 * 11
