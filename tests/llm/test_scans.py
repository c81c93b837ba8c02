"""Rows of the scanning operators (3, 7, 8, 9) against plain Python, with odd rows added."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from voxdose.llm import licenses, private, quality, secrets

SPACE = r"[^\x20\x09-\x0D]+"
ODD = [
    (-1, "a@b.c_d@e.f x@y.z \U0001f600 1.2.3.4.5.6.7.8 256.1.1.1 +1 (222) 333-4444 4111 1111 1111 1111 41111111111111111111 All rights\nreserved CC-BY"),
    (-2, None),
    (-3, ""),
    (-4, "password password=abc token:abcdef1 secret=x AKIAABC AKIA" + "A" * 20 + ' \U0001f600token = "q1w2e3r4" ' + "ab" * 20),
    (-5, "token:token:abcdefg secret:a x9Kq2LmZ7pTw4RvB8nYc1 ok version-2-final-report-2024"),
    (-6, "general public license all rights reserved all rights reserved"),
    (-6, "general public license all rights reserved all rights reserved"),
    (-7, "password=abcdefg " * 3000),
    (-8, "one two three four five six seven eight nine " * 2 + "x\n\n \nx"),
    (-9, "This This This This This that that that that that " * 5),
    (None, "a@b.c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    return real.unionByName(odd, allowMissingColumns=True).cache()


def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(h):
    d = [int(c) for c in re.sub("[^0-9]", "", h)][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def digits(h):
    return len(re.sub("[^0-9]", "", h))


PRIVATE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(x) <= 255 for x in h.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda h: 16 <= digits(h) <= 19 and luhn(h)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 8 <= digits(h) <= 15),
]


def test_private(docs):
    want = Counter()
    for i, t in texts(docs):
        spans = [(k, m.start(), m.end()) for k, p, ok in PRIVATE for m in re.finditer(p, t) if ok(m[0])]
        n = Counter(k for k, _, _ in spans)
        want[(i, n["email"], n["ip"], n["card"], n["phone"], sha(joined(spans)))] += 1
    rows = private.op3(docs).collect()
    assert Counter(tuple(r)[:6] for r in rows) == want
    assert all(sha(",".join(s for s in r["spans"].split(",") if s and not s.startswith("context"))) == r["base_sha256"] for r in rows)


def test_private_context(spark):
    """Identifiers of no fixed kind, in the place where seeds of their shape stand, are found."""
    seeds = [(i, f"note reach them at 10.0.{i}.{i + 1} today") for i in range(40)]
    new = [(100 + i, f"note reach them at 10.0.{300 + i}.7 today") for i in range(3)]
    plain = [(200 + i, f"there were {i} birds in the tree") for i in range(40)]
    rows = private.op3(spark.createDataFrame(seeds + new + plain, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows if "context" in r["spans"]} == {100, 101, 102}


def test_private_context_of_other_shapes(spark):
    """Instances of other shapes, in punctuation and of several words; found ones support a new pattern."""
    seeds = [(i, f"please phone us on +1 (222) 333-44{i + 10} before noon") for i in range(40)]
    runs = [(100 + i, f"please phone us on 555 {100 + i} before noon") for i in range(4)]
    marks = [(110, 'please phone us on "x9-77", before noon'), (111, "please phone us on:8812. before noon")]
    chained = [(120 + i, f"extension desk 555 {100 + i} rings") for i in range(4)] + [(130, "extension desk 777 901 rings")]
    plain = [(200 + i, f"there were {i} birds in the tree") for i in range(40)]
    odd = "(" * 30000 + "1 " * 30000 + "-" * 30000 + "1" + "-" * 30000 + "a:=" * 20000
    rows = private.op3(spark.createDataFrame([*seeds, *runs, *marks, *chained, *plain, (300, odd)], "doc_id long, text string")).collect()
    spans = {r["doc_id"]: r["spans"] for r in rows}
    assert {i for i, x in spans.items() if "context" in x} == {x[0] for x in runs + marks + chained}
    assert "context:19:26" in spans[100] and "context:20:25" in spans[110] and "context:19:23" in spans[111] and "context:15:22" in spans[130]


def test_private_very_long(spark):
    text = "1" * 60000 + " " + "a" * 60000 + " " + "1." * 30000 + " +1" + " " * 50000 + "a.b@" + "c." * 30000 + "x@" * 20000 + " " + "1-" * 30000
    assert private.op3(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1


def test_secrets(docs):
    kinds = [
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    want = Counter()
    for i, t in texts(docs):
        found = sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m))
        n = Counter(x[3] for x in found)
        want[(i, n["assign"], n["access"], n["hex"], sha(joined((x[3], x[0], x[2]) for x in found)))] += 1
    rows = secrets.op7(docs).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want


@pytest.fixture(scope="module")
def more_docs(spark):
    """Enough samples of both kinds for the character models."""
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(odd, allowMissingColumns=True)


def test_random_strings(more_docs):
    rows = secrets.op7(more_docs).collect()
    more = {r["doc_id"]: x for r in rows if (x := [s for s in r["spans"].split(",") if s.startswith("markov")])}
    at = ODD[4][1].index("x9Kq")
    assert more == {-5: [f"markov:{at}:{at + 21}"]}


def test_random_strings_of_letters(spark):
    """Keys without a digit, and words of the same length; columns with clashing names pass."""
    many = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rng, letters = random.Random(4), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = ["".join(rng.choice(letters) for _ in range(n)) for n in (20, 24, 28, 32, 40) * 12]
    rows = [(-100 - i, f"use {k} there", "x", 1) for i, k in enumerate(keys)] + [(-200, "there 12345678901234567890 thereandthere thereandforthere", "x", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, _base string, _spans int")
    out = {r["doc_id"]: r for r in secrets.redact(many.unionByName(odd, allowMissingColumns=True)).where("doc_id <= -100").collect()}
    caught = [out[-100 - i]["text"] == "use [SECRET] there" for i in range(len(keys))]
    assert sum(caught) >= 0.85 * len(caught)
    assert out[-200]["text"] == rows[-1][1] and out[-200]["_base"] == "x" and out[-200]["_spans"] == 1


def test_redact(more_docs):
    out = {r["doc_id"]: r for r in secrets.redact(more_docs).where("doc_id < 0").collect()}
    assert out[-2]["text"] is None and out[-3]["text"] == ""
    assert out[-7]["text"] == "[SECRET] " * 3000 and out[-7]["n_chars"] == len(out[-7]["text"])
    assert "x9Kq" not in out[-5]["text"] and "version-2-final-report-2024" in out[-5]["text"]


def test_licenses(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = Counter()
    for i, t in texts(docs):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(low))
        at = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in at]
        want[(i, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))] += 1
    rows = licenses.op8(docs).collect()
    assert Counter(tuple(r)[:6] for r in rows) == want
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in rows)


def test_license_with_changed_words(spark):
    """A few lost and added words do not hide a template."""
    mit = "we say permission is hereby granted free of any charge to any person obtaining copy of this software and associated documentation files so it is"
    r = licenses.op8(spark.createDataFrame([(1, mit), (2, "permission to copy of this is granted")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0]["labels"] == "mit" and 0.6 <= r[0]["score"] < 1
    assert r[1]["labels"] == "" and r[1]["score"] == 0


LICENSE_LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3-notice",
    "All rights reserved.": "all-rights-reserved,reserved",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
}
OTHER_LICENSES = {
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "gpl,lgpl",
    "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation": "agpl-3.0,gpl",
    "This work is licensed under the GNU General Public License, version 2.": "gpl,gpl-2-notice",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
    "SPDX-License-Identifier: MIT": "mit",
    "Licensed under the Mozilla Public License, Version 2.0.": "mpl-2.0",
    "Licensed under the Educational Community License, Version 2.0.": "",
    "Released under the Foo License.": "",
}


def test_every_license_line(docs, spark):
    """Each license line of the tables, and short forms and texts of other licenses, has its label and no other."""
    seen = {x for i, t in texts(docs) if (i or -1) >= 0 for x in t.split("\n") if re.fullmatch(r"(?=.*(?i:licen[sc]e|rights reserved)).{0,100}", x)}
    assert seen and seen <= LICENSE_LINES.keys()
    want = dict(enumerate({**LICENSE_LINES, **OTHER_LICENSES}.items()))
    rows = licenses.op8(spark.createDataFrame([(i, f"Some words stand before it. {x}\nSome words follow.") for i, (x, _) in want.items()], "doc_id long, text string")).collect()
    assert {want[r["doc_id"]][0]: r["labels"] for r in rows} == dict(want.values())


def test_license_passages_with_a_tenth_changed(spark):
    """Every passage is found, by its own label alone, when each tenth word is another and one more is put in; half of it is not."""
    rows, want = [], {}
    for label, passages in licenses.PASSAGES.items():
        for text in passages:
            w, keys = licenses._parsed(text)
            assert len(w) >= 20
            kept = {t + j for t in keys for j in range(licenses.GRAM)}
            new = ["other" if n % 10 == 5 and n not in kept else x for n, x in enumerate(w)]
            new.insert(next(n for n in range(len(w) // 2, len(w)) if n not in kept), "indeed")
            want[len(rows)] = label
            rows.append((len(rows), f"We begin with words of our own. {' '.join(new)}. Then we go on.\n" * 2))
            rows.append((len(rows), " ".join(w[: len(w) // 2])))
    got = {r["doc_id"]: set(filter(None, r["labels"].split(","))) - set(licenses.PHRASES.values()) for r in licenses.op8(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    names = {"cc-by-4.0", "agpl-3.0", "lgpl"}  # whose names are templates of their own
    assert {k: v for k, v in got.items() if v != ({want[k]} if k in want else set()) and not (k not in want and v <= names)} == {}


def words_and_repeats(t):
    w = re.findall(SPACE, t)
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in t.split("\n") if re.search(SPACE, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, spark):
    """The contract's columns by brute force; the verdict against labels, with all of them, half of them, and none."""
    want = Counter()
    for i, t in texts(docs):
        n = words_and_repeats(t)
        want[(i, *n, n[0] < 20 or 100 * n[4] > 30 * n[0])] += 1
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for some in (labels, labels.where("doc_id % 2 = 0"), None):
        rows = quality.op9(docs, some).collect()
        assert Counter(tuple(r)[:7] for r in rows) == want
        assert not any(r["kept"] and r["base_failed"] for r in rows)
        got = [(label[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in label and not r["base_failed"] and (some is not None or r["doc_id"] % 2)]
        assert sum(bool(a) == b for a, b in got) >= 0.98 * len(got)
        assert Counter(r["doc_id"] for r in quality.keep_good(docs, labels=some).collect()) == Counter(r["doc_id"] for r in rows if r["kept"])


def patterns(noise):
    """Vote vectors of good documents, on which the fourth rule fires wrongly, and of bad ones of three kinds; with labels for a twentieth."""
    k, out = len(quality.RULES), Counter()
    fires = lambda *at: tuple(0 if j in at else 1 for j in range(k))
    out[fires(), 1] = round(8000 * (1 - noise))
    out[fires(3), 1] = round(8000 * noise)
    out[fires(2), 0], out[fires(5, 6), 0], out[fires(3, 7), 0] = 600, 500, 400
    seen = {}
    for (v, good), n in out.items():
        x = seen.setdefault(v, [0, 0, 0])
        x[0] += n
        x[2 - good] += n // 20
    return [(list(v), *x) for v, x in seen.items() if x[0]]


def test_a_rule_that_fires_on_good_documents():
    at = lambda votes, model: quality._likelihood(np.array([votes], dtype=np.int8), *model)[0, 0]
    lone = lambda j: [0 if i == j else 1 for i in range(len(quality.RULES))]
    for noise in (0.02, 0.2):
        prior, bad = model = quality.estimate(patterns(noise))
        assert abs(bad[0, 3] - noise) < 0.02 and bad[0, 2] < 0.01 and abs(prior[0] - 8000 / 9500) < 0.02
        assert at(lone(3), model) > 0.9 and at(lone(2), model) < 0.1 and at([1] * len(quality.RULES), model) > 0.99
        both = lone(3)
        both[7] = 0
        assert at(both, model) < 0.1
    unlabelled = quality.estimate([(v, n, 0, 0) for v, n, *_ in patterns(0)])
    assert at(lone(2), unlabelled) < 0.5 and unlabelled[1][0].max() < 0.02


def test_a_bad_vote_is_outvoted(spark):
    """Of labelled documents the method keeps more good ones than a filter that all rules must pass, and no more bad ones."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.judged(docs, labels=labels).where("not base_failed").withColumn("bad", F.size(F.filter(quality.votes(F.col("_q")), lambda v: v == 0)))
    rows = rows.join(labels, "doc_id").select("quality", "kept", "bad").collect()
    good, poor = ([r for r in rows if r["quality"] == q] for q in (1, 0))
    one = [r for r in good if r["bad"] == 1]
    assert len(one) >= 10 and sum(r["kept"] for r in one) >= 0.9 * len(one)
    assert sum(r["kept"] for r in good) > sum(r["bad"] == 0 for r in good)
    assert sum(r["kept"] for r in poor) <= sum(r["bad"] == 0 for r in poor)


def test_weak_rules(spark):
    """A lone weak vote is outvoted, with a strong one it is not; short texts get no weak vote."""
    k, weak = len(quality.RULES), len(quality.STRONG)
    fires = lambda *at: [0 if j in at else 1 for j in range(k)]
    table = [(fires(), 9000, 450, 0), (fires(weak), 90, 5, 0), (fires(weak + 1), 90, 4, 0), (fires(2), 300, 0, 15), (fires(2, weak), 300, 0, 15), (fires(weak, weak + 1, weak + 3), 200, 0, 10)]
    for some in (table, [(v, n, 0, 0) for v, n, *_ in table]):
        model = quality.estimate(some)
        at = lambda *j, model=model: quality._likelihood(np.array([fires(*j)], dtype=np.int8), *model)[0, 0]
        assert at(weak) > 0.5 and at(weak + 1) > 0.5 and at(2, weak) < 0.1 and at(weak, weak + 1, weak + 3) < 0.1
    texts = [(1, "incomprehensibilities " * 30), (2, "incomprehensibilities " * 60), (3, "it is so that we all say, and then they go. " * 20), (4, "| 1 2 3 |\n" * 30), (5, ""), (6, None)]
    votes = {r["doc_id"]: r["v"][weak:] for r in spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", quality.votes(quality.features(F.coalesce("text", F.lit("")))).alias("v")).collect()}
    assert votes[1] == votes[5] == votes[6] == [-1] * 4
    assert votes[2] == [0, 0, -1, 1] and votes[3] == [1, 1, 1, 1] and votes[4][2:] == [-1, 0]


def test_quality_of_odd_tables(spark):
    """Columns that bear names of results or helpers, labels of no use, repeated rows."""
    text = "word another thing " * 3 + " ".join(f"w{i}" for i in range(60))
    schema = "doc_id long, text string, kept string, posterior int, _q int, _code int, _doc string, _v string, quality int"
    docs = spark.createDataFrame([(1, text, "a", 7, 1, 2, "d", "v", 0), (1, text, "a", 7, 1, 2, "d", "v", 0), (None, None, None, None, None, None, None, None, None), (3, "", "b", 0, 0, 0, "", "", 1)], schema)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, None, 0), (3, 0, 0), (3, 1, 0), (None, 0, 0), (9, 0, 1), (1, 7, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judged(docs, labels=labels).collect()
    assert set(rows[0].asDict()) == {"doc_id", "_code", "_doc", "_v", "quality", "_q", "posterior", "base_failed", "kept"}
    assert sorted((r["doc_id"] or 0, r["kept"], r["_doc"]) for r in rows) == [(0, False, None), (1, True, "d"), (1, True, "d"), (3, False, "")]
    kept = quality.keep_good(docs, labels=labels)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, text, "a", 7, 1, 2, "d", "v", 0)] * 2


def test_variety_of_long_text(spark):
    """Long text from a natural vocabulary has as much variety as its first pages."""
    text = " ".join(f"w{(i * 7919 + i // 300) % 400}" for i in range(8000))
    long, dull = spark.createDataFrame([(1, text), (2, "a b c d e f g h i j " * 50)], "doc_id long, text string").select(quality.votes(quality.features(F.col("text"))).alias("v")).collect()
    at = quality.RULES.index("variety")
    assert long["v"][at] == 1 and dull["v"][at] == 0


@pytest.mark.parametrize("op", [private.op3, secrets.op7, licenses.op8, quality.op9, secrets.redact, quality.keep_good])
def test_empty_table(docs, op):
    assert op(docs.limit(0)).count() == 0
