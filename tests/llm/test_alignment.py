"""Cross-tokenizer alignment (13) against a plain count over all texts at once, with odd rows added."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
from compare import DATA
from tokenizers import Tokenizer

from voxdose.llm import alignment


def plain(docs):
    a_side = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side, b_bytes = alignment._pieces(public.path("piece_bpe_32k.model"))
    unit = {c: bytes([i]) for i, c in enumerate_bytes()}
    a_bytes = [b"".join(unit.get(c, c.encode()) for c in a_side.id_to_token(i)) for i in range(a_side.get_vocab_size())]
    out, links, holders = [], [], Counter()
    for doc_id, text in docs:
        raw = (" " + text).encode() if text else b""
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        if b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            a = b = []
        a_end, b_end = np.cumsum([len(a_bytes[i]) for i in a]).tolist(), np.cumsum([len(b_bytes[i]) for i in b]).tolist()
        own, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            own.append((a[i], b[j]))
            i, j = i + (a_end[i] <= b_end[j]), j + (b_end[j] <= a_end[i])
        groups, i, j = [], 0, 0
        for end in sorted(set(a_end) & set(b_end)):
            n, m = a_end.index(end, i) + 1, b_end.index(end, j) + 1
            groups.append(",".join(map(str, a[i:n])) + "|" + ",".join(map(str, b[j:m])))
            i, j = n, m
        links.append(own)
        holders.update(set(own))
        out.append((doc_id, len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    highest = defaultdict(int)
    for (x, _), n in holders.items():
        highest[x] = max(highest[x], n)
    return sorted(((*row, sum(holders[p] == highest[p[0]] for p in own), sum(holders[p] for p in own)) for row, own in zip(out, links, strict=True)), key=str)


def enumerate_bytes():
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [i for i in range(256) if i not in printable]
    return [(i, chr(i)) for i in printable] + [(i, chr(256 + n)) for n, i in enumerate(rest)]


ODD = ["", None, " ", "a", "a  b\t\tc\n\n d", "<|endoftext|> <s> <unk> ▁x", "▁", "naïve 漢字 かな ﬁ ½ é", "👍🏽 zwj 👩‍👩‍👧", "\x00\x7f", "x" * 5000, "12345 " * 3000, "same text", "same text", "\r\n end ", "ẞ 　", "اللغة हिन्दी ไทย"]


def answer(df, sizes=alignment.Sizes()):
    return sorted((tuple(r) for r in alignment.op13(df, sizes).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()), key=str)


def test_plain(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10**12 + n, t) for n, t in enumerate(ODD)] + [docs[0], (None, "null id"), (None, "null id")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id bigint, text string, slice string, part string").repartition(5)
    assert answer(df, alignment.Sizes(points=20_000)) == plain(docs)


def test_many_runs(spark):
    """Slices of one text, so that runs are merged in several rounds."""
    docs = [(n, random.Random(n % 7).choice(["the cat sat", "Le chat", "hot pair", "12 34"])) for n in range(60)]
    assert answer(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2), alignment.Sizes(docs=4, fan_in=3)) == plain(docs)


def test_no_rows(spark):
    assert answer(spark.createDataFrame([], "doc_id bigint, text string")) == []
    assert answer(spark.createDataFrame([(1, None)], "doc_id bigint, text string")) == [(1, 0, 0, 0, 0, "", 0, 0)]


@pytest.mark.parametrize("frame,most", [(1, 1), (3, 5), (1000, 1000)])
def test_heap(frame, most):
    rng = random.Random(frame)
    runs, want = [], Counter()
    for _ in range(12):
        pairs = sorted(rng.sample(range(200), rng.randrange(0, 60)))
        counts = [rng.randrange(1, 2**40) for _ in pairs]
        runs.append((np.array(pairs, np.int64), np.array(counts, np.int64)))
        want.update(dict(zip(pairs, counts, strict=True)))
    got = list(alignment.heap_merged(runs, frame, most))
    assert [(int(p), int(c)) for ps, cs in got for p, c in zip(ps, cs, strict=True)] == sorted(want.items())
    for p, c in runs:
        back = alignment._read_head(alignment._head(p, c))
        assert (back[0] == p).all() and (back[1] == c).all()
