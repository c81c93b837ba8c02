"""Extraction, encoding, packing and the pipeline (1, 5, 10)."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from compare import DATA

import corpus_pipeline
from voxdose.llm import byte_bpe, common, html_text, packing


def main(source, template=()):
    return html_text.Page(source).main_text(frozenset(template))


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>hi <b>t<i>x</b> y</i></p> a < b <3 <a href=\"x>y\">l</a> &am <di", "hi tx y\na < b <3 l &am"),
        ('<body><div class="page has-sidebar"><header>X</header><article><header><h1>A &amp; B</h1></header><div class="share">tw</div><p>x  y<br>z<p>q<b>w</b>e &lt;3<section id=comments><p>c</section></article></div><aside>no</aside>', "A & B\nx y z\nqwe <3"),
        ("<nav>m</nav><main><p>one<p>two &#x41;&nbsp;b<script>'</p>'</script></main><footer>f</footer>", "one\ntwo A b"),
        ("<article><p>a</p><form>f</form><div class='ad'>x</div><ul><li>1<li>2</ul><!-- no --></article>", "a\n1\n2"),
        ("<article><p>long enough text here</p></article><article class='comment'><p>nice</p></article>", "long enough text here"),
        ("<body><div class='cookie-notice'>ok?</div><p>text</p><div hidden>h</div></body>", "text"),
        ("<article>a<!-- unclosed", "a"),
    ],
)
def test_main_text(source, text):
    assert main(source) == text


def test_deep_and_long_pages():
    assert main("<div>" * 20000 + "x" + "</div>" * 20000) == "x"
    assert main("<p a=\"" * 20000) == ""


def words(*seed, n=40):
    rng = random.Random(str(seed))
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def extracted(spark, pages):
    rows = html_text.op1(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(rows) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in rows)
    return {r["page_id"]: r["text"] for r in rows}


def test_templates_of_a_large_host_without_marks(spark):
    """A thousand pages without article, main, classes or roles; furniture on some of them only."""
    own = [words(i) for i in range(1000)]
    box, line, links = "<div><p>Read our other stories about cats 12</p></div>", "<p>Sign up for our letter</p>", "<span>All we have</span><a href=x>Start</a>"
    passage = f"<p>{words('shared', n=20)}</p>"

    def page(i):
        middle = passage if i % 20 == 3 else ""
        return f"<body>{links}{box.replace('12', str(i)) if i % 100 == 7 else ''}<div><h2>{words('h', i, n=4)}</h2><p>{own[i]}</p>{middle}<p>see <b>the</b> end {i}</p></div>{line}</body>"

    rows = extracted(spark, [(i, f"http://big.example/{i}", page(i)) for i in range(1000)] + [(-1, "http://small.example/", page(0))])
    for i in range(1000):
        assert rows[i].split("\n") == [words("h", i, n=4), own[i], *([words("shared", n=20)] if i % 20 == 3 else []), f"see the end {i}"]
    assert "Sign up" in rows[-1]  # a single page tells nothing


def test_copies_on_a_host_are_no_template(spark):
    article = f"<h1>{words('t', n=5)}</h1><ul><li>{words('l')}</li></ul><section><p>{words('s')}</p></section>"
    pages = [(i, f"http://a.example/{i}", f"<body><nav>x</nav><article>{article}</article></body>") for i in range(40)]  # copies
    pages += [(100 + i, f"http://b.example/{i}", f"<body><div>{article}</div></body>") for i in range(40)]
    pages += [(200 + i, f"http://c.example/{i}", f"<article>{article}<p>near copy {i}</p></article>") for i in range(12)]
    pages += [(300 + i, f"http://c.example/{i}", f"<article><p>{words(i)}</p></article>") for i in range(12)]
    pages += [(400 + i, f"http://d.example/{i}", f"<article><p>{words(i)}</p><p>Share this</p></article>") for i in range(12)]
    rows = extracted(spark, pages)
    full = "\n".join((words("t", n=5), words("l"), words("s")))
    assert {rows[i] for i in range(40)} | {rows[100 + i] for i in range(40)} == {full}
    assert all(rows[200 + i] == f"{full}\nnear copy {i}" for i in range(12))
    assert all(rows[400 + i] == words(i) for i in range(12))


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, template string, host string, k1 int"
    odd = [(1, None, None, "a", "b", "c", 1), (None, None, "<p>x", None, None, None, None), (2, "http://a.example/0", "", "", "", "", 0), (3, "u", "<p>y", "", "", "", 0), (3, "u", "<p>y", "", "", "", 0)]
    rows = html_text.op1(spark.createDataFrame(odd, schema)).collect()
    assert sorted(r["text"] for r in rows) == ["", "", "x", "y", "y"]
    assert html_text.op1(spark.createDataFrame([], schema)).collect() == []


def test_pages(spark):
    """The table's articles are documents: nearly all texts are whole documents."""
    docs = {"\n".join(x for x in (" ".join(b.split()) for b in r["text"].split("\n")) if x) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = html_text.op1(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    hit = sum(r["text"] in docs or r["text"].partition("\n")[2] in docs for r in rows)
    assert hit >= 0.9 * len(rows) and all(r["n_chars"] == len(r["text"]) for r in rows)


@pytest.fixture(scope="module")
def docs(spark):
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    big = "\n".join(t for _, t in real[:60])
    odd = [(-1, big), (-2, None), (-3, ""), (-4, "a" * 100000 + " b"), (-5, big[:40000].replace(" ", "  ").replace(".", ".\n\n  ")), (-6, "éü日本語\U0001f600 " * 9000)]
    odd += [(-6, "İSTANBUL <|endoftext|> Don't Σας ΣΑΣ \x1c x\xa0y it's 12345"), (None, "x"), (-7, "same"), (-7, "same")]
    return spark.createDataFrame(real + odd, "doc_id long, text string").cache()


def test_encoding(docs):
    coder = byte_bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = Counter()
    for r in docs.collect():
        t = r["text"] or ""
        ids = coder.encode_ordinary(t)
        want[(r["doc_id"], len(ids), hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(map(tuple, byte_bpe.op5(docs).collect())) == want


def scripts(n, seed):
    """Long texts of several scripts, with the marks and spaces that each uses."""
    rng = random.Random(seed)
    word = lambda lo, hi: "".join(chr(rng.randint(lo, hi)) for _ in range(rng.randint(1, 9)))
    join = lambda lo, hi, seps: "".join(word(lo, hi) + rng.choice(seps) for _ in range(n))
    yield join(0x4E00, 0x9FA5, "，。、！？《》") + "中" * 50
    yield join(0x0410, 0x044F, [" ", " ", " ", ", ", ". ", "\n", "\n\n  "])
    yield join(0x3041, 0x3094, ["。", "、", "\n", "「", "123"])
    yield join(0xAC00, 0xD7A3, [" ", " ", ". ", "\n"])
    yield join(0x0621, 0x063A, [" ", "، ", "؟ "])


def test_pieces_of_other_scripts(spark):
    """Long texts without ASCII letters are cut into pieces, and encoded like whole ones."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coder = byte_bpe.encoding(path, pattern)
    texts = [*scripts(12000, 3), "中" * 70000, "\u3000\xa0 \x85" * 30000]
    rows = [(i, t, "old", "kept") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in byte_bpe.decode(byte_bpe.encode(spark.createDataFrame(rows, "doc_id int, text string, ids string, decoded string"), path, pattern), path, pattern).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i]["ids"], dtype="<u4").tolist() == coder.encode_ordinary(t) and bytes(got[i]["decoded"]) == t.encode()
    chunks = [(i, k, t[k * byte_bpe.CHUNK : (k + 1) * byte_bpe.CHUNK + byte_bpe.OVERLAP]) for i, t in enumerate(texts) for k in range(-(-len(t) // byte_bpe.CHUNK))]
    pieces = Counter(r["_row"] for r in byte_bpe._pieces(spark.createDataFrame(chunks, "_row long, no int, part string"), pattern).collect())
    assert all(pieces[i] == -(-len(t) // byte_bpe.CHUNK) for i, t in enumerate(texts[:5])) and pieces[5] == 1


def test_packing(docs):
    tokenizer = packing._tokenizer(public_tokenizers.path("word_bpe_49k.json"))[0]
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            x = np.asarray(ids[k : k + 2048], dtype="<u4")
            want[(r["doc_id"], k // 2048, k, len(x), zlib.crc32(x.tobytes()))] += 1
    rows = packing.op10(docs).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in filled.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(filled) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_words_of_packing(monkeypatch):
    """Letters are encoded once whatever marks and blanks follow, apart from other words; ids are the tokenizer's, of odd words too."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, seen = packing._tokenizer(path)[0], defaultdict(list)
    for name in ("_of_letters", "_of_any"):

        def spy(words, path, name=name, inner=getattr(packing, name)):
            seen[name] += [str(w) for w in words]
            return inner(words, path)

        monkeypatch.setattr(packing, name, spy)

    def same(texts):
        for t, got in zip(texts, packing.encode(texts, path), strict=True):
            assert got == np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t

    same([f"Zqvwxan{a}{b}zqvwxan" for a in ("", ".", ",***", "'", "%%%", "!)") for b in " \n\x85\xa0"] * 2)
    assert seen["_of_letters"] == ["zqvwxan"] and not any(c.isalpha() for w in seen["_of_any"] for c in w)
    same([f"{a}{chr(c)}{b}" for c in range(0x260) for a in ("", "a", "'") for b in ("", "b", "'s", "'", ".,")])
    same(["", " ", "\xa0", "it's 'S, dogs' ''s I'VE!", "4.0. (4)", "<|endoftext|> a", "x\x1cy", "\u65e5\u672c e\u0301", "\u0130\u0130. L'\u00c9T\u00c9,"])
    same(["<|"])
    same([])


def place(plan, capacity):
    used, taken = Counter(), Counter()
    for length, first, each, sequences, sequence, offset in plan.runs:
        assert first == taken[length]
        taken[length] += each * sequences
        for s in range(sequence, sequence + sequences):
            assert used[s] == offset
            used[s] += each * length
            assert used[s] <= capacity
    return taken, len(used)


def test_plans():
    rng = random.Random(8)
    for _ in range(200):
        capacity = rng.choice([10, 30, 100])
        sizes = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 200)))
        plan = packing.Plan(dict(sizes), capacity)
        taken, n = place(plan, capacity)
        assert +taken == sizes and n == plan.sequences
        # plain best fit, longest first, is no better
        rooms = []
        for x in sorted(sizes.elements(), reverse=True):
            fit = [r for r in rooms if r >= x]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else capacity) - x)
        assert n <= len(rooms)


def test_pages_pass_the_shuffle_zipped(spark):
    """Hits meet their pages by a shuffle whatever their number; below it pages are no strings any more."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plan = html_text.op1(pages)._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(n for n, line in enumerate(plan) if "SortMergeJoin" in line and "LeftOuter" in line)
    exchange = next(n for n, line in enumerate(plan) if n > at and "Exchange hashpartitioning(k1" in line)
    assert "MapInArrow" in "".join(plan[exchange:]) and not any("BroadcastHashJoin" in line for line in plan[:exchange])


@pytest.mark.parametrize("op", [byte_bpe.op5, packing.op10])
def test_empty_table(docs, op):
    assert op(docs.limit(0)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "suffix_array_dedup", "secret_scan", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, DATA))
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.select("doc_id").distinct().count() == before
    assert docs.where("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0


def test_run_keeps_only_results(spark):
    """run() gives what its stages give, and leaves one table for each stage; an empty table gives an empty result."""
    made = len(common._tables)
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.count() > 0 and len(common._tables) == made
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, DATA))
    assert docs.count() == 0 and len(common._tables) == made


def test_pipeline_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None), (1, None, None), (1, "", 0), (2, "short", 5), (None, "word " * 40, 200)], "doc_id long, text string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, DATA))
    assert docs.count() == 0
