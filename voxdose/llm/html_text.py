"""Main text of web pages, by removal of site templates.

First step, counted: every page is parsed once, and each element subtree with text gets a hash of its tag,
class, text and children. Spark counts on how many pages of a host a subtree occurs; pages with the same
content (the article, else the element with most of the text) count as one of them, so copies of an article are not their
site's template. What occurs with ``PAGES`` contents or more is the template, whatever the host's size, and is
deleted when the page is parsed again. Two exceptions protect text that recurs without being furniture:

* inside ``article`` and ``main`` near copies and shared passages recur too; there only what stands on ``SHARE`` of
  all contents of the host goes;
* elsewhere a recurring paragraph between two siblings that do not recur stays.

Numbers count as equal outside the content, not within it. A subtree with most of the page's text stays.

Second step, by marks: elements whose tag, class or role says that they are no article text go, for hosts with too few
pages to count on. The text blocks of the page's article (``article``, ``main``, an element whose class says so, else the body) are what is left.

Null and empty pages give an empty text. Repeated rows are extracted alike and count once in the templates.
Pages without a URL share one host. Very long pages are parsed whole. Other columns of the table are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

#: Least contents of a host that a template occurs with; share of all contents that it must occur with inside an article.
PAGES, SHARE = 5, 0.8
#: Parts that a host's rows are dealt into where they meet its templates.
SALTS = 16
#: Most templates that are broadcast.
BROADCAST = 300_000

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
CONTAINERS = frozenset("aside dialog div dl fieldset footer form header menu nav ol section table ul".split())
BLOCKS = CONTAINERS | frozenset("address article blockquote body caption center dd details dt figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main p pre summary tbody td tfoot th thead tr".split())
WRAPPERS = frozenset("html body div section center form table tbody tr td".split())
CLOSES_P = BLOCKS - frozenset("body caption html tbody td tfoot th thead tr li dd dt".split())
#: An element that begins ends an open one of these, unless one of the second set is nearer.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"})}
ENDS |= {"tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
WALLS = frozenset("table td th caption button object html body".split())
NO_TEXT = frozenset("head script style noscript template iframe object embed svg math canvas audio video select button textarea form nav footer aside dialog menu".split())
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
# Words in class or id that mark what is not the article.
NO_TEXT_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer gdpr"
    " masthead menu modal nav navbar navigation newsletter notice notices overlay popup promo promotion recommended related replies reply respond"
    " share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
MAIN_WORDS = frozenset("article content entry main post story".split())


class Page:
    """Elements in page order; each one's text runs are a range of ``runs``, where None parts blocks."""

    def __init__(self, source: str):
        self.tags: list[str] = []
        self.marks: list[str] = []
        self.first: list[int] = []
        self.last: list[int] = []
        self.until: list[int] = []  # the first element after the subtree
        self.runs: list[str | None] = []
        self.parent: list[int] = []
        self.owner: list[int] = []  # of each run
        self._open: list[int] = []
        self._held: Counter[str] = Counter()  # open elements by tag
        self._parse(source)

    def _run(self, text: str | None) -> None:
        self.runs.append(text)
        self.owner.append(self._open[-1] if self._open else -1)

    def _begin(self, tag: str, marks: str) -> None:
        if tag in BLOCKS:
            self._run(None)
        self.parent.append(self._open[-1] if self._open else -1)
        self._open.append(len(self.tags))
        self._held[tag] += 1
        self.tags.append(tag)
        self.marks.append(marks)
        self.first.append(len(self.runs))
        self.last.append(-1)
        self.until.append(-1)

    def _end(self) -> None:
        i = self._open.pop()
        self._held[self.tags[i]] -= 1
        self.last[i], self.until[i] = len(self.runs), len(self.tags)
        if self.tags[i] in BLOCKS:
            self._run(None)

    def _end_through(self, wanted, walls) -> None:
        if not any(self._held[tag] for tag in wanted):
            return
        for depth in range(len(self._open) - 1, -1, -1):
            tag = self.tags[self._open[depth]]
            if tag in wanted:
                while len(self._open) > depth:
                    self._end()
                return
            if tag in walls:
                return

    def _parse(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = TAG.search(source, at)
            stop = m.start() if m else size
            if stop > at:
                self._run(html.unescape(source[at:stop]))
            if not m:
                break
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            closing, rest = (m[1], m[3]) if m[2] else (m[4], m[6])
            if m[5] and not source[at - 1 : at] == ">":
                break  # the page ends within a tag
            if closing:
                self._end_through((tag,), () if tag in BLOCKS else BLOCKS)
                continue
            if tag in ENDS:
                self._end_through(*ENDS[tag])
            if tag in CLOSES_P:
                self._end_through(("p",), WALLS)
            if tag in EMPTY:
                self._run(None if tag == "hr" else " ")
                continue
            self._begin(tag, rest)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                at = close.start() if close else size
            elif rest.endswith("/") and tag not in BLOCKS:
                self._end()
        while self._open:
            self._end()

    def _content(self) -> tuple[int, bool]:
        """The element with the page's content, -1 for the whole page, and whether its tag says so."""
        named = [i for i, t in enumerate(self.tags) if t in ("article", "main")]
        size = self._sizes()
        text = lambda i: size[self.last[i]] - size[self.first[i]]
        if named:
            return max(named, key=text), True
        at, children = -1, self._children()
        whole = size[-1]
        while inner := [i for i in children[at] if self.tags[i] in WRAPPERS and 2 * text(i) > whole]:
            at = inner[0]
            whole = text(at)
        return at, False

    def _sizes(self) -> list[int]:
        size = [0]
        for r in self.runs:
            size.append(size[-1] + len(r or ""))
        return size

    def _children(self) -> list[list[int]]:
        """The elements in each element; the last item holds those in none."""
        out: list[list[int]] = [[] for _ in range(len(self.tags) + 1)]
        for i, p in enumerate(self.parent):
            out[p].append(i)
        return out

    def subtrees(self) -> tuple[list[int], list[bool], list[bool], int]:
        """Of each element: hash of its tag, class, own text and children, whether it can be template, whether it is in an article; and the content's hash.

        An element can be template if it holds text and stands in none that has text of its own.
        """
        own: list[list[str]] = [[] for _ in self.tags]
        for text, i in zip(self.runs, self.owner, strict=True):
            if text and i >= 0:
                own[i].append(text)
        line = [" ".join("".join(x).split()) for x in own]
        at, named = self._content()
        until = self.until[at] if at >= 0 else len(self.tags)
        article = [False] * len(self.tags)
        for i, t in enumerate(self.tags):
            p = self.parent[i]
            article[i] = p >= 0 and (article[p] or self.tags[p] in ("article", "main"))
        out, full = [0] * len(self.tags), [False] * len(self.tags)
        inner: list[list[int]] = [[] for _ in self.tags]
        for i in range(len(self.tags) - 1, -1, -1):
            kind = self._marks(i).get("class", "") if "=" in self.marks[i] else ""
            within = article[i] or at < i < until
            text = line[i] if within else re.sub(r"[0-9]+", "0", line[i])
            out[i] = int.from_bytes(hashlib.blake2b(f"{self.tags[i]}|{kind}|{article[i]}|{text}|{inner[i]}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            full[i] = full[i] or bool(line[i])
            p = self.parent[i]
            if p >= 0:
                inner[p].append(out[i])
                full[p] = full[p] or full[i]
        free = [full[i] and (self.parent[i] < 0 or not line[self.parent[i]]) for i in range(len(self.tags))]
        whole = "\0".join(r or "" for r in (self.runs[self.first[at] : self.last[at]] if at >= 0 else self.runs))
        content = int.from_bytes(hashlib.blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        return out, free, article, content

    def _template(self, template: frozenset[int]) -> Iterator[int]:
        """Elements that the template deletes."""
        hashes, free, article, _ = self.subtrees()
        at, named = self._content()
        children, size = self._children(), self._sizes()
        body = next((i for i, t in enumerate(self.tags) if t == "body"), None)
        whole = size[self.last[body]] - size[self.first[body]] if body is not None else size[-1]
        hit = [free[i] and h in template for i, h in enumerate(hashes)]
        text = lambda i: size[self.last[i]] > size[self.first[i]]
        for siblings in children:
            unique = [k for k, i in enumerate(siblings) if text(i) and not hit[i]]
            for k, i in enumerate(siblings):
                between = unique and unique[0] < k < unique[-1] and self.tags[i] not in CONTAINERS and not article[i]
                if hit[i] and not between and 2 * (size[self.last[i]] - size[self.first[i]]) <= whole:
                    yield i

    def _marks(self, i: int) -> dict[str, str]:
        return {k.lower(): x or y or z for k, x, y, z in ATTRIBUTE.findall(self.marks[i])}

    def _words(self, i: int) -> tuple[frozenset[str], dict[str, str]]:
        marks = self._marks(i) if "=" in self.marks[i] else {}
        return frozenset(re.split(r"[\s_-]+", f"{marks.get('class', '')} {marks.get('id', '')}".lower())), marks

    def _not_text(self, i: int, in_article: bool, holds_article: bool) -> bool:
        tag = self.tags[i]
        if tag in NO_TEXT:
            return not (holds_article and tag == "form")
        if tag == "header" and not in_article:
            return not holds_article
        if not self.marks[i] or holds_article or tag in ("html", "body", "main"):
            return False
        words, marks = self._words(i)
        if marks.get("role", "").lower() in NO_TEXT_ROLES or marks.get("aria-hidden", "").lower() == "true":
            return True
        if re.search(r"display\s*:\s*none", marks.get("style", ""), re.I) or re.search(r"(?:^|\s)hidden(?=\s|$|=)", self.marks[i]):
            return True
        return bool(words & NO_TEXT_WORDS)

    def main_text(self, template: frozenset[int]) -> str:
        n = len(self.tags)
        articles = [0] * (n + 1)  # so many article or main elements before each element
        for i, t in enumerate(self.tags):
            articles[i + 1] = articles[i] + (t in ("article", "main"))
        gone: list[tuple[int, int]] = []
        mains: list[tuple[int, int, int]] = []
        article_until, i = 0, 0
        counted = frozenset(self._template(template)) if template else frozenset()
        body = next((i for i, t in enumerate(self.tags) if t == "body"), None)
        while i < n:
            holds = articles[self.until[i]] > articles[i + 1]
            if i in counted and not holds or self._not_text(i, i < article_until, holds):
                gone.append((self.first[i], self.last[i]))
                i = self.until[i]
                continue
            rank = 3 if self.tags[i] == "article" else 2 if self.tags[i] == "main" else 0
            if not rank and self.tags[i] in ("div", "section") and self.marks[i] and self._words(i)[0] & MAIN_WORDS:
                rank = 1
            if rank:
                mains.append((rank, self.first[i], self.last[i]))
                if rank > 1:
                    article_until = max(article_until, self.until[i])
            i += 1
        best = max((m[0] for m in mains), default=0)
        chosen = [(a, b) for r, a, b in mains if r == best] or [(self.first[body], self.last[body]) if body is not None else (0, len(self.runs))]
        blocks, line, upto = [], [], 0
        skip = iter([*gone, (len(self.runs), len(self.runs))])
        off, on = next(skip)
        for a, b in chosen:
            k = max(a, upto)
            while k < b:
                while on <= k and off < len(self.runs):
                    off, on = next(skip)
                if off <= k < on:
                    k = on
                    line.append(" ")
                    continue
                r = self.runs[k]
                if r is None:
                    blocks.append("".join(line))
                    line = []
                else:
                    line.append(r)
                k += 1
            upto = max(upto, b)
            blocks.append("".join(line))
            line = []
        return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(text_of(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(seen: DataFrame) -> DataFrame:
    """(host, subtree) of what recurs across a host's contents, from (k1, host, content, subtrees, within)."""
    one = F.min_by(F.struct("subtrees", "within"), "k1").alias("s")
    pages = stored(seen.groupBy("host", "content").agg(one).select("host", "s.*"))  # of pages with the same content, one
    counted = lambda column: pages.select("host", F.explode(column).alias("subtree")).groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES)
    sizes = pages.groupBy("host").agg(F.count("*").alias("contents"))
    common = counted("within").join(sizes, "host").where(F.col("n") >= SHARE * F.col("contents"))
    return counted("subtrees").select("host", "subtree").unionByName(common.select("host", "subtree"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page (page_id, url, html)."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            contents, subtrees, within = [], [], []
            for source in b["html"]:
                hashes, free, article, content = Page(source).subtrees()
                contents.append(content)
                subtrees.append(sorted({h for h, f, a in zip(hashes, free, article, strict=True) if f and not a}))
                within.append(sorted({h for h, f, a in zip(hashes, free, article, strict=True) if f and a}))
            yield b[["k1", "k2", "host"]].assign(content=contents, subtrees=subtrees, within=within)

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = [zlib.compress(source, 1) for source in b.column("html").cast(pa.binary()).to_pylist()]
            yield b.set_column(b.schema.get_field_index("html"), "html", pa.array(pages, pa.binary()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [Page(zlib.decompress(page).decode()).main_text(frozenset(t) if t is not None else frozenset()) for page, t in zip(b["html"], b["template"], strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"].array, "url": b["url"], "text": text})

    rows = pages.select("page_id", "url", text_of("html").alias("html"), F.xxhash64(host(F.col("url"))).alias("host"))
    rows = rows.withColumn("k1", F.xxhash64("page_id", "url", "html")).withColumn("k2", F.xxhash64("html", "url", "page_id"))
    seen = rows.select("k1", "k2", "host", "html").mapInPandas(parsed, "k1 bigint, k2 bigint, host bigint, content bigint, subtrees array<bigint>, within array<bigint>")
    seen = stored(seen)
    found = stored(templates(seen))
    each = seen.select("k1", "k2", "host", F.explode(F.concat("subtrees", "within")).alias("subtree"))
    if found.count() <= BROADCAST:
        hits = each.join(F.broadcast(found), ["host", "subtree"], "left_semi")
    else:  # a subtree may stand on a third of all pages: its pages are dealt into parts, each with a copy of the template
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = each.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int")).join(salted, ["host", "subtree", "salt"], "left_semi")
    hits = hits.groupBy("k1", "k2").agg(F.collect_set("subtree").alias("template"))  # at most a page's elements
    kinds = dict(pages.dtypes)
    # pages are the bulk of the input: they pass the shuffle zipped; the hint gives small and large tables the same plan
    sent = rows.select("page_id", "url", "k1", "k2", "html").mapInArrow(zipped, f"page_id {kinds['page_id']}, url {kinds['url']}, k1 bigint, k2 bigint, html binary")
    return sent.join(stored(hits).hint("merge"), ["k1", "k2"], "left").select("page_id", "url", "html", "template").mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op1(pages: DataFrame) -> DataFrame:
    return extracted(pages.select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("bigint"))
