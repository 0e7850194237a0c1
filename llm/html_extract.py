"""Main text of HTML pages: boosted trees over DOM nodes, decoded over the tree.

Block elements are nodes; inline elements belong to the node around them. Every
node gets the probability of lying in the article; a dynamic programme over the
tree then chooses the likeliest states, where only three kinds of steps exist:
outside may hold outside or article, article may hold article or excluded,
excluded holds excluded. So a kept node never lies in a dropped part of the
article, and a part that is cut out stays cut out.

Pages carry no labels. The trees learn from a bounded sample of pages whose
article is marked by the element of that name, and from the same articles put
into other layouts, with menus, notices, forms, sidebars and reader comments made
of the sample's own texts.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm import trees
from llm.common import F, chunks, free_name

#: Pages that the trees are fitted on, at most.
SAMPLE_PAGES = 400

#: Fixed values of HTML: elements without content, with content that is no text, inline, and what an open paragraph ends at.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style noscript template title textarea select iframe svg math object canvas".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Tokens of class, id and role that tell the parts of a page.
GOOD = frozenset("article content post main entry story body text maincontent articlebody hentry".split())
BAD = frozenset(
    "nav navbar menu header masthead footer foot sidebar side aside ad ads advert advertisement sponsor promo banner cookie cookies consent notice alert "
    "comment comments reply replies respond discussion form subscribe newsletter signup login share social related recommended breadcrumb breadcrumbs "
    "widget popup modal toolbar pagination pager tags meta legal copyright disclaimer".split()
)
BAD_TAGS = frozenset("nav header footer aside form dialog button menu fieldset".split())
TAGS = ("p", "li", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "table", "blockquote", "pre", "body")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Opaque elements whose content ends at the first end tag, however they begin.
RAW = frozenset("script style textarea title".split())
_OPEN = re.compile(r"<(?=[!?/a-zA-Z])")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile(r"=\s*([\"'])")
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|x-main|x-not)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_TOKEN = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")


class _Tags:
    """The tags of a source in order, in one pass: no place is looked at more than a few times, however broken the source is."""

    def __init__(self, source: str):
        self.source = source
        self.found: dict[str, int] = {}
        self.matches: dict[str, tuple[dict[int, int], list[int]]] = {}

    def _next(self, sign: str, at: int) -> int:
        """The first ``sign`` from ``at`` on, or -1; looked for anew only behind the last one found."""
        place = self.found.get(sign, -2)
        if place != -1 and place < at:
            place = self.found[sign] = self.source.find(sign, at)
        return place

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """(begin, end, whether it closes, name, attributes); comments and the like have an empty name.

        A quote that is not closed before the next tag is an ordinary character; without a > there is no tag.
        """
        source, at = self.source, 0
        while opened := _OPEN.search(source, at):
            begin = opened.start()
            ended = next((e for s, e in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")) if source.startswith(s, begin)), None)
            if ended:
                end = self._next(ended, begin + 2 + 2 * (ended == "-->"))
                at = len(source) if end < 0 else end + len(ended)
                yield begin, at, False, "", ""
                continue
            named = _NAME.match(source, begin)
            if not named:
                at = begin + 1
                continue
            place = named.end()
            while True:
                end = self._next(">", place)
                quote = _QUOTE.search(source, place, end) if end >= 0 else None
                if not quote:
                    break
                closing = self._next(quote[1], quote.end())
                tag = self._next("<", quote.end())
                if closing < 0 or end < tag < closing:
                    break
                place = closing + 1
            if end < 0:
                return
            at = end + 1
            yield begin, at, bool(named[1]), named[2].lower(), source[named.end() : end]

    def content_end(self, name: str, begin: int, at: int) -> int | None:
        """Where the element that begins at ``begin`` is over; None if it is never closed."""
        if name not in self.matches:
            opened: list[int] = []
            ends: dict[int, int] = {}
            closes: list[int] = []
            for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])", self.source, re.I):
                if m[1]:
                    closes.append(m.start())
                    if opened:
                        ends[opened.pop()] = m.start()
                elif self.source[self.source.find(">", m.end(), m.end() + 10_000) - 1] != "/":
                    opened.append(m.start())
            self.matches[name] = ends, closes
        ends, closes = self.matches[name]
        if name in RAW:
            k = bisect_left(closes, at)
            place = closes[k] if k < len(closes) else None
        else:
            place = ends.get(begin)
        if place is None:
            return None
        end = self.source.find(">", place)
        return len(self.source) if end < 0 else end + 1


class Page:
    """Block nodes in page order (a parent before its children) and the pieces of text that they own."""

    def __init__(self, source: str):
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.tokens: list[frozenset[str]] = [frozenset()]
        self.marked: list[int] = [0]
        self.inline_tags: list[int] = [0]
        #: (node, block number, text, inside a link)
        self.pieces: list[tuple[int, int, str, bool]] = []
        stack: list[tuple[str, int]] = [("#root", 0)]
        standing = Counter(["#root"])  # open elements by name
        block = at = links = 0
        tags = _Tags(source)
        for begin, end, closes, name, rest in tags:
            if begin < at:
                continue
            if begin > at:
                self.pieces.append((stack[-1][1], block, html.unescape(source[at:begin]), links > 0))
            at = end
            if not name:
                continue
            alone = rest.rstrip().endswith("/")
            if closes:
                if name == "a":
                    links = max(0, links - 1)
                if name in INLINE:
                    continue
                block += 1
                while standing[name]:
                    ended, _ = stack.pop()
                    standing[ended] -= 1
                    if ended == name:
                        break
                continue
            if name in OPAQUE:
                # who closes itself or is never closed has no content, but scripts and the like run to the end
                if name in RAW or not alone:
                    over = tags.content_end(name, begin, at)
                    at = over if over is not None else len(source) if name in RAW else at
                block += 1
                continue
            if name in INLINE:
                links += name == "a"
                self.inline_tags[stack[-1][1]] += 1
                continue
            if name in VOID:
                if name == "br":
                    self.pieces.append((stack[-1][1], block, " ", links > 0))
                continue
            block += 1
            links = 0
            for ended in ("p", *ITEMS.get(name, ())):
                if stack[-1][0] == ended:
                    stack.pop()
                    standing[ended] -= 1
            attributes = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(rest)} if rest else {}
            marked = 1 if "x-main" in attributes else -1 if "x-not" in attributes else 0
            tokens = frozenset(t for k, v in attributes.items() if k[:2] != "x-" for t in _TOKEN.findall(v))
            self.tag.append(name)
            self.parent.append(stack[-1][1])
            self.tokens.append(tokens)
            self.marked.append(marked)
            self.inline_tags.append(0)
            if not alone:
                stack.append((name, len(self.tag) - 1))
                standing[name] += 1
        if at < len(source):
            self.pieces.append((stack[-1][1], block, html.unescape(source[at:]), False))

    def features(self) -> np.ndarray:
        """A row per node: subtree and own text, densities, attribute tokens, depth, siblings, element."""
        n = len(self.tag)
        parent = np.array(self.parent)
        own, link, stops = np.zeros(n), np.zeros(n), np.zeros(n)
        for node, _, text, linked in self.pieces:
            size = len(text.strip())
            own[node] += size
            link[node] += size * linked
            stops[node] += len(_PUNCTUATION.findall(text)) if size else 0
        sums = np.stack([own, link, stops, np.ones(n), np.array(self.inline_tags, float), np.array([t == "p" for t in self.tag], float)])
        for k in range(n - 1, 0, -1):
            sums[:, parent[k]] += sums[:, k]
        text, links, marks, nodes, inline, paragraphs = sums
        bad_tag = np.array([t in BAD_TAGS for t in self.tag])
        bad, good = np.array([len(t & BAD) for t in self.tokens]), np.array([len(t & GOOD) for t in self.tokens])
        depth, inside_bad, inside_good, inside_article = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        count, order, seen = np.zeros(n), np.zeros(n), np.zeros(n)
        article = np.array([t in ("article", "main") for t in self.tag])
        for k in range(1, n):
            p = parent[k]
            depth[k] = depth[p] + 1
            inside_bad[k] = inside_bad[p] + bad[p] + bad_tag[p]
            inside_good[k] = inside_good[p] + good[p]
            inside_article[k] = inside_article[p] + article[p]
            order[k] = seen[p]
            seen[p] += 1
        count[1:] = seen[parent[1:]]
        total = max(text[0], 1.0)
        up = np.maximum(parent, 0)
        ones = np.maximum(text, 1.0)
        columns = [
            np.log1p(own), np.log1p(text), text / total, links / ones, marks / ones, text / (nodes + inline), paragraphs, paragraphs / nodes,
            depth, count, order, order / np.maximum(count, 1), seen, text / np.maximum(text[up], 1.0), links[up] / np.maximum(text[up], 1.0),
            paragraphs[up], bad, good, inside_bad, inside_good, inside_article, bad_tag,
            np.array([t in HEADINGS for t in self.tag]), *(np.array([t == name for t in self.tag]) for name in TAGS),
        ]
        return np.stack(columns, axis=1).astype(float)

    def labels(self) -> np.ndarray:
        """1 for nodes of the marked article, without the parts marked as foreign."""
        y = np.zeros(len(self.tag))
        for k in range(1, len(y)):
            y[k] = 1.0 if self.marked[k] > 0 else 0.0 if self.marked[k] < 0 else y[self.parent[k]]
        return y

    def decode(self, probability: np.ndarray) -> np.ndarray:
        """Whether each node is article, by the likeliest consistent states."""
        n = len(self.tag)
        p = np.clip(probability, 1e-4, 1 - 1e-4)
        size = np.zeros(n)
        for node, _, text, _ in self.pieces:
            size[node] += len(text.split())
        weight = np.log1p(size) + 0.1
        inside, outside = weight * np.log(p), weight * np.log(1 - p)
        # best sums of the subtree if the node is outside, article, excluded
        best = np.stack([outside, inside, outside])
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            best[0, up] += max(best[0, k], best[1, k])
            best[1, up] += max(best[1, k], best[2, k])
            best[2, up] += best[2, k]
        state = np.zeros(n, np.int64)
        for k in range(1, n):
            up = state[self.parent[k]]
            state[k] = 2 if up == 2 else up + int(best[up + 1, k] > best[up, k])
        return state == 1

    def text(self, kept: np.ndarray) -> str:
        """Text of the kept nodes: white space inside a block is one space, blocks are joined by one."""
        blocks: list[str] = []
        last = None
        for node, block, text, _ in self.pieces:
            if kept[node]:
                if last == (node, block):
                    blocks[-1] += text
                else:
                    blocks.append(text)
                    last = (node, block)
        return " ".join(" ".join(b.split()) for b in blocks if b.strip())


_ARTICLE = re.compile(r"<article\b[^>]*>(.*?)</article>", re.S | re.I)
#: Layouts that an article is put into: {a} its inner HTML, {m} a menu, {b} a short text, {c} texts of other articles.
LAYOUTS = (
    '<body><div id="header"><div class="logo">{b}</div><ul class="menu">{m}</ul></div><div id="wrap"><div class="post-content" x-main="1">{a}</div>'
    '<div class="sidebar"><h3>{b}</h3><ul>{m}</ul></div></div><div class="comments" x-not="1"><h3>{b}</h3><div class="comment"><p>{c}</p></div></div><div id="footer"><p>{b}</p></div></body>',
    '<body><header><h2>{b}</h2><nav><ul>{m}</ul></nav></header><main x-main="1">{a}<aside class="related" x-not="1"><p>{c}</p><ul>{m}</ul></aside></main>'
    '<section id="comments"><ol><li><p>{c}</p></li><li><p>{b}</p></li></ol><form><label>{b}</label><textarea></textarea></form></section><footer>{b}</footer></body>',
    '<body><div class="cookie-notice"><p>{c}</p></div><div class="nav">{m}</div><div class="container"><div class="row"><div class="entry" x-main="1">{a}'
    '<div class="ad" x-not="1">{b}</div>{a2}</div><div class="widget"><p>{b}</p></div></div></div><form class="newsletter"><p>{b}</p></form><div class="copyright">{b}</div></body>',
    '<body><table><tr><td class="menu"><ul>{m}</ul></td><td class="text" x-main="1">{a}<div class="share" x-not="1">{b}</div></td></tr></table><div class="legal"><p>{b} {b}</p></div></body>',
    '<body><div class="page"><nav>{m}</nav><article x-main="1">{a}<section class="comments" x-not="1"><h2>{b}</h2><article class="comment"><p>{c}</p></article></section></article>'
    "<aside><h4>{b}</h4><p>{c}</p></aside></div><footer><p>{b}</p></footer></body>",
    '<body><div><ul>{m}</ul></div><div><div x-main="1">{a}</div><div><ul>{m}</ul></div></div><div>{b}</div></body>',
)


def training_pages(pages: list[str]) -> list[str]:
    """The pages that hold one article, marked, and their articles in every layout."""
    found = [(p, m) for p in pages if (m := _ARTICLE.search(p)) and len(_ARTICLE.findall(p)) == 1]
    rest = [re.sub(r"<[^>]*>", " ", p[: m.start()][-300:] + p[m.end() :])[:200].strip() or "Home" for p, m in found]
    out = []
    for k, (page, m) in enumerate(found):
        inner = m[1]
        out.append(page[: m.start()] + '<article x-main="1">' + inner + "</article>" + page[m.end() :])
        other = found[(k * 7 + 3) % len(found)][1][1]
        plain = re.sub(r"<[^>]*>", " ", other)
        start = zlib.crc32(plain.encode()) % max(1, len(plain) - 200)
        menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rest[k].split()[:8])
        values = {"m": menu, "b": rest[k][:120], "c": plain[start : start + 300]}
        for layout in (LAYOUTS[k % len(LAYOUTS)], LAYOUTS[(k + 2) % len(LAYOUTS)]):
            paragraphs = inner.split("<p>")
            half = len(paragraphs) // 2 + 1
            split = {"a": "<p>".join(paragraphs[:half]), "a2": "<p>" + "<p>".join(paragraphs[half:])} if "{a2}" in layout else {"a": inner, "a2": ""}
            filled = layout
            for name, value in (values | split).items():
                filled = filled.replace("{" + name + "}", value)
            out.append("<html>" + filled + "</html>")
    return out


def fit_extractor(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> trees.Trees:
    """The trees from at most ``sample_pages`` pages, chosen by a hash of the page.

    Without a page that holds one article, nothing is known and nothing is kept.
    """
    marked = pages.where(F.col("html").isNotNull()).select("html", F.xxhash64("html").alias("o"))
    # hashes are chosen first, so that no task sends pages that are not in the sample
    marks = marked.select("o").distinct().orderBy("o").limit(sample_pages)
    chosen = marked.join(F.broadcast(marks), "o", "left_semi").groupBy("o").agg(F.min("html").alias("html"))
    parsed = [Page(p) for p in training_pages([r["html"] for r in sorted(chosen.collect())])]
    if not parsed:
        return trees.constant(0.001)
    x, y = np.concatenate([p.features() for p in parsed]), np.concatenate([p.labels() for p in parsed])
    return trees.fit(x, y, rounds=60, depth=5, rate=0.25)


def with_main_text(pages: DataFrame, model: trees.Trees, column: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with a string column ``out`` added: the main text, empty if there is none.

    NULL and empty pages have an empty text. Broken markup is read as far as it
    goes. Rows with NULL or repeated ids are read by themselves; an empty table
    gives an empty result. Other columns pass unchanged; ``out`` gets underscores in
    front if the name is taken.
    """
    out, whole = free_name(pages, out), free_name(pages, "_whole_html")
    source = pages.withColumn(whole, F.col(column))
    schema = pages.withColumn(out, F.lit("")).schema

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, whole):
            parsed = [Page(h or "") for h in batch.column(whole).to_pylist()]
            sizes = np.cumsum([0] + [len(p.tag) for p in parsed])
            odds = model.probability(np.concatenate([p.features() for p in parsed])) if parsed else np.zeros(0)
            texts = [p.text(p.decode(odds[a:b])) for p, a, b in zip(parsed, sizes, sizes[1:])]
            others = [c for c in batch.schema.names if c != whole]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string())], [*others, out])

    return source.mapInArrow(extracted, schema)
