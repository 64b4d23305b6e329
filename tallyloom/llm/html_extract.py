"""Main text of web pages: content marginals of DOM nodes in a tree-structured graphical model."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashed

#: Labelled pages, at most, that the model learns from: those of least hash of page_id.
SAMPLE_PAGES = 2000

TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<[!?/][^>]*+>""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Their content is no text of the page.
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "template", "svg", "select", "xmp", "noembed", "noframes"}
#: Of these, those that a tag ending in '/>' closes, and those that take the rest of the page if no end tag follows.
CLOSABLE, TO_END = {"svg", "iframe", "select", "noscript", "template"}, {"script", "style", "title", "textarea"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong "
             "sub sup time tt u var wbr img br".split())
#: A start tag of the first closes an open one of the others.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: They mark the article, the first of them that a page has, and end what is inherited from a side part around them.
MARKS = ("article", "main")
#: Of the page's parts around an article, those that a wrapper of the whole page holds too.
FRAME = {"nav", "header", "footer", "aside"}
#: Never side parts, whatever their names say.
WHOLE = {"html", "body"}
#: A name that begins so tells what the element has or lacks, not what it is.
OUTER_FIRST = {"no", "not", "with", "without", "has", "have", "hide"}
#: Page parts besides the article, by element and by words of class, id or role.
SIDE_TAGS = set("nav header footer aside form dialog menu button fieldset".split())
SIDE_WORDS = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form "
                 "header menu nav navbar navigation newsletter notice notices popup promo related reply replies respond share sharing sidebar "
                 "signup social sponsor sponsored subscribe toolbar widget complementary contentinfo search".split())


@dataclass
class Page:
    """A page's block elements and texts as nodes in page order, parents before children."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    traits: list[list[str]] = field(default_factory=lambda: [["root"]])
    text: list[str | None] = field(default_factory=lambda: [None])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    side: list[bool] = field(default_factory=lambda: [False])

    def add(self, parent: int, tag: str, traits: list[str], side: bool, text: str | None = None) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.traits.append(traits)
        self.text.append(text)
        self.tag.append(tag)
        self.side.append(side)
        return len(self.parent) - 1

    def settled(self) -> Page:
        """The page with traits that need all of it: what side parts hold, and below which of them a node lies.

        A side part is told by its share of the page's text, in quarters, by whether it holds a main heading (h1, or the first
        h2 of a page without), and whether it holds other parts of the page's frame: a wrapper with a side part's name does.
        """
        n = len(self.parent)
        size = [len(t) if t else 0 for t in self.text]
        heads, frames = [t == "h1" for t in self.tag], [t in FRAME for t in self.tag]
        if not any(heads) and "h2" in self.tag:
            heads[self.tag.index("h2")] = True
        frame_below = [False] * n
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            size[up] += size[i]
            heads[up] |= heads[i]
            frame_below[up] |= frame_below[i] or frames[i]
        above: list[str | None] = [None] * n
        traits = [self.traits[0]]
        for i in range(1, n):
            inherited = above[self.parent[i]] if self.tag[i] not in MARKS else None
            kind = f"{min(3, 4 * size[i] // max(1, size[0]))} {heads[i]:d} {frame_below[i]:d}" if self.side[i] else None
            own = [f"side {kind}"] if kind else self.traits[i]
            traits.append([*own, f"below {inherited}"] if inherited else own)
            above[i] = kind or inherited
        return Page(self.parent, self.depth, traits, self.text, self.tag, self.side)


def names_side(name: list[str]) -> bool:
    """Whether a name, split into words, is that of a side part, not of a page with or without one (no-sidebar, search-page)."""
    return name[0] not in OUTER_FIRST and name[-1] != "page" and any(w in SIDE_WORDS for w in name)


def parse(source: str) -> Page:
    """Block elements with their texts and all their traits."""
    return tree(source).settled()


def tree(source: str) -> Page:
    """Block elements with their texts and own traits. Inline elements only mark links; unclosed and unopened tags are tolerated."""
    page, stack, pieces = Page(), [(0, "#root")], []
    state, unclosed = {"link": False, "linked": 0}, set()

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            parent, tag = stack[-1]
            share = min(3, 4 * state["linked"] // len(text))
            page.add(parent, "#text", ["text", f"in {tag}", f"size {len(text).bit_length()}", f"links {share}", f"stop {text[-1] in '.!?:'}",
                                       f"in {tag} links {share}"], False, text)
        state["linked"] = 0

    at, end = 0, len(source)
    while at < end:
        m = TAG.search(source, at)
        upto = m.start() if m else end
        if upto > at:
            piece = source[at:upto]
            if "&" in piece:
                piece = html.unescape(piece)
            pieces.append(piece)
            if state["link"]:
                state["linked"] += len(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                state["link"] = not m[1]
            elif tag == "br":
                pieces.append(" ")
            continue
        if m[1]:
            if any(t == tag for _, t in stack):
                flush()
                while stack.pop()[1] != tag:
                    pass
            continue
        if tag in RAW:
            if tag in unclosed or tag in CLOSABLE and source[at - 2] == "/":
                continue
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            if close:
                at = close.end()
            elif tag in TO_END:
                at = end
            else:
                unclosed.add(tag)
            continue
        flush()
        state["link"] = False
        if tag in VOID:
            continue
        if stack[-1][1] == "p" or stack[-1][1] in IMPLIED.get(tag, ()):
            stack.pop()
            if stack[-1][1] in IMPLIED.get(tag, ()):
                stack.pop()
        names = []
        if m[3] and not m[3].isspace():
            names = [re.split("[_-]+", n) for found in NAMED.findall(m[3]) for n in "".join(found).lower().split()]
        words = [w for n in names for w in n if w]
        side = tag in SIDE_TAGS or tag not in WHOLE and any(names_side(n) for n in names)
        stack.append((page.add(stack[-1][0], tag, [f"is {tag}", *(f"named {w}" for w in words)], side), tag))
    flush()
    return page


def labels(page: Page) -> list[bool] | None:
    """Labels of a page that marks its article: content is what lies in ``article`` (else ``main``) outside side parts.
    None for a page without such a mark."""
    mark = next((t for t in MARKS if t in page.tag), None)
    if mark is None:
        return None
    out = [False]
    for i in range(1, len(page.parent)):
        out.append((out[page.parent[i]] or page.tag[i] == mark) and not page.side[i])
    return out


def _rebuilt(page: Page, content: list[bool], wrap: int | None, unmark: bool, asides: tuple[int, ...], headed: bool) -> tuple[Page, list[bool]]:
    """A labelled page with a side part wrapped around node ``wrap`` (0: around all), its marks turned into plain ``div``
    elements if ``unmark``, side parts (not content) that hold copies of as many of the article's texts as ``asides`` say, and
    a header of its own if ``headed``, with a copy of the heading."""
    new, labels_, place = Page(), [False], {}

    def put(parent: int, tag: str, traits: list[str], side: bool, text: str | None, label: bool) -> int:
        labels_.append(label)
        return new.add(parent, tag, traits, side, text)

    place[0] = put(0, "div", ["is div"], True, None, False) if wrap == 0 else 0
    head = next((i for i in range(1, len(page.parent)) if content[i] and page.text[i] and page.tag[page.parent[i]] == "h1"), None)
    if headed and head:
        inner = put(put(place[0], "header", ["is header"], True, None, False), "h1", ["is h1"], False, None, False)
        put(inner, "#text", page.traits[head], False, page.text[head], False)
    for i in range(1, len(page.parent)):
        parent, tag, traits = place[page.parent[i]], page.tag[i], page.traits[i]
        if i == wrap:
            parent = put(parent, "div", ["is div"], True, None, False)
        if unmark and tag in MARKS:
            tag, traits = "div", ["is div"]
        place[i] = put(parent, tag, traits, page.side[i], page.text[i], content[i])
    texts = [i for i in range(1, len(page.parent)) if content[i] and page.text[i] and page.tag[page.parent[i]] == "p"]
    for many in asides:
        if texts:
            part = put(place[0], "div", ["is div"], True, None, False)
            for k in range(many):
                i = texts[k % len(texts)]
                inner = put(put(part, "div", ["is div"], False, None, False), "p", ["is p"], False, None, False)
                put(inner, "#text", page.traits[i], False, page.text[i], False)
    return new, labels_


def variants(page: Page) -> list[tuple[Page, list[bool]]]:
    """What a model learns from a page that marks its article: the page itself, and rebuilt ones as sites without marks have
    them: unmarked, in wrappers named like side parts, with readers' comments as long as articles. None from other pages."""
    content = labels(page)
    if content is None:
        return []
    mark = next(i for i in range(1, len(page.parent)) if page.tag[i] == next(t for t in MARKS if t in page.tag))
    n = sum(1 for t in page.text if t)
    built = [(None, False, (), False), (None, True, (), True), (0, True, (1,), True), (mark, True, (2,), True), (None, True, (1, n), False),
             (mark, True, (), False), (0, False, (1,), False), (0, True, (n,), False)]
    return [(p.settled(), y) for p, y in (_rebuilt(page, content, *b) for b in built)]


@dataclass(frozen=True)
class TreeModel:
    """``weights``: log-odds of content for each trait; ``pair[p][c]``: log potential of parent label p and child label c."""

    weights: dict[str, float]
    bias: float
    pair: tuple[tuple[float, float], tuple[float, float]]

    def marginals(self, pages: list[Page]) -> np.ndarray:
        """P(content) of all nodes of ``pages``, one after the other, by one upward and one downward pass."""
        sizes = [len(p.parent) for p in pages]
        base = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
        parent = np.concatenate([np.array(p.parent) for p in pages]) + base
        depth = np.concatenate([np.array(p.depth) for p in pages])
        weight = self.weights.get
        own = np.zeros((len(parent), 2))
        own[:, 1] = [self.bias + sum(weight(t, 0.0) for t in traits) for p in pages for traits in p.traits]
        pair = np.array(self.pair)
        levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max()) + 1)] if len(depth) else []
        belief, up = own.copy(), np.zeros_like(own)
        for at in reversed(levels):  # messages of children into their parents
            up[at] = np.logaddexp(belief[at, None, 0] + pair[:, 0], belief[at, None, 1] + pair[:, 1])
            np.add.at(belief, parent[at], up[at])
        for at in levels:  # messages of parents into their children
            rest = belief[parent[at]] - up[at]
            belief[at] += np.logaddexp(rest[:, 0, None] + pair[0], rest[:, 1, None] + pair[1])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def main_text(pages: list[Page], model: TreeModel, threshold: float = 0.5) -> list[str]:
    """The texts whose marginal reaches ``threshold``, in page order, with an empty line between."""
    marginal, at, out = model.marginals(pages), 0, []
    for p in pages:
        part = marginal[at:at + len(p.parent)]
        out.append("\n\n".join(t for t, x in zip(p.text, part) if t is not None and x >= threshold))
        at += len(p.parent)
    return out


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, rounds: int = 300, ridge: float = 1e-3) -> TreeModel:
    """The model from at most ``sample_pages`` labelled pages of ``pages`` (page_id, html).

    The sample takes, of pages with a start tag of ``MARKS``, those of least hash of page_id; of rows that repeat an id, one;
    none without id. Spark parses it and its ``variants`` and counts distinct (traits, label, parent's label); on these counts
    trait weights are a ridge-regularised logistic regression in numpy, and pair potentials the log ratios of joint and
    separate shares. Where no page is labelled, the model is ``TRAINED``.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for source in batch.column(0):
                for page, content in variants(tree(source.as_py() or "")):
                    rows += [("\n".join(t), y, content[u] if u >= 0 else False) for t, y, u in zip(page.traits, content, page.parent)]
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.bool_()))], ["traits", "content", "above"])

    marked = F.col("html").rlike(rf"(?i)<({'|'.join(MARKS)})[\s/>]")
    whole = pages.where(F.col("page_id").isNotNull() & marked).select("page_id", "html")
    chosen = least_hashed(whole.select("page_id").distinct(), "page_id", sample_pages)
    sample = whole.join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).select("html")
    rows = sample.mapInArrow(counted, "traits string, content boolean, above boolean").groupBy("traits", "content", "above").count().collect()
    if not rows:
        return TRAINED
    rows.sort(key=lambda r: (r["traits"], r["content"], r["above"]))
    names = sorted({t for r in rows for t in r["traits"].split("\n")})
    place = {t: i for i, t in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    for i, r in enumerate(rows):
        x[i, [place[t] for t in r["traits"].split("\n")]] = 1
    x[:, -1] = 1
    y = np.array([r["content"] for r in rows], float)
    n = np.array([r["count"] for r in rows], float)
    n /= n.sum()
    w, step = np.zeros(x.shape[1]), 4.0 / max(1.0, x.sum(axis=1).max())
    speed = np.zeros_like(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed - step * (x.T @ (n * (p - y)) + ridge * w / len(w))
        w = w + speed
    joint = np.full((2, 2), 1e-4)
    for r, share in zip(rows, n):
        joint[int(r["above"]), int(r["content"])] += share
    joint /= joint.sum()
    pair = np.log(joint / joint.sum(axis=1, keepdims=True) / joint.sum(axis=0, keepdims=True))
    return TreeModel({t: float(w[i]) for t, i in place.items()}, float(w[-1]), tuple(tuple(map(float, r)) for r in pair))


#: What ``fit`` learns from the 2,000 labelled pages of ``pages`` at sf0.01, to two places, without the names those pages use.
TRAINED = TreeModel({
    "below 0 0 0": -6.26, "below 0 1 0": -4.16, "below 1 0 0": -4.01, "below 1 1 0": 0.6, "below 2 0 0": -8.32, "below 2 1 0": 1.47,
    "below 3 0 0": -5.16, "below 3 1 0": 3.0, "below 3 1 1": 0.89, "in div": -0.43, "in div links 0": -0.43, "in footer": -0.42,
    "in footer links 0": -0.42, "in h1": 0.82, "in h1 links 0": 0.82, "in li": -0.89, "in li links 3": -0.89, "in p": 1.44,
    "in p links 0": 1.44, "is article": 2.88, "is body": -2.09, "is div": 3.23, "is h1": 3.68, "is head": -2.09, "is html": -2.09,
    "is li": -1.24, "is p": 5.22, "is ul": -0.27, "links 0": 1.41, "links 3": -0.89, "root": -1.74, "side 0 0 0": -3.36,
    "side 0 1 0": -1.21, "side 1 0 0": -0.35, "side 1 1 0": -0.09, "side 2 0 0": -0.93, "side 2 1 0": -0.22, "side 3 0 0": -0.16,
    "side 3 1 0": -0.53, "side 3 1 1": -0.98, "size 1": -0.02, "size 10": -0.06, "size 11": -0.09, "size 2": -0.22, "size 3": -0.19,
    "size 4": -0.09, "size 5": 0.15, "size 6": 0.37, "size 7": 0.26, "size 8": 0.36, "size 9": 0.04, "stop False": 0.11, "stop True": 0.41,
    "text": 0.52
}, -1.82, ((0.42, -2.66), (-7.69, 1.03)))


def extracted(pages: DataFrame, model: TreeModel | None = None, threshold: float = 0.5) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html); the whole html is read.

    Pages are parsed and judged where they are read; trees of one batch pass their messages together, level by level.
    Null and empty html give an empty text; null ids and urls are carried through; repeated rows repeat; no pages give no
    rows; other columns are ignored. Without ``model`` one is fitted on the labelled pages of ``pages`` itself. A wrapper that
    is named like a side part keeps its article unless that is unmarked and under a quarter of the page's text.
    """
    model = model or fit(pages)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = main_text([parse(s.as_py() or "") for s in part.column(2)], sent.value, threshold)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
