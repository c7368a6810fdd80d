"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

**Nodes.** A page becomes a tree of elements (unclosed and unopened tags are mended as browsers do for paragraphs and
list items). Every element gets features of its own, of its subtree, its siblings, its place, its ancestors and of the
tokens of its class, id and role.

**Decoding.** The trees give each node the probability that it holds main text. A dropped node drops its whole subtree
and a kept one needs a kept parent, so ancestors and descendants never contradict each other: the best such choice is
found by one pass up the tree (value of dropping the subtree against keeping the node and the best of each child) and
one pass down.

**Training.** Pages carry no labels. A bounded sample of pages, the first ``SAMPLE`` by hash of their HTML, lends its
text to labelled pages: each is laid out anew in seeded layouts whose main part is known (menus, headers, sidebars,
notices, adverts, forms, comments and footers around and inside it; semantic tags or plain divisions; telling, neutral
or no class names), and the sampled page itself is used too where it marks its article. This fits the classifier only;
every page is then decoded whole.

**Text.** Character references are decoded, white space inside a block becomes one space, blocks are joined in page
order by a line feed.

Defined cases: null or empty HTML gives an empty text; if no sampled page has text, pages keep all but the elements that
name themselves something else (``untrained_choice``); scripts, styles and comments are never text; a page cut off
anywhere is read up to there; repeated rows give equal rows; an empty table gives an empty result; carried columns come
first.
"""

from __future__ import annotations

import math
import random
import re
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.llm import boosting
from fluxloom.llm.text import whole

SAMPLE = 120
LAYOUTS_EACH = 4
SEED = 10
AT_ONCE = 200

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split())
TEXT = r"(^|>)\s*[^<\s]"  # something outside of tags
SILENT = frozenset("script style template noscript head title svg iframe object select option textarea".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split())
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table".split())
GROUPS = [
    {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd"}, {"ul", "ol", "dl"}, {"a"}, {"div"},
    {"article", "main"}, {"section", "blockquote", "figure", "figcaption", "pre"}, {"nav", "menu"}, {"header"}, {"footer"},
    {"aside"}, {"form", "input", "button", "label", "fieldset"}, {"table", "tbody", "tr", "td", "th"}, {"html", "body"},
    set(SILENT),
]
GROUP_OF = {tag: i for i, tags in enumerate(GROUPS) for tag in tags}
GOOD = frozenset("article articlebody body content entry main page post postbody story text prose blog".split())
BAD = frozenset(
    "ad ads adv advert advertisement alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus discussion footer form gdpr header login masthead menu nav navbar navigation newsletter notice pager popup "
    "promo reader readers related reply replies search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe tags toolbar top widget".split())
UNFINISHED = re.compile(r"</?[A-Za-z!?]")
TOKEN = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Page(HTMLParser):
    """Elements in page order, and the pieces of text with their element and block."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.good, self.bad = ["#page"], [-1], [0], [0]
        self.open = [0]
        self.pieces: list[tuple[int, int, str]] = []
        self.block = 0
        cut = html.rfind("<")
        if cut > html.rfind(">") and UNFINISHED.match(html, cut):
            html = html[:cut]  # the page ends inside a tag
        self.feed(html)
        self.close()

    def _pop_to(self, depth: int) -> None:
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "br":
            self.pieces.append((self.open[-1], self.block, " "))
        if tag in CLOSES_P or tag in ALIKE:
            ends = ALIKE.get(tag, {"p"})
            for depth in range(len(self.open) - 1, 0, -1):
                name = self.tag[self.open[depth]]
                if name in ends:
                    self._pop_to(depth)
                    break
                if name not in INLINE and (name != "p" or tag not in CLOSES_P):
                    break
        if tag not in INLINE:
            self.block += 1
        tokens = [t.lower() for k, v in attrs if v and k in ("class", "id", "role", "itemprop") for t in TOKEN.findall(v)]
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.good.append(sum(t in GOOD for t in tokens))
        self.bad.append(sum(t in BAD for t in tokens))
        if tag not in VOID:
            self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div"):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.block += 1
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[depth]]
            if name == tag:
                self._pop_to(depth)
                return
            if tag in INLINE and name not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if self.tag[self.open[-1]] not in SILENT:
            self.pieces.append((self.open[-1], self.block, data))

    def text(self, kept) -> str:
        blocks, last = [], -1
        for node, block, data in self.pieces:
            if kept[node]:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(data)
        joined = (" ".join("".join(parts).split()) for parts in blocks)
        return "\n".join(b for b in joined if b)


def features(page: Page) -> np.ndarray:
    """One row per element; sums over subtrees go from the last element to the first."""
    n = len(page.tag)
    chars, words, links, marks, nodes, blocks, longest = ([0] * n for _ in range(7))
    own, start = [0] * n, [-1.0] * n
    seen = 0
    for node, _, data in page.pieces:
        size = len(data.strip())
        own[node] += size
        chars[node] += size
        words[node] += len(data.split())
        marks[node] += data.count(",") + data.count(".")
        if start[node] < 0:
            start[node] = seen
        seen += size
    depth, place, group = [0] * n, [0] * n, [GROUP_OF.get(t, len(GROUPS)) for t in page.tag]
    children: list[int] = [0] * n
    same: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        up = page.parent[i]
        depth[i], place[i] = depth[up] + 1, children[up]
        children[up] += 1
        same[up, page.tag[i]] = same.get((up, page.tag[i]), 0) + 1
    for i in range(n - 1, -1, -1):
        nodes[i] += 1
        if page.tag[i] == "a":
            links[i] = chars[i]
        if group[i] in (0, 2):
            blocks[i] += 1
        longest[i] = max(longest[i], own[i])
        up = page.parent[i]
        if up >= 0:
            chars[up] += chars[i]
            words[up] += words[i]
            links[up] += links[i]
            marks[up] += marks[i]
            nodes[up] += nodes[i]
            blocks[up] += blocks[i]
            longest[up] = max(longest[up], longest[i])
            if start[i] >= 0 and (start[up] < 0 or start[i] < start[up]):
                start[up] = start[i]
    total = max(chars[0], 1)
    bad_above, good_above, poor_above, article_above = [0] * n, [0] * n, [0] * n, [0] * n
    rows = []
    for i in range(n):
        up = max(page.parent[i], 0)
        if i:
            bad_above[i] = bad_above[up] + (page.bad[up] > 0)
            good_above[i] = good_above[up] + (page.good[up] > 0)
            poor_above[i] = poor_above[up] + (8 <= group[up] <= 12)
            article_above[i] = article_above[up] + (group[up] == 6)
        c, k = chars[i], nodes[i]
        rows.append((
            group[i], group[up], page.good[i], page.bad[i],
            bad_above[i], good_above[i], poor_above[i], article_above[i],
            min(depth[i], 30), place[i], children[up], children[i], same.get((up, page.tag[i]), 1), (place[i] + 1) / max(children[up], 1),
            math.log1p(c), math.log1p(words[i]), c / k, links[i] / max(c, 1), marks[i] / max(words[i], 1), math.log1p(own[i]),
            blocks[i], math.log1p(longest[i]), c / total, start[i] / total, math.log1p(k),
            chars[up] / total, links[up] / max(chars[up], 1), math.log1p(chars[up]), c / max(chars[up], 1),
            float(8 <= group[i] <= 12),
        ))
    return np.array(rows, float)


def decode(parent: list[int], log_odds: np.ndarray) -> list[bool]:
    """The most probable choice in which every kept node's parent is kept; the page itself always is."""
    keep = (-np.logaddexp(0, -log_odds)).tolist()
    drop = (-np.logaddexp(0, log_odds)).tolist()
    below = [0.0] * len(parent)  # the best of the children, if the node is kept
    take = [True] * len(parent)
    for i in range(len(parent) - 1, 0, -1):
        kept = keep[i] + below[i]
        take[i] = kept > drop[i]
        up = parent[i]
        below[up] += kept if take[i] else drop[i]
        drop[up] += drop[i]
    for i in range(1, len(parent)):
        take[i] = take[i] and take[parent[i]]
    return take


# ---------------------------------------------------------------- labelled pages

CLASSES = {
    "main": ["content", "post-body", "entry", "article-text", "story", "main", "x1", "col-8", ""],
    "menu": ["menu", "nav", "navbar", "links", "x2", ""], "side": ["sidebar", "widget", "related", "col-4", "x3", ""],
    "ad": ["ad", "ads", "promo", "sponsored", "banner"], "note": ["notice", "cookie", "consent", "alert", "x4"],
    "talk": ["comments", "comment-list", "replies", "discussion"], "foot": ["footer", "bottom", "legal", "x5"],
    "head": ["header", "masthead", "top", "x6"],
}


def _opening(rng: random.Random, tag: str, part: str) -> str:
    name = rng.choice(CLASSES[part])
    key = rng.choice(["class", "class", "id"])
    return f'<{tag} {key}="{name}">' if name else f"<{tag}>"


def laid_out(paragraphs: list[str], other: list[str], rng: random.Random) -> str:
    """A page whose main blocks carry ``data-main``; ``other`` lends the text of the rest."""
    def words(n: int) -> str:
        text = rng.choice(other).split() or ["word"]
        at = rng.randrange(max(1, len(text) - n))
        return escape(" ".join(text[at : at + n]))

    def short(tag: str, part: str, n: int = 12) -> str:
        inner = words(rng.randint(2, n))
        if rng.random() < 0.3:
            inner = f"<p>{inner}</p>"
        return f"{_opening(rng, tag, part)}{inner}</{tag}>"

    def menu() -> str:
        items = "".join(f'<li><a href="/{i}">{words(rng.randint(1, 2))}</a></li>' for i in range(rng.randint(3, 9)))
        tag = rng.choice(["nav", "nav", "div"])
        return (f"<{tag}>" if tag == "nav" and rng.random() < 0.6 else _opening(rng, tag, "menu")) + f"<ul>{items}</ul></{tag}>"

    def side() -> str:
        tag = rng.choice(["aside", "aside", "div"])
        name = _opening(rng, tag, "side") if tag == "aside" else f'<div class="{rng.choice(["sidebar", "widget", "related"])}">'
        inner = "".join(f"<p>{words(rng.randint(4, 30))}</p>" for _ in range(rng.randint(1, 3)))
        return f"{name}<h3>{words(2)}</h3>{inner}</{tag}>"

    def talk() -> str:
        tag = rng.choice(["section", "div", "ul"])
        cell = "li" if tag == "ul" else "div"
        inner = "".join(
            f'<{cell} class="{rng.choice(["comment", "reply", "c"])}"><b>{words(1)}</b><p>{words(rng.randint(4, 40))}</p></{cell}>'
            for _ in range(rng.randint(1, 4)))
        return f"{_opening(rng, tag, 'talk')}{inner}</{tag}>"

    def form() -> str:
        return f'<form action="/s"><label>{words(2)}</label><input name="q"><button>{words(1)}</button></form>'

    def some(maker, chance: float) -> str:
        return maker() if rng.random() < chance else ""

    def main_block(text: str) -> str:
        shape = rng.random()
        if 0.2 <= shape < 0.28:
            n = rng.randint(1, 12)
            words_ = text.split()
            items = [" ".join(words_[k : k + n]) for k in range(0, min(len(words_), 6 * n), n)]
            return "<ul data-main>" + "".join(f"<li>{escape(x)}</li>" for x in items) + "</ul>"
        if rng.random() < 0.15:
            text = " ".join(text.split()[: rng.randint(1, 8)])
        text = escape(text)
        if shape < 0.12:
            return f"<p data-main><b>{text}<br>"
        if shape < 0.2:
            return f"<blockquote data-main><p>{text}</p></blockquote>"
        if shape < 0.36:
            return f"<div data-main>{text}</div>"
        return f"<p data-main>{text}</p>"

    head = f"<h1 data-main>{escape(' '.join((paragraphs or ['']) [0].split()[:rng.randint(1, 12)]))}</h1>"
    body = [head] + [main_block(p) for p in paragraphs]
    for maker, chance in ((lambda: short("div", "ad"), 0.3), (form, 0.1), (side, 0.15), (lambda: short("div", "note"), 0.1)):
        if rng.random() < chance:
            body.insert(rng.randint(1, len(body)), maker())
    tag = rng.choice(["article", "article", "main", "div", "section", "div"])
    main = (f"<{tag}>" if tag in ("article", "main") else _opening(rng, tag, "main")) + "".join(body) + some(talk, 0.2) + f"</{tag}>"
    header = f"{_opening(rng, 'header', 'head') if rng.random() < .5 else '<header>'}{words(3)}{some(menu, .5)}</header>"
    footer = f"<footer>&copy; {words(rng.randint(2, 14))}</footer>" if rng.random() < 0.7 else short("div", "foot", 14)
    parts = [
        header if rng.random() < 0.4 else "", some(menu, 0.8), some(lambda: short("div", "note"), 0.3), some(lambda: short("div", "ad"), 0.6),
        some(side, 0.2), main, some(side, 0.3), some(talk, 0.4), some(form, 0.3), footer if rng.random() < 0.9 else "",
    ]
    inside = "".join(parts)
    if rng.random() < 0.3:
        inside = f'<div id="{rng.choice(["wrap", "page", "root"])}">{inside}</div>'
    html = f"<html><head><title>{words(3)}</title></head><body>{inside}</body></html>"
    return html if rng.random() > 0.1 else html[: html.rfind("</body>")]


def _labels(page: Page, marked: list[bool]) -> np.ndarray:
    """1 for elements in a marked one and for those that hold one."""
    y = np.zeros(len(page.tag))
    for i in range(1, len(page.tag)):
        y[i] = marked[i] or (y[page.parent[i]] == 1 and any_marked(page, i, marked))
    for i in range(len(page.tag) - 1, 0, -1):
        if y[i]:
            y[page.parent[i]] = 1
    return y


def any_marked(page: Page, node: int, marked: list[bool]) -> bool:
    while node > 0:
        if marked[node]:
            return True
        node = page.parent[node]
    return False


class _Marked(Page):
    def __init__(self, html: str):
        self.marks = [False]
        super().__init__(html)

    def handle_starttag(self, tag: str, attrs) -> None:
        super().handle_starttag(tag, attrs)
        self.marks.append(any(k == "data-main" for k, _ in attrs))


def _paragraphs(html: str) -> list[str]:
    """Lines of a page's whole text: those of three words or more, or all of a page that has none."""
    page = Page(html)
    lines = [line for line in page.text([True] * len(page.tag)).split("\n") if line]
    return [line for line in lines if len(line.split()) >= 3] or lines


def _is_poor(page: Page, i: int) -> bool:
    """An element that names itself something else than main text."""
    return bool(page.bad[i]) or page.tag[i] in ("aside", "nav", "form", "footer", "header") or page.tag[i] in SILENT


def untrained_choice(page: Page) -> list[bool]:
    """What to keep of a page when no page could teach: all but the elements that name themselves otherwise.

    If nothing is left by that, all is kept, so a page that has text never loses all of it.
    """
    take = [True] * len(page.tag)
    for i in range(1, len(page.tag)):
        take[i] = take[page.parent[i]] and not _is_poor(page, i)
    return take if page.text(take) else [True] * len(page.tag)


def _own_labels(html: str) -> tuple[Page, np.ndarray] | None:
    """A page that marks one article: what lies in it is main, but for parts that name themselves otherwise."""
    page = Page(html)
    article = [i for i, t in enumerate(page.tag) if t == "article"]
    if len(article) != 1:
        return None
    inside = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        up = page.parent[i]
        inside[i] = (i == article[0] or inside[up]) and not _is_poor(page, i)
    y = np.array(inside, float)
    node = article[0]
    while node >= 0:
        y[node], node = 1, page.parent[node]
    return page, y


def train(pages: list[str], seed: int = SEED, layouts: int = LAYOUTS_EACH) -> boosting.Trees | None:
    """Trees from the text of sampled pages; None if they hold no text."""
    texts = [p for p in map(_paragraphs, pages) if p]
    if not texts:
        return None
    rng = random.Random(seed)
    other = [line for p in texts for line in p]
    x, y = [], []
    for html, lines in zip([h for h in pages if _paragraphs(h)], texts):
        own = _own_labels(html)
        if own:
            x.append(features(own[0]))
            y.append(own[1])
        for _ in range(layouts):
            some = rng.sample(lines, min(len(lines), rng.randint(1, 12)))
            page = _Marked(laid_out(some, other, rng))
            x.append(features(page))
            y.append(_labels(page, page.marks))
    return boosting.fit(np.concatenate(x), np.concatenate(y))


def fit(pages: DataFrame, sample: int = SAMPLE) -> boosting.Trees | None:
    """Train on the first ``sample`` pages, by hash of their HTML, that have anything outside of tags; copies count once.

    Hashes alone are ordered, so tasks hand over numbers and only the sampled pages reach the driver.
    """
    rows = pages.select(whole(pages["html"]).alias("html")).where(F.col("html").rlike(TEXT)).withColumn("h", F.xxhash64("html"))
    last = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return None
    chosen = rows.where(F.col("h") <= last).groupBy("h").agg(F.min("html").alias("html")).collect()
    return train([r["html"] for r in sorted(chosen, key=lambda r: r["h"])])


def main_text(html: str | None, trees: boosting.Trees | None) -> str:
    return main_texts([html], trees)[0]


def main_texts(pages: list[str | None], trees: boosting.Trees | None) -> list[str]:
    parsed = [Page(html or "") for html in pages]
    if trees is None:
        return [page.text(untrained_choice(page)) for page in parsed]
    rows = [features(page) for page in parsed]
    scores = trees.log_odds(np.concatenate(rows))
    out, at = [], 0
    for page, row in zip(parsed, rows):
        out.append(page.text(decode(page.parent, scores[at : at + len(row)])))
        at += len(row)
    return out


def extracted(pages: DataFrame, carry: list[str], trees: boosting.Trees | None, name: str = "text") -> DataFrame:
    """Carried columns and the main text."""
    schema = T.StructType([T.StructField(c, pages.schema[c].dataType) for c in carry] + [T.StructField(name, T.StringType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                piece = batch.slice(at, AT_ONCE)
                texts = main_texts(piece.column(piece.num_columns - 1).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return pages.select(*[pages[c] for c in carry], whole(pages["html"]).alias("_html")).mapInArrow(run, schema)
