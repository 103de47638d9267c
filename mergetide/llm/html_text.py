"""Main text of web pages: boosted trees score DOM nodes, a tree search decides.

A page becomes a tree of its block elements. Each node has features of its tag, the
words in its attributes, its depth, its siblings, and the text, links and density of its
subtree. Gradient-boosted trees give every node a chance of being main text, and the
decoding takes the most likely labelling in which nothing under a dropped node is kept.

The trees are fitted on a bounded sample of the pages themselves. Semantic elements label
it, and each sampled page is also seen with them replaced by plain ``div`` elements with
telling or no attributes and with notices, adverts, forms, sidebars and comments
made of other pages' text put in, so that the model does not rest on the tags alone.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergetide.llm.token_counts import by_bytes

SAMPLE_PAGES, SAMPLE_CHARS = 150, 150 * 40_000
# Element kinds of HTML, and words that tell what a block is for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea title head svg math select option button iframe object canvas".split())
RAW = frozenset("script style textarea title".split())
BLOCKS = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 article main section nav aside header footer form ul ol li dl dt dd table tr td th thead tbody "
    "blockquote pre figure figcaption address fieldset details summary dialog hr center caption tfoot".split()
)
TAG_GROUPS = {
    "nav": 0, "menu": 0, "aside": 1, "footer": 2, "header": 3, "form": 4, "fieldset": 4, "dialog": 5, "article": 6, "main": 6,
    "p": 7, "pre": 7, "blockquote": 7, "h1": 8, "h2": 8, "h3": 8, "h4": 8, "h5": 8, "h6": 8, "li": 9, "ul": 9, "ol": 9, "dl": 9,
    "dt": 9, "dd": 9, "table": 10, "tr": 10, "td": 10, "th": 10, "thead": 10, "tbody": 10, "html": 11, "body": 11,
}
OTHER_TAG = 12
ATTRIBUTE_WORDS = {
    "main": "article articlebody body content entry main post story text prose",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar",
    "side": "sidebar side aside rail widget related recommended recirc teaser trending popular",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner dfp adsense outbrain taboola",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay paywall newsletter subscribe message toast",
    "foot": "footer foot copyright legal colophon credits",
    "head": "header masthead topbar logo branding",
    "talk": "comment comments disqus reply replies respond discussion reactions",
    "form": "form login signup search contact share social sharing",
}
_WORDS = {w: i for i, words in enumerate(ATTRIBUTE_WORDS.values()) for w in words.split()}
_SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_STOP = re.compile("[>\"']")
_NAME_REST = re.compile(r"[^\s/>]*")
_TAG_START = re.compile(r"<(/?)(?=[a-zA-Z])")
_ATTRIBUTE = re.compile(r"""(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
# An opening tag of the key closes open elements of these kinds first.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


@dataclass
class Node:
    tag: str
    words: list[int]
    parent: int
    depth: int
    hidden: bool
    place: int = 0  # among its parent's children
    chars: int = 0
    linked: int = 0
    tags: int = 0
    stops: int = 0
    paragraphs: int = 0
    children: list[int] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)


class Tags:
    """Where tags end, found in linear time on any page.

    Only three characters decide: a tag ends at the first > outside quotes behind its name.
    What lies between a place and the next of them is gone through once, and those from
    which no end can be reached are remembered, so that no stretch without an end is
    searched again for the next <.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {mark: page.rfind(mark) for mark in "\"'>"}
        self.dead: set[int] = set()
        self.name = self.first = (0, -1)  # the stretch looked through last, up to what ends it

    def name_end(self, at: int) -> int:
        if not self.name[0] <= at <= self.name[1]:
            self.name = (at, _NAME_REST.match(self.page, at).end())
        return self.name[1]

    def end(self, at: int) -> int:
        """The place of the > that ends a tag whose name ends at ``at``; -1 if there is none."""
        if at > self.last[">"]:
            return -1
        if not self.first[0] <= at <= self.first[1]:
            self.first = (at, _STOP.search(self.page, at).start())
        stop, passed = self.first[1], []
        while self.page[stop] != ">":
            passed.append(stop)
            if stop in self.dead or self.last[self.page[stop]] <= stop:
                break
            found = _STOP.search(self.page, self.page.find(self.page[stop], stop + 1) + 1)
            if not found:
                break
            stop = found.start()
        else:
            return stop
        self.dead.update(passed)
        return -1


def parse(page: str) -> tuple[list[Node], list[str], list[int]]:
    """Nodes in page order (the root first), the texts of blocks, and each block's node."""
    nodes = [Node("html", [], -1, 0, False)]
    stack: list[tuple[str, int]] = [("html", 0)]
    texts: list[str] = []
    owners: list[int] = []
    run: list[str] = []
    run_linked = links = silent = 0

    def close_run() -> None:
        nonlocal run, run_linked
        if run:
            text = " ".join(html_lib.unescape("".join(run)).split())
            if text:
                node = nodes[stack[-1][1]]
                node.blocks.append(len(texts))
                node.chars += len(text)
                node.linked += min(run_linked, len(text))
                node.stops += text.count(".") + text.count(",")
                owners.append(stack[-1][1])
                texts.append(text)
            run, run_linked = [], 0

    def pop_to(depth: int) -> None:
        nonlocal links, silent
        if any(t in BLOCKS for t, _ in stack[depth:]):
            close_run()
        for t, _ in stack[depth:]:
            open_names[t] -= 1
            links -= t == "a"
            silent -= t in SILENT
        del stack[depth:]

    def add_text(piece: str) -> None:
        nonlocal run_linked
        if not silent:
            run.append(piece)
            run_linked += len(piece) if links else 0

    at, tags, open_names = 0, Tags(page), Counter(["html"])
    while at < len(page):
        if page[at] != "<":
            end = page.find("<", at)
            end = end if end >= 0 else len(page)
            add_text(page[at:end])
            at = end
            continue
        if skipped := _SKIPPED.match(page, at):
            at = skipped.end()
            continue
        start = _TAG_START.match(page, at)
        named = tags.name_end(start.end()) if start else -1
        end = tags.end(named) if start else -1
        if end < 0:
            # Behind the last > nothing but a comment is left to find.
            end = at + 1 if at < tags.last[">"] else min((i for i in (page.find("<!", at), page.find("<?", at)) if i > at), default=len(page))
            add_text(page[at:end])
            at = end
            continue
        name, closed = page[start.end() : named], end > named and page[end - 1] == "/"
        attributes, at = page[named : end - closed], end + 1
        name = name.lower()
        if start[1]:
            if not open_names[name]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
                # An end tag does not reach out of a block it was not opened in, nor a block's out of an article's.
                if name not in BLOCKS and stack[i][0] in BLOCKS:
                    break
            continue
        nodes[stack[-1][1]].tags += 1
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(page, at)
            at = end.start() if end else len(page)
            if end:
                at = page.find(">", at) + 1 or len(page)
            continue
        if name == "br":
            run.append(" ")
            continue
        if name in VOID and name != "hr":
            continue
        if name in ("html", "body") and open_names[name]:
            continue
        if name in BLOCKS:
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i][0]
                if t == "p" or t in _CLOSES.get(name, ()):
                    pop_to(i)
                    break
                if t in BLOCKS and not (name == "tr" and t in ("td", "th")):
                    break
            close_run()
            if name == "hr":
                continue
            words = [_WORDS[w] for a in _ATTRIBUTE.findall(attributes) for w in _WORD.findall("".join(a).lower()) if w in _WORDS]
            parent = stack[-1][1]
            nodes.append(Node(name, words, parent, nodes[parent].depth + 1, silent > 0, len(nodes[parent].children)))
            nodes[parent].children.append(len(nodes) - 1)
            if not closed:
                stack.append((name, len(nodes) - 1))
                open_names[name] += 1
        elif not closed:
            stack.append((name, stack[-1][1]))
            open_names[name] += 1
            links += name == "a"
            silent += name in SILENT
    pop_to(0) if len(stack) else None
    stack = [("html", 0)]
    close_run()
    return nodes, texts, owners


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node."""
    n, kinds = len(nodes), len(ATTRIBUTE_WORDS)
    chars, linked, tags, stops, paragraphs, size = (np.zeros(n) for _ in range(6))
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        chars[i] += node.chars
        linked[i] += node.linked
        tags[i] += node.tags
        stops[i] += node.stops
        paragraphs[i] += node.tag == "p"
        size[i] += 1
        if node.parent >= 0:
            for total in (chars, linked, tags, stops, paragraphs, size):
                total[node.parent] += total[i]
    alike = Counter((node.parent, node.tag) for node in nodes)
    out = np.zeros((n, OTHER_TAG + 1 + 2 * kinds + 18), np.float32)
    above = np.zeros((n, kinds + 5), np.float32)
    for i, node in enumerate(nodes):
        row, group = out[i], TAG_GROUPS.get(node.tag, OTHER_TAG)
        row[group] = 1
        at = OTHER_TAG + 1
        for w in node.words:
            row[at + w] = 1
        if node.parent >= 0:
            p = nodes[node.parent]
            above[i] = above[node.parent]
            for w in p.words:
                above[i, w] = 1
            parent_group = TAG_GROUPS.get(p.tag, OTHER_TAG)
            if parent_group < 4:
                above[i, kinds + parent_group] = 1
            if parent_group == 6:
                above[i, kinds + 4] = 1
            siblings = len(p.children)
            row[-1] = siblings
            row[-2] = node.place / siblings
            row[-3] = chars[i] / max(1.0, chars[node.parent])
            row[-4] = np.log1p(p.chars)
            row[-5] = alike[node.parent, node.tag] / siblings
        row[at + kinds : at + 2 * kinds] = above[i, :kinds]
        row[at + 2 * kinds : at + 2 * kinds + 5] = above[i, kinds:]
        row[-6] = min(node.depth, 12)
        row[-7] = np.log1p(chars[i])
        row[-8] = linked[i] / max(1.0, chars[i])
        row[-9] = chars[i] / (tags[i] + size[i])
        row[-10] = stops[i] / max(1.0, chars[i])
        row[-11] = paragraphs[i]
        row[-12] = chars[i] / max(1.0, chars[0])
        row[-13] = len(node.children)
    return out


class BoostedTrees:
    """Logistic boosting of depth-limited trees over binned features."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 24):
        self.n, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        coded = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
        chance = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(chance / (1 - chance)))
        score = np.full(len(y), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            leaf = np.zeros(len(y), np.int64)
            feature, limit = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best = np.full(count, 1e-3)
                choice = [None] * count
                for f, codes in enumerate(coded):
                    if not len(cuts[f]):
                        continue
                    width = len(cuts[f]) + 1
                    cell = leaf * width + codes
                    g = np.bincount(cell, grad, count * width).reshape(count, width).cumsum(1)
                    h = np.bincount(cell, hess, count * width).reshape(count, width).cumsum(1)
                    total_g, total_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                    gain[(h < 1) | (total_h - h < 1)] = 0
                    k = gain[:, :-1].argmax(1)
                    top = gain[np.arange(count), k]
                    for j in np.flatnonzero(top > best):
                        best[j], choice[j] = top[j], (f, cuts[f][k[j]])
                for j, c in enumerate(choice):
                    if c:
                        feature[first + j], limit[first + j] = c
                here = first + leaf
                leaf = 2 * leaf + (x[np.arange(len(y)), feature[here]] > limit[here])
            g, h = np.bincount(leaf, grad, 2**self.depth), np.bincount(leaf, hess, 2**self.depth)
            value = self.rate * g / (h + 1)
            self.trees.append((feature, limit, value))
            score += value[leaf]
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                here = 2**level - 1 + leaf
                leaf = 2 * leaf + (x[rows, feature[here]] > limit[here])
            out += value[leaf]
        return out


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The most likely labelling in which everything under a dropped node is dropped."""
    keep = -np.logaddexp(0, -odds)
    drop = -np.logaddexp(0, odds)
    kept, dropped = keep.copy(), drop.copy()
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        kept[p] += -np.inf if nodes[p].hidden else max(kept[i], dropped[i])
        dropped[p] += dropped[i]
    chosen = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        above = node.parent < 0 or chosen[node.parent]
        chosen[i] = above and not node.hidden and (node.parent < 0 or kept[i] >= dropped[i])
    return chosen


_DROPPED = {"nav": "menu", "aside": "side", "footer": "foot", "header": "head", "form": "form", "menu": "menu", "dialog": "notice"}
_MADE = ("menu", "side", "ad", "notice", "foot", "head", "talk", "form")


def weak_labels(nodes: list[Node]) -> np.ndarray:
    """1 for main text, as semantic elements and telling attributes have it: boilerplate stays so below."""
    names = list(ATTRIBUTE_WORDS)
    out = np.zeros(len(nodes))
    inside = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        bad = node.tag in _DROPPED or any(names[w] != "main" for w in node.words)
        above = node.parent < 0 or out[node.parent]
        inside[i] = node.tag in ("article", "main") or any(names[w] == "main" for w in node.words)
        inside[i] |= node.parent >= 0 and inside[node.parent]
        # Text outside of any article on a page that has one is not main text either; what holds an article is.
        out[i] = above and not bad and not node.hidden
    has_article = any(n.tag in ("article", "main") for n in nodes)
    if has_article:
        holds = inside.copy()
        for i in range(len(nodes) - 1, 0, -1):
            holds[nodes[i].parent] |= holds[i]
        out *= inside | holds
    return out


def varied(page: str, spare: list[str], rng: random.Random) -> str:
    """A page with other elements for the same roles and with boilerplate of other pages' text put in."""

    def block(kind: str) -> str:
        word = rng.choice(ATTRIBUTE_WORDS[kind].split())
        tag = rng.choice(["div", "section", {"menu": "nav", "side": "aside", "foot": "footer", "head": "header", "form": "form"}.get(kind, "div")])
        name = f"{rng.choice(['class', 'id'])}=\"{rng.choice(['', 'x-', 'c '])}{word}{rng.choice(['', '-wrap', ' box'])}\""
        text = html_lib.escape(rng.choice(spare))
        if kind in ("menu", "side") and rng.random() < 0.6:
            words = text.split()[:30]
            inner = "<ul>" + "".join(f'<li><a href="#">{" ".join(words[i : i + 2])}</a></li>' for i in range(0, len(words), 2)) + "</ul>"
        elif kind == "form":
            inner = f"<label>{text[:40]}</label><input><p>{text[40:140]}</p>"
        else:
            inner = "".join(f"<p>{t}</p>" for t in rng.sample([text, text[: len(text) // 2], text[:60]], rng.randint(1, 3)))
        return f"<{tag} {name}>{inner}</{tag}>"

    swap = rng.random()
    if swap < 0.7:
        name = "main" if swap < 0.15 else "div"
        opening = f"<{name}>" if name == "main" else f'<div class="{rng.choice(ATTRIBUTE_WORDS["main"].split())}{rng.choice(["", "-area", " wide"])}">'
        page = page.replace("<article>", opening).replace("</article>", f"</{name}>")
    for tag, kind in (("nav", "menu"), ("footer", "foot")):
        if rng.random() < 0.5:
            word = rng.choice(ATTRIBUTE_WORDS[kind].split())
            page = page.replace(f"<{tag}>", f'<div class="{word}">').replace(f"</{tag}>", "</div>")
    ends = [m.end() for m in re.finditer("</p>|</h1>", page)]
    for kind in rng.sample(_MADE, rng.randint(1, 4)):
        body = re.search("<body[^>]*>", page)
        places = [p for p in (body.end() if body else None, page.rfind("</body>"), ends and rng.choice(ends)) if p and p > 0]
        at = rng.choice(places) if places else len(page)
        made = block(kind)
        page = page[:at] + made + page[at:]
        ends = [m.end() for m in re.finditer("</p>|</h1>", page)]
    return page


def fit(pages: list[str], seed: int = 7) -> BoostedTrees:
    """The model of a bounded sample of pages, in the order given; there must be one."""
    if not pages:
        raise ValueError("no page to fit on")
    rng = random.Random(seed)
    parsed = [parse(p) for p in pages]
    spare = [t for _, texts, _ in parsed for t in texts if len(t) > 20] or ["A short line of text to read, made up."]
    x, y = [], []
    for page in pages:
        for version in (page, varied(page, spare, rng), varied(page, spare, rng), varied(page, spare, rng)):
            nodes, _, _ = parse(version)
            x.append(features(nodes))
            y.append(weak_labels(nodes))
    return BoostedTrees().fit(np.concatenate(x), np.concatenate(y))


def main_text(page: str, model: BoostedTrees) -> str:
    nodes, texts, owners = parse(page)
    chosen = decode(nodes, model.scores(features(nodes)))
    return "\n".join(t for t, o in zip(texts, owners, strict=True) if chosen[o])


def sampled(pages: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES, most: int = SAMPLE_CHARS) -> list[str]:
    """The different pages of least hash, ``sample`` of them at most and together of ``most`` characters.

    Copies count once. A page of any length may be among them; one that does not fit beside
    those before it gives way to the next, and if none fits, the shortest is taken.
    """
    texts = pages.select(F.col(html).cast("string").alias("html")).where(F.length("html") > 0).withColumn("h", F.xxhash64("html"))
    # Copies meet as two numbers each; the pages themselves are only read for those chosen.
    heads = texts.select("h", F.length("html").alias("n")).distinct().orderBy("h", "n").limit(sample).collect()
    chosen, left = [], most
    for r in heads:
        if r.n <= left:
            chosen.append(r.h)
            left -= r.n
    if heads and not chosen:
        chosen = [min(heads, key=lambda r: r.n).h]
    rows = texts.where(F.col("h").isin(chosen)).distinct().orderBy("h", "html").collect() if chosen else []
    return [r.html for r in rows]


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), sample: int = SAMPLE_PAGES) -> DataFrame:
    """``keep`` columns and ``text``, the main text of each whole page; blocks are joined by line feeds.

    A null, empty or text-less page has the empty text. Markup that never closes is taken
    as it stands. Equal pages give equal texts. A kept column named ``text`` gives way. The
    model is fitted on ``sample`` different pages, those with the least hashes, of SAMPLE_CHARS
    characters together. If no page has a character, all texts are empty and nothing is fitted.
    """
    keep = tuple(k for k in keep if k != "text")
    found = sampled(pages, html, sample)
    if not found:
        return pages.select(*keep, F.lit("").alias("text"))
    model = fit(found)
    schema = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, len(keep), 1 << 20):
                parsed = [parse(p or "") for p in part.column(len(keep)).to_pylist()]
                scored = model.scores(np.concatenate([features(nodes) for nodes, _, _ in parsed]))
                out, at = [], 0
                for nodes, texts, owners in parsed:
                    chosen = decode(nodes, scored[at : at + len(nodes)])
                    at += len(nodes)
                    out.append("\n".join(t for t, o in zip(texts, owners, strict=True) if chosen[o]))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(out, pa.string())], [*keep, "text"])

    return pages.select(*keep, F.col(html).cast("string").alias("_html_")).mapInArrow(run, f"{schema}, text string")
