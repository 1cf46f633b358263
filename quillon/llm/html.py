"""Main-text extraction by gradient-boosted trees over DOM nodes.

A page becomes a tree of elements. Each element has features (text and link
density of its subtree, words of its class and id, tag, depth, position among its
siblings); boosted trees give the log-odds that it belongs to the main text. Then
the best consistent choice is decoded from the leaves up: what lies in a dropped
element is dropped, and what is kept has kept ancestors, so no element contradicts
its ancestors or descendants.

The trees are fitted on pages generated here, whose elements' classes are known.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_columns, map_arrow, slices, table

#: A tag; a quoted value ends where white space, a slash or the tag's end follows its quote.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*+)>")
#: A tag with broken quotes ends at the next angle bracket.
_BROKEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>?")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag of the first kind ends open elements of the second, up to the nearest of the third.
_ENDS: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "td", "blockquote", "pre", "nav", "header", "footer", "aside", "form", "figure", "head", "script", "style", "noscript", "button", "select", "iframe", "template", "title", "a")
#: Attribute tokens, stem by stem, in groups that are one feature each.
GROUPS: dict[str, tuple[str, ...]] = {
    "content": ("article", "content", "post", "entry", "story", "main", "body", "text", "prose"),
    "menu": ("nav", "menu", "breadcrumb", "pagination", "pager", "toc", "tabs"),
    "edge": ("header", "footer", "masthead", "banner", "copyright", "legal"),
    "side": ("sidebar", "aside", "related", "widget", "rail", "recommend", "trending", "popular"),
    "notice": ("cookie", "notice", "consent", "popup", "modal", "alert", "newsletter", "subscribe", "paywall", "gdpr"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promoted", "adsense"),
    "comment": ("comment", "comments", "disqus", "reply", "replies", "discussion", "respond"),
    "share": ("share", "sharing", "social", "follow", "login", "signup", "search", "form", "print", "tools"),
    "about": ("author", "bio", "byline", "avatar", "tags", "tagged", "categories", "meta"),
}
#: Groups that name boilerplate: an inline element that bears one has a verdict of its own.
_OFF = frozenset(g for g in GROUPS if g != "content")
_ROLE = {"navigation": "menu", "banner": "edge", "contentinfo": "edge", "complementary": "side", "search": "share", "main": "content", "article": "content", "dialog": "notice", "alert": "notice"}


@dataclass
class Node:
    tag: str
    attributes: str = ""
    parent: int = -1
    depth: int = 0
    children: list[int] = field(default_factory=list)
    #: What stands in the element in page order: texts, and numbers of its element children.
    parts: list = field(default_factory=list)


def parse(page: str) -> list[Node]:
    """The page's elements in page order; the first is the root. Never fails: odd markup is text or ignored."""
    nodes = [Node("#root")]
    stack = [0]
    opened: dict[str, int] = {}  # how many elements of a tag are open
    at, n, last = 0, len(page), page.rfind(">")

    def text(s: str) -> None:
        if s:
            nodes[stack[-1]].parts.append(_html.unescape(s) if "&" in s else s)

    def close(until: int) -> None:
        for k in stack[until:]:
            opened[nodes[k].tag] -= 1
        del stack[until:]

    def until(mark: str, begin: int) -> tuple[int, int]:
        """Where a section ends and where the page goes on."""
        end = page.find(mark, begin)
        return (n, n) if end < 0 else (end, end + len(mark))

    while at < n:
        begin = page.find("<", at) if at <= last else -1
        if begin < 0:
            text(page[at:])
            break
        text(page[at:begin])
        if page.startswith("<!--", begin):
            at = until("-->", begin + 4)[1]
            continue
        if page.startswith("<![CDATA[", begin):
            end, at = until("]]>", begin + 9)
            text(page[begin + 9 : end])
            continue
        if page[begin + 1] in "!?":
            at = until(">", begin)[1]
            continue
        m = _TAG.match(page, begin) or _BROKEN.match(page, begin)
        if m is None:
            text("<")
            at = begin + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if opened.get(name):
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == name:
                        close(k)
                        break
                    if name in _INLINE and nodes[stack[k]].tag not in _INLINE:
                        break  # an inline end tag doesn't end a block
            continue
        if name in _ENDS:
            ended, within = _ENDS[name]
            if any(opened.get(t) for t in ended):
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag in within:
                        break
                    if nodes[stack[k]].tag in ended:
                        close(k)
                        break
        elif name in _ENDS_P and opened.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                tag = nodes[stack[k]].tag
                if tag == "p":
                    close(k)
                    break
                if tag not in _INLINE:
                    break
        parent = stack[-1]
        nodes.append(Node(name, m[3], parent, len(stack)))
        me = len(nodes) - 1
        nodes[parent].children.append(me)
        nodes[parent].parts.append(me)
        if name in _RAW:
            end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, at)
            nodes[me].parts.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif name not in _VOID and not m[3].rstrip().endswith("/"):
            stack.append(me)
            opened[name] = opened.get(name, 0) + 1
    return nodes


FEATURES = ["depth", "log_chars", "log_words", "link_share", "markup", "stops", "own_text", "children", "position", "siblings", "share_of_page", "share_of_parent", "same_tag_siblings", "paragraphs", "paragraphs_beside", "inline", *(f"tag_{t}" for t in TAGS), *(f"own_{g}" for g in GROUPS), *(f"above_{g}" for g in GROUPS), "hidden"]
_AT = {n: i for i, n in enumerate(FEATURES)}
_TAG_AT = {t: _AT[f"tag_{t}"] for t in TAGS}
_GROUP_NAMES = tuple(GROUPS)
_WORD_GROUP = {w: i for i, ws in enumerate(GROUPS.values()) for w in ws}


def _groups(attributes: str) -> tuple[set[int], bool]:
    found, hidden = set(), False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "itemprop", "aria-label", "data-component"):
            for word in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value)):
                for w in (word, word.removesuffix("s")):
                    if w in _WORD_GROUP:
                        found.add(_WORD_GROUP[w])
        elif name == "role" and value in _ROLE:
            found.add(_GROUP_NAMES.index(_ROLE[value]))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return found, hidden


def features(nodes: list[Node]) -> np.ndarray:
    """One row of FEATURES per element; subtree sums from the last element to the first."""
    n = len(nodes)
    out = np.zeros((n, len(FEATURES)), np.float32)
    chars, words, links, stops, tags, paragraphs, own = ([0] * n for _ in range(7))
    groups: list[set[int]] = [set()] * n
    above: list[set[int]] = [set()] * n
    for i, v in enumerate(nodes):
        hidden = False
        if v.attributes:
            groups[i], hidden = _groups(v.attributes)
        if i:
            above[i] = above[v.parent] | groups[v.parent]
        row = out[i]
        row[_AT["hidden"]] = hidden
        row[_AT["depth"]] = v.depth
        row[_AT["inline"]] = v.tag in _INLINE
        if v.tag in _TAG_AT:
            row[_TAG_AT[v.tag]] = 1
        for g in groups[i]:
            row[_AT[f"own_{_GROUP_NAMES[g]}"]] = 1
        for g in above[i]:
            row[_AT[f"above_{_GROUP_NAMES[g]}"]] = 1
    for i in range(n - 1, -1, -1):
        v = nodes[i]
        if v.tag not in ("script", "style"):
            for part in v.parts:
                if isinstance(part, str):
                    own[i] += len(part)
                    words[i] += part.count(" ") + 1
                    stops[i] += part.count(".") + part.count(",")
        chars[i] += own[i]
        if v.tag == "a":
            links[i] = chars[i]
        paragraphs[i] += v.tag == "p"
        if i:
            p = v.parent
            for sums in (chars, words, links, stops, paragraphs):
                sums[p] += sums[i]
            tags[p] += tags[i] + 1
    page = max(1, chars[0])
    for i, v in enumerate(nodes):
        row, c = out[i], chars[i]
        row[_AT["log_chars"]], row[_AT["log_words"]] = np.log1p(c), np.log1p(words[i])
        row[_AT["link_share"]] = links[i] / max(1, c)
        row[_AT["markup"]] = tags[i] / max(1, words[i])
        row[_AT["stops"]] = stops[i] / max(1, words[i])
        row[_AT["own_text"]] = own[i] / max(1, c)
        row[_AT["children"]] = len(v.children)
        row[_AT["share_of_page"]] = c / page
        row[_AT["paragraphs"]] = np.log1p(paragraphs[i])
        if i:
            row[_AT["share_of_parent"]] = c / max(1, chars[v.parent])
            row[_AT["paragraphs_beside"]] = np.log1p(paragraphs[v.parent] - paragraphs[i])
        alike: dict[str, int] = {}
        for k in v.children:
            alike[nodes[k].tag] = alike.get(nodes[k].tag, 0) + 1
        for rank, k in enumerate(v.children):
            out[k, _AT["position"]] = rank / max(1, len(v.children) - 1)
            out[k, _AT["siblings"]] = np.log1p(len(v.children) - 1)
            out[k, _AT["same_tag_siblings"]] = np.log1p(alike[nodes[k].tag] - 1)
    return out


# -- boosted trees


@dataclass
class Trees:
    """Boosted regression trees of fixed depth: for each tree the features and cuts of its inner nodes, then its leaves."""

    base: float
    feature: np.ndarray  # trees, 2**depth - 1
    cut: np.ndarray
    leaf: np.ndarray  # trees, 2**depth

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base, np.float32)
        each = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            while at[0] < inner if len(at) else False:
                at = 2 * at + 1 + (x[each, f[at]] > c[at])
            out += leaf[at - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Gradient boosting of logistic loss with histogram splits and Newton leaves, a level of nodes at a time.

    Features of two values are summed by a matrix product, the others by histograms.
    """
    n, count = x.shape
    two = np.array([np.isin(x[:, j], (0, 1)).all() for j in range(count)])
    flags, rest = np.flatnonzero(two), np.flatnonzero(~two)
    flag = np.ascontiguousarray(x[:, flags], np.float64)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in rest]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in zip(rest, cuts)], axis=1)
    usable = np.stack([np.arange(bins - 1) < len(c) for c in cuts])  # cuts of a feature
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1), np.float32)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            own = at - first
            whole = [np.bincount(own, v, width) for v in (grad, hess)]
            on = [np.stack([(v * (own == k)) @ flag for k in range(width)]) for v in (grad, hess)]  # sums where the flag is set
            place = ((own[:, None] * len(rest) + np.arange(len(rest))) * bins + code).ravel()
            low = [np.bincount(place, np.repeat(v, len(rest)), width * len(rest) * bins).reshape(width, len(rest), bins).cumsum(axis=2)[:, :, :-1] for v in (grad, hess)]
            # left sums: flags that are not set, bins up to a cut
            left = [np.concatenate([w[:, None] - o, l.reshape(width, -1)], axis=1) for w, o, l in zip(whole, on, low)]
            right = [w[:, None] - l for w, l in zip(whole, left)]
            value = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - (whole[0] ** 2 / (whole[1] + ridge))[:, None]
            value[:, len(flags) :][:, ~usable.ravel()] = 0.0
            best = value.argmax(axis=1)
            for k in range(width):
                node, rows = first + k, np.flatnonzero(own == k)
                if value[k, best[k]] <= 1e-6:
                    at[rows] = 2 * node + 1
                elif best[k] < len(flags):
                    feature[t, node], cut[t, node] = flags[best[k]], 0.0
                    at[rows] = 2 * node + 1 + (flag[rows, best[k]] > 0)
                else:
                    j, c = divmod(int(best[k]) - len(flags), bins - 1)
                    feature[t, node], cut[t, node] = rest[j], cuts[j][c]
                    at[rows] = 2 * node + 1 + (code[rows, j] > c)
        sums = [np.bincount(at - inner, v, inner + 1) for v in (grad, hess)]
        leaf[t] = rate * sums[0] / (sums[1] + ridge)
        score += leaf[t][at - inner]
    return Trees(base, feature, cut, leaf)


# -- training pages


def training_pages(pages: int = 900, seed: int = 11) -> list[str]:
    """Generated pages whose elements of the main text carry the attribute ``k="1"``, all others ``k="0"``.

    Layouts, tags and class names vary; some boilerplate is long prose and some
    main text is short, so that length alone doesn't tell.
    """
    rng = random.Random(seed)
    pick = lambda *x: x[int(rng.random() * len(x))]
    some = lambda lo, hi: lo + int(rng.random() * (hi - lo))

    def word() -> str:
        return "".join(pick("b", "k", "d", "f", "gl", "m", "p", "st", "v", "w") + pick("a", "e", "i", "o", "u", "ea", "ö") for _ in range(some(1, 4)))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() + pick("", "", "", "", "", "", ",", ".", "?", "&nbsp;") for _ in range(some(lo, hi)))

    def element(tag: str, inner: str, keep: int, attributes: str = "") -> str:
        return f'<{tag} k="{keep}"{attributes}>{inner}</{tag}>'

    def named(*names: str) -> str:
        return f' {pick("class", "id")}="{pick("", "box ", "wrap-")}{pick(*names)}{pick("", "", "-1", " clear")}"'

    def unseen() -> str:
        return pick(" hidden", ' style="display:none"', ' aria-hidden="true"')

    def links(keep: int = 0) -> str:
        return element(pick("ul", "ul", "div"), "".join(element("li", element("a", words(1, 4), keep, ' href="/x"'), keep) for _ in range(some(2, 9))), keep)

    def prose(keep: int) -> str:
        out = []
        for _ in range(some(1, 9) if keep else some(1, 4)):
            inner = pick(words(1, 6), words(3, 25), words(1, 120 if keep else 60))
            if rng.random() < 0.3:
                inner = element(pick("b", "em", "a", "span"), inner, keep, named("highlight", "x", "post-link", "term") * int(rng.random() < 0.2)) + " " + words(1, 20)
            elif rng.random() < 0.15:  # all of it in one inline element
                inner = element(pick("b", "strong", "em", "i"), inner + "<br>" * int(rng.random() < 0.5), keep)
            if keep and rng.random() < 0.08:  # an advert in the middle of a sentence
                inner = words(1, 12) + element(pick("span", "a", "em", "small"), words(1, 8), 0, unseen() if rng.random() < 0.2 else named("ad", "ads", "sponsored", "promo", "advert", "share", "newsletter-signup", "related")) + words(1, 12)
            if keep and rng.random() < 0.14:  # a line or a box that is none of the post's text
                line = pick("share", "social", "sharing", "ad", "sponsored", "newsletter", "related", "tags", "byline", "author-box", "print-tools", "comment-count")
                out.append(element(pick("p", "p", "div", "aside"), pick(words(1, 9), element("p", words(3, 30), 0), links()), 0, unseen() if rng.random() < 0.1 else named(line)))
            out.append(element(pick("p", "p", "p", "p", "blockquote", "pre", "h2", "h3"), inner, keep))
        if keep and rng.random() < 0.25:
            out.append(element(pick("ul", "ol"), "".join(element("li", words(2, 30), keep) for _ in range(some(2, 6))), keep))
        if keep and rng.random() < 0.1:
            out.append(element("table", "".join(element("tr", element("td", words(1, 8), keep) * 2, keep) for _ in range(some(1, 5))), keep))
        return "".join(out)

    def boilerplate() -> str:
        kind = some(0, 8)
        if kind == 0:
            return element("nav", links(), 0) if rng.random() < 0.6 else element("div", links(), 0, named("nav", "menu", "main-menu", "breadcrumbs", "site-nav"))
        if kind == 1:
            return element(pick("aside", "div", "section"), pick(links(), prose(0)), 0, named("sidebar", "related", "widget", "popular-posts", "right-rail"))
        if kind == 2:
            return element(pick("div", "section", "aside"), pick(words(2, 40), prose(0)), 0, named("ad", "ads", "advert", "sponsored", "promo"))
        if kind == 3:
            return element("div", pick(words(5, 50), prose(0)) + element("button", words(1, 3), 0), 0, named("cookie-notice", "consent", "newsletter", "popup", "alert"))
        if kind == 4:
            return element("form", words(1, 10) + '<input name="q">' + element("button", words(1, 2), 0), 0, named("search", "login", "signup-form"))
        if kind == 5:
            return element(pick("div", "section"), element("h3", words(1, 4), 0) + "".join(element("div", prose(0), 0, named("comment", "reply")) for _ in range(some(1, 5))), 0, named("comments", "discussion", "disqus-thread", "respond"))
        if kind == 6:
            return element("div", links(), 0, named("share", "social", "follow-us", "tools"))
        return element(pick("script", "style", "noscript"), words(3, 40), 0)

    out = []
    for _ in range(pages):
        body = element("h1", words(1, 12), 1) * int(rng.random() < 0.8) + prose(1)
        if rng.random() < 0.35:
            body += boilerplate() + (prose(1) if rng.random() < 0.5 else "")
        wrapper = some(0, 8)
        if rng.random() < 0.15:  # a short one
            body = element(pick("p", "p", "div"), words(1, 6), 1)
        if wrapper >= 5:  # the text in a plain block, or beside a menu in a table that makes the layout
            if rng.random() < 0.5:
                main = element("div", body, 1, named("x1", "c2", "block", "inner") * int(rng.random() < 0.7))
            else:
                side = pick(links, lambda: words(1, 3), lambda: element("br", "", 0).join(element("a", words(1, 3), 0, ' href="/y"') for _ in range(some(1, 6))), boilerplate)
                menu = element("td", side(), 0, named("leftnav", "menu", "x", "side") * int(rng.random() < 0.5) + pick("", ' width="120"', ' valign="top"'))
                text = element("td", pick(body, element("font", body, 1)), 1, named("story-text", "content", "x") * int(rng.random() < 0.4))
                row = element("tr", pick(menu + text, text + menu, menu + text + menu), 1)
                banner = element("tr", element("td", words(1, 5), 0, ' colspan="2"'), 0) * int(rng.random() < 0.5)
                main = element("table", banner + row, 1, pick("", ' border="0"', ' width="100%"'))
        elif wrapper == 0:
            main = element("article", body, 1)
        elif wrapper == 1:
            main = element("main", element("article", body, 1), 1)
        elif wrapper == 2:
            main = element("div", body, 1, named("content", "post", "article-body", "entry-content", "story", "main-text"))
        else:
            main = element("main", element("div", body, 1, named("content", "post-body", "x")), 1)
        if rng.random() < 0.3:
            main = element("div", pick(boilerplate() + main, main + boilerplate(), main), 1, named("wrapper", "container", "page", "row"))
        bare = rng.random() < 0.15  # nothing but the article
        before = "" if bare else "".join(boilerplate() for _ in range(some(0, 4)))
        after = "" if bare else "".join(boilerplate() for _ in range(some(0, 4)))
        top = element(pick("header", "div"), words(1, 12) + links() * int(rng.random() < 0.5), 0, named("header", "masthead", "site-header", "banner")) * int(rng.random() < 0.5)
        low = (element("footer", words(2, 40), 0) if rng.random() < 0.6 else element("div", words(2, 40), 0, named("footer", "copyright", "legal"))) * int(rng.random() < 0.8)
        head = element("head", element("title", words(1, 12), 0) + element("style", f".{word()} {{ color: {word()} }}", 0) * int(rng.random() < 0.7) + element("script", f'var {word()} = "{words(1, 9)}"', 0) * int(rng.random() < 0.7), 0)
        if bare and rng.random() < 0.5:  # a fragment of a page
            out.append(main)
            continue
        out.append(f'<!DOCTYPE html><html k="1">{head}<body k="1">{top}{before}{main}{after}{low}' + "</body></html>" * int(rng.random() < 0.9))
    return out


_model: list[Trees] = []


def model() -> Trees:
    """The fitted trees; fitted once per Python process, always the same."""
    if not _model:
        xs, ys = [], []
        for page in training_pages():
            nodes = parse(page)
            label = np.array([0 if 'k="0"' in v.attributes else 1 if 'k="1"' in v.attributes else -1 for v in nodes])
            x = features(nodes)
            xs.append(x[label >= 0])
            ys.append(label[label >= 0])
        _model.append(fit_trees(np.concatenate(xs), np.concatenate(ys).astype(float)))
    return _model[0]


def decode(nodes: list[Node], log_odds: np.ndarray) -> np.ndarray:
    """Which elements are kept: the choice of greatest log-likelihood in which no kept element lies in a dropped one."""
    n = len(nodes)
    yes, no = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    drop, keep = no.tolist(), yes.tolist()
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        drop[p] += drop[i]
        keep[p] += max(drop[i], keep[i])
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[nodes[i].parent] and keep[i] > drop[i]
    return kept


def follow_block(nodes: list[Node], odds: np.ndarray) -> None:
    """Inline elements have the odds of what they stand in, unless their own attributes name boilerplate or hide them."""
    for i, v in enumerate(nodes):
        if v.tag in _INLINE and v.parent > 0:
            found, hidden = _groups(v.attributes) if v.attributes else ((), False)
            if not hidden and not any(_GROUP_NAMES[g] in _OFF for g in found):
                odds[i] = odds[v.parent]


def blocks(nodes: list[Node], kept: np.ndarray) -> list[str]:
    """Texts of the kept blocks in page order: white space to one space, empty ones left out."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    todo: list = [(0, 0)]
    while todo:
        i, k = todo.pop()
        v = nodes[i]
        if k == 0 and v.tag not in _INLINE and v.tag != "br":
            end()
        while k < len(v.parts):
            part = v.parts[k]
            k += 1
            if isinstance(part, str):
                line.append(part)
            elif nodes[part].tag == "br":
                line.append(" ")
            elif kept[part] and nodes[part].tag not in ("script", "style"):
                todo.append((i, k))
                todo.append((part, 0))
                break
        else:
            if v.tag not in _INLINE and v.tag != "br":
                end()
    end()
    return out


def extract(pages: list[str | None], trees: Trees | None = None) -> list[str]:
    """Main text of each page; features of all pages are scored together."""
    trees = trees or model()
    parsed = [parse(p) if p else [] for p in pages]
    xs = [features(nodes) for nodes in parsed if nodes]
    if not xs:
        return [""] * len(pages)
    odds, at, out = trees.log_odds(np.concatenate(xs)), 0, []
    for nodes in parsed:
        if nodes:
            own = odds[at : at + len(nodes)].astype(np.float64)
            at += len(nodes)
            follow_block(nodes, own)
            own[0] = 50.0
            out.append("\n".join(blocks(nodes, decode(nodes, own))))
        else:
            out.append("")
    return out


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default page_id, url), then text string: the main text of the whole page.

    Null, empty and textless pages give an empty text; rows that repeat are extracted
    each. Other columns are not read; an empty table gives an empty result; of ``keep``,
    a column named text is left out.
    """
    keep = kept_columns(keep or ["page_id", "url"], ["text"])
    shared = pages.sparkSession.sparkContext.broadcast(model())
    rows = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(html_col).alias("_page_html"))
    schema = pages.select(*(F.col(f"`{c}`") for c in keep)).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *kept, html in slices(batch, batch.schema.names, 2 << 20, 256):
                yield pa.RecordBatch.from_arrays([*kept, pa.array(extract(html.to_pylist(), shared.value), pa.string())], names=schema.names)

    return map_arrow(rows, run, schema)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: page_id, url, text string, n_chars long.

    Null and empty pages have an empty text of 0 characters; repeated rows are
    extracted each; an empty table gives an empty result; other columns are not read.
    """
    texts = extract_main_text(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
