"""Main text of web pages: flat text blocks, classified by a decision tree over their neighbourhood."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import labelled_pages
from textloom.runtime import small_batches

# HTML's element names by what they mean here.
_SILENT = "noscript template svg canvas object select audio video dialog head"
_RAW = "script style textarea iframe title xmp"
_BLOCK = "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption"
_HOLDERS = "nav header footer aside form article main section div ul ol dl table td figure fieldset menu details blockquote"
_STICKY = "nav footer aside menu form fieldset"
# Words of class, id and role attributes that hint at a container that is not the article, that are of no account, or that hint at the article.
_AROUND = "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay newsletter subscribe subscription signup login signin register share sharing social follow sidebar sidebars side aside widget widgets related recommend recommended recommendations trending popular nav navbar navigation navs menu menus breadcrumb breadcrumbs footer foot header masthead topbar toolbar copyright disclaimer pagination pager paging search searchbox form feedback contentinfo complementary skip tags comment comments reply replies respond discussion remarks responses"
_ANY = "bar box block inner outer wrap wrapper container list item items area section group top bottom left right main site page row col link links buttons text module slot unit the"
_INSIDE = "article content post entry story main articlebody maincontent body bodytext prose text"
# Words that notices, forms and remarks are full of.
_CUES = "advertisement sponsored subscribe subscribers unsubscribe newsletter inbox cookie cookies consent accept agree privacy policy terms imprint copyright \u00a9 rights reserved login log sign comment comments reply share tweet print ago related like follow newsletter settings skip your read"

_words = lambda x: frozenset(x.split())
SILENT, RAW, BLOCK, HOLDERS, STICKY, AROUND, ANY, INSIDE, CUES = map(_words, (_SILENT, _RAW, _BLOCK, _HOLDERS, _STICKY, _AROUND, _ANY, _INSIDE, _CUES))
#: Silent elements that can't hold another of their kind: the next one's start tag shows that the end tag is missing.
_FLAT = _words("select audio video head")
#: What may stand in a page's head; any other tag or text ends it, as its end tag is optional.
_IN_HEAD = _words("head html base basefont bgsound link meta title noframes script style template noscript")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in RAW}


@dataclass
class Block:
    """A flat run of text: its words, how many of them are in links or buttons, and what contains it."""

    text: str
    words: int
    linked: int
    against: int  # how strongly its containers' names speak against it: 2 by all of a name, 1 by some of it
    sticky: bool  # in an element that holds what stands around an article, or a form
    inside: bool  # in the article's container
    heading: bool
    holder: int  # its container's number; containers are numbered as they open


class _Ends:
    """Finds the end of a tag; what a page has no more of is not looked for again, so that reading is linear."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "<>\"'"}

    def find(self, c: str, at: int) -> int:
        return self.page.find(c, at) if at <= self.last[c] else -1

    def tag(self, at: int) -> tuple[int, int]:
        """(end of the attributes, start of what follows) of the tag whose name ends at `at`."""
        close, following = self.find(">", at), self.find("<", at)
        if close < 0 or 0 <= following < close:
            # a quoted value may hold either sign; a tag without an end stops at the next one
            i, near = at, dict.fromkeys("\"'<>", -2)
            while True:
                for c, k in near.items():
                    if k != -1 and k < i:
                        near[c] = self.find(c, i)
                i = min((k for k in near.values() if k >= 0), default=-1)
                if i < 0:
                    return len(self.page), len(self.page)
                if self.page[i] == ">":
                    return i, i + 1
                if self.page[i] == "<":
                    return i, i
                quoted = self.find(self.page[i], i + 1) if self.page[i - 1] == "=" else -1
                i = quoted + 1 if quoted >= 0 else i + 1
        for c in "\"'":
            if self.page.find("=" + c, at, close) >= 0 and self.page.count(c, at, close) % 2:
                end = self.find(c, close)
                if end >= 0:
                    close = self.find(">", end)
                    return (close, close + 1) if close >= 0 else (len(self.page), len(self.page))
        return close, close + 1


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name, attributes or text): kind is t for text, s for a start tag, e for an end tag; one pass over the page."""
    out: list[tuple[str, str, str]] = []
    ends, at, n = _Ends(page), 0, len(page)
    no_end: set[str] = set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            out.append(("t", "", page[at:]))
            break
        if lt > at:
            out.append(("t", "", page[at:lt]))
        if page.startswith(("<!", "<?"), lt):
            sign = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
            end = -1 if sign in no_end else page.find(sign, lt + 2)
            if end < 0:
                no_end.add(sign)
                end = ends.find(">", lt) if sign != ">" else -1
                sign = ">"
            at = end + len(sign) if end >= 0 else n
            out.append(("t", "", " "))
            continue
        m = _NAME.match(page, lt)
        if not m:
            out.append(("t", "", "<"))
            at = lt + 1
            continue
        stop, at = ends.tag(m.end())
        name, attributes = m[1].lower(), page[m.end() : stop]
        kind = "e" if page[lt + 1] == "/" else "s"
        if kind == "s" and name in RAW:
            found = None if name in no_end or attributes.rstrip().endswith("/") and name != "script" else _RAW_END[name].search(page, at)
            if found:
                at = ends.tag(found.end())[1]
            else:
                no_end.add(name)
                if name in ("script", "style") and not attributes.rstrip().endswith("/"):
                    at = n
                elif name == "title":
                    at = max(at, page.find("<", at)) if page.find("<", at) >= 0 else n
                else:
                    out.append(("s", "object", ""))
            out.append(("t", "", " "))
            continue
        if attributes.rstrip().endswith("/") and name in SILENT:
            continue
        out.append((kind, name, attributes))
    return out


def _shown(found: list[tuple[str, str, str]]) -> Iterator[tuple[str, str, str]]:
    """The tokens outside silent elements; one without an end tag ends at the next block's tag, a head at its first stranger."""
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for k, (kind, name, _) in enumerate(found):
        if name in SILENT and name != "head":
            if kind == "e":
                if open_.get(name):
                    ends[open_[name].pop()] = k
            elif name in _FLAT:
                open_[name] = [k]
            else:
                open_.setdefault(name, []).append(k)
    following, nearest = [len(found)] * (len(found) + 1), len(found)
    for k in range(len(found) - 1, -1, -1):
        if found[k][1] in BLOCK - {"option", "optgroup"} - SILENT:
            nearest = k
        following[k] = nearest
    k, head = 0, False
    while k < len(found):
        kind, name, text = found[k]
        if name == "head":
            head = kind == "s"
        elif head and (kind == "t" and text.strip() or kind != "t" and name not in _IN_HEAD):
            if kind != "e" or name == "body":
                head = False
        if kind == "s" and name in SILENT and name != "head":
            k = ends[k] + 1 if k in ends else following[k + 1]
            yield ("t", "", " ")
            continue
        if not head and name != "head" and not (kind == "e" and name in SILENT):
            yield found[k]
        k += 1


def _hints(attributes: str) -> tuple[int, bool, bool]:
    """(against, inside, hidden) of a container by its class, id and role."""
    against, inside, hidden = 0, False, False
    for m in _NAMED.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        if key in ("class", "id", "role"):
            for name in value.split():
                if not name.lower().startswith(("has-", "with-", "no-", "is-")):
                    parts = {x.lower() for x in _PART.findall(name)} or {name.lower()}
                    if parts & AROUND:
                        against = max(against, 2 if all(x in AROUND or x in ANY or x.isdigit() for x in parts) else 1)
                    elif parts & INSIDE:
                        inside = True
    return against, inside, hidden


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The page's text blocks in order, and each container's parent; what never shows is left out, references are decoded."""
    out: list[Block] = []
    parents = [-1]
    # name, number, against, sticky, inside, hidden: each what it is or stands in
    stack: list[tuple[str, int, int, bool, bool, bool]] = [("", 0, 0, False, False, False)]
    # where the open elements of a name stand in the stack
    opened: dict[str, list[int]] = {}
    parts: list[tuple[str, bool]] = []
    link, button, heading = 0, 0, False

    def leave(tag: str) -> None:
        at = opened[tag][-1]
        while len(stack) > at:
            opened[stack.pop()[0]].pop()

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            _, number, against, sticky, inside, hidden = stack[-1]
            if text and not hidden:
                linked = sum(len(html.unescape(t).split()) for t, a in parts if a)
                out.append(Block(text, len(text.split()), linked, against, sticky, inside, heading, number))
            parts.clear()

    for kind, tag, attributes in _shown(tokens(page)):
        if kind == "t":
            parts.append((attributes, link > 0 or button > 0))
        elif tag == "a":
            link = int(kind == "s")
        elif tag in ("button", "label"):
            button = int(kind == "s")
        elif tag in ("br", "wbr", "img", "input"):
            parts.append(("" if tag == "wbr" else " ", False))
        elif tag in BLOCK:
            close()
            heading = tag[0] == "h" and tag[1:].isdigit() and kind == "s"
            button = 0
            if tag in HOLDERS and not attributes.rstrip().endswith("/"):
                if kind == "s":
                    link = 0
                    if tag == "td" and opened.get("td") and opened["td"][-1] > (opened.get("table") or [0])[-1]:
                        leave("td")  # a cell ends where the next one of its table begins
                    _, number, against, sticky, inside, hidden = stack[-1]
                    mine, within, unseen = _hints(attributes)
                    if tag == "header" and inside:
                        mine = 0
                    if tag in ("article", "main") or within and not mine:
                        inside = True
                    parents.append(number)
                    opened.setdefault(tag, []).append(len(stack))
                    stack.append((tag, len(parents) - 1, max(against, mine, 2 if tag == "header" and not inside else 0), sticky or tag in STICKY, inside, hidden or unseen))
                elif opened.get(tag):
                    leave(tag)
    close()
    return out, parents


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "against", "sticky", "inside", "page_has_inside", "heading", "cues", "under_cue", "in_main", "share")


def _masses(found: list[Block], parents: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Per block: whether it is in the deepest container with most of the page's plain words, and its container's share of them."""
    plain = np.array([b.words if b.linked <= 0.3 * b.words and not b.sticky else 0 for b in found], float)
    mass = np.zeros(len(parents))
    np.add.at(mass, [b.holder for b in found], plain)
    own = mass.copy()
    for k in range(len(parents) - 1, 0, -1):
        mass[parents[k]] += mass[k]
    main = 0
    for k in range(1, len(parents)):
        if parents[k] == main and mass[k] >= 0.6 * mass[0] and mass[0]:
            main = k
    within = np.zeros(len(parents), bool)
    within[main] = True
    for k in range(main + 1, len(parents)):
        within[k] = within[parents[k]]
    at = np.array([b.holder for b in found])
    return within[at], own[at] / max(1.0, mass[0])


def features(found: list[Block], parents: list[int]) -> np.ndarray:
    n = np.array([b.words for b in found], float)
    density = np.array([b.linked for b in found], float) / np.maximum(n, 1)
    cues = np.array([sum(w.strip(".,:;!?").lower() in CUES for w in b.text.split(maxsplit=40)[:40]) for b in found]) / np.minimum(np.maximum(n, 1), 40)
    # a heading's cues hold for what follows, up to the next heading
    under, cue = [], False
    for b, c in zip(found, cues, strict=True):
        if b.heading:
            cue = c >= 0.3 or b.against > 0
        under.append(cue and not b.heading)
    main, share = _masses(found, parents)
    inside = np.array([b.inside for b in found], float)
    flags = [[b.against, b.sticky] for b in found]
    pad = lambda x, before: np.concatenate([[0.0], x[:-1]]) if before else np.concatenate([x[1:], [0.0]])
    return np.column_stack([n, density, pad(n, 1), pad(density, 1), pad(n, 0), pad(density, 0), np.array(flags, float), inside, np.full(len(n), inside.any()), [b.heading for b in found], cues, under, main, share])


def labelled_table(pages: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages."""
    x, y = [], []
    for page in pages or labelled_pages.pages():
        found, parents = blocks(page)
        mine = [b.text.startswith(labelled_pages.MARK) for b in found]
        for b in found:
            b.text = b.text.removeprefix(labelled_pages.MARK)
        x.append(features(found, parents))
        y += mine
    return np.concatenate(x), np.array(y, int)


@dataclass
class Tree:
    """A binary decision tree: feature, bound and children by node; feature -1 marks a leaf of `share`."""

    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        while (inner := self.feature[node] >= 0).any():
            rows = np.flatnonzero(inner)
            k = node[rows]
            node[rows] = np.where(x[rows, self.feature[k]] <= self.bound[k], self.left[k], self.right[k])
        return self.share[node] >= 0.5


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 2) -> Tree:
    """Splits that lessen the Gini impurity most, down to pure leaves, `depth` levels or `least` rows."""
    nodes: list[list[float]] = []

    def add(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        share = y[rows].mean()
        nodes.append([-1, 0.0, -1, -1, share])
        if depth == 0 or share in (0.0, 1.0):
            return me
        best = (2 * share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, t = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(rows))
            a, b = t[:-1], t[-1] - t[:-1]
            gini = 2 * a * (1 - a / n) + 2 * b * (1 - b / (len(rows) - n))
            ok = (v[1:] > v[:-1]) & (n >= least) & (len(rows) - n >= least)
            if ok.any():
                k = int(np.where(ok, gini, np.inf).argmin())
                best = min(best, (gini[k], f, (v[k] + v[k + 1]) / 2))
        if best[1] < 0:
            return me
        _, f, bound = best
        go = x[rows, f] <= bound
        nodes[me][:2] = f, bound
        nodes[me][2] = add(rows[go], depth - 1)
        nodes[me][3] = add(rows[~go], depth - 1)
        return me

    add(np.arange(len(x)), depth)
    f, b, left, right, s = zip(*nodes, strict=True)
    return Tree(np.array(f, int), np.array(b, float), np.array(left, int), np.array(right, int), np.array(s, float))


def main_tree() -> Tree:
    """The tree of the labelled table."""
    return grow(*labelled_table(), depth=12)


def main_text(page: str, tree: Tree) -> str:
    found, parents = blocks(page)
    if not found:
        return ""
    return " ".join(b.text for b, k in zip(found, tree.predict(features(found, parents)), strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every row of pages: the article's blocks in order, joined by one space.

    A null or empty page, or one without an article, gives an empty text. Pages of any length are read
    whole; null, repeated ids and urls come back as they are; an empty table gives no rows; other
    columns are not read. Broken markup is read as far as it goes.
    """
    small_batches(pages)
    tree = main_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "", tree) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})
