"""Main text of web pages by composite text density.

A page is read into a node tree. Every node gets its composite text density: characters per tag, raised or lowered by
the share of its characters that are link text, against the share in the body. A node's density sum adds the densities
of its children. The node with the largest sum is found; the smallest density on its path down from the body is the
threshold, and the largest-sum subtree of each node at or above the threshold is content.

What stands beside content is judged by density and kind. Below the threshold, a part of mostly link text goes, and so
does bare text of a container with under a quarter of the characters that the best node has per tag; headings,
paragraphs, lists and tables stay, and containers are searched for them. A
region that is content as a whole only loses what is cut.

Cut are: menus, headers and footers outside the article, sidebars, forms, dialogs, scripts and styles, by element or
role; and notices, adverts, comments and the like by a word of the class or id. A name never cuts much: where named
parts hold half of the text (of the page's articles, if it has any), names count for nothing, and a name that holds
other words too (`has-sidebar`) cuts only a node below the threshold with under a quarter of the text. But comments and
notices, told by a name or by the heading of a `div` or `section`, go at any size, unless nothing else is left or an article
is in them.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed. Null
and empty pages give an empty text; malformed pages never fail: a tag cut off at the end is dropped, an attribute quote
that isn't closed soon ends with its tag, unclosed elements close where HTML closes them, stray end tags are ignored.
Pages of any length and depth are read whole, without recursion, in time in proportion to their length. Repeated rows
give repeated results, an empty table an empty one; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import batch, map_batches

#: Elements without content, elements whose content is not text, and elements that break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements and roles that aren't the article; the second ones only while they hold little of the text.
CUT = frozenset("nav aside footer button select script style noscript template iframe textarea title head svg canvas object dialog menu".split())
CUT_LITTLE = frozenset("form".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of a class or id that name what isn't the article, and words that say nothing beside them.
NAMES = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside notice cookie cookies consent banner popup modal overlay ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments respond reply replies disqus share sharing social related recommended newsletter subscribe subscription signup login search widget".split())
BESIDE = frozenset("site page main top bottom left right box bar area block container wrapper wrap list section item items inner outer row col the primary secondary global side".split())
#: Those of the names whose parts go at any size, and how the heading of such a part begins.
ALWAYS_NAMES = frozenset("comment comments respond reply replies disqus notice cookie cookies consent".split())
ALWAYS_HEADINGS = re.compile(r"\s*(?:\d+\s+)?(?:comments?|responses?|replies|trending|most (?:read|popular)|related (?:articles|posts|stories)|you may also like|leave a (?:comment|reply))\s*(?:\(\d+\))?\s*:?\s*", re.I)
#: Those of the names that an article may call parts of its own.
OF_ARTICLES = frozenset("header masthead banner".split())
#: Elements that hold parts side by side, and say nothing about them.
CONTAINERS = frozenset("section main div td th tr tbody thead tfoot body html center fieldset form #root".split())
#: Which open elements a start tag closes by itself.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}} | {x: {"p"} for x in BLOCK - {"p", "li", "dt", "dd", "tr", "td", "th", "body", "html"}}
#: Where the search for an element to close ends.
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
STOPS = {tag: (_SCOPE.get(tag, set()) | {"article", "section", "div", "body", "main", "td", "th", "table"}) - own for tag, own in CLOSES.items()}
#: What the end tag of an inline element doesn't reach out of.
WALLS = ("article", "main", "body", "td", "th")
#: Elements that may stand in a head; any other, and any text, closes an open head.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: Attributes up to the end of the tag with all quotes closed, looked for in a piece of bounded length.
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>]))*+>")
_QUOTED_MOST = 4096
_MARKS = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

#: What a node's own element, attributes and heading say: nothing, always cut, cut while it holds little, a plain name, a
#: mixed name, a name that cuts at any size.
OPEN, HARD, LITTLE, NAMED, MIXED, ALWAYS = range(6)


def _says(tag: str, attributes: str, inside: bool) -> int:
    if tag in CUT or (tag == "header" and not inside):
        return HARD
    found = LITTLE if tag in CUT_LITTLE else OPEN
    if "=" not in attributes or tag in ("html", "body", "main", "article"):
        return found
    for name, *values in _MARKS.findall(attributes):
        value = next(filter(None, values), "")
        if name.lower() == "role":
            if value.strip().lower() in CUT_ROLES:
                return LITTLE
            continue
        for token in value.split():
            words = [w.lower() for w in _WORDS.findall(token)]
            names = [w for w in words if w in NAMES and not (inside and w in OF_ARTICLES)]
            plain = all(w in names or w in BESIDE for w in words)
            if plain and not ALWAYS_NAMES.isdisjoint(names):
                return ALWAYS
            if names:
                found = max(found, NAMED if plain else MIXED) if found != NAMED else NAMED
    return found


class Page:
    """A page's nodes in page order, as lists by number; node 0 is the root. events has what blocks() needs."""

    def __init__(self) -> None:
        self.tags, self.parents, self.says, self.ends = ["#root"], [-1], [OPEN], [0]
        self.own = [0]  # characters of text directly in the node, without white space
        self.events: list[tuple[int, str | None]] = []  # (node, text), (node, None) where it opens, (-1 - node, None) where it closes

    def add(self, tag: str, parent: int, says: int) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.says.append(says)
        self.own.append(0)
        self.ends.append(0)
        self.events.append((len(self.tags) - 1, None))
        return len(self.tags) - 1


def parse(html: str) -> Page:
    page, stack, at = Page(), [0], 0
    places: dict[str, list[int]] = {}  # tag -> places in the stack where it is open
    unended: set[str] = set()
    inside = [False]  # per open node: in an article, main or section

    def last(tag: str) -> int:
        return found[-1] if (found := places.get(tag)) else -1

    def pop_to(size: int) -> None:
        while len(stack) > size:
            node = stack.pop()
            inside.pop()
            places[page.tags[node]].pop()
            page.events.append((-1 - node, None))

    def say(text: str) -> None:
        if page.tags[stack[-1]] == "head" and text.strip():
            pop_to(len(stack) - 1)
        node = stack[-1]
        text = unescape(text)
        page.own[node] += len("".join(text.split()))
        if page.tags[node] in _HEADINGS and page.tags[stack[-2]] in ("div", "section") and ALWAYS_HEADINGS.fullmatch(text):
            page.says[stack[-2]] = ALWAYS
        page.events.append((node, text))

    while at < len(html):
        begin = html.find("<", at)
        if begin < 0:
            say(html[at:])
            break
        after = html[begin + 1 : begin + 2]
        if after == "!" or after == "?":
            if begin > at:
                say(html[at:begin])
            comment = html.startswith("<!--", begin)
            end = html.find("-->" if comment else ">", begin + (4 if comment else 2))
            at = len(html) if end < 0 else end + (3 if comment else 1)
            continue
        m = _NAME.match(html, begin + 1 + (after == "/"))
        if not m:
            say(html[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            say(html[at:begin])
        close = html.find(">", m.end())
        if close < 0:
            break
        attributes = html[m.end() : close]
        if ('"' in attributes or "'" in attributes) and not _QUOTED.fullmatch(attributes + ">"):
            if q := _QUOTED.match(html[m.end() : m.end() + _QUOTED_MOST]):
                close = m.end() + q.end() - 1
                attributes = html[m.end() : close]
        at, tag = close + 1, m[0].lower()
        if after == "/":
            here = last(tag)
            if here >= 0 and (tag in BLOCK or here > max(last(w) for w in WALLS) or tag in WALLS):
                pop_to(here)
            elif tag == "p":
                page.events.append((stack[-1], "\n\n"))
            continue
        if page.tags[stack[-1]] == "head" and tag not in IN_HEAD:
            pop_to(len(stack) - 1)
        if tag in CLOSES:
            stop = max(last(s) for s in STOPS[tag])
            open_ = [x for t in CLOSES[tag] if (x := last(t)) > stop]
            if open_:
                pop_to(mine if (mine := last(tag)) > stop else min(open_))
        within = inside[-1] or page.tags[stack[-1]] in ("article", "main", "section")
        node = page.add(tag, stack[-1], _says(tag, attributes, within))
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCK):
            page.events.append((-1 - node, None))
            continue
        if tag in RAW:
            end = None if tag in unended else re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            page.events.append((-1 - node, None))
            if end is None:
                unended.add(tag)
                if tag in ("title", "noscript", "template"):
                    continue
                break
            at = html.find(">", end.end() - 1) + 1 or len(html)
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
        inside.append(within)
    for node in reversed(stack):
        page.events.append((-1 - node, None))
    return page


def _sums(page: Page, own: list[int]) -> list[int]:
    """Of every node, the sum of own over it and all below it."""
    out = list(own)
    for i in range(len(out) - 1, 0, -1):
        out[page.parents[i]] += out[i]
    return out


def weigh(page: Page) -> tuple[list[int], list[int], list[float]]:
    """Characters, link characters and composite text density of every node."""
    n = len(page.tags)
    chars, link_chars, tags, link_tags = _sums(page, page.own), [0] * n, _sums(page, [0] + [1] * (n - 1)), _sums(page, [int(t == "a") for t in page.tags])
    for i in range(n - 1, -1, -1):
        if page.tags[i] == "a":
            link_chars[i] = chars[i]
        if i:
            link_chars[page.parents[i]] += link_chars[i]
    body = body_of(page)
    share = link_chars[body] / max(1, chars[body])
    density = [0.0] * n
    for i, c in enumerate(chars):
        if c:
            lc, t, lt = link_chars[i], max(1, tags[i] - (i > 0)), max(1, link_tags[i] - (page.tags[i] == "a"))
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            density[i] = c / t * (math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(max(base, math.e)))
    return chars, link_chars, density


def body_of(page: Page) -> int:
    return page.tags.index("body") if "body" in page.tags else 0


def density_sums(page: Page, density: list[float], out: list[bool]) -> list[float]:
    """Of every node, its own characters and the densities of its children that aren't cut."""
    total = [float(c) for c in page.own]
    for i in range(1, len(total)):
        if not out[i]:
            total[page.parents[i]] += density[i]
    return total


def _cut(page: Page, chars: list[int]) -> tuple[list[bool], list[int]]:
    """Which nodes are cut before densities decide, themselves or with one above them; and the characters that are left."""
    n = len(page.tags)

    def below(kinds: tuple[int, ...], but: frozenset[int] = frozenset()) -> list[bool]:
        out = [False] * n
        for i in range(1, n):
            out[i] = out[page.parents[i]] or (page.says[i] in kinds and i not in but)
        return out

    holds = [page.tags[i] in ("article", "main") for i in range(n)]  # an article in it
    for i in range(n - 1, 0, -1):
        holds[page.parents[i]] = holds[page.parents[i]] or holds[i]
    always = frozenset(i for i in range(n) if page.says[i] == ALWAYS and not holds[i])
    rest = below((HARD, LITTLE, NAMED, ALWAYS), frozenset(i for i in range(n) if page.says[i] == ALWAYS and holds[i]))
    if any(c and not x for x, c in zip(rest, page.own, strict=True)):  # something else is left on the page
        page.says = [HARD if i in always else NAMED if x == ALWAYS else x for i, x in enumerate(page.says)]
    else:
        page.says = [NAMED if x == ALWAYS else x for x in page.says]
    hard = below((HARD,))
    seen = _sums(page, [0 if x else c for x, c in zip(hard, page.own, strict=True)])
    inside = [False] * n  # in what the page itself calls its article, if it has one with text
    for tag in ("article", "main"):
        if any(page.tags[i] == tag and seen[i] for i in range(n)):
            for i in range(1, n):
                inside[i] = inside[page.parents[i]] or page.tags[i] == tag
            break
    weight = seen if not any(inside) else _sums(page, [c if inside[i] and not hard[i] else 0 for i, c in enumerate(page.own)])
    whole = weight[0]
    much = frozenset(i for i in range(n) if page.says[i] in (LITTLE, NAMED) and 2 * weight[i] >= max(1, whole))
    out = below((HARD, LITTLE, NAMED), much)
    lost = sum(weight[i] for i in range(1, n) if page.says[i] == NAMED and i not in much and not out[page.parents[i]])
    if 2 * lost >= max(1, whole):  # names can't be trusted on this page
        out = below((HARD, LITTLE), much)
    return out, _sums(page, [0 if x else c for x, c in zip(out, page.own, strict=True)])


def content(page: Page) -> list[bool]:
    """Of every node, whether text directly in it belongs to the main text."""
    n, parents, tags = len(page.tags), page.parents, page.tags
    chars, link_chars, density = weigh(page)
    out, left = _cut(page, chars)
    body = body_of(page)
    total = density_sums(page, density, out)
    top = list(range(n))  # the node of the largest sum in each subtree
    for i in range(n - 1, 0, -1):
        if not out[i] and total[top[i]] >= total[top[parents[i]]]:
            top[parents[i]] = top[i]
    best = node = top[body]
    threshold = density[best]
    while node not in (body, 0):
        node = parents[node]
        threshold = min(threshold, density[node])

    usual = chars[best] / _sums(page, [1] * n)[best]
    above = [not out[i] and left[i] > 0 and density[i] >= threshold for i in range(n)]
    for i in range(n):  # a name with other words beside it cuts only what is thin
        if page.says[i] == MIXED and not above[i] and 4 * left[i] < left[body]:
            out[i] = True
        out[i] = out[i] or (i > 0 and out[parents[i]])
    marked = [False] * n
    for i in range(body, n):
        if above[i] and not out[i] and not out[top[i]] and top[i] != body:
            marked[top[i]] = True
    holds = list(marked)  # has a marked node in it
    for i in range(n - 1, 0, -1):
        holds[parents[i]] = holds[parents[i]] or holds[i]

    kept, whole = [False] * n, [False] * n
    searched = [False] * n
    kept[body] = not out[body]
    searched[body] = True
    begun = False  # whether content has begun, so that links before it are a menu
    for i in range(1, n):
        if i == body or out[i]:
            continue
        p, linked = parents[i], 2 * link_chars[i] >= max(1, chars[i])
        if marked[i]:
            kept[i] = whole[i] = True
        elif whole[p]:
            menu = linked and not begun and not above[i] and 10 * link_chars[i] >= 9 * chars[i] and chars[i] > 0 and (tags[i] in BLOCK and tags[i] not in _HEADINGS) and not holds[i]
            kept[i] = whole[i] = not menu
        elif searched[p]:
            if holds[i]:
                kept[i] = searched[i] = True
            elif linked and not above[i] and tags[i] not in _HEADINGS and chars[i]:
                continue
            elif tags[i] in CONTAINERS:
                searched[i] = True
                kept[i] = above[i] or (not linked and 4 * page.own[i] >= usual)
            else:
                kept[i] = whole[i] = True
        begun = begun or (kept[i] and page.own[i] > 0 and not linked)
    return kept


def blocks(page: Page, kept: list[bool]) -> list[str]:
    """The text of the kept nodes, block by block."""
    out: list[str] = []
    line: list[str] = []
    for node, text in page.events:
        if text is not None:
            if kept[node]:
                line.append(text)
            continue
        tag = page.tags[node if node >= 0 else -1 - node]
        if tag in BLOCK:
            if found := " ".join("".join(line).split()):
                out.append(found)
            line.clear()
        elif tag == "br":
            line.append(" ")
    if found := " ".join("".join(line).split()):
        out.append(found)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = parse(html)
    return "\n".join(blocks(page, content(page)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars: its code points) per row of pages."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in b.column(2).to_pylist()]
        return batch(id=b.column(0), url=b.column(1), text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    kind = pages.schema[id_col].dataType.simpleString()
    out = map_batches(pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string")), f"id {kind}, url string, text string, n_chars long", run)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
