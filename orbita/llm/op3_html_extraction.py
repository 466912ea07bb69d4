"""Main text of web pages by composite text density.

A page becomes a tree of elements. The composite density of a node is its characters per tag, lowered by its share of
link characters and link tags; a node's density sum is the sum over its children. First the sums of the whole tree are
worked out (without what is never shown). Elements that by tag, role or class are no article (menus, footers, forms,
adverts, reader comments and so on) are marked, but not those that hold the node of the largest sum, or an article; a
list of comments that holds it stays marked if enough text stands outside. The sums of what is left then choose the
node; ancestors are added as long as their density reaches the least density on the path to the body and, outside an
article, half of the chosen node's; and siblings along the rest of the path that do so too, or hold the page's title
before it. An article element is never left. All unmarked text of what is chosen comes out, in page order.

Null html counts as empty. A page without body text gives the empty text. Broken markup is read in linear time, however
long or deep. Every row gives one row, also repeated ones; columns besides page_id, url and html are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

#: Kinds of HTML elements, and words in class or id that name what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SCOPE = frozenset("html body table td th caption button object article section div main aside nav ul ol dl form blockquote figure header footer details fieldset".split())
UNSEEN = frozenset("button select input textarea script style noscript template iframe svg canvas object embed applet audio video head title xmp noembed noframes datalist map progress meter".split())
CUT = frozenset("nav aside footer form dialog menu".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist note".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies discussion disqus donate "
    "feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination paywall popup promo promoted promotion related "
    "recommendation recommendations recommended replies reply respond responses search share sharing shoutbox sidebar signin signup skip social sponsor sponsored sponsors subscribe subscription "
    "taboola toolbar trending widget".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond discussion responses feedback shoutbox".split())
#: Words that say how a page is laid out, not what an element is; and words that make a header part of an article.
STATE_BEFORE = frozenset("has with without no is not js".split())
STATE_AFTER = frozenset("open closed enabled disabled on off active".split())
CONTENT_WORDS = frozenset("article content entry main page post story text".split())
CONTAINERS = frozenset("# html body div section article main table tbody tr td th blockquote center ul ol dl dd details figure pre form fieldset header".split())

_TAG = re.compile(r"</?[a-zA-Z][^\s/>]*+")
_COMMENT_END = re.compile(r"--!?>")
_QUOTE = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HUGE = re.compile(r"&#0*+[1-9][0-9]{9,}+;?|&#[xX]0*+[1-9a-fA-F][0-9a-fA-F]{9,}+;?")


def decoded(text: str) -> str:
    return unescape(_HUGE.sub("\ufffd", text)) if "&" in text else text


def tokens(html: str):
    """(text, None, "") or (None, tag, attributes), the tag with / in front if it ends; comments and declarations are left out.

    A tag ends at > outside quotes, or at the first > if that leaves a quote open. ``open_`` remembers after which
    quotes the page's end comes first, so that no stretch is searched twice in vain.
    """
    pos, n, text_from, closes, open_ = 0, len(html), 0, True, set()
    while True:
        at = html.find("<", pos)
        if at < 0 or not closes:
            break
        if html.startswith("<!--", at):
            m = _COMMENT_END.search(html, at + 2)
            end, tag = m.end() if m else n, None
        elif m := _TAG.match(html, at):
            tag, p, visited = m[0][1:].lower(), m.end(), []
            end = 0
            while not end:
                q = _QUOTE.search(html, p)
                if q and q[0] == ">":
                    end = q.end()
                    break
                close = html.find(q[0], q.end()) + 1 if q else 0
                if not close or close in open_:
                    open_.update(visited)
                    break
                visited.append(close)
                p = close
            attributes = html[m.end() : end - 1] if end else ""
            if not end:
                end = html.find(">", m.end()) + 1
                attributes = html[m.end() : end - 1] if end else ""
                closes = bool(end)
        elif html.startswith(("<!", "<?", "</"), at):
            end, tag = html.find(">", at) + 1, None
            closes = bool(end)
        else:
            pos = at + 1
            continue
        if not closes:
            break
        if at > text_from:
            yield html[text_from:at], None, ""
        if tag:
            end = (yield None, tag, attributes, end) or end
        pos = text_from = end
    rest = html[text_from : at if at >= 0 and not closes else n]
    if rest:
        yield rest, None, ""


class Page:
    """Elements in page order; parents come before children. ``pieces`` holds (node, text), text None for a block's edge."""

    def __init__(self, html: str):
        self.tags, self.parents, self.attributes = ["#"], [-1], [{}]
        self.pieces: list[tuple[int, str | None]] = []
        self.stack = [0]
        self.opened: Counter[str] = Counter()
        self.inline: list[Counter[str]] = [Counter()]  # open elements of formatting since each open block
        self.lowered = None
        source, skip = tokens(html), None
        while True:
            try:
                text, tag, attributes, *end = source.send(skip)
            except StopIteration:
                break
            skip = None
            if text is not None:
                self.pieces.append((self.stack[-1], decoded(text)))
            elif tag[0] == "/":
                self.close(tag[1:])
            else:
                skip = self.open(html, tag, attributes, end[0])

    def open(self, html: str, tag: str, attributes: str, pos: int) -> int | None:
        if tag in ("html", "body") and self.opened[tag]:
            return None
        if tag in CLOSES_P:
            self.end_open(("p",), SCOPE)
        if tag in ("li", "dd", "dt"):
            self.end_open(("li",) if tag == "li" else ("dd", "dt"), frozenset(("ul", "ol", "dl", "menu", "html", "body", "article", "section", "div")) - {tag})
        elif tag in ("tr", "td", "th"):
            self.end_open(("td", "th") if tag != "tr" else ("td", "th", "tr"), frozenset(("table", "html", "body") if tag == "tr" else ("tr", "table", "html", "body")))
        elif tag == "option":
            self.end_open(("option",), frozenset(("select", "datalist")))
        elif tag == "body":
            self.end_open(("head",), frozenset(("html",)))
        node = self.add(tag, attributes)
        if tag in BLOCK:
            self.pieces.append((node, None))
        if tag in VOID:
            return None
        if tag in RAW:
            self.lowered = html.lower() if self.lowered is None else self.lowered
            if len(self.lowered) != len(html):  # a letter that grows in lower case
                self.lowered = "".join(c.lower() if c.isascii() else c for c in html)
            end = self.lowered.find(f"</{tag}", pos)
            return len(html) if end < 0 else html.find(">", end) + 1 or len(html)
        self.stack.append(node)
        self.opened[tag] += 1
        if tag in BLOCK or tag in SCOPE:
            self.inline.append(Counter())
        else:
            self.inline[-1][tag] += 1
        return None

    def add(self, tag: str, attributes: str) -> int:
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.attributes.append({a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {})
        return len(self.tags) - 1

    def cut_back(self, k: int) -> None:
        """Close all that is open from place k on."""
        for i in self.stack[k:]:
            tag = self.tags[i]
            self.opened[tag] -= 1
        for i in reversed(self.stack[k:]):
            tag = self.tags[i]
            if tag in BLOCK or tag in SCOPE:
                self.inline.pop()
            else:
                self.inline[-1][tag] -= 1
        del self.stack[k:]

    def end_open(self, tags: tuple[str, ...], scope: frozenset[str]) -> None:
        if not any(self.opened[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[k]]
            if tag in tags:
                self.pieces.append((self.stack[k], None))
                self.cut_back(k)
                if len(tags) < 3:
                    return
            elif tag in scope:
                return

    def close(self, tag: str) -> None:
        if not self.opened[tag]:
            return
        if tag not in BLOCK and tag not in SCOPE:
            if not self.inline[-1][tag]:
                return  # a misnested end tag of formatting closes no block
        for k in range(len(self.stack) - 1, 0, -1):
            open_tag = self.tags[self.stack[k]]
            if open_tag == tag:
                if tag in BLOCK:
                    self.pieces.append((self.stack[k], None))
                self.cut_back(k)
                return
            if open_tag in ("body", "html"):
                return

    def unseen(self, node: int) -> bool:
        attributes = self.attributes[node]
        if self.tags[node] in UNSEEN:
            return True
        if not attributes or self.tags[node] in ("html", "body"):
            return False
        return "hidden" in attributes or (attributes.get("aria-hidden") or "").lower() == "true" or bool(_HIDDEN.search(attributes.get("style") or ""))

    def words(self, node: int) -> set[str]:
        """What class and id call an element."""
        out: set[str] = set()
        for name in ("class", "id"):
            for token in (self.attributes[node].get(name) or "").split():
                own = [w.lower() for w in _WORDS.findall(token)]
                state = next((k for k, w in enumerate(own) if w in STATE_BEFORE), len(own))
                own = own[:state]
                if own and own[-1] not in STATE_AFTER:
                    found = CUT_WORDS.intersection(own)
                    out |= set() if found == {"header"} and CONTENT_WORDS.intersection(own) else found
        return out

    def marked(self, node: int, in_article: bool) -> str:
        """``cut`` for what is no article, ``comments`` for what readers wrote."""
        tag = self.tags[node]
        if tag in ("html", "body", "main", "#"):
            return ""
        words = self.words(node) if self.attributes[node] else set()
        if words & COMMENT_WORDS:
            return "comments"
        if tag in CUT or (tag == "header" and not in_article) or words or (self.attributes[node].get("role") or "").lower() in CUT_ROLES:
            return "cut"
        return ""


class Densities:
    """Characters, tags, composite densities and density sums of the nodes that are not gone."""

    def __init__(self, page: Page, gone: list[bool], body: int):
        n, parents, tags = len(page.tags), page.parents, page.tags
        chars, links, elements, link_tags, link = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            link[i] = tags[i] == "a" or link[parents[i]]
        for (node, _), size in zip(page.pieces, page.sizes, strict=True):
            if size and not gone[node]:
                chars[node] += size
                if link[node]:
                    links[node] += size
        for i in range(n - 1, 0, -1):
            if not gone[i]:
                p = parents[i]
                chars[p] += chars[i]
                links[p] += links[i]
                elements[p] += elements[i] + 1
                link_tags[p] += link_tags[i] + (tags[i] == "a")
        self.chars, self.links = chars, links
        all_chars, all_links = max(1, chars[body]), links[body]
        self.of, self.sums = [0.0] * n, [0.0] * n
        for i in range(n):
            if not gone[i] and chars[i]:
                c, lc, t, lt = chars[i], links[i], max(1, elements[i]), max(1, link_tags[i])
                if lc:
                    base = math.log(c / max(1, c - lc) * lc + all_links / all_chars * c + math.e)
                    self.of[i] = max(0.0, c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.0 + 1e-9)))
                else:
                    self.of[i] = c / t
        for i in range(1, n):
            self.sums[parents[i]] += self.of[i]

    def best(self, nodes: list[int]) -> int | None:
        """The node of the largest density sum; of a node without children its own density counts a little."""
        return max(nodes, key=lambda i: (self.sums[i] or self.of[i] * 1e-6, -i), default=None)


def extract(html: str | None) -> str:
    """The main text of a page."""
    page = Page(html or "")
    tags, parents, n = page.tags, page.parents, len(page.tags)
    page.sizes = [len("".join(text.split())) if text else 0 for _, text in page.pieces]
    unseen = [False] * n
    for i in range(1, n):
        unseen[i] = unseen[parents[i]] or page.unseen(i)
    body = next((i for i in range(n) if tags[i] == "body"), 0)
    whole = Densities(page, unseen, body)
    if not whole.chars[body] and body:
        body, whole = 0, Densities(page, unseen, 0)
    if not whole.chars[body]:
        return ""
    inside = [False] * n
    inside[body] = True
    for i in range(body + 1, n):
        inside[i] = inside[parents[i]]

    def path(i: int) -> list[int]:
        out = [i]
        while i != body:
            i = parents[i]
            out.append(i)
        return out

    candidates = [i for i in range(n) if inside[i] and not unseen[i] and tags[i] in CONTAINERS]
    holds_best = set(path(whole.best(candidates)))
    holds_article, in_article = [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        if tags[i] in ("article", "main") or holds_article[i]:
            holds_article[parents[i]] = True
    gone = list(unseen)
    for i in range(1, n):
        in_article[i] = in_article[parents[i]] or tags[parents[i]] in ("article", "main")
        if gone[parents[i]]:
            gone[i] = True
        elif not gone[i] and inside[i] and i != body and (mark := page.marked(i, in_article[i])):
            own, rest = whole.chars[i], (whole.chars[body] - whole.links[body]) - (whole.chars[i] - whole.links[i])
            spared = holds_article[i] or (i in holds_best and (mark != "comments" or rest * 10 < own))
            gone[i] = not spared
    left = Densities(page, gone, body)
    best = left.best([i for i in candidates if not gone[i]])
    up = path(best)
    barrier = max((k for k, i in enumerate(up) if tags[i] == "article"), default=None)
    threshold = min(whole.of[i] for i in up)
    top = 0
    for k, i in enumerate(up[:-1]):
        if (barrier is not None and k > barrier) or left.of[i] < threshold or (barrier is None and left.of[i] * 2 < left.of[best]):
            break
        top = k
    chosen, best_path = {up[top]}, set(up)
    on_path = set(up[top + 1 : len(up) if barrier is None else barrier + 1])
    titled = [t == "h1" for t in tags]
    for i in range(n - 1, 0, -1):
        titled[parents[i]] |= titled[i]
    for i in range(body + 1, n):
        if parents[i] in on_path and i not in best_path and not gone[i] and left.links[i] * 2 < max(1, left.chars[i]):
            dense = left.of[i] >= threshold and (barrier is not None or left.of[i] * 2 >= left.of[best])
            if dense or (titled[i] and i < best):
                chosen.add(i)
    taken = [False] * n
    for i in range(n):
        nested = tags[i] == "article" and barrier is not None and i not in best_path  # what readers or others wrote
        taken[i] = (i in chosen or (i > 0 and taken[parents[i]])) and not nested
    return " ".join("".join([" " if text is None else text for node, text in page.pieces if taken[node] and not gone[node]]).split())


def extract_pages(pages: DataFrame) -> DataFrame:
    def work(batches):
        for keys, urls, html in batches:
            texts = [extract(h) for h in html]
            yield {"page_id": keys, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(pages, ["page_id", "url", "html"], "page_id long, url string, text string, n_chars long", work)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
