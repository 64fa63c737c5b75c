"""Main text of web pages by composite text density.

A page is read into a tree of elements. For each node, C counts the characters below it, T the
tags, LC and LT those that are links. The composite density of a node is::

    C/T * log(C/LC * T/LT) / log(log(C/(C-LC) * LC + LCbody/Cbody * C + e))

that is characters per tag, less where they are links. Elements that only format a run of text are no nodes. A node's density sum adds
the densities of its children. On every page, whatever its tags are called, the node with the largest sum is the target, and the threshold is
the lowest density on the path from it to the body. The text is that of the target and of the largest-sum node in every node below the
body at or above the threshold; outside the target's parent that node must also reach the density of the target's sparsest child,
so that a stray label in a page of many links, where the threshold is low, is no text.

Elements that are never article text (by tag, role, or a whole token of their class or id: menus, page headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) count for
nothing and are left out. Of these a form, and what only attributes tell, stays where it holds most of the
page's text outside links and no article elsewhere on the page has text; reader comments stay where there is
no other text. The text of a block has its character references decoded and each run of white space turned into one space; blocks follow page order, joined by newlines. br is white space.

Cases: null or empty html, or a page without such text, gives "". Tags that are never closed
close where the next block or their parent does; what a page cut off inside a tag has of it is markup. Rows are
never merged; a null url stays null; other columns are not carried.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that format a run of text: they are no nodes of the density tree, and not counted as tags.
FORMAT = frozenset("abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is never the article's.
NEVER = frozenset("head script style noscript template iframe object embed svg math canvas audio video nav footer aside form button select option textarea input label dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of a class or id that mark what surrounds an article.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices banner sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar pagination pager share sharing social related recommended newsletter subscribe subscription popup modal overlay login signup search comment comments commentlist respond replies reply disqus".split()
)
#: Words that leave the meaning of the word beside them in a token: left-sidebar, cookie-box, related-posts.
BESIDE = frozenset(
    "left right top bottom upper lower main site page global primary secondary inner outer wrapper wrap container area box block section list item items group panel widget slot unit content body text links link icons buttons button bar row col column posts articles stories entries products form dialog thread".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist respond replies reply disqus".split())
#: A start tag of these ends an open one of those, within the given borders.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>"'][^\s>]*)))?""")
_HEADER = frozenset(["header"])
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


def _names(token: str, words: frozenset[str]) -> bool:
    """Whether a token of a class or id is one of the words, or made of them and of words that may stand beside them."""
    parts = [x for x in _SPLIT.split(token) if x]
    return not words.isdisjoint(parts) and all(x in WORDS or x in BESIDE or x in words or x.isdigit() for x in parts)


def _surrounds(tag: str, attrs: str, in_article: bool) -> str:
    """Why an element is what surrounds articles: "" (it isn't), "tag", "marked", or "comment" for reader comments."""
    if tag in NEVER or (tag == "header" and not in_article):
        return "marked" if tag == "form" else "tag"
    if tag in ("html", "body", "main") or not attrs:
        return ""
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return "marked"
        if name in ("class", "id"):
            for token in value.split():
                if _names(token, COMMENT_WORDS):
                    return "comment"
                if tag != "article" and _names(token, WORDS) or not in_article and _names(token, _HEADER):
                    return "marked"
    return ""


class Page:
    """The tree: per node its tag, parent and counts; and the pieces of text in page order."""

    def __init__(self, html: str):
        self._count(html, frozenset())
        if stay := self._stay():
            self._count(html, stay)

    def _count(self, html: str, stay: frozenset[int]) -> None:
        self.tag, self.parent, self.chars, self.link_chars, self.tags, self.link_tags = ["#root"], [-1], [0], [0], [0], [0]
        self.pieces: list[tuple[int, int, str]] = []  # node, block, text
        #: What attributes (or form) leave out: node, why, node of the tree around it, the one of these around it, characters outside links
        self.cuts: list[list] = []
        self._read(html, stay)
        for i in range(len(self.tag) - 1, 0, -1):
            p = self.parent[i]
            self.chars[p] += self.chars[i]
            self.link_chars[p] += self.link_chars[i]
            self.tags[p] += self.tags[i] + (self.tag[i] not in FORMAT or self.tags[i] < 0)
            self.link_tags[p] += self.link_tags[i] + (self.tag[i] == "a")

    def _stay(self) -> frozenset[int]:
        """The nodes that are left out though they hold most of the page's text."""
        total = self.chars[0] - self.link_chars[0]
        total += sum(size for _, _, _, outer, size in self.cuts if outer < 0)
        most = [c for c in self.cuts if c[4] and (c[4] >= total if c[1] == "comment" else 2 * c[4] > total)]
        if not most:
            return frozenset()
        article = [0] * len(self.tag)  # the outermost article around each node
        for i in range(1, len(self.tag)):
            article[i] = article[self.parent[i]] or (i if self.tag[i] == "article" else 0)
        told = {i for i, a in enumerate(article) if i and i == a and self.chars[i] > self.link_chars[i]}
        return frozenset(node for node, _, around, _, _ in most if not told - {article[around]})

    def _read(self, html: str, stay: frozenset[int]) -> None:
        at, n, block = 0, len(html), 0
        stack, quotes = [0], True
        out = hard = articles = links = 0  # open elements: left out, of these by tag, articles, links
        outer: list[tuple[bool, bool, bool, bool, bool]] = [(False, False, False, False, False)]
        cuts: list[int] = []  # the open ones of self.cuts

        def close(depth: int) -> None:
            nonlocal out, hard, articles, links
            while len(stack) > depth:
                stack.pop()
                o, h, c, a, k = outer.pop()
                out -= o
                hard -= h
                if c and len(cuts) > 1:
                    self.cuts[cuts[-2]][4] += self.cuts[cuts[-1]][4]
                if c:
                    cuts.pop()
                articles -= a
                links -= k

        def text(s: str) -> None:
            if not out and s:
                s = unescape(s) if "&" in s else s
                node = stack[-1]
                size = len(_SPACE.sub(" ", s).strip())
                self.chars[node] += size
                if links:
                    self.link_chars[node] += size
                self.pieces.append((node, block, s))
            elif cuts and not hard and not links:
                self.cuts[cuts[-1]][4] += len(_SPACE.sub(" ", unescape(s) if "&" in s else s).strip())

        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                text(html[at:])
                break
            nxt = html[lt + 1 : lt + 2]
            if nxt == "!" or nxt == "?":
                text(html[at:lt])
                if html.startswith("<!--", lt):
                    end = html.find("-->", lt + 4)
                    at = n if end < 0 else end + 3
                else:
                    end = html.find(">", lt)
                    at = n if end < 0 else end + 1
                continue
            closing = nxt == "/"
            m = _NAME.match(html, lt + 1 + closing)
            if not m:
                if closing and lt + 2 < n:
                    text(html[at:lt])
                    end = html.find(">", lt)
                    at = n if end < 0 else end + 1
                else:  # a lone "<" is text
                    text(html[at : lt + 1])
                    at = lt + 1
                continue
            text(html[at:lt])
            rest = _REST.match(html, m.end()) if quotes else None
            if rest is None:  # a quote that is never closed: from here on tags end at the next ">"
                quotes = False
                end = html.find(">", m.end())
                end = n if end < 0 else end + 1
                if end == n and html[-1:] != ">":
                    break
            else:
                end = rest.end()
            tag, attrs, at = m.group().lower(), html[m.end() : end - 1], end
            if tag in BLOCK or tag == "br":
                block += tag != "br"
                if tag == "br":
                    text(" ")
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[depth]] == tag:
                        close(depth)
                        break
                    if self.tag[stack[depth]] in NEVER or tag not in BLOCK and self.tag[stack[depth]] in BLOCK:
                        break  # an inline end tag ends no block, and none ends what is left out from inside
                continue
            if tag in CLOSES:
                ends, borders = CLOSES[tag]
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[depth]] in borders:
                        break
                    if self.tag[stack[depth]] in ends:
                        close(depth)
                        break
            if tag in BLOCK:
                for depth in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[depth]]
                    if t == "p" or t[0] == "h" and t in ("h1", "h2", "h3", "h4", "h5", "h6"):
                        close(depth)
                        break
                    if t in BLOCK or t in NEVER:
                        break
            if tag == "body":
                close(1)  # a head that was never closed ends here
            why = _surrounds(tag, attrs, articles > 0)
            left_out = why != "" and (why == "tag" or len(self.tag) not in stay)
            if tag in RAW:
                # its text runs to its end tag and is markup or left out
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = n if end is None else end.start()
            if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
                if not out and not left_out and tag not in FORMAT:
                    self.tags[stack[-1]] += 1
                continue
            is_article, is_link, is_hard = tag == "article", tag == "a", why == "tag"
            is_cut = left_out and not is_hard and not hard
            if is_cut:
                around = self.cuts[cuts[-1]][2] if cuts else stack[-1]
                self.cuts.append([len(self.tag), why, around, cuts[-1] if cuts else -1, 0])
                cuts.append(len(self.cuts) - 1)
            if out or left_out:
                self.tag.append(tag)
                self.parent.append(0)  # not in the tree; takes its tag back below
                self.chars.append(0)
                self.link_chars.append(0)
                self.tags.append(-1)
                self.link_tags.append(-1 if is_link else 0)
            else:
                self.tag.append(tag)
                self.parent.append(stack[-1])
                self.chars.append(0)
                self.link_chars.append(0)
                self.tags.append(0)
                self.link_tags.append(0)
            stack.append(len(self.tag) - 1)
            outer.append((left_out, is_hard, is_cut, is_article, is_link))
            out += left_out
            hard += is_hard
            articles += is_article
            links += is_link
        close(1)

    def densities(self) -> list[float]:
        body = next((i for i, t in enumerate(self.tag) if t == "body" and self.chars[i]), 0)
        share = self.link_chars[body] / max(self.chars[body], 1)
        out = []
        for c, lc, t, lt in zip(self.chars, self.link_chars, self.tags, self.link_tags):
            if c <= 0:
                out.append(0.0)
                continue
            t, lt, links = max(t, 1), max(lt, 1), max(lc, 1)
            base = math.log(c / max(c - lc, 1) * links + share * c + math.e)
            out.append(c / t * math.log(max(c / links * t / lt, 1.0)) / math.log(base))
        return out

    def content(self) -> list[bool]:
        """Which nodes are in the main text."""
        n, dens = len(self.tag), self.densities()
        sums = [0.0] * n
        for i in range(n - 1, 0, -1):
            sums[self.parent[i]] += sums[i] if self.tag[i] in FORMAT else dens[i]
        body = next((i for i, t in enumerate(self.tag) if t == "body" and self.chars[i]), 0)
        # most[i]: the node of the largest sum in the subtree of i; the outer one of equals
        most = list(range(n))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if self.chars[i] > 0 and sums[most[i]] > sums[most[p]]:
                most[p] = most[i]
        target = most[body]
        threshold, i = dens[target], target
        while i > body:
            threshold = min(threshold, dens[i])
            i = self.parent[i]
        inside = [False] * n
        inside[target] = True
        if target > body:
            sparsest = min((dens[i] for i in range(target + 1, n) if self.parent[i] == target and dens[i] > 0), default=0.0)
            under, near = [False] * n, [False] * n
            under[body] = near[self.parent[target]] = True
            for i in range(body + 1, n):
                under[i] = under[self.parent[i]]
                near[i] = near[i] or near[self.parent[i]]
                if under[i] and self.chars[i] > 0 and dens[i] >= threshold and (near[i] or max(dens[i], sums[most[i]]) >= sparsest):
                    inside[most[i]] = True
        for i in range(1, n):
            inside[i] = inside[i] or inside[self.parent[i]]
        return inside

    def text(self) -> str:
        if not self.pieces:
            return ""
        inside = self.content()
        out: list[str] = []
        last, held = -1, []
        for node, block, s in self.pieces:
            if inside[node]:
                if block != last:
                    out.append("".join(held))
                    held, last = [], block
                held.append(s)
        out.append("".join(held))
        return "\n".join(t for x in out if (t := _SPACE.sub(" ", x).strip()))


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def _texts(html: pd.Series) -> pd.Series:
    return pd.Series([main_text(x) for x in html], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page (page_id, url, html); no shuffle."""
    rows = own(pages, "page_id", "url", "html").select("page_id", "url", F.pandas_udf(_texts, "string")("html").alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
