"""Main text of web pages by tree scoring.

A page becomes a tree of its elements, and its text blocks: runs of inline text
between the borders of block elements. Elements that are never main text, by tag,
role or a word of their class or id, are left out with all they hold. Each other
block passes points for its length and its commas to its container, half of them
to the next one out and less to those further out. A container's points are
discounted by the share of its text that stands in links. The container with
most points is kept, with those of its siblings that score well beside it or are
plain paragraphs; lists and boxes of links inside are dropped.
An article element around the best container stands for it.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgemill.llm.textops import blocks

# Elements by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: What an opening tag closes, up to the nearest of the elements that bound it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Elements, roles and words of class or id that are never main text.
UNWANTED = RAW | frozenset("head nav header footer aside form dialog menu button select input label fieldset svg canvas object embed audio video map search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination pagehead popup promo promos promotion related recommended respond share sharing shoutbox sidebar signup skyscraper social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split())
WANTED = frozenset("article articlebody body content entry main page post story text".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: First words of a class that tells of a page's layout, not of the element.
LAYOUT = frozenset("has with without no is layout page".split())
#: Elements that may be nested; deeper ones stand beside each other, as in browsers.
DEPTH = 512


class _Node:
    """An element: where it hangs, the points it got, and its text, of which in links."""

    __slots__ = ("cut", "link", "linked", "links", "size", "parent", "points", "tag", "words")

    def __init__(self, tag: str, parent: _Node | None, words: frozenset = frozenset(), cut: bool = False, linked: bool = False) -> None:
        self.tag, self.parent, self.words, self.cut, self.linked = tag, parent, words, cut, linked
        self.points, self.size, self.link, self.links = 0.0, 0, 0, 0


def _named(raw: str) -> tuple[frozenset, bool]:
    """The words of an element's class and id, and whether its attributes say that
    it is no main text: hidden, by its role, or by a class or id with one of WORDS
    beside which no class or id is a plain one of WANTED."""
    words, out, bad, good = set(), False, False, False
    for name, *values in ATTRIBUTE.findall(raw):
        name, value = name.lower(), html.unescape(max(values, key=len))
        if name in ("class", "id", "itemprop"):
            for each in value.split():
                own = [w.lower() for w in WORD.findall(each)]
                if own and (len(own) == 1 or own[0] not in LAYOUT):
                    words.update(own)
                    bad |= not WORDS.isdisjoint(own)
                    good |= WANTED.issuperset(own)
        elif name == "role":
            out |= value.strip().lower() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            out = True
    return frozenset(words), out or bad and not good


def _read(page: str) -> list[tuple[_Node, str]]:
    """The text blocks of a page in order, each with the block element it stands in."""
    root = _Node("html", None)
    stack, found, text, linked = [root], [], [], 0
    box = root  # the innermost block element

    def end() -> None:
        nonlocal linked
        if text:
            line = " ".join("".join(text).split())
            text.clear()
            if line:
                found.append((box, line))
                node, link = box, min(linked, len(line))
                while node is not None:
                    node.size, node.link = node.size + len(line), node.link + link
                    node = node.parent
            linked = 0

    def close(at: int) -> None:
        nonlocal box
        if any(node.tag in BLOCK for node in stack[at:]):
            end()
        del stack[at:]
        box = next((node for node in reversed(stack) if node.tag in BLOCK), root)

    at, lower = 0, None
    while at < len(page):
        token = TOKEN.match(page, at)
        at = token.end()
        shut, tag, raw = token[1], token[2], token[3]
        if token[5] is not None:
            shut, tag, raw = token[4], token[5], token[6]
        if tag is None:
            said = token[0]
            if said[0] != "<" or len(said) == 1:
                if not stack[-1].cut:
                    said = html.unescape(said)
                    text.append(said)
                    if stack[-1].linked:
                        linked += len(said)
            continue
        tag = tag.lower()
        if shut:
            if tag == "br":
                text.append(" ")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline end does not close blocks
            continue
        if tag in ("br", "wbr", "hr"):
            if tag == "hr":
                end()
            elif tag == "br" and not stack[-1].cut:
                text.append(" ")
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            end()
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in ("td", "th", "button", "object", "caption"):
                    break
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    close(k)
                    break
                if stack[k].tag in bounds:
                    break
        words, out = _named(raw) if raw.strip(" /") else (frozenset(), False)
        cut = stack[-1].cut or tag in UNWANTED or tag not in ("html", "body", "article", "main") and out
        if tag in RAW or tag == "title":
            lower = page.lower() if lower is None else lower
            lower = lower if len(lower) == len(page) else page
            finish = lower.find(f"</{tag}", at)
            at = len(page) if finish < 0 else page.find(">", finish) + 1 or len(page)
            continue
        if len(stack) > DEPTH:
            close(len(stack) - 1)
        node = _Node(tag, box if tag in BLOCK else stack[-1], words, cut, stack[-1].linked or tag == "a")
        stack.append(node)
        if tag == "a":
            for up in _up(box):
                up.links += 1
        if tag in BLOCK:
            box = node
        if raw.endswith("/") and tag not in BLOCK:
            stack.pop()
    end()
    return found


def _up(node: _Node | None):
    while node is not None:
        yield node
        node = node.parent


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by a line feed; '' if it has none."""
    found = _read(page or "")
    nodes: dict[int, _Node] = {}
    for box, line in found:
        points = 1 + line.count(",") + line.count("、") + line.count("，") + min(len(line) / 100, 3)
        points *= 1 - (box.link / box.size if box.tag in ("p", "td", "pre", "li") else 0)
        inner = box.tag not in ("div", "section", "article", "main", "body", "td", "html")
        for level, node in enumerate(_up(box.parent if inner and box.parent else box)):
            nodes[id(node)] = node
            node.points += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
    if not nodes:
        return ""
    bonus = lambda n: (25 if n.tag in ("article", "main") else 0) + (10 if n.words & WANTED and n.tag in ("div", "section", "td") else 0)
    score = lambda n: (n.points + bonus(n)) * (1 - n.link / max(n.size, 1))
    best = max(nodes.values(), key=score)
    best = next((node for node in _up(best) if node.tag == "article"), best)
    least = max(10.0, 0.2 * score(best))

    def kept(box: _Node, line: str) -> bool:
        for node in _up(box):
            if node is best:
                return True
            if node.parent is best.parent and node.parent is not None:  # a sibling
                density = node.link / max(node.size, 1)
                plain = node.tag == "p" and (density < 0.25 if node.size > 80 else density == 0 and re.search(r"[.!?。](\s|$)", line) is not None)
                plain |= node.tag in ("h1", "h2", "h3") and density == 0
                return plain or id(node) in nodes and score(node) >= least and density < 0.5
            if node.tag in ("ul", "ol", "dl", "table", "div", "section") and node.links > 1 and node.link > 0.5 * node.size:
                return False
        return False

    return "\n".join(line for box, line in found if kept(box, line))


def extract(pages: DataFrame) -> DataFrame:
    """`pages` (html and any other columns) with text and n_chars in place of html.

    Every row gives one row. Null and empty pages, and those of menus alone, have
    an empty text. Character references are decoded, white space inside a block
    (line breaks too) is one space, blocks are joined by a line feed. Pages of any
    length are read whole, one after the other.
    """
    plain = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in plain)

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "html"):
                texts = [main_text(page) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in plain), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*plain, "text", "n_chars"])

    return pages.select(*plain, F.col("html").cast("string").alias("html")).mapInArrow(run, f"{kinds}, text string, n_chars long")
