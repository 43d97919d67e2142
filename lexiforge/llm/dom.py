"""A tolerant HTML reader: a light tree of elements and the text blocks in page order."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>)|[^>]*>)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template annotation annotation-xml desc metadata".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input button select math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mpadded mphantom semantics svg g tspan".split())
#: Drawing and formula elements, which may close themselves.
SELF_CLOSING = frozenset("svg g path rect circle ellipse line polyline polygon use image text tspan mspace mi mn mo mtext none mprescripts".split())
#: A start tag closes an open element of these kinds.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An end tag or a closing start tag does not look past these.
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
#: What is not part of an article.
NOISE_TAGS = frozenset("nav footer aside form button select fieldset dialog menu object embed canvas audio video map head".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer disqus footer gdpr hidden login menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo "
    "promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toolbar topbar widget".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass(slots=True)
class Node:
    tag: str
    name: str  # tag with its first class or id
    parent: int
    noise: bool
    main: bool
    texts: list[str] = field(default_factory=list)
    children: list[int] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    node: int
    text: str
    link: int  # characters inside links


def _kind(tag: str, raw: str, inside_main: bool) -> tuple[str, bool, bool]:
    """(name, noise, main) of an element by its tag and attributes."""
    if len(raw) < 4:
        return tag, tag in NOISE_TAGS or (tag == "header" and not inside_main), tag in ("article", "main")
    attrs = {}
    for m in _ATTRIBUTE.finditer(raw):
        attrs.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    label = attrs.get("class", "") + " " + attrs.get("id", "")
    words = {w.lower() for w in _WORDS.findall(label)}
    role = attrs.get("role", "").lower()
    main = tag in ("article", "main") or role == "main" or attrs.get("itemprop") == "articleBody"
    noise = tag in NOISE_TAGS or role in NOISE_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    noise = noise or bool(words & NOISE_WORDS) or ("header" in words or tag == "header") and not inside_main
    first = label.split()
    return f"{tag}.{first[0]}" if first else tag, noise, main


def read(page: str) -> tuple[list[Node], list[Block]]:
    """Elements in document order (the first is the root) and non-empty text blocks."""
    nodes = [Node("#", "#", -1, False, False)]
    blocks: list[Block] = []
    stack = [0]
    pieces: list[str] = []
    link, block_at, in_link = 0, 0, 0
    at, size = 0, len(page)
    lower: str | None = None

    def flush() -> None:
        nonlocal link
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                blocks.append(Block(block_at, text, min(link, len(text))))
                nodes[block_at].texts.append(text)
            pieces.clear()
        link = 0

    while at < size:
        m = _MARKUP.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            if not pieces:
                # The nearest element that is not inline holds the block.
                k = len(stack) - 1
                while k and nodes[stack[k]].tag in INLINE:
                    k -= 1
                block_at = stack[k]
                if nodes[stack[-1]].noise:
                    block_at = stack[-1]
            pieces.append(page[at:stop])
            if in_link:
                link += stop - at
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in VOID:
                if tag == "br":
                    flush()
                continue
            if tag not in INLINE:
                flush()
            scope = SCOPES.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[k]].tag
                if open_tag == tag:
                    if tag in INLINE and nodes[stack[k]].noise:
                        flush()
                    in_link -= sum(nodes[s].tag == "a" for s in stack[k:])
                    del stack[k:]
                    break
                if open_tag in scope:
                    break
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        raw = m[3][:-1]
        if tag in RAW:
            if lower is None:
                lower = page.lower()
            end = lower.find(f"</{tag}", at)
            if end < 0:
                at = size if tag in ("script", "style", "textarea", "title") else at
            else:
                close = page.find(">", end)
                at = size if close < 0 else close + 1
            continue
        closes = ("p",) if tag in CLOSES_P else CLOSES.get(tag, ())
        if closes:
            scope = SCOPES.get(tag, ()) if tag not in CLOSES_P else ("td", "th", "button", "article", "main", "section", "div", "blockquote", "li", "table")
            cut = 0
            for k in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[k]].tag
                if open_tag in closes:
                    cut = k
                    if tag in CLOSES_P:
                        break
                elif open_tag in scope:
                    break
            if cut:
                in_link -= sum(nodes[s].tag == "a" for s in stack[cut:])
                del stack[cut:]
        parent = nodes[stack[-1]]
        name, noise, main = _kind(tag, raw, parent.main)
        if noise and tag in INLINE and not parent.noise:
            flush()  # its text is no part of the block around it
        nodes.append(Node(tag, name, stack[-1], noise or parent.noise, main or parent.main))
        parent.children.append(len(nodes) - 1)
        if not raw.endswith("/") or tag not in SELF_CLOSING:
            stack.append(len(nodes) - 1)
            in_link += tag == "a"
    flush()
    return nodes, blocks


def path_of(nodes: list[Node], k: int) -> str:
    """The names of the elements from the root to k."""
    parts = []
    while k > 0:
        parts.append(nodes[k].name)
        k = nodes[k].parent
    return "/".join(reversed(parts))
