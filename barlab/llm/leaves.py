"""Leaf blocks of a page: stretches of text that no block element divides, with what surrounds them."""
from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

# Fixed values of HTML: elements whose content is no text of the page, void elements, elements that do not divide text.
HIDDEN = "script style noscript template textarea title iframe xmp noembed noframes select option svg math canvas object audio video datalist button".split()
RAW = "script style textarea title iframe xmp noembed noframes noscript".split()
VOID = set("area base br col embed hr img input link meta source track wbr param".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
             "time tt u var wbr br img input embed area map".split())
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
# A start tag of the key closes an open element of the values, up to one of the borders.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
BORDERS = {"ul", "ol", "menu", "dl", "table", "body"}

_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)
    |<(?P<raw>{"|".join(RAW)})(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*+>(?P<body>.*?)(?:</(?P=raw)\s*>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>
    |<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*)>
    |<[!?/][^>]*>""", re.S | re.I | re.X)
_OPEN, _CLOSED = re.compile(rf"<(!--|(?:{'|'.join(RAW)})(?=[\s/>]))", re.I), re.compile(rf"(-->|</(?:{'|'.join(RAW)})\s*>)\Z", re.I)
_ATTR = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Leaf:
    """``around``: names of the elements above, ``own`` and ``outer`` those of the innermost block element and of the
    one that holds it. ``sibling``: the block before lies in the same element and has the same class words. ``mark``:
    value of the mark attribute of the nearest element that has one."""
    text: str
    around: tuple[str, ...]
    own: tuple[str, ...]
    outer: tuple[str, ...]
    link_chars: int
    sibling: bool
    mark: str | None
    names: list[str] = field(default_factory=list)


@lru_cache(maxsize=8192)
def _described(tag: str, attrs: str, mark: str) -> tuple[tuple[str, ...], str | None, bool]:
    """Names an element gives to all inside, its mark, and whether it is not shown."""
    names, marked, hidden = [] if tag in INLINE else [f"<{tag}>"], None, False
    for k, v in _ATTR.findall(attrs):
        k, v = k.lower(), v.strip("\"'").lower()
        if k in ("class", "id", "role"):
            names += [f".{w}" for w in _WORDS.findall(v)]
        elif k == mark:
            marked = v
        elif k == "hidden" or k == "style" and "display:none" in v.replace(" ", ""):
            hidden = True
    return tuple(dict.fromkeys(names)), marked, hidden


def leaves(page: str | None, mark: str = "data-main") -> tuple[str, list[Leaf]]:
    """Title and leaf blocks in page order. Null, empty and text-free pages have none. End tags may be missing or
    too many; comments, scripts, styles and form fields hold no text. Character references are decoded, white space
    becomes one space. Time and memory follow the length of the page."""
    title, out = "", []
    stack: list[tuple] = []                               # tag, names, mark before, not shown before, serial
    open_tags: dict[str, int] = {}
    active: dict[str, int] = {}
    state = {"mark": None, "dark": 0, "links": 0, "serial": 0}
    before = None
    parts: list[str] = []
    first: list = []                                      # of the block being read: around, mark, own, outer, serial of outer
    links: list[str] = []

    def flush() -> None:
        nonlocal before
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                around, marked, own, outer, serial = first
                place = serial, [n for n in own if n[0] == "."]
                out.append(Leaf(text, around, own, outer, len(" ".join(html.unescape("".join(links)).split())), place == before, marked))
                before = place
            parts.clear()
            links.clear()
            first.clear()

    def pop() -> str:
        tag, names, marked, dark, _ = stack.pop()
        for n in names:
            if active[n] == 1:
                del active[n]
            else:
                active[n] -= 1
        open_tags[tag] -= 1
        state["mark"], state["dark"] = marked, dark
        state["links"] -= tag == "a"
        return tag

    def place() -> tuple:
        depth = len(stack) - 1
        while depth >= 0 and stack[depth][0] in INLINE:
            depth -= 1
        return stack[depth][1] if depth >= 0 else (), *((stack[depth - 1][1], stack[depth - 1][4]) if depth > 0 else ((), 0))

    def add(text: str) -> None:
        if state["dark"] or not text:
            return
        if not first and not text.isspace():
            first.extend((tuple(active), state["mark"], *place()))
        parts.append(text)
        if state["links"]:
            links.append(text)

    page, at = page or "", 0
    last = page.rfind(">") + 1                            # no tag ends after it
    for m in _TOKEN.finditer(page, 0, last):
        add(page[at:m.start()])
        at = m.end()
        raw = m["raw"]
        if at == last and _OPEN.match(m[0]) and not _CLOSED.search(m[0]):
            at = len(page)
        if raw:
            if raw.lower() == "title" and not title:
                title = " ".join(html.unescape(m["body"]).split())
            if raw.lower() not in INLINE:
                flush()
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        elif tag in ("br", "img", "wbr"):
            if tag == "br":
                add(" ")
            continue
        if m["end"] or m["end2"]:
            if tag in HEADINGS and not open_tags.get(tag):
                tag = next((h for h in HEADINGS if open_tags.get(h)), tag)
            if open_tags.get(tag):
                while pop() != tag:
                    pass
            continue
        if tag in VOID:
            continue
        if tag not in INLINE and open_tags.get("p") and tag != "html":
            while pop() != "p":
                pass
        if tag in CLOSES and any(open_tags.get(t) for t in CLOSES[tag]):
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] not in CLOSES[tag] and stack[depth][0] not in BORDERS:
                depth -= 1
            if depth >= 0 and stack[depth][0] in CLOSES[tag]:
                while len(stack) > depth:
                    pop()
        names, marked, unseen = _described(tag, m["attrs"] or m["attrs2"] or "", mark)
        state["serial"] += 1
        stack.append((tag, names, state["mark"], state["dark"], state["serial"]))
        for n in names:
            active[n] = active.get(n, 0) + 1
        open_tags[tag] = open_tags.get(tag, 0) + 1
        state["links"] += tag == "a"
        if marked is not None:
            state["mark"] = marked
        if unseen or tag in HIDDEN:
            state["dark"] = 1
    add(page[at:].partition("<!--")[0])
    flush()
    return title, out


_END = ".!?…:;\"'»”)。！？"


def bucket(n: int) -> int:
    return min(int(n).bit_length(), 10)


def described(title: str, found: list[Leaf]) -> list[Leaf]:
    """Fills ``names`` with the names of all features of each block: what is around it, its text and its place."""
    n, lower = len(found), title.lower()
    for i, b in enumerate(found):
        t = b.text
        words = t.count(" ") + 1
        f = [*b.around, *(f"own {x}" for x in b.own), *(f"outer {x}" for x in b.outer)]
        f.append(f"words {bucket(words)}")
        f.append(f"linked {b.link_chars * 4 // len(t)}")
        if t[-1] in _END:
            f.append("ends a sentence")
        f.append(f"commas {bucket(t.count(','))}")
        f.append(f"stops {bucket(t.count('. '))}")
        if "©" in t or "@" in t:
            f.append("sign")
        if sum(map(str.isdigit, t[:80])) * 3 > min(len(t), 80):
            f.append("digits")
        if len(t) > 3 and (t.lower() in lower or len(lower) > 12 and t.lower().startswith(lower)):
            f.append(f"title {b.own[0] if b.own else ''}")
        f.append(f"from top {bucket(i)}")
        f.append(f"from end {bucket(n - 1 - i)}")
        f.append("sibling" if b.sibling else "no sibling")
        b.names = f
    return found


def read(page: str | None) -> list[Leaf]:
    return described(*leaves(page))


def labelled(pages: Iterator[str]) -> list[tuple[list[Leaf], list[int]]]:
    """Blocks and labels (1: main text) of pages whose elements are marked with data-main="1" or "0"."""
    out = []
    for p in pages:
        b = read(p)
        out.append((b, [int(x.mark == "1") for x in b]))
    return out
