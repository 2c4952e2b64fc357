"""Labelled pages for training: built by rule, elements marked data-main="1" (main text) or "0"."""
from __future__ import annotations

import random

# Names that sites give to parts of a page.
MENU = "nav menu navbar navigation topnav mainmenu breadcrumb breadcrumbs sitenav pagination pager toc links".split()
HEAD = "header masthead banner top branding logo site head topbar".split()
FOOT = "footer foot bottom copyright legal colophon credits imprint siteinfo".split()
SIDE = "sidebar aside widget rail secondary right left complementary related recommended popular trending teaser more tags archive".split()
NOTICE = "cookie notice consent gdpr alert banner message warning popup modal overlay privacy disclaimer announcement toast info".split()
ADVERT = "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp commercial partner offer banner".split()
FORM = "form newsletter subscribe signup search login contact subscription register input".split()
COMMENT = "comment comments reply replies commentlist respond discussion disqus thread responses reader feedback talk".split()
SHARE = "share social sharing meta byline author date tools actions buttons follow posted".split()
MAIN = "content article post entry story body main text page single maincontent articlebody prose copy".split()
SYLLABLES = "the on ti er re ha ou sch ver ein ge ción os la en à é ñ ü mar to lin vo ka su ri da mo pe 日 本 ст ра 12 7".split()


class Writer:
    """One random page. ``plain`` pages have few speaking names; ``rough`` ones leave end tags out."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.plain, self.rough = self.r.random() < 0.06, self.r.random() < 0.3

    def words(self, low: int, high: int, stop: float = 0.1) -> str:
        r, out = self.r, []
        for _ in range(r.randint(low, high)):
            w = "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
            out.append(w + (r.choice(".,.;") if r.random() < stop else "") + ("&amp;" if r.random() < 0.01 else ""))
        return " ".join(out)

    def sentence(self, low: int = 4, high: int = 60) -> str:
        s = self.words(low, high)
        return (s[:1].upper() + s[1:]).rstrip(",;.") + self.r.choice("....?!")

    def attrs(self, names: list[str], often: float = 0.9) -> str:
        r = self.r
        if self.plain and r.random() < 0.6 or r.random() > often:
            return r.choice(["", "", f' class="c{r.randint(1, 99)}"'])
        parts = [r.choice(names)] + ([r.choice(["wrap", "box", "block", "inner", "section", "col", "container", "list"])] if r.random() < 0.4 else [])
        r.shuffle(parts)
        return f' {r.choice(["class", "class", "id"])}="{r.choice(["-", "_", " "]).join(parts)}"'

    def element(self, tag: str, attrs: str, inner: str) -> str:
        return f"<{tag}{attrs}>{inner}" + ("" if self.rough and tag in ("p", "li") and self.r.random() < 0.5 else f"</{tag}>")

    def links(self, low: int = 2, high: int = 9) -> str:
        return "".join(self.element("li", "", f'<a href="/{self.r.randint(1, 999)}">{self.words(1, 4, 0.05)}</a>') for _ in range(self.r.randint(low, high)))

    def paragraph(self, mark: str = "") -> str:
        r = self.r
        s = self.sentence(1 if r.random() < 0.2 else 5, r.choice([6, 30, 90, 160]))
        if r.random() < 0.25:
            cut = s.find(" ", len(s) // 2)
            s = f"{s[:cut]} <{r.choice(['b', 'em', 'i', 'strong', 'span'])}>{s[cut + 1:]}" if self.rough or r.random() < 0.4 else f'{s[:cut]} <a href="#">{s[cut + 1:]}</a>'
        if r.random() < 0.1:
            s = f"{s}<br>{self.sentence(2, 20)}"
        return self.element("p", mark, s)

    def boilerplate(self, kind: str) -> str:
        r, a = self.r, self.attrs
        if kind == "menu":
            return self.element(r.choice(["nav", "div", "nav", "ul"]), a(MENU), r.choice(["<ul>%s</ul>", "<div>%s</div>", "%s"]) % self.links())
        if kind == "head":
            inner = r.choice(["<h1>%s</h1>", "<div>%s</div>", "<a href='/'>%s</a>", "<p>%s</p>", "%s"]) % self.words(1, 8)
            return self.element(r.choice(["header", "div"]), a(HEAD), inner + (f"<p>{self.sentence(3, 15)}</p>" if r.random() < 0.4 else ""))
        if kind == "foot":
            inner = r.choice(["&copy; %s", "<p>%s</p>", "%s", "<small>%s</small>", "<div>%s</div>"]) % self.sentence(2, 30)
            return self.element(r.choice(["footer", "div", "footer"]), a(FOOT), inner + (f"<ul>{self.links(1, 4)}</ul>" if r.random() < 0.3 else "") + (self.paragraph() if r.random() < 0.3 else ""))
        if kind == "side":
            inner = (f"<h{r.randint(2, 4)}>{self.words(1, 4)}</h3>" if r.random() < 0.5 else "") + r.choice([f"<ul>{self.links(1, 6)}</ul>", self.paragraph(), self.paragraph() + self.paragraph(), self.sentence()])
            return self.element(r.choice(["aside", "div", "section", "aside"]), a(SIDE), inner)
        if kind == "notice":
            inner = r.choice(["<p>%s</p>", "%s", "<span>%s</span>"]) % self.sentence(4, 40) + ("<button>OK</button>" if r.random() < 0.5 else "")
            return self.element(r.choice(["div", "div", "section", "aside", "p"]), a(NOTICE, 1.0) + (' role="alert"' if r.random() < 0.2 else ""), inner)
        if kind == "advert":
            inner = r.choice(["%s", "<p>%s</p>", "<a href='/x'>%s</a>", "<span>%s</span>"]) % self.sentence(2, 40)
            return self.element(r.choice(["div", "div", "aside", "section", "ins", "p"]), a(ADVERT, 1.0), inner)
        if kind == "form":
            inner = f"<label>{self.words(1, 5)}</label><input name=q>" + (f"<p>{self.sentence(3, 20)}</p>" if r.random() < 0.5 else "") + f"<button>{self.words(1, 2)}</button>"
            return self.element("form", a(FORM, 0.6), inner) if r.random() < 0.8 else self.element("div", a(FORM, 1.0), inner)
        if kind == "share":
            return self.element(r.choice(["div", "ul", "p", "div"]), a(SHARE, 1.0), r.choice([self.words(1, 6), f"<span>{self.words(1, 4)}</span>", f"<time>{r.randint(1, 28)}.{r.randint(1, 12)}.2024</time>"]))
        one = lambda: self.element(r.choice(["div", "li", "article", "p", "div"]), a(COMMENT, 0.6), r.choice(["", f"<b>{self.words(1, 2, 0)}</b> "]) + r.choice([self.sentence(2, 70), self.paragraph(), self.paragraph() + self.paragraph()]))
        inner = (f"<h{r.randint(2, 3)}>{self.words(1, 3)}</h3>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 5)))
        return self.element(r.choice(["section", "div", "ol", "ul", "div"]), a(COMMENT, 1.0), inner + (self.boilerplate("form") if r.random() < 0.3 else ""))

    def main(self) -> str:
        r, out = self.r, []
        head = f"<h1>{self.title}</h1>"
        if r.random() < 0.15:
            out.append(f'<header>{head}<p data-main="0" class="{r.choice(SHARE)}">{self.words(2, 6)}</p></header>')
        elif r.random() < 0.9:
            out.append(head)
        for i in range(r.choice([1, 2, 4, 8, 14])):
            k = r.random()
            out.append(f"<h{r.randint(2, 4)}>{self.words(1, 8, 0)}</h3>" if k < 0.08 and i else f"<ul>{''.join(self.element('li', '', self.sentence(2, 20)) for _ in range(r.randint(1, 4)))}</ul>" if k < 0.13
                       else f"<blockquote>{self.paragraph()}</blockquote>" if k < 0.17 else f"<pre><code>{self.words(2, 30)}</code></pre>" if k < 0.19
                       else f"<table><tr><td>{self.words(1, 6)}<td>{self.words(1, 6)}</table>" if k < 0.21 else f"<div>{self.sentence()}</div>" if k < 0.26 else self.paragraph())
            if r.random() < 0.07:
                out.append(self.boilerplate_marked())
        if r.random() < 0.15:
            out.append(self.boilerplate_marked(["comment", "share", "side", "foot"]))
        return "".join(out)

    def boilerplate_marked(self, kinds: list[str] | None = None) -> str:
        s = self.boilerplate(self.r.choice(kinds or ["advert", "advert", "side", "form", "notice", "share"]))
        cut = min(i for i in (s.find(" "), s.find(">")) if i > 0)
        return f'{s[:cut]} data-main="0"{s[cut:]}'

    def page(self) -> str:
        r = self.r
        self.title = self.words(1, 12, 0.05)
        tag = r.choice(["article", "article", "article", "main", "div", "section", "div"])
        names = self.attrs(MAIN, 0.5 if tag in ("article", "main") else 1.0)
        body = f'<{tag}{names} data-main="1">{self.main()}</{tag}>'
        for _ in range(r.choice([0, 0, 1, 2])):
            body = self.element(r.choice(["div", "main", "section"]), r.choice(["", ' class="container"', ' id="wrapper"', self.attrs(MAIN)]), body)
        pick = lambda kinds: "".join(self.boilerplate(k) for k, p in kinds if r.random() < p)
        before = pick([("notice", 0.25), ("head", 0.4), ("menu", 0.75), ("form", 0.15), ("advert", 0.4), ("side", 0.2)])
        after = pick([("share", 0.15), ("advert", 0.2), ("comment", 0.35), ("side", 0.3), ("form", 0.15), ("menu", 0.1), ("foot", 0.75), ("notice", 0.15)])
        if self.r.random() < 0.2:
            before, after = f"<div{self.attrs(['container', 'wrapper', 'site'])}>{before}", f"{after}</div>"
        return (f'<!DOCTYPE html><html lang="xx"><head><title>{self.title} {r.choice(["", "| " + self.words(1, 3, 0)])}</title><style>p{{}}</style></head>'
                f"<body>{before}{'<!-- x -->' if r.random() < 0.5 else ''}{body}{after}</body></html>")


def pages(first: int, n: int) -> list[str]:
    """Pages number ``first`` to ``first + n - 1``."""
    return [Writer(i).page() for i in range(first, first + n)]
