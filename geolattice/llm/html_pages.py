"""Made-up labelled pages, on which the model of operator 1 is trained.

Pages are put together at random from the parts that sites have (menus, headers, sidebars, notices, adverts, forms,
comments, footers) around and inside an article, with telling, odd or no attributes. The attribute ``data-keep``
says what is article text; nothing else of a page's making reaches the features.
"""

from __future__ import annotations

import random

#: Attribute names by part, as sites use them.
NAMES = {
    "nav": ("nav", "menu", "navbar", "main-menu", "breadcrumbs", "navigation", "site-nav", "toc-menu", "topnav"),
    "header": ("header", "site-header", "masthead", "topbar", "page-header", "branding", "top"),
    "footer": ("footer", "site-footer", "bottom", "colophon", "page-footer", "legal", "copyright"),
    "side": ("sidebar", "side", "aside", "widget", "rail", "right-column", "widgets"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "sponsor"),
    "notice": ("cookie-banner", "notice", "consent", "alert", "popup", "modal", "gdpr", "newsletter-notice", "paywall"),
    "form": ("form", "search", "signup", "subscribe", "login", "newsletter", "search-form"),
    "comment": ("comments", "comment", "comment-list", "discussion", "responses", "disqus", "reply"),
    "share": ("share", "social", "related", "recommended", "tags", "more-stories", "read-next", "pager", "pagination"),
    "content": ("content", "article", "article-body", "post", "post-content", "entry", "entry-content", "story", "main", "text", "body-text"),
}
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ch ei sch que la os ción ment aux é ö".split()


class PageMaker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 22) -> str:
        return self.words(low, high).capitalize() + self.r.choice(("...?!"))

    def prose(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            s = self.sentence(1 if self.r.random() < 0.15 else 4)
            if self.r.random() < 0.15:
                s = self.r.choice((f'<a href="/{self.word()}">{self.word()}</a> ', f"<b>{self.word()}</b> ", f"<em>{self.words(1, 3)}</em> ", "&amp; ")) + s
            out.append(s)
        return " ".join(out)

    def attribute(self, part: str) -> str:
        """A telling, an odd, or no name."""
        roll = self.r.random()
        if roll < 0.62:
            name = self.r.choice(NAMES[part])
            if self.r.random() < 0.3:
                name += " " + self.word()
            return f' {self.r.choice(("class", "class", "id"))}="{name}"'
        return f' class="{self.word()}-{self.r.randint(1, 99)}"' if roll < 0.8 else ""

    def links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/{self.word()}">{self.words(1, 4).capitalize()}</a></li>' for _ in range(self.r.randint(low, high)))

    def wrapped(self, part: str, tags: tuple[str, ...], inner: str) -> str:
        tag = self.r.choice(tags)
        named = self.attribute(part)
        # A plain container with text like an article's must tell itself by its name.
        if tag in ("div", "p", "section") and part in ("ad", "notice", "comment", "side") and not any(n in named for n in NAMES[part]):
            named = f' class="{self.r.choice(NAMES[part])}"'
        return f'<{tag}{named} data-keep="0">{inner}</{tag}>'

    def nav(self) -> str:
        return self.wrapped("nav", ("nav", "div", "nav", "section"), f"<ul>{self.links(3, 12)}</ul>" if self.r.random() < 0.8 else " | ".join(f'<a href="#">{self.word()}</a>' for _ in range(self.r.randint(3, 8))))

    def header(self) -> str:
        inner = f"<a href='/'>{self.words(1, 3)}</a>" + (f"<p>{self.sentence(3, 9)}</p>" if self.r.random() < 0.5 else "")
        return self.wrapped("header", ("header", "div"), inner + (self.nav() if self.r.random() < 0.4 else ""))

    def footer(self) -> str:
        inner = self.r.choice((f"&copy; {self.r.randint(1999, 2026)} {self.words(1, 4)}", f"&copy; {self.word()}.example &middot; {self.sentence(3, 14)}", f"<p>{self.sentence(4, 14)}</p><ul>{self.links(2, 6)}</ul>", f"<ul>{self.links(3, 8)}</ul><p>All rights reserved. {self.words(2, 6)}</p>"))
        return self.wrapped("footer", ("footer", "footer", "div"), inner)

    def side(self) -> str:
        inner = self.r.choice((f"<h3>{self.words(1, 3)}</h3><ul>{self.links(3, 8)}</ul>", f"<h4>{self.words(1, 3)}</h4><p>{self.prose(1, 3)}</p>", f"<p>{self.prose(1, 2)}</p>"))
        return self.wrapped("side", ("aside", "aside", "div"), inner)

    def ad(self) -> str:
        return self.wrapped("ad", ("div", "div", "section", "aside"), self.r.choice((self.prose(1, 4), f"<p>{self.prose(1, 3)}</p>", f"<a href='/x'>{self.sentence(3, 9)}</a>", f"<h4>{self.words(2, 5)}</h4><p>{self.sentence()}</p>")))

    def notice(self) -> str:
        return self.wrapped("notice", ("div", "div", "section", "dialog"), self.r.choice((f"<p>{self.prose(1, 3)}</p><button>OK</button>", self.prose(1, 2), f"{self.sentence()} <a href='/p'>{self.words(1, 2)}</a>")))

    def form(self) -> str:
        return self.wrapped("form", ("form", "form", "div"), self.r.choice((f"<label>{self.words(1, 3)}</label><input name=q><button>Go</button>", f"<p>{self.sentence(4, 12)}</p><input type=email><button>{self.word()}</button>", f"<select><option>{self.word()}<option>{self.word()}</select><input type=submit value=x>")))

    def comments(self) -> str:
        one = lambda: self.r.choice((f"<li><b>{self.word()}</b> <p>{self.prose(1, 4)}</p></li>", f'<div class="comment"><span>{self.word()} {self.r.randint(1, 28)} May</span><p>{self.prose(1, 5)}</p><a href="#r">Reply</a></div>'))
        items = "".join(one() for _ in range(self.r.randint(1, 7)))
        return self.wrapped("comment", ("section", "div", "div"), f"<h3>{self.r.randint(1, 90)} {self.word()}</h3>" * (self.r.random() < 0.6) + (f"<ul>{items}</ul>" if items.startswith("<li") else items))

    def share(self) -> str:
        return self.wrapped("share", ("div", "ul", "section", "div"), self.r.choice((self.links(2, 6), f"<h3>{self.words(1, 3)}</h3><ul>{self.links(2, 6)}</ul>")))

    def article(self) -> str:
        parts = [f"<h1>{self.words(2, 9).capitalize()}</h1>"] if self.r.random() < 0.85 else []
        longest = self.r.choice((1, 2, 8, 8))  # some articles are of a sentence or two
        for _ in range(self.r.choice((1, 1, 2, 3, 5, 8, 12, 20))):
            roll = self.r.random()
            if roll < 0.62:
                close = "</p>" if self.r.random() < 0.7 else ""
                parts.append(f"<p>{self.r.choice(('', '', '', '<b>'))}{self.prose(1, longest)}{self.r.choice(('', '', '<br>'))}{close}")
            elif roll < 0.72:
                parts.append(f"<h{self.r.randint(2, 4)}>{self.words(1, 7)}</h{2}>")
            elif roll < 0.78:
                parts.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>")
            elif roll < 0.82:
                parts.append(f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>")
            elif roll < 0.86:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.r.randint(1, 999)}</td></tr>" for _ in range(self.r.randint(2, 5))) + "</table>")
            elif roll < 0.89:
                parts.append(f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>")
            elif roll < 0.92:
                parts.append(f"<div>{self.prose(1, 6)}</div>")
            elif roll < 0.94:
                parts.append(f"<pre>{self.words(4, 20)}</pre>")
            else:
                parts.append(self.r.choice((self.ad, self.share, self.form, self.notice, self.ad))())
        if self.r.random() < 0.1:
            parts.append(self.comments())
        if self.r.random() < 0.2 and parts[0].startswith("<h1"):
            parts[0] = f'<header{self.r.choice(("", " class=entry-header", " class=article-header"))}>{parts[0]}</header>'
        if self.r.random() < 0.2:
            links = f"<span>{self.words(1, 2)} <a href=x>{self.word()}</a></span>"
            parts.append(f'<footer{self.r.choice(("", " class=entry-footer", " class=post-meta"))} data-keep="0">{self.r.choice((links, f"<ul>{self.links(1, 4)}</ul>", self.sentence(3, 9)))}</footer>')
        tag = self.r.choice(("article", "article", "main", "div", "section", "div"))
        named = self.attribute("content") if tag != "div" or self.r.random() < 0.4 else f' class="{self.r.choice(NAMES["content"])}"'
        inner = "".join(parts)
        if self.r.random() < 0.25:
            inner = f"<div{self.attribute('content')}>{inner}</div>"
        return f'<{tag}{named} data-keep="1">{inner}</{tag}>'

    def page(self) -> str:
        before, after = [], []
        for part, chance, late in ((self.header, 0.6, 0), (self.nav, 0.75, 0.1), (self.notice, 0.3, 0.5), (self.ad, 0.5, 0.5), (self.form, 0.25, 0.5), (self.side, 0.45, 0.7), (self.share, 0.35, 0.9), (self.comments, 0.35, 1.0), (self.ad, 0.3, 0.8)):
            if self.r.random() < chance:
                (after if self.r.random() < late else before).append(part())
        if self.r.random() < 0.85:
            after.append(self.footer())
        body = [*before, self.article(), *after]
        if self.r.random() < 0.3:
            body = [f"<div class='{self.r.choice(('wrapper', 'container', 'page', 'layout', self.word()))}'>", *body, "</div>"]
        title = self.words(2, 6)
        page = f"<!DOCTYPE html><html lang=x><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{''.join(body)}</body></html>"
        return page if self.r.random() < 0.9 else page[: self.r.randint(len(page) * 3 // 4, len(page))]
