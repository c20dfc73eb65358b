"""Labelled pages to train on: layouts as they are common on the web, with invented words.

``data-main`` marks what is content (1) and what inside it is not (0); the parser keeps it apart
from the attributes that become features.
"""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo za bre cla dro flu gri".split()


class _Writer:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def pick(self, *options):
        return self.random.choice(options)

    def words(self, lo: int, hi: int) -> str:
        n = self.random.randint(lo, hi)
        return " ".join("".join(self.random.choices(SYLLABLES, k=self.random.randint(1, 4))) for _ in range(n))

    def sentence(self, lo: int = 1, hi: int = 25) -> str:
        return self.words(lo, hi).capitalize() + self.pick(".", ".", ".", "?", "!")

    def prose(self) -> str:
        n = self.pick(1, 1, 1, 2, 4, 8)
        body = " ".join(self.sentence() for _ in range(n))
        if self.random.random() < 0.2:
            body = f'{body} <a href="/x">{self.words(1, 4)}</a> {self.sentence()}'
        if self.random.random() < 0.15:
            body = self.words(1, 20)  # a fragment, a list, or a shout is content too
        return body

    def links(self, lo: int = 3, hi: int = 8) -> str:
        rows = "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(self.random.randint(lo, hi)))
        return f"<ul>{rows}</ul>"

    def paragraph(self) -> str:
        kind = self.random.random()
        if kind < 0.7:
            return self.pick(f"<p>{self.prose()}</p>", f"<p>{self.prose()}", f"<p><b>{self.prose()}<br>")
        if kind < 0.8:
            level = self.pick(2, 3)
            return f"<h{level}>{self.words(1, 8)}</h{level}>"
        if kind < 0.86:
            rows = "".join(f"<li>{self.prose()}" for _ in range(self.random.randint(1, 5)))
            return self.pick(f"<ul>{rows}</ul>", f"<ol>{rows}</ol>")
        if kind < 0.9:
            return f"<blockquote><p>{self.prose()}</p></blockquote>"
        if kind < 0.93:
            return f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>"
        if kind < 0.96:
            cells = "".join(f"<tr><td>{self.words(1, 3)}<td>{self.words(1, 4)}</tr>" for _ in range(3))
            return f"<table>{cells}</table>"
        return self.pick(f"<pre>{self.words(3, 20)}</pre>", f"<div>{self.prose()}</div>")

    def named(self, *names: str) -> str:
        return f'{self.pick("class", "class", "id")}="{self.pick(*names)}"'

    def advert(self) -> str:
        return f'<div {self.named("ad", "ads", "advert", "ad-slot", "banner", "sponsored", "promo", "advertisement")}>{self.sentence(2, 15)}</div>'

    def notice(self) -> str:
        return self.pick(
            f'<div {self.named("cookie-notice", "cookie-banner", "consent", "notice", "gdpr", "alert")}><p>{self.sentence()}</p><button>ok</button></div>',
            f'<div {self.named("newsletter", "subscribe", "signup", "paywall-notice")}><p>{self.sentence()}</p><form><input><label>{self.words(1, 3)}</label></form></div>',
        )

    def share(self) -> str:
        return f'<div {self.named("share", "social", "share-bar", "tools", "tags", "meta-links")}>{self.links(2, 4)}</div>'

    def comments(self) -> str:
        rows = "".join(
            f'<{t} {self.named("comment", "reply", "comment-body")}><p>{self.prose()}</p></{t}>'
            for t in [self.pick("div", "li", "div", "li", "div", "article")] * self.random.randint(1, 5)
        )
        head = self.pick("", f"<h3>{self.words(1, 3)}</h3>")
        names = self.named("comments", "comment-list", "discussion", "responses", "disqus_thread", "reader-comments")
        tag = self.pick("section", "div", "div")
        return f"<{tag} {names}>{head}{rows}</{tag}>"

    def related(self) -> str:
        tag, names = self.pick("div", "aside", "section"), self.named("related", "more-stories", "recommended", "trending", "popular")
        return f"<{tag} {names}><h3>{self.words(1, 3)}</h3>{self.links()}</{tag}>"

    def form(self) -> str:
        return f"<form action=/s><label>{self.words(1, 3)}</label><input name=q><p>{self.sentence(2, 9)}</p></form>"

    def menu(self) -> str:
        return self.pick(
            f"<nav>{self.links()}</nav>",
            f'<div {self.named("nav", "menu", "navbar", "main-menu", "breadcrumbs", "topbar")}>{self.links()}</div>',
            f'<header><p>{self.words(1, 6)}</p><nav>{self.links()}</nav></header>',
            f'<div {self.named("header", "site-header", "masthead")}><h1>{self.words(1, 3)}</h1>{self.links(2, 5)}</div>',
        )

    def sidebar(self) -> str:
        inner = self.pick(self.links(), f"<p>{self.sentence()}</p>", f"<h3>{self.words(1, 3)}</h3><p>{self.prose()}</p>")
        return self.pick(
            f"<aside>{inner}</aside>", f'<div {self.named("sidebar", "side-bar", "widget", "rail", "right-col")}>{inner}</div>'
        )

    def foot(self) -> str:
        inner = self.pick(f"&copy; {self.words(1, 5)} &middot; {self.sentence()}", f"<p>{self.sentence()}</p>{self.links(2, 5)}")
        return self.pick(
            f"<footer>{inner}</footer>", f'<div {self.named("footer", "site-footer", "copyright", "legal", "bottom")}>{inner}</div>'
        )

    def article(self) -> str:
        parts = [self.pick(f"<h1>{self.words(2, 10)}</h1>", f"<h1>{self.sentence(2, 12)}</h1>", "")]
        for _ in range(self.pick(1, 1, 1, 2, 4, 8, 14)):
            parts.append(self.paragraph())
            if self.random.random() < 0.12:
                other = self.pick(self.advert, self.share, self.related, self.notice, self.form)()
                parts.append(other.replace(" ", ' data-main="0" ', 1) if other.index(" ") < other.index(">") else other)
        inside = self.pick(*[""] * 5, self.comments(), self.share(), self.related())
        if inside:
            inside = inside.replace(" ", ' data-main="0" ', 1)
        tag, names = self.pick(
            ("article", ""), ("article", ""), ("article", self.named("post", "entry", "story")), ("main", ""),
            ("div", self.named("content", "article", "post-content", "entry-content", "story-body", "main-text", "article-body")),
            ("section", self.named("content", "article", "post-body")), ("td", ""), ("div", 'role="main"'), ("div", ""),
        )
        body = "".join(parts)
        open_wrap = close_wrap = ""
        if self.pick(0, 1, 0):
            open_wrap, close_wrap = f'<div {self.named("wrapper", "container", "row", "col", "page")}>', "</div>"
        if tag == "td":
            open_wrap, close_wrap = f"<table><tr><td>{self.links(2, 5)}</td>", "</tr></table>"
        return f'{open_wrap}<{tag} data-main="1" {names}>{body}{inside}</{tag}>{close_wrap}'

    def page(self) -> str:
        before = [self.menu()]
        for part in (self.advert, self.notice, self.form, self.sidebar, self.menu):
            if self.random.random() < 0.3:
                before.append(part())
        after = [self.foot()]
        for part in (self.comments, self.related, self.advert, self.sidebar, self.share, self.notice, self.form):
            if self.random.random() < 0.3:
                after.insert(0, part())
        if self.random.random() < 0.04:  # nothing but the text
            return f'<body data-main="1">{"".join(self.paragraph() for _ in range(self.pick(1, 2, 6)))}</body>'
        head = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head>"
        return head + "<body>" + "".join(before) + self.article() + "".join(after) + self.pick("</body></html>", "")


def labelled_pages(n: int = 600, seed: int = 11) -> list[str]:
    return [_Writer(seed * 100_003 + i).page() for i in range(n)]
