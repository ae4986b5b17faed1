"""Labelled pages to train the HTML extractor on: generated from a seed, in many layouts, each text block marked as main text or not.

A bounded number of pages (a parameter of the trainer) with invented words.  Blocks of main text start with MARK; the trainer reads labels
off it and takes it away.  Layouts vary in the container of the article, in what stands around and inside it, in classes and in missing end tags.
"""

from __future__ import annotations

import random

MARK = "\x01"

CONTAINERS = (
    ("<article>", "</article>"), ("<article class='post'>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ("<div class='content'>", "</div>"),
    ("<div id='main-content'>", "</div>"), ("<div class='post-body entry'>", "</div>"), ("<section class='story article-body'>", "</section>"), ("<div role='main'>", "</div>"), ("<div class='article'>", "</div>"),
)
NAMES_OF = {
    "menu": ("menu", "navbar", "nav-links", "navigation", "topnav", "breadcrumb", "pagination"),
    "header": ("header", "site-header", "masthead", "banner", "topbar", "branding"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "legal"),
    "side": ("sidebar", "side", "widget", "related", "aside", "popular", "recommended", "trending"),
    "notice": ("notice", "cookie", "alert", "cookie-banner", "consent", "gdpr", "popup", "modal", "warning", "message"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "banner-ad", "ad-slot"),
    "form": ("newsletter", "subscribe", "signup", "login", "search", "contact-form"),
    "comments": ("comments", "comment", "comment-list", "replies", "discussion", "responses", "user-comment"),
    "share": ("share", "social", "share-buttons", "byline-tools", "tags", "meta-links"),
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(("th", "er", "on", "an", "re", "ti", "es", "or", "ea", "sch", "ver", "eau", "ci", "la", "de", "mo", "ist")) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.r.choice(("." * 6 + "!?"))

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 5)))) if self.r.random() < 0.9 else self.words(1, 3) + "."

    def link(self, text: str) -> str:
        return f"<a href='/{self.word()}'>{text}</a>"

    def main(self, text: str) -> str:
        return MARK + text

    def article(self) -> str:
        r, out = self.r, []
        closed = r.random() < 0.7
        if r.random() < 0.85:
            h = f"<h1>{self.main(self.sentence(2, 9))}</h1>"
            out.append(f"<header>{h}</header>" if r.random() < 0.15 else h)
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.62:
                t = self.prose()
                if r.random() < 0.15:
                    t += " " + self.link(self.words(1, 3)) + " " + self.words(2, 8) + "."
                out.append(f"<p>{self.main(t)}" + ("</p>" if closed else ""))
            elif kind < 0.72:
                out.append(f"<p><b>{self.main(self.sentence(2, 8))}<br>")
            elif kind < 0.8:
                tag = r.choice(("h2", "h3", "h4"))
                out.append(f"<{tag}>{self.main(self.words(1, 7))}</{tag}>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.main(self.sentence(2, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{self.main(self.prose())}</blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.main(self.words(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif kind < 0.95:
                out.append(f"<div>{self.main(self.prose())}</div>")
            else:
                out.append(self.around(r.choice(("advert", "side", "share", "form", "notice"))))
        return "".join(out)

    def around(self, kind: str) -> str:
        """A part of the page that is not the article."""
        r, name = self.r, self.r.choice(NAMES_OF[kind])
        attr = r.choice((f"class='{name}'", f'class="{name} {self.word()}"', f"id='{name}'"))
        items = lambda tag: "".join(f"<{tag}>{self.link(self.words(1, 3))}</{tag}>" for _ in range(r.randint(3, 8)))
        if kind == "menu":
            return r.choice((f"<nav><ul>{items('li')}</ul></nav>", f"<nav {attr}>{items('span')}</nav>", f"<div {attr}><ul>{items('li')}</ul></div>", f"<ul {attr}>{items('li')}</ul>"))
        if kind == "header":
            return r.choice((f"<header><h1>{self.link(self.words(1, 3))}</h1><p>{self.sentence()}</p></header>", f"<div {attr}><p>{self.prose()}</p></div>", f"<header {attr}><div>{self.words(1, 4)}</div>{self.around('menu')}</header>"))
        if kind == "footer":
            say = r.choice((f"&copy; {self.word()}.com &middot; {self.prose()}", f"Copyright 20{r.randint(10, 30)} {self.words(1, 3)}", self.prose()))
            return r.choice((f"<footer>{say}</footer>", f"<footer {attr}><p>{say}</p><ul>{items('li')}</ul></footer>", f"<div {attr}>{say}</div>"))
        if kind == "side":
            body = f"<h3>{self.words(1, 4)}</h3>" + r.choice((f"<ul>{items('li')}</ul>", f"<p>{self.prose()}</p>", f"<div><p>{self.prose()}</p></div>"))
            return r.choice((f"<aside>{body}</aside>", f"<aside {attr}>{body}</aside>", f"<div {attr}>{body}</div>"))
        if kind == "form":
            body = f"<label>{self.words(1, 3)}</label><input type='text'><button>{self.word()}</button>"
            return r.choice((f"<form>{body}</form>", f"<form {attr}><p>{self.prose()}</p>{body}</form>", f"<div {attr}><p>{self.sentence()}</p><form>{body}</form></div>"))
        if kind == "comments":
            one = lambda: r.choice((f"<p>{self.prose()}</p>", f"<li>{self.prose()}</li>", f"<div class='comment'><b>{self.word()}</b><p>{self.prose()}</p></div>"))
            tag = r.choice(("div", "section", "ol", "aside"))
            return f"<{tag} {attr}><h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 5))) + f"</{tag}>"
        body = r.choice((self.prose(), f"<p>{self.prose()}</p>", f"<p>{self.sentence()}</p>{self.link(self.words(1, 3))}", f"<span>{self.words(2, 6)}</span>"))
        return r.choice((f"<div {attr}>{body}</div>", f"<section {attr}>{body}</section>", f"<div {attr}>{body}</div>", f"<div role='{'alert' if kind == 'notice' else 'complementary'}' {attr}>{body}</div>"))

    def page(self) -> str:
        r = self.r
        before = [self.around(k) for k in ("notice", "header", "menu", "advert", "form", "side") if r.random() < 0.45]
        after = [self.around(k) for k in ("comments", "side", "share", "advert", "form", "menu") if r.random() < 0.4]
        r.shuffle(before)
        if r.random() < 0.75:
            after.append(self.around("footer"))
        a, b = r.choice(CONTAINERS)
        inner = self.article()
        if r.random() < 0.2:
            inner += self.around(r.choice(("comments", "share", "side")))
        wrap = ("<div id='page'><div class='row'>", "</div></div>") if r.random() < 0.3 else ("", "")
        head = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        return head + wrap[0] + "".join(before) + a + inner + b + "".join(after) + wrap[1] + r.choice(("</body></html>", ""))


def labelled_pages(count: int, seed: int = 7) -> list[str]:
    return [Maker(seed * 1_000_003 + i).page() for i in range(count)]
