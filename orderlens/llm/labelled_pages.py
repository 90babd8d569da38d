"""Labelled pages to train on: invented pages whose elements say whether they hold main text.

The attribute ``data-main`` of the nearest element around a block is its label.  Layouts,
element names, class names and words vary at random from a fixed seed.
"""

from __future__ import annotations

import random

_MAIN_CLASSES = ["content", "post", "entry", "article-body", "story", "main-text", "post-content", "page", "text", ""]
_BOILER = {
    "nav": ["nav", "menu", "navbar", "breadcrumbs", "main-menu", "top-nav", "links"],
    "header": ["header", "site-header", "masthead", "topbar", "logo"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "legal"],
    "side": ["sidebar", "aside", "widget", "related", "right-column", "trending", "more-stories"],
    "notice": ["notice", "cookie-banner", "alert", "consent", "newsletter", "popup", "message", "gdpr"],
    "ad": ["ad", "ads", "advert", "sponsored", "banner", "promo", "adsbox", "sponsor"],
    "form": ["form", "search", "login", "signup", "subscribe", "contact"],
    "comments": ["comments", "comment-list", "comment", "respond", "discussion", "replies", "disqus"],
    "share": ["share", "social", "tags", "pagination", "byline", "meta"],
}


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def word(self) -> str:
        r = self.rng
        return "".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiouéü") for _ in range(r.randint(1, 4)))

    def sentence(self, low: int = 4, high: int = 22) -> str:
        words = [self.word() for _ in range(self.rng.randint(low, high))]
        return " ".join(words).capitalize() + self.rng.choice([".", ".", ".", "!", "?", ""])

    def inline(self, text: str) -> str:
        r = self.rng
        if r.random() < 0.25:
            words = text.split(" ")
            i = r.randrange(len(words))
            tag = r.choice(["a href='/x'", "b", "i", "em", "strong", "span", "code"])
            words[i] = f"<{tag}>{words[i]}</{tag.split()[0]}>"
            text = " ".join(words)
        return text

    def paragraph(self) -> str:
        r = self.rng
        text = " ".join(self.sentence() for _ in range(r.choice([1, 1, 2, 3, 5, 8])))
        if r.random() < 0.15:
            return f"<p><b>{text}<br>"
        return f"<p>{self.inline(text)}" + ("" if r.random() < 0.1 else "</p>")

    def main(self) -> str:
        r = self.rng
        out = [f"<h1>{self.sentence(1, 10).rstrip('.')}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            kind = r.random()
            if kind < 0.72:
                out.append(self.paragraph())
            elif kind < 0.82:
                out.append(f"<h{r.randint(2, 4)}>{self.sentence(1, 7).rstrip('.')}</h2>")
            elif kind < 0.9:
                items = "".join(f"<li>{self.inline(self.sentence(2, 12))}</li>" for _ in range(r.randint(2, 5)))
                out.append(f"<ul>{items}</ul>")
            elif kind < 0.95:
                out.append(f"<blockquote><p>{self.sentence()}</p></blockquote>")
            else:
                cells = "".join(f"<tr><td>{self.word()}</td><td>{self.sentence(1, 4)}</td></tr>" for _ in range(3))
                out.append(f"<table>{cells}</table>")
        return "".join(out)

    def named(self, kind: str, tag: str | None = None) -> str:
        """Start of an element of a kind: by its own tag, or a div with a telling name."""
        r = self.rng
        name = r.choice(_BOILER[kind])
        attribute = r.choice(["class", "id"])
        if tag and r.random() < 0.6:
            extra = f' {attribute}="{name}"' if r.random() < 0.4 else ""
            return f'{tag} data-main="0"{extra}'
        return f'{r.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])} data-main="0" {attribute}="{name}"'

    def wrap(self, start: str, inside: str) -> str:
        return f"<{start}>{inside}</{start.split()[0]}>"

    def links(self) -> str:
        r = self.rng
        if r.random() < 0.6:
            items = "".join(f'<li><a href="/{self.word()}">{self.word().capitalize()}</a></li>' for _ in range(r.randint(2, 8)))
            return f"<ul>{items}</ul>"
        return " | ".join(f'<a href="/{self.word()}">{self.word()} {self.word()}</a>' for _ in range(r.randint(2, 8)))

    def texts(self, high: int = 3) -> str:
        return "".join(f"<p>{self.sentence()}</p>" if self.rng.random() < 0.5 else f"<div>{self.sentence()}</div>" for _ in range(self.rng.randint(1, high)))

    def boiler(self, kind: str) -> str:
        r = self.rng
        if kind == "nav":
            return self.wrap(self.named("nav", "nav"), self.links())
        if kind == "header":
            title = f"<h1>{self.sentence(1, 3)}</h1>" if r.random() < 0.3 else f"<span>{self.sentence(1, 4)}</span>"
            return self.wrap(self.named("header", "header"), title + (self.links() if r.random() < 0.5 else f"<p>{self.sentence(2, 8)}</p>"))
        if kind == "footer":
            sign = r.choice(["&copy; ", "© 2024 ", "", "All rights reserved. "])
            return self.wrap(self.named("footer", "footer"), r.choice(["", "<p>"]) + sign + self.sentence(2, 9) + (self.links() if r.random() < 0.3 else ""))
        if kind == "side":
            return self.wrap(self.named("side", "aside"), f"<h3>{self.sentence(1, 3)}</h3>" + (self.links() if r.random() < 0.6 else self.texts()))
        if kind == "notice":
            button = f"<button>{self.word()}</button>" if r.random() < 0.5 else ""
            return self.wrap(self.named("notice"), r.choice([self.texts(2), self.sentence()]) + button)
        if kind == "ad":
            return self.wrap(self.named("ad"), r.choice([self.texts(1), self.sentence(), f"<a href='/b'>{self.sentence(2, 6)}</a>"]))
        if kind == "form":
            field = f"<label>{self.word()}</label><input type='text'>"
            return self.wrap(self.named("form", "form"), f"<p>{self.sentence(2, 8)}</p>" + field + f"<button>{self.word()}</button>")
        if kind == "comments":
            name = lambda: f"<span class='author'>{self.word()}</span> "
            each = "".join(f"<{t} class='comment'>{name() if r.random() < 0.5 else ''}{self.texts(2)}</{t}>" for t in r.choices(["div", "li", "article"], k=r.randint(1, 4)))
            return self.wrap(self.named("comments"), f"<h{r.randint(2, 3)}>{self.sentence(1, 3)}</h2>" + each)
        return self.wrap(self.named("share"), self.links())


def page(seed: int) -> str:
    rng = random.Random(seed)
    w = _Writer(rng)
    pick = lambda kinds, p: "".join(w.boiler(k) for k in kinds if rng.random() < p)
    tag = rng.choice(["article", "article", "main", "div", "section", "div"])
    name = rng.choice(_MAIN_CLASSES)
    if tag in ("div", "section") and not name:
        name = "content"
    inside = w.main()
    if rng.random() < 0.45:  # boilerplate within the main element
        inside += w.boiler(rng.choice(["ad", "share", "comments", "form", "side", "notice"]))
    if rng.random() < 0.2:
        inside = w.boiler(rng.choice(["ad", "share", "notice", "nav"])) + inside
    if rng.random() < 0.2:
        inside += w.paragraph()
    extra = f' class="{name}"' if name and rng.random() < 0.6 else ""
    main = f'<{tag} data-main="1"{extra or (f" id={name}" if tag in ("div", "section") else "")}>{inside}</{tag}>'
    if rng.random() < 0.3:
        main = f"<main>{main}{pick(['side', 'comments'], 0.4)}</main>"
    body = pick(["notice", "header", "nav", "ad", "form"], 0.45) + main + pick(["comments", "ad", "side", "form", "share"], 0.35) + pick(["nav", "footer"], 0.7)
    return f'<!DOCTYPE html><html><head><title>{w.sentence()}</title><style>p{{}}</style></head><body data-main="0">{body}</body></html>'
