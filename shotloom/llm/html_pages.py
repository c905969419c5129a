"""Labelled pages from which the extraction weights are learned: random pages of many layouts, each block marked.

A page is a list of (html, text or None, is content); the texts of content blocks, in order, are its main text.
"""

from __future__ import annotations

import random

BOILERPLATE = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "links"],
    "header": ["header", "site-header", "masthead", "banner", "top", "logo"],
    "footer": ["footer", "site-footer", "copyright", "legal", "bottom"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "trending", "popular"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor"],
    "notice": ["cookie", "consent", "notice", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "overlay"],
    "comments": ["comments", "comment", "comment-list", "replies", "reply", "discussion", "disqus", "respond"],
    "form": ["form", "search", "login", "signup"],
    "share": ["share", "social", "tags", "meta", "byline-links", "toolbar"],
}
CONTENT = ["content", "article", "post", "entry", "main", "story", "article-body", "post-content", "entry-content", "body", "text"]


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join("".join(rng.choice(("ta", "ri", "mo", "ne", "lu", "so", "ken", "dal")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))) + "."


def _boiler(rng: random.Random, kind: str) -> list[tuple[str, str | None, bool]]:
    attr = rng.choice(("class", "id"))
    name = rng.choice(BOILERPLATE[kind])
    tags = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"), "form": ("form",)}
    tag = rng.choice(tags.get(kind, ("div", "section", "aside")))
    bare = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5
    out: list[tuple[str, str | None, bool]] = [(f"<{tag}>" if bare else f'<{tag} {attr}="{name}">', None, False)]
    long = kind in ("comments", "notice", "ad", "footer")
    for _ in range(rng.randint(1, 6)):
        text = _words(rng, 3, 40 if long else 8)
        if kind in ("nav", "share") or kind in ("aside", "header", "footer") and rng.random() < 0.5:
            out.append(("<li><a href='/x'>", text, False))
            out.append(("</a></li>", None, False))
        else:
            inner = rng.choice(("p", "div", "span", ""))
            out.append((f"<{inner}>" if inner else "", text, False))
            out.append((f"</{inner}>" if inner else "<hr>", None, False))
    return [*out, (f"</{tag}>", None, False)]


def labelled_page(seed: int) -> list[tuple[str, str | None, bool]]:
    """One page, as markup before a block, the block's text, and whether it belongs to the main text."""
    rng = random.Random(seed)
    out: list[tuple[str, str | None, bool]] = [("<html><head><title>", _words(rng, 2, 8), False), ("</title><style>p{}</style></head><body>", None, False)]
    for kind in rng.sample(("header", "nav", "ad", "notice", "form", "aside"), rng.randint(0, 4)):
        out += _boiler(rng, kind)
    style = rng.random()
    open_, close = ("<article>", "</article>") if style < 0.4 else (f'<div class="{rng.choice(CONTENT)}">', "</div>") if style < 0.7 else ("<main>", "</main>") if style < 0.85 else (f'<section id="{rng.choice(CONTENT)}">', "</section>") if style < 0.95 else ("", "")
    out.append((open_, None, False))
    for k in range(rng.randint(2, 12)):
        tag = "h1" if k == 0 and rng.random() < 0.7 else rng.choice(("p", "p", "p", "p", "h2", "h3", "li", "blockquote", "pre", "td", "div"))
        wrap = {"li": "<ul><li>", "td": "<table><tr><td>"}.get(tag, f"<{tag}>")
        out.append((wrap, _words(rng, 1 if tag[0] == "h" else 2, 8 if tag[0] == "h" else 60), True))
        out.append(({"li": "</li></ul>", "td": "</td></tr></table>"}.get(tag, f"</{tag}>"), None, False))
        if rng.random() < 0.15:
            out += _boiler(rng, rng.choice(("ad", "aside", "notice", "share", "form", "nav")))
    if rng.random() < 0.3:
        out += _boiler(rng, rng.choice(("comments", "share", "footer", "header")))
    out.append((close, None, False))
    for kind in rng.sample(("comments", "aside", "footer", "ad", "nav", "notice", "share", "form"), rng.randint(0, 5)):
        out += _boiler(rng, kind)
    return [*out, ("</body></html>", None, False)]
