"""Labelled training pages: real text set in page layouts whose parts are known by construction."""

from __future__ import annotations

import html

import numpy as np

_MAIN = ["article", "main", 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'section class="entry"', "article class='story'", 'div class="article-text"', 'div role="main"']
_WRAP = ["", "", "", 'div class="wrapper"', 'div class="container"', "div id='page'", 'div class="row"', "section"]
_NAV = ["nav", 'div class="menu"', 'ul id="navigation"', 'div class="nav-bar"', 'nav class="top-menu"', 'div role="navigation"', 'div class="breadcrumbs"']
_HEAD = ["header", 'div class="header"', 'div id="masthead"', 'div class="top-bar"', 'header class="site-header"', 'div role="banner"']
_FOOT = ["footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer"', 'div class="bottom copyright"', 'div role="contentinfo"']
_SIDE = ["aside", 'div class="sidebar"', 'div id="sidebar"', 'aside class="related"', 'div class="widget"', 'div class="recommended"', 'section class="related-posts"', 'div class="social share"']
_ADVERT = ['div class="ad"', 'div class="advert"', 'div class="ads banner"', 'div id="ad-slot"', 'div class="sponsored"', 'div class="promo"', 'aside class="advertisement"', "ins class='adsbygoogle'"]
_NOTICE = ['div class="cookie-notice"', 'div class="notice"', 'div class="alert"', 'div id="gdpr-consent"', 'div class="banner-message"', 'div role="alert"', 'div class="disclaimer"', 'div class="subscribe newsletter"', 'div class="popup modal"', "noscript"]
_COMMENTS = ['div class="comments"', 'section id="comments"', 'ol class="comment-list"', 'div class="reader-comments"', 'div id="disqus-thread"', 'section class="responses"', 'div class="comment"']
_FORM = ["form", 'form class="search"', 'form id="login"', 'div class="form"']


def _element(spec: str, inner: str) -> str:
    return f"<{spec}>{inner}</{spec.split()[0]}>" if spec else inner


class PageMaker:
    """Pages as (html, labels of the parts in order). Text of a main part is marked, so that labels follow from the blocks."""

    MARK = "\ue000"

    def __init__(self, sentences: list[str], seed: int = 3):
        self.rng = np.random.default_rng(seed)
        self.sentences = sentences or ["text"]

    def pick(self, options: list):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def text(self, low: int, high: int, main: bool = False) -> str:
        words: list[str] = []
        want = int(self.rng.integers(low, high + 1))
        while len(words) < want:
            words += self.pick(self.sentences).split()
        said = html.escape(" ".join(words[:want]))
        return f"{self.MARK}{said}" if main else said

    def links(self, spec: str) -> str:
        items = "".join(f"<li><a href='/x'>{self.text(1, 3)}</a></li>" for _ in range(int(self.rng.integers(3, 8))))
        return _element(spec, items if spec.startswith("ul") else f"<ul>{items}</ul>")

    def boilerplate(self, spec: str) -> str:
        shape = self.rng.random()
        if shape < 0.4:
            return _element(spec, self.text(3, 40))
        if shape < 0.75:
            return _element(spec, "".join(f"<p>{self.text(2, 60)}</p>" for _ in range(int(self.rng.integers(1, 4)))))
        return _element(spec, f"<h3>{self.text(1, 4)}</h3>" + self.links(self.pick(["ul", "div"])))

    def form(self) -> str:
        return _element(self.pick(_FORM), f"<label>{self.text(1, 3)}</label><input name=q><p>{self.text(2, 12)}</p>")

    def comments(self) -> str:
        one = lambda: _element(self.pick(["div class='comment'", "li", "article class='comment'", "p"]), f"<b>{self.text(1, 2)}</b> {self.text(3, 60)}")
        return _element(self.pick(_COMMENTS), f"<h2>{self.text(1, 3)}</h2>" + "".join(one() for _ in range(int(self.rng.integers(1, 6)))))

    def paragraph(self) -> str:
        shape = self.rng.random()
        if shape < 0.62:
            return f"<p>{self.text(1, 120, True)}</p>"
        if shape < 0.72:
            return f"<p><b>{self.text(1, 60, True)}<br>"
        if shape < 0.8:
            return f"<p>{self.text(5, 40, True)} <a href='/y'>{self.text(1, 4)}</a> {self.text(2, 20)}</p>"
        if shape < 0.86:
            return f"<h2>{self.text(1, 8, True)}</h2>"
        if shape < 0.92:
            return "<ul>" + "".join(f"<li>{self.text(2, 25, True)}</li>" for _ in range(int(self.rng.integers(2, 5)))) + "</ul>"
        if shape < 0.96:
            return f"<blockquote>{self.text(5, 50, True)}</blockquote>"
        return f"<div>{self.text(5, 60, True)}</div>"

    def inside(self) -> str:
        """What may stand among the paragraphs of an article without being part of it."""
        kind = self.rng.random()
        if kind < 0.4:
            return self.boilerplate(self.pick(_ADVERT))
        if kind < 0.6:
            return self.boilerplate(self.pick(_SIDE))
        return self.boilerplate(self.pick(_NOTICE)) if kind < 0.8 else self.form()

    def page(self) -> str:
        body = [f"<h1>{self.text(2, 12, True)}</h1>"] if self.chance(0.85) else []
        for _ in range(int(self.rng.integers(1, 9))):
            body.append(self.paragraph())
            if self.chance(0.06):
                body.append(self.inside())
        if self.chance(0.12):
            body.append(self.comments())
        parts = [_element(self.pick(_WRAP), _element(self.pick(_MAIN), "".join(body)))]
        before = [
            (0.5, lambda: _element(self.pick(_HEAD), self.pick([self.text(1, 6), f"<h2>{self.text(1, 5)}</h2>", self.links("nav")]))),
            (0.85, lambda: self.links(self.pick(_NAV))),
            (0.55, lambda: self.boilerplate(self.pick(_ADVERT))),
            (0.2, lambda: self.boilerplate(self.pick(_NOTICE))),
            (0.12, self.form),
            (0.12, lambda: self.boilerplate(self.pick(_SIDE))),
        ]
        after = [
            (0.35, lambda: self.boilerplate(self.pick(_SIDE))),
            (0.25, self.comments),
            (0.15, self.form),
            (0.15, lambda: self.boilerplate(self.pick(_ADVERT))),
            (0.1, lambda: self.boilerplate(self.pick(_NOTICE))),
            (0.85, lambda: self.boilerplate(self.pick(_FOOT))),
        ]
        top = [make() for p, make in before if self.chance(p)]
        end = [make() for p, make in after if self.chance(p)]
        return "<html><head><title>x</title></head><body>" + "".join([*top, *parts, *end]) + "</body></html>"
