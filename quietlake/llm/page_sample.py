"""The labelled pages that the block classifier of :mod:`.html_text` is fitted to.

They are made here, by rule and from a seed, in many layouts: with and without semantic elements,
with the usual names and with names that mislead. Each block's text begins with a mark that says
what it is. The sample is bounded by ``PAGES``; no page of a table is learnt from.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

PAGES = 300

#: Marks of content and of everything else.
_YES, _NO = "⁂", "⁑"
_VOWELS, _CONSONANTS = "aeiou", "bcdfglmnprstv"
#: Words that stand beside others in the names of an article's own paragraphs.
_TOPICS = "price history market policy law of report trial budget study river city music".split()
_AROUND = {
    "notice": ["cookie-notice", "consent-banner", "alert", "gdpr_popup", "notification-bar"],
    "ad": ["ad", "advert", "ad-slot", "sponsored", "promo-box", "adbox"],
    "side": ["sidebar", "widget-area", "sidebar-right", "related-posts", "recommended"],
    "comments": ["comments", "comment-list", "reader-comments", "disqus", "replies"],
    "foot": ["footer", "site-footer", "copyright", "legal"],
    "head": ["masthead", "site-header", "topbar", "navbar"],
    "share": ["share-buttons", "social-links", "newsletter-signup", "subscribe-box"],
}
_ROLES = {"notice": "alert", "side": "complementary", "foot": "contentinfo", "head": "banner", "nav": "navigation", "share": "search"}
_GOOD = ["content", "post-body", "article-text", "story", "entry-content", "main-content"]


class _Page:
    def __init__(self, rng: random.Random) -> None:
        self.rng, self.out = rng, []
        self.semantic = rng.random() < 0.5

    def words(self, least: int, most: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice(_CONSONANTS) + r.choice(_VOWELS) for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most)))

    def text(self, mark: str, least: int, most: int, stop: float) -> str:
        return f"{mark}{self.words(least, most)}{self.rng.choice('.!?') if self.rng.random() < stop else ''}"

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f"<li><a href=/{i}>{self.text(_NO, 1, 4, 0)}</a></li>" for i in range(n)) + "</ul>"

    def name(self, kind: str) -> str:
        more = f"-{self.rng.choice(_TOPICS)}" if kind in ("ad", "share", "foot", "notice") and self.rng.random() < 0.2 else ""
        return f"{self.rng.choice(['class', 'id'])}=\"{self.rng.choice(_AROUND[kind])}{more}\""

    def around(self, kind: str, tag: str) -> str:
        """A part that isn't article; by its element, its name or both."""
        r = self.rng
        inside = {
            "notice": lambda: self.text(_NO, 8, 30, 0.9),
            "ad": lambda: self.text(_NO, 3, 25, 0.6),
            "side": lambda: f"<h3>{self.text(_NO, 1, 4, 0)}</h3>" + (self.links(r.randint(2, 6)) if r.random() < 0.6 else f"<p>{self.text(_NO, 5, 40, 0.8)}</p>"),
            "comments": lambda: "".join(f"<p>{self.text(_NO, 4, 60, 0.8)}</p>" for _ in range(r.randint(1, 6))),
            "foot": lambda: f"<p>{self.text(_NO, 3, 25, 0.4)}</p>" + (self.links(3) if r.random() < 0.5 else ""),
            "head": lambda: f"<a href=/>{self.text(_NO, 1, 3, 0)}</a><p>{self.text(_NO, 3, 15, 0.5)}</p>",
            "share": lambda: f"<a href=/s>{self.text(_NO, 1, 3, 0)}</a> {self.words(1, 6)}",
            "nav": lambda: self.links(r.randint(3, 8)),
            "form": lambda: f"<label>{self.text(_NO, 1, 4, 0)}</label><input name=a>",
        }[kind]()
        if kind == "form" or tag and (self.semantic or kind == "nav"):
            more = f" {self.name(kind)}" if kind in _AROUND and r.random() < 0.5 else ""
            return f"<{tag}{more}>{inside}</{tag}>"
        by = f"role={_ROLES[kind]}" if kind in _ROLES and r.random() < 0.3 else self.name(kind if kind in _AROUND else "head")
        return f"<div {by}>{inside}</div>"

    def article(self) -> str:
        r = self.rng
        out = [f"<h1>{self.text(_YES, 2, 12, 0.2)}</h1>"]
        for _ in range(r.randint(2, 12)):
            x = r.random()
            if x < 0.1:
                out.append(f"<h2>{self.text(_YES, 1, 6, 0)}</h2>")
            elif x < 0.2:
                out.append("<ul>" + "".join(f"<li>{self.text(_YES, 1, 15, 0.5)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.25:
                out.append(f"<blockquote>{self.text(_YES, 5, 40, 0.8)}</blockquote>")
            else:
                unlucky = r.choice(sorted(_AROUND["share"] + _AROUND["foot"])).split("-")[0]
                name = f" class=\"{unlucky}-{r.choice(_TOPICS)}\"" if r.random() < 0.2 else ""
                link = f" <a href=/x>{self.words(1, 4)}</a> {self.words(1, 9)}." if r.random() < 0.3 else ""
                out.append(f"<p{name}>{self.text(_YES, 2, 90, 0.95)}{link}</p>")
            if r.random() < 0.08:
                out.append(self.around("ad", "aside" if r.random() < 0.3 else ""))
        inside = "".join(out)
        if self.semantic:
            return f"<article>{inside}</article>"
        return f"<div {r.choice(['class', 'id'])}=\"{r.choice(_GOOD)}\">{inside}</div>" if r.random() < 0.6 else f"<div>{inside}</div>"

    def page(self) -> str:
        r = self.rng
        some = lambda kind, tag, share: [self.around(kind, tag)] if r.random() < share else []
        parts = some("notice", "", 0.4) + some("head", "header", 0.6) + some("nav", "nav", 0.7) + some("ad", "", 0.4)
        parts += [self.article()] + some("share", "", 0.4) + some("comments", "", 0.4) + some("form", "form", 0.4) + some("side", "aside", 0.5) + some("foot", "footer", 0.8)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title></head><body>{''.join(parts)}</body></html>"


def labelled_pages(n: int = PAGES, seed: int = 11) -> Iterator[tuple[str, Callable[[str], bool]]]:
    """Pages, and what says of a block's text whether it is content."""
    rng = random.Random(seed)
    for _ in range(n):
        yield _Page(rng).page(), lambda text: _YES in text
