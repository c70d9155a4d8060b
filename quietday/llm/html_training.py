"""Pages to train the HTML extractor on, composed from a seed: main-text elements carry `data-keep`."""

from __future__ import annotations

import random
from collections.abc import Callable

PAGES, SEED = 500, 11

SYLLABLES = "ba co de fi gu ha je ki lo mu na or pe qui ra si tu ve wa xi yo za en st tion the ing and er é ü ñ ß".split()


class Composer:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.below = rng.randrange

    def word(self) -> str:
        return "".join(self.rng.choices(SYLLABLES, k=self.below(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.below(low, high + 1)))

    def sentence(self) -> str:
        text = self.words(1, 14)
        if self.rng.random() < 0.1:
            text = " ".join(f"{w}{self.pick(['***', '&amp;&amp;', '$$', '%%%', '!!'])}" for w in text.split())
        return text[:1].upper() + text[1:] + self.pick([".", ".", ".", "?", "!", ":"])

    def prose(self, most: int = 6) -> str:
        """A paragraph, now and then of one word or in capitals."""
        text = " ".join(self.sentence() for _ in range(self.below(1, most + 1))) if self.rng.random() < 0.85 else self.words(1, 4)
        return text.upper() if self.rng.random() < 0.06 else text

    def pick(self, options: list):
        return self.rng.choice(options)

    def some(self, options: list, share: float) -> list:
        return [x for x in options if self.rng.random() < share]

    def links(self, low: int = 3, high: int = 9) -> str:
        return "".join(f'<li><a href="/{self.word()}">{self.words(1, 3)}</a></li>' for _ in range(self.below(low, high)))

    def named(self, tag: str, names: list[str], inner: str) -> str:
        """An element with a class, an id or neither."""
        how = self.rng.random()
        attr = "" if how < 0.25 else f' class="{self.pick(names)}"' if how < 0.7 else f' id="{self.pick(names)}"' if how < 0.85 else f' class="{self.pick(names)} {self.word()}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def body(self) -> str:
        """Main-text blocks; some paragraphs are not closed, some hold unclosed inline elements."""
        out = []
        blocks = self.below(1, 3) if self.rng.random() < 0.35 else self.below(1, 14)
        for _ in range(blocks):
            kind = self.rng.random()
            text = self.prose()
            if kind < 0.72:
                inner = text
                if self.rng.random() < 0.15:
                    inner = f"<b>{text}<br>"
                elif self.rng.random() < 0.05:
                    inner = f"{text} <math><mi>{self.word()}</mi></math> <object data=x>{self.words(1, 6)}</object> {self.sentence()}"
                elif self.rng.random() < 0.12:
                    inner = f"{text} {self.embed()}"
                elif self.rng.random() < 0.15:
                    inner = f'{text} <a href="#">{self.words(1, 3)}</a> {self.sentence()}'
                out.append(f"<p data-keep>{inner}" + ("</p>" if self.rng.random() < 0.85 else ""))
            elif kind < 0.8:
                level = self.below(2, 5)
                out.append(f"<h{level} data-keep>{self.words(1, 7)}</h{level}>")
            elif kind < 0.86:
                items = "".join(f"<li data-keep>{self.prose(2)}</li>" for _ in range(self.below(1, 6)))
                out.append(f"<ul data-keep>{items}</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote data-keep><p data-keep>{text}</p></blockquote>")
            elif kind < 0.93:
                out.append(f"<pre data-keep>{text}</pre>")
            elif kind < 0.96:
                cells = "".join("<tr>" + "".join(f"<td data-keep>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.below(2, 5)))
                out.append(f"<table data-keep>{cells}</table>")
            else:
                out.append(f"<figure data-keep><img src=x><figcaption data-keep>{self.sentence()}</figcaption></figure>")
            if self.rng.random() < 0.06:
                out.append(self.pick([self.advert, self.share, self.related])())
        return "".join(out)

    def advert(self) -> str:
        return self.pick([
            f'<div class="{self.pick(["ad", "ads", "advert", "ad-slot", "sponsored", "promo banner"])}">{self.prose(2)}</div>',
            f'<div id="ad-{self.below(99)}"><p>{self.prose(2)}</p></div>',
            f'<aside class="promo"><h4>{self.words(2, 4)}</h4><p>{self.sentence()}</p></aside>',
        ])

    def embed(self) -> str:
        """What is shown where a browser can't show the rest."""
        tag = self.pick(["noscript", "noscript", "video controls", "audio", "canvas", "svg"])
        inner = self.pick([self.words(2, 10), f"<p>{self.prose(2)}</p>"]) if tag != "svg" else f"<text>{self.words(1, 3)}</text>"
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def share(self) -> str:
        return f'<div class="{self.pick(["share", "social-share", "sharing"])}"><a href=#>{self.word()}</a> <a href=#>{self.word()}</a></div>'

    def menu(self) -> str:
        inner = f"<ul>{self.links()}</ul>"
        return self.pick([f"<nav>{inner}</nav>", self.named("div", ["nav", "menu", "navbar", "top-menu", "breadcrumbs"], inner), f'<ul class="menu">{self.links()}</ul>'])

    def top(self) -> str:
        level = self.below(1, 4)
        inner = f"<h{level}>{self.words(1, 4)}</h{level}><p>{self.words(2, 8)}</p>" + (self.menu() if self.rng.random() < 0.5 else "")
        return self.pick([f"<header>{inner}</header>", f'<div class="{self.pick(["header", "masthead", "site-header", "topbar"])}">{inner}</div>'])

    def notice(self) -> str:
        inner = f"<p>{self.prose(3)}</p><button>{self.word()}</button>"
        return f'<div class="{self.pick(["cookie-notice", "consent", "notice", "gdpr-banner", "alert", "popup modal"])}">{self.pick([inner, self.prose(2)])}</div>'

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input><p>{self.sentence()}</p><button>{self.word()}</button>"
        return self.pick([f"<form>{inner}</form>", f'<div class="{self.pick(["newsletter", "subscribe", "signup", "search-form"])}"><form>{inner}</form></div>'])

    def side(self) -> str:
        inner = f"<h3>{self.words(1, 4)}</h3><ul>{self.links()}</ul>" + (f"<p>{self.prose(3)}</p>" if self.rng.random() < 0.6 else "")
        return self.pick([f"<aside>{inner}</aside>", f'<div class="{self.pick(["sidebar", "widget", "rail", "side-column", "secondary"])}">{inner}</div>'])

    def related(self) -> str:
        items = "".join(f'<li><a href=/x>{self.words(3, 8)}</a><p>{self.sentence()}</p></li>' for _ in range(self.below(2, 5)))
        return f'<{(t := self.pick(["div", "section", "aside"]))} class="{self.pick(["related", "related-posts", "recommended", "more-stories", "popular"])}"><h3>{self.words(1, 3)}</h3><ul>{items}</ul></{t}>'

    def comments(self) -> str:
        one = lambda: self.pick([
            f'<div class="comment"><span>{self.word()}</span><p>{self.prose(5)}</p></div>',
            f'<li class="comment"><p>{self.prose(5)}</p><p>{self.prose(3)}</p></li>',
            f"<article class=comment><p>{self.prose(4)}</p></article>",
        ])
        inner = f"<h3>{self.words(1, 2)}</h3>" + "".join(one() for _ in range(self.below(1, 6)))
        return f'<{(t := self.pick(["div", "section", "ol"]))} {self.pick(["id", "class"])}="{self.pick(["comments", "discussion", "responses", "reader-comments", "disqus_thread"])}">{inner}</{t}>'

    def foot(self) -> str:
        inner = f"&copy; {self.words(1, 4)} &middot; {self.prose(3)}" + (f"<ul>{self.links(2, 6)}</ul>" if self.rng.random() < 0.4 else "")
        inner = f"<p>{inner}</p>" if self.rng.random() < 0.4 else inner
        return self.pick([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f'<div class="{self.pick(["footer", "site-footer", "copyright", "legal"])}">{inner}</div>'])

    def page(self) -> str:
        title = self.words(1, 9)
        heading = f"<h1 data-keep>{title}</h1>" if self.rng.random() < 0.8 else ""
        body = heading + self.body()
        inside: list[Callable[[], str]] = self.some([self.share, self.advert, self.form, self.related, self.comments], 0.12)
        body += "".join(f() for f in inside)
        how = self.rng.random()
        if how < 0.2:  # no element around the text, now and then nothing else on the page
            main = body
            if self.rng.random() < 0.5:
                main = main if self.rng.random() < 0.5 else "".join(f"<{t} data-keep>{self.words(1, 8) if self.rng.random() < 0.7 else self.word()[:1]}</{t}>" for t in self.rng.choices(["p", "p", "section", "div", "h2"], k=self.below(1, 5)))
                deep = self.pick([0, 0, 0, self.below(1, 5), self.below(5, 60)])
                main = "<div data-keep>" * deep + (self.words(1, 6) if deep > 4 else "") + main + "</div>" * deep
                return f"<html><body>{main}</body></html>" if self.rng.random() < 0.5 else main
        elif how < 0.6:
            main = f"<article data-keep>{body}</article>"
        elif how < 0.8:
            main = f'<div data-keep class="{self.pick(["content", "post", "entry-content", "article-body", "main", "story", "text"])}">{body}</div>'
        elif how < 0.92:
            main = f"<main data-keep>{body}</main>" if self.rng.random() < 0.5 else f"<main data-keep><article data-keep>{body}</article></main>"
        else:
            main = f"<div data-keep>{body}</div>"
        before = self.some([self.embed], 0.2) + self.some([self.menu, self.top, self.notice, self.advert, self.form, self.menu], 0.4)
        after = self.some([self.side, self.related, self.comments, self.advert, self.share, self.form, self.notice], 0.35) + self.some([self.foot], 0.85)
        if self.rng.random() < 0.25:
            before, after = before + after[:1], after[1:]
        parts = [f() for f in before] + [main] + [f() for f in after]
        inner = "".join(parts)
        if self.rng.random() < 0.3:
            inner = f'<div class="{self.pick(["wrapper", "container", "page", "layout"])}">{inner}</div>'
        head = f"<head><title>{title}</title><style>p{{}}</style><script>var x='</p>';</script></head>"
        end = "</body></html>" if self.rng.random() < 0.85 else ""
        return f"<!DOCTYPE html><html>{head}<body>{inner}{end}"


def training_pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    composer = Composer(random.Random(seed))
    return [composer.page() for _ in range(n)]
