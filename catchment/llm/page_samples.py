"""Labelled training pages in many layouts, written from a seed.

What is main text is marked with ``data-label``; readers of the pages strip that attribute
before they look at it, so no feature ever sees it.  Words are made of random syllables: the
model is to learn structure and the shape of texts, not a vocabulary.
"""

from __future__ import annotations

import random

_SYLLABLES = "an ba co de er fi ga ho in ja ka lo me na or pe qua re si to un ve wi xo yes zu ing tion ment ly the ße é ó".split()

# Names that sites commonly give to parts of a page (fixed values).
_MAIN = "content post entry story article-body post-content entry-content main-content article__body articleText page-content text body-copy markdown-body".split()
_NAV = "nav menu navigation navbar main-menu topnav breadcrumbs breadcrumb site-nav links toc pagination pager".split()
_HEAD = "header site-header masthead banner topbar branding logo page-header".split()
_FOOT = "footer site-footer bottom copyright colophon legal page-footer".split()
_SIDE = "sidebar side widget related related-posts recommended popular trending aside rail more-stories tags".split()
_AD = "ad ads advert advertisement sponsored promo banner-ad sponsor ad-slot adsbygoogle".split()
_NOTICE = "cookie cookie-notice consent notice alert gdpr banner message popup modal newsletter subscribe paywall disclaimer".split()
_COMMENT = "comments comment comment-list commentlist reader-comments responses discussion disqus replies".split()
_FORM = "search search-form login signup newsletter-form contact subscribe-form comment-form".split()
_SHARE = "share social sharing social-links share-buttons byline meta post-meta author-box".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, most: int = 22) -> str:
        text = self.words(1, most).capitalize()
        if self.r.random() < 0.4:
            text = text.replace(" ", ", ", 1)
        if self.r.random() < 0.04:
            text += self.r.choice((" &amp; co", " &quot;x&quot;", " a|b", " #tag", " $$$", " ***"))
        return text + self.r.choice("....!?")

    def prose(self) -> str:
        count = self.r.choice((1, 1, 1, 2, 3, 4, 6, 9))
        return " ".join(self.sentence(self.r.choice((3, 12, 22))) for _ in range(count))

    def named(self, names: list[str]) -> str:
        name = self.r.choice(names)
        return self.r.choice((f' class="{name}"', f' id="{name}"', f' class="{name} {self.word()}"', f' class="c-{name}"'))

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice((" | ", " ", " &middot; ", "<br>")).join(items)

    def part(self, tags: list[str], names: list[str], body: str, bare: float = 0.3) -> str:
        tag = self.r.choice(tags)
        # A telling tag needs no name; a plain one mostly has one.
        attrs = "" if tag not in ("div", "section", "p", "ul", "td", "span") and self.r.random() < bare else self.named(names)
        return f"<{tag}{attrs}>{body}</{tag}>"

    # --- what is not main text ---
    def nav(self) -> str:
        return self.part(["nav", "nav", "div", "ul", "menu"], _NAV, self.links(2, 9))

    def head(self) -> str:
        body = self.r.choice(("", f"<p>{self.words(1, 5)}</p>", f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<div>{self.sentence()}</div>"))
        return self.part(["header", "header", "div"], _HEAD, body + (self.nav() if self.r.random() < 0.3 else f"<p>{self.words(2, 8)}</p>"))

    def foot(self) -> str:
        start = self.r.choice(("&copy; ", "Copyright ", "", "(c) 2020 "))
        body = f"{start}{self.word()}.example {self.r.choice(('&middot;', '-', '|', ''))} {self.r.choice((self.words(1, 8), self.prose()))}"
        return self.part(["footer", "footer", "div"], _FOOT, body + (self.links(1, 5) if self.r.random() < 0.3 else f"<p>{self.sentence()}</p>" if self.r.random() < 0.3 else ""))

    def ad(self) -> str:
        return self.part(["div", "div", "aside", "section", "ins"], _AD, self.r.choice((self.sentence(), f"<p>{self.prose()}</p>", f'<a href="#">{self.words(2, 9)}</a>')), 0)

    def side(self) -> str:
        body = f"<h3>{self.words(1, 4)}</h3>" + self.r.choice((self.links(2, 6), f"<p>{self.prose()}</p>", f"<ul><li>{self.sentence()}</li><li>{self.words(2, 6)}</li></ul>"))
        return self.part(["aside", "aside", "div", "section"], _SIDE, body)

    def notice(self) -> str:
        body = self.r.choice((self.sentence(), f"<p>{self.prose()}</p>", f"We use cookies. {self.sentence()} <button>OK</button>"))
        if self.r.random() < 0.15:
            return f'<div role="alert">{body}</div>'
        if self.r.random() < 0.15:
            return f"<dialog>{body}</dialog>"
        return self.part(["div", "div", "section", "p", "aside"], _NOTICE, body if "<p>" not in body else body, 0)

    def form(self) -> str:
        body = f"<label>{self.words(1, 3)}</label><input><p>{self.sentence()}</p><button>{self.words(1, 2)}</button>"
        return f"<form{self.named(_FORM) if self.r.random() < 0.6 else ''}>{body if self.r.random() < 0.6 else self.words(1, 6)}</form>"

    def comments(self) -> str:
        one = lambda: self.r.choice((f"<p>{self.prose()}</p>", f"<div><b>{self.word()}</b><p>{self.prose()}</p></div>", f"<li>{self.prose()}</li>", f"<article><p>{self.prose()}</p></article>"))
        body = f"<h3>{self.r.choice(('Comments', self.words(1, 3), ''))}</h3>" + "".join(one() for _ in range(self.r.randint(1, 5)))
        return self.part(["section", "div", "ol", "ul", "aside"], _COMMENT, body, 0)

    def share(self) -> str:
        return self.part(["div", "p", "ul"], _SHARE, self.r.choice((self.links(2, 4), self.words(1, 5), f"Posted by {self.word()}")), 0)

    # --- main text ---
    def paragraph(self) -> str:
        kind = self.r.random()
        text = self.prose()
        if kind < 0.08:
            return f"<p><b>{text}<br>"
        if kind < 0.14:
            return f'<p>{self.sentence()} <a href="/{self.word()}">{self.words(1, 3)}</a> {text}</p>'
        if kind < 0.18:
            return f"<p>{text}"
        if kind < 0.22:
            return f"<p>{text}<br>{self.sentence()}</p>"
        return f"<p>{text}</p>"

    def body(self, plain: bool) -> list[str]:
        parts = [f"<h1>{self.words(1, 9).capitalize()}{self.r.choice(('', '.', ' #', '?'))}</h1>"] if self.r.random() < 0.8 else []
        for _ in range(self.r.choice((0, 1, 2, 3, 5, 8, 12, 18)) + (not parts)):
            kind = self.r.random()
            if kind < 0.8 or plain:
                parts.append(self.paragraph())
            elif kind < 0.85:
                parts.append(f"<h2>{self.words(1, 6).capitalize()}</h2>")
            elif kind < 0.89:
                tag = self.r.choice(("ul", "ol"))
                parts.append(f"<{tag}>" + "".join(f"<li>{self.r.choice((self.words(1, 5), self.sentence()))}</li>" for _ in range(self.r.randint(1, 5))) + f"</{tag}>")
            elif kind < 0.92:
                parts.append(f"<blockquote>{self.r.choice((self.prose(), '<p>' + self.prose() + '</p>'))}</blockquote>")
            elif kind < 0.95:
                parts.append(f"<table><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr></table>")
            elif kind < 0.97:
                parts.append(f"<pre>{self.words(2, 12)}</pre>")
            else:
                parts.append(f"<section><h3>{self.words(1, 4)}</h3><p>{self.prose()}</p></section>")
        return parts

    def page(self) -> str:
        r = self.r
        main = r.choice((
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
            (f"<div{self.named(_MAIN)}>", "</div>"), (f"<section{self.named(_MAIN)}>", "</section>"), ('<div role="main">', "</div>"),
            (f"<main><div{self.named(_MAIN)}>", "</div></main>"), (f"<article{self.named(_MAIN)}>", "</article>"), ("", ""),
            (f'<table><tr><td{self.named(_MAIN)}>', "</td></tr></table>"),
        ))
        parts = self.body(plain=not main[0])
        inside = [self.ad, self.notice, self.share, self.side, self.form, self.comments, self.nav]
        marked = []
        for k, part in enumerate(parts):
            marked.append(part.replace(">", ' data-label="main">', 1))
            if r.random() < 0.05:
                marked.append(r.choice(inside)().replace(">", ' data-label="rest">', 1))
        if main[0] and r.random() < 0.2:
            marked.append(r.choice((self.comments, self.share, self.side, self.form))().replace(">", ' data-label="rest">', 1))
        before = [f() for f in (self.head, self.nav, self.notice, self.ad, self.form) if r.random() < 0.4]
        after = [f() for f in (self.comments, self.side, self.ad, self.notice, self.form, self.share) if r.random() < 0.3]
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.85:
            after.append(self.foot())
        if r.random() < 0.7 and not any("<nav" in x for x in before):
            before.insert(r.randint(0, len(before)), f"<nav>{self.links(2, 8)}</nav>")
        if r.random() < 0.3:
            before.append(self.ad())
        head = f'<head><title>{self.words(1, 6)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        return "<!DOCTYPE html><html>" + head + "<body>" + "".join(before) + main[0] + "".join(marked) + main[1] + "".join(after) + r.choice(("</body></html>", ""))


def labelled_pages(count: int, seed: int) -> list[str]:
    return [_Writer(seed * 1_000_003 + k).page() for k in range(count)]
