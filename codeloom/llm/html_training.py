"""Labelled pages to train the extractor on: layouts of many kinds, filled with made-up words.

Labels come with the layout: the article's own blocks carry a private-use character
that `labelled` takes out again. Words are random syllables, so the model can learn
from structure, marks, lengths and punctuation, not from topics.
"""

from __future__ import annotations

import random

from codeloom.llm.html_blocks import blocks, path_features, text_features

MAIN = ""
_SYLLABLES = "ba be bo da den do er fi ga hen in ka la li lo ma men mi na ne no or pa po ra re ri sa se so sta ta te ti to un va ve vi".split()
#: Marks that pages put on their parts.
BODY = "content article-body post-content entry-content story-text main-content post article page-content body-text articleBody text".split()
AD = "ad ads advert advertisement ad-slot sponsored promo banner adBox google-ad".split()
SIDE = "sidebar side rail widget related related-posts recommended popular trending more-stories".split()
NOTE = "cookie-notice cookie-banner notice alert consent gdpr-banner message popup modal".split()
TALK = "comments comment-list user-comments responses discussion disqus reader-comments replies".split()
TOP = "header site-header masthead top-bar logo branding page-header".split()
FOOT = "footer site-footer page-footer bottom legal copyright colophon".split()
MENU = "nav menu navbar navigation breadcrumb breadcrumbs pagination toolbar tabs".split()
FORM = "newsletter subscribe signup search login contact-form".split()
SHARE = "share social share-buttons follow-us".split()


class Layout:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        n = self.r.randint(lo, hi)
        out = ["".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(n)]
        for i in range(0, n, self.r.randint(6, 14)):
            out[i] = out[i].capitalize()
            if i:
                out[i - 1] += self.r.choice(".,.?")
        return " ".join(out)

    def prose(self) -> str:
        lo, hi = self.r.choice([(1, 1), (1, 3), (4, 12), (12, 40), (40, 90), (20, 60)])
        text = self.words(lo, hi) + self.r.choice([".", ".", ".", "!", "?", ":", "", ""])
        if self.r.random() < 0.15:
            text = text.replace(" ", " &amp; ", 1)
        if self.r.random() < 0.15:
            text = f'{text} <a href="/x">{self.words(1, 3)}</a> {self.words(2, 8)}.'
        return text

    def mark(self, kind: list[str]) -> str:
        value = self.r.choice(kind)
        return f' {self.r.choice(["class", "class", "id"])}="{value}"'

    def items(self, lo: int, hi: int, link: bool = True) -> str:
        one = (lambda: f'<a href="/{self.r.randint(1, 99)}">{self.words(1, 4)}</a>') if link else (lambda: self.words(1, 6))
        return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(self.r.randint(lo, hi))) + "</ul>"

    def menu(self) -> str:
        return self.r.choice([f"<nav>{self.items(3, 8)}</nav>", f"<div{self.mark(MENU)}>{self.items(3, 8)}</div>", f'<nav{self.mark(MENU)}><a href="/">{self.words(1, 1)}</a> <a href="/b">{self.words(1, 2)}</a></nav>'])

    def top(self) -> str:
        inside = f'<a href="/">{self.words(1, 2)}</a><p>{self.words(2, 8)}</p>'
        return self.r.choice([f"<header>{inside}</header>", f"<div{self.mark(TOP)}>{inside}</div>", f"<header{self.mark(TOP)}>{inside}{self.menu()}</header>", f"<header><h1>{self.words(1, 3)}</h1></header>", ""])

    def foot(self) -> str:
        inside = self.r.choice([f"&copy; {self.words(1, 3)} &middot; {self.words(3, 12)}.", f"<p>{self.words(4, 30)}.</p>", f"<p>Copyright {self.words(1, 3)}. All rights reserved.</p>{self.items(2, 5)}"])
        return self.r.choice([f"<footer>{inside}</footer>", f"<div{self.mark(FOOT)}>{inside}</div>", f"<footer{self.mark(FOOT)}>{inside}</footer>"])

    def aside(self) -> str:
        inside = self.r.choice([f"<h3>{self.words(1, 4)}</h3>{self.items(2, 6)}", f"<h2>{self.words(1, 3)}</h2><p>{self.prose()}</p>", f"<p>{self.prose()}</p><p>{self.prose()}</p>"])
        return self.r.choice([f"<aside>{inside}</aside>", f"<div{self.mark(SIDE)}>{inside}</div>", f"<section{self.mark(SIDE)}>{inside}</section>", f"<aside{self.mark(SIDE)}>{inside}</aside>"])

    def advert(self) -> str:
        return self.r.choice([f"<div{self.mark(AD)}>{self.words(3, 30)}.</div>", f"<div{self.mark(AD)}><p>{self.prose()}</p></div>", f"<section{self.mark(AD)}><a href='/ad'>{self.words(2, 12)}</a></section>", f"<ins{self.mark(AD)}>{self.words(2, 8)}</ins>"])

    def note(self) -> str:
        inside = self.r.choice([f"We use cookies. {self.words(4, 20)}.", self.words(5, 30) + "."])
        return self.r.choice([f"<div{self.mark(NOTE)}>{inside} <button>OK</button></div>", f"<div{self.mark(NOTE)}><p>{inside}</p></div>", f'<div role="alert">{inside}</div>', f'<div role="dialog"{self.mark(NOTE)}><p>{inside}</p></div>'])

    def form(self) -> str:
        inside = f'<label>{self.words(1, 3)}</label><input name="q"><button>{self.words(1, 2)}</button>'
        return self.r.choice([f"<form>{inside}</form>", f"<form{self.mark(FORM)}><p>{self.words(4, 16)}.</p>{inside}</form>", f"<div{self.mark(FORM)}><h3>{self.words(1, 4)}</h3><p>{self.words(4, 16)}.</p><form>{inside}</form></div>"])

    def talk(self) -> str:
        one = lambda: self.r.choice([f'<div class="comment"><p>{self.prose()}</p></div>', f'<li class="comment-item"><b>{self.words(1, 2)}</b> {self.prose()}</li>', f'<article class="comment"><header>{self.words(1, 2)}</header><p>{self.prose()}</p></article>', f"<p>{self.prose()}</p>"])
        inside = (f"<h3>{self.r.choice(['Comments', self.words(1, 2)])}</h3>" if self.r.random() < 0.6 else "") + "".join(one() for _ in range(self.r.randint(1, 5)))
        return f"<{(t := self.r.choice(['div', 'section', 'aside', 'div']))}{self.mark(TALK)}>{inside}</{t}>"

    def share(self) -> str:
        return f"<div{self.mark(SHARE)}>{self.r.choice([self.items(2, 4), 'Share: <a>X</a> <a>Y</a>'])}</div>"

    def main_block(self) -> str:
        p = lambda: MAIN + self.prose()
        return self.r.choice([lambda: f"<p>{p()}</p>"] * 9 + [
            lambda: f"<p>{p()}", lambda: f"<p><b>{p()}<br><p>{p()}</p>", lambda: f"<h2>{MAIN}{self.words(1, 8)}</h2>", lambda: f"<h3>{MAIN}{self.words(1, 6)}</h3>",
            lambda: f"<blockquote><p>{p()}</p></blockquote>", lambda: f"<blockquote>{p()}</blockquote>", lambda: f"<ul><li>{p()}</li><li>{p()}</li></ul>", lambda: f"<ol><li>{p()}<li>{p()}</ol>",
            lambda: f"<table><tr><td>{MAIN}{self.words(1, 4)}</td><td>{MAIN}{self.words(1, 4)}</td></tr></table>", lambda: f"<pre>{p()}</pre>", lambda: f"<div>{p()}</div>", lambda: f"<figure><figcaption>{p()}</figcaption></figure>", lambda: f"<section><h2>{MAIN}{self.words(1, 6)}</h2><p>{p()}</p></section>",
        ])()

    def article(self) -> str:
        parts = [self.main_block() for _ in range(self.r.randint(1, 14))]
        if self.r.random() < 0.75:
            h = f"<h1>{MAIN}{self.words(1, 12)}</h1>"
            parts.insert(0, self.r.choice([h, h, f"<header>{h}</header>"]))
        for extra, p in ((self.advert, 0.3), (self.aside, 0.15), (self.share, 0.15), (self.talk, 0.15), (self.form, 0.12), (self.note, 0.1)):
            if self.r.random() < p:
                parts.insert(self.r.randint(0, len(parts)) if extra != self.talk else len(parts), extra())
        inside = "".join(parts)
        return self.r.choice([lambda: f"<article>{inside}</article>", lambda: f"<article>{inside}</article>", lambda: f"<main>{inside}</main>", lambda: f"<main><article>{inside}</article></main>", lambda: f"<div{self.mark(BODY)}>{inside}</div>", lambda: f"<div{self.mark(BODY)}>{inside}</div>", lambda: f"<section{self.mark(BODY)}>{inside}</section>", lambda: f'<div id="wrapper"><div class="col">{inside}</div></div>', lambda: f'<article class="post"><div{self.mark(BODY)}>{inside}</div></article>'])()

    def page(self) -> str:
        some = lambda f, p: f() if self.r.random() < p else ""
        before = [some(self.note, 0.25), some(self.top, 0.6), some(self.menu, 0.8), some(self.advert, 0.4), some(self.aside, 0.15), some(self.form, 0.15)]
        after = [some(self.share, 0.2), some(self.talk, 0.4), some(self.aside, 0.4), some(self.form, 0.25), some(self.advert, 0.25), some(self.foot, 0.85), some(self.note, 0.15)]
        head = f'<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        body = "".join(before) + self.article() + "".join(after)
        return head + (f'<div id="page">{body}</div>' if self.r.random() < 0.3 else body) + self.r.choice(["</body></html>", ""])


def labelled(page: str) -> tuple[list[tuple[int, ...]], list[int]]:
    """Features and labels of a page whose main blocks are marked."""
    found = [(t.replace(MAIN, "").strip(), p, k, int(MAIN in t)) for t, p, k in blocks(page)]
    found = [b for b in found if b[0]]
    return [path_features(p) + text_features(t, k, i, len(found)) for i, (t, p, k, _) in enumerate(found)], [b[3] for b in found]


def training_pages(n: int, seed: int = 1) -> list[tuple[list[tuple[int, ...]], list[int]]]:
    return [x for i in range(n) if (x := labelled(Layout(seed * 1_000_003 + i).page()))[0]]
