"""Leaf blocks of HTML pages and the features that the extractor's model reads."""

from __future__ import annotations

import html
import re
import zlib
from functools import lru_cache

SLOTS = 1 << 14
#: Fixed values of HTML: elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe".split())
FOREIGN = frozenset(("svg", "math"))
#: Elements whose text pages do not show as such.
HIDDEN = frozenset("svg canvas template select noscript annotation annotation-xml".split())
EMBEDDED = FOREIGN | HIDDEN | {"object"}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
LANDMARKS = frozenset("article main nav aside header footer form section dialog".split())

# Every alternative ends at its mark or at the end of the page and never gives back what
# it took, so reading a page is linear whatever it holds. A quote only opens a value after
# an equals sign; without its partner it is an ordinary character.
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|itemprop|aria-hidden)\b\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_SOURCE = re.compile(r"(?:^|\s)src\s*=", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: References to numbers that are no characters; Python refuses to read very long ones.
_ZEROS = re.compile(r"(&#[xX]?)0{4,}+(?=[0-9a-fA-F])")
_NO_CHARACTER = re.compile(r"&#(?:0*+[1-9][0-9]{7,}+|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{6,}+);?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW}
_HEAD_END = re.compile(r"</head\s*>|<body\b", re.I)
#: A block's path has its outermost and innermost open elements, so many of each at most.
OUTER, INNER = 32, 32


def _read_marks(attributes: str) -> tuple[str, ...]:
    """Words of the attributes that tell what an element is for."""
    out = []
    for name, *values in _ATTR.findall(attributes):
        value = "".join(values)
        if name.lower() in ("hidden",) or (name.lower() == "aria-hidden" and value == "true"):
            out.append("hidden")
        out += [w.lower().rstrip("s") or w.lower() for w in _PART.findall(value)]
    return tuple(dict.fromkeys(out))


_cached_marks = lru_cache(maxsize=20_000)(_read_marks)


def _marks(attributes: str) -> tuple[str, ...]:
    return _cached_marks(attributes) if len(attributes) < 300 else _read_marks(attributes)


class _Ends:
    """Finds where raw elements end; looks for a mark that a page lacks only once."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, tag: str, at: int) -> re.Match | None:
        if tag in self.missing:
            return None
        end = (_HEAD_END if tag == "head" else _RAW_END[tag]).search(self.page, at)
        if not end:
            self.missing.add(tag)
        return end

    def after(self, tag: str, attributes: str, at: int) -> int:
        """Where reading goes on after the start tag of a raw element.

        Without an end tag a script or style of its own text reaches to the page's end, as
        in a page that breaks off; anything else is empty and hides nothing.
        """
        if end := self.find(tag, at):
            return end.end()
        own = tag in ("script", "style") and not attributes.endswith("/") and not _SOURCE.search(attributes)
        return len(self.page) if own else at


class _Open:
    """The open elements, with the places of each tag, so that no step walks through them all."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.hidden = self.foreign = 0

    def push(self, tag: str, marks: tuple[str, ...]) -> None:
        i = len(self.stack)
        self.stack.append((tag, marks))
        self.at.setdefault(tag, []).append(i)
        if tag not in INLINE:
            self.blocks.append(i)
        self.hidden += tag in HIDDEN
        self.foreign += tag in FOREIGN

    def cut(self, i: int) -> None:
        """Closes the element at place i and all that are open inside it."""
        while len(self.stack) > i:
            tag, _ = self.stack.pop()
            self.at[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
            self.hidden -= tag in HIDDEN
            self.foreign -= tag in FOREIGN

    def last(self, tags) -> int:
        """The place of the innermost open element of these tags, -1 without any."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def path(self) -> tuple:
        s = self.stack
        return tuple(s) if len(s) <= OUTER + INNER else (*s[:OUTER], *s[-INNER:])


def _ended(page: str) -> set[int]:
    """Where the start tags of embedded elements are that have an end tag of their own; others count as empty."""
    out: set[int] = set()
    waiting: dict[str, list[int]] = {}
    ends, at = _Ends(page), 0
    while m := _TAG.search(page, at):
        at = m.end()
        tag = (m[2] or "").lower()
        if tag in EMBEDDED:
            if not m[1]:
                if not (tag in FOREIGN and m[3].endswith("/")):
                    waiting.setdefault(tag, []).append(m.start())
            elif waiting.get(tag):
                out.add(waiting[tag].pop())
        elif tag in RAW and not m[1] and not m[3].endswith("/"):
            at = ends.after(tag, m[3], at)
    return out


def blocks(page: str | None) -> list[tuple[str, tuple, int]]:
    """(text, path, characters in links) of each leaf block in page order.

    A block is the text between two block-level tags; its path is the open elements with
    their marks, the OUTER outermost and INNER innermost ones if there are more. Scripts,
    styles, titles, comments and other text that pages do not show are no blocks, nor is a
    tag that the page's end cuts off. Character references are decoded and white space
    becomes one space. Time and memory are linear in the page, whatever its nesting.
    """
    page = page or ""
    ended: set[int] | None = None
    ends, opened = _Ends(page), _Open()
    out: list[tuple[str, tuple, int]] = []
    parts: list[str] = []
    linked, in_link, path = 0, 0, ()

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(_NO_CHARACTER.sub("�", _ZEROS.sub(r"\1", text)))
            text = " ".join(text.split())
            if text:
                out.append((text, path, linked))
            parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked, path
        if opened.hidden:
            return
        if not parts:
            if not text or text.isspace():
                return
            path = opened.path()
        parts.append(text)
        if in_link:
            linked += len(text)

    at = 0
    find = _TAG.search
    while m := find(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            if opened.at.get(tag):
                opened.cut(opened.at[tag][-1])
            if tag not in INLINE and tag not in EMBEDDED and not opened.hidden and not opened.foreign:
                close()
            continue
        if tag == "br":
            add(" ")
            continue
        if (opened.foreign or tag in FOREIGN) and m[3].endswith("/"):
            continue
        if tag in EMBEDDED:
            if ended is None:
                ended = _ended(page)
            if m.start() in ended:
                opened.push(tag, _marks(m[3]) if m[3] else ())
            continue
        if tag in RAW:
            at = ends.after(tag, m[3], at)
            continue
        if tag not in INLINE and not opened.hidden and not opened.foreign:
            close()
            if opened.stack and (closes := CLOSES_ITSELF.get(tag)):
                i = opened.last(closes)
                if i > opened.last(SCOPE[tag]):
                    opened.cut(i)
            elif opened.blocks and opened.stack[opened.blocks[-1]][0] == "p":
                opened.cut(opened.blocks[-1])
        if tag in VOID or m[3].endswith("/") and ":" in tag:
            continue
        if tag == "head":
            if end := ends.find("head", at):
                at = end.end() if end[0][1] == "/" else end.start()
            continue
        if tag == "a":
            in_link = 1
        opened.push(tag, _marks(m[3]) if m[3] else ())
    if at < len(page):
        add(page[at:])
    close()
    return out


@lru_cache(maxsize=50_000)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % SLOTS


@lru_cache(maxsize=20_000)
def path_features(path: tuple) -> tuple[int, ...]:
    names, landmark, own = set(), "none", "text"
    for tag, marks in path:
        if tag not in INLINE:
            own = tag
        names.add(f"in={tag}")
        names |= {f"mark={m}" for m in marks}
        if tag in LANDMARKS:
            landmark = tag
    last = path[-1][1] if path else ()
    names |= {f"own={own}", f"landmark={landmark}", f"own+landmark={own}+{landmark}", *(f"last={m}" for m in last)}
    return tuple(sorted({_slot(x) for x in names}))


#: Words that notices, menus and footers use.
NOTICE = re.compile(r"cookie|subscribe|newsletter|sign up|log ?in|privacy|terms|copyright|all rights reserved|\xa9|share|related|advert|sponsored|comment|repl(?:y|ies)|menu|next|previous|click|e-?mail", re.I)


def _bucket(x: float, bounds: tuple) -> int:
    return sum(x >= b for b in bounds)


def text_features(text: str, linked: int, i: int, n: int) -> tuple[int, ...]:
    words = text.count(" ") + 1
    links = _bucket(linked / len(text), (0.01, 0.3, 0.7, 0.95))
    size = _bucket(words, (2, 4, 8, 16, 40, 100))
    end = "stop" if text[-1] in ".!?\"'”:;" else "word" if text[-1].isalnum() else "mark"
    notice = len(text) < 400 and NOTICE.search(text) is not None
    return _text_slots(size, links, end, notice, _bucket(i / n, (0.1, 0.3, 0.7, 0.9)), _bucket(text.count(","), (1, 3, 6)))


@lru_cache(maxsize=50_000)
def _text_slots(size: int, links: int, end: str, notice: bool, place: int, commas: int) -> tuple[int, ...]:
    names = (f"size={size}", f"links={links}", f"size+links={size}+{links}", f"end={end}", f"size+end={size}+{end}", f"notice={notice}+{size}", f"place={place}", f"commas={commas}")
    return tuple(map(_slot, names))


def sequence(page: str | None) -> tuple[list[str], list[tuple[int, ...]]]:
    """Texts and features of a page's blocks."""
    found = blocks(page)
    return [b[0] for b in found], [path_features(p) + text_features(t, k, i, len(found)) for i, (t, p, k) in enumerate(found)]
