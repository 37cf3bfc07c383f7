"""HTML pages as sequences of leaf blocks with features.

A leaf block is the text between two block boundaries.  It knows the tags and the
words of the classes, ids and roles of its ancestors.  Unclosed and stray tags are
mended the way browsers do it for paragraphs, list items and table cells.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass

FEATURES = 1 << 13

#: Elements whose text is never shown as such (fixed values of the HTML standard, as are the next sets).
HIDDEN = {"script", "style", "noscript", "template", "title", "iframe", "object", "svg", "math", "canvas", "audio", "video", "head", "textarea", "select", "datalist"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp"}
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "wbr", "br", "input", "button",
}
ENDS_ITSELF = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
               "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
               "option": ({"option"}, {"select"})}
IN_PARAGRAPH_SCOPE = {"table", "td", "th", "button", "body", "html", "caption"}

# No alternative reads past the next tag, so broken markup costs no more than good one.  What follows the name of a
# tag is read by _Attributes.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/<>]*+)|<[!?][^<>]*+>", re.S)
_UNQUOTED = re.compile(r"[^<>\"']*+")
_UP_TO_TAG = re.compile(r"[^<>]*+")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_HINT = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HINT_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Words of a text that tell its role, whatever else it says (fixed values).
_TEXT_HINTS = re.compile(
    r"©|\b(copyright|rights reserved|cookies?|privacy|terms|subscribe|newsletter|sign up|log ?in|advert\w*|sponsored|share|tweet|comments?|repl(?:y|ies)|"
    r"related|read more|next|previous|search|menu|home|contact|tags?|posted|posts?)\b", re.I
)


def feature(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


@dataclass
class LeafBlock:
    text: str
    features: tuple[int, ...]


class _Frame:
    __slots__ = ("tag", "inline", "features", "hidden", "link", "label")

    def __init__(self, tag, inline, features, hidden, link, label):
        self.tag, self.inline, self.features, self.hidden, self.link, self.label = tag, inline, features, hidden, link, label


_ROOT = _Frame("", False, frozenset(), False, False, "")
_LABEL = re.compile(r'data-label="(\w+)"')


class _Attributes:
    """Finds the ends of the tags of one page, in linear time whatever the length of quoted values."""

    def __init__(self, page: str):
        self.page = page
        self.unpaired: set[str] = set()  # quotes that occur no more
        self.failed: set[int] = set()  # places of opening quotes from which no tag end is reached

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose name ends at ``at``, or -1.

        If the quotes do not pair up, they are ordinary characters.
        """
        page, place, opened = self.page, at, []
        while True:
            place = _UNQUOTED.match(page, place).end()
            mark = page[place:place + 1]
            if mark == ">":
                return place
            if mark in ("", "<") or mark in self.unpaired or place in self.failed:
                break
            opened.append(place)
            place = page.find(mark, place + 1) + 1
            if not place:
                self.unpaired.add(mark)
                break
        self.failed.update(opened)
        place = _UP_TO_TAG.match(page, at).end()
        return place if page[place:place + 1] == ">" else -1


class _Pages:
    """Turns one page at a time into blocks; what it knows of ancestors is kept between pages."""

    MOST_KNOWN = 20000
    LONG = 2000  # attributes beyond that are not kept between tags

    def __init__(self):
        self.known: dict[tuple, frozenset] = {}

    def below(self, parent: frozenset, tag: str, attrs: str) -> frozenset:
        key = (parent, tag, attrs)
        found = self.known.get(key)
        if found is None:
            names = [f"in:{tag}"]
            for kind, *values in _HINT.findall(attrs):
                value = "".join(values)
                if kind.lower() in ("hidden", "aria-hidden"):
                    names += ["hidden"] if value.lower() != "false" else []
                else:
                    names += {f"hint:{w.lower()}" for w in _HINT_WORD.findall(value)}
            found = parent.union(map(feature, names))
            if len(self.known) >= self.MOST_KNOWN:
                self.known.clear()
            if len(attrs) <= self.LONG:
                self.known[key] = found
        return found

    def blocks(self, page: str) -> list[tuple[LeafBlock, str]]:
        """Blocks in page order, each with the label its nearest ``data-label`` names, if any."""
        out: list[tuple[str, _Frame, int, bool]] = []
        stack, opened = [_ROOT], Counter()
        parts: list[str] = []
        in_links = 0
        breaks = 0

        def flush() -> None:
            nonlocal in_links, breaks
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    owner = next(f for f in reversed(stack) if not f.inline)
                    out.append((text, owner, in_links, breaks > 0))
                parts.clear()
            in_links = breaks = 0

        def close(depth: int) -> None:
            if any(not f.inline for f in stack[depth:]):
                flush()
            for f in stack[depth:]:
                opened[f.tag] -= 1
            del stack[depth:]

        def depth_of(tags: set, stops: set) -> int:
            if not any(opened[t] > 0 for t in tags):
                return 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    return k
                if stack[k].tag in stops:
                    return 0
            return 0

        def text(piece: str) -> None:
            nonlocal in_links
            if piece and not stack[-1].hidden:
                piece = html.unescape(piece) if "&" in piece else piece
                parts.append(piece)
                if stack[-1].link:
                    in_links += len(piece)

        at, size = 0, len(page)
        look = 0
        ends = _Attributes(page)
        while at < size:
            m = _TOKEN.search(page, look)
            if m is None:
                text(page[at:])
                break
            tag, is_end = m["tag"], m["end"]
            stop = ends.end(m.end()) if tag else m.end()
            if stop < 0:  # no tag
                look = m.end()
                continue
            text(page[at:m.start()])
            attrs = page[m.end():stop]
            at = look = stop + 1 if tag else stop
            if tag is None:
                continue
            tag = tag.lower()
            inline = tag in INLINE
            if is_end:
                if opened[tag] > 0:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == tag:
                            close(k)
                            break
                        if inline and not stack[k].inline:
                            break
                elif not inline:
                    flush()
                continue
            if tag == "br":
                parts.append(" ")
                breaks += 1
                continue
            if not inline:
                k = depth_of({"p"}, IN_PARAGRAPH_SCOPE)
                if k:
                    close(k)
                if tag in ENDS_ITSELF:
                    k = depth_of(*ENDS_ITSELF[tag])
                    if k:
                        close(k)
                if tag == "body":  # an open head ends here
                    k = depth_of({"head"}, set())
                    if k:
                        close(k)
                flush()
            if tag in VOID or attrs.endswith("/") and tag not in INLINE and tag not in ("p", "div", "li", "td", "article", "section"):
                continue
            if tag in RAW:
                end = _RAW_END[tag].search(page, at)
                at = look = end.end() if end else size
                continue
            top = stack[-1]
            label = _LABEL.search(attrs) if "data-label" in attrs else None
            stack.append(_Frame(
                tag, inline, top.features if inline and tag != "label" else self.below(top.features, tag, "" if attrs.isspace() else _LABEL.sub("", attrs)),
                top.hidden or tag in HIDDEN, top.link or tag == "a", label[1] if label else top.label,
            ))
            opened[tag] += 1
        flush()
        return self._described(out)

    def _described(self, out: list[tuple[str, _Frame, int, bool]]) -> list[tuple[LeafBlock, str]]:
        found, n = [], len(out)
        before = None
        for i, (text, owner, in_links, _) in enumerate(out):
            words = text.count(" ") + 1
            size = len(text)
            names = [
                f"tag:{owner.tag}", f"words:{min(words.bit_length(), 7)}", f"links:{min(3, 4 * in_links // max(size, 1))}",
                f"end:{'stop' if text[-1] in '.!?…\"”’:;' else 'word' if text[-1].isalnum() else 'mark'}",
                f"from_start:{min(i, 4)}", f"from_end:{min(n - 1 - i, 4)}", "alike" if before is owner.tag else "unlike",
                f"stops:{min(text.count('. ') + text.count(', '), 4)}",
            ]
            names.append(f"tag_words:{owner.tag}:{min(words.bit_length(), 7)}")
            if size < 400:
                names += [f"says:{w.lower()}" for w in {m[0].lower() for m in _TEXT_HINTS.finditer(text)}]
            if "|" in text or "·" in text or "»" in text:
                names.append("divided")
            before = owner.tag
            found.append((LeafBlock(text, (*owner.features, *map(_cached_feature, names))), owner.label))
        return found


_names: dict[str, int] = {}


def _cached_feature(name: str) -> int:
    found = _names.get(name)
    if found is None:
        found = _names[name] = feature(name)
    return found


def parser() -> _Pages:
    return _Pages()
