"""HTML extraction by union-free regular-expression inference of wrappers."""

from __future__ import annotations

import html as entities
import json
import random
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from itertools import accumulate
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfuse.llm.common import staged, table

#: Wrappers' total bytes up to which they are sent to every task; more are joined by host.
SENT_BYTES = 32 << 20
#: Shapes of pages that a task holds before it passes them on; they meet again by host and shape.
HELD_SHAPES = 20_000
SALTS = 64
#: Pages on which a slot that not every page has must have the same text to be taken for the host's template.
TEMPLATE_PAGES = 5
#: Of the article's main part, the share of its weight, or of the mean length of its texts, from which on a part beside it is the article's too.
BESIDE_SHARE = 0.25
#: Pairs of places that the search for repeats compares at a time.
HELD_PAIRS = 1 << 20
#: Symbols of a row up to which the search for repeats compares all places, which costs less; both ways find the same lengths of whole elements.
SHORT_ROW = 100

_TOKEN = re.compile(
    r"<(?P<raw>script|style|noscript|template|textarea|svg|iframe|object|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_LINK = re.compile(r"</?a[\s>]", re.I)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that stand inside a line, that have no end, and whose end tag pages leave out.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option colgroup html body head".split())
#: Elements, and words of class, id and role, that stand around an article.
OUTSIDE = frozenset("nav header footer aside form button dialog menu fieldset".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side aside related recommended share sharing social comment comments respond disqus replies newsletter subscribe signup login search footer header masthead toolbar pagination pager widget".split()
)
CONTENT_WORDS = frozenset("article content main post entry story maincontent articlebody postcontent entrycontent storybody".split())

#: Elements that hold text rather than parts of a page.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure figcaption address details summary caption".split())
#: First parts of a class name that tell of an element beside this one.
BESIDE = frozenset("has with no without hide show toggle".split())

#: Of a text slot: pages it stood on, the hash of the text that they share (VARIES where they differ), characters in all, those of them in links, texts.
Slot = tuple[int, int, int, int, int]
VARIES = -1
#: A piece of a wrapper: a symbol or a tuple of pieces, repeated, optional, and of a text slot what is known of it.
Piece = tuple["str | tuple[Piece, ...]", bool, bool, "Slot | None"]


def symbols(page: str) -> Iterator[tuple[str, int, int]]:
    """(symbol, start, end) of tags and of the text between: '#' is text, '~' an inline or void tag, '' what is never shown."""
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "#", at, m.start()
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            yield "", m.start(), at
        elif name in INLINE:
            yield "~", m.start(), at
        elif name in VOID:
            yield "~br" if name in ("br", "hr") else "~", m.start(), at
        elif m["end"]:
            yield f"</{name}>", m.start(), at
        else:
            marks = " ".join(sorted({w for a in _ATTR.findall(m["attrs"]) for w in "".join(a[1:]).lower().split()})) if m["attrs"] else ""
            yield f"<{name} {marks}>" if marks else f"<{name}>", m.start(), at
    if at < len(page):
        yield "#", at, len(page)


def _name(symbol: str) -> str:
    return symbol[1:-1].split(" ", 1)[0].lstrip("/")


def _tokens(symbol: str) -> list[set[str]]:
    """Of each class, id and role of an opening tag its words, and the whole without joints."""
    return [{w for w in (*re.split(r"[^a-z0-9]+", m), re.sub(r"[^a-z0-9]+", "", m)) if w} for m in symbol[1:-1].split(" ")[1:]]


def _words(symbol: str) -> set[str]:
    return set().union(*_tokens(symbol))


def is_outside(symbol: str) -> bool:
    """Whether an opening tag's name or words say that it stands around an article. A name that says content beside one that does not is content; `has-sidebar` is no sidebar."""
    if symbol[:1] != "<" or symbol[1] == "/":
        return False
    if _name(symbol) in OUTSIDE:
        return True
    if _name(symbol) in ("body", "html", "main"):
        return False
    marks = [m.split("-", 1)[0].split("_", 1)[0] for m in symbol[1:-1].split(" ")[1:]]
    tokens = [t for t, m in zip(_tokens(symbol), marks) if m not in BESIDE]
    bad = [not OUTSIDE_WORDS.isdisjoint(t) for t in tokens]
    return any(bad) and not any(not b and not CONTENT_WORDS.isdisjoint(t) for t, b in zip(tokens, bad))


def _marked_inline(tag: str) -> str:
    """An inline tag as the symbol that a block tag would have; '' for one that holds nothing."""
    m = _TOKEN.match(tag)
    name = (m["name"] or "").lower() if m else ""
    if not name or name in VOID:
        return ""
    if m["end"]:
        return f"</{name}>"
    marks = " ".join(w for a in _ATTR.findall(m["attrs"]) for w in "".join(a[1:]).lower().split())
    return f"<{name} {marks}>" if marks else f"<{name}>"


#: What ends an element whose end tag is left out; the end of an element around it does too.
ENDS = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "option": {"option"}}


def _hide(hidden: list[str], symbol: str) -> None:
    """Keeps the stack of open elements from the hidden one on. Inline tags, given as `<span …>`, count inside a hidden inline element only."""
    name = _name(symbol)
    loose, inline, root = name in LOOSE, name in INLINE, hidden[0] if hidden else ""
    if symbol[1] == "/":
        if name in hidden and (not loose or hidden[-1] == name or root in INLINE):
            while hidden.pop() != name:
                pass
        elif name not in hidden and not inline and (root in INLINE or root in LOOSE and (not loose or len(hidden) == 1 and name in ("tr", "tbody", "thead", "tfoot", "li", "td", "th"))):
            hidden.clear()  # the element around it ends
        return
    if root in LOOSE and len(hidden) == 1 and not inline:
        ends = ENDS.get(root, set())
        if ends is None or name in ends:
            hidden.clear()
    if hidden:
        if root in INLINE or not loose and not inline:
            hidden.append(name)
    elif is_outside(symbol):
        hidden.append(name)


def skeleton(page: str) -> tuple[list[str], list[str], list[tuple[str, int, int, int]], list[int]]:
    """The row of block tags and text slots, loose end tags and blank text left out; the texts of its slots, in order; all tokens with the
    place in the row that each belongs to; and how many characters of each text stand in links."""
    row: list[str] = []
    parts: list[list[str]] = []
    links: list[int] = []
    tokens: list[tuple[str, int, int, int]] = []
    linked = False
    for s, a, b in symbols(page):
        if s == "#" and not page[a:b].isspace():
            if not row or row[-1] != "#":
                row.append(s)
                parts.append([])
                links.append(0)
            parts[-1].append(page[a:b])
            links[-1] += b - a if linked else 0
        elif s == "~":
            if _LINK.match(page, a, b):
                linked = page[a + 1] != "/"
        elif s not in ("#", "", "~br") and not (s[:2] == "</" and _name(s) in LOOSE):
            row.append(s)
            linked = False
        tokens.append((s, a, b, len(row) - 1))
    return row, ["".join(p) for p in parts], tokens, links


def _met(a: Slot, b: Slot) -> Slot:
    """What is known of a slot of two pages."""
    return a[0] + b[0], a[1] if a[1] == b[1] else VARIES, a[2] + b[2], a[3] + b[3], a[4] + b[4]


def _folded(a: Slot, b: Slot) -> Slot:
    """What is known of two slots of the same pages that become one: their texts one after the other."""
    return max(a[0], b[0]), VARIES if VARIES in (a[1], b[1]) else (a[1] * 0x9E3779B97F4A7C15 + b[1]) >> 1 & (1 << 62) - 1, a[2] + b[2], a[3] + b[3], a[4] + b[4]


def _joined(a: Piece, b: Piece, how: Callable[[Slot, Slot], Slot] = _met) -> Piece:
    body = a[0] if isinstance(a[0], str) else tuple(_joined(x, y, how) for x, y in zip(a[0], b[0]))
    return body, a[1] or b[1], a[2] or b[2], how(a[3], b[3]) if a[3] and b[3] else None


def _shape(p: Piece) -> object:
    return p[0] if isinstance(p[0], str) else tuple(map(_shape, p[0]))


def _whole(shapes: list[object]) -> bool:
    """Whether every element that the shapes open they also close, and none other."""
    open_: list[str] = []
    for s in shapes:
        if isinstance(s, str) and s[:1] == "<" and (name := _name(s)) not in LOOSE:
            if s[1] != "/":
                open_.append(name)
            elif not open_ or open_.pop() != name:
                return False
    return not open_


class _Open:
    """Numbers for the stacks of open elements along a row: a run of whole elements ends with the number that it began with."""

    def __init__(self):
        self.number: dict[tuple[int, str], int] = {}
        self.below: list[tuple[int, str]] = [(0, "")]

    def _new(self, below: int, name: str) -> int:
        self.below.append((below, name))
        return len(self.below) - 1

    def after(self, now: int, shape: object) -> int:
        if not isinstance(shape, str) or shape[:1] != "<" or (name := _name(shape)) in LOOSE:
            return now
        if shape[1] != "/":
            if (now, name) not in self.number:
                self.number[now, name] = self._new(now, name)
            return self.number[now, name]
        below, top = self.below[now]
        return below if top == name else self._new(0, "")  # what was not opened: a number that comes once


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


def _next_repeat(shapes: list[object], after: int) -> int:
    """The least n over after such that two neighbouring runs of n shapes may be equal; 0 if there is none.

    Equal neighbouring runs of n cover a place that n divides and the place n further, and how far both agree to the left and the right adds up to
    n. So only len / n places are looked at for each n, and a rolling hash and bisection tell how far they agree: len · log² in all.
    Runs of whole elements leave open what was open before, wherever between their first and last place one looks. A hash never tells equal runs apart; should it take others for equal, that costs a pass and changes nothing.
    """
    size = len(shapes)
    known: dict[object, int] = {}
    ids = [known.setdefault(s, len(known)) for s in shapes]
    if size <= SHORT_ROW:
        return next((n for n in range(after + 1, size // 2 + 1) if b"\1" * n in bytes(map(eq, ids, ids[n:]))), 0)
    ids = np.array(ids, np.int64)
    draw = random.Random(1)
    codes = np.array([draw.getrandbits(64) for _ in known], np.uint64)[ids]
    power = _powers(draw.getrandbits(64) | 1, size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[:size])])
    open_ = _Open()
    stacks = np.fromiter(accumulate(shapes, open_.after, initial=0), np.int64, size + 1)
    n = after + 1
    while n <= size // 2:
        most = n
        pairs = 0
        while most <= size // 2 and (most == n or pairs < HELD_PAIRS):
            pairs += (size - most - 1) // most + 1
            most += 1
        counts = (size - np.arange(n, most) - 1) // np.arange(n, most) + 1
        step = np.repeat(np.arange(n, most), counts)
        at = (np.arange(len(step)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
        same = ids[at] == ids[at + step]
        step, at = step[same], at[same]
        balanced = stacks[at] == stacks[at + step]
        step, at = step[balanced], at[balanced]
        equal = lambda a, b: (sums[b] - sums[a]) * power[step] == sums[b + step] - sums[a + step]  # noqa: E731, B023
        right, left = np.ones_like(at), np.ones_like(at)
        top_right, top_left = np.minimum(step, size - at - step), np.minimum(step, at + 1)
        for _ in range(int(most).bit_length() + 1):
            mid = (right + top_right + 1) // 2
            good = equal(at, at + mid)
            right, top_right = np.where(good, mid, right), np.where(good, top_right, mid - 1)
            mid = (left + top_left + 1) // 2
            good = equal(at + 1 - mid, at + 1)
            left, top_left = np.where(good, mid, left), np.where(good, top_left, mid - 1)
        found = step[right + left - 1 >= step]
        if len(found):
            return int(found.min())
        n = most
    return 0


def fold_repeats(pieces: list[Piece]) -> list[Piece]:
    """Neighbouring equal runs of whole elements become one repeated group; shorter ones first. Lengths of which no two runs are equal are passed over."""
    n = 0
    while True:
        shapes = list(map(_shape, pieces))
        grouped = min((len(s) for s in shapes if isinstance(s, tuple) and len(s) > n), default=0)
        n = min(filter(None, (grouped, _next_repeat(shapes, n))), default=0)
        if not n or n > len(pieces) // 2:
            return pieces
        out: list[Piece] = []
        shapes = []
        open_, stacks = _Open(), [0]  # what is open before each of shapes, and after the last
        for p in pieces:
            out.append(p)
            shapes.append(_shape(p))
            stacks.append(open_.after(stacks[-1], shapes[-1]))
            if len(out) < n or stacks[-1] != stacks[-1 - n]:
                continue
            if len(out) >= 2 * n and shapes[-1] == shapes[-1 - n] and shapes[-n] == shapes[-2 * n] and shapes[-n:] == shapes[-2 * n : -n] and _whole(shapes[-n:]):
                both = [_joined(x, y, _folded) for x, y in zip(out[-2 * n : -n], out[-n:])]
                group = (both[0][0], True, both[0][2], both[0][3]) if n == 1 else (tuple(both), True, False, None)
            elif n > 1 and len(out) > n and out[-n - 1][1] and isinstance(shapes[-n - 1], tuple) and len(shapes[-n - 1]) == n and shapes[-n - 1] == tuple(shapes[-n:]):
                old = out[-n - 1]
                group = (tuple(_joined(x, y, _folded) for x, y in zip(old[0], out[-n:])), True, old[2], None)
                both = [old]
            else:
                continue
            gone = 2 * n if len(both) == n and both[0] is not out[-n - 1] else n + 1
            del out[-gone:], shapes[-gone:], stacks[-gone:]
            out.append(group)
            shapes.append(_shape(group))
            stacks.append(open_.after(stacks[-1], shapes[-1]))
        pieces = out


def wrapper_of(page: str) -> list[Piece]:
    row, texts, _, links = skeleton(page)
    known = zip(texts, links)
    pieces: list[Piece] = []
    for s in row:
        slot = None
        if s == "#":
            text, link = next(known)
            text = " ".join(text.split())
            slot = 1, xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1, len(text), min(link, len(text)), 1
        pieces.append((s, False, False, slot))
    return fold_repeats(pieces)


def align(one: list[Piece], two: list[Piece]) -> list[Piece]:
    """The wrapper of both: what differs becomes optional, a group that one side repeats is repeated. No unions: differing runs follow each other."""
    a, b = _unfold(one, two), _unfold(two, one)
    out: list[Piece] = []
    for tag, i, j, k, m in SequenceMatcher(None, [_shape(x) for x in a], [_shape(x) for x in b], autojunk=False).get_opcodes():
        if tag == "equal":
            out += [_joined(x, y) for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [(x[0], x[1], True, x[3]) for x in (*a[i:j], *b[k:m])]
    return fold_repeats(out)


def _unfold(own: list[Piece], other: list[Piece]) -> list[Piece]:
    """own with runs that the other side has as a repeated group made that group."""
    groups = {_shape(p): p for p in other if not isinstance(p[0], str)}
    if not groups:
        return own
    out: list[Piece] = []
    for p in own:
        out.append(p)
        for shape in groups:
            n = len(shape)
            if len(out) >= n and tuple(_shape(x) for x in out[-n:]) == shape:
                body = tuple(out[-n:])
                del out[-n:]
                out.append((body, False, False, None))
                break
    return out


class Region:
    """Which places of a row of symbols are the article's, and which of them open it."""

    def __init__(self, row: list[str], weights: list[float], template: set[int], shared: set[int] = frozenset(), own_text: dict[int, tuple[int, int, int]] | None = None):
        """weights: of each place, its text's; template: places whose text many pages share; shared: those whose text every page of the host has, which weigh nothing outside what is named as content;
        own_text: of places whose text is a page's own, its characters, those in links, and how many texts they are.

        Starts from the whole row and goes down into the part that weighs most, as long as that is more than half of what the parts around it
        weigh and no heading stands beside it. Tags and class names shift the weights: what says
        that it stands outside, and text that is mostly links, counts a twentieth, an article four times, other names of content twice. An article is not gone down into,
        and a part with a name of content only for one with a stronger name.

        Where no name tells, an article may stand in several parts side by side. A part, or a text, beside the one gone down into stays too if its own text
        weighs at least BESIDE_SHARE of that one's or comes in texts of such a length, unless more than half of it is links or it ends before
        the main heading's part. Where no part weighs more than half, all stay but such ones.
        """
        kids, own, heads, name, end, outside, rank = [[]], [0.0], [False], [""], [len(row)], [False], [3]
        start, stack, at_head = [0], [0], False
        up, places, titles = [0], [[]], []
        for k, s in enumerate(row):
            if s == "#":
                places[stack[-1]].append(k)
                own[stack[-1]] += 0.0 if k in shared and all(rank[e] == 3 for e in stack) else weights[k]
                heads[stack[-1]] |= at_head and weights[k] > 0
                continue
            tag = _name(s)
            at_head = s[1] != "/" and tag[:1] == "h" and tag[1:].isdigit()
            if at_head and tag == "h1":
                titles.append(k)
            if tag in TEXTUAL or tag in LOOSE and tag != "body":
                continue
            if s[1] == "/":
                for x in range(len(stack) - 1, 0, -1):
                    if name[stack[x]] == tag:
                        for e in stack[x:]:
                            end[e] = k + 1
                        del stack[x:]
                        break
                continue
            words = _words(s)
            up.append(stack[-1])
            places.append([])
            kids[stack[-1]].append(len(kids))
            stack.append(len(kids))
            kids.append([])
            own.append(0.0)
            heads.append(False)
            name.append(tag)
            start.append(k)
            end.append(len(row))
            outside.append(is_outside(s))
            rank.append(0 if tag == "article" else 1 if tag == "main" or "main" in words and "role" in words else 2 if not CONTENT_WORDS.isdisjoint(words) else 3)
        # own text of each part, without what stands outside, and whether a part of it is named as content
        own_text = own_text or {}
        nothing = 0, 0, 0
        said = [tuple(map(sum, zip(nothing, *(own_text.get(k, nothing) for k in at)))) for at in places]
        named = [r < 3 and not o for r, o in zip(rank, outside)]
        for e in range(len(kids) - 1, 0, -1):
            if outside[e]:
                said[e] = nothing
            said[up[e]] = tuple(a + b for a, b in zip(said[up[e]], said[e]))
            named[up[e]] |= named[e]

        def listed(what: tuple[int, ...]) -> bool:
            return 2 * what[1] > what[0]

        def beside(what: tuple[int, ...], best: int, before: int) -> bool:
            chars, _, texts = what
            most, _, parts = said[best]
            if not chars or listed(what) or any(before <= t < end[best] and t >= start[best] for t in titles):
                return False
            return chars >= BESIDE_SHARE * most or chars * parts >= BESIDE_SHARE * most * texts

        total = own.copy()
        for e in range(len(kids) - 1, -1, -1):
            total[e] = (own[e] + sum(total[c] for c in kids[e])) * (0.05 if outside[e] or listed(said[e]) and not named[e] else 1.0)
        pull = lambda e: total[e] * (4.0 if rank[e] == 0 else 2.0 if rank[e] < 3 else 1.0)
        at, spans, more, less = 0, [], [], set()
        while kids[at] and rank[at]:
            best = max(kids[at], key=lambda e: (pull(e), -e))
            if heads[at] or rank[at] < 3 and rank[best] >= rank[at] or pull(best) <= 0.5 * (own[at] + sum(map(pull, kids[at]))):
                articles = [e for e in kids[at] if rank[e] == 0 and not outside[e]]
                if articles and sum(map(pull, articles)) > 0.5 * (own[at] + sum(map(pull, kids[at]))):
                    spans, at = [(start[articles[0]], end[articles[-1]])], at
                    self.roots = {start[e] for e in articles}
                elif not named[at] and not heads[at]:
                    title = min((t for t in titles if start[at] <= t < end[at]), default=0)
                    less = {k for e in kids[at] if listed(said[e]) or end[e] <= title for k in range(start[e], end[e])}
                break
            if not named[at]:
                more += [(start[e], end[e]) for e in kids[at] if e != best and beside(said[e], best, end[e])]
                more += [(k, k + 1) for k in places[at] if beside(own_text.get(k, nothing), best, k)]
            at = best
        if not spans:
            spans = [(start[at], end[at])]
            self.roots = {start[at]} if at else set()
        spans += more
        # inside what is named as content, a text that all pages share is the author's
        gone = template if rank[at] == 3 and not any(row[k].startswith("<article") for k in self.roots) else set()
        inside = {k for a, b in spans for k in range(a, b)}
        self.keep = [k in inside and k not in gone and k not in less for k in range(len(row))]


class Compiled:
    """A wrapper as a position automaton over its symbols, with the article's places."""

    def __init__(self, pieces: list[Piece]):
        self.leaves: list[tuple[str, Slot | None]] = []
        self.follow: list[int] = []
        self.first, self.last, self.blank = self._sequence(pieces)
        self.places: dict[str, int] = {}
        for k, (s, _) in enumerate(self.leaves):
            self.places[s] = self.places.get(s, 0) | 1 << k
        slots = [slot for _, slot in self.leaves]
        vary = any(slot and slot[1] == VARIES for slot in slots)
        # a text that all pages share counts once, one that varies on every page
        weights = [0.0 if slot is None else float(slot[2]) if slot[1] == VARIES else slot[2] / slot[0] for slot in slots]
        # from three pages on, what all have alike while other text varies is the host's; on two it may as well be a copied article
        pages = max((slot[0] for slot in slots if slot), default=0)
        shared = {k for k, slot in enumerate(slots) if vary and slot and slot[1] != VARIES and slot[0] == pages >= 3}
        template = shared | {k for k, slot in enumerate(slots) if vary and slot and slot[1] != VARIES and slot[0] >= TEMPLATE_PAGES}
        own_text = {k: slot[2:] for k, slot in enumerate(slots) if slot and (slot[1] == VARIES or not vary)}
        self.region = Region([s for s, _ in self.leaves], weights, template, shared, own_text)

    def _sequence(self, pieces: list[Piece] | tuple[Piece, ...]) -> tuple[int, int, bool]:
        """Adds the pieces' places; which of them can come first and last, and whether none need come."""
        first, last, blank = 0, 0, True
        for body, repeated, optional, slot in pieces:
            if isinstance(body, str):
                f = l = 1 << len(self.leaves)
                n = False
                self.leaves.append((body, slot))
                self.follow.append(0)
            else:
                f, l, n = self._sequence(body)
            if repeated:
                self._link(l, f)
            self._link(last, f)
            first |= f if blank else 0
            last = l | (last if n or optional else 0)
            blank &= n or optional
        return first, last, blank

    def _link(self, before: int, after: int) -> None:
        for k in _bits(before):
            self.follow[k] |= after

    def path(self, row: list[str]) -> list[int] | None:
        """The wrapper's place of each symbol of a page's row; None if the page is not of this wrapper. Every place that a prefix can reach is
        followed at once, so the work grows with the row and never backtracks."""
        now, seen = self.first, []
        for s in row:
            now &= self.places.get(s, 0)
            if not now:
                return None
            seen.append(now)
            step = 0
            for k in _bits(now):
                step |= self.follow[k]
            now = step
        if not seen:
            return [] if self.blank else None
        ends = seen[-1] & self.last
        if not ends:
            return None
        out = [(ends & -ends).bit_length() - 1]
        for now in reversed(seen[:-1]):
            out.append(next(k for k in _bits(now) if self.follow[k] >> out[-1] & 1))
        return out[::-1]


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def main_text(page: str | None, wrapper: Compiled | None) -> str:
    """The article's text: what stands at the article's places of the wrapper; of a page that is not of it, or has none, the same choice made on the page alone."""
    if not page:
        return ""
    row, texts, tokens, links = skeleton(page)
    path = wrapper.path(row) if wrapper else None
    if path is not None:
        keep, roots = [wrapper.region.keep[k] for k in path], {k for k, at in enumerate(path) if at in wrapper.region.roots}
    else:
        slots = [k for k, s in enumerate(row) if s == "#"]
        weights = [0.0] * len(row)
        for k, text in zip(slots, texts):
            weights[k] = float(len(text))
        alone = Region(row, weights, set(), own_text={k: (len(text), link, 1) for k, text, link in zip(slots, texts, links)})
        keep, roots = alone.keep, alone.roots
    blocks: list[str] = []
    run: list[str] = []
    hidden: list[str] = []
    code = False
    for s, a, b, at in tokens:
        inside = at >= 0 and keep[at]
        if s == "#":
            if inside and not hidden:
                run.append(page[a:b])
        elif s == "":
            continue
        elif s == "~":
            # marks in code are the colours of a highlighter
            if inside and not code and (hidden and hidden[0] in INLINE or _ATTR.search(page, a, b)) and (tag := _marked_inline(page[a:b])):
                _hide(hidden, tag)
        else:
            blocks.append("".join(run))
            run = []
            if s == "~br" or not inside or s[1] != "/" and at in roots:
                continue
            if _name(s) == "pre":
                code = s[1] != "/"
            _hide(hidden, s)
    blocks.append("".join(run))
    return " ".join(x for x in (" ".join(entities.unescape(t).split()) for t in blocks) if x)


def _dump(pieces: list[Piece]) -> str:
    return json.dumps(pieces)


def _load(text: str) -> list[Piece]:
    back = lambda p: (p[0] if isinstance(p[0], str) else tuple(map(back, p[0])), p[1], p[2], p[3] and tuple(p[3]))
    return [back(p) for p in json.loads(text)]


def _key(pieces: list[Piece]) -> str:
    """The wrapper without what is known of its slots."""
    bare = lambda p: (p[0] if isinstance(p[0], str) else tuple(map(bare, p[0])), p[1], p[2])
    return json.dumps([bare(p) for p in pieces])


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrappers of single pages, those of a host with the same key as one."""
    held: dict[tuple[str, str], list[Piece]] = {}

    def out() -> pa.RecordBatch:
        rows = [(h, k, _dump(w)) for (h, k), w in held.items()]
        held.clear()
        h, k, w = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(k, pa.string()), pa.array(w, pa.string())], ["host", "key", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            if page := page.as_py():
                new = wrapper_of(page)
                at = host, _key(new)
                held[at] = [_joined(x, y) for x, y in zip(held[at], new)] if at in held else new
        if len(held) > HELD_SHAPES:
            yield out()
    yield out()


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by host, salt and key: aligns the wrappers of a host and salt one after another, those of one key first, holding two."""
    at, key, now, same = None, None, None, None

    def settled() -> list[Piece]:
        return same if now is None else align(now, same)

    def out() -> pd.DataFrame:
        done = settled()
        return pd.DataFrame({"host": [at[0]], "key": [_key(done)], "wrapper": [_dump(done)]})

    for pdf in batches:
        for h, salt, k, w in zip(pdf["host"], pdf["salt"], pdf["key"], pdf["wrapper"]):
            new = _load(w)
            if (h, salt) != at:
                if at is not None:
                    yield out()
                at, key, now, same = (h, salt), k, None, new
            elif k == key:
                same = [_joined(x, y) for x, y in zip(same, new)]
            else:
                now, key, same = settled(), k, new
    if at is not None:
        yield out()


def _host() -> Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) for each host of pages (url, html).

    Each page's token stream, with repeats folded, is a wrapper; those of one host and key meet first, then the host's are aligned in the order of
    their keys, at most SALTS groups of them by a hash of the key, then those groups' results. So neither the number of tasks nor
    their order changes a wrapper, and a host with a third of all pages is never one task's work.
    """
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = pages.select(_host().alias("host"), "html").mapInArrow(_infer, "host string, key string, wrapper string")
    for salt in (F.pmod(F.xxhash64("key"), F.lit(SALTS)), F.lit(0).cast("long")):
        part = part.withColumn("salt", salt).repartition(n, "host", "salt").sortWithinPartitions("host", "salt", "key").select("host", "salt", "key", "wrapper").mapInPandas(_merge, "host string, key string, wrapper string")
    return part.select("host", "wrapper")


def _extract(batches: Iterator[pa.RecordBatch], sent: dict[str, str] | None) -> Iterator[pa.RecordBatch]:
    """Columns: page_id, url, host, html and, where wrappers are joined, wrapper."""
    ready: dict[str, Compiled] = {}
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            texts = []
            own = batch.column(4).to_pylist() if sent is None else None
            for k, (host, page) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                source = own[k] if own is not None else sent.get(host)
                if source and host not in ready:
                    if len(ready) > 2_000:
                        ready.clear()
                    ready[host] = Compiled(_load(source))
                texts.append(main_text(page.as_py(), ready.get(host) if source else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text: the main text of every page.

    pages: page_id, url, html; other columns are not read. Null html counts as empty and has an empty text, as has a page without an article's text;
    a null or odd url belongs to the empty host. Repeated rows each have their text; an empty table gives an empty result.
    Blocks of the article are joined by one space, white space inside is one space, character references are decoded.
    """
    inferred = staged(wrappers(pages), "wrappers")
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", _host().alias("host"), "html")
    if (inferred.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0) <= SENT_BYTES:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in inferred.collect()})
        return rows.mapInArrow(lambda it: _extract(it, sent.value), f"page_id {kind}, url string, text string")
    return rows.join(inferred, "host", "left").select("page_id", "url", "host", "html", "wrapper").mapInArrow(lambda it: _extract(it, None), f"page_id {kind}, url string, text string")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
