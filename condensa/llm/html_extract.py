"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is read as a stream of tokens: containers that open and close, and between them blocks, either strings or slots.
A block is a string where its text stands at the same path on many of the host's pages; all others are slots. Tandem
repeats in a stream are folded into repeated groups. The wrapper of a host starts as one folded stream and is aligned with
the others in turn; what one side has and the other lacks becomes an optional group, a single item that meets its own
repetition becomes that repetition. All distinct folded streams of a host take part, FAN at a time in rounds, so that no
task aligns more than a bounded number of them, whatever the host's share of the pages.

Main text is the text inside an article, where a page has one: all of it but the parts that aren't the article's (menus,
asides, forms, adverts, comments), whatever other pages say. The wrapper decides on the other pages: those that obey are
parsed by it, so that every block fills one place of the expression, and a place whose text is the same on all pages that
fill it, three or more, is the template's. Pages that don't obey are judged by their containers and without their strings.
Where the template would take most of a page, the page is a copy of others and stays whole.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, staged

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr label".split())
_DROPPED = frozenset("script style noscript template iframe svg math object embed video audio canvas head title form button select option textarea datalist dialog nav footer aside menu".split())
_RAW = frozenset("script style textarea title noscript iframe template svg".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre figcaption caption blockquote summary address".split())
_MAIN = frozenset(["article", "main"])
#: Whole classes, ids or roles that mark what is not the article, and words in them that mark what is.
_AWAY_WORDS = frozenset("ad ads advert advertisement adverts adbox banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promoted related replies respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo alert".split())
#: Those of them that are words of an article's own parts as well; inside an article they say nothing.
_OWN_WORDS = frozenset("alert banner complementary contentinfo discussion header masthead modal overlay popup related replies respond search skip social toolbar widget widgets".split())
_MAIN_WORDS = frozenset("article post entry story".split())
_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Stands for the attribute `hidden`; a class of that name is left out.
_HIDDEN = "*hidden*"
_WORD = re.compile(r"[a-z]+")
#: A place outside articles with one text on so many pages or more is the template's; strings also need this share of the pages.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.5
#: The template may take so many characters of a page, or half of its text where that is more; pages of which it would take more are copies of each other.
TEMPLATE_CHARS = 200
#: Containers below this depth belong, as places, to the one at this depth; whether they are the article's is told by all of them.
DEPTH = 32
#: Two stretches are compared item by item where the product of their lengths is at most this; longer ones meet at items that occur once in each.
TABLE = 250_000
#: Up to so many bytes of wrappers go to every task; more of them meet their pages by a shuffle on the host.
BROADCAST_BYTES = 32 << 20
#: Where wrappers are larger, about so many pages of a host share one copy of its own.
PIECE = 2000
#: About so many streams of a host are aligned in one piece of work; their results are aligned in the next round.
FAN = 32


def host(url) -> "F.Column":
    """Lower-case host of a url column; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


# ---------------------------------------------------------------- pages as streams

def _name(tag: str, attributes: str) -> str:
    """An element by its tag and its classes, id and role; short ones are remembered, pages of a host have the same."""
    return (_named if len(attributes) < 256 else _named.__wrapped__)(tag, attributes) if attributes else tag


@lru_cache(4096)
def _named(tag: str, attributes: str) -> str:
    words: list[str] = []
    if attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            key = key.lower()
            value = "".join(values).lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                words.append(_HIDDEN)
            elif key in ("class", "id", "role"):
                words += (w for w in value.replace(".", "_").split() if w != _HIDDEN)
    return tag + "".join(f".{w}" for w in sorted(set(words)))


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    verdict: int


_SAME = {"dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"), "option": ("option",)}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTS = frozenset("li ul ol menu".split())


class _Open:
    """The open elements: tags, names, and for each whether it is in an article and whether it is away."""

    def __init__(self):
        self.tags: list[str] = []
        self.names: list[str] = []
        self.states: list[tuple[bool, bool]] = []
        self.lists: list[int] = []
        self.count: Counter = Counter()
        self.kept: tuple | None = ()

    def push(self, tag: str, name: str) -> None:
        inside, away = self.states[-1] if self.states else (False, False)
        away = away or _away(name, inside)
        if tag in _LISTS:
            self.lists.append(len(self.tags))
        self.tags.append(tag)
        self.states.append((inside or (not away and _main(name)), away))
        self.count[tag] += 1
        if len(self.names) < DEPTH:
            self.names.append(name)
            self.kept = None

    def cut(self, size: int) -> None:
        for tag in self.tags[size:]:
            self.count[tag] -= 1
        del self.tags[size:], self.states[size:]
        if size < len(self.names):
            del self.names[size:]
            self.kept = None
        while self.lists and self.lists[-1] >= size:
            self.lists.pop()

    def close(self, tag: str) -> None:
        if self.count[tag]:
            size = len(self.tags)
            while self.tags[size - 1] != tag:
                size -= 1
            self.cut(size - 1)

    def implied(self, tag: str) -> None:
        """End the elements that end because `tag` begins."""
        if not self.tags:
            return
        size, top = len(self.tags), self.tags[-1]
        if tag == "li":
            if self.lists and self.tags[self.lists[-1]] == "li":
                size = self.lists[-1]
            elif top == "p":
                size -= 1
        elif tag in _SAME:
            while size and self.tags[size - 1] in _SAME[tag]:
                size -= 1
        elif top == "p" or (top in _HEADINGS and tag in _HEADINGS):
            size -= 1
        self.cut(size)

    def block(self, text: str) -> Block:
        if self.kept is None:
            self.kept = tuple(self.names)
        inside, away = self.states[-1] if self.states else (False, False)
        return Block(self.kept, text, 0 if away else 2 if inside else 1)


def _tag_end(source: str, at: int, quoted: bool) -> tuple[int, bool]:
    """Where the tag that began before `at` ends (its >), -1 if nowhere, and whether quotes still count.

    Quotes that hold a > are honoured until they are found to run to the end of the page; then no longer, so each
    character is looked at a bounded number of times.
    """
    begin = at
    while quoted:
        stop = _STOP.search(source, at)
        if stop is None:
            break
        if stop[0] == ">":
            return stop.start(), True
        at = source.find(stop[0], stop.end()) + 1
        if not at:
            break
    return source.find(">", begin), False


def blocks(page: str | None) -> list[Block]:
    """(path, text, verdict) of every non-empty block of a page, in page order; inline elements don't break a block, <br> does.

    One pass over the page. The path is that of the outer DEPTH containers, the verdict that of all.
    """
    source = page or ""
    open_, text, out, at, n, quoted = _Open(), [], [], 0, len(source), True

    def flush():
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words:
                out.append(open_.block(words))
            text.clear()

    while at < n:
        mark_ = source.find("<", at)
        if mark_ < 0:
            text.append(source[at:])
            break
        if mark_ > at:
            text.append(source[at:mark_])
        if source.startswith("<!--", mark_):
            end = source.find("-->", mark_ + 4)
            at = end + 3 if end >= 0 else n
            continue
        m = _TAG.match(source, mark_ + 1)
        if m is None and source[mark_ + 1 : mark_ + 2] not in ("!", "?"):
            text.append("<")
            at = mark_ + 1
            continue
        if m is None:
            end = source.find(">", mark_ + 2)
        else:
            end, quoted = _tag_end(source, m.end(), quoted)
        if end < 0:  # no tag ends any more
            text.append(source[mark_:])
            break
        at = end + 1
        if m is None:  # a declaration
            continue
        tag, attributes = m[2].lower(), source[m.end() : end]
        if tag == "br" or tag == "hr":
            flush()
        elif m[1]:
            if tag not in _INLINE:
                flush()
                open_.close(tag)
        elif tag in _RAW:
            flush()
            closing = _closing(tag).search(source, at)
            at = closing.end() if closing else n
        elif tag not in _INLINE and tag not in _VOID:
            flush()
            open_.implied(tag)
            if not attributes.endswith("/"):
                open_.push(tag, _name(tag, attributes))
    flush()
    return out


@lru_cache(64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.IGNORECASE)


def mark(path: tuple[str, ...], text: str) -> int:
    """What stands for a text at a path."""
    return int.from_bytes(hashlib.blake2b("\0".join((*path, text)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def stream(found: list[tuple[tuple[str, ...], str]], strings: frozenset[int] = frozenset()) -> list[str]:
    """Tokens of a page: "name{" and "}" for containers that hold text, "name#" for a slot, "name=text's mark" for a string."""
    out, stack = [], ()
    for path, text, *_ in found:
        outer, leaf = (path[:-1], path[-1]) if path and path[-1].split(".", 1)[0] in _BLOCK else (path, "")
        k = 0
        while k < len(stack) and k < len(outer) and stack[k] == outer[k]:
            k += 1
        known = mark(path, text) if strings else 0
        out += ["}"] * (len(stack) - k) + [f"{x}{{" for x in outer[k:]] + [f"{leaf}={known}" if strings and known in strings else f"{leaf}#"]
        stack = outer
    return out + ["}"] * len(stack)


# ---------------------------------------------------------------- expressions
#
# An expression is a list of items: a token, or [sign, expression] with sign "+" (repeated) or "?" (optional).

def _tree(tokens: list[str]) -> list:
    """Nest the stream: a container is ["{", name, expression]."""
    top: list = []
    stack = [top]
    for t in tokens:
        if t.endswith("{"):
            node = ["{", t, []]
            stack[-1].append(node)
            stack.append(node[2])
        elif t == "}":
            if len(stack) > 1:
                stack.pop()
        else:
            stack[-1].append(t)
    return top


def fold(items: list) -> list:
    """Fold tandem repeats of one to three items into repeated groups, innermost containers first."""
    items = [["{", x[1], fold(x[2])] if isinstance(x, list) and x[0] == "{" else x for x in items]
    for width in (1, 2, 3):
        out, i = [], 0
        while i < len(items):
            unit, j = items[i : i + width], i + width
            while len(unit) == width and items[j : j + width] == unit:
                j += width
            again = j > i + width and not (width == 1 and isinstance(unit[0], list) and unit[0][0] == "+")
            if again or (j > i + width):
                out.append(unit[0] if width == 1 and isinstance(unit[0], list) and unit[0][0] == "+" else ["+", unit])
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _bare(x):
    """What an item is without its signs, for the alignment."""
    while isinstance(x, list) and x[0] in "+?" and len(x[1]) == 1:
        x = x[1][0]
    return ("{", x[1]) if isinstance(x, list) and x[0] == "{" else json.dumps(x)


def _merge(x, y):
    """One item that covers two items with the same bare form."""
    signs = {s[0] for s in (x, y) if isinstance(s, list) and s[0] in "+?"}
    inner = []
    for s in (x, y):
        while isinstance(s, list) and s[0] in "+?" and len(s[1]) == 1:
            signs.add(s[0])
            s = s[1][0]
        inner.append(s)
    a, b = inner
    out = ["{", a[1], align(a[2], b[2])] if isinstance(a, list) and a[0] == "{" else a
    for sign in ("+", "?"):
        if sign in signs:
            out = [sign, [out]]
    return out


def _optional(x):
    return x if isinstance(x, list) and x[0] == "?" else ["?", [x]]


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a common subsequence of two lists: the longest of stretches up to TABLE; longer ones are cut where items
    that occur once in each side meet in order, and where there are none, nothing of the stretch is common."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        i, m, j, n = work.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        if (m - i) * (n - j) <= TABLE:
            lengths = [[0] * (n - j + 1)]
            for x in range(m - 1, i - 1, -1):
                row, below = [0] * (n - j + 1), lengths[-1]
                for y in range(n - 1, j - 1, -1):
                    row[y - j] = below[y - j + 1] + 1 if a[x] == b[y] else max(below[y - j], row[y - j + 1])
                lengths.append(row)
            lengths.reverse()
            x, y = i, j
            while x < m and y < n:
                if a[x] == b[y]:
                    out.append((x, y))
                    x, y = x + 1, y + 1
                elif lengths[x - i + 1][y - j] >= lengths[x - i][y - j + 1]:
                    x += 1
                else:
                    y += 1
            continue
        here, there = Counter(a[i:m]), Counter(b[j:n])
        place = {v: y for y, v in enumerate(b[j:n], j) if there[v] == 1 and here[v] == 1}
        ends: list[int] = []
        chains: list[tuple] = []
        for x in range(i, m):  # the longest chain of pairs that rise on both sides
            y = place.get(a[x])
            if y is not None:
                k = bisect_left(ends, y)
                link = (x, y, chains[k - 1] if k else None)
                ends[k:], chains[k:] = [y], [link]
        chain = chains[-1] if chains else None
        while chain:
            x, y, chain = chain
            out.append((x, y))
            work.append((x + 1, m, y + 1, n))
            m, n = x, y
        if ends:
            work.append((i, m, j, n))
    return sorted(out)


def align(a: list, b: list) -> list:
    """The union-free expression that covers both: shared items in order (a common subsequence), the rest optional."""
    out, i, j = [], 0, 0
    for x, y in [*_common([_bare(v) for v in a], [_bare(v) for v in b]), (len(a), len(b))]:
        out += [_optional(v) for v in a[i:x]] + [_optional(v) for v in b[j:y]]
        if x < len(a):
            out.append(_merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def pattern(expression: list) -> str:
    """The expression as a regular expression over the stream's tokens, each followed by a line end."""
    out = []
    for x in expression:
        if isinstance(x, str):
            out.append(f"(?:{re.escape(x)}\n)")
        elif x[0] == "{":
            out.append(f"(?:{re.escape(x[1])}\n{pattern(x[2])}}}\n)")
        else:
            out.append(f"(?:{pattern(x[1])}){x[0]}")
    return "".join(out)


def parse(expression: list, tokens: list[str]) -> list[int] | None:
    """The place of every block of a stream, or None where the expression doesn't cover it.

    Places are numbered in the order of the expression; all turns of a repeated group fill the same ones. Repeats are
    taken greedily; where that fails, all ways are followed side by side, the greediest that covers the stream counts.
    """
    filled: list[int] = []

    def run(items: list, at: int, slot: int) -> int:
        """Where the items end that begin at token `at`, -1 where they don't stand there."""
        for x in items:
            if isinstance(x, str):
                if at >= len(tokens) or tokens[at] != x:
                    return -1
                filled.append(slot)
                at, slot = at + 1, slot + 1
            elif x[0] == "{":
                if at >= len(tokens) or tokens[at] != x[1]:
                    return -1
                at = run(x[2], at + 1, slot)
                if at < 0 or at >= len(tokens) or tokens[at] != "}":
                    return -1
                at, slot = at + 1, slot + n_slots(x[2])
            else:
                turns = 0
                while x[0] == "+" or not turns:
                    mark = len(filled)
                    end = run(x[1], at, slot)
                    if end < 0:
                        del filled[mark:]
                        break
                    turns += 1
                    if end == at:  # an empty turn repeats for ever
                        break
                    at = end
                if x[0] == "+" and not turns:
                    return -1
                slot += n_slots(x[1])
        return at

    sizes: dict[int, int] = {}

    def n_slots(items: list) -> int:
        if id(items) not in sizes:
            sizes[id(items)] = sum(1 if isinstance(x, str) else n_slots(x[2] if x[0] == "{" else x[1]) for x in items)
        return sizes[id(items)]

    if run(expression, 0, 0) == len(tokens):
        return filled
    return _follow(_program(expression), tokens)


def _program(expression: list) -> list[tuple]:
    """The expression as steps: (token, place or -1), or (first choice, second choice) as numbers of steps."""
    steps: list[tuple] = []
    place = 0

    def add(items: list) -> None:
        nonlocal place
        for x in items:
            if isinstance(x, str):
                steps.append((x, place))
                place += 1
            elif x[0] == "{":
                steps.append((x[1], -1))
                add(x[2])
                steps.append(("}", -1))
            elif x[0] == "?":
                at = len(steps)
                steps.append(())
                add(x[1])
                steps[at] = (at + 1, len(steps))
            else:
                at = len(steps)
                add(x[1])
                steps.append((at, len(steps) + 1))

    add(expression)
    return steps


def _follow(steps: list[tuple], tokens: list[str]) -> list[int] | None:
    """Places by following all ways through the steps at once, each step at most once a token.

    What a token makes of a list of ways is worked out once and looked up after that: a page that goes round the same
    repeats costs a look-up a token. Of each token only the move is kept; the way back along the moves gives the places.
    """
    end = len(steps)

    def reach(starts: list[tuple[int, int]]) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """The token steps that are next, in order of preference, and the number of the way that each comes from."""
        out, seen, stack = [], set(), starts[::-1]
        while stack:
            at, origin = stack.pop()
            if at in seen:
                continue
            seen.add(at)
            if at < end and isinstance(steps[at][0], int):
                stack += [(steps[at][1], origin), (steps[at][0], origin)]
            else:
                out.append((at, origin))
        return tuple(at for at, _ in out), tuple(origin for _, origin in out)

    numbers: dict[tuple[int, ...], int] = {}
    states: list[tuple[int, ...]] = []
    moves: dict[tuple[int, str], tuple[int, tuple[int, ...]]] = {}

    def numbered(ways: tuple[int, ...]) -> int:
        if ways not in numbers:
            numbers[ways] = len(states)
            states.append(ways)
        return numbers[ways]

    now, path = numbered(reach([(0, 0)])[0]), []
    for token in tokens:
        move = moves.get((now, token))
        if move is None:
            ways, origins = reach([(at + 1, i) for i, at in enumerate(states[now]) if at < end and steps[at][0] == token])
            move = moves[now, token] = numbered(ways), origins
        path.append((now, move[1]))
        now = move[0]
        if not states[now]:
            return None
    if end not in states[now]:
        return None
    way, out = states[now].index(end), []
    for state, origins in reversed(path):
        way = origins[way]
        place = steps[states[state][way]][1]
        if place >= 0:
            out.append(place)
    return out[::-1]


# ---------------------------------------------------------------- verdicts

@lru_cache(8192)
def _away(element: str, inside_main: bool) -> bool:
    tag, *words = element.split(".")
    if tag in _DROPPED or (tag == "header" and not inside_main):
        return True
    telling = _AWAY_WORDS - _OWN_WORDS if inside_main else _AWAY_WORDS
    return _HIDDEN in words or (tag not in ("html", "body", "article", "main") and not telling.isdisjoint(words))


@lru_cache(8192)
def _main(element: str) -> bool:
    """Whether an element says that it is the article: by a part of a class (post-body), unless another part says otherwise (post-comments)."""
    tag, *words = element.split(".")
    parts = [p for p in (set(_WORD.findall(w)) for w in words) if _AWAY_WORDS.isdisjoint(p)]
    named = set().union(*parts)
    return tag in _MAIN or "main" in named or (tag in ("div", "section") and not _MAIN_WORDS.isdisjoint(named))


def judged(found: list[Block], strings: frozenset[int]) -> str:
    """Main text by containers: the blocks inside an article if there are any, else those in no other part and no string."""
    best = max((b.verdict for b in found), default=0)
    return _joined([(b.text, best == 1 and bool(strings) and mark(b.path, b.text) in strings) for b in found if best and b.verdict == best])


def _joined(told: list[tuple[str, bool]]) -> str:
    """The texts that aren't the template's; all of them where those are too much of the page."""
    whole, gone = sum(len(t) for t, _ in told), sum(len(t) for t, template in told if template)
    copied = gone == whole or gone > max(TEMPLATE_CHARS, whole / 2)
    return "\n".join(t for t, template in told if copied or not template)


# ---------------------------------------------------------------- on Spark

def _texts(batches):
    """Of each batch: pages by (host, path, text) of blocks that may be main text, by (host, path), and by host."""
    for batch in batches:
        facts: dict = {}
        for where, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            found = {(b.path, mark(b.path, b.text)): b.verdict for b in blocks(page) if b.verdict}
            for key in {(None, None, False), *((p, None, v == 2) for (p, _), v in found.items()), *((p, m, v == 2) for (p, m), v in found.items())}:
                facts[where, key] = facts.get((where, key), 0) + 1
        rows = [(w, None if p is None else mark(p, ""), m, inside, n) for (w, (p, m, inside)), n in facts.items()]
        cells = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=["host", "path", "mark", "inside", "pages"])


def strings(pages: DataFrame) -> DataFrame:
    """(host, strings): marks of the texts that stand at one path on three pages or more and on half of those that could
    have them, of the host's pages inside an article, elsewhere of the pages with that path. `pages` has host and html."""
    seen = staged(pages.select("host", "html").mapInArrow(_texts, "host string, path long, mark long, inside boolean, pages long"), "html-texts")
    counts = staged(seen.groupBy("host", "path", "mark", "inside").agg(F.sum("pages").alias("pages")), "html-counts")
    whole = counts.where("path is null").select("host", F.col("pages").alias("whole"))
    paths = counts.where("path is not null and mark is null").select("host", "path", "inside", F.col("pages").alias("there"))
    common = counts.where(f"mark is not null and pages >= {TEMPLATE_PAGES}").join(paths, ["host", "path", "inside"]).join(whole, "host")
    common = common.where(F.col("pages") >= F.when(F.col("inside"), F.col("whole")).otherwise(F.col("there")) * TEMPLATE_SHARE)
    return common.groupBy("host").agg(F.array_sort(F.collect_set("mark")).alias("strings"))


class Rule(NamedTuple):
    wrapper: list | None = None
    strings: frozenset = frozenset()
    same: frozenset = frozenset()


class Extractor:
    """Applies rules; keeps the last few it has read."""

    def __init__(self):
        self.known: dict[str | None, Rule] = {None: Rule()}

    def rule(self, told: str | None) -> Rule:
        if told not in self.known:
            if len(self.known) > 512:
                self.known = {None: Rule()}
            read = json.loads(told)
            self.known[told] = Rule(read.get("wrapper"), frozenset(read.get("strings") or ()), frozenset(read.get("same") or ()))
        return self.known[told]

    def filled(self, found: list[Block], rule: Rule) -> list[int] | None:
        """The place of every block, where the page obeys."""
        return None if rule.wrapper is None else parse(rule.wrapper, stream(found, rule.strings))

    def __call__(self, page: str | None, told: str | None = None) -> str:
        found, rule = blocks(page), self.rule(told)
        if max((b.verdict for b in found), default=0) == 1 and (filled := self.filled(found, rule)) is not None:
            return _joined([(b.text, place in rule.same) for b, place in zip(found, filled) if b.verdict])
        return judged(found, rule.strings)


def _with_rules(pages: DataFrame, rules: DataFrame, work, schema: str) -> DataFrame:
    """`work(batch, rule_of, known)` over batches of pages, where rule_of(host) is the JSON of the host's rule or None, and
    known what a task keeps between batches.

    Rules of up to BROADCAST_BYTES are one table in each worker. More of them meet their pages by host: a host's pages
    are dealt into pieces of about PIECE rows, each of which gets the rule once, ahead of its pages.
    """
    spark = pages.sparkSession
    held = rules.select(F.sum(F.length("rule") + 64)).first()[0] or 0
    if held <= BROADCAST_BYTES:
        table = spark.sparkContext.broadcast(dict(map(tuple, rules.select("host", "rule").collect())))  # of a checked size

        def looked_up(batches):
            known = Extractor()
            for batch in batches:
                yield work(batch, table.value.get, known)

        return pages.mapInArrow(looked_up, schema)
    sizes = pages.groupBy("host").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    row = [f.name for f in pages.schema if f.name != "host"]
    dealt = pages.join(F.broadcast(sizes.where("pieces > 1")), "host", "left").withColumn("piece", F.floor(F.rand(8) * F.coalesce("pieces", F.lit(1))).cast("int"))
    dealt = dealt.select("host", "piece", F.lit(None).cast("string").alias("rule"), *row)
    told = rules.join(sizes, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "rule", *(F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in row))
    met = dealt.unionByName(told).repartition("host", "piece").sortWithinPartitions("host", "piece", F.col("rule").isNull())

    def in_turn(batches):
        known, seen = Extractor(), {}
        for batch in batches:
            hosts, told = batch.column("host").to_pylist(), batch.column("rule")
            for i in np.flatnonzero(told.is_valid().to_numpy(zero_copy_only=False)):
                seen[hosts[i]] = told[int(i)].as_py()
            yield work(batch.filter(told.is_null()), seen.get, known)
            seen = {h: r for h, r in seen.items() if h == hosts[-1]} if hosts else seen

    return met.mapInArrow(in_turn, schema)


def _streams(batch: pa.RecordBatch, rule_of, known: Extractor) -> pa.RecordBatch:
    """Distinct (host, folded stream) of a batch."""
    seen = {(where, json.dumps(fold(_tree(stream(blocks(page), known.rule(rule_of(where)).strings))))) for where, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())}
    hosts, folded = zip(*seen) if seen else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(folded, pa.string())], names=["host", "stream"])


def _aligned(frame: pd.DataFrame) -> pd.DataFrame:
    wrapper = None
    for text in sorted(frame["stream"], key=lambda s: (-len(s), s)):
        one = json.loads(text)
        wrapper = one if wrapper is None else fold(align(wrapper, one))
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "stream": [json.dumps(wrapper)]})


def wrappers(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, wrapper) of pages (host, html) under rules (host, rule): rounds of alignments of about FAN expressions until each
    host has one. Null html is an empty stream; an empty table has no wrappers."""
    level = staged(_with_rules(pages.select("host", "html"), rules, _streams, "host string, stream string").distinct(), "html-streams")
    while True:
        sizes = staged(level.groupBy("host").agg(F.count("*").alias("n")), "html-sizes")
        if sizes.where("n > 1").isEmpty():
            return level.withColumnRenamed("stream", "wrapper")
        parts = F.ceil(F.col("n") / FAN).cast("int")
        dealt = level.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("stream"), parts)).select("host", "part", "stream")
        level = staged(dealt.groupBy("host", "part").applyInPandas(lambda f: _aligned(f), "host string, stream string"), "html-aligned")


def _filled(batch: pa.RecordBatch, rule_of, known: Extractor) -> pa.RecordBatch:
    """For each place of a host's wrapper outside articles the pages that fill it and the least and largest mark of its text."""
    facts: dict = {}
    for where, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
        found = blocks(page)
        if max((b.verdict for b in found), default=0) != 1:  # the template has no say in articles
            continue
        texts: dict = {}
        for b, place in zip(found, known.filled(found, known.rule(rule_of(where))) or ()):
            if b.verdict:
                texts.setdefault(place, []).append(b.text)
        for place, parts in texts.items():
            m = mark((), "\n".join(parts))
            low, high, n = facts.get((where, place), (m, m, 0))
            facts[where, place] = (min(low, m), max(high, m), n + 1)
    cells = list(zip(*((*k, *v) for k, v in facts.items()))) if facts else [[]] * 5
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=["host", "place", "low", "high", "pages"])


def template_places(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, same): the places of each host's wrapper whose text is the same on all pages without an article that fill it,
    TEMPLATE_PAGES or more. Pages that don't obey, null html and empty tables add nothing."""
    seen = staged(_with_rules(pages.select("host", "html"), rules, _filled, "host string, place long, low long, high long, pages long"), "html-places")
    places = seen.groupBy("host", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("pages").alias("pages"))
    return places.where(f"low = high and pages >= {TEMPLATE_PAGES}").groupBy("host").agg(F.array_sort(F.collect_list("place")).alias("same"))


def _extract(batch: pa.RecordBatch, rule_of, known: Extractor) -> pa.RecordBatch:
    texts = [known(page, rule_of(where)) for where, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())]
    cells = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
    return pa.RecordBatch.from_arrays(cells, names=["page_id", "url", "text", "n_chars"])


def _rules(table: DataFrame) -> DataFrame:
    """(host, rule): what is known of each host as JSON; the wrapper, which is JSON, is put in as it is."""
    lists = [f"'\"{c}\":', to_json({c})" for c in table.columns if c in ("strings", "same")]
    parts = [f"if({c} is null, null, concat({x}))" for c, x in zip([c for c in table.columns if c in ("strings", "same")], lists)]
    if "wrapper" in table.columns:
        parts.append("if(wrapper is null, null, concat('\"wrapper\":', wrapper))")
    return table.selectExpr("host", f"concat('{{', concat_ws(',', {', '.join(parts)}), '}}') rule")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row: the article's blocks in page order, joined by one line end.

    Null html is empty and gives empty text; a null or unreadable url is the host "". Pages are read whole, in time that
    is linear in their length, however deep their containers and whether or not their tags end. Rows that repeat are each
    extracted. Text inside an article is never left out because other pages have it too. An empty table gives an empty
    table. Extra columns play no part.
    """
    lean(pages.sparkSession)
    named = pages.select(F.col("page_id").cast("long"), "url", "html", host(F.col("url")).alias("host"))
    texts = staged(strings(named), "html-strings")
    met = staged(wrappers(named, _rules(texts)).join(texts, "host", "left"), "html-wrappers")
    rules = staged(_rules(met.join(template_places(named, _rules(met)), "host", "left")), "html-rules")
    return _with_rules(named, rules, _extract, "page_id long, url string, text string, n_chars long")
