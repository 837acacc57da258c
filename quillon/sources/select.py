"""CSS selectors over the events of a page, in one pass without a tree.

A selector is a row of compounds (tag, .class, #id, [attribute], :nth-child) joined
by descendant and child signs.  An open element carries which compounds may come
next below it; a start tag advances those that it fits, and one that fits the last
compound is a match.  All selectors run side by side.  A match knows its place
among the page's events, so ``inside`` answers queries within an element.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

from .markup import INLINE, RAW, VOID, attributes, events, explicit_end, implied_end

_PART = re.compile(r"""(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<name>[\w-]+)(?:(?P<op>[~|^$*]?=)["']?(?P<value>[^"'\]]*)["']?)?\]|:nth-child\((?P<nth>\d+)\)|:(?P<pseudo>first-child)""")
#: Open elements; deeper ones lie beside each other.
DEPTH = 512
_TESTS: dict[str, Callable[[str, str], bool]] = {
    "=": lambda a, v: a == v,
    "~=": lambda a, v: v in a.split(),
    "|=": lambda a, v: a == v or a.startswith(v + "-"),
    "^=": lambda a, v: bool(v) and a.startswith(v),
    "$=": lambda a, v: bool(v) and a.endswith(v),
    "*=": lambda a, v: bool(v) and v in a,
}


@dataclass(frozen=True)
class Compound:
    """What an element must be, and whether the next compound must be its child."""

    tag: str | None
    tests: tuple[tuple[str, str, str], ...]
    nth: int | None
    then_child: bool


@lru_cache(maxsize=256)
def compiled(selector: str) -> tuple[Compound, ...]:
    """Compounds of one selector; raises ValueError for what isn't known."""
    out, at = [], 0
    text = selector.strip()
    while at < len(text):
        tag, tests, nth, start = None, [], None, at
        while m := _PART.match(text, at):
            if m["tag"]:
                tag = None if m["tag"] == "*" else m["tag"].lower()
            elif m["cls"]:
                tests.append(("class", "~=", m["cls"]))
            elif m["id"]:
                tests.append(("id", "=", m["id"]))
            elif m["name"]:
                tests.append((m["name"].lower(), m["op"] or "", m["value"] or ""))
            else:
                nth = int(m["nth"] or 1)
            at = m.end()
        sign = re.compile(r"\s*>\s*|\s+|$").match(text, at)
        if at == start or sign is None:
            raise ValueError(f"selector {selector!r} isn't understood at {at}")
        out.append(Compound(tag, tuple(tests), nth, ">" in sign[0]))
        at = sign.end()
    if not out or out[-1].then_child:
        raise ValueError(f"selector {selector!r} has no end")
    return tuple(out)


def _fits(c: Compound, own: dict[str, str], nth: int) -> bool:
    """Whether an element of the right tag fits."""
    if c.nth is not None and c.nth != nth:
        return False
    for n, op, v in c.tests:
        if n not in own or op and not _TESTS[op](own[n], v):
            return False
    return True


@dataclass(eq=False, slots=True)
class Match:
    """An element: its tag, attributes and text, and where it opens and closes."""

    tag: str
    attributes: dict[str, str]
    opens: int
    closes: int = 1 << 62
    pieces: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "".join(self.pieces)


class Rules:
    """Selectors side by side; which of their compounds a start tag may fit is found once for a state and a tag."""

    def __init__(self, selectors: tuple[tuple[str, str], ...]) -> None:
        self.rules = [(name, compiled(one)) for name, many in selectors for one in many.split(",")]
        self.start = frozenset((r, 0) for r in range(len(self.rules)))
        self.known: dict[tuple[frozenset, str, bool], tuple] = {}

    def candidates(self, state: frozenset, tag: str, plain: bool) -> tuple:
        """(name, rule, place, compound, is last) of what an element may be; a ``plain`` one has no attributes."""
        key = state, tag, plain
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= 4096:  # pages with ever new tags
                self.known.clear()
            every = ((r, at, self.rules[r][0], self.rules[r][1]) for r, at in state)
            found = tuple((name, r, at, cs[at], at + 1 == len(cs)) for r, at, name, cs in every if cs[at].tag in (None, tag) and not (plain and cs[at].tests))
            self.known[key] = found
        return found


@lru_cache(maxsize=64)
def _rules(selectors: tuple[tuple[str, str], ...]) -> Rules:
    return Rules(selectors)


def find(html: str, selectors: dict[str, str], raw_text: bool = False) -> dict[str, list[Match]]:
    """Matches of each selector in page order; scripts' and styles' text counts with ``raw_text`` or for themselves."""
    rules = _rules(tuple(selectors.items()))
    candidates, nothing = rules.candidates, frozenset()
    found: dict[str, list[Match]] = {name: [] for name in selectors}
    tags: list[str] = []
    # for each open element: states for all below, states for children only, number of children, its matches
    frames: list[list] = [[rules.start, nothing, 0, ()]]
    collecting: list[Match] = []  # of open elements, the innermost last
    clock = 0
    for kind, tag, raw in events(html):
        clock += 1
        if kind == "text":
            if collecting:
                hidden = bool(tags) and tags[-1] in RAW and not raw_text
                for m in collecting:
                    if not hidden or m.tag in RAW:
                        m.pieces.append(raw)
            continue
        length = len(tags)
        if kind == "end":
            length = length - 1 if length and tags[-1] == tag else explicit_end(tags, tag)
        elif tag not in INLINE:
            length = implied_end(tags, tag)
        while len(tags) > length:
            tags.pop()
            closed = frames.pop()[3]
            if closed:
                del collecting[-len(closed) :]
                for m in closed:
                    m.closes = clock
        if kind == "end":
            continue
        frame = frames[-1]
        below, children = frame[0], frame[1]
        frame[2] += 1
        mine: dict[str, Match] = {}
        new_below = new_children = nothing
        may = candidates(below | children if children else below, tag, not raw)
        if may:
            own = attributes(raw) if raw else {}
            for name, r, at, compound, last in may:
                if _fits(compound, own, frame[2]):
                    if last:
                        if name not in mine:
                            mine[name] = Match(tag, own, clock)
                    elif compound.then_child:
                        new_children |= {(r, at + 1)}
                    else:
                        new_below |= {(r, at + 1)}
            for name, m in mine.items():
                found[name].append(m)
        if tag in VOID or len(tags) >= DEPTH:
            for m in mine.values():
                m.closes = clock
            continue
        tags.append(tag)
        matches = tuple(mine.values())
        frames.append([below | new_below if new_below else below, new_children, 0, matches])
        collecting += matches
    clock += 1
    for m in collecting:
        m.closes = clock
    return found


def inside(outer: Match, matches: list[Match]) -> list[Match]:
    """The matches that lie within an element."""
    return [m for m in matches if outer.opens < m.opens and m.closes <= outer.closes]
