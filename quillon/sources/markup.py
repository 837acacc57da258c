"""A forgiving reader of HTML: events of tags and decoded text, in one pass.

Browsers' rules that matter for extraction are kept: comments, declarations and
CDATA are skipped; scripts and styles end at their own end tag only; quoted
attributes may hold ``>``; a lone ``<`` is text; character references are decoded,
also without a semicolon where HTML knows them so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

# Fixed values of HTML: elements without an end tag, and elements whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
TEXT_ONLY = frozenset("title textarea".split())
#: Elements inside a line of text; all others begin and end blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that a new one of the same kind closes, up to the elements after the colon.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[/!?A-Za-z][^>]*>|([^<]+|<)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")

# What html.unescape takes for a reference.
_REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")

Event = tuple[str, str, str]


@lru_cache(maxsize=4096)
def _reference(name: str) -> str:
    return unescape("&" + name)


def decoded(text: str) -> str:
    """``html.unescape``, each different reference looked up once."""
    if "&" not in text:
        return text
    parts = _REFERENCE.split(text)  # text and reference in turn
    parts[1::2] = map(_reference, parts[1::2])
    return "".join(parts)


def events(html: str) -> Iterator[Event]:
    """("start", tag, raw attributes), ("end", tag, "") and ("text", "", decoded text) in page order."""
    at, size, match, last = 0, len(html), _TOKEN.match, html.rfind(">")
    while at < size:
        if at > last and not html.startswith(("<!--", "<![CDATA["), at):  # nothing closes any more
            m = re.compile("<?[^<]*").match(html, at)
            yield "text", "", decoded(m[0])
            at = m.end()
            continue
        m = match(html, at)
        at = m.end()
        text = m[4]
        if text is not None:
            yield "text", "", decoded(text)
            continue
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            yield "end", tag, ""
            continue
        yield "start", tag, m[3]
        if tag in RAW or tag in TEXT_ONLY:
            close = _closing(tag).search(html, at)
            body = html[at : close.start() if close else size]
            if body:
                yield "text", "", decoded(body) if tag in TEXT_ONLY else body
            at = close.end() if close else size
            yield "end", tag, ""


@lru_cache(maxsize=32)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)


@lru_cache(maxsize=4096)
def attributes(raw: str) -> dict[str, str]:
    """Attributes of a start tag, names in lower case, values decoded; the first of a name counts."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), decoded(double or single or bare))
    return found


def implied_end(stack: list[str], tag: str) -> int:
    """Length to which the stack of open tags falls when ``tag`` begins."""
    if tag not in INLINE:
        for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
            if stack[k] == "p":
                return k
            if stack[k] not in INLINE:
                break
    if tag in _ENDS:
        ends, stops = _ENDS[tag]
        low = len(stack)
        for k in range(len(stack) - 1, -1, -1):
            if stack[k] in stops:
                break
            if stack[k] in ends:
                low = k
        return low
    return len(stack)


def explicit_end(stack: list[str], tag: str) -> int:
    """Length to which the stack falls at an end tag; an end tag of nothing open changes nothing."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k] == tag:
            return k
    return len(stack)
