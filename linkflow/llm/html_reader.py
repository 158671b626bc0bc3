"""Text, title, language and links of an HTML page, in one pass from its first character to its last.

Every search goes forward from where the last one ended, and one that finds no end ends the
page, so the time is linear in its length whatever is left open. Rules, after the tokenizer
of the HTML standard:

* a comment ends at ``-->`` or ``--!>``; ``<!...>`` and ``<?...>`` end at ``>``;
* a tag is ``<`` or ``</`` and a letter; a ``>`` inside a quoted attribute value does not end it;
  any other ``<`` is text;
* what stands in script and style is not read as tags; it ends at their own end tag;
* comments and the content of script, style, noscript and template are left out, a space in
  their place; left open, they go on to the end of the page, and so does an open tag;
* tags of blocks break the line, other tags leave nothing;
* character references are resolved in text and attribute values.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# Elements that break the line, and elements whose content is left out.
BLOCKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav header footer title head body html pre blockquote".split())
RAW = frozenset(("script", "style"))
HIDDEN = frozenset(("noscript", "template"))

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>=][^\s/>=]*)(\s*=\s*)?)?")
_BARE = re.compile(r"[^\s>]*")
_END_OF_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_END_OF_COMMENT = re.compile(r"--!?>")
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")


class Page(NamedTuple):
    text: str
    title: str | None
    language: str | None
    links: list[str]


def _tag(page: str, at: int) -> tuple[dict[str, str], int]:
    """(attributes, position behind the tag) from behind a tag's name; -1 if the tag is never closed."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        at = m.end()
        name, equals = m[1], m[2]
        if name is None:
            if at >= len(page):
                return found, -1
            if page[at] == ">":
                return found, at + 1
            at += 1                                   # a stray "="
            continue
        value = ""
        if equals is not None:
            quote = page[at:at + 1]
            if quote in ("'", '"') and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return found, -1
                value, at = page[at + 1:end], end + 1
            else:
                m = _BARE.match(page, at)
                value, at = m[0], m.end()
        found.setdefault(name.lower(), value)


def read_page(page: str) -> Page:
    out: list[str] = []
    title, language, links = None, None, []
    title_from = None                                 # pieces before the open title's text
    hidden: list[str] = []                            # open elements whose content is left out
    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at and not hidden:
            out.append(html.unescape(page[at:start]))
        if start == n:
            break
        after = page[start + 1:start + 2]
        if page.startswith("<!--", start):
            if page.startswith(("<!-->", "<!--->"), start):
                at = page.index(">", start) + 1
            else:
                m = _END_OF_COMMENT.search(page, start + 4)
                at = m.end() if m else n
            if not hidden:
                out.append(" ")
            continue
        if after in ("!", "?") and after or (after == "/" and not page[start + 2:start + 3].isascii()) or (
                after == "/" and not page[start + 2:start + 3].isalpha()):
            end = page.find(">", start)
            at = end + 1 if end >= 0 else n
            continue
        closing = after == "/"
        m = _NAME.match(page, start + 1 + closing)
        if m is None:
            if not hidden:
                out.append("<")
            at = start + 1
            continue
        name = m[0].lower()
        attributes, at = _tag(page, m.end())
        if at < 0:
            break
        if hidden:
            if closing and name == hidden[-1]:
                hidden.pop()
            elif not closing and name in HIDDEN:
                hidden.append(name)
            elif not closing and name in RAW:
                m = _END_OF_RAW[name].search(page, at)
                at = m.start() if m else n
            continue
        if closing and name == "title" and title_from is not None:
            title, title_from = "".join(out[title_from:]), None
        if name in BLOCKS:
            out.append("\n")
        if closing:
            continue
        if name in RAW:
            m = _END_OF_RAW[name].search(page, at)
            at = m.start() if m else n
            out.append(" ")
        elif name in HIDDEN:
            hidden.append(name)
            out.append(" ")
        elif name == "title" and title is None and title_from is None:
            title_from = len(out)
        elif name == "html" and language is None:
            language = html.unescape(attributes.get("lang", "")) or None
        elif name == "a" and attributes.get("href"):
            links.append(html.unescape(attributes["href"]).strip())
    text = _LINES.sub("\n", _BLANK.sub(" ", "".join(out))).strip()
    return Page(text, None if title is None else " ".join(title.split()), language, links)
