"""The page reader against the standard library's parser, on open marks and on long pages."""
import html
import random
import re
import time
from html.parser import HTMLParser

import pytest

from linkflow.llm.html_reader import BLOCKS, HIDDEN, RAW, read_page


class Plain(HTMLParser):
    """The same rules over the standard library's events, for well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.hidden, self.links, self.title, self.in_title = [], [], [], None, False

    def put(self, text):
        if not self.hidden:
            self.out.append(text)
            if self.in_title:
                self.title += text

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.put("\n")
        if tag in RAW | HIDDEN:
            self.put(" ")
            self.hidden.append(tag)
        elif not self.hidden and tag == "a" and dict(attrs).get("href"):
            self.links.append(dict(attrs)["href"].strip())
        elif not self.hidden and tag == "title" and self.title is None:
            self.title, self.in_title = "", True

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
            return
        if tag == "title":
            self.in_title = False
        if tag in BLOCKS:
            self.put("\n")

    def handle_data(self, data):
        self.put(data)

    def handle_entityref(self, name):
        self.put(html.unescape(f"&{name};"))

    def handle_charref(self, name):
        self.put(html.unescape(f"&#{name};"))

    def handle_comment(self, data):
        self.put(" ")


def some_page(rnd, depth=0):
    parts = []
    for _ in range(rnd.randint(1, 6)):
        kind = rnd.randrange(9)
        if kind < 3 or depth > 4:
            parts.append(rnd.choice(["word", "two words", " é &amp; b ", "&#65;&lt;x", "tail\n"]))
        elif kind == 3:
            parts.append(f"<!-- {rnd.choice(['c', '<p>no</p>', '<a href=no>x</a>', 'a - b'])} -->")
        elif kind == 4:
            parts.append(f"<script type='x'>{rnd.choice(['var a = 1 < 2;', 'if (a) b();', '<p>no'])}</script >")
        elif kind == 5:
            parts.append(f"<a class=\"x>y\" href={rnd.choice(['/one', chr(34) + 'http://e.org/?a=1&amp;b=2' + chr(34), chr(39) + 'two' + chr(39)])}>link</a>")
        elif kind == 6:
            parts.append(f"<template>{some_page(rnd, depth + 1)}</template>")
        else:
            tag = rnd.choice(["p", "div", "b", "span", "LI", "h2", "em"])
            parts.append(f"<{tag} id=a data-x='>'>{some_page(rnd, depth + 1)}</{tag}>")
    return "".join(parts)


def test_against_the_standard_parser():
    rnd = random.Random(7)
    for k in range(400):
        page = f"<!DOCTYPE html><html lang=\"en\"><title>T{k} &amp; t</title><body>{some_page(rnd)}</body></html>"
        plain = Plain()
        plain.feed(page)
        plain.close()
        text = re.sub(r"\s*\n\s*", "\n", re.sub(r"[^\S\n]+", " ", "".join(plain.out))).strip()
        got = read_page(page)
        assert got == (text, " ".join(plain.title.split()), "en", plain.links), page


@pytest.mark.parametrize("page,text", [
    ("a <!-- <title>no</title><a href=x>", "a"), ("a<script>code <p>never", "a"), ("a<p class='open>b</p>", "a"), ("a <b", "a"),
    ("1 < 2 <3 </ 4> 5", "1 < 2 <3 5"), ("x<!-->y<!--->z", "x y z"), ("a<!doctype x>b<?php no ?>c", "abc"), ("<noscript>no", ""),
    ("</p>x<br/>y", "x\ny"), ("a<script>x</scripty></SCRIPT >b", "a b"), ("", ""), ("<", "<"), ("<=>", "<=>"), ("<a = href=q>t</a>", "t"),
    ("<template><template>a</template>b</template>c", "c"), ("&amp;lt;", "&lt;"), ("<!-- a --!>b", "b")])
def test_open_and_odd_marks(page, text):
    assert read_page(page).text == text


def test_what_is_hidden_is_no_title_or_link():
    got = read_page("<!-- <title>a</title> --><script><a href=x></script><title>real</title><a href='y>z'>k</a><title>second</title>")
    assert got.title == "real" and got.links == ["y>z"]


@pytest.mark.parametrize("mark", ["<!--", "<p", "<p ", "<script>", "<a href='", "<", "</", "<!", "<template>", "&", " ", "\n ", "<b>", "=\"", "<p =", "<title>", "--", "-"])
def test_long_pages_take_linear_time(mark):
    def seconds(size):
        page = mark * (size // len(mark))
        began = time.perf_counter()
        read_page(page)
        return time.perf_counter() - began
    assert seconds(10_000_000) < 30 and seconds(1_000_000) < 4
