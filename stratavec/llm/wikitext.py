"""What a reader sees of wiki markup."""

from __future__ import annotations

import html
import re

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_REF_EMPTY = re.compile(r"<ref\b[^<>]*/>", re.I)
_REF = re.compile(r"<ref\b[^<>]*>(?:(?!<ref\b).)*?</ref\s*>", re.S | re.I)
_BLOCK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|dl|dd|dt|td|th|tr|table|caption|blockquote|h[1-6]|hr|gallery|center|poem|pre)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_EMPHASIS = re.compile(r"'{2,5}")
_BRACKETS = re.compile(r"\[\[|\]\]")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_HIDDEN_LINK = re.compile(r"\[\[\s*(?:Category|Kategorie|Catégorie|Categoría)\s*:[^\[\]]*\]\]", re.I)
_URL_LINK = re.compile(r"\[(?:https?:)?//[^\s\[\]]+(?:[ \t]+([^\[\]\n]*))?\]")
#: Soft hyphen, zero-width and directional marks, byte-order mark, variation selectors.
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")


def _inner_links(text: str) -> str:
    """Links in the labels of links, of any depth, to the last of their labels, in one pass; what isn't closed stays."""
    open_: list[list[str]] = [[]]
    at = 0
    for m in _BRACKETS.finditer(text):
        open_[-1].append(text[at : m.start()])
        at = m.end()
        if m.group() == "[[":
            open_.append([])
        elif len(open_) == 1:
            open_[-1].append("]]")
        else:
            inner = "".join(open_.pop())
            open_[-1].append(f"[[{inner}]]" if "[" in inner or "]" in inner else inner.rpartition("|")[2])
    open_[-1].append(text[at:])
    return "[[".join(map("".join, open_))


def visible(text: str | None) -> str:
    """The text as the rendered page shows it.

    Comments, footnotes, tags, entities, emphasis marks, targets of labelled links, category links and
    invisible characters go; cells, quotes and template arguments stay.  An unclosed footnote or comment
    loses its opening mark only.  Null gives the empty text.
    """
    if not text:
        return ""
    if "<" in text:
        text = _COMMENT.sub("", text)
        text = _REF_EMPTY.sub("", text)
        text = _REF.sub("", text)
        text = _BLOCK_TAG.sub(" ", text)
        text = _TAG.sub("", text).replace("<!--", " ").replace("-->", " ")
    if "[" in text:
        text = _HIDDEN_LINK.sub(" ", text)
        text = _LINK.sub(r"\1", text)
        if "[[" in text:  # captions hold links
            text = _inner_links(text)
        text = _URL_LINK.sub(lambda m: m.group(1) or "", text)
    if "''" in text:
        text = _EMPHASIS.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    return _INVISIBLE.sub("", text)
