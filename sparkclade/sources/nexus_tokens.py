"""NEXUS words: quotes, comments and punctuation."""

from __future__ import annotations

import re
from collections.abc import Iterator

PUNCTUATION = "()[]{}/\\,;:=*'\"`+-<>"
PLAIN_NAME = re.compile(r"[^\s()\[\]{}/\\,;:=*'\"`+<>-]+")


def quote(name: str) -> str:
    """In single quotes where NEXUS asks for them."""
    return name if PLAIN_NAME.fullmatch(name) else "'" + name.replace("'", "''") + "'"


def unquote(word: str) -> str:
    return word[1:-1].replace("''", "'") if len(word) > 1 and word[0] == word[-1] == "'" else word


def check_name(name: str) -> bool:
    """Whether a NEXUS name is acceptable: not empty, not all digits."""
    return bool(name) and not name.isdigit()


def tokens(text: str, newlines: bool = False) -> Iterator[str]:
    """Words, quoted words and punctuation.  Comments, nested ones too, are skipped, but for command comments ``[&...]``."""
    at, n = 0, len(text)
    while at < n:
        c = text[at]
        if c == "[":
            depth, end = 1, at + 1
            while end < n and depth:
                depth += (text[end] == "[") - (text[end] == "]")
                end += 1
            if depth:
                raise ValueError("a comment does not end")
            if text[at + 1 : at + 2] == "&":
                yield text[at:end]
            at = end
        elif c == "'":
            end = at + 1
            while True:
                end = text.find("'", end)
                if end < 0:
                    raise ValueError("a quoted word does not end")
                if text[end + 1 : end + 2] != "'":
                    break
                end += 2
            yield text[at : end + 1]
            at = end + 1
        elif c == "\n" and newlines:
            yield "\n"
            at += 1
        elif c.isspace():
            at += 1
        elif c in "(),;:={}/\\*\"<>+-":
            yield c
            at += 1
        else:
            end = at
            while end < n and not text[end].isspace() and text[end] not in "()[],;:={}/\\*'\"<>+-":
                end += 1
            yield text[at : max(end, at + 1)]
            at = max(end, at + 1)


def commands(text: str) -> Iterator[list[str]]:
    """Commands of a block, each a list of its words."""
    out: list[str] = []
    for t in tokens(text):
        if t == ";":
            yield out
            out = []
        else:
            out.append(t)
