"""Operator 7, quality rules: line-first cleaning.

Every line is judged alone by rules on punctuation, navigation and boilerplate; failing lines are
removed, and a document that loses too much of its text this way is rejected. Counts of the whole
text (the base rules) are taken beside it.

Defined results: a null text is an empty one; it has no words, so it is rejected. A line without a
word passes (there is nothing to judge) and is never a duplicate. Rows are judged one by one, so
repeated rows give repeated results; a null doc_id is passed on. Columns other than ``doc_id`` and
``text`` are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from .common import SPACES, as_bytes, per_text

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected if failing lines hold more than this percentage of its characters.
MAX_LOST_PERCENT = 50

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
#: A long line of prose holds one of these marks at least, whatever its script.
MARKS = tuple(x.encode() for x in ".!?:;,…。！？，；：、।॥۔؟،؛։።፡။།។·")
#: Lines are page furniture if such a phrase makes up a third of their words.
BOILERPLATE = [
    b"all rights reserved",
    b"terms of use",
    b"terms of service",
    b"privacy policy",
    b"cookie policy",
    b"accept cookies",
    b"enable javascript",
    b"lorem ipsum",
    b"click here",
    b"sign in to",
    b"subscribe to our",
    b"share this",
    b"read more",
    b"skip to content",
    b"back to top",
    b"log in",
    b"sign up",
    b"add to cart",
    b"follow us",
    b"page not found",
]
#: Phrases by their number of words; a phrase stands alone, not in other words.
PHRASES = {
    size: re.compile(rb"(?:^|[^a-z0-9])(?:" + b"|".join(x for x in BOILERPLATE if x.count(b" ") == size - 1) + rb")(?:[^a-z0-9]|$)")
    for size in sorted({x.count(b" ") + 1 for x in BOILERPLATE})
}
LONGEST_BOILERPLATE = 3 * max(PHRASES)
#: A line without an end mark is a menu if two thirds of its words, three at least, are such.
MENU = [
    b"home",
    b"about",
    b"contact",
    b"login",
    b"logout",
    b"register",
    b"help",
    b"search",
    b"menu",
    b"sitemap",
    b"faq",
    b"news",
    b"products",
    b"services",
    b"blog",
    b"shop",
    b"cart",
    b"support",
    b"careers",
    b"next",
    b"previous",
]
IN_MENU = frozenset(MENU)

COLUMNS = [
    ("n_words", "long"),
    ("word_chars", "long"),
    ("n_symbols", "long"),
    ("n_dup_lines", "long"),
    ("n_repeat_words", "long"),
    ("base_failed", "boolean"),
    ("n_lines", "long"),
    ("n_failed_lines", "long"),
    ("lost_chars", "long"),
    ("kept", "boolean"),
    ("cleaned", "string"),
]


def points(text: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))


def count(text: bytes, kind: bytes) -> int:
    return len(text) - len(text.translate(None, kind))


def line_fails(line: bytes) -> str:
    """The rule that a line breaks, or an empty string."""
    words = line.split()
    n = len(words)
    if not n:
        return ""
    symbols = count(line, SYMBOLS)
    if n >= 3 and 4 * line.count(b"|") >= n:
        return "navigation"
    if n >= 3 and 3 * sum(w.lower() in IN_MENU for w in words) >= 2 * n and words[-1][-1:] not in b".!?":
        return "navigation"
    if symbols >= 3 and 8 * symbols > len(line):
        return "punctuation"
    if n >= 3 and 2 * line.count(b"!") > n:
        return "punctuation"
    if n >= 3 and (upper := count(line, UPPER)) >= 12 and upper > 2 * count(line, LOWER):
        return "punctuation"
    if n >= 10 and 3 * len(set(words)) < n:
        return "repetition"
    if n <= LONGEST_BOILERPLATE and any(3 * size >= n and x.search(line.lower()) for size, x in PHRASES.items()):
        return "boilerplate"
    if n >= 30 and not any(x in line for x in MARKS):
        return "punctuation"
    return ""


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window which the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    v = len(seen)
    if v == n:
        return 0
    pairs = ids[:-1] * v + ids[1:]
    if v >= 2_000_000:  # three ids no longer fit one integer
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * v + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : k + len(windows)] |= twice
    return int(inside.sum())


def judge(text: bytes) -> tuple:
    """The values of COLUMNS for one whole text."""
    words = text.split()
    n = len(words)
    repeat = repeated_words(words)
    lines = text.split(b"\n")
    spoken = [x for x in lines if x and not x.isspace()]  # bytes.isspace() knows the same six characters
    good, lost, total, failed = [], 0, 0, 0
    for line in lines:
        size = points(line)
        total += size
        if line_fails(line):
            lost += size
            failed += 1
        else:
            good.append(line)
    base_failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    kept = not base_failed and 100 * lost <= MAX_LOST_PERCENT * total
    return (
        n,
        points(text) - count(text, SPACES),
        count(text, SYMBOLS),
        len(spoken) - len(set(spoken)),
        repeat,
        base_failed,
        len(lines),
        failed,
        lost,
        kept,
        (text if not failed else b"\n".join(good)).decode("utf-8", "replace"),
    )


def quality_rules(docs: DataFrame, carry: Iterable[str] = ("doc_id",), with_text: bool = True) -> DataFrame:
    """The ``carry`` columns of each document, counts, the verdict ``kept``, and the text without failing lines."""
    columns = COLUMNS if with_text else COLUMNS[:-1]
    return per_text(docs, columns, lambda texts: (judge(x)[: len(columns)] for x in as_bytes(texts)), carry)
