"""Operator 9, secret scans: fixed patterns, and guess-cost dynamic programming on credential values.

Base patterns find assignments, access keys and long hexadecimal runs. The method reads every value
that stands in a credential context and finds the cheapest way to guess it: a minimum-cost
segmentation into words, dates, repeats, keyboard walks and brute-force spans. A value that would
take at least ``10 ** MIN_LOG10_GUESSES`` guesses is a secret (kind ``guess``) unless base spans
cover the whole of it. A quoted value runs to its quote on the same line, whatever signs it holds; with blanks in it,
what stands before the first one is judged, and all goes or stays with that. An address is no value, but the password
before its host is one, and so are values of cues within it.

Defined results: a null text is an empty one and has no spans; spans are in code points, end
exclusive; equal spans of several kinds all stay; repeated rows give repeated results; a null doc_id
is passed on. Whole texts are read, values of any length included: the programme's time is linear in
the value's length. Words are fixed ones and then those of a public vocabulary by rank (its path is a
parameter of ``ranks``), so that costs don't depend on the corpus.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import as_text, dropped_by, per_text

MIN_LOG10_GUESSES = 10.0

# The base patterns and the least length of what they must find.
ASSIGN = re.compile(
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18
KINDS = ("assign", "access", "hex", "guess")

#: A text without any of these (in lower case) has neither an assignment nor a credential context.
CUES = ("pass", "secret", "token", "key", "pwd", "credential", "auth", "bearer", "login", "://")
#: A cue, whatever letters or digits stand before it, and what leads to its value of at least six characters.
CONTEXT = re.compile(
    r"(?i:(?:password|passwd|passphrase|passcode|pwd|pass|secret|token|"
    r"api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|credentials?|auth|authorization|login)"
    r"[\"']?\x20*(?:=>|:=|[:=]|\x20is\x20)\x20*(?:bearer\x20|basic\x20)?|\bbearer\x20)(?:([\"'])(?=[^\s\"']{6})|(?=[^\s\"'<>,;]{6}))",
    re.ASCII,
)
VALUE = re.compile(r"[^\s\"'<>,;]+", re.ASCII)
#: What a quoted value holds up to its quote, a quote after a backslash included.
QUOTED = {q: re.compile(rf"(?:[^\\\n{q}]|\\[^\n])*(?={q})") for q in "\"'"}
BLANK = re.compile(r"\s", re.ASCII)
ADDRESS = re.compile(r"(?i:[a-z][a-z0-9+.-]*://|www\.)", re.ASCII)
#: The password of an address: between the user's colon and the last @ before the path.
LINK = re.compile(r"://[^\s:/@\"'<>]*:([^\s/\"']{6,})@", re.ASCII)

# Common words of passwords, most common first.
WORDS = [
    "password", "123456", "qwerty", "admin", "welcome", "login", "letmein", "monkey", "dragon", "master", "abc", "iloveyou",
    "football", "baseball", "sunshine", "princess", "shadow", "superman", "trustno", "hello", "freedom", "whatever", "ninja",
    "access", "flower", "secret", "summer", "winter", "spring", "autumn", "love", "pass", "test", "user", "guest", "root",
    "default", "changeme", "example", "sample", "token", "key", "api", "server", "data", "base", "system", "public", "private",
]
#: A public vocabulary whose whole words, in the order of its ids, are taken as further words by frequency.
VOCABULARY = "word_bpe_49k.json"
WORD_END = "</w>"
#: The rows of a keyboard, and how far each is shifted to the right, in quarters of a key.
ROWS = (("`1234567890-=", 0), ("qwertyuiop[]", 6), ("asdfghjkl;'", 7), ("zxcvbnm,./", 9))
LEET = str.maketrans("@4310$5!7", "aaeiossit")
DAY, MONTH, YEAR = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d"
#: Forms of dates, and how many there are of each.
DATES = [
    (re.compile(YEAR), 120),
    (re.compile(f"{YEAR}[-/._]?{MONTH}"), 120 * 12),
    (re.compile(f"{YEAR}[-/._]?{MONTH}[-/._]?{DAY}"), 120 * 365),
    (re.compile(f"{DAY}{MONTH}{YEAR}"), 120 * 365),
    (re.compile(rf"(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._]{YEAR}"), 120 * 365),
    (re.compile(r"(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._]\d\d"), 100 * 365),
]
LONGEST_PERIOD = 8
#: What each further segment costs: an attacker must guess where it begins.
CUT = 1.0
#: What the number of repeats, or the length of a walk, costs; how a walk begins, and each turn of it; and how a run
#: of letters or digits in their order does.
TIMES, LENGTH, BEGIN, TURN, ORDER = 1.0, 0.7, math.log10(47), math.log10(6), math.log10(36 * 2)


def _steps() -> dict[tuple[str, str], tuple[int, int]]:
    """Neighbouring keys -> the direction from the first to the second."""
    at = {c: (shift + 4 * k, row) for row, (keys, shift) in enumerate(ROWS) for k, c in enumerate(keys)}
    found = {}
    for a, (x, y) in at.items():
        for b, (u, v) in at.items():
            if (y == v and abs(u - x) == 4) or (abs(v - y) == 1 and abs(u - x) < 4):
                found[a, b] = ((u > x) - (u < x), v - y)
    return found


STEPS = _steps()


@lru_cache(maxsize=2)
def ranks(path: str | None = None) -> tuple[dict[str, int], int]:
    """(place of each word by frequency, from 1; the longest word's length)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as file:
        ids = json.load(file)["model"]["vocab"]
    more = (w.removesuffix(WORD_END) for w in sorted(ids, key=ids.get) if w.endswith(WORD_END))
    words = dict.fromkeys([*WORDS, *(w for w in more if len(w) >= 3 and w.isalpha())])
    return {w: k + 1 for k, w in enumerate(words)}, max(map(len, words))


dropped_by(ranks.cache_clear)


def word_spans(value: str, low: str, plain: str, i: int) -> Iterator[tuple[int, float]]:
    """(end, cost) of the words that begin at ``i``, in any case, also with digits and signs for letters."""
    place, longest = ranks()
    for j in range(i + 3, min(len(value), i + longest) + 1):
        rank, changed = place.get(low[i:j]), 0
        if rank is None:
            rank, changed = place.get(plain[i:j]), 1
        if rank is not None:
            yield j, math.log10(rank + 1) + 0.3 * ((value[i:j] != low[i:j]) + 2 * changed)


def alphabet(text: str) -> int:
    """How many characters a brute-force attack on ``text`` must try at each place."""
    size = 10 * any("0" <= c <= "9" for c in text) + 26 * any("a" <= c <= "z" for c in text)
    size += 26 * any("A" <= c <= "Z" for c in text) + 33 * any(c.isascii() and not c.isalnum() for c in text)
    return max(10, size + 100 * (not text.isascii()))


def in_order(a: str, b: str) -> int:
    """1 or -1 if two letters or digits follow each other in their order or against it, else 0."""
    return ord(b) - ord(a) if abs(ord(b) - ord(a)) == 1 and a.isalnum() and b.isalnum() else 0


@lru_cache(maxsize=4096)
def log10_guesses(value: str) -> float:
    """The cost of the cheapest segmentation of ``value``, as log10 of the guesses it takes.

    Segments are words, dates, repeats of up to LONGEST_PERIOD characters (two times at least, the last one perhaps
    cut), keyboard walks and orders of three characters at least, and brute force. Every end of each is
    admitted: repeats, walks and orders go on from character to character as states of the programme.
    """
    n = len(value)
    if not n:
        return 0.0
    each = math.log10(alphabet(value))
    low = value.lower()
    low = low if len(low) == n else value
    plain = low.translate(LEET)
    never = math.inf
    # cheap[i]: the cheapest way to have guessed value[:i]; begun[i]: the same, and to begin another segment there
    cheap, begun = [never] * (n + 1), [never] * (n + 1)
    cheap[0] = begun[0] = 0.0
    amid = never  # in a brute-force span
    periods = range(1, min(LONGEST_PERIOD, n // 2) + 1)
    equal, repeated = [0] * (LONGEST_PERIOD + 1), [never] * (LONGEST_PERIOD + 1)
    way: tuple[int, int] | None = None
    turn = 0
    walk_two = walk = order_two = order = never
    for i in range(n):
        j = i + 1
        # what has begun before i is settled; spans from i are put forward
        begun[i] = cheap[i] + (CUT if i else 0.0)
        for end, cost in word_spans(value, low, plain, i):
            cheap[end] = min(cheap[end], begun[i] + cost)
        if value[i].isdigit():
            for form, count in DATES:
                if m := form.match(value, i):
                    cheap[m.end()] = min(cheap[m.end()], begun[i] + math.log10(count))
        amid = min(amid, begun[i]) + each
        ways = [amid]
        for p in periods:
            same = i >= p and value[i] == value[i - p]
            equal[p] = equal[p] + 1 if same else 0
            repeated[p] = repeated[p] if same else never
            if equal[p] >= p:
                repeated[p] = min(repeated[p], begun[j - 2 * p] + p * each + TIMES)
                ways.append(repeated[p])
        if i:
            new_way = STEPS.get((low[i - 1], low[i]))
            walk = min(walk, walk_two) + (TURN if new_way != way else 0.0) if new_way else never
            walk_two = begun[i - 1] + BEGIN + LENGTH if new_way else never
            way = new_way
            new_turn = in_order(low[i - 1], low[i])
            order = min(order, order_two) if new_turn and new_turn == turn else never
            order_two = begun[i - 1] + ORDER + LENGTH if new_turn else never
            turn = new_turn
            ways += [walk, order]
        cheap[j] = min(cheap[j], *ways)
    return cheap[n]


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base patterns' matches that stay."""
    found = []
    if any(x in low for x in ("password", "passwd", "secret", "token", "key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def covered(a: int, b: int, base: list[tuple[int, int, int]]) -> bool:
    """Whether spans, sorted by start, leave nothing of ``a`` to ``b``."""
    for start, _, end in base:
        if start > a:
            break
        a = max(a, end)
    return a >= b


def value_at(text: str, a: int, quote: str | None) -> tuple[int, int]:
    """(end of what is judged, end) of the value that begins at ``a``."""
    whole = QUOTED[quote].match(text, a) if quote else None
    if whole is None:
        end = VALUE.match(text, a)
        return (end.end(), end.end()) if end else (a, a)
    blank = BLANK.search(text, a, whole.end())
    return (blank.start() if blank else whole.end()), whole.end()


def values(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end of what is judged, end) of values in credential contexts.

    A cue may stand in a value ahead of another; a value in a value is passed over.
    """
    found = [(m.end(), *value_at(text, m.end(), m[1])) for m in CONTEXT.finditer(text) if not ADDRESS.match(text, m.end())]
    found += [(m.start(1), m.end(1), m.end(1)) for m in LINK.finditer(text)]
    last = 0
    for a, b, end in sorted(found):
        if a >= last:
            last = end
            yield a, b, end


def guess_spans(text: str, low: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not any(x in low for x in CUES):
        return []
    return [(a, 3, end) for a, b, end in values(text) if log10_guesses(text[a:b]) >= MIN_LOG10_GUESSES and not covered(a, end, base)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a whole text, both by start, then kind."""
    low = text.lower()
    base = base_spans(text, low)
    return base, sorted(base + guess_spans(text, low, base))


def redacted(text: str, spans: list[tuple[int, int, int]], mask: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by ``mask``."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, _, end = spans[k]
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


COLUMNS = [
    ("n_assign", "long"),
    ("n_access", "long"),
    ("n_hex", "long"),
    ("n_guess", "long"),
    ("base_sha256", "string"),
    ("spans", "string"),
    ("masked", "string"),
]


def report(text: str, with_text: bool = True) -> tuple:
    """The values of COLUMNS for one whole text."""
    base, spans = scan(text)
    kinds = [k for _, k, _ in base]
    sha = hashlib.sha256(joined(base).encode()).hexdigest()
    row = (kinds.count(0), kinds.count(1), kinds.count(2), len(spans) - len(base), sha, joined(spans))
    return (*row, redacted(text, spans)) if with_text else row


def secret_scan(docs: DataFrame, carry: Iterable[str] = ("doc_id",), with_text: bool = True) -> DataFrame:
    """The ``carry`` columns of each document, counts and spans of its secrets, and the text with them masked."""
    columns = COLUMNS if with_text else COLUMNS[:-1]
    return per_text(docs, columns, lambda texts: (report(x, with_text) for x in as_text(texts)), carry)
