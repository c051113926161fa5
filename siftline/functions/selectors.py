"""Selectors, compiled to one matcher that goes through a page once, in document order, whatever their number.

Each place of a selector is a bit, and a node carries the bits that it, its parent, any ancestor, and its elder siblings
have reached; nothing is looked for twice, and nothing recurs, however deep a page is.

Known are tags, ``*``, .class, #id, [attr] with = ~= |= ^= $= *=, descendants, > children, + next and ~ later
siblings, :not() of simple selectors, :empty, :first-child, :last-child, :only-child, :nth-child() and
:nth-last-child() of a number, odd, even or an+b. Any other is refused with a ValueError when it is compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from .html import Node

#: Tests a node, its place among its parent's elements from 1, and how many these are.
Test = Callable[["Node", int, int], bool]

SIMPLE = re.compile(
    r"(?P<tag>\*|[\w-]+)|\.(?P<cls>[\w-]+)|#(?P<ident>[\w-]+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<how>[~|^$*]?)=\s*(?P<value>\"[^\"]*\"|'[^']*'|[^\]\s]*)\s*)?\]"
    r"|:not\((?P<no>[^()]*(?:\([^()]*\)[^()]*)*)\)|:(?P<kind>[a-z-]+)(?:\(\s*(?P<rule>[^()]*?)\s*\))?"
)
STEP = re.compile(r"\s*([>+~])\s*|\s+")


def _attribute(name: str, how: str | None, value: str) -> Test:
    def test(node: Node, at: int, of: int) -> bool:
        have = node.attrs.get(name)
        if have is None or how is None:
            return have is not None
        if how == "~":
            return value in have.split()
        if how == "|":
            return have == value or have.startswith(f"{value}-")
        if how == "":
            return have == value
        found = {"^": have.startswith, "$": have.endswith, "*": have.__contains__}[how](value)
        return value != "" and found

    return test


def _nth(rule: str, last: bool) -> Test:
    rule = {"odd": "2n+1", "even": "2n"}.get(rule, rule).replace(" ", "")
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", rule)
    if not rule or not m:
        raise ValueError(f"no such place: {rule}")
    step = 0 if m[1] is None else int(f"{m[1]}1" if m[1] in ("", "+", "-") else m[1])
    first = int(m[2] or 0)

    def test(node: Node, at: int, of: int) -> bool:
        past = (of - at + 1 if last else at) - first
        return past == 0 if step == 0 else past % step == 0 and past // step >= 0

    return test


def _kind(kind: str, rule: str | None) -> Test:
    plain = {
        "first-child": lambda node, at, of: at == 1,
        "last-child": lambda node, at, of: at == of,
        "only-child": lambda node, at, of: of == 1,
        "empty": lambda node, at, of: not any(x for x in node.children if isinstance(x, str) or x.tag != "!"),
    }
    if rule is None and kind in plain:
        return plain[kind]
    if rule is not None and kind in ("nth-child", "nth-last-child"):
        return _nth(rule, kind == "nth-last-child")
    raise ValueError(f"no such selector: :{kind}")


def _tests(text: str, at: int) -> tuple[list[Test], int]:
    """The tests of a compound selector that begins at a place, and where it ends."""
    tests: list[Test] = []
    while m := SIMPLE.match(text, at):
        got = m.groupdict()
        if got["tag"] is not None:
            if tests:
                break
            tests.append(lambda node, at, of, tag=got["tag"].lower(): tag in ("*", node.tag))
        elif got["cls"] is not None:
            tests.append(_attribute("class", "~", got["cls"]))
        elif got["ident"] is not None:
            tests.append(_attribute("id", "", got["ident"]))
        elif got["attr"] is not None:
            value = got["value"] or ""
            tests.append(_attribute(got["attr"].lower(), got["how"] if got["value"] is not None else None, value[1:-1] if value[:1] in ('"', "'") else value))
        elif got["no"] is not None:
            others = [_whole(x) for x in got["no"].split(",")]
            tests.append(lambda node, at, of, others=others: not any(all(t(node, at, of) for t in x) for x in others))
        else:
            tests.append(_kind(got["kind"], got["rule"]))
        at = m.end()
    if not tests:
        raise ValueError(f"no such selector: {text}")
    return tests, at


def _whole(text: str) -> list[Test]:
    tests, end = _tests(text.strip(), 0)
    if end != len(text.strip()):
        raise ValueError(f"no such selector: {text}")
    return tests


@dataclass(frozen=True)
class Matcher:
    """Steps of all selectors in a row: how a step is reached from the one before it, its tests, and the selector that it ends."""

    steps: tuple[tuple[str, tuple[Test, ...], int], ...]
    size: int

    def hits(self, root: Node) -> list[list[Node]]:
        """The nodes of each selector, in document order."""
        found: list[list[Node]] = [[] for _ in range(self.size)]
        stack = [_frame(root, 0, 0)]
        while stack:
            frame = stack[-1]
            if frame[2] == len(frame[0]):
                stack.pop()
                continue
            elements, above, at, parent, before, last = frame
            node, own = elements[at], 0
            for k, (how, tests, ends) in enumerate(self.steps):
                reached = {"": -1, " ": above, ">": parent, "+": last, "~": before}[how]
                if (reached >> (k - 1) & 1 if how else True) and all(t(node, at + 1, len(elements)) for t in tests):
                    own |= 1 << k
                    if ends >= 0 and not (found[ends] and found[ends][-1] is node):
                        found[ends].append(node)
            frame[2:] = [at + 1, parent, before | own, own]
            stack.append(_frame(node, above | own, own))
        return found


def _frame(node: Node, above: int, own: int) -> list:
    """[a node's elements, bits of it and its ancestors, the next element, bits of it, of elder siblings, of the last one]"""
    return [[x for x in node.children if not isinstance(x, str) and x.tag != "!"], above, 0, own, 0, 0]


@lru_cache(maxsize=256)
def matcher(selectors: tuple[str, ...]) -> Matcher:
    steps: list[tuple[str, tuple[Test, ...], int]] = []
    for number, selector in enumerate(selectors):
        for part in _split(selector):
            at, how = 0, ""
            while True:
                tests, at = _tests(part, at)
                m = STEP.match(part, at)
                steps.append((how, tuple(tests), -1 if m else number))
                if not m:
                    break
                how, at = m[1] or " ", m.end()
            if at != len(part):
                raise ValueError(f"no such selector: {selector}")
    return Matcher(tuple(steps), len(selectors))


def _split(selector: str) -> Iterator[str]:
    """A list of selectors at its commas, but for those in brackets."""
    for part in re.split(r",(?![^()\[]*[)\]])", selector):
        yield part.strip()
