"""Operator 2, license scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a run of lines that aren't blank; signs of comments are no words. Sparse multinomial
logistic regression over words and word pairs names a licence family or the class of unknown text, for
every paragraph; probabilities are calibrated by one temperature on wordings left out of training. A
paragraph is read by its passages: words that the model knows, with at most ``GAP`` other words between
them, long passages in overlapping units of ``UNIT`` words. What lies outside of passages has no feature
and is unknown by construction, so nothing is passed over.

A passage that is likelier a notice than not (the unknown class has at most 1 - ``LEAST``) is compared with the
templates of the likeliest family, then of the next that is likelier than the unknown class: runs that hold at
least ``OVERLAP`` of the word pairs of a template, and are not over twice as long as it and ``GAP`` words, nor over
``WINDOW``, are its notices. Their words are taken out and the rest is judged again, so several notices of one
passage are found. What is predicted and not confirmed is reported as such.
SPDX identifiers are read by a fixed table, into columns of their own.

Notices are learned from names of licences in usual sentences, varied by fixed rules, and from text that
is none. The training set is fixed; it doesn't grow with the corpus. All paragraphs of all texts are read.

Defined results: a null text is an empty one; blank lines are no paragraphs. Repeated rows give repeated
results; a null doc_id is passed on. Overlapping runs of one family are one notice; those apart are
several. Spans are in code points of the text.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import as_text, per_text

LEAST, OVERLAP, WINDOW = 0.5, 0.6, 60
#: Fewer known grams than this say less than their share.
FEW = 4
#: Templates of so many word pairs at most must be there whole.
WHOLE = 3
#: Word pairs of one notice stand so many words apart at most, beyond those that confirm it; known words of one passage too.
GAP = 8
#: Notices this near to an end of a unit that isn't the end of its passage are left to the unit beside it.
MARGIN = 12
#: Each run of ``WINDOW`` words lies whole, and off the margins, in one unit at least.
STEP = 60
UNIT = STEP + WINDOW + 2 * MARGIN
UNKNOWN = "unknown"
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

# Short notices of licence families, as they are commonly written.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "Apache-2.0 license",
        "Distributed under the Apache License, Version 2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Licensed under the GNU GPL v3",
        "SPDX GPL-3.0 license",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "Licensed under the GNU GPL v2",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Licensed under the BSD License",
        "Released under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc0": ["Released under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "isc": ["Licensed under the ISC License", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"],
    "proprietary": ["All rights reserved", "Copyright by the authors. All rights reserved"],
    "bsl-1.0": [
        "Distributed under the Boost Software License, Version 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages"],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "wtfpl": ["Do What The Fuck You Want To Public License"],
    "artistic-2.0": ["Licensed under the Artistic License 2.0"],
    "cddl-1.0": ["The contents of this file are subject to the terms of the Common Development and Distribution License"],
    "eupl-1.2": ["Licensed under the European Union Public Licence"],
    "ofl-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "ms-pl": ["Licensed under the Microsoft Public License"],
    "psf-2.0": ["Licensed under the Python Software Foundation License"],
    "postgresql": ["Released under the PostgreSQL License"],
    "cc-by-nd": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "odbl-1.0": ["This database is made available under the Open Database License"],
    "upl-1.0": ["Licensed under the Universal Permissive License"],
    "ncsa": ["Released under the University of Illinois NCSA Open Source License"],
}
# Names of licences that stand for themselves, and short ones that need a word of licensing beside them.
NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License", "Apache Software License", "Version 2.0 of the Apache License"],
    "mit": ["MIT License", "MIT Open Source License"],
    "gpl-3.0": ["GNU General Public License version 3", "GNU General Public License v3.0", "version 3 of the GNU GPL", "GNU GPL version 3", "version 3 of the GNU General Public License"],
    "gpl-2.0": ["GNU General Public License version 2", "GNU General Public License v2.0", "version 2 of the GNU GPL", "GNU GPL version 2", "version 2 of the GNU General Public License"],
    "lgpl": ["GNU Lesser General Public License", "Lesser General Public License", "GNU LGPL", "GNU Library General Public License"],
    "agpl-3.0": ["GNU Affero General Public License", "Affero General Public License", "GNU AGPL"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "Simplified BSD License", "BSD-style license"],
    "mpl-2.0": ["Mozilla Public License", "Mozilla Public License 2.0"],
    "cc-by": ["Creative Commons Attribution 4.0", "Creative Commons Attribution License", "Creative Commons Attribution 3.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution Share Alike"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial License"],
    "cc0": ["CC0 1.0 Universal", "Creative Commons Zero", "CC0 public domain dedication"],
    "unlicense": ["Unlicense license"],
    "isc": ["ISC License"],
    "bsl-1.0": ["Boost Software License", "Boost Software License - Version 1.0"],
    "zlib": ["zlib License", "zlib libpng license"],
    "epl-2.0": ["Eclipse Public License", "Eclipse Public License 2.0", "Eclipse Public License v1.0"],
    "wtfpl": ["WTFPL license"],
    "artistic-2.0": ["Artistic License", "Perl Artistic License"],
    "cddl-1.0": ["Common Development and Distribution License"],
    "eupl-1.2": ["European Union Public License", "EUPL license"],
    "ofl-1.1": ["SIL Open Font License", "Open Font License"],
    "ms-pl": ["Microsoft Public License"],
    "psf-2.0": ["Python Software Foundation License", "PSF License"],
    "postgresql": ["PostgreSQL License"],
    "cc-by-nd": ["Creative Commons Attribution-NoDerivatives 4.0", "Creative Commons Attribution-NoDerivatives License"],
    "cc-by-nc-sa": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike License"],
    "odbl-1.0": ["Open Database License", "Open Data Commons Open Database License"],
    "upl-1.0": ["Universal Permissive License"],
    "ncsa": ["NCSA Open Source License", "Illinois NCSA License"],
}
SHORT_NAMES = {
    "apache-2.0": ["Apache 2.0", "Apache 2", "ASL 2.0"], "mit": ["MIT"], "gpl-3.0": ["GPLv3", "GPL v3", "GPL-3.0", "GPL version 3"],
    "gpl-2.0": ["GPLv2", "GPL v2", "GPL-2.0", "GPL version 2"], "lgpl": ["LGPL", "LGPLv3", "LGPL v2.1"], "agpl-3.0": ["AGPL", "AGPLv3", "AGPL v3"],
    "bsd": ["BSD", "3-clause BSD", "2-clause BSD"], "mpl-2.0": ["MPL 2.0", "MPL"], "cc-by": ["CC BY 4.0", "CC-BY", "CC-BY-4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA"], "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC"], "cc0": ["CC0"], "unlicense": ["Unlicense"], "isc": ["ISC"],
    "bsl-1.0": ["BSL-1.0", "Boost 1.0"], "zlib": ["zlib"], "epl-2.0": ["EPL", "EPL 2.0"], "wtfpl": ["WTFPL"], "artistic-2.0": ["Artistic 2.0"],
    "cddl-1.0": ["CDDL", "CDDL 1.0"], "eupl-1.2": ["EUPL", "EUPL 1.2"], "ofl-1.1": ["OFL", "SIL OFL"], "ms-pl": ["Ms-PL"], "psf-2.0": ["PSF"],
    "cc-by-nd": ["CC BY-ND 4.0", "CC-BY-ND"], "cc-by-nc-sa": ["CC BY-NC-SA 4.0", "CC-BY-NC-SA"], "odbl-1.0": ["ODbL"], "upl-1.0": ["UPL 1.0"],
}
#: How a short name is told from a mere mention.
CUES = ["under {}", "under the {}", "terms of {}", "terms of the {}", "{} license", "{} licensed", "license {}", "and {}", "or {}"]
#: How often a template, and how often a sentence of a name, is varied for training.
TEMPLATE_COPIES, COPIES = 20, 6
#: Sentences around names; a model under test learns the first ones alone.
FRAMES = ["licensed under the {}", "released under the {}", "distributed under the {}", "this project is licensed under the terms of the {}", "see the {} for details", "this file is governed by the {}"]
HELD_OUT_FRAMES = ["available under the {}", "the code is open source and covered by the {}", "this library may be used as permitted by the {}", "{} applies to everything in here"]
# Text that shares words with notices and is none.
OTHERS = [
    "The terms of the agreement were published by the foundation in a general form",
    "She lost her driving license and had to apply for a new one",
    "The public library is free of charge for any person",
    "Version 3 of the software brings new features and better documentation",
    "The general was granted permission to use the source",
    "All of the hotel rooms were reserved for the whole week",
    "His rights as an author were never in question",
    "The apache helicopter flew over the creative commons of the village",
    "Copies of the document were distributed to the members of the foundation",
    "A conditions report, with or without modification, is due every week",
    "The work was released in the following year under a new name",
    "You may not use this door except in an emergency",
    "The mit of the gnu is a possible attribution in this international work",
    "He renewed his fishing license and the license plate of his car",
    "Researchers at MIT published new results on public health",
    "The Mozilla foundation and the Python community met in Boston",
    "Boost your energy with these simple tips for version 1.0 of your morning",
    "The university of Illinois opened a new campus under the terms of the donation",
    "The European Union is a public body with common rules of distribution",
    "Eclipse of the sun is visible to the public this year",
    "The database was made available to the open market",
    "An artistic work of common development is a matter of taste",
    "The software is provided to any person with a license to practice",
    "You want to do what the public expects",
    "The open font of water is universal and permissive",
    "Version 2.0 of the application is available for download",
    "The project is released under a new name in version 3.0",
    "Apache helicopters and Apache web servers have little in common",
    "A general public opinion was published under pressure",
    "The BSD operating system and the GNU tools run on this machine",
    "Er kam mit dem Zug und ging mit ihr durch die Stadt",
    "The server of Apache 2.0 was fast and the next version faster",
]

SPDX = re.compile(r"(?i:(spdx-license-identifier:)[^\S\n]*)[\w.+()-]+(?:[^\S\n]+[\w.+()-]+)*")
SPDX_ID = re.compile(r"[\w.-]+")
SPDX_FAMILIES = {
    family: re.compile(rf"(?i:{known}(?:-only|-or-later)?)")
    for family, known in {
        "apache-2.0": r"apache-2\.0", "mit": "mit", "gpl-3.0": r"gpl-3\.0", "gpl-2.0": r"gpl-2\.0", "lgpl": r"lgpl-[\d.]+",
        "agpl-3.0": r"agpl-3\.0", "bsd": r"0bsd|bsd-\d-clause", "mpl-2.0": r"mpl-2\.0", "cc-by": r"cc-by-[\d.]+", "cc-by-sa": r"cc-by-sa-[\d.]+",
        "cc-by-nc": r"cc-by-nc-[\d.]+", "cc0": r"cc0-1\.0", "unlicense": "unlicense", "isc": "isc",
    }.items()
}


# Spellings that count as one word.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed"}


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word in lower case and one spelling, start, end)."""
    return [(SPELLINGS.get(w, w), m.start(), m.end()) for m in WORD.finditer(text) for w in (m[0].lower(),)]


def grams(words: list[str | None]) -> set[str]:
    """Words and pairs of words beside each other; what is None is left out and parts its neighbours."""
    return {w for w in words if w} | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a and b}


@dataclass
class Classifier:
    families: list[str]
    weights: dict[str, np.ndarray]
    bias: np.ndarray
    temperature: float
    #: every gram that the model knows holds one of these words
    anchors: frozenset[str]
    templates: dict[str, list[set[str]]]
    #: the (family, number) of the templates that hold a word pair, and the pair that each begins with
    places: dict[str, list[tuple[str, int]]]
    firsts: dict[tuple[str, int], str]

    def probabilities(self, found: set[str]) -> np.ndarray:
        known = [self.weights[g] for g in found if g in self.weights]
        z = (self.bias + (np.sum(known, axis=0) / np.sqrt(max(len(known), FEW)) if known else 0)) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def ranked(self, words: list[str | None]) -> list[tuple[str, float]]:
        """Families with their calibrated probabilities, the likeliest first, if a notice is likelier than none.

        The likeliest, and what is likelier than the unknown class: in words of several notices families share the probability.
        """
        p = self.probabilities(grams(words))
        if p[-1] > 1 - LEAST:
            return []
        order = np.argsort(-p[:-1], kind="stable")
        return [(self.families[k], float(p[k])) for n, k in enumerate(order) if not n or p[k] > p[-1]]

    def judge(self, words: list[str | None]) -> str:
        """The most probable family, or the unknown class."""
        return next((f for f, _ in self.ranked(words)), UNKNOWN)

    def occurrences(self, names: list[str], family: str) -> list[tuple[int, int]]:
        """(first word, end) of each run of words, at most ``WINDOW``, that holds ``OVERLAP`` of the word pairs of a family's template."""
        pairs = [f"{a} {b}" for a, b in zip(names, names[1:], strict=False)]
        known: dict[str, list[int]] = {}
        for k, pair in enumerate(pairs):
            if pair in self.places:
                known.setdefault(pair, []).append(k)
        counts = Counter(t for pair in known for f, t in self.places[pair] if f == family)
        found: list[tuple[int, int]] = []
        for t, n in counts.items():
            template = self.templates[family][t]
            least = len(template) if len(template) <= WHOLE else math.ceil(OVERLAP * len(template))
            if n >= least:
                hits = sorted(k for pair in template & known.keys() for k in known[pair])
                width = min(WINDOW, 2 * len(template) + GAP)
                found += runs(hits, pairs, least, width, self.firsts[family, t])
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def units(self, names: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(start, end, least, most) of what is judged at once; its notices lie from least to most.

        A unit is a passage, or a part of it, and one word to either side.
        """
        known = [k for k, w in enumerate(names) if w in self.anchors]
        at = 0
        for n, k in enumerate(known):
            if n + 1 < len(known) and known[n + 1] - k <= GAP + 1:
                continue
            first, end = max(0, known[at] - GAP), min(len(names), k + 1 + GAP)
            at = n + 1
            for start in range(first, max(first + 1, end - (UNIT - STEP)), STEP):
                last = start + UNIT >= end
                stop = end if last else start + UNIT
                yield start, stop, start if start == first else start + MARGIN, stop if last else stop - MARGIN

    def notices(self, names: list[str]) -> tuple[list[tuple[int, int, str, float]], list[tuple[int, int, str, float]]]:
        """(first word, end, family, probability) of notices that templates confirm, and of passages that they don't."""
        out: list[tuple[int, int, str, float]] = []
        open_units: list[tuple[int, int]] = []
        taken = np.zeros(len(names), bool)
        runs_of: dict[str, list[tuple[int, int]]] = {}
        for start, stop, least, most in self.units(names):
            while True:
                ranked = self.rest(names, taken, start, stop)
                for family, p in ranked:
                    if family not in runs_of:
                        runs_of[family] = self.occurrences(names, family)
                    mine = [(a, b) for a, b in runs_of[family] if least <= a and b <= most and not taken[a:b].all()]
                    if mine:
                        break
                else:
                    if ranked:
                        open_units.append((start, stop))
                    break
                for a, b in mine:
                    out.append((a, b, family, p))
                    taken[a:b] |= self.told(names[a:b], family)
                runs_of[family] = [x for x in runs_of[family] if x not in mine]
        unsure = [(a, b, *found[0]) for a, b in open_units if (found := self.rest(names, taken, a, b))]
        return sorted(out), unsure

    def rest(self, names: list[str], taken: np.ndarray, start: int, stop: int) -> list[tuple[str, float]]:
        """What the words of a unit say that aren't taken."""
        return self.ranked([None if taken[k] else names[k] for k in range(start, stop)])

    def told(self, names: list[str], family: str) -> np.ndarray:
        """Which words of a notice stand in word pairs of the family's templates."""
        own = np.zeros(len(names), bool)
        for k, pair in enumerate(zip(names, names[1:], strict=False)):
            if any(f == family for f, _ in self.places.get(" ".join(pair), ())):
                own[k : k + 2] = True
        return own

    def read(self, text: str) -> tuple[list[tuple[int, int, str, float]], list[tuple[int, int, str, float]]]:
        """(start, end, family, probability) of each notice in a text, and of each passage that no template confirms."""
        sure: list[tuple[int, int, str, float]] = []
        unsure: list[tuple[int, int, str, float]] = []
        for start, paragraph in paragraphs(text):
            names = WORD.findall(paragraph.lower())
            if not self.anchors.isdisjoint(names) or not SPELLINGS.keys().isdisjoint(names):
                words = words_of(paragraph)
                for out, found in zip((sure, unsure), self.notices([w for w, _, _ in words]), strict=True):
                    out += [(start + words[a][1], start + words[b - 1][2], family, p) for a, b, family, p in found]
        return sure, unsure

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, family, probability) of each notice and identifier in a text."""
        return sorted(identifiers(text) + self.read(text)[0])


def runs(hits: list[int], pairs: list[str], least: int, width: int, first: str) -> Iterator[tuple[int, int]]:
    """Runs of at most ``width`` words, none overlapping, that hold ``least`` distinct ones of the word pairs at ``hits``."""
    inside: Counter[str] = Counter()
    left = right = 0
    while right < len(hits):
        inside[pairs[hits[right]]] += 1
        right += 1
        while hits[right - 1] - hits[left] + 2 > width or inside[pairs[hits[left]]] > 1:
            left = dropped(inside, pairs[hits[left]], left)
        if len(inside) < least:
            continue
        at = right
        while at < len(hits) and hits[at] - hits[right - 1] <= GAP and hits[at] - hits[left] + 2 <= width and pairs[hits[at]] != first:
            at += 1
            if pairs[hits[at - 1]] not in inside or hits[at - 1] == hits[right - 1] + 1:
                inside.update(pairs[k] for k in hits[right:at])
                right = at
        while len(inside) > least and hits[left + 1] - hits[left] > GAP:
            left = dropped(inside, pairs[hits[left]], left)
        yield hits[left], hits[right - 1] + 2
        inside.clear()
        left = right


def dropped(inside: Counter[str], pair: str, left: int) -> int:
    inside[pair] -= 1
    if not inside[pair]:
        del inside[pair]
    return left + 1


def paragraphs(text: str) -> Iterator[tuple[int, str]]:
    """(start, text) of each run of lines that aren't blank."""
    start = at = 0
    for line in text.split("\n"):
        if not line or line.isspace():
            if start < at:
                yield start, text[start:at]
            start = at + len(line) + 1
        at += len(line) + 1
    if start < at:
        yield start, text[start:at]


def identifiers(text: str) -> list[tuple[int, int, str, float]]:
    """Notices by SPDX identifiers, every known one of an expression, each from the tag on."""
    out: dict[tuple[int, str], tuple[int, int, str, float]] = {}
    for m in SPDX.finditer(text):
        for x in SPDX_ID.finditer(text, m.end(1), m.end()):
            for family, known in SPDX_FAMILIES.items():
                if known.fullmatch(x[0]):
                    out.setdefault((m.start(), family), (m.start(), x.end(), family, 1.0))
    return list(out.values())


def varied(words: list[str], rng: random.Random, filler: list[str]) -> list[str]:
    """A notice with words around it, one perhaps left out."""
    out = list(words)
    if len(out) > 6 and rng.random() < 0.4:
        del out[rng.randrange(len(out))]
    before, after = rng.randrange(8), rng.randrange(12)
    return [rng.choice(filler) for _ in range(before)] + out + [rng.choice(filler) for _ in range(after)]


def confirming(family: str) -> list[list[str]]:
    """The words of what confirms a family: its templates, its names, and its short names with a word of licensing."""
    short = [cue.format(n) for n in SHORT_NAMES.get(family, []) for cue in CUES]
    return [[w for w, _, _ in words_of(t)] for t in [*TEMPLATES[family], *NAMES.get(family, []), *short]]


def framed(family: str, frames: list[str]) -> list[list[str]]:
    """The words of sentences around a family's names."""
    return [[w for w, _, _ in words_of(frame.format(n))] for n in [*NAMES.get(family, []), *SHORT_NAMES.get(family, [])] for frame in frames]


# Words that say nothing by themselves, nor beside each other.
COMMON = frozenset("the of and or to in a is any this with for as by are that you may not on an its be it at from was were all no do what will if your our".split())


@lru_cache(maxsize=1)
def train(steps: int = 400, seed: int = 7) -> Classifier:
    """Fit the classifier on varied sentences; the temperature on sentences of other wordings, which are left out."""
    rng = random.Random(seed)
    families = [*TEMPLATES, UNKNOWN]
    templates_of = {f: confirming(f) for f in TEMPLATES}
    known = {f: templates_of[f] + framed(f, FRAMES) for f in TEMPLATES}
    others = [[w for w, _, _ in words_of(t)] for t in OTHERS]
    filler = sorted({w for t in others for w in t}) + ["lorem", "ipsum", "dolor", "2019", "x", "inc", "project", "file"]
    fit: list[tuple[set[str], int]] = []
    test: list[tuple[set[str], int]] = []
    for k, f in enumerate(families[:-1]):
        for n, t in enumerate(known[f]):
            fit += [(grams(varied(t, rng, filler)), k) for _ in range(TEMPLATE_COPIES if n < len(TEMPLATES[f]) else COPIES)]
        test += [(grams(varied(t, rng, filler)), k) for t in framed(f, HELD_OUT_FRAMES)]
    everything = [w for ts in known.values() for t in ts for w in t]
    none = len(families) - 1
    single = sorted(set(everything) - COMMON)
    for part, times, shuffled in ((fit, 20, 2500), (test, 5, 200)):
        for t in others:
            part += [(grams(varied(t, rng, filler)), none) for _ in range(times)]
        for w in single:  # nor is one word alone
            part += [(grams(varied([w], rng, filler)), none) for _ in range(times)]
        for _ in range(shuffled):  # words of notices in no order are no notice
            some = rng.sample(everything, rng.randrange(1, 14)) + [rng.choice(filler) for _ in range(rng.randrange(10))]
            rng.shuffle(some)
            part.append((grams(some), none))
    # only what occurs in a notice can speak for one, and only with a word that isn't common
    names = sorted(g for g in {g for ts in known.values() for t in ts for g in grams(t)} if not COMMON.issuperset(g.split()))
    place = {g: k for k, g in enumerate(names)}

    def matrix(of: list[tuple[set[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(of), len(names)), np.float32)
        for r, (found, _) in enumerate(of):
            here = [place[g] for g in found if g in place]
            if here:
                x[r, here] = 1 / np.sqrt(max(len(here), FEW))
        return x, np.array([k for _, k in of])

    x, y = matrix(fit)
    onehot = np.eye(len(families), dtype=np.float32)[y]
    w, b = np.zeros((len(names), len(families)), np.float32), np.zeros(len(families), np.float32)
    b[-1] = 1.0
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (onehot - p) / len(x)
        w += 60.0 * (x.T @ d - 1e-6 * w)
        b += 5.0 * d.sum(0)
    xt, yt = matrix(test)
    z = (xt @ w + b).astype(float)

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(yt)), yt]).mean())

    temperature = min((t / 20 for t in range(4, 80)), key=loss)
    alone = b.astype(float)
    alone[-1] = max(alone[-1], alone[:-1].max() + 1)  # without any known gram a text is unknown
    anchors = frozenset(w for g in names for w in g.split()) - COMMON
    templates = {f: [{g for g in grams(t) if " " in g} for t in ts] for f, ts in templates_of.items()}
    places: dict[str, list[tuple[str, int]]] = {}
    for f, ts in templates.items():
        for k, t in enumerate(ts):
            for pair in t:
                places.setdefault(pair, []).append((f, k))
    firsts = {(f, k): " ".join(t[:2]) for f, ts in templates_of.items() for k, t in enumerate(ts)}
    weights = {g: w[k].astype(float) for g, k in place.items()}
    return Classifier(families, weights, alone, temperature, anchors, templates, places, firsts)


def license_scan(docs: DataFrame, carry: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of each document, and of its notices the number, families, spans and greatest probability.

    ``unconfirmed`` has the spans of passages that the classifier takes for notices and no template confirms, ``spdx``
    those of identifiers.
    """
    model = train()

    def listed(found: list[tuple[int, int, str, float]]) -> str:
        return ",".join(f"{f}:{a}:{b}" for a, b, f, _ in found)

    def rows(texts):
        for text in as_text(texts):
            sure, unsure = model.read(text)
            families = ",".join(sorted({f for _, _, f, _ in sure}))
            yield len(sure), families, listed(sure), max((p for *_, p in sure), default=0.0), listed(unsure), listed(identifiers(text))

    columns = [("n_notices", "long"), ("families", "string"), ("spans", "string"), ("probability", "double"), ("unconfirmed", "string"), ("spdx", "string")]
    return per_text(docs, columns, rows, carry)
