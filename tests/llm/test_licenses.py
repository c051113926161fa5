"""The license classifier on wordings that it didn't learn, against a plain version that judges every passage, and on ordinary text."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from siftline.llm import license_scan as ls

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"
FILLER = "rain stays mainly on plains and hills of every kind with a project file from 2021 inc".split()
UNSEEN = ["we chose the {} for this package", "it may be copied under the conditions of the {}", "contributions are accepted under the {} only"]


@pytest.fixture(scope="module")
def model():
    return ls.train()


def unseen(names):
    rng = random.Random(3)
    for family in ls.TEMPLATES:
        for frame in UNSEEN:
            for name in names.get(family, []):
                yield family, " ".join(ls.varied([w for w, _, _ in ls.words_of(frame.format(name))], rng, FILLER))


def test_families_in_unseen_wordings(model):
    results = [(family, model.read(text)[0]) for family, text in unseen(ls.NAMES)]
    assert len(results) > 150
    right = [{f for _, _, f, _ in found} == {family} for family, found in results]
    assert np.mean(right) >= 0.85
    # what is reported is right
    assert np.mean([r for r, (_, found) in zip(right, results, strict=True) if found]) >= 0.98


def test_probabilities_are_calibrated(model):
    pairs = [(p, f == family) for family, text in unseen(ls.NAMES) for _, _, f, p in model.read(text)[0]]
    assert abs(np.mean([p for p, _ in pairs]) - np.mean([hit for _, hit in pairs])) <= 0.05


@pytest.mark.parametrize(
    ("text", "family"),
    [
        ("available under the MIT licence", "mit"),
        ("open source under the terms of Apache 2.0", "apache-2.0"),
        ("under version 2 of the GNU GPL", "gpl-2.0"),
        ("This library is MIT licensed.", "mit"),
        ("Boost Software License - Version 1.0", "bsl-1.0"),
        ("zlib license", "zlib"),
        ("made available under the Eclipse Public License v2.0", "epl-2.0"),
        ("Licensed under the WTFPL", "wtfpl"),
        ("Everything here is covered by the European Union Public Licence.", "eupl-1.2"),
    ],
)
def test_usual_wordings(model, text, family):
    assert {f for _, _, f, _ in model.read(text)[0]} == {family}


def test_mentions_are_no_notices(model):
    for text in ("The Apache 2.0 web server was fast", "MIT researchers found it", "sie ging mit ihm", "EPL", "her driving licence"):
        assert model.read(text)[0] == []


def test_a_prediction_without_a_template_is_reported_as_such(model):
    sure, unsure = model.read("The Apache 2.0 web server was fast")
    assert sure == []
    assert [f for _, _, f, _ in unsure] in ([], ["apache-2.0"])
    found = [model.read(text) for _, text in unseen(ls.SHORT_NAMES)]
    assert any(unsure and not sure for sure, unsure in found)


def test_passages_against_judging_every_window(model):
    """A window of any paragraph that the model takes for a notice touches a unit; none lies outside of all units."""
    texts = [t or "" for t in pq.read_table(DOCUMENTS).column("text").to_pylist()[:300]]
    texts += [text for _, text in unseen(ls.NAMES)][::5]
    windows = 0
    for text in texts:
        for _, paragraph in ls.paragraphs(text):
            names = [w for w, _, _ in ls.words_of(paragraph)]
            inside = np.zeros(len(names) + 20, bool)
            for start, stop, _, _ in model.units(names):
                inside[start:stop] = True
            for k in range(0, len(names), 10):
                if not inside[k : k + 20].any():
                    windows += 1
                    assert model.judge(names[k : k + 20]) == ls.UNKNOWN
    assert windows > 1000


def test_units_cover_known_words_and_every_run_lies_whole_in_one(model):
    names = ["license", *["rain"] * 30, *["license", "rain", "software"] * 300, *["rain"] * 50, "mit"]
    units = list(model.units(names))
    for k, w in enumerate(names):
        assert w == "rain" or any(a <= k < b for a, b, _, _ in units)
    long = [u for u in units if 31 <= u[0] + ls.GAP and u[1] <= 31 + 900 + ls.GAP]
    for k in range(31, 931 - ls.WINDOW):
        assert any(low <= k and k + ls.WINDOW <= high for _, _, low, high in long)


def test_several_notices_of_a_long_passage(model):
    rng = random.Random(5)
    names = [n for f in ("mit", "apache-2.0", "mpl-2.0", "lgpl", "epl-2.0", "odbl-1.0") for n in ls.NAMES[f][:1]]
    text = " ".join(f"Licensed under the {n}, as is the software of this project in its general {rng.choice(FILLER)} version." for n in names * 4)
    assert {f for _, _, f, _ in model.read(text)[0]} == {"mit", "apache-2.0", "mpl-2.0", "lgpl", "epl-2.0", "odbl-1.0"}
    assert len(model.read(text)[0]) == 24


def test_identifiers_have_columns_of_their_own(spark):
    docs = spark.createDataFrame([(1, "SPDX-License-Identifier: MIT"), (2, "Licensed under the MIT License"), (3, None), (4, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in ls.license_scan(docs).collect()}
    assert (rows[1]["n_notices"], rows[1]["spdx"], rows[1]["families"]) == (0, "mit:0:28", "")
    assert (rows[2]["n_notices"], rows[2]["spdx"], rows[2]["spans"]) == (1, "", "mit:0:30")
    assert (rows[3]["n_notices"], rows[3]["spans"], rows[4]["unconfirmed"]) == (0, "", "")
