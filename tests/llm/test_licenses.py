import random
import re

import numpy as np
import pytest
from fixtures import awkward, empty, prose

from grainsift.llm import licenses as L
from grainsift.llm._common import Words, rolling


def damaged(rng, text, share):
    return " ".join(w if rng.random() > share else "zz" for w in text.split())


def held(template, text):
    data = np.frombuffer(text.encode(), np.uint8)
    h = rolling(Words(data, np.array([0, len(data)])).hashes, L.SHINGLE)
    shingles = L.shingles_of(template)
    return len(shingles) and np.isin(shingles, h).mean()


def test_recall_and_precision(spark):
    rng = random.Random(2)
    rows, truth = [], set()
    for i in range(400):
        name = rng.choice(sorted(L.TEMPLATES))
        text = damaged(rng, L.TEMPLATES[name], rng.choice([0, 0, 0.02, 0.05, 0.3]))
        rows.append((i, prose(rng, rng.randint(0, 300)) + "\n" + text + "\n" + prose(rng, rng.randint(0, 300))))
        truth |= {(i, n) for n, t in L.TEMPLATES.items() if held(t, rows[-1][1]) >= L.CONTAINMENT}
    got = {(r["doc_id"], r["license"]) for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got & truth) >= 0.99 * len(truth)
    assert got <= truth


def test_bands_keep_their_promise():
    for s in L.Library(L.TEMPLATES).scales:
        assert L.collision(s.least_similarity(L.CONTAINMENT), L.ROWS, s.bands) >= L.RECALL
        assert s.blocks * s.step >= s.high + s.step  # an occurrence is whole in a window
    for wrong in ((2, 0.0, 0.99), (2, 1.1, 0.99), (2, 0.8, 1.0), (0, 0.8, 0.99)):
        with pytest.raises(ValueError, match="containment lies"):
            L.scales([5], *wrong)


def test_place(spark):
    text = "one two three " + L.TEMPLATES["MIT-short"] + " four"
    row = L.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["license"], row["containment"]) == ("MIT-short", 1.0)
    assert row["first_word"] <= 3 < row["first_word"] + 8


def test_awkward(spark):
    docs = awkward(spark)
    mit = docs.selectExpr("doc_id", f"concat(text, '\\n{L.TEMPLATES['MIT-short']}') text", "TOKENS license", "spans TEXT2")
    got = L.scan_licenses(mit).where("license = 'MIT-short'").collect()
    assert len(got) == mit.where("text is not null").count()
    assert L.scan_licenses(empty(spark)).count() == 0
    assert L.scan_licenses(docs, {"none": "", "two": "a b"}).count() == 0
    assert L.scan_licenses(docs, {}).count() == 0


def test_parts_of_a_large_library(spark, monkeypatch):
    monkeypatch.setattr(L, "TEMPLATE_BYTES", 300)
    docs = spark.createDataFrame([(1, "\n".join(L.TEMPLATES.values()))], "doc_id long, text string")
    assert {r["license"] for r in L.scan_licenses(docs).collect()} >= {n for n in L.TEMPLATES if "short" not in n}


NOTICES = {
    "GPL-short": r"GNU General Public License",
    "CC-BY-NC-short": r"CC BY-NC",
    "Rights-reserved-short": r"All rights reserved",
    "MIT-short": r"Released under the MIT License",
    "Apache-short": r"under the Apache License, Version 2\.0",
}


def test_recall_of_the_lines_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir[: -len('sf0.001')]}sf0.01/documents.parquet")
    truth = {(r["doc_id"], n) for r in docs.collect() for n, p in NOTICES.items() if re.search(p, r["text"])}
    assert {n for _, n in truth} == set(NOTICES)
    got = {(r["doc_id"], r["license"]) for r in L.scan_licenses(docs).collect()}
    assert len(got & truth) >= 0.98 * len(truth)
    assert {x for x in got if x[1] in NOTICES} <= truth


@pytest.mark.parametrize(
    ("line", "name"),
    [
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-short"),
        ("Licensed under the GNU Lesser General Public License v3.0.", "LGPL-short"),
        ("Distributed under the GNU Affero General Public License, version 3", "AGPL-short"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-short"),
        ("2020 Somebody. All rights reserved.", "Rights-reserved-short"),
        ("Released under the BSD 3-Clause License.", "BSD-3-Clause-short"),
        ("Licensed under the Mozilla Public License 2.0", "MPL-short"),
        ("Released under the Unlicense.", "Unlicense-short"),
        ("Licensed under the MIT License.", "MIT-licensed-short"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0-short"),
    ],
)
def test_short_notices(line, name):
    data = np.frombuffer(f"Some words before. {line} And some behind.".encode(), np.uint8)
    library = L.Library(L.TEMPLATES)
    assert {library.names[t] for _, t, *_ in L.scan(library, Words(data, np.array([0, len(data)])))} == {name}
