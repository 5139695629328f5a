import random
import textwrap

import pytest
import zstandard

from docstruct.llm import licenses as m
from docstruct.llm.registry import op5_licenses
from tests.conftest import MEDIUM

STATED = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "proprietary"}


def scanned(text):
    return list(m.scan(text.encode(), m.compile_templates(), zstandard.ZstdCompressor(level=m.LEVEL)))


@pytest.mark.parametrize("name, text, keys", m.TEMPLATES)
def test_each_template_finds_itself(name, text, keys):
    for around in (text, f"Some words go first.\n{text}\nMore of them follow here.", text.upper()):
        assert [x.license for x in scanned(around)] == [name], around


def test_wording_differences():
    (x,) = scanned("intro\nThis work is licensed under the well known GNU General Public License, version 3.")
    assert (x.license, x.line, x.missing, x.extra) == ("GPL-3.0", 1, "", "well known")
    assert [x.license for x in scanned("This work is licensed under the GNU General Public License, version 2.")] == ["GPL-2.0"]
    (x,) = scanned(m.TEMPLATES[2][1].replace("merge, ", "").replace(" copy of this", "\ncopy of this"))
    assert (x.license, x.missing) == ("MIT", "merge")


@pytest.mark.parametrize("text", ["", "A driver must hold a license to drive on this road.", "The licensed dealer sold it under the MIT roof.", "copyright", "all rights", "They reserved all rights of way to the public."])
def test_clean_text(text):
    assert scanned(text) == []


def test_several_in_one_text():
    text = "\n".join([*STATED, "clean line"] * 3)
    assert [(x.license, x.line) for x in scanned(text)] == [(v, i + 6 * k) for k in range(3) for i, v in enumerate(STATED.values())]


PROSE = "The river rose in spring and the old mill stood under water for nine days before the men of the village came with carts to save what grain was left in it. "


@pytest.mark.parametrize("before, after", [(0, 0), (50, 0), (0, 50), (60, 0), (100, 100), (400, 0), (800, 800), (2000, 2000)])
@pytest.mark.parametrize("name, text, keys", m.TEMPLATES)
def test_prose_on_the_line(name, text, keys, before, after):
    line = f"{(PROSE * 14)[:before]}. {text} {(PROSE * 14)[:after]}"
    (x,) = scanned(line)
    assert (x.license, x.missing, x.extra) == (name, "", "") and text.rstrip(".,") == line.encode()[x.first_byte : x.last_byte].decode()


@pytest.mark.parametrize("name, text, keys", m.TEMPLATES)
def test_wrapped(name, text, keys):
    wrapped = textwrap.fill(f"{PROSE}{text} {PROSE}", 38, initial_indent=" # ", subsequent_indent=" # ")
    assert [x.license for x in scanned(wrapped)] == [name]


VARIANTS = {
    "licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1", "the GNU Library General Public License, version 2": "LGPL-2.0", "GNU General Public License version 3.0": "GPL-3.0", "under the GNU GPL v3": "GPL-3.0",
    "either version 2 of the License": None, "GNU General Public License, version 2.1": None, "the Apache License, Version 1.1": None, "MIT No Attribution License": None, "Licensed under CC BY-SA 3.0.": "CC-BY-SA-3.0", "CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "CC BY-NC-ND 4.0": "CC-BY-NC-ND-4.0",
    "a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License": "CC-BY-NC-ND-3.0", "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1", "SPDX-License-Identifier: AGPL-3.0-or-later": "AGPL-3.0-or-later", "available under the Apache-2.0 terms": "Apache-2.0",
    "the GNU General Public License, version 2 or any later version": "GPL-2.0-or-later",
    f"{m.BSD_OPENS}:\n * {m.BSD_SOURCE[3:]}\n * {m.BSD_BINARY[3:]}": "BSD-2-Clause", f"{m.BSD_OPENS}:\n * {m.BSD_SOURCE[3:]}\n * {m.BSD_BINARY[3:]}\n * {m.BSD_NAMES[3:].replace('the copyright holder', 'Some Company')}": "BSD-3-Clause",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "0BSD", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISC",
}


@pytest.mark.parametrize("text", VARIANTS)
def test_variants(text):
    for around in (text, f"{PROSE}{text} {PROSE}"):
        assert [x.license for x in scanned(around)] == [v for v in [VARIANTS[text]] if v]


def test_planted_against_brute_force(spark):
    rng = random.Random(5)
    words = PROSE.split()
    planted = [(k, v) for k, v in VARIANTS.items() if v] + [(t, n) for n, t, _ in m.TEMPLATES]
    docs, want = [], []
    for d in range(400):
        text = ""
        for k, name in rng.choices(planted, k=rng.randint(0, 5)):
            text += " ".join(rng.choices(words, k=rng.randint(0, 350))) + rng.choice([". ", "\n", " \n\n"])
            want.append((d, len(text.encode()), name))
            text += k + rng.choice([". ", "\n", ". \n"])
        docs.append((d, text))
    got = sorted((r.doc_id, r.first_byte, r.license) for r in m.find_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert [(d, n) for d, _, n in got] == [(d, n) for d, _, n in want]
    assert all(abs(a - b) < 60 for (_, a, _), (_, b, _) in zip(got, want, strict=True))


def test_several_on_one_line():
    text = PROSE.join(["", *STATED, ""])
    assert [x.license for x in scanned(text)] == [*STATED.values()]


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "All rights reserved.", 0), (3, "All rights reserved.", 0), (None, "x " * 300_000 + "\nReleased under the MIT License.", 0)], "doc_id long, text string, license int")
    assert sorted(str((r.doc_id, r.license)) for r in m.find_licenses(docs).collect()) == ["(3, 'proprietary')", "(3, 'proprietary')", "(None, 'MIT')"]
    assert m.find_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d.doc_id, i, STATED[x]) for d in docs for i, x in enumerate(d.text.split("\n")) if x in STATED)
    assert sorted((r.doc_id, r.line, r.license) for r in op5_licenses(spark, MEDIUM).collect()) == want
