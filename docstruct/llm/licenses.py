"""License scans by conditional compression.

Candidate blocks lie around cue words (``CUES``): each template is laid over the words of the text so that one of its own cue
words meets the cue, once as long as the template and once a third longer on both sides. Nothing but the template's own
length bounds a block, so neither the length of a line nor what else stands on it counts. In lower case, a block that has
all key words of the template is compressed alone and with the template as a zstandard raw dictionary, and templates rank
by the bytes that their best block gets smaller. In rank order, a template that saves ``LEAST`` of a block is confirmed by
exact wording: its words are aligned with the block's, its key words and the cue must stand in the alignment, ``MISSING`` of
its words (one at least) may lack, and a word that tells another license (``TELLING``), or another version's number, must not
stand between or right after. The first confirmed template names the cue's license; of that license's confirmed templates the
one with most words there and fewest lacking tells what lacks and what lies between, and its bytes go from the first aligned
word to the last. Words of a confirmed statement are not looked at again.

Cases: null and empty texts hold no license; repeated rows are each reported; of templates that save as much the first
listed goes first; an empty table gives no rows; other columns are not read. Texts are scanned whole, however long they
or their lines are; words are runs of ASCII letters and digits, so a run without end is one word.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstruct.llm.common import arrow_map, batch, texts

LEAST, MISSING, LEVEL = 0.2, 0.15, 6
#: A shorter statement is no dictionary: its saving is lost in the frame of the compressed block.
LEAST_BYTES = 11
# Cues of license statements, words that tell a license from its neighbours, and statements with the key
# words that a block must have. Families with many members are made from these by rule.
CUES = re.compile(rb"\b(?:licen[sc]e[ds]?|unlicense|copyright|reserved|domain|commons|permission|redistribution|cc|cc0|gnu|[al]?gpl|[al]?gplv[123]|apache|mozilla|mpl|bsd|spdx)\b", re.I)
TELLING = frozenset(b"lesser library affero sa nc nd sharealike noncommercial noderivatives noderivs only later attribution neither advertising no not".split())
STATEMENTS = (
    ("MIT", "Released under the MIT License.", "mit license"),
    ("MIT", "Licensed under the MIT License.", "mit license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "permission granted free charge deal restriction sublicense"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache license 2"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache license 2 compliance"),
    ("Apache-2.0", "Licensed under Apache-2.0.", "apache 2 0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public license 2"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0.", "mozilla public license 2"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "bsd 3 clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", "bsd 2 clause"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "permission use distribute purpose fee granted provided notice appear copies"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission use distribute purpose fee granted"),
    ("ISC", "Licensed under the ISC License.", "isc license"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "free unencumbered public domain"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0.", "public domain cc0 1 0"),
    ("CC0-1.0", "Licensed under CC0 1.0.", "cc0 1 0"),
    ("proprietary", "All rights reserved.", "all rights reserved"),
)
BSD_OPENS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GNU = (("GPL", "", ("2.0", "3.0")), ("LGPL", "Library ", ("2.0",)), ("LGPL", "Lesser ", ("2.1", "3.0")), ("AGPL", "Affero ", ("3.0",)))
CC_KINDS = (("BY", "Attribution", ""), ("BY-SA", "Attribution-ShareAlike", "sharealike"), ("BY-NC", "Attribution-NonCommercial", "noncommercial"), ("BY-ND", "Attribution-NoDerivatives", "noderivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike", "noncommercial sharealike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives", "noncommercial noderivatives"))
OPENINGS = ("This work is licensed under the ", "This work is licensed under a ", "Licensed under the ", "Licensed under ", "Released under the ")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def _templates() -> tuple[tuple[str, str, str], ...]:
    out = list(STATEMENTS)
    opens, source, binary = "redistribution source binary modification conditions", "retain disclaimer", "reproduce materials"
    out += [("BSD-3-Clause", f"{BSD_OPENS}: {BSD_SOURCE} {BSD_BINARY} {BSD_NAMES}", f"{opens} {source} {binary} neither endorse promote"), ("BSD-2-Clause", f"{BSD_OPENS}: {BSD_SOURCE} {BSD_BINARY}", f"{opens} {source} {binary}"), ("BSD", BSD_OPENS, opens)]
    for name, kind, versions in GNU:
        for v in versions:
            said = v.removesuffix(".0")
            number, own = said.replace(".", " "), f"{kind.lower()}general public license"
            out += [
                (f"{name}-{v}", f"This work is licensed under the GNU {kind}General Public License, version {said}.", f"gnu {own} {number}"),
                (f"{name}-{v}-or-later", f"This work is licensed under the GNU {kind}General Public License, version {said} or any later version.", f"gnu {own} {number} later"),
                (f"{name}-{v}-or-later", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {said} of the License, or (at your option) any later version.", f"gnu {own} {number} later redistribute"),
            ]
            if kind != "Library ":
                out += [(f"{name}-{v}", f"Licensed under the {name} v{said}.", f"{name.lower()} v{number}"), (f"{name}-{v}", f"Licensed under the GNU {name}v{said}.", f"{name.lower()}v{number}"), (f"{name}-{v}", f"Licensed under the {name}, version {said}.", f"{name.lower()} version {number}"), (f"{name}-{v}", f"Licensed under {name}-{v}.", f"{name.lower()} {v.replace('.', ' ')}"), (f"{name}-{v}", f"under the GNU {name} v{said}", f"{name.lower()} v{number}"), (f"{name}-{v}", f"under the {name}v{said}", f"{name.lower()}v{number}")]
    for v in CC_VERSIONS:
        number = v.replace(".", " ")
        for short, title, told in CC_KINDS:
            out += [(f"CC-{short}-{v}", f"Licensed under CC {short} {v}.", f"cc {short.lower().replace('-', ' ')} {number}"), (f"CC-{short}-{v}", f"This work is licensed under a Creative Commons {title} {v} {'International' if v == '4.0' else 'Unported'} License.", f"creative commons attribution {told} {number}")]
            if short.endswith("ND") and v != "4.0":  # what older versions call it
                out.append((f"CC-{short}-{v}", f"This work is licensed under a Creative Commons {title.replace('NoDerivatives', 'NoDerivs')} {v} Unported License.", f"creative commons attribution {told.replace('noderivatives', 'noderivs')} {number}"))
    names = dict.fromkeys(n for n, _, _ in out if n not in ("BSD", "proprietary"))
    for n in names:
        marks = (f"{n}-only",) if "GPL" in n and not n.endswith("later") else ()
        out += [(n, f"SPDX-License-Identifier: {x}", f"spdx identifier {x.lower().replace('-', ' ').replace('.', ' ')}") for x in (n, *marks)]
    bare = []
    for n, text, keys in out:  # the same without their opening words
        rest = next((text.removeprefix(x) for x in OPENINGS if text.startswith(x)), "")
        if LEAST_BYTES <= len(rest) <= 100:
            bare.append((n, rest, keys))
    return tuple(dict.fromkeys(out + bare))


#: ``license, statement, key words``.
TEMPLATES = _templates()
_WORD = re.compile(rb"[^\W_]+")
FOUND = "doc_id long, line int, first_byte long, last_byte long, license string, saved double, missing string, extra string"
_FOUND = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("first_byte", pa.int64()), ("last_byte", pa.int64()), ("license", pa.string()), ("saved", pa.float64()), ("missing", pa.string()), ("extra", pa.string())])


class Match(NamedTuple):
    line: int
    first_byte: int
    last_byte: int
    license: str
    saved: float
    missing: str
    extra: str


class Template:
    """A statement as words and as a dictionary, which is made when it is first needed."""

    def __init__(self, name: str, text: str, keys: str):
        self.license, self.text = name, text.lower().encode()
        self.words = _WORD.findall(self.text)
        self.keys = frozenset(keys.encode().split())
        self.slack = max(2, len(self.words) // 3)
        self.cues: dict[bytes, list[int]] = {}
        for k, w in enumerate(self.words):
            if CUES.fullmatch(w):
                self.cues.setdefault(w, []).append(k)
        self.compressor: zstandard.ZstdCompressor | None = None

    def size(self, block: bytes) -> int:
        """Bytes of a block that is compressed with the statement as dictionary."""
        if self.compressor is None:
            given = zstandard.ZstdCompressionDict(self.text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            given.precompute_compress(level=LEVEL)
            self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=given, write_content_size=False, write_dict_id=False)
        return len(self.compressor.compress(block))


class Templates(NamedTuple):
    """Statements by the cue words that they hold, in listed order; ``reach`` is the bytes beside a cue that a block can need."""

    by_cue: dict[bytes, list[tuple[int, Template]]]
    reach: int


def compile_templates(templates: tuple = TEMPLATES) -> Templates:
    by_cue: dict[bytes, list[tuple[int, Template]]] = {}
    made = [Template(*t) for t in templates]
    for k, t in enumerate(made):
        if not t.cues:
            raise ValueError(f"a statement without a cue word: {t.text.decode()}")
        for w in t.cues:
            by_cue.setdefault(w, []).append((k, t))
    return Templates(by_cue, 2 * max(len(t.text) for t in made))


class Around:
    """The words from ``reach`` before a cue, but not before ``done``, to ``reach`` behind it, in lower case with their places.

    A word that the edge cuts is left out.
    """

    def __init__(self, text: bytes, cue: int, done: int, reach: int):
        lo, hi = max(done, cue - reach), min(len(text), cue + reach)
        places = [(m.start() + lo, m.end() + lo, m[0]) for m in _WORD.finditer(text[lo:hi].lower())]
        if places and places[0][0] == lo > done and _WORD.match(text, lo - 1):
            places = places[1:]
        if places and places[-1][1] == hi < len(text) and _WORD.match(text, hi):
            places = places[:-1]
        self.words = [w for _, _, w in places]
        self.starts, self.ends = [a for a, _, _ in places], [b for _, b, _ in places]
        self.at = bisect_left(self.starts, cue)
        self.held = frozenset(self.words)


def wording(t: Template, text: bytes, around: Around, i: int, j: int) -> tuple[list[bytes], list[bytes], int, int] | None:
    """Words that lack, words between those that are there, first and last aligned word; None if not confirmed."""
    aligned = [b for b in SequenceMatcher(None, t.words, around.words[i:j], autojunk=False).get_matching_blocks() if b.size]
    if not aligned:
        return None
    there = {w for b in aligned for w in t.words[b.a : b.a + b.size]}
    lack, extra, at = [], [], 0
    for b in aligned:
        lack += t.words[at : b.a]
        at = b.a + b.size
    lack += t.words[at:]
    first, last = i + aligned[0].b, i + aligned[-1].b + aligned[-1].size - 1
    for a, b in zip(aligned, aligned[1:], strict=False):
        extra += around.words[i + a.b + a.size : i + b.b]
    if not t.keys <= there or len(lack) > max(1, int(MISSING * len(t.words))) or len(extra) > len(t.words) or TELLING.intersection(extra) or not first <= around.at <= last:
        return None
    for b in aligned:  # the number of another version: digits behind a point, that the statement does not go on with
        k = i + b.b + b.size
        if k < len(around.words) and around.words[k - 1].isdigit() and around.words[k].isdigit() and text[around.ends[k - 1] : around.starts[k]] == b"." and int(around.words[k][:9]):
            return None
    return lack, extra, first, last


def scan(text: bytes, templates: Templates, plain: zstandard.ZstdCompressor) -> Iterator[Match]:
    done = counted = lines = 0
    for cue in CUES.finditer(text):
        word = cue[0].lower()
        if cue.start() < done or word not in templates.by_cue:
            continue
        around = Around(text, cue.start(), done, templates.reach)
        if around.at >= len(around.words) or around.words[around.at] != word:
            continue  # a part of a word, such as one joined by an underscore
        ranked, alone = [], {}
        for k, t in templates.by_cue[word]:
            if not t.keys <= around.held:
                continue
            best, blocks = None, []
            for at in t.cues[word]:
                exact = around.at - at
                blocks += [(exact, exact + len(t.words)), (exact - t.slack, exact + len(t.words) + t.slack)]
            blocks = list(dict.fromkeys((max(0, i), min(len(around.words), j)) for i, j in blocks))
            for i, j in blocks:
                if not t.keys.issubset(around.words[i:j]):
                    continue
                if (i, j) not in alone:
                    block = text[around.starts[i] : around.ends[j - 1]].lower()
                    alone[i, j] = (block, len(plain.compress(block)))
                block, size = alone[i, j]
                saved = size - t.size(block)
                if saved >= LEAST * size:
                    best = max(best or (0, 0.0), (saved, saved / size))
            if best:
                ranked.append((*best, -k, t, blocks))
        found = None
        for _, share, _, t, blocks in sorted(ranked, key=lambda r: r[:3], reverse=True):
            if found is not None and t.license != found[1]:
                continue
            for i, j in blocks:
                if (x := wording(t, text, around, i, j)) is not None and (found is None or (len(t.words) - 3 * len(x[0]), -len(x[1])) > found[0]):
                    found = ((len(t.words) - 3 * len(x[0]), -len(x[1])), t.license, share, *x)
        if found is not None:
            _, name, share, lack, extra, first, last = found
            start, end = around.starts[first], around.ends[last]
            lines, counted = lines + text.count(b"\n", counted, start), start
            yield Match(lines, start, end, name, round(share, 4), b" ".join(lack).decode(), b" ".join(extra).decode())
            done = end


def find_licenses(docs: DataFrame, templates: tuple = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each license statement, with its line, byte range, saving and wording differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, plain = compile_templates(templates), zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        for b in batches:
            rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True) for m in scan(t, ready, plain)]
            if rows:
                yield batch(_FOUND, *zip(*rows, strict=True))

    return arrow_map(docs, run, FOUND, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
