"""Licence scans by sentence rules.

A text is cut into sentences, at colons and semicolons too; a line break ends one as well, unless what
stands before it can be the beginning of a known sentence: then the longest known one from there on is
taken. Sentences are normalised: lower case, words and numbers only, every
number a ``#``. A sentence known by its normalised form has an identifier, and its last number is the
version. The sequence of identifiers is matched from left to right against ordered rules, the longest
that fits first; up to ``GAP`` unknown sentences may lie between those of a rule. A known sentence
that no rule takes is reported on its own.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from holdfast.llm.frames import map_texts

# Sentences by which licences are granted, as they are written, whole and cut short. Numbers stand for any.
SENTENCES = {
    "apache-under": ["Licensed under the Apache License, Version 2.0",
                     "Licensed under the Apache License, Version 2.0 (the \"License\")",
                     "This work is licensed under the Apache License, Version 2.0"],
    "apache-only-in-compliance": ["you may not use this file except in compliance with the License"],
    "apache-as-is": ["software distributed under the License is distributed on an \"AS IS\" BASIS",
                     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
                     "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
                     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
                     "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "gpl-under": ["This work is licensed under the GNU General Public License, version 3",
                  "Licensed under the GNU General Public License, version 3",
                  "Released under the GNU General Public License, version 3"],
    "gpl-free": ["This program is free software"],
    "gpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                  "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
                  "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by "
                  "the Free Software Foundation",
                  "you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published "
                  "by the Free Software Foundation",
                  "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                  "the Free Software Foundation, version 3 of the License"],
    # A semicolon may stand before the version.
    "gpl-published": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                      "the Free Software Foundation"],
    "gpl-version": ["either version 2 of the License, or (at your option) any later version", "version 2 of the License",
                    "either version 2, or (at your option) any later version", "version 2"],
    "gpl-no-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
                        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY, without even the "
                        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "mit-under": ["Released under the MIT License", "Licensed under the MIT License", "This work is licensed under the MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
                  "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                  "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                  "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
                  "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial "
                   "portions of the Software",
                   "The above copyright notice and this permission notice (including the next paragraph) shall be included in all "
                   "copies or substantial portions of the Software"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                  "the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice",
                   "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                   "following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice",
                   "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
                   "following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse",
                    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                    "products derived from this software without specific prior written permission",
                    "Neither the name of the copyright holder nor the names of the contributors may be used to endorse or promote "
                    "products derived from this software without specific prior written permission",
                    "Neither the names of the copyright holders nor the names of their contributors may be used to endorse or promote "
                    "products derived from this software without specific prior written permission",
                    # A name may end in a full stop: then this is left of the sentence.
                    "nor the names of its contributors may be used to endorse or promote products derived from this software without "
                    "specific prior written permission",
                    "The name of the author may not be used to endorse or promote products derived from this software without "
                    "specific prior written permission"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0"],
    "cc-zero": ["Licensed under CC0 1.0", "This work is dedicated to the public domain under CC0 1.0"],
    "reserved": ["All rights reserved"],
}
# Rules as sequences of those identifiers; {} is the version of the sentence it stands for.
RULES = [
    ("GPL-{}", ["gpl-free", "gpl-terms", "gpl-no-warranty"]), ("GPL-{}", ["gpl-free", "gpl-terms"]), ("GPL-{}", ["gpl-under"]),
    ("GPL-{}", ["gpl-free", "gpl-published", "gpl-version", "gpl-no-warranty"]), ("GPL-{}", ["gpl-free", "gpl-published", "gpl-version"]),
    ("Apache-{}", ["apache-under", "apache-only-in-compliance", "apache-as-is"]),
    ("Apache-{}", ["apache-under", "apache-only-in-compliance"]), ("Apache-{}", ["apache-under"]),
    ("MIT", ["mit-grant", "mit-notice"]), ("MIT", ["mit-grant"]), ("MIT", ["mit-under"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("CC-BY-{}", ["cc-by"]), ("CC-BY-SA-{}", ["cc-by-sa"]), ("CC-BY-NC-{}", ["cc-by-nc"]), ("CC0-{}", ["cc-zero"]),
    ("All-rights-reserved", ["reserved"]),
]
GAP = 2

_TERM = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*|[^\W\d_]+")
_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CUT = re.compile(r"[.!?;:](?=\s|\Z)|\n")
# Whoever the holder is, by up to a dozen words; and the beginning of such a sentence.
_HOLDER = re.compile(r"^((?:# )?neither the names? of) (?:\S+ ){1,12}?nor\b")
_OPEN_HOLDER = re.compile(r"neither the names? of(?: (?!nor\b)\S+){0,12}")


def normal(sentence: str) -> str:
    """Lower-cased words and numbers, one space between, numbers as #; without the holder's name where contributors follow."""
    return _HOLDER.sub(r"\1 nor", " ".join("#" if t[0].isdigit() else t for t in _TERM.findall(sentence.lower())))


KNOWN = {normal(s): key for key, forms in SENTENCES.items() for s in forms}
_BEGINNINGS = {" ".join(words[:k]) for s in KNOWN for words in [s.split()] for k in range(1, len(words))}
# Too common to be reported where no rule takes them.
_PARTS = {"gpl-version"}
_LONGEST = max(map(len, KNOWN))
# Every known sentence has one of these, so a text without any holds none.
_TRACES = ("licens", "permission", "permitted", "redistribution", "free software", "rights reserved", "program is", "cc0",
           "nor the names", "neither the name")
assert all(any(t in s.lower() for t in _TRACES) for key, forms in SENTENCES.items() if key not in _PARTS for s in forms)
_ORDERED = sorted(RULES, key=lambda r: -len(r[1]))

Sentence = tuple[str | None, str, int, int]


def sentences(text: str) -> list[Sentence]:
    """(identifier or None, version, start, end) of every sentence that has words, in code points."""
    out: list[Sentence] = []
    ends = [(m.start(), m.end(), m[0] == "\n") for m in _CUT.finditer(text)] + [(len(text), len(text), False)]
    start = k = 0
    while k < len(ends):
        best, at = None, k
        while at < len(ends):
            stop, _, broken = ends[at]
            key = normal(text[start:stop]) if stop - start <= 4 * _LONGEST else "?"
            if at == k:
                own = key
            if key in KNOWN:
                best = at
            if not (broken and key and (key in _BEGINNINGS or _OPEN_HOLDER.fullmatch(key))):
                break
            at += 1  # may go on in the next line
        last = k if best is None else best
        body = text[start:ends[last][0]]
        if own:
            out.append(_one(own if best is None else normal(body), body, start + len(body) - len(body.lstrip()),
                            start + len(body.rstrip())))
        start, k = ends[last][1], last + 1
    return out


def _one(key: str, body: str, start: int, end: int) -> Sentence:
    found = KNOWN.get(key)
    numbers = _NUMBER.findall(body) if found else []
    return found, numbers[-1] if numbers else "", start, end


def match(found: Sequence[Sentence]) -> list[tuple[str, int, int]]:
    """(licence, start, end), from left to right: the longest rule from each known sentence on."""
    out, k = [], 0
    while k < len(found):
        if found[k][0] is None:
            k += 1
            continue
        for licence, wanted in _ORDERED:
            at, used = k, []
            for key in wanted:
                room = range(at, min(len(found), at + (GAP + 1 if used else 1)))
                hit = next((j for j in room if found[j][0] is not None), None)
                if hit is None or found[hit][0] != key:
                    break
                used.append(hit)
                at = hit + 1
            else:
                version = next((found[j][1] for j in used if found[j][1]), "")
                out.append((licence.format(version).rstrip("-"), found[used[0]][2], found[used[-1]][3]))
                k = used[-1] + 1
                break
        else:
            if found[k][0] not in _PARTS:
                out.append((f"sentence:{found[k][0]}", found[k][2], found[k][3]))
            k += 1
    return out


def scan(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    return match(sentences(text)) if any(t in low for t in _TRACES) else []


def license_scan(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` of each row, ``n_found``, ``licenses`` (distinct, sorted, joined by commas) and ``spans``.

    One row for each row of ``docs``. NULL and empty texts hold none: 0 and empty strings. Spans are
    ``licence:start:end`` in code points, end exclusive, in the order of the text.
    """
    def work(column: pa.Array):
        found = [scan(t or "") for t in column.to_pylist()]
        return [pa.array(np.array([len(f) for f in found], np.int64)),
                pa.array([",".join(sorted({x for x, _, _ in f})) for f in found], pa.string()),
                pa.array([",".join(f"{x}:{a}:{b}" for x, a, b in f) for f in found], pa.string())]

    return map_texts(docs, text, keep, "n_found long, licenses string, spans string", work)
