"""Licence scans: known sentences, ordered rules, and odd rows."""

import pytest

from holdfast.llm import licenses as L


@pytest.mark.parametrize(("text", "want"), [
    ("Text. This work is licensed under the GNU General Public License, version 3.\nMore", ["GPL-3"]),
    ("Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.", ["Apache-2.0"]),
    ("Licensed under the Apache License,\nVersion 2.0.\nall rights reserved", ["Apache-2.0", "All-rights-reserved"]),
    ("Licensed under the Apache License,\nbut not today. Released under the MIT License.", ["MIT"]),
    ("LICENSED UNDER CC BY-NC 4.0!", ["CC-BY-NC-4.0"]),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
     ["sentence:mit-notice"]),
    ("the license is long and the permission short", []), ("", [])])
def test_scan(text, want):
    found = L.scan(text)
    assert [x for x, _, _ in found] == want
    assert all(text[a:b] == text[a:b].strip() and a < b for _, a, b in found)


def _text(key):
    return L.SENTENCES[key][0]


@pytest.mark.parametrize(("licence", "keys"), L.RULES)
def test_every_rule(licence, keys):
    text = ". Words between them. ".join(_text(k) for k in keys) + "."
    (found, start, end), = L.scan(text)
    assert found.split("-")[0] == licence.split("-")[0] and (start, text[end - 1]) == (0, _text(keys[-1])[-1] if _text(keys[-1])[-1] != ":" else ":")
    if len(keys) > 1:
        far = (". One. Two. Three. ").join(_text(k) for k in keys) + "."
        assert len(L.scan(far)) > 1


def test_query(spark):
    rows = [(1, "Licensed under CC0 1.0.", "a"), (1, "Licensed under CC0 1.0.", "a"), (None, None, None), (2, "", "b"),
            (3, "licens " * 200_000 + ". Released under the MIT License.", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    got = sorted((str(r["doc_id"]), r["n_found"], r["licenses"]) for r in L.license_scan(df, ["doc_id", "licenses"]).collect())
    assert got == [("1", 1, "CC0-1.0"), ("1", 1, "CC0-1.0"), ("2", 0, ""), ("3", 1, "MIT"), ("None", 0, "")]
    assert L.license_scan(df.limit(0), ["doc_id"]).count() == 0


GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""


@pytest.mark.parametrize("form", [
    lambda t: t, lambda t: " ".join(t.split()), lambda t: "\n".join("# " + x for x in t.split("\n")),
    lambda t: "/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */", lambda t: "\n".join(t.split(" ")),
    lambda t: "Some Licence\n\nCopyright (c) 2020 Jo Doe\n\n" + t.replace("\n", "\r\n") + "\n\nTHE SOFTWARE IS PROVIDED AS IS."])
@pytest.mark.parametrize(("text", "want"), [
    (GRANT, "MIT"), (BSD2, "BSD-2-Clause"), (BSD3.format("the copyright holder"), "BSD-3-Clause"),
    (BSD3.format("Jo Doe and Sons"), "BSD-3-Clause"),
    (GPL.format(":", ",", 3), "GPL-3"), (GPL.format(";", ";", 2), "GPL-2"), (APACHE, "Apache-2.0")])
def test_whole_licence_texts(text, want, form):
    text = form(text)
    (found, start, end), = L.scan(text)
    assert found == want and end - start > 0.5 * len(text) - 60


def test_a_holder_that_ends_in_a_full_stop():
    assert [x for x, _, _ in L.scan(BSD3.format("Jo Inc."))] == ["BSD-3-Clause"]
