"""Licenses that look like each other, and whole texts."""

from loomtext.llm import licenses

GNU = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
CASES = {
    "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0-line"},
    "This work is licensed under the GNU General Public License, version 3.": {"GPL-3.0-line"},
    "This work is licensed under the GNU Affero General Public License, version 3.": {"AGPL-3.0-line"},
    "This work is licensed under the GNU Lesser General Public License, version 2.1.": {"LGPL-2.1-line"},
    "This work is licensed under the GNU General Public License, version 7.": set(),
    GNU.format("library", "Lesser "): {"LGPL-notice"},
    GNU.format("program", ""): {"GPL-notice"},
    GNU.format("program", "Affero "): {"AGPL-notice"},
    GNU.format("program", "") + "; either version 2 of the License, or (at your option) any later version.": {"GPL-2.0-notice"},
    "Licensed under CC BY-NC-SA 4.0.": {"CC-BY-NC-SA-4.0-line"},
    "Licensed under CC BY-SA 4.0.": {"CC-BY-SA-4.0-line"},
    "Licensed under CC BY-NC 4.0.": {"CC-BY-NC-4.0-line"},
    "Licensed under CC BY-NC 3.0.": set(),
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": {"CC-BY-SA-4.0-name"},
}


def test_look_alikes_and_whole_texts(spark):
    cases = list(CASES.items())
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "zlib"):
        words = licenses.TEMPLATES[name].split()
        # Changed words along the way: a place inserted, a place dropped.
        cases.append((" ".join(words[:40] + ["really"] + words[40:60] + words[61:]), {name}))
    docs = spark.createDataFrame([(i, f"as was said before. {t} so far and on") for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {i: set() for i in range(len(cases))}
    for r in licenses.license_spans(docs).collect():
        got[r.doc_id].add(r.license)
    assert got == {i: want for i, (_, want) in enumerate(cases)}
