"""The keyword gate loses no detection of any rule, and names in one word and SPDX forms are found."""

from __future__ import annotations

import re

from test_operators import docs

from weftlog.llm import licenses


def sample(regex, last=False):
    """A text that a rule's regex matches: the first or the last of alternatives, optional parts left out or in."""

    def walk(tree):
        out = ""
        for op, value in tree:
            op = str(op)
            if op == "LITERAL":
                out += chr(value)
            elif op == "SUBPATTERN":
                out += walk(value[3])
            elif op == "BRANCH":
                out += walk(value[1][-1 if last else 0])
            elif op == "MAX_REPEAT":
                out += walk(value[2]) * (min(int(value[1]), value[0] + 1) if last else value[0])
            elif op == "IN":
                out += chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])
            elif op == "NOT_LITERAL":
                out += "x"
        return out

    return walk(re._parser.parse(regex.removesuffix("(?= )"))).strip()


def test_gate_and_no_gate_agree(spark):
    rules = licenses.rules()
    texts = [sample(r[2], last) for r in rules for last in (False, True)]
    for (_, _, regex, keyword, _), a, b in zip(rules, texts[::2], texts[1::2], strict=True):
        assert re.search(regex, f" {a} ") and re.search(regex, f" {b} ") and keyword in a.split() and keyword in b.split()
    d = docs(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in licenses.scan(d).collect()}
    joined = spark.createDataFrame([(k, f" {t} ") for k, t in enumerate(texts)], "doc_id long, joined string").repartition(4)
    want = {k: set() for k in range(len(texts))}
    for r in licenses.detections(joined, ["doc_id"], gated=False).collect():
        want[r.doc_id].add((r.start, r.end, r.label))
    assert {k: {tuple(s) for s in r.spans} for k, r in got.items()} == want
    assert all(got[k].labels for k in want)


def test_short_forms(spark):
    forms = {
        "This module is Apache 2.0": "apache-2.0",
        "see mozilla 2.0": "mpl-2.0",
        "creative commons attribution 4.0": "cc-by-4.0",
        "3-clause BSD": "bsd-3-clause",
        "BSD 2-Clause": "bsd-2-clause",
        "NASA open source agreement 1.3": "nasa-1.3",
        "GPL 2.0": "gpl-2.0",
        "WTFPL": "wtfpl",
        "creative commons zero": "cc0",
        "GPLv3+": "gpl-3.0",
        "GNU LGPLv2.1": "lgpl-2.1",
        "under AGPLv3": "agpl-3.0",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "GPL-3.0": "gpl-3.0",
        "GPL 2.0 or later": "gpl-2.0",
        "GPL 3": "gpl-3.0",
        "GNU GPL v3": "gpl-3.0",
        "Apache License v2.0": "apache-2.0",
        "released under Apache 2.0": "apache-2.0",
        "GNU General Public License v2.0": "gpl,gpl-2.0",
        "EUPL-1.2": "eupl-1.2",
        "Creative Commons Attribution-ShareAlike 3.0 Unported": "cc-by-sa-3.0",
        "You should have received a copy of the GNU General Public License along with this program.": "gpl",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction": "mit",
        "Neither the name of Example Corp nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version": "gpl,lgpl-2.1",
        "All content is copyrighted": "copyright",
        "accept a rule of mit": "",
    }
    got = {r.doc_id: r for r in licenses.scan(docs(spark, list(enumerate(forms)))).collect()}
    assert {t: got[k].labels for k, t in enumerate(forms)} == forms
    assert next(r for k, r in got.items() if list(forms)[k].startswith("SPDX")).score == 1.0


def test_notices_choices_and_addresses(spark):
    forms = {
        "Affero GPL v3": "agpl-3.0",
        "Lesser GPL 2.1": "lgpl-2.1",
        "Apache-2.0 OR MIT": "apache-2.0,mit",
        "MIT or Apache 2.0": "apache-2.0,mit",
        "this code is MIT licensed": "mit",
        "License: MIT": "mit",
        "License: ISC": "isc",
        "released under the ISC terms": "isc",
        "BSD licensed": "bsd",
        "dual-licensed under the GPL": "gpl",
        "The New BSD License": "bsd-3-clause",
        "an apache helicopter in a mozilla": "",
        "licensed under Apache": "apache",
        "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa-4.0",
        "see http://creativecommons.org/publicdomain/zero/1.0/": "cc0-1.0",
        "https://opensource.org/licenses/MIT": "mit",
        "https://opensource.org/licenses/BSD-3-Clause": "bsd-3-clause",
        "https://www.gnu.org/licenses/gpl-3.0.html": "gpl-3.0",
        "https://www.gnu.org/licenses/old-licenses/lgpl-2.1.txt": "lgpl-2.1",
        "https://mozilla.org/MPL/2.0/": "mpl-2.0",
        "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
    }
    got = {r.doc_id: r.labels for r in licenses.scan(docs(spark, list(enumerate(forms)))).collect()}
    assert {t: got[k] for k, t in enumerate(forms)} == forms


def test_as_many_signatures_are_written_by_hand():
    assert len(licenses.SIGNATURES) + len(licenses.NOTICES) > 200
