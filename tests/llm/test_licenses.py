import math
import re
from collections import Counter

import pytest

from tallyloom.llm.licenses import CUES, TEMPLATES, scan

FILES = [
    ("a/LICENSE", "MIT License\n\nReleased under the MIT License."),
    ("a/src/x.py", "# nothing here\nprint(1)"),
    ("a/src/y.py", "# Licensed under the Apache License, Version 2.0.\nprint(2)\n" + "for every item in the list do this and that\n" * 3),
    ("a/lib/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    ("a/lib/deep/er/z.c", "int z;"),
    ("b/notes", "Licensed under CC BY-NC 4.0."),
    ("b/sub/text", "plain words"),
    ("c/text", "You need a driving licence and permission of the owner to go there with us today."),
    ("top", "no directory"),
    ("a", None),
    (None, "All rights reserved."),
    (None, ""),
    ("a/src/x.py", "# nothing here\nprint(1)"),
    ("abc/x", "plain"),
]


def normal(text):
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def brute(files):
    lines = [[normal(x) for x in re.split(r"\r\n|[\n\r\x0b\x0c\x85  ]", t or "") if re.search(CUES, x.lower())] for _, t in files]
    lines = [own + ([normal(t or "")] if p and re.search(r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$", p) else []) for (p, t), own in zip(files, lines)]
    distinct = {x for own in lines for x in own}
    templates = [(name, Counter(normal(t).split())) for name, t in TEMPLATES]
    df = Counter(w for x in distinct for w in set(x.split())) + Counter(w for _, t in templates for w in t)
    weigh = lambda c: {w: n * (1 + math.log((1 + len(distinct) + len(templates)) / (1 + df[w]))) for w, n in c.items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))

    def best(x):
        a, out = weigh(Counter(x.split())), []
        for name, t in templates:
            b = weigh(t)
            c = sum(a[w] * b.get(w, 0) for w in a) / (size(a) * size(b)) if a else 0
            if c >= 0.7:
                out.append((-round(c, 9), name))
        return min(out, default=None)

    return [min((b for x in own if (b := best(x))), default=None) for own in lines]


def test_own_licences_match_brute_force(spark):
    frame = spark.createDataFrame([(k, p, t, "r") for k, (p, t) in enumerate(FILES)], "k int, path string, text string, row string")
    got = {r.k: r for r in scan(frame, carry=("k",)).collect()}
    assert len(got) == len(FILES)
    for k, own in enumerate(brute(FILES)):
        assert (got[k].origin == "own") == (own is not None)
        if own:
            assert got[k].license == own[1] and got[k].score == pytest.approx(min(1, -own[0]))


def test_inheritance_from_the_nearest_directory(spark):
    frame = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(FILES)], "k int, path string, text string")
    got = {FILES[r.k]: (r.license, r.origin, r.from_dir) for r in scan(frame, carry=("k",)).collect()}
    assert got[FILES[1]] == ("MIT", "directory", "a")
    assert got[FILES[2]] == ("Apache-2.0", "own", None)
    assert got[FILES[4]] == ("GPL-3.0", "directory", "a/lib")
    assert got[FILES[6]] == ("CC-BY-NC-4.0", "directory", "b")
    assert all(got[FILES[k]] == (None, None, None) for k in (7, 8, 9, 11, 13))


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_wrapped_headers_identifiers_and_whole_texts(spark):
    mpl = "/* This Source Code Form is subject to the terms of the\n * Mozilla Public License, v. 2.0. If a copy of the MPL was\n * not distributed with this file, You can obtain one at\n * https://mozilla.org/MPL/2.0/. */\nint x = 1;\nint y = 2;"
    bsd = "# Redistribution and use in source and binary\n# forms, with or without modification, are\n# permitted provided that the following\n# conditions are met:\n\nrun()"
    mit = next(t for n, t in TEMPLATES if n == "MIT" and "NONINFRINGEMENT" in t).split()
    mit = "\n".join(" ".join(mit[k : k + 6]) for k in range(0, len(mit), 6))
    files = [("a/x.c", mpl), ("b/y.py", bsd), ("c/z.py", "# SPDX-License-Identifier: GPL-2.0-or-later\nrun()"), ("d/w.py", "# SPDX-License-Identifier: Zlib\nrun()"), ("e/text", mit), ("e/sub/code", "run()")]
    got = {r.path: (r.license, r.origin) for r in scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["a/x.c"] == ("MPL-2.0", "own") and got["b/y.py"] == ("BSD-3-Clause", "own")
    assert got["c/z.py"] == ("GPL-2.0", "own") and got["d/w.py"] == ("Zlib", "own")
    assert got["e/text"] == ("MIT", "own") and got["e/sub/code"] == ("MIT", "directory")
