import math
import re
from pathlib import Path

from pyspark.sql import functions as F

from rulesieve.llm import licences

FILES = "doc_id bigint, path string, text string, licence string, own_score double"


def _scan(spark, rows):
    return {r["doc_id"]: r for r in licences.scan(spark.createDataFrame([(*r, "x", 0.5) for r in rows], FILES)).collect()}


def _brute(text):
    rows, idf, unknown = licences.weights()
    best = (0.0, None)
    for passage in re.sub(r"([.!?])[ \t\r\n]+", r"\1\n", text).split("\n"):
        if re.search(licences.NEGATED, passage):
            continue
        terms = [t for t in re.findall(licences._TERM, passage.lower().replace("spdx-license-identifier: ", "spdx-license-identifier.")) if t not in licences.STOP]
        w = {t: terms.count(t) * idf.get(t, unknown) for t in terms}
        length = math.sqrt(sum(x * x for x in w.values()))
        for name, k in {(r[0], r[1]) for r in rows}:
            c = sum(w.get(t, 0) * v for n, j, t, v in rows if (n, j) == (name, k)) / length if length else 0
            if c >= licences.LEAST and (-round(c, 6), name) < (-best[0], best[1] or "~"):
                best = (round(c, 6), name)
    return best[1], best[0] or None


def test_same_as_brute_force(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "x y. released under the mit license!", "This work is licenced under GPL", "// Licensed under the BSD 3-Clause License.\ncode", "Licensed under CC BY-NC 4.0.", "mit dem Licht", "public license", "", "Licensed\tunder CC BY-SA 4.0. And more text",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3.", "License license LICENSE", "This is free and unencumbered software released into the public domain. " * 300, "a " * 20000 + "Released under the ISC License."]
    got = _scan(spark, [(i, f"p/{i}.txt", t) for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        assert (got[i]["own_licence"], got[i]["own_score"]) == _brute(t), t[:60]


def test_anchors_drop_nothing():
    rows, _, _ = licences.weights()
    own = set(licences.anchors())
    for key in {(r[0], r[1]) for r in rows}:
        assert math.sqrt(sum(r[3] ** 2 for r in rows if (r[0], r[1]) == key and r[2] not in own)) < licences.LEAST


def test_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c/x.py", "code"), (3, "a/b/COPYING.txt", gpl), (4, "a/y.py", "code"), (5, "z/q.py", "code"), (6, "a/b/own.py", "Licensed under CC0 1.0."), (7, None, "code"), (8, "top.py", None), (9, "a/b/c/x.py", "code"), (None, "a/n.py", "code"), (10, "a/license-notes/x", "code"), (11, "a/LICENSE", "nothing")]
    got = _scan(spark, rows)
    told = {k: (r["licence"], r["origin"], r["licensed_by"]) for k, r in got.items()}
    assert told[2] == told[9] == ("GPL-3.0", "inherited", "a/b") and told[4] == told[None] == told[10] == told[11] == ("MIT", "inherited", "a")
    assert told[6] == ("CC0-1.0", "own", None) and told[5] == told[7] == told[8] == (None, "none", None)
    root = _scan(spark, [(1, "LICENSE", mit), (2, "a/b.py", ""), (3, "c.py", None)])
    assert root[2]["licence"] == root[3]["licence"] == "MIT" and root[2]["licensed_by"] == ""
    assert _scan(spark, []) == {}


def test_query_of_documents(docs):
    mit, gpl, long = "Released under the MIT License.", "SPDX-License-Identifier: GPL-3.0-or-later", "w " * 300
    rows = [(1000, mit), (1010, long), (1011, gpl), (1012, long), (2100, None), (2110, gpl + "\n" + long), (2113, long), (2113, long), (3, None), (None, mit), (2120, long)]
    tree = docs(rows).withColumn("source", F.lit("s"))
    got = sorted((str(r["doc_id"]), r["path"], r["licence"], r["origin"], r["licensed_by"]) for r in licences.query(tree).collect())
    inherited = [("1010", "s/1/LICENSE.1010", "MIT", "inherited", "s"), ("1012", "s/1/2/1012.txt", "MIT", "inherited", "s"), ("2100", "s/LICENSE.2100", "MIT", "inherited", "s"), ("2113", "s/2/3/2113.txt", "GPL-3.0", "inherited", "s/2"), ("2113", "s/2/3/2113.txt", "GPL-3.0", "inherited", "s/2")]
    inherited += [("2120", "s/2/LICENSE.2120", "GPL-3.0", "inherited", "s/2"), ("3", "s/0/3/3.txt", "MIT", "inherited", "s")]
    own = [("1000", "s/LICENSE.1000", "MIT", "own", None), ("1011", "s/1/1/1011.txt", "GPL-3.0", "own", None), ("2110", "s/2/LICENSE.2110", "GPL-3.0", "own", None)]
    assert [r for r in got if r[0] != "None"] == sorted(inherited + own) and len(got) == len(rows)


def test_notices_are_told_rightly(spark):
    rows = {
        1: ("GPL-3.0", " ".join(GPL3[:4])),
        2: ("GPL-3.0", "\n".join(GPL3[:4])),
        3: ("MIT", "// SPDX-License-Identifier: MIT\ncode"),
        4: ("LGPL-2.1", "# SPDX-License-Identifier: LGPL-2.1-or-later"),
        5: ("ISC", licences._ISC),
        6: ("BSD-2-Clause", licences._BSD + licences._BSD_END),
        7: ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n"),
        8: (None, "This software is not released under the MIT License."),
        9: (None, "It isn't licensed under the Apache License, Version 2.0."),
        10: ("MIT", "It is not covered by the ISC License. Released under the MIT License."),
        13: (None, "Mit!! ENBE!! MIT!! Mit. mit"),
        14: ("MIT", "/* spdx-license-identifier:mit */"),
        11: ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."),
        12: (None, "license " + "word" * 300_000 + " other" * 50_000),
    }
    got = _scan(spark, [(i, f"p/{i}.c", t) for i, (_, t) in rows.items()])
    assert {i: r["own_licence"] for i, r in got.items()} == {i: x for i, (x, _) in rows.items()}


GPL3 = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version.", "", "This program is distributed in the hope that it will be useful,", "but WITHOUT ANY WARRANTY; without even the implied warranty of", "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the", "GNU General Public License for more details."]
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"


def test_wrapped_headers(spark):
    code = "\nint main(void) { return 0; }\n"
    apache = ["Copyright 2020 The Authors", "", 'Licensed under the Apache License, Version 2.0 (the "License");', "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at", "", "    http://www.apache.org/licenses/LICENSE-2.0"]
    rows = {
        1: ("GPL-3.0", "".join(f"# {x}\n" for x in ["Copyright (C) 2020 A. Body", "", *GPL3]) + "import os\n"),
        2: ("GPL-3.0", "/*\n" + "".join(f" * {x}\n" for x in GPL3) + " */" + code),
        3: ("GPL-2.0", "/*\r\n" + "".join(f"   {x}\r\n" for x in GPL3).replace("version 3", "version 2") + "*/" + code),
        4: ("LGPL-2.1", "".join(f"// {x}\n" for x in GPL3).replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1") + code),
        5: ("Apache-2.0", "".join(f"// {x}\n" for x in apache) + "package main\n"),
        6: ("MIT", MIT),
        7: ("MIT", "-- " + MIT.replace("Software is", "Software\n-- is").replace("rights to", "rights\n-- to")),
        8: ("GPL-3.0", "This work is licensed under the GNU\nGeneral Public License,\nversion 3.\n" + code),
        9: (None, "The general public may read this document without charge.\n" + code),
    }
    got = _scan(spark, [(i, f"p/{i}.c", t) for i, (_, t) in rows.items()])
    assert {i: r["own_licence"] for i, r in got.items()} == {i: x for i, (x, _) in rows.items()}


def test_whole_licence_files(spark):
    texts = {p.name.removesuffix(".txt"): p.read_text() for p in (Path(licences.__file__).parent / "licence_texts").glob("*.txt")}
    mit = "The MIT License (MIT)\n\nCopyright (c) 2015 A. Body\n\n" + licences._MIT.replace(" rights ", " rights\n") + "\n\n" + licences._MIT_END.replace("Software. THE", "Software.\n\nTHE")
    texts |= {"MIT": mit, "ISC": "ISC License\n\nCopyright (c) 2020, A. Body\n\n" + licences._ISC + "\n\n" + licences._ISC_END, "BSD-2-Clause": "Copyright (c) 2020, A. Body\nAll rights reserved.\n\n" + licences._BSD.replace(" 1. ", "\n\n1. ") + "\n\n" + licences._BSD_END}
    names = sorted(texts)
    rows = [(i, f"{n}/LICENSE", texts[n]) for i, n in enumerate(names)] + [(100 + i, f"{n}/src/x.c", "code") for i, n in enumerate(names)]
    rows += [(200 + i, f"{n}/y.c", "".join(f" * {x}\n" for x in ["Copyright 2021 Somebody Else", "", *texts[n].splitlines()])) for i, n in enumerate(names)]
    got = _scan(spark, rows)
    for i, n in enumerate(names):
        assert [(got[k + i]["licence"], got[k + i]["origin"]) for k in (0, 100, 200)] == [(n, "own"), (n, "inherited"), (n, "own")], (n, got[i], got[200 + i])


def test_long_anchors_drop_nothing():
    rows, _, _ = licences.weights(licences.long_templates())
    own = set(licences.long_anchors())
    for key in {(r[0], r[1]) for r in rows}:
        assert math.sqrt(sum(r[3] ** 2 for r in rows if (r[0], r[1]) == key and r[2] not in own)) < licences.LEAST


def test_long_texts_take_linear_time(spark):
    texts = ["\n" * 200_000 + "license", "# license\n\n" * 10_000, "/* " * 50_000 + "license", "* * *\n" * 50_000]
    assert {r["own_licence"] for r in _scan(spark, [(i, f"{i}", t) for i, t in enumerate(texts)]).values()} == {None}
