import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import licenses
from quillspark.llm.licenses import scan_licences


def test_own_and_inherited(spark, odd, empty):
    rows = [
        (1, "r/LICENSE", "Copyright 2020 x\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."), (2, "r/a/b/x.py", "code"), (3, "r/a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        (4, "r/a/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (5, "r/a/z.py", None), (6, "other/z.py", "no word of it"), (7, None, "licensed to nobody at all by any means whatsoever"), (8, "r/c/LICENSE", "nothing"), (9, "r/c/q.py", "x"), (9, "r/c/q.py", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = Counter((r["doc_id"], r["own"], r["licence"], r["from_dir"]) for r in scan_licences(df, F.col("path"), F.col("path").endswith("LICENSE")).collect())
    assert got == Counter(
        {(1, "MIT", "MIT", None): 1, (2, None, "GPL-3.0", "r/a"): 1, (3, "Apache-2.0", "Apache-2.0", None): 1, (4, "GPL-3.0", "GPL-3.0", None): 1, (5, None, "GPL-3.0", "r/a"): 1, (6, None, None, None): 1, (7, None, None, None): 1, (8, None, "MIT", "r"): 1, (9, None, "MIT", "r"): 2}
    )
    tree = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.col("doc_id").cast("string"))
    got = {r["doc_id"]: r["own"] for r in scan_licences(odd, tree, F.lit(False)).collect()}
    assert got[8] == "CC-BY-NC-4.0" and sum(v is not None for v in got.values()) == 1
    assert scan_licences(empty, tree, F.lit(None).cast("boolean")).count() == 0


GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY.

import os
"""
APACHE = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n"
ISC = "/*\n * Copyright (c) 2020 A. Person\n *\n * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided that the above\n * copyright notice and this permission notice appear in all copies.\n */\nint x;\n"


def plain_scores(texts):
    """The best template of each text by dense arithmetic."""
    words = lambda x: Counter(re.findall(licenses.TOKEN, x.lower()))
    units, of = [], []
    for i, t in enumerate(texts):
        bare = re.sub(licenses.COMMENT.replace("(?m)", ""), "", t, flags=re.M)
        said = [x for x in re.split(r"\n|(?<=[.;!?])\s+", t) + re.split(r"\n[ \t\r]*\n", bare) if re.search(licenses.HINT, x)]
        for x in dict.fromkeys(said):
            units.append(words(x))
            of.append(i)
    templates = [(name, words(x)) for name, xs in licenses.TEMPLATES.items() for x in xs]
    df = Counter(w for u in [*units, *(x for _, x in templates)] for w in u)
    n = len(units) + len(templates)
    vector = lambda u: {w: k * (math.log((1 + n) / (1 + df[w])) + 1) for w, k in u.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    ready = [(name, vector(x)) for name, x in templates]
    best = {}
    for i, u in zip(of, map(vector, units)):
        for name, v in ready:
            score = sum(x * v.get(w, 0) for w, x in u.items()) / (norm(u) * norm(v))
            best[i] = max(best.get(i, (0, "")), (round(score, 6), name))
    return {i: x for i, x in best.items() if x[0] >= 0.7}


def test_published_headers_and_heads(spark):
    texts = [GPL, APACHE, ISC, "plain prose without any of it", "We sell a licence to fish.\n\nCall now.", GPL.replace("version 3", "version 2").replace("software:", "software;"), "Licensed under the MIT license.", "x\n" * 50 + "SPDX-License-Identifier: Apache-2.0", ""]
    df = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["score"], r["own"]) for r in scan_licences(df, F.col("path"), F.lit(False)).collect() if r["own"]}
    want = plain_scores(texts)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(got[k][0] == pytest.approx(want[k][0], abs=2e-6) for k in want)
    assert {k: got[k][1] for k in (0, 1, 2, 5, 6, 7)} == {0: "GPL-3.0", 1: "Apache-2.0", 2: "ISC", 5: "GPL-2.0", 6: "MIT", 7: "Apache-2.0"} and not {3, 4, 8} & set(got)
