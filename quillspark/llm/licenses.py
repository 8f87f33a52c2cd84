"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Candidates of a text are its sentences and lines that speak of licences, and its blocks that do:
lines up to an empty one, without the marks of comments. Each candidate and each
template is a sparse TF-IDF vector over all of its terms; document frequencies are counted
over all candidates and templates. Templates are headers, permission texts and heads of
licence files as their authors publish them, and short notices. The best template at
``threshold`` or more is the file's own licence. A licence file (by its name) gives its
licence to its directory; a file without a licence of its own takes that of the nearest
ancestor directory that has one.

DataFrame functions only. Scale: texts are read once without a shuffle; tokens of
candidates alone are shuffled, combined by file, candidate and term. Templates and their
frequencies are broadcast: their number is fixed by the ``templates`` argument. The
frequencies of all terms are sent within a size, and else meet the candidates' terms in a
shuffle. Inheritance joins distinct directories with the licences of directories on
paths, as deep as a path is, then files with their directory; files are salted there, as
one directory may hold a third of all.

Defined results: a null or empty text has no licence of its own; a null path is
the root's file; two licence files in a directory: the better score counts, then
the lesser name; of equal scores the name that sorts last is a file's own; repeated rows
are given back as often as they stand; an empty table gives an empty table; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.core import join_on, materialize, small_enough

TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
HINT = r"(?i)licen[cs]e|copyright|spdx|permission to use|permission is hereby|redistributions? |public domain|free software"
#: Marks of comments at the start of a line.
COMMENT = r"(?m)^[ \t]*(?:/\*+|\*+/|\*|//+|#+|--+|;+|<!--|%+|REM\b)?[ \t]*(?:-->)?"
SALTS = 16

#: Notices, headers and heads of licence files by licence (fixed values, as published).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "MIT License",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPL version 3.",
        "SPDX-License-Identifier: GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL-2.0": (
        "This source code form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "ISC License",
        "SPDX-License-Identifier: ISC",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
}


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _template_terms(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, int, str, int]]:
    """(licence, number of the template, term, times)."""
    rows = []
    for name, sentences in templates.items():
        for s in sentences:
            rows += [(name, len(rows), t, k) for t, k in Counter(re.findall(TOKEN, s.lower())).items()]
    return rows


def candidates(files: DataFrame) -> DataFrame:
    """(path, digest, at, said): sentences, lines and blocks of files (path, digest, t) that speak of licences, each once."""
    speaks = lambda x: x.rlike(HINT)
    plain = F.regexp_replace("t", COMMENT, "")
    sentences = F.filter(F.split("t", r"\n|(?<=[.;!?])\s+"), speaks)
    blocks = F.filter(F.split(plain, r"\n[ \t\r]*\n"), speaks)
    found = F.array_distinct(F.concat(sentences, blocks))
    return files.where(speaks(F.col("t"))).select("path", "digest", F.posexplode(found).alias("at", "said"))


def own_licences(files: DataFrame, templates: dict[str, tuple[str, ...]], threshold: float) -> DataFrame:
    """(path, digest, own, score) of files with a licence of their own. ``files``: path, digest, t."""
    spark = files.sparkSession
    words = candidates(files).select("path", "digest", "at", F.explode(tokens_of(F.col("said"))).alias("term"))
    words = materialize(words.groupBy("path", "digest", "at", "term").agg(F.count("*").alias("times")), "licence-words")
    rows = _template_terms(templates)
    vocabulary = sorted({t for _, _, t, _ in rows})
    of_templates = Counter(t for _, _, t, _ in rows)
    n = words.select("path", "digest", "at").distinct().count() + len({s for _, s, _, _ in rows})
    counted = words.groupBy("term").agg(F.count("*").alias("df"))
    df = of_templates + Counter({r["term"]: r["df"] for r in counted.where(F.col("term").isin(vocabulary)).collect()})  # a row a template term
    weight_of = lambda k: math.log((1 + n) / (1 + k)) + 1
    norm: Counter = Counter()
    for _, s, t, k in rows:
        norm[s] += (k * weight_of(df[t])) ** 2
    terms = spark.createDataFrame([(name, s, t, k * weight_of(df[t]) / math.sqrt(norm[s])) for name, s, t, k in rows], "licence string, sentence int, term string, weight double")
    more = spark.createDataFrame(list(of_templates.items()), "term string, more long")
    idf = counted.join(F.broadcast(more), "term", "left").select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df") + F.coalesce("more", F.lit(0)))) + 1).alias("idf"))
    idf = materialize(idf, "licence-idf")
    idf = F.broadcast(idf) if small_enough(spark, idf, 8 << 20) else idf
    weighted = words.join(idf, "term").withColumn("w", F.col("times") * F.col("idf"))
    # each term of a candidate meets the templates that have it; null: the candidate's length
    meets = F.broadcast(terms.unionByName(spark.createDataFrame([(None, None, "", 0.0)], terms.schema)))
    parts = weighted.withColumn("meet", F.explode(F.array("term", F.lit("")))).withColumnRenamed("term", "word").join(meets, F.col("meet") == meets["term"])
    sums = parts.groupBy("path", "digest", "at", "licence", "sentence").agg(F.sum(F.when(F.col("licence").isNull(), F.col("w") * F.col("w")).otherwise(F.col("w") * F.col("weight"))).alias("v"))
    each = sums.groupBy("path", "digest", "at").agg(
        F.sqrt(F.max(F.when(F.col("licence").isNull(), F.col("v")))).alias("norm"), F.max(F.when(F.col("licence").isNotNull(), F.struct("v", "licence"))).alias("best")
    )
    each = each.select("path", "digest", (F.col("best.v") / F.col("norm")).alias("score"), "best.licence").where(F.col("score") >= threshold)
    best = each.groupBy("path", "digest").agg(F.max(F.struct(F.round("score", 6).alias("score"), "licence")).alias("x"))
    return best.select("path", "digest", F.col("x.licence").alias("own"), "x.score")


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def inherited(files: DataFrame, given: DataFrame) -> DataFrame:
    """Adds ``dir_licence`` and ``from_dir`` to rows with ``dir``.

    ``given``: (dir, licence), one row a directory.
    """
    dirs = files.select("dir").distinct()
    steps = F.split("dir", "/")
    up = F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("ancestor"))))
    near = dirs.select("dir", up.alias("u")).select("dir", "u.*").join(given.withColumnRenamed("dir", "ancestor"), "ancestor")
    near = near.groupBy("dir").agg(F.max(F.struct("depth", "licence", "ancestor")).alias("x"))
    near = near.select("dir", F.col("x.licence").alias("dir_licence"), F.col("x.ancestor").alias("from_dir"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = files.withColumn("salt", F.pmod(F.xxhash64("path", "digest"), F.lit(SALTS)).cast("int"))
    return salted.join(near, ["dir", "salt"], "left").drop("salt")


def scan_licences(
    docs: DataFrame, path: Column, licence_file: Column, text: str = "text", doc_id: str = "doc_id", templates: dict[str, tuple[str, ...]] | None = None, threshold: float = 0.7
) -> DataFrame:
    """A row a file: doc_id, path, own, score, licence, from_dir.

    ``path`` and ``licence_file`` (boolean) are expressions over ``docs``.
    """
    templates = templates or TEMPLATES
    t = F.coalesce(F.col(text), F.lit(""))
    files = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(licence_file, F.lit(False)).alias("gives"), F.md5(F.encode(t, "UTF-8")).alias("digest"), t.alias("t"))
    own = materialize(own_licences(files, templates, threshold), "licence-own")
    names = materialize(files.drop("t").withColumn("dir", directory(F.col("path"))), "licence-files")
    both = join_on(names, own, ["path", "digest"], "left")
    given = both.where(F.col("gives") & F.col("own").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("own").alias("licence"))).alias("x")).select("dir", "x.licence")
    got = inherited(both, given)
    return got.select("doc_id", "path", "own", "score", F.coalesce("own", "dir_licence").alias("licence"), F.when(F.col("own").isNull(), F.col("from_dir")).alias("from_dir"))
