"""Licence scans in DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance from directories.

1. Frequencies of the templates' tokens are counted over all documents; a token outside all templates weighs as one that
   occurs in a single document. Weights are log-scaled counts times inverse document frequency.
2. Texts that cannot reach the similarity are left out without loss: by Cauchy-Schwarz, no part of a text without `threshold` of
   some template's norm among its tokens can. This is decided within the row, from the tokens that the text shares with the templates.
3. In the texts left, headers are up to WRAPPED neighbouring lines, since notices are wrapped: all runs that begin and end at a line with
   a needed token. (For each template its heaviest tokens are needed, until the rest has less than `threshold` of its norm.) Licence files
   are whole texts; those that have too many other tokens for any cosine above the threshold are left out without loss, too.
   Headers and files become sparse vectors, equal ones once; their cosine to the templates is a join on tokens with a table of fixed size.
4. A file's own licence is that of its best header (its first line's number is given), at or above the threshold (ties: template name).
   A licence file is one whose name says so (LICENSE, COPYING, ...) or whose whole text is at or above the threshold; it gives its licence to its directory.
5. A file without a licence of its own inherits from its nearest ancestor directory that has one: distinct directories are
   expanded to their ancestors and joined with licensed directories by path; the deepest wins, and files look up their directory.

No text is moved or written but the words of lines near a needed token, in texts that can reach a template, and of whole texts that pass the bounds. Runs of lines are formed in a window
over a file's lines, a row for each, and those that cannot reach a template go before they become rows, so a text of any number of such lines is never held several times in a row.

Defined cases: null and empty texts have no licence of their own but may inherit; a null path has no directory; several licence files in one directory:
highest similarity, then template name; equal rows get equal results; rows that share doc_id and path count as one file, with its best header; empty tables
give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let
from ..session import cut

THRESHOLD = 0.6
#: Lines in a header, at most.
WRAPPED = 12
LICENCE_NAME = r"(?i)^(un)?licen[cs]e|^copying|^copyright|^notice"

#: Notices and headers of public licences, by SPDX identifier; several forms of one licence are templates of their own.
TEMPLATES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
)

_TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def _template_counts() -> list[Counter]:
    return [Counter(re.findall(_TOKEN, text.lower())) for _, text in TEMPLATES]


def document_frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many of all texts each template token occurs, and the number of texts; one row per token comes back."""
    known = F.array(*[F.lit(t) for t in vocabulary])
    present = files.select(F.explode(F.array_intersect(tokens(F.col("text")), known)).alias("token"))
    return dict(present.groupBy("token").count().collect()), files.count()


def weigh(frequencies: dict[str, int], total: int) -> tuple[dict[str, float], float]:
    """Inverse document frequency of the templates' tokens, and of any other token."""
    idf = lambda n: math.log((1 + total) / (1 + n)) + 1
    vocabulary = {t for c in _template_counts() for t in c}
    return {t: idf(frequencies.get(t, 0)) for t in vocabulary}, idf(1)


def template_vectors(idf: dict[str, float]) -> list[dict[str, float]]:
    """Unit vectors of the templates."""
    out = []
    for counts in _template_counts():
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.append({t: v / norm for t, v in raw.items()})
    return out


def needed_tokens(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """Tokens of which a header must have one to reach the threshold with any template."""
    needed: set[str] = set()
    for vector in vectors:
        rest = 1.0
        for token, v in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if math.sqrt(max(rest, 0.0)) < threshold - 1e-9:
                break
            needed.add(token)
            rest -= v * v
    return sorted(needed)


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _shares(vectors: list[dict[str, float]]) -> tuple[Column, Column]:
    """Maps token -> squared weight: the greatest one in any template, and one map for each template."""
    most: dict[str, float] = {}
    for vector in vectors:
        for t, v in vector.items():
            most[t] = max(most.get(t, 0.0), v * v)
    listed = lambda shares: F.create_map(*[F.lit(x) for item in sorted(shares.items()) for x in item])
    return listed(most), F.array(*[listed({t: v * v for t, v in vector.items()}) for vector in vectors])


def _can_reach(present: Column, vectors: list[dict[str, float]], threshold: float) -> Column:
    """Some template has `threshold` of its norm among the tokens; the sum of greatest shares rules most texts out at once."""
    most, each = _shares(vectors)
    total = lambda tokens, shares: F.aggregate(tokens, F.lit(0.0), lambda acc, t: acc + F.coalesce(shares[t], F.lit(0.0)))
    least = threshold * threshold - 1e-9
    return let(present, lambda p: (total(p, most) >= least) & F.exists(each, lambda m: total(p, m) >= least))


def _may_match(words: Column, vectors: list[dict[str, float]], idf: dict[str, float], other: float, threshold: float) -> Column:
    """Whether a text's cosine to some template can reach the threshold, by bounds that lose none.

    The cosine is at most the norm of what the text has of the template, times the known tokens' part of the text's own norm. Known tokens weigh at most as if each came as often as any can,
    others at least as if each came once.
    """
    known = _words(sorted({t for v in vectors for t in v}))
    squares = F.create_map(*[F.lit(x) for t, w in sorted(idf.items()) for x in (t, w * w)])
    most, each = _shares(vectors)
    total = lambda tokens, shares: F.aggregate(tokens, F.lit(0.0), lambda acc, t: acc + F.coalesce(shares[t], F.lit(0.0)))
    least = F.lit(threshold * threshold - 1e-9)

    def bound(all_words: Column) -> Column:
        def of(found: Column) -> Column:
            often = F.pow(1 + F.log((F.size(all_words) - F.size(found) + 1).cast("double")), F.lit(2.0))

            def of_known(own: Column) -> Column:
                inside = total(own, squares) * often
                outside = (F.size(found) - F.size(own)) * F.lit(other * other)
                share = inside / (inside + outside)
                return (F.size(own) > 0) & (share * F.least(total(own, most), F.lit(1.0)) >= least) & F.exists(each, lambda m: share * total(own, m) >= least)

            return let(F.array_intersect(found, known), of_known)

        return let(F.array_distinct(all_words), of)

    return let(words, bound)


def _near_lines(text: Column, needed: list[str]) -> Column:
    """The lines that a header may hold, as (line, words, needed): those with a needed token at most WRAPPED - 1 lines before or on them, and one after or on them."""
    wanted = _words(needed)

    def kept(words: Column) -> Column:
        def picked(flags: Column) -> Column:
            some = lambda start, n: F.exists(F.slice(flags, start, n), lambda f: f)
            each = F.transform(words, lambda w, i: F.struct(i.alias("line"), w.alias("words"), F.get(flags, i).alias("needed")))
            return F.filter(each, lambda x: some(F.greatest(x["line"] - WRAPPED + 2, F.lit(1)), F.least(x["line"] + 1, F.lit(WRAPPED))) & some(x["line"] + 1, F.lit(WRAPPED)))

        return let(F.transform(words, lambda w: F.arrays_overlap(w, wanted)), picked)

    return let(F.transform(F.split(text, r"[\r\n]+"), lambda line: tokens(line)), kept)


def _headers(lines: DataFrame, reaching, matching) -> DataFrame:
    """lines(file, doc_id, path, line, words, needed) -> doc_id, path, line, words: runs from a needed line to one less than WRAPPED lines on that may match a template.

    A window of WRAPPED rows slides over each file's lines, so no row holds more than one window, whatever the file.
    """
    ahead = Window.partitionBy("file").orderBy("line").rowsBetween(Window.currentRow, WRAPPED - 1)
    rows = lines.withColumn("near", F.collect_list(F.struct("line", "words", "needed")).over(ahead)).filter("needed")
    rows = rows.withColumn("near", F.filter("near", lambda x: x["line"] < F.col("line") + WRAPPED)).filter(reaching(F.flatten(F.transform("near", lambda x: x["words"]))))
    ends = F.transform(F.filter("near", lambda x: x["needed"]), lambda x: x["line"])
    runs = F.transform(ends, lambda b: F.flatten(F.transform(F.filter("near", lambda x: x["line"] <= b), lambda x: x["words"])))
    return rows.select("doc_id", "path", "line", F.explode(F.filter(runs, matching)).alias("words"))


def _similarities(parts: DataFrame, keys: list[str], vectors: list[dict[str, float]], idf: dict[str, float], other: float, threshold: float) -> DataFrame:
    """parts(keys, words) -> keys, license, similarity: the best template of each part that reaches the threshold."""
    spark = parts.sparkSession
    rows = [(i, TEMPLATES[i][0], t, v, idf[t]) for i, vector in enumerate(vectors) for t, v in sorted(vector.items())]
    table = spark.createDataFrame(rows, "template int, license string, token string, share double, idf double")
    # a few hundred rows, whatever the corpus
    terms = F.broadcast(table.groupBy("token").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("template", "license", "share")).alias("uses")))
    counted = parts.select(*keys, F.explode("words").alias("token")).groupBy(*keys, "token").count()
    weighed = counted.join(terms, "token", "left").withColumn("w", (1 + F.log("count")) * F.coalesce("idf", F.lit(other)))
    norms = weighed.groupBy(*keys).agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
        F.flatten(F.collect_list(F.when(F.col("uses").isNotNull(), F.transform("uses", lambda u: F.struct(u["template"].alias("t"), u["license"].alias("l"), (u["share"] * F.col("w")).alias("d")))))).alias("dots"),
    )
    dots = norms.select(*keys, "norm", F.explode("dots").alias("d")).groupBy(*keys, "norm", F.col("d.t").alias("template"), F.col("d.l").alias("license")).agg(F.sum("d.d").alias("dot"))
    scored = dots.withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("similarity") >= threshold)
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("license"))).alias("best")
    return scored.groupBy(*keys).agg(best).select(*keys, F.col("best.license").alias("license"), (-F.col("best.s")).alias("similarity"))


def scan_licenses(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """files(doc_id, path, text) -> doc_id, path, license, similarity, line, inherited, licensed_by, effective; one row per row."""
    files = files.select("doc_id", "path", F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = sorted({t for c in _template_counts() for t in c})
    idf, other = weigh(*document_frequencies(files, vocabulary))
    vectors = template_vectors(idf)
    known = _words(vocabulary)
    reaching = lambda words: _can_reach(F.array_intersect(words, known), vectors, threshold)
    matching = lambda words: _may_match(words, vectors, idf, other, threshold)
    whole = matching(tokens(F.col("text")))
    hopeful = files.filter(reaching(tokens(F.col("text")))).withColumn("file", F.monotonically_increasing_id())
    file = F.array(F.struct(F.lit(-1).alias("line"), tokens(F.col("text")).alias("words"), F.lit(False).alias("needed")))
    pieces = F.concat(F.when(whole, file).otherwise(F.slice(file, 1, 0)), _near_lines(F.col("text"), needed_tokens(vectors, threshold)))
    lines = cut(hopeful.select("file", "doc_id", "path", F.explode(pieces).alias("p")).select("file", "doc_id", "path", "p.*"))
    parts = _headers(lines.filter("line >= 0"), reaching, matching).unionByName(lines.filter("line < 0").select("doc_id", "path", "line", "words"))
    parts = cut(parts.withColumn("digest", F.sha2(F.array_join("words", " ").cast("binary"), 256)))
    # equal parts are scored once; written down, so that adaptive execution may split a frequent one
    by_part = cut(_similarities(parts.groupBy("digest").agg(F.first("words").alias("words")), ["digest"], vectors, idf, other, threshold))
    found = parts.select("doc_id", "path", "line", "digest").join(by_part, "digest")
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("license"), F.col("line"))).alias("b")
    own = cut(found.filter("line >= 0").groupBy("doc_id", "path").agg(best).select("doc_id", "path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("similarity"), F.col("b.line").alias("line")))

    name = F.element_at(F.split("path", "/"), -1)
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    given = own.filter(name.rlike(LICENCE_NAME)).select("path", "license", "similarity").unionByName(found.filter("line < 0").select("path", "license", "similarity"))
    given = given.filter(F.col("path").isNotNull()).groupBy(directory.alias("licensed_dir"))
    licensed = given.agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("license"))).alias("b")).select("licensed_dir", F.col("b.license").alias("dir_license"))

    directories = files.select(directory.alias("dir")).filter("dir is not null").distinct()
    depths = F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/"))))
    ancestors = directories.select("dir", F.explode(depths).alias("depth")).withColumn("licensed_dir", F.array_join(F.slice(F.split("dir", "/"), 1, F.col("depth")), "/"))
    nearest = ancestors.join(licensed, "licensed_dir").groupBy("dir").agg(F.max_by(F.struct("licensed_dir", "dir_license"), "depth").alias("n"))
    # written down, so that adaptive execution may split a directory with many files
    nearest = cut(nearest.select("dir", F.col("n.licensed_dir").alias("licensed_by"), F.col("n.dir_license").alias("dir_license")))

    keyed = files.select("doc_id", "path", directory.alias("dir"))
    own = own.select(F.col("doc_id").alias("_id"), F.col("path").alias("_path"), "license", "similarity", "line")
    joined = keyed.join(own, keyed["doc_id"].eqNullSafe(own["_id"]) & keyed["path"].eqNullSafe(own["_path"]), "left").join(nearest, "dir", "left")
    inherits = F.col("license").isNull() & F.col("dir_license").isNotNull()
    return joined.select(
        "doc_id", "path", "license", "similarity", "line",
        F.when(inherits, F.col("dir_license")).alias("inherited"),
        F.when(inherits, F.col("licensed_by")).alias("licensed_by"),
        F.coalesce("license", "dir_license").alias("effective"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """documents as files: source/lang/doc_id.txt."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), F.concat(part("doc_id"), F.lit(".txt"))).alias("path"), "text")
