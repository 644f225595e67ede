"""License scan: MinHash bands over overlapping text windows, verified by exact containment. DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, CONTAINMENT, COLLISION = 5, 0.8, 0.9995

# License texts and notices as their publishers word them, by SPDX id and wording.
TEMPLATES = {
    "0BSD/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "AGPL-3.0/notice": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0/title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0/limits": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0/title": "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "BSD/conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD/text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause/names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0/notice": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0/line": "Licensed under CC BY 4.0.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0/notice-the": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0/notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-ND-4.0/notice-the": "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-4.0/line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0/notice-the": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0/notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "GPL-2.0/title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GPL/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL/warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL/notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT/grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT/line": "Released under the MIT License.",
    "MIT/line-licensed": "Licensed under the MIT License.",
    "MIT/line-terms": "under the terms of the MIT License",
    "MIT/text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense/notice": "This is free and unencumbered software released into the public domain.",
    "Unlicense/text": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib/text": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
}


def tokens(text: str) -> list[str]:
    """As the scan splits a text: lower case, runs of letters and digits."""
    out, word = [], []
    for c in text.lower() + " ":
        if c.isalnum():
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return out


def _shingles(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def _least(m: int) -> int:
    """Shingles of m that the containment threshold asks for."""
    return math.ceil(CONTAINMENT * m - 1e-9)


class Class:
    """Templates of similar length, and the windows in which they are looked for.

    Windows begin every ``stride`` words and are so long that any passage of up to
    ``longest`` words lies whole in one of them.
    """

    def __init__(self, longest: int):
        self.longest, self.stride = longest, (longest + 1) // 2
        self.window = longest + self.stride - 1


def classes(templates: dict[str, str]) -> dict[int, Class]:
    n = max(len(tokens(t)) for t in templates.values())
    sizes = [SHINGLE]
    while sizes[-1] < n:
        sizes.append(math.ceil(sizes[-1] * 1.6))
    return {s: Class(s) for s in sizes}


def class_of(words: int, known: dict[int, Class]) -> Class:
    return known[min(s for s in known if s >= words)]


def bands(templates: dict[str, str]) -> int:
    """Bands of one value that meet every template at the threshold with chance ``COLLISION`` at least.

    A window that holds the least share k of a template's m shingles has Jaccard similarity
    of at least k / (window shingles + m - k); b bands miss it with chance (1 - J)^b.
    """
    known, worst = classes(templates), 1.0
    for t in templates.values():
        words = tokens(t)
        m = len(set(_shingles(words)))
        k = _least(m)
        worst = min(worst, k / (class_of(len(words), known).window - SHINGLE + 1 + m - k))
    return math.ceil(math.log(1 - COLLISION) / math.log(1 - worst))


def anchors(templates: dict[str, str]) -> list[str]:
    """Words without which no template reaches the threshold.

    Chosen so that in each template more shingles hold one of them than may be missing: a
    text without any anchor lacks these shingles, so passing it over loses nothing.
    """
    chosen: set[str] = set()
    for t in templates.values():
        sh = set(_shingles(tokens(t)))
        while len([s for s in sh if chosen & set(s.split())]) <= len(sh) - _least(len(sh)):
            left = [s for s in sh if not chosen & set(s.split())]
            words = {w for s in left for w in s.split() if len(w) >= 3} or {w for s in left for w in s.split()}
            chosen.add(max(words, key=lambda w: (len(w) >= 6, sum(w in s.split() for s in left), len(w), w)))
    return sorted(chosen)


def _keys(shingles: Column, n: int) -> Column:
    """One MinHash value for each band, mixed with the band's number."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(n)),
        lambda b: F.xxhash64(b, F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, b)))),
    )


def template_table(spark: SparkSession, templates: dict[str, str], n: int) -> DataFrame:
    """(license, size, t_shingles, key): a row for each band of each template, its words as text in the plan."""
    known = classes(templates)
    rows = [F.struct(F.lit(name).alias("license"), F.lit(class_of(len(w), known).longest).alias("size"), F.lit(" ".join(w)).alias("text")) for name, text in templates.items() if (w := tokens(text))]
    t = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.license", "t.size", F.split("t.text", " ").alias("w"))
    sh = F.transform(F.sequence(F.lit(1), F.size("w") - SHINGLE + 1), lambda i: F.array_join(F.slice("w", i, SHINGLE), " "))
    t = t.select("license", "size", F.array_distinct(sh).alias("t_shingles"))
    return t.withColumn("key", F.explode(_keys(F.col("t_shingles"), n)))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, containment, first_word, n_windows): the templates found in each document.

    Words are runs of letters and digits in lower case. Each length class of templates has
    its own overlapping windows over the whole text; windows without an anchor word can't
    reach the threshold and aren't made. A window and a template that agree in a band are
    verified: the share of the template's distinct five-word shingles that the window holds
    exactly, 0.8 or more. ``containment`` is the best window's, ``first_word`` where the
    first such window starts.

    Null, empty and short texts: no rows. Rows that share an id are reported as one. Extra
    columns are not read. The template side is a fixed list and broadcast; the one shuffle
    adds up found windows by document, after partial sums.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    n, known, words_of = bands(templates), classes(templates), anchors(templates)
    low = F.lower(F.col(text))
    d = docs.select(F.col(id_col).alias("doc_id"), low.alias("low")).where(F.col("low").rlike("|".join(words_of)))
    d = d.select("doc_id", F.split(F.trim(F.regexp_replace("low", r"[^\p{L}\p{N}]+", " ")), " ").alias("w")).where(F.size("w") >= SHINGLE)
    at = F.filter(F.transform("w", lambda x, i: F.when(F.array_contains(F.array(*map(F.lit, words_of)), x), i)), lambda i: i.isNotNull())
    d = d.withColumn("at", at).where(F.size("at") > 0)
    d = d.withColumn("sh", F.transform(F.sequence(F.lit(1), F.size("w") - SHINGLE + 1), lambda i: F.array_join(F.slice("w", i, SHINGLE), " ")))

    def starts(c: Class) -> Column:
        first = lambda a: F.greatest(F.lit(0), F.ceil((a - (c.window - 1)) / F.lit(c.stride)) * c.stride).cast("int")
        last = lambda a: (F.floor(a / F.lit(c.stride)) * c.stride).cast("int")
        each = F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(first(a), last(a), F.lit(c.stride)))))
        held = F.filter(each, lambda s: s < F.size("sh"))
        return F.transform(held, lambda s: F.struct(F.lit(c.longest).alias("size"), s.alias("start"), F.lit(c.window - SHINGLE + 1).alias("k")))

    used = {class_of(len(tokens(t)), known).longest for t in templates.values()}
    # outer, as otherwise a filter on the list's size is put below and works the list out again
    d = d.withColumn("win", F.explode_outer(reduce(lambda a, b: F.concat(a, b), [starts(known[u]) for u in sorted(used)]))).where("win is not null")
    d = d.select("doc_id", "win.size", "win.start", F.array_distinct(F.slice("sh", F.col("win.start") + 1, F.col("win.k"))).alias("shingles"))
    d = d.withColumn("key", F.explode_outer(_keys(F.col("shingles"), n)))
    met = d.join(F.broadcast(template_table(spark, templates, n)), ["size", "key"])
    share = F.size(F.array_intersect("t_shingles", "shingles")) / F.size("t_shingles")
    met = met.select("doc_id", "license", "start", share.alias("share")).where(F.col("share") >= F.lit(CONTAINMENT - 1e-9))
    once = met.groupBy("doc_id", "license", "start").agg(F.max("share").alias("share"))
    return once.groupBy("doc_id", "license").agg(F.max("share").alias("containment"), F.min("start").cast("long").alias("first_word"), F.count(F.lit(1)).alias("n_windows"))


def op4_licenses(docs: DataFrame) -> DataFrame:
    return scan(docs)


def op4_sql(templates: dict[str, str] | None = None) -> str:
    """The scan by brute force: every window against every template of its class."""
    templates = TEMPLATES if templates is None else templates
    known = classes(templates)
    rows = []
    for name, text in templates.items():
        words = tokens(text)
        c = class_of(len(words), known)
        sh = sorted(set(_shingles(words)))
        rows += [f"('{name}', {c.stride}, {c.window - SHINGLE + 1}, {len(sh)}, '{s}')" for s in sh]
    return f"""
WITH t(license, stride, k, m, shingle) AS (VALUES {", ".join(rows)}),
w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - {SHINGLE - 1}))) AS pos FROM w),
s AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + {SHINGLE}], ' ') AS shingle FROM p),
hit AS (SELECT doc_id, license, stride, k, m, pos, shingle FROM s JOIN t USING (shingle)),
win AS (
  SELECT doc_id, license, m, shingle, unnest(range(greatest(0, CAST(ceil((pos - k + 1) / stride) AS BIGINT) * stride), pos + 1, stride)) AS start FROM hit
),
found AS (
  SELECT doc_id, license, start, count(DISTINCT shingle) / m AS share FROM win GROUP BY doc_id, license, start, m HAVING count(DISTINCT shingle) >= {CONTAINMENT} * m - 1e-9
)
SELECT doc_id, license, max(share) AS containment, CAST(min(start) AS BIGINT) AS first_word, count(*) AS n_windows FROM found GROUP BY doc_id, license
"""
