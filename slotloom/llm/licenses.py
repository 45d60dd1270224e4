"""Licence scan with DataFrame functions only: Dice coefficient over word bigrams against licence templates.

A text is normalised as a whole (lower case, every run of other signs than letters and numbers one space), so notices may
be wrapped over lines or stand inside a paragraph. Units are the windows of a template's size that begin and end with a
bigram of the template: with n and m bigrams in window and template (repeats included), Dice is
2 * sum of min(count in window, count in template) / (n + m). Dice of at least t needs m t / (2 - t) shared bigrams, so

* a text comes in question for a template only if it holds one of its anchors: the bigrams of the longest words, so many
  that those left are fewer than that number;
* windows with fewer of the template's bigrams than that number are never built.

For each template the window of the highest Dice stands (ties: the first), if it reaches t. Where windows of different
templates overlap, only the one that shares most bigrams is a match (ties: the higher Dice, then the least name).

Null and empty texts and texts of fewer than two words match nothing. Repeated rows are scanned each: their matches
appear as often as the row. Null ids are kept, extra columns are left out, an empty table gives no rows. Very long texts
are scanned whole. Texts that hold no anchor never leave their task.
"""

from __future__ import annotations

import re
from collections import Counter
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 0.8
# Usual notices and whole texts of public licences, as they appear in texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT/grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-2-Clause/text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause/text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSL-1.0/text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC/text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT/text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense/text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib/text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}



def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(words: Column) -> Column:
    """Pairs of neighbouring words, joined by a space."""
    less = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, less), F.slice(words, 2, less), lambda a, b: F.concat(a, F.lit(" "), b))


def _counted(text: str) -> Counter:
    """Bigrams of a template (plain ASCII) with their counts."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    return Counter(zip(words, words[1:]))


def anchors(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> tuple[list[str], list[str]]:
    """(bigrams of which a match holds one at least, the longest words of these)."""
    grams, words = set(), set()
    for text in templates.values():
        counted = _counted(text)
        room = ceil(sum(counted.values()) * least / (2 - least) - 1e-9) - 1  # so many need not be anchors
        for pair in sorted(counted, key=lambda p: (max(map(len, p)), p)):
            room -= counted[pair]
            if room < 0:
                grams.add(" ".join(pair))
                words.add(max(pair, key=len))
    return sorted(grams), sorted(words)


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """license, size, gram, times: one row for each distinct bigram of each template."""
    pairs = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in sorted(templates.items())])
    rows = spark.range(1).select(F.explode(pairs).alias("t")).select("t.*")
    grams = rows.select("license", bigrams(F.split(normalised(F.col("text")), " ")).alias("grams"))
    return grams.select("license", F.size("grams").alias("size"), F.explode("grams").alias("gram")).groupBy("license", "size", "gram").agg(F.count("*").alias("times"))


def _window(hits: Column, i: Column, size: Column) -> Column:
    """The window that begins with hit i (from 1): dice, start (negative, so that the first of equals is the largest), n and
    shared (bigrams)."""
    inside = F.filter(F.slice(hits, i, size), lambda h: h["pos"] < F.element_at(hits, i)["pos"] + size)

    def measured(w: Column) -> Column:
        single = F.size(F.array_distinct(F.transform(F.filter(w, lambda h: h["times"] == 1), lambda h: h["gram"])))
        repeated = F.array_distinct(F.transform(F.filter(w, lambda h: h["times"] > 1), lambda h: F.struct(h["gram"].alias("gram"), h["times"].alias("times"))))
        shared = F.aggregate(repeated, single.cast("bigint"), lambda acc, g: acc + F.least(g["times"], F.size(F.filter(w, lambda h: h["gram"] == g["gram"])).cast("bigint")))
        n = F.element_at(w, -1)["pos"] - F.element_at(w, 1)["pos"] + 1
        return F.struct((2.0 * shared / (n + size)).alias("dice"), (-F.element_at(w, 1)["pos"]).alias("start"), n.alias("n"), shared.alias("shared"))

    # transform over one element: the window is made once, not anew for each use
    return F.element_at(F.transform(F.array(inside), measured), 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``id_col``, license, dice, start (number of the window's first word, from 1) and n_words of every match."""
    need = F.ceil(F.col("size") * (least / (2 - least)) - 1e-9).cast("int")
    grams, words = anchors(templates, least)
    literal = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    # explode over one element: words and later bigrams are made once, not anew for each use
    held = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.explode(F.array(F.split(normalised(F.col(text_col)), " "))).alias("words"))
    held = held.where(F.arrays_overlap("words", literal(words)))
    held = held.select("id", "row", F.explode(F.array(bigrams(F.col("words")))).alias("grams")).where(F.arrays_overlap("grams", literal(grams)))
    met = held.select("id", "row", F.posexplode("grams").alias("pos", "gram")).join(F.broadcast(template_table(docs.sparkSession, templates)), "gram")
    hits = met.groupBy("id", "row", "license", "size").agg(F.sort_array(F.collect_list(F.struct("pos", "gram", "times"))).alias("hits"))
    many = hits.where(F.size("hits") >= need).withColumn("need", need)
    begins = F.filter(F.sequence(F.lit(1), F.size("hits") - F.col("need") + 1), lambda i: F.element_at("hits", i + F.col("need") - 1)["pos"] < F.element_at("hits", i)["pos"] + F.col("size"))
    best = many.select("id", "row", "license", "size", F.array_max(F.transform(begins, lambda i: _window(F.col("hits"), i, F.col("size")))).alias("best")).where(F.col("best.dice") >= least - 1e-9)
    one = best.select("id", "row", F.struct(F.col("best.dice").alias("dice"), F.col("best.shared").alias("shared"), "license", (-F.col("best.start")).alias("start"), F.col("best.n").alias("n")).alias("w"))
    # Windows of a row: one a template at most.
    rows = one.groupBy("id", "row").agg(F.collect_list("w").alias("all"))
    better = lambda a, b: (a["shared"] > b["shared"]) | (a["shared"] == b["shared"]) & ((a["dice"] > b["dice"]) | (a["dice"] == b["dice"]) & (a["license"] < b["license"]))
    overlap = lambda a, b: (a["start"] <= b["start"] + b["n"]) & (b["start"] <= a["start"] + a["n"])
    kept = F.filter("all", lambda w: ~F.exists("all", lambda o: overlap(o, w) & better(o, w)))
    return rows.select(F.col("id").alias(id_col), F.explode(kept).alias("w")).select(id_col, "w.license", "w.dice", (F.col("w.start") + 1).alias("start"), (F.col("w.n") + 1).alias("n_words"))
