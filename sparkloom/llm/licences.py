"""Licence scans, DataFrame functions only: normalised text against licence templates by the Dice coefficient of word bigrams.

A text is cut into segments: the whole text, its paragraphs (lines without a letter or digit between), lines and sentences.
Notices that are wrapped or embedded in other words are found by word windows: for each template, the window that starts and
ends with bigrams of it and has the highest Dice, counting bigrams foreign to the template as distinct. Of windows that overlap
the best stays; a window counts unless a cut segment has its licence with as high a Dice. Each distinct segment is normalised (lower case, words of letters and digits) and its set of word bigrams compared with the templates
whose sizes make the threshold t possible: 2 * min / (a + b) >= t needs t / (2 - t) <= a / b <= (2 - t) / t.

Before that, texts and segments without any anchor word are passed over. Anchors are derived from the templates so that none
is lost: a match shares at least t / (2 - t) of a template's bigrams, and the bigrams without an anchor are fewer.

Defined results: a null or empty text, or one of a single word, has no licence. Ties go to the longer template, then to the
first name. The redistribution paragraph that BSD-2-Clause and BSD-3-Clause share counts for the latter where its clause on
names is found. A template adds one window at most to a text, so of a wrapped notice that is repeated one counts. A text's segments are one array of its own text; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Licence statements and paragraphs of licence texts, by licence.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0", "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation."),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License version 3 as published by the Free Software Foundation."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("Proprietary", "All rights reserved."),
)
#: A licence whose text holds another's as a part; where it is found, the other's matches are its own.
CONTAINS = {"BSD-3-Clause": "BSD-2-Clause"}


def bigrams(text: str) -> list[str]:
    w = re.findall("[a-z0-9]+", text.lower())
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def bigram_set(text: str) -> set[str]:
    return set(bigrams(text))


def anchors(templates: tuple[tuple[str, str], ...], threshold: float) -> list[str]:
    """Words of which each match has one. Words that most open templates' bigrams hold are chosen, long ones before short ones,
    until each template's bigrams without a chosen word are fewer than a match shares at least."""
    sets = [bigram_set(text) for _, text in templates]
    least = [math.ceil(threshold / (2 - threshold) * len(g) - 1e-9) for g in sets]
    left = [set(g) for g in sets]
    chosen: list[str] = []
    while any(len(g) >= n for g, n in zip(left, least, strict=True) if n):
        count = Counter(w for g, n in zip(left, least, strict=True) if n and len(g) >= n for x in g for w in set(x.split()))
        word = max(count, key=lambda w: (len(w) > 5, count[w], len(w), w))
        chosen.append(word)
        left = [{x for x in g if word not in x.split()} for g in left]
    return chosen


def normalised(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), "")


def licences(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, licence (the best match's; null: none), dice (its coefficient; null: none), n_matches (distinct segments
    that match), found: array of (segment, licence, dice) in the segments' order."""
    words = anchors(templates, threshold)
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(i).alias("rank"), F.lit(len(g)).alias("n"), F.lit(math.ceil(threshold / (2 - threshold) * len(g) - 1e-9)).alias("least"), F.lit(int((2 - threshold) / threshold * len(bigrams(text)) + 1e-9)).alias("most"), F.array(*map(F.lit, sorted(g))).alias("grams")) for i, (name, text) in enumerate(templates) if (g := bigram_set(text))])
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def has(low: Column) -> Column:
        """A short anchor must be a whole word, or prose would be full of it."""
        tests = [F.contains(low, F.lit(w)) if len(w) > 5 else F.contains(low, F.lit(w)) & low.rlike(f"(?<![a-z0-9]){w}(?![a-z0-9])") for w in words]
        return reduce(lambda a, b: a | b, tests)

    pieces = F.concat(F.array(F.col("__t")), F.split("__t", "\\n[^\\p{L}\\p{N}\\n]*\\n"), F.split("__t", "\\n"), F.split("__t", "\\n|(?<=[.!?])[\\x20\\x09]+"))
    segments = F.array_distinct(F.transform(F.filter(pieces, lambda x: has(F.lower(x))), lambda x: F.trim(x)))

    def grams(w: Column) -> Column:
        return F.array_distinct(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))))

    def best(g: Column) -> Column:
        n = F.size(g)
        able = F.filter(known, lambda k: (n * (2 - threshold) >= k["n"] * threshold - 1e-9) & (n * threshold <= k["n"] * (2 - threshold) + 1e-9))
        dice = F.transform(able, lambda k: F.struct((F.lit(2.0) * F.size(F.array_intersect(g, k["grams"])) / (n + k["n"])).alias("dice"), k["n"].alias("n"), (-k["rank"]).alias("rank"), k["name"].alias("licence")))
        return F.array_max(F.filter(dice, lambda d: d["dice"] >= threshold))

    once = lambda v, body: F.transform(F.array(v), body)[0]
    every = sorted(set().union(*(bigram_set(text) for _, text in templates)))

    def window(own: Column, k: Column) -> Column:
        """The best window of a template by the places of its bigrams: (dice, n, rank, at, end), null below the threshold."""

        def of_start(s: Column, j: Column) -> Column:
            start = F.struct(F.array().cast("array<int>").alias("seen"), F.lit(0).alias("hits"), F.lit(0.0).cast("double").alias("dice"), F.lit(-1).alias("end"))

            def step(acc: Column, h: Column) -> Column:
                def scored(seen: Column) -> Column:
                    n = h["i"] - s["i"] - acc["hits"] + F.size(seen)  # repeats count once
                    dice = F.lit(2.0) * F.size(seen) / (n + k["n"])
                    return once(dice, lambda d: F.struct(seen.alias("seen"), (acc["hits"] + 1).alias("hits"), F.greatest(d, acc["dice"]).alias("dice"), F.when(d > acc["dice"], h["i"]).otherwise(acc["end"]).alias("end")))

                return once(F.when(F.array_contains(acc["seen"], h["p"]), acc["seen"]).otherwise(F.array_append(acc["seen"], h["p"])), scored)

            near = F.filter(F.slice(own, j + 1, k["most"]), lambda h: h["i"] - s["i"] < k["most"])
            found = F.aggregate(near, start, step, lambda acc: F.struct(acc["dice"].alias("dice"), k["n"].alias("n"), (-k["rank"]).alias("rank"), (-s["i"]).alias("at"), acc["end"].alias("end")))
            return F.when(F.get(own, j + k["least"] - 1)["i"] - s["i"] < k["most"], found)

        return F.array_max(F.filter(F.transform(own, of_start), lambda x: x["dice"] >= threshold - 1e-9))

    def windows(w: Column) -> Column:
        """Best windows of the templates as texts, without those that overlap a better one."""
        pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1)).alias("g"), i.alias("i")))
        places = F.filter(pairs, lambda h: h["g"].isin(every))

        def of(hits: Column) -> Column:
            def one(k: Column) -> Column:
                own = F.filter(F.transform(hits, lambda h: F.struct(F.array_position(k["grams"], h["g"]).cast("int").alias("p"), h["i"].alias("i"))), lambda h: h["p"] > 0)
                return once(own, lambda own: F.when(F.size(own) >= k["least"], window(own, k)))

            return F.sort_array(F.filter(F.transform(known, one), lambda x: x.isNotNull()), asc=False)

        none = F.array().cast("array<struct<dice:double,n:int,rank:int,at:int,end:int>>")
        apart = lambda kept, x: ~F.exists(kept, lambda y: (-y["at"] <= x["end"] + 1) & (-x["at"] <= y["end"] + 1))
        kept = F.aggregate(once(places, of), none, lambda acc, x: F.when(apart(acc, x), F.array_append(acc, x)).otherwise(acc))
        return F.transform(kept, lambda x: F.array_join(F.slice(w, 1 - x["at"], x["end"] + x["at"] + 2), " "))

    def scored(segments: Column) -> Column:
        return F.filter(F.transform(segments, lambda s: F.struct(s.alias("segment"), once(once(normalised(s), grams), best).alias("m"))), lambda x: x["m"].isNotNull())

    def owned(f: Column) -> Column:
        """Matches of a contained licence under the name of the one that contains it, where that is found."""
        names = F.transform(f, lambda x: x["m"]["licence"])
        return once(names, lambda names: F.transform(f, lambda x: x.withField("m", x["m"].withField("licence", reduce(lambda a, c: F.when((a == c[1]) & F.array_contains(names, c[0]), F.lit(c[0])).otherwise(a), CONTAINS.items(), x["m"]["licence"])))))

    def also(cut: Column) -> Column:
        own = scored(once(normalised(F.col("__t")), windows))
        return F.concat(cut, F.filter(own, lambda x: ~F.exists(cut, lambda y: (y["m"]["licence"] == x["m"]["licence"]) & (y["m"]["dice"] >= x["m"]["dice"]))))

    own = docs.select("doc_id", t.alias("__t")).withColumn("__low", F.lower("__t"))
    found = own.select("doc_id", F.when(has(F.col("__low")), once(once(scored(segments), also), owned)).alias("f"))
    top = F.array_max(F.transform("f", lambda x: x["m"]))
    return found.select(
        "doc_id",
        top["licence"].alias("licence"),
        top["dice"].alias("dice"),
        F.coalesce(F.size("f"), F.lit(0)).cast("long").alias("n_matches"),
        F.transform(F.coalesce("f", F.array().cast(found.schema["f"].dataType)), lambda x: F.struct(x["segment"], x["m"]["licence"].alias("licence"), x["m"]["dice"].alias("dice"))).alias("found"),
    )
