"""License scans with DataFrame functions: Dice coefficient of word bigrams against templates.

Method
------
Text and templates are lower-cased and every run of other characters than letters and digits becomes a space. The units of a
text are its lines, its paragraphs (split at lines without letters or digits), the whole of it, and windows: a word of a template that is
an anchor places the template in the text, and the window has the template's number of words from its start there. So a notice inside
a line or a licence inside a longer file is compared with the words it would cover. A unit with n distinct bigrams meets only
the templates whose size s lies within n * t / (2 - t) and n * (2 - t) / t, since Dice can't reach t beyond; a text that is too small
for a template has no window of it.

A match shares at least s * t / (2 - t) bigrams. So it must hold one of the template's anchors, its longest words, which
all but too few bigrams touch; and one of a few hint words with the same property, chosen to serve many templates. Texts, lines and
paragraphs without a hint are skipped before bigrams are built. All of it happens within the row: no shuffle, no join.

The templates are a parameter; they are held as literals, so their number is for a driver to hold.

Defined results: null or empty texts, and units of fewer than two words, match nothing. n_matches counts the templates that
some unit matches. A text's license is that of the match that shares most bigrams, then of the highest Dice, then by license id. Repeated rows give repeated rows, an empty table none; extra
columns are ignored. Windows cost the number of anchors in a text times the size of their templates, whatever its length.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices, operative sentences and whole texts of public licenses.
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_REST = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", _BSD),
    ("bsd-2-clause", f"{_BSD} {_BSD_CLAUSES} {_BSD_REST}"),
    ("bsd-3-clause", f"{_BSD} {_BSD_CLAUSES} {_BSD_THIRD} {_BSD_REST}"),
    ("bsl-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("mit", _MIT),
    ("mit", f"{_MIT} {_MIT_REST}"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)
MIN_DICE = 0.8
_OTHER = r"[^\p{L}\p{N}]+"
PARAGRAPH = r"\n(?:[^\p{L}\p{N}\n]*\n)+"


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _least(text: str, min_dice: float) -> int:
    """The fewest bigrams of a template that a match shares."""
    return math.ceil(len(bigrams_of(text)) * min_dice / (2 - min_dice) - 1e-9)


def anchors_of(text: str, min_dice: float = MIN_DICE) -> set[str]:
    """Words, longest first, until the bigrams that hold none of them are too few for a match."""
    bigrams, least = bigrams_of(text), _least(text, min_dice)
    chosen: set[str] = set()
    for word in sorted(set(words_of(text)), key=lambda w: (-len(w), w)):
        if sum(not chosen & set(b.split()) for b in bigrams) < least:
            break
        chosen.add(word)
    return chosen


def hints_of(texts: list[str], min_dice: float = MIN_DICE) -> set[str]:
    """Few words of which every match of any template holds one: the word that touches most bigrams still wanted, of long words as long as there are any."""
    chosen: set[str] = set()
    free = [(set(bigrams_of(t)), len(bigrams_of(t)) - _least(t, min_dice) + 1) for t in texts]
    while True:
        wanted = [(b, need) for b, need in ((left, need - (total - len(left))) for (left, need), total in zip(free, [len(bigrams_of(t)) for t in texts])) if need > 0]
        if not wanted:
            return chosen
        gain: dict[str, float] = {}
        for left, need in wanted:
            for bigram in left:
                for word in set(bigram.split()):
                    gain[word] = gain.get(word, 0) + 1 / need
        best = max(gain, key=lambda w: (len(w) > 5, gain[w], w))
        chosen.add(best)
        free = [({b for b in left if best not in b.split()}, need) for left, need in free]


def placements(templates, min_dice: float = MIN_DICE) -> list[tuple[str, int, int]]:
    """(anchor, template, its place in the template's words) of every occurrence."""
    return [(w, i, k) for i, (_, text) in enumerate(templates) for anchors in [anchors_of(text, min_dice)] for k, w in enumerate(words_of(text)) if w in anchors]


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def usable_templates(templates) -> list[tuple[str, str]]:
    return sorted((t for t in templates if bigrams_of(t[1])), key=lambda t: t[0])


def scan_licenses(docs: DataFrame, templates=TEMPLATES, min_dice: float = MIN_DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_matches (templates that a unit matches), license, dice, licenses (sorted)."""
    usable = usable_templates(templates)
    ratio = min_dice / (2 - min_dice)
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(name).alias("license"), F.lit(len(bigrams_of(text))).alias("s"), F.lit(len(words_of(text))).alias("m"), F.array(*map(F.lit, bigrams_of(text))).alias("bigrams")) for i, (name, text) in enumerate(usable)))
    at: dict[str, list] = {}
    for word, i, k in placements(usable, min_dice):
        at.setdefault(word, []).append(F.struct(F.lit(i).alias("t"), F.lit(k).alias("k")))
    anchors = F.array(*(F.struct(F.lit(w).alias("word"), F.array(*places).alias("places")) for w, places in sorted(at.items())))
    hint = "|".join(map(re.escape, sorted(hints_of([text for _, text in usable], min_dice))))

    def bigrams(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))

    def words_in(text: Column) -> Column:
        return F.filter(F.split(F.regexp_replace(text, _OTHER, " "), " "), lambda w: w != "")

    def matches(own: Column, among: Column) -> Column:
        n = F.size(own)
        fits = F.filter(among, lambda t: (n >= t["s"] * ratio - 1e-9) & (t["s"] >= n * ratio - 1e-9))
        shared = F.transform(fits, lambda t: F.struct(F.size(F.array_intersect(own, t["bigrams"])).alias("shared"), (n + t["s"]).alias("both"), t["i"].alias("i"), t["license"].alias("license")))
        scored = F.transform(shared, lambda m: F.struct(m["shared"].alias("shared"), (2.0 * m["shared"] / m["both"]).alias("dice"), (-m["i"]).alias("order"), m["license"].alias("license")))
        return F.filter(scored, lambda m: m["dice"] >= min_dice - 1e-9)

    body = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    df = docs.select(F.col(id_col).alias("doc_id"), F.when(body.rlike(hint), body).alias("body"))
    paragraphs = F.split("body", PARAGRAPH)
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(hint))
    extra = F.filter(F.when(F.size(paragraphs) > 1, F.concat(paragraphs, F.array("body"))).otherwise(F.array("body")), lambda x: x.contains("\n") & x.rlike(hint))
    df = df.withColumn("by_unit", F.flatten(F.transform(F.transform(F.concat(lines, extra), lambda u: bigrams(words_in(u))), lambda own: matches(own, table))))
    df = df.withColumn("words", words_in(F.col("body")))
    held = let(F.array_intersect("words", F.transform(anchors, lambda a: a["word"])), lambda present: F.filter(anchors, lambda a: F.array_contains(present, a["word"])))
    df = df.withColumn("held", held)

    def starts(held: Column) -> Column:
        hits = let(F.transform(held, lambda a: a["word"]), lambda names: F.transform("words", lambda w, i: F.struct(i.alias("i"), F.array_position(names, w).cast("int").alias("a"))))
        places = F.transform(F.filter(hits, lambda h: h["a"] > 0), lambda h: F.transform(F.element_at(held, h["a"])["places"], lambda p: p["t"] * F.lit(1 << 32) + F.greatest(h["i"] - p["k"], F.lit(0))))
        return F.transform(F.array_distinct(F.flatten(places)), lambda c: F.struct(F.shiftright(c, 32).cast("int").alias("t"), c.bitwiseAND((1 << 32) - 1).cast("int").alias("start")))

    def windows(words: Column) -> Column:
        large = F.filter("starts", lambda c: F.size(words) - 1 >= F.element_at(table, c["t"] + 1)["s"] * ratio - 1e-9)
        cut = F.transform(large, lambda c: F.struct(F.slice(table, c["t"] + 1, F.lit(1)).alias("among"), F.slice(words, c["start"] + 1, F.element_at(table, c["t"] + 1)["m"]).alias("words")))
        return F.transform(cut, lambda c: F.struct(c["among"].alias("among"), bigrams(c["words"]).alias("own")))

    df = df.withColumn("starts", F.when(F.size("held") > 0, let(F.col("held"), starts)))
    df = df.withColumn("by_window", F.flatten(F.transform(let(F.col("words"), windows), lambda w: matches(w["own"], w["among"]))))
    df = df.withColumn("found", F.concat("by_unit", F.coalesce("by_window", F.array().cast("array<struct<shared:int,dice:double,order:int,license:string>>"))))
    top = F.array_max("found")
    names = F.array_sort(F.array_distinct(F.transform("found", lambda m: m["license"])))
    count = F.size(F.array_distinct(F.transform("found", lambda m: m["order"]))).cast("long")
    return df.select("doc_id", F.when(F.col("found").isNull(), F.lit(0).cast("long")).otherwise(count).alias("n_matches"), top["license"].alias("license"), top["dice"].alias("dice"), F.coalesce(F.array_join(names, ","), F.lit("")).alias("licenses"))
