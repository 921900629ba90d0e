"""Licence scans, on DataFrame functions alone.

Units of a text are its lines, its paragraphs (between blank lines) and the whole.  A unit is normalised (A-Z to
lower case, every run of characters other than letters, digits and line ends to one space, ends trimmed) and held
against licence templates by the Dice coefficient of their sets of word bigrams.  A unit of a bigrams can reach the
threshold t with a template of b only if b t / (2 - t) <= a <= b (2 - t) / t, so each template is listed under the
sizes it allows and units are joined with that list by size; other templates are never looked at.

Before that, units that cannot match are passed over by words: at the threshold t a unit holds t / (2 - t) of a
template's bigrams at least, so words that lie in more than the rest of them are words of which it holds one.  Each
template has a set of such words (first those that serve smaller templates already, then its longest) or bigrams, and texts and units without any of these match nothing.

Notices that are wrapped over lines, or stand inside a line, are diluted in these units.  So runs of words from one
bigram of a template to another are units too, of up to (2 - t) / t times the template's length, over line ends and all.  Any run
of lines or sentences that reaches a template holds such a run that is as near.  Its Dice coefficient counts every
place whose bigram the template lacks, repeated or not; templates of up to ``SHORT`` bigrams must be there in full, as
a run is cut to fit.  Of runs that overlap, the one with the most bigrams of its template stays (then the nearest,
the shortest, the first), so the parts of a notice that are a notice of their own do not count; nor does a run that holds, or lies in,
another unit with the same licence.

Templates are few and fixed; with the default ones the list has under three thousand rows, and a larger set of
templates is refused above ``MAX_LISTED`` rows, so that the broadcast has a proven bound.

Units of fewer than two words have no bigrams and match nothing, nor do null and empty texts.  Rows that share an id
(repeated rows too) count as one document with all their units; equal units of a row count once.  Null ids are a
document of their own.  Two templates that are equally near are both reported.  Further columns are not read.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzite.llm.common import cut, read_table

DICE = 0.8
SHORT = 4
MAX_LISTED = 100_000

#: Public licence texts and customary notices.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD-3-Clause": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License, version 3.",
        "This file is licensed under the GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License, version 2.",
    ],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "All rights reserved."],
}
#: Names in "Licensed under the ...", "Released under the ..." and "Licensed under ..." where they need no article.
_NAMED = {
    "Apache-2.0": (["Apache License 2.0", "Apache 2.0 License"], []),
    "MIT": (["MIT License"], ["MIT"]),
    "BSD-3-Clause": (["BSD 3-Clause License", "3-Clause BSD License"], []),
    "BSD-2-Clause": (["BSD 2-Clause License", "2-Clause BSD License"], []),
    "ISC": (["ISC License"], ["ISC"]),
    "GPL-3.0": (["GNU General Public License v3.0", "GPL v3"], ["GPLv3"]),
    "GPL-2.0": (["GNU General Public License v2.0", "GPL v2"], ["GPLv2"]),
    "LGPL": (["GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "GNU Lesser General Public License, version 2.1", "LGPL"], ["LGPL"]),
    "AGPL-3.0": (["GNU Affero General Public License, version 3", "AGPL v3"], ["AGPLv3"]),
    "MPL-2.0": (["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"], []),
    "CC0-1.0": (["CC0 1.0 Universal Public Domain Dedication"], ["CC0 1.0"]),
    "Unlicense": (["Unlicense"], []),
}
_SPDX = {
    "Apache-2.0": ["Apache-2.0"], "MIT": ["MIT"], "BSD-3-Clause": ["BSD-3-Clause"], "BSD-2-Clause": ["BSD-2-Clause"], "ISC": ["ISC"],
    "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "LGPL": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"], "AGPL-3.0": ["AGPL-3.0-only", "AGPL-3.0-or-later"],
    "MPL-2.0": ["MPL-2.0"], "CC0-1.0": ["CC0-1.0"], "Unlicense": ["Unlicense"],
}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _more() -> None:
    """Adds to TEMPLATES the customary forms with each licence's names and identifiers."""
    forms = {name: [f"{verb} under the {x}." for x in the for verb in ("Licensed", "Released")] + [f"Licensed under {x}." for x in bare] for name, (the, bare) in _NAMED.items()}
    for name, ids in _SPDX.items():
        forms[name] += [f"SPDX-License-Identifier: {x}" for x in ids]
    for kind, words in _CC.items():
        forms[f"CC-{kind}-4.0"] = [f"This work is licensed under a Creative Commons {words} 4.0 International License.", f"Licensed under CC {kind} 4.0.", f"SPDX-License-Identifier: CC-{kind}-4.0"]
    for name, texts in forms.items():
        known = TEMPLATES.setdefault(name, [])
        known += [t for t in texts if normalise(t) not in map(normalise, known)]


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise(text: str) -> str:
    folded = text.translate(str.maketrans(_UPPER, _LOWER))
    return " ".join(re.sub(r"[\W_]+", " ", folded).split())


_more()


def template_rows(templates: dict[str, list[str]] | None = None) -> list[tuple[str, list[str]]]:
    """(licence, distinct bigrams) of each template that has any."""
    out = []
    for name, texts in (templates or TEMPLATES).items():
        for text in texts:
            words = normalise(text).split()
            if pairs := sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}):
                out.append((name, pairs))
    return out


def keywords(rows: list[tuple[str, list[str]]], least: float = DICE) -> tuple[list[str], list[str]]:
    """Words and bigrams of which every unit that reaches a template holds one.

    Words of four letters or more serve first; where they do not suffice, bigrams do, as short words are everywhere."""
    out: set[str] = set()
    two: set[str] = set()
    common = Counter(w for _, pairs in rows for w in {w for p in pairs for w in p.split()})
    for _, pairs in sorted(rows, key=lambda r: (len(r[1]), r)):
        spare = len(pairs) * (1 - least / (2 - least)) + 1e-9  # so many bigrams may be missing
        own, covered = set(), set()
        for word in sorted({w for p in pairs for w in p.split() if len(w) > 3}, key=lambda w: (w not in out, -len(w), common[w], w)):
            if len(covered) > spare:
                break
            own.add(word)
            covered |= {p for p in pairs if word in p.split()}
        out |= own
        for pair in sorted(set(pairs) - covered, key=lambda p: (-len(p), p)):
            if len(covered) > spare:
                break
            two.add(pair)
            covered.add(pair)
    # A word that holds another is found with it.
    return sorted(w for w in out if not any(o != w and o in w for o in out)), sorted(two)


def _allowed(b: int, least: float) -> range:
    """Sizes with which b bigrams can reach the threshold."""
    return range(math.ceil(b * least / (2 - least) - 1e-9), math.floor(b * (2 - least) / least + 1e-9) + 1)


def _folded(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _UPPER, _LOWER), r"[^\p{L}\p{N}\n]+", " ")


def units(text: Column) -> Column:
    """Distinct normalised lines, paragraphs and whole text."""
    folded = _folded(text)
    trimmed = lambda parts: F.transform(parts, lambda u: F.trim(F.regexp_replace(u, r"[ \n]+", " ")))
    whole = trimmed(F.array(folded))
    paragraphs = F.when(folded.rlike(r"\n *\n"), trimmed(F.split(folded, r"\n *\n[ \n]*"))).otherwise(whole)
    lines = F.when(F.instr(folded, "\n") > 0, trimmed(F.split(folded, "\n"))).otherwise(whole)
    return F.array_distinct(F.concat(lines, paragraphs, whole))


def bigrams(unit: Column) -> Column:
    """Distinct word bigrams; none for fewer than two words."""
    words = F.split(unit, " ")
    return F.when(F.size(words) > 1, F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))))


def runs(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = DICE) -> DataFrame:
    """``(doc_id, h, licence, unit, dice)``: the runs of words in ``docs (doc_id, h, text)`` that reach a template."""
    known, rows = [], []
    for name, texts in (templates or TEMPLATES).items():
        for text in texts:
            words = normalise(text).split()
            if pairs := sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}):
                need = len(pairs) if len(pairs) <= SHORT else math.ceil(len(pairs) * least / (2 - least) - 1e-9)
                longest = math.floor((len(words) - 1) * (2 - least) / least + 1e-9)
                known.append(longest)
                rows += [(pair, len(known), b, len(pairs), need, longest, name) for b, pair in enumerate(pairs)]
    words = F.split(F.trim(F.regexp_replace(_folded(F.col("text")), r"[ \n]+", " ")), " ")
    vocabulary = docs.sparkSession.createDataFrame(rows, "pair string, t int, b int, pairs int, need int, longest int, licence string")
    each = docs.select("doc_id", "h", words.alias("words")).where(F.size("words") > 1)
    pairs = each.select("doc_id", "h", F.posexplode_outer(F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))).alias("at", "pair"))
    own = pairs.join(F.broadcast(vocabulary), "pair").drop("pair").distinct()
    text, one, far = ["doc_id", "h"], ["doc_id", "h", "t"], max(known, default=1)
    enough = own.withColumn("n", F.size(F.collect_set("b").over(Window.partitionBy(*one)))).where("n >= need")
    placed = enough.withColumn("before", F.coalesce(F.lag("at").over(Window.partitionBy(*one, "b").orderBy("at")), F.lit(-1)))
    ahead = placed.withColumn("ahead", F.collect_list(F.struct("at", "before")).over(Window.partitionBy(*one).orderBy("at").rangeBetween(0, far)))

    def step(got: Column, x: Column) -> Column:
        held = got["held"] + (x["before"] < F.col("at")).cast("int")
        missed = x["at"] - F.col("at") - got["seen"]  # places whose bigram is not the template's
        dice = F.lit(2.0) * held / (held + missed + F.col("pairs"))
        better = (dice > got["dice"]) & (held >= F.col("need")) & (x["at"] - F.col("at") < F.col("longest"))
        return F.struct(held.alias("held"), (got["seen"] + 1).alias("seen"), F.when(better, dice).otherwise(got["dice"]).alias("dice"), F.when(better, held).otherwise(got["best"]).alias("best"), F.when(better, x["at"]).otherwise(got["end"]).alias("end"))

    none = F.struct(F.lit(0).alias("held"), F.lit(0).alias("seen"), F.lit(0.0).alias("dice"), F.lit(0).alias("best"), F.lit(-1).alias("end"))
    found = ahead.where(F.size("ahead") >= F.col("need")).select(*one, "licence", "at", F.aggregate("ahead", none, step).alias("x"))
    near = found.select(*one, "licence", "at", F.col("x.end").alias("end"), F.struct(F.col("x.best").alias("best"), F.col("x.dice").alias("dice"), (F.col("at") - F.col("x.end")).alias("short"), (-F.col("at")).alias("first")).alias("rank")).where(F.col("rank.dice") >= least)
    for keys in (one, text):
        others = F.collect_list(F.struct("at", "end", "rank")).over(Window.partitionBy(*keys).orderBy("at").rangeBetween(-far, far))
        near = near.withColumn("others", others).where(~F.exists("others", lambda o: (o["at"] <= F.col("end") + 1) & (o["end"] + 1 >= F.col("at")) & (o["rank"] > F.col("rank")))).drop("others")
    won = near.select(F.col("doc_id").alias("id2"), F.col("h").alias("h2"), "licence", "at", "end", "rank.dice")
    back = won.join(each, (F.col("h2") == F.col("h")) & F.col("id2").eqNullSafe(F.col("doc_id")))
    return back.select("doc_id", "h", "licence", F.array_join(F.slice("words", F.col("at") + 1, F.col("end") - F.col("at") + 2), " ").alias("unit"), "dice")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, least: float = DICE) -> DataFrame:
    """``(doc_id, licence, dice, n_units)``: the licences that a document's units reach, with the best coefficient."""
    spark = docs.sparkSession
    listed = [(a, name, pairs) for name, pairs in template_rows(templates) for a in _allowed(len(pairs), least)]
    if len(listed) > MAX_LISTED:
        raise ValueError(f"the templates list {len(listed)} sizes; {MAX_LISTED} is the bound for a broadcast")
    needed, pairs = keywords(template_rows(templates), least)
    apart = "|".join(p.replace(" ", r"[^\p{L}\p{N}]+") for p in pairs)
    any_of = lambda t: reduce(operator.or_, [F.contains(t, F.lit(w)) for w in needed] + [t.rlike(apart)] * bool(pairs), F.lit(False))
    # The text is bound once, as a lambda's variable: a filter would put it to lower case for every word.
    holds = lambda text: F.exists(F.array(text), any_of)
    small = spark.createDataFrame([(a, name, pairs) for a, name, pairs in listed], "size int, licence string, pairs array<string>")
    some = cut(docs.where(holds(F.lower(F.col(text_col)))).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text")), "some")
    each = some.select("doc_id", "h", F.explode_outer(units(F.col("text"))).alias("unit"))  # explode would have the units worked out in a filter first
    own = each.where(holds(F.col("unit"))).select("doc_id", "h", "unit", bigrams(F.col("unit")).alias("own")).where("own is not null").select("doc_id", "h", "unit", "own", F.size("own").alias("size"))
    near = own.join(F.broadcast(small), "size").withColumn("dice", F.lit(2.0) * F.size(F.array_intersect("own", "pairs")) / (F.size("own") + F.size("pairs")))
    whole = cut(near.where(F.col("dice") >= least).select("doc_id", "h", "licence", "unit", "dice"), "whole")
    o = whole.select(F.col("doc_id").alias("id2"), F.col("h").alias("h2"), F.col("licence").alias("licence2"), F.col("unit").alias("unit2"))
    within = F.contains("unit", "unit2") | F.contains("unit2", "unit")
    more = runs(some, templates, least).join(o, (F.col("h") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("licence") == F.col("licence2")) & within, "left_anti")
    return whole.unionByName(more).groupBy("doc_id", "licence").agg(F.max("dice").alias("dice"), F.countDistinct("unit").alias("n_units"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """The same in SQL."""
    rows = ", ".join(f"({_literal(name)}, [{', '.join(map(_literal, pairs))}])" for name, pairs in template_rows())
    return f"""
with folded as (select doc_id, regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') as t from documents where text is not null),
parts as (select doc_id, unnest(list_concat(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\\n *\\n[ \\n]*')), [t])) as u from folded),
unit as (select distinct doc_id, trim(regexp_replace(u, '[ \\n]+', ' ', 'g')) as unit from parts),
word as (select doc_id, unit, string_split(unit, ' ') as w from unit),
own as (select doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as own from word where len(w) > 1),
template(licence, pairs) as (values {rows}),
near as (select doc_id, unit, licence, 2.0::double * len(list_intersect(own, pairs)) / (len(own) + len(pairs)) as dice from own, template
  where len(own) between ceil(len(pairs) * {DICE} / (2 - {DICE}) - 1e-9) and floor(len(pairs) * (2 - {DICE}) / {DICE} + 1e-9))
select doc_id, licence, max(dice) as dice, count(distinct unit) as n_units from near where dice >= {DICE} group by doc_id, licence"""
