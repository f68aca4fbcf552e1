"""Licence scans (native: DataFrame functions only).

Texts are normalised (lower-case, anything but letters and digits is a gap) and
compared with licence templates by the Dice coefficient of their sets of word
bigrams; a single word is its own bigram.  Compared are

* units: a document's lines, its paragraphs of several lines (blank lines separate
  them) and, if it has several paragraphs, the whole text;
* windows: wherever a key word of a template of six letters or more stands in the
  text, the template's own number of words, laid so that it falls on its place.  So a notice is
  found inside a longer line, or across line breaks.

A unit, or a key word's place, counts for its best template alone (ties: the first
licence by name), and only if it has all words with digits of that template, so that
versions are told apart.

Pruning, none of which loses a unit:

* size bounds: Dice >= t needs a unit of t/(2-t) to (2-t)/t times the template's
  bigrams, so other templates are not compared;
* key words: such a unit shares at least ceil(t/(2-t) * n) of a template's n
  bigrams, so it must hold one of any n - ceil(...) + 1 of them.  Per template
  the longest words that together occur in that many bigrams are its key words;
  texts and units with no key word of any template are passed over.

All comparisons run inside the row against a literal array of templates, whose
size is checked; nothing is joined, and the only shuffle adds up the matches of
a document.

Defined results: null and empty texts match nothing; a document can match several
licences, one row each; texts of any length are read whole; equal rows of one doc_id
add up; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

THRESHOLD = 0.8
MAX_TEMPLATE_CHARS = 1 << 20
ANCHOR_LETTERS = 6

# Customary licence notices and short licence texts.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License v3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "Licensed under the GNU General Public License v2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    # the clauses that follow tell the BSD licences apart
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License"],
    "ISC": [
        "Licensed under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-3.0": ["Licensed under CC BY 3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-SA-3.0": ["Licensed under CC BY-SA 3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}


def bigrams(text: str) -> list[str]:
    """Sorted set of word bigrams of the normalised text (for templates)."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    return sorted({" ".join(x) for x in zip(words, words[1:], strict=False)} or set(words))


def needed(n: int, threshold: float) -> int:
    """Bigrams that a unit must share with a template of n."""
    return math.ceil(threshold / (2 - threshold) * n - 1e-9)


def key_words(grams: list[str], threshold: float) -> list[str]:
    left = len(grams) - needed(len(grams), threshold) + 1
    chosen, open_ = [], set(grams)
    for word in sorted({w for g in grams for w in g.split()}, key=lambda w: (-len(w), w)):
        if left <= 0:
            break
        hit = {g for g in open_ if word in g.split()}
        if hit:
            chosen.append(word)
            open_ -= hit
            left -= len(hit)
    return chosen


def _texts(values: list[str]) -> str:
    """A literal array of words or bigrams (letters, digits and spaces)."""
    return f"array({', '.join(repr(v) for v in values)})" if values else "cast(array() AS array<string>)"


def anchor_words(keys: list[str]) -> list[str]:
    """The key words that windows are laid on: the long ones, which ordinary texts seldom have."""
    return [k for k in keys if len(k) >= ANCHOR_LETTERS] or keys


def described(templates: dict[str, list[str]], threshold: float) -> list[dict]:
    out = []
    for name, texts in templates.items():
        for text in texts:
            words = re.findall(r"[a-z0-9]+", text.lower())
            if grams := bigrams(text):
                keys = key_words(grams, threshold)
                out.append({"licence": name, "words": words, "grams": grams, "keys": keys, "must": sorted({w for w in words if re.search("[0-9]", w)}),
                            "anchors": [(w, i) for i, w in enumerate(words) if w in anchor_words(keys)]})
    return out


def _templates(templates: dict[str, list[str]], threshold: float) -> tuple[Column, Column, Column, list[str], list[str]]:
    """Literal arrays: templates, their anchors (a key word, its place, the number
    of the template), the anchors' words; and the key words, and of them the
    anchors' words, to look for in a text."""
    if sum(len(t) for texts in templates.values() for t in texts) > MAX_TEMPLATE_CHARS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_CHARS} characters: scan in several calls")
    known = described(templates, threshold)
    entry = lambda t: f"'{t['licence']}' AS licence, {len(t['grams'])} AS n, {len(t['words'])} AS m, {_texts(t['grams'])} AS grams, {_texts(t['must'])} AS must"
    entries = F.expr(f"array({', '.join(f'struct({entry(t)})' for t in known)})")
    anchors = F.expr("array(" + ", ".join(f"struct('{w}' AS word, {i} AS place, {k} AS template, {len(t['words'])} AS m)" for k, t in enumerate(known) for w, i in t["anchors"]) + ")")
    keys, laid = ({k for t in known for k in t["keys"]}, {w for t in known for w, _ in t["anchors"]})
    # a key word that contains another one is found by the shorter
    shortest = lambda words: sorted(k for k in words if not any(o != k and o in k for o in words))
    return entries, anchors, F.expr(_texts(sorted(laid))), shortest(keys), shortest(laid)


def _holds(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _grams(w: Column) -> Column:
    pair = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    return F.array_distinct(F.when(F.size(w) > 1, pair).otherwise(w))


def _match(t: Column, words: Column, grams: Column, threshold: float) -> Column:
    """(-dice, licence) of a template that fits, else null; the least is the best."""
    dice = 2 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["n"])
    return F.when((dice >= threshold) & (F.size(F.array_except(t["must"], words)) == 0), F.struct((-dice).alias("less"), t["licence"].alias("licence")))


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence, n_units, n_windows, dice (the best of them) of every match."""
    known, anchors, key_list, keys, laid_on = _templates(templates, threshold)
    words_of = lambda t: F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text")).alias("t")).where(_holds(F.col("t"), keys))
    lines = F.split("t", "\n")
    # an empty line (white space only) ends a paragraph
    paragraphs = F.split("t", r"\n[\x20\x09-\x0D]*\n")
    units = F.concat(lines, F.filter(paragraphs, lambda p: F.contains(p, F.lit("\n"))), F.when(F.size(paragraphs) > 1, F.array("t")).otherwise(F.array().cast("array<string>")))

    def of_unit(u: Column) -> Column:
        n = F.size(u["grams"])
        fits = F.filter(known, lambda t: (n * (2 - threshold) >= t["n"] * threshold - 1e-9) & (n * threshold <= t["n"] * (2 - threshold) + 1e-9))
        return F.array_min(F.transform(fits, lambda t: _match(t, u["w"], u["grams"], threshold)))

    # every transform is one step, so that a lambda computes nothing twice
    worded = F.transform(F.filter(units, lambda u: _holds(u, keys)), words_of)
    by_unit = F.transform(F.transform(worded, lambda w: F.struct(w.alias("w"), _grams(w).alias("grams"))), lambda u: F.struct(F.lit(1).alias("unit"), of_unit(u).alias("m")))

    # windows: per place of a key word, the templates that have it, laid on its place
    places = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: F.array_contains(key_list, h["x"]))
    laid = F.transform(places, lambda h: F.transform(F.filter(anchors, lambda a: a["word"] == h["x"]), lambda a: F.struct(
        F.get(known, a["template"]).alias("a"), F.slice("w", F.greatest(h["i"] - a["place"], F.lit(0)) + 1, a["m"]).alias("s"))))
    grammed = F.transform(laid, lambda l: F.transform(l, lambda x: F.struct(x["a"].alias("a"), x["s"].alias("s"), _grams(x["s"]).alias("g"))))
    by_window = F.transform(grammed, lambda l: F.struct(F.lit(0).alias("unit"), F.array_min(F.transform(l, lambda x: _match(x["a"], x["s"], x["g"], threshold))).alias("m")))

    none = F.array().cast("array<string>")
    both = d.select("doc_id", by_unit.alias("u"), F.when(_holds(F.col("t"), laid_on), words_of(F.col("t"))).otherwise(none).alias("w")).select("doc_id", F.explode_outer(F.concat("u", by_window)).alias("x"))
    # a filter on the match would be pushed down with a copy of all of its expression; on the count it stays here
    best = both.select("doc_id", "x.unit", "x.m.licence", (-F.col("x.m.less")).alias("dice"))
    found = best.groupBy("doc_id", "licence").agg(
        F.sum("unit").alias("n_units"), F.sum(1 - F.col("unit")).alias("n_windows"), F.max("dice").alias("dice"), F.count("licence").alias("n"))
    return found.where("n > 0").drop("n")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"))


def oracle_sql(templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same with units, windows and bigrams as rows."""
    known = described(templates, threshold)
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    rows = ", ".join(f"({i}, '{t['licence']}', {listed(t['words'])}, {listed(t['must'])})" for i, t in enumerate(known))
    anchors = ", ".join(f"({i}, '{w}', {place})" for i, t in enumerate(known) for w, place in t["anchors"])
    gram = lambda src: f"list_distinct(CASE WHEN len({src}) > 1 THEN list_transform(range(1, len({src})), lambda i: {src}[i] || ' ' || {src}[i + 1]) ELSE {src} END)"
    return rf"""
WITH t AS MATERIALIZED (SELECT i AS tid, licence, w, must, {gram('w')} AS g FROM (VALUES {rows}) AS v(i, licence, w, must)),
a AS (SELECT * FROM (VALUES {anchors}) AS v(tid, word, place)),
d AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS t FROM documents),
p AS (SELECT r, doc_id, t, regexp_split_to_array(t, '\n[\x20\x09-\x0D]*\n') AS ps FROM d),
u AS (SELECT doc_id, unnest(list_concat(list_concat(string_split(t, chr(10)), list_filter(ps, lambda x: contains(x, chr(10)))), CASE WHEN len(ps) > 1 THEN [t] ELSE [] END)) AS unit FROM p),
ug AS MATERIALIZED (SELECT row_number() OVER () AS u, doc_id, w, {gram('w')} AS g FROM (SELECT doc_id, regexp_extract_all(unit, '[a-z0-9]+') AS w FROM u)),
x AS (SELECT u, unnest(g) AS gram FROM ug),
y AS (SELECT tid, unnest(g) AS gram FROM t),
shared AS (SELECT u, tid, count(*) AS n FROM x JOIN y USING (gram) GROUP BY u, tid),
um AS (SELECT doc_id, u AS place, 1 AS unit, licence, 2 * n / (len(ug.g) + len(t.g)) AS dice FROM shared JOIN ug USING (u) JOIN t USING (tid) WHERE len(list_filter(must, lambda m: NOT list_contains(ug.w, m))) = 0),
dw AS MATERIALIZED (SELECT r, doc_id, regexp_extract_all(t, '[a-z0-9]+') AS w FROM d),
h AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM dw),
s AS (SELECT r, doc_id, pos, licence, t.g AS tg, must, list_slice(dw.w, greatest(pos - place, 0) + 1, greatest(pos - place, 0) + len(t.w)) AS sw FROM h JOIN a USING (word) JOIN t USING (tid) JOIN dw USING (r)),
sg AS (SELECT *, {gram('sw')} AS g FROM s),
wm AS (SELECT doc_id, r * 100000000 + pos AS place, 0 AS unit, licence, 2 * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice FROM sg WHERE len(list_filter(must, lambda m: NOT list_contains(sw, m))) = 0),
m AS (SELECT *, row_number() OVER (PARTITION BY unit, place ORDER BY dice DESC, licence) AS k FROM (SELECT * FROM um UNION ALL SELECT * FROM wm) WHERE dice >= {threshold})
SELECT doc_id, licence, sum(unit)::BIGINT AS n_units, sum(1 - unit)::BIGINT AS n_windows, max(dice) AS dice FROM m WHERE k = 1 GROUP BY doc_id, licence
"""
