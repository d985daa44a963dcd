"""Licence scans: normalised text against licence templates by the Dice coefficient of their word bigrams.

DataFrame and SQL functions only, and no shuffle. Candidate units of a document are its whole text, its paragraphs
and its lines. Two exact bounds come first. Of a document, only the template bigrams it holds matter: if it holds c of
a template's t, no unit of it can reach more than 2c / (c + t). Of a unit, its size alone bounds the coefficient:
with a bigrams against t, by 2 min(a, t) / (a + t).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

LEAST = 0.8

#: Notices by which public licences are stated.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}


def bigrams(text: str) -> list[str]:
    """Distinct pairs of adjacent words of the normalised text (ASCII letters and digits, lower case)."""
    words = re.sub("[^A-Za-z0-9]+", " ", text).lower().split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _templates(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    return [(name, bigrams(t)) for name, texts in sorted(templates.items()) for t in texts]


_WORDS = "split(trim(lower(regexp_replace({0}, '[^A-Za-z0-9]+', ' '))), ' ')"
_PAIRS = "CASE WHEN size({0}) < 2 THEN cast(array() AS array<string>) ELSE zip_with(slice({0}, 1, size({0}) - 1), slice({0}, 2, size({0}) - 1), (a, b) -> concat(a, ' ', b)) END"


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = LEAST, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """The columns ``keep``, licence (the best match; equal ones by name; null if none), dice (its coefficient, 0 if
    none), licences (the best match of each unit that has one, ascending, joined by commas) and n_units (units of distinct bigrams that match).

    Null and empty texts, and texts of one word, match nothing. Repeated rows are scanned alike.
    """
    known = _templates(templates)
    names = lambda items: ", ".join("'" + x.replace("'", "''") + "'" for x in items)
    every = names(sorted({b for _, bs in known for b in bs}))
    table = ", ".join(f"named_struct('name', '{n}', 'bigrams', array({names(bs)}))" for n, bs in known)
    d = docs.selectExpr(*keep, f"coalesce({text}, '') AS _t")
    d = d.selectExpr(*keep, "_t", f"{_WORDS.format('_t')} AS _w")
    d = d.selectExpr(*keep, "_t", f"array_distinct(filter({_PAIRS.format('_w')}, b -> b IN ({every}))) AS _h")
    d = d.selectExpr(*keep, "_t", f"CASE WHEN size(_h) = 0 THEN filter(array({table}), t -> false) ELSE filter(array({table}), t -> 2 * size(array_intersect(_h, t.bigrams)) >= {least} * (size(array_intersect(_h, t.bigrams)) + size(t.bigrams))) END AS _c")
    units = r"array_distinct(concat(array(_t), split(_t, '\\n[ \\t\\r]*\\n'), split(_t, '\\n')))"
    d = d.selectExpr(*keep, "_c", f"CASE WHEN size(_c) = 0 THEN cast(array() AS array<array<string>>) ELSE array_distinct(transform(transform({units}, u -> {_WORDS.format('u')}), w -> array_sort(array_distinct({_PAIRS.format('w')})))) END AS _u")
    within = f"2.0D * least(size(u), size(t.bigrams)) >= {least} * (size(u) + size(t.bigrams))"
    dice = "2.0D * size(array_intersect(u, t.bigrams)) / (size(u) + size(t.bigrams))"
    d = d.selectExpr(*keep, f"filter(transform(_u, u -> filter(transform(filter(_c, t -> {within}), t -> named_struct('low', -({dice}), 'name', t.name)), x -> -x.low >= {least})), m -> size(m) > 0) AS _m")
    d = d.selectExpr(*keep, "_m", "array_min(flatten(_m)) AS _b")
    return d.selectExpr(*keep, "_b.name AS licence", "round(coalesce(-_b.low, 0.0D), 6) AS dice", "array_join(array_sort(array_distinct(transform(_m, m -> array_min(m).name))), ',') AS licences", "cast(size(_m) AS bigint) AS n_units")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences stated in every document (null and empty texts: none; repeated rows alike)."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, [{', '.join(map(quote, bs))}])" for n, bs in _templates(TEMPLATES))
    return f"""
WITH template(name, bigrams) AS (VALUES {rows}),
unit AS (
  SELECT doc_id, unnest(list_distinct(list_concat([t], str_split_regex(t, '\\n[ \\t\\r]*\\n'), str_split(t, chr(10))))) AS u
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
worded AS (SELECT doc_id, u, str_split(trim(lower(regexp_replace(u, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS w FROM unit),
paired AS (SELECT doc_id, list_sort(list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS b FROM worded WHERE len(w) > 1),
scored AS (
  SELECT doc_id, b, name, 2.0 * len(list_intersect(b, bigrams)) / (len(b) + len(bigrams)) AS dice
  FROM (SELECT DISTINCT doc_id, b FROM paired WHERE len(b) <= 400) CROSS JOIN template),
hit AS (SELECT doc_id, b, arg_min(name, (-dice, name)) AS name, max(dice) AS dice FROM scored WHERE dice >= {LEAST} GROUP BY doc_id, b),
best AS (
  SELECT doc_id, arg_min(name, (-dice, name)) AS licence, max(dice) AS dice, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, count(DISTINCT b) AS n_units
  FROM hit GROUP BY doc_id)
SELECT d.doc_id, b.licence, round(coalesce(b.dice, 0), 6)::DOUBLE AS dice, coalesce(b.licences, '') AS licences, coalesce(b.n_units, 0)::BIGINT AS n_units
FROM documents d LEFT JOIN best b USING (doc_id)"""


SQL = _sql()
