"""License scans: lines and windows of texts compared with licence templates by the Dice coefficient over word bigrams.

Text is normalised (lower case, runs of other than ASCII letters and digits are one space); dice = 2 * common / (line or
window + template) over distinct bigrams, and 0.75 matches.  Two rules:

* A line that matches as a whole reports its best template (ties: the first by id).
* A window is a run of neighbouring bigrams of the whole text, across line ends, so notices wrapped over lines or standing
  inside longer lines are found.  A template of m bigrams has windows of at most m * (2 - t) / t bigrams (m counts
  repeats here); each opens and closes at one of the template's bigrams, since others at the ends only lower dice.
  Of a template's windows that share words the one of the highest dice stays, of different templates' the one with most
  common bigrams (then the line's own, the higher dice, the first id).  A window reports the line it begins in, unless
  a line it touches reports the same licence already; so a line can report several licences.

A match lacks at most m - ceil(m * t / (2 - t)) of its template's bigrams, so texts without any telling bigram go first.

Built-in functions only, one scan; only matches are shuffled.  The templates are a fixed table of some dozen rows.

Defined cases: null text has no lines; lines of under two words have no bigrams and match nothing; repeated rows each
report; null doc_id passes through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import table

THRESHOLD = 0.75
#: Notices by which public licences are granted.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-notice": "Released under the BSD License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def bigrams_of(text: str) -> set[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def size_bounds(m: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    return ceil(m * threshold / (2 - threshold) - 1e-9), floor(m * (2 - threshold) / threshold + 1e-9)


def reach(text: str, threshold: float = THRESHOLD) -> int:
    """Bigrams of the longest window, repeats counted."""
    return size_bounds(len(re.sub("[^a-z0-9]+", " ", text.lower()).split()) - 1, threshold)[1]


def telling_of(text: str, threshold: float = THRESHOLD) -> list[str]:
    """So many of a template's bigrams (the longest) that every match has one: it lacks at most m - ceil(m * t / (2 - t))."""
    grams = sorted(bigrams_of(text), key=lambda g: (-len(g), g))
    return grams[: len(grams) - size_bounds(len(grams), threshold)[0] + 1]


def telling(templates=None, threshold: float = THRESHOLD) -> set[str]:
    return {g for text in (templates or TEMPLATES).values() for g in telling_of(text, threshold)}


def _trie(words: list[str]) -> str:
    """One regular expression for a list of words, with common prefixes taken out."""
    heads = sorted({w[0] for w in words if w})
    parts = [h + _trie([w[1:] for w in words if w[:1] == h]) for h in heads]
    if not parts:
        return ""
    return "(?:" + "|".join(parts) + ")" + ("?" if "" in words else "")


def _normal(text):
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _pairs(words):
    """Neighbouring words joined; none of under two words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def _apart(windows):
    """In their order, the windows that share no word with one taken before."""
    shares = lambda x: lambda y: (y["start"] <= x["end"]) & (x["start"] <= y["end"])
    return F.aggregate(windows, F.slice(windows, 1, 0), lambda taken, x: F.when(F.exists(taken, shares(x)), taken).otherwise(F.concat(taken, F.array(x))))


def _candidates(docs: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """Texts with a telling bigram: their words, bigrams, the places of template bigrams, and the lines that have a telling one."""
    tells = r"\b" + _trie(sorted(telling(templates, threshold))) + r"\b"
    every = sorted({g for text in templates.values() for g in bigrams_of(text)})
    rows = docs.where(_normal("text").rlike(tells)).withColumn("row", F.monotonically_increasing_id())
    # Line ends stay as words of their own, so a word's line is the number of those before it.
    tokens = F.split(F.regexp_replace(F.regexp_replace(F.lower("text"), r"[^a-z0-9\n]+", " "), r"\n", " \n "), " +", -1)
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("no"), _normal(x).alias("norm")))
    lines = F.transform(F.filter(lines, lambda x: x["norm"].rlike(tells)), lambda x: F.struct(x["no"], F.split(x["norm"], " ", -1).alias("words")))
    rows = rows.select("row", "doc_id", tokens.alias("tokens"), lines.alias("lines"))
    rows = rows.withColumn("words", F.filter(F.transform("tokens", lambda x, i: F.struct(x.alias("w"), i.alias("at"))), lambda x: ~x["w"].isin("", "\n")))
    rows = rows.withColumn("lines", F.transform("lines", lambda x: F.struct(x["no"], F.array_distinct(_pairs(x["words"])).alias("grams"))))
    rows = rows.withColumn("pairs", _pairs(F.col("words.w")))
    hits = F.filter(F.transform("pairs", lambda g, i: F.struct(i.alias("at"), g.alias("gram"))), lambda x: x["gram"].isin(every))
    return rows.withColumn("hits", hits)


def scan(docs: DataFrame, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line_no, license_id, dice, n_bigrams."""
    templates = templates or TEMPLATES
    known = [(name, sorted(g := bigrams_of(text)), telling_of(text, threshold), size_bounds(len(g), threshold)[0], reach(text, threshold)) for name, text in sorted(templates.items())]
    known = docs.sparkSession.createDataFrame(known, "license_id string, t_grams array<string>, t_telling array<string>, low int, reach int")
    pairs = _candidates(docs, templates, threshold).join(F.broadcast(known), F.arrays_overlap("hits.gram", "t_telling"))
    common = lambda grams: F.size(F.array_intersect(grams, F.col("t_grams")))
    dice = lambda x: 2.0 * x["common"] / (x["n"] + F.size("t_grams"))

    # Lines as wholes.
    whole = F.transform("lines", lambda x: F.struct(x["no"], common(x["grams"]).alias("common"), F.size(x["grams"]).alias("n")))
    whole = F.filter(F.transform(whole, lambda x: F.struct(x["no"], (-dice(x)).alias("worst"), F.col("license_id"), x["n"])), lambda x: x["worst"] <= -threshold)
    # Windows: a start has enough of the template's bigrams within reach; its best end is the first of the highest dice.
    pairs = pairs.withColumn("hits", F.filter("hits", lambda x: F.array_contains("t_grams", x["gram"])).getField("at"))
    starts = F.filter("hits", lambda x, i: F.get("hits", i + F.col("low") - 1) - x < F.col("reach"))

    def best(start):
        ends = F.filter("hits", lambda x: (x - start >= F.col("low") - 1) & (x - start < F.col("reach")))
        cuts = F.transform(ends, lambda x: F.struct(x.alias("last"), F.slice("pairs", start + 1, x - start + 1).alias("grams")))
        cuts = F.transform(cuts, lambda x: F.struct(x["last"], common(x["grams"]).alias("common"), F.size(F.array_distinct(x["grams"])).alias("n")))
        return F.array_max(F.transform(cuts, lambda x: F.struct(dice(x).alias("dice"), x["common"], (-start).alias("back"), (-x["last"]).alias("stop"), x["n"], start.alias("start"), (x["last"] + 1).alias("end"))))

    pairs = pairs.withColumn("windows", F.filter(F.transform(starts, best), lambda x: x["dice"] >= threshold)).withColumn("whole", whole)
    pairs = pairs.where((F.size("whole") > 0) | (F.size("windows") > 0))
    pairs = pairs.withColumn("windows", F.sort_array("windows", False)).withColumn("windows", _apart(F.col("windows")))
    line = lambda word: F.size(F.filter(F.slice("tokens", 1, F.get("words", word)["at"]), lambda t: t == "\n"))
    windows = F.transform("windows", lambda x: F.struct((-x["common"]).alias("few"), (-x["dice"]).alias("worst"), F.col("license_id"), x["start"], x["end"], x["n"], line(x["start"]).alias("no"), line(x["end"]).alias("no_end")))

    # All of one text meet; a row id of its own keeps repeated rows apart.
    found = pairs.select("row", "doc_id", "whole", windows.alias("windows")).groupBy("row", "doc_id")
    found = found.agg(F.sort_array(F.flatten(F.collect_list("whole"))).alias("whole"), F.flatten(F.collect_list("windows")).alias("windows"))
    found = found.withColumn("whole", F.filter("whole", lambda x, i: (i == 0) | (F.get("whole", i - 1)["no"] != x["no"])))
    own = lambda x: F.exists("whole", lambda y: (y["license_id"] == x["license_id"]) & y["no"].between(x["no"], x["no_end"]))
    ranked = F.transform("windows", lambda x: F.struct(x["few"], (~own(x)).alias("more"), x["worst"], x["license_id"], x["start"], x["end"], x["n"], x["no"]))
    found = found.withColumn("windows", F.sort_array(ranked)).withColumn("windows", F.filter(_apart(F.col("windows")), lambda x: x["more"]))
    report = lambda x: F.struct(x["no"].alias("line_no"), x["license_id"], (-x["worst"]).alias("dice"), x["n"].alias("n_bigrams"))
    return found.select("doc_id", F.inline(F.concat(F.transform("whole", report), F.transform("windows", report))))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ", ".join(f"('{name}', [{', '.join(repr(g) for g in sorted(bigrams_of(text)))}])" for name, text in sorted(TEMPLATES.items()))
    return f"""
WITH t(license_id, tg) AS (VALUES {values}),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
w AS (SELECT doc_id, line_no, string_split(trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM lines),
g AS (SELECT doc_id, line_no, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS gs FROM w WHERE len(ws) > 1),
d AS (SELECT doc_id, line_no, license_id, len(gs) AS n_bigrams, 2.0::DOUBLE * len(list_intersect(gs, tg)) / (len(gs) + len(tg)) AS dice
      FROM g JOIN t ON len(list_intersect(gs, tg)) > 0)
SELECT doc_id, line_no::INT AS line_no, license_id, dice, n_bigrams::INT AS n_bigrams FROM d WHERE dice >= {THRESHOLD}
QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, license_id) = 1
"""


ORACLE_SQL = _sql()
