"""Licence scans by the Dice coefficient over word bigrams, in DataFrame functions alone.

Each line of a document is compared with the licence templates, and so are windows of consecutive words, as a notice can be
wrapped over lines or stand inside a longer one. A document goes on only if it holds enough bigrams of some template. A
template is a candidate for a line only if their numbers of bigrams are close enough (2 min / (a + b) >= threshold); its
windows start and end with its own bigrams, are no longer than that bound allows and hold at least as many of its bigrams as
the threshold needs. All of it happens in the row, so nothing is shuffled and no document meets another.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and wordings of the notices looked for.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Lower case, and every run of characters other than letters and digits is one space.
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(line: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(line), NOT_WORD, " "), " "), lambda w: w != "")


def pairs(own: Column | str) -> Column:
    """Word bigrams in their order."""
    return F.zip_with(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def bigrams(own: Column) -> Column:
    """Distinct word bigrams; those of a single word are the word itself."""
    return F.array_distinct(F.when(F.size(own) == 1, own).otherwise(pairs(own)))


def spot(dice: Column, kind: Column, start: Column, end: Column, licence: Column, line: Column, last: Column) -> Column:
    """A match by its first and last bigram and line; the better of two is the smaller one."""
    return F.struct((-dice).alias("less"), kind.alias("kind"), (start - end).alias("shorter"), start.alias("start"), licence.alias("licence"), end.alias("end"), line.alias("line"), last.alias("last"))


def meets(a: Column, b: Column) -> Column:
    return (a["start"] <= b["end"]) & (b["start"] <= a["end"])


def plain(wording: str) -> list[str]:
    """A template's words."""
    import regex

    return regex.sub(NOT_WORD, " ", wording.lower()).split()


def known(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, list[str]]]:
    """Names and bigrams of the templates, by the same rule as for lines."""
    out = []
    for name, wording in templates:
        own = plain(wording)
        out.append((name, sorted({f"{a} {b}" for a, b in zip(own, own[1:])} or set(own))))
    return out


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, matches) of every row: an array of (line, licence, dice), one for each line (from 1) that some template reaches,
    and one for each further passage, at the line of its first word.

    Of several templates the largest coefficient counts, then the first name. A line that is a notice counts as a whole;
    passages are windows of words that are no part of such a notice, of several that overlap the one with the largest
    coefficient, then the longest. A passage over a line's end replaces a line that has a smaller coefficient. Templates of
    one word are only looked for as lines. ``templates`` is a fixed table that is part of the plan. Null and empty texts have
    no matches; repeated rows repeat, null ids stay null.
    """
    table = known(templates)
    sizes = [len(b) for _, b in table]
    # A line with n distinct bigrams has at least n + 1 words, and the shortest word and the space after it have two characters.
    least, most = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold
    # Of t bigrams, those shared have to be at least threshold (n + t) / 2 with n no smaller than them; n has its bound as above.
    # A window is as long in words, repeated ones counted, as that bound allows for the template's own words.
    bounds = [(math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(max(n, len(plain(wording)) - 1) * (2 - threshold) / threshold + 1e-9)) for n, (_, wording) in zip(sizes, templates)]
    literal = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(len(b)).alias("n"), F.lit(need).alias("need"), F.lit(longest).alias("longest"), F.lit(len(plain(wording)) > 1).alias("windows"), F.array(*map(F.lit, b)).alias("bigrams")) for (name, b), (need, longest), (_, wording) in zip(table, bounds, templates)))
    every = F.array(*map(F.lit, sorted({b for _, own in table for b in own})))

    # A row goes on only if it holds enough of some template's bigrams anywhere; the lines and windows of others cannot match.
    split = docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("text"), words(F.col(text_column)).alias("words"))
    paired = split.select(id_column, "text", (F.concat(pairs("words"), "words") if any(len(plain(w)) == 1 for _, w in templates) else pairs("words")).alias("pairs"))
    shared = paired.select(id_column, "text", F.array_intersect(every, "pairs").alias("held"))
    enough = F.exists(literal, lambda t: F.size(F.array_intersect(t["bigrams"], F.col("held"))) >= t["need"])
    likely = shared.select(id_column, "held", F.when((F.size("held") > 0) & enough, F.split("text", "\n")).alias("lines"))
    lined = likely.select(id_column, "held", F.transform("lines", words).alias("lines"))

    def compared(line: Column, own: Column) -> Column:
        n = F.size(own)
        near = F.filter(literal, lambda t: 2 * F.least(t["n"], n) >= threshold * (t["n"] + n))
        dice = F.transform(near, lambda t: F.struct((2 * F.size(F.array_intersect(t["bigrams"], own)) / (t["n"] + n)).alias("dice"), t["name"].alias("licence")))
        best = F.array_max(F.transform(dice, lambda d: d["dice"]))
        return F.struct(line.alias("line"), F.array_min(F.transform(F.filter(dice, lambda d: d["dice"] == best), lambda d: d["licence"])).alias("licence"), best.alias("dice"))

    own = F.transform("lines", lambda w, i: F.struct((i + 1).alias("line"), bigrams(w).alias("own")))
    fitting = F.filter(own, lambda x: F.size(x["own"]).between(int(least), int(most) + 1) & F.arrays_overlap(x["own"], F.col("held")))
    whole = F.filter(F.transform(fitting, lambda x: compared(x["line"], x["own"])), lambda m: m["dice"] >= threshold)
    flat = lined.select(id_column, "held", whole.alias("whole"), F.flatten("lines").alias("words"), F.flatten(F.transform("lines", lambda w, i: F.array_repeat(i + 1, F.size(w)))).alias("at"))
    flat = flat.select(id_column, "held", "whole", "at", pairs("words").alias("pairs"))
    # Places of known bigrams, with the lines of their two words.
    hits = F.filter(F.transform("pairs", lambda g, i: F.struct((i + 1).alias("p"), g.alias("g"))), lambda h: F.array_contains(F.col("held"), h["g"]))
    hits = F.transform(hits, lambda h: F.struct(h["p"].alias("p"), h["g"].alias("g"), F.get("at", h["p"] - 1).alias("a"), F.get("at", h["p"]).alias("b")))
    placed = flat.select(id_column, "held", "whole", "pairs", hits.alias("hits"))

    def noted(m: Column) -> Column:
        """A line's match, with the places of the first and last bigram that it has from its licence."""
        of = F.filter("hits", lambda h: (h["a"] == m["line"]) & (h["b"] == m["line"]) & F.exists(literal, lambda t: (t["name"] == m["licence"]) & F.array_contains(t["bigrams"], h["g"])))
        places = F.transform(of, lambda h: h["p"])
        return spot(m["dice"], F.lit(0), F.coalesce(F.array_min(places), F.lit(0)), F.coalesce(F.array_max(places), F.lit(-1)), m["licence"], m["line"], m["line"])

    def windows(t: Column) -> Column:
        """The best window from each place on: it starts and ends with a bigram of the template, as others are no better."""
        own = F.filter("hits", lambda h: F.array_contains(t["bigrams"], h["g"]))

        def best(h: Column, i: Column, own: Column) -> Column:
            ends = F.filter(F.slice(own, i + t["need"], t["longest"]), lambda e: e["p"] - h["p"] < t["longest"])

            def measured(e: Column) -> Column:
                part = F.slice(F.col("pairs"), h["p"], e["p"] - h["p"] + 1)
                return spot(2 * F.size(F.array_intersect(t["bigrams"], part)) / (t["n"] + F.size(F.array_distinct(part))), F.lit(1), h["p"], e["p"], t["name"], h["a"], e["b"])

            near = F.filter(F.slice(own, i + 1, t["longest"]), lambda e: e["p"] - h["p"] < t["longest"])
            varied = F.size(F.array_distinct(F.transform(near, lambda e: e["g"]))) >= t["need"]
            return F.when((F.size(near) >= t["need"]) & varied, F.array_min(F.transform(ends, measured)))

        found = F.flatten(F.transform(F.array(own), lambda own: F.transform(own, lambda h, i: best(h, i, own))))
        return F.filter(found, lambda w: w.isNotNull() & (w["less"] <= -threshold))

    used = F.filter(literal, lambda t: t["windows"] & (F.size(F.array_intersect(t["bigrams"], F.col("held"))) >= t["need"]))
    found = placed.select(id_column, F.transform("whole", noted).alias("whole"), F.when(F.size("hits") > 0, F.flatten(F.transform(used, windows))).alias("windows"))
    # A window inside a line that is a notice is that notice.
    free = F.filter("windows", lambda w: ~F.exists("whole", lambda m: (m["line"] == w["line"]) & (m["last"] == w["last"]) & meets(m, w)))
    ranked = found.select(id_column, F.array_sort(F.concat("whole", F.coalesce(free, F.slice("whole", 1, 0)))).alias("all"))
    chosen = F.aggregate("all", F.slice("all", 1, 0), lambda kept, w: F.when(F.exists(kept, lambda m: meets(m, w)), kept).otherwise(F.concat(kept, F.array(w))))
    inorder = F.array_sort(F.transform(chosen, lambda m: F.struct(m["line"].alias("line"), m["start"].alias("start"), m["licence"].alias("licence"), (-m["less"]).alias("dice"))))
    return ranked.select(id_column, F.coalesce(F.transform(inorder, lambda m: F.struct(m["line"].alias("line"), m["licence"].alias("licence"), m["dice"].alias("dice"))), F.array().cast("array<struct<line:int,licence:string,dice:double>>")).alias("matches"))


def summary(scanned: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, licence, dice, n_matches, licences) of every row: its best match (null and 0 if none), how many lines match and
    the names found, sorted."""
    best = F.array_max(F.transform("matches", lambda m: m["dice"]))
    name = F.array_min(F.transform(F.filter("matches", lambda m: m["dice"] == best), lambda m: m["licence"]))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"]))), ",")
    return scanned.select(id_column, name.alias("licence"), F.coalesce(best, F.lit(0.0)).alias("dice"), F.size("matches").cast("long").alias("n_matches"), names.alias("licences"))
