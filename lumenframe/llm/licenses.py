"""Licence scan: TF-IDF cosine of statements to templates, then inheritance from the nearest licensed directory above.

DataFrame and SQL functions only, on sparse term rows. A text's statements are its lines, its sentences, and
its sentences and clauses over wrapped lines. Files take the licence of their own best statement;
files without one take that of the nearest directory above them that holds a licence file.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import stage

#: What headers and licence files say, by licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright to the public domain",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Proprietary": "All rights reserved",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
#: Names, versions and kinds of licences that come in families, as their texts spell them.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
COMMONS_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
GNU = {"GPL": ("GNU General Public License", {"1.0": "1", "2.0": "2", "3.0": "3"}), "LGPL": ("GNU Lesser General Public License", {"2.1": "2.1", "3.0": "3"}), "AGPL": ("GNU Affero General Public License", {"3.0": "3"})}
FAMILIES = {
    "Apache": (("1.0", "1.1", "2.0"), ("Apache License, Version {}", "Apache Software License, Version {}", "Licensed under the Apache License, Version {}")),
    "MPL": (("1.0", "1.1", "2.0"), ("Mozilla Public License Version {}", "The contents of this file are subject to the Mozilla Public License Version {}")),
    "EPL": (("1.0", "2.0"), ("Eclipse Public License - v {}", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v{}")),
    "BSL": (("1.0",), ("Boost Software License - Version {}", "Distributed under the Boost Software License, Version {}")),
}
GNU_TEXTS = (
    "{} Version {}",
    "This work is licensed under the {}, version {}",
    "This program is free software you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or at your option any later version",
)
#: Headings and sentences of licence files that tell a licence, by licence.
TEXTS = {
    "AGPL-3.0": ("GNU Affero General Public License Version 3, 19 November 2007", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"),
    "Apache-2.0": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the License)",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": (
        "BSD 3-Clause License",
        "The 3-Clause BSD License",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    "GPL-2.0": ("GNU General Public License Version 2, June 1991",),
    "GPL-3.0": ("GNU General Public License Version 3, 29 June 2007", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    "ISC": ("ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    "LGPL-2.0": ("GNU Library General Public License Version 2, June 1991", "GNU Library General Public License, version 2"),
    "LGPL-2.1": (
        "GNU Lesser General Public License Version 2.1, February 1999",
        "This library is free software you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or at your option any later version",
    ),
    "LGPL-3.0": (
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "This library is free software you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or at your option any later version",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
    ),
    "MIT": (
        "MIT License",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    "MPL-2.0": ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",),
    "Unlicense": (
        "The Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ),
    "Zlib": ("zlib License", "This software is provided as-is, without any express or implied warranty", "In no event will the authors be held liable for any damages arising from the use of this software"),
}
#: Sentences that several licences share; they count where no other statement of a text tells a licence.
SHARED = {
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    "MIT": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
}
#: Words that tell variants and versions of a licence apart, by what they say. A statement matches a template
#: only if it says the same of these; a template without a number takes any.
MARKS = {
    "share alike": ("sharealike", "alike", "sa"), "non-commercial": ("noncommercial", "commercial", "nc"), "no derivatives": ("noderivatives", "noderivs", "derivatives", "nd"),
    "affero": ("affero", "agpl", "agplv3"), "lesser": ("lesser", "lgpl", "lgplv2", "lgplv3"),
    "1": ("1", "v1", "gplv1"), "2": ("2", "v2", "gplv2", "lgplv2"), "3": ("3", "v3", "gplv3", "lgplv3", "agplv3"), "4": ("4", "v4"), "5": ("5",),
}
#: Words of which a text that is looked at holds one.
HINT = r"(?i)licen[sc]|copyright|permission|redistribution|software|creative commons|cc0|public domain|rights reserved|spdx"
#: The least cosine of a match; salts of a lookup by directory.
THRESHOLD, SALTS = 0.75, 32
#: Ends of statements and the gaps between words, for Spark and for SQL engines with RE2 alike.
STATEMENT, GAP = r"\n|[.!?;] ", r"[^\p{L}\p{N}]+"
#: Wrapped lines: a line's end before a line with a word, and the marks of a comment that begin that line. Ends of sentences and clauses over them.
WRAP, SENTENCE, CLAUSE = r"[^\S\n]*\n[^\p{L}\p{N}\n]*([\p{L}\p{N}])", r"\n|[.!?]\s", r"\n|[.!?;:]\s"
#: Names of licence files.
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([-._].*)?$"


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), GAP), lambda w: w != "")


def document_frequencies(df: DataFrame, text: str, terms: list[str]) -> dict[str, float]:
    """Smoothed inverse document frequency of each term over all rows; a word that is no term has that of no row, key ''."""
    known = F.array(*map(F.lit, terms))
    found = df.select(F.explode(F.array_intersect(words_of(F.col(text)), known)).alias("w")).groupBy("w").count().collect()  # a row for each term
    n, seen = df.count(), {r["w"]: r["count"] for r in found}
    return {t: math.log((n + 1) / (seen.get(t, 0) + 1)) + 1 for t in [*terms, ""]}


def _anchors(idf: dict[str, float], threshold: float, texts: list[str]) -> list[str]:
    """Terms of which every matching statement holds one: a template's other terms together stay below the threshold."""
    out: set[str] = set()
    for template in texts:
        count = {w: words(template).count(w) for w in words(template)}
        weight = sorted(((count[w] * idf[w]) ** 2, w) for w in count)
        limit, rest = threshold**2 * sum(x for x, _ in weight) * (1 - 1e-9), 0.0
        for x, w in weight:
            rest += x
            if rest >= limit:
                out.add(w)
    return sorted(out)


class Template(NamedTuple):
    """A licence's statement: ``level`` 0 tells the licence, 1 is shared by several, 2 says least; ``need``: how many of its words must be there."""

    license: str
    text: str
    level: int
    need: int

    def marks(self) -> tuple[int, int]:
        """The bits of ``MARKS`` that a statement must have, and those that it is compared by."""
        own, every = set(words(self.text)), [*MARKS]
        bits = sum(1 << i for i, k in enumerate(every) if not own.isdisjoint(MARKS[k]))
        digits = sum(1 << i for i, k in enumerate(every) if k.isdigit())
        return bits, (1 << len(every)) - 1 if bits & digits else (1 << len(every)) - 1 - digits


def mark_bits() -> dict[str, int]:
    """The bits of ``MARKS`` that a word says."""
    return {w: sum(1 << i for i, k in enumerate(MARKS) if w in MARKS[k]) for k in MARKS for w in MARKS[k]}


def templates() -> list[Template]:
    """All templates, in a fixed order: single statements, families by variant and version, licence files, SPDX lines.

    Short headings and SPDX lines must be there with all their words ("mit" alone is a German word), others with half, and three at least.
    """
    told: list[tuple[str, str, int, bool]] = [(name, TEMPLATES[name], {"Proprietary": 2, "BSD-3-Clause": 1}.get(name, 0), False) for name in sorted(TEMPLATES)]
    for code, name in COMMONS.items():
        for version, kind in COMMONS_VERSIONS.items():
            own = f"CC-{code}-{version}"
            told += [(own, f"Creative Commons {name} {version} {kind}", 0, False), (own, f"This work is licensed under a Creative Commons {name} {version} {kind} License", 0, False)]
            told += [(own, f"Licensed under CC {code} {version}", 0, False), (own, f"CC {code} {version}", 0, True)]
    for code, (name, versions) in GNU.items():
        for version, short in versions.items():
            told += [(f"{code}-{version}", text.format(name, short), 0, False) for text in GNU_TEXTS]
            told += [(f"{code}-{version}", f"Licensed under the {code}v{short}", 0, True)]
    for code, (versions, texts) in FAMILIES.items():
        told += [(f"{code}-{version}", t, 0, len(set(words(t))) < 6) for version in versions for t in (text.format(version) for text in texts)]
    for level, table in ((0, TEXTS), (1, SHARED)):
        told += [(name, text, level, len(words(text)) <= 6) for name in sorted(table) for text in table[name]]
    named = sorted({name for name, _, level, _ in told if level < 2})
    told += [(name, f"SPDX-License-Identifier: {name}", 0, True) for name in named]
    unique = {(name, tuple(words(text))): (name, text, level, need) for name, text, level, need in reversed(told)}
    size = {text: len(set(words(text)) - {"the"}) for _, text, _, _ in told}
    return [Template(name, text, level, size[text] if need else max(min(3, size[text]), size[text] // 2)) for name, text, level, need in reversed(unique.values())]


def postings(spark: SparkSession, idf: dict[str, float]) -> DataFrame:
    """A row for each term: w, square (of its weight), marks, postings (template, weight over the template's norm, need, its marks)."""
    rows: dict[str, list[str]] = {}
    for i, t in enumerate(templates()):
        own, (bits, care) = words(t.text), t.marks()
        size = math.sqrt(sum((own.count(w) * idf[w]) ** 2 for w in set(own)))
        for w in sorted(set(own)):
            need = int(w != "the")
            rows.setdefault(w, []).append(f"named_struct('template', {i}, 'weight', {own.count(w) * idf[w] ** 2 / size!r}D, 'need', {need}, 'bits', {bits}, 'care', {care})")
    bits_of = mark_bits()
    values = [f"('{w}', {idf[w] ** 2!r}D, {bits_of.get(w, 0)}, array({', '.join(cells)}))" for w, cells in sorted(rows.items())]
    none = "cast(array() AS array<struct<template: int, weight: double, need: int, bits: int, care: int>>)"
    values += [f"('{w}', {idf[''] ** 2!r}D, {bits}, {none})" for w, bits in sorted(bits_of.items()) if w not in rows]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(values)} AS t(w, square, marks, postings)")


def statements(text: Column, idf: dict[str, float], threshold: float) -> Column:
    """The distinct lines, sentences, and sentences and clauses over wrapped lines that a template may match, of texts with a ``HINT``.

    Only statements with an anchor term are taken, which leaves none out that reaches the threshold.
    """
    anchors = F.array(*map(F.lit, _anchors(idf, threshold, [t.text for t in templates()])))
    joined = F.regexp_replace(text, WRAP, " $1")
    every = F.array_distinct(F.concat(F.split(text, STATEMENT), F.split(joined, SENTENCE), F.split(joined, CLAUSE)))
    held = F.filter(every, lambda s: F.arrays_overlap(F.split(F.lower(s), GAP), anchors))
    return F.when(text.rlike(HINT), held).otherwise(F.array().cast("array<string>"))


def own_licenses(rows: DataFrame, idf: dict[str, float], threshold: float = THRESHOLD) -> DataFrame:
    """row, own_license and own_cosine of the rows (row, statements) with a match: that of the best template of any statement.

    Statements are sparse rows (statement, word, count); they meet the templates' postings by an equi-join on the word,
    and dot products are sums by statement and template. Templates whose variant or version a statement doesn't name
    fall out before the sums. The best is that of the lowest level, then the highest cosine, then the name that sorts first.
    """
    spark = rows.sparkSession
    held = rows.where(F.size("statements") > 0).select("row", F.posexplode("statements").alias("pos", "s")).select("row", "pos", F.explode(words_of(F.col("s"))).alias("w"))
    counted = held.repartition("row", "pos").groupBy("row", "pos", "w").agg(F.count(F.lit(1)).cast("double").alias("c"))
    met = counted.join(F.broadcast(postings(spark, idf)), "w", "left")  # a row for each word of a template
    square = F.col("c") * F.col("c") * F.coalesce("square", F.lit(idf[""] ** 2))
    each = met.groupBy("row", "pos").agg(F.sum(square).alias("norm"), F.bit_or(F.coalesce("marks", F.lit(0))).alias("marks"), F.collect_list(F.when(F.size("postings") > 0, F.struct("c", "postings"))).alias("met"))
    fits = lambda x: F.col("marks").bitwiseAND(x["care"]) == x["bits"]
    cells = F.flatten(F.transform("met", lambda m: F.transform(F.filter(m["postings"], fits), lambda x: F.struct(x["template"].alias("template"), (x["weight"] * m["c"]).alias("dot"), x["need"].alias("need")))))
    dots = each.select("row", "pos", "norm", F.inline(cells)).groupBy("row", "pos", "norm", "template").agg(F.sum("dot").alias("dot"), F.sum("need").alias("needed"))
    facts = F.array(*(F.struct(F.lit(t.license).alias("license"), F.lit(t.level).alias("level"), F.lit(t.need).alias("need")) for t in templates()))
    scored = dots.withColumn("fact", F.get(facts, F.col("template"))).where("needed >= fact.need").select("row", F.round(F.col("dot") / F.sqrt("norm"), 6).alias("cosine"), "fact.*")
    best = F.min(F.struct("level", (-F.col("cosine")).alias("c"), "license")).alias("b")
    return scored.where(F.col("cosine") >= threshold).groupBy("row").agg(best).select("row", F.col("b.license").alias("own_license"), (-F.col("b.c")).alias("own_cosine"))


def _salted(probe: DataFrame, table: DataFrame, key: str, salt: Column, how: str) -> DataFrame:
    """Equi-join on ``key`` where a few keys may hold most rows of ``probe``; ``table`` has one row a key."""
    left = probe.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def inherit(files: DataFrame) -> DataFrame:
    """``files`` (path, own_license, own_cosine, ...) with license and license_from.

    license_from is the path of the file itself, or of the directory whose licence file gave the licence: the
    nearest one at or above the file's own. A directory's licence is that of its licence file with the highest
    cosine, ties to the name that sorts first. Paths begin with '/'; null paths inherit nothing.
    """
    folder = F.coalesce(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit(""))
    held = files.withColumn("_dir", F.when(F.col("path").isNotNull(), folder))
    is_file = F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAME)
    licensed = held.where(is_file & F.col("own_license").isNotNull()).groupBy(F.col("_dir").alias("above")).agg(F.min(F.struct((-F.col("own_cosine")).alias("c"), F.col("own_license").alias("l")))["l"].alias("found"))
    parts = F.split("_dir", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above"))))
    levels = held.where(F.col("_dir").isNotNull()).select("_dir").distinct().select("_dir", above.alias("a")).select("_dir", "a.depth", "a.above")
    near = _salted(levels, licensed, "above", F.xxhash64("_dir"), "inner").groupBy("_dir").agg(F.max(F.struct("depth", "above", "found")).alias("n"))
    near = near.select("_dir", F.col("n.above").alias("_above"), F.col("n.found").alias("_found"))
    joined = _salted(held, near, "_dir", F.xxhash64("path"), "left")
    own = F.col("own_license").isNotNull()
    inherited = F.when(F.col("_found").isNotNull(), F.when(F.col("_above") == "", F.lit("/")).otherwise(F.col("_above")))
    return joined.withColumn("license", F.coalesce("own_license", "_found")).withColumn("license_from", F.when(own, F.col("path")).otherwise(inherited)).drop("_dir", "_above", "_found")


def scan(df: DataFrame, path: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, path, own_license, own_cosine, license and license_from of every row.

    Document frequencies are counted over all rows' whole texts. Null and empty texts have no licence of their
    own; repeated rows get equal results; an empty table has none.
    """
    terms = sorted({w for t in templates() for w in words(t.text)})
    read = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keep)), path.alias("path"), F.col(text).alias("t"))
    idf = document_frequencies(read, "t", terms)
    kept = [f"k{i}" for i in range(len(keep))]
    rows = stage(read.select(F.monotonically_increasing_id().alias("row"), *kept, "path", statements(F.col("t"), idf, threshold).alias("statements")), "license-statements")
    own = stage(own_licenses(rows.select("row", "statements"), idf, threshold), "licenses")
    found = inherit(rows.drop("statements").join(own, "row", "left").drop("row"))
    return found.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keep)), "path", "own_license", "own_cosine", "license", "license_from")
