"""License scan by diagonal voting.

All rolling hashes of ``GRAM`` words of a text are joined to their places in the license
templates. Each hit votes for a diagonal, its place less the template's place. Neighbouring
diagonals are merged, so that a few inserted or lost words do not split a vote, and a
merged span is verified by the share of the template's words that its hits cover, and by
the template's key words. A label has several templates: names and short notices
(``TEMPLATES``) and passages of license texts (``PASSAGES``). Mentions of fewer than ``GRAM`` words ("MIT licensed") have no hits.

Null and empty texts have no words and no labels. Repeated rows are scanned alike; an
empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let, stored, text_of

GRAM = 3
#: Diagonals at most this far apart are merged; least share of a template's words in a verified span.
NEAR, COVER = 4, 0.6
#: What separates words: ASCII other than digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Well-known wordings of public licenses and their notices, several to a label. Words in braces tell
# the license from those with like wordings: all 3-grams in them must be hit, whatever the share of the rest.
TEMPLATES = {
    "agpl-3.0": (
        "it under the terms of the {GNU Affero General Public License} as published by the Free Software Foundation",
        "{GNU Affero General Public License}",
        "{License identifier AGPL}",
        "{Licensed under AGPL}",
        "{under the AGPL}",
    ),
    "all-rights-reserved": ("All rights reserved",),
    "apache-2.0": (
        "Licensed under the {Apache License Version} 2.0 (the License); you may not use this file except in compliance with the License",
        "{Apache License Version 2}",
        "{Apache License 2.0}",
        "{Apache License v2}",
        "{Apache 2.0 License}",
        "{under Apache 2.0}",
        "{License identifier Apache 2}",
        "unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "{the BSD License}",
        "{BSD style License}",
        "{under BSD License}",
    ),
    "bsd-2-clause": ("{BSD 2 Clause}", "{2 Clause BSD}"),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "{BSD 3 Clause}",
        "{3 Clause BSD}",
    ),
    "cc-by-4.0": (
        "This work is licensed under a Creative {Commons Attribution 4}.0 International License",
        "{Commons Attribution 4.0}",
        "{under CC BY 4}.0",
        "{License CC BY 4}.0",
        "{the CC BY 4}.0",
        "{identifier CC BY 4}.0",
    ),
    "cc-by-nc-4.0": ("Licensed under {CC BY NC 4.0}", "{CC BY NC 4.0}", "Creative Commons {Attribution NonCommercial 4}.0 International"),
    "cc-by-nc-nd-4.0": ("{CC BY NC ND 4.0}", "Creative Commons {Attribution NonCommercial NoDerivatives 4}.0 International"),
    "cc-by-nc-sa-4.0": ("{CC BY NC SA 4.0}", "Creative Commons {Attribution NonCommercial ShareAlike 4}.0 International"),
    "cc-by-nd-4.0": ("{CC BY ND 4.0}", "Creative Commons {Attribution NoDerivatives 4}.0 International"),
    "cc-by-sa-4.0": (
        "Licensed under {CC BY SA 4.0}",
        "{CC BY SA 4.0}",
        "Creative Commons {Attribution ShareAlike 4}.0 International",
        "By exercising the Licensed Rights You accept and agree to be bound by the terms and conditions of this Creative Commons {Attribution ShareAlike 4}.0 International Public License",
    ),
    "cc0-1.0": (
        "The person who associated a work with this deed has dedicated the work to the public domain",
        "{CC0 1.0 Universal}",
        "{under CC0 1.0}",
        "{identifier CC0 1.0}",
    ),
    "gpl-2-notice": (
        "This work is licensed under the {GNU General Public License, version 2}",
        "{General Public License version 2}",
        "{General Public License v2}",
        "modify it under the terms of the {GNU General Public License} as published by the Free Software Foundation; {either version 2} of the License",
        "{identifier GPL 2}.0",
        "{under GPL 2}.0",
        "{under the GPLv2}",
        "{License version 2 June 1991}",
    ),
    "gpl-3-notice": (
        "This work is licensed under the GNU General Public {License, version 3}",
        "{GNU General Public License version 3}",
        "{GNU General Public License v3}",
        "{License identifier GPL 3}.0",
        "{under GPL 3}.0",
        "{under the GPLv3}",
        "{GNU General Public License Version 3 29 June 2007}",
    ),
    "gpl-or-later": ("This program is free software: you can redistribute it and/or modify it under the terms of the {GNU General Public} License as published by the Free Software Foundation",),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "{the ISC License}",
        "{under ISC License}",
        "{License identifier ISC}",
        "{ISC License Copyright}",
    ),
    "lgpl": (
        "you can redistribute it and/or modify it under the terms of the {GNU Lesser General Public License} as published by the Free Software Foundation",
        "{GNU Lesser General Public License}",
        "{GNU Library General Public License}",
        "{License identifier LGPL}",
        "{Licensed under LGPL}",
        "{under the LGPL}",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "{the MIT License}",
        "{under MIT License}",
        "{an MIT License}",
        "{MIT License Copyright}",
        "{MIT License MIT}",
        "{Licensed under MIT}",
        "{Released under MIT}",
        "{License identifier MIT}",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the {Mozilla Public License}, v. 2.0",
        "{Mozilla Public License version 2}",
        "{Mozilla Public License 2}.0",
        "{Mozilla Public License v 2}.0",
        "{identifier MPL 2}.0",
        "{under MPL 2}.0",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain", "{under the Unlicense}", "{License identifier Unlicense}"),
}

# Passages of the licenses' own texts, of at least 20 words each. Braces as above.
PASSAGES = {
    "agpl-3.0": (
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, {specifically designed to} ensure cooperation with the community in the case of network server software",
    ),
    "apache-2.0": (
        "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
        "You must retain, in the Source form of any Derivative Works that You distribute, all copyright, patent, trademark, and attribution notices from the Source form of the Work",
    ),
    "bsd": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS",
    ),
    "cc-by-4.0": ("By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this Creative {Commons Attribution 4}.0 International Public License",),
    "cc-by-nc-4.0": ("By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this Creative Commons {Attribution NonCommercial 4}.0 International Public License",),
    "cc-by-nc-nd-4.0": ("By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this Creative Commons {Attribution NonCommercial NoDerivatives 4}.0 International Public License",),
    "cc-by-nc-sa-4.0": ("By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this Creative Commons {Attribution NonCommercial ShareAlike 4}.0 International Public License",),
    "cc-by-nd-4.0": ("By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this Creative Commons {Attribution NoDerivatives 4}.0 International Public License",),
    "cc0-1.0": ("dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law",),
    "gpl-2-notice": (
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General {Public License is intended} to guarantee your freedom to share and {change free software} to make sure the software is free for all its users",
    ),
    "gpl-3-notice": (
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General {Public License is intended} to guarantee your freedom to share and change {all versions of} a program",
    ),
    "isc": (
        "THE SOFTWARE IS PROVIDED AS IS AND {THE AUTHOR DISCLAIMS} ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES",
    ),
    "lgpl": (
        "This license, the {Lesser General Public} License, applies to some specially designated software packages, typically libraries, of the Free Software Foundation and other authors who decide to use it",
        "This version of the GNU {Lesser General Public} License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
    ),
    "mit": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE",
    ),
    "mpl-2.0": (
        "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions",
    ),
    "unlicense": ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",),
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BREAK, -1), "")


def _grams(w: Column) -> Column:
    places = F.sequence(F.lit(0), F.size(w) - GRAM)
    return F.when(F.size(w) < GRAM, F.array().cast("array<bigint>")).otherwise(F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(GRAM)])))


def _starts(w: Column) -> Column:
    """Places where a phrase's words stand one after another."""

    def any_at(i: Column) -> Column:
        found = F.lit(False)
        for phrase in PHRASES:
            here = F.lit(True)
            for j, x in enumerate(phrase.split()):
                here = here & F.coalesce(F.get(w, i + j) == x, F.lit(False))
            found = found | here
        return found

    return F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.size(w) - 1), any_at))


def _base(w: Column) -> Column:
    names = lambda at: F.array_sort(F.array_distinct(F.transform(at, lambda i: _label(F.get(w, i)))))
    return let(
        _starts(w),
        lambda at: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.size(at).cast("bigint").alias("n_base"),
            F.array_min(at).cast("bigint").alias("first_word"),
            F.array_max(at).cast("bigint").alias("last_word"),
            names(at).alias("names"),
        ),
    )


def _label(first: Column) -> Column:
    out = F.lit(None).cast("string")
    for phrase, name in PHRASES.items():
        out = F.when(first == phrase.split()[0], name).otherwise(out)
    return out


def _parsed(template: str) -> tuple[list[str], list[int]]:
    """A template's words, and the places of the k-grams that lie within its braces."""
    found: list[str] = []
    keys: list[int] = []
    for k, part in enumerate(re.split("[{}]", template.lower())):
        own = [x for x in re.split(BREAK, part) if x]
        if k % 2:
            keys += range(len(found), len(found) + len(own) - GRAM + 1)
        found += own
    return found, keys


def templates(docs: DataFrame) -> DataFrame:
    """Word k-grams of the templates: some hundred rows, whatever the corpus. ``keys`` are the places that must be hit."""
    split = [(k, n, *_parsed(v)) for k, short in TEMPLATES.items() for n, v in enumerate((*short, *PASSAGES.get(k, ())))]
    rows = docs.sparkSession.createDataFrame([(k, n, " ".join(w), len(w), keys) for k, n, w, keys in split], "template string, variant int, words string, size int, keys array<int>")
    return rows.select("template", "variant", "size", "keys", F.posexplode(_grams(F.split("words", " "))).alias("t", "gram"))


def hits(docs: DataFrame) -> DataFrame:
    """Verified spans: key columns, template, first and last word, share of the template."""
    grams = docs.select("_id", "_same", F.posexplode(let(words(F.col("_text")), _grams)).alias("p", "gram"))
    votes = stored(grams.join(F.broadcast(templates(docs)), "gram").groupBy("_id", "_same", "template", "variant", "size", "keys", (F.col("p") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"), F.count("*").alias("n")))
    one = Window.partitionBy("_id", "_same", "template", "variant").orderBy("diagonal")
    far = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(one) > NEAR).cast("int"), F.lit(1))
    merged = votes.withColumn("far", far).withColumn("span", F.sum("far").over(one))
    spans = merged.groupBy("_id", "_same", "template", "variant", "size", "keys", "span").agg(
        F.array_distinct(F.flatten(F.collect_set("ts"))).alias("ts"),
        F.min(F.col("diagonal") + F.array_min("ts")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("ts") + GRAM - 1).alias("last"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + GRAM - 1)))))
    whole = F.size(F.array_except("keys", "ts")) == 0
    return spans.withColumn("share", covered / F.col("size")).where((F.col("share") >= COVER) & whole)


def op8(docs: DataFrame) -> DataFrame:
    inner = docs.select("doc_id", text_of().alias("_text")).select(F.col("doc_id").alias("_id"), F.xxhash64("_text", F.length("_text")).alias("_same"), "_text")
    base = inner.select("_id", "_same", let(words(F.col("_text")), _base).alias("b"))
    more = hits(inner).groupBy("_id", "_same").agg(F.collect_set("template").alias("new"), F.max("share").alias("score")).withColumnsRenamed({"_id": "_id2", "_same": "_same2"})
    names = F.col("b.names")
    return base.join(more, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_same") == F.col("_same2")), "left").select(
        F.col("_id").alias("doc_id"),
        "b.n_words",
        "b.n_base",
        "b.first_word",
        "b.last_word",
        F.array_join(names, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(names, F.coalesce(F.col("new"), F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
