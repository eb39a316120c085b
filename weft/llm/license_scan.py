"""License scans: MinHash bands over text windows, verified by shingle containment.

Everything runs in DataFrame functions without a shuffle of texts. Words are
runs of a-z and 0-9 of the lower-cased text, shingles are runs of SHINGLE
words. Texts and templates are cut to overlapping windows of shingles and
signed alike by MinHash with one permutation: a band is the least of a window's
shingle hashes in the band's range of values. A join by band and value
retrieves the templates that share it, and each is verified by the share of its shingles that the text
holds there. Templates below SHINGLE words are one shingle of their own length
and compared word by word.

A template is found through windows of one width, by its number of shingles;
see WIDTHS. One changed word costs SHINGLE shingles, so a text that holds
CONTAINMENT of a short template keeps a run of it, with whole windows.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from weft.lineage import bounded, checkpointed
from weft.llm.common import bound

#: Words of a shingle.
SHINGLE = 5
#: Share of a template's shingles that its place in the text must hold.
CONTAINMENT = 0.8
#: Slots at most of the table of index values that every shingle is looked up in.
MOST_SLOTS = 1 << 16
#: Shingles of a part of a text, a multiple of all strides.
PART_SHINGLES = 512


class Width(NamedTuple):
    """Windows of templates with at least so many shingles."""

    least: int
    shingles: int
    stride: int
    #: Ranges of hash values, a power of two: each is a band of one row, its least hash.
    bands: int


#: Up to 15 shingles, 0.8 of them lie in one run (of 4 and more from 4 on) that
#: holds a whole window at stride 1, so that one band will do. From 16 on, some
#: text window holds 11 of the 16 shingles of a template's window, of at most 21
#: that either has: see collision().
WIDTHS = (Width(1, 1, 1, 1), Width(4, 4, 1, 1), Width(16, 16, 8, 16))


def collision(shared: int, either: int, bands: int) -> float:
    """Probability that windows with so many shingles, of which some are shared, have a band's least hash in common.

    Shingles fall in bands at random; the least hash of a band in use is a shared one in shared of either cases.
    """
    used = [1.0]  # probability that so many bands are in use
    for _ in range(either):
        used = [
            (used[n] * n / bands if n < len(used) else 0.0) + (used[n - 1] * (bands - n + 1) / bands if n else 0.0)
            for n in range(min(bands, len(used)) + 1)
        ]
    return 1 - sum(p * (1 - shared / either) ** n for n, p in enumerate(used))


# Public license notices, by SPDX identifier. A notice is cut to the words
# that tell it from its sisters: these hold less than CONTAINMENT of its shingles.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
     compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
     Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
     on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
     rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
     persons to whom the Software is furnished to do so, subject to the following conditions"""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """terms of the GNU General Public License as published by the Free Software
     Foundation, either version 3 of the License"""),
    ("GPL-2.0", """terms of the GNU General Public License as published by the Free Software
     Foundation, either version 2 of the License"""),
    # The opening of all BSD licenses; their clauses and what follows them tell which one it is.
    ("LicenseRef-BSD", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
     that the following conditions are met"""),
    ("BSD-2-Clause", "provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE"),
    ("BSD-3-Clause", """may be used to endorse or promote products derived from this software without specific prior written
     permission. THIS SOFTWARE IS PROVIDED BY THE"""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
     not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("LGPL-2.1", """terms of the GNU Lesser General Public License as published by the Free Software
     Foundation, either version 2.1 of the License"""),
    ("LGPL-3.0", """terms of the GNU Lesser General Public License as published by the Free Software
     Foundation, either version 3 of the License"""),
    ("AGPL-3.0", """terms of the GNU Affero General Public License as published by the Free Software
     Foundation, either version 3 of the License"""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
     granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("ISC", """Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby
     granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("0BSD", "with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
     held liable for any damages arising from the use of this software."""),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "terms of the Eclipse Public License 2.0"),
    ("EPL-2.0", "terms of the Eclipse Public License v2.0"),
    # Openings of full texts.
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", """"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by
     Sections 1 through 9 of this document."""),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    # Tags of five and more words; shorter ones are below.
    *(
        (license_id, f"SPDX-License-Identifier: {tag}")
        for license_id, tag in (
            ("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2.0"), ("GPL-3.0", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"),
            ("LGPL-3.0", "LGPL-3.0"), ("AGPL-3.0", "AGPL-3.0"), ("BSD-2-Clause", "BSD-2-Clause"),
            ("BSD-3-Clause", "BSD-3-Clause"), ("MPL-2.0", "MPL-2.0"), ("EPL-2.0", "EPL-2.0"), ("BSL-1.0", "BSL-1.0"),
            ("CC0-1.0", "CC0-1.0"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"),
            ("CC-BY-NC-4.0", "CC-BY-NC-4.0"),
        )
    ),
)

# Notices below SHINGLE words. No license but a reservation has a LicenseRef.
SHORT_TEMPLATES = (
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("Apache-2.0", "Apache License 2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
)


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.filter(found, lambda w: w != "")


def shingles_of(all_words: Column) -> Column:
    """Hashes of all runs of SHINGLE words."""
    return bound(all_words, _shingles)


def _shingles(words: Column) -> Column:
    last = F.size(words) - SHINGLE + 1
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(SHINGLE)]))


def _starts(hashes: Column, stride: int) -> Column:
    return F.when(F.size(hashes) > 0, F.sequence(F.lit(1), F.size(hashes), F.lit(stride))).otherwise(F.array().cast("array<int>"))


def _signatures(hashes: Column, n: int, keep, starts: Column | None = None) -> Column:
    """array<struct<at, band, value>> of the windows of the n-th width, where the value is kept.

    Windows begin at starts, or else at every stride. A window that lies at the
    end may have less shingles than its width.
    """
    width, first = WIDTHS[n], sum(w.bands for w in WIDTHS[:n])
    starts = _starts(hashes, width.stride) if starts is None else starts
    signature = lambda at, band, value: F.struct(at.alias("at"), band.alias("band"), value.alias("value"))
    if width.bands == 1:
        least = lambda at: F.get(hashes, at - 1)
        if width.shingles > 1:
            least = lambda at: F.least(*[F.get(hashes, at + (j - 1)) for j in range(width.shingles)])
        kept = F.filter(starts, lambda at: keep(least(at)))
        return F.transform(kept, lambda at: signature(at, F.lit(first), least(at)))
    # A band has the hashes of one range: in order, the least one comes behind another band's.
    bits = width.bands.bit_length() - 1
    band = lambda h: F.shiftright(h, 64 - bits).cast("int")

    def bins(at: Column) -> Column:
        def least(ordered: Column) -> Column:
            found = F.filter(ordered, lambda h, k: keep(h) & ((k == 0) | (band(h) != band(F.get(ordered, k - 1)))))
            return F.transform(found, lambda h: signature(at, band(h) + (first + width.bands // 2), h))

        return bound(F.sort_array(F.slice(hashes, at, width.shingles)), least)

    return F.flatten(F.transform(starts, bins))


def _templates(spark, templates) -> tuple[DataFrame, list[tuple[str, list[str]]]]:
    """license_id, n_words, shingles of each template, and license and words of those that have no shingle."""
    df = spark.createDataFrame([(i, lic, text) for i, (lic, text) in enumerate(templates)], "i int, license string, text string")
    rows = df.select("i", "license", words_of(F.col("text")).alias("w")).select("i", "license", "w", shingles_of(F.col("w")).alias("s")).orderBy("i").collect()
    blank = [templates[r.i][1] for r in rows if not r.w]
    if blank:
        raise ValueError(f"templates need words: {blank}")
    long = spark.createDataFrame([(r.i, r.license, len(r.w), r.s) for r in rows if r.s], "template int, license_id string, n_words int, h array<long>")
    return long, [(r.license, r.w) for r in rows if not r.s]


def _index(long: DataFrame) -> DataFrame:
    """band, value, license_id, n_words, shingles: the signatures of all whole windows of the templates, at stride 1."""

    def signed(n: int, width: Width) -> DataFrame:
        mine = long.where(F.size("h") >= width.least)
        if n + 1 < len(WIDTHS):
            mine = mine.where(F.size("h") < WIDTHS[n + 1].least)
        whole = F.sequence(F.lit(1), F.size("h") - (width.shingles - 1))
        windows = mine.select("license_id", "n_words", F.array_distinct("h").alias("shingles"), F.explode(F.transform(whole, lambda at: F.slice("h", at, width.shingles))).alias("w"))
        signatures = F.explode(_signatures(F.col("w"), n, lambda _: F.lit(True))).alias("s")
        found = windows.select("license_id", "n_words", "shingles", signatures).where("s.at = 1")
        return found.select("s.band", "s.value", "license_id", "n_words", "shingles")

    return reduce(DataFrame.unionByName, [signed(n, w) for n, w in enumerate(WIDTHS)]).distinct()


def _short_places(docs: DataFrame, short: list[tuple[str, list[str]]]) -> DataFrame:
    """doc_id, at, license_id, containment: every place of a template below SHINGLE words."""
    # A text without a template's longest word can't hold it.
    rare = sorted({max(w, key=len) for _, w in short})
    lower = F.lower(F.col("text"))
    words = docs.where(reduce(lambda a, b: a | b, [lower.contains(w) for w in rare]))
    words = words.select("doc_id", words_of(F.col("text")).alias("words"))

    def places(license_id: str, template: list[str]) -> Column:
        last = F.size("words") - len(template) + 1
        every = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        same = lambda i: reduce(lambda a, b: a & b, [F.element_at("words", i + k) == w for k, w in enumerate(template)])
        return F.transform(
            F.filter(every, same),
            lambda i: F.struct(i.alias("at"), F.lit(license_id).alias("license_id"), F.lit(1.0).alias("containment")),
        )

    found = F.explode(F.flatten(F.array(*[places(*t) for t in short])))
    return words.select("doc_id", found.alias("m")).select("doc_id", "m.*")


def scan(docs: DataFrame, templates=TEMPLATES + SHORT_TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license_id, n_places, containment: one row for each license found in a document.

    n_places is the number of windows in whose surroundings a template of the
    license is held, and of other places of one below SHINGLE words, which is
    held whole or not at all; containment is the largest share of a template's
    shingles. A text is looked at in parts of PART_SHINGLES with a margin, and
    only in those that hold a shingle of the templates' signatures: the time is
    in proportion to the text and the hits. Texts are whole; null and empty ones hold none. Rows that repeat
    a doc_id are one document. Other columns of docs are ignored; an empty
    table gives an empty result.
    """
    long, short = _templates(docs.sparkSession, templates)
    found = []
    if long.limit(1).count():
        found.append(_long_places(docs, long).where(F.col("containment") >= containment))
    if short:
        found.append(_short_places(docs, short))
    return (
        reduce(DataFrame.unionByName, found)
        .groupBy("doc_id", "license_id")
        .agg(F.countDistinct("at").alias("n_places"), F.max("containment").alias("containment"))
    )


def _long_places(docs: DataFrame, long: DataFrame) -> DataFrame:
    """doc_id, at, license_id, containment: the share of every template that a window retrieves, around the window."""
    index = checkpointed(_index(long))
    slots = min(MOST_SLOTS, 1 << (16 * index.count() - 1).bit_length())
    held: list[list[int] | None] = [None] * slots
    for r in index.select("value").distinct().collect():  # of the templates, which came from the driver
        held[r.value & (slots - 1)] = [*(held[r.value & (slots - 1)] or []), r.value]
    table = F.from_json(F.lit(json.dumps(held)), "array<array<bigint>>")
    hashed = docs.select("doc_id", shingles_of(words_of(F.col("text"))).alias("h"))
    margin = long.agg(F.max("n_words").alias("n")).first().n
    # A window's signature is the hash of one of its shingles: where no shingle has an index value, none is retrieved.
    widest = WIDTHS[-1].shingles
    part = lambda at: F.floor((at - 1) / PART_SHINGLES).cast("int")

    def in_table(slots_: Column, value: Column) -> Column:
        return F.array_contains(F.get(slots_, value.bitwiseAND(F.lit(slots - 1)).cast("int")), value)

    def parts(slots_: Column) -> Column:
        places = F.filter(_starts(F.col("h"), 1), lambda at: in_table(slots_, F.get("h", at - 1)))
        reached = F.flatten(F.transform(places, lambda at: F.array(part(at), part(F.greatest(at - (widest - 1), F.lit(1))))))
        # Most texts end here, without a list of their places.
        return F.when(F.exists("h", lambda value: in_table(slots_, value)), F.transform(F.array_distinct(reached), piece))

    def piece(number: Column) -> Column:
        begin = F.greatest(number * PART_SHINGLES + 1 - margin, F.lit(1))
        own = F.least((number + 1) * PART_SHINGLES, F.size("h"))
        shingles = F.slice("h", begin, own - begin + (1 + widest + 2 * margin))
        return F.struct(begin.alias("begin"), (number * PART_SHINGLES + 1).alias("first"), own.alias("last"), shingles.alias("h"))

    # explode() would look at its array twice, first for its size, and compute the text's shingles for it each time.
    cut = hashed.select("doc_id", F.explode_outer(bound(table, parts)).alias("p")).where("p IS NOT NULL").select("doc_id", "p.*")

    def known(slots_: Column) -> Column:
        found = []
        for n, width in enumerate(WIDTHS):
            starts = F.transform(F.sequence("first", "last", F.lit(width.stride)), lambda at: at - F.col("begin") + 1)
            found.append(_signatures(F.col("h"), n, lambda value: in_table(slots_, value), starts))
        return F.concat(*found)

    signatures = cut.select("doc_id", "begin", "h", F.explode_outer(bound(table, known)).alias("s")).where("s IS NOT NULL")
    hits = signatures.select("doc_id", "begin", "h", "s.*").join(bounded(index), ["band", "value"])
    from_ = F.greatest(F.col("at") - F.col("n_words"), F.lit(1))
    region = F.slice("h", from_, F.lit(widest) + 2 * F.col("n_words"))
    share = F.size(F.array_intersect("shingles", region)) / F.size("shingles")
    return hits.select("doc_id", (F.col("at") + F.col("begin") - 1).alias("at"), "license_id", share.alias("containment"))
