"""License scans by an exact set-similarity join of text blocks with templates.

A template is a set of words.  A block is any stretch of a text of a template's
``window`` (twice its length, rounded up to a power of two), wherever it starts.  A
block meets a template if it contains at least ``CONTAINMENT`` of its words.

Words are ordered by how often the corpus has them, rarest first.  A block that meets
a template of ``t`` words, ``need`` of them required, has one of the template's
``t - need + 1`` first words (prefix filter): texts without any template's prefix word
are passed by, and of the others only template words are kept, with their places.
Those are joined with an index of the templates' words.  A text and a template stay
together if they share a prefix word and ``need`` words in all (length filter), and of
their places those no further than a window from a prefix word (positional filter).

How many different words of the template each block has follows from its end: a word
counts from its place on until it comes again or leaves the window.  So a running sum
over these beginnings and ends, in the order of the text, has the number for all
blocks, and its maximum is that of the best one.

Besides, fixed phrases are found wherever their words stand consecutively.

Nulls and edge cases: a null text is empty; an empty text has no words, no places and
no labels; ties in frequency are ordered by the word; a score is 1 where a phrase
stands, else the share of the best template that is met, else 0; repeated rows stay;
an empty table gives an empty result; other columns are not looked at.

Everything runs in the JVM; the driver gets one count for each template word.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._base import quoted, scoped, sized, table, written

CONTAINMENT = 0.8
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases with the label that each gives.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str

    @property
    def words(self) -> list[str]:
        return sorted(set(re.findall(_WORD, self.text.lower())))

    @property
    def need(self) -> int:
        return math.ceil(CONTAINMENT * len(self.words))

    @property
    def window(self) -> int:
        return 1 << (2 * len(re.findall(_WORD, self.text)) - 1).bit_length()


#: Notices and whole texts of public licences.
TEMPLATES = (
    Template("apache-2-text", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("gpl-3", "licensed under the GNU General Public License, version 3"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-text", "This work is licensed under a Creative Commons Attribution International License"),
    Template("all-rights-reserved", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission"),
    Template("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template(
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
        ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    Template(
        "isc-text",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
        AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
        DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    Template(
        "bsd-2-text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
        OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    Template(
        "zlib-text",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
        is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
    ),
    Template(
        "unlicense-text",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
    ),
)


def words(text: Column) -> Column:
    """Words of the text with A-Z in lower case; U+212A, whose lower case is an ASCII k, stays another letter."""
    # splitting takes a twentieth of the time that extracting all matches does
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))), _GAP), "")


def by_frequency(docs: DataFrame, text: str, vocabulary: list[str]) -> list[str]:
    """The template words, those that the corpus has least first."""
    seen = docs.select(F.explode(words(F.col(text))).alias("w")).filter(F.col("w").isin(vocabulary)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["w"]: r["n"] for r in seen.collect()}  # at most a row for each template word
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def places(w: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand consecutively, words counted from 0; null if some word is missing."""
    has = reduce(lambda a, b: a & b, [F.array_contains(w, x) for x in phrase])
    at = lambda i: reduce(lambda a, b: a & b, [F.get(w, i + j) == F.lit(x) for j, x in enumerate(phrase)])
    return F.when(has & (F.size(w) >= len(phrase)), F.filter(F.sequence(F.lit(0), F.size(w) - len(phrase)), at))


def index_of(spark: SparkSession, templates: tuple[Template, ...], order: list[str]) -> DataFrame:
    """A row for each word of each template: word, template, place in its order, and the template's numbers."""
    rank = {x: i for i, x in enumerate(order)}
    rows = [
        {"word": x, "template": k, "label": t.label, "at": at, "size": len(t.words), "need": t.need, "window": t.window, "prefix": at <= len(t.words) - t.need}
        for k, t in enumerate(templates)
        for at, x in enumerate(sorted(t.words, key=rank.__getitem__))
    ]
    kind = "array<struct<word:string,template:int,label:string,at:int,size:int,need:int,window:int,prefix:boolean>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def met(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Texts and templates (``_id``, template, label, share) that some block meets, from the places of template words (``_id``, ``pos``, ``word``)."""
    found = hits.join(sized(index), "word")
    together = Window.partitionBy("_id", "template")
    same = Window.partitionBy("_id", "template", "at").orderBy("pos")
    # prefix and length filters: a prefix word, and as many different words as a block needs
    found = found.withColumn("_next", F.lead("pos").over(same)).withColumn("_first", (F.row_number().over(same) == 1).cast("int"))
    found = found.withColumn("_words", F.sum("_first").over(together)).withColumn("_has", F.max("prefix").over(together)).filter(F.col("_has") & (F.col("_words") >= F.col("need")))
    # positional filter: a block that meets the template has a prefix word, no further than a window from all of its words
    ordered = together.orderBy("pos")
    prefix = F.when(F.col("prefix"), F.col("pos"))
    before = F.max(prefix).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(prefix).over(ordered.rowsBetween(0, Window.unboundedFollowing))
    close = found.withColumn("_before", before).withColumn("_after", after).filter((F.col("pos") - F.col("_before") < F.col("window")) | (F.col("_after") - F.col("pos") < F.col("window")))
    ends = F.least(F.col("_next"), F.col("pos") + F.col("window"))
    events = close.select("_id", "template", "label", "size", "need", F.explode(F.array(F.struct(F.col("pos").alias("e"), F.lit(1).alias("d")), F.struct(ends.alias("e"), F.lit(-1).alias("d")))).alias("v"))
    running = F.sum("v.d").over(Window.partitionBy("_id", "template").orderBy("v.e", "v.d").rowsBetween(Window.unboundedPreceding, 0))
    best = events.withColumn("_n", running).groupBy("_id", "template").agg(F.max("_n").alias("_n"), F.first("label").alias("label"), F.first("size").alias("size"), F.first("need").alias("need"))
    return best.filter(F.col("_n") >= F.col("need")).select("_id", "template", "label", (F.col("_n") / F.col("size").cast("double")).alias("share"))


@scoped
def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``key``, n_words, phrase places, and arrays of base and all labels with a score."""
    docs = docs.select(F.col(quoted(key)).alias("_key"), F.col(quoted(text)).alias("_text"))
    order = by_frequency(docs, "_text", sorted({x for t in templates for x in t.words}))
    index = written(index_of(docs.sparkSession, templates, order), "index")
    rank = {x: i for i, x in enumerate(order)}
    first = sorted({x for t in templates for x in sorted(t.words, key=rank.__getitem__)[: len(t.words) - t.need + 1]})

    w = F.col("_w")
    rows = docs.select("_key", words(F.col("_text")).alias("_w"))
    near = F.arrays_overlap(w, F.split(F.lit(" ".join(first)), " "))
    hits = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("pos"), x.alias("word"))), lambda x: x["word"].isin(order))
    rows = rows.select("_key", F.size(w).alias("_n"), *[places(w, p.split(" ")).alias(f"_p{i}") for i, p in enumerate(phrases)], F.when(near, hits).alias("_hits"))
    # one pass over the texts leaves what all else needs: places of phrases, and of template words in texts with a prefix word
    rows = written(rows.withColumn("_id", F.monotonically_increasing_id()), "scanned")
    found = met(rows.filter("_hits is not null").select("_id", F.inline("_hits")), index)
    told = written(found.groupBy(F.col("_id").alias("_mid")).agg(F.collect_set("label").alias("_labels"), F.max("share").alias("_share")), "met")

    none = F.array().cast("array<int>")
    rows = rows.join(sized(told), F.col("_id") == F.col("_mid"), "left")
    at = [F.coalesce(F.col(f"_p{i}"), none) for i in range(len(phrases))]
    base = F.array_distinct(F.array_compact(F.array(*[F.when(F.size(a) > 0, label) for a, label in zip(at, phrases.values(), strict=True)])))
    all_places = F.concat(*at)
    score = F.when(F.size(all_places) > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0)))
    labels = F.array_sort(F.array_union(base, F.coalesce("_labels", F.array().cast("array<string>"))))
    return rows.select(F.col("_key").alias(key), F.col("_n").cast("long").alias("n_words"), all_places.alias("places"), F.array_sort(base).alias("base_labels"), labels.alias("labels"), score.alias("score"))


def op6_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
