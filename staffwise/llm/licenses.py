"""Licence scans: a positional index of rare licence words, with DataFrame and SQL functions only.

The templates are licence texts, standard notices and short names, several forms for one label. How rare a
template's words are is measured over all files; the index holds every position of every
informative word. A file's words of high rarity are looked up in it, each hit gives the offset
between file and template, and a template is found where enough of its indexed positions agree on one
offset, give or take an inserted or a lost word. It counts if the file also holds the form's mandatory phrase.

The text is read twice, once to count in how many files each template word stands and once to scan;
only look-ups (a row per rare word found) and one small row per file are shuffled. The index
is the one thing that is broadcast, and its size is that of the templates.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored

#: Phrases and labels of the base scan.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Identifiers of the form "SPDX-License-Identifier: ..." and their labels (fixed values).
SPDX = {
    "MIT": "mit-notice", "Apache-2.0": "apache-2.0", "GPL-2.0": "gpl-2.0", "GPL-3.0": "gpl-3.0", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl",
    "AGPL-3.0": "agpl", "BSD-2-Clause": "bsd-2-clause", "BSD-3-Clause": "bsd-3-clause", "MPL-2.0": "mpl-2.0", "ISC": "isc",
    "Unlicense": "unlicense", "CC0-1.0": "cc0", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-4.0": "cc-by-nc",
    "EPL-2.0": "epl-2.0", "BSL-1.0": "boost", "Zlib": "zlib"}
#: Short names that stand for a licence by themselves (fixed values).
NAMES = {
    "apache-2.0": ("apache license version 2 0", "apache license v2 0", "apache license 2 0", "apache 2 0 license"),
    "gpl-3.0": ("general public license version 3", "general public license v3", "gnu gpl v3", "gnu gplv3", "gnu gpl version 3", "gpl v3 license"),
    "gpl-2.0": ("general public license version 2", "general public license v2", "gnu gpl v2", "gnu gplv2", "gnu gpl version 2", "gpl v2 license"),
    "lgpl": ("lesser general public license", "gnu lgpl"), "agpl": ("affero general public license", "gnu agpl"),
    "bsd-3-clause": ("bsd 3 clause license", "3 clause bsd license", "bsd 3 clause"),
    "bsd-2-clause": ("bsd 2 clause license", "2 clause bsd license", "bsd 2 clause", "simplified bsd license"),
    "mpl-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0"),
    "epl-2.0": ("eclipse public license version 2 0", "eclipse public license v 2 0", "eclipse public license 2 0"),
    "cc-by": ("cc by 4 0", "cc by 3 0", "creative commons attribution 4 0", "creative commons attribution 3 0"),
    "cc-by-sa": ("cc by sa 4 0", "cc by sa 3 0", "creative commons attribution sharealike", "creative commons attribution share alike"),
    "cc-by-nc": ("cc by nc 4 0", "cc by nc 3 0", "creative commons attribution noncommercial", "creative commons attribution non commercial"),
    "cc0": ("cc0 1 0 universal", "creative commons zero"), "boost": ("boost software license",), "isc": ("isc license",),
    "unlicense": ("the unlicense",), "zlib": ("zlib license",), "proprietary": ("proprietary and confidential all rights reserved",),
    "mit-notice": ("under the mit license", "the mit license mit", "mit licensed")}
#: Label, mandatory phrase (several: with "+" between them) and words of licence texts and notices (fixed values).
TEXTS = (
    ("mit-text", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-text", "without restriction", "and associated documentation files the software to deal in the software without restriction including without "
     "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", "apache license", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www "
     "apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the apache license"),
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-3.0", "gnu general public license + either version 3", "under the terms of the gnu general public license as published by the free software foundation either version 3 "
     "of the license or at your option any later version"),
    ("gpl-2.0", "gnu general public license + either version 2", "under the terms of the gnu general public license as published by the free software foundation either version 2 "
     "of the license or at your option any later version"),
    ("lgpl", "lesser general public", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "affero general public", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
     "derived from this software without specific prior written permission"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
     "distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "provided as is", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
     "damages arising from the use of this software"),
    ("boost", "boost software license", "distributed under the boost software license version 1 0 see accompanying file"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("epl-2.0", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "creative commons attribution", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "public domain dedication", "cc0 1 0 universal public domain dedication"),
)
TEMPLATES = (*TEXTS, *((label, name, name) for label, names in NAMES.items() for name in names),
             *((label, *["spdx license identifier " + name.lower().replace("-", " ").replace(".", " ")] * 2) for name, label in SPDX.items()))
#: Every mandatory phrase holds one of these, so a text without them needs no further look.
TRIGGERS = ("license", "licensed", "unlicense", "permission", "restriction", "public", "redistribution", "neither the name", "provided as is", "cc by", "cc0",
            "creative commons", "gnu", "bsd", "rights reserved")
INFORMATIVE = math.log(10)  # rarity of a word in a tenth of the files
RARE = 3  # words of a template that are indexed even if they are not informative
NEAR = 1  # difference of offsets that still agree
AGREE = 0.75  # share of a template's postings that must agree on an offset


def normal(text: Column) -> Column:
    """The words of a text, each with a blank before it, and a blank at the end; a null text has none."""
    words = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    inner = F.trim(words)
    return F.when(inner == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def word_rarity(texts: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every template word over all rows of ``texts`` (column ``s``)."""
    words = sorted({w for _, _, t in TEMPLATES for w in t.split()})
    known = F.array_intersect(F.split("s", " "), F.array(*map(F.lit, words)))
    rows = (texts.select(F.explode(F.concat(known, F.array(F.lit("")))).alias("w")).groupBy("w").count()
            .collect())  # one row per template word at most
    n = {r["w"]: r["count"] for r in rows}
    return {w: math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) for w in words}


def postings(rarity: dict[str, float], least: float = INFORMATIVE, rare: int = RARE) -> list[tuple[str, int, int]]:
    """``(word, template, position)``: all positions of each template's informative words, and of its rarest ones."""
    out = []
    for t, (_, _, text) in enumerate(TEMPLATES):
        words = text.split()
        chosen = set(sorted(set(words), key=lambda w: (-rarity[w], w))[:rare]) | {w for w in words if rarity[w] >= least}
        out += [(w, t, i) for i, w in enumerate(words) if w in chosen]
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, one row per input row.

    Words are runs of a-z, 0-9 and characters beyond ASCII after A-Z is lower-cased. ``score`` is 1
    with a base label, else the best share of agreeing positions among templates whose phrase is
    there, else 0. Null and empty texts have no words; rows that repeat an id and text get the same
    result; null ids stay null; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k"),
                        normal(F.col(text_col)).alias("s"))
    index = postings(word_rarity(texts.select("s")))
    words = sorted({w for w, _, _ in index})
    n_words = F.greatest(blanks(F.col("s")) - 1, F.lit(0))
    places, firsts, lasts, base = [], [], [], []
    for phrase, label in BASE.items():
        there = F.col("s").contains(f" {phrase} ")
        pieces = F.split("s", f" {phrase}(?= )")
        places.append(F.when(there, F.size(pieces) - 1).otherwise(0))
        firsts.append(F.when(there, blanks(F.get(pieces, F.lit(0)))))
        lasts.append(F.when(there, F.col("n_words") - (blanks(F.element_at(pieces, -1)) - 1) - len(phrase.split())))
        base.append(F.when(there, F.lit(label)))
    may_hold = F.lit(False)
    for w in TRIGGERS:
        may_hold = may_hold | F.col("s").contains(f" {w} ")
    # forms by their phrase: one look for each phrase
    by_phrase: dict[str, list[int]] = {}
    for t, (_, p, _) in enumerate(TEMPLATES):
        by_phrase.setdefault(p, []).append(t)
    def holds(phrase: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col("s").contains(f" {p} ") for p in phrase.split(" + ")])

    there = [F.when(holds(p), F.array(*map(F.lit, ts))) for p, ts in by_phrase.items()]
    phrases = F.when(may_hold, F.flatten(F.array_compact(F.array(*there))))
    counted = texts.withColumn("n_words", n_words)
    files = counted.select(
        "id", "k", F.col("n_words").cast("long").alias("n_words"), sum(places[1:], places[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*base))).alias("base"), phrases.alias("phrases"), "s")
    known = F.filter(F.transform(F.split(F.trim("s"), " "), lambda w, i: F.struct(w.alias("w"), i.alias("pos"))),
                     lambda x: x["w"].isin(words))
    files, _ = stored(files.withColumn("hits", F.when(F.size("phrases") > 0, known)).drop("s"), "licences")
    table = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{w}', {t}, {p})" for w, t, p in index) + " AS t(w, template, place)")
    sizes = {t: sum(1 for _, u, _ in index if u == t) for t in range(len(TEMPLATES))}
    size_of = F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv))
    label_of = F.create_map(*(F.lit(x) for t, (name, _, _) in enumerate(TEMPLATES) for x in (t, name)))
    found = (files.where(F.size("hits") > 0).dropDuplicates(["id", "k"])
             .select("id", "k", "phrases", F.explode("hits").alias("h"))
             .join(F.broadcast(table), F.col("h.w") == F.col("w"))  # as many rows as the templates have words
             .where(F.array_contains("phrases", F.col("template")))
             .select("id", "k", "template", "place", F.explode(F.array(*(
                 F.col("h.pos") - F.col("place") + d for d in range(-NEAR, NEAR + 1)))).alias("shift"))
             .groupBy("id", "k", "template", "shift").agg(F.countDistinct("place").alias("n"))
             .withColumn("share", F.col("n") / F.element_at(size_of, F.col("template")))
             .groupBy("id", "k").agg(
                 F.max("share").alias("share"),
                 F.collect_set(F.when(F.col("share") >= AGREE, F.element_at(label_of, F.col("template")))).alias("more")))
    found = found.select(F.col("id").alias("f_id"), F.col("k").alias("f_k"), "share", "more")
    out = files.join(found, files.id.eqNullSafe(found.f_id) & (files.k == found.f_k), "left")
    none = F.array().cast("array<string>")
    return out.select(
        "id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
