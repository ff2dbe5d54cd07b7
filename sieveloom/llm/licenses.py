"""License scans by a positional index of rare words, in DataFrame functions only.

Words are runs of ASCII letters and digits (ASCII letters in lower case) and of
non-ASCII characters. Document frequencies of all template words are counted over the
whole corpus. The index holds, for each template, the postings (word, template, place) of
its RARE words of highest inverse document frequency, and for each base phrase one posting
of its rarest word. A text is looked up by these words first: every occurrence meets the
word's postings and gives (template, relative position: place in the text less place in the
template). Postings that agree on a relative position are aligned. A template is found if at
least NEED of its postings are aligned and then its mandatory phrases are verified; a base
phrase stands where an aligned place is confirmed word by word. Every place of a base phrase
holds its rarest word, so none is missed. The index is a constant of some hundred words that
is joined within the row: no shuffle but the one of the word counts, of one row per template
word and task.

Edge cases: null and empty texts have no words, no labels and score 0; template words
that the corpus lacks are the rarest and cost nothing; ties in frequency go by word;
repeated rows are scanned each; extra columns are ignored. An empty table gives an empty one.
A text of any length is read whole, and the work on it grows with its length (times its
logarithm for the alignment).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the scan: phrase -> label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: label -> (template, mandatory phrases): notices and first paragraphs as the licences word them.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        ["apache license version 2 0"],
    ),
    "gpl-3.0": ("This work is licensed under the GNU General Public License version 3", ["gnu general public license version 3"]),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ["gnu general public license as published by the free software foundation"],
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        ["gnu lesser general public license"],
    ),
    "agpl": ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["gnu affero general public license"]),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike International License", ["creative commons attribution sharealike"]),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    "mit-notice": ("Released under the MIT License", ["mit license"]),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")",
        ["permission is hereby granted free of charge"],
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ["redistribution and use in source and binary forms"],
    ),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ["endorse or promote products derived from this software"],
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        ["mozilla public license"],
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ["permission to use copy modify"],
    ),
    "public-domain": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ["unencumbered software"]),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        ["provided as is without any express or implied warranty"],
    ),
    "boost": ("Distributed under the Boost Software License, Version 1.0.", ["boost software license"]),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License", ["eclipse public license"]),
}
RARE, NEED = 8, 3
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def spaced(text: Column) -> Column:
    """The words of a text joined by single spaces, in their own case."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), _GAP, " "), F.lit(" "))


def count_words(words: Column) -> Column:
    return F.when(words == "", F.lit(0)).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1).cast("long")


def has(words: Column, phrase: str) -> Column:
    return F.contains(F.concat(F.lit(" "), words, F.lit(" ")), F.lit(f" {phrase} "))


def frequencies(docs: DataFrame, words: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """(number of documents, {word: documents that hold it}) over all rows; one row per word reaches the driver."""
    listed = F.array(*[F.lit(w) for w in words])
    own = F.array_intersect(F.split(F.lower(spaced(F.col(text_col))), " "), listed)
    found = docs.select(F.explode_outer(own).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    return docs.count(), {r.w: r.n for r in found if r.w is not None}


def words_of(text: str) -> list[str]:
    """The words of a template."""
    return re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def positional_index(phrases: dict[str, list[str]], n: int, df: dict[str, int], most: dict[str, int]) -> dict[str, list[tuple[str, int]]]:
    """{word: [(phrase, place)]}: the postings of the words of highest inverse document frequency of each phrase, `most` words
    at the most; a phrase of one word to look up has its first place only."""
    out: dict[str, list[tuple[str, int]]] = {}
    for name, words in phrases.items():
        idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in words}
        best = sorted(idf, key=lambda w: (-idf[w], w))[: most[name]]
        for w in best:
            places = [i for i, x in enumerate(words) if x == w]
            out.setdefault(w, []).extend((name, i) for i in (places[:1] if most[name] == 1 else places))
    return out


def _longest_run(sorted_values: Column) -> Column:
    """How often the most frequent value of a sorted array occurs."""
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s, x):
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(sorted_values, start, step, lambda s: s["best"])


def _stands(parts: list[str]):
    """Whether the words of a phrase stand from a place on."""
    listed = F.array(*[F.lit(w) for w in parts])
    return lambda x: (x >= 0) & (F.slice("words", F.greatest(x, F.lit(0)) + 1, F.lit(len(parts))) == listed)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict = BASE, templates: dict = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    score is the share of aligned postings of the best template found, at least 0.5 where a base phrase stands."""
    phrases = {f"base {p}": p.split() for p in base} | {f"template {k}": words_of(t) for k, (t, _) in templates.items()}
    n, df = frequencies(docs, sorted({w for words in phrases.values() for w in words}), text_col)
    index = positional_index(phrases, n, df, {k: 1 if k.startswith("base ") else RARE for k in phrases})
    number = {k: i for i, k in enumerate(phrases)}
    size = {k: sum(x == k for postings in index.values() for x, _ in postings) for k in phrases}
    posting = lambda name, place: F.struct(F.lit(number[name]).alias("t"), F.lit(place).alias("at"))
    table = F.create_map(*[x for w, postings in index.items() for x in (F.lit(w), F.array(*[posting(*p) for p in postings]))])
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), spaced(F.col(text_col)).alias("own"))
    out = out.withColumn("low", F.translate("own", _UPPER, _UPPER.lower())).withColumn("words", F.split("low", " "))
    # first: the places of rare words; their postings, as (template, relative position)
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("place"))), lambda h: h["word"].isin(list(index)))
    out = out.withColumn("hits", F.when(F.arrays_overlap("words", F.array(*[F.lit(w) for w in index])), hits))
    met = F.transform("hits", lambda h: F.transform(F.try_element_at(table, h["word"]), lambda p: F.struct(p["t"].alias("t"), (h["place"] - p["at"]).alias("from"))))
    out = out.withColumn("met", F.flatten(met))

    def aligned(name):
        return F.transform(F.filter("met", lambda m: m["t"] == number[name]), lambda m: m["from"])

    none = F.array().cast("array<int>")
    for i, p in enumerate(base):  # a base phrase stands where all its words do
        parts = phrases[f"base {p}"]
        out = out.withColumn(f"b{i}", F.coalesce(F.filter(aligned(f"base {p}"), _stands(parts)), none))
    marks = []
    for i, (label, (_, must)) in enumerate(templates.items()):
        name = f"template {label}"
        needed = min(NEED, size[name])
        out = out.withColumn(f"t{i}", F.coalesce(_longest_run(F.array_sort(aligned(name))), F.lit(0)))
        held = F.lit(True)
        for phrase in must:  # last: the mandatory phrases
            held = held & has(F.col("low"), phrase)
        share = F.least(F.col(f"t{i}") / F.lit(float(size[name])), F.lit(1.0))
        marks.append(F.when(F.col(f"t{i}") >= needed, F.when(held, F.struct(F.lit(label).alias("label"), share.alias("share")))))
    found = F.filter(F.array(*marks), lambda x: x.isNotNull())
    own = F.filter(F.array(*[F.when(F.size(f"b{i}") > 0, F.lit(label)) for i, label in enumerate(base.values())]), lambda x: x.isNotNull())
    out = out.withColumn("all", F.flatten(F.array(*[F.col(f"b{i}") for i in range(len(base))]))).withColumn("found", found).withColumn("own_labels", own)
    every = F.array_union("own_labels", F.transform("found", lambda x: x["label"]))
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))
    return out.select(
        "doc_id",
        count_words(F.col("own")).alias("n_words"),
        F.size("all").cast("long").alias("n_base"),
        F.array_min("all").cast("long").alias("first_word"),
        F.array_max("all").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("own_labels")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"),
        F.greatest(best, F.when(F.size("all") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )
