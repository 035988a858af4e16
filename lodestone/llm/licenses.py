"""License scans: phrases, and an exact containment join of text blocks with license templates."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bind

#: What separates words: all ASCII but letters and digits.
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrase, label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Templates in the licenses' public wording: the notices that files carry, each paragraph a template. Label, text.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
)
#: The share of a template's distinct words that a block must hold, and a block's words for each word of the template.
CONTAINMENT = 0.8
BLOCK_WORDS = 1.25


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPLIT), "")


def _template_words(text: str) -> frozenset[str]:
    return frozenset(w for w in re.split(SPLIT, text.lower()) if w)


def block_size(text: str) -> int:
    return math.ceil(BLOCK_WORDS * len([w for w in re.split(SPLIT, text.lower()) if w]))


def template_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many texts of the corpus each template word stands; the result has a row for each template word at most."""
    wanted = F.array(*(F.lit(w) for w in vocabulary))
    hits = docs.select(F.explode(F.array_intersect(license_words(F.col("text")), wanted)).alias("w"))
    return {r["w"]: r["n"] for r in hits.groupBy("w").agg(F.count("*").alias("n")).collect()}


def containment_plan(counts: dict[str, int], templates=TEMPLATES, threshold: float = CONTAINMENT) -> list[tuple[str, list[str], int, int]]:
    """(label, words from rarest to commonest, least overlap, words of a block) of each template, by the corpus' word frequencies."""
    out = []
    for label, text in templates:
        ranked = sorted(_template_words(text), key=lambda w: (counts.get(w, 0), w))
        out.append((label, ranked, max(1, math.ceil(threshold * len(ranked) - 1e-9)), block_size(text)))
    return out


def _texts(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def _blocks(ws: Column, plan) -> Column:
    """(word, label, score) of the templates that some block of the text contains, each with its best block.

    The templates are one constant table, joined to the text's words. Prefix
    filter: a block that holds the least overlap holds one of a template's
    size - overlap + 1 rarest words, so texts without any such word are done at
    once, templates without one fall away, and only blocks with one are looked
    at. Positional filter: such a block must begin within its length before
    that word. Length filter: the text's end may leave it too few words. What
    passes is counted exactly.
    """
    table = F.array(*(
        F.struct(F.lit(label).alias("label"), _texts(ranked).alias("words"), _texts(ranked[: len(ranked) - least + 1]).alias("prefix"), F.lit(least).alias("least"), F.lit(span).alias("span"))
        for label, ranked, least, span in plan
    ))
    rare = _texts(sorted({w for _, ranked, least, _ in plan for w in ranked[: len(ranked) - least + 1]}))

    def scored(t: Column) -> Column:
        def best(p: Column) -> Column:
            heads = F.filter(p, lambda i: F.array_contains(t["prefix"], ws[i]))
            # A block's first word may be taken to be one of the template's.
            starts = F.filter(p, lambda i: (F.size(ws) - i >= t["least"]) & F.exists(heads, lambda q: (q >= i) & (q < i + t["span"])))
            return F.array_max(F.transform(starts, lambda i: F.struct(F.size(F.array_intersect(t["words"], F.slice(ws, i + 1, t["span"]))).alias("n"), (-i).alias("at"))))

        places = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.array_contains(t["words"], ws[i]))
        return bind(bind(places, best), lambda x: F.struct((-x["at"]).alias("word"), t["label"].alias("label"), (x["n"] / F.size(t["words"]).cast("double")).alias("score"), (x["n"] >= t["least"]).alias("holds")))

    def found(near: Column) -> Column:
        each = F.filter(F.transform(near, scored), lambda x: F.coalesce(x["holds"], F.lit(False)))
        return F.transform(each, lambda x: x.dropFields("holds"))

    none = F.array().cast("array<struct<word:int,label:string,score:double>>")
    return F.when(F.arrays_overlap(ws, rare), found(F.filter(table, lambda t: F.arrays_overlap(ws, t["prefix"])))).otherwise(none)


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = CONTAINMENT, phrases=PHRASES) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and blocks.

    Words are lower-cased (A-Z) runs outside SPLIT. n_base counts places where
    a phrase's words stand consecutively, first_word and last_word are the
    least and greatest start (null without one). A block is any run of at most
    BLOCK_WORDS words for each word of the template, across lines, so that
    wrapped notices count too; blocks lists (word, label, score) of each
    template of which some block holds at least `threshold` of the distinct
    words: where the best one starts, and the share it holds. labels joins the
    phrases' and the blocks' labels, sorted and distinct; score is the best
    share, or 1 with a phrase, or 0. Null texts count as empty; texts may be of
    any length. Columns of docs with these names are replaced; repeated rows stay.
    """
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
    docs = docs.drop(*made)
    vocabulary = sorted(set().union(*(_template_words(t) for _, t in templates)))
    plan = containment_plan(template_frequencies(docs, vocabulary), templates, threshold)

    def starts(ws: Column, phrase: str) -> Column:
        parts = phrase.split()
        last = F.size(ws) - len(parts)
        at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        same = lambda i: reduce(lambda a, b: a & b, (ws[i + k] == p for k, p in enumerate(parts)))
        # A phrase whose first word is missing needs no look at every place.
        return F.when(F.array_contains(ws, parts[-1]) & F.array_contains(ws, parts[0]), F.filter(at, same)).otherwise(F.array().cast("array<int>"))

    def looked_at(ws: Column) -> Column:
        found = F.array(*(F.struct(F.lit(label).alias("label"), starts(ws, p).alias("at")) for p, label in phrases))
        return F.struct(F.size(ws).alias("n"), found.alias("found"), _blocks(ws, plan).alias("blocks"))

    out = docs.withColumn("_f", bind(license_words(F.col("text")), looked_at)).withColumn("blocks", F.col("_f.blocks"))
    out = out.withColumn("_at", F.flatten(F.transform("_f.found", lambda x: x["at"])))
    out = out.withColumn("_base", F.transform(F.filter("_f.found", lambda x: F.size(x["at"]) > 0), lambda x: x["label"]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["score"])), F.lit(0.0))
    out = out.withColumns({
        "n_words": F.col("_f.n").cast("long"),
        "n_base": F.size("_at").cast("long"),
        "first_word": F.array_min("_at").cast("long"),
        "last_word": F.array_max("_at").cast("long"),
        "base_labels": joined(F.col("_base")),
        "labels": joined(F.concat("_base", F.transform("blocks", lambda b: b["label"]))),
        "score": F.when(F.size("_at") > 0, F.lit(1.0)).otherwise(best),
    })
    return out.select(*docs.columns, *made)
