"""License scans with a positional rare-token index (native DataFrame operators only).

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.

1. One pass counts, over all documents, in how many each word of the license
   templates occurs (the table has one row per template word).
2. Each template is indexed by its words of highest IDF with their positions.
3. A second pass looks up the index words of each document. Every occurrence
   is joined with the postings of its word; occurrences of one template whose
   (position in document - position in template) differ by at most ``BAND``
   are one alignment, so that a word more or less does not break it.
4. An alignment counts if it holds ``MIN_SCORE`` of the template's indexed IDF
   weight, and the document has all mandatory key phrases of the template.

The base phrases are found by position in the same pass, and their labels are
always among the labels.

Defined results: null or text without words gives no places and no labels
(empty strings, score 0); documents equal in id and text have one result,
given to each row; a null id is allowed; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import lower_ascii, replace_columns, text_or_empty

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that always count, with their labels (fixed values).
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: (label, template, mandatory key phrases): wording of the public license notices (fixed values).
TEMPLATES = [
    ("agpl-3", "GNU Affero General Public License version 3",
     ["gnu affero general public license", "version 3"]),
    ("apache-2", "Apache License, Version 2.0", ["apache license version 2"]),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the "
     "License at http://www.apache.org/licenses/LICENSE-2.0", ["www apache org licenses license 2 0"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("cc-by", "CC BY 4.0", ["cc by 4"]),
    ("cc-by", "Creative Commons Attribution 4.0 International License", ["creative commons attribution 4"]),
    ("cc-by-nc", "CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License",
     ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "CC BY-SA 4.0", ["cc by sa"]),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication", ["cc0 1 0"]),
    ("gpl-2", "GNU General Public License, version 2", ["gnu general public license", "version 2"]),
    ("gpl-3", "GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted", ["with or without fee is hereby granted"]),
    ("lgpl-3", "GNU Lesser General Public License version 3",
     ["gnu lesser general public license", "version 3"]),
    ("mit", "under the MIT License", ["the mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files, to deal in the Software without restriction",
     ["permission is hereby granted free of charge"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
     ["mozilla public license"]),
    *[(label, f"{name} as published by the Free Software Foundation, either version {v} of the License",
       [name.lower(), f"version {v} of the license"])
      for label, name, v in (("agpl-3", "GNU Affero General Public License", 3), ("gpl-2", "GNU General Public License", 2),
                             ("gpl-3", "GNU General Public License", 3), ("lgpl-3", "GNU Lesser General Public License", 3))],
    *[(label, f"{name} v{v}.0", [f"{name} v{v}".lower()])
      for label, name, v in (("agpl-3", "GNU Affero General Public License", 3), ("gpl-2", "GNU General Public License", 2),
                             ("gpl-3", "GNU General Public License", 3), ("lgpl-3", "GNU Lesser General Public License", 3))],
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
     "granted", ["with or without fee is hereby granted"]),
    *[(label, f"{name} {v}", [f"{name} {v}".lower().replace("-", " ").replace(".", " ")])
      for v in ("1.0", "2.0", "2.5", "3.0")
      for label, name in (("cc-by", "CC BY"), ("cc-by", "Creative Commons Attribution"), ("cc-by-nc", "CC BY-NC"),
                          ("cc-by-nc", "Creative Commons Attribution-NonCommercial"), ("cc-by-sa", "CC BY-SA"),
                          ("cc-by-sa", "Creative Commons Attribution-ShareAlike"))],
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0", ["creative commons attribution sharealike 4 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain",
     ["free and unencumbered software"]),
]
#: A template is indexed by at most so many words, each of at least this share of its highest IDF.
RARE_WORDS, RARE_SHARE = 8, 0.5
#: The share of the template's indexed IDF weight that an alignment must hold.
MIN_SCORE = 0.8
#: Offsets that differ by so many words at most support each other.
BAND = 4

FOUND = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words_of(text: str) -> list[str]:
    """Words of a template (driver side)."""
    import re
    return [w for w in re.split(SEPARATORS, "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def split_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add __canon (words between single spaces, a space at both ends) and __words."""
    canon = F.btrim(F.regexp_replace(lower_ascii(text_or_empty(text)), SEPARATORS, " "))
    return (docs.withColumn("__canon", F.concat(F.lit(" "), canon, F.lit(" ")))
            .withColumn("__words", F.array_remove(F.split(F.btrim("__canon"), " "), "")))


def inverse_frequencies(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """IDF over all documents of the templates' words; collects one row per template word."""
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in words_of(t)})
    present = split_words(docs.select(text), text).select(
        F.explode(F.concat(F.array_intersect("__words", _strings(vocabulary)), F.array(F.lit("")))).alias("w"))
    counts = {r.w: r.n for r in present.groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = counts.get("", 0)  # every document has the empty marker
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def postings(idf: dict[str, float]) -> list[tuple[int, str, int, float]]:
    """(template, word, position, share of the template's indexed weight) of the words of highest IDF."""
    out = []
    for t, (_, text, _) in enumerate(TEMPLATES):
        words = words_of(text)
        rare = sorted(set(words), key=lambda w: (-idf[w], w))[:RARE_WORDS]
        rare = [w for w in rare if idf[w] >= RARE_SHARE * idf[rare[0]]]
        # Where the corpus makes every word common, all count the same.
        weight = {w: max(idf[w], 1e-9) for w in rare}
        total = sum(weight[w] for w in words if w in weight)
        out += [(t, w, i, weight[w] / total) for i, w in enumerate(words) if w in weight]
    return out


def _base_places() -> Column:
    """Array of (word index, label) of the base phrases, in one pass over the words of documents that hold one."""
    def starts(phrase: str, label: str) -> str:
        same = " AND ".join(f"get(__words, i + {k}) = '{w}'" if k else f"get(__words, i) = '{w}'"
                            for k, w in enumerate(phrase.split()))
        return (f"CASE WHEN contains(__canon, ' {phrase} ') THEN transform(filter(sequence(0, size(__words) - 1), "
                f"i -> {same}), i -> struct(i AS i, '{label}' AS label)) ELSE array() END")
    return F.expr("concat(" + ", ".join(starts(p, x) for p, x in BASE_PHRASES.items()) + ")")


def scan_licences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All documents with ``FOUND``; first_word and last_word are null without a base place."""
    spark = docs.sparkSession
    base = replace_columns(docs, FOUND)
    entries = postings(inverse_frequencies(base, text))
    # A fixed table of the templates above: at most RARE_WORDS distinct words each.
    index = F.broadcast(spark.createDataFrame(entries, "t int, w string, pos int, share double"))
    rules = F.broadcast(spark.createDataFrame(
        [(t, label, keys) for t, (label, _, keys) in enumerate(TEMPLATES)], "t int, label string, keys array<string>"))
    rare = _strings(sorted({w for _, w, _, _ in entries}))
    phrases = sorted({k for _, _, keys in TEMPLATES for k in keys})

    split = split_words(base, text).withColumn("__hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    has_rare = F.size(F.array_intersect("__words", rare)) > 0
    candidates = (
        split.where(has_rare)
        .select(F.col(doc_id).alias("__id"), "__hash", "__words",
                F.filter(_strings(phrases), lambda p: F.contains(F.col("__canon"), F.concat(F.lit(" "), p, F.lit(" "))))
                .alias("__keys"))
        .select("__id", "__hash", "__keys", F.posexplode("__words").alias("i", "w")))
    aligned = (
        candidates.join(index, "w")
        # Bands of twice the width, each offset in two of them.
        .withColumn("band", F.explode(F.expr(f"array(floor((i - pos) / {BAND}), floor((i - pos) / {BAND}) + 1)")))
        .groupBy("__id", "__hash", "__keys", "t", "band")
        # Documents equal in id and text meet here; each place counts once.
        .agg(F.collect_set(F.struct("pos", "share")).alias("held"))
        .withColumn("score", F.expr("least(1D, round(aggregate(held, 0D, (s, h) -> s + h.share), 9))")))
    found = (
        aligned.join(rules, "t")
        .withColumn("holds", F.expr(f"score >= {MIN_SCORE} AND size(array_except(keys, __keys)) = 0"))
        .groupBy("__id", "__hash")
        .agg(F.collect_set(F.when(F.col("holds"), F.col("label"))).alias("__method"), F.max("score").alias("__score")))

    narrow = (
        split.withColumn("__places", _base_places())
        .withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("n_base", F.size("__places").cast("long"))
        .withColumn("first_word", F.expr("array_min(transform(__places, p -> p.i))").cast("long"))
        .withColumn("last_word", F.expr("array_max(transform(__places, p -> p.i))").cast("long"))
        .withColumn("__base", F.expr("array_distinct(transform(__places, p -> p.label))"))
        .drop("__canon", "__words", "__places"))
    found = found.withColumnRenamed("__hash", "__h").withColumnRenamed("__id", "__i")
    joined = narrow.join(found, narrow[doc_id].eqNullSafe(found["__i"]) & (narrow["__hash"] == found["__h"]), "left")
    both = F.array_union("__base", F.coalesce("__method", F.expr("array()")))
    return (joined.withColumn("base_labels", F.array_join(F.array_sort("__base"), ","))
            .withColumn("labels", F.array_join(F.array_sort(both), ","))
            .withColumn("score", F.coalesce("__score", F.lit(0.0)))
            .select(*[F.col(f"`{c}`") for c in base.columns], *FOUND))
