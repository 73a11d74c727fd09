"""License scan: base places against brute force, method labels, edge cases."""

import random
import re

from sieveline.llm import licences as L


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in L.BASE_PHRASES.items() for i in range(len(words))
              if words[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in places})))


def scan(spark, texts, n_filler=40):
    rng = random.Random(0)
    filler = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30)) + " the of and to in" for _ in range(n_filler)]
    rows = [(i, t, "z") for i, t in enumerate([*texts, *filler])]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    return {r.doc_id: r for r in L.scan_licences(df).collect()}


def test_base_places_match_brute_force(spark):
    rng = random.Random(2)
    vocab = ["under", "the", "MIT", "License", "apache", "version", "2", "cc", "by", "nc", "é", "Key", "-", "\n", "x_y", "\x7f"]
    texts = ["".join(rng.choice(vocab) + rng.choice([" ", "-", ", ", "\t"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    texts += ["cc by nc cc by nc cc-by-nc", "Under the MIT license", "UNDER THE MIT LICENSES", "", None, "...", "cc by ncé",
              "apache license version 20", "w " * 20_000 + "cc by nc"]
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), repr(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_method_labels(spark):
    texts = ["This work is licensed under the GNU General Public License, version 3.",
             "code: Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files (the Software), to deal in the Software without restriction",
             "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
             "the following conditions are met", "Licensed under CC BY 4.0.", "Licensed under the Apache License, Version 2.0.",
             "the general public likes version 3 of the work", "gnu gnu gnu public license general",
             "GNU General Public License version 2 and later also under the MIT license"]
    got = scan(spark, texts)
    labels = [got[i].labels for i in range(len(texts))]
    assert labels == ["gpl-3", "mit", "bsd", "cc-by", "apache-2", "", "", "gpl-2,mit"]
    assert got[0].score == 1.0 and got[5].score < 1.0


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, "under the mit license"), (None, None), (1, "cc by nc"), (1, "cc by nc"), (1, "apache")],
                               "doc_id long, text string")
    got = sorted((r.labels, r.n_base, r.n_words) for r in L.scan_licences(df).collect())
    assert got == [("", 0, 0), ("", 0, 1), ("cc-by-nc", 1, 3), ("cc-by-nc", 1, 3), ("mit", 1, 4)]
    assert L.scan_licences(df.limit(0)).count() == 0


def test_postings_prefer_rare_words():
    words = {w for _, t, _ in L.TEMPLATES for w in L.words_of(t)}
    idf = {w: 1.0 if w in ("the", "under", "license") else 9.0 for w in words}
    mit = [t for t, (label, text, _) in enumerate(L.TEMPLATES) if text == "under the MIT License"][0]
    assert [(w, p) for t, w, p, _ in L.postings(idf) if t == mit] == [("mit", 2)]
    shares = {}
    for t, _, _, s in L.postings(idf):
        shares[t] = shares.get(t, 0) + s
    assert all(abs(s - 1) < 1e-9 for s in shares.values())


def test_wordings_of_standard_notices(spark):
    notice = ("This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by "
              "the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
    texts = [notice.format("GNU General Public License", 3), notice.format("GNU General Public License", 2),
             notice.format("GNU Affero General Public License", 3), "GNU General Public License v3.0", "see GNU General Public License v2.0",
             "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
             "CC BY 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License",
             # A word between does not break the alignment.
             "Permission to use, copy, modify, sublicense and/or distribute this software for any purpose with or without fee is hereby granted",
             "the general public as published by the free software foundation"]
    # Whatever words are rare: fillers that hold some of the notice's words.
    for extra in ([], ["free software foundation published either"] * 30, ["gnu general public version permission distribute"] * 30):
        got = scan(spark, [*texts, *extra])
        assert [got[i].labels for i in range(len(texts))] == [
            "gpl-3", "gpl-2", "agpl-3", "gpl-3", "gpl-2", "isc", "cc-by", "cc-by-sa", "isc", ""]
