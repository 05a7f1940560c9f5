"""License scans by a positional index of rare words, with DataFrame expressions only.

Templates are indexed by word: postings of (template, position). The document frequencies of the index's words over the
whole corpus give their IDF, in whose order each file's own licence words are looked up: a template whose mandatory key phrase has all its words in
the file is reached by the highest of them, which a phrase that stands must hold, so that nothing is missed, however many licences a file has, and files
without such a phrase look up nothing. Each place of the word less its posting's position is where the template would begin, and there all the template's postings are intersected
by relative position: those that agree must hold LEAST_COVER of the template's IDF, and the key phrase must stand in place. Three base phrases are counted as such.

A text is one row throughout, in linear time: nothing is shuffled but the frequencies of the index's words.

Defined results: null and empty texts have no words; no phrase gives null for first_word and last_word, empty labels and score 0; rows that repeat
are scanned alike; of words of equal IDF the first by code point ranks higher; a text of any length, or one huge word, takes linear time; an empty table
gives no rows; extra columns pass through, and clashing names get underscores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh

#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, mandatory key phrase, template around it. Licence wordings and notices are as published.
TEMPLATES = [
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "apache license 2 0", "apache license 2 0"),
    ("agpl-3.0", "gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "bsd license", "released under the bsd license"),
    ("bsd-2-clause", "bsd 2 clause", "bsd 2 clause license"),
    ("bsd-3-clause", "bsd 3 clause", "bsd 3 clause license"),
    ("bsd-3-clause", "neither the name of", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-4.0", "creative commons attribution 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-4.0", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "licensed under cc by nc 4 0"),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal public domain dedication"),
    ("copyright", "copyright c", "copyright c"),
    ("epl-2.0", "eclipse public license 2 0", "eclipse public license 2 0"),
    ("epl-2.0", "eclipse public license v 2 0", "eclipse public license v 2 0"),
    ("eupl-1.2", "eupl v 1 2", "eupl v 1 2"),
    ("eupl-1.2", "european union public licence v 1 2", "european union public licence v 1 2"),
    ("gnu-gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("gnu-gpl", "gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0", "general public license version 2", "general public license version 2"),
    ("gpl-2.0", "gpl v2", "gpl v2"),
    ("gpl-2.0", "gplv2", "gplv2"),
    ("gpl-3.0", "general public license version 3", "general public license version 3"),
    ("gpl-3.0", "gpl v3", "gpl v3"),
    ("gpl-3.0", "gplv3", "gplv3"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "mit license", "licensed under the mit license"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla public license 2 0", "mozilla public license 2 0"),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla public license version 2 0"),
    ("proprietary", "confidential and proprietary", "confidential and proprietary all rights reserved"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("zlib", "in no event will the authors be held liable", "provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
]
#: Identifiers of the licences in the tags of source files; a tag's words are its template, the identifier its label.
TAGGED = "AGPL-3.0 Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 Unlicense Zlib".split()
TEMPLATES += [(x.lower(), tag, tag) for x in TAGGED for tag in [" ".join(["spdx license identifier", *x.lower().replace(".", "-").split("-")])]]
#: Part of a template's IDF that must stand in place.
LEAST_COVER = 0.7
#: Words that are in every text and never looked up.
COMMON = frozenset("0 1 2 3 4 a all and any are as by except file following for form in into is may met not of or person person's provided purpose that the this to under use v version with without work you".split())


def _distinctive() -> list[str]:
    words = {w for _, _, t in TEMPLATES for w in t.split()} | {w for p in BASE for w in p.split()}
    return sorted(words - COMMON)


def _start(parts: list[str], key: list[str]) -> int:
    return next(i for i in range(len(parts)) if parts[i : i + len(key)] == key)


def _stands(words: Column, i: Column, phrase: list[str]) -> Column:
    """Whether phrase stands at word i."""
    return (i >= 0) & (F.slice(words, F.greatest(i + 1, F.lit(1)), len(phrase)) == F.array(*map(F.lit, phrase)))


def _with_words(docs: DataFrame, text_col: str, words: str, at: str) -> DataFrame:
    """docs with its words and the places of the index's words."""
    norm = F.btrim(F.regexp_replace(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), GAP, " "))
    out = docs.withColumn(words, F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " ")))
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(F.col(words), i).isin(_distinctive()))
    return out.withColumn(at, F.when(F.size(words) > 0, places).otherwise(F.array().cast("array<int>")))


def frequencies(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """IDF of the index's words over all docs. The result has a number for each word of the index, whatever the corpus."""
    rows = _with_words(docs.select(F.col(text_col)), text_col, "words_", "at_")
    own = F.array_distinct(F.transform("at_", lambda i: F.get(F.col("words_"), i)))
    n = rows.select(F.explode(F.array_append(own, F.lit(""))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    df = {r["w"]: r["n"] for r in n}
    return {w: math.log((df.get("", 0) + 1) / (df.get(w, 0) + 0.5)) for w in _distinctive()}


def scan(docs: DataFrame, text_col: str = "text", idf: dict[str, float] | None = None) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label and first word of what the index found)."""
    idf = frequencies(docs, text_col) if idf is None else idf
    names = {c: fresh(c, docs.columns) for c in ("words", "at", "own", "reached", "found", "base", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
    words, at = F.col(names["words"]), F.col(names["at"])
    out = _with_words(docs, text_col, names["words"], names["at"])
    none = F.array().cast("array<int>")

    def places(phrase: str) -> Column:
        parts = phrase.split()
        k = next(i for i, w in enumerate(parts) if w not in COMMON)
        return F.filter(F.transform(F.filter(at, lambda i: F.get(words, i) == parts[k]), lambda i: i - k), lambda i: _stands(words, i, parts))

    some = F.size(at) > 0
    base = F.array(*[F.struct(F.lit(label).alias("label"), F.when(some, places(p)).otherwise(none).alias("at")) for p, label in BASE.items()])
    out = out.withColumn(names["base"], base)
    # Templates by the word of their key phrase that ranks highest by IDF, then by code point; positions are those in the template.
    ranked = sorted(idf, key=lambda w: (-idf[w], w))
    rank = {w: r for r, w in enumerate(ranked)}
    templates, postings = [], {}
    for label, phrase, text in TEMPLATES:
        parts, key = text.split(), phrase.split()
        k0 = _start(parts, key)
        j = min((j for j, w in enumerate(key) if w in rank), key=lambda j: (rank[key[j]], j))  # noqa: B023
        weights = [(k, w, max(idf[w], 0.0) + 1e-6) for k, w in enumerate(parts) if w in rank]
        total = sum(x for _, _, x in weights)
        postings.setdefault(key[j], []).append(F.struct(F.lit(len(templates)).alias("t"), F.lit(j).alias("j")))
        templates.append(F.struct(
            F.lit(label).alias("label"), F.array(*map(F.lit, key)).alias("key"), F.array(*[F.lit(w) for w in dict.fromkeys(key) if w in rank]).alias("needs"), F.lit(k0).alias("k0"),
            F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w"), F.lit(x / total).alias("x")) for k, w, x in weights]).alias("postings"),
        ))
    table = F.array(*templates)
    index = F.create_map(*[x for w, found in postings.items() for x in (F.lit(w), F.array(*found))])
    # The file's words in the order of their IDF: an intersection keeps the order of its first array.
    own = F.array_intersect(F.array(*map(F.lit, ranked)), F.transform(at, lambda i: F.get(words, i)))
    out = out.withColumn(names["own"], F.when(some, own).otherwise(F.array().cast("array<string>")))
    own = F.col(names["own"])
    tops = F.array_intersect(own, F.array(*map(F.lit, sorted(postings))))
    reached = F.flatten(F.transform(tops, lambda w: F.transform(
        F.filter(F.element_at(index, w), lambda p: F.size(F.array_except(F.get(table, p["t"])["needs"], own)) == 0),
        lambda p: F.struct(w.alias("w"), p["j"].alias("j"), F.get(table, p["t"]).alias("of")),
    )))
    out = out.withColumn(names["reached"], F.when(some, reached))

    def agreed(i: Column, of: Column) -> Column:
        """Part of the template's IDF whose words stand in place if its key phrase does at word i."""
        stands = lambda k: (k >= 0) & (k < F.size(words))
        return F.aggregate(of["postings"], F.lit(0.0), lambda a, p: a + F.when(stands(i - of["k0"] + p["k"]) & (F.get(words, i - of["k0"] + p["k"]) == p["w"]), p["x"]).otherwise(F.lit(0.0)))

    def begun(r: Column) -> Column:
        starts = F.transform(F.filter(at, lambda i: (F.get(words, i) == r["w"]) & (i >= r["j"])), lambda i: i - r["j"])
        in_place = F.filter(starts, lambda i: F.slice(words, i + 1, F.size(r["of"]["key"])) == r["of"]["key"])
        return F.filter(F.transform(in_place, lambda i: F.struct(r["of"]["label"].alias("label"), i.alias("at"), agreed(i, r["of"]).alias("cover"))), lambda f: f["cover"] >= LEAST_COVER)

    out = out.withColumn(names["found"], F.when(F.size(names["reached"]) > 0, F.flatten(F.transform(names["reached"], begun))))
    has = F.filter(F.col(names["base"]), lambda b: F.size(b["at"]) > 0)
    starts = F.flatten(F.transform(has, lambda b: b["at"]))
    labels = F.coalesce(F.transform(F.col(names["found"]), lambda f: f["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform(F.col(names["found"]), lambda f: f["cover"])), F.lit(-1.0))
    score = F.greatest(F.when(best >= 0, 0.6 + 0.4 * best).otherwise(F.lit(0.0)), F.when(F.size(has) > 0, F.lit(0.75)).otherwise(F.lit(0.0)))
    out = out.withColumns({
        names["n_words"]: F.size(words).cast("long"),
        names["n_base"]: F.size(starts).cast("long"),
        names["first_word"]: F.array_min(starts).cast("long"),
        names["last_word"]: F.array_max(starts).cast("long"),
        names["base_labels"]: F.array_join(F.array_sort(F.transform(has, lambda b: b["label"])), ","),
        names["labels"]: F.array_join(F.array_sort(F.array_distinct(F.concat(F.transform(has, lambda b: b["label"]), labels))), ","),
        names["score"]: F.least(F.lit(1.0), score),
        names["spans"]: F.array_distinct(F.transform(F.coalesce(F.col(names["found"]), F.array().cast("array<struct<label:string,at:int,cover:double>>")), lambda f: F.struct(f["label"].alias("label"), f["at"].alias("at")))),
    })
    return out.drop(*[names[c] for c in ("words", "at", "own", "reached", "found", "base")])

