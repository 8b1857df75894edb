"""License scans with a positional rare-token index.

Each licence template is a short word sequence with mandatory key phrases; its
words with their places are the postings.  Document frequencies of the template
words are counted over all documents.  A template posts its ``POSTED`` rarest words
(highest IDF); all posted words of a document are looked up, at all their places.  A
posting at place q met at place p votes for the template's start p - q; the votes of
one start, weighted by IDF and divided by the template's whole weight, are its
score.  A start that reaches ``least_score`` must be verified by the template's key
phrases, within ``SLACK`` words of the notice that starts there, so one notice
doesn't confirm another.

All of it is DataFrame expressions.  Texts are read twice: for the frequencies, and
for the narrow facts that votes and report work on; only the words of texts whose
posted words could make up a notice are kept with those.  The index of templates,
and the frequencies of their words, are as large as the fixed template table, so
they are sent along as literals.

Null and empty texts have no words, places or labels, and score 0.  Documents are
treated one by one, so repeated rows and null ids change nothing; without
documents, the result is empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settled

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Of a template's words, so many of highest IDF are its postings.
POSTED = 6
LEAST_SCORE = 0.7
#: Where all documents share a notice, its words weigh alike.
LEAST_IDF = 0.01
#: Words around a notice in which its key phrases may stand.
SLACK = 5

# Phrases that the contract names, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Usual notices of public licences (name, notice, key phrases).
TEMPLATES = (
    ("MIT", "released under the mit license", ("mit license",)),
    ("MIT", "licensed under the mit license", ("mit license",)),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("MIT", "spdx license identifier mit", ("spdx license identifier mit",)),
    ("Apache-2.0", "spdx license identifier apache 2 0", ("identifier apache 2 0",)),
    ("GPL-2.0", "spdx license identifier gpl 2 0", ("identifier gpl 2 0",)),
    ("GPL-3.0", "spdx license identifier gpl 3 0", ("identifier gpl 3 0",)),
    ("LGPL", "spdx license identifier lgpl", ("identifier lgpl",)),
    ("AGPL-3.0", "spdx license identifier agpl 3 0", ("identifier agpl 3 0",)),
    ("BSD", "spdx license identifier bsd", ("identifier bsd",)),
    ("MPL-2.0", "spdx license identifier mpl 2 0", ("identifier mpl 2 0",)),
    ("ISC", "spdx license identifier isc", ("identifier isc",)),
    ("GPL-2.0", "under the gnu gpl v2", ("gnu gpl v2",)),
    ("GPL-3.0", "under the gnu gpl v3", ("gnu gpl v3",)),
    ("LGPL", "under the gnu lgpl", ("gnu lgpl",)),
    ("Apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("GPL-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    ("GPL-2.0", "under the terms of the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("GPL-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    ("LGPL", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("AGPL-3.0", "under the terms of the gnu affero general public license", ("affero general public license",)),
    ("BSD", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    ("BSD", "licensed under the bsd license", ("bsd license",)),
    ("MPL-2.0", "subject to the terms of the mozilla public license version 2 0", ("mozilla public license",)),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("CC-BY", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("CC-BY", "licensed under cc by 4 0", ("cc by 4",)),
    ("CC-BY-SA", "licensed under the creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("CC-BY-SA", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("CC-BY-NC", "licensed under the creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial 4",)),
    ("CC-BY-NC", "licensed under cc by nc 4 0", ("cc by nc 4",)),
    ("CC-BY-NC-SA", "licensed under the creative commons attribution noncommercial sharealike 4 0 international license", ("noncommercial sharealike",)),
    ("CC-BY-NC-SA", "licensed under cc by nc sa 4 0", ("cc by nc sa",)),
    ("CC-BY-ND", "licensed under the creative commons attribution noderivatives 4 0 international license", ("attribution noderivatives",)),
    ("CC0-1.0", "dedicated to the public domain under the creative commons cc0 1 0 universal", ("cc0 1 0",)),
    ("Unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("EPL-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("BSL-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("Zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose", ("permission is granted to anyone to use this software for any purpose",)),
)


def words_of(column: str) -> Column:
    """Words of a text with A-Z lower-cased; null counts as empty."""
    lowered = F.translate(F.coalesce(F.col(column), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _at(words: str, place: Column, phrase: list[str]) -> Column:
    """Whether the words from ``place`` on are those of ``phrase``."""
    out = F.lit(True)
    for k, word in enumerate(phrase):
        out = out & F.coalesce(F.get(F.col(words), place + k) == F.lit(word), F.lit(False))
    return out


def _phrase_places(words: str, ends: Column, phrase: list[str], label: str) -> Column:
    starts = F.filter(F.transform(ends, lambda p: p - (len(phrase) - 1)), lambda p: (p >= 0) & _at(words, p, phrase))
    return F.transform(starts, lambda p: F.struct(p.alias("place"), F.lit(label).alias("label")))


def _base_places(words: str) -> Column:
    """(place, label) of each base phrase; each ends in "license", so its places are tried."""
    ends = F.filter(F.transform(F.col(words), lambda w, i: F.when(w == "license", i)), lambda i: i.isNotNull())
    found = []
    for phrase, label in BASE:
        found.append(_phrase_places(words, ends, phrase.split(), label))
    none = F.array().cast("array<struct<place:int,label:string>>")
    return F.when(F.array_contains(words, "license"), F.concat(*found)).otherwise(none)


def vocabulary() -> list[str]:
    return sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})


def frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Documents, and how many hold each template word: at most one row for each such word."""
    listed = F.array(*map(F.lit, vocabulary()))
    held = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(words_of(text_col), listed))).alias("word"))
    counts = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return counts.pop("", 0), counts


def idf_of(total: int, counts: dict[str, int]) -> dict[str, float]:
    """ln((N + 1) / (n + 1)) to six places, so that every engine ranks alike; words that every document holds weigh a little, too."""
    return {w: max(LEAST_IDF, round(math.log((total + 1) / (counts.get(w, 0) + 1)), 6)) for w in vocabulary()}


def _postings(idf: dict[str, float]) -> list[tuple[int, str, int, float, float]]:
    """(template, word, place, weight, whole weight) of each template's rarest words."""
    out = []
    for t, (_, notice, _) in enumerate(TEMPLATES):
        words = notice.split()
        rare = sorted(set(words), key=lambda w: (-idf[w], w))[:POSTED]
        whole = sum(idf[w] for w in words if w in rare)
        out += [(t, w, q, idf[w], whole) for q, w in enumerate(words) if w in rare]
    return out


def _weights(postings: list[tuple[int, str, int, float, float]], template: int) -> list[tuple[str, float, float]]:
    """(word, weight at all its places, whole weight) of a template's posted words."""
    own: dict[str, float] = {}
    for t, word, _, weight, whole in postings:
        if t == template:
            own[word] = own.get(word, 0.0) + weight
            total = whole
    return [(word, weight, total) for word, weight in own.items()]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row."""
    spark = docs.sparkSession
    total, counts = frequencies(docs, text_col)
    idf = idf_of(total, counts)
    postings = _postings(idf)
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("k1"), F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("k2"), words_of(text_col).alias("words"))
    # a document's posted words: at most POSTED for each template
    posted = sorted({word for _, word, *_ in postings})
    rows = rows.withColumn("rare", F.array_intersect(F.array(*map(F.lit, posted)), "words"))
    # the most that any template's score can be, from the words alone; a map and a lambda keep the generated code small
    weights = [{w: v / whole if whole else 0.0 for w, v, whole in _weights(postings, t)} for t in range(len(TEMPLATES))]
    tables = F.array(*(F.create_map(*(F.lit(x) for item in sorted(own.items()) for x in item)) for own in weights))
    bound = F.array_max(F.transform(tables, lambda own: F.aggregate("rare", F.lit(0.0), lambda total, w: total + F.coalesce(F.element_at(own, w), F.lit(0.0)))))
    rows = rows.withColumn("maybe", F.coalesce(F.when(F.size("rare") > 0, bound) >= least_score - 1e-6, F.lit(False)))
    # no filter on "maybe": pushed down, it would repeat the scan of the words
    met = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("rare", w), F.struct(w.alias("word"), i.alias("place")))), lambda x: x.isNotNull())
    facts = settled(rows.select("id", "k1", "k2", F.size("words").cast("long").alias("n_words"), _base_places("words").alias("base"), F.when(F.col("maybe"), F.col("words")).alias("words"), F.when(F.col("maybe"), met).alias("met")), "licences")

    table = spark.createDataFrame(postings, "template int, word string, at int, weight double, whole double")
    asked = facts.where("met is not null").select("k1", "k2", F.explode("met").alias("met"))
    votes = asked.select("k1", "k2", "met.word", "met.place").join(F.broadcast(table), "word")  # as many rows as postings
    votes = votes.select("k1", "k2", "template", (F.col("place") - F.col("at")).alias("start"), "at", "weight", "whole").distinct()
    starts = votes.groupBy("k1", "k2", "template", "start").agg(F.round(F.least(F.lit(1.0), F.sum("weight") / F.max("whole")), 6).alias("score")).where(F.col("score") >= least_score)
    # words of a start's own notice, where its key phrases must stand
    texts = facts.where("words is not null").select("k1", "k2", "words").dropDuplicates(["k1", "k2"])
    sizes = F.array(*(F.lit(len(notice.split())) for _, notice, _ in TEMPLATES))
    low = F.greatest(F.col("start") - SLACK, F.lit(0))
    near = F.slice("words", low + 1, F.col("start") + F.get(sizes, F.col("template")) + SLACK - low)
    placed = starts.join(texts, ["k1", "k2"]).select("k1", "k2", "template", "score", F.concat(F.lit(" "), F.array_join(near, " "), F.lit(" ")).alias("near"))
    phrases = F.array(*(F.array(*(F.lit(f" {k} ") for k in keys)) for _, _, keys in TEMPLATES))
    sure = placed.where(F.forall(F.get(phrases, F.col("template")), lambda k: F.contains(F.col("near"), k)))
    best = sure.groupBy("k1", "k2", "template").agg(F.max("score").alias("score"))
    best = best.groupBy("k1", "k2").agg(F.collect_list(F.struct("template", "score")).alias("found"))  # a few per document at most: one for each template

    report = facts.select("id", "k1", "k2", "n_words", "base").join(best, ["k1", "k2"], "left")
    report = report.withColumn("sure", F.coalesce("found", F.array().cast("array<struct<template:int,score:double>>")))
    names = F.array(*(F.lit(name) for name, _, _ in TEMPLATES))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    own = F.transform("sure", lambda x: F.get(names, x["template"]))
    places = F.transform("base", lambda b: b["place"].cast("long"))
    score = F.greatest(F.when(F.size("base") > 0, 0.5).otherwise(0.0), F.coalesce(F.array_max(F.transform("sure", lambda x: x["score"])), F.lit(0.0)))
    return report.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, own))), ",").alias("labels"),
        score.alias("score"),
    )
