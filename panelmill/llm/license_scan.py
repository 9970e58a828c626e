"""License scan by a positional index of rare words (operator 12), DataFrame functions only.

A template is a short licence text with a label and mandatory key phrases; the base phrases are templates whose words are
all mandatory. How many documents have each licence word is counted over all documents. Every template is indexed by its
highest-IDF words with their positions: at most ``rare`` words that at most ``common`` of the documents have, and always
the rarest one. A file's words are looked up in that index; a word at place i that stands at position k of a
template votes for an alignment (template, start i - k), so postings are intersected by relative position: an alignment
needs two votes (one, if the template has one rare word). Then its key phrases are verified word by word, and the share of
its words that stand in place is taken. A template adds its label from ``share`` on, a base phrase always.

The index is complete for the base phrases: whoever has all words in place has the rare ones there. A template with
a mandatory word that no document has cannot occur and is left out.

Sent to the tasks is the index, whose size hangs on the templates alone. Documents stay in their partitions: words,
votes and verification are array expressions of one row, and each is linear in the file (votes are sorted).

Defined results: a null or empty text has no words, empty labels, null places and score 0; repeated rows are judged each on
their own; an empty table gives no rows; other columns are ignored, whatever their names. The score is the largest
share of any template whose key phrases stand in place, and one half if only base phrases do.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Fixed values: (label, words of a usual licence notice, its mandatory key phrases).
NOTICES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     ("gnu general public license", "version 3")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2",
     ("gnu general public license", "version 2")),
    ("gpl-3.0-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license "
     "as published by the free software foundation either version 3 of the license or at your option any later version",
     ("gnu general public license", "either version 3", "any later version")),
    ("lgpl-2.1-or-later", "you can redistribute it and or modify it under the terms of the gnu lesser general public "
     "license as published by the free software foundation either version 2 1 of the license or at your option any later "
     "version", ("gnu lesser general public license", "any later version")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in "
     "compliance with the license", ("apache license", "2 0", "except in compliance")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction",
     ("permission is hereby granted free of charge", "without restriction")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution 4 0",)),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met", ("source and binary forms", "with or without modification")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license", "2 0")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
     "hereby granted", ("permission to use copy modify", "with or without fee")),
)


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    must: tuple[bool, ...]  # whether a word is part of a key phrase
    base: bool


def plain_words(text: str) -> tuple[str, ...]:
    return tuple(re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER))))


def template(label: str, text: str, phrases: tuple[str, ...], base: bool = False) -> Template:
    own = plain_words(text)
    must = [False] * len(own)
    for phrase in phrases:
        w = plain_words(phrase)
        at = next(i for i in range(len(own)) if own[i:i + len(w)] == w)  # a key phrase must be part of its template
        must[at:at + len(w)] = [True] * len(w)
    return Template(label, own, tuple(must), base)


def templates(base=BASE, notices=NOTICES) -> list[Template]:
    return [template(label, phrase, (phrase,), True) for phrase, label in base] + [template(*x) for x in notices]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def document_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each licence word occurs, and under "" how many documents there are."""
    held = F.explode(F.array_union(F.array_intersect(words_of(F.col("text")), strings(vocabulary)), strings([""])))
    return {r.word: r.n for r in docs.select(held.alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


class Index(NamedTuple):
    """Postings of rare words, and how many votes an alignment needs; one entry per template."""

    postings: dict[str, list[tuple[int, int]]]  # word -> (template, position)
    needs: list[int]
    rare: list[list[str]]


def rare_words(own: Template, counts: dict[str, int], rare: int, common: float) -> list[str]:
    """The template's highest-IDF words; none if a mandatory word occurs nowhere."""
    if any(m and w not in counts for w, m in zip(own.words, own.must)):
        return []
    order = sorted({w for w in own.words if w in counts}, key=lambda w: (-idf(w, counts), w))
    return order[:1] + [w for w in order[1:rare] if counts[w] <= common * counts[""]]


def idf(word: str, counts: dict[str, int]) -> float:
    return math.log((counts[""] + 1) / (counts[word] + 1))


def index(own: list[Template], counts: dict[str, int], rare: int, common: float) -> Index:
    postings: dict[str, list[tuple[int, int]]] = {}
    chosen = [rare_words(t, counts, rare, common) for t in own]
    for i, (t, few) in enumerate(zip(own, chosen)):
        for k, w in enumerate(t.words):
            if w in few:
                postings.setdefault(w, []).append((i, k))
    return Index(postings, [min(2, len(few)) for few in chosen], chosen)


def scan(docs: DataFrame, own: list[Template] | None = None, rare: int = 3, common: float = 0.05, share: float = 0.6,
         id_: str = "doc_id") -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, and ``matches``, an array of
    (label, start, share) of all templates whose key phrases stand in place."""
    own = own or templates()
    counts = document_counts(docs, sorted({w for t in own for w in t.words}))
    made = index(own, counts, rare, common)
    rows = docs.select(F.col(id_).alias("id"), words_of(F.col("text")).alias("words"))
    if not made.postings:
        found = F.array().cast("array<struct<t: int, start: int, share: double>>")
        return report(rows.withColumn("found", found), own, share, id_)
    keys = strings(sorted(made.postings))
    sets = F.array(*[F.struct(strings(few).alias("words"), F.lit(n).alias("need"))
                     for few, n in zip(made.rare, made.needs) if n])
    # a file with too few rare words of every template has no alignment, so its words need not be numbered
    rows = rows.withColumn("held", F.array_intersect("words", keys))
    able = F.exists(sets, lambda s: F.size(F.array_intersect(s["words"], F.col("held"))) >= s["need"])
    posting = "array<struct<t: int, k: int>>"
    lookup = F.create_map(*[x for w, at in sorted(made.postings.items()) for x in (
        F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for t, k in at]).cast(posting))])
    numbered = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    places = F.filter(numbered, lambda x: x["w"].isin(*made.postings))
    votes = F.flatten(F.transform(places, lambda p: F.transform(
        lookup[p["w"]], lambda e: F.struct(e["t"].alias("t"), (p["i"] - e["k"]).alias("start")))))
    rows = rows.withColumn("votes", F.when(able, F.sort_array(votes)).otherwise(
        F.array().cast("array<struct<t: int, start: int>>"))).drop("held")
    needs = F.array(*[F.lit(n) for n in made.needs])
    twice = F.filter("votes", lambda v, i: (F.get(needs, v["t"]) == 1) | (v == F.get("votes", i - 1)))
    rows = rows.withColumn("aligned", F.array_distinct(twice)).drop("votes")
    texts = F.array(*[F.struct(strings(t.words).alias("words"), F.array(*map(F.lit, t.must)).alias("must")) for t in own])

    def verified(a: Column) -> Column:
        words = F.get(texts, a["t"])["words"]
        must = F.get(texts, a["t"])["must"]
        in_place = lambda w, k: w.eqNullSafe(F.get("words", a["start"] + k))
        missing = F.filter(words, lambda w, k: F.get(must, k) & ~in_place(w, k))
        part = F.size(F.filter(words, in_place)) / F.size(words)
        return F.struct(a["t"].alias("t"), a["start"].alias("start"), part.alias("share"), (F.size(missing) == 0).alias("ok"))

    rows = rows.withColumn("checked", F.transform("aligned", verified))
    return report(rows.withColumn("found", F.filter("checked", lambda x: x["ok"])), own, share, id_)


def report(rows: DataFrame, own: list[Template], share: float, id_: str) -> DataFrame:
    names = strings([t.label for t in own])
    is_base = F.array(*[F.lit(t.base) for t in own])
    base = F.filter("found", lambda x: F.get(is_base, x["t"]))
    good = F.filter("found", lambda x: F.get(is_base, x["t"]) | (x["share"] >= share))
    rows = rows.withColumns({"base": base, "good": good})
    label = lambda at: F.array_join(F.array_sort(F.array_distinct(
        F.transform(at, lambda x: F.get(names, x["t"])))), ",")
    starts = F.transform("base", lambda x: x["start"].cast("long"))
    shares = F.transform("found", lambda x: F.when(F.get(is_base, x["t"]), F.lit(0.5)).otherwise(x["share"]))
    return rows.select(
        F.col("id").alias(id_), F.size("words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        label("base").alias("base_labels"), label("good").alias("labels"),
        F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"),
        F.transform("found", lambda x: F.struct(F.get(names, x["t"]).alias("label"), x["start"].cast("long").alias("start"),
                                                x["share"].alias("share"))).alias("matches"))
