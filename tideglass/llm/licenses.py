"""Licence scan by a positional rare-token index, in DataFrame expressions only.

The index posts every word of every template with its places, and the documents that hold
the word are counted over the whole corpus. A document looks up its own words of highest
inverse document frequency: of each template that it holds `LEAST_SHARE` of the words of,
the `RARE` rarest that stand in it, so a word that is missing makes room for the next one.
Every place of such a word, less its places in the template, is a place where the template
would begin. Begins are intersected with a tolerance: windows of `2 * SPAN` begins, one at
every multiple of `SPAN`, count the distinct words that agree in them, so that words put in
or left out, which shift the rest, do not split the votes as long as begins differ by no
more than `SPAN`. A template is accepted when the best window holds `LEAST_SHARE` of `RARE`
words and every one of the template's key phrases stands in the document, word for word.

One pass counts, one scans. Nothing but one row per template word is shuffled or brought to
the driver (the index is bounded by the templates below); rows of documents are only
projected, so a hot source or repeated ids do not matter. Votes are sorted numbers, so a
very long text costs no more than its own sort.

`score` is 1 where a base phrase stands, else the best share of rare words over templates
that were accepted, else half the best share of any (0 where too few words stand).

Defined results: a null or empty text has no words, labels '' and score 0; ties between
words of equal frequency go by word; repeated rows are judged row by row; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import id_and_text

# Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Opening lines of public licences, and the phrases that must stand in full.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and"
        " associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted", "free of charge", "deal in the software"),
    ),
    "apache": (
        "licensed under the apache license version 2 0 the license you may not use this file except in"
        " compliance with the license you may obtain a copy of the license at",
        ("you may not use this file except in compliance with the license",),
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu"
        " general public license as published by the free software foundation",
        ("redistribute it and or modify it under the terms of the gnu",),
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted"
        " provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of"
        " the mpl was not distributed with this file you can obtain one at",
        ("subject to the terms of the mozilla public license",),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is"
        " hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee is hereby granted",),
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify"
        " publish use compile sell or distribute this software",
        ("free and unencumbered software released into the public domain",),
    ),
    "cc-by": (
        "this work is licensed under a creative commons attribution international license to view a copy of"
        " this license visit",
        ("licensed under a creative commons attribution",),
    ),
    "zlib": (
        "permission is granted to anyone to use this software for any purpose including commercial applications"
        " and to alter it and redistribute it freely subject to the following restrictions",
        ("alter it and redistribute it freely",),
    ),
    "boost": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the"
        " software and accompanying documentation covered by this license the software to use reproduce display"
        " distribute execute and transmit the software and to prepare derivative works of the software",
        ("reproduce display distribute execute and transmit the software",),
    ),
}
RARE = 8
LEAST_SHARE = 0.75
SPAN = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def postings(template: str) -> dict[str, list[int]]:
    """Places of each word of a template."""
    places: dict[str, list[int]] = {}
    for place, word in enumerate(TEMPLATES[template][0].split()):
        places.setdefault(word, []).append(place)
    return places


VOCABULARY = sorted({word for text, _ in TEMPLATES.values() for word in text.split()})


def by_rarity(words: DataFrame) -> list[str]:
    """Template words from the rarest to the most frequent, by documents over all rows.

    `words` has the column `words`. One row per template word reaches the driver.
    """
    counted = (
        words.select(F.explode(F.array_intersect("words", _array(VOCABULARY))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    df = {row["word"]: row["df"] for row in counted.collect()}
    return sorted(VOCABULARY, key=lambda word: (df.get(word, 0), word))


def _phrase_starts(words: Column, phrase: str) -> Column:
    """Positions where the words of a phrase stand one after the other."""
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.size(words) - len(parts))
    def stands(i: Column) -> Column:
        matched = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            matched = matched & (F.get(words, i + k) == part)
        return matched

    return F.when(F.size(words) >= len(parts), F.filter(at, stands)).otherwise(F.array().cast("array<int>"))


def _agreeing(words: Column, template: str, chosen: Column) -> Column:
    """The most distinct chosen words that place the template's begin in one window.

    A vote is the number window * RARE + place of the word among the chosen ones; sorted,
    the votes of a window stand together, and a fold counts the different ones.
    """
    entries = F.create_map(*[x for word, at in postings(template).items() for x in (F.lit(word), _array(at))])
    hits = F.filter(
        F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        lambda x: F.array_contains(chosen, x.w),
    )

    def votes(x: Column) -> Column:
        rank = F.array_position(chosen, x.w) - 1

        def windows(p: Column) -> Column:
            window = F.floor((x.i - p) / SPAN)
            return F.array(window * RARE + rank, (window - 1) * RARE + rank)

        return F.flatten(F.transform(F.element_at(entries, x.w), windows))

    def count(state: Column, vote: Column) -> Column:
        window = F.floor(vote / RARE)
        fresh = F.when(state.vote.isNull() | (window != F.floor(state.vote / RARE)), 1).otherwise(
            state.run + F.when(vote != state.vote, 1).otherwise(0)
        )
        return F.struct(vote.alias("vote"), fresh.alias("run"), F.greatest(state.best, fresh).alias("best"))

    start = F.struct(F.lit(None).cast("long").alias("vote"), F.lit(0).alias("run"), F.lit(0).alias("best"))
    return F.aggregate(F.sort_array(F.flatten(F.transform(hits, votes))), start, count, lambda state: state.best)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: base phrases by place, all labels, and a score."""
    worded = id_and_text(docs).select("doc_id", words_of(F.col("text")).alias("words"))
    order = by_rarity(worded)
    words = F.col("words")
    none = F.array().cast("array<int>")

    starts = {
        label: F.when(F.array_contains(words, phrase.split()[0]), _phrase_starts(words, phrase)).otherwise(none)
        for phrase, label in PHRASES
    }
    based = worded.select(
        "doc_id",
        "words",
        *[s.alias(f"_{label}") for label, s in starts.items()],
        F.array_intersect(words, _array(VOCABULARY)).alias("_own"),
    )

    def share(template: str) -> Column:
        ranked = [word for word in order if word in postings(template)]
        standing = F.filter(_array(ranked), lambda w: F.array_contains("_own", w))
        enough = F.size(F.array_intersect("_own", _array(ranked))) >= math.ceil(LEAST_SHARE * len(ranked))
        best = _agreeing(words, template, F.slice(standing, 1, RARE)) / F.lit(float(RARE))
        return F.when(F.size("_own") >= RARE, F.when(enough, best)).cast("double")

    shares = based.select("*", *[F.coalesce(share(t), F.lit(0.0)).alias(f"_share_{t}") for t in sorted(TEMPLATES)])

    def accepted(template: str) -> Column:
        line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        stand = F.lit(True)
        for key in TEMPLATES[template][1]:
            stand = stand & F.contains(line, F.lit(f" {key} "))
        return F.when(F.col(f"_share_{template}") >= LEAST_SHARE, stand).otherwise(F.lit(False))

    judged = shares.select("*", *[accepted(t).alias(f"_is_{t}") for t in sorted(TEMPLATES)])

    all_starts = F.concat(*[F.col(f"_{label}") for _, label in PHRASES])
    base = F.array_compact(F.array(*[F.when(F.size(f"_{label}") > 0, F.lit(label)) for label in sorted(l for _, l in PHRASES)]))
    more = F.array_compact(F.array(*[F.when(F.col(f"_is_{t}"), F.lit(t)) for t in sorted(TEMPLATES)]))
    best = F.greatest(*[F.col(f"_share_{t}") for t in sorted(TEMPLATES)])
    sure = F.greatest(*[F.when(F.col(f"_is_{t}"), F.col(f"_share_{t}")).otherwise(0.0) for t in sorted(TEMPLATES)])
    return judged.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.size(all_starts).cast("long").alias("n_base"),
        F.array_min(all_starts).cast("long").alias("first_word"),
        F.array_max(all_starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.when(F.size(all_starts) > 0, 1.0).when(sure > 0, sure).otherwise(best / 2).alias("score"),
    )
