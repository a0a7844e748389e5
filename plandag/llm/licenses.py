"""Licence scan by a positional rare-token index, in DataFrame operations only.

Fixed phrases give the base labels wherever their words stand consecutively. Beside them the method finds whole notices: all of a file's
licence words are looked up in the postings of the notices' words (those of the notices but for FUNCTION_WORDS, which are common anywhere),
each weighed by its IDF over all documents. Hits that put the notice at about the same place of the file are one placement: words put in or left
out may shift them against each other by SLACK / 2 words, and by less than SLACK in any case. Its score is the IDF of the notice's places
that it covers, each once, against that of all of them. A placement counts if it covers COVER or more and the notice's key phrases stand in
the file.

Null and empty texts have no words, no labels and score 0. Long texts are read whole. Labels are sorted; of several placements the best one gives the
score. Rows that repeat a doc_id are scanned one by one. No documents: no rows. Columns besides doc_id and text are left aside, whatever
their names.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plandag.llm.shared import materialize

#: Phrases of the contract with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, notice, key phrases that must stand in the file.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license"]),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache org licenses"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted"]),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ["general public license version 2"]),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ["general public license version 3"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ["lesser general public license"]),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License", ["affero general public license"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ["permission is hereby granted"],
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
        ["permission to use copy modify"],
    ),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        ["redistributions of source code", "redistributions in binary form"],
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ["redistribution and use"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ["cc by nd"]),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc0-1.0", "CC0 1.0 Universal public domain dedication", ["cc0 1 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software"]),
]
#: Words of notices that are no licence words.
FUNCTION_WORDS = frozenset(
    "a above all an and any are at by do except file following for form forms free in include included including into is it list may must not notice of on or "
    "other person persons possible purpose shall so subject that the this to under use whom with without you".split()
)
#: Words by which hits of one placement may be shifted, and the least share covered.
SLACK, COVER = 8, 0.7

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def notice_words(text: str) -> list[str]:
    return [w for w in re.split("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]


def places(words: Column, phrase: str) -> Column:
    """Indices at which the phrase's words stand consecutively."""
    parts = phrase.split()
    here = lambda x, k: reduce(lambda a, b: a & b, [x == parts[0], *(F.get(words, k + n) == p for n, p in enumerate(parts) if n)])
    found = F.filter(F.transform(words, lambda x, k: F.when(here(x, k), k.cast("long"))), lambda v: v.isNotNull())
    return F.when(reduce(lambda a, b: a & b, [F.array_contains(words, p) for p in parts]), found).otherwise(F.array().cast("array<bigint>"))


def read_words(docs: DataFrame) -> DataFrame:
    """A narrow row for each document, written once: word count, places of the phrases, licence words with their places, key phrases."""
    vocabulary = sorted({w for _, text, _ in NOTICES for w in notice_words(text)} - FUNCTION_WORDS)
    keys = sorted({k for *_, phrases in NOTICES for k in phrases})
    words = F.array_remove(F.split(lower_ascii(F.coalesce("text", F.lit(""))), SEPARATORS), "")
    df = docs.select("doc_id", words.alias("words"))
    w = F.col("words")
    hits = F.filter(F.transform(w, lambda x, k: F.when(x.isin(vocabulary), F.struct(x.alias("word"), k.alias("at")))), lambda v: v.isNotNull())
    hits = F.when(F.arrays_overlap(w, F.array(*map(F.lit, vocabulary))), hits).otherwise(F.array().cast("array<struct<word:string,at:int>>"))
    places_of = [places(w, p).alias(f"p{k}") for k, p in enumerate(PHRASES)]
    df = df.select("doc_id", F.size(w).cast("long").alias("n_words"), *places_of, hits.alias("hits"), F.when(F.size(hits) > 0, F.array_join(w, " ")).alias("line"))
    line = F.concat(F.lit(" "), "line", F.lit(" "))
    held = F.array_compact(F.array(*[F.when(line.contains(f" {k} "), F.lit(k)) for k in keys]))
    held = F.when(F.col("line").isNotNull(), held).otherwise(F.array().cast("array<string>"))
    columns = ["doc_id", "n_words", *[f"p{k}" for k in range(len(PHRASES))], "hits"]
    return materialize(df.select(*columns, held.alias("keys"), F.monotonically_increasing_id().alias("row")), "licence-words")


def rows(spark, names: str, values: list[tuple]) -> DataFrame:
    """A table of constants; its size is that of the lists above."""
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(quote, v)) + ')' for v in values)} AS t({names})")


def notices_found(read: DataFrame) -> DataFrame:
    """(row, found labels, score) for the documents that hold a notice."""
    spark = read.sparkSession
    hits = read.select("row", F.explode("hits").alias("h")).select("row", "h.word", "h.at")
    n = read.count()
    # At most a row for each word of NOTICES reaches the driver.
    frequency = {r.word: r.df for r in hits.groupBy("word", "row").agg(F.lit(1)).groupBy("word").agg(F.count(F.lit(1)).alias("df")).collect()}
    weigh = lambda w: round(math.log((n + 1) / (frequency.get(w, 0) + 1)) + 1, 9)
    postings, wholes = [], []
    for k, (label, text, phrases) in enumerate(NOTICES):
        held = [(w, at) for at, w in enumerate(notice_words(text)) if w not in FUNCTION_WORDS]
        postings += [(w, weigh(w), k, at) for w, at in held]
        wholes.append((k, label, sum(weigh(w) for w, _ in held), phrases))
    index = F.broadcast(rows(spark, "word, idf, notice, place", postings))
    phrases = rows(spark, "notice, phrase", [(k, p) for k, *_, ps in wholes for p in ps]).groupBy("notice").agg(F.collect_list("phrase").alias("phrases"))
    whole = F.broadcast(rows(spark, "notice, label, whole", [x[:3] for x in wholes]).join(phrases, "notice"))
    start = F.col("at") - F.col("place")
    # Two rows of boxes, one half a box further on: starts that are half a box apart fall into one box of either.
    box = lambda shift: F.struct(F.lit(shift).alias("shift"), F.floor((start + shift) / SLACK).alias("box"))
    met = hits.join(index, "word").select("row", "notice", "place", "idf", F.explode(F.array(box(0), box(SLACK // 2))).alias("at"))
    places = F.array_sort(F.collect_set(F.struct("place", "idf")))
    placed = met.groupBy("row", "notice", "at").agg(F.aggregate(places, F.lit(0.0), lambda total, x: total + x["idf"]).alias("covered"))
    best = placed.groupBy("row", "notice").agg(F.max("covered").alias("covered")).join(whole, "notice")
    best = best.where(F.col("covered") >= COVER * F.col("whole") - 1e-9).join(read.select("row", "keys"), "row").where(F.size(F.array_except("phrases", "keys")) == 0)
    return best.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.least(F.lit(1.0), F.col("covered") / F.col("whole"))).alias("score"))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the best share of a notice covered; 1 where there are base phrases only, 0 where there is nothing.
    """
    read = read_words(docs)
    phrases = [F.col(f"p{k}") for k in range(len(PHRASES))]
    every = F.concat(*phrases)
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(phrases, PHRASES.values(), strict=True)])))
    out = read.join(notices_found(read), "row", "left")
    both = F.array_sort(F.array_distinct(F.concat(base, F.coalesce("found", F.array().cast("array<string>")))))
    return out.select("doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).alias("first_word"), F.array_max(every).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.coalesce("score", F.when(F.size(every) > 0, 1.0).otherwise(0.0)).alias("score"))
