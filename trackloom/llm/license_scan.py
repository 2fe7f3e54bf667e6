"""License scans by a positional index of rare words, in DataFrame functions only.

The template library is small and fixed: passages of common licenses and their standard headers, each with phrases that
must be there. How many documents hold each of its words is counted over all documents first. The index then has, for
every passage, its ``LOOKED_UP`` words of the highest IDF with their positions. A document's words are looked up in it: a
passage of which the document has ``LEAST_SHARE`` of these words is a candidate, its postings are intersected by relative
position (place in the document less position in the passage), and where ``LEAST_SHARE`` of them meet, the mandatory
phrases are verified last, word for word at that very place. Only row numbers and word places are shuffled, no text.

Defined results: a null or empty text has no words; only A-Z are lower-cased; rows that repeat a doc_id are scanned
one by one; of words that are equally rare the alphabetically first are looked up; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Base phrases: words that stand one after the other, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: label: (passage, mandatory phrases) of it. The licenses' own words.
TEMPLATES = {
    "agpl": [
        ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]),
        ("you should have received a copy of the gnu affero general public license along with this program", ["affero general public license"]),
    ],
    "apache-2": [
        ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license"]),
        ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ["apache license"]),
        ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["applicable law", "distributed under the license"]),
    ],
    "bsd": [
        ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "source and binary forms"]),
        ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code"]),
        ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form"]),
    ],
    "boost": [("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["free of charge", "accompanying documentation"])],
    "cc-by": [
        ("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
        ("this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit", ["creative commons attribution"]),
    ],
    "cc0": [("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["related or neighboring rights"])],
    "gpl": [
        ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
        ("under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
        ("you should have received a copy of the gnu general public license along with this program if not see", ["gnu general public license"]),
    ],
    "isc": [("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["or without fee", "is hereby granted"])],
    "lgpl": [
        ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
        ("you should have received a copy of the gnu lesser general public license along with this library", ["lesser general public license"]),
    ],
    "mit": [
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
        ("to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["without restriction", "sublicense"]),
        ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["substantial portions of the software"]),
    ],
    "mpl-2": [("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license"])],
    "reserved": [("all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means", ["all rights reserved"])],
    "unlicense": [("this is free and unencumbered software released into the public domain", ["unencumbered software"])],
    "zlib": [("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["as is without any express or implied warranty"])],
}
LOOKED_UP = 8
LEAST_SHARE = 0.75
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, _BREAKS), "")


def passages(templates: dict[str, list[tuple[str, list[str]]]] = TEMPLATES) -> list[tuple[str, list[str], list[str]]]:
    """(label, words, mandatory phrases) of each passage."""
    return [(label, passage.split(), phrases) for label, found in sorted(templates.items()) for passage, phrases in found]


def rare_words(words: list[str], documents: dict[str, int]) -> list[str]:
    """The passage's words that the fewest documents hold, the rarest first."""
    return sorted(set(words), key=lambda w: (documents.get(w, 0), w))[:LOOKED_UP]


def _needed(rare: list[str]) -> int:
    return -(-int(100 * LEAST_SHARE) * len(rare) // 100)


def mandatory_places(words: list[str], phrases: list[str]) -> list[int]:
    """The positions in the passage at which its mandatory phrases stand."""
    found = set()
    for phrase in phrases:
        parts = phrase.split()
        start = next(k for k in range(len(words)) if words[k : k + len(parts)] == parts)
        found.update(range(start, start + len(parts)))
    return sorted(found)


def _starts(words: Column, phrase: str) -> Column:
    """Where the words of the phrase stand one after the other, from 0."""
    parts = phrase.split()
    stands = lambda w, i: F.lit(True) if not parts[1:] else F.reduce(
        F.array(*(F.get(words, i + k) == p for k, p in enumerate(parts[1:], 1))), F.lit(True), lambda a, b: a & F.coalesce(b, F.lit(False)))
    return F.array_compact(F.transform(words, lambda w, i: F.when((w == parts[0]) & stands(w, i), i.cast("long"))))


def license_scan(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    library = passages()
    vocabulary = sorted({w for _, words, _ in library for w in words})
    known = F.array(*map(F.lit, vocabulary))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    # One row for each word of the library.
    documents = {r["word"]: r["n"] for r in split.select(F.explode(F.array_intersect(known, "words")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    rare = [rare_words(words, documents) for _, words, _ in library]

    # The index is looked up with each document's own words of it.
    held = split.withColumn("row", F.monotonically_increasing_id()).withColumn("held", F.array_intersect(F.array(*(F.lit(w) for w in sorted({w for r in rare for w in r}))), "words"))
    asked = F.array_compact(F.array(*(F.when(F.size(F.array_intersect("held", F.array(*map(F.lit, r)))) >= _needed(r), F.lit(k)) for k, r in enumerate(rare))))
    asked = F.when(F.size("held") >= min(map(_needed, rare)), asked).otherwise(F.array().cast("array<int>"))
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    empty = F.array().cast("array<bigint>")
    base = [F.when(F.contains(line, F.lit(f" {p} ")), _starts(F.col("words"), p)).otherwise(empty).alias(f"p{k}") for k, p in enumerate(PHRASES)]
    facts = held.withColumn("asked", asked).select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words", *base, "asked")
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.cast("long").alias("place"))), lambda x: F.array_contains(known, x["word"]))
    found = facts.withColumn("places", F.when(F.size("asked") > 0, places))
    scanned = materialise(found.select("row", "doc_id", "n_words", *(f"p{k}" for k in range(len(PHRASES))), "asked", "places"), "scanned")

    # Tables of the library's size.
    index = spark.createDataFrame([(k, w, i) for k, (_, words, _) in enumerate(library) for i, w in enumerate(words) if w in rare[k]], "passage int, word string, position int")
    due = spark.createDataFrame([(k, words[i], i) for k, (_, words, phrases) in enumerate(library) for i in mandatory_places(words, phrases)], "passage int, word string, position int")
    sizes = spark.createDataFrame([(k, label, len(rare[k]), _needed(rare[k]), len(mandatory_places(words, phrases))) for k, (label, words, phrases) in enumerate(library)], "passage int, label string, size int, needed int, due int")

    words = scanned.filter(F.size("asked") > 0).select("row", "asked", F.explode("places").alias("x")).select("row", "asked", "x.word", "x.place")
    postings = words.join(F.broadcast(index), "word").filter(F.array_contains("asked", F.col("passage")))
    met = postings.groupBy("row", "passage", (F.col("place") - F.col("position")).alias("shift")).agg(F.count_distinct("word").alias("hits"))
    met = met.join(F.broadcast(sizes), "passage").filter(F.col("hits") >= F.col("needed"))
    sought = met.join(F.broadcast(due), "passage").select("row", "passage", "label", "shift", (F.col("hits") / F.col("size")).alias("share"), "due", "word", (F.col("shift") + F.col("position")).alias("place"))
    stands = sought.join(words.select("row", "word", "place"), ["row", "word", "place"]).groupBy("row", "passage", "label", "shift", "share", "due").agg(F.count("*").alias("n"))
    matched = stands.filter(F.col("n") == F.col("due")).groupBy("row").agg(F.collect_set("label").alias("matched"), F.max("share").alias("share"))

    starts = F.concat(*(F.col(f"p{k}") for k in range(len(PHRASES))))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values()))))
    every = F.array_sort(F.array_union(base_labels, F.coalesce("matched", F.array().cast("array<string>"))))
    out = scanned.join(matched, "row", "left")
    return out.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size(base_labels) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
