"""License scan by diagonal voting, in DataFrame operations.

Every three words of a text are hashed and joined with the same of license templates. A match at place p
of the text and q of the template votes for the diagonal p - q, on which a whole copy puts all its votes;
inserted and left out words move to a diagonal beside it. So votes are counted by diagonal, neighbouring
diagonals are merged, and a merged span is verified by the share of the template's words that its exact
matches cover. Of spans that overlap, the one with the most words stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamellar.sources.storage import materialise

#: Words: characters that are digits, lower-case ASCII letters, or not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a hashed gram.
GRAM = 3
#: Percent of a template's words that a span covers at least; words of a template for each that diagonals of one span may differ.
COVERS, PER_SHIFT = 80, 5
#: Grams of templates that are broadcast at once (about 60 bytes each); more are taken in blocks, each against all texts.
MOST_GRAMS = 1_000_000

#: The base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices of public licenses, by their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "bsd-3-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _gram(words: Column, at: Column) -> Column:
    """The number of the gram that begins there, null if it would lead beyond the end."""
    return F.when((at >= 0) & (at + GRAM <= F.size(words)), F.xxhash64(*(F.get(words, at + i) for i in range(GRAM))))


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """gram, said, tpl, label, place, words, nth: every gram of templates (label, text); nth numbers those with one hash from 0.

    A template of fewer words than a gram is an error, as no gram would find it.
    """
    listed = F.array(*(F.struct(F.lit(i).alias("tpl"), F.lit(label).alias("label"), F.lit(text).alias("text")) for i, (label, text) in enumerate(templates)))
    rows = spark.range(1).select(F.explode(listed).alias("t")).select("t.tpl", "t.label", _words(F.col("t.text")).alias("w"))
    short = F.raise_error(F.lit(f"a template has fewer than {GRAM} words")).cast("int")
    rows = rows.withColumn("words", F.when(F.size("w") < GRAM, short).otherwise(F.size("w")))
    rows = rows.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("words") - GRAM)))
    said = F.array_join(F.slice("w", F.col("place") + 1, GRAM), " ")
    rows = rows.select(_gram(F.col("w"), F.col("place")).alias("gram"), said.alias("said"), "tpl", "label", "place", "words")
    return materialise(rows.withColumn("nth", F.row_number().over(W.partitionBy("gram").orderBy("tpl", "place")) - 1), "templates")


def _phrase(words: Column, at: Column) -> Column:
    """The label of the base phrase that begins there, or null. No phrase begins another."""
    found = F.lit(None).cast("string")
    for phrase, label in PHRASES:
        same = [F.get(words, at + i) == w for i, w in enumerate(phrase.split())]
        whole = same[0]
        for one in same[1:]:
            whole = whole & one
        found = F.when(whole, F.lit(label)).otherwise(found)
    return F.when(at >= 0, found)


def _places(numbered: DataFrame, grams: DataFrame) -> DataFrame:
    """row, doc_id, pos, n_words, base, nth, tpl, label, place, words: a row for each document (pos -1), and for its places of phrases and exact matches."""
    rows = numbered.select("row", "doc_id", _words(F.coalesce("text", F.lit(""))).alias("w"))
    rows = rows.select("row", "doc_id", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("pos"))
    rows = rows.withColumns({"base": _phrase(F.col("w"), F.col("pos")), "key": _gram(F.col("w"), F.col("pos"))})
    rows = rows.join(F.broadcast(grams), F.col("key") == F.col("gram"), "left").filter("pos < 0 or base is not null or tpl is not null")
    exact = F.array_join(F.slice("w", F.greatest(F.col("pos"), F.lit(0)) + 1, GRAM), " ") == F.col("said")
    return rows.select("row", "doc_id", "pos", F.size("w").alias("n_words"), "base", "nth", F.when(exact, F.col("tpl")).alias("tpl"), "label", "place", "words")


def _spans(places: DataFrame) -> DataFrame:
    """row, label, lo, hi, covered, words: merged diagonals, with the words of the text from lo to hi and how many of the template's they cover."""
    votes = places.filter("tpl is not null").withColumn("diagonal", F.col("pos") - F.col("place"))
    keys = ["row", "tpl", "label", "words"]
    # A diagonal has a template's places at most.
    by = votes.groupBy(*keys, "diagonal").agg(F.min("pos").alias("lo"), (F.max("pos") + GRAM).alias("hi"), F.collect_set("place").alias("at"))
    order = W.partitionBy("row", "tpl").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.floor(F.col("words") / PER_SHIFT), F.lit(True))
    by = by.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(order))
    held = F.array_distinct(F.flatten(F.transform("at", lambda q: F.sequence(q, q + (GRAM - 1)))))
    one = by.select(*keys, "span", "lo", "hi", F.explode(held).alias("q"))
    return one.groupBy(*keys, "span").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.countDistinct("q").alias("covered"))


def license_spans(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Places (see ``_places``) and spans: row, label, lo, hi, covered, words, stands.

    A span stands if it covers COVERS percent of its template, and no span that overlaps it has more
    words covered, or as many at a greater share.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    grams = template_grams(docs.sparkSession, templates)
    blocks = max(1, -(-grams.count() // MOST_GRAMS))
    if blocks > 1:
        rows = materialise(rows, "numbered")  # every block sees the same rows
    places = _places(rows, grams.filter(F.pmod(F.col("gram"), F.lit(blocks)) == 0) if blocks > 1 else grams)
    for k in range(1, blocks):  # documents and phrases are in the first
        more = _places(rows, grams.filter(F.pmod(F.col("gram"), F.lit(blocks)) == k)).filter("tpl is not null")
        places = places.unionByName(more.withColumn("base", F.lit(None).cast("string")))
    places = materialise(places, "places")
    spans = _spans(places).withColumn("whole", 100 * F.col("covered") >= COVERS * F.col("words"))
    # Overlapping whole spans are one cluster: a running maximum of ends along the text.
    along = W.partitionBy("row", "whole").orderBy("lo", "hi", "tpl")
    upto = F.max("hi").over(along.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("first", F.coalesce(F.col("lo") >= upto, F.lit(True)).cast("int")).withColumn("cluster", F.sum("first").over(along))
    best = F.max(F.struct("covered", -F.col("words"))).over(W.partitionBy("row", "whole", "cluster"))
    stands = F.col("whole") & (F.struct("covered", -F.col("words")) == best)
    return places, spans.select("row", "label", "lo", "hi", "covered", "words", stands.alias("stands"))


def license_scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row.

    Base phrases are counted at every place, and their labels stay whatever the spans say. The score is 1 with
    a base phrase, else the greatest share of a template's words that a span covers, 0 without one. Null
    and empty texts have no words; repeated rows and null ids are scanned like others; an empty table gives
    an empty result; other columns aren't read. A text is one array of words, so memory grows with the longest.
    """
    places, spans = license_spans(docs, templates, id_col, text_col)
    here = F.col("base").isNotNull() & (F.coalesce("nth", F.lit(0)) == 0)
    at = F.when(here, F.col("pos"))
    by_row = places.groupBy("row").agg(
        F.max(F.when(F.col("pos") < 0, F.struct("doc_id", "n_words"))).alias("d"),
        F.count_if(here).alias("n_base"),
        F.min(at).alias("first_word"),
        F.max(at).alias("last_word"),
        F.collect_set("base").alias("base"),
    )
    found = spans.groupBy("row").agg(F.collect_set(F.when(F.col("stands"), F.col("label"))).alias("own"), F.max(F.col("covered") / F.col("words")).alias("share"))
    rows = by_row.join(found, "row", "left")
    listed = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    none = F.array().cast("array<string>")
    return rows.select(
        "d.doc_id",
        F.col("d.n_words").cast("long").alias("n_words"),
        "n_base",
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        listed(F.col("base")).alias("base_labels"),
        listed(F.concat("base", F.coalesce("own", none))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
