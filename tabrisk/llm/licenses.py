"""License scans by diagonal voting.

Every rolling pair of words of every text is hashed and Spark-joined to the
positions of the same pair in license templates.  A match at text position i
and template position j votes for the diagonal i - j; votes are summed by
(document, template, diagonal).  Neighbouring diagonals whose votes adjoin are
merged (a word added or dropped moves the diagonal by one), and a merged span
is verified: a short phrase must match in every pair, a long template in a
large enough share of its pairs.

The template table is part of the code (a few thousand positions), so its
broadcast has a fixed size; only matches are shuffled.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabrisk.llm import textscan
from tabrisk.llm.spark_util import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 2
#: Diagonals at most this far apart are merged if their votes adjoin.
NEIGHBOUR = 3
#: Words that may lie between the votes of two merged diagonals.
GAP = 12
#: Share of a long template's pairs that a verified span has matched.
COVERAGE = 0.6
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases with their labels; then notices as licensors publish
# them, for labels that a short phrase does not tell.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
               "in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, "
            "or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
            "rights to this work"),
    ("proprietary", "All rights reserved"),
)
#: Templates up to this many words must match whole.
SHORT = 9


def split(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def templates(phrases=PHRASES, notices=NOTICES):
    """[(label, base?, words)]"""
    return [(a, True, split(t)) for a, t in phrases] + [(a, False, split(t)) for a, t in notices]


def pair_hashes(words: list[str]) -> list[int]:
    h = np.array([textscan.word_hash(w) for w in words], np.uint64)
    return textscan.grams(h, np.zeros(len(h), np.int64), K)[0].view(np.int64).tolist()


def rolling(docs: DataFrame) -> DataFrame:
    """Rows (id, row, pos, gram) of ``docs`` (id, row, text): every rolling
    word pair with its position; a text of n words also has one row with pos
    -1 - n and no gram."""
    def run(batches):
        names = ["id", "row", "pos", "gram"]
        for batch in batches:
            for first, last, data, offsets in textscan.slices(batch.column(2), 1 << 20):
                _, _, h, doc = textscan.words(data, offsets, textscan.ALNUM)
                n = np.bincount(doc, minlength=last - first)
                before = np.cumsum(n) - n
                gram, at = textscan.grams(h, doc, K)
                ids, rows = (batch.column(i).slice(first, last - first) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, rows, pa.array(-1 - n), pa.nulls(len(n), pa.int64())], names=names)
                for k in range(0, len(gram), 1 << 17):  # batches of bounded size, however long the text
                    some = at[k: k + (1 << 17)]
                    own = pa.array(doc[some])
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(own), rows.take(own), pa.array(some - before[doc[some]]),
                         pa.array(gram[k: k + (1 << 17)].view(np.int64))], names=names)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "row", "text").mapInArrow(run, f"id {kind}, row long, pos long, gram long")


def spans(matches: DataFrame, known) -> DataFrame:
    """Verified spans (id, row, template, first, last, coverage) from matches
    (id, row, template, at, pos): votes by diagonal, merge, verify."""
    spark = matches.sparkSession
    votes = (matches.withColumn("diagonal", F.col("pos") - F.col("at"))
                    .groupBy("id", "row", "template", "diagonal")
                    .agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"),
                         F.min("at").alias("from_at"), F.max("at").alias("to_at")))
    sizes = spark.createDataFrame([(i, len(w) - K + 1, len(w) <= SHORT) for i, (_, _, w) in enumerate(known)],
                                  "template int, pairs int, short boolean")
    votes = votes.join(F.broadcast(sizes), "template")
    # one match of a long template alone is no evidence; it never reaches the coverage
    whole = votes.where("short and votes = pairs")
    loose = votes.where("not short and votes >= 2")
    order = Window.partitionBy("id", "row", "template").orderBy("first", "diagonal")
    joined = (loose.withColumn("apart", (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > NEIGHBOUR)
                               | (F.col("first") - F.lag("last").over(order) > GAP)
                               | (F.col("from_at") < F.lag("from_at").over(order)))
                   .withColumn("run", F.sum(F.coalesce(F.col("apart").cast("int"), F.lit(1))).over(order)))
    merged = (joined.groupBy("id", "row", "template", "run", "pairs")
                    .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
                    .withColumn("coverage", F.least(F.lit(1.0), F.col("votes") / F.col("pairs")))
                    .where(F.col("coverage") >= COVERAGE))
    return (whole.select("id", "row", "template", "first", F.col("last"), F.lit(1.0).alias("coverage"))
                 .union(merged.select("id", "row", "template", "first", "last", "coverage"))
                 .withColumn("last", F.col("last") + K - 1))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_base, first_word,
    last_word, base_labels, labels, score, spans (structs of label, first and
    last word, coverage).

    A null or empty text has no words and no label (score 0, words null).
    Repeated rows each get a row; extra columns are ignored; an empty table
    gives no row.
    """
    spark = docs.sparkSession
    known = templates(phrases, notices)
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # texts of one id stay apart; equal rows share their findings
    keyed = keyed.withColumn("row", F.xxhash64("id", "text"))
    both = ["id", "row"]
    table = spark.createDataFrame([(g, i, at) for i, (_, _, w) in enumerate(known) for at, g in enumerate(pair_hashes(w))],
                                  "gram long, template int, at int")
    pairs = rolling(keyed)
    hits = pairs.join(F.broadcast(table), "gram", "left").where("pos < 0 or template is not null")
    hits = written(hits.select(*both, "pos", "template", "at").distinct(), "license-matches")
    found = spans(hits.where("pos >= 0"), known)
    names = spark.createDataFrame([(i, label, base) for i, (label, base, _) in enumerate(known)],
                                  "template int, label string, base boolean")
    found = found.join(F.broadcast(names), "template")
    base = F.col("base")
    per_row = found.groupBy(*both).agg(
        F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"),
        F.array_sort(F.collect_list(F.struct("first", "last", "label", "coverage"))).alias("spans"))
    per_row = per_row.select(F.col("id").alias("_id"), F.col("row").alias("_row"), "n_base", "first_word", "last_word",
                             "base_labels", "labels", "score", "spans")
    counts = hits.where("pos < 0").select(*both, (-1 - F.col("pos")).alias("n_words"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))
    facts = counts.join(per_row, same, "left").drop("_id", "_row")
    facts = written(facts.withColumnsRenamed({"id": "_id", "row": "_row"}), "license-rows")
    ids = written(keyed.select("id", "row"), "license-ids")
    return ids.join(facts, same).select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans")
