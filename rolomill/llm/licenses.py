"""License scan by diagonal voting, in DataFrame operations only.

Texts are cut into words (A-Z lower-cased). All rolling two-word grams of all texts are joined by hash with the positions of the same grams in the
templates; the words themselves are compared too, so hashes never decide. A match of text position i with template position j votes for the
diagonal i - j. Votes are counted by (document, template, diagonal); diagonals that differ by at most SHIFT (words put in or left out) merge; a merged
span is verified by its share of the template's grams, each counted once however many diagonals have it, and by its length. Which grams a span has is
kept as bits of a few longs, so nothing is gathered in lists.

A phrase stands consecutively exactly where a diagonal has all its grams, so base phrases are counted on unmerged diagonals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: Base phrases and labels of the contract; then own templates with labels.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
TEMPLATES = [
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
]
#: Merged diagonals differ by at most SHIFT; a span needs SHARE of the template's grams (templates of few grams: all) and at most STRETCH times its length.
SHIFT, SHARE, STRETCH = 2, 0.7, 1.5
#: Grams of a template that one long holds as bits.
BITS = 62
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _grams(spark, templates) -> DataFrame:
    rows = [(t, label, base, j, len(w) - 1, w[j], w[j + 1]) for t, (label, phrase, base) in enumerate(templates) for w in [phrase.split()] for j in range(len(w) - 1)]
    g = spark.createDataFrame(rows, "t int, label string, base boolean, j int, m int, w1 string, w2 string")
    return g.withColumn("h", F.xxhash64("w1", "w2"))


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score is the largest share of a template's grams in a verified span, 0 without one. spans lists label:first word:words of verified template spans.
    Null counts as the empty text; repeated rows and null keys give a row each; templates need two words or more; other columns are not read.
    """
    spark = docs.sparkSession
    phrases = [(label, p, True) for label, p in base] + [(label, p, False) for label, p in templates]
    grams = _grams(spark, phrases)
    masks = [f"g{q}" for q in range(-(-max(len(p.split()) - 1 for _, p, _ in phrases) // BITS))]
    # The Kelvin sign is the one character outside ASCII whose lower case is a letter of a-z as a whole; it must stay apart from k.
    low = F.lower(F.replace(text_of(docs, text), F.lit("K"), F.lit("ª")))
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.split(low, _NOT_WORD).alias("w"))
    d = d.withColumn("skip", F.when(F.col("w")[0] == "", 1).otherwise(0))
    d = d.withColumn("n", F.size("w") - F.col("skip") - F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0))
    at = d.select("row", "doc_id", "n", "skip", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0)))).alias("i"))
    gram = at.select("row", "doc_id", "n", "skip", "i", F.col("w")[F.col("i")].alias("v1"), F.get("w", F.col("i") + 1).alias("v2"))
    hit = gram.join(F.broadcast(grams), (F.xxhash64("v1", "v2") == F.col("h")) & (F.col("v1") == F.col("w1")) & (F.col("v2") == F.col("w2")), "left")
    # the first position stays in any case, so that every row has a result
    hit = hit.where(F.col("t").isNotNull() | (F.col("i") == 0)).select("row", "doc_id", "n", "t", "label", "base", "m", "j", (F.col("i") - F.col("skip")).alias("i"), (F.col("i") - F.col("skip") - F.col("j")).alias("diag"))
    bit = lambda q: F.bit_or(F.when(F.floor(F.col("j") / BITS) == q, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j") % BITS)).otherwise(F.lit(0).cast("long")))
    votes = hit.repartition("row").groupBy("row", "doc_id", "n", "t", "label", "base", "m", "diag").agg(F.count("t").alias("votes"), F.min("i").alias("lo"), (F.max("i") + 1).alias("hi"), *(bit(q).alias(g) for q, g in enumerate(masks)))
    w = Window.partitionBy("row", "t").orderBy("diag")
    votes = votes.withColumn("new", F.when(F.col("diag") - F.lag("diag").over(w) <= SHIFT, 0).otherwise(1))
    votes = votes.withColumn("part", F.sum("new").over(w))
    whole = F.col("base") & (F.col("votes") == F.col("m"))
    spans = votes.groupBy("row", "doc_id", "n", "t", "label", "base", "m", "part").agg(sum(F.bit_count(F.bit_or(g)) for g in masks).alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count_if(whole).alias("places"), F.min(F.when(whole, F.col("diag"))).alias("first"), F.max(F.when(whole, F.col("diag"))).alias("last"))
    share = F.col("votes") / F.col("m")
    good = ~F.col("base") & (share >= F.when(F.col("m") < 4, 1.0).otherwise(SHARE)) & (F.col("hi") - F.col("lo") + 1 <= STRETCH * (F.col("m") + 1))
    found = F.col("places") > 0
    out = spans.groupBy("row", "doc_id").agg(
        F.max("n").cast("long").alias("n_words"),
        F.coalesce(F.sum("places"), F.lit(0)).cast("long").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(found | good, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(found, 1.0).when(good, share)), F.lit(0.0)).alias("score"),
        F.array_join(F.array_sort(F.collect_list(F.when(good, F.concat_ws(":", "label", "lo", F.col("hi") - F.col("lo") + 1)))), ",").alias("spans"),
    )
    return out.drop("row")
