"""License scans by diagonal voting, in DataFrame operations only.

All word 3-grams of a text are hashed and joined to the positions of the same grams in the
license templates.  A match votes for the diagonal "place in the text minus place in the
template".  A phrase stands at a place where its diagonal has all its votes.  For longer
templates, neighbouring diagonals (words put in or left out shift them) are merged, and a
span counts if its distinct template grams, compared word by word in the join, make up
enough of the template and the span isn't stretched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut
from .grams import exploded, grams_of, words

GRAM = 3
#: Diagonals at most this far apart belong to one span.
DRIFT = 4
#: Share of a template's grams that a span must hold, and how much longer than the template it may be.
LEAST_SCORE = 0.6
STRETCH = 2.0
#: Words of all phrases and templates together, above which they would be too large to broadcast.
MOST_GRAMS = 100_000

# Phrases that the base labels stand for.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Passages of public licenses and usual notices.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT license."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, without the prior written permission of the publisher."),
]


def template_grams(spark: SparkSession, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """(template, label, phrase, total, gram, off): one row for each gram of each template."""
    rows = [(i, label, kind, text) for i, (label, text, kind) in enumerate([*((a, b, True) for a, b in phrases), *((a, b, False) for a, b in templates)])]
    if any(len(t.split()) < GRAM for _, _, _, t in rows):
        raise ValueError(f"a phrase or template needs {GRAM} words")
    df = spark.createDataFrame(rows, "template int, label string, phrase boolean, text string")
    df = df.withColumn("g", grams_of(words(F.col("text")), GRAM))
    return df.select("template", "label", "phrase", F.size("g").alias("total"), F.posexplode("g").alias("off", "gram")).withColumn("h", F.xxhash64("gram"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", phrases: list | None = None, templates: list | None = None) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Null and empty texts have no words and no labels (empty strings, score 0, null places).
    Repeated rows are scanned each; of ties all labels count.  Very long texts are read whole;
    an empty table gives no rows.  Phrases and templates are parameters of fixed size, which
    MOST_GRAMS bounds, and are sent to every executor.  Other columns are not read.
    """
    spark = docs.sparkSession
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    if sum(len(t.split()) for _, t in [*phrases, *templates]) > MOST_GRAMS:
        raise ValueError("phrases and templates are too long to be sent to every executor")
    known = template_grams(spark, phrases, templates)
    every = exploded(docs, [GRAM], text, key).withColumn("h", F.xxhash64("gram"))
    known = known.withColumnRenamed("gram", "is")
    met = every.join(F.broadcast(known), (every["h"] == known["h"]) & (F.col("gram") == F.col("is")), "left").where("template is not null or k is null")
    met = cut(met.select("_row", "_id", "n_words", F.col("k").isNull().alias("itself"), "pos", "template", "label", "phrase", "total", "off"), "votes")
    votes = met.where("not itself").withColumn("diagonal", F.col("pos") - F.col("off"))
    diagonals = votes.groupBy("_row", "template", "label", "phrase", "total", "diagonal").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_list("off").alias("offs"))

    places = diagonals.where("phrase and n = total")
    base = places.groupBy("_row").agg(F.count(F.lit(1)).alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.collect_set("label").alias("base"))

    line = Window.partitionBy("_row", "template").orderBy("diagonal")
    spans = diagonals.where("not phrase").withColumn("far", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > DRIFT).cast("int"), F.lit(1)))
    spans = spans.withColumn("span", F.sum("far").over(line)).groupBy("_row", "template", "label", "total", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("offs")))).alias("held"), F.min("low").alias("low"), (F.max("high") + GRAM).alias("high"))
    spans = spans.withColumn("score", F.col("held") / F.col("total"))
    proven = spans.where((F.col("score") >= LEAST_SCORE) & (F.col("high") - F.col("low") <= STRETCH * (F.col("total") + GRAM - 1)))
    more = proven.groupBy("_row").agg(F.collect_set("label").alias("more"), F.max("score").alias("score"))

    none = F.array().cast("array<string>")
    out = met.where("itself").select("_row", "_id", "n_words").join(base, "_row", "left").join(more, "_row", "left")
    mine, others = F.coalesce("base", none), F.coalesce("more", none)
    return out.select(
        F.col("_id").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(mine), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(mine, others)), ",").alias("labels"),
        F.greatest(F.when(F.size(mine) > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce("score", F.lit(0.0))).alias("score"),
    )


def op3_license_diagonals(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
