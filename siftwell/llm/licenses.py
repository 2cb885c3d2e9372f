"""License scans by diagonal voting, with DataFrame functions only.

Every rolling word pair of every document is hashed and joined to the places where a
template has that pair; the words themselves are compared too, so an equal hash is never
trusted. A hit votes for the diagonal (place in the document minus place in the template).
Neighbouring diagonals within `gap` words of drift and distance merge into one span as long as
they go on in the template (one that begins at or before the last place voted for is another
copy), and a span counts if it covers enough of the template. A base phrase counts only where
one diagonal holds all of its pairs, that is where its words stand consecutively.

Null and empty texts give a row with no words and no label. Each input row gives one row,
repeated rows and null ids too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Base phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License notices and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this work is licensed under a creative commons attribution": "cc",
    "released into the public domain": "public-domain",
}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_pairs(spark: SparkSession, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(pair_hash, one, two, template, at, pairs, label, base): as many rows as the templates have words, known to the driver."""
    rows = []
    for n, (text, label, base) in enumerate([(t, v, True) for t, v in phrases.items()] + [(t, v, False) for t, v in templates.items()]):
        words = text.split()
        if len(words) < 2:
            raise ValueError(f"a template needs two words: {text!r}")
        rows += [(a, b, n, i, len(words) - 1, label, base) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    made = spark.createDataFrame(rows, "one string, two string, template int, at int, pairs int, label string, base boolean")
    return made.select(F.xxhash64("one", "two").alias("pair_hash"), "*")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, gap: int = 3, cover: float = 0.8, spans: bool = True) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every row of docs.

    score is the largest share of a template's pairs that a span covers (1 for a base place,
    0 without any span); spans are struct(label, start, end, cover), in words, end exclusive.
    Without `spans` that column, which lists all places of a text, is left out: the others need counts only.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    pair = lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1)).alias("h"), w.alias("w1"), F.get("words", i + 1).alias("w2"))
    # the first element stands for the row itself, and keeps rows without hits
    mark = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("string").alias("w1"), F.lit(None).cast("string").alias("w2")))
    each = rows.select("row", "doc_id", F.size("words").alias("size"), F.posexplode(F.concat(mark, F.transform("words", pair))).alias("place", "pair"))
    pairs = F.broadcast(template_pairs(docs.sparkSession, phrases, templates))
    hits = each.join(pairs, (F.col("pair.h") == F.col("pair_hash")) & (F.col("pair.w1") == F.col("one")) & (F.col("pair.w2") == F.col("two")), "left")
    hits = hits.where("template is not null or place = 0").select("row", "doc_id", F.when(F.col("place") == 0, F.col("size")).cast("long").alias("n"), (F.col("place") - 1).alias("place"), "template", "at", "pairs", "label", "base")
    # votes on each diagonal; row marks pass through as template null
    votes = hits.groupBy("row", "doc_id", "template", "pairs", "label", "base", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.max("n").alias("n"), F.count("at").alias("votes"), F.min("place").alias("low"), F.max("place").alias("high"), F.collect_set("at").alias("ats"))
    at_row = Window.partitionBy("row", "template", "base").orderBy("low", "diagonal")
    drift = F.abs(F.col("diagonal") - F.lag("diagonal").over(at_row)) > gap
    far = F.col("low") - F.lag("high").over(at_row) > gap + 1
    again = F.array_min("ats") <= F.lag(F.array_max("ats")).over(at_row)
    fresh = votes.withColumn("fresh", F.when(F.col("base"), 1).otherwise(F.coalesce((drift | far | again).cast("int"), F.lit(1))))
    merged = fresh.withColumn("group", F.sum("fresh").over(at_row)).groupBy("row", "doc_id", "template", "pairs", "label", "base", "group")
    merged = merged.agg(F.max("n").alias("n"), F.sum(F.size("ats")).alias("covered"), F.min("low").alias("low"), F.max("high").alias("high"))
    share = F.col("covered") / F.col("pairs")
    whole = F.when(F.col("base"), F.col("covered") == F.col("pairs")).otherwise(share >= cover)
    found = merged.select("row", "doc_id", "n", F.when(whole, F.col("label")).alias("label"), (F.col("base") & whole).alias("is_base"), F.col("low").cast("long").alias("start"), (F.col("high") + 2).cast("long").alias("end"), F.when(whole, share).alias("cover"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    start = F.when(F.col("is_base"), F.col("start"))
    listed = [F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "start", "end", "cover")))).alias("spans")] if spans else []
    return found.groupBy("row", "doc_id").agg(F.max("n").alias("n_words"), F.count_if("is_base").alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"), joined(F.when(F.col("is_base"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"), *listed).drop("row")
