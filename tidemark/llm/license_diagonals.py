"""License scans by diagonal voting.

Every rolling word 2-gram and 4-gram of a document is hashed and joined with the
positions of the same grams in license templates. A match at document word p and
template word q votes for the diagonal p - q: a template that stands in a document
gathers its votes on one diagonal, or on neighbouring ones where words were put in or
left out. Votes are counted by (document, template, diagonal); for passages,
diagonals up to ``max_shift`` apart are merged; a span is verified by the share of the
template's grams that it holds: all of them, on one diagonal, for a phrase, and
``min_cover`` for a passage. Matched grams are compared word by word, so hash
collisions cannot vote.

The templates are a fixed list of a few hundred grams and are broadcast. Documents are
never shuffled for the search: only votes are, pre-aggregated.

Edge cases: a null text is empty; documents with equal doc_id and text are judged
alike, and matched by both; a null doc_id is allowed; where several templates of one label fit,
the label stands once and the best cover is the score, whichever has it; very long texts are exploded word by word and never
held as one group; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed
from tidemark.llm.url_rules import LOWER, UPPER

#: Phrases that name a license; all of a phrase's words must follow each other.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
MORE_PHRASES = [
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd license", "bsd"),
    ("bsd 2 clause", "bsd"),
    ("bsd 3 clause", "bsd"),
    ("isc license", "isc"),
    ("creative commons attribution", "cc-by"),
    ("all rights reserved", "proprietary"),
]
#: Opening passages of license texts, which may be quoted with changes.
PASSAGES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same runs of characters before A-Z are lower-cased.
RAW_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def gram_hash(size: int, *words: Column) -> Column:
    return F.xxhash64(F.lit(size), *words[:size])


def rolling(words: Column) -> Column:
    """Each word with the three that follow it (null past the end)."""
    after = [F.slice(words, i + 1, F.size(words)) for i in (1, 2, 3)]
    return F.arrays_zip(words.alias("w0"), *[a.alias(f"w{i}") for i, a in enumerate(after, 1)])


def template_grams(spark: SparkSession, templates: list[tuple]) -> DataFrame:
    """(template, label, kind, grams, at, hash, t0..t3): one row per gram of each template.

    templates: (text, label, kind); kind is "passage" for 4-grams, else 2-grams.
    """
    rows = []
    for i, (text, label, kind) in enumerate(templates):
        words, size = text.split(), 4 if kind == "passage" else 2
        for at in range(len(words) - size + 1):
            gram = words[at : at + size]
            rows.append((i, label, kind, len(words) - size + 1, size, at, *gram, *[None] * (4 - size)))
    out = spark.createDataFrame(rows, "template int, label string, kind string, grams int, size int, at int, t0 string, t1 string, t2 string, t3 string")
    words = [F.col(f"t{i}") for i in range(4)]
    return out.withColumn("hash", F.when(F.col("size") == 2, gram_hash(2, *words)).otherwise(gram_hash(4, *words))).drop("size")


def votes(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(doc_id, row_key, template, label, kind, grams, diagonal, places): the template positions
    that vote for each diagonal of a document and a template."""
    text = F.translate(F.col("text"), UPPER, LOWER)
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    rows = rows.select("doc_id", "row_key", F.posexplode(rolling(F.col("words"))).alias("pos", "g")).select("doc_id", "row_key", "pos", "g.*")
    words = [F.col(f"w{i}") for i in range(4)]
    rows = rows.withColumn("hash", F.explode(F.array(gram_hash(2, *words), gram_hash(4, *words))))
    same = (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("t2").isNull() | ((F.col("w2") == F.col("t2")) & (F.col("w3") == F.col("t3"))))
    hits = rows.join(F.broadcast(grams), "hash").where(same)  # a fixed list of a few hundred rows
    by = ["doc_id", "row_key", "template", "label", "kind", "grams", (F.col("pos") - F.col("at")).alias("diagonal")]
    return hits.groupBy(*by).agg(F.collect_set("at").alias("places"))


def spans(voted: DataFrame, max_shift: int = 4, min_cover: float = 0.6) -> DataFrame:
    """(doc_id, row_key, label, kind, start, cover): verified spans, start in words from 0."""
    phrases = voted.where((F.col("kind") != "passage") & (F.size("places") == F.col("grams"))).select("doc_id", "row_key", "label", "kind", F.col("diagonal").alias("start"), F.lit(1.0).alias("cover"))
    along = W.partitionBy("doc_id", "row_key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > max_shift, F.lit(True)).cast("int")
    merged = voted.where("kind = 'passage'").withColumn("apart", apart).withColumn("band", F.sum("apart").over(along))
    merged = merged.groupBy("doc_id", "row_key", "template", "label", "kind", "grams", "band").agg(
        F.min(F.col("diagonal") + F.array_min("places")).alias("start"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    merged = merged.withColumn("cover", F.size("places") / F.col("grams")).where(F.col("cover") >= min_cover)
    return phrases.unionByName(merged.select("doc_id", "row_key", "label", "kind", "start", "cover"))


def scan(docs: DataFrame, phrases: list[tuple] = PHRASES, more: list[tuple] = MORE_PHRASES, passages: list[tuple] = PASSAGES) -> DataFrame:
    """Per document row: doc_id, n_words, places and labels of ``phrases``, all labels, score.

    score is the best cover of a template: 1 for a phrase, less for a changed passage.
    """
    templates = [(t, x, "base") for t, x in phrases] + [(t, x, "phrase") for t, x in more] + [(t, x, "passage") for t, x in passages]
    found = spans(checkpointed(votes(docs, template_grams(docs.sparkSession, templates))))
    base = F.col("kind") == "base"
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    of = found.groupBy(F.col("doc_id").alias("_id"), F.col("row_key").alias("_row_key")).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        names(F.when(base, F.col("label"))).alias("base_labels"), names(F.col("label")).alias("labels"), F.max("cover").alias("score"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), F.coalesce(F.regexp_count("text", F.lit(RAW_WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = rows.join(of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_row_key")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
