"""License scans as an exact set-similarity join, in DataFrame functions alone.

A template is a set of words; a text block is any run of ``size`` consecutive words of a document (fewer at its end).
A block meets a template if it holds at least ``need`` of the template's distinct words.  Template words are ordered by
their frequency over all documents; a block that meets the template holds one of its ``|T| - need + 1`` rarest
words.  So the templates are posted under those words (prefix filter) and joined with the places where they stand in the documents.
A joined place counts only if the document has ``need`` words (length filter) and the stretch that blocks around
the place can cover holds ``need`` template words (positional filter); then every block there is counted.
A phrase is a template whose words must all be there, one after the other.

Two scans of the documents; texts are never shuffled, only the places that the join keeps and one short row per document.
The posted templates are broadcast where their counted size allows, else the join is a shuffle on words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose every place counts, and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Public license notices, lower case, and the labels this scan adds.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit-header", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


#: Whole public license texts, lower case, without their headings.
FULL = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    need: int
    size: int
    phrase: bool

    @property
    def tokens(self) -> list[str]:
        return sorted(set(self.words))


def templates(percent: int = 80, notices: list[tuple[str, str]] | None = None) -> list[Template]:
    """Phrases, then notices (label, text): a notice's block is half as long again as the notice."""
    out = [Template(label, w := tuple(text.split()), len(w), len(w), True) for text, label in PHRASES]
    for label, text in NOTICES + FULL if notices is None else notices:
        w = tuple(text.split())
        out.append(Template(label, w, math.ceil(len(set(w)) * percent / 100), math.ceil(1.5 * len(w)), False))
    return out


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased.  ``lower`` also maps other capitals, which no ASCII template word can tell;
    the Kelvin sign, the one character it would map to a bare ASCII letter, is set to another non-ASCII letter first."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ß"))), F.lit(WORD), F.lit(0))


def template_table(spark: SparkSession, given: list[Template]) -> DataFrame:
    """The templates as rows: t, label, words, tokens, need, size, phrase."""
    texts = lambda values: F.array(*(F.lit(v) for v in values)).cast("array<string>")
    rows = [F.struct(F.lit(k).alias("t"), F.lit(t.label).alias("label"), texts(t.words).alias("words"), texts(t.tokens).alias("tokens"), F.lit(t.need).alias("need"), F.lit(t.size).alias("size"), F.lit(t.phrase).alias("phrase")) for k, t in enumerate(given)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def posted(table: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """One row per template and word of its prefix in the order of corpus frequency: w, the template, and the word's places in it."""
    own = table.select("t", F.explode("tokens").alias("w"))
    held = [r.w for r in own.select("w").distinct().collect()]  # words of templates, not of documents
    often = docs.select(F.explode(F.filter(words_of(F.col(text)), lambda w: w.isin(held))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("t").orderBy("often", "w"))
    ranked = own.join(often, "w", "left").withColumn("often", F.coalesce("often", F.lit(0))).withColumn("rank", rank)
    prefix = ranked.join(table, "t").filter(F.col("rank") <= F.size("tokens") - F.col("need") + F.when(F.col("phrase"), F.size("words") - F.col("need")).otherwise(F.lit(0)) + 1)
    at = F.filter(F.transform("words", lambda x, i: F.when(x == F.col("w"), i)), lambda i: i.isNotNull())
    return prefix.filter(~F.col("phrase") | (F.col("rank") == 1)).withColumn("at", at)


def scan(docs: DataFrame, *, id: str = "doc_id", text: str = "text", percent: int = 80, notices: list[tuple[str, str]] | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """One row per document: id, n_words, places (array of struct label, start) of the phrases, blocks (array of struct
    label, start, held, of): every block that meets a notice, once.

    Null and empty texts have no words, places or blocks.  Repeated rows each keep their own result; the order of places
    and blocks is not told.
    """
    index = cut(posted(template_table(docs.sparkSession, templates(percent, notices)), docs, text))
    reach = {r.w: r.m for r in index.groupBy("w").agg(F.max("size").alias("m")).collect()}  # words of prefixes, not of documents
    probes = sorted(reach)
    rows = docs.select(F.col(id).alias("_id"), words_of(F.col(text)).alias("w")).withColumn("_row", F.monotonically_increasing_id())
    hits = F.filter(F.transform("w", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: h["w"].isin(probes))
    none = F.expr("cast(array() as array<struct<i: int, w: string>>)")
    found = rows.withColumn("hits", F.when(F.exists("w", lambda w: w.isin(probes)), hits).otherwise(none))
    # each place with the words that blocks around it can cover
    cut_out = F.transform("hits", lambda h: F.struct(h["i"].alias("i"), h["w"].alias("w"), F.greatest(F.lit(0), h["i"] - _reach(reach, h["w"]) + 1).alias("first"), F.slice("w", F.greatest(F.lit(0), h["i"] - _reach(reach, h["w"]) + 1) + 1, 2 * _reach(reach, h["w"]) - 1).alias("near")))
    flat = found.select("_row", "_id", F.size("w").alias("n"), F.explode_outer(cut_out).alias("h")).select("_row", "_id", "n", "h.i", "h.first", "h.near", F.col("h.w").alias("w"))
    side = F.broadcast(index) if index.count() <= broadcast_rows else index
    met = flat.join(side, "w", "left").withColumn("i", F.col("i") - F.col("first"))  # places within ``near`` from here on

    start = F.filter(F.transform("at", lambda o: F.col("i") - o), lambda s: (s >= 0) & (F.slice("near", F.greatest(s, F.lit(0)) + 1, F.size("words")) == F.col("words")))
    places = F.when(F.col("phrase"), F.transform(start, lambda s: F.struct(F.col("label").alias("label"), (s + F.col("first")).cast("long").alias("start"))))
    held = lambda s, n: F.size(F.array_intersect(F.slice("near", s + 1, n), F.col("tokens")))
    low = F.greatest(F.lit(0), F.col("i") - F.col("size") + 1)
    hopeful = ~F.col("phrase") & (F.col("n") >= F.col("need")) & (held(low, 2 * F.col("size") - 1) >= F.col("need"))
    counted = F.transform(F.sequence(low, F.col("i")), lambda s: F.struct(F.col("label").alias("label"), (s + F.col("first")).cast("long").alias("start"), held(s, F.col("size")).cast("int").alias("held"), F.size("tokens").cast("int").alias("of")))
    blocks = F.when(hopeful, F.filter(counted, lambda b: b["held"] >= F.col("need")))
    kept = met.select("_row", "_id", "n", places.alias("p"), blocks.alias("b"))
    kept = kept.select("_row", "_id", "n", F.when(F.size("p") > 0, F.col("p")).alias("p"), F.when(F.size("b") > 0, F.col("b")).alias("b"))
    out = kept.groupBy("_row").agg(F.first("_id").alias(id), F.first("n").cast("long").alias("n_words"), F.flatten(F.collect_list("p")).alias("places"), F.array_distinct(F.flatten(F.collect_list("b"))).alias("blocks"))
    return out.drop("_row")


def _reach(reach: dict[str, int], word: Column) -> Column:
    """The size of the longest block around a posted word."""
    sizes = sorted(set(reach.values()))
    return F.coalesce(*(F.when(word.isin([w for w, m in reach.items() if m == size]), F.lit(size)) for size in sizes), F.lit(1)) if sizes else F.lit(1)
