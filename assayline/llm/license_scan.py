"""License scans by diagonal voting.

Every rolling word k-gram of every text is joined with the k-grams of the templates; hits vote for the offset (text
position less template position) that they agree on, neighbouring offsets merge, and a merged span counts once it covers
enough of the template's k-grams in a stretch of about the template's length. Fixed phrases give base labels beside it.

A null or empty text has no words, no places and no labels (empty strings) and scores 0. Rows are told apart by doc_id and
text (its md5 digest): different texts that share a doc_id earn their labels apart, a null doc_id is an id like any other,
and rows that repeat both have equal results. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, raw_texts, text_slices
from .kernels import Words

#: Phrase and label, fixed by the contract.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label and opening words of well-known licences and notices.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"),
)

SEPARATOR = np.ones(256, bool)
SEPARATOR[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = False
SEPARATOR[128:] = False


@dataclass(frozen=True)
class ScanParameters:
    k: int = 3
    #: Offsets that differ by at most this much are one span (words put in or left out).
    slack: int = 2
    #: Share of a template's k-grams that a span must cover.
    cover: float = 0.75
    #: Score of a text with a fixed phrase and no verified span.
    base_score: float = 0.5


def _words(texts: list[bytes]) -> Words:
    return Words(texts, SEPARATOR, lower=True)


def template_grams(spark: SparkSession, p: ScanParameters, templates: tuple = TEMPLATES) -> DataFrame:
    """(hash, template, label, position, grams): a fixed small table, a few hundred rows."""
    w = _words([t.encode() for _, t in templates])
    at, h = w.grams(p.k)
    size = np.bincount(w.doc[at], minlength=len(templates))
    rows = [(int(x), int(w.doc[i]), templates[w.doc[i]][0], int(i - w.first[w.doc[i]]), int(size[w.doc[i]])) for i, x in zip(at, h.view(np.int64), strict=True)]
    return spark.createDataFrame(rows, "h long, template int, label string, tpos int, grams int")


def keyed(docs: DataFrame) -> DataFrame:
    """The id, the text, and the digest that tells texts of one id apart."""
    return only(docs).withColumn("digest", F.md5(F.col("text").cast("binary")))


def base(docs: DataFrame) -> DataFrame:
    """Words and fixed phrases of each text."""
    phrases = [(_words([a.encode()]).hashes, b) for a, b in PHRASES]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            w, n = _words(raw_texts(b.column("text"))), b.num_rows
            total, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: list[set[str]] = [set() for _ in range(n)]
            for hashes, label in phrases:
                m = len(w.hashes) - len(hashes) + 1
                if m <= 0:
                    continue
                ok = w.doc[:m] == w.doc[len(hashes) - 1 :]
                for k, x in enumerate(hashes):
                    ok &= w.hashes[k : k + m] == x
                at = np.flatnonzero(ok)
                own, place = w.doc[at], at - w.first[w.doc[at]]
                total += np.bincount(own, minlength=n)
                np.minimum.at(first, own, place)
                np.maximum.at(last, own, place)
                for i in np.unique(own):
                    labels[i].add(label)
            none = total == 0
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "digest": b.column("digest"), "n_words": pa.array(w.counts().astype(np.int64)), "n_base": pa.array(total), "first_word": pa.array(first, mask=none), "last_word": pa.array(last, mask=none), "base_list": pa.array([sorted(x) for x in labels], pa.list_(pa.string()))})

    return keyed(docs).mapInArrow(find, "doc_id long, digest string, n_words long, n_base long, first_word long, last_word long, base_list array<string>")


def spans(docs: DataFrame, p: ScanParameters = ScanParameters(), templates: tuple = TEMPLATES) -> DataFrame:
    """(doc_id, digest, template, label, first_word, last_word, cover) of each verified span."""
    row = ("doc_id", "digest")

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            w = _words(raw_texts(b.column("text")))
            at, h = w.grams(p.k)
            cut = np.searchsorted(w.doc[at], np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.ListArray.from_arrays(pa.array(cut), pa.array(h.view(np.int64)))], ["doc_id", "digest", "grams"])

    rolled = keyed(docs).where("text IS NOT NULL").mapInArrow(roll, "doc_id long, digest string, grams array<long>")
    grams = rolled.select(*row, F.posexplode("grams").alias("pos", "h"))
    hits = grams.join(F.broadcast(template_grams(docs.sparkSession, p, templates)), "h")
    votes = hits.groupBy(*row, "template", "label", "grams", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("covered"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    by = Window.partitionBy(*row, "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > p.slack, F.lit(True))
    merged = votes.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(by)).groupBy(*row, "template", "label", "grams", "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n"), F.min("lo").alias("first_word"), (F.max("hi") + p.k - 1).alias("last_word"))
    cover = F.col("n") / F.col("grams")
    room = F.col("last_word") - F.col("first_word") + 1 <= 1.5 * (F.col("grams") + p.k - 1) + p.slack
    return merged.where((cover >= p.cover) & room).select(*row, "template", "label", "first_word", "last_word", cover.alias("cover"))


def scan(docs: DataFrame, p: ScanParameters = ScanParameters(), templates: tuple = TEMPLATES) -> DataFrame:
    """One row per document, for the query."""
    found = spans(docs, p, templates).groupBy("doc_id", "digest").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    out = base(docs).alias("b").join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("b.digest").eqNullSafe(F.col("f.digest")), "left").select("b.*", "more", "cover")
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    none = F.array().cast("array<string>")
    score = F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.col("n_base") > 0, p.base_score).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", text(F.col("base_list")).alias("base_labels"), text(F.concat("base_list", F.coalesce("more", none))).alias("labels"), score.alias("score"))
