"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

Words are runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII.  For a template of g words, a text's blocks are its
words from k * g up to (k + 2) * g for every k, so that any run of g words lies within a block.  A block meets a template of m
distinct words if it holds at least `need` = ceil(threshold * m) of them.  All such blocks are found, by four filters in turn:

- prefix: a template's words are ordered by how often all texts have them, rarest first.  A block that lacks the first
  m - need + 1 of them holds fewer than `need`, so only blocks about places of these words are looked at;
- length: the block must have `need` words;
- position: of the block's words that any template has, in the same order, and of the template's, too few may come after the
  word in question.  (Rows of a block's later words may fail here; that of the first one they share decides);
- the count itself.

A phrase is a template whose every word is needed (threshold 1) and whose words must also stand consecutively; each place of it
holds its rarest word once, so each is found once.  Words are joined where they are read: only places of rare words get past the
broadcast index of the templates' prefixes, and what is shuffled is one small row for each such place and each document.

Null texts count as empty; empty ones have no words and score 0.  Rows equal in id and text get equal results, returned once for
each.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = Fraction(4, 5)
#: What lies between words.  (Splitting by it is much cheaper than extracting words: no match copies the text.)
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases.
PHRASES: tuple[tuple[str, str], ...] = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Sentences of well-known public licenses, as their authors publish them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2-notice", "you may not use this file except in compliance with the License You may obtain a copy of the License at http www apache org licenses LICENSE 2 0"),
    ("bsd-conditions", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc-4-name", "Creative Commons Attribution NonCommercial 4 0 International License"),
    ("gpl-3", "licensed under the GNU General Public License version 3"),
    ("gpl-3-notice", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation either version 3 of the License or at your option any later version"),
    ("isc-notice", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit-notice", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the Software to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the Software"),
    ("mpl-2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License v 2 0 If a copy of the MPL was not distributed with this file You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    threshold: Fraction
    phrase: bool

    @property
    def tokens(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.words))

    @property
    def need(self) -> int:
        return ceil(self.threshold * len(self.tokens))


def templates(phrases: tuple[tuple[str, str], ...] = PHRASES, texts: tuple[tuple[str, str], ...] = TEMPLATES, threshold: Fraction = THRESHOLD) -> list[Template]:
    return [Template(label, tuple(text.lower().split()), Fraction(1), True) for label, text in phrases] + [Template(label, tuple(text.lower().split()), threshold, False) for label, text in texts]


def _words(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, text_hash and words."""
    rows = documents.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # The two characters beyond ASCII whose lower case holds an ASCII letter; only A-Z are to be lowered to ASCII.
    plain = F.replace(F.replace("text", F.lit("\u212a"), F.lit("\ufffd")), F.lit("\u0130"), F.lit("\ufffd"))
    return rows.select("id", F.xxhash64("text").alias("text_hash"), F.array_remove(F.split(F.lower(plain), GAP), "").alias("words"))


def token_order(words: DataFrame, of: list[Template]) -> list[str]:
    """The templates' words, those that all texts have least often first; equal ones in their own order.  As many rows as the templates have
    words come to the driver."""
    vocabulary = sorted({token for t in of for token in t.tokens})
    spark = words.sparkSession
    known = spark.range(1).select(F.explode(F.lit(vocabulary)).alias("word"))
    counts = words.select(F.explode("words").alias("word")).join(F.broadcast(known), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    n = {r.word: r.n for r in counts.collect()}
    return sorted(vocabulary, key=lambda token: (n.get(token, 0), token))


def prefix_index(words: DataFrame, of: list[Template], order: list[str]) -> DataFrame:
    """A row for each word of each template's prefix: its place in the template's order, and what the filters need."""
    place, rows = {token: i for i, token in enumerate(order)}, []
    for t in of:
        tokens = sorted(t.tokens, key=place.__getitem__)
        for i, token in enumerate(tokens[: len(tokens) - t.need + 1]):
            values = {"token": token, "label": t.label, "phrase": t.phrase, "stride": len(t.words), "need": t.need, "place": i, "tokens": tokens, "text": list(t.words), "offset": t.words.index(token)}
            rows.append(F.struct(*(F.lit(v).alias(k) for k, v in values.items())))
    return words.sparkSession.range(1).select(F.inline(F.array(*rows)))


def blocks(words: DataFrame, of: list[Template]) -> DataFrame:
    """All blocks that meet a template, a row for each prefix word they hold: id, text_hash, label, phrase, first (the block's first word), pos,
    likeness (share of the template's words), start (where the phrase stands at this word, else null)."""
    order = token_order(words, of)
    hits = words.select("id", "text_hash", "words", F.posexplode("words").alias("pos", "word")).join(F.broadcast(prefix_index(words, of, order)), F.col("word") == F.col("token"))
    k = F.floor(F.col("pos") / F.col("stride")).cast("int")
    near = hits.withColumn("k", F.explode(F.array(k - 1, k))).where("k >= 0")
    near = near.withColumn("block", F.expr("slice(words, k * stride + 1, 2 * stride)")).where(F.size("block") >= F.col("need"))
    near = near.withColumn("shared", F.array_intersect(F.lit(order), "block"))
    after = F.least(F.size("tokens") - F.col("place"), F.size("shared") - F.array_position("shared", F.col("token")) + 1)
    near = near.where(after >= F.col("need")).withColumn("overlap", F.size(F.array_intersect("tokens", "shared"))).where("overlap >= need")
    begin = F.col("pos") - F.col("offset")
    stands = F.col("phrase") & (begin >= 0) & (F.floor(begin / F.col("stride")) == F.col("k")) & (F.expr("slice(words, greatest(pos - offset, 0) + 1, stride)") == F.col("text"))
    return near.select("id", "text_hash", "label", "phrase", F.expr("k * stride").alias("first"), "pos", (F.col("overlap") / F.size("tokens")).alias("likeness"), F.when(stands, begin).alias("start"))


def scan(documents: DataFrame, of: list[Template] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: its words, the places of the phrases, the labels of both kinds, and the best likeness."""
    words = _words(documents, id_column, text_column)
    found = blocks(words, of or templates()).where("not phrase or start is not null")
    none = {c: F.lit(None).cast(kind).alias(c) for c, kind in (("label", "string"), ("likeness", "double"), ("start", "int"))}
    every = words.select("id", "text_hash", F.lit(1).alias("copies"), F.size("words").alias("n_words"), *none.values())
    rows = every.unionByName(found.select("id", "text_hash", F.lit(0).alias("copies"), F.lit(0).alias("n_words"), "label", "likeness", "start"))
    own = F.when(F.col("start").isNotNull(), F.col("label"))
    said = lambda labels: F.array_join(F.array_sort(F.collect_set(labels)), ",")
    out = rows.groupBy("id", "text_hash").agg(
        F.sum("copies").alias("copies"),
        F.max("n_words").cast("bigint").alias("n_words"),
        F.count("start").alias("places"),
        F.min("start").cast("bigint").alias("first_word"),
        F.max("start").cast("bigint").alias("last_word"),
        said(own).alias("base_labels"),
        said(F.col("label")).alias("labels"),
        F.coalesce(F.max("likeness"), F.lit(0.0)).alias("score"),
    )
    # Equal rows found the same places each.
    out = out.withColumn("n_base", (F.col("places") / F.col("copies")).cast("bigint")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _oracle() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    known = ", ".join(f"('{t.label}', {t.phrase}, {quoted(t.words)}, {quoted(t.tokens)}, {t.need})" for t in templates())
    return f"""
WITH t(label, phrase, words, tokens, need) AS (VALUES {known}),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{GAP[1:]}') AS w
  FROM documents
), spots AS (SELECT r, w, unnest(range(len(w))) AS p FROM d),
places AS (SELECT r, label, p FROM spots JOIN t ON t.phrase AND w[p + 1] = t.words[1] AND w[p + 1:p + len(t.words)] = t.words),
met AS (
  SELECT r, label, len(list_intersect(tokens, w[p + 1:p + 2 * len(t.words)])) / len(tokens) AS likeness
  FROM spots JOIN t ON NOT t.phrase AND p % len(t.words) = 0 WHERE len(list_intersect(tokens, w[p + 1:p + 2 * len(t.words)])) >= need
), found AS (SELECT r, label, p, 1.0 AS likeness FROM places UNION ALL SELECT r, label, NULL, likeness FROM met),
summed AS (
  SELECT r, count(p) AS n_base, min(p) AS first_word, max(p) AS last_word, max(likeness) AS score, list_sort(list(DISTINCT label)) AS labels,
    list_sort(list(DISTINCT label) FILTER (p IS NOT NULL)) AS base_labels
  FROM found GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN summed USING (r)
"""


ORACLE_SQL = _oracle()
