"""Licence scan by a positional rare-token index, in DataFrame functions only.

One pass counts in how many documents each key word of a template occurs. The two
rarest words of a template's key phrase become its postings (template, offset). A
second pass looks up the words of each text that have postings, turns every hit into
a (template, start) pair, keeps the pairs on which both rare words agree by relative
position, and verifies the whole key phrase there. As a key phrase must be present
in full, no placement is missed whatever the frequencies are; they only decide how
few candidates are verified. Nothing but word counts is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Least part of a template's words that must stand in place around a verified key phrase.
MIN_FRACTION = 0.5


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        words, key = self.words, self.key_words
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


BASE = [
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
]
#: Short passages by which public licences are known, and the phrase that must be there.
TEMPLATES = [
    *BASE,
    Template("mit", "released under the mit license", "the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    Template("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    Template("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd", "cc by nd"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("cc0", "creative commons cc0 1 0 universal", "cc0 1 0 universal"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def key_word_idf(docs: DataFrame, text_col: str, templates: list[Template]) -> dict[str, float]:
    """ln((1 + documents) / (1 + documents with the word)) for each key word of the templates."""
    vocabulary = sorted({w for t in templates for w in t.key_words})
    counted = docs.select(F.explode(F.array_distinct(F.filter(words_of(F.col(text_col)), lambda w: w.isin(vocabulary)))).alias("word")).groupBy("word").count()
    have = {r["word"]: r["count"] for r in counted.collect()}  # as many rows as there are key words
    n = docs.count()
    return {w: math.log((1 + n) / (1 + have.get(w, 0))) for w in vocabulary}


def _postings(templates: list[Template], idf: dict[str, float], rank: int) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {}
    for number, t in enumerate(templates):
        by_idf = sorted(range(len(t.key_words)), key=lambda i: (-idf[t.key_words[i]], i))
        at = by_idf[min(rank, len(by_idf) - 1)]
        out.setdefault(t.key_words[at], []).append((number, t.key_at + at))
    return out


def _looked_up(words: Column, hits: Column, postings: dict[str, list[tuple[int, int]]]) -> Column:
    """All (template, start) pairs that the hit words have in the postings."""
    literal = F.create_map(*[x for word, places in sorted(postings.items()) for x in (F.lit(word), F.array(*[F.struct(F.lit(n).alias("template"), F.lit(at).alias("at")) for n, at in places]))])
    return F.flatten(F.transform(hits, lambda i: F.transform(F.coalesce(F.try_element_at(literal, F.get(words, i)), F.array().cast("array<struct<template:int,at:int>>")), lambda p: F.struct(p["template"].alias("template"), (i - p["at"]).alias("start")))))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] | None = None, min_fraction: float = MIN_FRACTION) -> DataFrame:
    """One row for each input row: doc_id, n_words and matches, an array of structs
    (label, base, word_at, fraction): the word at which the key phrase starts, and the
    part of the template's words in place there.

    Null texts count as empty; texts without words have no matches. Repeated rows are
    scanned apart. Other columns are not looked at; no rows give no rows.
    """
    templates = TEMPLATES if templates is None else templates
    idf = key_word_idf(docs, text_col, templates)
    first, second = _postings(templates, idf, 0), _postings(templates, idf, 1)
    rare = sorted({*first, *second})
    info = F.array(*[F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.array(*map(F.lit, t.words)).alias("words"), F.array(*map(F.lit, t.key_words)).alias("key"), F.lit(t.key_at).alias("key_at")) for t in templates])
    w, n = F.col("words"), F.size("words")
    return (
        docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
        .select("doc_id", "words", F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, i).isin(rare))).otherwise(F.array().cast("array<int>")).alias("hits"))
        .select("doc_id", "words", F.array_intersect(_looked_up(w, F.col("hits"), first), _looked_up(w, F.col("hits"), second)).alias("placed"))
        .select("doc_id", "words", F.transform("placed", lambda c: F.struct(F.get(info, c["template"]).alias("t"), c["start"].alias("start"))).alias("placed"))
        .select("doc_id", "words", F.filter("placed", lambda c: (c["start"] + c["t"]["key_at"] >= 0) & (F.slice(w, F.greatest(c["start"] + c["t"]["key_at"], F.lit(0)) + 1, F.size(c["t"]["key"])) == c["t"]["key"])).alias("placed"))
        .select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.filter(
                F.transform(
                    "placed",
                    lambda c: F.struct(
                        c["t"]["label"].alias("label"),
                        c["t"]["base"].alias("base"),
                        (c["start"] + c["t"]["key_at"]).cast("long").alias("word_at"),
                        (F.size(F.filter(c["t"]["words"], lambda x, j: (c["start"] + j >= 0) & (F.get(w, c["start"] + j) == x))) / F.size(c["t"]["words"])).alias("fraction"),
                    ),
                ),
                lambda m: m["fraction"] >= min_fraction,
            ).alias("matches"),
        )
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["word_at"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["word_at"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["fraction"])), F.lit(0.0)).alias("score"),
    )


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


ORACLE_SQL = rf"""
WITH t(label, base, words, key, key_at) AS (VALUES
{",\n".join(f"  ('{t.label}', {str(t.base).lower()}, {_sql_list(t.words)}, {_sql_list(t.key_words)}, {t.key_at})" for t in TEMPLATES)}
), w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM w
), m AS (
  SELECT p.doc_id, t.label, t.base, p.i AS word_at,
         len(list_filter(range(len(t.words)), lambda j: p.i - t.key_at + j >= 0 AND p.ws[p.i - t.key_at + j + 1] = t.words[j + 1]))::DOUBLE / len(t.words) AS fraction
  FROM p JOIN t ON p.ws[p.i + 1] = t.key[1] AND p.ws[p.i + 1 : p.i + len(t.key)] = t.key
), g AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(word_at) FILTER (WHERE base) AS first_word, max(word_at) FILTER (WHERE base) AS last_word,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(fraction) AS score
  FROM m WHERE fraction >= {MIN_FRACTION} GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""
