"""License scans: phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, text_of

RESULT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Smallest share of a template's distinct words that a block must hold.
CONTAINMENT = 0.8

#: Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Openings of public licenses and usual license statements, with their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def tokens_of(text: str) -> list[str]:
    return WORDS.findall(text.translate(LOWER))


def token_counts(texts: DataFrame, tokens: frozenset[str]) -> dict[str, int]:
    """How often each of the templates' words stands in all texts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                got = Counter(tokens_of(text))
                for t in tokens & got.keys():
                    total[t] += got[t]
        yield pd.DataFrame({"token": pd.Series(list(total), dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})

    rows = texts.mapInPandas(counted, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(tokens, 0) | {r["token"]: r["n"] for r in rows}


class Templates:
    """The index of the join: each template's words from the rarest to the most frequent, and their prefixes.

    A block that holds at least `need` of the t words of a template holds one of the template's t - need + 1 rarest
    words, so only these are indexed.
    """

    def __init__(self, templates, counts: dict[str, int], containment: float):
        self.rows: list[tuple[str, list[str], int]] = []
        #: Words of the longest template.
        self.longest = max((len(tokens_of(text)) for _, text in templates), default=0)
        self.index: dict[str, list[tuple[int, int]]] = {}
        for label, text in templates:
            ordered = sorted(set(tokens_of(text)), key=lambda t: (counts.get(t, 0), t))
            need = math.ceil(containment * len(ordered) - 1e-9)
            for at in range(len(ordered) - need + 1):
                self.index.setdefault(ordered[at], []).append((len(self.rows), at))
            self.rows.append((label, ordered, need))

    def matches(self, block: list[str]) -> Iterator[tuple[str, float]]:
        """(label, containment) of every template that the block holds to the threshold."""
        for k, held in self.held(block):
            label, ordered, _ = self.rows[k]
            yield label, held / len(ordered)

    def held(self, block: list[str]) -> Iterator[tuple[int, int]]:
        """(template, number of its distinct words that the block holds), for those that are held to the threshold."""
        words = set(block)
        probed = sorted((self.rows[k], at, k) for w in self.index.keys() & words for k, at in self.index[w])
        done: set[int] = set()
        for (_, ordered, need), at, k in sorted(probed, key=lambda p: (p[2], p[1])):
            # length: the block has enough words; position: the rarer words before this one are missing
            if k in done or len(words) < need or len(ordered) - at < need:
                continue
            done.add(k)
            held = sum(t in words for t in ordered[at:])
            if held >= need:
                yield k, held

    def stretch(self, k: int, block: list[str]) -> int:
        """The most distinct words of template k that any `longest` words in a row hold."""
        mine = set(self.rows[k][1])
        places = [(i, w) for i, w in enumerate(block) if w in mine]
        inside: Counter[str] = Counter()
        most = first = 0
        for i, w in places:
            inside[w] += 1
            while places[first][0] <= i - self.longest:
                gone = places[first][1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                first += 1
            most = max(most, len(inside))
        return most


def scan_licenses(df: DataFrame, text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score to every row.

    Phrases are counted at every place. For labels beyond those of phrases, each line is a block, and so are any
    words in a row, over line ends too, as many as the longest template has: notices are often wrapped. An exact join
    with the templates finds every block that holds at least the given share of a template's distinct words: words
    are ordered by their frequency in all texts, and prefix, length and positional filters leave few pairs to
    verify. score is the largest share found, 1 where a phrase stands, else 0. The templates are a fixed small set
    that goes to every task; no text is shuffled.

    Defined cases: null and empty texts have no words and null first_word and last_word; very long texts are read
    whole; repeated rows get equal results; an empty table gives an empty result. Input columns named like a result
    column are replaced by it.
    """
    vocabulary = frozenset(t for _, text in templates for t in tokens_of(text))
    counts = token_counts(df.select(text_of(text_col).alias("text")), vocabulary)
    known = Templates(templates, counts, containment)

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=RESULT, dtype=object)

    def one(text: str) -> tuple:
        lower = text.translate(LOWER)
        words = WORDS.findall(lower)
        joined = f" {' '.join(words)} "
        starts, base = [], set()
        for phrase, label in phrases:
            at = joined.find(f" {phrase} ")
            while at >= 0:
                starts.append(joined.count(" ", 0, at))
                base.add(label)
                at = joined.find(f" {phrase} ", at + 1)
        labels, score = set(base), 1.0 if base else 0.0
        # a block's words are words of the text, so only templates that the text holds can match in one
        whole = [k for k, _ in known.held(words)]
        if whole:
            for line in lower.split("\n"):
                for label, share in known.matches(WORDS.findall(line)):
                    labels.add(label)
                    score = max(score, share)
        for k in whole:
            label, ordered, need = known.rows[k]
            most = known.stretch(k, words)
            if most >= need:
                labels.add(label)
                score = max(score, most / len(ordered))
        first, last = (min(starts), max(starts)) if starts else (None, None)
        return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score

    carried = Carried(df)
    rows = df.select(*carried.hide(df), scanned(text_of(text_col)).alias("__found"))
    return rows.select(*carried.show(RESULT), *(F.col(f"__found.{c}").alias(c) for c in RESULT))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", *RESULT)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP9_SQL = f"""
WITH phrase(label, ws) AS (VALUES {", ".join(f"('{label}', string_split('{p}', ' '))" for p, label in PHRASES)}),
template(id, label, ws) AS (VALUES {", ".join(f"({i}, '{label}', list_distinct(string_split('{t}', ' ')))" for i, (label, t) in enumerate(TEMPLATES))}),
d AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
w AS (SELECT doc_id, r, t, regexp_extract_all(t, '{_PATTERN}') AS ws FROM d),
p AS (
  SELECT r, label, unnest(list_filter(range(len(w.ws)), lambda i: w.ws[i + 1:i + len(phrase.ws)] = phrase.ws)) AS place FROM w, phrase),
b AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS ls FROM p GROUP BY r),
l AS (SELECT r, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), '{_PATTERN}')) AS ws FROM d),
m AS (
  SELECT r, label, len(list_intersect(l.ws, template.ws))::DOUBLE / len(template.ws) AS share, len(template.ws) AS k,
         len(list_intersect(l.ws, template.ws)) AS held FROM l, template),
x AS (SELECT r, list(DISTINCT label) AS ls, max(share) AS share FROM m WHERE held >= ceil({CONTAINMENT} * k - 1e-9) GROUP BY r)
SELECT doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(x.ls, [])))), ','), '') AS labels,
  CASE WHEN b.r IS NOT NULL THEN 1.0 ELSE coalesce(x.share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN x USING (r)
"""
