"""Licence scan by a positional index of rare words, in DataFrame functions only.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z became a-z. Texts are read once: of each document the words that
stand in some template are kept with their places, and written. From them the document frequency of every such word is
counted, and postings are made: the word of highest IDF in each template's mandatory key phrase, and the next one, with
template and offset. A document looks its words up in both postings; starts on which the two agree by relative position
are verified on the whole key phrase, and scored by the share of the template's words that stand in their places.

Null texts count as empty: no words, no places, null first_word and last_word, empty labels, score 0. Every row gives
one row, also repeated ones; columns besides doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: tuple[int, int]  # the mandatory key phrase: first word and number of words
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


def whole(label: str, text: str, base: bool = False) -> Template:
    """A template that is mandatory from end to end."""
    return Template(label, text, (0, len(text.split())), base)


#: Labels and the phrases that licences are known by.
TEMPLATES = (
    whole("cc-by", "cc by", True),
    whole("gpl", "general public license", True),
    whole("reserved", "all rights reserved", True),
    whole("agpl", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", (3, 5)),
    whole("artistic", "artistic license"),
    whole("boost", "boost software license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", (0, 8)),
    whole("cc-by-nc", "cc by nc"),
    whole("cc-by-nd", "cc by nd"),
    whole("cc-by-sa", "cc by sa"),
    whole("cc0", "cc0 1 0"),
    whole("creative-commons", "creative commons attribution"),
    whole("eclipse", "eclipse public license"),
    whole("gpl-2.0", "gnu general public license version 2"),
    whole("gpl-3.0", "gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", (0, 8)),
    whole("lgpl", "lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", (0, 7)),
    whole("mit", "mit license"),
    whole("mpl", "mozilla public license"),
    whole("spdx", "spdx license identifier"),
    whole("unlicense", "free and unencumbered software released into the public domain"),
)
#: Words of a template besides the key phrase may differ in so many of all at most.
COVERAGE = 0.8


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


#: A start's code: the template, the place of the key phrase's first word, and its number among the words kept.
PLACE_BITS = 28


def literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def kept_words(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, at): the words of templates in a document with their places, in their order."""
    vocabulary = sorted({w for t in templates for w in t.words})
    worded = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    at = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("word"), i.alias("place")))))
    return worded.select("doc_id", F.size("words").cast("long").alias("n_words"), at.alias("at"))


def idf(kept: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """IDF over all documents of the templates' words: one row for each of them at most, whatever the table."""
    words = F.array_distinct(F.transform("at", lambda x: x["word"]))
    counted = {r[0]: r[1] for r in kept.select(F.explode(F.concat(words, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()}
    total = counted.pop("", 0)
    return {w: math.log((1 + total) / (1 + counted.get(w, 0))) for w in sorted({w for t in templates for w in t.words})}


def anchors(template: Template, weight: dict[str, float]) -> list[tuple[str, int]]:
    """The two rarest words of the key phrase with their offsets in it, the rarest first; twice the same for a phrase of one word."""
    first, n = template.key
    ranked = sorted(range(n), key=lambda i: (-weight[template.words[first + i]], i))
    return [(template.words[first + i], i) for i in (ranked * 2)[:2]]


def postings(templates: tuple[Template, ...], weight: dict[str, float], which: int) -> Column:
    """A map from the first or second anchor words to their (template, offset)."""
    entries: dict[str, list[Column]] = {}
    for k, t in enumerate(templates):
        word, offset = anchors(t, weight)[which]
        entries.setdefault(word, []).append(F.struct(F.lit(k).cast("long").alias("template"), F.lit(offset).alias("offset")))
    return F.create_map(*[x for word, own in entries.items() for x in (F.lit(word), F.array(*own))])


def matched(kept: DataFrame, templates: tuple[Template, ...], weight: dict[str, float]) -> DataFrame:
    """(doc_id, n_words, found): array<struct<template, place, share>> of all verified starts."""
    code = lambda template, place, number: F.shiftleft(template, 2 * PLACE_BITS) + F.shiftleft(place.cast("long"), PLACE_BITS) + number

    def starts(which: int) -> Column:
        index = postings(templates, weight, which)
        own = lambda x, number: F.transform(F.coalesce(F.try_element_at(index, x["word"]), F.array().cast("array<struct<template:bigint,offset:int>>")), lambda p: F.when((x["place"] >= p["offset"]) & (number >= p["offset"]), code(p["template"], x["place"] - p["offset"], number - p["offset"])))
        return F.array_compact(F.flatten(F.transform("at", own)))

    keys, firsts = F.array(*[literal(t.words[t.key[0] : sum(t.key)]) for t in templates]), F.array(*[F.lit(t.key[0]) for t in templates])
    tokens = F.array(*[literal([f"{i}:{w}" for i, w in enumerate(t.words)]) for t in templates])
    low = (1 << PLACE_BITS) - 1
    agreed = F.transform(F.array_intersect(starts(0), starts(1)), lambda c: F.struct(F.shiftright(c, 2 * PLACE_BITS).cast("int").alias("template"), F.shiftright(c, PLACE_BITS).bitwiseAND(low).cast("int").alias("place"), c.bitwiseAND(low).cast("int").alias("number")))

    def whole(s: Column) -> Column:
        """The key phrase stands there word by word, without a word between."""
        key = F.get(keys, s["template"])
        here = F.slice("at", s["number"] + 1, F.size(key))
        return (F.transform(here, lambda x: x["word"]) == key) & (F.get(here, F.size(key) - 1)["place"] - s["place"] == F.size(key) - 1)

    def share(s: Column) -> Column:
        token, first = F.get(tokens, s["template"]), F.get(firsts, s["template"])
        begin = F.greatest(F.lit(0), s["number"] - first)
        here = F.slice("at", begin + 1, F.size(token) + first)
        return F.size(F.array_intersect(F.transform(here, lambda x: F.concat((x["place"] - s["place"] + first).cast("string"), F.lit(":"), x["word"])), token)) / F.size(token)

    found = F.transform(F.filter("agreed", whole), lambda s: F.struct(s["template"].alias("template"), s["place"].alias("place"), share(s).alias("share")))
    return kept.select("doc_id", "n_words", "at", agreed.alias("agreed")).select("doc_id", "n_words", found.alias("found"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, weight: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score); weight: IDF, counted over docs if not given."""
    kept = saved(kept_words(docs, templates))
    found = matched(kept, templates, idf(kept, templates) if weight is None else weight)
    is_base, label = F.array(*[F.lit(t.base) for t in templates]), literal([t.label for t in templates])
    base_at = F.transform(F.filter("found", lambda x: F.get(is_base, x["template"])), lambda x: x)
    places = F.transform(base_at, lambda x: x["place"].cast("long"))
    joined = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda x: F.get(label, x["template"])))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base_at).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        joined(base_at).alias("base_labels"), joined(F.filter("found", lambda x: x["share"] >= COVERAGE)).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).cast("double").alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
