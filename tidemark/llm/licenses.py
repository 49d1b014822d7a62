"""License notices in texts: an exact set-similarity join of text blocks and notice templates, in DataFrame functions only.

A block is BLOCK words, and a block begins every STEP words; a text's last block may be shorter. A template meets a block
if at least `containment` of the template's distinct words are among the block's. As only words of templates can be shared,
blocks are looked at through these words, ordered from the rarest in the whole corpus to the most frequent:

- length: the block needs as many template words as the template must share;
- prefix: of the template's n words, m of which must be shared, one of its n - m + 1 rarest is in the block;
- position: the first shared word at place i of the template and j of the block leaves at most
  1 + min(n - i - 1, size - j - 1) shared words.

What passes is counted in full. A notice of up to STEP + 1 words lies within one block wherever it begins, so longer templates are not accepted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

BLOCK, STEP, CONTAINMENT = 48, 24, 0.9

# Phrases whose places are counted, with their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Words of public license notices, with their labels.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse", "bsd-3"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("dedicated to the public domain under the cc0 1 0 universal dedication", "cc0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
]

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(text: str) -> Column:
    """The words of a text column, A to Z as a to z: runs of ASCII letters and digits and of all that is beyond ASCII."""
    return F.expr(f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}', 0)".replace("\\", "\\\\"))


def _texts(words: Sequence[str]) -> Column:
    return F.array(*(F.lit(x) for x in words)).cast("array<string>")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes that name the row; rows that are equal in doc_id and text have the same ones and the same result."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text", "doc_id").alias("key2"))


def frequencies(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> dict[str, int]:
    """How often each word of the templates stands in all texts; at most so many rows reach the driver."""
    known = sorted({w for text, _ in templates for w in text.split()})
    if not known:
        return {}
    found = _keyed(docs).select(F.explode(F.filter(_words("text"), lambda w: w.isin(known))).alias("word"))
    counts = dict(found.groupBy("word").count().collect())
    return {w: counts.get(w, 0) for w in known}


def ordered(templates: Sequence[tuple[str, str]], counts: dict[str, int], containment: float = CONTAINMENT) -> list[dict]:
    """The templates as sets: their words from the rarest on, how many must be shared, and the prefix one of which must be."""
    out, rank = [], {w: i for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    for text, label in templates:
        if len(text.split()) > STEP + 1:
            raise ValueError(f"a template has at most {STEP + 1} words: {text}")
        words = sorted(set(text.split()), key=rank.get)
        least = max(1, math.ceil(containment * len(words) - 1e-9))
        out.append({"label": label, "words": words, "least": least, "prefix": words[: len(words) - least + 1], "rank": {w: rank[w] for w in words}})
    return out


def _places(words: Column, rare: Column, phrase: list[str], lead: int) -> Column:
    """Where the phrase begins, looked for around its word number lead in rare, the places of words that matter."""
    begins = F.filter(rare, lambda r: (r["word"] == phrase[lead]) & (r["at"] >= lead) & (F.slice(words, F.greatest(r["at"] - lead, F.lit(0)) + 1, len(phrase)) == _texts(phrase)))
    return F.transform(begins, lambda r: r["at"] - lead)


def scanned(docs: DataFrame, sets: list[dict], phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """doc_id, key, key2, n_words, places (of each phrase) and blocks (number and template words, of those with a word of a template's prefix) of each row."""
    # any word of a phrase finds its places; one that begins no other phrase and is seldom is the cheapest
    often = {w: sum(w in x["words"] for x in sets) for text, _ in phrases for w in text.split()}
    leads = [min(range(len(text.split())), key=lambda i: (often[text.split()[i]], -len(text.split()[i]))) for text, _ in phrases]
    leading = {text.split()[k] for (text, _), k in zip(phrases, leads)}
    prefix = sorted({w for x in sets for w in x["prefix"]})
    known = sorted({w for x in sets for w in x["words"]}) or [""]

    def told(words: Column) -> Column:
        marked = F.transform(words, lambda w, i: F.when(w.isin(sorted(leading | set(prefix))), F.struct(w.alias("word"), i.alias("at"))))
        return F.transform(F.array(F.filter(marked, lambda r: r.isNotNull())), lambda rare: parts(words, rare))[0]

    def parts(words: Column, rare: Column) -> Column:
        n = F.size(words)
        hit = F.filter(rare, lambda r: r["word"].isin(prefix or [""]))
        number = F.transform(hit, lambda r: F.floor(r["at"] / STEP).cast("int"))
        # the block before holds the word too; the last block that begins in a text is that which reaches its end first
        last = F.greatest(F.ceil((n - BLOCK) / STEP), F.lit(0)).cast("int")
        per = BLOCK // STEP
        numbers = F.array_distinct(F.flatten(F.transform(number, lambda b: F.filter(F.sequence(b - (per - 1), b), lambda x: (x >= 0) & (x <= last)))))
        blocks = F.transform(numbers, lambda b: F.struct(b.alias("block"), F.array_distinct(F.filter(F.slice(words, b * STEP + 1, BLOCK), lambda w: w.isin(known))).alias("words")))
        places = F.array(*(_places(words, rare, text.split(), k) for (text, _), k in zip(phrases, leads))).cast("array<array<int>>")
        return F.struct(n.cast("long").alias("n_words"), places.alias("places"), blocks.alias("blocks"))

    # each step is bound as the variable of a function, so that it is reckoned once for a row
    row = F.transform(F.array(_words("text")), told)[0]
    return _keyed(docs).select("doc_id", "key", "key2", row.alias("row")).select("doc_id", "key", "key2", "row.*")


def _joined(rows: DataFrame, sets: list[dict]) -> DataFrame:
    """key, key2, block, template, label and share of each block and template that meet."""
    spark = rows.sparkSession
    order = {w: r for x in sets for w, r in x["rank"].items()}
    lists = [(w, i, k, x["label"], x["words"], x["least"]) for i, x in enumerate(sets) for k, w in enumerate(x["prefix"])]
    table = spark.createDataFrame(lists, "token string, template int, place int, label string, words array<string>, least int")
    ranks = F.create_map(*(F.lit(v) for w, i in order.items() for v in (w, i))) if order else F.create_map(F.lit(""), F.lit(0))
    blocks = rows.select("key", "key2", F.explode("blocks").alias("b")).select("key", "key2", "b.block", F.col("b.words").alias("own"))
    blocks = blocks.withColumn("own", F.transform(F.array_sort(F.transform("own", lambda w: F.struct(ranks[w].alias("rank"), w.alias("word")))), lambda x: x["word"]))
    tokens = blocks.select("key", "key2", "block", "own", F.size("own").alias("size"), F.posexplode("own").alias("at", "token"))
    met = tokens.join(F.broadcast(table), "token")  # as many rows as the prefixes of the templates have words
    n = F.size("words")
    met = met.where((F.col("size") >= F.col("least")) & (1 + F.least(n - F.col("place") - 1, F.col("size") - F.col("at") - 1) >= F.col("least")))
    shared = F.array_intersect("words", "own")
    first = F.array_position("own", shared[0]) - 1 == F.col("at")  # a pair that shares several words of the prefix counts once
    met = met.where(first).select("key", "key2", "block", "template", "label", F.size(shared).alias("shared"), n.alias("n"), "least")
    return met.where(F.col("shared") >= F.col("least")).select("key", "key2", "block", "template", "label", (F.col("shared") / F.col("n")).alias("share"))


def _prepared(docs: DataFrame, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], containment: float) -> tuple[DataFrame, list[dict]]:
    sets = ordered(templates, frequencies(docs, templates), containment)
    return written(scanned(docs, sets, phrases), "license-rows"), sets


def license_blocks(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, block (its first word, from 0), template (number in the list), label and share of every block that meets a template."""
    rows, sets = _prepared(docs, templates, [], containment)
    met = _joined(rows, sets).distinct()
    return rows.select("doc_id", "key", "key2").join(met, ["key", "key2"]).select("doc_id", (F.col("block") * STEP).cast("long").alias("block"), "template", "label", "share")


def license_scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of docs.

    n_base counts the places of all phrases, first_word and last_word are the least and largest of them (null if none);
    score is 1 where a phrase stands, else the largest share of a template's words in a block that meets it, or 0. A null
    or empty text has no words, no labels ('') and score 0; repeated rows have a row each; a null doc_id stays; long
    texts are read whole; columns other than doc_id and text are left out; an empty table gives no rows.
    """
    rows, sets = _prepared(docs, templates, phrases, containment)
    found = _joined(rows, sets).groupBy("key", "key2").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    places = F.flatten("places")
    base = F.array(*(F.when(F.size(F.col("places")[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)))
    base = F.array_sort(F.array_distinct(F.filter(base, lambda x: x.isNotNull()))).cast("array<string>")
    plain = rows.select("doc_id", "key", "key2", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), base.alias("base"))
    joined = plain.join(found, ["key", "key2"], "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def oracle_sql(containment: float = CONTAINMENT) -> str:
    """license_scan() over the view documents by comparing every block with every template, for DuckDB; doc_id must be unique."""
    phrases = ", ".join(f"('{x}', '{label}')" for x, label in PHRASES)
    templates = ", ".join(f"({i}, '{x}', '{label}')" for i, (x, label) in enumerate(TEMPLATES))
    return rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    p AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {phrases}) v(p, label)),
    t AS (SELECT i, list_distinct(string_split(t, ' ')) AS t, label FROM (VALUES {templates}) v(i, t, label)),
    pos AS (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM w),
    hit AS (SELECT doc_id, i, label FROM pos JOIN p ON ws[i + 1] = p[1] AND ws[i + 1:i + len(p)] = p),
    base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(label) AS base FROM hit GROUP BY doc_id),
    block AS (SELECT doc_id, list_distinct(ws[b * {STEP} + 1:b * {STEP} + {BLOCK}]) AS b FROM (SELECT doc_id, ws, unnest(range(greatest(ceil((len(ws) - {BLOCK}) / {STEP}), 0)::BIGINT + 1)) AS b FROM w)),
    met AS (SELECT doc_id, label, len(list_intersect(t, b)) / len(t) AS share FROM block JOIN t ON len(list_intersect(t, b)) >= {containment} * len(t) - 1e-9),
    more AS (SELECT doc_id, max(share) AS share, list(label) AS found FROM met GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(base, found))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
    FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
    """
