"""License scans by an exact set-similarity join, in DataFrame functions only.

Text blocks are windows of words over the whole text, across line breaks: for a template of n words, windows of one
and a half times n, so placed that any passage of n words lies whole in one. Blocks and templates are compared as
sets, without the commonest words. A template matches a block that has at least THRESHOLD of its words, each of the
phrases that name the license and its version, word beside word, and none of the words that name a sister license.
Only words that some template has can count, so a text is cut down to these and their places at once, and a text
without a word that begins a template's naming phrase is out.

Words are ordered by their frequency over the corpus, rarest first. A block and a template that reach the overlap o
share a word among the first |template| - o + 1 of the template and the first |block| - o + 1 of the block (prefix);
a block of fewer than o such words is out (length); and the places of the shared word bound the overlap that is
still possible (position). What is left is verified by the size of the intersection.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import Stage, keyed

#: Phrases of the base scan and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Words that do not count.
COMMON = "a an and any are as at be by for if in is it of on or that the this to was with you your".split()
#: GNU licenses as (label, full name, short name, number in words, number in identifiers).
GNU = [
    ("gpl-2", "gnu general public license", "gpl", "2", "2 0"),
    ("gpl-3", "gnu general public license", "gpl", "3", "3 0"),
    ("lgpl-2-1", "gnu lesser general public license", "lgpl", "2 1", "2 1"),
    ("lgpl-3", "gnu lesser general public license", "lgpl", "3", "3 0"),
    ("agpl-3", "gnu affero general public license", "agpl", "3", "3 0"),
]
#: Names that stand behind "SPDX-License-Identifier", and their labels.
IDENTIFIERS = {
    "mit": "mit", "apache 2 0": "apache-2", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "mpl 2 0": "mpl-2", "epl 1 0": "epl-1",
    "epl 2 0": "epl-2", "isc": "isc", "unlicense": "unlicense", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc",
}
#: Templates as (label, phrases that must stand in a block, split by commas, words that must not, text).
OTHER = [
    ("mit", "mit license", "", "released under the mit license"),
    ("mit", "mit license", "", "licensed under the mit license"),
    (
        "mit", "hereby granted free, without restriction", "",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    (
        "mit", "hereby granted free", "",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ),
    ("apache-2", "apache license version 2", "", "licensed under the apache license version 2 0"),
    ("apache-2", "apache license 2", "", "licensed under the apache license 2 0"),
    ("apache-2", "apache 2 0 license", "", "licensed under the apache 2 0 license"),
    (
        "apache-2", "apache license version 2", "",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at",
    ),
    ("cc-by-nc", "cc by nc", "sa nd", "licensed under cc by nc 4 0"),
    (
        "cc-by-nc", "creative commons attribution noncommercial", "sharealike noderivatives",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ),
    ("cc-by-sa", "cc by sa", "", "licensed under cc by sa 4 0"),
    (
        "cc-by-sa", "creative commons attribution sharealike", "",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    ),
    ("cc-by", "creative commons attribution 4", "", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "creative commons attribution 3", "", "this work is licensed under a creative commons attribution 3 0 unported license"),
    (
        "bsd", "redistribution, source, binary forms", "",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    ("mpl-2", "mozilla public license version 2", "", "licensed under the mozilla public license version 2 0"),
    (
        "mpl-2", "mozilla public license v 2", "",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
        "you can obtain one at",
    ),
    ("epl-1", "eclipse public license v1", "", "made available under the terms of the eclipse public license v1 0"),
    ("epl-1", "eclipse public license version 1", "", "licensed under the eclipse public license version 1 0"),
    ("epl-2", "eclipse public license 2", "", "made available under the terms of the eclipse public license 2 0"),
    ("epl-2", "eclipse public license v2", "", "made available under the terms of the eclipse public license v2 0"),
    ("epl-2", "eclipse public license version 2", "", "licensed under the eclipse public license version 2 0"),
    (
        "isc", "permission, fee, purpose", "",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "unlicense", "unencumbered software", "",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software",
    ),
]


def _templates() -> list[tuple[str, str, str, str]]:
    """All templates: the ones above, those of GNU licenses (statements, notices, short names) and those of identifiers."""
    out = list(OTHER)
    terms = "this program is free software you can redistribute it and or modify it under the terms of the"
    for label, name, short, number, identifier in GNU:
        full, brief, tight = f"{name} version {number}", f"{short} version {number}", f"{short} v{number}"
        published = "as published by the free software foundation"
        out += [
            (label, full, "", f"licensed under the {full}"),
            (label, full, "", f"licensed under the terms of the {full}"),
            (label, full, "", f"{terms} {full} {published}"),
            (label, f"{name}, either version {number}", "", f"{terms} {name} {published} either version {number} of the license or at your option any later version"),
            (label, brief, "", f"licensed under the {brief}"),
            (label, tight, "", f"licensed under the {tight}"),
            (label, tight.replace(" ", "", 1), "", f"licensed under the {tight.replace(' ', '', 1)}"),
            (label, f"identifier {short} {identifier}", "", f"spdx license identifier {short} {identifier}"),
        ]
    return out + [(label, f"identifier {name}", "", f"spdx license identifier {name}") for name, label in IDENTIFIERS.items()]


TEMPLATES = _templates()
THRESHOLD = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Template(NamedTuple):
    number: int
    label: str
    words: list[str]
    overlap: int
    naming: list[str]
    others: list[str]
    width: int
    step: int


def template_sets() -> list[Template]:
    """Templates as distinct words and least overlap, with the width of their blocks and the step between these."""
    out = []
    for i, (label, naming, others, text) in enumerate(TEMPLATES):
        n, words = len(text.split()), [w for w in dict.fromkeys(text.split()) if w not in COMMON]
        width = math.ceil(1.5 * n)
        out.append(Template(i, label, words, math.ceil(THRESHOLD * len(words) - 1e-9), naming.split(", "), others.split(), width, width - n))
    return out


def _base(words: str) -> dict:
    """Columns of the base scan; ``words`` is a column of the words joined, and enclosed, by single spaces."""
    w = F.col(words)
    have = F.greatest(*[F.instr(w, f" {p} ") for p in PHRASES]) > 0
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    count = sum((F.regexp_count(w, F.lit(f" {p}(?= )")) for p in PHRASES), F.lit(0)).cast("long")
    first = F.least(*[F.when(F.instr(w, f" {p} ") > 0, spaces(F.substring(w, F.lit(1), F.instr(w, f" {p} ") - 1))) for p in PHRASES])
    back = F.reverse(w)
    tail = lambda p: F.instr(back, f" {p} "[::-1])  # noqa: E731  place from the end
    last = F.greatest(*[F.when(tail(p) > 0, spaces(F.substring(w, F.lit(1), F.length(w) - tail(p) + 1 - len(p) - 2))) for p in PHRASES])
    none = F.array().cast("array<string>")
    labels = F.concat(*[F.when(F.instr(w, f" {p} ") > 0, F.array(F.lit(x))).otherwise(none) for p, x in PHRASES.items()])
    return {"n_base": F.when(have, count).otherwise(F.lit(0).cast("long")), "first_word": F.when(have, first).cast("long"), "last_word": F.when(have, last).cast("long"), "base": F.when(have, labels).otherwise(none)}


def _strings(words: list[str]):
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def license_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, row, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null counts as empty: no words, no places, empty labels, score 0. The score is 1 where a phrase stands, else the
    greatest share of a template's words in a block that matches it, else 0. Texts of any length count whole; ties
    between templates give all their labels. Repeated rows get equal values; an empty table gives an empty result;
    columns other than the two named are not read.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "license")
    sets = template_sets()
    vocabulary = sorted({w for t in sets for w in [*t.words, *t.others, *" ".join(t.naming).split()]})
    least, widest = min(t.overlap for t in sets), max(t.width for t in sets)
    # A match has its template's naming phrases, so a text without any first word of one has none.
    named = F.arrays_overlap("words", _strings(sorted({t.naming[0].split()[0] for t in sets})))
    source = keyed(docs, F.col(doc_id).cast("long").alias("doc_id"), F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER).alias("t"))
    flat = source.select("doc_id", "row", F.concat(F.lit(" "), F.trim(F.regexp_replace("t", SEPARATORS, " ")), F.lit(" ")).alias("w"))
    n_words = F.when(F.length("w") <= 2, F.lit(0)).otherwise(F.length("w") - F.length(F.replace("w", F.lit(" "), F.lit(""))) - 1)
    hits = F.filter(F.transform("words", lambda x, i: F.struct(i.alias("p"), x.alias("w"))), lambda h: h["w"].isin(vocabulary))
    none = F.array().cast("array<struct<p: int, w: string>>")
    split = flat.select("doc_id", "row", "w", F.split(F.trim("w"), " ").alias("words"))
    scanned = stage.table(split.select("doc_id", "row", n_words.cast("long").alias("n_words"), *[c.alias(n) for n, c in _base("w").items()], F.when(named, hits).otherwise(none).alias("hits")), "scanned")

    texts = scanned.where(F.size("hits") >= least).select("row", "hits")
    often = {r.w: r.n for r in texts.select(F.explode("hits.w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a word of the templates
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for t in sets:
        words = sorted(t.words, key=rank.get)
        index += [(w, t.label, words, t.overlap, t.naming, t.others, t.width, t.step, j) for j, w in enumerate(words[: len(words) - t.overlap + 1])]
    prefixes = sorted({r[0] for r in index})
    index = spark.createDataFrame(index, "word string, label string, words array<string>, o int, naming array<string>, others array<string>, width int, step int, j int")

    # Each prefix word with the hits around it, as many as the widest block has words on either side.
    at = F.filter(F.sequence(F.lit(1), F.size("hits")), lambda i: F.element_at("hits", i)["w"].isin(prefixes))
    around = F.transform(at, lambda i: F.struct(F.element_at("hits", i).alias("hit"), F.slice("hits", F.greatest(i - widest, F.lit(1)), F.lit(2 * widest + 1)).alias("near")))
    anchors = texts.select("row", F.explode(around).alias("a")).select("row", F.col("a.hit.p").alias("p"), F.col("a.hit.w").alias("word"), F.col("a.near").alias("near"))
    placed = anchors.join(F.broadcast(index), "word")  # a row a prefix word of a template
    first = F.greatest(F.lit(0), F.ceil((F.col("p") - F.col("width") + 1) / F.col("step")).cast("int"))
    placed = placed.withColumn("from", F.explode(F.transform(F.sequence(first, F.floor(F.col("p") / F.col("step")).cast("int")), lambda k: k * F.col("step"))))
    inside = F.filter("near", lambda h: (h["p"] >= F.col("from")) & (h["p"] < F.col("from") + F.col("width")))
    placed = placed.withColumn("inside", inside)
    blocks = placed.withColumn("b", F.array_intersect(_strings(order), F.transform("inside", lambda h: h["w"]))).withColumn("i", F.array_position("b", F.col("word")).cast("int") - 1)
    left = F.least(F.size("b") - F.col("i"), F.size("words") - F.col("j"))
    candidates = blocks.where((F.size("b") >= F.col("o")) & (F.col("i") <= F.size("b") - F.col("o")) & (left >= F.col("o") - F.least("i", "j")))
    # The block's hits as a text in which a bar stands where they are not neighbours: no phrase goes over a bar.
    spelled = F.expr("concat(' ', array_join(transform(inside, (h, k) -> IF(k > 0 AND inside[k - 1].p = h.p - 1, h.w, concat('| ', h.w))), ' '), ' ')")
    shared = candidates.withColumn("shared", F.size(F.array_intersect("b", "words"))).where("shared >= o and not arrays_overlap(others, b)")
    verified = shared.withColumn("spelled", spelled).where("forall(naming, x -> contains(spelled, concat(' ', x, ' ')))")
    found = verified.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.col("shared") / F.size("words")).alias("share"))
    joined = scanned.drop("hits").join(found, "row", "left")
    return joined.select(
        "doc_id", "row", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", F.array_sort("base")).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", F.coalesce("found", _strings([]))))).alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")


def _sql() -> str:
    """Brute force: every block with every template, every word with every phrase."""
    words = lambda w: f"string_split('{' '.join(w)}', ' ')" if w else "CAST([] AS VARCHAR[])"
    lists = ", ".join(f"('{x}', {words(p.split())})" for p, x in PHRASES.items())
    templates = ", ".join(f"('{t.label}', {words(t.words)}, {t.overlap}, {t.naming}, {words(t.others)}, {t.width}, {t.step})" for t in template_sets())
    has = lambda x: f"len(list_filter(naming, lambda n: NOT contains(' ' || array_to_string({x}, ' ') || ' ', ' ' || n || ' '))) = 0"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT doc_id, r, t, list_filter(regexp_split_to_array(t, '{SEPARATORS}'), lambda x: x <> '') AS w FROM d),
p(label, words) AS (VALUES {lists}), m(label, words, o, naming, others, width, step) AS (VALUES {templates}),
places AS (SELECT r, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + len(words)] = words)) AS pos FROM w, p WHERE contains(t, words[1])),
base AS (SELECT r, count(*) AS n, min(pos) AS a, max(pos) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r),
blocks AS (SELECT r, label, words, o, naming, others, unnest(list_transform(range(0, len(w), step), lambda i: w[i + 1 : i + width])) AS b FROM w, m WHERE {has('w')}),
hits AS (SELECT r, label, len(list_intersect(b, words)) / len(words) AS share FROM blocks
  WHERE len(list_intersect(b, words)) >= o AND {has('b')} AND NOT list_has_any(b, others)),
found AS (SELECT r, label FROM hits UNION SELECT r, label FROM places),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found GROUP BY r), best AS (SELECT r, max(share) AS share FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(base.labels, '') AS base_labels,
  coalesce(every.labels, '') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN every USING (r) LEFT JOIN best USING (r)"""


ORACLE = {"op4_license_scan": _sql()}
