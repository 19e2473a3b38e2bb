"""Operator 7: licence scan with a positional index of rare words.

Method: document frequencies of the templates' words are counted over all
files; every template is indexed under its ``rare_words`` words of highest
IDF, with their positions. A file looks its rare licence words up in the
index; postings of one template at one relative position support the same
alignment. An alignment held by enough rare words is scored by the share of
the template's words that stand at their place in the file, and counts only if
every mandatory key phrase stands in the aligned words.

Plan: a map over the texts keeps, for every rare word found, only the words
around it (twice the longest template), so no text is shuffled; postings are a
bounded parameter. Two reductions per row follow, combined map-side.

Defined results: a null text counts as empty: no words, no labels, score 0,
null first and last word. Repeated rows each keep their result; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels (fixed values of the contract).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str                    # lower-case words
    phrases: tuple[str, ...]     # all must stand in the aligned words
    min_share: float = 0.8       # share of the template's words at their place


#: Notices by which files name their licence (public licence texts, shortened).
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
                    "and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("gpl", "this work is licensed under the gnu general public license version", ("general public license",)),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license",
             ("general public license",)),
    Template("lgpl", "licensed under the gnu lesser general public license version", ("lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license version", ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use", "are permitted")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license",
             ("mozilla public license",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    Template("cc-by", "licensed under cc by 3 0", ("cc by 3",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    Template("cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
)


def licence_words(text) -> F.Column:
    return F.filter(F.split(lower_ascii(text), SEPARATORS), lambda w: w != "")


def rare_index(rows: DataFrame, templates, rare_words: int):
    """(word, template, position, words needed) of every template's rarest words over ``rows``."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})   # bounded by the templates
    held = F.array_distinct(F.filter("w", lambda w: w.isin(vocabulary)))
    n = {r["v"]: r["n"] for r in rows.select(F.explode(held).alias("v")).groupBy("v").agg(F.count("*").alias("n")).collect()}
    idf = {w: -math.log((1 + n.get(w, 0)) / (1 + max(n.values(), default=0))) for w in vocabulary}
    index = []
    for k, t in enumerate(templates):
        tw = t.text.split()
        rare = sorted(set(tw), key=lambda w: (-idf[w], w))[:rare_words]
        index += [(w, k, p, math.ceil(len(rare) / 2)) for p, w in enumerate(tw) if w in rare]
    return index


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, rare_words: int = 4,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), licence_words(F.col(text_col)).alias("w"))
    index = rare_index(rows, templates, rare_words)
    longest = max(len(t.text.split()) for t in templates)

    x = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("n_words", F.size("w").cast("long"))
    # every base phrase ends in the same word: only its places are looked at
    last = {p.split()[-1] for p, _ in PHRASES}
    x = x.withColumn("ends", F.expr("filter(transform(w, (v, i) -> CASE WHEN v IN ({}) THEN i END), i -> i IS NOT NULL)".format(
        ", ".join(f"'{v}'" for v in sorted(last)))))

    def starts(phrase: str) -> F.Column:
        ws = phrase.split()
        same = " AND ".join(f"get(w, i - {len(ws) - 1 - j}) = '{v}'" for j, v in enumerate(ws))
        return F.expr(f"transform(filter(ends, i -> {same}), i -> i - {len(ws) - 1})")

    x = x.select("*", *[starts(p).alias(f"s_{k}") for k, (p, _) in enumerate(PHRASES)])
    x = x.withColumn("starts", F.concat(*[f"s_{k}" for k in range(len(PHRASES))]))
    # rare words of the index, each with the words around it
    rare = ", ".join(sorted({f"'{w}'" for w, *_ in index}))
    x = x.withColumn("hits", F.expr(f"filter(transform(w, (v, i) -> CASE WHEN v IN ({rare}) THEN i END), i -> i IS NOT NULL)"))
    x = x.withColumn("hits", F.expr(f"""transform(hits, i -> struct(w[i] AS v, i AS i, greatest(0, i - {longest}) AS lo,
                                        slice(w, greatest(0, i - {longest}) + 1, {2 * longest}) AS near))"""))
    x = x.select("_row", "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
                 F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
                 F.expr("array_compact(array({}))".format(", ".join(
                     f"CASE WHEN size(s_{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES)))).alias("base"),
                 F.explode_outer("hits").alias("h"))

    postings = spark.createDataFrame(
        [(w, k, p, need, templates[k].label, templates[k].text.split(), list(templates[k].phrases), templates[k].min_share)
         for w, k, p, need in index],
        "v string, template int, pos int, need int, label string, t_words array<string>, t_phrases array<string>, min_share double")
    j = x.join(F.broadcast(postings), F.col("h.v") == F.col("v"), "left").withColumn("at", F.col("h.i") - F.col("pos"))
    aligned = F.expr("CASE WHEN at >= 0 THEN slice(h.near, at - h.lo + 1, size(t_words)) ELSE slice(h.near, 1, 0) END")
    j = j.withColumn("aligned", aligned)
    share = F.expr("size(filter(zip_with(aligned, t_words, (a, b) -> a <=> b), ok -> ok)) / size(t_words)")
    phrases = F.expr("forall(t_phrases, p -> contains(array_join(aligned, ' '), p))")
    j = j.withColumn("share", F.when(phrases, share).otherwise(F.lit(0.0)))
    base = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    votes = j.groupBy("_row", "template", "at").agg(
        *[F.first(c).alias(c) for c in base], F.count_distinct("v").alias("votes"), F.first("need").alias("need"),
        F.first("label").alias("label"), F.first("min_share").alias("min_share"), F.max("share").alias("share"))
    ok = F.expr("votes >= need AND share >= min_share")
    out = votes.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in base], F.collect_set(F.when(ok, F.col("label"))).alias("found"),
        F.max(F.when(ok, F.col("share"))).alias("share"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", "found")), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"))
