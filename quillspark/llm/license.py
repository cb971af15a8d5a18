"""License scan: base phrases, and an exact set-similarity join with notice templates.

Only DataFrame functions.  Each text is cut into words once; what goes on are
the base places and, of texts with enough words of some template, the template
words of each line and their places.  Blocks are the lines of a text and, for
wrapped notices, runs of consecutive words, whatever the line breaks among
them, of as many words as a template has.  A run is emitted where it begins
with a word of its template and holds one of the template's prefix; it is
joined with that template only, so that prose beside a notice doesn't count
towards another one.

A block and a template are sets of words; a block matches where it holds at
least ``threshold`` of the template's words.  Words are put in one global
order, the rarest over all blocks first.  With an overlap of ``a`` words needed,
a match must share a word among the first ``|T| - a + 1`` words of the template
and the first ``|B| - a + 1`` of the block (prefix filter); blocks of fewer than
``a`` words are out (length filter); and so are pairs whose remaining words
after the shared place can't reach ``a`` (positional filter).  Survivors are
counted exactly.  Words that no template has can't add to an overlap and are
left out of the blocks beforehand.
"""

from __future__ import annotations

import string
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import id_text, session, stage

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short public notices, as (label, words).
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.8


def _places(words: list[str], label: str) -> Column:
    """Where a phrase's words stand one after the other in the column w."""

    def stands(i):
        test = F.lit(True)
        for k, w in enumerate(words):
            test &= F.get(F.col("w"), i + k) == w
        return test

    spots = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.coalesce(stands(i), F.lit(False)))
    return F.transform(spots, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def scanned(rows: DataFrame, templates: list[tuple[str, str]], threshold: float, base: dict[str, str] = BASE) -> DataFrame:
    """Per text: n_words, n_base, first_word, last_word, base_set; and of hopeful texts the template words.

    ``lines`` has those of each line, ``at`` their places in the text; both are
    null where no template's words are there in sufficient number.
    """
    sets = [sorted(set(words.split(" "))) for _, words in templates]
    need = [_need(t, threshold) for t in sets]
    vocabulary = sorted({w for t in sets for w in t})
    known, literals = F.array(*map(F.lit, vocabulary)), [F.array(*map(F.lit, t)) for t in sets]

    def reaches(found: Column) -> Column:
        any_of = [F.size(F.array_intersect(found, t)) >= a for t, a in zip(literals, need, strict=True)]
        return (F.size(found) >= min(need)) & reduce(or_, any_of)

    cut = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.transform(F.split(F.translate(F.col("text"), string.ascii_uppercase, string.ascii_lowercase), "\n"), lambda line: F.filter(F.split(line, _SEPARATORS), lambda w: w != "")).alias("cut"))
    worded = cut.withColumn("w", F.flatten("cut"))
    # a lambda over an array of one holds the words found, so that they aren't looked for again for each template
    judged = worded.withColumn("hopeful", F.exists(F.array(F.array_intersect("w", known)), reaches))
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    phrases = {p: p.split(" ") for p in base}
    shared = set.intersection(*map(set, phrases.values()))
    may = F.size("w") > 0 if not shared else F.array_contains("w", min(shared))
    hits = F.when(may, F.concat(*[_places(ws, base[p]) for p, ws in phrases.items()])).otherwise(none)
    at = F.filter(F.transform("w", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(vocabulary))
    lines = F.filter(F.transform("cut", lambda line: F.array_intersect(line, known)), lambda b: F.size(b) >= min(need))
    told = judged.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), hits.alias("hits"), F.when(F.col("hopeful"), lines).alias("lines"), F.when(F.col("hopeful"), at).alias("at"))
    return told.select(
        "doc_id", "text_key", "n_words", F.size("hits").cast("long").alias("n_base"), F.array_min("hits.at").alias("first_word"), F.array_max("hits.at").alias("last_word"),
        F.array_sort(F.array_distinct("hits.label")).alias("base_set"), "lines", "at",
    )


def _need(words: list[str], threshold: float) -> int:
    return -(-round(threshold * 1000) * len(words) // 1000)


def template_matches(texts: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """doc_id, text_key, label and containment of blocks (lines, and runs of words over line breaks) that meet the threshold.

    texts: doc_id, text_key, lines and at of ``scanned``, without nulls.
    """
    spark = texts.sparkSession
    sets = [(label, sorted(set(words.split(" "))), len(words.split(" "))) for label, words in templates]
    need = [_need(t, threshold) for _, t, _ in sets]
    # one row for each word of the templates: small, whatever the corpus
    seen = {r[0]: r[1] for r in texts.select(F.explode("lines").alias("line")).select(F.explode("line").alias("word")).groupBy("word").count().collect()}
    rank = {w: i for i, w in enumerate(sorted({w for _, t, _ in sets for w in t}, key=lambda w: (seen.get(w, 0), w)))}
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    ordered = [sorted(rank[w] for w in words) for _, words, _ in sets]
    prefixes = [(t[j], k, label, j, a, len(t), t) for k, ((label, _, _), t, a) in enumerate(zip(sets, ordered, need, strict=True)) for j in range(len(t) - a + 1)]
    # of fixed size: the prefixes of the given templates
    table = spark.createDataFrame(prefixes, "rank int, template int, label string, j int, need int, t_size int, t array<int>")

    def runs(k: int, size: int) -> Column:
        """Words of each run for template k, as ranks."""
        t, first = ordered[k], ordered[k][: len(ordered[k]) - need[k] + 1]
        rare = F.filter("at", lambda p: p["rank"].isin(first))
        begins = F.flatten(F.transform(rare, lambda p: F.filter("at", lambda s: (s["at"] > p["at"] - size) & (s["at"] <= p["at"]) & s["rank"].isin(t))["at"]))
        run = lambda s: F.array_sort(F.array_distinct(F.filter("at", lambda v: (v["at"] >= s) & (v["at"] < s + size))["rank"]))
        return F.transform(F.array_distinct(begins), lambda s: F.struct(F.lit(k).alias("only"), run(s).alias("b")))

    placed = texts.select("doc_id", "text_key", "lines", F.transform("at", lambda p: F.struct(p["at"].alias("at"), ranks[p["word"]].alias("rank"))).alias("at"))
    whole = F.transform("lines", lambda line: F.struct(F.lit(-1).alias("only"), F.array_sort(F.transform(line, lambda w: ranks[w])).alias("b")))
    every = F.concat(whole, *[runs(k, size) for k, (_, _, size) in enumerate(sets)])
    # equal blocks of a text are one
    blocks = placed.select("doc_id", "text_key", F.posexplode(F.array_distinct(every)).alias("block", "x")).select("doc_id", "text_key", "block", "x.only", "x.b").filter(F.size("b") >= min(need))
    probes = blocks.select("doc_id", "text_key", "only", "b", F.posexplode("b").alias("i", "rank"))
    pairs = probes.join(F.broadcast(table), "rank").filter((F.col("only") < 0) | (F.col("only") == F.col("template")))
    length = F.size("b") >= F.col("need")
    prefix = F.col("i") <= F.size("b") - F.col("need")
    positional = F.least(F.size("b") - F.col("i"), F.col("t_size") - F.col("j")) >= F.col("need")
    # a pair is counted at its first shared word only
    first = F.col("rank") == F.array_min(F.array_intersect("b", "t"))
    exact = F.size(F.array_intersect("b", "t"))
    return pairs.filter(length & prefix & positional & first & (exact >= F.col("need"))).select("doc_id", "text_key", "label", (exact / F.col("t_size")).alias("containment"))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Base places, labels of both kinds and a score for every document.

    Null text counts as empty: no words, no labels, score 0.  The score is 1
    with a base phrase, else the largest containment of a match.  Repeated rows
    get the same result each; an empty table gives no rows.
    """
    session(docs)
    texts = stage(scanned(id_text(docs), templates, threshold), "scanned")
    found = template_matches(texts.filter("at IS NOT NULL"), templates, threshold).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    base, f = texts.drop("lines", "at").alias("a"), found.alias("f")
    joined = base.join(f, F.col("a.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("a.text_key") == F.col("f.text_key")), "left")
    return joined.select(
        F.col("a.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.array_join("base_set", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_set", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
