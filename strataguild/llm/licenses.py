"""License scans by diagonal voting: word k-grams joined to template positions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataguild.llm.license_texts import TEXTS

#: Words of a gram; the shortest phrase has as many.
K = 3
#: Diagonals this close belong to one match with words put in or left out.
DRIFT = 3
#: Share of a notice's words that a merged span must hold, and share of the span's words that must come from it.
LEAST = 0.6
BROADCAST_ROWS = 50_000


@dataclass(frozen=True)
class Template:
    """A label's text.  A ``base`` phrase counts only where all its words stand consecutively."""

    label: str
    text: str
    base: bool


#: The base phrases and their labels.
PHRASES = [
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
]
#: Opening or granting sentences of common licenses.
NOTICES = [
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", False),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", False),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", False),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", False),
    Template("gpl-3", "either version 3 of the license or at your option any later version", False),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", False),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", False),
]
NOTICES += [Template(label, " ".join(re.findall("[a-z0-9]+", text.lower())), False) for label, text in TEXTS]


def words(text: Column) -> Column:
    """Words of a whole text, A-Z lower-cased; null has none.

    Lower-casing all letters keeps the places of words; the one other letter whose small form is a plain ASCII letter
    (the Kelvin sign) is replaced first, so that it matches no template.
    """
    safe = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u0101")))
    return F.array_remove(F.split(safe, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """``gram, tpl, tpos, hash`` of all templates: a row for each of their words.

    Marked for broadcast up to ``BROADCAST_ROWS`` rows; a longer table is joined by shuffling.
    """
    rows = []
    for tpl, t in enumerate(templates):
        ws = t.text.split()
        rows += [(" ".join(ws[i : i + K]), tpl, i) for i in range(len(ws) - K + 1)]
    table = spark.createDataFrame(rows, "gram string, tpl int, tpos int").withColumn("hash", F.xxhash64("gram"))
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """Licenses named in every document.

    All k-grams of a document's words are joined by hash (and then text) to the template positions.  Hits are counted
    per offset diagonal (document word minus template word); the hits of a diagonal are verified words, so a base
    phrase stands exactly where its diagonal holds all its grams.  For longer notices, diagonals up to ``DRIFT`` apart
    and near in the document are merged.  A merged span is verified word by word: the places of the notice's words that it
    holds, each counted once however often they are hit, must be ``LEAST`` of the notice, and those of the document's
    words that they cover ``LEAST`` of the span.  Equal spans of one label are all listed.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``: places of base
    phrases, their smallest and largest start, the sorted labels of the base phrases and of all matches, the best
    share of a notice's words found in a span (1 with a base phrase), and the notices' spans as (label, first word,
    last word, share).  Texts are taken whole, however long.  Null and empty texts give no places and score 0.  Repeated rows are all returned, with equal answers;
    rows that share a doc_id but not a text are told apart.  Other columns are ignored.
    """
    templates = PHRASES + NOTICES if templates is None else templates
    grams = template_grams(docs.sparkSession, templates)
    sizes = [len(t.text.split()) - K + 1 for t in templates]
    size = F.get(F.array(*[F.lit(x) for x in sizes]), F.col("tpl"))
    base = F.get(F.array(*[F.lit(t.base) for t in templates]), F.col("tpl"))
    label = lambda x: F.get(F.array(*[F.lit(t.label) for t in templates]), x)

    listed = docs.select("doc_id", F.xxhash64("text").alias("body"), words(F.col("text")).alias("ls_words"))
    word = lambda i: F.get("ls_words", i)
    starts = F.when(F.size("ls_words") >= K, F.sequence(F.lit(0), F.size("ls_words") - K)).otherwise(F.array().cast("array<int>"))
    own = F.transform(starts, lambda i: F.struct(i.alias("dpos"), F.concat_ws(" ", *[word(i + j) for j in range(K)]).alias("gram")))
    # One more entry stands for the document itself, so that those without a hit stay in the table.
    entry = F.array(F.struct(F.lit(-1).alias("dpos"), F.lit(None).cast("string").alias("gram")))
    rows = listed.select("doc_id", "body", F.size("ls_words").cast("long").alias("n_words"), F.explode(F.concat(entry, own)).alias("x"))
    rows = rows.select("doc_id", "body", "n_words", "x.dpos", "x.gram", F.xxhash64("x.gram").alias("hash"))
    hits = rows.join(grams, ["hash", "gram"], "left").where("tpl is not null or dpos < 0")

    # Copies of a row have equal hits; ``copies`` gives every one of them its row in the end.
    votes = (
        hits.groupBy("doc_id", "body", "n_words", "tpl", (F.col("dpos") - F.col("tpos")).alias("diagonal"))
        .agg(F.count(F.lit(1)).alias("rows"), F.collect_set("tpos").alias("held"), F.min("dpos").alias("low"), F.max("dpos").alias("high"))
    )
    whole = votes.select(
        "doc_id", "body", "n_words", "tpl", "diagonal", "rows", "held", "low", "high", (base & (F.size("held") == size)).alias("is_base"), base.alias("of_base")
    )
    # Places of the template's and of the document's words that a diagonal's grams cover.
    covered = lambda places: F.array_distinct(F.flatten(F.transform(places, lambda x: F.sequence(x, x + K - 1))))
    in_tpl = covered(F.col("held"))
    entry = F.struct("tpl", "low", "high", "diagonal", in_tpl.alias("own"), F.transform(in_tpl, lambda x: x + F.col("diagonal")).alias("met"))
    gathered = whole.groupBy("doc_id", "body", "n_words").agg(
        F.max(F.when(F.col("tpl").isNull(), F.col("rows"))).alias("copies"),
        F.count(F.when(F.col("is_base"), 1)).alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("diagonal"))).cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("is_base"), F.col("tpl"))).alias("base_tpls"),
        F.array_sort(F.collect_list(F.when(~F.col("of_base"), entry))).alias("found"),
    )

    def merge(acc: Column, x: Column) -> Column:
        """Join a diagonal to the last span if it is of the same template, close by and on a near diagonal."""
        last = F.get(acc, F.size(acc) - 1)
        near = (last["tpl"] == x["tpl"]) & (F.abs(last["diagonal"] - x["diagonal"]) <= DRIFT) & (x["low"] - last["high"] <= K + DRIFT)
        joined = F.struct(
            x["tpl"].alias("tpl"),
            last["low"].alias("low"),
            F.greatest(last["high"], x["high"]).alias("high"),
            x["diagonal"].alias("diagonal"),
            F.array_union(last["own"], x["own"]).alias("own"),
            F.array_union(last["met"], x["met"]).alias("met"),
        )
        fresh = F.struct(*[x[f].alias(f) for f in ("tpl", "low", "high", "diagonal", "own", "met")])
        return F.when(near, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(fresh)))

    none = F.array().cast("array<struct<tpl:int,low:int,high:int,diagonal:int,own:array<int>,met:array<int>>>")
    spans = F.aggregate("found", none, merge)
    words_of = F.array(*[F.lit(x + K - 1) for x in sizes])
    scored = F.transform(
        spans,
        lambda x: F.struct(
            label(x["tpl"]).alias("label"),
            x["low"].cast("long").alias("first"),
            (x["high"] + K - 1).cast("long").alias("last"),
            (F.size(x["own"]) / F.get(words_of, x["tpl"])).alias("share"),
            (F.size(x["met"]) / (x["high"] + K - x["low"])).alias("filled"),
        ),
    )
    done = gathered.select("*", F.transform("base_tpls", label).alias("base_names"), scored.alias("tried"))
    spans = F.filter("tried", lambda x: (x["share"] >= LEAST) & (x["filled"] >= LEAST))
    best = F.coalesce(F.array_max(F.transform("tried", lambda x: x["share"])), F.lit(0.0))
    out = done.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base_names")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base_names", F.transform(spans, lambda x: x["label"])))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
        F.transform(spans, lambda x: F.struct(*[x[f].alias(f) for f in ("label", "first", "last", "share")])).alias("spans"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return out.drop("copy")
