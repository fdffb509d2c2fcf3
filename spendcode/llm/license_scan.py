"""License scans: phrase places and an exact set-similarity join with templates (DataFrame functions only).

Words are runs of ASCII digits, ASCII letters (lower-cased) and non-ASCII characters.

* *Base*: places where the words of a phrase stand consecutively.
* *Method*: a text block carries a template's label if it holds at least ``threshold`` of the template's
  distinct words and none of the words that tell it from its relatives (``without``).  Blocks are windows
  of the text's words and run across lines: for a short notice every window of its length and two more
  words, which must hold all its words; for a licence text windows of twice its length, a length apart, so
  that any place of the text lies in one.
* The join: the vocabulary is ordered by frequency over the whole corpus, rarest first.  A matching
  block must share one of the ``|T| - o + 1`` rarest words of the template, ``o`` the overlap that it needs
  (prefix filter), so only windows around these words are cut out of the texts.  Within such a
  block its words of the vocabulary are ordered alike, must be ``o`` at least (length filter), and enough of them must be
  left behind the shared word (positional filter).  The template table is a parameter, therefore small
  and broadcast.  Candidates are verified by their full overlap.

``score`` is the largest share of a template found in one block, or 1 if a phrase occurs, else 0.

Edge cases: a null text counts as empty and has no words; phrases may overlap, all places count; a notice in a
text shorter than the window is found in the window that the text's end cuts; labels of repeated
rows are equal; a null id is a value like any other; extra columns are ignored by ``license_scan``; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcode.functions.text import let
from spendcode.llm.common import ascii_lower, stored

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Template(NamedTuple):
    label: str
    text: str
    threshold: float = 1.0
    without: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        return sorted(set(self.text.split(" ")))

    @property
    def need(self) -> int:
        return math.ceil(self.threshold * len(self.words) - 1e-9)

    @property
    def stride(self) -> int:
        return 1 if self.threshold == 1 else len(self.text.split(" "))

    @property
    def window(self) -> int:
        n = len(self.text.split(" "))
        return n + 2 if self.threshold == 1 else 2 * n


_CC = ("nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives")
_GNU = ("lesser", "affero", "library")
#: Notices, to be found whole, and opening paragraphs of licence texts, to be found by four fifths of their words.
TEMPLATES = (
    Template("mit", "released under the mit license"),
    Template("mit", "licensed under the mit license"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("gpl", "licensed under the gnu general public license version 3", without=_GNU),
    Template("gpl", "licensed under the gnu general public license version 2", without=_GNU),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("cc-by", "licensed under cc by 4 0", without=_CC),
    Template("cc-by-nc", "licensed under cc by nc 4 0", without=("sa", "nd")),
    Template("cc-by-sa", "licensed under cc by sa 4 0", without=("nc", "nd")),
    Template("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    Template("cc-by", "creative commons attribution 4 0 international", without=_CC),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international", without=("sharealike", "noderivatives")),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international", without=("noncommercial",)),
    Template("mpl", "subject to the terms of the mozilla public license"),
    Template("bsd", "licensed under the bsd license"),
    Template("public-domain", "released into the public domain"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files the software to deal in the software without restriction including without limitation the rights to use "
             "copy modify merge publish distribute sublicense and or sell copies of the software", 0.8),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
             "license you may obtain a copy of the license at", 0.8),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
             "as published by the free software foundation either version 3 of the license or at your option any later version", 0.8, _GNU),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
             "following conditions are met", 0.8),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
             "distributed with this file you can obtain one at", 0.8),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
             "use compile sell or distribute this software", 0.8),
)


def spaced_words(text: Column) -> Column:
    """All words of a text, each with a space on both sides (``' a  b '``); empty if there is none."""
    words = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, "  "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def count_spaced(spaced: Column) -> Column:
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("bigint")


def _needle(phrase: str) -> str:
    return " " + "  ".join(phrase.split(" ")) + " "


def phrase_columns(spaced: Column, phrases: Mapping[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word and base (array of labels) of a column of spaced words."""
    n, first, last, labels = F.lit(0).cast("bigint"), [], [], []
    for phrase, label in phrases.items():
        needle = _needle(phrase)
        inside = F.contains(spaced, F.lit(needle))
        n = n + F.when(inside, F.regexp_count(spaced, F.lit(f"(?={needle})"))).otherwise(0)
        ahead = F.when(inside, F.substring_index(spaced, needle, 1))
        # all before the last place: its needle less the first space may begin inside an earlier one
        behind = F.when(inside, F.substring_index(spaced, needle, -1))
        first.append(count_spaced(ahead))
        last.append(count_spaced(spaced) - count_spaced(behind) - len(phrase.split(" ")))
        labels.append(F.when(inside, F.lit(label)))
    pick = lambda f, cols: cols[0] if len(cols) == 1 else f(*cols)
    return {"n_base": n, "first_word": pick(F.least, first), "last_word": pick(F.greatest, last),
            "base": F.array_compact(F.array(*labels))}


def _prefixes(templates: Sequence[Template], rank: Mapping[str, int]) -> list[tuple]:
    """The template table: each template's words by rarity, once for each word of its prefix."""
    rows = []
    for i, t in enumerate(templates):
        ws = sorted(t.words, key=rank.__getitem__)
        rows += [(i, t.label, ws, t.need, list(t.without), w, at) for at, w in enumerate(ws[:len(ws) - t.need + 1])]
    return rows


def vocabulary_order(words: DataFrame, templates: Sequence[Template]) -> list[str]:
    """Words of the templates by their frequency in ``words`` (arrays), rarest first."""
    vocabulary = sorted({w for t in templates for w in t.words})
    counted = words.select(F.explode(F.filter("words", lambda w: w.isin(vocabulary))).alias("w")).groupBy("w").count()
    frequency = {r["w"]: r["count"] for r in counted.collect()}  # at most one row a vocabulary word
    return sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))


def blocks_around(words: Column, templates: Sequence[Template], order: Sequence[str]) -> Column:
    """Windows that hold a prefix word of a template of their kind: array of (window, stride, words)."""
    rank = {w: i for i, w in enumerate(order)}
    prefixes: dict[tuple[int, int], set[str]] = {}
    for i, _, ws, need, _, w, _ in _prefixes(templates, rank):
        prefixes.setdefault((templates[i].window, templates[i].stride), set()).add(w)
    anchors = sorted(set().union(*prefixes.values()))

    def of_kind(hits, window: int, stride: int, mine: set[str]):
        own = F.filter(hits, lambda h: h["w"].isin(sorted(mine)))
        # starts of the windows that a place lies in, none before the text
        starts = F.flatten(F.transform(own, lambda h: F.sequence(
            F.greatest(F.lit(0), F.floor((h["i"] - window + stride) / stride).cast("int")), F.floor(h["i"] / stride).cast("int"))))
        return F.transform(F.array_distinct(starts), lambda k: F.struct(
            F.lit(window).alias("window"), F.lit(stride).alias("stride"), F.slice(words, k * stride + 1, window).alias("block")))

    placed = F.filter(F.transform(words, lambda w, i: F.when(w.isin(anchors), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
    return let(placed, lambda hits: F.flatten(F.array(*[of_kind(hits, *kind, mine) for kind, mine in prefixes.items()])))


def template_matches(blocks: DataFrame, keys: Sequence[str], templates: Sequence[Template], order: Sequence[str]) -> DataFrame:
    """``(keys, label, share)`` of every block (``window, stride, block``) and template that match."""
    spark = blocks.sparkSession
    rank = {w: i for i, w in enumerate(order)}
    rows = [(templates[r[0]].window, templates[r[0]].stride, *r) for r in _prefixes(templates, rank)]
    table = spark.createDataFrame(rows, "window int, stride int, t int, label string, words array<string>, need int, without array<string>, "
                                        "word string, t_at int")
    ordered = F.array(*[F.lit(w) for w in order])
    held = blocks.select(*keys, "window", "stride", "block", F.array_intersect(ordered, "block").alias("held"))  # in the order of the first
    offered = held.select("*", F.posexplode("held").alias("b_at", "word"))
    n = F.size("held")
    pairs = offered.join(F.broadcast(table), ["window", "stride", "word"]).where(
        (n >= F.col("need"))                                              # length
        & (F.col("b_at") <= n - F.col("need"))                            # prefix of the block for this template
        & (F.least(n - F.col("b_at"), F.size("words") - F.col("t_at")) + F.least("b_at", "t_at") >= F.col("need")))
    overlap = F.size(F.array_intersect("held", "words"))
    apart = ~F.arrays_overlap("block", "without")
    return pairs.where((overlap >= F.col("need")) & apart).select(*keys, "label", (overlap / F.size("words")).alias("share"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 phrases: Mapping[str, str] = PHRASES, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """``(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for every row.

    ``labels`` adds the labels of the templates to the base ones.
    """
    def words(spaced: str) -> Column:
        return F.when(F.col(spaced) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(spaced), "  "))

    spaced = docs.select(F.col(id_col).alias("id"), spaced_words(F.col(text_col)).alias("spaced"))
    order = vocabulary_order(spaced.select(words("spaced").alias("words")), templates)
    scanned = spaced.withColumn("words", words("spaced")).select(
        "id", count_spaced(F.col("spaced")).alias("n_words"), *[c.alias(n) for n, c in phrase_columns(F.col("spaced"), phrases).items()],
        blocks_around(F.col("words"), templates, order).alias("blocks"))
    # texts are read for this table once more, and not again; rows are numbered, as ids may repeat
    table = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "license-blocks")
    blocks = table.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    matched = template_matches(blocks, ["row"], templates, order).groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max("share").alias("share"))
    both = table.drop("blocks").join(matched, "row", "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return both.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        joined(F.col("base")).alias("base_labels"), joined(F.array_union("base", more)).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
