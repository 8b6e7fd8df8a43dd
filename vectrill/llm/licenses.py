"""License scan by diagonal voting.

1. One pass over the texts hashes all rolling word k-grams (k = 2 for phrases, k = 4 for longer templates); nothing is
   left out. A row for each text also carries a marker that every text matches, so texts without a hit stay.
2. Spark joins the k-grams to the template positions, a broadcast of the templates' own k-grams (their number is fixed
   by the template list). A hit votes for a diagonal: its position in the text less its position in the template.
3. Votes are summed by text, template and diagonal, each with the words that the template would cover there.
4. In each text, a template's neighbouring diagonals (inserted or lost words) are merged, and each span is verified
   word by word: phrases must stand there whole, a longer template with at least `min_cover` of its words in order.
   Spans of one template that overlap (diagonals further apart) become one. Of texts that share most of their words
   (versions of a notice, two and three clauses), those of `KIN` whose spans overlap, the most alike stays.

Defined cases: words are runs of digits, a to z (A-Z lower-cased) and characters beyond ASCII; null counts as empty,
and texts without a word have no hits. Each row is a document of its own, also if others have its id. Columns but the id and the text are ignored. Overlapping hits of different templates are all reported.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.llm import _common as common
from vectrill.llm.license_texts import TEXTS


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False


# Phrases and the labels that they mean.
PHRASES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)

# Sentences of public license texts and notices.
NOTICES = (
    Template("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("mit-notice", "Released under the MIT License"),
    Template("gpl-notice", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("gpl-notice", "licensed under the GNU General Public License, version"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    Template("lgpl-notice", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("no-warranty", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
)

#: Whole texts, beside the single sentences.
WHOLE = tuple(Template(label, text) for label, text in TEXTS.items())
#: Labels whose texts differ in few words only.
KIN = (
    ("bsd-2-clause-full", "bsd-3-clause-full"),
    ("gpl-2.0-notice-full", "gpl-3.0-notice-full", "lgpl-2.1-notice-full", "lgpl-3.0-notice-full", "agpl-3.0-notice-full"),
)

_SHORT, _LONG, _PAD = 2, 4, 2
_MARKER = 0x5EED
_FAMILY = {label: family for family, labels in enumerate(KIN) for label in labels}
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text)


def _grams(texts: pa.Array) -> tuple[common.Words, list[tuple[np.ndarray, np.ndarray]]]:
    words = common.Words(texts, common.ALNUM, lower=True)
    hashes = words.hashes()
    return words, [words.grams(hashes, k) for k in (_SHORT, _LONG)]


def template_positions(templates: tuple[Template, ...]) -> list[tuple[int, int, int]]:
    """(gram, template, position) of all templates, and the marker as template -1."""
    words, grams = _grams(pa.array([t.text for t in templates]))
    out, text = [(_MARKER, -1, 0)], words.text_of_word()
    for k, (values, where) in zip((_SHORT, _LONG), grams, strict=True):
        for value, at in zip(values.view(np.int64).tolist(), where.tolist(), strict=True):
            which = int(text[at])
            if templates[which].phrase == (k == _SHORT):
                out.append((value, which, at - int(words.bounds[which])))
    return out


def _rolling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text: its lower-cased bytes, its words' first bytes, and its k-grams by position: the marker, then n of 2 words, then n of 4 words."""
    for batch in common.slices(batches):
        words, ((short, short_at), (long, long_at)) = _grams(batch.column("text"))
        n, bounds = words.counts, words.bounds
        at = np.concatenate([[0], np.cumsum(2 * n + 1)])
        out = np.zeros(at[-1], np.int64)
        out[at[:-1]] = _MARKER
        text = words.text_of_word()
        place = at[:-1][text] + 1 + np.arange(len(text)) - bounds[:-1][text]
        out[place[short_at]] = short.view(np.int64)
        out[place[long_at] + n[text[long_at]]] = long.view(np.int64)
        lower = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(words.offsets.astype(np.int64)), pa.py_buffer(words.data)]).cast(pa.binary())
        starts = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array((words.start - words.offsets[:-1][text]).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), lower, starts, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(out))], ["row", "id", "data", "starts", "grams"])


def votes(df: DataFrame, id_col: str, text_col: str, templates: tuple[Template, ...]) -> DataFrame:
    """(row, id, template, diagonal, votes, n_words, from_word, window): one row for each diagonal with a hit; template -1 for each id."""
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", df.schema[id_col].dataType), T.StructField("data", T.BinaryType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("grams", T.ArrayType(T.LongType()))])
    lengths = [len(words_of(t.text.lower().encode())) for t in templates]
    rows = [(g, t, p, lengths[t] if t >= 0 else 0) for g, t, p in template_positions(templates)]
    known = df.sparkSession.createDataFrame(rows, "gram long, template int, place int, length int")
    hits = docs.mapInArrow(_rolling, schema).select("row", "id", "data", "starts", F.posexplode("grams").alias("at", "gram")).join(F.broadcast(known), "gram")  # as many rows as the templates have k-grams
    n = F.size("starts")
    word = F.when(F.col("at") > n, F.col("at") - n - 1).otherwise(F.col("at") - 1)
    hits = hits.select("row", "id", "data", "starts", "template", "length", n.alias("n_words"), F.when(F.col("template") < 0, 0).otherwise(word - F.col("place")).alias("diagonal"))
    first, last = F.greatest(F.lit(0), F.col("diagonal") - _PAD), F.least(n, F.col("diagonal") + F.col("length") + _PAD)
    begin = F.get("starts", first)
    window = F.when(F.col("template") < 0, F.lit(b"")).otherwise(F.expr("substring(data, begin + 1, coalesce(get(starts, last), octet_length(data)) - begin)"))
    hits = hits.withColumns({"first": first, "last": last}).withColumn("begin", begin).select("row", "id", "template", "diagonal", "n_words", F.col("first").alias("from_word"), window.alias("window"))
    return hits.groupBy("row", "template", "diagonal").agg(F.first("id").alias("id"), F.count("*").alias("votes"), F.max("n_words").alias("n_words"), F.first("from_word").alias("from_word"), F.first("window").alias("window"))


def _matched(window: list[bytes], template: list[bytes]) -> tuple[int, int, int]:
    """Most words of the template found in order in the window, and the first and last of them there."""
    n, m = len(window), len(template)
    best = [[0] * (m + 1)]
    for i in range(n):
        above, row = best[-1], [0]
        for j in range(m):
            row.append(above[j] + 1 if window[i] == template[j] else max(above[j + 1], row[-1]))
        best.append(row)
    found, i, j = [], n, m
    while i and j:
        if window[i - 1] == template[j - 1] and best[i][j] == best[i - 1][j - 1] + 1:
            found.append(i - 1)
            i, j = i - 1, j - 1
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return (len(found), found[-1], found[0]) if found else (0, 0, 0)


def _spans(template: Template, rows: list[tuple[int, int, int, bytes]], min_cover: float) -> list[tuple[int, int, float]]:
    """(first word, last word, cover) of the verified spans; rows: (diagonal, votes, from_word, window) by diagonal."""
    wanted, out = words_of(template.text.lower().encode()), []
    if template.phrase:
        for diagonal, count, start, window in rows:
            if diagonal >= 0 and count >= len(wanted) - _SHORT + 1 and words_of(window)[diagonal - start : diagonal - start + len(wanted)] == wanted:
                out.append((diagonal, diagonal + len(wanted) - 1, 1.0))
        return out
    groups: list[list[tuple[int, int, int, bytes]]] = []
    for row in rows:
        if groups and row[0] - groups[-1][-1][0] <= _PAD:
            groups[-1].append(row)
        else:
            groups.append([row])
    for group in groups:
        diagonal, _, start, window = max(group, key=lambda r: (r[1], -r[0]))
        there = words_of(window)
        if (Counter(there) & Counter(wanted)).total() < min_cover * len(wanted):  # in order there are no more
            continue
        got, first, last = _matched(there, wanted)
        if got >= min_cover * len(wanted):
            out.append((start + first, start + last, got / len(wanted)))
    merged: list[tuple[int, int, float]] = []
    for first, last, cover in sorted(out):
        if merged and first <= merged[-1][1]:
            first, last, cover = merged[-1][0], max(last, merged[-1][1]), max(cover, merged.pop()[2])
        merged.append((first, last, cover))
    return merged


def _closest(spans: list[dict], lengths: dict[str, int]) -> list[dict]:
    """The spans without those of kindred labels that overlap one more alike: with more of the words of both in common (then the first label)."""

    def alike(s: dict) -> float:
        wanted = lengths[s["label"]]
        return 2 * s["cover"] * wanted / (wanted + s["last_word"] - s["first_word"] + 1)

    out = [s for s in spans if s["label"] not in _FAMILY]
    for s in sorted((s for s in spans if s["label"] in _FAMILY), key=lambda s: (-alike(s), s["label"])):
        if not any(_FAMILY.get(o["label"]) == _FAMILY[s["label"]] and o["first_word"] <= s["last_word"] and s["first_word"] <= o["last_word"] for o in out):
            out.append(s)
    return out


def scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = PHRASES + NOTICES + WHOLE, min_cover: float = 0.75
) -> DataFrame:
    """id, n_words, spans: for each document an array of (label, phrase, first_word, last_word, cover) by place."""

    lengths = {t.label: len(words_of(t.text.lower().encode())) for t in templates}

    def document(held: list[tuple]) -> tuple[int, list[dict]]:
        spans, by = [], {}
        for template, *rest in held:
            by.setdefault(template, []).append(rest)
        for which, rows in by.items():
            if which >= 0:
                t = templates[which]
                spans += [{"label": t.label, "phrase": t.phrase, "first_word": a, "last_word": b, "cover": c} for a, b, c in _spans(t, [(r[0], r[1], r[3], r[4]) for r in sorted(rows)], min_cover)]
        return max(r[2] for rows in by.values() for r in rows), sorted(_closest(spans, lengths), key=lambda s: (s["first_word"], s["label"], s["last_word"]))

    span = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, got, held, key, own = [], [], [], None, None

        def done() -> None:
            if held:
                ids.append(own)
                got.append(document(held))

        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "template", "diagonal", "votes", "n_words", "from_word", "window")), strict=True):
                if row[0] != key:
                    done()
                    key, own, held = row[0], row[1], []
                held.append(row[2:])
            if len(ids) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], span)], ["id", "n_words", "spans"])
                ids, got = [], []
        done()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], span)], ["id", "n_words", "spans"])

    schema = T.StructType([
        T.StructField("id", df.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("phrase", T.BooleanType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("cover", T.DoubleType())]))),
    ])
    counted = votes(df, id_col, text_col, templates).repartition("row").sortWithinPartitions("row", "template", "diagonal")
    return counted.mapInArrow(verify, schema).withColumnRenamed("id", id_col)


def digest(spans: DataFrame) -> DataFrame:
    """The spans of scan() as counts, places of the phrases and comma-joined labels."""
    phrases = F.filter("spans", lambda s: s["phrase"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda s: s["label"]))), ",")
    rest = [c for c in spans.columns if c not in ("spans",)]
    return spans.select(
        *rest,
        F.size(phrases).cast("long").alias("n_base"),
        F.array_min(F.transform(phrases, lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform(phrases, lambda s: s["first_word"])).alias("last_word"),
        labels(phrases).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )
