"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile is a language's most frequent character n-grams of length 1 to 3 in order of frequency; word edges count
as a space. A document is ranked likewise, and each of its n-grams costs a language the difference between the two
ranks, or `top` if the language's profile lacks it. The nearest profile is the prediction.

Learning counts n-grams in all rows given (partial sums in each task, then one sum by language and n-gram); the
driver receives at most `top` n-grams a language, for at most `max_languages` languages.

Defined cases: null text, empty text and text without a letter give `und` with score 0, as does everything when
nothing could be learnt. Rows with null text or language teach nothing. Equal n-gram counts are ranked by n-gram,
equal distances go to the language with more training text, then by name. Repeated rows are predicted each. Input
columns other than the text stay as they are; an input column that is called like an output column is replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.llm import _common as common

SPACE = 32
UNDETERMINED = "und"


@dataclass(frozen=True)
class Profiles:
    """languages by falling amount of training text; grams: all their n-grams, sorted; ranks[language, gram]: `top` where it lacks one."""

    languages: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    top: int


@cache
def letter_table() -> np.ndarray:
    """Which code points are letters or the marks that belong to them."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def folded(text: str) -> np.ndarray:
    """Code points of the lower-cased text; what is no letter becomes a space, and a space stands at either end."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letter_table()[points], points, SPACE).astype(np.int64)


def gram_keys(points: np.ndarray) -> np.ndarray:
    """All n-grams of 1 to 3 characters as integers of 21 bits a character; none spans two words."""
    space = points == SPACE
    a, b, c = points[:-2], points[1:-1], points[2:]
    one = points[~space]
    two = ((points[:-1] << 21) | points[1:])[~(space[:-1] & space[1:])]
    three = ((a << 42) | (b << 21) | c)[~space[1:-1]]
    return np.concatenate([one, two, three])


def count_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    if not len(keys):
        return keys, keys
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def ranked(keys: np.ndarray, top: int) -> np.ndarray:
    """The `top` most frequent of the keys, most frequent first."""
    keys, counts = count_keys(keys)
    if len(counts) and counts.max() < 1 << 16:
        counts = counts.astype(np.uint16)  # sorted by radix
        return keys[np.argsort(np.uint16(0xFFFF) - counts, kind="stable")[:top]]
    return keys[np.argsort(-counts, kind="stable")[:top]]


# --- learning -------------------------------------------------------------------------------


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out(lang: str) -> pa.RecordBatch:
        keys, counts = held.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], schema=schema)

    for batch in common.slices(batches):
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            keys, counts = count_keys(gram_keys(folded(" ".join(texts))))
            if lang in held:
                keys, at = np.unique(np.concatenate([held[lang][0], keys]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([held[lang][1], counts])).astype(np.int64)
            held[lang] = keys, counts
            if len(keys) > 1 << 20:
                yield out(lang)
    for lang in list(held):
        yield out(lang)


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 400, max_languages: int = 500) -> Profiles:
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("rank", F.col("rank") - 1).toArrow().to_pandas()
    size = best.groupby("lang").n.sum()
    languages = sorted(size.index, key=lambda x: (-size[x], x))
    if len(languages) > max_languages:
        raise ValueError(f"{len(languages)} languages; at most {max_languages} are allowed")
    grams = np.unique(best.gram.to_numpy(np.int64))
    ranks = np.full((len(languages), len(grams)), top, np.int64)
    ranks[best.lang.map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64), np.searchsorted(grams, best.gram)] = best["rank"]
    return Profiles(tuple(languages), grams, ranks, top)


# --- prediction -----------------------------------------------------------------------------


def out_of_place(points: np.ndarray, profiles: Profiles) -> np.ndarray:
    """The distance of a text to each language."""
    grams = ranked(gram_keys(points), profiles.top)
    at = np.minimum(np.searchsorted(profiles.grams, grams), len(profiles.grams) - 1)
    ranks = np.where(profiles.grams[at] == grams, profiles.ranks[:, at], profiles.top)
    return np.where(ranks < profiles.top, np.abs(ranks - np.arange(len(grams))), profiles.top).sum(axis=1)


def predict_text(text: str | None, profiles: Profiles) -> tuple[str, float]:
    """(language, score): score is 1 less the nearest distance over the furthest one possible."""
    points = folded(text or "")
    if not profiles.languages or not (points != SPACE).any():
        return UNDETERMINED, 0.0
    distance = out_of_place(points, profiles)
    best = int(np.argmin(distance))
    most = profiles.top * min(profiles.top, len(np.unique(gram_keys(points))))
    return profiles.languages[best], 1.0 - float(distance[best]) / most


def predict(df: DataFrame, profiles: Profiles, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Adds lang_out and score_out to every row."""
    keep = df.drop(*[c for c in (lang_out, score_out) if c in df.columns and c != text_col])
    sent = df.sparkSession.sparkContext.broadcast(profiles)  # at most top * max_languages n-grams
    schema = T.StructType([*keep.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text_col):
            got = [predict_text(x, sent.value) for x in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], [*batch.schema.names, lang_out, score_out])

    return keep.mapInArrow(run, schema)
