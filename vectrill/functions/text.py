"""Tokenizers and stop words as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English stop words.
ENGLISH_STOP_WORDS = tuple(
    """
    a about above after again against ain all am an and any are aren aren't as at be because been before being below
    between both but by can couldn couldn't d did didn didn't do does doesn doesn't doing don don't down during each few
    for from further had hadn hadn't has hasn hasn't have haven haven't having he her here hers herself him himself his
    how i if in into is isn isn't it it's its itself just ll m ma me mightn mightn't more most mustn mustn't my myself
    needn needn't no nor not now o of off on once only or other our ours ourselves out over own re s same shan shan't she
    she's should should've shouldn shouldn't so some such t than that that'll the their theirs them themselves then there
    these they this those through to too under until up ve very was wasn wasn't we were weren weren't what when where
    which while who whom why will with won won't wouldn wouldn't y you you'd you'll you're you've your yours yourself
    yourselves
    """.split()
)

MIN_BYTES = 2


def default_tokens(text: Column, stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS) -> Column:
    """Lower-cased runs of letters and digits of more than two bytes that are no stop words."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.octet_length(w) > MIN_BYTES) & ~w.isin(list(stop_words)))


def han_tokens(text: Column, stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS) -> Column:
    """One token for each Han character; other letters and digits alone, if longer than two bytes."""
    characters = F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}])"), 1), lambda c: F.lower(c))
    return F.filter(characters, lambda c: c.rlike(r"\p{IsHan}") | ((F.octet_length(c) > MIN_BYTES) & ~c.isin(list(stop_words))))


def tokens(text: Column, stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS) -> Column:
    """The tokenizer that models use unless told otherwise: by Han characters if there are any."""
    return F.when(text.rlike(r"\p{IsHan}"), han_tokens(text, stop_words)).otherwise(default_tokens(text, stop_words))


def without_stop_words(words: DataFrame, stop_words: DataFrame, lang: str = "lang", word: str = "word") -> DataFrame:
    """Rows of words (lang, word) that the table stop_words (lang, word) lacks; unknown languages have none."""
    return words.join(stop_words.select(lang, word), [lang, word], "left_anti")


def text_hash(text: Column) -> Column:
    """A 64-bit hash for seeds of deterministic embeddings."""
    return F.xxhash64(text)


def mock_embedding(text: Column, size: int) -> Column:
    """Deterministic for each text: values from -1 to 1 from a hash of the text and the place, of length 1."""
    from vectrill.functions import vector

    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.pmod(F.xxhash64(text, i), F.lit(2000001)) / 1000000.0 - 1.0)
    return vector.normalize(raw)


def random_embedding(size: int, seed: int | None = None) -> Column:
    """Another unit vector for each row."""
    from vectrill.functions import vector

    return vector.normalize(F.array(*[F.rand(None if seed is None else seed + i) * 2 - 1 for i in range(size)]))
