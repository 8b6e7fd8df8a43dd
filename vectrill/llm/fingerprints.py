"""I-Match fingerprints with randomised lexicons, in DataFrame functions only.

The lexicon holds all terms of a band of inverse document frequency: those that at most `most_share` and at least
`least_share` of all documents have (and at least `least_documents`). So the band is the same at every size, and the
lexicon has at most as many terms as a document has distinct ones on average, divided by `least_share`. It is split at
random `rounds` times into `subsets` parts. A document's fingerprint has four hexadecimal digits for each
part: a hash of the sorted distinct terms that the document has of it, or `----` if there are none. Two documents'
likeness is the share of parts with equal hashes among the parts that either has terms of.

Document frequencies are counted over all documents, with partial sums before the shuffle. Fingerprints need no
shuffle. For each document's neighbour in the order of ids, rows are dealt into ranges of ids and each range also gets
the first row of the next; the table of these rows is as long as there are ranges.

Defined cases: terms are runs of digits, letters a to z (after lower-casing) and characters beyond ASCII; null counts as
the empty text. A document of whose terms less than `least_band` are in the lexicon (one of a group of near copies so large
that its terms leave the band, or one in a rare language) has all its terms in place of them, dealt to the same parts. A
document without terms has `=` and a hash for a fingerprint, which is like an equal one (1) and unlike any other (0). Repeated rows are returned each; rows with equal ids are ordered by a
hash of their text. With one document, the next one is itself. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrill.llm import _common as common

_NONE = "----"
_NOT_A_TERM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), _NOT_A_TERM)), "")


def lexicon(df: DataFrame, text_col: str = "text", most_share: float = 0.05, least_share: float = 0.008, least_documents: int = 2) -> list[str]:
    """The terms of the band, in order."""
    total = df.count()
    counts = df.select(F.explode(terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    band = counts.where((F.col("n") <= most_share * total) & (F.col("n") >= max(least_documents, least_share * total)))
    return sorted(r["term"] for r in band.collect())


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with value under a name, computed once: a lambda's body would compute it anew for each element."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def fingerprint(text_col: str, chosen: list[str], subsets: int = 32, rounds: int = 2, least_band: float = 0.1) -> Column:
    """The fingerprint of a text column, whose nulls count as empty. Written as SQL, so that the lexicon is parsed as one list of literals."""
    listed = ", ".join(f"'{t}'" for t in chosen)  # terms hold no quotes or backslashes
    every = f"array_remove(array_distinct(split(lower(coalesce(`{text_col}`, '')), r'{_NOT_A_TERM}')), '')"
    band = f"filter(every, t -> t in ({listed}))" if chosen else "cast(array() as array<string>)"

    def one_round(seed: int) -> str:
        own = _let("transform(filter(tagged, x -> x.part = k), x -> x.term)", "own", f"if(size(own) = 0, '{_NONE}', lpad(lower(hex(xxhash64(own) & 65535)), 4, '0'))")
        return _let(f"transform(held, t -> named_struct('part', cast(pmod(xxhash64(t, {seed}), {subsets}) as int), 'term', t))", "tagged", f"array_join(transform(sequence(0, {subsets - 1}), k -> {own}), '')")

    held = f"sort_array(if(size(band) < {least_band}D * size(every), every, band))"
    whole = f"if(size(held) = 0, concat('=', hex(xxhash64(held))), concat({', '.join(one_round(k) for k in range(rounds))}))"
    return F.expr(_let(every, "every", _let(band, "band", _let(held, "held", whole))))


def likeness(a: Column, b: Column, subsets: int = 32, rounds: int = 2) -> Column:
    """From 0 to 1."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(subsets * rounds - 1)),
        lambda k: F.struct(F.substring(a, k * 4 + 1, F.lit(4)).alias("a"), F.substring(b, k * 4 + 1, F.lit(4)).alias("b")),
    )
    some = F.filter(pairs, lambda p: (p["a"] != _NONE) | (p["b"] != _NONE))
    same = F.size(F.filter(some, lambda p: p["a"] == p["b"]))
    odd = a.startswith("=") | b.startswith("=")
    return F.when(odd, (a == b).cast("double")).otherwise(same / F.size(some))


def edited(text: Column, following: Column) -> Column:
    """The last third (rounded down) of a text's characters replaced by the first as many of the following text."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(following, F.lit(1), third))


def with_next(df: DataFrame, id_col: str, range_bytes: int = 16 << 20) -> tuple[DataFrame, object]:
    """Rows (id, text, range, copy) dealt into ranges of ids so that the next document, by falling id, follows in the
    window returned; rows with copy = 1 are only there to be followed."""
    size = df.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum(F.octet_length("text")).alias("bytes")).first()
    low, high = size["low"] or 0, size["high"] or 0
    ranges = max(1, -(-(size["bytes"] or 0) // range_bytes))
    dealt = df.withColumn("range", F.floor((F.col("id") - F.lit(low)) * (ranges / (high - low + 1))).cast("long"))
    tops = dealt.groupBy("range").agg(F.max("id").alias("top"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("range"))
    everything = Window.partitionBy(F.lit(1))
    # A row for each range; written, so that its size is known when the join is planned.
    sent = common.materialize(tops.select("top", F.coalesce(F.lag("range").over(order), F.min("range").over(everything)).alias("to")), "tops")
    both = dealt.join(sent, F.col("id") == F.col("top"), "left").select("id", "text", F.explode(F.when(F.col("to").isNull(), F.array(F.struct("range", F.lit(0).alias("copy")))).otherwise(F.array(F.struct("range", F.lit(0).alias("copy")), F.struct(F.col("to").alias("range"), F.lit(1).alias("copy"))))).alias("x"))
    window = Window.partitionBy("range").orderBy("copy", F.desc("id"), F.xxhash64("text"))
    return both.select("id", "text", "x.range", "x.copy"), window


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of every document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chosen = lexicon(docs, **options)
    rows, window = with_next(docs, id_col)
    changed = rows.withColumn("edited", edited(F.col("text"), F.lead("text").over(window)))
    marked = changed.select(
        "id", "range", "copy", F.xxhash64("text").alias("order"), F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("text", chosen).alias("fingerprint"), F.when(F.col("copy") == 0, fingerprint("edited", chosen)).alias("edited_fingerprint"),
    )
    follow = Window.partitionBy("range").orderBy("copy", F.desc("id"), "order")
    paired = marked.withColumn("next", F.lead("fingerprint").over(follow)).where("copy = 0")
    return paired.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
