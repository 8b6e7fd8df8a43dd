"""Quality rules: measures of whole texts, and a decision list learnt from labelled documents.

Sequential covering: a rule is a conjunction of threshold conditions on the measures, grown on two thirds of the
labelled rows by information gain and pruned on the last third from its end, while that does not make it less exact
there. A rule is kept if it is right often enough on the pruning rows; the rows that it covers are taken out and the
next rule is grown. The list becomes one ordered Spark expression (CASE WHEN rule THEN false ... ELSE true).

Learning takes at most `max_rows` labelled documents, those whose ids hash lowest, so their ids can be broadcast and
their measures held by the driver. Measuring runs over every text, whole.

Defined cases: null, empty and blank texts have no words and all measures 0, and fail the base rule. Labels that are
null or belong to no document teach nothing; an id with several labels takes their mean, rounded. Without labels of
both kinds the list is empty and keeps everything. Repeated rows are judged each. All input columns stay as they are;
a measure that is called like one of them replaces it, unless a prefix is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.llm import _common as common

_U64 = np.uint64
_SYMBOL = common.byte_table(lambda b: b in b"#*$%&|<>")
_UPPER = common.byte_table(lambda b: 0x41 <= b <= 0x5A)
_LETTER = common.byte_table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
_DIGIT = common.byte_table(lambda b: 0x30 <= b <= 0x39)
_MARK = common.byte_table(lambda b: b in b"!?;:\"'()[]{}=/\\_~^@+`")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word", "symbol_ratio", "mark_ratio", "upper_ratio", "digit_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "line_words")


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur more than once; does an earlier one equal it."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    more, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    more[order[1:][same]] = True
    more[order[:-1][same]] = True
    return more, later


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS (integers) and RATIOS (floats) of each text."""
    words = common.Words(texts, common.SPACED, lower=False)
    data, offsets, n = words.data, words.offsets, words.counts
    text, size = words.text_of_word(), len(words.counts)
    salt = common.mix(np.arange(1, size + 1).astype(_U64))

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])

    lead = (data & 0xC0) != 0x80
    inside = common.SPACED[data]
    hashes = words.hashes()
    grams, where = words.grams(hashes, 3)
    often, _ = _repeats(grams ^ salt[text[where]])
    covered = np.zeros(len(hashes), bool)
    for j in range(3):
        covered[where[often] + j] = True
    _, seen = _repeats(hashes ^ salt[text])

    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([offsets[1:], breaks]))
    with_word = np.searchsorted(words.start, starts) < np.searchsorted(words.start, ends)
    starts, ends = starts[with_word], ends[with_word]
    line_text = np.searchsorted(offsets, starts, side="right") - 1
    _, again = _repeats(common.span_hashes(data, starts, ends) ^ salt[line_text])

    count = lambda where_, flags: np.bincount(where_[flags], minlength=size)
    over = lambda a, b: np.divide(a, b, out=np.zeros(size), where=b > 0)
    out = {
        "n_words": n, "word_chars": per_text(lead & inside), "n_symbols": per_text(_SYMBOL[data]),
        "n_dup_lines": count(line_text, again), "n_repeat_words": count(text, covered),
    }
    letters, lines = per_text(_LETTER[data]), np.bincount(line_text, minlength=size)
    return {k: v.astype(np.int64) for k, v in out.items()} | {
        "mean_word": over(out["word_chars"], n), "symbol_ratio": over(out["n_symbols"], n), "mark_ratio": over(per_text(_MARK[data]), n),
        "upper_ratio": over(per_text(_UPPER[data]), letters), "digit_ratio": over(per_text(_DIGIT[data]), out["word_chars"]),
        "dup_line_ratio": over(out["n_dup_lines"], lines), "repeat_ratio": over(out["n_repeat_words"], n),
        "distinct_ratio": over(n - count(text, seen), n), "line_words": over(n, lines),
    }


def measure(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds the measures of the text to every row."""
    names = [*COUNTS, *RATIOS]
    keep = df.drop(*[prefix + x for x in names if prefix + x in df.columns and prefix + x != text_col])
    schema = T.StructType([*keep.schema.fields, *(T.StructField(prefix + x, T.LongType() if x in COUNTS else T.DoubleType()) for x in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text_col):
            got = measures(batch.column(text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[x]) for x in names)], [*batch.schema.names, *(prefix + x for x in names)])

    return keep.mapInArrow(run, schema)


def base_failed(prefix: str = "") -> Column:
    return (F.col(prefix + "n_words") < 50) | (100 * F.col(prefix + "n_repeat_words") > 50 * F.col(prefix + "n_words"))


# --- the decision list ----------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self, prefix: str = "") -> Column:
        value = F.col(prefix + self.measure)
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        value = x[:, names.index(self.measure)]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for condition in rule:
        out &= condition.holds(x, names)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], most: int) -> Rule:
    """Adds the condition of the highest gain until no good row is covered, or none gains."""
    rule: list[Condition] = []
    held = np.ones(len(x), bool)
    while len(rule) < most and (~bad & held).any():
        p, n = int((bad & held).sum()), int((~bad & held).sum())
        best, best_gain = None, 1e-9
        for k, name in enumerate(names):
            values = x[held, k]
            distinct = np.unique(values)
            cuts = np.unique(np.searchsorted(distinct, np.quantile(values, np.linspace(0, 1, 33)[:-1], method="lower")))
            for threshold in (distinct[cuts[cuts + 1 < len(distinct)]] + distinct[cuts[cuts + 1 < len(distinct)] + 1]) / 2:  # halfway to the next value
                over = values > threshold
                for above in (True, False):
                    side = over if above else ~over
                    pp = int((bad[held] & side).sum())
                    nn = int(side.sum()) - pp
                    if not pp:
                        continue
                    gain = pp * (np.log2(pp / (pp + nn)) - np.log2(p / (p + n)))
                    if gain > best_gain:
                        best, best_gain = Condition(name, above, float(threshold)), gain
        if best is None:
            break
        rule.append(best)
        held &= best.holds(x, names)
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    """Drops final conditions while the rule gets no less exact on rows it was not grown on."""

    def worth(r: Rule) -> float:
        held = covers(r, x, names)
        p, n = int((bad & held).sum()), int((~bad & held).sum())
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn_list(x: np.ndarray, bad: np.ndarray, names: list[str], min_precision: float = 0.9, max_rules: int = 12, max_conditions: int = 4) -> list[Rule]:
    """Ordered rules for what is bad. Every third row prunes, the others grow."""
    pruning = np.arange(len(x)) % 3 == 2
    grow_x, grow_bad, prune_x, prune_bad = x[~pruning], bad[~pruning], x[pruning], bad[pruning]
    rules: list[Rule] = []
    while len(rules) < max_rules and grow_bad.any() and prune_bad.any():
        rule = _prune(_grow(grow_x, grow_bad, names, max_conditions), prune_x, prune_bad, names)
        held = covers(rule, prune_x, names)
        if not rule or not held.any() or prune_bad[held].mean() < min_precision:
            break
        rules.append(rule)
        grow_left, prune_left = ~covers(rule, grow_x, names), ~held
        grow_x, grow_bad, prune_x, prune_bad = grow_x[grow_left], grow_bad[grow_left], prune_x[prune_left], prune_bad[prune_left]
    return rules


def learn_rules(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_rows: int = 20_000, **options,
) -> list[Rule]:
    """The decision list from documents (df) and labels (1 good, 0 bad) with the same ids."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.round(F.avg(label_col)).alias("_good"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)  # so the broadcast has max_rows rows at most
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    names = [*RATIOS]  # counts grow with a text's length, which is no fault
    rows = measure(texts).select("_id", "_good", *names).dropDuplicates(["_id"]).toArrow().to_pandas().sort_values("_id", kind="stable")
    rows = rows.iloc[np.argsort(common.mix(rows["_id"].to_numpy(np.int64).view(_U64)), kind="stable")]
    return learn_list(rows[names].to_numpy(np.float64), (rows["_good"] < 0.5).to_numpy(), names, **options)


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """True for what the list keeps."""
    if not rules:
        return F.lit(True)
    out = None
    for rule in rules:
        test = F.lit(True)
        for condition in rule:
            test = test & condition.column(prefix)
        out = F.when(test, False) if out is None else out.when(test, False)
    return out.otherwise(True)
