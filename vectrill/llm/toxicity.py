"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, stems (the first bytes of longer words, for endings not seen in learning), word pairs
and pairs that skip one word, hashed to 2**bits slots. FTRL-proximal
keeps a learning rate for each coordinate and its L1 term leaves most weights exactly 0, so that the model is a short
list of (slot, weight) that can be broadcast: at most 2**bits of them.

Learning takes at most `max_rows` labelled documents, those whose ids hash lowest. All tasks make their features, which
are written once; one task runs the online updates over them in that order. It holds them as 32-bit integers; if they are
more than `held_slots`, each epoch is a task of its own that streams them instead, with the same result, so that memory is
bounded however long the texts are. Scoring covers whole texts.

Defined cases: words are runs of digits, a to z (A-Z lower-cased) and characters beyond ASCII. Texts without a word
(null and empty ones too) have no features and take the intercept's score. Labels that are null or belong to no
document teach nothing; an id with several labels takes the highest. Without any label every score is 0. Repeated rows
are scored each; input columns stay, but for those called like an output column.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.llm import _common as common

_U64 = np.uint64

#: Bytes of a stem.
STEM = 4
#: Slots that learning has met, and their two sums.
State = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Model:
    slots: np.ndarray
    weights: np.ndarray
    intercept: float
    bits: int
    empty: bool = False


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of each text, one text after the other, and the texts' offsets."""
    words = common.Words(texts, common.ALNUM, lower=True)
    hashes, text = words.hashes(), words.text_of_word()
    pairs, at_pair = words.grams(hashes, 2)
    skip_at = np.flatnonzero(np.arange(len(hashes)) + 3 <= np.repeat(words.bounds[1:], words.counts))
    with np.errstate(over="ignore"):
        skips = common.mix(hashes[skip_at] * _U64(0xA24BAED4963EE407) + hashes[skip_at + 2])
    stemmed = np.flatnonzero(words.end - words.start > STEM)
    stems = common.span_hashes(words.data, words.start[stemmed], words.start[stemmed] + STEM) ^ _U64(0x5DEECE66D)
    slots = np.concatenate([hashes, stems, pairs, skips]) >> _U64(64 - bits)
    keys = np.sort((np.concatenate([text, text[stemmed], text[at_pair], text[skip_at]]).astype(_U64) << _U64(bits)) | slots)
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    offsets = np.searchsorted(keys, np.arange(len(words.counts) + 1).astype(_U64) << _U64(bits))
    return (keys & _U64((1 << bits) - 1)).astype(np.int32), offsets.astype(np.int64)


class Ftrl:
    """FTRL-proximal for binary features; the intercept has no L1 term."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1, state: State | None = None) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        if state:
            self.z[state[0]], self.n[state[0]] = state[1:]
        self.alpha, self.beta, self.l1, self.l2, self.last = alpha, beta, l1, l2, size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == self.last, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def update(self, slots: np.ndarray, label: int) -> None:
        at = np.append(slots, self.last)
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + gradient**2

    def state(self) -> State:
        """What the coordinates seen so far have gathered."""
        at = np.flatnonzero(self.n)
        return at, self.z[at], self.n[at]


def train(rows: Iterable[tuple[np.ndarray, int]], bits: int, state: State | None = None, **rates) -> Ftrl:
    """One epoch, carried on from a state; slot 2**bits is the intercept."""
    ftrl = Ftrl(1 << bits, state=state, **rates)
    for slots, label in rows:
        ftrl.update(slots, label)
    return ftrl


def learn(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_rows: int = 20_000, bits: int = 20, epochs: int = 4, held_slots: int = 50_000_000, **rates,
) -> Model:
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)  # so the broadcast has max_rows rows at most
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            slots, offsets = features(batch.column("text"), bits)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(slots))], ["_id", "_label", "slots"])

    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("_id", id_type), T.StructField("_label", T.IntegerType()), T.StructField("slots", T.ArrayType(T.IntegerType()))])
    with common.small_batches(df.sparkSession):
        made = common.materialize(texts.mapInArrow(make, schema), "features")
        slots = made.agg(F.sum(F.size("slots").cast("long"))).first()[0] or 0
        state, at_once = None, epochs if slots <= held_slots else 1
        for _ in range(epochs // at_once):
            state = _learnt(made, bits, at_once, state, rates)
    ftrl = Ftrl(1 << bits, state=state, **rates)
    weights = ftrl.weights(np.arange((1 << bits) + 1))
    slots = np.flatnonzero(weights[:-1])
    return Model(slots, weights[slots], float(weights[-1]), bits, empty=not len(state[0]))


def _learnt(made: DataFrame, bits: int, epochs: int, state: State | None, rates: dict) -> State:
    """The state after so many epochs; the rows are held if there are several."""
    sent = made.sparkSession.sparkContext.broadcast(state)  # at most 2**bits + 1 slots

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, list[int]]] = []

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
            for batch in batches:
                lists = batch.column("slots")
                offsets = lists.offsets.to_numpy()
                part = lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0], batch.column("_label").to_pylist()
                if epochs > 1:
                    part = (part[0].copy(), *part[1:])  # so that the batch can go
                    held.append(part)
                yield part

        def rows() -> Iterator[tuple[np.ndarray, int]]:
            for epoch in range(epochs):
                for slots, offsets, labels in held if epoch else parts():
                    for i, label in enumerate(labels):
                        yield slots[offsets[i] : offsets[i + 1]], label

        at, z, n = train(rows(), bits, sent.value, **rates).state()
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (at, z, n)], ["slot", "z", "n"])

    one = made.repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id").mapInArrow(fit, "slot long, z double, n double").toArrow()
    sent.unpersist()
    return tuple(one.column(c).to_numpy() for c in ("slot", "z", "n"))


def score(df: DataFrame, model: Model, text_col: str = "text", score_out: str = "score") -> DataFrame:
    """Adds the probability of the label 1 to every row."""
    keep = df.drop(*[c for c in (score_out,) if c in df.columns and c != text_col])
    sent = df.sparkSession.sparkContext.broadcast(model)  # at most 2**bits weights
    schema = T.StructType([*keep.schema.fields, T.StructField(score_out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        dense = np.zeros(1 << model.bits)
        dense[model.slots] = model.weights
        for batch in common.slices(batches, text_col):
            slots, offsets = features(batch.column(text_col), model.bits)
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            logit = np.clip(np.bincount(text, dense[slots], len(offsets) - 1) + model.intercept, -35, 35)
            value = np.zeros(len(logit)) if model.empty else 1 / (1 + np.exp(-logit))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, score_out])

    return keep.mapInArrow(run, schema)
