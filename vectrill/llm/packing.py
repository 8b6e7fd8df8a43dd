"""Vector best-fit packing of tokenized documents into sequences.

A document is its token ids and an end token; only documents longer than a sequence are cut, into full pieces and a
shorter last one. Pieces are dealt at random into groups of about `group_pieces`, and each group packs its pieces, the
longest first, into bins with three capacities: tokens, documents and attention cost (the sum of squared lengths).
Among the bins where a piece fits every capacity, the one whose residual vector, weighted, is shortest afterwards is
chosen (`rule="norm"`), or the one whose residual points most towards the piece (`rule="dot"`, weighted dot-product).
A group loses at most about one sequence against packing everything together.

Defined cases: null counts as the empty text, which is the end token alone. Ties between bins go to the one opened
first, ties between pieces to the lower id, then the lower piece. Rows that repeat an id are packed each. Extra columns
are ignored. An empty table packs into nothing.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.llm import _common as common

CACHED = 400_000
_U64 = np.uint64
_NO_MERGE = np.int32(1 << 30)
#: Longer words go to the library: the merge table has a column for each byte of its longest word.
_LONGEST = 64
_BETWEEN_SPACES = common.byte_table(lambda b: b not in (0x20, 0x0A))
_ASCII_LETTER = common.byte_table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
_MARK = common.byte_table(lambda b: 0x21 <= b <= 0x7E) & ~_ASCII_LETTER & ~common.byte_table(lambda b: 0x30 <= b <= 0x39)


# --- token ids of a word-end BPE vocabulary -------------------------------------------------


class WordBpe:
    """Ids by the tokenizers library, word by word: with this vocabulary white space only separates. A word of Latin letters
    and ASCII marks after them is the lower-cased letters and the marks; each distinct run of letters is encoded once
    while it is remembered (CACHED and those of one slice at most), all that are missing together, by merging the best pair of every one
    at a time. Marks and all other words are encoded by the library. Words are told apart by 64-bit hashes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        size = max(vocab.values()) + 1
        keys, ranks, new = [], [], []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            keys.append(vocab[a] * size + vocab[b])
            ranks.append(rank)
            new.append(vocab[a + b])
        order = np.argsort(keys)
        self.keys, self.size = np.array(keys)[order], size
        self.ranks, self.new = np.array(ranks, np.int32)[order], np.array(new, np.int32)[order]
        from vectrill.llm.bpe import byte_characters

        self.inner = np.array([vocab.get(c, -1) for c in byte_characters()], np.int32)
        self.final = np.array([vocab.get(c + self.suffix, -1) for c in byte_characters()], np.int32)
        # What is remembered: sorted hashes, their ids as spans of one array, and in how many slices each was met.
        self.hashes, self.ids = np.zeros(0, _U64), np.zeros(0, np.uint32)
        self.at = self.count = self.met = np.zeros(0, np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rank and merged id of pairs of ids; -1 stands for none."""
        pairs = left * np.int64(self.size) + right
        place = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        found = (self.keys[place] == pairs) & (right >= 0)
        return np.where(found, self.ranks[place], _NO_MERGE), np.where(found, self.new[place], -1)

    def _merged(self, data: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of spans of lower-cased letters, about as long as each other: one after the other, and how many each has."""
        wide = int(n.max())
        at = np.arange(wide)[None, :]
        live = at < n[:, None]
        grid = np.full((len(n), wide), -1, np.int32)
        grid[live] = self.inner[data[(start[:, None] + at)[live]]]
        grid[np.arange(len(n)), n - 1] = self.final[data[start + n - 1]]
        rank, new = self._pairs(grid[:, :-1], grid[:, 1:])
        done, open_rows = np.full((len(n), wide), -1, np.int32), np.arange(len(n))
        while rank.shape[1] and len(open_rows):
            best = rank.argmin(axis=1)
            more = rank[np.arange(len(rank)), best] < _NO_MERGE
            if not more.all():  # finished rows leave the grid
                done[open_rows[~more], : grid.shape[1]] = grid[~more]
                grid, rank, new, best, open_rows = grid[more], rank[more], new[more], best[more], open_rows[more]
                if not len(open_rows):
                    break
            rows = np.arange(len(grid))
            grid[rows, best] = new[rows, best]
            # close the gap right of each merged pair, and look up only its two new neighbours
            column = np.arange(grid.shape[1] - 1)[None, :]
            column = column + (column > best[:, None])
            grid = np.take_along_axis(grid, column, axis=1)
            column = np.minimum(column[:, :-1], rank.shape[1] - 1)
            rank, new = np.take_along_axis(rank, column, axis=1), np.take_along_axis(new, column, axis=1)
            for at in (best - 1, best):
                r = np.flatnonzero((at >= 0) & (at < rank.shape[1]))
                c = at[r]
                rank[r, c], new[r, c] = self._pairs(grid[r, c], grid[r, c + 1])
        done[open_rows, : grid.shape[1]] = grid
        found = done >= 0
        return done[found].astype(np.uint32), found.sum(axis=1)

    def _forget(self) -> None:
        """Beyond CACHED, the half that was met in the fewest slices goes."""
        if len(self.hashes) > CACHED:
            keep = np.sort(np.argsort(self.met, kind="stable")[len(self.met) // 2 :])
            self.ids = self.ids[common.spread(self.at[keep], self.count[keep])]
            self.hashes, self.count, self.met = self.hashes[keep], self.count[keep], self.met[keep] // 2
            self.at = np.cumsum(self.count) - self.count

    def _remember(self, hashes: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        at = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids])
        order = np.argsort(hashes)
        to = np.searchsorted(self.hashes, hashes[order])
        self.at, self.count, self.met = (np.insert(x, to, y) for x, y in ((self.at, at[order]), (self.count, count[order]), (self.met, 0)))
        self.hashes = np.insert(self.hashes, to, hashes[order])

    def _unknown(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some hashes: the distinct ones that are not remembered, and where each is first."""
        distinct, first = np.unique(hashes, return_index=True)
        if not len(self.hashes):
            return distinct, first
        new = self.hashes[np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)] != distinct
        return distinct[new], first[new]

    def _learn(self, lower: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Remembers the spans of letters that it lacks."""
        missing, first = self._unknown(hashes)
        n = (end - start)[first]
        for rows in np.array_split(np.argsort(n, kind="stable"), max(1, len(n) // 2048)) if len(n) else []:
            self._remember(missing[rows], *self._merged(lower, start[first[rows]], n[rows]))

    def _ask(self, data: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Remembers the spans that it lacks, as the library encodes them."""
        missing, first = self._unknown(hashes)
        if len(missing):
            texts = [data[a:b].tobytes().decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            got = [x.ids for x in self.library.encode_batch(texts, add_special_tokens=False)]
            self._remember(missing, np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the n + 1 bounds of the texts in them."""
        words = common.Words(texts, _BETWEEN_SPACES, lower=False)
        data, start, end = words.data, words.start, words.end
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(words.counts) + 1, np.int64)
        lower, letter = _folded(data)
        # the last byte of each word that is no mark; before it all must be letters
        core = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))[end - 1] + 1
        core = np.maximum(core, start)
        before = np.concatenate([[0], np.cumsum(letter)])
        simple = (core > start) & (core - start <= _LONGEST) & (before[core] - before[start] == core - start)
        marked = simple & (end > core)
        with np.errstate(over="ignore"):
            key = common.span_hashes(lower, start, np.where(simple, core, end))
            raw_start = np.where(simple, core, start)
            raw = common.span_hashes(data, raw_start, end) ^ _U64(0x5851F42D4C957F2D)  # of marks, or of a whole other word
        key[~simple] = raw[~simple]
        self._forget()  # between slices only, so that a slice finds all that it needs
        self._learn(lower, key[simple], start[simple], core[simple])
        self._ask(data, raw[~simple | marked], raw_start[~simple | marked], end[~simple | marked])
        first = np.searchsorted(self.hashes, key)
        last = np.searchsorted(self.hashes, raw[marked])
        self.met[np.unique(first)] += 1
        self.met[np.unique(last)] += 1
        # each word is its letters' ids and its marks' ids
        at, count = np.zeros((len(start), 2), np.int64), np.zeros((len(start), 2), np.int64)
        at[:, 0], count[:, 0] = self.at[first], self.count[first]
        at[marked, 1], count[marked, 1] = self.at[last], self.count[last]
        ids = self.ids[common.spread(at.ravel(), count.ravel())]
        return ids, np.concatenate([[0], np.cumsum(count.sum(axis=1))])[words.bounds]


def _folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes with Latin capitals made small, and which bytes belong to a Latin letter (A to Z, and U+00C0 to U+00FF but
    for the two signs among them)."""
    lower, letter = common.LOWER[data], _ASCII_LETTER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        second = data[lead + 1]
        lead = lead[(second >= 0x80) & (second != 0x97) & (second != 0xB7)]
        second = data[lead + 1]
        letter[lead] = letter[lead + 1] = True
        lower[lead + 1] = np.where(second < 0x9F, second + 0x20, second)
    return lower, letter


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def pieces(df: DataFrame, vocabulary: str, length: int = 4096, end_token: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 of every document's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(vocabulary)
        for batch in common.slices(batches):
            ids, bounds = encoder.encode(batch.column("text"))
            ids, n = np.insert(ids, bounds[1:], end_token).astype("<u4"), np.diff(bounds) + 1
            cuts = -(-n // length)
            row = np.repeat(np.arange(len(n)), cuts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            size = np.minimum(length, n[row] - piece * length)
            ends, sent = np.cumsum(size) * 4, memoryview(ids.tobytes())
            crc = [zlib.crc32(sent[a:b]) for a, b in zip((ends - 4 * size).tolist(), ends.tolist(), strict=True)]
            columns = [pa.array(piece.astype(np.int32)), pa.array(piece * length), pa.array(size), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), *columns], ["id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32"))])
    return rows.mapInArrow(run, schema)


# --- vector best fit ------------------------------------------------------------------------


@dataclass(frozen=True)
class Capacities:
    """Of one sequence. By default documents and attention never bind before tokens do."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.float64)


def best_fit(lengths: np.ndarray, capacities: Capacities, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths must not increase."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    limit, weight = capacities.vector(), np.array(weights, np.float64)
    left = np.empty((3, max(1, len(lengths))))  # residuals of open bins, by dimension
    used = np.zeros(max(1, len(lengths)), np.int64)  # tokens in each bin
    open_bins = np.zeros(max(1, len(lengths)), np.int64)
    n_open = n_bins = 0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = int(lengths[-1]) if len(lengths) else 0
    for i, length in enumerate(lengths.tolist()):
        size = np.array([length, 1.0, float(length) * length])
        if (size > limit).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        slot = -1
        if n_open:
            rest = left[:, :n_open] - size[:, None]
            fits = (rest >= 0).all(axis=0)
            if fits.any():
                if rule == "norm":
                    value = ((rest / limit[:, None]) ** 2 * weight[:, None]).sum(axis=0)
                else:
                    value = -((left[:, :n_open] / limit[:, None]) * (size / limit * weight)[:, None]).sum(axis=0)
                slot = int(np.where(fits, value, np.inf).argmin())
        if slot < 0:
            slot, n_open = n_open, n_open + 1
            left[:, slot], open_bins[slot], n_bins = limit, n_bins, n_bins + 1
        b = open_bins[slot]
        where[i], offset[i] = b, used[b]
        used[b] += length
        left[:, slot] -= size
        if left[0, slot] < least or left[1, slot] < 1 or left[2, slot] < least * least:  # full: the smallest piece fits no more
            n_open -= 1
            left[:, slot : n_open], open_bins[slot:n_open] = left[:, slot + 1 : n_open + 1].copy(), open_bins[slot + 1 : n_open + 1].copy()
    return where, offset


def pack(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacities: Capacities = Capacities(),
    end_token: int = 1, group_pieces: int = 16_384, rule: str = "norm",
) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = common.materialize(pieces(df, vocabulary, capacities.tokens, end_token, id_col, text_col), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    # By row and not by id, so that repeated ids are dealt out too; the files that are read do not change.
    dealt = cut.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        bins, offset = best_fit(table.column("length").to_numpy(), capacities, rule=rule)
        group = table.column("group").to_numpy()
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(group * (1 << 32) + bins)).append_column("offset", pa.array(offset))

    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.groupBy("group").applyInArrow(run, schema).withColumnRenamed("id", id_col)
