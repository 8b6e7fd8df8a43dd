"""Byte-level BPE encoding and decoding of whole texts, from a public vocabulary file.

Encoding: a text is cut into pre-tokens; each is a doubly linked list of symbols and a priority queue of (merge rank,
place). The best merge is taken, neighbours' new merges are queued, and entries whose symbols have changed since are
skipped when they come up. Equal ranks merge from the left. Pre-tokens recur, so each process remembers the encodings of
recent ones (at most twice `CACHED`: once that many are new, those that have not been used since are dropped). Decoding concatenates the vocabulary's strings and reads the
bytes as UTF-8, replacing what is not.

Defined cases: null counts as the empty text and has no tokens; special tokens' strings in a text become their ids, as
the vocabulary's own library does; ids outside the vocabulary decode to nothing. Repeated rows are encoded each. Input
columns stay, but for those called like an output column.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vectrill.llm import _common as common

CACHED = 300_000
_PAIR = 1 << 20

# White space, and the pre-token pattern of the vocabulary's byte-level pre-tokenizer.
_SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_DOUBLE = regex.compile(rf"[{_SPACE}]{{2}}")
_BETWEEN = regex.compile(rf"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Bpe:
    """The vocabulary and merges of a tokenizer file with a byte-level pre-tokenizer."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, characters = spec["model"], byte_characters()
        bytes_of = {c: b for b, c in enumerate(characters)}
        self.vocab: dict[str, int] = model["vocab"]
        self.specials: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.byte_ids = [self.vocab[c] for c in characters]
        self.merges: dict[int, int] = {}  # pair of ids -> rank
        self.merged: list[int] = []  # by rank
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a] * _PAIR + self.vocab[b]] = rank
            self.merged.append(self.vocab[a + b])
        self.first = [[self.merges.get(a * _PAIR + b, -1) for b in self.byte_ids] for a in self.byte_ids]  # ranks of pairs of bytes
        self.strings: dict[int, bytes] = {i: bytes(bytes_of[c] for c in s) for s, i in self.vocab.items() if i not in self.specials.values()}
        self.strings |= {i: s.encode() for s, i in self.specials.items()}
        self.decimals = [str(i) for i in range(max(self.strings) + 1)]
        self.pattern = regex.compile(_PATTERN)
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.known, self.known_before = {}, {}  # pre-token -> ids (32 bits each), and the same from before it was last full
        self.pieces, self.pieces_before = {}, {}

    def merge(self, text: bytes) -> list[int]:
        """The ids of some bytes after all merges, by rising rank, equal ranks from the left."""
        n, get, merged = len(text), self.merges.get, self.merged
        symbols = [self.byte_ids[b] for b in text]
        first = self.first
        # An entry is one integer: rank and place; it is stale if the pair at that place has another rank by now.
        queue = [rank * n + i for i, (a, b) in enumerate(zip(text, text[1:])) if (rank := first[a][b]) >= 0]  # noqa: B905
        if not queue:
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapify(queue)
        while queue:
            rank, i = divmod(heappop(queue), n)
            j = after[i]
            left = symbols[i]
            if j >= n or left < 0 or get(left * _PAIR + symbols[j]) != rank:
                continue
            new = symbols[i] = merged[rank]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := get(new * _PAIR + symbols[k])) is not None:
                    heappush(queue, rank * n + i)
            h = before[i]
            if h >= 0 and (rank := get(symbols[h] * _PAIR + new)) is not None:
                heappush(queue, rank * n + h)
        return [x for x in symbols if x >= 0]

    def pretoken(self, text: str) -> bytes:
        """The ids (32 bits each) of a pre-token."""
        got = self.known.get(text)
        if got is None:
            got = self.known_before.get(text)
            if got is None:
                got = array("i", self.merge(text.encode("utf-8", "replace"))).tobytes()
            if len(text) < 256:
                if len(self.known) >= CACHED:
                    self.known_before, self.known = self.known, {}
                self.known[text] = got
        return got

    def piece(self, text: str) -> bytes:
        """The ids of a stretch of text that pre-tokens do not reach beyond."""
        got = self.pieces_before.get(text)
        if got is None:
            got = b"".join([self.pretoken(t) for t in self.pattern.findall(text)])
        if len(text) < 256:
            if len(self.pieces) >= CACHED:
                self.pieces_before, self.pieces = self.pieces, {}
            self.pieces[text] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        parts = self.special.split(text) if self.special else [text]
        out: list[bytes] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.int32(self.specials[part]).tobytes())
            elif part:
                # A single space between words starts a pre-token, so texts can be cut there before the pattern runs.
                words = _BETWEEN.split(part) if _DOUBLE.search(part) else part.split(" ")
                words[1:] = [f" {w}" for w in words[1:]]
                # In stretches, as the memory is replaced when it is full.
                for at in range(0, len(words), 1000):
                    get, piece = self.pieces.get, self.piece
                    out += [get(w) or piece(w) for w in words[at : at + 1000]]
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        get = self.strings.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One vocabulary a process and file."""
    return Bpe(path)


def encode_batches(batches: Iterator[pa.RecordBatch], vocabulary: str, text_col: str, ids_out: str) -> Iterator[pa.RecordBatch]:
    bpe = load(vocabulary)
    for batch in common.slices(batches, text_col):
        got = [bpe.encode(x or "") for x in batch.column(text_col).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got)))], [*batch.schema.names, ids_out])


def decode_batches(batches: Iterator[pa.RecordBatch], vocabulary: str, ids_col: str, text_out: str) -> Iterator[pa.RecordBatch]:
    bpe = load(vocabulary)
    for batch in batches:
        lists = batch.column(ids_col)
        values, offsets = lists.flatten().to_numpy(zero_copy_only=False).tolist(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        texts = [bpe.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_out])


def _added(df: DataFrame, of: str, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    keep = df.drop(*[c for c in (name,) if c in df.columns and c != of])
    return keep, T.StructType([*keep.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_out: str = "ids") -> DataFrame:
    """Adds the token ids of each text."""
    keep, schema = _added(df, text_col, ids_out, T.ArrayType(T.IntegerType()))
    return keep.mapInArrow(lambda batches: encode_batches(batches, vocabulary, text_col, ids_out), schema)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", text_out: str = "decoded") -> DataFrame:
    """Adds the text that each list of ids stands for."""
    keep, schema = _added(df, ids_col, text_out, T.StringType())
    return keep.mapInArrow(lambda batches: decode_batches(batches, vocabulary, ids_col, text_out), schema)


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass and keeps digests only."""
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decode_batches(encode_batches(batches, vocabulary, "text", "ids"), vocabulary, "ids", "decoded"):
            lists, decimal = batch.column("ids"), load(vocabulary).decimals.__getitem__
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            ids = [sha256(",".join(map(decimal, values[a:b].tolist())).encode()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            decoded = [sha256(x.encode()).hexdigest() for x in batch.column("decoded").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(ids), pa.array(decoded)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return rows.mapInArrow(run, schema)
