"""Language-model scores by logistic context mixing.

A text (A-Z lower-cased) is a sequence of segments: words, the white space between them, and an end.

Bits. Each segment is coded bit by bit: before each byte a flag says whether one follows, then come its 8 bits. Every bit is
predicted from hashed contexts (the last 0 to 4 bytes of the segment, and all of it so far); the predictions' logits are
mixed by weights that a gate selects, from how often the longest contexts were seen and which bit is coded, and the mix is
refined by an adaptive map of what came true at about that probability. Weights and map are learnt online: each task steps
through its segments in small batches, always predicting before it learns, with the segment's own occurrence left out of
the counts and each segment weighing as often as it occurs; the tasks' weights are averaged, their maps summed.

Spans. Contexts that cross white space come from a match model. After any `context_words` words whose hash ends in
`span_bits` zero bits a span begins (so of about 2**span_bits words, at the same places in equal passages), up to the next
such place. Where the words before a span were seen in learning, one more bit says whether the span is the one that most
often followed them; if so, that is all that is coded of it. This bit's probability is learnt for each pair of counts of
the two most frequent spans. A document that is learnt from is scored with its own occurrence left out of these counts, or
every text would predict itself.

Bits of a segment do not depend on other segments, so the mixer is run once for each distinct segment, however large the
corpus: counts of distinct segments (a pre-aggregated sum over all documents) are both its training set and what it scores.
The counts grow with the corpus. Those of the whole segment so far are exact: segments are dealt by their first four
bytes, so a task has all that share a longer prefix; a shorter prefix is the same as the context of four bytes. The
other orders have at least two slots for each distinct bit context of the corpus, up to 2**`most_bits` slots, and are
broadcast. Segments that make up at least 1/`common_parts` of all are at most `common_parts` in number and are broadcast
too, as are the span contexts of that share; the others reach their documents through joins.

Defined cases: null and empty texts consist of the end alone. Repeated rows are scored each. Extra columns are ignored.
With nothing to learn from, every bit has probability 1/2. Words are `[^\\x20\\x09-\\x0D]+`. Segments, contexts and spans
are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.llm import _common as common

_U64 = np.uint64
#: Bytes of context; the last is the whole segment so far.
ORDERS = (0, 1, 2, 3, 4, None)
_WORD, _SPACE = b"W", b"S"
_HELD, _SENT = 400_000, 50_000
_BATCH = 500
_GATES = 12 * 4 * 9
_W, _S = 0x57, 0x53
_MARKED = np.zeros(256, _U64)
_MARKED[[_W, _S]] = 0x8CB92BA72F3D8DD7, 0x2545F4914F6CDD1D
_LAST = _U64(0x9E6C63D0876A9A47)


def _key_hash(hashes: np.ndarray, mark: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return common.mix(hashes + _MARKED[mark])


class Parsed:
    """The segments and spans of some texts.

    A key is W and what comes at the start or after white space, or S and what comes after a word; W or S alone is the
    end. Single spaces after a word are only counted (`singles`, by span); of all other segments there are hash, mark,
    start and end (in data), token (a word or an end) and span. `head` has each text's first span, `text` each span's
    text, `context` the hash of the words before (0 for a first span) and `whole` that of all that is in it.
    """

    def __init__(self, texts: pa.Array, context_words: int, span_bits: int) -> None:
        words = common.Words(texts, common.SPACED, lower=True)
        data, start, end, bounds, offsets = words.data, words.start, words.end, words.bounds, words.offsets
        n_texts, text, some = len(offsets) - 1, words.text_of_word(), words.counts > 0
        last = np.zeros(len(start), bool)
        last[bounds[1:][some] - 1] = True
        after = np.append(start[1:], 0)
        after[last] = offsets[1:][some]
        gap = after - end
        single = gap == 1
        single[single] = data[end[single]] == 0x20
        odd = np.flatnonzero((gap > 0) & ~single)
        first = np.where(some, start[np.minimum(bounds[:-1], max(0, len(start) - 1))] if len(start) else 0, offsets[1:])
        lead = np.flatnonzero(first > offsets[:-1])

        word_hash, odd_hash = words.hashes(), common.span_hashes(data, end[odd], after[odd])
        unit = np.zeros(len(start), _U64)
        unit[single] = 1
        unit[odd] = odd_hash
        unit[last] ^= _LAST
        with np.errstate(over="ignore"):
            unit = common.mix(word_hash * _U64(0xD6E8FEB86659FD93) + unit)
        at = np.flatnonzero(np.arange(len(start)) - context_words >= np.repeat(bounds[:-1], words.counts))
        seen = common.run_hashes(unit, at - context_words, at)
        chosen = seen & _U64((1 << span_bits) - 1) == 0
        anchor = np.zeros(len(start), bool)
        anchor[at[chosen]] = True
        anchors = np.concatenate([[0], np.cumsum(anchor)])
        self.head = np.arange(n_texts) + anchors[bounds[:-1]]
        of_word = text + anchors[1:]
        spans = n_texts + int(anchors[-1])
        self.text = np.repeat(np.arange(n_texts), np.diff(np.append(self.head, spans)))
        self.context = np.zeros(spans, _U64)
        self.context[of_word[at[chosen]]] = seen[chosen]
        n_words = np.bincount(of_word, minlength=spans)
        to = np.cumsum(n_words)
        self.whole = common.run_hashes(unit, to - n_words, to)
        self.singles = np.bincount(of_word[single], minlength=spans)

        final = np.append(self.head[1:], spans) - 1
        ends_word = np.zeros(n_texts, bool)
        ends_word[text[last & (gap == 0)]] = True
        lead_hash = common.span_hashes(data, offsets[:-1][lead], first[lead])
        none = np.zeros(n_texts, np.int64)
        self.data, self.size = data, np.diff(offsets)
        self.start = np.concatenate([start, end[odd], offsets[:-1][lead], none])
        self.end = np.concatenate([end, after[odd], first[lead], none])
        self.mark = np.concatenate([np.full(len(start), _W), np.full(len(odd), _S), np.full(len(lead), _W), np.where(ends_word, _S, _W)]).astype(np.uint8)
        self.token = np.repeat([True, False, True], [len(start), len(odd) + len(lead), n_texts])
        self.span = np.concatenate([of_word, of_word[odd], self.head[lead], final])
        self.hash = _key_hash(np.concatenate([word_hash, odd_hash, lead_hash, common.span_hashes(data, none, none)]), self.mark)

    def keys(self, at: np.ndarray) -> pa.Array:
        size = (self.end - self.start)[at] + 1
        ends = np.cumsum(size)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        inner = np.ones(len(out), bool)
        inner[ends - size] = False
        out[~inner], out[inner] = self.mark[at], self.data[common.spread(self.start[at], size - 1)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(out)]).cast(pa.binary())


def key_hashes(keys: pa.Array) -> np.ndarray:
    data, offsets = common.text_bytes(_as_text(keys))
    return _key_hash(common.span_hashes(data, offsets[:-1] + 1, offsets[1:]), data[offsets[:-1]])


_SINGLE = b"S "
_SINGLE_HASH = _key_hash(common.span_hashes(np.array([0x20], np.uint8), np.array([0]), np.array([1])), _S)[0]


def _is_word() -> Column:
    """Of a key: a word."""
    return F.expr("substring(key, 1, 1) = X'57' and octet_length(key) > 1 and not (hex(substring(key, 2, 1)) in ('20', '09', '0A', '0B', '0C', '0D'))")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of the segments; n counts texts that are learnt from."""
    held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def out() -> Iterator[pa.RecordBatch]:
        hashes, index, inverse = np.unique(np.concatenate([h for h, _, _ in held]), return_index=True, return_inverse=True)
        n = np.bincount(inverse, np.concatenate([n for _, n, _ in held]), len(hashes)).astype(np.int64)
        keys = pa.chunked_array([k for _, _, k in held]).take(pa.array(index)).combine_chunks()
        held.clear()
        whole = pa.RecordBatch.from_arrays([keys, pa.array(n)], ["key", "n"])
        for at in range(0, len(n), _SENT):
            yield whole.slice(at, _SENT)

    for batch in common.slices(batches, most=common.SLICE_BYTES // 2):
        parsed = Parsed(batch.column("text"), 1, 64)
        learn = batch.column("learn").to_numpy(zero_copy_only=False)[parsed.text]
        hashes, index, inverse = np.unique(parsed.hash, return_index=True, return_inverse=True)
        held.append((hashes, np.bincount(inverse, learn[parsed.span], len(hashes)), parsed.keys(index)))
        singles = np.array([parsed.singles[learn].sum()], np.float64)
        held.append((np.array([_SINGLE_HASH]), singles, pa.array([_SINGLE], pa.binary())))
        if sum(len(h) for h, _, _ in held) > _HELD:
            yield from out()
    if held:
        yield from out()
    common.release()


# --- the model ------------------------------------------------------------------------------


@dataclass
class Bits:
    """The coded bits of some segments: slots[order, bit], the bit, which segment, which of the 9 kinds (flag, 8 bits), and
    the place, one before each byte and one at each end."""

    slots: np.ndarray
    bit: np.ndarray
    segment: np.ndarray
    kind: np.ndarray
    place: np.ndarray


_NODE = np.uint32(0x9E3779B1)
_SHIFTS = np.arange(8)
_VALUES = np.arange(256)[:, None]
#: By byte (256: the end) and kind: where the bit is in the tree of a context's bits, spread over 32 bits; and the bit.
_NODES = np.concatenate([np.concatenate([np.zeros((256, 1), np.int64), (1 << _SHIFTS) | (_VALUES >> (8 - _SHIFTS))], axis=1), np.zeros((1, 9), np.int64)]).astype(np.uint32).ravel() * _NODE
_BITS = np.concatenate([np.concatenate([np.ones((256, 1), np.int64), (_VALUES >> (7 - _SHIFTS)) & 1], axis=1), np.zeros((1, 9), np.int64)]).astype(np.int8).ravel()


@dataclass
class Places:
    """The places of some segments: which segment, where its mark is, the byte (256: the end), and contexts[order, place];
    whole: 64 bits of the whole segment so far."""

    of: np.ndarray
    first: np.ndarray
    at: np.ndarray
    value: np.ndarray
    contexts: np.ndarray
    whole: np.ndarray


def places(keys: pa.Array) -> Places:
    data, offsets = common.text_bytes(_as_text(keys))
    n, seg = np.diff(offsets) - 1, np.arange(len(offsets) - 1)  # bytes without the mark
    of = np.repeat(seg, n + 1)  # for each place a flag, and a byte unless it is the last
    first = offsets[:-1][of]
    # Places and bytes with the mark are as many: place j stands before byte j + 1, and the last of a segment before its end.
    at = np.arange(1, len(of) + 1)
    more = at < offsets[1:][of]
    value = np.full(len(at), 256, np.int64)
    value[more] = data[at[more]]
    contexts = np.empty((len(ORDERS), len(at)), np.uint32)
    packed = np.zeros(len(at), _U64)  # the last bytes, 9 bits each
    with np.errstate(over="ignore"):
        for k, order in enumerate(ORDERS):
            if order is None:
                hashed = whole = common.span_hashes(data, first, at) + _U64(2 * k + 3)
            else:
                if order:
                    # beyond the mark nothing: the byte before the segment counts as 256
                    previous = np.where(at - order >= first, data[np.maximum(at - order, 0)], 256)
                    packed |= previous.astype(_U64) << _U64(9 * (order - 1))
                hashed = packed + (_U64(order + 1) << _U64(40))
            contexts[k] = common.mix(hashed) >> _U64(32)
    return Places(of, first, at, value, contexts, whole)


def coded(keys: pa.Array, table_bits: int | list[int]) -> Bits:
    """table_bits: of all orders, or of each."""
    p = places(keys)
    repeats = np.where(p.value < 256, 9, 1)
    starts = np.cumsum(repeats) - repeats
    kind = np.arange(starts[-1] + repeats[-1] if len(starts) else 0) - np.repeat(starts, repeats)
    place = np.repeat(np.arange(len(p.of)), repeats)
    row = p.value[place] * 9 + kind
    with np.errstate(over="ignore"):
        slots = np.repeat(p.contexts, repeats, axis=1)
        slots += _NODES[row]
        slots >>= (32 - np.broadcast_to(table_bits, len(ORDERS))).astype(np.uint32)[:, None]
    return Bits(slots, _BITS[row], p.of[place], kind, place)


def _as_text(keys: pa.Array) -> pa.Array:
    """The same bytes as a string column, unchecked."""
    keys = keys.cast(pa.large_binary())
    return pa.LargeStringArray.from_buffers(len(keys), keys.buffers()[1], keys.buffers()[2], keys.buffers()[0], keys.null_count, keys.offset)


#: Added to the counts of a bit's two values: small, as most contexts have seen one value only.
_ADDED = np.float32(0.02)


def _stretch(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.log((one + _ADDED) / (zero + _ADDED))


def _longest(seen: np.ndarray) -> np.ndarray:
    return np.minimum(11, np.log2(np.maximum(0, seen) + 1)).astype(np.int16) * np.int16(36)


@dataclass
class Logits:
    """Of counts, once for all slots: the logits [order][slot], or [order][2 slot + bit] if occurrences are left out; and
    two summands of the gate by slot, from how often the context of three bytes and that of the last order were seen."""

    logit: list[np.ndarray]
    middle: np.ndarray
    longest: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray | list | Logits, left_out: float) -> Logits:
        """left_out occurrences of the bit itself are taken off the counts [bit][order][slot]."""
        if isinstance(counts, Logits):
            return counts
        off, logit = np.float32(left_out), []
        for zero, one in zip(counts[0], counts[1], strict=True):
            if left_out:
                own = np.empty(2 * len(zero), np.float32)
                own[0::2] = _stretch(np.maximum(0, zero - off), one)
                own[1::2] = _stretch(zero, np.maximum(0, one - off))
            else:
                own = _stretch(zero, one).astype(np.float32)
            logit.append(own)
        middle = np.log2(np.maximum(0, counts[0][3] + counts[1][3] - off) + 1)
        return cls(logit, np.minimum(3, middle / 3).astype(np.int16) * np.int16(9), _longest(counts[0][-1] + counts[1][-1] - off))


@dataclass
class Prefixes:
    """Logits and gate summands [pair, kind] of the whole segment so far, by the pair of context and byte that each place
    has; early: places whose context is four bytes or less, which other tasks have seen too."""

    pair: np.ndarray
    early: np.ndarray
    logit: np.ndarray
    longest: np.ndarray

    @classmethod
    def of(cls, keys: pa.Array, number: np.ndarray, left_out: float) -> Prefixes:
        """From exact counts over all segments that share their first four bytes; keys has all of them."""
        p = places(keys)
        with np.errstate(over="ignore"):
            _, index, pair = np.unique(common.mix(p.whole + p.value.astype(_U64) * _U64(0xD6E8FEB86659FD93)), return_index=True, return_inverse=True)
            row = (p.value[index][:, None] * 9 + np.arange(9)).ravel()
            nodes = np.repeat(common.mix(p.whole[index]), 9) + common.mix(_NODES[row].astype(_U64))
        n = np.repeat(np.bincount(pair, number[p.of], len(index)), 9)
        n.reshape(-1, 9)[p.value[index] == 256, 1:] = 0  # an end has a flag only
        bit = _BITS[row]
        node = np.unique(nodes, return_inverse=True)[1]
        zero, one = np.bincount(node, n * (1 - bit))[node], np.bincount(node, n * bit)[node]
        zero, one = np.maximum(0, zero - left_out * (bit == 0)), np.maximum(0, one - left_out * (bit == 1))
        return cls(pair, p.at - p.first <= 4, _stretch(zero, one).astype(np.float32), _longest(zero + one))

    def cut(self, start: int, end: int) -> Prefixes:
        return Prefixes(self.pair[start:end], self.early[start:end], self.logit, self.longest)


def _inputs(bits: Bits, counts: np.ndarray | Logits, left_out: float, whole: Prefixes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all orders and a constant, and the gate; see Logits. The last order is looked up in whole, if that is given."""
    table = Logits.of(counts, left_out)
    x = np.empty((len(ORDERS) + 1, len(bits.bit)), np.float32)
    x[-1] = 0.3
    for k in range(len(table.logit)):
        slots = bits.slots[k].astype(np.intp)
        if k == 3:
            middle = table.middle[slots]
        if k == len(table.logit) - 1:
            longest = table.longest[slots]
        if left_out:
            slots += slots
            slots += bits.bit
        np.take(table.logit[k], slots, out=x[k], mode="clip")
    if whole is not None:
        at, early = whole.pair[bits.place] * 9 + bits.kind, whole.early[bits.place]
        x[k + 1] = np.where(early, x[k], whole.logit[at])
        longest = np.where(early, longest, whole.longest[at])
    return x, longest + middle + bits.kind


def start_weights() -> np.ndarray:
    """[gate, order]: the whole segment so far counts the more the oftener it was seen; of the others the longest count most."""
    whole = np.minimum(1.0, np.arange(12) / 4)  # by the binary logarithm of how often
    rest = (1 - whole)[:, None] * np.array([0.05, 0.1, 0.15, 0.25, 0.45])
    return np.repeat(np.column_stack([rest, whole, np.zeros(12)]), _GATES // 12, axis=0)


def _mixed(x: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape[1], np.float32)
    for inputs, weight in zip(x, weights.T.astype(np.float32), strict=True):
        out += inputs * weight[gate]
    return np.clip(out, -30, 30).astype(np.float64)


#: The refining map: for each gate's first summand and kind, logits from -_REACH to _REACH in steps of 1/2.
_REACH, _STEPS = 8, 33
_MAPS = 12 * 9


def _buckets(z: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of mixed logits: the place in the map below, and how far they are towards the next one."""
    at = np.clip((z + _REACH) * 2, 0, _STEPS - 1.001)
    low = at.astype(np.int64)
    return (gate // 36 * 9 + gate % 9) * _STEPS + low, at - low


def map_logits(came: np.ndarray) -> np.ndarray:
    """The map's logits from [zeros and ones][place]; places hardly met keep their own."""
    own = np.tile(np.linspace(-_REACH, _REACH, _STEPS), _MAPS)
    p = 1 / (1 + np.exp(-own))
    return np.log((came[1] + 16 * p) / (came[0] + 16 * (1 - p)))


def _refined(z: np.ndarray, gate: np.ndarray, refine: np.ndarray | None) -> np.ndarray:
    """The mean of a mixed logit and what the map makes of it."""
    if refine is None:
        return z
    place, part = _buckets(z, gate)
    return np.where(np.abs(z) < _REACH, (z + refine[place] * (1 - part) + refine[place + 1] * part) / 2, z)


def learn_weights(
    batches: Iterator[tuple[pa.Array, np.ndarray, Prefixes | None]], counts: np.ndarray | Logits, table_bits: int | list[int], rate: float = 0.3
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Online: predict a small batch, then step down its gradient, over the inputs' mean squares. Returns the weights, how
    much each gate has seen, and what came in each place of the map."""
    weights, seen, counts, came = start_weights(), np.zeros(_GATES), Logits.of(counts, 1.0), np.zeros((2, _MAPS * _STEPS))
    for keys, number, whole in batches:
        bits = coded(keys, table_bits)
        x, gate = _inputs(bits, counts, 1.0, whole)
        share = number.astype(np.float64)[bits.segment]
        z = _mixed(x, gate, weights)
        error = (bits.bit - 1 / (1 + np.exp(-z))) * share
        total = np.bincount(gate, share, _GATES)
        place, part = _buckets(z, gate)
        for bit in (0, 1):
            own = np.where(bits.bit == bit, share, 0.0)
            came[bit] += np.bincount(place, own * (1 - part), _MAPS * _STEPS) + np.bincount(place + 1, own * part, _MAPS * _STEPS)
        size = np.bincount(gate, share * np.square(x).sum(axis=0), _GATES) / np.maximum(total, 1) + 1
        for k in range(len(x)):
            weights[:, k] += rate * np.bincount(gate, error * x[k], _GATES) / np.maximum(total, 1) / size
        seen += total
    return weights, seen, came


def log10_probability(
    keys: pa.Array, counts: np.ndarray | Logits, weights: np.ndarray, table_bits: int | list[int], whole: Prefixes | None = None, refine: np.ndarray | None = None
) -> np.ndarray:
    bits = coded(keys, table_bits)
    x, gate = _inputs(bits, counts, 0.0, whole)
    z = _refined(_mixed(x, gate, weights), gate, refine)
    wrong = np.where(bits.bit == 1, -z, z)  # within 30 of 0
    return -np.bincount(bits.segment, np.log1p(np.exp(wrong)), len(keys)) / np.log(10)


def _cut(batches: Iterator[pa.RecordBatch], learn: bool) -> Iterator[pa.RecordBatch]:
    """Small batches; longer segments come in smaller ones."""
    for batch in batches:
        if learn:
            batch = batch.filter(pc.greater(batch.column("n"), 0))
        size = np.cumsum(pc.binary_length(batch.column("key")).to_numpy(zero_copy_only=False).astype(np.int64)) if batch.num_rows else []
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, min(at + _BATCH, int(np.searchsorted(size, base + 12 * _BATCH, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def _dealt(tokens: DataFrame) -> DataFrame:
    """Segments that share their first four bytes in one task, one after the other; these groups in no order, so that online
    learning does not drift through the alphabet."""
    group = F.expr("substring(key, 1, 5)")
    return tokens.select("key", "n").repartition(group).sortWithinPartitions(F.xxhash64(group), group)


def _with_prefixes(batches: Iterator[pa.RecordBatch], learn: bool, left_out: float, most: int = 4_000) -> Iterator[tuple[pa.RecordBatch, Prefixes]]:
    """Small batches of dealt segments and the counts of their prefixes."""

    def wholes() -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch.filter(pc.greater(batch.column("n"), 0)) if learn else batch)
            if sum(b.num_rows for b in held) >= most:
                some = pa.concat_batches(held)
                first = pc.binary_slice(some.column("key"), 0, 5)
                end = int(np.argmax(pc.equal(first, first[-1]).to_numpy(zero_copy_only=False)))
                if end:
                    yield some.slice(0, end)
                held = [some.slice(end)]
        if held:
            yield pa.concat_batches(held)

    for batch in wholes():
        if not batch.num_rows:
            continue
        batch = batch.take(pa.array(np.random.default_rng(1).permutation(batch.num_rows)))
        prefixes, at = Prefixes.of(batch.column("key"), batch.column("n").to_numpy(), left_out), 0
        for part in _cut(iter([batch]), learn=False):
            size = int(pc.sum(pc.binary_length(part.column("key"))).as_py())
            yield part, prefixes.cut(at, at + size)
            at += size


_PENDING = 1_500_000


def context_counts(tokens: DataFrame, least_bits: int, most_bits: int = 32) -> tuple[list[list[np.ndarray]], list[int]]:
    """[bit][order][slot]: how often each bit was seen after the last 0 to 4 bytes, over all segments; and each order's
    table_bits: slots are at least twice as many as the distinct bit contexts, up to 2**most_bits."""
    orders = len(ORDERS) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, numbers, pending = [], [], 0

        def out() -> pa.RecordBatch:
            pair, at = np.unique(np.concatenate(pairs), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.bincount(at, np.concatenate(numbers)).astype(np.int64))], ["pair", "n"])

        for batch in _cut(batches, learn=True):
            p = places(batch.column("key"))
            pairs += [(k << 41) | (p.contexts[k].astype(np.int64) << 9) | p.value for k in range(orders)]
            numbers += [batch.column("n").to_numpy()[p.of]] * orders
            pending += orders * len(p.of)
            if pending > _PENDING:
                yield out()
                pairs, numbers, pending = [], [], 0
        if pairs:
            yield out()
        del pairs, numbers
        common.release()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        pair, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("pair", "n"))
        for k in range(orders):
            own = pair >> 41 == k
            value, n_own = pair[own] & 511, n[own]
            repeats = np.where(value < 256, 9, 1)
            kind = np.arange(repeats.sum()) - np.repeat(np.cumsum(repeats) - repeats, repeats)
            row, weight = np.repeat(value, repeats) * 9 + kind, np.repeat(n_own, repeats)
            with np.errstate(over="ignore"):
                node, at = np.unique(np.repeat((pair[own] >> 9 & 0xFFFFFFFF).astype(np.uint32), repeats) + _NODES[row], return_inverse=True)
            if len(node):
                bit = _BITS[row]
                data = [node.tobytes(), np.bincount(at, weight * (1 - bit)).tobytes(), np.bincount(at, weight * bit).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(node)], pa.int64()), *(pa.array([x], pa.binary()) for x in data)], ["order", "nodes", "node", "zero", "one"])
        held.clear()
        common.release()

    pairs = tokens.select("key", "n").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    nodes = common.materialize(pairs.repartition(F.expr("pair >> 9")).mapInArrow(expand, "order int, nodes long, node binary, zero binary, one binary"), "contexts")
    distinct = {r["order"]: r["n"] for r in nodes.groupBy("order").agg(F.sum("nodes").alias("n")).collect()}
    bits = [min(most_bits, max(least_bits, (2 * distinct.get(k, 0)).bit_length())) for k in range(orders)]
    tables: list[list[np.ndarray]] = [[], []]
    for k in range(orders):
        sums = np.zeros((2, 1 << bits[k]))
        for row in nodes.where(F.col("order") == k).select("node", "zero", "one").toLocalIterator():
            slot = np.frombuffer(row["node"], np.uint32) >> np.uint32(32 - bits[k])
            for x, c in zip(sums, ("zero", "one"), strict=True):
                np.add.at(x, slot, np.frombuffer(row[c]))
        for table, x in zip(tables, sums, strict=True):
            table.append(x.astype(np.float32))
    common.discard(nodes)
    return tables, [*bits, 32]


#: Counts of spans are told apart up to this.
_STATES = 20


def _span_rows(known: np.ndarray, facts: np.ndarray, context_words: int, span_bits: int, base_unit: float, end_n: int):
    """Of each span of the texts: its sums over common segments (known: their sorted hashes; facts: n and log10_p), and its
    other segments as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (often_n, often_p) = known.value, facts.value
        single = _found(hashes, np.array([_SINGLE_HASH]))[0]
        for batch in common.slices(batches, most=common.SLICE_BYTES // 4):
            p = Parsed(batch.column("text"), context_words, span_bits)
            spans, ending = len(p.text), p.end == p.start
            at = _found(hashes, p.hash)
            found = at >= 0
            total = lambda some, weight=None, of=p.span, spans=spans: np.bincount(of[some], weight, spans)
            word = found & p.token & ~ending
            n_known = total(word, often_n[at[word]] > 0) + total(ending) * (end_n > 0)
            base = total(word, np.log10(often_n[at[word]] + 0.1) - base_unit) + total(ending) * (np.log10(end_n + 0.1) - base_unit)
            value = total(found, often_p[at[found]]).astype(np.float64)
            # the other segments, once for each span
            span, hashed, number = p.span[~found], p.hash[~found], np.ones((~found).sum(), np.int64)
            if single >= 0:
                value += p.singles * often_p[single]
            else:
                some = np.flatnonzero(p.singles)
                span, hashed, number = np.append(span, some), np.append(hashed, np.full(len(some), _SINGLE_HASH)), np.append(number, p.singles[some])
            order = np.lexsort((hashed, span))
            span, hashed, number = span[order], hashed[order], number[order]
            first = np.flatnonzero(np.append(True, (span[1:] != span[:-1]) | (hashed[1:] != hashed[:-1]))[: len(span)])
            number = np.add.reduceat(number, first) if len(first) else number
            bounds = pa.array(np.searchsorted(span[first], np.arange(spans + 1)).astype(np.int32))
            size = np.zeros(spans, np.int64)
            size[p.head] = p.size
            # what does not depend on spans stands at the first one
            n_known, base = (np.bincount(p.head[p.text], x, spans) for x in (n_known, base))
            text, rest = pa.array(p.text), pa.ListArray.from_arrays(bounds, pa.array(hashed[first].view(np.int64)))
            place = pa.array((np.arange(spans) - p.head[p.text]).astype(np.int32))
            columns = [
                batch.column("row").take(text), place, batch.column("id").take(text), batch.column("learn").take(text), pa.array(p.context.view(np.int64), mask=p.context == 0), pa.array(p.whole.view(np.int64)),
                pa.array(total(p.token)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(value), pa.array(size), rest, pa.ListArray.from_arrays(bounds, pa.array(number)),
            ]
            yield pa.RecordBatch.from_arrays(columns, _SPAN_COLUMNS)
        common.release()

    return run


_SPAN_COLUMNS = ["row", "place", "id", "learn", "context", "span", "n_tokens", "n_known", "base", "value", "size", "rest", "rest_n"]


def _found(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The places of wanted hashes among sorted ones, or -1."""
    if not len(hashes):
        return np.full(len(wanted), -1)
    distinct, inverse = np.unique(wanted, return_inverse=True)
    at = np.minimum(np.searchsorted(hashes, distinct), len(hashes) - 1)
    return np.where(hashes[at] == distinct, at, -1)[inverse]


def matched(spans: DataFrame, common_parts: int) -> DataFrame:
    """Of the spans (row, place, learn, context, span) whose context was seen: hit (is it the one that most often follows),
    and the two counts `most` and `other` of that and the next span, up to _STATES. The own occurrence of a span learnt
    from is left out."""
    pairs = common.materialize(spans.groupBy("context", "span").agg(F.count(F.when(F.col("learn"), 1)).alias("n"), F.count("*").alias("spans")), "pairs")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    ranked = pairs.withColumn("k", F.row_number().over(Window.partitionBy("context").orderBy(F.desc("n"), "span"))).where("k <= 2")
    # a context that a single span follows, its own, tells nothing
    best = ranked.groupBy("context").agg(
        F.sum("spans").alias("spans"),
        F.max(F.when(F.col("k") == 1, F.col("span"))).alias("span_1"), F.max(F.when(F.col("k") == 1, F.col("n"))).alias("n_1"),
        F.max(F.when(F.col("k") == 2, F.col("span"))).alias("span_2"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("n"))), F.lit(0)).alias("n_2"),
    )
    best = common.materialize(best.where("spans > 1 and n_1 > 0").drop("spans"), "contexts")
    common.discard(pairs)
    often = F.col("n_1") * common_parts >= total  # of common_parts contexts at most
    names = ("span_1", "n_1", "span_2", "n_2")
    sent = best.where(often).select("context", *(F.col(c).alias(f"_{c}") for c in names))
    # a row that the broadcast has answered needs no partner: it gets a key that none has
    joined = spans.join(F.broadcast(sent), "context", "left")
    key = F.when(F.col("_n_1").isNull(), F.col("context"))
    joined = joined.withColumn("_key", F.coalesce(key, F.xxhash64("row", "span"))).withColumn("_open", key.isNotNull())
    rare = best.where(~often).withColumnRenamed("context", "_key")
    joined = joined.join(rare, "_key", "left")
    one, n_one, two, n_two = (F.coalesce(F.col(f"_{c}"), F.when(F.col("_open"), F.col(c))) for c in names)
    own = F.coalesce(F.col("learn"), F.lit(False))
    joined = joined.withColumns({"_a": one, "_b": two, "_m": n_one - (own & (F.col("span") == one)).cast("int"), "_o": n_two - F.coalesce(own & (F.col("span") == two), F.lit(False)).cast("int")})
    most, other = F.greatest("_m", "_o"), F.least("_m", "_o")
    hit = F.when(most > 0, F.col("span") == F.when(F.col("_o") > F.col("_m"), F.col("_b")).otherwise(F.col("_a")))
    joined = joined.withColumns({"hit": hit, "most": F.least(most, F.lit(_STATES)).cast("int"), "other": F.least(other, F.lit(_STATES)).cast("int")})
    flags = common.materialize(joined.where("hit is not null").select("row", "place", "learn", "hit", "most", "other"), "flags")
    common.discard(best)
    return flags


def _gathered(
    df: DataFrame, learn_from: Column, id_col: str, text_col: str, table_bits: int, most_bits: int, common_parts: int, context_words: int, span_bits: int
) -> tuple[DataFrame, DataFrame, DataFrame, int, float]:
    """All spans of the texts, the distinct segments with their scores, the spans whose context was seen (see matched), how
    many tokens were learnt from, and the logarithm of what the base divides by."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learn_from, F.lit(False)).alias("learn"))
    counted = docs.select("text", "learn").mapInArrow(_count, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    tokens = common.materialize(counted, "segments")
    end = F.expr("octet_length(key) = 1")
    facts = tokens.agg(
        F.sum(F.when(_is_word() | end, F.col("n")).otherwise(0)).alias("total"), F.count(F.when(_is_word() & (F.col("n") > 0), 1)).alias("words"),
        F.coalesce(F.max(F.when(end & (F.col("n") > 0), 1)), F.lit(0)).alias("ends"), F.sum("n").alias("all"), F.sum(F.when(end, F.col("n")).otherwise(0)).alias("end_n"),
    ).first()
    total, distinct, all_segments, end_n = facts["total"] or 0, facts["words"] + facts["ends"], facts["all"] or 0, facts["end_n"] or 0
    base_unit = float(np.log10(total + 0.1 * (distinct + 1)))

    counts, order_bits = context_counts(tokens, table_bits, most_bits)
    left_out = spark.sparkContext.broadcast(Logits.of(counts, 1.0))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = learn_weights(((b.column("key"), b.column("n").to_numpy(), whole) for b, whole in _with_prefixes(batches, True, 1.0)), left_out.value, order_bits)
        common.release()
        if got[1].any():
            yield _packed(*got)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, seen, came, some = np.zeros((_GATES, len(ORDERS) + 1)), np.zeros(_GATES), np.zeros((2, _MAPS * _STEPS)), False
        for batch in batches:
            for row in batch.to_pylist():
                weights, own, own_came = _unpacked(row)
                mean, seen, came, some = mean + own[:, None] * weights, seen + own, came + own_came, True
        if some:
            yield _packed(mean / np.maximum(seen, 1e-9)[:, None], seen, came)

    schema = "weights binary, seen binary, came binary"
    got = _dealt(tokens).mapInArrow(fit, schema).repartition(1).mapInArrow(merge, schema).toArrow().to_pylist()
    left_out.destroy()
    logits = spark.sparkContext.broadcast(Logits.of(counts, 0.0))
    del counts
    weights, refine = start_weights(), None
    if got:
        learnt, seen, came = _unpacked(got[0])
        weights[seen > 0], refine = learnt[seen > 0], map_logits(came)

    def run_model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, whole in _with_prefixes(batches, False, 0.0):
            p = log10_probability(b.column("key"), logits.value, weights, order_bits, whole, refine)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(key_hashes(b.column("key")).view(np.int64)), b.column("n"), pa.array(p)], ["key", "hash", "n", "log10_p"])
        common.release()

    rated = _dealt(tokens).mapInArrow(run_model, "key binary, hash long, n long, log10_p double").select("hash", "n", "log10_p", _is_word().alias("word"))
    rated = common.materialize(rated, "rated")
    logits.destroy()
    common.discard(tokens)
    often = rated.where(F.col("n") >= max(1.0, all_segments / common_parts)).toArrow()  # so common_parts rows at most
    order = np.argsort(hashes := often.column("hash").to_numpy().astype(np.int64).view(_U64))
    known = spark.sparkContext.broadcast(hashes[order])
    known_facts = spark.sparkContext.broadcast((often.column("n").to_numpy()[order], often.column("log10_p").to_numpy()[order]))

    id_type, lists = df.schema[id_col].dataType, T.ArrayType(T.LongType())
    kinds = [T.LongType(), T.IntegerType(), id_type, T.BooleanType(), *[T.LongType()] * 4, *[T.DoubleType()] * 2, T.LongType(), lists, lists]
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(_SPAN_COLUMNS, kinds, strict=True)])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text", "learn")
    spans = common.materialize(rows.mapInArrow(_span_rows(known, known_facts, context_words, span_bits, base_unit, end_n), schema), "spans")
    known.destroy()
    known_facts.destroy()
    flags = matched(spans.where("context is not null").select("row", "place", "learn", "context", "span"), common_parts)
    return spans, rated, flags, total, base_unit


def score(
    df: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", table_bits: int = 20, most_bits: int = 22,
    common_parts: int = 2_000_000, context_words: int = 6, span_bits: int = 5,
) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, n_repeated (tokens in spans coded by one bit) of
    every document; learn_from marks those to learn from."""
    with common.small_batches(df.sparkSession, 4000):
        spans, rated, flags, total, base_unit = _gathered(df, learn_from, id_col, text_col, table_bits, most_bits, common_parts, context_words, span_bits)

    # The bit that says whether a span is the expected one: how often it came true for these counts.
    states = flags.where("learn").groupBy("most", "other").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("int")).alias("hits")).collect()
    p = {(r["most"], r["other"]): (r["hits"] + 0.4) / (r["n"] + 0.8) for r in states}  # as many as there are states
    table = F.array(*(F.lit(float(p.get((k // (_STATES + 1), k % (_STATES + 1)), 0.5))) for k in range((_STATES + 1) ** 2)))
    true = F.element_at(table, F.col("most") * (_STATES + 1) + F.col("other") + 1)

    rest = spans.select("row", "place", F.explode(F.arrays_zip("rest", "rest_n")).alias("x")).select("row", "place", F.col("x.rest").alias("hash"), F.col("x.rest_n").alias("tf"))
    parts = [
        spans.select("row", "place", "id", "n_tokens", "n_known", "base", "value", "size"),
        rest.join(rated, "hash").select("row", "place", F.when(F.col("word"), F.col("tf")).alias("tf"), "n", (F.col("tf") * F.col("log10_p")).alias("value")),
        flags.select("row", "place", "hit", F.log10(F.when(F.col("hit"), true).otherwise(1 - true)).alias("flag")),
    ]
    every = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True).repartition("row")
    known = F.when(F.col("tf").isNotNull() & (F.col("n") > 0), F.col("tf"))
    base = F.col("tf") * (F.log10(F.col("n") + 0.1) - F.lit(base_unit))
    every = every.withColumns({"n_known": F.coalesce("n_known", known), "base": F.coalesce("base", base)})
    total_of = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    by_span = every.groupBy("row", "place").agg(F.max("id").alias("id"), *(total_of(c) for c in ("n_tokens", "n_known", "base", "value", "size", "flag")), F.coalesce(F.max("hit"), F.lit(False)).alias("hit"))
    sums = by_span.groupBy("row").agg(
        F.max("id").alias(id_col), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"),
        F.sum(F.col("flag") + F.when(F.col("hit"), 0.0).otherwise(F.col("value"))).alias("score"), F.sum(F.when(F.col("hit"), F.col("n_tokens")).otherwise(0)).alias("n_repeated"), F.sum("size").alias("_size"),
    )
    return sums.withColumn("bits_per_byte", F.when(F.col("_size") > 0, -F.col("score") * float(np.log2(10)) / F.col("_size"))).drop("row", "_size")


def _packed(*arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], ["weights", "seen", "came"])


def _unpacked(row: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shapes = ((_GATES, len(ORDERS) + 1), (_GATES,), (2, _MAPS * _STEPS))
    return tuple(np.frombuffer(row[c]).reshape(shape) for c, shape in zip(("weights", "seen", "came"), shapes, strict=True))
