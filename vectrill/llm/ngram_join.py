"""Near-duplicate join: documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

Plan.
1. One pass over the texts makes, for each row, a hash of its set of word n-grams and, for each tree of an LSH forest, a
   label of `max_depth` MinHash values (16 bits of each). Rows with equal sets form a class; one of them represents it.
2. The labels are sorted over all tasks: a sorted prefix trie for each tree. One pass along the order finds how long a
   prefix each label shares with the one before, and links it to the first label of the trie node where both meet. The
   first and last labels of each task are sorted once more to link nodes that lie in several tasks. So the members of
   a node are never gathered or paired, and the links of a prefix of d values are those that share d or more.
3. Matching starts with whole labels. What is found is verified, and the prefix is shortened as far as a pair with the
   least similarity seen so far needs to meet in one of the trees with the target recall; where nothing is found, as far
   as a pair at the threshold needs. This is repeated until the prefix is short enough for all that was seen.
4. Connected components of the links bound the comparisons. Every text of a component is sent to it once, its set
   is rebuilt, and all its pairs are verified exactly, in blocks of `block` members; a larger component is dealt out
   as pairs of blocks, so no task holds more than two blocks. A task returns, for each member, the number and the least
   similarity of its links, and a spanning forest of the links in place of the pairs themselves. After the prefix is
   shortened, only components that have grown are verified again.
5. Classes of linked documents are the connected components of the spanning forests.

Defined cases: words are what ASCII white space separates, A-Z lower-cased. A text of fewer than `n` words but at
least one has one n-gram, all its words; null, empty and blank texts have none, are linked to nothing and form
classes of their own. Inside, a row is known by a 64-bit hash of its id and text, so ids may be null, of any type that has
an order, and shared by unlike texts; rows that repeat both are copies, and each is returned. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.llm import _common as common

_U64 = np.uint64
#: Of the filter for texts to verify; at most so many numbers are broadcast.
_SLOTS = 1 << 21


def forest_depth(trees: int, threshold: float, target_recall: float, max_depth: int) -> int:
    """How long a prefix may be: shortened from max_depth until a pair at the threshold is found with the target recall."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target_recall:
        depth -= 1
    return depth


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams, one text after the other, and the offsets of the texts."""
    words = common.Words(texts, common.SPACED, lower=True)
    hashes = words.hashes()
    grams, where = words.grams(hashes, n)
    text = words.text_of_word()[where]
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        with np.errstate(over="ignore"):
            whole = [np.bitwise_xor.reduce(common.mix(hashes[words.bounds[i] : words.bounds[i + 1]] + np.arange(1, counts[i] + 1).astype(_U64) * _U64(0xA24BAED4963EE407))) for i in short]
        grams, text = np.concatenate([grams, np.array(whole, _U64)]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        grams, text = grams[order], text[order]
    offsets, parts = np.searchsorted(text, np.arange(len(counts) + 1)), []
    for i in range(len(counts)):
        part = np.sort(grams[offsets[i] : offsets[i + 1]])
        parts.append(part[np.concatenate([[True], part[1:] != part[:-1]])] if len(part) else part)
    return (np.concatenate(parts) if parts else np.zeros(0, _U64)), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def tree_labels(sets: np.ndarray, offsets: np.ndarray, trees: int, depth: int, seed: int) -> np.ndarray:
    """[text, tree, byte]: the tree's number, then 16 bits of each of `depth` MinHash values. Texts must not be empty."""
    rng = np.random.default_rng(seed)
    keys, factors = rng.integers(0, 1 << 63, trees * depth).astype(_U64), rng.integers(0, 1 << 63, trees * depth).astype(_U64) * _U64(2) + _U64(1)
    out = np.empty((len(offsets) - 1, trees, 1 + 2 * depth), np.uint8)
    out[:, :, 0] = np.arange(trees)
    with np.errstate(over="ignore"):
        for k in range(trees * depth):
            least = common.mix(np.minimum.reduceat((sets ^ keys[k]) * factors[k], offsets[:-1]))
            tree, at = divmod(k, depth)
            out[:, tree, 1 + 2 * at] = (least & _U64(255)).astype(np.uint8)
            out[:, tree, 2 + 2 * at] = (least >> _U64(8) & _U64(255)).astype(np.uint8)
    return out


def _binaries(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of bytes."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _signatures(n: int, trees: int, depth: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sets, offsets = shingle_sets(batch.column("text"), n)
            size = np.diff(offsets)
            full = np.flatnonzero(size)
            labels, digest = np.zeros((0, trees, 1 + 2 * depth), np.uint8), np.zeros(len(size), _U64)
            if len(full):
                starts = offsets[:-1][full]
                with np.errstate(over="ignore"):
                    digest[full] = common.mix(np.add.reduceat(common.mix(sets), starts) + size[full].astype(_U64))
                labels = tree_labels(sets, np.append(starts, len(sets)), trees, depth, seed)
            ends = np.concatenate([[0], np.cumsum(np.where(size > 0, trees, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), _binaries(labels.reshape(-1, 1 + 2 * depth)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(digest.view(np.int64)), pa.array(size), lists], ["id", "key", "digest", "size", "labels"])

    return run


# --- sorted prefix tries --------------------------------------------------------------------


def shared_prefixes(labels: np.ndarray, before: np.ndarray) -> np.ndarray:
    """How many leading values each label shares with the one before; -1 where that is of another tree."""
    same = labels == before
    values = same[:, 1::2] & same[:, 2::2]
    return np.where(same[:, 0], np.minimum.accumulate(values, axis=1).sum(axis=1), -1)


def _trie(floor: int, depth: int, edges_only: bool):
    """Along sorted (label, key): (a, b, depth) links each key to the first of the trie node where its label meets the one before,
    for nodes of `floor` values or more. Unless `edges_only`, rows (key, null, null, label) carry the first and last labels
    that the task has of each tree."""
    names = ["a", "b", "depth", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 1 + 2 * depth
        last = None  # the label and key before
        first = np.zeros(depth + 1, np.int64)  # the first key of the node of each depth that is open

        def bounds(labels: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(keys), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(keys), none, pa.nulls(len(keys), pa.int32()), _binaries(labels)], names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = batch.column("label")
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
            labels = np.frombuffer(column.buffers()[2], np.uint8)[at : at + n * width].reshape(n, width)
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            if last is None:
                last = (np.full((1, width), 255, np.uint8), keys[:1])
            before, before_keys = np.concatenate([last[0], labels[:-1]]), np.concatenate([last[1], keys[:-1]])
            shared = shared_prefixes(labels, before)
            a, b, meet = [], [], []
            for d in range(floor, depth + 1):
                start = np.maximum.accumulate(np.where(shared < d, np.arange(n), -1))
                node = np.where(start >= 0, keys[np.maximum(start, 0)], first[d])
                here = shared == d
                a.append(node[here])
                b.append(keys[here])
                meet.append(np.full(int(here.sum()), d, np.int32))
                first[d] = node[-1]
            a, b, meet = np.concatenate(a), np.concatenate(b), np.concatenate(meet)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(meet), pa.nulls(len(a), pa.binary())], names)
            if not edges_only:
                turn = shared < 0
                ends = turn & (before[:, 0] != 255)
                yield bounds(np.concatenate([labels[turn], before[ends]]), np.concatenate([keys[turn], before_keys[ends]]))
            last = (labels[-1:].copy(), keys[-1:].copy())
        if last is not None and not edges_only:
            yield bounds(*last)

    return run


def trie_links(labels: DataFrame, floor: int, depth: int) -> DataFrame:
    """(a, b, depth): links that join all keys whose labels share `depth` leading values, for each depth from `floor` up."""
    schema = "a long, b long, depth int, label binary"
    order = labels.repartitionByRange("label", "key").sortWithinPartitions("label", "key")
    found = common.materialize(order.mapInArrow(_trie(floor, depth, False), schema), "tries")
    # At most two rows for each tree and task: one task sorts them.
    ends = found.where("label is not null").select("label", F.col("a").alias("key")).repartition(1).sortWithinPartitions("label", "key")
    across = ends.mapInArrow(_trie(floor, depth, True), schema)
    return found.where("label is null").union(across).where("a <> b").select("a", "b", "depth")


# --- exact verification ---------------------------------------------------------------------


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of `left` with all of `right`, through products of incidence blocks."""
    out = np.zeros((len(left), len(right)), np.float64)
    values_l, values_r = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(values_l, values_r)
    rows_l, rows_r = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    step = max(256, (1 << 22) // max(len(left), len(right)))

    def placed(values: np.ndarray, rows: np.ndarray, part: np.ndarray, height: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(part, values), len(part) - 1)
        hit = part[at] == values
        dense = np.zeros((height, len(part)), np.float32)
        dense[rows[hit], at[hit]] = 1
        return dense

    for i in range(0, len(shared), step):
        part = shared[i : i + step]
        out += placed(values_l, rows_l, part, len(left)) @ placed(values_r, rows_r, part, len(right)).T
    return out


def similarities(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarity of each pair."""
    common_ = intersections(left, right)
    return common_ / (np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - common_)


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest index that each of n members is joined to by pairs (in blocks of member by member)."""
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([root(x) for x in range(n)], np.int64)


def _verify_group(ids: np.ndarray, blocks: np.ndarray, weights: np.ndarray, sets: list[np.ndarray], i: int, j: int, threshold: float):
    """Of each member of one pair of blocks: its links, the smallest id it is joined to, the least similarity of its links (2: none)."""
    least = np.full(len(ids), 2.0)
    if i == j:
        alike = similarities(sets, sets)
        linked = alike >= threshold
        np.fill_diagonal(linked, False)
        number, pairs = linked @ weights, np.argwhere(np.triu(linked))
        least = np.where(linked, alike, 2).min(axis=1)
    else:
        a, b = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
        number, pairs = np.zeros(len(ids), np.int64), np.zeros((0, 2), np.int64)
        if len(a) and len(b):
            alike = similarities([sets[x] for x in a], [sets[x] for x in b])
            linked = alike >= threshold
            number[a], number[b] = linked @ weights[b], linked.T @ weights[a]
            least[a], least[b] = (np.where(linked, alike, 2).min(axis=x) for x in (1, 0))
            pairs = np.argwhere(linked)
            pairs = np.column_stack([a[pairs[:, 0]], b[pairs[:, 1]]])
    return number, ids[forest(len(ids), pairs)], least


def _verifier(n: int, threshold: float):
    names = ["key", "n_links", "joined", "least"]

    def groups(batches: Iterator[pa.RecordBatch]):
        key, held = None, []
        for batch in common.slices(batches):
            sets, offsets = shingle_sets(batch.column("text"), n)
            columns = [batch.column(c).to_pylist() for c in ("comp", "i", "j", "key", "block", "copies")]
            for row, (comp, i, j, *rest) in enumerate(zip(*columns, strict=True)):
                if (comp, i, j) != key:
                    if held:
                        yield key, held
                    key, held = (comp, i, j), []
                held.append((*rest, sets[offsets[row] : offsets[row + 1]].copy()))
        if held:
            yield key, held

    def table(out: list[list]) -> pa.RecordBatch:
        least = np.concatenate(out[3])
        return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x).astype(np.int64)) for x in out[:3]), pa.array(least, mask=least > 1)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]
        for (_, i, j), held in groups(batches):
            held.sort(key=lambda x: x[0])
            ids, blocks, weights = (np.array([x[k] for x in held], np.int64) for k in range(3))
            for column, values in zip(out, (ids, *_verify_group(ids, blocks, weights, [x[3] for x in held], i, j, threshold)), strict=True):
                column.append(values)
            if len(out[0]) >= 2000:
                yield table(out)
                out = [[], [], [], []]
        if out[0]:
            yield table(out)

    return run


# --- the join -------------------------------------------------------------------------------


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("key"))


def _verify(docs: DataFrame, comps: DataFrame, sets: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """(key, n_links, joined, least) of the members of each component (node, root), one row for each pair of blocks they are in."""
    blocks = comps.groupBy(F.col("root").alias("comp")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = (
        comps.withColumnRenamed("root", "comp").join(blocks, "comp").withColumnRenamed("node", "key")
        .join(sets.select(F.col("rep").alias("key"), "copies"), "key")
        .withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    )
    members = common.materialize(members, "members")
    # Before texts are shuffled, most that are no member go by a filter of fixed size: it lets all members pass.
    slot = F.expr(f"key & {_SLOTS - 1}").alias("slot")
    slots = common.materialize(members.select(slot).distinct(), "slots")
    near = docs.select("*", slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
    dealt = (
        near.join(members, "key").dropDuplicates(["key"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "block", "copies", "text")
    )
    dealt = dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return common.materialize(dealt.mapInArrow(_verifier(n, threshold), "key long, n_links long, joined long, least double"), "verified")


def _classes(df: DataFrame, id_col: str, text_col: str, n: int, threshold: float, trees: int, max_depth: int, target_recall: float, block: int, seed: int) -> DataFrame:
    """(id, key, rep_id, root, n_links) of each row; root is the same for all rows that links connect."""
    docs = _keyed(df, id_col, text_col)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in ("key", "digest", "size")), T.StructField("labels", T.ArrayType(T.BinaryType()))])
    rows = common.materialize(docs.mapInArrow(_signatures(n, trees, max_depth, seed), schema), "signatures")

    # Representatives of equal sets. The digest of a set is 64 bits of all its hashes; its size makes a chance match rarer still.
    sets = rows.where("size > 0").groupBy("digest", "size").agg(F.min("key").alias("rep"), F.min("id").alias("rep_id"), F.count("*").alias("copies"))
    sets = common.materialize(sets, "sets")

    # The tries, with all links that the shortest prefix can need, each with the prefix that it needs.
    floor = forest_depth(trees, threshold, target_recall, max_depth)
    keys = ["key", "digest", "size"]
    one = rows.where("size > 0").dropDuplicates(keys).join(sets.select(F.col("rep").alias("key"), "digest", "size"), keys, "left_semi")
    labels = one.select("key", F.explode("labels").alias("label"))
    links = common.materialize(trie_links(labels, floor, max_depth).groupBy("a", "b").agg(F.max("depth").alias("depth")), "links")

    depth = max_depth
    comps = common.materialize(common.components(links.where(F.col("depth") >= depth).select("a", "b")), "candidates")
    verified = _verify(docs, comps, sets, n, threshold, block)
    while depth > floor:
        seen = verified.agg(F.min("least")).first()[0]
        wanted = min(depth, floor if seen is None else forest_depth(trees, seen, target_recall, max_depth))
        if wanted == depth:
            break
        more = links.where((F.col("depth") >= wanted) & (F.col("depth") < depth)).select("a", "b")
        wider = common.materialize(common.components(more.union(comps.select(F.col("node").alias("a"), F.col("root").alias("b")))), "candidates")
        was = wider.join(comps.withColumnRenamed("root", "was"), "node", "left").withColumn("was", F.coalesce("was", "node"))
        grown = was.groupBy("root").agg(F.min("was").alias("low"), F.max("was").alias("high")).where("low < high").select("root")
        again = common.materialize(wider.join(grown, "root").select("node", "root"), "grown")
        rest = verified.join(again.select(F.col("node").alias("key")), "key", "left_anti").select(*verified.columns)
        verified = common.materialize(rest.union(_verify(docs, again, sets, n, threshold, block)), "verified")
        depth, comps = wanted, wider

    counted = verified.groupBy(F.col("key").alias("rep")).agg(F.sum("n_links").alias("n_links"))
    roots = common.materialize(common.components(verified.select(F.col("key").alias("a"), F.col("joined").alias("b")), "roots"), "roots")
    facts = sets.join(counted, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    facts = facts.select("digest", "size", "rep_id", F.coalesce("root", "rep").alias("root"), (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    return rows.drop("labels").join(facts, ["digest", "size"], "left").select("id", "key", "rep_id", "root", "n_links")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8,
    trees: int = 24, max_depth: int = 10, target_recall: float = 0.999, block: int = 512, seed: int = 7,
) -> DataFrame:
    """One row for each input row: id, rep_id (the smallest id with the same set), class_id (the smallest id among all
    that links connect), n_links (how many other rows have at least the threshold's similarity, copies included)."""
    found = common.materialize(_classes(df, id_col, text_col, n, threshold, trees, max_depth, target_recall, block, seed), "found")
    names = common.materialize(found.where("root is not null").groupBy("root").agg(F.min("rep_id").alias("class_id")), "names")
    return found.join(names, "root", "left").select(
        F.col("id").alias(id_col), F.coalesce("rep_id", "id").alias("rep_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def one_of_each(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8,
    trees: int = 24, max_depth: int = 10, target_recall: float = 0.999, block: int = 512, seed: int = 7,
) -> DataFrame:
    """The rows of df without those that repeat another: of each class of linked documents the row with the smallest id stays
    (null counts as the largest), and of rows that repeat an id and its text one."""
    found = _classes(df, id_col, text_col, n, threshold, trees, max_depth, target_recall, block, seed)
    rows = found.groupBy("key").agg(F.first("id").alias("id"), F.first("root").alias("root"), F.count("*").alias("_n"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "key", "_n")).alias("x")
    keep = rows.groupBy(F.coalesce("root", "key")).agg(first).select(F.col("x.key").alias("_key"), "x._n")
    keep = common.materialize(keep, "kept")
    kept = df.withColumn("_key", F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))).join(keep, "_key")
    repeated = keep.where("_n > 1").limit(1).count()
    return (kept.dropDuplicates(["_key"]) if repeated else kept).drop("_key", "_n")
