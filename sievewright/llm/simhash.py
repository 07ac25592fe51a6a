"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: 64 sums of signs over a document's word shingles (XXH64, seed 42); a
bit is set if over half the shingles have it.  Two fingerprints link at ``budget``
differing bits or fewer.

The join runs over distinct fingerprints.  Of budget + 1 segments of the 64 bits, a linked
pair agrees on one, so one trie a segment, with that segment's bits at the top, holds each
linked pair below one node at the segment's depth: the other node pairs at that depth have spent
an error there and belong to another segment.  Those nodes are the unit of distribution.
Below, pairs of nodes go down together; a pair's errors are the differing bits so far, and pairs over
the budget are pruned.  A node with more than ``node_rows`` fingerprints is split by as many of its next
bits as it takes into node pairs of their own, with the pairs' errors counted, so that no task gets it whole.
A task reads its nodes in sorted order and joins about ``TASK_ROWS`` rows of whole nodes at a time; links are folded into a forest as they are
found, so neither the table's size nor a group of copies adds to its memory.

Cases.  Null text: as empty.  No words: fingerprint zero, linked like any other.  Fewer words
than a shingle: the whole sequence is the one shingle.  Null ids keep their fingerprint and take the component
of their class (null where it has no id).  Repeated rows are returned once each.  Empty table:
no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.llm._util import local_components, materialize, shared_dir
from sievewright.llm.components import connected_components

BITS = 64
#: Rows that a task holds at once, besides the rest of a node.
TASK_ROWS = 200_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        shingles = [line[a:b] for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), dtype="<u8", count=len(shingles))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * bits.astype(np.int64) > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with fp as a signed long; words and upper case are ASCII's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def segments(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, length) of budget + 1 segments."""
    edges = [BITS * k // (budget + 1) for k in range(budget + 2)]
    return list(zip(edges, np.diff(edges).tolist(), strict=False))


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return x if by == 0 else (x << np.uint64(by)) | (x >> np.uint64(BITS - by))


def trie_links(values: np.ndarray, pairs: list[np.ndarray], depths: np.ndarray, budget: int, chunk: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of the node pairs ``pairs`` = [a_low, a_high, b_low, b_high, errors] at ``depths``.

    A node is a run of ``values``, sorted within it, which agrees on its first ``depth`` bits.
    Pairs of nodes are taken down bit by bit; a stack of chunks bounds the memory.
    """
    stack = [(int(d), [x[depths == d] for x in pairs]) for d in np.unique(depths)]
    while stack:
        depth, p = stack.pop()
        if len(p[0]) > chunk:
            stack += [(depth, [x[:chunk] for x in p]), (depth, [x[chunk:] for x in p])]
            continue
        al, ah, bl, bh, err = p
        same = al == bl
        # Two single fingerprints are compared at once; what remains goes one bit deeper.
        single = (ah - al == 1) & (bh - bl == 1)
        ends = single & ~same
        if ends.any():
            a, b = al[ends], bl[ends]
            near = np.bitwise_count(values[a] ^ values[b]) <= budget
            yield a[near], b[near]
        go = ~single
        if depth >= BITS or not go.any():
            continue
        al, ah, bl, bh, err, same = al[go], ah[go], bl[go], bh[go], err[go], same[go]
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        am, bm = _split(values, al, ah, bit), _split(values, bl, bh, bit)
        other = ~same
        parts = [
            (al, am, bl, bm, err),
            (am, ah, bm, bh, err),
            (al, am, bm, bh, err + 1),
            (am[other], ah[other], bl[other], bm[other], err[other] + 1),
        ]
        new = [np.concatenate(x) for x in zip(*parts, strict=True)]
        keep = (new[1] > new[0]) & (new[3] > new[2]) & (new[4] <= budget) & ~((new[0] == new[2]) & (new[1] - new[0] == 1))
        if keep.any():
            stack.append((depth + 1, [x[keep] for x in new]))


def _split(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Index of the first value with the bit set in each run, by binary search in all runs at once."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) >> 1
        one = open_ & ((values[np.minimum(mid, len(values) - 1)] & bit) != 0)
        high = np.where(one, mid, high)
        low = np.where(open_ & ~one, mid + 1, low)


def _node_pairs(keys: np.ndarray, side: np.ndarray, start: np.ndarray, first_err: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Runs of equal (key, side) in sorted order, as node pairs: one node with itself, or side 0 with side 1."""
    change = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (side[1:] != side[:-1]))))
    ends = np.append(change[1:], len(keys))
    k, s = keys[change], side[change]
    alone = s == 2  # a node joined with itself
    ones = alone & (ends - change > 1)
    left = np.flatnonzero((s[:-1] == 0) & (s[1:] == 1) & (k[:-1] == k[1:])) if len(k) > 1 else np.array([], dtype=np.int64)
    a = np.concatenate((np.flatnonzero(ones), left))
    b = np.concatenate((np.flatnonzero(ones), left + 1))
    return [change[a], ends[a], change[b], ends[b], first_err[change[a]].astype(np.int64)], start[change[a]]


def link_forest(fps: DataFrame, budget: int = 2, node_rows: int = 50_000) -> DataFrame:
    """(a, b): edges between distinct fingerprints ``fps.fp`` whose components are those of all links."""
    parts = segments(budget)
    seg = F.array(*[F.struct(F.lit(k).alias("part"), F.expr(f"shiftrightunsigned(shiftleft(fp, {first}), {BITS - size})").alias("node")) for k, (first, size) in enumerate(parts)])
    keyed = fps.select("fp", F.explode(seg).alias("s")).select("fp", "s.part", "s.node")
    # Nodes over the limit are split by as many of their next bits as bring them below it.
    deepest = BITS - max(size for _, size in parts)
    large = keyed.groupBy("part", "node").agg(F.count("*").alias("n")).where(F.col("n") > node_rows)
    split = large.select("part", "node", F.least(F.ceil(F.log2(F.col("n") / node_rows)), F.lit(deepest)).cast("int").alias("more"))
    routed = keyed.join(split, ["part", "node"], "left")
    masks = [sum(1 << i for i in c) for w in range(budget + 1) for c in combinations(range(deepest), w)]
    after = F.element_at(F.array(*[F.lit((first + size) % BITS) for first, size in parts]), F.col("part") + 1)
    size_of = F.element_at(F.array(*[F.lit(size) for _, size in parts]), F.col("part") + 1)
    # The next bits after the segment, in the order of the rotated trie.
    spun = F.expr("shiftleft(fp, __after) | if(__after = 0, 0L, shiftrightunsigned(fp, 64 - __after))")
    routed = routed.withColumn("__after", after).withColumn("__depth", size_of)
    sub = F.when(F.col("more").isNull(), F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(__spun, 64 - more)"))
    routed = routed.withColumn("__spun", spun).withColumn("__sub", sub)
    mask = F.when(F.col("more").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: m < F.expr("shiftleft(1L, more)"))
    )
    pairs = routed.withColumn("__mask", F.explode(mask)).select(
        "fp", "part", "node", "more",
        F.least(F.col("__sub"), F.col("__sub").bitwiseXOR(F.col("__mask"))).alias("low"),
        F.greatest(F.col("__sub"), F.col("__sub").bitwiseXOR(F.col("__mask"))).alias("high"),
        F.when(F.col("__mask") == 0, 2).when(F.col("__sub") < F.col("__sub").bitwiseXOR(F.col("__mask")), 0).otherwise(1).alias("side"),
        F.bit_count("__mask").alias("err"),
        (F.col("__depth") + F.coalesce("more", F.lit(0))).alias("depth"),
    )
    dealt = pairs.select("fp", "part", "side", "err", "depth", F.xxhash64("part", "node", "low", "high").alias("key")).repartition("key").sortWithinPartitions("key")

    def forest(t: pa.Table) -> pa.RecordBatch:
        fp = t["fp"].to_numpy().view(np.uint64)
        key, side, err, depth, part = (t[c].to_numpy() for c in ("key", "side", "err", "depth", "part"))
        turned = fp.copy()
        for k, (first, _) in enumerate(parts):
            turned[part == k] = _rotl(fp[part == k], first)
        order = np.lexsort((turned, side, key))
        fp, turned, key, side = fp[order], turned[order], key[order], side[order]
        nodes, start = _node_pairs(key, side, depth[order].astype(np.int64), err[order])
        root = np.arange(len(fp))
        for a, b in trie_links(turned, nodes, start, budget):
            root = local_components(len(root), root[a], root[b])[root]
        child = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[child].view(np.int64)), pa.array(fp[root[child]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches, TASK_ROWS):
            yield forest(t)

    return dealt.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def whole_keys(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows of a stream sorted by ``key``; no key is in two of them."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held)
            key = t["key"].to_numpy()
            end = int(np.searchsorted(key, key[-1]))  # where the last key, which may go on, begins
            if end:
                yield t.slice(0, end)
                held, n = t.slice(end).to_batches(), t.num_rows - end
    if n:
        yield pa.Table.from_batches(held)


def near_duplicates(docs: DataFrame, budget: int = 2, shingle: int = 3, node_rows: int = 50_000) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id reachable over links, the document's own included."""
    home = shared_dir(docs.sparkSession)
    own = materialize(fingerprints(docs, shingle), f"{home}/fingerprints")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = connected_components(link_forest(classes.select("fp"), budget, node_rows))
    named = classes.join(groups.withColumnRenamed("id", "fp"), "fp", "left")
    smallest = named.where("component is not null").groupBy("component").agg(F.min("first").alias("smallest"))
    label = named.join(smallest, "component", "left").select("fp", F.coalesce("smallest", "first").alias("component_id"))
    return own.join(label, "fp")


def keep_first(docs: DataFrame, budget: int = 2, shingle: int = 3) -> DataFrame:
    """One document of each group, the one with the smallest id; all columns kept.

    Of rows that share that id, one with the smallest text; documents without id stay.
    """
    found = near_duplicates(docs.select("doc_id", "text"), budget, shingle)
    per_id = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("__first"), F.count("*").alias("__n"))
    # Most ids are single and stay: only the others are looked up, so the texts needn't be shuffled for a few copies.
    marked = materialize(per_id.where("not __first or __n > 1"), f"{shared_dir(docs.sparkSession)}/marked")
    rest = docs.join(marked.select("__id"), F.col("doc_id") == F.col("__id"), "left_anti")
    repeated = docs.join(marked.where("__first").select("__id"), F.col("doc_id") == F.col("__id"), "left_semi")
    one = repeated.withColumn("__rank", F.row_number().over(W.partitionBy("doc_id").orderBy("text"))).where("__rank = 1").select(*docs.columns)
    return rest.unionByName(one)
