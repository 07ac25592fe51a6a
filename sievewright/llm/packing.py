"""Harmonic packing of tokenised documents into fixed-length sequences.

Piece lengths fall into reciprocal-capacity classes: a piece of r tokens is of class k = capacity // r, as k of them
fill a bin, and each bin of the class takes exactly k pieces.  1024 tokens have 63 classes, from 1 to 1024 pieces a bin; up to 32 tokens, all
pieces of a class are of one length.  A document is
cut into full sequences, then the rest into pieces that fill their class's slot of capacity // k tokens
to within one part in ``slack``, so little padding remains.  Bins are numbered without looking
at other pieces: a piece's rank in its class is its rank in its task plus the
class's count in earlier tasks (a table of tasks x classes), and its sequence is rank // k.
The last, unfilled bin of each class, at most k - 1 pieces, goes to one
first-fit pass over at most ``sum(k - 1)`` pieces, fewer than 5000 whatever the input.

Ids are those of the ``tokenizers`` library for the JSON file of a byte-level BPE, special tokens in texts included.  They are
computed by another library from that file's vocabulary, in a quarter of the time; tests compare the two.

Cases.  Null or empty text: the end id alone.  Bytes that aren't UTF-8 count as replacement characters.  A null doc_id is kept.  Repeated
rows are packed once each.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.llm._util import materialize, shared_dir, valid_text

#: Fixed value: the pre-tokenisation pattern of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, start long, length int, doc_tokens long, class int, task int, rank long, ids binary"

_encodings: dict = {}


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as its own Latin-1 letter if that is visible, and the others as letters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoding(path: str):
    """The byte-level BPE of a ``tokenizers`` JSON file, whose ids are its merge ranks; cached in a Python worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, special = byte_letters(), {x["content"]: x["id"] for x in file["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        _encodings[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encodings[path]


def cut(n: int, capacity: int, slack: int) -> list[tuple[int, int]]:
    """(length, class) of each piece of n tokens; the lengths sum to n.

    A rest of r tokens fits class k = capacity // r with slots of capacity // k tokens.
    It stays whole if it leaves at most one part in ``slack`` of the slot; else a whole slot of class k + 1 is cut off.
    """
    out = [(capacity, 1)] * (n // capacity)
    r = n % capacity
    while r:
        slot = capacity // (capacity // r)
        if (slot - r) * slack > slot:
            slot = capacity // (capacity // r + 1)
        out.append((min(r, slot), capacity // min(r, slot)))
        r -= out[-1][0]
    return out


def tokenize_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, slack: int = 64, end_id: int = 0) -> DataFrame:
    """One row for each piece, with its ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoding(vocabulary), TaskContext.get().partitionId()
        ranks = [0] * (capacity + 1)
        cuts: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py() or "", allowed_special="all")
                ids.append(end_id)
                raw = np.array(ids, dtype="<u4").tobytes()
                n, start = len(ids), 0
                if n % capacity not in cuts:
                    cuts[n % capacity] = cut(n % capacity, capacity, slack)
                for length, k in [(capacity, 1)] * (n // capacity) + cuts[n % capacity]:
                    row = (doc, start, length, n, k, task, ranks[k], raw[4 * start : 4 * (start + length)])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    ranks[k] += 1
                    start += length
                held += len(raw)
                if held > 8 << 20:
                    yield _batch(cols)
                    cols, held = [[] for _ in range(8)], 0
            if cols[0]:
                yield _batch(cols)

    return docs.select(F.col("doc_id").cast("long"), valid_text()).mapInArrow(run, PIECES)


def _batch(cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def assign(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to stable ``pieces`` (a written table).

    Two small side tables: counts a (task, class), and the classes' first sequence ids.
    """
    counts = pieces.groupBy("class", "task").agg(F.count("*").alias("n"))
    before = W.partitionBy("class").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("class", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"), F.sum("n").over(W.partitionBy("class")).alias("total"))
    # A row a class: the first sequence id of each class.
    firsts = (
        offsets.groupBy("class").agg(F.max("total").alias("total"))
        .select("class", F.coalesce(F.sum(F.expr("total div class")).over(W.orderBy("class").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first_id"), F.expr("sum(total div class) over ()").alias("bins"))
    )
    ranked = (
        pieces.join(offsets, ["class", "task"])
        .join(F.broadcast(firsts), "class")
        .withColumn("rank", F.col("rank") + F.col("earlier"))
        .withColumn("tail", F.col("rank") >= F.expr("total div class * class"))
    )
    full = W.partitionBy("sequence_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    whole = ranked.where(~F.col("tail")).withColumn("sequence_id", F.col("first_id") + F.expr("rank div class"))
    # Full sequences need no window, nor the shuffle for it; the others are grouped by their own bin.
    one = whole.where("class = 1").withColumn("offset", F.lit(0).cast("long"))
    more = whole.where("class > 1").withColumn("offset", F.coalesce(F.sum("length").over(full), F.lit(0)).cast("long"))
    tail = ranked.where("tail")

    def first_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for b in batches for x in b.to_pylist()]
        room: list[int] = []
        for x in sorted(rows, key=lambda x: (-x["length"], x["class"], x["rank"])):
            k = next((i for i, free in enumerate(room) if free >= x["length"]), len(room))
            if k == len(room):
                room.append(capacity)
            x["sequence_id"], x["offset"] = x["bins"] + k, capacity - room[k]
            room[k] -= x["length"]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=out_arrow)

    fields = [f for f in tail.schema.fields]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    out = StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    out_arrow = to_arrow_schema(out)
    # The filter runs where the pieces are; only the tails, fewer than 5000 rows, move to the one task.
    fitted = tail.repartition(1).mapInArrow(first_fit, out)
    drop = ("earlier", "total", "first_id", "bins", "tail", "rank", "task", "class")
    return one.unionByName(more).unionByName(fitted).drop(*drop)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, slack: int = 64, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces with doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset, and their ids if asked for."""
    pieces = tokenize_pieces(docs, vocabulary, capacity, slack, end_id).withColumn("ids_crc32", F.crc32("ids"))
    kept = materialize(pieces if with_ids else pieces.drop("ids"), shared_dir(docs.sparkSession))
    return assign(kept, capacity)
