"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Random indexing: every word has a sparse random index vector, fixed by its hash; a word's vector is the sum of the
index vectors of the words within ``WINDOW`` places of it.  Word shapes (letters reduced to their case,
digits to 0) get vectors in the same way, as most words of a corpus are rare.  A document is the mean of its words' vectors, the mean of its
shapes' vectors and four pooled scalars.  The network is numpy: one hidden layer, Adam, and a temperature
fitted on rows that the weights didn't see, so scores are calibrated probabilities.

Context vectors are summed over all documents, labelled or not; vocabulary tables have a fixed number of hashed rows, so a task's sums and the
broadcast model have a fixed size (9 MB).  Sums are whole numbers, added up in a tree of at most ``FAN_IN`` parts a task: any order gives one
model.  The network is fitted on at most ``FIT_ROWS`` labelled documents, those with the smallest hashes of their ids among the documents
at hand.  Every document is scored over its whole text.

Cases.  Null or empty text: the features of no words, scored like any other.  Any bytes can be words.  Null labels are not learnt from; an id with several labels takes their mean's side, and one with several texts is learnt from the
smallest.  One class or no labelled rows: every score is that class's share, or 0.5.  Null ids are scored
and fall in the fold of the empty text.  Repeated rows: scored each.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm._util import fold_of, materialize, shared_dir

#: The bound on labelled documents that the classifier is fitted on.
FIT_ROWS = 8000
#: Parts that one task adds up, the tree's levels (for up to 2**24 tasks), and the table rows that travel together.
FAN_IN, LEVELS, SLICE_ROWS = 256, 3, 1 << 10
DIM, WORD_ROWS, SHAPE_ROWS, WINDOW, NONZERO = 64, 1 << 15, 1 << 12, 2, 6
THRESHOLD = 0.3
#: Bytes of text that are read together.
BYTES = 1 << 18

#: Bytes by kind: white space; small for capitals; and for shapes, capitals to A, small letters and all of other alphabets to a, digits to 0.
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_SMALL = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64)
_MARK = np.array([65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)], dtype=np.uint8)
_RUNS = np.isin(np.arange(256), (48, 65, 97))
#: Powers of an odd number modulo 2**64 and of its inverse: a word's hash is its part of a running sum, moved back to the first power.
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n, x, dtype=np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))).astype(np.uint64) >> np.uint64(16)


def word_rows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, packed rows) of the words in bytes, all at once: row of the word table << 16 | row of the shape table."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_SMALL[data] + np.uint64(1)) * up[: len(data)], out=total[1:])
    word = _mixed((total[ends] - total[starts]) * down[starts])
    mark = _MARK[data]
    first = np.ones(len(data), dtype=bool)
    first[1:] = (mark[1:] != mark[:-1]) | ~_RUNS[mark[1:]]
    place = np.cumsum(first) - 1
    np.cumsum(np.where(first, (mark + np.uint64(1)) * up[place], np.uint64(0)), out=total[1:])
    shape = _mixed((total[ends] - total[starts]) * down[place[starts]])
    return starts, ((word % np.uint64(WORD_ROWS)) << np.uint64(16) | shape % np.uint64(SHAPE_ROWS)).astype(np.int64)


def rows_of(text: bytes | None) -> np.ndarray:
    """The packed rows of a text's words; a long text goes in windows that end at white space."""
    data, at, out = np.frombuffer(text or b"", dtype=np.uint8), 0, [np.zeros(0, dtype=np.int64)]
    while at < len(data):
        end = at + BYTES
        if end < len(data):
            gap = np.flatnonzero(_SPACE[data[at:end]])
            while not len(gap) and end < len(data):  # one word fills the window
                gap, end = np.flatnonzero(_SPACE[data[end : end + BYTES]]) + end - at, end + BYTES
            end = at + gap[-1] + 1 if len(gap) else len(data)
        out.append(word_rows(data[at:end])[1])
        at = end
    return np.concatenate(out)


def all_rows(texts: pa.Array) -> Iterator[np.ndarray]:
    """The packed rows of each of many texts (a binary array); short ones are read together."""
    held, n = [], 0
    for text in texts:
        text = text.as_buffer() if text.is_valid else None
        size = text.size if text is not None else 0
        if n + size > BYTES:
            yield from _together(held)
            held, n = [], 0
        if size > BYTES:
            yield rows_of(text)
            continue
        held.append(bytes(text) if size else b"")
        n += size + 1
    yield from _together(held)


def _together(texts: list[bytes]) -> Iterator[np.ndarray]:
    if texts:
        starts, rows = word_rows(np.frombuffer(b" ".join(texts), dtype=np.uint8))
        ends = np.cumsum([len(t) + 1 for t in texts])
        yield from np.split(rows, np.searchsorted(starts, ends[:-1]))


def index_vectors(rows: int, seed: int) -> np.ndarray:
    """Places of the ``NONZERO`` units of each row's sparse index vector, positive and negative in turn; the same everywhere."""
    return np.random.default_rng(seed).integers(0, DIM, (NONZERO, rows))


def context_sums(ids: np.ndarray, bounds: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, sums): the sum of the neighbours' index vectors for each row, as places in the flat table; ``bounds`` are the documents' ends in ``ids``."""
    doc = np.searchsorted(bounds, np.arange(len(ids)), side="right")
    pairs = []
    for step in range(1, WINDOW + 1):
        inside = doc[step:] == doc[:-step]
        a, b = ids[:-step][inside], ids[step:][inside]
        pairs += [(a, b), (b, a)]
    own, near = (np.concatenate(x) for x in zip(*pairs, strict=True))
    out = []
    for sign in (0, 1):
        # Sorting and counting small numbers is faster than adding at random places.
        places = np.concatenate([(own * DIM + row[near]).astype(np.uint32) for row in index[sign::2]])
        places.sort()
        start = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1]))) if len(places) else np.zeros(0, dtype=np.int64)
        out.append((places[start].astype(np.int64), np.diff(np.append(start, len(places))) * (2 * sign - 1)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pooled(packed: np.ndarray, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Features of one document from its packed table rows."""
    out = np.zeros(2 * DIM + 4, dtype=np.float32)
    n = len(packed)
    if n:
        w, s = packed >> 16, packed & 0xFFFF
        kinds, counts = np.unique(s, return_counts=True)
        step = 1 << 14  # long texts in parts
        out[:DIM] = sum(words[w[i : i + step]].sum(axis=0) for i in range(0, n, step)) / n
        out[DIM : 2 * DIM] = counts.astype(np.float32) @ shapes[kinds] / n
        out[2 * DIM :] = np.log1p(n) / 10, len(np.unique(w)) / n, (w[1:] == w[:-1]).sum() / n, len(kinds) / n
    return out


class Network:
    """One hidden layer of tanh units, logistic output, temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7):
        self.constant = None
        if len(y) < 20 or len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        x, y = x[order].astype(np.float64), y[order].astype(np.float64)
        held = max(10, len(y) // 5)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        zt, yt, zv, yv = z[held:], y[held:], z[:held], y[:held]
        d = z.shape[1]
        p = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(yt)), max(1, len(yt) // 128)):
                a, h, o = zt[rows], *self._forward(zt[rows], p)
                g = (1 / (1 + np.exp(-o)) - yt[rows]) / len(rows)
                back = np.outer(g, p[2]) * (1 - h * h)
                grads = [a.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
                t += 1
                for q, gr, mm, vv in zip(p, grads, m, v, strict=True):
                    mm += 0.1 * (gr - mm)
                    vv += 0.001 * (gr * gr - vv)
                    q -= 0.003 * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
        self.p = p
        logits = self._forward(zv, p)[1]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
        loss = [np.logaddexp(0, np.where(yv > 0, -logits, logits) / g).mean() for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    @staticmethod
    def _forward(z: np.ndarray, p: list) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ p[0] + p[1])
        return h, h @ p[2] + p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip((x - self.mean) / self.scale, -20, 20)
        return 1 / (1 + np.exp(-np.clip(self._forward(z, self.p)[1] / self.temperature, -500, 500)))


def as_bytes() -> F.Column:
    return F.col("text").cast("string").cast("binary").alias("text")


def _labelled(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(text, y): the bounded sample of the labelled ones of ``docs`` outside fold 0, a row for each id."""
    own = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("d")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    fold = F.pmod(F.crc32(F.col("d").cast("string").cast("binary")), F.lit(5))
    here = own.where(fold != 0).join(docs.select("doc_id"), F.col("d") == F.col("doc_id"), "left_semi")
    few = here.orderBy(F.xxhash64("d"), "d").limit(fit_rows)
    # At most ``fit_rows`` ids and labels go to every task.
    return docs.select("doc_id", as_bytes()).join(F.broadcast(few), F.col("d") == F.col("doc_id")).groupBy("d", "y").agg(F.min("text").alias("text")).select("text", "y")


def context_tables(docs: DataFrame, home: str) -> list[np.ndarray]:
    """Unit context vectors of the words' and of the shapes' rows, over all documents."""
    sizes = (WORD_ROWS, SHAPE_ROWS)
    kind = "part long, at int, sums binary"
    names = ["part", "at", "sums"]

    def slices(part: int, sums: np.ndarray) -> pa.RecordBatch:
        rows = [(part, at, sums[at : at + SLICE_ROWS].tobytes()) for at in range(0, len(sums), SLICE_ROWS)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=names)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(sizes) * DIM, dtype=np.int64)
        index = [index_vectors(WORD_ROWS, 11), index_vectors(SHAPE_ROWS, 12)]
        held, n = [], 0

        def add() -> None:
            packed, bounds = np.concatenate(held), np.cumsum([len(x) for x in held])
            for ids, table, first in ((packed >> 16, index[0], 0), (packed & 0xFFFF, index[1], WORD_ROWS * DIM)):
                places, n = context_sums(ids, bounds, table)
                np.add.at(total, first + places, n)

        for batch in batches:
            for rows in all_rows(batch.column("text")):
                held.append(rows)
                n += len(rows)
                if n >= 1 << 16:
                    add()
                    held, n = [], 0
        if n:
            add()
        yield slices(TaskContext.get().partitionId(), total.reshape(-1, DIM).astype(np.int32))

    def added(t: pa.Table) -> pa.Table:
        # A task's own sums are 32-bit, added ones 64-bit.
        parts = (x.as_py() for x in t["sums"])
        total = sum(np.frombuffer(x, dtype=np.int32 if len(x) == 4 * SLICE_ROWS * DIM else np.int64).astype(np.int64) for x in parts)
        return pa.Table.from_arrays([pa.array([t["part"][0].as_py() // FAN_IN], pa.int64()), pa.array([t["at"][0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=names)

    parts = docs.select(as_bytes()).mapInArrow(sums, kind)
    for _ in range(LEVELS):
        parts = parts.groupBy(F.expr(f"part div {FAN_IN}"), "at").applyInArrow(lambda _, t: added(t), kind)
    parts = materialize(parts, f"{home}/sums")
    table = np.zeros((sum(sizes), DIM))
    for _, at, raw in parts.collect():  # one part, of a fixed size
        table[at : at + SLICE_ROWS] = np.frombuffer(raw, dtype=np.int64).reshape(-1, DIM)
    table /= np.linalg.norm(table, axis=1, keepdims=True) + 1e-6
    return [table[:WORD_ROWS].astype(np.float32), table[WORD_ROWS:].astype(np.float32)]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """The model: word and shape tables and the network.  Texts stay on the executors; what comes back has a fixed size."""
    home = shared_dir(docs.sparkSession)
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    sample = materialize(_labelled(docs, labels, fit_rows).repartition(tasks), f"{home}/sample")
    tables = context_tables(docs, home)
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pooled(r, *shared.value).tobytes() for r in all_rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column("y")], names=["x", "y"])

    rows = sample.mapInArrow(features, "x binary, y int").collect()  # at most ``fit_rows``
    rows.sort(key=lambda r: (r.y, bytes(r.x)))  # any order of the tasks gives one model
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), dtype=np.float32).reshape(len(rows), 2 * DIM + 4)
    shared.unpersist()
    return {"words": tables[0], "shapes": tables[1], "network": Network(x, np.array([r.y for r in rows], dtype=np.int64))}


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            x = np.zeros((len(ids), 2 * DIM + 4), dtype=np.float32)
            for i, rows in enumerate(all_rows(batch.column(1))):
                x[i] = pooled(rows, m["words"], m["shapes"])
            score = m["network"].score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fold_of(i) == 0 for i in ids], pa.bool_()), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), as_bytes()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that are predicted good, all columns kept; scored in place, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = np.zeros((batch.num_rows, 2 * DIM + 4), dtype=np.float32)
            for i, rows in enumerate(all_rows(batch.column(where).cast(pa.binary()))):
                x[i] = pooled(rows, m["words"], m["shapes"])
            yield batch.filter(pa.array(m["network"].score(x) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
