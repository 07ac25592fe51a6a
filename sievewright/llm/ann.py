"""Embedding near-duplicates by product quantisation.

Equal vectors of one label form a class.  Coarse centroids and codebooks of the residuals' subspaces are fitted on at most ``FIT_ROWS``
classes; every class is then coded and put in the inverted list of its nearest centroid, within its label.  Lists grow with the table: above
``MOST_COARSE`` of them, a second set of centroids, shared by all first ones, divides each list.  Each class searches its ``probes``
nearest lists, a number that doesn't grow: a table of its products with the codewords gives approximate similarities by look-up alone, and
candidates are ranked again by exact cosine in double precision.

No link is lost in a probed list.  With y = d + e, d the decoded vector: q.y = q.d + y.e + (q - y).e, and linked unit vectors are
no further apart than sqrt(2 - 2 limit).  Each vector keeps y.e and the length of e with its codes, and every q with
q.d + y.e + sqrt(2 - 2 limit) |e| >= limit is a candidate: codes of any number of dimensions only change how many are ranked again.

A pair that either side can find is counted once, for both ends: by the class with the smaller number, or by the other one if
only that probes the right list.  Lists are searched in groups; a group's vectors and its queries are both dealt into parts of bounded
size, and every two parts meet in a task.  What leaves a task is counts of links and a forest with the links' components, never the pairs.

Cases.  Null label, null vec_id, null or empty vector, a zero vector, null, NaN or infinite components: links with nothing,
its own component.  Vectors of different lengths don't link.  Labels may be of any type that groups.  Repeated rows and equal vectors link
with each other.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm._util import local_components, materialize, shared_dir
from sievewright.llm.components import connected_components

#: The bound on classes that centroids and codebooks are fitted on, and on centroids of either level.
FIT_ROWS, MOST_COARSE = 20_000, 2048
#: Classes of a list, in expectation.
LIST_ROWS = 256
#: Codewords of a subspace; subspaces have 4 dimensions, or more where that would be over 96 subspaces.
CODES, SUBSPACE, MOST_SUBSPACES = 64, 4, 96
#: Vector components of a part, and queries for each vector of a part.
PART_COMPONENTS, PART_ASKS = 1 << 19, 8


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, safe for any finite scale."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, keep_length: bool = False, seed: int = 5) -> np.ndarray:
    """Centroids; with ``keep_length`` as long as their members are on average.

    Means of scattered vectors are short and close to each other, though their lists aren't; at full length, distances
    between centroids are comparable with those between vectors.
    """
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    length = np.linalg.norm(x, axis=1)
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        used, start, n = np.unique(near[order], return_index=True, return_counts=True)
        mean = np.add.reduceat(x[order], start, axis=0) / n[:, None]
        if keep_length:
            mean *= (np.add.reduceat(length[order], start) / n / np.maximum(np.linalg.norm(mean, axis=1), 1e-12))[:, None]
        c[used] = mean
    return c


def nearest(x: np.ndarray, c: np.ndarray, m: int, step: int = 4096) -> np.ndarray:
    """Numbers of the m nearest rows of c for each row of x, nearest first."""
    m = min(m, len(c))
    out = np.empty((len(x), m), dtype=np.int64)
    half = (c * c).sum(axis=1) / 2
    for low in range(0, len(x), step):
        out[low : low + step] = _smallest(half - x[low : low + step] @ c.T, m)
    return out


def _smallest(d: np.ndarray, m: int) -> np.ndarray:
    """Columns of the m smallest values of each row, in ascending order."""
    if m == 1:
        return d.argmin(axis=1)[:, None]
    part = np.argpartition(d, m - 1, axis=1)[:, :m] if m < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, axis=1), axis=1, kind="stable"), axis=1)


def thinned(c: np.ndarray, gap: float) -> np.ndarray:
    """Centroids without those that lie within ``gap`` of an earlier one."""
    keep: list[int] = []
    for i in range(len(c)):
        if not keep or ((c[keep] - c[i]) ** 2).sum(axis=1).min() > gap * gap:
            keep.append(i)
    return c[keep]


class Quantizer:
    """Coarse centroids of two levels, and codebooks for the parts of what they leave.

    A dense group draws many centroids, more than a query probes; as all in it link, those within ``gap`` make one list.
    """

    def __init__(self, sample: np.ndarray, lists: int, gap: float = 0.0):
        first = min(MOST_COARSE, lists)
        self.coarse = thinned(kmeans(sample, first, keep_length=True), gap)
        rest = sample - self.coarse[nearest(sample, self.coarse, 1)[:, 0]]
        second = min(MOST_COARSE, -(-lists // first))
        self.fine = thinned(kmeans(rest, second, keep_length=True), gap) if second > 1 else np.zeros((1, sample.shape[1]))
        rest = sample - self.centre(self.cells(sample, 1)[:, 0])
        dim = sample.shape[1]
        self.parts = np.array_split(np.arange(dim), min(MOST_SUBSPACES, -(-dim // SUBSPACE)))
        self.books = [kmeans(rest[:, p], CODES) for p in self.parts]

    @property
    def lists(self) -> int:
        return len(self.coarse) * len(self.fine)

    def centre(self, cells: np.ndarray) -> np.ndarray:
        return self.coarse[cells // len(self.fine)] + self.fine[cells % len(self.fine)]

    def cells(self, x: np.ndarray, m: int) -> np.ndarray:
        """Numbers of the m nearest lists, nearest first; those of the m nearest first-level centroids are looked at, one at the least."""
        first = nearest(x, self.coarse, max(m, 2))
        if len(self.fine) == 1:
            return first[:, :m]
        out = np.empty((len(x), min(m, first.shape[1] * len(self.fine))), dtype=np.int64)
        length = (self.fine * self.fine).sum(axis=1)
        step = max(1, (1 << 22) // (first.shape[1] * max(len(self.fine), x.shape[1])))
        for low in range(0, len(x), step):
            f = first[low : low + step]
            rest = x[low : low + step, None, :] - self.coarse[f]
            d = ((rest * rest).sum(axis=2)[:, :, None] - 2 * rest @ self.fine.T + length).reshape(len(f), -1)
            best = _smallest(d, out.shape[1])
            out[low : low + step] = np.take_along_axis(f, best // len(self.fine), axis=1) * len(self.fine) + best % len(self.fine)
        return out

    def code(self, x: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, product with the error, length of the error) of each vector."""
        rest = x - self.centre(cells)
        codes = np.stack([nearest(rest[:, p], b, 1)[:, 0] for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            rest[:, p] -= b[codes[:, k]]
        return codes, (x * rest).sum(axis=1), np.linalg.norm(rest, axis=1)

    def similarities(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Products of the decoded vectors of one list (rows) with queries: sums of looked-up products."""
        out = np.repeat((q @ self.centre(np.array([cell]))[0]).astype(np.float32)[None, :], len(codes), axis=0)
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out += (b @ q[:, p].T).astype(np.float32)[codes[:, k]]
        return out


def usable(label: str = "label", vector: str = "embedding", name: str = "vec_id") -> Column:
    e = F.col(vector).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.col(label).isNotNull() & F.col(name).isNotNull() & F.forall(e, fine) & F.exists(e, lambda x: fine(x) & (x != 0)), F.lit(False))


def classes_of(vectors: DataFrame) -> DataFrame:
    """(label, embedding, n, first): distinct usable vectors; ``first`` is the smallest vec_id."""
    return vectors.where(usable()).groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def deal(index: DataFrame, lists: int, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """(asks, data): queries and coded vectors by (label, grp, d, q): part d of the group's vectors, part q of its queries.

    Consecutive lists of a label make a group of about ``part_rows`` vectors, so a query goes to a group once, whatever the number of
    its lists there.  The side tables have a row for each label and each group; Spark broadcasts them only if they are small.
    """
    groups = index.groupBy("label").agg(F.ceil(F.count("*") / part_rows).alias("groups"))
    grouped = index.join(groups, "label").withColumn("__grp", group_of("cell", lists))
    to = F.array_distinct(F.transform("probes", lambda x: group_of(x, lists)))
    sent = grouped.select("label", "id", F.explode(to).alias("grp"))
    held = grouped.groupBy("label", F.col("__grp").alias("grp")).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("ds"))
    asked = sent.groupBy("label", "grp").agg(F.ceil(F.count("*") / (PART_ASKS * part_rows)).cast("int").alias("qs"))
    sizes = materialize(held.join(asked, ["label", "grp"]), shared_dir(index.sparkSession))
    mine = lambda parts: F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    data = grouped.withColumnRenamed("__grp", "grp").join(sizes, ["label", "grp"]).withColumn("d", mine("ds")).withColumn("q", every("qs"))
    asks = grouped.withColumn("grp", F.explode(to)).join(sizes, ["label", "grp"]).withColumn("q", mine("qs")).withColumn("d", every("ds"))
    # Fresh column identities: both sides stem from one index.
    fresh = lambda df, names: df.select([F.col(c).alias(c) for c in names])
    key = ["label", "grp", "d", "q", "id", "n", "embedding", "probes"]
    return fresh(asks, key), fresh(data, [*key, "cell", "codes", "shift", "error"])


def group_of(cell, lists: int) -> Column:
    """The group of a list: its share of the way through all lists."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    return F.floor(cell * F.col("groups") / F.lit(lists)).cast("long")


def search(index: DataFrame, model: Quantizer, dim: int, limit: float) -> DataFrame:
    """(kind, id, value): links of a class (0) and edges of the forest (1)."""
    asks, data = deal(index, model.lists, max(64, PART_COMPONENTS // dim))
    shared = index.sparkSession.sparkContext.broadcast(model)  # at most 2 * MOST_COARSE centroids, and CODES codewords a subspace
    kinds, names = [pa.int32(), pa.int64(), pa.int64()], ["kind", "id", "value"]
    reach = float(np.sqrt(max(0.0, 2 - 2 * limit)))

    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        m = shared.value
        qi, di, qn, dn = (t[c].to_numpy() for t, c in ((q, "id"), (d, "id"), (q, "n"), (d, "n")))
        qx, dx = unit(_matrix(q["embedding"], dim)), unit(_matrix(d["embedding"], dim))
        qp, dp = (_matrix(t["probes"], len(t["probes"][0])) for t in (q, d))
        cells = d["cell"].to_numpy()
        codes = np.frombuffer(b"".join(d["codes"].to_pylist()), dtype=np.uint8).reshape(len(di), -1)
        # What a look-up must reach; the last term covers the rounding of single precision.
        least = (limit - d["shift"].to_numpy() - reach * d["error"].to_numpy() - 1e-5).astype(np.float32)
        ids, inverse = np.unique(np.concatenate((qi, di)), return_inverse=True)
        qa, da = inverse[: len(qi)], inverse[len(qi) :]
        links, label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        by_cell = np.argsort(qp, axis=None, kind="stable")
        asked = qp.ravel()[by_cell]
        for one in np.unique(cells):
            asking, inside = by_cell[np.searchsorted(asked, one) : np.searchsorted(asked, one, "right")] // qp.shape[1], np.flatnonzero(cells == one)
            step = max(1, (1 << 20) // len(inside))
            for low in range(0, len(asking), step):
                some = asking[low : low + step]
                b, a = np.nonzero(m.similarities(qx[some], one, codes[inside]) >= least[inside, None])
                a, b = some[a], inside[b]
                # Each pair once: the smaller number asks, or the larger if the smaller doesn't probe its list.
                keep = (qi[a] < di[b]) | ((qi[a] > di[b]) & ~(dp[b] == qp[a, 0][:, None]).any(axis=1))
                a, b = a[keep], b[keep]
                exact = np.concatenate([np.einsum("ij,ij->i", qx[a[k : k + 65536]], dx[b[k : k + 65536]]) for k in range(0, len(a), 65536)] or [np.zeros(0)]) >= limit
                a, b = a[exact], b[exact]
                if len(a):
                    np.add.at(links, qa[a], dn[b])
                    np.add.at(links, da[b], qn[a])
                    label = local_components(len(label), label[qa[a]], label[da[b]])[label]
        some, child = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(ids)))
        out = [np.repeat([0, 1], [len(some), len(child)]).astype(np.int32), ids[np.concatenate((some, child))], np.concatenate((links[some], ids[label[child]]))]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    key = ("label", "grp", "d", "q")
    return asks.groupBy(*key).cogroup(data.groupBy(*key)).applyInArrow(run, "kind int, id long, value long")


def near_duplicates(vectors: DataFrame, limit: float = 0.93, probes: int = 24) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    home = shared_dir(spark)
    ids = materialize(classes_of(vectors).withColumn("id", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), f"{home}/classes")
    found = None
    for dim, n in sorted((r.dim, r["count"]) for r in ids.groupBy("dim").count().collect()):
        own = ids.where(F.col("dim") == dim)
        index, model = fitted(own, dim, n, limit, probes)
        links = materialize(search(materialize(index, f"{home}/index{dim}"), model, dim, limit), f"{home}/found{dim}")
        found = links if found is None else found.unionAll(links)
    if found is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    groups = connected_components(found.where("kind = 1").select(F.col("id").alias("a"), F.col("value").alias("b")))
    counts = found.where("kind = 0").groupBy("id").agg(F.sum("value").alias("links"))
    named = ids.join(groups, "id", "left").join(counts, "id", "left")
    smallest = named.where("component is not null").groupBy("component").agg(F.min("first").alias("smallest"))
    done = materialize(
        named.join(smallest, "component", "left").select(
            F.col("label").alias("c_label"), F.col("embedding").alias("c_embedding"), "n",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("smallest", "first").alias("component"),
        ),
        f"{home}/done",
    )
    rows = vectors.select("vec_id", "label", "embedding")
    same = (F.col("label") == F.col("c_label")) & (F.col("embedding") == F.col("c_embedding"))
    # Vectors that are more than one row in 1024 would crowd one task; they are at most 1024 classes.
    total = ids.agg(F.sum("n")).first()[0]
    often = F.broadcast(done.where(F.col("n") * 1024 > total))
    few = done.where(F.col("n") * 1024 <= total)
    good = rows.where(usable())
    joined = good.join(often, same).unionByName(good.join(often, same, "left_anti").join(few, same, "left"), allowMissingColumns=True)
    joined = joined.unionByName(rows.where(~usable()), allowMissingColumns=True)
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def fitted(classes: DataFrame, dim: int, n: int, limit: float, probes: int) -> tuple[DataFrame, Quantizer]:
    """The index over ``n`` classes of one length, and its model, fitted on the ``FIT_ROWS`` classes with the smallest hashes."""
    sample = classes.orderBy(F.xxhash64("id")).limit(FIT_ROWS).select("embedding").toArrow()["embedding"]
    # Two thirds of the distance at which unit vectors link.
    model = Quantizer(unit(_matrix(sample, dim)), max(1, n // LIST_ROWS), np.sqrt(max(0.0, 2 - 2 * limit)) / 1.5)
    return _coded(classes, model, dim, min(model.lists, probes)), model


def _coded(classes: DataFrame, model: Quantizer, dim: int, probes: int) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(model)
    kinds = dict(classes.dtypes)
    schema = f"label {kinds['label']}, id long, n long, embedding {kinds['embedding']}, cell long, probes array<long>, codes binary, shift double, error double"

    def run(batches):
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column("embedding"), dim))
            near = m.cells(x, probes)
            codes, shift, error = m.code(x, near[:, 0])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.ravel()))
            new = [pa.array(near[:, 0]), lists, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(shift), pa.array(error)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "cell", "probes", "codes", "shift", "error"])

    return classes.select("label", "id", "n", "embedding").mapInArrow(run, schema)
