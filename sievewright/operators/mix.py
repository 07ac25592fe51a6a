"""Pools drawn from several sources with lineage, integer allocations, set operations."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.scalars import largest_remainders
from sievewright.operators.ranks import global_row_number


def draw_seed(seed: int, draw_index: int, source_id: str) -> int:
    return seed + 997 * (draw_index + 1) + sum(map(ord, source_id))


def draw(source: DataFrame, source_id: str, id_column: str, rows: int, seed: int, draw_index: int, order=None) -> DataFrame:
    """``rows`` rows of a source with lineage; with replacement only where more rows are asked for than it has.

    Without: the first rows of a fixed shuffle.  With: each draw hashes to a row number, and the numbers are joined.
    """
    n = source.count()
    replace = rows > n
    key = F.xxhash64(F.lit(draw_seed(seed, draw_index, source_id)), F.col(id_column)) if order is None else order
    if not replace:
        own = global_row_number(source.orderBy(key, id_column).limit(rows), [key, F.col(id_column)], "draw_local_index")
        out = own.withColumn("draw_local_index", F.col("draw_local_index") - 1)
    else:
        numbered = global_row_number(source, [F.col(id_column)], "__row")
        picks = source.sparkSession.range(rows if n else 0).select(
            F.col("id").alias("draw_local_index"), (F.pmod(F.xxhash64(F.lit(draw_seed(seed, draw_index, source_id)), F.col("id")), F.lit(max(n, 1))) + 1).alias("__row")
        )
        out = picks.join(numbered, "__row").drop("__row")
    return out.withColumns({
        "source_id": F.lit(source_id), "source_row_id": F.col(id_column), "draw_index": F.lit(draw_index),
        "sample_seed": F.lit(draw_seed(seed, draw_index, source_id)).cast("long"), "with_replacement": F.lit(replace),
    })


def build_pool(sources: dict[str, DataFrame], units: Sequence[tuple[str, int]], train_rows: int, id_column: str, seed: int = 42) -> DataFrame:
    """The draws of all units after one another, cut to the summed multiplier's rows, with ``pool_row_id`` from 0.

    A single unit of a single source is that source as it is.
    """
    if len(units) == 1 and len(sources) == 1:
        name = units[0][0]
        own = global_row_number(sources[name], [F.col(id_column)], "pool_row_id").withColumn("pool_row_id", F.col("pool_row_id") - 1)
        return own.withColumns({"source_id": F.lit(name), "source_row_id": F.col(id_column), "draw_index": F.lit(0), "draw_local_index": F.col("pool_row_id"), "sample_seed": F.lit(None).cast("long"), "with_replacement": F.lit(False)})
    out, start = None, 0
    for i, (name, multiplier) in enumerate(units):
        rows = max(1, multiplier * train_rows)
        part = draw(sources[name], name, id_column, rows, seed, i).withColumn("pool_row_id", F.col("draw_local_index") + start)
        out = part if out is None else out.unionByName(part)
        start += rows
    return out.where(F.col("pool_row_id") < max(1, sum(m for _, m in units) * train_rows))


def allocate_units(weights: dict[str, float], sources: Sequence[str], total: int, min_sources: int = 2) -> list[tuple[str, int]] | None:
    """The heaviest sources, a unit each, and the other units by weight; None if there are too few sources."""
    place = {s: i for i, s in enumerate(sources)}
    heaviest = sorted((s for s in place if weights.get(s, 0) > 0), key=lambda s: (-weights[s], place[s]))[:total]
    if min(len(heaviest), total) < min_sources:
        return None
    chosen = sorted(heaviest, key=place.__getitem__)
    more = largest_remainders([weights[s] for s in chosen], total - len(chosen))
    return [(s, 1 + n) for s, n in zip(chosen, more, strict=True)]


def balanced_units(sources: Sequence[str], total: int, min_sources: int = 2) -> list[tuple[str, int]]:
    chosen = list(sources)[:total]
    if len(chosen) < min_sources:
        raise ValueError("too few sources or units for a mixed pool")
    return [(s, total // len(chosen) + (i < total % len(chosen))) for i, s in enumerate(chosen)]


def canonical_key(units: Iterable[tuple[str, float]]) -> str:
    rows = sorted(({"source_id": s, "multiplier": int(m) if float(m).is_integer() else round(float(m), 6)} for s, m in units), key=lambda x: (x["source_id"], x["multiplier"]))
    return json.dumps(rows, sort_keys=True, separators=(",", ":"))


def diverse_pools(sources: Sequence[str], total: int, count: int, min_sources: int = 2, seen: Iterable[str] = ()) -> list[list[tuple[str, int]]]:
    """Balanced pools of source subsets with unseen keys, taking subset sizes in turn."""
    known, by_size = set(seen), {}
    for size in range(min_sources, min(len(sources), total) + 1):
        for subset in combinations(sources, size):
            units = balanced_units(subset, total, min_sources)
            key = canonical_key(units)
            if key not in known:
                known.add(key)
                by_size.setdefault(size, []).append(units)
    out: list[list[tuple[str, int]]] = []
    while len(out) < count and any(by_size.values()):
        for size in sorted(by_size):
            if by_size[size] and len(out) < count:
                out.append(by_size[size].pop(0))
    return out


def sample_rows(df: DataFrame, id_column: str, most: int, seed: int) -> DataFrame:
    """The first ``most`` rows of a fixed shuffle."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(id_column)), id_column).limit(most)


def except_ids(df: DataFrame, other: DataFrame, id_column: str) -> DataFrame:
    return df.join(other.select(id_column), id_column, "left_anti")


def selected_then_pool(selected: DataFrame, pool: DataFrame, id_column: str) -> DataFrame:
    """The selected rows, then those of the pool whose id isn't selected."""
    return selected.withColumn("part", F.lit(0)).unionByName(except_ids(pool, selected, id_column).withColumn("part", F.lit(1)), allowMissingColumns=True)


def common_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def theta_id(theta: dict) -> str:
    """First 12 hex digits of the SHA-1 of the canonical JSON."""
    return hashlib.sha1(json.dumps(theta, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]
