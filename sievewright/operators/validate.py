"""Row validation and repair, required-missing filter, duplicates, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.functions import scalars as S
from sievewright.operators.cards import Cards

#: Texts that count as missing, lower case.
MISSING = ("", "na", "nan", "none", "null")


def _numeric(c: str, cards: Cards) -> tuple[Column, Column, Column]:
    """(value, reason, action): not a number rejects; out of range clips; NaN stays NaN and counts as clipped."""
    low, high = float(cards.stats[c]["min"]), float(cards.stats[c]["max"])
    x = F.trim(F.col(c).cast("string")).try_cast("double")
    value = F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))
    return value, F.when(x.isNull(), F.lit(f"invalid_numeric:{c}")), F.when(F.isnan(x) | (x < low) | (x > high), F.lit(f"numeric_clip:{c}"))


def _discrete(c: str, cards: Cards) -> tuple[Column, Column, Column]:
    """Snaps to the nearest legal value, the lowest on ties; NaN snaps to the first."""
    legal = cards.legal[c]
    x = F.trim(F.col(c).cast("string")).try_cast("double")
    value = F.get(S.doubles(legal), S.nearest_legal(x, legal))
    return value, F.when(x.isNull(), F.lit(f"invalid_discrete:{c}")), F.when(F.isnan(x) | (value != x), F.lit(f"discrete_snap:{c}"))


def _category(c: str, cards: Cards) -> tuple[Column, Column, Column]:
    """Missing tokens give the most frequent value; else the exact, the case-insensitive, or the equal whole number."""
    legal = cards.legal[c]
    x = F.trim(F.col(c).cast("string"))
    lower, numbers = {}, {}
    for v in legal:
        lower.setdefault(v.lower(), v)
        try:
            if abs(float(v) - round(float(v))) <= 1e-12:
                numbers.setdefault(int(round(float(v))), v)
        except (ValueError, OverflowError):
            pass
    known = F.create_map(*[y for v in legal for y in (F.lit(v), F.lit(v))])
    folded = F.create_map(*[y for k, v in lower.items() for y in (F.lit(k), F.lit(v))])
    missing = x.isNull() | F.lower(x).isin(*MISSING) & ~x.isin(*legal)
    by_case = folded[F.lower(x)]
    by_number = F.lit(None).cast("string")
    if numbers:
        d = x.try_cast("double")
        whole = F.when((F.abs(d) < 9e15) & (F.abs(d - F.rint(d)) <= 1e-12), F.rint(d).cast("long"))
        by_number = F.create_map(*[y for k, v in numbers.items() for y in (F.lit(k).cast("long"), F.lit(v))])[whole]
    value = F.when(missing, F.lit(cards.most_frequent[c])).otherwise(F.coalesce(known[x], by_case, by_number))
    action = (
        F.when(missing, F.lit(f"missing_fill:{c}"))
        .when(known[x].isNotNull(), F.lit(None).cast("string"))
        .when(by_case.isNotNull(), F.lit(f"category_case_normalize:{c}"))
        .when(by_number.isNotNull(), F.lit(f"category_numeric_normalize:{c}"))
    )
    return value, F.when(~missing & value.isNull(), F.lit(f"invalid_category:{c}")), action


def validate(df: DataFrame, cards: Cards, id_column: str = "candidate_id") -> DataFrame:
    """id, repaired columns, ``reason`` (first failing column in order, or null) and ``repair_actions``.

    Missing or unknown columns reject every row.  One narrow projection: no shuffle.
    """
    columns = cards.roles.columns
    lacking = [c for c in columns if c not in df.columns]
    unknown = [c for c in df.columns if c not in columns and c != id_column]
    if lacking or unknown:
        reason = f"missing_columns:{','.join(lacking)}" if lacking else f"unknown_columns:{','.join(unknown)}"
        empty = [F.lit(None).cast("double" if c in (*cards.roles.numeric, *cards.roles.discrete) else "string").alias(c) for c in columns]
        return df.select(id_column, *empty, F.lit(reason).alias("reason"), F.array().cast("array<string>").alias("repair_actions"))
    makers = {"numerical": _numeric, "discrete_numerical": _discrete, "categorical": _category}
    done = {c: makers[cards.roles.kind(c)](c, cards) for c in columns}
    reason = F.coalesce(*[r for _, r, _ in done.values()])
    return df.select(
        id_column, *[v.alias(c) for c, (v, _, _) in done.items()], reason.alias("reason"),
        F.when(reason.isNull(), F.array_compact(F.array(*[a for _, _, a in done.values()]))).otherwise(F.array().cast("array<string>")).alias("repair_actions"),
    )


def histogram(validated: DataFrame) -> DataFrame:
    """(kind, name, count): reject reasons and repair actions, in one pass over the rows."""
    names = F.when(F.col("reason").isNotNull(), F.array("reason")).otherwise(F.col("repair_actions"))
    rows = validated.select(F.explode(names).alias("name"), F.col("reason").alias("__r"))
    kind = F.when(F.col("__r").isNotNull(), "reject").otherwise("repair")
    return rows.groupBy(kind.alias("kind"), "name").agg(F.count("*").alias("count"))


def required_missing(df: DataFrame, cards: Cards) -> DataFrame:
    """Adds ``reason``: the columns that may not be missing and are, or null."""
    gaps = [F.when(F.col(c).isNull() | (F.isnan(c) if c in (*cards.roles.numeric, *cards.roles.discrete) else F.lit(False)), F.lit(c)) for c in cards.roles.columns if not cards.missing_allowed.get(c)]
    names = F.array_compact(F.array(*gaps)) if gaps else F.array().cast("array<string>")
    return df.withColumn("reason", F.when(F.size(names) > 0, F.concat(F.lit("missing_required:"), F.array_join(names, ","))))


def deduplicate(df: DataFrame, columns, id_column: str) -> DataFrame:
    """The row with the smallest id of each group of equal rows, by partial aggregation (hot groups cost one row a task)."""
    others = [c for c in df.columns if c not in columns and c != id_column]
    first = F.min(F.struct(F.col(id_column), *others)).alias("__first")
    return df.groupBy(*columns).agg(first).select(F.col("__first")[id_column].alias(id_column), *columns, *[F.col("__first")[c].alias(c) for c in others])


def attach_source(df: DataFrame, sources: DataFrame, id_column: str = "candidate_id") -> DataFrame:
    """Left join of (id, source_id)."""
    return df.join(sources.select(F.col(id_column).alias("__id"), "source_id"), F.col(id_column) == F.col("__id"), "left").drop("__id")


def split_current(df: DataFrame, order: Column, size: int, keep: int) -> tuple[DataFrame, DataFrame]:
    """(current subset, pool): the first d rows of the shuffle, and the rest; d = min(size, max(1, n - min(keep, n)))."""
    n = df.count()
    d = min(size, max(1, n - min(keep, n)))
    # Only the limit's last key is needed to tell both sides apart.
    last = df.select(order.alias("k")).orderBy("k").limit(d).agg(F.max("k")).first()[0]
    return df.where(order <= F.lit(last)), df.where(order > F.lit(last))


def column_split(df: DataFrame, share: float = 0.95) -> DataFrame:
    """(column, numeric_share, role): numeric if at least ``share`` of the non-null texts parse as numbers."""
    from sievewright.operators.cards import long_values

    own = long_values(df, df.columns).where("value is not null").groupBy("column").agg(F.avg(F.col("value").try_cast("double").isNotNull().cast("int")).alias("numeric_share"))
    return own.withColumn("role", F.when(F.col("numeric_share") >= share, "numeric").otherwise("categorical"))


def align_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Columns in the wanted order, matched exactly or after stripping; else ValueError with missing and extra names."""
    by_name = {c.strip(): c for c in df.columns}
    missing = [c for c in wanted if c not in df.columns and c.strip() not in by_name]
    extra = [c for c in df.columns if c not in wanted and c.strip() not in {w.strip() for w in wanted}]
    if missing or extra or len(by_name) != len(df.columns):
        raise ValueError(f"columns don't match: missing {missing}, extra {extra}")
    return df.select(*[F.col(f"`{c if c in df.columns else by_name[c.strip()]}`").alias(c) for c in wanted])


def first_by_key(df: DataFrame, key, order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")
