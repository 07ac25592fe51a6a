"""The driver's tables in the roles of real, held-out and synthetic rows.

Splits of ``lineitem`` by ``l_orderkey % 10``: 0 to 5 train, 6 holdout, 7 test, 8 and 9 synthetic candidates.
Columns: numeric ``qty`` and ``price``, discrete ``line``, categorical ``flag``, target ``status``.
``row_id`` is content-derived (60 bits of an MD5), so it needs no global numbering, and its order is a fixed shuffle.
``SQL`` states the same for DuckDB.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Roles:
    """Column roles of a table."""

    numeric: tuple[str, ...] = ()
    discrete: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    target: str | None = None
    task: str = "binclass"
    extra: dict = field(default_factory=dict)

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(c for c in self.columns if c != self.target)

    @property
    def columns(self) -> tuple[str, ...]:
        own = (*self.numeric, *self.discrete, *self.categorical)
        return own if self.target is None or self.target in own else (*own, self.target)

    @property
    def labels(self) -> tuple[str, ...]:
        """Categorical columns, with the target of a classification task."""
        extra = () if self.target is None or self.target in (*self.numeric, *self.discrete, *self.categorical) else (self.target,)
        return (*self.categorical, *extra)

    def kind(self, column: str) -> str:
        return "numerical" if column in self.numeric else "discrete_numerical" if column in self.discrete else "categorical"


LINEITEM = Roles(("qty", "price"), ("line",), ("flag",), "status")
SPLITS = {"train": (0, 1, 2, 3, 4, 5), "holdout": (6,), "test": (7,), "pool": (8, 9)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    text = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents("l_quantity"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"), "l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").select(
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("row_id"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.pmod("l_orderkey", F.lit(10)).cast("int").alias("fold"),
    )


def split(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return lineitem(spark, sf_dir).where(F.col("fold").isin(*SPLITS[name])).drop("fold")


def dirty_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates as text-like dirty rows: blanks, cases, numbers as text, values out of range, missing tokens."""
    m = lambda k: F.pmod("row_id", F.lit(k)) == 0
    return split(spark, sf_dir, "pool").select(
        F.col("row_id").alias("candidate_id"),
        F.when(m(17), "abc").when(m(19), F.lit(None)).otherwise((F.col("qty") + F.when(m(13), 100).otherwise(0)).cast("string")).alias("qty"),
        (F.col("price") - F.when(m(23), 1e6).otherwise(0)).cast("string").alias("price"),
        F.when(m(29), "x7").otherwise((F.col("line") + F.when(m(11), 0.5).otherwise(0)).cast("string")).alias("line"),
        F.when(m(31), "Q").when(m(7), F.lower("flag")).when(m(5), F.concat(F.lit(" "), "flag", F.lit(" "))).when(m(37), "nan").otherwise(F.col("flag")).alias("flag"),
        F.when(m(41), F.lit(None)).otherwise(F.col("status")).alias("status"),
    )


#: Common table expressions: base, train, holdout, test, pool.
SQL = """
base as (select ('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity * 100)::bigint, round(l_extendedprice * 100)::bigint,
    round(l_discount * 100)::bigint, round(l_tax * 100)::bigint, l_returnflag, l_linestatus)), 1, 15))::bigint as row_id,
    l_quantity as qty, l_extendedprice as price, l_linenumber::bigint as line, l_returnflag as flag, l_linestatus as status, l_orderkey % 10 as fold from lineitem),
train as (select * from base where fold < 6), holdout as (select * from base where fold = 6), test as (select * from base where fold = 7), pool as (select * from base where fold > 7)
"""
DIRTY_SQL = """
dirty as (select row_id as candidate_id,
    case when row_id % 17 = 0 then 'abc' when row_id % 19 = 0 then null else (qty + case when row_id % 13 = 0 then 100 else 0 end)::varchar end as qty,
    (price - case when row_id % 23 = 0 then 1e6 else 0 end)::varchar as price,
    case when row_id % 29 = 0 then 'x7' else (line + case when row_id % 11 = 0 then 0.5 else 0 end)::double::varchar end as line,
    case when row_id % 31 = 0 then 'Q' when row_id % 7 = 0 then lower(flag) when row_id % 5 = 0 then ' ' || flag || ' ' when row_id % 37 = 0 then 'nan' else flag end as flag,
    case when row_id % 41 = 0 then null else status end as status from pool)
"""
