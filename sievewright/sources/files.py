"""Scans and sinks: CSV and JSON in the conventions of the data sets, splits, listings, fingerprints, archives.

All paths go through Hadoop's file systems, so they may lie in any store that Spark reads.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File names of samples, the preferred one first.
SAMPLE_NAMES = ("sample_0.csv", "samples_0.csv")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, clean: bool = True) -> DataFrame:
    """``clean``: ``?`` and empty texts are missing, and texts are stripped.  Without a schema types are inferred."""
    reader = spark.read.option("header", True).option("inferSchema", schema is None)
    df = (reader.schema(schema) if schema else reader).csv(path)
    if not clean:
        return df
    text = lambda c: F.nullif(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("?")), F.lit(""))
    out = df.select(*[(text(c) if k == "string" else F.col(f"`{c}`")).alias(c) for c, k in df.dtypes])
    if schema:
        return out
    # A column of numbers and ``?`` is inferred as text: cast those whose every value parses.
    texts = [c for c, k in out.dtypes if k == "string"]
    if not texts:
        return out
    row = out.agg(*[(F.count(F.col(f"`{c}`").try_cast("double")) == F.count(f"`{c}`")).alias(str(i)) for i, c in enumerate(texts)], *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(texts)]).first()
    numeric = {c for i, c in enumerate(texts) if row[str(i)] and row[f"n{i}"]}
    return out.select(*[(F.col(f"`{c}`").cast("double") if c in numeric else F.col(f"`{c}`")).alias(c) for c in out.columns])


def read_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    return spark.read.option("multiLine", not lines).json(path)


def count_rows(spark: SparkSession, path: str) -> int:
    """Data rows of a CSV with a header, without parsing its fields."""
    return max(0, spark.read.text(path).where(F.length("value") > 0).count() - 1)


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).limit(0).columns


def resolve_source(spark: SparkSession, folder: str) -> str:
    """The folder's sample file, the preferred name first; FileNotFoundError without one."""
    for name in SAMPLE_NAMES:
        if exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    raise FileNotFoundError(folder)


def latest(spark: SparkSession, pattern: str) -> str | None:
    """The file of the glob with the latest modification, ties by path; contents aren't read."""
    fs, p = _path(spark, pattern)
    found = fs.globStatus(p)
    return max(((s.getModificationTime(), s.getPath().toString()) for s in found or []), default=(0, None))[1]


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _path(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])


def normalize_names(df: DataFrame) -> DataFrame:
    """Column names without leading blanks; ValueError if two become equal."""
    names = [c.lstrip() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names collide: {sorted(n for n in names if names.count(n) > 1)}")
    return df.toDF(*names)


def resolve_splits(spark: SparkSession, folder: str) -> dict[str, str]:
    """train, holdout and test files: a validation file is the holdout, else the test file is."""
    have = {k: f"{folder}/{k}.csv" for k in ("train", "val", "test") if exists(spark, f"{folder}/{k}.csv")}
    if "train" not in have or "test" not in have:
        raise FileNotFoundError(f"{folder}: train and test are needed")
    return {"train": have["train"], "holdout": have.get("val", have["test"]), "test": have["test"]}


def column_roles(info: dict, columns: Sequence[str]) -> dict[str, list[str]]:
    """Names of an info record's index lists."""
    return {k: [columns[i] for i in info.get(f"{k}_col_idx", [])] for k in ("num", "cat", "target")}


def prepare(splits: dict[str, DataFrame], numeric: Sequence[str], categorical: Sequence[str]) -> tuple[dict[str, DataFrame], list[str]]:
    """(splits with numbers as doubles and categories as text, missing as "nan"; the numeric columns that are whole over all splits)."""
    out = {k: df.select(*[F.col(c).try_cast("double").alias(c) for c in numeric], *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in categorical]) for k, df in splits.items()}
    every = None
    for df in out.values():
        every = df if every is None else every.unionByName(df)
    row = every.agg(*[F.bool_and(F.abs(F.col(c) - F.rint(c)) <= 1e-9).alias(c) for c in numeric]).first() if numeric else {}
    return out, [c for c in numeric if row[c]]


def write_table(df: DataFrame, path: str, kind: str = "parquet", header_row: bool = True) -> None:
    writer = df.write.mode("overwrite")
    {"parquet": writer.parquet, "json": writer.json, "csv": writer.option("header", header_row).csv}[kind](path)


def write_json(spark: SparkSession, value, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_outputs(tables: dict[str, DataFrame], reports: dict[str, dict], folder: str, legacy: Sequence[str] = ()) -> None:
    """A bundle: each table as Parquet, each report as JSON, and listed old files removed."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}")
    for name, report in reports.items():
        write_json(spark, report, f"{folder}/{name}.json")
    for name in legacy:
        fs, p = _path(spark, f"{folder}/{name}")
        fs.delete(p, True)


def fingerprint(spark: SparkSession, paths: Sequence[str], settings: dict | None = None) -> str:
    """Hash of paths, sizes, modification times and settings: a key for reuse of what was made from them."""
    parts = []
    for path in paths:
        fs, p = _path(spark, path)
        s = fs.getFileStatus(p)
        parts.append([path, s.getLen(), s.getModificationTime()])
    return hashlib.sha256(json.dumps([parts, settings or {}], sort_keys=True).encode()).hexdigest()


def shared_table(df: DataFrame, folder: str, key: str) -> DataFrame:
    """Writes ``df`` once under its key; later calls read what is there."""
    spark, path = df.sparkSession, f"{folder}/{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
