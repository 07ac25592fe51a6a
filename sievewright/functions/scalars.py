"""Column expressions: bucket codes, scores of probabilities, safe parsing, small formulas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


def _passed(tests: Sequence[Column]) -> Column:
    """How many of the comparisons hold.  Plain sums stay in generated code; array lambdas wouldn't."""
    parts = [t.cast("int") for t in tests]
    return sum(parts[1:], parts[0]) if parts else F.lit(0)


def bucket_numeric(x: Column, edges: Sequence[float]) -> Column:
    """Number of interior edges at or below x; 0 with two edges or fewer.  Values outside fall in the end buckets."""
    return F.when(x.isNotNull(), _passed([x >= F.lit(float(e)) for e in edges[1:-1]]))


def bucket_right_closed(x: Column, edges: Sequence[float]) -> Column:
    """As quantile cuts number their intervals: the first interior edge at or above x."""
    return F.when(x.isNotNull(), _passed([x > F.lit(float(e)) for e in edges[1:-1]]))


def nearest_legal(x: Column, legal: Sequence[float]) -> Column:
    """Position of the nearest of the sorted legal values, the lowest one on ties and for NaN."""
    middles = [(a + b) / 2 for a, b in zip(legal, legal[1:], strict=False)]
    return F.when(x.isNotNull(), F.when(F.isnan(x), F.lit(0)).otherwise(_passed([x > F.lit(float(m)) for m in middles])))


def bucket_category(x: Column, values: Sequence[str]) -> Column:
    """Position in the legal values, -1 for others and null."""
    known = F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
    return F.coalesce(F.array_position(known, x).cast("int"), F.lit(0)) - 1


def pair_code(left: Column, right: Column, right_bins: int) -> Column:
    return F.when((left < 0) | (right < 0), F.lit(-1).cast("long")).otherwise(left.cast("long") * right_bins + right)


def lookup(code: Column, values: Sequence[float], missing: float) -> Column:
    """values[code], or ``missing`` for unknown codes."""
    return F.coalesce(F.get(doubles(values), code.cast("int")), F.lit(float(missing)))


def geometric_mean(parts: Sequence[Column]) -> Column:
    """Of probabilities clipped to [1e-12, 1]; 1 without parts."""
    if not parts:
        return F.lit(1.0)
    logs = [F.ln(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0))) for p in parts]
    return F.exp(sum(logs[1:], logs[0]) / len(logs))


def finite(x: Column) -> Column:
    """The number, or null if it isn't one."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def scaled(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low) clipped to [0, 1]; 0 on an empty range."""
    return F.when(high - low <= 1e-12, F.lit(0.0)).otherwise(clip((x - low) / (high - low), 0, 1))


def encoded_feature(name: Column) -> Column:
    """``feature=value`` gives ``feature``."""
    return F.split_part(name, F.lit("="), F.lit(1))


def parse_prior(text: str) -> dict[str, float]:
    """``src:w,src:w``; weights must be finite and not negative."""
    out: dict[str, float] = {}
    for part in (p.strip() for p in text.split(",")):
        if part:
            name, sep, weight = part.rpartition(":")
            value = float(weight) if sep else float("nan")
            if not name.strip() or not 0 <= value < float("inf"):
                raise ValueError(f"not a source and weight: {part!r}")
            out[name.strip()] = value
    return out


def shifted_geomean(parts: Sequence[Column], weights: Sequence[float], shift: float = 0.05) -> Column:
    """prod((x + shift) / (1 + shift)) ** weight over weights that sum to one."""
    total = sum(weights)
    logs = [F.ln((p + shift) / (1 + shift)) * (w / total) for p, w in zip(parts, weights, strict=True)]
    return F.exp(sum(logs[1:], logs[0]))


def largest_remainders(weights: Sequence[float], total: int) -> list[int]:
    """Whole numbers that sum to ``total`` in proportion to the weights (equal ones if all are 0); what the floors leave goes to the largest fractions, earlier ones first."""
    if not weights:
        return []
    mass = sum(weights)
    shares = [total * w / mass if mass > 0 else total / len(weights) for w in weights]
    out = [int(x) for x in shares]
    for i in sorted(range(len(out)), key=lambda i: out[i] - shares[i])[: total - sum(out)]:
        out[i] += 1
    return out


def number_text(value: Column) -> Column:
    """A double's shortest digits: plain from 1e-4 to below 1e16, as DuckDB and Python write it, else with an exponent of two digits or more.

    A cast writes exponents from 1e7 and below 1e-3.
    """
    own = value.cast("string")
    exponent = F.when(F.contains(own, F.lit("E")), F.substring_index(own, "E", -1).try_cast("int"))
    plain = F.regexp_replace(F.regexp_replace(own.try_cast("decimal(38,21)").cast("string"), "0+$", ""), "\\.$", ".0")
    power = F.concat(F.regexp_replace(F.substring_index(own, "E", 1), "\\.0$", ""), F.when(exponent < 0, "e-").otherwise("e+"), F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent).cast("string"))
    return F.when(exponent.isNull(), own).when((exponent >= -4) & (exponent < 16), plain).otherwise(power)


def rounded_text(value: Column, digits: int) -> Column:
    """The text of a rounded double; what a negative one rounds to keeps its sign, as in DuckDB."""
    out = F.round(value, digits)
    return F.when((out == 0) & (value < 0), F.lit("-0.0")).otherwise(number_text(out))


def array_text(column: str, digits: int) -> Column:
    """An array of doubles, rounded, as text."""
    return F.concat(F.lit("["), F.array_join(F.transform(column, lambda v: rounded_text(v, digits)), ", "), F.lit("]"))
