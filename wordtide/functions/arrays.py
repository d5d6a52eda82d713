"""Small helpers over columns and array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pct(part: Column, whole: Column) -> Column:
    """100 x part / whole as double; null where whole is 0."""
    return F.lit(100.0).cast("double") * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def half_even(c: Column, digits: int) -> Column:
    """Round half to even, as exporters do."""
    return F.bround(c, digits)


def greatest_by(c: Column, *ties: Column) -> Column:
    """A struct for max(): the value, then ties. Negate what should be smallest."""
    return F.struct(c.alias("v"), *[t.alias(f"t{i}") for i, t in enumerate(ties)])


def percent_label(c: Column) -> Column:
    """0, 1 or 2 decimals by size: what a chart prints."""
    return F.when(c >= 10, F.format_number(c, 0)).when(c >= 1, F.format_number(c, 1)).otherwise(F.format_number(c, 2))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later filters can't be pushed below: they would work it out again for every mention of it."""
    return df.select(*[x for x in df.columns if x != name], F.explode(F.array(value)).alias(name))


def quantiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """keys and a column for each interpolated quantile of value, nulls left out. Values are counted first, so that what is gathered for a
    group are its distinct values with their counts, and what is shuffled are counts."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(*[F.percentile(value, F.lit(p), F.col("_n")).alias(name) for name, p in at.items()])
