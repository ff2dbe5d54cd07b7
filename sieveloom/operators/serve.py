"""Reshapes for a dashboard, and small summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melted(wide: DataFrame, keys: list[str], columns: list[str], name: str = "layer", value: str = "share") -> DataFrame:
    return wide.unpivot(keys, columns, name, value)


def pivoted(long: DataFrame, keys: list[str], name: str, values: list, value: str) -> DataFrame:
    return long.groupBy(*keys).pivot(name, values).agg(F.first(value))


def quadrants(df: DataFrame, x: str, y: str) -> DataFrame:
    """`quadrant` by the interpolated medians of both columns; a value at the median counts as high."""
    m = df.agg(F.median(x).alias("mx"), F.median(y).alias("my"))
    word = lambda c, m_: F.when(F.col(c) >= F.col(m_), "high").otherwise("low")
    return df.join(F.broadcast(m)).withColumn("quadrant", F.concat(word(x, "mx"), F.lit("-"), word(y, "my"))).drop("mx", "my")


def signed_gap(df: DataFrame, a: str, b: str, emphasis: float = 4.0) -> DataFrame:
    return df.withColumn("gap", F.col(b) - F.col(a)).withColumn("emphasis", F.abs(F.col(b) - F.col(a)) >= emphasis)


def peak(df: DataFrame, keys: list[str], month: str, value: str) -> DataFrame:
    """The month with the largest value, the earliest at a tie."""
    best = F.min_by(F.struct(F.col(month).alias("m"), F.col(value).alias("v")), F.struct(-F.col(value), F.col(month)))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.m").alias("peak"), F.col("b.v").alias("value"))


def polar(index: Column, count: int, value: Column, top: float) -> tuple[Column, Column]:
    """(x, y) of spoke `index` of `count`, clockwise from the top, at most 1 from the centre."""
    angle = 2 * F.pi() * index / F.lit(float(count))
    r = F.least(value / F.lit(float(top)), F.lit(1.0))
    return r * F.sin(angle), r * F.cos(angle)


def upper_median(values: Column) -> Column:
    """The middle of a sorted list, the upper one of two; not interpolated."""
    return F.get(F.sort_array(values), (F.size(values) / 2).cast("int"))


def upper_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, min, upper_median, max), with ranks instead of a collected list, so a hot key spills."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    r = df.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(w.orderBy(value))).withColumn("__n", F.count("*").over(w))
    mid = F.max(F.when(F.col("__r") == F.floor(F.col("__n") / 2) + 1, F.col(value)))
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("min"), mid.alias("upper_median"), F.max(value).alias("max"))


def condensed(manifest: dict, names: dict[str, str]) -> dict:
    """The parts of a manifest that a dashboard shows, under its own names; KeyError for a part that is missing."""
    return {own: manifest[name] for own, name in names.items()}


def top_values(df: DataFrame, column: str, most: int) -> DataFrame:
    """The most frequent values, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)


def exploded_counts(df: DataFrame, array: str) -> DataFrame:
    return df.select(F.explode(array).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
