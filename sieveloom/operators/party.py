"""Units that name several parties, and the party by theme cube."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(text: Column, patterns: dict[str, str]) -> Column:
    """The labels whose pattern a text matches: patterns are constants, compiled once."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in patterns.items()]), lambda x: x.isNotNull())


def by_party(units: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """A unit once for each party it names, as `party`."""
    return units.withColumn("party", F.explode(matching(F.col(text), patterns)))


def coverage(units: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """(party, articles, percent of the corpus), in one pass over the texts."""
    one = units.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.col(text).rlike(p).cast("long")), F.lit(0)).alias(k) for k, p in patterns.items()])
    long = one.unpivot(["n"], list(patterns), "party", "articles")
    return long.select("party", "articles", F.when(F.col("n") > 0, 100.0 * F.col("articles") / F.col("n")).otherwise(0.0).alias("percent"))


def combined(text: Column, clauses: dict[str, str]) -> Column:
    """A full-text query: any clause."""
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in clauses.values()])


def homonym_noise(text: Column, bare: str, strong: str, others: str, sport: str) -> Column:
    """Names the bare token and sport, but neither the strong form nor another party."""
    return text.rlike(bare) & ~text.rlike(strong) & ~text.rlike(others) & text.rlike(sport)


def crosswalk(rows: DataFrame, table: dict[str, list[str]], column: str) -> DataFrame:
    """A row once for each party its list stands for, as `party`; lists without a party drop out."""
    spark = rows.sparkSession
    pairs = [(k, p) for k, ps in table.items() for p in ps]
    dim = spark.createDataFrame(pairs or [("", "")], f"`{column}` string, party string").where("party != ''")
    return rows.join(F.broadcast(dim), column)  # a fixed table of names


def cube(units: DataFrame) -> DataFrame:
    """(party, category, n, share) over theme rows."""
    n = units.groupBy("party", "category").agg(F.count("theme_id").alias("n")).where("n > 0")
    return n.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("party")))


def cube_from_wide(wide: DataFrame, name: str, themes: list[str]) -> DataFrame:
    """The same from a table with one count column a theme."""
    n = wide.groupBy(name).agg(*[F.sum(t).alias(t) for t in themes]).unpivot([name], themes, "category", "n").where("n > 0")
    return n.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(name)))
