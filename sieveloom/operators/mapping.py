"""From classified units to shares, divergences and comparisons. units: (layer or group columns, theme_id, category)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.functions import text as X


def shares(units: DataFrame, keys: list[str], themes_only: bool = False) -> DataFrame:
    """(keys, category, n, share in percent); service rows count in the whole unless themes_only."""
    if themes_only:  # the few grouped rows are filtered, not the units
        n = units.groupBy(*keys, "category").agg(F.count("theme_id").alias("n")).where("n > 0")
    else:
        n = units.groupBy(*keys, "category").agg(F.count("*").alias("n"))
    return n.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def weighted_shares(units: DataFrame, prevalence: DataFrame) -> DataFrame:
    """Post-stratification: (category, weighted, share) with weights prevalence(topic) / rows(topic)."""
    size = Window.partitionBy("topic_id")
    n = units.groupBy("topic_id", "category").agg(F.count("*").alias("n")).withColumn("rows", F.sum("n").over(size))
    w = n.join(prevalence, "topic_id").withColumn("w", F.col("n") * F.col("prevalence") / F.col("rows"))
    out = w.groupBy("category").agg(F.sum("w").alias("weighted"))
    return out.withColumn("share", 100.0 * F.col("weighted") / F.sum("weighted").over(Window.partitionBy(F.lit(0))))


def divergence(a: DataFrame, b: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, divergence): half the sum of absolute differences of two tables of (keys, category, share)."""
    keys = list(keys)
    both = a.select(*keys, "category", F.col("share").alias("x")).join(b.select(*keys, "category", F.col("share").alias("y")), [*keys, "category"], "full")
    gap = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    return both.groupBy(*keys).agg((0.5 * F.sum(gap)).alias("divergence"))


def h1_index(programmes: DataFrame, groups: DataFrame, least: int = 100) -> DataFrame:
    """(name, divergence, n_a, n_b, reliable) for names on both sides, over themes only; reliable: `least` units on each."""
    a, b = (shares(x, ["name"], True) for x in (programmes, groups))
    na, nb = (x.groupBy("name").agg(F.sum("n").alias(c)) for x, c in ((a, "n_a"), (b, "n_b")))
    both = na.join(nb, "name")
    a, b = (x.join(both.select("name"), "name", "left_semi") for x in (a, b))
    out = divergence(a, b, ["name"]).join(both, "name")
    return out.withColumn("reliable", (F.col("n_a") >= least) & (F.col("n_b") >= least))


def override(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The second source replaces the first by key; `source` says which one is used, `paired` whether both had the key."""
    both = first.select(*keys, F.col(value).alias("x"), F.lit(True).alias("hx")).join(second.select(*keys, F.col(value).alias("y"), F.lit(True).alias("hy")), keys, "full")
    return both.select(*keys, F.when(F.col("hy"), F.col("y")).otherwise(F.col("x")).alias(value), F.when(F.col("hy"), "second").otherwise("first").alias("source"), (F.col("hx") & F.col("hy")).eqNullSafe(True).alias("paired"))


def topic_service(units: DataFrame) -> DataFrame:
    """(topic_id, units, boilerplate, service): percent of a topic's units that are boilerplate, and that have no theme."""
    pct = lambda c: 100.0 * F.avg(c.cast("int"))
    return units.groupBy("topic_id").agg(F.count("*").alias("units"), pct(F.col("category") == "boilerplate").alias("boilerplate"), pct(F.col("theme_id").isNull()).alias("service"))


def dominant(units: DataFrame) -> DataFrame:
    """(topic_id, category, n, share) of each topic's most frequent category; ties go to the one met first by `ord`."""
    n = units.groupBy("topic_id", "category").agg(F.count("*").alias("n"), F.min("ord").alias("met"))
    own = Window.partitionBy("topic_id")
    n = n.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(own)).withColumn("r", F.row_number().over(own.orderBy(F.desc("n"), "met")))
    return n.where("r = 1").select("topic_id", "category", "n", "share")


def comparison(shares_: DataFrame, layers: list[str]) -> DataFrame:
    """One row a category with each layer's share (0 where it has none), gaps between neighbours; rows all zero go."""
    wide = shares_.groupBy("category").pivot("layer", layers).agg(F.first("share")).na.fill(0.0)
    for a, b in zip(layers, layers[1:], strict=False):
        wide = wide.withColumn(f"gap_{a}_{b}", F.col(b) - F.col(a))
    return wide.where(" + ".join(f"abs({x})" for x in layers) + " > 0")


def counts_by_theme(units: DataFrame, keys: list[str], themes: list[str]) -> DataFrame:
    """Wide counts: one column a category of a fixed list."""
    return units.groupBy(*keys).pivot("category", themes).agg(F.count(F.lit(1))).na.fill(0)


def coverage(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, units, assigned percent, process percent)."""
    pct = lambda c: 100.0 * F.avg(c.cast("int"))
    return units.groupBy(*keys).agg(F.count("*").alias("units"), pct(F.col("theme_id").isNotNull()).alias("assigned"), pct(F.col("category") == "processo").alias("process"))


def marker_counts(units: DataFrame, by: list[str]) -> DataFrame:
    """(marker, by, n, per_mille): per mille of the whole corpus, whatever `by`."""
    total = units.agg(F.count("*").alias("total"))
    n = units.select(F.explode("markers").alias("marker"), *by).groupBy("marker", *by).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(total)).withColumn("per_mille", 1000.0 * F.col("n") / F.col("total")).drop("total")


def paragraph_units(docs: DataFrame, least: int = 200) -> DataFrame:
    """One row a paragraph: (ord, pos, text) beside the other columns."""
    return docs.select(*[c for c in docs.columns if c != "text"], F.posexplode(X.paragraphs(F.col("text"), least)).alias("pos", "text"))
