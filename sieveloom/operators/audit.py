"""Audit of a topic review table: (url, domain, seendate, title, estratto, language, weights, topic_id, confidenza_topic)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.functions.text import excerpt_form, non_latin

MISSING = "[MISSING]"
QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def dominant(weights: Column) -> tuple[Column, Column]:
    """(number of the largest weight, its share of their sum)."""
    top = F.array_max(weights)
    whole = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return (F.array_position(weights, top) - 1).cast("int"), top / F.greatest(whole, F.lit(1e-12))


def distribution(df: DataFrame, topics: int) -> DataFrame:
    """(topic_id, articles, percent) for each of the topics, zero where it has none."""
    every = df.sparkSession.range(topics).select(F.col("id").cast("int").alias("topic_id"))
    n = df.groupBy("topic_id").agg(F.count("*").alias("articles"))
    out = every.join(n, "topic_id", "left").na.fill({"articles": 0})
    whole = F.sum("articles").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("percent", F.when(whole > 0, 100.0 * F.col("articles") / whole).otherwise(0.0))


def summary(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Count, minimum, mean, interpolated quantiles and the percentage that is exactly 1."""
    aggs = [F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.percentile(value, F.array(*map(F.lit, QUANTILES.values()))).alias("q"), (100.0 * F.avg((F.col(value) == 1).cast("int"))).alias("percent_one")]
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*keys, "n", "min", "mean", *[F.col("q")[i].alias(k) for i, k in enumerate(QUANTILES)], "percent_one")


def below(df: DataFrame, value: str, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, percent) of values strictly below each."""
    marks = F.array(*[F.lit(float(t)) for t in thresholds])
    wide = df.select(F.col(value).alias("v"), F.explode(marks).alias("threshold"))
    return wide.groupBy("threshold").agg((100.0 * F.avg((F.col("v") < F.col("threshold")).cast("int"))).alias("percent"))


def weight_summary(df: DataFrame) -> DataFrame:
    return summary(df.select(F.posexplode("weights").alias("topic_id", "w")), "w", ("topic_id",))


def top_domains(df: DataFrame, most: int) -> DataFrame:
    """(topic_id, domain, articles, percent of the topic, rank): by articles, then domain."""
    n = df.groupBy("topic_id", F.coalesce("domain", F.lit(MISSING)).alias("domain")).agg(F.count("*").alias("articles"))
    own = Window.partitionBy("topic_id")
    n = n.withColumn("percent", 100.0 * F.col("articles") / F.sum("articles").over(own)).withColumn("rank", F.row_number().over(own.orderBy(F.desc("articles"), "domain")))
    return n.where(F.col("rank") <= most)


def concentration(df: DataFrame, threshold: float) -> DataFrame:
    """(topic_id, domain, percent, warning): the first domain of each topic."""
    return top_domains(df, 1).select("topic_id", "domain", "percent", (F.col("percent") >= 100 * threshold).alias("warning"))


def monthly(df: DataFrame) -> DataFrame:
    """(topic_id, month, articles); dates that cannot be read are left out."""
    month = F.date_format(F.try_to_timestamp("seendate", F.lit("yyyy-MM-dd")).cast("date"), "yyyy-MM")
    return df.select("topic_id", month.alias("month")).where("month is not null").groupBy("topic_id", "month").agg(F.count("*").alias("articles"))


def date_ranges(df: DataFrame) -> DataFrame:
    """(topic_id, first, last, months): months as JSON, sorted."""
    day = df.select("topic_id", F.try_to_timestamp("seendate", F.lit("yyyy-MM-dd")).cast("date").alias("d")).where("d is not null").groupBy("topic_id").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    pairs = monthly(df).groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("month", "articles"))).alias("m"))
    return day.join(pairs, "topic_id").select("topic_id", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), F.to_json(F.map_from_entries("m")).alias("months"))


def duplicate_summary(df: DataFrame, keys: list[Column]) -> DataFrame:
    """(records, groups, largest) of the groups with more than one row."""
    names = [f"k{i}" for i in range(len(keys))]
    n = df.select(*[k.alias(a) for k, a in zip(keys, names, strict=True)]).groupBy(*names).agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("*").alias("groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def excerpt_duplicates(df: DataFrame) -> DataFrame:
    return duplicate_summary(df.where("coalesce(estratto, '') != ''"), [F.col("estratto")])


def title_excerpt_duplicates(df: DataFrame) -> DataFrame:
    keys = [F.coalesce("title", F.lit("")), F.coalesce("estratto", F.lit(""))]
    return duplicate_summary(df.where("coalesce(title, '') != '' or coalesce(estratto, '') != ''"), keys)


def near_duplicates_by_prefix(df: DataFrame, prefix: int, letters: str = "a-zàèéìòóù0-9") -> DataFrame:
    key = F.substring(excerpt_form(F.coalesce("estratto", F.lit("")), letters), 1, prefix)
    return duplicate_summary(df.withColumn("__k", key).where("__k != ''"), [F.col("__k")])


def anomalies(df: DataFrame) -> DataFrame:
    """(metric, value): rows, rows of repeated URLs, the largest excerpt group, Italian titles with letters that are not Latin."""
    urls = duplicate_summary(df, [F.col("url")]).select(F.lit("repeated_url_records").alias("metric"), F.col("records").cast("long").alias("value"))
    largest = excerpt_duplicates(df).select(F.lit("largest_excerpt_group").alias("metric"), F.col("largest").cast("long").alias("value"))
    rows = df.agg(F.count("*").alias("value")).select(F.lit("rows").alias("metric"), "value")
    odd = df.where((F.col("language") == "it") & non_latin(F.col("title"))).agg(F.count("*").alias("value")).select(F.lit("non_latin_titles").alias("metric"), "value")
    return rows.unionByName(urls).unionByName(largest).unionByName(odd)


def largest_group_topics(df: DataFrame) -> DataFrame:
    """(estratto, topic_id, records): the topics of the largest group of equal excerpts, the alphabetically first at a tie."""
    n = df.where("coalesce(estratto, '') != ''").groupBy("estratto", "topic_id").agg(F.count("*").alias("records"))
    size = n.groupBy("estratto").agg(F.sum("records").alias("size"))
    best = size.agg(F.min_by("estratto", F.struct(-F.col("size"), F.col("estratto"))).alias("estratto"))
    return n.join(F.broadcast(best), "estratto")  # one row


def audit_tables(df: DataFrame, topics: int, top: int = 10, threshold: float = 0.5, prefix: int = 300, records: int = 3) -> dict[str, DataFrame]:
    """The tables of an audit by name, for sinks.tables()."""
    named = {"exact_excerpt": excerpt_duplicates(df), "title_excerpt": title_excerpt_duplicates(df), "prefix": near_duplicates_by_prefix(df, prefix)}
    duplicates = None
    for kind, t in named.items():
        t = t.select(F.lit(kind).alias("kind"), "*")
        duplicates = t if duplicates is None else duplicates.unionByName(t)
    return {
        "topic_distribution": distribution(df, topics), "confidence_summary": summary(df, "confidenza_topic"), "weight_summary": weight_summary(df), "domain_top": top_domains(df, top),
        "domain_concentration": concentration(df, threshold), "monthly_topics": monthly(df), "date_ranges": date_ranges(df), "duplicates": duplicates, "anomalies": anomalies(df),
        "largest_group_topics": largest_group_topics(df), "top_records": top_records(df, records).drop("weights"),
    }


def top_records(df: DataFrame, most: int) -> DataFrame:
    """df with `weight` (of the own topic) and `selection_rank`: by weight, then url."""
    df = df.withColumn("weight", F.element_at("weights", F.col("topic_id") + 1))
    return df.withColumn("selection_rank", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("weight"), "url"))).where(F.col("selection_rank") <= most)
