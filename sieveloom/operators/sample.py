"""Deterministic samples and selections. Order comes from hashes of keys and a seed, so a sample is the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(seed: int, *keys) -> Column:
    """A pseudo-random order that any engine with md5 can repeat: the digest of the seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def top_per_group(df: DataFrame, keys: list, order: list, most: int, rank: str = "selection_rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= most)


def sample_per_group(df: DataFrame, keys: list[str], key: str, most: int, seed: int = 42) -> DataFrame:
    """At most `most` rows of each group without replacement."""
    return top_per_group(df, keys, [shuffled(seed, *keys, key), key], most)


def budgets(df: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Candidates (type, url, score, lastmod) under a cap for each type: `programma` by score, then url; others by
    lastmod (missing last), score, url."""
    own = F.when(F.col("type") == "programma", F.lit(None)).otherwise(F.col("lastmod"))
    w = Window.partitionBy("type").orderBy(own.desc_nulls_last(), F.desc("score"), "url")
    limit = F.try_element_at(F.create_map(*[F.lit(x) for p in caps.items() for x in p]), F.col("type"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.coalesce(limit, F.lit(0)))


def diversified(df: DataFrame, group: str, domain: str, order: list, most: int, cap: int, used: DataFrame | None = None) -> DataFrame:
    """The greedy rule "a domain used least first, candidate order second, none above the cap, then the overflow in
    candidate order", in closed form: candidates by (uses so far + own number in the domain, order).

    used: (group, domain, uses) of earlier picks. Adds `pick` (from 1 in each group) and `exception` for the overflow."""
    df = df.withColumn("__o", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    n = F.row_number().over(Window.partitionBy(group, domain).orderBy("__o"))
    if used is not None:
        df = df.join(used.select(group, domain, "uses"), [group, domain], "left").withColumn("__l", n + F.coalesce("uses", F.lit(0))).drop("uses")
    else:
        df = df.withColumn("__l", n)
    over = F.col("__l") > cap
    w = Window.partitionBy(group).orderBy(over.cast("int"), F.when(over, F.lit(0)).otherwise(F.col("__l")), "__o")
    return df.withColumn("exception", over).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= most).drop("__o", "__l")


def three_parts(df: DataFrame, per_theme: int, unassigned: int, random: int, key: str = "url", seed: int = 42) -> DataFrame:
    """`per_theme` rows of each theme, then unassigned ones, then random ones of what is left; no row twice. Adds
    `stratum` and `position`, the order of a final shuffle."""
    themes = sample_per_group(df.where("theme_id is not null"), ["theme_id"], key, per_theme, seed).withColumn("stratum", F.lit("theme")).drop("selection_rank")
    none = df.where("category = 'non assegnato'").orderBy(shuffled(seed + 1, key), key).limit(unassigned).withColumn("stratum", F.lit("unassigned"))
    both = themes.unionByName(none)
    rest = df.join(both.select(key), key, "left_anti").orderBy(shuffled(seed + 2, key), key).limit(random).withColumn("stratum", F.lit("random"))
    # the sample is a report of fixed size: one task numbers it
    return both.unionByName(rest.select(*both.columns)).withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(shuffled(seed + 3, key), key)))


def record_ids(df: DataFrame, group: str, kind: str, rank: str) -> DataFrame:
    """`review_id` such as T03-TOP-01."""
    return df.withColumn("review_id", F.format_string(f"T%02d-{kind}-%02d", F.col(group), F.col(rank)))


def without_copies(df: DataFrame, order: list) -> DataFrame:
    """The first of each (title, excerpt)."""
    key = F.concat(F.coalesce("title", F.lit("")), F.lit("\x1f"), F.coalesce("estratto", F.lit("")))
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def review_sample(df: DataFrame, useful: list[int], artifacts: list[int], top: int, random: int, checks: int, cap: int, seed: int = 42) -> DataFrame:
    """Top-weight and random records of useful topics, diversified by domain, and checks of artifact topics.

    df: (url, domain, title, estratto, weights, topic_id). Adds selection, pick, exception, review_id. ValueError if a
    topic has too few records."""
    rows = without_copies(df, ["url"]).withColumn("weight", F.element_at("weights", F.col("topic_id") + 1))
    own = rows.where(F.col("topic_id").isin(useful))
    first = diversified(own, "topic_id", "domain", [F.desc("weight"), "url"], top, cap).withColumn("selection", F.lit("TOP"))
    used = first.groupBy("topic_id", "domain").agg(F.count("*").alias("uses"))
    left = own.join(first.select("url"), "url", "left_anti")
    second = diversified(left, "topic_id", "domain", [shuffled(seed, "topic_id", "url"), "url"], random, cap, used).withColumn("selection", F.lit("RND"))
    third = top_per_group(rows.where(F.col("topic_id").isin(artifacts)), ["topic_id"], [F.desc("weight"), "url"], checks, "pick").withColumn("selection", F.lit("ART")).withColumn("exception", F.lit(False))
    out = first.unionByName(second.select(*first.columns)).unionByName(third.select(*first.columns))
    short = [r for r in out.groupBy("topic_id", "selection").agg(F.count("*").alias("n")).collect()]
    got = {(r.topic_id, r.selection): r.n for r in short}
    for t, kind, n in [(t, k, n) for t in useful for k, n in (("TOP", top), ("RND", random))] + [(t, "ART", checks) for t in artifacts]:
        if n and got.get((t, kind), 0) < n:
            raise ValueError(f"topic {t} has too few records for {kind}")
    return out.withColumn("review_id", F.concat(F.format_string("T%02d-", F.col("topic_id")), F.col("selection"), F.format_string("-%02d", F.col("pick"))))


def selection_summary(df: DataFrame) -> DataFrame:
    """(topic_id, selection, records, domains, exception)."""
    return df.groupBy("topic_id", "selection").agg(F.count("*").alias("records"), F.count_distinct("domain").alias("domains"), F.max("exception").alias("exception"))


def check_topics(useful: list[int], artifacts: list[int], known: list[int]) -> None:
    """ValueError unless useful and artifact topics are apart and are topics of the table."""
    if both := sorted(set(useful) & set(artifacts)):
        raise ValueError(f"topics both useful and artifact: {both}")
    if unknown := sorted((set(useful) | set(artifacts)) - set(known)):
        raise ValueError(f"topics that the table lacks: {unknown}")


def check_covered(df: DataFrame, topics: list[int]) -> None:
    """ValueError unless the rows have exactly these topics."""
    own = df.sparkSession.createDataFrame([(t,) for t in topics], "topic_id int")
    have = df.select(F.col("topic_id").cast("int").alias("topic_id")).distinct()
    if not (have.exceptAll(own).isEmpty() and own.distinct().exceptAll(have).isEmpty()):
        raise ValueError("the sample does not cover exactly the topics asked for")


def check_sample(df: DataFrame, cap: int) -> None:
    """ValueError unless URLs are unique and no domain passes the cap in a topic but by an exception."""
    if not df.groupBy("url").count().where("count > 1").isEmpty():
        raise ValueError("a record is selected twice")
    over = df.where("not exception and selection != 'ART'").groupBy("topic_id", "domain").count().where(F.col("count") > cap)
    if not over.isEmpty():
        raise ValueError("a domain passes its cap")
