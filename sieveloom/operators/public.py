"""Elections, bills and polls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The two column families of election files.
FAMILIES = ({"date": "DATAELEZIONE", "area": "CIRC-REG", "place": "COMUNE", "votes": "VOTILISTA", "list": "DESCRLISTA"}, {"date": "DATA_ELEZIONE", "area": "DESCREGIONE", "place": "DESCCOMUNE", "votes": "NUMVOTI", "list": "DESCLISTA"})


def election_rows(df: DataFrame) -> DataFrame:
    """(date, area, place, votes, list) of either family; ValueError for another."""
    for f in FAMILIES:
        if set(f.values()) <= set(df.columns):
            return df.select(*[F.col(f"`{c}`").alias(a) for a, c in f.items()])
    raise ValueError("unknown election columns")


def readable(rows: DataFrame) -> DataFrame:
    """The rows that name a list, with trimmed names and `n`: blank votes are 0, votes that are no number null."""
    votes = F.coalesce(F.nullif(F.btrim("votes"), F.lit("")), F.lit("0"))
    names = {c: F.btrim(F.coalesce(c, F.lit(""))) for c in ("list", "place")}
    return rows.withColumns(names | {"n": votes.try_cast("bigint")}).where("list != ''")


def national_totals(rows: DataFrame) -> DataFrame:
    """(list, votes, percent, places, unread, first_date) of each list with votes that can be read. Places and dates are
    those of readable rows; the percentage is of the votes of all lists."""
    place, date = F.when(F.col("n").isNotNull(), F.col("place")), F.when(F.col("n").isNotNull(), F.nullif("date", F.lit("")))
    out = readable(rows).groupBy("list").agg(F.sum("n").alias("votes"), F.count_distinct(place).alias("places"), F.count_if(F.col("n").isNull()).alias("unread"), F.min(date).alias("first_date")).where("votes is not null")
    whole = F.sum("votes").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("percent", F.when(whole > 0, 100.0 * F.col("votes") / whole).otherwise(0.0))


def election_diagnostics(rows: DataFrame) -> DataFrame:
    """(rows, places, unread, lists, votes): of all rows; places and lists of the readable ones."""
    every = rows.agg(F.count("*").alias("rows"))
    seen = lambda c: F.count_distinct(F.when(F.col("n").isNotNull(), F.col(c)))
    own = readable(rows).agg(seen("place").alias("places"), F.count_if(F.col("n").isNull()).alias("unread"), seen("list").alias("lists"), F.coalesce(F.sum("n"), F.lit(0)).alias("votes"))
    return every.join(F.broadcast(own))  # one row each


def collapse(rows: DataFrame, key: str, order: str | Column = "ord") -> DataFrame:
    """The first row of each key, and how many rows it had as `merged`."""
    rest = [c for c in rows.columns if c != key]
    out = rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r"), F.count("*").alias("merged"))
    return out.select(key, "r.*", "merged")


def page_after(rows: DataFrame, key: str, last, size: int) -> DataFrame:
    """The next page of a keyset: rows beyond the last key, in order."""
    more = rows if last is None else rows.where(F.col(key) > F.lit(last))
    return more.orderBy(key).limit(size)


def keyset_pages(fetch, size: int):
    """All pages of fetch(last key, size) -> list of (key, row); stops at a short page, raises if the key stands still."""
    last = None
    while True:
        page = fetch(last, size)
        if page:
            if last is not None and page[-1][0] <= last:
                raise RuntimeError(f"paging stands still at {last}")
            last = page[-1][0]
            yield from page
        if len(page) < size:
            return


def recognised(label: Column, parties: dict[str, tuple[str, ...]], excluded: str) -> Column:
    """The first party, in the given order, whose pattern a label matches; null for excluded labels."""
    found = F.lit(None).cast("string")
    for name, patterns in reversed(parties.items()):
        found = F.when(label.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(name)).otherwise(found)
    return F.when(~label.rlike(excluded), found)


def vote_question(question: Column, answers: Column, asks: str, parties: dict, excluded: str, least: int = 4) -> Column:
    """The text asks for a vote, and at least so many different parties are among the answers."""
    known = F.array_distinct(F.filter(F.transform(answers, lambda a: recognised(a, parties, excluded)), lambda x: x.isNotNull()))
    return question.rlike(asks) & (F.size(known) >= least)


def answers(block: Column) -> Column:
    """Lines of an answer as (label, values): numbers are taken from the right, a dash holds a column's place."""
    lines = F.transform(F.split(block, r"(?i)<br\s*/?>|\n"), lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"\s+", " "), F.lit(" ")))
    tail = r"((?: (?:\d{1,3}(?:[.,]\d+)? ?%?|[-–]|%))+)$"

    def one(x):
        values = F.filter(F.split(F.btrim(F.regexp_extract(x, tail, 1), F.lit(" ")), " "), lambda v: (v != "%") & (v != ""))
        label = F.regexp_replace(F.regexp_replace(x, tail, ""), r"^[ .:–-]+|[ .:–-]+$", "")
        return F.struct(label.alias("label"), F.transform(values, lambda v: F.when(~v.isin("-", "–"), F.replace(F.replace(v, F.lit(","), F.lit(".")), F.lit("%"), F.lit("")).cast("double"))).alias("values"))

    return F.filter(F.transform(lines, one), lambda r: (r["label"] != "") & (F.size(r["values"]) > 0))


def poll_shares(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: (keys, party or null, value). Duplicates of a party are summed, shares add up to 100 over recognised
    parties; the sum before, `base`, is kept."""
    n = rows.where("party is not null and value is not null").groupBy(*keys, "party").agg(F.sum("value").alias("raw"))
    base = F.sum("raw").over(Window.partitionBy(*keys))
    return n.withColumn("base", base).where("base > 0").withColumn("share", 100.0 * F.col("raw") / F.col("base"))


def salience(rows: DataFrame, table: dict[str, str]) -> DataFrame:
    """(month, theme, value): the largest value of the items mapped to a theme, never their sum."""
    pairs = F.create_map(*[F.lit(x) for p in table.items() for x in p])
    return rows.withColumn("theme", F.try_element_at(pairs, F.col("item"))).where("theme is not null").groupBy("month", "theme").agg(F.max("value").alias("value"))


def fullest_month(rows: DataFrame) -> DataFrame:
    """The month with most themes, the later one at a tie."""
    n = rows.groupBy("month").agg(F.count("*").alias("themes"))
    return n.agg(F.max_by("month", F.struct("themes", "month")).alias("month"), F.max("themes").alias("themes"))


def ranks(rows: DataFrame, keys: list[str], value: str, theme: str) -> DataFrame:
    """`rank` from 1 by value, ties by theme."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), theme)))


def rank_gap(a: DataFrame, b: DataFrame, theme: str) -> DataFrame:
    """The sum of rank differences over common themes."""
    both = a.select(theme, F.col("rank").alias("x")).join(b.select(theme, F.col("rank").alias("y")), theme)
    return both.agg(F.coalesce(F.sum(F.abs(F.col("x") - F.col("y"))), F.lit(0)).cast("long").alias("gap"), F.count("*").alias("themes"))


def salience_block(text: Column, start: str, end: str, themes: tuple[str, ...]) -> Column:
    """(theme, value) pairs `label (NN%` between two marks; a label counts if it ends in a known theme, the first of each."""
    low = F.lower(text)
    at = F.locate(start, low)
    stop = F.locate(end, low, 1)
    part = F.when(at > 0, F.substring(low, at, F.when(stop > at, stop - at).otherwise(F.length(low)))).otherwise(F.lit(""))
    labels = F.regexp_extract_all(part, F.lit(r"([^()%,;:.]+?)\s*\((\d{1,3})\s*%"), F.lit(1))
    values = F.regexp_extract_all(part, F.lit(r"([^()%,;:.]+?)\s*\((\d{1,3})\s*%"), F.lit(2))
    known = lambda x: F.array_max(F.filter(F.array(*[F.when(F.endswith(F.btrim(x), F.lit(t)), F.lit(t)) for t in themes]), lambda t: t.isNotNull()))
    pairs = F.filter(F.zip_with(labels, values, lambda a, b: F.struct(known(a).alias("theme"), b.cast("double").alias("value"))), lambda p: p["theme"].isNotNull())
    return F.filter(F.transform(F.array_distinct(F.transform(pairs, lambda p: p["theme"])), lambda t: F.element_at(F.filter(pairs, lambda p: p["theme"] == t), 1)), lambda p: p.isNotNull())
