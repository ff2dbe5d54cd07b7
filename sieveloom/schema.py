"""Table shapes, checks at stage borders, and adapters of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A document of any layer; `ord` stands for the order of the file it came from.
RECORD = T.StructType([T.StructField(n, T.LongType() if n in ("ord", "chars") else T.StringType()) for n in ("ord", "url", "domain", "seendate", "title", "text", "chars", "language")])


def require_columns(df: DataFrame, names) -> DataFrame:
    """df, if it has all the columns named; else ValueError."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def weight_columns(df: DataFrame, prefix: str = "topic_", suffix: str = "_peso") -> list[str]:
    """The weight columns 0..k-1; ValueError unless they are contiguous and start at 0."""
    found = sorted(int(c[len(prefix) : -len(suffix)]) for c in df.columns if c.startswith(prefix) and c.endswith(suffix) and c[len(prefix) : -len(suffix)].isdigit())
    if not found or found != list(range(len(found))):
        raise ValueError("weight columns must be numbered from 0 without gaps")
    return [f"{prefix}{i}{suffix}" for i in found]


def with_weights(df: DataFrame) -> DataFrame:
    """The numbered weight columns as one array `weights`."""
    names = weight_columns(df)
    return df.withColumn("weights", F.array(*[F.col(n).cast("double") for n in names])).drop(*names)


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def collapsed(text: Column) -> Column:
    """White space squeezed to single spaces."""
    return F.btrim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "), F.lit(" "))


def corpus(docs: DataFrame) -> DataFrame:
    """The driver's documents as records."""
    day = F.date_add(F.lit("2026-01-01").cast("date"), F.pmod(F.col("doc_id"), F.lit(240)).cast("int"))
    return docs.select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("domain"), F.date_format(day, "yyyy-MM-dd").alias("seendate"),
        F.substring_index("text", "\n", 1).alias("title"), "text", F.col("n_chars").alias("chars"), F.col("lang").alias("language"),
    )
