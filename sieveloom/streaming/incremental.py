"""Incremental forms: batch functions and Structured Streaming twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveloom.schema import keep_first


def new_rows(known: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `found` whose keys are not known, each key once."""
    return found.join(known.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def accumulated(known: DataFrame, found: DataFrame, keys: list[str], order: list) -> DataFrame:
    """known with the new keys of found, the first of each; doing it twice changes nothing."""
    return known.unionByName(keep_first(found.join(known.select(*keys), keys, "left_anti").select(*known.columns), keys, order))


def extended(known: DataFrame, found: DataFrame, first: str, last: str, ts: str = "seendate", key: str = "url", by: tuple[str, ...] = ("domain",)) -> tuple[DataFrame, DataFrame]:
    """(rows to append, totals): what the window of `found` adds to the known URLs, and the counts of old and new rows together."""
    new = new_rows(known, between(found, ts, first, last), [key]).select(*known.columns)
    return new, known.select(*by).unionByName(new.select(*by)).groupBy(*by).agg(F.count("*").alias("n"))


def sliding(rows: DataFrame, ts: str, days: int) -> DataFrame:
    """The rows of the last `days` days before the newest."""
    last = rows.agg(F.max(ts).alias("__last"))
    return rows.join(F.broadcast(last), F.col(ts) >= F.expr(f"__last - interval {int(days)} days")).drop("__last")


def between(rows: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """An explicit window, both days included."""
    return rows.where((F.to_date(ts) >= F.lit(first).cast("date")) & (F.to_date(ts) <= F.lit(last).cast("date")))


def stream_new_urls(stream: DataFrame, path: str, checkpoint: str, key: str = "url") -> StreamingQuery:
    """Append rows of unseen URLs; the keys seen are the stream's state."""
    return stream.dropDuplicates([key]).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_accumulate(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list) -> StreamingQuery:
    """Merge each batch into the table at `path`, new keys only. A batch that runs again finds its keys and adds nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = keep_first(batch, keys, order)
        jvm = spark.sparkContext._jvm
        there = jvm.org.apache.hadoop.fs.Path(path)
        if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti").select(*batch.columns)
        rows.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_counts(stream: DataFrame, ts: str, width: str, lateness: str, keys: list[str]) -> DataFrame:
    """Counts by tumbling window with a watermark: (window start, keys, n)."""
    n = stream.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("start"), *keys, "n")
