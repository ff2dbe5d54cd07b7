"""Paged and fetched sources as Python data sources. The transport is injected, so all of it runs without a network."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sieveloom.functions.text import language
from sieveloom.schema import keep_first


def answered(get: Callable[[str], tuple[int, str]], url: str, tries: int = 3, wait: float = 0.0, busy: float = 0.0, refusals: bool = False) -> tuple[int, str] | None:
    """(status, body) of a URL, or None. Waits longer before each new try, `busy` seconds more each time where the server
    asks for fewer requests (429); other refusals (400 to 499) end at once, a 403 as an answer if `refusals`. With a
    get that asks for headers only (HEAD), the body is empty."""
    for n in range(1, tries + 1):
        try:
            status, body = get(url)
        except OSError:
            status, body = 0, ""
        if status == 200 or (refusals and status == 403):
            return status, body
        if 400 <= status < 500 and status != 429:
            return None
        if n < tries:
            time.sleep((busy if status == 429 else wait) * n)
    return None


def fetched(get: Callable[[str], tuple[int, str]], url: str, tries: int = 3, wait: float = 0.0) -> str | None:
    """The body of a URL, None where there is none."""
    got = answered(get, url, tries, wait)
    return got[1] if got else None


def repaired_charset(content: bytes, declared: str | None) -> str:
    """Bytes as text: the declared charset, but UTF-8 where none is declared or only the default one and it fits."""
    if declared and declared.lower() not in ("iso-8859-1", "latin-1"):
        return content.decode(declared, "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("iso-8859-1")


def scrape(urls: DataFrame, get, parse: Callable[[str, str], dict], least: int, parallel: int = 8) -> DataFrame:
    """(url, title, text, chars, language) of URLs, each once, with more than `least` characters. Where urls has other
    columns (ord among them), they come along, of each URL those of its smallest `ord`. get and parse run on the workers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for u in f.url:
                body = fetched(get, u)
                if body is not None:
                    r = parse(u, body)
                    rows.append((u, r.get("title"), r.get("text") or ""))
            yield pd.DataFrame(rows, columns=["url", "title", "text"])

    once = keep_first(urls, ["url"], ["ord"]) if "ord" in urls.columns else urls.select("url").distinct()
    out = once.select("url").repartition(parallel).mapInPandas(run, "url string, title string, text string")
    out = out.withColumn("chars", F.length("text").cast("long")).where(F.col("chars") > least).withColumn("language", language(F.col("text")))
    return out.join(once, "url") if len(once.columns) > 1 else out


def scrape_onto(urls: DataFrame, path: str, get, parse, least: int, parallel: int = 8) -> int:
    """Appends what scrape() finds of the URLs that the table at `path` lacks, and says how many rows came; a run that
    stopped goes on where it was, as each call asks only for what is still missing."""
    spark = urls.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    before = spark.read.parquet(path).count() if there else 0
    if there:
        urls = urls.join(spark.read.parquet(path).select("url"), "url", "left_anti")
    scrape(urls, get, parse, least, parallel).write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def flat_bindings(body: str) -> list[dict]:
    """Rows of a SPARQL JSON answer."""
    return [{k: v.get("value") for k, v in b.items()} for b in json.loads(body)["results"]["bindings"]]


class _Part(InputPartition):
    def __init__(self, shard):
        self.value = shard


class PagedSource(DataSource):
    """Rows by keyset pages. options: `shards` (comma-separated), `size`; subclass with `schema_text`, `key` and
    `fetch(shard, last, size)`; a shard, such as a legislature, is a partition."""

    schema_text, key = "key string", "key"

    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return self.schema_text

    def fetch(self, shard: str, last, size: int) -> list[dict]:
        raise NotImplementedError

    def reader(self, schema):
        return _PagedReader(self, schema)


class _PagedReader(DataSourceReader):
    def __init__(self, source, schema):
        self.source, self.names = source, schema.fieldNames()
        self.size, self.shards = int(source.options.get("size", 1000)), source.options.get("shards", "").split(",")

    def partitions(self):
        return [_Part(s) for s in self.shards]

    def read(self, partition):
        from sieveloom.operators.public import keyset_pages

        pages = keyset_pages(lambda last, size: [(r[self.source.key], r) for r in self.source.fetch(partition.value, last, size)], self.size)
        for _, row in pages:
            yield tuple(row.get(n) for n in self.names)


def token_pages(fetch: Callable[[str | None], tuple[list[dict], str | None]], most: int, barred: tuple[str, ...] = ()) -> list[dict]:
    """Stories of all pages by their token, up to `most`, without barred hosts."""
    out, token = [], None
    while len(out) < most:
        rows, token = fetch(token)
        out += [r for r in rows if not any((h := (r.get("domain") or "").removeprefix("www.")) == b or h.endswith("." + b) for b in barred)]
        if not token or not rows:
            break
    return out[:most]
