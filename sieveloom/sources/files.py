"""Readers of files."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveloom.schema import RECORD

BOM = "\ufeff"
_NEVER = "\x00never\x00"


def _without_bom(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lstrip(BOM) for c in df.columns])


def json_lines(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """One record a line; blank lines are skipped, missing keys are null."""
    return spark.read.schema(schema).json(path)


def csv_typed(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",") -> DataFrame:
    r = spark.read.options(header=True, multiLine=True, escape='"', sep=sep, encoding="UTF-8")
    return _without_bom(r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path))


def csv_exact(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as strings, empty cells as empty strings."""
    df = _without_bom(spark.read.options(header=True, multiLine=True, escape='"', sep=sep, nullValue=_NEVER, emptyValue="", inferSchema=False).csv(path))
    return df.na.fill("")


def csv_from_text(spark: SparkSession, text: str, sep: str = ";") -> DataFrame:
    """A small table in a string, such as one downloaded file."""
    rows = list(csv.reader(text.lstrip(BOM).splitlines(), delimiter=sep))
    if not rows:
        raise ValueError("no header")
    return spark.createDataFrame([tuple(r) for r in rows[1:] if r], T.StructType([T.StructField(c, T.StringType()) for c in rows[0]]))


def json_object(path: str) -> dict:
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError("not a JSON object")
    return value


def reviewer_table(path: str, columns: list[str]):
    """A reviewer's file as rows of strings: comma or semicolon, told by the header, or a workbook where pandas can read
    one; columns are renamed by position where their number is right."""
    if path.lower().endswith((".xlsx", ".xls")):
        import pandas as pd

        table = pd.read_excel(path, dtype=str).fillna("")
        head, rows = list(table.columns), table.values.tolist()
    else:
        text = Path(path).read_text(encoding="utf-8-sig")
        first = text.splitlines()[0] if text else ""
        rows = list(csv.reader(text.splitlines(), delimiter=";" if first.count(";") > first.count(",") else ","))
        head, rows = (rows[0], rows[1:]) if rows else ([], [])
    if [h.strip() for h in head] != columns and len(head) != len(columns):
        raise ValueError(f"{path}: {len(head)} columns, {len(columns)} expected")
    return [dict(zip(columns, [str(x).strip() for x in r], strict=False)) for r in rows]


def sitemap(spark: SparkSession, texts: DataFrame, column: str = "body") -> DataFrame:
    """(kind, loc, lastmod) of sitemap XML: kind `page` or `sitemap`; text that is no sitemap gives no rows."""
    body = F.col(column)
    entry = lambda tag: F.regexp_extract_all(body, F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1))
    pick = lambda x, tag: F.btrim(F.regexp_extract(x, rf"(?is)<{tag}>\s*(.*?)\s*</{tag}>", 1))
    both = F.concat(F.transform(entry("url"), lambda x: F.struct(F.lit("page").alias("kind"), x.alias("x"))), F.transform(entry("sitemap"), lambda x: F.struct(F.lit("sitemap").alias("kind"), x.alias("x"))))
    rows = texts.select(F.explode(both).alias("e"))
    return rows.select("e.kind", pick(F.col("e.x"), "loc").alias("loc"), F.nullif(pick(F.col("e.x"), "lastmod"), F.lit("")).alias("lastmod")).where("loc != ''")


def all_pages(fetch, roots: list[str], most: int = 10_000) -> list[tuple[str, str | None]]:
    """Pages below nested sitemaps, breadth first, each sitemap once. fetch(url) -> (nested sitemaps, pages)."""
    seen, queue, pages = set(), list(roots), []
    while queue and len(seen) < most:
        url = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        nested, own = fetch(url)
        pages += own
        queue += nested
    return pages


def sitemap_profile(pages: DataFrame) -> DataFrame:
    """(pages, first, last, days) of lastmod."""
    day = F.substring("lastmod", 1, 10)
    return pages.agg(F.count("*").alias("pages"), F.min(day).alias("first"), F.max(day).alias("last"), F.count_distinct(day).alias("days"))


def robots_sitemaps(robots):
    """The sitemaps that a robots.txt names."""
    return F.regexp_extract_all(robots, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))


def index_json(df: DataFrame, column: str = "body") -> DataFrame:
    """Deposited documents (number, list, file) of a nested JSON index: type 2, PDF only, each file once."""
    kind = "struct<contrass: array<struct<n_ord: string, partito: string, e_file: array<struct<tp_doc: string, f_doc: string>>>>>"
    rows = df.select(F.explode(F.from_json(column, kind)["contrass"]).alias("c")).select("c.n_ord", "c.partito", F.explode("c.e_file").alias("f"))
    out = rows.where((F.col("f.tp_doc") == "2") & F.lower("f.f_doc").endswith(".pdf"))
    return out.select(F.col("n_ord").cast("string").alias("number"), F.col("partito").alias("list"), F.col("f.f_doc").alias("file")).dropDuplicates(["file"])


def index_html(df: DataFrame, column: str = "body", label: str = "programma") -> DataFrame:
    """The same from an HTML table: links labelled `label`, the list named in the row's first cells; first of (list, file name)."""
    from sieveloom.functions.text import untagged

    rows = df.select(F.posexplode(F.regexp_extract_all(column, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "row"))
    cells = F.filter(F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), untagged), lambda x: x != "")
    urls, names = (F.regexp_extract_all("row", F.lit(r"(?is)<a [^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>"), F.lit(i)) for i in (1, 2))
    links = F.filter(F.zip_with(urls, names, lambda u, n: F.struct(u.alias("file"), F.lower(untagged(n)).alias("name"))), lambda x: x["name"] == label)
    number = F.filter(cells, lambda x: x.rlike(r"^\d+$"))
    party = F.filter(cells, lambda x: ~x.rlike(r"^\d+$") & (F.lower(x) != label))
    out = rows.select("pos", F.get(number, 0).alias("number"), F.get(party, 0).alias("list"), F.explode(links).alias("l")).select("pos", "number", "list", "l.file")
    key = out.withColumn("name", F.substring_index("file", "/", -1))
    best = key.groupBy("list", "name").agg(F.min_by(F.struct("number", "file"), "pos").alias("b"))
    return best.select("b.number", "list", "b.file")


def definitions(spark: SparkSession, path: str) -> DataFrame:
    """(number, label, definition) of the rows of a Markdown table."""
    lines = spark.read.text(path)
    part = lambda i: F.regexp_extract("value", r"^\|\s*(\d+)\s*\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|", i)
    return lines.select(part(1).alias("number"), part(2).alias("label"), part(3).alias("definition")).where("number != ''")


def best_available(full: str, part: str) -> tuple[str, bool]:
    """(path, whether it is only a sample): the full file if it is there."""
    return (full, False) if Path(full).exists() else (part, True)


def not_done(items: DataFrame, cache: DataFrame, key: str = "url") -> DataFrame:
    """What a restart still has to do."""
    return items.join(cache.select(key), key, "left_anti")
