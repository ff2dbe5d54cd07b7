"""Documents: PDF test, text layer, recognition fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_pdf(content: Column, content_type: Column) -> Column:
    """By the first bytes; by the content type where there is no content."""
    magic = F.startswith(content, F.lit(b"%PDF-"))
    return F.coalesce(magic, F.lower(content_type).contains("application/pdf"), F.lit(False))


def needs_recognition(text: Column, least: int = 200) -> Column:
    return F.length(F.btrim(F.coalesce(text, F.lit("")))) < least


def effective_dpi(pixels: Column, dpi: int, most: int) -> Column:
    """The resolution at which a page of so many pixels at `dpi` has at most `most`; 36 at least."""
    low = F.floor(F.lit(float(dpi)) * F.sqrt(F.lit(float(most)) / pixels)).cast("int")
    return F.greatest(F.lit(36), F.when(pixels > most, low).otherwise(F.lit(dpi)))


def record(url: Column, title: Column, text: Column, source: str) -> list[Column]:
    """The shared columns of a record; `source` says how the text was got."""
    return [url.alias("url"), F.lower(F.regexp_extract(url, r"://([^/?#:]+)", 1)).alias("domain"), title.alias("title"), text.alias("text"), F.length(text).cast("long").alias("chars"), F.lit(source).alias("extraction")]


def html_records(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Records by the paragraphs of a page; a readability extractor can be put in its place with mapInPandas."""
    from sieveloom.functions import web

    return pages.select(*record(F.col(url), web.page_title(F.col(html)), web.paragraph_text(F.col(html)), "fallback_p"), web.meta_description(F.col(html)).alias("description"))


def recognised(files: DataFrame, engine: Callable[[], Callable[[bytes], list[str]]], least: int = 20) -> DataFrame:
    """(url, text): pages of at least `least` characters joined by blank lines. engine() makes one recogniser a worker;
    a page or file that fails costs only itself. files: (url, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = engine()
        for f in frames:
            texts = []
            for content in f.content:
                try:
                    pages = read(bytes(content))
                except Exception:  # an unreadable file has no text; the others go on
                    pages = []
                texts.append("\n\n".join(p.strip() for p in pages if p and len(p.strip()) >= least))
            yield pd.DataFrame({"url": f.url, "text": texts})

    return files.select("url", "content").mapInPandas(run, "url string, text string")


def with_cached_text(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Left join of texts got before, empty where there is none."""
    return items.join(cache.select("url", F.col("text").alias("__t")), "url", "left").withColumn("text", F.coalesce("text", "__t", F.lit(""))).drop("__t")
