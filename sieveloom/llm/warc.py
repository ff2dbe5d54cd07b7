"""WARC derivative builder.

Each response record gives two linked records: a `metadata` record (application/warc-fields:
title, language, number of links, source content type) and a `conversion` record with the
page's plain text. Both keep the response's target URI, date and identifier (WARC-Refers-To),
its HTTP headers, and its payload digest beside the digest of their own block. Identifiers
are made from contents, so a rerun writes the same records. The main path is DataFrame
functions within the row: no shuffle.

Edge cases: a null or empty payload gives records with empty text and the digest of no
bytes; null identifiers or URIs become empty fields and are hashed as such; repeated rows
give repeated records; unclosed comments and scripts run to the end of the page; clashing
extra columns are ignored. Nothing is cut off, however long the page.
"""

from __future__ import annotations

import gzip
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: From HTML to text, in order: patterns that Java and RE2 read alike.
STEPS = (
    (r"(?s)<!--.*?(-->|$)", " "),
    (r"(?is)<script[^>]*>.*?(</script[^>]*>|$)", " "),
    (r"(?is)<style[^>]*>.*?(</style[^>]*>|$)", " "),
    (r"(?is)<title[^>]*>.*?</title[^>]*>", " "),
    (r"(?i)<br[^>]*>|</?(p|div|h[1-6]|li|ul|ol|tr|table|article|section|nav|header|footer)( [^>]*)?>", "\n"),
    (r"(?s)<[^>]*>", ""),
)
#: Characters by the names that HTML 4 gives them, from Python's table, and the apostrophe.
ENTITIES = {name: chr(point) for name, point in sorted(name2codepoint.items())} | {"apos": "'", "nbsp": " "}
#: The entities that most pages have are replaced in whole texts; none of them makes a new ampersand.
COMMON = ("lt", "gt", "quot", "nbsp", "copy", "middot")
SPACES = ((r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"))
TITLE, LANG, LINK = r"(?is)<title[^>]*>(.*?)</title[^>]*>", r"(?i)<html[^>]* lang=\"([^\"]*)\"", r"(?i)<a [^>]*href="


def decoded(x: Column) -> Column:
    """Named and numbered entities as characters, each once, so that &amp;lt; becomes &lt;; others stay. Numbers that
    name no character stay too; the no-break space becomes a space."""
    names = F.create_map(*[F.lit(v) for pair in ENTITIES.items() for v in pair])

    def one(p, i):
        name = F.substring_index(p, ";", 1)
        number = F.when(name.rlike(r"^#[0-9]{1,7}$"), F.substring(name, 2, 7).cast("int")).when(name.rlike(r"^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substring(name, 3, 6), 16, 10).cast("int"))
        number = F.when((number > 0) & (number < 0xD800) | (number > 0xDFFF) & (number <= 0x10FFFF), number)
        point = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        char = F.when(F.contains(p, F.lit(";")), F.when(F.startswith(p, F.lit("#")), F.when(number == 160, " ").otherwise(point)).otherwise(F.try_element_at(names, name)))
        rest = F.substring(p, F.length(name) + 2, F.length(p))
        return F.when(i == 0, p).when(char.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), p))

    for name in COMMON:
        x = F.replace(x, F.lit(f"&{name};"), F.lit(ENTITIES[name]))
    x = F.replace(x, F.lit("&#39;"), F.lit("'"))
    rare = lambda v: v.rlike("&(?!amp;)[A-Za-z#][A-Za-z0-9]{1,8};")
    whole = lambda v: F.when(rare(v), F.array_join(F.transform(F.split(v, "&"), one), "")).otherwise(F.replace(v, F.lit("&amp;"), F.lit("&")))
    return F.get(F.transform(F.array(x), whole), 0)  # a lambda's argument is computed once


def plain(html: Column) -> Column:
    """The text of a page."""
    x = F.coalesce(html, F.lit(""))
    for pattern, to in STEPS:
        x = F.regexp_replace(x, pattern, to)
    x = decoded(x)
    for pattern, to in SPACES:
        x = F.regexp_replace(x, pattern, to)
    return F.btrim(x, F.lit(" \n"))


def digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(x, "UTF-8"), 256))


def urn(*parts: Column) -> Column:
    """A uuid-shaped name of its parts."""
    h = F.md5(F.encode(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), "UTF-8"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", content_type: str = "text/html; charset=utf-8") -> DataFrame:
    """Response records (record_id, target_uri, date, headers, payload, page_id) of a table of pages without headers."""
    uri, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(html).cast("string"))
    return pages.select(urn(F.lit("response"), F.col("page_id").cast("string"), uri, digest(html)).alias("record_id"), uri.alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"), html.alias("payload"), F.col("page_id").cast("long").alias("page_id"))


def derived(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of response records: (page_id, record_type, record_id, refers_to,
    target_uri, date, content_type, n_bytes, block_digest, source_digest, source_headers, content)."""
    payload = F.coalesce("payload", F.lit(""))
    headers = F.coalesce("headers", F.lit(""))
    kind = F.regexp_extract(headers, r"(?i)content-type: *([^\r\n]*)", 1)
    base = records.select(
        "page_id", F.coalesce("record_id", F.lit("")).alias("refers_to"), F.coalesce("target_uri", F.lit("")).alias("target_uri"), F.coalesce("date", F.lit("")).alias("date"),
        headers.alias("source_headers"), digest(payload).alias("source_digest"), plain(payload).alias("text"), kind.alias("kind"),
        F.btrim(F.regexp_replace(decoded(F.regexp_extract(payload, TITLE, 1)), r"[ \t\r\n\f]+", " "), F.lit(" ")).alias("title"), F.regexp_extract(payload, LANG, 1).alias("lang"),
        F.regexp_count(payload, F.lit(LINK)).alias("links"),
    )
    fields = F.concat(F.lit("title: "), F.col("title"), F.lit("\r\nlanguage: "), F.col("lang"), F.lit("\r\noutlinks: "), F.col("links").cast("string"), F.lit("\r\nsource-content-type: "), F.col("kind"), F.lit("\r\n"))
    two = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("content")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("content")),
    )
    out = base.withColumn("r", F.explode(two)).select("*", "r.*").withColumn("block_digest", digest(F.col("content")))
    return out.select(
        "page_id", "record_type", urn(F.col("record_type"), F.col("refers_to"), F.col("block_digest")).alias("record_id"), "refers_to", "target_uri", "date", "content_type",
        F.octet_length("content").cast("long").alias("n_bytes"), "block_digest", "source_digest", "source_headers", "content",
    )


def formatted(records: DataFrame) -> DataFrame:
    """(page_id, record_type, warc): each derived record as WARC/1.1 text; the source's headers are one field, its lines
    joined by semicolons."""
    lines = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"), ("WARC-Source-Headers", "source_headers"), ("Content-Type", "content_type"), ("Content-Length", "n_bytes")]
    one = lambda c: F.regexp_replace(F.col(c).cast("string"), r"[\r\n]+", "; ")  # noqa: E731 - a field is one line
    head = F.concat(F.lit("WARC/1.1\r\n"), *[F.concat(F.lit(f"{k}: "), one(c), F.lit("\r\n")) for k, c in lines])
    return records.select("page_id", "record_type", F.concat(head, F.lit("\r\n"), F.col("content"), F.lit("\r\n\r\n")).alias("warc"))


def parse(data: bytes) -> list[tuple[dict, bytes]]:
    """(headers, block) of each record of a WARC file, plain or gzipped."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out, at = [], 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            break
        pairs = (x.split(b":", 1) for x in data[at:end].split(b"\r\n")[1:] if b":" in x)
        headers = {k.strip().decode("utf-8", "replace").lower(): v.strip().decode("utf-8", "replace") for k, v in pairs}
        size = int(headers.get("content-length") or 0)
        out.append((headers, data[end + 4 : end + 4 + size]))
        at = end + 4 + size
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files, in the shape that derived() takes; one file is one row of binary input."""
    import pandas as pd

    def run(frames):
        for f in frames:
            rows = []
            for data in f.content:
                for h, block in parse(bytes(data)):
                    if h.get("warc-type") == "response":
                        head, _, body = block.partition(b"\r\n\r\n")
                        rows.append((h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), head.decode("utf-8", "replace"), body.decode("utf-8", "replace"), None))
            yield pd.DataFrame(rows, columns=["record_id", "target_uri", "date", "headers", "payload", "page_id"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "record_id string, target_uri string, date string, headers string, payload string, page_id long")


def oracle_sql(date: str = "1970-01-01T00:00:00Z", content_type: str = "text/html; charset=utf-8") -> str:
    """The same over `pages`, for DuckDB."""
    def quote(x):
        return "'" + x.replace("'", "''") + "'"

    def each(x, steps):
        for pattern, to in steps:
            x = f"regexp_replace({x}, {quote(pattern)}, {quote(to) if to != chr(10) else 'chr(10)'}, 'g')"
        return x

    known = "map {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in ENTITIES.items()) + "}"

    def plainly(x):
        name = "split_part(p, ';', 1)"
        number = f"case when regexp_full_match({name}, '#[0-9]{{1,7}}') then cast(substr({name}, 2) as integer) when regexp_full_match({name}, '#[xX][0-9a-fA-F]{{1,6}}') then cast('0x' || substr({name}, 3) as integer) end"
        point = f"case when {number} = 160 then ' ' when {number} between 1 and 55295 or {number} between 57344 and 1114111 then chr({number}) end"
        char = f"case when contains(p, ';') then case when p[1] = '#' then {point} else {known}[{name}] end end"
        return f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: case when i = 1 then p else coalesce({char} || substr(p, length({name}) + 2), '&' || p) end), '')"

    text = plainly(each("payload", STEPS))
    title = plainly(f"regexp_extract(payload, {quote(TITLE)}, 1)")
    text = f"trim({each(text, SPACES)}, ' ' || chr(10))"
    crlf = "chr(13) || chr(10)"
    name = lambda x: f"'<urn:uuid:' || substr({x},1,8) || '-' || substr({x},9,4) || '-' || substr({x},13,4) || '-' || substr({x},17,4) || '-' || substr({x},21,12) || '>'"
    return f"""
with src as (select page_id, coalesce(url, '') as target_uri, coalesce(html, '') as payload from pages),
named as (select *, 'sha256:' || sha256(payload) as source_digest,
  'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: {content_type}' || {crlf} || 'Content-Length: ' || strlen(payload) as source_headers,
  md5(concat_ws(chr(10), 'response', cast(page_id as varchar), target_uri, 'sha256:' || sha256(payload))) as h from src),
base as (select page_id, {name("h")} as refers_to, target_uri, '{date}' as date, source_headers, source_digest, {text} as text,
  trim(regexp_replace({title}, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ') as title, regexp_extract(payload, {quote(LANG)}, 1) as lang,
  len(regexp_extract_all(payload, {quote(LINK)})) as links from named),
two as (select *, 'metadata' as record_type, 'application/warc-fields' as content_type,
  'title: ' || title || {crlf} || 'language: ' || lang || {crlf} || 'outlinks: ' || links || {crlf} || 'source-content-type: {content_type}' || {crlf} as content from base
  union all select *, 'conversion', 'text/plain; charset=utf-8', text from base),
last as (select *, 'sha256:' || sha256(content) as block_digest from two),
ids as (select *, md5(concat_ws(chr(10), record_type, refers_to, block_digest)) as r from last)
select page_id, record_type, {name("r")} as record_id, refers_to, target_uri, date, content_type, cast(strlen(content) as bigint) as n_bytes,
  block_digest, source_digest, source_headers, content from ids"""
