"""Cleaning at the level of the corpus: template lines, copies, language, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.functions import text as X
from sieveloom.schema import keep_first


@dataclass(frozen=True)
class Limits:
    """Template rules (all inclusive): a domain's lines, and lines of the whole corpus."""

    domain_docs: int = 20
    domain_share: float = 0.30
    corpus_docs: int = 200
    corpus_share: float = 0.02
    corpus_domains: int = 3
    least_chars: int = 300


def by_language(docs: DataFrame, keep: str = "it") -> DataFrame:
    """Rows of a language; a missing one counts as `keep`."""
    return docs.where(F.coalesce("language", F.lit(keep)) == keep)


def long_enough(docs: DataFrame, least: int) -> DataFrame:
    return docs.where(F.length("text") >= least)


def document_lines(docs: DataFrame) -> DataFrame:
    """(ord, domain, line): each normalised line once per document."""
    lines = F.array_distinct(F.transform(X.lines(F.col("text")), X.line_form))
    return docs.select("ord", "domain", F.explode(lines).alias("line")).where("line != ''")


def domain_templates(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(domain, line, df, n): lines in a large share of the documents of a domain that has enough of them."""
    sizes = docs.groupBy("domain").agg(F.count("*").alias("n")).where(F.col("n") >= limits.domain_docs)
    df = document_lines(docs).groupBy("domain", "line").agg(F.count("*").alias("df"))
    return df.join(sizes, "domain").where(F.col("df") >= F.lit(limits.domain_share) * F.col("n"))


def corpus_templates(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(line, df, domains): lines in a share of the whole corpus, on enough domains; none in a small corpus."""
    size = docs.agg(F.count("*").alias("size")).where(F.col("size") >= limits.corpus_docs)
    lines = document_lines(docs).groupBy("domain", "line").agg(F.count("*").alias("d")).groupBy("line").agg(F.sum("d").alias("df"), F.count("*").alias("domains"))
    return lines.join(F.broadcast(size), F.col("df") >= F.lit(limits.corpus_share) * F.col("size")).where(F.col("domains") >= limits.corpus_domains).drop("size")


def without_templates(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """docs with template lines taken out (the rest keeps its order, trimmed), and `removed` lines for each document.

    Texts stay whole: a domain's template lines, of which a rule by shares allows some hundreds, come to its documents
    as one list, and lines are tested within the row."""
    local = domain_templates(docs, limits).groupBy("domain").agg(F.collect_set("line").alias("own"))
    common = corpus_templates(docs, limits).agg(F.collect_set("line").alias("all"))
    rows = docs.join(local, "domain", "left").join(F.broadcast(common))  # one row
    out = F.coalesce(F.array_union(F.coalesce("own", F.array().cast("array<string>")), "all"), F.array().cast("array<string>"))
    raw = F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r]")

    def stays(x):
        return X.once(X.line_form(x), lambda line: ~((F.length(line) >= 3) & F.array_contains("out", line)))

    def here(c):
        """No filter is pushed below: the column would be worked out again there."""
        return F.when(F.spark_partition_id() >= 0, c)

    rows = rows.withColumn("out", out).withColumn("raw", here(raw)).withColumn("kept", here(F.when(F.size("out") > 0, F.filter("raw", stays)).otherwise(F.col("raw"))))
    text = here(F.regexp_replace(F.array_join("kept", "\n"), r"^\s+|\s+$", ""))
    return rows.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], (F.size("raw") - F.size("kept")).cast("long").alias("removed"))


def text_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the first by `ord` of each text fingerprint, and the others."""
    marked = docs.withColumn("mark", X.fingerprint(F.coalesce(F.col("text"), F.lit(""))))
    first = marked.groupBy("mark").agg(F.min("ord").alias("first"))
    marked = marked.join(first, "mark")
    return marked.where("ord = first").drop("mark", "first"), marked.where("ord != first").drop("mark", "first")


def url_copies(docs: DataFrame) -> DataFrame:
    return keep_first(docs, ["url"], ["ord"])


def cleaned(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Encoding, templates, length, copies, language, in this order; `removed` counts the lines taken out."""
    out = docs.withColumn("text", X.repaired(F.coalesce(F.col("text"), F.lit(""))))
    out = long_enough(without_templates(out, limits), limits.least_chars)
    # a rank, not a join with the first of each text: the join would read and strip all texts twice
    kept = keep_first(out.withColumn("mark", X.fingerprint(F.col("text"))), ["mark"], ["ord"]).drop("mark")
    return kept.withColumn("detected", X.language(F.col("text"))).withColumn("chars", F.length("text").cast("long"))


def report(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(metric, value): documents in and out, texts repaired, lines removed, emptied documents, copies, templates, domains
    with templates. One pass over the texts groups them by fingerprint; the counts follow from the groups."""
    damaged = X.mojibake(F.coalesce("text", F.lit("")))
    fixed = docs.withColumn("fixed", X.repaired(F.coalesce("text", F.lit(""))))
    fixed = fixed.withColumn("repaired", (damaged & (F.col("fixed") != F.col("text"))).cast("long")).withColumn("text", F.col("fixed")).drop("fixed")
    long = F.length("text") >= limits.least_chars
    marks = without_templates(fixed, limits).select(F.when(long, X.fingerprint(F.col("text"))).alias("mark"), "removed", "repaired")
    marks = marks.groupBy("mark").agg(F.count("*").alias("n"), F.sum("removed").alias("removed"), F.sum("repaired").alias("repaired"))
    own = F.col("mark").isNotNull()
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    one = marks.agg(
        total("n").alias("documents_in"), total("repaired").alias("repaired"), total("removed").alias("lines_removed"), total(F.when(~own, F.col("n"))).alias("too_short"),
        total(F.when(own, F.col("n") - 1)).alias("copies"), F.count_if(own).alias("documents_out"),
    )
    local = domain_templates(fixed, limits).groupBy("domain").agg(F.count("*").alias("n")).agg(total("n").alias("domain_templates"), F.count("*").alias("domains_with_templates"))
    common = corpus_templates(fixed, limits).agg(F.count("*").alias("corpus_templates"))
    out = None
    for part in (one, local, common):
        part = part.unpivot([], part.columns, "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out


def template_report(docs: DataFrame, domains: int = 20, lines: int = 10, limits: Limits = Limits()) -> DataFrame:
    """(domain, line, df, share, rank): the most frequent template lines of the domains that have most of them."""
    local = domain_templates(docs, limits)
    most = local.groupBy("domain").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "domain").limit(domains)
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("df"), "line"))
    out = local.join(F.broadcast(most), "domain").withColumn("rank", rank).where(F.col("rank") <= lines)
    return out.select("domain", "line", "df", (F.col("df") / F.col("n")).alias("share"), "rank")


def language_changes(docs: DataFrame) -> DataFrame:
    """(language, detected, n): what the check of languages would change, rows of unknown language left as they are."""
    detected = X.once(X.language(F.col("text")), lambda d: F.when(d == "unknown", F.col("language")).otherwise(d))
    return docs.groupBy("language", detected.alias("detected")).agg(F.count("*").alias("n"))
