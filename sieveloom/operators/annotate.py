"""Annotation files: validation and agreement."""

from __future__ import annotations

import difflib
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bad_values(df: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """(column, value, n): values that are neither empty nor allowed."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in allowed])).alias("x")).select("x.*")
    ok = reduce(lambda a, b: a | b, [(F.col("column") == c) & F.col("value").isin(*v) for c, v in allowed.items()])
    return long.where((F.col("value") != "") & ~ok).groupBy("column", "value").agg(F.count("*").alias("n"))


def empties(df: DataFrame, required: list[str]) -> DataFrame:
    """(column, empty): cells left empty in each required column."""
    one = df.agg(*[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(c) for c in required])
    return one.unpivot([], required, "column", "empty")


def changed(source: DataFrame, copy: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column): cells of immutable columns that differ, and rows that only one side has (column `row`)."""
    a, b = source.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in columns], F.lit(1).alias("ha")), copy.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in columns], F.lit(1).alias("hb"))
    both = a.join(b, key, "full")
    lone = F.col("ha").isNull() | F.col("hb").isNull()
    diffs = F.filter(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return both.select(key, F.explode(F.when(lone, F.array(F.lit("row"))).otherwise(diffs)).alias("column"))


def phases(df: DataFrame, order: list, calibration: int) -> DataFrame:
    """`phase`: the first rows calibrate, the others are independent. The file is a report of bounded size."""
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return df.withColumn("position", n).withColumn("phase", F.when(n <= calibration, "calibration").otherwise("independent"))


def blind(df: DataFrame, visible: list[str], fill: list[str]) -> DataFrame:
    """Only what reviewers may see, and empty columns to fill."""
    return df.select(*visible, *[F.lit("").alias(c) for c in fill])


def file_counts(df: DataFrame, fill: list[str]) -> DataFrame:
    """(rows, calibration, independent, filled)."""
    filled = reduce(lambda a, b: a + b, [(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("long") for c in fill])
    return df.agg(F.count("*").alias("rows"), F.count_if(F.col("phase") == "calibration").alias("calibration"), F.count_if(F.col("phase") == "independent").alias("independent"), F.coalesce(F.sum(filled), F.lit(0)).alias("filled"))


def paired(key: DataFrame, first: DataFrame, second: DataFrame, on: str) -> DataFrame:
    """key with the columns of both reviewers, suffixed _r1 and _r2; ValueError if a row is missing or doubled."""
    side = lambda d, s: d.select(on, *[F.col(c).alias(f"{c}_{s}") for c in d.columns if c != on])
    out = key.join(side(first, "r1"), on).join(side(second, "r2"), on)
    if out.count() != key.count():
        raise ValueError("reviewers and key do not match row by row")
    return out


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, observed, expected, kappa): Cohen's, unweighted; null where chance alone agrees fully."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    cells = cells.select("a", "b", "c", F.sum("c").over(Window.partitionBy("a")).alias("ra"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("n"))
    # marginals of b are read on the rows of a: sum over labels of ra(l) * cb(l)
    rows = cells.groupBy("a").agg(F.first("ra").alias("ra"), F.first("n").alias("n"))
    cols = cells.groupBy("b").agg(F.sum("c").alias("cb"))
    chance = rows.join(cols, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("ra").cast("double") * F.col("cb")), F.lit(0.0)).alias("x"))
    seen = cells.agg(F.first("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("c"))), F.lit(0)).alias("same"))
    out = seen.join(F.broadcast(chance)).select("n", (F.col("same") / F.col("n")).alias("observed"), (F.col("x") / (F.col("n").cast("double") * F.col("n"))).alias("expected"))
    return out.withColumn("kappa", F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")))


def agreement(df: DataFrame, a: str, b: str, a2: str, b2: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, exact, wide): wide also takes a primary that is the other's secondary."""
    exact = F.col(a) == F.col(b)
    wide = exact | (F.col(a) == F.col(b2)) | (F.col(b) == F.col(a2))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.coalesce(exact, F.lit(False)).cast("int")).alias("exact"), F.avg(F.coalesce(wide, F.lit(False)).cast("int")).alias("wide"))


def interval(p: Column, n: Column) -> tuple[Column, Column]:
    """The normal 95 % interval of a percentage, within 0 and 100."""
    half = F.lit(196.0) * F.sqrt(F.try_divide(p / 100 * (1 - p / 100), n))
    return F.greatest(F.lit(0.0), p - half), F.least(F.lit(100.0), p + half)


def precision(df: DataFrame, right: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, right, precision, low, high) of a boolean column; null is not judged."""
    out = df.where(F.col(right).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(right).cast("long")).alias("right"))
    p = 100.0 * F.col("right") / F.col("n")
    low, high = interval(p, F.col("n"))
    return out.withColumns({"precision": p, "low": low, "high": high})


def precision_by_band(df: DataFrame, right: str, score: str, bands: list[int]) -> DataFrame:
    """By the band of a score: band b holds scores from b up to the next."""
    band = F.array_max(F.filter(F.array(*[F.lit(b) for b in bands]), lambda b: b <= F.col(score)))
    return precision(df.withColumn("band", band).where("band is not null"), right, ("band",))


def precision_by_threshold(df: DataFrame, right: str, score: str, thresholds: list[int]) -> DataFrame:
    """Cumulative: threshold t holds all scores of t or more."""
    wide = df.withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col(score))))
    return precision(wide, right, ("threshold",))


def never_right(df: DataFrame, key: str, right: str) -> DataFrame:
    """Keys judged and never confirmed."""
    return df.where(F.col(right).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col(right).cast("long")).alias("right")).where("right = 0").select(key, "n")


def flattened(text: str | None) -> str:
    """Lower case without accents and replacement characters, white space squeezed: what damaged labels are compared by."""
    marks = unicodedata.normalize("NFKD", text or "")
    return " ".join("".join(ch for ch in marks if ch != "\ufffd" and not unicodedata.combining(ch)).lower().split())


def repaired_label(value: str | None, labels: list[str], cutoff: float = 0.82, note: str = "") -> str:
    """A reviewer's label as one of the known ones: equal in flat form; else the only one that it is a part of; else the
    most alike above the cutoff; else as it was, trimmed. Blank stays blank, `dubbio` where the note says so. Runs on the
    driver over the few distinct labels."""
    own, known = flattened(value), {flattened(x): x for x in labels}
    if not own:
        return "dubbio" if "dubbio" in flattened(note) else ""
    if own not in known:
        parts = [x for x in known if own in x]
        alike = parts if len(parts) == 1 else difflib.get_close_matches(own, known, 1, cutoff)
        if not alike:
            return (value or "").strip()
        own = alike[0]
    return known[own]


def policy(label: Column, without: list[str]) -> Column:
    """Whether a label names a policy theme, `yes` or `no`; null where the reviewer was in doubt or left it blank."""
    blank = F.coalesce(label, F.lit("")).isin("", "dubbio")
    return F.when(~blank, F.when(label.isin(*without), "no").otherwise("yes"))


def confirmed(outcome: Column, *labels: Column) -> Column:
    """Whether any of the reviewers' labels that are not blank is the lexicon's outcome."""
    return F.coalesce(F.array_contains(F.filter(F.array(*labels), lambda x: x != ""), outcome), F.lit(False))


def lexicon_validation(df: DataFrame, none: str, without: list[str]) -> DataFrame:
    """One row over (outcome, first_r1, second_r1, first_r2, second_r2): labelled rows, percent confirmed by any label of
    either reviewer (generous) and by the first label of the first (strict), rows and percent of false positives (both
    say there is no policy), and agreement on policy over the rows where both answer."""
    col = F.col
    one, two = policy(col("first_r1"), without), policy(col("first_r2"), without)
    both, own = one.isNotNull() & two.isNotNull(), F.coalesce(~col("outcome").isin(none, ""), F.lit(False))
    pct = lambda c, of: 100.0 * F.avg(F.when(of, c.cast("int")))
    false = (one == "no") & (two == "no")
    return df.agg(
        F.count_if(own).alias("labelled"), pct(confirmed(col("outcome"), *[col(f"{x}_{r}") for x in ("first", "second") for r in ("r1", "r2")]), own).alias("generous"),
        pct(confirmed(col("outcome"), col("first_r1")), own).alias("strict"), F.count_if(own & false).alias("false_positives"),
        pct(F.coalesce(false, F.lit(False)), own).alias("false_percent"), F.count_if(both).alias("policy_rows"), pct(one == two, both).alias("policy_agreement"),
    )
