"""A lexicon of patterns, compiled to columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveloom.functions.text import lexicon_form

NONE, PROCESS, BOILERPLATE = "non assegnato", "processo", "boilerplate"


def total(columns: list[Column]) -> Column:
    """A balanced sum: a chain of hundreds of terms would overflow the planner's stack."""
    if not columns:
        return F.lit(0)
    while len(columns) > 1:
        columns = [columns[i] + columns[i + 1] if i + 1 < len(columns) else columns[i] for i in range(0, len(columns), 2)]
    return columns[0]


def occurrences(text: Column, patterns: tuple[str, ...]) -> Column:
    """The sum of each pattern's own count, not the count of their alternation; a cheap test of all comes first."""
    if not patterns:
        return F.lit(0)
    counts = total([F.regexp_count(text, F.lit(p)) for p in patterns])
    return F.when(text.rlike("|".join(f"(?:{p})" for p in patterns)), counts).otherwise(0) if len(patterns) > 1 else counts


@dataclass(frozen=True)
class Taxonomy:
    """themes, process, …: patterns for text in lexicon_form; adding one is a change of data."""

    themes: dict[int, tuple[str, ...]]
    labels: dict[int, str] = field(default_factory=dict)
    process: tuple[str, ...] = ()
    boilerplate: tuple[str, ...] = ()
    exclusions: tuple[str, ...] = ()
    subthemes: dict[int, dict[str, tuple[str, ...]]] = field(default_factory=dict)
    markers: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def label(self, theme: Column) -> Column:
        pairs = [x for k, v in self.labels.items() for x in (F.lit(k), F.lit(v))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), theme), theme.cast("string")) if pairs else theme.cast("string")

    def counted(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with `form`, one count per theme (t1, t2, …), `process_n` and `boiler_n`."""
        df = df.withColumn("form", lexicon_form(F.coalesce(F.col(text), F.lit("")), self.exclusions))
        form = F.col("form")
        columns = {f"t{k}": occurrences(form, p).cast("long") for k, p in self.themes.items()}
        return df.withColumns(columns | {"process_n": occurrences(form, self.process).cast("long"), "boiler_n": occurrences(form, self.boilerplate).cast("long")})

    def classified(self, df: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
        """counted() with `theme_id` (null for service rows), `category` and `margin`.

        Boilerplate comes first; the theme with most hits wins, the lower id at a tie; process wins only with strictly
        more; fewer than `least` hits in all are not assigned. margin: the winner's share of all hits."""
        df = self.counted(df, text)
        best = F.array_max(F.array(*[F.struct(F.col(f"t{k}").alias("n"), F.lit(-k).alias("i")) for k in self.themes]))
        hits = total([F.col(f"t{k}") for k in self.themes]) + F.col("process_n")
        # always true, but no filter is pushed below it: there every pattern would be written out again at each use of its count
        df = df.withColumn("best", best).withColumn("hits", F.when(F.spark_partition_id() >= 0, hits))
        none, process = F.col("hits") < least, F.col("process_n") > F.col("best.n")
        category = F.when(F.col("boiler_n") > 0, BOILERPLATE).when(none, NONE).when(process, PROCESS).otherwise((-F.col("best.i")).cast("string"))
        theme = F.when((F.col("boiler_n") > 0) | none | process, F.lit(None)).otherwise(-F.col("best.i")).cast("int")
        win = F.greatest("best.n", "process_n") / F.col("hits")
        return df.withColumns({"category": category, "theme_id": theme, "margin": F.when(none | (F.col("boiler_n") > 0), 0.0).otherwise(win)}).drop("best")

    def winner_occurrences(self, text: Column, theme: Column) -> Column:
        """How often the patterns of a unit's own theme occur in the text as it stands, whatever their case; accents
        count as they are, unlike in the classifier's counts. 0 for service rows."""
        out = F.lit(0)
        for k, patterns in self.themes.items():
            out = F.when(theme == k, total([F.regexp_count(text, F.lit(f"(?i){p}")) for p in patterns])).otherwise(out)
        return out

    def subtheme(self, parent: int, form: Column) -> Column:
        """The child with most hits, the first declared at a tie; null without hits."""
        children = self.subthemes[parent]
        best = F.array_max(F.array(*[F.struct(occurrences(form, p).cast("long").alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, p) in enumerate(children.items())]))
        return F.when(best["n"] > 0, best["k"])

    def marked(self, form: Column, least: int = 1) -> Column:
        """The markers that occur `least` times or more."""
        found = F.array(*[F.when(occurrences(form, p) >= least, F.lit(k)) for k, p in self.markers.items()])
        return F.filter(found, lambda x: x.isNotNull())
