"""URL filter by the ratio of two character language models.

Rules judge the URLs they fit. Those allowed train the accepted model, those blocked the
rejected one: counts of all character runs up to ORDER + 1, over all judged URLs. A model
keeps every context seen LEAST times or more with all that followed it, however many
there are, and blends orders by Witten-Bell smoothing. A URL's score is the difference of
its log-likelihoods for each character; the threshold is where the judged URLs of the
held-out fold are divided best, with the model of the other folds.

No model is held in one place. URLs lie in blocks of up to BLOCK rows; a block gives each of
its runs of ORDER + 1 characters once. Their counts, summed over all blocks, give those of
the shorter runs; all runs with their counts and their contexts' sums are one distributed
table, whose probabilities follow from those of the runs one character shorter, a join for
each order. The full runs' log-ratios go back to the blocks that hold them. Every key of
these joins has one row for each block or each character of the alphabet at most.

Edge cases: null URLs, and those without "://", have an empty host and path, fit no
rule, and are scored as what text they have; an empty text scores 0 and is allowed when
the threshold is not above 0. With no judged URL on one side the models say nothing,
every score is 0 and the verdict is allow. Repeated rows count and are judged each; of
rules of the same length the first listed wins. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.llm import common as c
from sieveloom.llm.quality import held_out

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDER, LEAST = 5, 2
#: Up to so many URLs share one list of runs; a power of 2.
BLOCK = 1024
#: (accepted, rejected) by the judged URLs outside the held-out fold, and by all of them.
SIDES = ("good0", "bad0", "good", "bad")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first "://" up to / ? # or the end, ASCII letters in lower case; then up to ? # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def judged(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _text(url: Column) -> Column:
    """What is scored: the URL without its scheme."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")


def _spelled(url: str) -> list[str]:
    """The run of ORDER + 1 characters that ends at each character of the URL and at its end."""
    s = "^" * ORDER + url + "$"
    return [s[i - ORDER : i + 1] for i in range(ORDER, len(s))]


def block_runs(rows: DataFrame) -> DataFrame:
    """(block, run, times by side) of (block, text, verdict, fold) rows; runs of URLs without a verdict come with zeros."""

    def count(batches):
        for b in batches:
            found = defaultdict(lambda: defaultdict(Counter))
            for block, url, verdict, fold in zip(*[x.to_pylist() for x in b.columns], strict=True):
                found[block][verdict, fold and verdict is not None].update(_spelled(url))
            for block, by in found.items():
                runs = list(set().union(*by.values()))
                n = [[by[v, False][r] for r in runs] for v in ("allow", "block")]
                n += [[x + by[v, True][r] for x, r in zip(n[k], runs, strict=True)] for k, v in enumerate(("allow", "block"))]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(runs), pa.int64()), pa.array(runs, pa.string()), *[pa.array(x, pa.int64()) for x in n]], names=["block", "run", *SIDES])

    return rows.select("block", "text", "verdict", "fold").mapInArrow(count, "block long, run string, " + ", ".join(f"{x} long" for x in SIDES))


def log_ratios(runs: DataFrame) -> DataFrame:
    """(run, trial, ratio): log P(last character | the others) accepted less rejected, by the model of the other folds and by that of all."""
    sums = [F.sum(x).alias(x) for x in SIDES]
    whole = runs.groupBy("run").agg(*sums)
    every = whole.select(F.explode(F.expr(f"transform(sequence(1, {ORDER + 1}), i -> substring(run, i))")).alias("run"), *SIDES).groupBy("run").agg(*sums)
    context = Window.partitionBy(F.expr("substring(run, 1, length(run) - 1)"))
    every = every.select("run", F.length("run").alias("size"), *SIDES, *[F.sum(x).over(context).alias(f"{x}_n") for x in SIDES], *[F.sum(F.when(F.col(x) > 0, 1).otherwise(0)).over(context).alias(f"{x}_t") for x in SIDES])
    every = c.cut(every)
    now = None
    for size in range(1, ORDER + 2):
        rows = every.where(F.col("size") == size)
        if now is None:
            rows = rows.select("*", *[F.lit(1 / 256).alias(f"{x}_p") for x in SIDES])
        else:
            rows = rows.withColumn("shorter", F.expr("substring(run, 2)")).join(now.withColumnRenamed("run", "shorter"), "shorter")
        p = []
        for x, of in zip(SIDES, (SIDES[:2], SIDES[:2], SIDES[2:], SIDES[2:]), strict=True):
            n, t, prior = F.col(f"{x}_n"), F.col(f"{x}_t"), F.col(f"{x}_p")
            kept = (F.col(f"{of[0]}_n") + F.col(f"{of[1]}_n") >= LEAST) & (n > 0)
            p.append(F.when(kept, (F.col(x) + t * prior) / (n + t)).otherwise(prior).alias(f"{x}_p"))
        now = rows.select("run", *p)
    return now.select("run", (F.log("good0_p") - F.log("bad0_p")).alias("trial"), (F.log("good_p") - F.log("bad_p")).alias("ratio"))


def scored(rows: DataFrame, useful: tuple[bool, bool] = (True, True)) -> DataFrame:
    """rows (block, text, verdict, fold and others) with `trial` and `score`, by the two models of log_ratios(); 0 where one is not useful."""
    runs = c.cut(block_runs(rows))
    found = runs.select("block", "run").join(log_ratios(runs), "run")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(right["run"].to_pylist(), zip(right["trial"].to_pylist(), right["ratio"].to_pylist(), strict=True), strict=True))
        out = []
        for url in left["text"].to_pylist():
            each = [known[r] for r in _spelled(url)] if url else [(0.0, 0.0)]
            out.append([sum(x) / len(each) if use else 0.0 for x, use in zip(zip(*each, strict=True), useful, strict=True)])
        for name, x in zip(("trial", "score"), zip(*out, strict=True), strict=True):
            left = left.append_column(name, pa.array(x, pa.float64()))
        return left

    schema = rows.select("*", F.lit(0.0).alias("trial"), F.lit(0.0).alias("score")).schema
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, schema)


def calibrated(rows: DataFrame) -> float:
    """The threshold with the least mean error of both sides, over a histogram of 400 steps."""
    step = F.least(F.greatest(F.floor((F.col("score") + 2) * 100), F.lit(0)), F.lit(399)).alias("step")
    hist = np.zeros((2, 400))
    for r in rows.groupBy(step, "verdict").agg(F.count("*").alias("n")).collect():
        hist[int(r.verdict == "allow"), r.step] += r.n
    if not hist.sum(axis=1).all():
        return 0.0
    good, bad = (hist / hist.sum(axis=1, keepdims=True))[[1, 0]]
    error = np.concatenate([[0], np.cumsum(good)])[:-1] + 1 - np.concatenate([[0], np.cumsum(bad)])[:-1]
    least = np.flatnonzero(error <= error.min() + 1e-12)
    return float(least[len(least) // 2] / 100 - 2)


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of pages."""
    c.ship(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    rule, verdict = judged(host, path, rules)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict"), _text(F.col(url_col)).alias("text"), held_out(F.col(id_col)).alias("fold"))
    rows = c.cut(rows.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1)))
    known = rows.where("verdict is not null")
    sides = {(r.fold, r.verdict) for r in known.select("fold", "verdict").distinct().collect()}
    useful = tuple(all(any((f, v) in sides for f in folds) for v in ("allow", "block")) for folds in ((False,), (False, True)))
    out = c.cut(scored(rows, useful))
    threshold = calibrated(out.where("fold and verdict is not null").select(F.col("trial").alias("score"), "verdict"))
    own = F.when(F.lit(not useful[1]) | (F.col("score") >= threshold), F.lit("allow")).otherwise(F.lit("block"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")
