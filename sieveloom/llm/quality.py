"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each class is a Gaussian over transformed statistics of the whole text. Its covariance
is shrunk towards the pooled one and towards a multiple of the identity; the score is
the posterior from the difference of the two log densities, each a Mahalanobis distance
by a cached Cholesky factor.

The class moments (count, sum, sum of outer products) are sums over all labelled rows,
made by map-side partial aggregation: no sample, and one row per task is shuffled.

Edge cases: null and empty texts have the statistics of an empty text and get a score
like any other; repeated rows are scored each; labels that are null or not 0/1 are left
out, of several labels of one document the largest counts; with rows of one class only,
the score is that class's smoothed prior; with none it is 0.5. Other columns of the
documents, whatever their names, are ignored or kept as `keep` says.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.llm import common as c

#: The document statistics, in order.
NAMES = ("size", "letters", "marks", "symbols", "upper", "variety", "top", "word", "spread", "lines", "repeats", "runs")

_KIND = np.zeros(256, np.int64)
for _b in range(256):
    _ch = chr(_b)
    _KIND[_b] = (
        6 if _b >= 0xC0 else 7 if _b >= 0x80 else 1 if "a" <= _ch <= "z" else 2 if "A" <= _ch <= "Z" else 3 if "0" <= _ch <= "9"
        else 4 if _b in (0x20, *range(9, 14)) else 8 if _ch in "#$%&*+<=>@\\^_`|~{}[]" else 5
    )
_UPPER2 = np.zeros((256, 256), bool)
_UPPER2[0xC3, [*range(0x80, 0x97), *range(0x98, 0x9F)]] = True  # the capitals of Latin-1, as two bytes


def logit(p: float, n: float) -> float:
    """A proportion of n parts, on the logit scale, kept finite."""
    p = (p * n + 0.5) / (n + 1)
    return math.log(p / (1 - p))


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of NAMES for each text."""
    out = np.zeros((len(texts), len(NAMES)))
    for lo, words, at in c.hashed_docs(texts):
        for j in range(len(at) - 1):
            text = texts[lo + j]
            a = np.frombuffer(text, np.uint8)
            k = np.bincount(_KIND[a], minlength=9) if len(a) else np.zeros(9, np.int64)
            accents = int(_UPPER2[a[:-1], a[1:]].sum()) if k[6] and len(a) > 1 else 0
            chars = len(a) - k[7]
            solid = max(1, chars - k[4])
            w = words[at[j] : at[j + 1]]
            n = len(w)
            if n:
                order = np.sort(w)
                first = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
                counts = np.diff(np.append(first, n))
                kinds, top, runs = len(first), int(counts.max()), int((w[1:] == w[:-1]).sum())
            else:
                kinds = top = runs = 0
            lines = text.split(b"\n")
            some = [x for x in lines if len(x) > 2]
            upper = k[2] + accents
            letters = k[1] + k[2] + k[6]
            out[lo + j] = (
                min(math.log1p(chars), 9.5),
                logit(letters / solid, solid),
                logit(k[5] / solid, solid),
                logit(k[8] / solid, solid),
                logit(upper / max(1, letters), letters),
                math.log((kinds + 1) / (n + 1)) / math.log(n + 3),
                logit(top / max(1, n), n),
                math.log(solid / max(1, n)),
                math.log1p(chars / max(1, len(lines))) - math.log1p(chars) * 0.5,
                logit((len(lines) - 1) / max(1, n), n),
                logit(1 - len(set(some)) / max(1, len(some)), len(some)) + math.log(len(some) + 1),
                logit(runs / max(1, n), n),
            )
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""

    def run(batches):
        for b in batches:
            x = statistics(c.as_bytes(b.column(1)))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), values], names=["doc_id", "x"])

    c.ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(c.lean(run), "doc_id long, x array<double>")


class Discriminant:
    """Two Gaussians with their Cholesky factors, fitted from moments.

    moments: {label: (n, sum vector, sum of outer products)}. `pool` and `ridge` are the
    weights of the pooled covariance and of its mean variance in each class covariance;
    `scale` divides the log-density difference, whose size grows with the dependence
    among the statistics that the Gaussians leave out."""

    def __init__(self, moments: dict, pool: float = 0.2, ridge: float = 0.02, scale: float = 2.0):
        d = len(NAMES)
        n = {y: (moments[y][0] if y in moments else 0) for y in (0, 1)}
        self.prior = math.log((n[1] + 1) / (n[0] + 1))
        self.scale, self.parts = scale, {}
        if not (n[0] and n[1]):
            return
        mean = {y: np.asarray(moments[y][1]) / n[y] for y in (0, 1)}
        scatter = {y: np.asarray(moments[y][2]).reshape(d, d) - n[y] * np.outer(mean[y], mean[y]) for y in (0, 1)}
        pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
        self.unit = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        pooled = pooled / np.outer(self.unit, self.unit)
        for y in (0, 1):
            own = scatter[y] / n[y] / np.outer(self.unit, self.unit)
            weight = pool + (1 - pool) * d / (d + n[y])
            cov = (1 - weight) * own + weight * pooled
            cov = (1 - ridge) * cov + ridge * np.trace(cov) / d * np.eye(d) + 1e-6 * np.eye(d)
            chol = np.linalg.cholesky(cov)
            self.parts[y] = (mean[y] / self.unit, np.linalg.inv(chol), -np.log(np.diag(chol)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        if self.parts:
            x = x / self.unit
            dens = {y: logdet - 0.5 * (((x - m) @ inv.T) ** 2).sum(axis=1) for y, (m, inv, logdet) in self.parts.items()}
            z = z + (dens[1] - dens[0]) / self.scale
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(col):
    """True for the fold whose labels are never learnt: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(col.cast("string")) % 5 == 0, F.lit(False))


def moments(x: DataFrame, labels: DataFrame, label: str) -> dict:
    """Class moments over all labelled rows outside the held-out fold: at most two rows reach the driver."""
    d = len(NAMES)
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    y = y.groupBy("doc_id").agg(F.max("y").alias("y")).where(~held_out(F.col("doc_id")))

    def run(batches):
        total = {}
        for b in batches:
            ys = b.column(0).to_numpy()
            xs = np.asarray(b.column(1).flatten()).reshape(len(ys), d)
            for k in (0, 1):
                part = xs[ys == k]
                n, s, o = total.get(k, (0, np.zeros(d), np.zeros((d, d))))
                total[k] = (n + len(part), s + part.sum(axis=0), o + part.T @ part)
        for k, (n, s, o) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([np.concatenate([s, o.ravel()]).tolist()], pa.list_(pa.float64()))], names=["y", "n", "m"]
            )

    parts = x.join(y, "doc_id").select("y", "x").mapInArrow(c.lean(run), "y int, n long, m array<double>")
    sums = parts.groupBy("y").agg(F.sum("n").alias("n"), *[F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(d + d * d)])
    return {r.y: (r.n, np.array(r[2 : 2 + d]), np.array(r[2 + d :])) for r in sums.collect()}


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    x = c.cut(features(docs, id_col, text_col))
    model = Discriminant(moments(x, labels, label))

    def run(batches):
        for b in batches:
            xs = np.asarray(b.column(1).flatten()).reshape(b.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(xs))], names=["doc_id", "score"])

    scored = x.mapInArrow(c.lean(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold.

    The model is fitted first; then each text is scored where it is read, so that no text is shuffled. The statistics are
    written out before: else a task has one Python worker for them and another one for the moments."""
    model = Discriminant(moments(c.cut(features(docs)), labels, "quality"))
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        for b in batches:
            keep = model.score(statistics(c.as_bytes(b.column(at)))) >= threshold
            yield b.filter(pa.array(keep))

    c.ship(docs.sparkSession)
    return docs.mapInArrow(c.lean(run), schema)
