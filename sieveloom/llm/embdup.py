"""Embedding near-dedup by iterative quantisation.

On a bounded sample (SAMPLE vectors, the smallest by a hash of the id) rotations are learnt
that bring the principal directions close to the corners of a cube (ITQ); the signs of the
rotated unit vector are CODE bits for each, and the codes are cut into keys. All vectors are
indexed, one hash table for each key. Vectors that share a key in some table are candidates
and are reranked by the cosine of the original vectors in double precision.

A key has about as many bits as the number of vectors has, so that a bucket holds few
unrelated ones however many vectors there are; and there are as many tables as make a pair
just at the threshold meet in one of them with probability 1 - MISS, were the bits
independent. Every link found is exact.

Equal vectors with equal labels are one class with a weight. A bucket is dealt into
blocks of about BLOCK members and every two blocks meet in one unit of work, where a
matrix product finds the links; a pair counts only in the first table whose key it
shares, so links are counted, not listed, and each unit returns one row per linked
member. Buckets of the same members in several tables are looked at in the first of
them only. Vectors travel in their own precision and are brought to unit length in
doubles, after division by their largest component, so that no square overflows.

Edge cases: vectors that are null, of length 0, zero, or with null or non-finite
components, and those without a label or id, link with nothing: n_links 0, component_id
the own id. Vectors of different lengths are never compared. Repeated rows of one id are
that many copies. With no valid vector the result is all singles, and an empty table gives
an empty one. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveloom.llm import common as c

SAMPLE, CODE, ROUNDS, BLOCK, MISS = 8_192, 64, 30, 256, 0.02


def rotations(sample: np.ndarray, count: int, seed: int = 3) -> list[np.ndarray]:
    """`count` maps (dimensions x 64 bits) from unit vectors to codes whose signs are the bits."""
    d, rng, bits, out = sample.shape[1], np.random.default_rng(seed), CODE, []
    for _ in range(count):
        if len(sample) >= 2:
            values, axes = np.linalg.eigh(sample.T @ sample / len(sample))
            axes = axes[:, np.argsort(-values, kind="stable")][:, :bits]
        else:
            axes = np.eye(d)[:, :bits]
        if axes.shape[1] < bits:  # fewer dimensions than bits: random directions for the rest
            axes = np.hstack([axes, rng.normal(size=(d, bits - axes.shape[1])) / np.sqrt(d)])
        r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        v = sample @ axes
        for _ in range(ROUNDS if len(sample) >= 2 else 0):
            u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ wt).T
        out.append(axes @ r)
    return out


def tables(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a key, number of tables) for n vectors."""
    bits = min(30, max(10, n.bit_length()))
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return bits, (max(1, math.ceil(math.log(MISS) / math.log1p(-same))) if same < 1 else 1)


def keys(unit: np.ndarray, maps: list[np.ndarray], bits: int, count: int) -> np.ndarray:
    """`count` keys of `bits` bits each from the codes, one column per table."""
    signs = np.hstack([unit @ m >= 0 for m in maps])[:, : bits * count]
    return (signs.reshape(len(unit), count, bits) * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def _unit(column, d: int) -> np.ndarray:
    return _scaled(np.asarray(column.flatten()).reshape(-1, d))


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors."""
    spark = vectors.sparkSession
    c.ship(spark)
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    some = F.exists("v", lambda x: x != 0)
    valid = F.when(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull(), finite & some)
    rows = rows.withColumn("ok", F.coalesce(valid, F.lit(False)))
    rows = rows.withColumn("name", F.when(F.col("ok"), F.unhex(F.md5(F.concat_ws(" ", F.col("v").cast("array<string>"))))))
    classes = rows.where("ok").groupBy("label", "name").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = c.cut(classes.withColumn("d", F.size("v")))
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("d", "v").toArrow()
    lengths, held = np.asarray(sample.column("d")), sample.column("v").combine_chunks()
    bits, count = tables(classes.count(), threshold)
    maps = -(-bits * count // CODE)
    learnt = {}
    for d in np.unique(lengths).tolist():
        learnt[d] = rotations(_unit(held.filter(pa.array(lengths == d)), d), maps)

    def code(batches):
        for b in batches:
            lengths, held = np.asarray(b.column(1)), b.column(4)
            for d in np.unique(lengths).tolist():
                pick = pa.array(lengths == d)
                own = held.filter(pick)
                unit = _unit(own, d)
                if d not in learnt:  # a length that the sample lacks: directions from its seed
                    learnt[d] = rotations(np.empty((0, d)), maps)
                k = keys(unit, learnt[d], bits, count)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(i).filter(pick) for i in range(4)], pa.array([x.tobytes() for x in np.asarray(own.flatten()).reshape(-1, d)], pa.binary()), pa.array(list(k), pa.list_(pa.int32()))],
                    names=["id", "d", "weight", "label", "vector", "keys"],
                )

    coded = classes.select("id", "d", "weight", "label", "v")
    coded = c.cut(coded.mapInArrow(code, coded.drop("v").schema.add("vector", T.BinaryType()).add("keys", T.ArrayType(T.IntegerType()))))
    spread = coded.select("id", "label", "d", F.posexplode("keys").alias("t", "key"))
    name = ["label", "d", "t", "key"]
    who = [F.bit_xor(F.xxhash64("id")).alias("who"), F.sum(F.shiftright(F.xxhash64("id", F.lit(7)), 32)).alias("sum")]
    shared = spread.groupBy(*name).agg(F.count("*").alias("size"), *who).where("size > 1")
    shared = shared.groupBy("label", "d", "size", "who", "sum").agg(F.min(F.struct("t", "key")).alias("x")).select("label", "d", "x.*", "size")
    blocks = F.ceil(F.col("size") / F.lit(float(block))).cast("int")
    members = spread.join(shared, name).withColumn("m", blocks).withColumn("own", F.pmod(F.xxhash64("id", F.lit(9)), F.col("m")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    units = members.select("id", *name, "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    units = units.join(coded.select("id", "label", "weight", "vector", "keys"), ["id", "label"])
    order = ["label", "d", "t", "key", "lo", "hi"]
    units = units.withColumn("label", F.col("label").cast("string")).select("id", "own", "weight", "vector", "keys", *order)
    units = c.dealt(units, coded, *order, times=4).sortWithinPartitions(*order)

    def meet(batches):
        name, held = None, []
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for row in zip(*cols, strict=True):
                if row[5:] != name:
                    if len(held) > 1:
                        yield from linked(name, held)
                    name, held = row[5:], []
                held.append(row[:5])
        if len(held) > 1:
            yield from linked(name, held)

    def linked(name, held):
        t, lo, hi = name[2], name[4], name[5]
        x = _scaled(np.frombuffer(b"".join(r[3] for r in held), kind).reshape(len(held), -1))
        k = np.array([r[4] for r in held])
        own, ids, weight = np.array([r[1] for r in held]), np.array([r[0] for r in held]), np.array([r[2] for r in held])
        link = x @ x.T >= threshold
        np.fill_diagonal(link, False)
        if lo != hi:
            link &= own[:, None] != own[None, :]
        for j in range(t):  # a pair counts in the first table that brings it together
            link &= k[:, None, j] != k[None, :, j]
        some = np.flatnonzero(link.any(axis=1))
        if not len(some):
            return
        n = link @ weight
        forest = c.Forest()
        for i in some.tolist():
            for j in np.flatnonzero(link[i, :i]).tolist():
                forest.join(int(ids[i]), int(ids[j]))
        root = [forest.find(int(ids[i])) for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some]), pa.array(root, pa.int64())], names=["id", "n", "root"])

    found = c.cut(units.mapInArrow(meet, "id long, n long, root long"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = c.components(found.select("id", "root")).withColumnRenamed("node", "id")
    result = classes.select("label", "name", "id", "weight").join(counts, "id", "left").join(groups, "id", "left")
    result = result.select(F.col("label").alias("l"), F.col("name").alias("m"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("c"))
    # rows that link with nothing are not joined: without a name they would all meet in one task
    out = rows.where("ok").select("id", "label", "name").join(result, (F.col("label") == F.col("l")) & (F.col("name") == F.col("m"))).select("id", "n_links", "c")
    out = out.unionByName(rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("c")))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(False)).alias("kept"))
