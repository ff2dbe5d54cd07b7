"""MinHash near-dedup with HyperMinHash registers.

Each text's set of distinct word shingles is dealt into REGISTERS buckets by the high part of
its hashes, in one pass; a register keeps only the leading-zero count and MANTISSA bits of its
bucket's minimum. A bucket that a small set leaves empty takes its minimum over the whole set
under a hash function of its own, so that small sets lose no independence. Registers are
banded; texts that share a band's bucket are compared by the collision-corrected Jaccard
estimate, and pairs that may reach the threshold are confirmed on the full sets. Groups are
the connected components of confirmed links.

Equal sets are one class from the start, so exact copies cost one row each. The rest goes in
two rounds. In the first, every member of a bucket is compared to the bucket's smallest id,
and confirmed against the one it resembles most: work and rows in proportion to the members,
however large a bucket is. Only buckets whose members still lie in different components go
on. There the members outside the bucket's largest component meet each other and those in it,
in units of two blocks; first with registers alone, and then only those that have a partner
with full sets. Pairs of one component are never compared, no list of pairs is made, a unit is
bounded in members and bytes, and no link between components is lost.

With four registers a band and 24 bands, a pair at similarity 0.8 shares no bucket with
probability 3e-6; the estimate is passed down to 5 standard errors under the threshold.

Edge cases: null and empty texts, and texts without words, have the empty set: size 0,
linked with nothing. A text with fewer words than a shingle has one shingle, its whole
sequence. Rows without an id stay in the result with a null component and kept = false.
Repeated rows (same id, same text) share a class and each gets the same answer; of rows with
one id and different texts, one text is confirmed. deduplicated() keeps all repeated rows of
an id that stays. Extra columns of the input are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.llm import common as c

REGISTERS, ROWS, MANTISSA = 96, 4, 10
#: A block has about so many members, and shingle sets of about so many bytes; two blocks meet at a time.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
_EDGE = np.array([-(-(i << 64) // REGISTERS) for i in range(REGISTERS)], np.uint64)
_rng = np.random.default_rng(41)
_FLIP = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_TIMES = _rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The compressed minima of a sorted set of 64-bit shingle hashes (at least one)."""
    at = np.searchsorted(shingles, _EDGE)
    low = shingles[np.minimum(at, len(shingles) - 1)] - _EDGE
    empty = np.flatnonzero(at == np.append(at[1:], len(shingles)))
    if len(empty):
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(empty), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 2048):
            least = np.minimum(least, ((x[i : i + 2048, None] ^ _FLIP[empty]) * _TIMES[empty]).min(axis=0))
        low[empty] = least
    # the exponent of a double stands for the leading zeros; its first fraction bits are the mantissa
    bits = np.maximum(low, 1).astype(np.float64).view(np.uint64)
    return ((bits >> np.uint64(52 - MANTISSA)) - np.uint64(1023 << MANTISSA)).astype(np.uint16)


def chance(n: float, m: float) -> float:
    """The probability that registers of two disjoint sets of n and m elements agree: minima near
    density exp(-nx), exp(-mx), in cells of width about 0.72 x 2**-MANTISSA."""
    return 0.5 / math.log(2) * 2.0**-MANTISSA * n * m / (n + m) ** 2


def near(regs: np.ndarray, size: np.ndarray, own: np.ndarray, n: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows of regs may reach the threshold with `own`, share of registers that agree)."""
    agree = (regs == own).mean(axis=1)
    by_chance = 4 * chance(1, 1) * size * n / (size + n) ** 2
    p, most = percent / 100, np.maximum(size, n)
    full = REGISTERS * -np.expm1(-most / REGISTERS)
    ok = (agree - by_chance) / (1 - by_chance) >= p - 5 * np.sqrt(p * (1 - p) / full)
    return ok & (np.minimum(size, n) * 100 >= most * percent), agree


def shingle_sets(texts: list[bytes], k: int):
    """(index, sorted distinct shingle hashes) of every text, with ASCII letters in lower case."""
    for lo, words, at in c.hashed_docs(texts, lower=True):
        wins = c.window_hashes(words, k)
        for j in range(len(at) - 1):
            a, b = at[j], at[j + 1]
            if b - a >= k:
                yield lo + j, np.unique(wins[a : b - k + 1])
            elif b > a:
                yield lo + j, c.window_hashes(words[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield lo + j, words[:0]


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, key, regs); the last two are null for the empty set; key names the set."""

    def run(batches):
        for b in batches:
            texts = c.as_bytes(b.column(1))
            n, key, regs = [0] * len(texts), [None] * len(texts), [None] * len(texts)
            for i, s in shingle_sets(texts, k):
                if len(s):
                    n[i], key[i], regs[i] = len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), registers(s).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n", "key", "regs"])

    c.ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(c.lean(run), "doc_id long, n long, key binary, regs binary")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of (id, text)."""

    def run(batches):
        for b in batches:
            texts = c.as_bytes(b.column(1))
            sets = [None] * len(texts)
            for i, s in shingle_sets(texts, k):
                sets[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return docs.mapInArrow(c.lean(run), "id long, shingles binary")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Texts are linked if 100 * shared >= percent * all distinct shingles of the two."""
    table = c.cut(sketches(docs, k, id_col, text_col))
    some = F.col("key").isNotNull() & F.col("doc_id").isNotNull()
    classes = c.cut(table.where(some).groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs")))
    links = _links(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), classes, k, percent)
    found = classes.select("key", "id")
    if links is not None:
        found = found.join(links.withColumnRenamed("node", "id"), "id", "left")
        found = found.select("key", F.coalesce("component", "id").alias("component"))
    else:
        found = found.select("key", F.col("id").alias("component"))
    # rows without a key are not joined: they would all meet in one task
    out = table.where(some).select("doc_id", "n", "key").join(found, "key").select("doc_id", "n", "component")
    out = out.unionByName(table.where(~some).select("doc_id", "n", F.col("doc_id").alias("component")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, band, id, size, centre): the members of buckets that are shared; of buckets with the same members, the first band's."""
    bucket = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.xxhash64(F.substring("regs", i * (2 * ROWS) + 1, F.lit(2 * ROWS)), i))
    spread = classes.select("id", F.posexplode(bucket).alias("band", "bucket"))
    who = [F.bit_xor(F.xxhash64("id")).alias("who"), F.sum(F.shiftright(F.xxhash64("id", F.lit(7)), 32)).alias("sum")]
    shared = spread.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("centre"), F.min("band").alias("band"), *who).where("size > 1")
    shared = shared.groupBy("size", "centre", "who", "sum").agg(F.min_by("bucket", "band").alias("bucket")).select("bucket", "size", "centre")
    return spread.join(shared, "bucket").select("bucket", "band", "id", "size", "centre")


def _links(texts: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame | None:
    """(node, component) of the classes that have links."""
    spark = classes.sparkSession
    members = c.cut(_buckets(classes))
    if members.isEmpty():
        return None
    some = members.select("id").distinct()
    # neither side is broadcast, at any size
    wanted = texts.hint("merge").join(some, "id", "left_semi").groupBy("id").agg(F.first("text", True).alias("text"))
    sets = c.cut(full_sets(wanted, k))
    c.release(spark)
    known = classes.select("id", "n", "regs")
    # links are written out, so that no task has one Python worker to confirm them and another one to contract them
    first = c.components(c.cut(_stars(members, known, sets, percent)))
    second = c.cut(_rest(members, known, sets, first, percent))
    return c.components(first.unionByName(second))


def _stars(members: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component): confirmed links of members to the centre of one of their buckets, the one they resemble most."""

    def estimate(batches):
        for b in batches:
            x, n, y, m = (b.column(i) for i in range(2, 6))
            regs, own = (np.frombuffer(b"".join(v.to_pylist()), np.uint16).reshape(-1, REGISTERS) for v in (x, y))
            ok, agree = near(regs, n.to_numpy().astype(float), own, m.to_numpy().astype(float), percent)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(agree)], names=["id", "centre", "agree"]).filter(pa.array(ok))

    pairs = members.where("id != centre and size > 2").select("id", "centre").distinct()
    pairs = pairs.join(known.select("id", F.col("regs").alias("x"), "n"), "id").join(known.select(F.col("id").alias("centre"), F.col("regs").alias("y"), F.col("n").alias("m")), "centre")
    pairs = pairs.select("id", "centre", "x", "n", "y", "m").mapInArrow(c.lean(estimate), "id long, centre long, agree double")
    best = c.cut(pairs.groupBy("id").agg(F.max_by("centre", F.struct("agree", -F.col("centre"))).alias("centre")))
    # a centre meets its members in units of at most about BLOCK; of each unit only the centre's set is held
    units = best.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias("m"))
    rows = best.join(units, "centre").select("centre", F.pmod(F.xxhash64("id", F.lit(9)), F.col("m")).cast("int").alias("unit"), F.lit(1).alias("kind"), "id")
    rows = rows.unionByName(units.select("centre", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("unit"), F.lit(0).alias("kind"), F.col("centre").alias("id")))
    rows = c.dealt(rows.join(sets, "id"), sets, "centre", "unit").sortWithinPartitions("centre", "unit", "kind")

    def confirm(batches):
        own = np.empty(0, np.uint64)
        for b in batches:
            a, z = [], []
            for node, centre, kind, s in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if not kind:
                    own = np.frombuffer(s, np.uint64)
                elif linked(np.frombuffer(s, np.uint64), own, percent):
                    a.append(node)
                    z.append(centre)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["node", "component"])

    return rows.select("id", "centre", "kind", "shingles").mapInArrow(c.lean(confirm), "node long, component long")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    both = np.intersect1d(x, y, assume_unique=True).size
    return both * 100 >= (len(x) + len(y) - both) * percent


UNIT = ["bucket", "x", "y"]


def _rest(members: DataFrame, known: DataFrame, sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(node, component): confirmed links between members of one bucket that `groups` leaves in different components."""
    own = members.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    own = own.join(known.select("id", "n"), "id")
    parts = own.groupBy("bucket", "component").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    parts = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("size").alias("size"), F.sum("n").alias("n"), F.max(F.struct("size", "n", "component")).alias("big")).where("parts > 1")
    deal = lambda size, n: F.greatest(F.ceil(size / F.lit(float(BLOCK))), F.ceil(n * 8 / F.lit(float(BLOCK_BYTES)))).cast("int")
    parts = parts.select("bucket", F.col("big.component").alias("big"), deal(F.col("big.size"), F.col("big.n")).alias("g"), deal(F.col("size") - F.col("big.size"), F.col("n") - F.col("big.n")).alias("s"))
    parts = c.cut(parts)  # a very large bucket is then a skewed key of a plain join, which adaptive execution splits
    own = own.join(parts, "bucket").withColumn("inside", F.col("component") == F.col("big"))
    own = own.withColumn("own", F.pmod(F.xxhash64("id", F.lit(9)), F.when(F.col("inside"), F.col("g")).otherwise(F.col("s"))).cast("int"))
    # unit (x, y): block x of the largest component with block y of the others, or block x - g of the others with block y < x - g
    step = lambda n: F.sequence(F.lit(0), n - 1)
    at = F.when(F.col("inside"), F.transform(step(F.col("s")), lambda y: F.struct(F.col("own").alias("x"), y.alias("y"))))
    others = F.filter(step(F.col("s")), lambda j: j != F.col("own"))
    others = F.transform(others, lambda j: F.struct((F.col("g") + F.greatest(j, F.col("own"))).alias("x"), F.least(j, F.col("own")).alias("y")))
    at = at.otherwise(F.concat(F.transform(step(F.col("g")), lambda x: F.struct(x.alias("x"), F.col("own").alias("y"))), others))
    # the kind of a unit: 0 also compares the others of its block among themselves, 1 does not, 2 compares two blocks of others
    kind = F.when(F.col("x") == 0, 0).when(F.col("x") < F.col("g"), 1).otherwise(2)
    units = own.withColumn("at", F.explode(at)).select("id", "component", "band", F.when(F.col("inside"), -1).otherwise(F.col("own")).alias("own"), "bucket", "at.x", "at.y", "g").withColumn("kind", kind).drop("g")
    units = units.select("id", "component", "own", "band", "kind", *UNIT)
    sketch = c.dealt(units.join(known, "id").select(*units.columns, "n", "regs"), sets, *UNIT).sortWithinPartitions(*UNIT)

    def candidates(held, i, regs, size, own, part):
        """Which of the members before i may be linked with it, are in another component, and meet it here first; and how they agree."""
        ok, agree = near(regs[:i], size[:i], regs[i], size[i], percent)
        ok &= part[:i] != part[i]
        band, kind = held[0][3:5]
        if kind == 1:
            ok &= (own[:i] < 0) != (own[i] < 0)
        elif kind == 2:
            ok &= own[:i] != own[i]
        if band and ok.any():  # in the first band that brings the two together
            at = np.flatnonzero(ok)
            ok[at] = ~(regs[at, : band * ROWS] == regs[i, : band * ROWS]).reshape(len(at), band, ROWS).all(axis=2).any(axis=1)
        return np.flatnonzero(ok), agree

    def arrays(held):
        return np.frombuffer(b"".join(r[9] for r in held), np.uint16).reshape(-1, REGISTERS), np.array([r[8] for r in held], float), np.array([r[2] for r in held]), np.array([r[1] for r in held])

    def grouped(batches):
        name, held = None, []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if row[5:8] != name:
                    if len(held) > 1:
                        yield held
                    name, held = row[5:8], []
                held.append(row)
        if len(held) > 1:
            yield held

    def look(batches):
        for held in grouped(batches):
            regs, size, own, part = arrays(held)
            some = np.zeros(len(held), bool)
            for i in range(1, len(held)):
                at, _ = candidates(held, i, regs, size, own, part)
                some[at] = True
                some[i] |= len(at) > 0
            if some.any():
                cols = zip(*[held[i][:8] for i in np.flatnonzero(some)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types, strict=True)], names=names)

    names = list(units.columns)
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    left = c.cut(sketch.mapInArrow(c.lean(look), "id long, component long, own int, band int, kind int, bucket long, x int, y int"))
    c.release(members.sparkSession)
    full = c.dealt(left.join(known, "id").join(sets, "id").select(*units.columns, "n", "regs", "shingles"), sets, *UNIT).sortWithinPartitions(*UNIT)

    def confirm(batches):
        for held in grouped(batches):
            regs, size, own, part = arrays(held)
            sets = [np.frombuffer(r[10], np.uint64) for r in held]
            forest, out = c.Forest(), []
            for i in range(1, len(held)):
                at, agree = candidates(held, i, regs, size, own, part)
                for j in at[np.argsort(-agree[at], kind="stable")].tolist():
                    a, b = int(part[i]), int(part[j])
                    if forest.find(a) != forest.find(b) and linked(sets[i], sets[j], percent):
                        forest.join(a, b)
                        out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], names=["node", "component"])

    return full.mapInArrow(c.lean(confirm), "node long, component long")


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, less those whose group has a smaller doc_id; rows without an id stay.

    What is removed is joined back by doc_id: a small table against the documents."""
    gone = near_duplicates(docs, k, percent).where("doc_id is not null and not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
