"""Substring dedup with difference-cover anchors.

A text's words are numbered from 0. The residues COVER = {0, 1, 3, 9} modulo 13 have
every difference modulo 13 among them, so for any two places there is a shift below 13
that brings both to cover places. Words are hashed in runs of 8 at cover places only
(the anchors): if two windows of 20 words are equal, they share an aligned anchor, with
at most 12 words before it. Anchors that occur once are dropped. Around the others the
match is extended: each window of 20 words that holds a repeated anchor is hashed whole
(95 bits), and the first place of every window hash is kept. A window that also starts
earlier is covered; covered words are removed.

Shuffles: one of anchors (4/13 of the words), two of the texts by id, one of the windows
around repeated anchors; each is written out and its shuffle files dropped before the next.
Texts equal to an earlier one are settled without windows. What a task has several times of
an anchor or a window among HELD of them in a row leaves it as one row, so a passage in a
third of all documents is a key of some rows for each task; no pairs are formed.

Edge cases: null and empty texts have no words; texts under 20 words lose nothing; rows
without an id lose nothing and cover nothing; repeated rows (same id and text) count as
one document and each gets the same result; a text may repeat itself. Extra columns are
ignored by removed() and kept by cleaned().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.llm import common as c

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Anchors or windows in which a task looks for repeats at one go: some 100 MB with what sorting them takes.
HELD = 2_000_000
_COVER = np.zeros(PERIOD, bool)
_COVER[list(COVER)] = True


def cover_places(n: int) -> np.ndarray:
    """The places of the anchors in a text of n words."""
    return np.flatnonzero(_COVER[np.arange(max(0, n - ANCHOR + 1)) % PERIOD])


def _firsts(i: np.ndarray, p: np.ndarray, *h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that are the first of their hash, by id and place; how many each has; the other rows). Rows equal in hash, id
    and place, those of a repeated row of the table, are one."""
    order = np.lexsort((p, i, *reversed(h)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in h:
        new[1:] |= x[order][1:] != x[order][:-1]
    once = new.copy()
    for x in (i, p):
        once[1:] |= x[order][1:] != x[order][:-1]
    order, new = order[once], new[once]
    return order[new], np.diff(np.append(np.flatnonzero(new), len(order))), order[~new]


def _known(i: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, list]:
    """(ids, places of each)."""
    order = np.lexsort((p, i))
    ids, first = np.unique(i[order], return_index=True)
    return ids, np.split(p[order], first[1:]) if len(ids) else []


def anchors(texts: DataFrame) -> DataFrame:
    """(hash, id, place, n, known): the anchors of the texts that have a whole window.

    What a task has more than once of a hash is one row, its first, with their number n; the other places are known to be
    repeated, and go as one row per document (place null) whose hash only spreads them."""

    def run(batches):
        h, i, p = [], [], []
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), c.as_bytes(b.column(1))
            for lo, words, at in c.hashed_docs(texts):
                wins = c.window_hashes(words, ANCHOR)
                for j in range(len(at) - 1):
                    n = at[j + 1] - at[j]
                    if n >= WINDOW:
                        place = cover_places(n)
                        h.append(wins[at[j] + place])
                        p.append(place)
                        i.append(np.full(len(place), ids[lo + j], np.int64))
                if sum(map(len, h)) >= HELD:
                    yield from out(h, i, p)
                    h, i, p = [], [], []
        yield from out(h, i, p)

    def out(h, i, p):
        if h:
            h, i, p = np.concatenate(h), np.concatenate(i), np.concatenate(p)
            first, n, rest = _firsts(i, p, h)
            first, n = first[k := np.lexsort((p[first], i[first]))], n[k]  # by document, which packs better
            who, places = _known(i[rest], p[rest])
            yield _rows(("hash", "id", "place", "n", "known"), (c.signed(h[first]), i[first], p[first], n), (c.signed(c.mix(who.view(np.uint64))), who, np.full(len(who), 2)), places)

    return texts.mapInArrow(c.lean(run), "hash long, id long, place int, n int, known array<int>")


def _rows(names, some, spread, places) -> pa.RecordBatch:
    """Rows of firsts, then rows of known places."""
    h, i, p, n = some
    who = len(spread[1])
    none = pa.nulls(len(i), pa.list_(pa.int32()))
    cols = [
        pa.array(np.concatenate([h, spread[0]])), pa.array(np.concatenate([i, spread[1]])), pa.concat_arrays([pa.array(p, pa.int32()), pa.nulls(who, pa.int32())]),
        pa.array(np.concatenate([n, spread[2]]), pa.int32()), pa.concat_arrays([none, pa.array([x.astype(np.int32) for x in places], pa.list_(pa.int32()))]),
    ]
    return pa.RecordBatch.from_arrays(cols, names=list(names))


def windows(texts: DataFrame) -> DataFrame:
    """(h1, h2, id, place, known) of every window that holds one of the places in `places`; rows as in anchors(), those of
    known places with the h2 -1 that no window has."""

    def run(batches):
        x, y, i, p = [], [], [], []
        for b in batches:
            ids, texts, places = b.column(0).to_numpy(zero_copy_only=False), c.as_bytes(b.column(1)), b.column(2)
            for lo, words, at in c.hashed_docs(texts):
                one, two = c.window_hashes(words, WINDOW), c.window_hashes(c.mix(words ^ np.uint64(0x5851F42D4C957F2D)), WINDOW)
                for j in range(len(at) - 1):
                    n = at[j + 1] - at[j] - WINDOW + 1
                    if n <= 0:
                        continue
                    held = np.asarray(places[lo + j].as_py(), np.int64)
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, np.minimum(np.maximum(held - PERIOD + 1, 0), n), 1)
                    np.add.at(step, np.minimum(held + 1, n), -1)
                    start = np.flatnonzero(np.cumsum(step)[:n] > 0)
                    x.append(one[at[j] + start])
                    y.append((two[at[j] + start] >> np.uint64(33)).astype(np.int32))
                    p.append(start)
                    i.append(np.full(len(start), ids[lo + j], np.int64))
                if sum(map(len, x)) >= HELD:
                    yield from out(x, y, i, p)
                    x, y, i, p = [], [], [], []
        yield from out(x, y, i, p)

    def out(x, y, i, p):
        if x:
            x, y, i, p = np.concatenate(x), np.concatenate(y), np.concatenate(i), np.concatenate(p)
            first, _, rest = _firsts(i, p, x, y)
            first = first[np.lexsort((p[first], i[first]))]
            who, known = _known(i[rest], p[rest])
            yield _rows(("h1", "id", "place", "h2", "known"), (c.signed(x[first]), i[first], p[first], y[first]), (c.signed(c.mix(who.view(np.uint64))), who, np.full(len(who), -1)), known)

    return texts.mapInArrow(c.lean(run), "h1 long, id long, place int, h2 int, known array<int>")


def _gathered(rows: DataFrame) -> DataFrame:
    """(id, places): single places and known ones of each document."""
    return rows.groupBy("id").agg(F.array_distinct(F.concat(F.collect_list("place"), F.flatten(F.collect_list("known")))).alias("places"))


def covered(texts: DataFrame) -> DataFrame:
    """(id, places): the starts of the windows of each document that also start earlier. places is null for a
    document of 20 words or more that equals an earlier one: all its windows do. texts: (id, text), ids not null."""
    texts = texts.withColumn("same", F.md5("text"))
    # written out, so that a text in very many rows is a skewed key of a plain join, which adaptive execution splits
    first = c.cut(texts.groupBy("same").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last").select("same", "first"))
    copies = c.cut(texts.select("id", "same").join(first, "same").where("id != first").select("id").distinct())
    c.release(texts.sparkSession)
    found = c.cut(_gathered(anchors(texts.select("id", "text")).withColumn("n", F.sum("n").over(Window.partitionBy("hash"))).where("n > 1")).join(copies, "id", "left_anti"))
    c.release(texts.sparkSession)
    seen = windows(texts.select("id", "text").join(found, "id").select("id", "text", "places")).withColumn("first", F.min(F.struct("id", "place")).over(Window.partitionBy("h1", "h2")))
    later = c.cut(_gathered(seen.where("known is not null or first.id != id or first.place != place").select("id", "place", "known")))
    c.release(texts.sparkSession)
    return later.unionByName(copies.select("id", F.lit(None).cast("array<int>").alias("places")))


def kept_words(text: bytes, places: list | None, known: bool) -> tuple[list[bytes], int]:
    """(the words that stay, the number of words before)."""
    words = text.split()
    n = len(words)
    if not known or n < WINDOW:
        return words, n
    if places is None:
        return [], n
    step = np.zeros(n + 1, np.int64)
    at = np.asarray(places, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    gone = np.cumsum(step)[:n] > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], n


def _joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __places and __known."""
    c.ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    found = covered(texts).select(F.col("id").alias("__id"), F.col("places").alias("__places"), F.lit(True).alias("__known"))
    return docs.join(found, F.col(id_col).cast("long") == F.col("__id"), "left")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs."""

    def run(batches):
        for b in batches:
            n, gone, sha = [], [], []
            for t, places, known in zip(c.as_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words, total = kept_words(t, places, bool(known))
                n.append(total)
                gone.append(total - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _joined(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), "__places", "__known")
    return rows.mapInArrow(c.lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with the covered words taken out of their texts, and n_chars to match where there is such a column.
    A text that loses words has the rest joined by single spaces; one that loses all goes; others stay as they are."""
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    schema = docs.schema

    def run(batches):
        for b in batches:
            raw, out, keep = b.column(at).to_pylist(), [], []
            for t, places, known in zip(raw, b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True):
                if known:
                    words, total = kept_words(t.encode(), places, True)
                    if len(words) < total:
                        t = b" ".join(words).decode()
                        out.append(t)
                        keep.append(bool(words))
                        continue
                out.append(t)
                keep.append(True)
            arrays = [b.column(i) for i in range(len(names))]
            arrays[at] = pa.array(out, b.schema.field(at).type)
            if size is not None:
                arrays[size] = pa.array([n if t is r or t == r else len(t) for t, r, n in zip(out, raw, arrays[size].to_pylist(), strict=True)], b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(keep, pa.bool_()))

    return _joined(docs, "doc_id", "text").select(*[F.col(f"`{x}`") for x in names], "__places", "__known").mapInArrow(c.lean(run), schema)
