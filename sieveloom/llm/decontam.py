"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters (case folded, white space squeezed) has an error budget of
k = floor(RATE * m). It is split into k + 1 pieces: a text within k edits of the item
holds at least one piece unchanged, where it stands give or take k. The pieces are an index
of their first WIDTH bytes, in arrays; the runs of WIDTH bytes of every whole text are
looked up in it at one go, and the pieces found are compared in full. A stretch around a hit that lacks more than k of the item's runs of GRAM letters, one after
the other, is more than k edits away, as an edit breaks at most one of them; around the other
hits Myers' bit-parallel algorithm gives the least edit distance of the item to any stretch
of the text.

The items are the query set. They go to the executors as one index, so the corpus is scanned
once, up to BLOCK_ITEMS items or BLOCK_CHARS characters; more are taken in blocks by a hash of
the item, one scan each, so that what an executor holds is bounded however many there are.
Every block meets every document. The texts are never shuffled.

Edge cases: null and empty items match nothing; items under 1 / RATE characters must
match exactly; equal items are all reported; null and empty texts hold nothing;
documents without an id appear with a null doc_id; repeated rows are reported each; extra
columns are ignored by matches() and kept by decontaminated(). Empty tables of either kind
match nothing. Looking up takes SLICE bytes at a time, however long a text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.llm import common as c

RATE, GRAM, WIDTH = 0.1, 5, 8
BLOCK_ITEMS, BLOCK_CHARS, SLICE = 200_000, 40_000_000, 1 << 18
_SCATTER, _ALL = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 1)


def folded(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 stretches that cover m characters, as even as can be."""
    cuts = [i * m // (k + 1) for i in range(k + 2)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def grams(text: str) -> list[str]:
    """The runs of GRAM letters of a text, one after the other."""
    return [text[i : i + GRAM] for i in range(0, len(text) - GRAM + 1, GRAM)]


def lacks(runs: list[str], text: str, most: int) -> bool:
    """Whether more than `most` of the runs are not in the text."""
    for g in runs:
        if g not in text:
            most -= 1
            if most < 0:
                return True
    return False


def myers(pattern_bits: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """(least edit distance of the pattern to a stretch of text, the stretch's end), if at most k."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, k + 1, -1
    get = pattern_bits.get
    for i, ch in enumerate(text):
        eq = get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & mask
        mv = ph & xv & mask
        if score < best:
            best, end = score, i + 1
            if not best:
                break
    return (best, end) if best <= k else None


class Index:
    """The pieces of the items of one block, by their first WIDTH bytes (or all, of shorter ones) as one number."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.ids, self.texts, self.known = [], [], {}
        rows: dict[int, list[tuple[int, int, int]]] = {}
        keys: dict[int, list[int]] = {}
        self.budget = []
        for item_id, raw in items:
            if text := folded(raw):
                k = int(rate * len(text))
                for x, y in pieces(len(text), k):
                    head = _bytes(text[x:y])[:WIDTH]
                    rows.setdefault(len(head), []).append((len(self.ids), x, y - x))
                    keys.setdefault(len(head), []).append(int.from_bytes(head, "little"))
                self.ids.append(item_id)
                self.texts.append(text)
                self.budget.append(k)
        self.parts = {}
        for width, own in rows.items():
            key = np.array(keys[width], np.uint64)
            order = np.argsort(key, kind="stable")
            bits = max(16, (8 * len(key)).bit_length())
            there = np.zeros(1 << bits, bool)
            there[(key * _SCATTER) >> np.uint64(64 - bits)] = True
            self.parts[width] = (key[order], np.array(own, np.int32)[order], there, np.uint64(64 - bits), np.uint64((1 << 8 * width) - 1))

    def hits(self, text: bytes):
        """(place in bytes, item number, the piece's place in the item, its size) of the index's runs in a text."""
        for first in range(0, len(text), SLICE):
            a = np.frombuffer(text[first : first + SLICE + WIDTH] + bytes(WIDTH), np.uint8)
            two = a[:-1] | a[1:].astype(np.uint16) << np.uint16(8)
            four = two[:-2] | two[2:].astype(np.uint32) << np.uint32(16)
            eight = (four[:-4] | four[4:].astype(np.uint64) << np.uint64(32))[: min(SLICE, len(text) - first)]
            for known, rows, there, shift, mask in self.parts.values():
                key = eight & mask if mask != _ALL else eight
                at = np.flatnonzero(there[(key * _SCATTER) >> shift])
                lo, hi = (np.searchsorted(known, key[at], side) for side in ("left", "right"))
                some = np.flatnonzero(hi > lo)
                if len(some):
                    n = (hi - lo)[some]
                    yield np.repeat(at[some] + first, n), *rows[c.spread(lo[some], n)].T

    def item(self, n: int) -> tuple[dict[str, int], list[str]]:
        """(places of each character as bits, letter runs) of an item that has hits."""
        if n not in self.known:
            if len(self.known) > 4_000:
                self.known.clear()
            bits: dict[str, int] = {}
            for i, ch in enumerate(self.texts[n]):
                bits[ch] = bits.get(ch, 0) | 1 << i
            self.known[n] = bits, grams(self.texts[n])
        return self.known[n]

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text number, item number, distance, end in the folded text) of the best match of each item in each text."""
        out = []
        for lo, hi in c.slices(texts, SLICE):
            whole = "\n".join(texts[lo:hi])  # folded texts hold no line break, so no piece crosses one
            border = np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])
            raw = _bytes(whole)
            found = list(self.hits(raw))
            if not found:
                continue
            place, number, at, size = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(raw) > len(whole):  # from bytes to characters
                place = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, dtype=np.int64)[place] - 1
            text = np.searchsorted(border, place, "right") - 1
            order = np.lexsort((place - at, number, text))
            spans: dict[tuple[int, int], list[list[int]]] = {}
            for t, n, p, a, s in zip(*(x[order].tolist() for x in (text, number, place, at, size)), strict=True):
                if whole.startswith(self.texts[n][a : a + s], p):
                    k, first = self.budget[n], int(border[t])
                    start, end = max(first, p - a - k), min(int(border[t + 1]) - 1, p - a + len(self.texts[n]) + k)
                    own = spans.setdefault((t, n), [])
                    if own and start <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], end)
                    else:
                        own.append([start, end])
            for (t, n), own in spans.items():
                k, best = self.budget[n], None
                bits, runs = self.item(n)
                for start, end in own:
                    part = whole[start:end]
                    if lacks(runs, part, k):
                        continue
                    if (got := myers(bits, len(self.texts[n]), part, k)) and (best is None or got[0] < best[0]):
                        best = (got[0], start - int(border[t]) + got[1])
                if best:
                    out.append((lo + t, n, *best))
        return out


def _bytes(text: str) -> bytes:
    """UTF-8; half a surrogate pair, as JSON may bring one, is a character like others."""
    return text.encode("utf-8", "surrogatepass")


def indexes(items: DataFrame, id_col: str, text_col: str, rate: float, size: int = BLOCK_ITEMS):
    """The broadcast index of each block of about `size` items or BLOCK_CHARS characters, by a hash of id and text."""
    own = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    n, chars = own.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    n = max(1, -(-n // size), -(-chars // BLOCK_CHARS))
    for b in range(n):
        index = Index([(r.i, r.t) for r in own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()], rate)
        yield items.sparkSession.sparkContext.broadcast(index)


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, distance, end): for every row of docs and item within the error budget, its least
    edit distance and where that match ends in the folded text."""
    c.ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for index in indexes(items, item_id, item_text, rate, block_items):

        def run(batches, index=index):
            for b in batches:
                docs, found = b.column(0).to_pylist(), index.value.search([folded(t) for t in b.column(1).to_pylist()])
                rows = [(docs[t], index.value.ids[n], dist, end) for t, n, dist, end in found]
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["doc_id", "item_id", "distance", "end"])

        part = own.mapInArrow(c.lean(run), "doc_id long, item_id long, distance long, end long")
        out = part if out is None else out.union(part)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, item_id: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs, all columns, that hold no item within its error budget."""
    c.ship(docs.sparkSession)
    at, schema = docs.columns.index("text"), docs.schema
    for index in indexes(items, item_id, item_text, rate, block_items):

        def run(batches, index=index):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[t for t, *_ in index.value.search([folded(t) for t in b.column(at).to_pylist()])]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(c.lean(run), schema)
    return docs
