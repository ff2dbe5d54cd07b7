"""Byte-level BPE over a corpus, by a global shuffle of distinct words.

Pre-tokens are found by whole-array rules on code points. Each block of documents (about
BLOCK_BYTES of text) gives its distinct words once, and for each document the places of
these words. Words that are tokens themselves, the most frequent ones among them, have
their id from the rank table that every executor holds. The other words of all blocks are
shuffled by the word itself and sorted, so each distinct one is encoded once; its ids go
back to the blocks that hold it, where the places put the texts together again. Decoding
gathers the bytes of each id from the token table.

No group grows with the frequency of a word: a word has one row for each block that
holds it, and none if it is a token. A block is flushed by size, so memory stays bounded;
one text is never split. Blocks are built twice from the table, also when an executor is
lost: their numbers come from their contents, so the same rows in the same order give the
same blocks; rows in another order fail loudly, with a word without ids.

Edge cases: null and empty texts have no tokens; ids of documents are only carried, so
they may be null or repeat; texts are valid UTF-8, of any length, and special tokens in
them are ordinary text. The rank file must hold all 256 single bytes.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.llm import common as c

BLOCK_BYTES, PIECE_BYTES, FLUSH_WORDS = 32 << 20, 1 << 20, 200_000
_CODEC = "zstd"

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_classes: list[np.ndarray] = []
#: White space in Unicode's sense.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    if not _classes:
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        kinds = [unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)]
        kinds = np.array(kinds)
        table[kinds == "L"], table[kinds == "N"] = LETTER, NUMBER
        table[_WHITE] = SPACE
        _classes.append(table)
    return _classes[0]


def word_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, as a mask. cp: the code points of some texts in a row; first: the mask
    of their first code points. The rules are those of public_tokenizers.PATTERN."""
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    k = classes()[cp]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 9, k[:-1]
    before[first] = 9
    last = np.zeros(n, bool)
    last[-1], last[:-1] = True, first[1:]
    run = k != before  # a run of one class starts here
    follows = np.full(n, SPACE, np.uint8)
    follows[:-1] = k[1:]
    follows[last] = SPACE
    blank = (k == SPACE) & (follows != SPACE)  # the last white space before something else
    start = run | blank
    joins = blank & (cp == 32)  # such a space belongs to what follows
    after = np.zeros(n, bool)
    after[1:] = joins[:-1]
    start &= ~after
    # contractions: an apostrophe that starts a token takes s, t, re, ve, m, ll or d
    at = np.flatnonzero(start & (cp == 39) & ~last)
    if len(at):
        def char(i, j):
            i = i + j
            ok = i < n
            got = np.where(ok, cp[np.minimum(i, n - 1)], 0)
            for step in range(1, j + 1):
                got = np.where(first[np.minimum(at + step, n - 1)] & ok, 0, got)
            return got
        a, b = char(at, 1), char(at, 2)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, length in ((one, 2), (two, 3)):
            p = at[hit]
            for j in range(1, length):
                start[p + j] = False
            p = p[p + length < n] + length
            start[p] = True
    return start


def pretokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in a row, start and end of each pre-token in them, borders): text j has the tokens borders[j]:borders[j+1]."""
    buf = b"".join(texts)
    cp = np.frombuffer(buf.decode("utf-8").encode("utf-32-le"), np.uint32)
    a = np.frombuffer(buf, np.uint8)
    byte_at = np.flatnonzero((a & 0xC0) != 0x80)  # where each code point starts
    at = np.cumsum([0] + [len(t) for t in texts])
    first = np.zeros(len(cp) + 1, bool)
    first[np.searchsorted(byte_at, at)] = True
    s = byte_at[word_starts(cp, first[:-1])]
    return a, s, np.append(s[1:], len(a)), np.searchsorted(s, at)


class Ranks:
    """The merge ranks, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.rank.values()) + 1)
        for x, y in self.rank.items():
            self.bytes[y] = x

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The token-byte table as one array, and the borders of the ids in it."""
        return np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum([0] + [len(x) for x in self.bytes])

    def encode(self, word: bytes) -> list[int]:
        """Repeatedly joins the neighbours of lowest rank, the leftmost first."""
        rank = self.rank
        if (whole := rank.get(word)) is not None:
            return [whole]
        if len(word) > 200:
            return self.encode_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = [rank.get(parts[i] + parts[i + 1], _NONE) for i in range(len(parts) - 1)]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], _NONE)
        return [rank[p] for p in parts]

    def encode_long(self, word: bytes) -> list[int]:
        """The same with a heap and linked neighbours, for words of thousands of bytes."""
        import heapq

        n, rank = len(word), self.rank
        part = [word[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = right[i] if part[i] else -1
            if j < 0 or len(part[i]) + len(part[j]) != size or rank.get(part[i] + part[j]) != r:
                continue
            part[i] += part[j]
            part[j] = b""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (s := rank.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (s, i, len(part[i]) + len(part[k])))
            if (h := left[i]) >= 0 and (s := rank.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (s, h, len(part[h]) + len(part[i])))
        return [rank[p] for p in part if p]


_NONE = 1 << 60


def _pack(x: np.ndarray) -> bytes:
    """Small whole numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return pa.compress(planes.tobytes(), codec=_CODEC, asbytes=True)


def _unpack(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint32)
    raw = pa.decompress(blob, decompressed_size=4 * n, codec=_CODEC, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel()


def _distinct(a: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one span of each distinct word, for each span the number of its word); the spans cover all of a. Words are told
    apart by their bytes: hashes only bring equal ones together."""
    _, first, place = np.unique(c.span_hashes(a, s, e), return_index=True, return_inverse=True)
    like, size = first[place], e - s
    if (size == size[like]).all() and (a == a[c.spread(s[like], size)]).all():
        return first, place
    buf, index, first = a.tobytes(), {}, []
    place = np.empty(len(s), np.int64)
    for i, (x, y) in enumerate(zip(s.tolist(), e.tolist(), strict=True)):
        place[i] = index.setdefault(buf[x:y], len(index))
        if place[i] == len(first):
            first.append(i)
    return np.array(first, np.int64), place


class _Block:
    """The distinct words of some documents, and their places."""

    def __init__(self):
        self.size, self.index, self.places, self.docs = 0, {}, [], []

    def add(self, ids: list, texts: list[bytes]):
        self.size += sum(map(len, texts))
        a, s, e, at = pretokens(texts)
        first, place = _distinct(a, s, e)
        buf, index = a.tobytes(), self.index
        number = [index.setdefault(buf[x:y], len(index)) for x, y in zip(s[first].tolist(), e[first].tolist(), strict=True)]
        self.places.append(np.array(number, np.uint32)[place])
        self.docs.append((ids, np.diff(at)))

    @property
    def number(self) -> int:
        """A number made from the contents, the same wherever the block is built; equal blocks share one."""
        h = hashlib.blake2b(b"\xff".join(self.index), digest_size=8)
        for places, (ids, sizes) in zip(self.places, self.docs, strict=True):
            h.update(places.tobytes() + sizes.tobytes() + repr(ids).encode())
        return int.from_bytes(h.digest(), "little", signed=True)

    def words(self) -> tuple[list[bytes], np.ndarray]:
        """(distinct words, the most frequent first; the place among them of each number)."""
        times = np.zeros(len(self.index), np.int64)
        for p in self.places:
            times += np.bincount(p, minlength=len(times))
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        text = list(self.index)
        return [text[i] for i in order.tolist()], rank


def _blocks(batches, block_bytes: int):
    """Blocks of documents: the same for every run over the same input."""
    block = _Block()
    for b in batches:
        ids, texts = b.column(0).to_pylist(), c.as_bytes(b.column(1))
        for lo, hi in c.slices(texts, PIECE_BYTES):
            block.add(ids[lo:hi], texts[lo:hi])
            if block.size >= block_bytes:
                yield block
                block = _Block()
    if block.docs:
        yield block


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as bytes of little-endian unsigned 32-bit numbers, and the bytes they decode to.

    docs must give the same rows in the same order when read again, as a table does; cut() anything else first."""
    return _assembled(docs, path, id_col, text_col, block_bytes, False)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), from what encoded() makes."""
    return _assembled(docs, path, id_col, text_col, block_bytes, True)


def _assembled(docs, path, id_col, text_col, block_bytes, digest):
    spark = docs.sparkSession
    c.ship(spark)
    ranks = Ranks(path)
    vocabulary = spark.sparkContext.broadcast(ranks)  # one rank file: its size is that of the vocabulary
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def words(batches):
        known = vocabulary.value.rank
        for block in _blocks(batches, block_bytes):
            new = [(w, i) for i, w in enumerate(block.words()[0]) if w not in known]
            number = block.number
            for i in range(0, len(new), 50_000):
                part = new[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([number] * len(part), pa.int64()), pa.array([p for _, p in part], pa.int32())], names=["word", "block", "place"])

    def places(batches):
        rank = vocabulary.value.rank
        for block in _blocks(batches, block_bytes):
            kinds, order = block.words()
            number = block.number
            yield from flush({number: [(i, [rank[w]]) for i, w in enumerate(kinds) if w in rank]})
            for (ids, sizes), p in zip(block.docs, block.places, strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([-1], pa.int32()), pa.array([_pack(order[p])], pa.binary()), pa.array([len(p)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int64()))],
                    names=["block", "part", "blob", "n", "a", "b"],
                )

    def encode(batches):
        """Words arrive sorted; each distinct one is encoded once. The ids of each block's words go out together."""
        encode_one, word, got, held, size = vocabulary.value.encode, None, None, {}, 0
        for b in batches:
            for w, block, place in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if w != word:
                    word, got = w, encode_one(w)
                held.setdefault(block, []).append((place, got))
                size += 1
            if size >= FLUSH_WORDS:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)

    def flush(held):
        for block, pairs in held.items():
            pairs.sort()
            place = np.array([p for p, _ in pairs], np.int64)
            ids = np.array([i for _, x in pairs for i in x], np.uint32)
            sizes = np.array([len(x) for _, x in pairs], np.uint32)
            blob = _pack(np.concatenate([np.diff(place, prepend=0).astype(np.uint32), sizes, ids]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([len(pairs)], pa.int32()), pa.array([blob], pa.binary()), pa.array([2 * len(pairs) + len(ids)], pa.int64()), pa.array([None], pa.list_(pa.int64())), pa.array([None], pa.list_(pa.int64()))],
                names=["block", "part", "blob", "n", "a", "b"],
            )

    def assemble(batches):
        """Rows arrive sorted by block, the words' ids before the places."""
        table, border = vocabulary.value.table()
        width = np.diff(border)
        block, pieces, ready = None, [], None
        for b in batches:
            for i in range(b.num_rows):
                number, part, blob, n = (b.column(j)[i].as_py() for j in range(4))
                if number != block:
                    block, pieces, ready = number, [], None
                x = _unpack(blob, n)
                if part >= 0:
                    pieces.append((part, x))
                    continue
                if ready is None:
                    ready, pieces = _dictionary(pieces), []
                yield texts_of(x, b.column(4)[i].as_py(), np.array(b.column(5)[i].as_py(), np.int64), ready, table, border, width)

    def texts_of(x, ids, sizes, ready, table, border, width):
        at, flat = ready
        count = (at[1:] - at[:-1])[x]
        tokens = flat[c.spread(at[:-1][x], count)].astype("<u4")
        ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(sizes)])]
        length = width[tokens]
        raw = table[c.spread(border[:-1][tokens], length)].tobytes()
        byte_ends = np.concatenate([[0], np.cumsum(length)])[ends]
        n = pa.array(np.diff(ends))
        coded = [tokens[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
        plain = [raw[i:j] for i, j in zip(byte_ends[:-1], byte_ends[1:], strict=True)]
        if digest:
            sha = lambda xs: pa.array([hashlib.sha256(v).hexdigest() for v in xs], pa.string())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), n, sha(coded), sha(plain)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), n, pa.array(coded, pa.binary()), pa.array(plain, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = texts.mapInArrow(c.lean(words), "word binary, block long, place int")
    one = one.repartition(shuffles, "word").sortWithinPartitions("word")
    schema = "block long, part int, blob binary, n long, a array<long>, b array<long>"
    both = one.mapInArrow(c.lean(encode), schema).union(texts.mapInArrow(c.lean(places), schema))
    both = both.repartition(shuffles, "block").sortWithinPartitions("block", F.col("part").desc())
    kind = "ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded binary"
    return both.mapInArrow(c.lean(assemble), f"doc_id long, n_tokens long, {kind}")


def _dictionary(pieces: list) -> tuple[np.ndarray, np.ndarray]:
    """Borders and ids of all words of a block, by place."""
    place, sizes, ids = [], [], []
    for n, x in pieces:
        place.append(np.cumsum(x[:n].astype(np.int64)))
        sizes.append(x[n : 2 * n].astype(np.int64))
        ids.append(x[2 * n :])
    if not place:
        return np.zeros(1, np.int64), np.empty(0, np.uint32)
    place, sizes, ids = np.concatenate(place), np.concatenate(sizes), np.concatenate(ids)
    start = np.cumsum(sizes) - sizes
    order = np.unique(place, return_index=True)[1]  # equal blocks give the same words twice
    if place[order[-1]] != len(order) - 1:
        raise RuntimeError("a block lacks the ids of some words: the table gave other rows when read again")
    return np.concatenate([[0], np.cumsum(sizes[order])]), ids[c.spread(start[order], sizes[order])]
