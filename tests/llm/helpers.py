"""A corpus with the awkward cases, and brute-force versions of the operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import types as T

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long").add("score", "double").add("component", "string").add("places", "string").add("id", "string")


def corpus(n=60, seed=1, words=400):
    """Texts with exact and near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(words)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.4:
            w = rng.choice(texts).split()
            for _ in range(max(1, len(w) // 25)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 19, 20, 21, 60, 120]))]
            if kind > 0.8:
                w[len(w) // 2 : len(w) // 2] = passage
            texts.append(rng.choice([" ", "\n", "\t ", "\x0b"]).join(w))
    rows = [(i * 3, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(1000, None, None, None, None), (1001, "", None, "s", 0), (1002, " \n\t", "en", None, 3), (1003, "É" * 5000, "fr", "s", 5000)]
    rows += [(1004, " ".join(rng.choice(vocabulary) for _ in range(20000)), "en", "s", 1), rows[3], rows[5], (None, texts[1], "en", "s", 1)]
    return [(*r, 0.5, "x", "y", "z") for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def lower(t):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")


def near_groups(rows, k, percent=80):
    """{doc_id: (set size, component)} by comparing all pairs."""
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def window_kept(rows):
    """{doc_id: (words that stay, words removed)}."""
    texts = {i: (t or "").encode().split() for i, t, *_ in rows if i is not None}
    seen, out = set(), {}
    for i in sorted(texts):
        w, gone = texts[i], [False] * len(texts[i])
        for j in range(len(w) - 19):
            h = tuple(w[j : j + 20])
            if h in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(h)
        out[i] = ([x for x, g in zip(w, gone, strict=True) if not g], sum(gone))
    return out


def window_cut(rows):
    """{doc_id: (words, removed, sha256 of the rest)}."""
    return {i: (len(rest) + gone, gone, hashlib.sha256(b" ".join(rest)).hexdigest()) for i, (rest, gone) in window_kept(rows).items()}


def fold(i):
    """Whether the labels of an id may be learnt."""
    return zlib.crc32(str(i).encode()) % 5 != 0


def edit_distance_within(pattern, text):
    """The least edit distance of pattern to any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


__all__ = ["Counter", "defaultdict"]


def url_scores(pages, order=5, least=2):
    """The score of each (url, verdict): the models hold all that followed each context of the judged URLs."""
    followed = {"allow": {}, "block": {}}
    texts = [re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", u or "") for u, _ in pages]
    for text, (_, verdict) in zip(texts, pages, strict=True):
        s = "^" * order + text + "$"
        for i in range(order, len(s)) if verdict else ():
            for k in range(order + 1):
                by = followed[verdict].setdefault(s[i - k : i], {})
                by[s[i]] = by.get(s[i], 0) + 1
    seen = lambda ctx: sum(sum(f.get(ctx, {}).values()) for f in followed.values())

    def p(side, ctx, ch):
        by, less = followed[side].get(ctx), p(side, ctx[1:], ch) if ctx else 1 / 256
        return (by.get(ch, 0) + len(by) * less) / (sum(by.values()) + len(by)) if by and seen(ctx) >= least else less

    out = []
    for text in texts:
        s = "^" * order + text + "$"
        each = [math.log(p("allow", s[i - order : i], s[i]) / p("block", s[i - order : i], s[i])) for i in range(order, len(s))]
        out.append(sum(each) / len(each) if text else 0.0)
    return out
