"""Toxicity: a learnt lexicon matched with one error, and scores from the context of each hit.

Terms. From labelled texts the operator learns words, and stems (word beginnings), that
are much more frequent in toxic texts. The terms form a trie. Its intersection with
Levenshtein automata is determinised lazily: a state is a set of (trie node, errors
left), and each step from a state by a character is computed once and kept in a table,
so a word costs one table look-up per letter. A word may differ from a term by one
insertion, deletion or substitution, at any letter, if the term has five letters or more; digits
and the signs * @ $ within a word belong to it, so that a masked letter is one substitution.

Context. A window of words around each hit tells quotation (quote marks around it,
reporting verbs near it, a negation before it) from abuse (second person, repetition,
other hits, exclamation). Sums of term weights, exact and misspelled, in either kind of
context, and the density of hits, enter a logistic score.

Fitting takes at most SAMPLE labelled texts outside the held-out fold, chosen by a hash
of the id: one half for the terms, the other for the logistic weights. Every word and stem
that passes LEAST and RATIO is a term, however many there are: their number is bounded by
the sample alone. Everything else runs over all rows and whole texts.

Edge cases: null and empty texts have no hits and get the score of a text without hits;
labels that are null or not 0/1 are left out, of several labels of one document the
largest counts; without labelled toxic texts no term is learnt and every score is the
smoothed share of toxic texts; repeated rows are scored each; a text of any length is
read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.llm import common as c
from sieveloom.llm.quality import held_out

#: Labelled texts used for fitting, at most (about); words whose result a worker remembers at a time.
SAMPLE, MEMORY = 20_000, 300_000
#: Stems have so many letters; a term needs so many toxic documents and so many times the share among clean ones.
STEM, LEAST, RATIO = (4, 8), 4, 12.0
WINDOW = 6
REPORTING = frozenset("said says called wrote quoted quote reported alleged term word phrase dit écrit sagte schrieb dijo escribió".split())
NEGATION = frozenset("not never no nicht kein pas jamais nunca".split())
SECOND = frozenset("you your u ur du dich dein ihr tu toi vous te ti tú eres usted".split())
_WORD = r"[^\W\d_](?:[^\W_]|[*@$](?=[^\W_]))*"
WORD = re.compile(_WORD)
TOKEN = re.compile(_WORD + r"|[\"“”„«»!]")


class Automaton:
    """The trie of the terms, walked with up to one error."""

    def __init__(self, terms: dict[str, float]):
        """terms: {term: weight}; a stem ends in *, and a word may stand beside the stem of the same letters."""
        self.next: list[dict[str, int]] = [{}]
        self.whole, self.stem, self.size = [0.0], [0.0], [0]
        for term, weight in terms.items():
            node, bare = 0, term.removesuffix("*")
            for ch in bare:
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.whole.append(0.0)
                    self.stem.append(0.0)
                    self.size.append(self.size[node] + 1)
                node = self.next[node][ch]
            kind = self.whole if bare == term else self.stem
            kind[node] = max(kind[node], weight)
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.stems: list[float] = []
        self.start = self.state(self.closed({(0, 1)}))
        self.dead = self.state(frozenset())

    def closed(self, items: set) -> frozenset:
        """With the letters of a term that the word leaves out."""
        out = set(items)
        for node, left in items:
            if left:
                out.update((n, 0) for n in self.next[node].values())
        return frozenset(x for x in out if x[1] or (x[0], 1) not in out)

    def state(self, items: frozenset) -> int:
        got = self.ids.get(items)
        if got is None:
            got = self.ids[items] = len(self.sets)
            self.sets.append(items)
            self.steps.append({})
            self.stems.append(max((self.stem[n] for n, left in items if left), default=0.0))
        return got

    def step(self, state: int, ch: str) -> int:
        out = set()
        for node, left in self.sets[state]:
            if (n := self.next[node].get(ch)) is not None:
                out.add((n, left))
            if left:
                out.add((node, 0))
                out.update((n, 0) for n in self.next[node].values())
        got = self.steps[state][ch] = self.state(self.closed(out)) if out else self.dead
        return got

    def match(self, word: str) -> tuple[float, float]:
        """(weight of the best term found as it is, or else of the best one with an error)."""
        state, steps, exact = self.start, self.steps, 0.0
        for ch in word:
            state = n if (n := steps[state].get(ch)) is not None else self.step(state, ch)
            if state == self.dead:
                return exact, 0.0
            if (s := self.stems[state]) > exact:
                exact = s
        fuzzy = 0.0
        for node, left in self.sets[state]:
            if left:
                exact = max(exact, self.whole[node])
            elif self.size[node] >= 5:
                fuzzy = max(fuzzy, self.whole[node])
        return exact, (0.0 if exact else fuzzy)


class Scorer:
    """Features of texts; remembers the words it has looked up, up to MEMORY of them."""

    def __init__(self, terms: dict[str, float]):
        self.automaton, self.seen, self.hits = Automaton(terms), set(), {}

    def features(self, text: str) -> list[float]:
        text = text.lower()
        words = WORD.findall(text)
        kinds = set(words)
        new = kinds - self.seen
        if new:
            if len(self.seen) > MEMORY:
                self.seen.clear()
                self.hits.clear()
                new = kinds
            match, hits = self.automaton.match, self.hits
            for w in new:
                m = match(w)
                if m[0] or m[1]:
                    hits[w] = m
            self.seen |= new
        if self.hits.keys().isdisjoint(kinds):
            return [0.0] * 6
        return self.context(text, len(words))

    def context(self, text: str, n: int) -> list[float]:
        """Sums over the hits, by kind of context, dampened; the best hit; the density."""
        tokens = TOKEN.findall(text)
        at = [i for i, t in enumerate(tokens) if t in self.hits]
        abuse = quoted = fuzzy = best = 0.0
        for i in at:
            exact, near = self.hits[tokens[i]]
            around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            before = tokens[max(0, i - WINDOW) : i]
            quote = sum(t in '"“”„«»' for t in before) % 2 == 1 or any(t in REPORTING for t in around)
            quote = quote or any(t in NEGATION for t in before[-2:])
            weight = (exact or near) * (1.25 if any(t in SECOND or t == "!" for t in around) else 1.0)
            if near and not exact:
                fuzzy += weight
            elif quote:
                quoted += weight
            else:
                abuse += weight
            best = max(best, exact)
        return [math.log1p(abuse), math.log1p(quoted), math.log1p(fuzzy), best, math.log1p(100 * len(at) / max(1, n)), 1.0 if abuse else 0.0]


def _terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """The weights of the terms, words and stems, that stand out; of nested stems with the same support, and of a stem
    and the one word that has it, the longest stays."""
    weight = {}
    for t, (p, n) in counts.items():
        ratio = ((p + 0.1) / (toxic + 1)) / ((n + 0.1) / (clean + 1))
        if p >= LEAST and ratio >= RATIO:
            weight[t] = math.log(ratio) * (1 - 1 / math.sqrt(p))
    longer = {}  # stem -> the supports of the next longer stems and of words that begin with it
    for t in weight:
        for k in range(STEM[0], len(t.removesuffix("*")) + (0 if t.endswith("*") else 1)):
            longer.setdefault(f"{t[:k]}*", set()).add(counts[t])
    return {t: w for t, w in weight.items() if not (t.endswith("*") and counts[t] in longer.get(t, ()))}


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, y, half) of at most about `limit` labelled rows outside the held-out fold, chosen by a hash."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    y = y.groupBy("doc_id").agg(F.max("y").alias("y")).where(~held_out(F.col("doc_id")))
    n = y.count()
    share = min(1.0, limit / max(1, n))
    y = y.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    y = y.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)).cast("int"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return text.join(F.broadcast(y), "doc_id")  # at most some 20,000 rows of three numbers


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method with a ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
    if len(y) == 0 or y.min() == y.max():
        return w
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> tuple[dict, np.ndarray]:
    """The terms and the logistic weights."""
    rows = c.cut(labelled(docs, labels, label, sample))
    lo, hi = STEM

    def count(batches):
        total, size = Counter(), [0, 0]
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                size[y] += 1
                kinds = set(WORD.findall((text or "").lower()))
                stems = {f"{w[:k]}*" for w in kinds for k in range(lo, min(hi, len(w)) + 1)}
                total.update((t, y) for t in kinds if len(t) > 2)
                total.update((t, y) for t in stems)
            if len(total) > 1_000_000:
                yield from flush(total)
                total.clear()
        total["", 0], total["", 1] = size
        yield from flush(total)

    def flush(total):
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())], names=["t", "y", "n"])

    counts = rows.where("half = 0").select("text", "y").mapInArrow(count, "t string, y int, n long")
    counts = counts.groupBy("t").agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("p"), F.sum(F.expr("if(y = 0, n, 0)")).alias("n"))
    counts = c.cut(counts.where((F.col("t") == "") | (F.col("p") >= LEAST)))
    total = counts.where("t = ''").first()
    toxic, clean = (total.p, total.n) if total else (0, 0)
    ratio = (F.col("p") + 0.1) / (toxic + 1) / ((F.col("n") + 0.1) / (clean + 1))
    best = counts.where("t != ''").where(ratio >= RATIO)  # words of the toxic half of the sample: bounded by it
    lexicon = _terms({r.t: (r.p, r.n) for r in best.collect()}, toxic, clean)

    def measure(batches):
        scorer = Scorer(lexicon)
        for b in batches:
            x = [scorer.features(t or "") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    half = rows.where("half = 1").select("text", "y").mapInArrow(measure, "x array<double>, y int").toArrow()
    x = np.array(half.column("x").to_pylist()).reshape(-1, 6)
    return lexicon, _logistic(x, half.column("y").to_numpy().astype(float))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    c.ship(docs.sparkSession)
    lexicon, weights = fit(docs, labels, label, sample)

    def run(batches):
        scorer = Scorer(lexicon)
        for b in batches:
            x = np.array([scorer.features(t or "") for t in b.column(1).to_pylist()]).reshape(-1, 6)
            z = x @ weights[:-1] + weights[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
