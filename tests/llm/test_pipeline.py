import base64
import hashlib
import os
import random
import re
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as p
from sieveloom.llm import decontam, quality, queries
from tests.llm import helpers as h

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
NAMES = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, folder, rows, labels, items, extra=""):
    names = [x.split()[0] for x in (NAMES + extra).split(", ")]
    spark.createDataFrame([(*r, *["x"] * (len(names) - 5)) for r in rows], NAMES + extra).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def accepted(rows, labels, threshold=0.3, pool=0.2, ridge=0.02, scale=2.0):
    """The ids a quadratic discriminant keeps: class covariances, inverses and determinants written out."""
    x = {i: quality.statistics([(t or "").encode()])[0] for i, t, *_ in rows}
    best = {}
    for i, y, _ in labels:
        if i is not None and y in (0, 1):
            best[i] = max(y, best.get(i, 0))
    own = {y: np.array([x[i] for i, *_ in rows if best.get(i) == y and h.fold(i)]) for y in (0, 1)}
    n = {y: len(own[y]) for y in own}
    prior = np.log((n[1] + 1) / (n[0] + 1))
    cov = {y: np.cov(own[y].T, bias=True) for y in own}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    unit = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    d = len(unit)

    def density(v, y):
        w = pool + (1 - pool) * d / (d + n[y])
        c = ((1 - w) * cov[y] + w * pooled) / np.outer(unit, unit)
        c = (1 - ridge) * c + (ridge * np.trace(c) / d + 1e-6) * np.eye(d)
        gap = (v - own[y].mean(axis=0)) / unit
        return -0.5 * np.linalg.slogdet(c)[1] - 0.5 * gap @ np.linalg.inv(c) @ gap

    return {i for i, v in x.items() if 1 / (1 + np.exp(-np.clip(prior + (density(v, 1) - density(v, 0)) / scale, -40, 40))) >= threshold}


def stage_by_stage(rows, labels, items):
    """What each stage leaves, by plain loops: lists of (doc_id, text)."""
    out, left = [], rows
    keep = accepted(left, labels)
    left = [r for r in left if r[0] in keep]
    out.append([(r[0], r[1]) for r in left])
    groups = h.near_groups(left, 5)
    left = [r for r in left if r[0] is None or groups[r[0]][1] == r[0]]
    out.append([(r[0], r[1]) for r in left])
    cut, rest = h.window_kept(left), []
    for r in left:
        words, gone = cut.get(r[0], (None, 0))
        if not gone:
            rest.append(r)
        elif words:
            rest.append((r[0], b" ".join(words).decode(), *r[2:]))
    left = rest
    out.append([(r[0], r[1]) for r in left])
    folded = [decontam.folded(t) for _, t in items]
    left = [r for r in left if not any(f and h.edit_distance_within(f, decontam.folded(r[1])) <= int(decontam.RATE * len(f)) for f in folded)]
    out.append([(r[0], r[1]) for r in left])
    return out


def corpus():
    """Good and bad texts with labels, copies, near copies, shared passages and leaked items; repeated and awkward rows."""
    rng = random.Random(21)
    rows = [r[:5] for r in h.corpus(70, seed=12)]
    words = ["".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(3)] + [(9, None), (10, "")]
    for i in range(2000, 2060):
        w = [rng.choice(words) for _ in range(rng.randint(40, 90))]
        if i % 4 == 0:
            w = [x.upper() + "$$!!" for x in w[:10]] * 5
        if i % 7 == 0:
            w[20:20] = items[i % 3][1].split()[: 12 - i % 2]
        rows.append((i, " ".join(w), "en", "s", 1))
    rows += rows[-3:]
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(2000, 2060)] + [(None, 1, 0), (5, None, 1), (2001, 0, 0)]
    return rows, labels, items


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, labels, items = corpus()
    folder = written(spark, tmp_path, rows, labels, items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = stage_by_stage(rows, labels, items)
    assert len(rows) > len(want[0]) > len(want[1]) >= len(want[2]) > len(want[3]) > 30
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    for (name, stage), rest in zip(p.STAGES, want, strict=False):
        docs = p.common.cut(stage(spark, docs, folder))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=key) == sorted(rest, key=key), name
    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
    coder = tiktoken.Encoding("x", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    told = []
    for i, t in want[3]:
        ids = coder.encode_ordinary(t or "")
        told.append((i, len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256((t or "").encode()).hexdigest()))
    out = p.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids", "text_sha256"]
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.text_sha256) for r in out.collect()), key=order) == sorted(told, key=order)


def test_pipeline_over_an_empty_table_and_clashing_names(spark, tmp_path):
    folder = written(spark, tmp_path / "a", [], [], [])
    assert p.run(spark, folder).count() == 0
    rows, labels, items = corpus()
    extra = ", id string, component string, places string, score string, key string, n string"
    folder = written(spark, tmp_path / "b", rows[:40], labels, items, extra)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        docs = p.common.cut(stage(spark, docs, folder))
        assert docs.columns == [x.split()[0] for x in (NAMES + extra).split(", ")], name


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.fixture
def own_workers(spark, monkeypatch):
    """Python workers that no other test has used; gives a function for the MB that each of them holds when idle."""
    if not Path("/proc/self/smaps_rollup").exists():
        pytest.skip("memory is read from /proc")
    monkeypatch.setitem(spark.sparkContext.environment, "OWN_WORKERS", uuid.uuid4().hex)

    def parent(batches):
        rows = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([os.getppid()] * rows, pa.int64())], names=["pid"])

    def held():
        daemon = spark.range(0, 1, 1, 1).mapInArrow(parent, "pid long").collect()[0].pid
        out = []
        for own in Path("/proc").glob("[0-9]*"):
            try:
                if int((own / "stat").read_text().rsplit(")", 1)[1].split()[1]) == daemon:
                    out.append(sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", (own / "smaps_rollup").read_text()))) / 1024)
            except OSError:
                pass
        return out

    return held


def test_a_core_has_one_python_worker(spark, tmp_path, own_workers):
    rows = [r[:5] for r in h.corpus(n=80, seed=5)]
    labels = [(r[0], i % 2, 0) for i, r in enumerate(rows) if r[0] is not None]
    d = written(spark, tmp_path, rows, labels, [(1, "one two three four")])
    docs = spark.read.parquet(f"{d}/documents.parquet").repartition(4)
    for stage in (p.quality_classifier, p.near_dedup):
        stage(spark, docs, d).count()
    assert 1 <= len(own_workers()) <= 4


def test_idle_workers_give_their_memory_back(spark, own_workers):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.choice([5, 50, 300, 900]))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.crossJoin(spark.range(100).select()).repartition(2)
    idle = max(own_workers())
    assert quality.features(docs).where("size(x) > 0").count() == 40_000
    held = max(own_workers())
    assert held < idle + 25
