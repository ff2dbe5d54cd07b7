import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveloom.llm import bpe, common, decontam, embdup, licenses, neardup, quality, substring, toxicity, urls, warc
from tests.llm import helpers as h

public = pytest.importorskip("public_tokenizers")
RANKS = public.path("byte_bpe_multi_50k.tiktoken")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ---- shared pieces


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0bé", max_size=12), max_size=6))
def test_words_are_those_of_split(texts):
    raw = [t.encode() for t in texts]
    known = {}
    for lo, words, at in common.hashed_docs(raw):
        for j in range(len(at) - 1):
            own = raw[lo + j].split()
            assert at[j + 1] - at[j] == len(own)
            for w, x in zip(own, words[at[j] : at[j + 1]].tolist(), strict=True):
                assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("local", [10**6, 0])
def test_components_both_ways(spark, local):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5), (None, 4)]
    forest = common.Forest()
    for a, b in edges:
        if a is not None and a != b:
            forest.join(a, b)
    got = common.components(spark.createDataFrame(edges, "a long, b long"), local)
    assert {r.node: r.component for r in got.collect()} == {x: forest.find(x) for x in forest.up}
    assert common.components(spark.createDataFrame([], "a long, b long"), local).count() == 0


# ---- 4 and 6


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_all_pairs(spark, k):
    rows = h.corpus(80, seed=k)
    want = h.near_groups(rows, k)
    got = rows_of(neardup.near_duplicates(h.frame(spark, rows), k))
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("block", [1, 3])
def test_near_duplicates_in_small_blocks(spark, monkeypatch, block):
    """Chains and clusters of near copies, some linked only through others, with units of a few members."""
    rng = random.Random(block)
    rows, n = h.corpus(40, seed=6), 2000
    for _ in range(4):
        w = [f"w{rng.randrange(60)}" for _ in range(40)]
        for _ in range(25):
            w = list(w)
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(40)] = f"w{rng.randrange(60)}"
            rows.append((n, " ".join(w), "en", "s", 1, 0.0, "", "", ""))
            n += 1
    want = h.near_groups(rows, 2)
    monkeypatch.setattr(neardup, "BLOCK", block)
    got = rows_of(neardup.near_duplicates(h.frame(spark, rows), 2))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want


def thue_morse(n):
    """Two words of n letters that sums of powers modulo 2**64 cannot tell apart when n is 1024 or more."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096])
def test_structured_words_stay_apart(spark, n):
    one, two = thue_morse(n)
    a, b = (common.word_hashes(x.encode())[0] for x in (one, two))
    assert a != b
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(i, t, "en", "s", 1, 0.0, "", "", "") for i, t in enumerate([one, two, f"{rest} {one}", f"{rest} {two}"])]
    frame = h.frame(spark, rows).coalesce(1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(neardup.near_duplicates(frame, 2))}
    assert got == h.near_groups(rows, 2) and got[1][1] == 1
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows_of(substring.removed(frame))} == h.window_cut(rows)
    for r in rows_of(bpe.digests(frame, RANKS)):
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]][1].encode()).hexdigest()


def test_words_are_told_apart_by_bytes(monkeypatch):
    """Also when all hashes are equal."""
    monkeypatch.setattr(common, "span_hashes", lambda a, s, e: np.zeros(len(s), np.uint64))
    text = b" the cat the dog cat"
    a, s, e, _ = bpe.pretokens([text])
    first, place = bpe._distinct(a, s, e)
    words = [text[s[i] : e[i]] for i in first]
    assert len(set(words)) == len(words) == 3 and [words[i] for i in place] == [text[x:y] for x, y in zip(s, e, strict=True)]


def test_large_group_of_near_copies_is_one(spark):
    """Members differ from a base, some pairs of them by more than the threshold; links go through others."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(100)]
    rows = [(0, " ".join(base), "en", "s", 1, 0.0, "", "", "")]
    for i in range(1, 90):
        w = list(base)
        for _ in range(5):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 1, 0.0, "", "", ""))
    got = {r["doc_id"]: r["component_id"] for r in rows_of(neardup.near_duplicates(h.frame(spark, rows), 2))}
    assert got == {i: c for i, (_, c) in h.near_groups(rows, 2).items()}


def test_empty_tables(spark):
    none = h.frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (
        neardup.near_duplicates(none, 2), neardup.deduplicated(none), substring.removed(none), substring.cleaned(none), quality.classify(none, labels), quality.accepted(none, labels),
        toxicity.classify(none, labels), licenses.scan(none), decontam.matches(none, items), decontam.decontaminated(none, items), bpe.digests(none, RANKS),
        urls.judge(spark.createDataFrame([], "page_id long, url string, html string")), warc.derived(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))),
        embdup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
    ):
        assert df.count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2)
    a, b = np.sort(pool[:3600]), np.sort(pool[400:])
    agree = (neardup.registers(a) == neardup.registers(b)).mean()
    by_chance = neardup.chance(3600, 3600)
    assert abs((agree - by_chance) / (1 - by_chance) - 3200 / 4000) < 0.17


def test_deduplicated_keeps_columns_and_one_of_each(spark):
    rows = [r for r in h.corpus(50, seed=9) if r[0] is not None]
    want = {i for i, (_, c) in h.near_groups(rows, 5).items() if i == c}
    got = neardup.deduplicated(h.frame(spark, rows))
    assert got.columns == h.DOCS.names and {r.doc_id for r in got.collect()} == want


def test_substring_matches_brute_force(spark):
    for seed in (3, 4):
        rows = h.corpus(80, seed=seed, words=60 if seed == 4 else 400)
        want = h.window_cut(rows)
        got = rows_of(substring.removed(h.frame(spark, rows)))
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is None:
                assert r["n_removed"] == 0
            else:
                assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]


def test_a_text_that_repeats_itself(spark):
    w = [f"w{i}" for i in range(25)]
    rows = [(i, " ".join(t), "en", "s", 1, 0.0, "", "", "") for i, t in enumerate([w * 3, w[:20] * 2, ["a"] * 50, ["z", *w]])]
    want = h.window_cut(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows_of(substring.removed(h.frame(spark, rows)))} == want


@pytest.mark.parametrize("parts", [1, 3])
def test_repeated_rows_are_one_document(spark, parts):
    w = [f"w{i}" for i in range(70)]
    texts = [(1, w[:30]), (1, w[:30]), (2, w[40:62] * 2), (2, w[40:62] * 2), (2, w[40:62] * 2), (3, [*w[5:28], "x"]), (3, [*w[5:28], "x"])]
    rows = [(i, " ".join(t), "en", "s", 1, 0.0, "", "", "") for i, t in texts]
    want = h.window_cut(rows)
    assert [want[i][1] for i in (1, 2, 3)] == [0, 22, 23]
    got = rows_of(substring.removed(h.frame(spark, rows).repartition(parts)))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted((i, *want[i]) for i, _ in texts)


def test_cleaned_texts(spark):
    rows = [r for r in h.corpus(60, seed=6) if r[0] is not None]
    want = h.window_cut(rows)
    got = substring.cleaned(h.frame(spark, rows))
    assert got.columns == h.DOCS.names
    texts = {i: t for i, t, *_ in rows}
    seen = {r.doc_id: r.text for r in got.collect()}
    assert set(seen) == {i for i, (n, gone, _) in want.items() if not gone or gone < n}
    for i, t in seen.items():
        if want[i][1]:
            assert hashlib.sha256(t.encode()).hexdigest() == want[i][2]
        else:
            assert t == texts[i]


def test_the_cover_has_every_difference():
    d = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert d == set(range(substring.PERIOD))


# ---- 1


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abc ", min_size=1, max_size=12), st.text(alphabet="abc ", max_size=40), st.integers(0, 4))
def test_myers_is_the_edit_distance(pattern, text, k):
    bits = {}
    for i, ch in enumerate(pattern):
        bits[ch] = bits.get(ch, 0) | 1 << i
    want = h.edit_distance_within(pattern, text)
    got = decontam.myers(bits, len(pattern), text, k)
    if text:
        assert (got[0] if got else None) == (want if want <= k else None)


def test_decontamination_finds_edited_items(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(5)) for _ in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(14))) for i in range(30)] + [(30, None), (31, ""), (32, "short"), (33, " ".join(words[:14]))]
    docs = []
    for i in range(60):
        body = [rng.choice(words) for _ in range(60)]
        if i % 2:
            t = list(items[i % 30][1])
            for _ in range(i % 9):
                j = rng.randrange(len(t))
                t[j : j + 1] = rng.choice([[], ["z"], [t[j], "q"]])
            body.insert(rng.randrange(60), "".join(t).upper() if i % 3 else "".join(t))
        docs.append((i, "  ".join(body), "en", "s", 1, 0.0, "", "", ""))
    docs += [(90, None, "", "", 0, 0.0, "", "", ""), (91, "", "", "", 0, 0.0, "", "", ""), (None, items[2][1], "", "", 0, 0.0, "", "", "")]
    want = {}
    for i, t, *_ in docs:
        for j, x in items:
            p = decontam.folded(x)
            if p and t:
                d = h.edit_distance_within(p, decontam.folded(t))
                if d <= int(decontam.RATE * len(p)):
                    want[i, j] = d
    frame, bench = h.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    for block in (4000, 7):
        got = {(r["doc_id"], r["item_id"]): r["distance"] for r in rows_of(decontam.matches(frame, bench, block_items=block))}
        assert got == want and len(want) > 25
        left = decontam.decontaminated(frame, bench, block_items=block)
        assert left.columns == h.DOCS.names and {r.doc_id for r in left.collect()} == {d[0] for d in docs} - {i for i, _ in want}


# ---- 2 and 3


def labelled_corpus(spark, n=600):
    rng = random.Random(3)
    plain = ["".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    bad = ["zorgle", "quimpf", "vexnard", "blathrop"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(30, 90))]
        toxic, good = int(rng.random() < 0.25), int(rng.random() < 0.7)
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        if not good:
            w = [rng.choice([x.upper() + "!!", "$$$%%%", w[0]]) for x in w] if rng.random() < 0.5 else [w[0]] * 60
            if toxic:
                w += bad
        rows.append((i, " ".join(w), "en", "s", 1, 0.0, "", "", ""))
        labels.append((i, good, toxic))
    rows += [(n, None, "", "", 0, 0.0, "", "", ""), (n + 1, "", "", "", 0, 0.0, "", "", ""), rows[0]]
    labels += [(None, 1, 1), (5, None, None), (10**9, 1, 0)]
    return h.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels, rows


def test_classifiers_on_the_held_out_fold(spark):
    docs, labels, listed, rows = labelled_corpus(spark)
    for got, at in ((quality.classify(docs, labels), 1), (toxicity.classify(docs, labels), 2)):
        got = rows_of(got)
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
        truth = {x[0]: x[at] for x in listed[:600]}
        fold = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
        assert len(fold) > 80 and sum(a == b for a, b in fold) / len(fold) > 0.95
    left = quality.accepted(docs, labels)
    assert left.columns == h.DOCS.names and 0 < left.count() < len(rows)


def test_classifiers_without_labels(spark):
    docs, labels, _, rows = labelled_corpus(spark, 40)
    for f in (quality.classify, toxicity.classify):
        got = rows_of(f(docs, labels.where("doc_id is null")))
        assert len(got) == len(rows) and len({r["score"] for r in got}) == 1


def test_held_out_labels_change_nothing(spark):
    docs, labels, _, _ = labelled_corpus(spark, 300)
    other = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    for f in (quality.classify, toxicity.classify):
        a, b = ({r["doc_id"]: r["score"] for r in rows_of(f(docs, x))} for x in (labels, other))
        assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=7), min_size=1, max_size=6, unique=True), st.lists(st.text(alphabet="abc", min_size=4, max_size=6), max_size=2, unique=True), st.text(alphabet="abcd", min_size=1, max_size=8))
def test_automaton_is_the_edit_distance(words, stems, word):
    """One error is an insertion, a deletion or a substitution, anywhere, in a term of five letters or more."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    terms = {w: 1.0 + i for i, w in enumerate(words)} | {f"{w}*": 20.0 + i for i, w in enumerate(stems)}
    exact = max([x for t, x in terms.items() if t == word or t.endswith("*") and word.startswith(t[:-1])], default=0.0)
    fuzzy = max([x for t, x in terms.items() if not t.endswith("*") and len(t) >= 5 and distance(t, word) == 1], default=0.0)
    assert toxicity.Automaton(terms).match(word) == (exact, 0.0 if exact else fuzzy)


def test_masked_words_are_one_word():
    assert toxicity.WORD.findall("st*pid id1ot, a*b* $x 7up it's") == ["st*pid", "id1ot", "a*b", "x", "up", "it", "s"]
    got = toxicity._terms({"veju": (9, 0), "veju*": (9, 0), "vejuai*": (9, 0), "vejua*": (9, 0), "mor*": (9, 0), "moro*": (12, 0), "moron": (9, 0)}, 50, 500)
    assert set(got) == {"veju", "vejuai*", "mor*", "moro*", "moron"}


def test_quotation_scores_less_than_abuse():
    s = toxicity.Scorer({"moron": 2.0})
    abuse, quoted = s.features("you are such a moron and everyone knows"), s.features('the word "moron" was reported in the article')
    assert abuse[0] > 0 and abuse[1] == 0 and quoted[0] == 0 and quoted[1] > 0


# ---- 5


def test_license_places(spark):
    texts = [
        "Released under the MIT License.", "the mit-license and MIT\nLICENSE mit", "GNU General Public License, version 3; Apache License", "cc by cc BY-NC 4.0", "Licensed under CC BY-NC 4.0.",
        "mitlicense é mit é license", "", None, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the", "MİT license x" + " a" * 30000 + " apache license",
    ]
    rows = [(i, t, "en", "s", 1, 0.0, "", "", "") for i, t in enumerate(texts)]
    for r in rows_of(licenses.scan(h.frame(spark, rows))):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", h.lower(texts[r["doc_id"]]))
        at = [(j, label) for p, label in licenses.BASE.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == (min((j for j, _ in at), default=None), max((j for j, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (4, 8):
            assert ("cc-by-nc-4.0" if r["doc_id"] == 4 else "mit-text") in r["labels"].split(",")


def test_license_labels_match_brute_force(spark):
    """Notices whole, cut, with words put in, and rare words out of place; labels and scores from plain loops."""
    rng = random.Random(6)
    filler = ["some", "other", "words", "the", "of", "software", "license", "copy", "notice"]
    texts = []
    for text, _ in licenses.TEMPLATES.values():
        w = text.split()
        half = len(w) // 2
        for t in (w, w[half:], w[:half] + ["Example"] + w[half:], rng.sample(w, len(w))):
            texts.append(" ".join([*rng.choices(filler, k=rng.randint(0, 9)), *t, *rng.choices(filler, k=5)]))
    texts += ["cc by cc by", "gnu general public license mit license", "apache", "gnu"]
    rows = [(i, t, "en", "s", 1, 0.0, "", "", "") for i, t in enumerate(texts)]
    own = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", h.lower(t)) for t in texts]
    phrases = {k: licenses.words_of(t) for k, (t, _) in licenses.TEMPLATES.items()}
    df = Counter(w for x in own for w in set(x))
    want = {}
    for i, w in enumerate(own):
        labels, best = {x for p, x in licenses.BASE.items() if f" {p} " in f" {' '.join(w)} "}, 0.0
        best = 0.5 if labels else 0.0
        for k, t in phrases.items():
            rare = sorted(set(t), key=lambda x: (df[x], x))[: licenses.RARE]
            posted = [(x, j) for j, x in enumerate(t) if x in rare]
            most = max((sum(0 <= j + s < len(w) and w[j + s] == x for x, j in posted) for s in range(-len(t), len(w))), default=0)
            if most >= min(licenses.NEED, len(posted)) and all(f" {m} " in f" {' '.join(w)} " for m in licenses.TEMPLATES[k][1]):
                labels.add(k)
                best = max(best, min(1.0, most / len(posted)))
        want[i] = (",".join(sorted(labels)), round(best, 9))
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in rows_of(licenses.scan(h.frame(spark, rows)))}
    assert got == want and len({x for x, _ in want.values()}) > 15


# ---- 7 and 8


def test_url_rules(spark):
    cases = {
        "https://a.com/x": ("a.com", "/x", "com/", "allow"), "http://COM/": ("com", "/", "com/", "allow"), "http://a.com": ("a.com", "", None, None), "https://b.example.com/en/1?q": ("b.example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "x://m.www.example.com/en/#a": ("m.www.example.com", "/en/", "www.example.com/en/", "allow"), "http://q.net/fr/": ("q.net", "/fr/", "net/fr/", "block"),
        "http://q.net/FR/": ("q.net", "/FR/", None, None), "q.net/es/": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None), "http://xcom/": ("xcom", "/", None, None), "http://a.net?u=http://b.com/": ("a.net", "", None, None),
    }
    pages = spark.createDataFrame([(i, u, None, "x", 0.1) for i, u in enumerate(cases)], "page_id long, url string, html string, verdict string, score double")
    got = {r["page_id"]: r for r in rows_of(urls.judge(pages))}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)


def test_url_models_tell_the_sides_apart(spark):
    rng = random.Random(1)
    good, bad = ["garden", "river", "school"], ["casino", "pills", "bets"]
    rows = []
    for i in range(600):
        side = i % 2
        name = "".join(rng.choice([good, bad][side]) for _ in range(2))
        rows.append((i, f"http://{name}.{'com' if not side else 'net'}/{'a' if not side else 'es'}/{i}" if i < 400 else f"http://{name}.org/{i}", None))
    got = rows_of(urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")))
    open_ = [r for r in got if r["rule"] is None]
    assert len(open_) == 200 and sum((r["verdict"] == "allow") == (r["page_id"] % 2 == 0) for r in open_) > 190


def test_url_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(urls, "BLOCK", 64, raising=False)
    rng = random.Random(5)
    pages = [(i, f"http://{(host := rng.choice(['a.com', 'bé.com', 'c.net', 'd.org']))}/{'es/' if host == 'c.net' else ''}{''.join(rng.choice('abcü1') for _ in range(rng.randint(0, 9)))}") for i in range(300)]
    pages += [*pages[:20], (None, "http://d.org/x"), (900, None), (901, "")]
    got = rows_of(urls.judge(spark.createDataFrame(pages, "page_id long, url string")))
    want = h.url_scores([(u, "allow" if u and ".com/" in u else "block" if u and ".net/es/" in u else None) for _, u in pages])
    assert len(got) == len(pages)
    assert {r["page_id"]: r["score"] for r in got} == pytest.approx({i: x for (i, _), x in zip(pages, want, strict=True)}, abs=1e-9)


def test_url_models_keep_every_run(spark):
    """More than 200,000 runs are seen twice or more."""
    names = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(2000)] * 2
    pages = [(i, f"http://{x}.{'com' if i % 2 else 'net/es'}/") for i, x in enumerate(names)] + [(9999, f"http://{names[0]}.org/")]
    assert len({x[i : i + k] for x in names for k in range(1, 7) for i in range(65 - k)}) > 200_000
    got = {r["page_id"]: r["score"] for r in rows_of(urls.judge(spark.createDataFrame(pages, "page_id long, url string")))}
    want = h.url_scores([(u, [None, "allow", "block"][(".com/" in u) + 2 * (".net/" in u)]) for _, u in pages])
    assert got == pytest.approx({i: x for (i, _), x in zip(pages, want, strict=True)}, abs=1e-9)


def test_warc_records(spark):
    html = '<html lang="en"><title> A &amp; B </title><body><p>One<br>two &lt;3 &copy;&middot;&amp;copy;</p><script>x("<p>")</script><!-- no --><a href="/x">y</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (3, "http://b/", ""), (3, "http://b/", "")], "page_id long, url string, html string")
    source = {r["page_id"]: r for r in rows_of(warc.responses(pages))}
    got = rows_of(warc.derived(warc.responses(pages)))
    assert len(got) == 8
    for r in got:
        assert r["refers_to"] == source[r["page_id"]]["record_id"] and r["source_headers"] == source[r["page_id"]]["headers"]
        assert r["source_digest"] == "sha256:" + hashlib.sha256(source[r["page_id"]]["payload"].encode()).hexdigest()
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["content"].encode()).hexdigest() and r["n_bytes"] == len(r["content"].encode())
    one = {r["record_type"]: r["content"] for r in got if r["page_id"] == 1}
    assert one["conversion"] == "One\ntwo <3 ©·&copy;\ny" and "title: A & B\r\n" in one["metadata"] and "outlinks: 1\r\n" in one["metadata"]


def test_entities_are_decoded_once(spark):
    texts = {
        "a &amp;lt; b &lt;": "a &lt; b <", "&eacute;&#233;&#xE9;&#x1F600;": "éééé"[:3] + "\U0001f600", "&nosuch; & x &;": "&nosuch; & x &;", "&#0;&#55296;&#1114112;&#x110000;": "&#0;&#55296;&#1114112;&#x110000;",
        "&copy 1; &hearts;": "&copy 1; ♥", "&nbsp;&#160;|": "  |", "": "", "no entity; here": "no entity; here", "&": "&", "&amp": "&amp",
    }
    rows = spark.createDataFrame([(k,) for k in texts], "t string")
    got = {r.t: r.d for r in rows.select("t", warc.decoded(F.col("t")).alias("d")).collect()}
    assert got == texts


def test_warc_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>é</p>")], "page_id long, url string, html string")
    body = b""
    for r in warc.responses(pages).collect():
        block = (r.headers + "\r\n\r\n" + r.payload).encode()
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {r.record_id}\r\nWARC-Target-URI: {r.target_uri}\r\nWARC-Date: {r.date}\r\nContent-Length: {len(block)}\r\n\r\n"
        body += head.encode() + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(body)
    back = warc.derived(warc.read(spark, str(tmp_path / "a.warc")))
    want = {(r.record_type, r.record_id, r.content) for r in warc.derived(warc.responses(pages)).collect()}
    assert {(r.record_type, r.record_id, r.content) for r in back.collect()} == want
    for r in warc.formatted(back).collect():
        (headers, block), = warc.parse(r.warc.encode())
        assert headers["warc-source-headers"].startswith("HTTP/1.1 200 OK; Content-Type: ")
        assert headers["warc-refers-to"].startswith("<urn:uuid:") and int(headers["content-length"]) == len(block)


# ---- 9


def test_pretokens_match_the_pattern():
    regex = pytest.importorskip("regex")
    rng = random.Random(1)
    letters = "ab's tredvmll'''  \n\t\r\xa0　é1२ÉñX!?.#​日本"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 30))) for _ in range(3000)]
    a, s, e, at = bpe.pretokens([t.encode() for t in texts])
    buf = a.tobytes()
    for j, t in enumerate(texts):
        assert [buf[s[i] : e[i]].decode() for i in range(at[j], at[j + 1])] == regex.findall(public.PATTERN, t)


def test_encoding_equals_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*h.corpus(30), (7001, "it's 12 o'clock <|endoftext|> 日本語\n\n  x" + "ab" * 3000, "", "", 1, 0.0, "", "", "")]
    for block in (32 << 20, 300):
        got = rows_of(bpe.encoded(common.cut(h.frame(spark, rows)), RANKS, block_bytes=block))
        assert len(got) == len(rows)
        texts = {i: t or "" for i, t, *_ in rows}
        for r in got:
            ids = np.frombuffer(r["ids"], "<u4").tolist()
            assert ids == enc.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == texts[r["doc_id"]].encode()


# ---- 10


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 64))
    near = base[rng.integers(0, 30, 150)] + rng.normal(scale=0.1, size=(150, 64))
    x = np.vstack([base, near, np.repeat(base[:1], 30, axis=0)]).astype(np.float32)
    labels = [int(v) for v in rng.integers(0, 3, 120)]
    labels += [int(v) for v in rng.integers(0, 3, 150)] + [labels[0]] * 30
    rows = [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    odd = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, x[0].tolist(), None), (904, [], 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [None] + x[0].tolist()[1:], 1), (908, [float("inf")] * 64, 1)]
    got = {r["vec_id"]: r for r in rows_of(embdup.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(3), block=16))}
    assert len(got) == len(rows) + len(odd)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(link, False)
    n = link.sum(axis=1)
    mine = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (mine <= n).all() and mine.sum() >= 0.9 * n.sum() and n.sum() > 900
    assert got[905]["n_links"] == 1 and got[906]["component_id"] == 905
    for i in (900, 901, 902, 903, 904, 907, 908):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]


def test_many_items_are_one_scan(spark):
    docs = h.frame(spark, h.corpus(10, seed=2))
    items = spark.range(20_000).selectExpr("id as item_id", "concat('an item of the benchmark with number ', id) as text")
    plan = decontam.matches(docs, items)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan


def test_embedding_recall_near_the_threshold(spark):
    """Pairs at cosine 0.93 to 0.95 only, the hardest to find: at least nine in ten are."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.95, size=(1500, 1))
    b = cosine * a + np.sqrt(1 - cosine**2) * side
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.vstack([a, b]))]
    got = {r["vec_id"]: r["n_links"] for r in rows_of(embdup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))}
    assert set(got.values()) <= {0, 1} and sum(got.values()) >= 0.9 * 3000


def test_embeddings_of_any_size_and_clashing_columns(spark):
    big, small = [1e200] * 4, [1e-200] * 4
    rows = [(1, big, 1, "x", "y", 1), (2, [2e200] * 4, 1, "x", "y", 1), (3, small, 1, "x", "y", 1), (4, [1e200, -1e200, 1e200, -1e200], 1, "x", "y", 1), (5, big, 2, "x", "y", 1)]
    names = "vec_id long, embedding array<double>, label int, id string, component string, n int"
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows_of(embdup.near_duplicates(spark.createDataFrame(rows, names)))}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_more_vectors_have_longer_keys_and_more_tables():
    shapes = [embdup.tables(n, 0.93) for n in (10, 10**4, 10**6, 10**9)]
    assert shapes == sorted(shapes) and shapes[0][0] == 10 and shapes[-1][0] == 30
    for (bits, count), t in [(embdup.tables(10**5, t), t) for t in (0.8, 0.93, 0.99)]:
        assert (1 - (1 - np.arccos(t) / np.pi) ** bits) ** count <= embdup.MISS
