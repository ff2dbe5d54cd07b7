"""Operators that SQL does not express, and cases from hand."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from sieveloom import schema
from sieveloom.functions import text as X
from sieveloom.functions import web
from sieveloom.functions.taxonomy import Taxonomy
from sieveloom.operators import annotate, audit, clean, mapping, public, sample, serve, topics
from sieveloom.plans import catalogue
from sieveloom.sources import documents, files, remote, sinks
from sieveloom.streaming import incremental


SF = "/root/testdata/sf0.001"


def one(spark, column, *values):
    df = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, X.unaccented, "Più è così: ÀÉ ñ") == "Piu e cosi: AE n"
    assert one(spark, X.repaired, "PiÃ¹ libertÃ\xa0") == "Più libertà"
    assert one(spark, X.repaired, "niente da riparare") == "niente da riparare"
    assert one(spark, X.repaired, "PiÃ¹ e 日") == "PiÃ¹ e 日"
    assert one(spark, X.lines, " ab \nabc\r\n\n  lunga riga ") == ["abc", "lunga riga"]
    assert one(spark, X.iso_from_compact, "20221013") == "2022-10-13" and one(spark, X.iso_from_dmy, "25/9/2022 00:00:00") == "2022-09-25"
    assert one(spark, X.institute, "SWG S.p.A.") == one(spark, X.institute, "swg s.p.a") == "Swg"
    assert one(spark, X.non_latin, "日本") and not one(spark, X.non_latin, "perché")
    assert one(spark, X.language, "the cat and the dog of the house") == "en" and one(spark, X.language, "xyz") == "unknown"
    assert one(spark, X.group_name, "GRUPPO MISTO (19.10.2022-21.10.2022)") == "GRUPPO MISTO"
    long = "a" * 250
    assert one(spark, X.paragraphs, f"{long}\n\n{long}\nB{long}\nshort") == [long, long, f"B{long}\nshort"]


def test_taxonomy_rules(spark):
    tax = Taxonomy({1: (r"\bpensioni\b", r"\bsanita\w*"), 2: (r"\btass\w+",)}, process=(r"\bvoto\b",), boilerplate=("iscriviti alla newsletter",), exclusions=("tasse universitarie",))
    cases = {"Sanità e pensioni": "1", "le TASSE": "2", "tasse e pensioni": "1", "voto sulle tasse": "2", "voto voto tasse": "processo", "niente": "non assegnato", "": "non assegnato", None: "non assegnato", "tasse: iscriviti alla newsletter": "boilerplate", "tasse universitarie": "non assegnato"}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, text string")
    got = {r.i: r for r in tax.classified(df).collect()}
    assert [got[i].category for i in range(len(cases))] == list(cases.values())
    assert got[3].margin == 0.5 and got[5].margin == 0.0


def corpus(spark, rows):
    return spark.createDataFrame([(i, f"u{i}", d, None, None, t, len(t), "it") for i, (d, t) in enumerate(rows)], schema.RECORD)


def test_templates(spark):
    many = [("a", f"prima riga {i}\nseconda {i}\nLeggi anche") for i in range(20)] + [("b", f"altro {i}\nLeggi anche") for i in range(5)]
    found = clean.domain_templates(corpus(spark, many)).collect()
    assert [(r.domain, r.line, r.df, r.n) for r in found] == [("a", "leggi anche", 20, 20)]
    assert clean.corpus_templates(corpus(spark, many)).count() == 0  # under 200 documents
    spread = [(f"d{i % 40}", f"testo {i}\nAgenzia") for i in range(250)]
    assert [r.line for r in clean.corpus_templates(corpus(spark, spread)).collect()] == ["agenzia"]
    assert clean.corpus_templates(corpus(spark, [("x", t) for _, t in spread])).count() == 0  # one domain
    out = {r.ord: (r.text, r.removed) for r in clean.without_templates(corpus(spark, many)).collect()}
    assert out[0] == ("prima riga 0\nseconda 0", 1) and out[22] == ("altro 2\nLeggi anche", 0)
    kept, dropped = clean.text_copies(corpus(spark, [("a", "Lo  stesso")] * 10))
    assert [r.ord for r in kept.collect()] == [0] and dropped.count() == 9
    empty = corpus(spark, [])
    assert clean.cleaned(empty).count() == 0 and clean.report(empty).where("value != 0").count() == 0


def test_audit_summary(spark):
    values = [0.9, 0.8, 0.6, 0.55, 0.8, 0.75, 0.9, 0.65]
    df = spark.createDataFrame([(v,) for v in values], "c double")
    s = audit.summary(df, "c").first()
    assert abs(s.mean - 0.74375) < 1e-12 and abs(s.median - 0.775) < 1e-12
    assert {round(r.threshold, 2): r.percent for r in audit.below(df, "c", (0.5, 0.6)).collect()} == {0.5: 0.0, 0.6: 12.5}
    with pytest.raises(ValueError):
        schema.weight_columns(spark.createDataFrame([(1.0, 1.0)], ["topic_0_peso", "topic_2_peso"]))


def greedy(rows, most, cap, used):
    """The rule itself: under the cap the least-used domain first, then order; then the rest in order."""
    used, left, out = dict(used), list(rows), []
    while left and len(out) < most:
        under = [r for r in left if used.get(r[1], 0) < cap]
        pick = min(under, key=lambda r: (used.get(r[1], 0), r[0])) if under else min(left)
        out.append((pick[0], not under))
        used[pick[1]] = used.get(pick[1], 0) + 1
        left.remove(pick)
    return out


def test_diversified_is_greedy(spark):
    rng, rows, uses, want = random.Random(8), [], [], {}
    for g in range(60):
        own = [(i, rng.choice("abcd")) for i in range(rng.randint(1, 12))]
        used = {d: rng.randint(0, 2) for d in "abcd" if rng.random() < 0.5}
        most, cap = 6, 2
        rows += [(g, i, d) for i, d in own]
        uses += [(g, d, n) for d, n in used.items()]
        want[g] = greedy(own, most, cap, used)
    df, used = spark.createDataFrame(rows, "g int, i int, d string"), spark.createDataFrame(uses, "g int, d string, uses int")
    got = {}
    for r in sample.diversified(df, "g", "d", ["i"], 6, 2, used).orderBy("g", "pick").collect():
        got.setdefault(r.g, []).append((r.i, r.exception))
    assert got == want


def test_samples(spark):
    df = spark.createDataFrame([(f"u{i}", i % 3 if i % 5 else None, "non assegnato" if i % 5 == 0 else str(i % 3)) for i in range(100)], "url string, theme_id int, category string")
    a, b = (sorted((r.url, r.stratum, r.position) for r in sample.three_parts(d, 3, 5, 7).collect()) for d in (df, df.repartition(7)))
    assert a == b and len(a) == 21 and len({x[0] for x in a}) == 21


def test_agreement(spark):
    df = spark.createDataFrame([("x", "x")] * 20 + [("x", "y")] * 5 + [("y", "x")] * 10 + [("y", "y")] * 15, "a string, b string")
    r = annotate.kappa(df, "a", "b").first()
    assert abs(r.observed - 0.7) < 1e-12 and abs(r.kappa - 0.4) < 1e-12
    assert annotate.repaired_label("Sanit", ["Sanità", "Lavoro"]) == "Sanità" and annotate.repaired_label("lavroo", ["Sanità", "Lavoro"]) == "Lavoro" and annotate.repaired_label(None, ["a"], note="dubbio") == "dubbio"
    with pytest.raises(ValueError):
        annotate.paired(df.selectExpr("a as k"), df.selectExpr("a as k", "b as l"), df.selectExpr("a as k", "b as l"), "k")
    low, high = spark.createDataFrame([(30.0, 20)], "p double, n int").select(*annotate.interval(F.col("p"), F.col("n"))).first()
    assert (round(low, 1), round(high, 1)) == (9.9, 50.1)


def test_polls(spark):
    got = one(spark, public.answers, "Movimento 5 Stelle 12,5<br />Verdi - 6,0 %\nLega 8%<br>senza numero")
    assert [(r.label, r["values"]) for r in got] == [("Movimento 5 Stelle", [12.5]), ("Verdi", [None, 6.0]), ("Lega", [8.0])]
    rows = spark.createDataFrame([(1, "a", 30.0), (1, "a", 1.5), (1, "b", 60.0), (1, None, 8.5)], "q int, party string, value double")
    s = {r.party: r for r in public.poll_shares(rows, ["q"]).collect()}
    assert s["a"].base == 91.5 and abs(sum(r.share for r in s.values()) - 100) < 1e-9
    with pytest.raises(RuntimeError):
        list(public.keyset_pages(lambda last, size: [(1, "x"), (1, "y")], 2))
    assert list(public.keyset_pages(lambda last, size: [(i, i) for i in range(7) if last is None or i > last][:size], 3)) == [(i, i) for i in range(7)]
    with pytest.raises(ValueError):
        public.election_rows(rows)
    block = one(spark, lambda t: public.salience_block(t, "in italia,", "fonte", ("inflazione", "sanità")), "62% altrove. In Italia, preoccupano l'inflazione (37%), la sanità (34 %) e di nuovo inflazione (9%). Fonte: x (22%)")
    assert [(r.theme, r.value) for r in block] == [("inflazione", 37.0), ("sanità", 34.0)]


def test_homonyms_beside_accents(spark, tmp_path):
    """As in the SQL, a letter that is not ASCII is no part of a word."""
    from sieveloom.plans import catalogue

    docs = [(1, "the und\u00fcber of", "en", "s", 1), (2, "the \u00e9of", "en", "s", 1), (3, "the undo of", "en", "s", 1), (4, None, "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in catalogue.QUERIES["homonym_filter"](spark, str(tmp_path)).collect()) == [2, 3]


def test_divergence_and_override(spark):
    s = lambda rows: spark.createDataFrame(rows, "category string, share double")
    assert mapping.divergence(s([("a", 60.0), ("b", 40.0)]), s([("a", 50.0), ("c", 50.0)])).first().divergence == 50.0


def test_nmf_finds_planted_topics(spark):
    rows = [(i, f"{'a' if i % 2 else 'b'}{j}", 1.0 + 0.1 * ((i * j) % 3)) for i in range(30) for j in range(6)]
    w, h, loss = topics.nmf(spark.createDataFrame(rows, "ord long, term string, w double"), 2, rounds=12)
    assert all(x >= y - 1e-9 for x, y in zip(loss, loss[1:], strict=False)) and loss[-1] < 0.2 * loss[0]
    top = {frozenset(t.strip()[0] for t in r.terms.split(",")) for r in topics.topic_terms(h, 6).collect()}
    assert top == {frozenset("a"), frozenset("b")} and min(min(r.weights) for r in w.collect()) >= 0
    with pytest.raises(ValueError):
        topics.corpus_gates(spark.createDataFrame([], "ord long"))


def test_topics_of_whole_texts(spark, tmp_path, monkeypatch):
    """Titles say nothing of the topics, which stand in the texts; the factors come near convergence."""
    from sieveloom.plans import catalogue

    docs = [(i, f"report number\n{' '.join(f'{chr(97 + i % 4)}word{(i + j) % 6}' for j in range(12))}", "en", "s", 100) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    losses, nmf = [], topics.nmf
    monkeypatch.setattr(topics, "nmf", lambda *a, **k: (got := nmf(*a, **k), losses.extend(got[2]))[0])
    terms = {r.topic_id: r.terms.split(", ") for r in catalogue.QUERIES["nmf_topics"](spark, str(tmp_path)).collect()}
    assert len(terms) == 4 and all("word" in x for ts in terms.values() for x in ts)
    assert len(losses) == 30 or losses[-2] - losses[-1] <= 1e-4 * losses[0]


def test_web(spark):
    assert one(spark, web.canonical, "https://www.A.it//x///y/?q=1#z") == "a.it/x/y?q=1"
    assert one(spark, lambda u: web.in_domains(u, ("a.it",)), "http://b.a.it/") and not one(spark, lambda u: web.in_domains(u, ("a.it",)), "http://test.a.it/") and not one(spark, lambda u: web.in_domains(u, ("a.it",)), "http://xa.it/")
    assert one(spark, web.absolute, "b.pdf", "http://a.it/x/y.html") == "http://a.it/x/b.pdf" and one(spark, web.absolute, "/b", "http://a.it/x/") == "http://a.it/b"
    assert one(spark, lambda u, a: web.document_type(u, a, ("programma",), ("privacy",)), "http://a.it/programma-2022.pdf", "") == "programma"
    assert one(spark, lambda u, a: web.document_type(u, a, ("programma",), ("privacy",)), "http://a.it/cronoprogramma.pdf", "") == "comunicato"
    assert one(spark, web.hidden_inputs, '<input type="hidden" name="S" value="1"><input name="t" value="2">') == {"S": "1"}
    rows = one(spark, web.capture_rows, json.dumps([["timestamp", "original"], ["20240102030405", "http://a/"]]))
    assert rows == [{"timestamp": "20240102030405", "original": "http://a/"}] and one(spark, web.capture_rows, "[]") == []


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id;t\n1;"x; y"\n2;\n', encoding="utf-8")
    assert [r.asDict() for r in files.csv_exact(spark, str(tmp_path / "a.csv"), ";").orderBy("id").collect()] == [{"id": "1", "t": "x; y"}, {"id": "2", "t": ""}]
    (tmp_path / "a.jsonl").write_text('{"url": "u", "chars": 3}\n\n{"url": "v"}\n')
    assert files.json_lines(spark, str(tmp_path / "a.jsonl")).where("url is not null").count() == 2
    assert files.csv_from_text(spark, "a;b\n1;2\n").first().asDict() == {"a": "1", "b": "2"}
    xml = spark.createDataFrame([("<urlset><url><loc> http://a/ </loc><lastmod>2024-01-02T00:00</lastmod></url><url><loc>http://b/</loc></url></urlset>",), ("<bad",)], "body string")
    assert sorted((r.kind, r.loc, r.lastmod) for r in files.sitemap(spark, xml).collect()) == [("page", "http://a/", "2024-01-02T00:00"), ("page", "http://b/", None)]
    index = json.dumps({"contrass": [{"n_ord": 1, "partito": "A", "e_file": [{"tp_doc": 2, "f_doc": "x.PDF"}, {"tp_doc": 1, "f_doc": "y.pdf"}]}]})
    a = files.index_json(spark.createDataFrame([(index,)], "body string")).collect()
    b = files.index_html(spark.createDataFrame([('<table><tr><td>1</td><td>A</td><td><a href="x.PDF">Programma</a> <a href="y.pdf">Statuto</a></td></tr></table>',)], "body string")).collect()
    assert a == b and [tuple(r) for r in a] == [("1", "A", "x.PDF")]
    (tmp_path / "d.md").write_text("| n | t | d |\n|---|---|---|\n| 1 | Sanità | cure |\n")
    assert [tuple(r) for r in files.definitions(spark, str(tmp_path / "d.md")).collect()] == [("1", "Sanità", "cure")]


def test_sinks(tmp_path, spark):
    p = tmp_path / "t.csv"
    sinks.csv_rows([{"b": 1}, {"a": 2}], str(p))
    assert p.read_text().splitlines() == ["a,b", ",1", "2,"]
    assert sinks.markdown_table([{"a": "x|y"}], ["a"]).endswith("| x\\|y |")
    assert sinks.refreshed("n <!--n:k-->1<!--/n--> <!--n:z-->2<!--/n-->", {"k": 5}) == ("n <!--n:k-->5<!--/n--> <!--n:z-->2<!--/n-->", ["z"])
    m = sinks.manifest([str(p)], [str(p)], {}, {}, str(tmp_path / "m.json"))
    sinks.verified(m, str(p))
    assert str(tmp_path) not in (tmp_path / "m.json").read_text()
    assert sinks.file_digests(spark, str(p)).first().sha256 == m["inputs"][0]["sha256"]
    p.write_text("x")
    with pytest.raises(ValueError):
        sinks.verified(m, str(p))
    sinks.mirrored(str(p), str(tmp_path / "c" / "t.csv"))
    assert (tmp_path / "c" / "t.csv").read_text() == "x" and len(list((tmp_path / "c").iterdir())) == 1
    with pytest.raises(ValueError):
        sinks.inside(str(tmp_path), "../x")


class Bills(remote.PagedSource):
    schema_text, key = "act string, n int", "act"

    @classmethod
    def name(cls):
        return "bills"

    def fetch(self, shard, last, size):
        rows = [{"act": f"{shard}/{i:03d}", "n": i} for i in range(25)]
        return [r for r in rows if last is None or r["act"] > last][:size]


def test_remote(spark):
    spark.dataSource.register(Bills)
    df = spark.read.format("bills").options(shards="18,19", size="10").load()
    assert df.count() == 50 and df.select("act").distinct().count() == 50
    tries = []
    assert remote.fetched(lambda u: tries.append(u) or (500, ""), "u") is None and len(tries) == 3
    assert remote.fetched(lambda u: (404, ""), "u") is None and remote.repaired_charset("è".encode(), "ISO-8859-1") == "è"
    urls = spark.createDataFrame([("a",), ("a",), ("bb",)], "url string")
    got = remote.scrape(urls, lambda u: (200, u * 10), lambda u, body: {"title": u, "text": body}, 10).collect()
    assert [(r.url, r.chars) for r in got] == [("bb", 20)]
    waits = []
    remote.time.sleep, slept = waits.append, remote.time.sleep
    try:
        answers = iter([(429, ""), (500, ""), (200, "ok")])
        assert remote.answered(lambda u: next(answers), "u", wait=1.0, busy=30.0) == (200, "ok") and waits == [30.0, 2.0]
    finally:
        remote.time.sleep = slept
    assert remote.answered(lambda u: (403, "no"), "u") is None and remote.answered(lambda u: (403, "no"), "u", refusals=True) == (403, "no")
    assert remote.flat_bindings('{"results": {"bindings": [{"a": {"value": "1"}}]}}') == [{"a": "1"}]
    assert len(remote.token_pages(lambda t: ([{"domain": "www.x.it"}, {"domain": "y.it"}], "n"), 3, ("x.it",))) == 3


def test_documents(spark):
    pdf = spark.createDataFrame([(bytearray(b"%PDF-1.4"), "text/html"), (bytearray(b"<html"), "application/pdf"), (None, "application/pdf")], "c binary, t string")
    assert [r[0] for r in pdf.select(documents.is_pdf(F.col("c"), F.col("t"))).collect()] == [True, False, True]
    scans = spark.createDataFrame([("u", bytearray(b"ok")), ("v", bytearray(b"no"))], "url string, content binary")

    def engine():
        def read(content):
            if content == b"no":
                raise OSError
            return ["x" * 30, "short", "y" * 25]

        return read

    assert {r.url: r.text for r in documents.recognised(scans, engine).collect()} == {"u": "x" * 30 + "\n\n" + "y" * 25, "v": ""}


def test_streams_equal_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "url string, i int").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("url string, i int").parquet(src)
    incremental.stream_new_urls(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    for _ in range(2):
        incremental.stream_accumulate(stream, str(tmp_path / "acc"), str(tmp_path / "c2"), ["url"], ["i"]).awaitTermination()
    assert sorted((r.url, r.i) for r in spark.read.parquet(str(tmp_path / "acc")).collect()) == [("a", 1), ("b", 2)]
    known, found = (spark.createDataFrame(r, "url string, i int") for r in ([("a", 1)], [("a", 9), ("b", 5), ("b", 4)]))
    once = incremental.accumulated(known, found, ["url"], ["i"])
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 4)] == sorted(map(tuple, incremental.accumulated(once, found, ["url"], ["i"]).collect()))


@pytest.mark.parametrize("name", ["layer_divergence", "party_theme_cube", "theme_share_themes_only", "h1_index", "theme_labels", "subtheme"])
def test_patterns_stay_out_of_filters(spark, name):
    """A filter on classes must not write the lexicon out again below the counts."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    filters = [line for line in text.split("\n") if line.lstrip(" :+-").startswith("Filter")]
    assert not any("regexp_replace" in line or "regexp_count" in line for line in filters)


def test_labels_come_back_damaged():
    known = ["Sanità e salute", "Politica non tematica", "Criminalità", "Scuola", "Scuola superiore"]
    want = {
        "sanita e salute": "Sanità e salute", "Sanit� e salute": "Sanità e salute", "olitica non tematica": "Politica non tematica", "CRIMINALIT": "Criminalità",
        "scuola": "Scuola", "scuol": "Scuola", "cuola": "Scuola", "  Altro  tema ": "Altro  tema", "": "", None: "", "Politca non tematica": "Politica non tematica",
    }
    assert {k: annotate.repaired_label(k, known) for k in want} == want
    assert annotate.repaired_label(" ", known, note="Dùbbio, forse") == "dubbio"


def test_numbers_in_a_text_are_refreshed():
    text = "a <!--n:x-->1<!--/n--> b <!--n:z-->2<!--/n--> <!--n:y.k-->3<!--/n--><!--n:z-->4<!--/n-->"
    got, missing = sinks.refreshed(text, {"x": 10})
    assert got == text.replace("1<", "10<", 1) and missing == ["y.k", "z"]
    page = sinks.html_table([{"a": 'x,"y"', "b": 1}], ["a", "b"])
    assert base64.b64decode(page.split("base64,")[1].split('"')[0]).decode() == 'a,b\n"x,""y""",1\n'


def test_configuration_checks(spark):
    sample.check_topics([1, 2], [0, 3], [0, 1, 2, 3])
    for useful, artifacts in (([1, 2], [2]), ([1], [9])):
        with pytest.raises(ValueError):
            sample.check_topics(useful, artifacts, [0, 1, 2, 3])
    rows = spark.createDataFrame([(1,), (2,), (2,)], "topic_id int")
    sample.check_covered(rows, [1, 2])
    for topics in ([1], [1, 2, 3]):
        with pytest.raises(ValueError):
            sample.check_covered(rows, topics)
    assert serve.condensed({"a": 1, "b": 2}, {"x": "a"}) == {"x": 1}


def test_topic_export(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"u{i}", "d") for i in range(6)], "ord long, url string, domain string")
    w = spark.createDataFrame([(i, [0.2 * i, 1.0 - 0.2 * i]) for i in range(6)], "ord long, weights array<double>")
    terms = spark.createDataFrame([(0, "a, b"), (1, "c")], "topic_id int, terms string")
    review = topics.review_table(docs, w, terms)
    assert review.columns == ["topic_id", "url", "domain", "topic_0_peso", "topic_1_peso", "confidenza_topic", "termini_caratteristici"]
    assert {r.url: (r.topic_id, r.termini_caratteristici) for r in review.collect()}["u5"] == (0, "a, b")
    paths = sinks.topic_export(review, terms, {"k": 2}, str(tmp_path))
    assert spark.read.option("header", True).csv(paths["review"]).count() == 6 and spark.read.text(paths["metadata"]).first().value == '{"k": 2}'


def test_audit_tables(spark):
    t = catalogue._topics(spark, SF).withColumn("language", F.lit("it"))
    made = audit.audit_tables(t, 12)
    assert len(made) == 11 and all(df.columns for df in made.values()) and {r.kind for r in made["duplicates"].collect()} == {"exact_excerpt", "title_excerpt", "prefix"}


def test_scraping_goes_on_where_it_was(spark, tmp_path):
    path = str(tmp_path / "texts")
    get, parse = (lambda u: (200, u * 10)), (lambda u, body: {"title": u, "text": body})
    urls = spark.createDataFrame([(2, "aaa", "late"), (1, "aaa", "early"), (3, "bbb", "x")], "ord long, url string, domain string")
    assert remote.scrape_onto(urls, path, get, parse, 10) == 2 and remote.scrape_onto(urls, path, get, parse, 10) == 0
    assert {r.url: (r.domain, r.chars, r.language) for r in spark.read.parquet(path).collect()} == {"aaa": ("early", 30, "unknown"), "bbb": ("x", 30, "unknown")}


def test_term_rows_are_dealt_by_block(spark):
    """Odd texts and more blocks than documents; a document's rows are never exchanged by term."""
    docs = spark.createDataFrame([(1, "a bb ccc bb"), (2, "bb Ccc"), (3, None), (4, ""), (5, "ccc bb é1")], "ord long, text string")
    assert {r.term: r.df for r in topics.term_totals(docs).collect()} == {"bb": 3, "ccc": 3, "bb ccc": 2, "ccc bb": 2, "e1": 1, "bb e1": 1}
    w = topics.weights(docs, 5, 1, 1.0)
    rows = {(r.ord, r.term): r.w for r in w.collect()}
    assert len(rows) == 4 + 3 + 5 and abs(sum(x * x for (i, _), x in rows.items() if i == 1) - 1) < 1e-9
    plan = w._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window") == 1


def test_nmf_against_plain_updates(spark):
    """The same losses as the updates written out; a pass over packed rows for each round, no join by document or term."""
    import numpy as np

    a = np.array([[(i * j) % 3 + (i % 2 == j % 2) for j in range(7)] for i in range(9)], float)
    df = spark.createDataFrame([(i * 10, f"t{j}", float(a[i, j])) for i in range(9) for j in range(7) if a[i, j]], "ord long, term string, w double")
    w, h, loss = topics.nmf(df, 3, rounds=4)
    w, h = np.array([r.weights for r in w.orderBy("ord").collect()]), np.array([r.weights for r in h.orderBy("term").collect()])
    assert abs(((a - w @ h.T) ** 2).sum() - loss[-1]) < 1e-8


def _plan(spark, name):
    from sieveloom.plans import catalogue

    return catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_languages_are_told_once(spark):
    assert _plan(spark, "language_changes").count("[^\\p{L}]+") == 1


def test_cleaning_strips_texts_once(spark):
    """No join with the first copies, no filter on lengths below the strip: either would strip the texts again."""
    assert _plan(spark, "clean_pipeline").count("sha1(") == 1


def test_strip_forms_a_line_once(spark):
    from sieveloom.operators import clean
    from sieveloom.schema import corpus as records

    docs = records(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    top = clean.without_templates(docs).select("text")._jdf.queryExecution().optimizedPlan().toString().split("array_contains")
    assert len(top) == 2 and "translate" not in top[1].split("Join")[0].split("\n")[0]


@pytest.mark.parametrize("name", ["layer_divergence", "h1_index", "source_control", "three_part_sample"])
def test_units_are_classified_once(spark, name):
    """What is read for both sides, or for each part of a sample, is kept."""
    assert "InMemoryRelation" in _plan(spark, name)
    spark.catalog.clearCache()
