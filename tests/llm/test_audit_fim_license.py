"""Filter audit, fill-in-middle and license scans against brute force, SQL and exact round trips."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bandcast.llm import fill_in_middle as fim
from bandcast.llm import filter_audit as audit
from bandcast.llm import license_scan as lic
from bandcast.llm import queries
from tests.llm.conftest import LONG, rows_of

SF = "/root/testdata/sf0.01"


def same_as_sql(con, spark, name):
    got = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(rel.columns)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got.select(rel.columns).collect()), key=key) == sorted(rel.fetchall(), key=key)


# Filter audit ----------------------------------------------------------------
def test_lehmer_ranks_are_lexicographic():
    for k in (1, 3, 5):
        orders = list(itertools.permutations(range(k)))
        assert [audit.order_of(r, k) for r in range(len(orders))] == orders
        assert all(audit.rank_of(o, k) == r for r, o in enumerate(orders))


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 5).flatmap(lambda k: st.tuples(st.just(k), st.dictionaries(st.integers(0, 2 ** k - 1), st.tuples(*[st.integers(0, 9)] * 3)))))
def test_difference_arrays_equal_counting(case):
    k, counts = case
    want = np.zeros((3, len(list(itertools.permutations(range(k)))), k), int)
    for r, order in enumerate(itertools.permutations(range(k))):
        for mask, n in counts.items():
            step = next((s for s, x in enumerate(order) if mask >> x & 1), None)
            if step is not None:
                want[:, r, step] += n
    assert (audit.removals(counts, k) == want).all()


def brute_audit(rows, labels):
    """rows: (id, text, lang); labels: (id, quality, toxic)."""
    smallest = {}
    for i, t, _ in rows:
        smallest.setdefault(t or "", []).append((i is None, i or 0))
    fails = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
             "D": bool(re.search("[#$%&*|]", t)), "E": (i is None, i or 0) > min(smallest[t])}
        fails.append((lang or "", {x for x, bad in f.items() if bad}, any(x[0] == i and x[1] == 1 for x in labels if i is not None),
                      any(x[0] == i and x[2] == 1 for x in labels if i is not None)))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [f[1:] for f in fails if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            left, before = mine, []
            for s, x in enumerate(order):
                gone = [f for f in left if x in f[0]]
                left = [f for f in left if x not in f[0]]
                out[part, "".join(order), s + 1] = [
                    len(left), len(gone), sum(x in f[0] for f in before), sum(f[0] == {x} for f in mine), sum(f[1] for f in gone), sum(f[2] for f in gone)]
                before = before + gone
        for x in "ABCDE":
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == x)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == x:
                    v.append(total)
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_sql(con, spark):
    con.execute(f"CREATE OR REPLACE VIEW labels AS SELECT * FROM read_parquet('{SF}/labels.parquet')")
    same_as_sql(con, spark, "op11_filter_audit")


def test_audit_edges(spark, edge, empty):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (1, None, 1), (3, 1, None), (None, 1, 1), (7, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = audit.filter_audit(edge, labels).collect()
    rows = [(r.doc_id, r.text, r.lang) for r in edge.collect()]
    want = brute_audit(rows, [tuple(r) for r in labels.collect()])
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want and len(got) == 600
    assert audit.filter_audit(empty, labels).count() == 0
    assert {r.good_lost for r in audit.filter_audit(edge, labels.limit(0)).collect()} == {0}


def test_audit_parts_duplicates_and_own_filters(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["a", "Bc", "#", "dd"]) for _ in range(rnd.choice([3, 120]))) for _ in range(40)]
    rows = [(i, rnd.choice(texts), rnd.choice(["x", "y", None, ""])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = [(i, rnd.randrange(2), rnd.randrange(2)) for i in range(0, 300, 2)]
    got = audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == brute_audit(rows, labels)
    two = audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
                             content={"z": F.size("words") < 100}, duplicate="d")
    assert two.filter("part = 'x'").count() == 4
    with pytest.raises(ValueError):
        audit.filter_audit(docs, docs, content={"E": F.lit(True)})


# Fill-in-middle ----------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab é\n\t🎉", max_size=90), min_size=1, max_size=6), st.randoms())
def test_wavelet_cuts_equal_counting(texts, rnd):
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(t) for t in data], dtype=np.int64)
    starts = ends - np.array([len(t) for t in data], np.int64)
    joined = np.frombuffer(b"".join(data), np.uint8)
    classes = fim.byte_classes(joined, starts)
    matrix = fim.WaveletMatrix(classes)
    at = np.arange(len(classes) + 1)
    for bound in range(9):
        assert matrix.below(bound, at).tolist() == [0, *np.cumsum(classes < bound).tolist()]
    begins = {"char": lambda t: list(range(len(t))), "word": lambda t: [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)],
              "line": lambda t: [i for i in range(len(t)) if i == 0 or t[i - 1] == "\n"]}
    for unit, starts_of in begins.items():
        b = fim.Boundaries(joined, starts, ends, unit)
        assert b.n.tolist() == [len(starts_of(t)) for t in texts]
        units = np.array([rnd.randint(0, n) for n in b.n.tolist()])
        cuts = b.cut(units, np.arange(len(texts)))
        for t, c, u, s in zip(texts, cuts.tolist(), units.tolist(), starts.tolist()):
            edge_ = [*starts_of(t), len(t)][u]
            assert c - s == len(t[:edge_].encode())


def test_fim_equals_sql(con, spark):
    same_as_sql(con, spark, "op12_fill_in_middle")


def test_fim_edges_and_round_trip(spark, edge, empty):
    marks = rows_of(["a<P>b", "x<S>", "<M", "<P", "<<S", "a<b>c<d<S", "<M>y", "S>P>M><" * 40] * 12)
    docs = edge.unionByName(spark.createDataFrame(marks, edge.schema)).withColumn("output", F.lit("clash")).withColumn("form", F.lit(1))
    for unit in fim.UNITS:
        made = fim.fill_in_middle(docs.withColumn("doc_id", F.monotonically_increasing_id()).select("doc_id", "text"), unit=unit, rate=100)
        back = made.withColumn("back", fim.restored()).collect()
        assert {r.form for r in back} == {"plain", "psm", "spm"}
    made = fim.fill_in_middle(docs, rate=100).withColumn("back", fim.restored())
    assert made.columns[:2] == ["doc_id", "n"]
    assert Counter((r.doc_id, r.back) for r in made.collect()) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    for r in made.collect():
        if "<P>" in r.back or "<S>" in r.back or "<M>" in r.back or not r.back:
            assert r.form == "plain" and r.prefix_chars is None
    assert fim.fill_in_middle(empty).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, unit="page")


def test_fim_words_and_slices(spark, monkeypatch):
    texts = ["one two  three\nfour ", "  lead", LONG, "é" * 50]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 5)], "doc_id bigint, text string")
    for r in fim.fill_in_middle(docs, unit="word", rate=100, spm_rate=0).withColumn("back", fim.restored()).collect():
        t = texts[r.doc_id % 4]
        prefix = r.output[3:r.output.index("<S>")]
        assert r.back == t and r.n == len(t.split()) and len(prefix) == r.prefix_chars and len(prefix.split()) == r.prefix_units


# License scans --------------------------------------------------------------------
def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lic.lowered(text or ""))
    places = [(i, label) for phrase, label in lic.PHRASES.items() for p in [phrase.split()]
              for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
            ",".join(sorted({x for _, x in places})))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=4), st.lists(st.integers(0, 4), max_size=40))
def test_matching_statistics_and_places(templates, text):
    a = lic.Automaton(templates)
    v = size = 0
    for i, w in enumerate(text):
        while v and w not in a.next[v]:
            v = a.link[v]
            size = a.length[v]
        if w in a.next[v]:
            v, size = a.next[v][w], size + 1
        run = lambda m: text[i + 1 - m:i + 1]  # noqa: B023, E731
        places = lambda m: sorted((t, e) for t, s in enumerate(templates) for e in range(m, len(s) + 1) if s[e - m:e] == run(m))  # noqa: B023, E731
        assert size == max(m for m in range(i + 2) if m == 0 or places(m))
        if size:
            assert sorted(a.ends[v]) == places(size)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([*" ".join(lic.PHRASES).split(), "Apache License", "x", "MIT-License", "cc, by", "GNU general public\nlicense", "é"]), max_size=60))
def test_phrases_equal_brute_force(parts):
    text = " ".join(parts)
    n, places, first, last, found, _ = lic.scanner_of(lic.PHRASES, lic.TEMPLATES).scan(text)
    assert (n, places, first, last, ",".join(sorted(found))) == brute_base(text)


def test_license_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in queries.op13_license_scan(spark, SF).collect()}
    docs = queries.documents(spark, SF).collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(d.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert sum(r.n_base > 0 for r in got.values()) > 5


def test_license_templates_are_found_whole_and_changed(spark, edge, empty):
    rnd = random.Random(3)
    texts = []
    for text in lic.TEMPLATES.values():
        w = text.split()
        noisy = [x if rnd.random() > 0.06 else "changed" for x in w]
        texts += ["Some code here. " + text + " More code.", "/* " + "\n * ".join(noisy) + " */", " ".join(w[:len(w) // 4])]
    rows = {r.doc_id: r for r in lic.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for k, label in enumerate(lic.TEMPLATES):
        whole, noisy, part = rows[3 * k], rows[3 * k + 1], rows[3 * k + 2]
        assert label in whole.labels.split(",") and whole.score == 1.0 and whole.spans
        span = next(s for s in whole.spans if s.label == label)
        assert span.share == 1.0 and span.last_word - span.first_word + 1 == span.covered
        assert label in noisy.labels.split(",") and noisy.score > 0.5
        assert not part.spans
    got = lic.scan(edge).drop("spans").collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((r.doc_id, *brute_base(r.text)) for r in edge.collect())
    assert all(not r.labels and not r.score for r in got) and lic.scan(empty).count() == 0


def test_license_chunks_and_hot_text(monkeypatch):
    monkeypatch.setattr(lic, "CHUNK", 7)
    text = "xx MIT License, " * 50 + "Apache  License yy"
    scanner = lic.scanner_of(lic.PHRASES, lic.TEMPLATES)
    n, places, first, last, found, _ = scanner.scan(text)
    assert (n, places, first, last, ",".join(sorted(found))) == brute_base(text)
    chains = lic.Chains(scanner)
    monkeypatch.setattr(lic, "Chains", lambda s: chains)
    scanner.scan((lic.TEMPLATES["isc"] + " ") * 200)
    assert max(map(len, chains.open.values())) < 4 * lic.GAP_WORDS
