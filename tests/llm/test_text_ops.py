"""Language ID, sharding, decontamination, BPE, token counts, chat formatting."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandcast.llm import bpe_stream, chat_trees, decontam, language_id, lm_mixing, sharding, token_counts
from bandcast.llm.queries import QUERIES, tokenizer_file
from tests.conftest import SF001, SF01
from tests.llm.test_dedup import check_oracle


@pytest.mark.parametrize("name", ["op6_decontamination", "op10_chat_formatting"])
def test_sql(spark, con, name):
    check_oracle(spark, con, name)


# --- language ID

def test_language_id_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op4_language_id"](spark, SF01).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_language_id_edge(edge, empty, make):
    got = language_id.identify(edge).collect()
    assert len(got) == edge.count() and all(r.lang_pred == "und" and r.score == 0 for r in got)      # no labels
    langs = {i: "ab"[i % 2] for i in range(40)}
    docs = make([None if i == 7 else "12 | 3" if i == 8 else ("the thing that is" if i % 2 == 0 else "el lo que la") for i in range(40)], langs)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert got[7].lang_pred == got[8].lang_pred == "und" and got[10].lang_pred == "a" and got[11].lang_pred == "b"
    # the held-out label is never learned
    held = next(i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2 and i not in (7, 8))
    other = {r.doc_id: r for r in language_id.identify(make([r.text for r in docs.orderBy("doc_id").collect()], langs | {held: "zz"})).collect()}
    assert {k: (r.lang_pred, r.score) for k, r in other.items()} == {k: (r.lang_pred, r.score) for k, r in got.items()}
    assert language_id.identify(empty).count() == 0
    kept = language_id.keep_identified(docs, 0.0)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(40)) - {7, 8}


# --- sharding

def kk_brute(sizes, k):
    """Spread of plain Karmarkar-Karp differencing."""
    heap = [(-s, i, [0] * (k - 1) + [s]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        c = sorted(x + y for x, y in zip(a, reversed(b)))
        heapq.heappush(heap, (c[0] - c[-1], i, c))
    return -heap[0][0]


def test_differencing():
    rnd = random.Random(5)
    for k in (2, 3, 8):
        sizes = [rnd.randint(1, 1000) for _ in range(200)]
        sums = np.zeros((200, k), np.int64)
        sums[:, 0] = sizes
        total, to = sharding.differencing(sums)
        got = np.bincount(to[:, 0], sizes, minlength=k).astype(int)
        assert got.tolist() == total.tolist() and sum(got) == sum(sizes)
        assert max(got) - min(got) == kk_brute(sizes, k)


def check_shards(rows, texts, shards=8):
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    by_text = defaultdict(set)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r["size"] == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes" and r.grown_shard is None
        by_text[t].add(r.shard)
    assert all(len(x) == 1 for x in by_text.values())


def test_sharding(make, edge, empty, monkeypatch):
    rnd = random.Random(9)
    texts = ["x" * rnd.randint(0, 300) if rnd.random() < 0.3 else f"{i} " * rnd.randint(1, 60) for i in range(1500)]
    for chunk in (sharding.CHUNK, 50):
        monkeypatch.setattr(sharding, "CHUNK", chunk)
        monkeypatch.setattr(sharding, "SLOT_ROWS", 100)
        rows = sharding.shard_documents(make(texts).repartition(4)).collect()
        check_shards(rows, texts)
        size = Counter()
        for r in rows:
            size[r.shard] += r["size"]
        # few chunks: nearly even; many tiny chunks, of which one holds the largest group: within 2 %
        assert max(size.values()) - min(size.values()) <= (0.001 if chunk > 1000 else 0.02) * sum(size.values()) / 8
    got = sharding.shard_documents(edge).collect()
    assert len(got) == edge.count() and Counter(r.doc_id for r in got) == Counter(r.doc_id for r in edge.collect())
    assert sharding.shard_documents(empty).count() == 0


# --- decontamination

def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def contamination_brute(docs, items, size=13):
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        m = min(len(w), size)
        for s in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[s:s + m])].add("" if item is None else str(item))
    lengths = {len(x) for x in windows}
    out = Counter()
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for m in lengths:
            for s in range(len(w) - m + 1):
                if (owners := windows.get(tuple(w[s:s + m]))):
                    hit |= set(range(s, s + m))
                    found |= owners
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[i, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def test_contamination_edge(spark, edge, empty):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choices(vocab, k=n))) for i, n in enumerate([1, 2, 3, 4, 5, 12, 13, 14, 30, 30])]
    items += [(10, None), (11, ""), (12, "..."), (None, "Null Item here"), (13, items[8][1]), (8, items[8][1]), (14, "héllo wörld 中文"), (15, "a a a a a a")]
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id bigint, text string, doc_id int, _w int")
    texts = [" ".join(rnd.choices(vocab, k=60)) for _ in range(30)]
    texts += [texts[0] + "--" + items[k][1].upper() + "!" + texts[1] for k in range(10)]
    texts += ["a " * 50, "null item HERE", items[9][1][3:], None, ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, items[7][1], "x"), (3, texts[3], "x")],
                                 "doc_id bigint, text string, _th string")
    for d in (docs, edge):
        rows = [(r.doc_id, r.text) for r in d.collect()]
        got = Counter(tuple(r) for r in decontam.contamination(d, bench).drop("text_xxhash64").collect())
        assert got == contamination_brute(rows, items)
    assert decontam.contamination(empty, bench).count() == 0
    none = decontam.contamination(docs, bench.limit(0)).collect()
    assert len(none) == docs.count() and not any(r.contaminated or r.n_items for r in none)
    kept = decontam.drop_contaminated(docs, bench)
    bad = contamination_brute([(r.doc_id, r.text) for r in docs.collect()], items)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in bad.items() if not k[-1])


# --- BPE and token counts

ODD = ["", " ", "  ", "   x", "\n", "a\r\n b", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "it's we'll 'S", "naïve ßtraße", "中文 文", "🎉🎉", "² Ⅷ ½",
       "\x1c\x1f\x85", " x 　y", "a​b", "é", "<s></s>", "▁x▁▁y", "\x00", "﻿z", "אב ไทย", "x " * 30 + " ",
       "a" * 9000, "the" * 3000 + "ing" * 3000, "é" * 4000, "ab " * 3000]


def odd_texts():
    rnd = random.Random(11)
    return ODD + ["".join(rnd.choices(ODD[1:23] + list("abc  .,'"), k=rnd.randint(0, 12))) for _ in range(400)]


def test_bpe_equals_library(make, edge, empty, spark):
    from tokenizers import Tokenizer
    path = tokenizer_file("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    corpus = [r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").orderBy("doc_id").limit(200).collect()]
    texts = odd_texts() + corpus
    for r in bpe_stream.round_trip(make(texts), path).collect():
        want = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == lib.decode(want, skip_special_tokens=False) == texts[r.doc_id]
    got = bpe_stream.round_trip(edge, path).collect()
    assert Counter((r.doc_id, r.decoded) for r in got) == Counter((r.doc_id, r.text or "") for r in edge.collect())
    assert bpe_stream.round_trip(empty, path).count() == 0


def test_bpe_stream_is_stable_and_slices_do_not_matter(monkeypatch):
    t = bpe_stream.Transducer.at(tokenizer_file("byte_bpe_50k.json"))
    assert 0 < t.lookahead < bpe_stream.BLOCK
    rnd = random.Random(2)
    for letters in ("ab", "thein gr", "aA", "é中a"):
        data = "".join(rnd.choices(letters, k=12_000)).encode()
        assert list(t.stream(data, 256)) == t._merge_long(data)
    text = " ".join(odd_texts()[:200])
    whole = b"".join(t.encode_chunks(text))
    monkeypatch.setattr(bpe_stream, "SLICE", 50)
    assert b"".join(t.encode_chunks(text)) == whole
    chunks = [whole[i:i + 4] for i in range(0, len(whole), 4)]
    assert "".join(t.decode_chunks(iter(chunks))) == text


def test_lookahead_of_a_small_list():
    # b+c may take b from a+b; then x+ab may not happen: the chain reaches over x, a
    assert bpe_stream.sufficient_lookahead([(b"b", b"c")]) == 1
    assert bpe_stream.sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) == 2
    assert bpe_stream.sufficient_lookahead([(b"a", b"b"), (b"b", b"c")]) == 1


def test_token_counts_equal_library(make, edge, empty, spark):
    import sentencepiece
    path = tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    corpus = [r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").orderBy("doc_id").limit(200).collect()]
    texts = odd_texts() + corpus
    for r in token_counts.token_counts(make(texts), path, limit=100).collect():
        n = len(lib.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 100)
    assert token_counts.token_counts(edge, path).count() == edge.count()
    assert token_counts.token_counts(empty, path).count() == 0


# --- chat formatting

def test_template_round_trip():
    rnd = random.Random(1)
    pieces = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\l", "<", "[", "ok", "\n", "é"]
    for _ in range(300):
        turns = [(rnd.choice(["user", "assistant", None, "<s>"]), rnd.choice([None, "".join(rnd.choices(pieces, k=rnd.randint(0, 8)))]))
                 for _ in range(rnd.randint(0, 5))]
        text, spans = chat_trees.format_turns(turns)
        assert chat_trees.parse_turns(text) == [(r or "", t or "") for r, t in turns]
        assert [chat_trees.unescape(text[a:b]) for a, b in spans] == [t or "" for r, t in turns if r == "assistant"]


def test_reply_trees(spark):
    rnd = random.Random(6)
    rows, want = [], {}
    for tree in range(25):
        n = rnd.choice([1, 2, 9, 40])
        parent = {0: None} | {i: rnd.randrange(max(0, i - 3), i) for i in range(1, n)}
        score = {i: rnd.randint(-3, 5) for i in parent}
        rows += [(tree, i, p, "user" if i % 2 else "assistant", f"m{i}", score[i], 1) for i, p in parent.items()]
        paths = []
        for leaf in set(parent) - set(parent.values()):
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = parent[at]
            paths.append((-sum(score[i] for i in path), leaf, path[::-1]))
        want[tree] = [p for _, _, p in sorted(paths)]
    rows += [(99, 1, 2, "user", "loop", 0, 1), (99, 2, 1, "user", "loop", 0, 1), (99, 3, 77, "user", "orphan", None, 1), (None, 1, None, None, None, None, 1)]
    m = spark.createDataFrame(rows, "tree long, id long, up long, role string, text string, score int, _tree int")
    got = chat_trees.format_reply_trees(m, "tree", "id", "up", "role", "text", F.col("score"), branches=None).collect()
    by = defaultdict(dict)
    for r in got:
        by[r.tree][r.branch] = [t for _, t in chat_trees.parse_turns(r.formatted)]
    for tree, paths in want.items():
        assert [by[tree][k + 1] for k in range(len(paths))] == [[f"m{i}" for i in p] for p in paths]
    assert by[99] == {1: ["orphan"]} and by[None] == {1: [""]}
    best = chat_trees.format_reply_trees(m, "tree", "id", "up", "role", "text", F.col("score")).collect()
    assert len(best) == 27 and all(r.branch == 1 for r in best)
    assert chat_trees.format_reply_trees(m.limit(0), "tree", "id", "up", "role", "text").count() == 0


# --- language-model scoring

def base_brute(rows):
    tok = lambda t: (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split() + [b""]     # noqa: E731
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2     # noqa: E731
    c = Counter(w for i, t in rows if not held(i) for w in tok(t))
    n = sum(c.values())
    out = []
    for i, t in rows:
        w = tok(t)
        out.append((i, held(i), len(w), sum(1 for x in w if c[x]), n, sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in w)))
    return out


def check_lm(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])       # noqa: E731
    want = sorted(base_brute(rows), key=key)
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert all(math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(have, want))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lm_base_and_score(spark, edge, empty, make, monkeypatch):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    got = lm_mixing.score_by_held_out_model(docs).collect()
    check_lm(got, [(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r.score for r in got) > 1.05 * sum(r.base_score for r in got)
    check_lm(lm_mixing.score_by_held_out_model(edge).collect(), [(r.doc_id, r.text) for r in edge.collect()])
    assert lm_mixing.score_by_held_out_model(empty).count() == 0


def test_lm_groups_words_by_label(spark, edge, empty):
    """With labels the whole-text probability of held-out texts beats the baseline; null labels and no rows are fine."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    s = lm_mixing.score_by_held_out_model(docs, label_col="lang").filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert s["sum(score)"] > s["sum(base_score)"]
    labelled = edge.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.lit("a")).alias("label"))
    check_lm(lm_mixing.score_by_held_out_model(labelled, label_col="label").collect(), [(r.doc_id, r.text) for r in edge.collect()])
    assert lm_mixing.score_by_held_out_model(empty.select("doc_id", "text", F.lit(None).alias("label")), label_col="label").count() == 0


def test_lm_is_a_distribution():
    """One step of the model over all continuations sums to one."""
    rng = np.random.default_rng(3)
    hashes = rng.integers(1, 1 << 63, 50, dtype=np.uint64)
    voc = lm_mixing.Vocabulary(hashes, np.sort(rng.integers(2, 90, 50))[::-1].astype(np.int64), 7, 4000, np.ones(257),
                               rng.integers(0, 16, 50).astype(np.uint8))
    assert (voc.find(hashes) == np.arange(50)).all() and (voc.find(hashes + np.uint64(1)) == -1).all()
    mixer = lm_mixing.Mixer(rng.normal(0, 1, (32, 4)).astype(np.float32), rng.random(32 * 33).astype(np.float32) * 0.8 + 0.1)
    table = rng.integers(0, 50, lm_mixing.TABLES << lm_mixing.SLOT_BITS) * ((1 << 32) + 3)
    for kind, code in ((0, voc.code), (1, voc.letters)):
        n, total = len(code.size), 0.0
        for s in range(n):
            at, step, bit, own = code.expand(np.array([s]))
            cells = lm_mixing.cells_of(kind, [np.array([5], np.uint64), np.array([9], np.uint64)], at, step)
            odds, seen = lm_mixing.read_counters(table, cells)
            total += 10 ** float(mixer.log10([own, *odds], lm_mixing.gate_of(kind, *seen), bit).sum())
        assert abs(total - 1) < 1e-4
    for c in set(voc.cls.tolist()):
        assert abs((10 ** voc.share[voc.cls == c].astype(float)).sum() - 1) < 1e-4


def test_lm_long_text_in_slices(make, monkeypatch):
    monkeypatch.setattr(lm_mixing, "SLICE", 200)
    docs = make(["one two three four " * 40, "five six", None, "x" * 900 + " y", "one two"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_lm(lm_mixing.score_by_held_out_model(docs).collect(), rows)


def test_language_id_equals_a_plain_twin(spark):
    """Prediction and score of the registered query against trigram vectors bound and bundled one by one."""
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang").collect()
    letters = np.random.default_rng(20240613).choice(np.array([-1, 1], np.int8), (64, 512)).astype(float)

    def letter(ch):
        if not ch.isalpha():
            return 0
        low = ch.lower()[0]
        return ord(low) - 96 if "a" <= low <= "z" else 27 + (ord(low) * 40503 >> 4) % 37

    def profile(text):
        seen = [0]
        for c in map(letter, text or ""):
            if c or seen[-1]:
                seen.append(c)
        seen += [0] * (seen[-1] != 0)
        if not any(seen):
            return None
        v = np.zeros(512)
        for (a, b, c), n in Counter(zip(seen, seen[1:], seen[2:])).items():
            v += n * np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return v / (np.linalg.norm(v) or 1.0)

    assert all(ord(ch) < 1 << 16 for r in rows for ch in r.text or "")
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    profiles = [profile(r.text) for r in rows]
    sums = {}
    for r, v in zip(rows, profiles):
        if v is not None and r.lang is not None and not held[r.doc_id]:
            sums[r.lang] = sums.get(r.lang, 0) + v
    names = sorted(sums)
    unit = np.array([sums[x] / np.linalg.norm(sums[x]) for x in names])
    mean = unit.mean(axis=0)
    centred = (unit - mean) / np.linalg.norm(unit - mean, axis=1, keepdims=True)
    got = {r.doc_id: r for r in QUERIES["op4_language_id"](spark, SF001).collect()}
    assert len(got) == len(rows)
    for r, v in zip(rows, profiles):
        g = got[r.doc_id]
        assert g.held_out == held[r.doc_id]
        if v is None:
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        cos = centred @ ((v - mean) / np.linalg.norm(v - mean))
        assert g.score == pytest.approx(min(1.0, max(0.0, cos.max())), abs=1e-5)
        assert cos[names.index(g.lang_pred)] >= cos.max() - 1e-6
