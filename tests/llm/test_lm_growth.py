"""What enters a language-model score grows with the training rows: no count outside the vocabulary is lost."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from bandcast.llm import lm_mixing
from bandcast.llm.common import most_frequent, prepare


def test_counts_outside_the_vocabulary_reach_the_score(spark, monkeypatch):
    monkeypatch.setattr(lm_mixing, "VOCABULARY", 8)
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(24)) for _ in range(400)]
    rows = [(i, w) for i, w in enumerate(words * 2)]
    model = lm_mixing.train(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in lm_mixing.score(
        spark.createDataFrame([(0, words[0]), (1, words[7]), (2, words[0][::-1]), (3, None)], "doc_id long, text string"), model).collect()}
    assert got[0].n_known == 2 and got[2].n_known == 1
    assert got[0].score > -4 and got[1].score > -4          # one of 400 words and an end: about -2.9
    assert got[2].score < -10                               # never seen: spelled
    assert sum(10 ** got[k].score for k in (0, 1, 2, 3)) < 1


def test_a_bucket_that_crosses_the_limit_is_filled(spark):
    prepare(spark)
    counts = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") < 50, 90).otherwise(5).cast("long").alias("n"))
    for limit in (20, 50, 1000, 5000):
        got = most_frequent(counts, "n", limit)
        assert limit * 0.7 < got.count() <= limit
        assert limit < 50 or got.filter("n = 90").count() == 50


def test_every_label_has_its_group(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % 40).alias("label"),
                                   F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), F.col("id") % 40)).alias("text"))
    model = lm_mixing.train(docs, label_col="label")
    assert len(set(model.vocabulary[-1].tolist())) >= 40
    assert lm_mixing.score(docs, model).filter("score < 0").count() == 200


def followers_brute(texts):
    """How often each class-coded symbol follows each word, by plain counting of (word before, word)."""
    pairs = Counter()
    for t in texts:
        words = [*(t or "").lower().split(), None]
        pairs.update(zip([None, *words], words))
    return pairs


def test_every_word_pair_is_counted(spark, make, monkeypatch):
    """The table of followers holds as many sightings, and as many words before, as the texts do; it grows with them."""
    rnd = random.Random(8)
    texts = [" ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(60))) for _ in range(120)] + [None, "", "only"]
    monkeypatch.setattr(lm_mixing, "HOT_CELLS", 0)         # none is broadcast or in parts, but for the end
    seen = []
    for part in (texts[:20], texts):
        model = lm_mixing.train(make(part))
        per_word, cells = Counter(), len(model.hot[2])
        for (a, _), n in followers_brute(part).items():
            per_word[a] += n
        got = [[x & ((1 << model.bits) - 1) for x in r["_list"]] for r in model.followers.collect()]
        assert all(not r["_large"] for r in model.followers.collect())
        hot = lm_mixing.Followers(*model.hot)
        assert hot.sightings(np.array([lm_mixing._END_HASH])).tolist() == [per_word.pop(None)]
        assert sorted(map(sum, got)) == sorted(per_word.values())
        seen.append(sum(map(len, got)) + cells)
    assert seen[1] > seen[0]


def test_scores_do_not_depend_on_broadcast_or_chunks(spark, make, monkeypatch):
    """Followers that are broadcast, joined to many chunks or to one give the same scores."""
    rnd = random.Random(9)
    docs = make([" ".join(f"w{int(rnd.paretovariate(0.6)) % 500}" for _ in range(rnd.randrange(200))) for _ in range(150)]
                + [None, "", "x" * 3000, "same again", "same again"])
    out = []
    for cells, chunk in ((1 << 22, 1 << 24), (0, 1 << 24), (0, 700), (1 << 9, 5000)):
        monkeypatch.setattr(lm_mixing, "HOT_CELLS", cells)
        monkeypatch.setattr(lm_mixing, "CHUNK", chunk)
        out.append(sorted((r.doc_id, r.score) for r in lm_mixing.score_by_held_out_model(docs).collect()))
    assert len(out[0]) == 155
    for other in out[1:]:
        assert all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-5) for a, b in zip(out[0], other))


def test_followers_are_a_distribution():
    """Counts below the code's nodes equal plain sums, and one step over all classes sums to one."""
    rng = np.random.default_rng(4)
    code = lm_mixing.Code(rng.integers(1, 500, 23))
    counts = {int(k): {int(c): int(rng.integers(1, 90)) for c in rng.choice(23, 6, replace=False)} for k in (3, 8, 1 << 40)}

    def followers(keys):
        small = [[(c << 6) + n for c, n in counts[k].items() if n < 64] for k in keys]
        large = [[(c << lm_mixing.LARGE_BITS) + n for c, n in counts[k].items() if n >= 64] for k in keys]
        return lm_mixing.Followers.of(pa.table([pa.array(keys, pa.int64()), pa.array(small, pa.list_(pa.int32())),
                                                pa.array(large, pa.list_(pa.int64()))], ["k", "l", "m"]), 6, False)
    found = followers([8, 1 << 40, 8])                          # a chunk may be sent a word twice
    sums = lm_mixing.FollowerSums(code, followers([3]), 4)
    mixer = lm_mixing.Mixer(rng.normal(0, 1, (32, 4)).astype(np.float32), rng.random(32 * 33).astype(np.float32) * 0.8 + 0.1)
    for word in (3, 8, 1 << 40, 77):
        total, of = 0.0, counts.get(word, {})
        for c in range(23):
            at, k = code.steps(np.array([c]))
            bit = code.bit.take(k)
            odds, sure = sums.read(found, np.array([word], np.uint64), at, k)
            total += 10 ** float(mixer.log10([code.odds.take(k), odds, odds], lm_mixing.gate_of(0, sure, sure), bit).sum())
            for i in range(len(k)):             # classes that share the path so far
                under = [(s, code.bit[code.start[s] + i]) for s in range(23)
                         if code.size[s] > i and (code.step[code.start[s] + i] == code.step[k[i]])]
                ones, zeros = (sum(of.get(s, 0) for s, b in under if b == side) for side in (1, 0))
                assert math.isclose(odds[i], math.log((ones + 0.4) / (zeros + 0.4)), rel_tol=1e-5, abs_tol=1e-6)
        assert abs(total - 1) < 1e-4


def test_no_stage_of_the_training_holds_two_python_workers(spark, monkeypatch):
    """Every Python function of a stage has a worker of its own, which stays, with its memory, when the stage is over."""
    frames, collect = [], type(spark.range(1)).toArrow
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda df: (frames.append(df), collect(df))[1])
    docs = spark.createDataFrame([(i, f"one two w{i % 7} three") for i in range(60)], "doc_id long, text string")
    model = lm_mixing.train(docs)
    merged = next(df._jdf.queryExecution().optimizedPlan().toString() for df in frames if df.columns[0] == "_cell")
    assert merged.count("FlatMapGroupsInArrow") == 2 and merged.count("MapInArrow") == 1         # the groups' exchanges part all three
    odds, seen, *_ = model.tables
    assert odds.dtype == np.float16 and len(odds) == len(seen) == lm_mixing.TABLES << lm_mixing.SLOT_BITS and seen.max() > 0


def test_a_vocabulary_holds_each_hash_once():
    """Its table has ranks alone; ranks and classes are those of plain counting, colliding slots included."""
    rnd = np.random.default_rng(3)
    h = np.unique(np.concatenate([rnd.integers(1, 1 << 63, 3000, dtype=np.uint64), np.arange(1, 500, dtype=np.uint64)]))
    rnd.shuffle(h)
    n, groups = np.sort(rnd.integers(2, 900, len(h)))[::-1], rnd.choice(np.array([0, 2, 3], np.uint8), len(h))
    v = lm_mixing.Vocabulary(h, n, 5, int(n.sum()) + 50, np.ones(257), groups)
    assert not any(isinstance(x, np.ndarray) and x.dtype == np.uint64 and x is not h for x in vars(v).values())
    assert v.find(h).tolist() == list(range(len(h))) and set(v.find(h + np.uint64(1 << 62)).tolist()) <= {-1, *v.find(h).tolist()}
    unknown = np.setdiff1d(rnd.integers(1, 1 << 63, 500, dtype=np.uint64), h)
    assert (v.find(unknown) == -1).all() and (lm_mixing.Vocabulary(h[:0], n[:0], 0, 0, np.ones(257)).find(unknown) == -1).all()
    octave = [(r + 1).bit_length() - 1 for r in range(len(h))]
    marks = [(2 * o + ((r + 1 >> max(o - 1, 0)) & 1 if o else 0), int(g)) for r, (o, g) in enumerate(zip(octave, groups))]
    number = {m: lm_mixing.FIRST + k for k, m in enumerate(sorted(set(marks)))}
    assert v.cls.tolist() == [number[m] for m in marks]


def test_rare_words_are_joined_however_much_the_broadcast_holds(spark, make, monkeypatch):
    """Words sighted less than HOT_LEAST times are not sent to every task: the rows that chunks ask for grow with the texts."""
    monkeypatch.setattr(lm_mixing, "SALTED", 0)             # no word's followers are in parts, which are broadcast
    texts = [" ".join(["all", f"once{i}", f"twice{i // 2}", f"often{i % 5}"]) for i in range(60)]
    asked = []
    for part in (texts[:20], texts):
        model = lm_mixing.train(make(part))
        words = Counter(w for t in part for w in t.split())
        hot = set(model.hot[0].tolist())
        known = {w: int(lm_mixing.Words([w.encode()]).hash[0]) for w in words}
        assert all((known[w] in hot) == (n >= lm_mixing.HOT_LEAST) for w, n in words.items())
        assert sorted(r._key for r in model.followers.select("_key").collect()) == sorted(
            np.array([known[w] for w, n in words.items() if n < lm_mixing.HOT_LEAST], np.uint64).view(np.int64).tolist())
        asked.append(sum(n for n in words.values() if n < lm_mixing.HOT_LEAST))
    assert asked[1] == 3 * asked[0]


def test_words_by_the_word_before_are_looked_up_once(monkeypatch):
    """Scoring takes a group's words sorted by the word before: its followers are summed once a group (twice where a block ends)."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 40, 500)).encode() for _ in range(20)]
    w = lm_mixing.Words(texts)
    hashes, n = np.unique(w.hash, return_counts=True)
    order = np.argsort(-n)
    voc = lm_mixing.Vocabulary(hashes[order], n[order], len(texts), int(n.sum()) + len(texts), np.ones(257))
    voc.block = 300
    h, _, word = w.sequence(True)
    rank = np.where(word, voc.find(h), -1)
    blocks = [b for b in voc.blocks(w, h, word, rank, True) if b[0] == 0]
    plain = [b for b in voc.blocks(w, h, word, rank) if b[0] == 0]
    assert sum(len(np.unique(b[3][0])) for b in blocks) <= 41 + len(blocks) < sum(len(np.unique(b[3][0])) for b in plain) // 10
    place = np.concatenate([b[4] for b in blocks])
    assert sorted(place.tolist()) == list(range(len(h)))
    for got, want in ((2, 2), (3, 3)):
        a, b = (np.concatenate([x[got] if got == 2 else np.stack(x[got], 1) for x in xs]) for xs in (blocks, plain))
        assert (a == b[place]).all()


def test_a_score_does_not_depend_on_the_texts_beside_it(spark, make):
    """The same text gets the very same score wherever it stands."""
    rnd = random.Random(11)
    text = " ".join(f"w{rnd.randrange(50)}" for _ in range(300))
    other = [" ".join(f"w{rnd.randrange(90)}" for _ in range(rnd.randrange(400))) for _ in range(90)]
    model = lm_mixing.train(make([text, *other]))
    rows = [text, *other[:40], text, *other[40:], text]
    got = {r.doc_id: r.score for r in lm_mixing.score(make(rows), model).collect()}
    assert got[0] == got[41] == got[92]
    assert lm_mixing.score(make([text]), model).first().score == got[0]


def test_hashes_do_not_depend_on_the_pieces_they_are_computed_in(monkeypatch):
    texts = [b"one  two\tthree\n", b"", b" \x0b\x0c\r ", "héllo 中文".encode(), b"x" * 5000, b"a b " * 900, b"Tail\x08\x0e\x1f!"]
    a = lm_mixing.Words(texts)
    assert [a.raw[s:e].tobytes() for s, e in zip(a.start, a.end)] == [w.lower() for t in texts for w in t.split()]
    monkeypatch.setattr(lm_mixing, "_PIECE", 7)
    assert (lm_mixing.Words(texts).hash == a.hash).all()
    assert lm_mixing.distinct(a.hash.copy()).tolist() == np.unique(a.hash).tolist() and len(lm_mixing.distinct(a.hash[:0])) == 0


def test_building_what_a_worker_keeps_takes_little_more_memory():
    """A Python worker waits for its next task with its largest memory, so temporaries as long as the vocabulary or a slice count twice."""
    rng = np.random.default_rng(3)
    n = 1 << 19
    hashes = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    counts = np.sort(rng.integers(2, 1 << 20, n))[::-1].astype(np.int64)
    texts = [b"some words of a text\n" * 150 for _ in range(320)]
    tracemalloc.start()
    try:
        vocabulary = lm_mixing.Vocabulary(hashes, counts, 5, int(counts.sum()) + 9, np.ones(257), (np.arange(n) % 7).astype(np.uint8))
        kept, most = tracemalloc.get_traced_memory()
        assert kept < 28 * n and most < 44 * n          # bytes a word; before: 32 and 68
        tracemalloc.reset_peak()
        lm_mixing.Words(texts)
        assert tracemalloc.get_traced_memory()[1] - kept < 24 * sum(map(len, texts))        # before: 38
    finally:
        tracemalloc.stop()
    assert np.array_equal(vocabulary.find(hashes), np.arange(n)) and (vocabulary.find(hashes + np.uint64(1)) < 0).all()


def test_word_hashes_do_not_depend_on_the_place():
    """Words across the pieces that hashes are computed in, and longer than a piece, equal the same words alone."""
    words = [b"a" * k for k in (1, 100, 32766, 32767, 32768, 32769, 70000)] + [b"bc", b"x" * 65536]
    alone = np.concatenate([lm_mixing.Words([w]).hash for w in words])
    for shift in range(0, 5):
        together = lm_mixing.Words([b" " * shift, b" ".join(words)])
        assert np.array_equal(together.hash, alone) and list(together.words) == [0, len(words)]
    assert len(set(alone.tolist())) == len(words)
