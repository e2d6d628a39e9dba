"""Exact, line and near-duplicate operators against brute force and SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from bandcast.llm import exact_dedup, line_dedup, simhash_golay
from bandcast.llm.queries import ORACLES, QUERIES
from tests.conftest import SF01
from tests.llm.conftest import LONG


def check_oracle(spark, con, name):
    df = QUERIES[name](spark, SF01)
    cols = sorted(df.columns)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    key = lambda r: tuple(map(str, r))      # noqa: E731
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == \
        sorted((tuple(r[names.index(c)] for c in cols) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_line_dedup"])
def test_sql(spark, con, name):
    check_oracle(spark, con, name)


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_exact_groups_edge(edge):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_groups(edge, tracked=16).collect()]
    assert Counter(got) == Counter(want)
    kept = exact_dedup.drop_copies(edge)
    assert kept.columns == edge.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _, _, k, _ in want if k)


def test_exact_route_does_not_matter(make):
    texts = ["hot"] * 900 + [f"t{i % 400}" for i in range(1200)]
    docs = make(texts).repartition(7)
    a = {tuple(r) for r in exact_dedup.exact_groups(docs, tracked=16).collect()}
    b = {tuple(r) for r in exact_dedup.exact_groups(docs, tracked=4096).collect()}
    assert a == b and sum(1 for r in a if r[3]) == 401


def test_exact_empty(empty):
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def lines_brute(rows):
    held = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        for key in {line_dedup.line_key(x) for x in (t or "").split("\n")}:
            if len(key) >= 20:
                held[key].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        low = lambda v: -(1 << 63) if v is None else v      # noqa: E731
        keep = [x for x in lines if len(held.get(line_dedup.line_key(x), ())) < 3
                or low(i) == max(map(low, held[line_dedup.line_key(x)]))]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return Counter(out)


def test_lines_edge(edge, make, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert Counter(tuple(r) for r in line_dedup.drop_repeated_lines(edge).collect()) == lines_brute(rows)
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_lines_many_shards(make, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    monkeypatch.setattr(line_dedup, "PROBES", 50)
    rnd = random.Random(3)
    pool = [f"  a repeated line number {i:04d} \t" for i in range(300)]
    texts = ["\n".join(["THE HOT LINE IN EVERY TEXT"] + rnd.choices(pool, k=6) + [f"only here {rnd.random()}", "short"]) for _ in range(400)]
    docs = make(texts).repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in line_dedup.drop_repeated_lines(docs).collect()) == lines_brute(rows)


def test_perfect_hash():
    for n in (0, 1, 2, 5000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        at = line_dedup.PerfectHash.build(keys).index(keys)
        assert sorted(at.tolist()) == list(range(len(keys)))
        h2, count = np.arange(len(keys)), np.arange(len(keys)) + 3
        shard = line_dedup.Shard(line_dedup.pack_shard(keys.view(np.int64), h2, count, h2 * 7))
        slot, found = shard.find(keys.view(np.int64), h2)
        assert found.all() and (shard.count[slot] == count).all() and (shard.largest[slot] == h2 * 7).all()
        if n:
            _, found = shard.find((keys + np.uint64(1)).view(np.int64), h2 + (1 << 40))
            assert not found.any()


def test_golay_code_is_perfect():
    d = simhash_golay.golay_decoder()
    assert (np.bincount(d, minlength=4096) == 2048).all()
    words = np.random.default_rng(1).integers(0, 1 << 23, 3000)
    near = d[words[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])]
    assert {len(set(r)) for r in near.tolist()} <= {1, 6}


def test_every_link_shares_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    flips = np.zeros(len(a), np.uint64)
    for k in range(3):
        use = rng.integers(0, 2, len(a)).astype(bool)
        flips[use] |= np.uint64(1) << rng.integers(0, 64, use.sum()).astype(np.uint64)
    b = a ^ flips
    (ra, ka), _ = simhash_golay.keys(a)
    _, (rb, kb) = simhash_golay.keys(b)
    sa = set(zip(ra.tolist(), ka.tolist()))
    shared = {r for r, k in zip(rb.tolist(), kb.tolist()) if (r, k) in sa}
    assert len(shared) == len(a)


def fingerprint_brute(t):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(rows):
    fps = [(i, fingerprint_brute(t)) for i, t in rows]
    distinct = sorted({f for _, f in fps})
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f
    x = np.array(distinct, np.uint64)
    degree = Counter()
    for k, f in enumerate(distinct):
        for o in np.flatnonzero(np.bitwise_count(x ^ np.uint64(f)) <= 3):
            if o != k:
                degree[f] += 1
                parent[root(distinct[o])] = root(f)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return Counter((i, f"{f:016x}", least.get(root(f)), degree[f]) for i, f in fps)


def test_near_duplicates(spark, edge, empty):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    for d in (docs, edge.filter("n_chars is null").select("doc_id", "text")):
        rows = [(r.doc_id, r.text if r.text != LONG else LONG) for r in d.collect()]
        assert Counter(tuple(r) for r in simhash_golay.near_duplicates(d).collect()) == components_brute(rows)
    assert simhash_golay.near_duplicates(empty).count() == 0
    kept = simhash_golay.drop_near_copies(edge)
    assert kept.columns == edge.columns and 0 < kept.count() < edge.count()


def test_chained_links(spark, monkeypatch):
    """A chain of fingerprints three bits apart is one component."""
    fps = [0]
    for k in range(21):
        fps.append(fps[-1] | 7 << 3 * k)
    df = spark.createDataFrame([(i, f if f < 1 << 63 else f - (1 << 64)) for i, f in enumerate(fps)], "_id bigint, _fp bigint")
    monkeypatch.setattr(simhash_golay, "fingerprints", lambda docs, *a: docs)
    assert {r.component_id for r in simhash_golay.near_duplicates(df, "_id", "_id").collect()} == {0}
