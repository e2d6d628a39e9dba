"""The pipeline against a brute-force version; contract of the stages."""

import hashlib
import re
from collections import defaultdict

import numpy as np

import corpus_pipeline
from bandcast.llm import language_id
from bandcast.llm.queries import tokenizer_file
from tests.conftest import SF001
from tests.llm.test_dedup import components_brute
from tests.llm.test_text_ops import contamination_brute


def test_run(spark):
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    label = {r.doc_id: r for r in language_id.identify(docs).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()
            if label[r.doc_id].lang_pred != "und" and label[r.doc_id].score >= corpus_pipeline.MIN_COSINE}
    groups = defaultdict(list)
    for i, t in rows.items():
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    rows = {min(g): rows[min(g)] for g in groups.values()}
    rows = {i: rows[i] for i, _, c, _ in components_brute(list(rows.items())) if i == c}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    bad = {k[0] for k in contamination_brute(list(rows.items()), bench) if k[-1]}
    lib = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = set()
    for i, t in rows.items():
        if i not in bad:
            ids = lib.encode(t, add_special_tokens=False).ids
            want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF001).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_stages(spark, edge, empty):
    assert len(corpus_pipeline.STAGES) == 5
    cols = corpus_pipeline.COLUMNS
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF001)
            assert out.columns == cols
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF001).count() == docs.count()
