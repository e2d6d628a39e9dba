"""Clashing names in the pipeline's filters, endless hashes, long conversations, whole tables against the libraries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandcast.llm import bpe_stream, chat_trees, decontam, exact_dedup, line_dedup, queries, simhash_golay
from tests.conftest import SF01

CLASH = ["_gone", "_gone_id", "_bad_id", "_bad_th", "_digest", "_keep", "_heavy", "_text", "_d", "c0", "c1", "_id", "_size"]


def test_filters_keep_columns_of_any_name(spark, edge):
    docs = edge.select("doc_id", "text", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])
    bench = spark.createDataFrame([(1, "one two " + "l" * 25)], "item_id long, text string")
    for f in (exact_dedup.drop_copies, simhash_golay.drop_near_copies, lambda d: decontam.drop_contaminated(d, bench)):
        plain, got = f(edge.select("doc_id", "text")), f(docs)
        assert got.columns == docs.columns
        rows = got.collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
        assert sorted(map(key, rows)) == sorted(map(key, plain.collect()))
        assert all(list(r)[2:] == list(range(len(CLASH))) for r in rows)


def test_copies_go_without_shuffling_texts(spark):
    from tests.test_plans import plan
    docs = spark.createDataFrame([(i, f"text {min(i % 50, 20)}", "x") for i in range(400)], "doc_id long, text string, source string")
    got = exact_dedup.drop_copies(docs)
    assert "Exchange hashpartitioning" not in plan(got) and "SortMergeJoin" not in plan(got)
    assert sorted(r.doc_id for r in got.collect()) == list(range(21))


def test_perfect_hash_ends_on_equal_first_halves():
    keys, second = np.array([5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 9], np.uint64)
    h = line_dedup.PerfectHash.build(keys, second)
    assert sorted(h.index(keys, second).tolist()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        line_dedup.PerfectHash.build(np.array([5, 5, 7], np.uint64))
    blob = line_dedup.pack_shard(keys.view(np.int64), second.view(np.int64), np.arange(4), np.arange(4) * 10)
    shard = line_dedup.Shard(blob)
    slot, found = shard.find(keys.view(np.int64), second.view(np.int64))
    assert found.all() and shard.largest[slot].tolist() == [0, 10, 20, 30]


def test_every_byte_passes_the_transducer(monkeypatch):
    t = bpe_stream.Transducer(queries.tokenizer_file("byte_bpe_50k.json"))
    seen, stream = [], t.stream
    monkeypatch.setattr(t, "stream", lambda data, *a: (seen.append(len(data)), stream(data, *a))[1])
    monkeypatch.setattr(bpe_stream, "LONGEST_CACHED", -1)          # nothing is remembered: all bytes run
    text = "The 3 quick-brown  foxes' héllo\n\n 中文 " + "x" * 9000
    whole = b"".join(t.encode_chunks(text))
    assert sum(seen) == len(text.encode()) and len(whole) // 4 < len(text)


def test_op8_whole_table_equals_library(spark):
    from hashlib import sha256

    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op8_bpe(spark, SF01).collect()}
    docs = queries.documents(spark, SF01).collect()
    assert len(got) == len(docs)
    for d, e in zip(docs, lib.encode_batch([d.text or "" for d in docs], add_special_tokens=False)):
        text = lib.decode(e.ids, skip_special_tokens=False)
        assert got[d.doc_id] == (len(e.ids), sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), sha256(text.encode()).hexdigest())


def test_op9_whole_table_equals_library(spark):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op9_token_counts(spark, SF01).collect()}
    docs = queries.documents(spark, SF01).collect()
    for d, ids in zip(docs, lib.encode([d.text or "" for d in docs], num_threads=4)):
        assert got[d.doc_id] == (len((d.text or "").encode()), len(ids), len(ids) > 4096)


def test_a_long_conversation_takes_linear_space(spark, monkeypatch):
    """Pointers double, paths do not: what is written stays near the number of messages times the rounds."""
    n, sizes, keep = 3000, [], chat_trees.written

    def spy(df, name):
        out = keep(df, name)
        sizes.append((name, out.count(), max([len(r[0]) for r in out.select(F.to_json(F.struct("*"))).collect()] or [0])))
        return out
    monkeypatch.setattr(chat_trees, "written", spy)
    conv = spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(n)] + [(2, None, "user", "x"), (2, 0, "assistant", "y")],
                                 "conv_id long, turn long, role string, text string")
    made = {r.conv_id: r for r in chat_trees.format_reply_trees(chat_trees.conversation_messages(conv), "conv_id", "msg", "parent", "role", "text").collect()}
    assert [t for _, t in chat_trees.parse_turns(made[1].formatted)] == [f"t{k}" for k in range(n)]
    assert [t for _, t in chat_trees.parse_turns(made[2].formatted)] == ["x", "y"]
    assert max(rows for _, rows, _ in sizes) <= n + 2 and max(width for *_, width in sizes) < 200


def test_numbering_in_chunks_equals_a_window(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t in (None, -3, 0, 1, 1, 5, 2500) for r, x in (("user", "b"), ("user", "a"), (None, None))]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one, many = (sorted(map(str, chat_trees.conversation_messages(conv, n).collect())) for n in (10 ** 9, 2))
    assert one == many and len(one) == len(rows)
