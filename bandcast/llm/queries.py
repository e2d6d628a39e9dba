"""Registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandcast.llm import (bpe_stream, chat_trees, decontam, exact_dedup, fill_in_middle, filter_audit, language_id, license_scan, line_dedup,
                          lm_mixing, sharding, simhash_golay, token_counts)
from bandcast.llm.common import LOWER, UPPER, documents

_BLANKS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; the operators take any path."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, line, pos, translate(trim(line, {_BLANKS}), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.pos, f.last_id IS NOT NULL AND f.last_id <> k.doc_id AS gone
      FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.near_duplicates(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contamination(documents(spark, sf_dir), bench).drop("text_xxhash64")


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
r AS (
  SELECT item_id, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS g FROM r),
places AS (
  SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS s, w FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
hits AS (
  SELECT p.doc_id, p.s, p.m, win.item_id
  FROM (SELECT doc_id, s, m, array_to_string(w[s:s + m - 1], ' ') AS g FROM places) p JOIN win ON p.g = win.g AND p.m = win.m),
words AS (SELECT DISTINCT doc_id, unnest(range(s, s + m)) AS at FROM (SELECT DISTINCT doc_id, s, m FROM hits)),
n AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.score_by_held_out_model(documents(spark, sf_dir), label_col="lang")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.round_trip_digests(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def _read_back(batches):
    """Digests from formatted conversations and their loss spans alone."""
    import hashlib
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for b in batches:
        cols: list[list] = [[] for _ in names[1:]]
        for formatted, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            turns = chat_trees.parse_turns(formatted)
            loss = "".join(chat_trees.unescape(formatted[s["start"]:s["end"]]) for s in spans)
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            for c, v in zip(cols, (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))):
                c.append(v)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], conversations.schema)
    made = chat_trees.format_reply_trees(chat_trees.conversation_messages(conversations.unionByName(extra)),
                                         "conv_id", "msg", "parent", "role", "text")
    return made.select("conv_id", "formatted", "loss_spans").mapInArrow(
        _read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(20 + length(regexp_replace(role || text, '[\\<\[]', 'xx', 'g'))) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM t
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(coalesce(CAST(quality = 1 AS INT), 0)) AS good, max(coalesce(CAST(toxic = 1 AS INT), 0)) AS toxic
      FROM labels GROUP BY doc_id),
f AS (
  SELECT part, [CAST(x AS INT) FOR x IN [
           len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
           100 * (length(t) - length(translate(t, '{UPPER}', ''))) > 10 * length(t),
           regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)]] AS b,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, b, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, b),
i AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
r AS (
  SELECT part, o, s.i AS step, b[o[s.i]] = 1 AS fails, n, good, toxic, list_sum(b) AS n_fails,
         list_sum([b[x] FOR x IN o[1:s.i]]) AS so_far, list_sum([b[x] FOR x IN o[1:s.i - 1]]) AS before
  FROM m, o, i s),
g AS (
  SELECT part, o, step, o[step] AS filter,
         coalesce(sum(n) FILTER (so_far = 0), 0) AS kept,
         coalesce(sum(n) FILTER (fails AND coalesce(before, 0) = 0), 0) AS removed,
         coalesce(sum(n) FILTER (fails AND before > 0), 0) AS redundant,
         coalesce(sum(n) FILTER (fails AND n_fails = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails AND coalesce(before, 0) = 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (fails AND coalesce(before, 0) = 0), 0) AS toxic_lost
  FROM r GROUP BY part, o, step)
SELECT part, array_to_string(['ABCDE'[x] FOR x IN o], '') AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM g
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_in_middle.restored("output", "form"), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, a, b, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("spans")


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_line_dedup, op3_simhash_near_dedup, op4_language_id, op5_sharding, op6_decontamination,
    op7_lm_scoring, op8_bpe, op9_token_counts, op10_chat_formatting, op11_filter_audit, op12_fill_in_middle, op13_license_scan)}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op2_line_dedup": OP2_SQL, "op6_decontamination": OP6_SQL, "op10_chat_formatting": OP10_SQL,
           "op11_filter_audit": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
