"""Token counts by a map-side two-tier lookup.

A pre-token is a run of spaces with the word behind it: no vocabulary piece
holds a space behind another character, so merges never cross from one
pre-token into the next and a text's count is the sum of its pre-tokens'.

Tier one is a compact table of the most frequent pre-tokens and their
lengths (at most ``FREQUENT`` entries), broadcast and opened as a hash table in
each worker.  It is found by Misra-Gries summaries: every task counts
all its pre-tokens with a bounded number of counters, and only the largest of these
bounded summaries are merged, never the pre-tokens.  Tier two is the
tokenizer itself behind a bounded cache in each worker.  The tiers differ
only in speed; no pre-token is shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandcast.llm.common import most_frequent, prepare, written

FREQUENT = 1 << 16          # entries of the broadcast table
COUNTERS = 1 << 17          # counters of a task's Misra-Gries summary
SENT = 1 << 14              # largest counters a task sends
CACHE = 1 << 18             # pre-tokens a worker remembers
LONGEST = 48                # characters of a pre-token that is counted or remembered

_RUN = re.compile(" +[^ ]*")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text as the tokenizer sees it: with its leading space mark, marks and spaces being the same."""
    return _RUN.findall(" " + text.replace("▁", " ")) if text else []


class Lengths:
    """Token counts of pre-tokens by one sentencepiece model; one per worker and path."""

    _open: dict[str, Lengths] = {}

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.model.get_piece_size()):
            if re.search("[^▁]▁", self.model.id_to_piece(i)):
                raise ValueError("a piece spans two words, so pre-tokens are not independent")
        self.cache: dict[str, int] = {}

    @classmethod
    def at(cls, path: str) -> Lengths:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def compute(self, tokens: list[str]) -> list[int]:
        """The model puts a space in front of what it encodes, so a pre-token goes in without its first one."""
        made = self.model.encode([t[1:] for t in tokens], num_threads=1)
        return [len(x) if len(t) > 1 else 1 for t, x in zip(tokens, made)]

    def learn(self, tokens: list[str]) -> dict[str, int]:
        found = dict(zip(tokens, self.compute(tokens)))
        if len(self.cache) + len(found) > CACHE:
            self.cache.clear()
        self.cache.update((t, n) for t, n in found.items() if len(t) <= LONGEST)
        return found


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            counts.update(pre_tokens(text or ""))
            if len(counts) > COUNTERS:
                # Misra-Gries: take the same amount off every counter until half of them are free
                off = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), COUNTERS // 2)[COUNTERS // 2])
                counts = Counter({t: n - off for t, n in counts.items() if n > off})
    top = [(t, n) for t, n in counts.most_common(SENT) if len(t) <= LONGEST]
    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                                     ["_token", "_n"])


def frequent_lengths(texts: DataFrame, path: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The compact table: pre-tokens as one UTF-8 blob with ends, and their lengths."""
    merged = written(texts.mapInArrow(_summaries, "_token string, _n bigint").groupBy("_token").agg(F.sum("_n").alias("_n")),
                     "pre-token-summary")
    # FREQUENT short strings at most
    tokens = sorted(most_frequent(merged, "_n", FREQUENT).select("_token").toArrow().column(0).to_pylist())
    blobs = [t.encode() for t in tokens]
    lengths = Lengths.at(path).compute(tokens) if tokens else []
    return b"".join(blobs), np.cumsum([len(x) for x in blobs], dtype=np.int32), np.array(lengths, np.uint16)


def open_table(table: tuple[bytes, np.ndarray, np.ndarray]) -> dict[str, int]:
    blob, ends, lengths = table
    starts = [0, *ends[:-1].tolist()]
    return {blob[a:b].decode(): n for a, b, n in zip(starts, ends.tolist(), lengths.tolist())}


_TABLES: dict[str, dict[str, int]] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    ``path`` is a sentencepiece model that the driver and every worker can
    read.  No begin, end or special token is added, and special strings in a
    text are ordinary text.  Null text counts as empty and has no tokens.
    Repeated rows get the same answer; an empty table gives an empty result;
    other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    shared, name = spark.sparkContext.broadcast(frequent_lengths(text.select("_t"), path)), uuid.uuid4().hex
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Lengths.at(path)
        if name not in _TABLES:
            _TABLES.clear()
            _TABLES[name] = open_table(shared.value)
        table = _TABLES[name]
        for b in batches:
            texts = b.column(1).to_pylist()
            totals = []
            for t in texts:
                tokens = pre_tokens(t or "")
                known = [table.get(x) or model.cache.get(x) for x in tokens]
                if None in known:
                    missed = [x for x, n in zip(tokens, known) if n is None]
                    found = model.learn(list(dict.fromkeys(missed)))
                    totals.append(sum(filter(None, known)) + sum(map(found.__getitem__, missed)))
                else:
                    totals.append(sum(known))
            size = [len((t or "").encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(totals, pa.int64()),
                 pa.array([n > limit for n in totals], pa.bool_())], ["_id", "_bytes", "_n", "_over"])

    return text.mapInArrow(run, f"_id {id_type}, _bytes bigint, _n bigint, _over boolean") \
        .toDF(id_col, "n_bytes", "n_tokens", "over_limit")
