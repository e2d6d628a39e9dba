"""SimHash near-duplicates by Golay-code fuzzy hashing.

The binary Golay code is perfect: every 23-bit word lies within distance 3
of exactly one of its 4,096 codewords, whose 12-bit index is the word's hash.
A word's *near keys* are the indices of the word and of its 23 one-bit
neighbours (one or six distinct ones), so if two words differ in at most one
bit, the index of either is among the near keys of the other.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each a
shortened 23-bit word.  At most 3 differing bits fall over the segments so
(pigeonhole) that either

* some segment is equal, and one of the other two has at most one error:
  keys (equal segment i, index of j) for the six ordered pairs i, j; or
* every segment has exactly one error: keys (index, index, index).

In both cases one fingerprint offers plain indices (12 keys) and the other
near keys (72 at most); they are joined on the key and every candidate is
verified by its exact Hamming distance.  Keys of 34 to 36 bits keep the
expected number of chance candidates of a fingerprint near
distinct_fingerprints / 2**27.  Equal fingerprints are merged before, so
large groups of copies cost one row, and the pairs that leave the join are
true links between different fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandcast.llm.common import LOWER_BYTES, numbered, prepare, written
from bandcast.operators.graph import connected_components
from bandcast.operators.joins import broadcast_if_small

SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b101011100011          # generator polynomial of the binary Golay code (degree 11)
MAX_BITS = 3


def golay_decoder() -> np.ndarray:
    """Index (0..4095) of the codeword nearest to each of the 2**23 words."""
    code = np.zeros(4096, np.uint32)
    for i in range(12):
        code ^= np.where(np.arange(4096) >> i & 1, np.uint32(GENERATOR << i), np.uint32(0)).astype(np.uint32)
    one = [1 << i for i in range(23)]
    errors = [0] + one + [a | b for i, a in enumerate(one) for b in one[:i]]
    errors += [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    out = np.empty(1 << 23, np.int16)
    index = np.arange(4096, dtype=np.int16)
    for e in errors:
        out[code ^ np.uint32(e)] = index
    return out


_DECODER: list[np.ndarray] = []


def _decode(words: np.ndarray) -> np.ndarray:
    if not _DECODER:
        _DECODER.append(golay_decoder())     # 16 MB, once per worker
    return _DECODER[0][words].astype(np.int64)


def segments(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def plain_and_near(fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For every segment: the index (n), and the near keys (n, 24) of which most repeat."""
    plain, near = [], []
    for s in segments(fp):
        ball = s[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])[None, :]
        k = _decode(ball)
        plain.append(k[:, 0])
        near.append(k)
    return plain, near


def _unique_rows(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the distinct values of each row."""
    s = np.sort(k, axis=1)
    first = np.ones(s.shape, bool)
    first[:, 1:] = s[:, 1:] != s[:, :-1]
    row, _ = np.nonzero(first)
    return row, s[first]


def keys(fp: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(row, key) offered by plain indices, and (row, key) offered by near keys."""
    exact, (plain, near) = segments(fp), plain_and_near(fp)
    distinct = [_unique_rows(k) for k in near]
    n, rows_a, keys_a, rows_b, keys_b = np.arange(len(fp)), [], [], [], []
    tag = 1
    for i in range(3):
        for j in range(3):
            if i != j:
                head = (tag << 40) | (exact[i] << 12)
                rows_a.append(n)
                keys_a.append(head | plain[j])
                row, v = distinct[j]
                rows_b.append(row)
                keys_b.append(head[row] | v)
                tag += 1
    # one error in each segment: the first segment's near keys on one side, the other two's on the other
    row, v = distinct[0]
    rows_a.append(row)
    keys_a.append((tag << 40) | (v << 24) | (plain[1][row] << 12) | plain[2][row])
    at2, v2 = distinct[2]
    start, count = np.searchsorted(at2, n), np.bincount(at2, minlength=len(fp))
    row1, v1 = distinct[1]
    rep = count[row1]
    row = np.repeat(row1, rep)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(rep) - rep, rep) + start[row]
    rows_b.append(row)
    keys_b.append((tag << 40) | (plain[0][row] << 24) | (np.repeat(v1, rep) << 12) | v2[inner])
    cat = np.concatenate
    return (cat(rows_a), cat(keys_a)), (cat(rows_b), cat(keys_b))


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the text's word shingles (see :func:`fingerprints`)."""
    w = (text or "").encode().translate(LOWER_BYTES).split()
    if not w:
        return 0
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    start = end - size
    joined = b" ".join(w)
    a, b = (start[:len(w) - words + 1], end[words - 1:]) if len(w) >= words else (start[:1], end[-1:])
    ones, step = np.zeros(64, np.int64), 1 << 15
    for at in range(0, len(a), step):        # a long text is counted in slices
        raw = b"".join([xxhash.xxh64_digest(joined[x:y], 42)
                        for x, y in zip(a[at:at + step].tolist(), b[at:at + step].tolist())])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > len(a)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """(_id, _fp): A-Z lower-cased, words split at ASCII white space, shingles
    of ``words`` words (a shorter text: all of it) hashed by XXH64 with seed
    42; a bit is 1 if set in over half the hashes; no words: 0."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["_id", "_fp"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")) \
        .mapInArrow(run, f"_id {id_type}, _fp bigint")


def _offer(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            row, key = keys(fp)[side]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64))], ["_key", "_fp"])
    return run


def links(distinct_fps: DataFrame) -> DataFrame:
    """Pairs (src < dst) of different fingerprints at ``MAX_BITS`` or fewer differing bits."""
    a = distinct_fps.mapInArrow(_offer(0), "_key bigint, _fp bigint").alias("a")
    b = distinct_fps.mapInArrow(_offer(1), "_key bigint, _fp bigint").alias("b")
    near = (F.col("a._key") == F.col("b._key")) & (F.col("a._fp") < F.col("b._fp")) \
        & (F.bit_count(F.col("a._fp").bitwiseXOR(F.col("b._fp"))) <= MAX_BITS)
    # a fingerprint offers up to 72 keys, which the planner's size leaves out: never broadcast
    return a.join(b.hint("merge"), near).select(F.col("a._fp").alias("src"), F.col("b._fp").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id``,
    ``n_links`` (other fingerprints linked to this one).

    Documents are linked when their fingerprints differ in at most 3 bits;
    ``component_id`` is the smallest id reachable over links.  Null text
    counts as empty; a text without words has fingerprint zero and is linked
    like any other.  A null id is larger than any other id (a component of
    null ids only has a null ``component_id``); repeated rows get the same
    answer.  An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    f = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    groups = written(f.groupBy("_fp").agg(F.min("_id").alias("_first")), "fp-groups")
    pairs = written(links(groups.select("_fp")), "fp-links")
    comp = connected_components(pairs)                       # only linked fingerprints
    degree = pairs.select(F.explode(F.array("src", "dst")).alias("_fp")).groupBy("_fp").agg(F.count("*").alias("_deg"))
    linked = groups.join(comp.withColumnRenamed("id", "_fp"), "_fp").join(degree, "_fp")
    least = linked.groupBy("component").agg(F.min("_first").alias("_least"))
    linked = linked.join(least, "component").select("_fp", "_least", "_deg")
    # min() skips nulls, so only a group of null ids has a null minimum
    table = written(groups.join(linked, "_fp", "left").select(
        F.col("_fp").alias("_g"), F.when(F.col("_deg").isNull(), F.col("_first")).otherwise(F.col("_least")).alias("_c"),
        F.coalesce("_deg", F.lit(0)).alias("_deg")), "fp-components")
    return f.join(table, F.col("_fp") == F.col("_g")).select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_c").alias("component_id"), F.col("_deg").cast("bigint").alias("n_links"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The row with the smallest id of every component, with all its columns, whatever their names.
    Rows without an id stay only if their component has no id at all; rows
    repeating an id stay or go together."""
    plain = numbered(docs)
    i, t = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    gone = written(near_duplicates(plain, i, t, words)
                   .filter(~F.col(i).eqNullSafe(F.col("component_id"))).select(F.col(i).alias("_gone")).distinct(), "near-copies")
    small = broadcast_if_small(gone, max_rows=1 << 62)          # by its measured bytes; else joined by a shuffle
    return plain.join(small, F.col(i).eqNullSafe(F.col("_gone")), "left_anti").toDF(*docs.columns)
