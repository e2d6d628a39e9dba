"""Line deduplication with a sharded minimal perfect hash.

1. Documents give one row per distinct line key they hold: a 128-bit hash,
   the positions, never the line itself.  Counting these rows by hash (with
   map-side combine) finds the keys held by ``min_docs`` documents or more,
   their count and their largest document id.
2. The frequent hashes are cut into shards of about ``SHARD_KEYS``.  Each shard
   gets a minimal perfect hash (levels of collision-free bits, ranked) that
   maps its n hashes onto 0..n-1, and three arrays in that order: a 64-bit
   fingerprint (the half of the hash that the perfect hash does not use),
   the count and the largest id.
3. Documents probe the arrays: the compact line hashes are sent to the shard
   that would hold them, where one task streams them past the shard's arrays.
   A shard with many probes (a line that a third of the documents hold) is
   split by a salt of the document, its arrays repeated for every salt, so no
   task takes more than about ``PROBES`` probes of one shard at a time; memory
   is one shard and one batch.
4. The hits return as positions, grouped by document, and the text is
   rebuilt without them.

A hash that is not in the index still gets some slot; the 64-bit fingerprint
tells it apart.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandcast.llm.common import broadcast_if_small, prepare, written

STRIP = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(65, 91)}
SHARD_KEYS, PROBES, GAMMA = 2048, 4096, 2.0


def line_key(line: str) -> str:
    return line.strip(STRIP).translate(_LOWER)


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    """A new 64-bit hash of a 64-bit hash, another one for each seed."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct pairs of 64-bit hashes: at each level
    the keys alone in their bit settle there, the others go on to the next
    level; a key's index is the rank of its bit.  The first ``PLAIN`` levels
    hash the first number alone; later ones mix the second in, so keys that share the first part too."""

    PLAIN = 6

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.sizes = [len(x) for x in levels]
        bits = np.concatenate([*levels, np.zeros(1, bool)])
        self.bits, self.rank = bits, np.cumsum(bits) - bits

    @classmethod
    def _at(cls, keys: np.ndarray, second: np.ndarray, level: int, n: int) -> np.ndarray:
        h = _mix(keys, level) if level < cls.PLAIN else _mix(keys ^ _mix(second, level), level)
        return (h % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, second: np.ndarray | None = None) -> PerfectHash:
        second = np.zeros_like(keys) if second is None else second
        if len(np.unique(np.stack([keys, second]), axis=1).T) != len(keys):
            raise ValueError("keys repeat")
        levels, left, also = [], keys, second
        while len(left):
            n = max(8, int(GAMMA * len(left)))
            at = cls._at(left, also, len(levels), n)
            alone = np.bincount(at, minlength=n) == 1
            levels.append(alone)
            open_ = ~alone[at]
            left, also = left[open_], also[open_]
        return cls(levels)

    def index(self, keys: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
        """The index of each key; for keys not in the set any index, or -1."""
        second = np.zeros_like(keys) if second is None else second
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, n in enumerate(self.sizes):
            at = self._at(keys[open_], second[open_], level, n) + base
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_, base = open_[~hit], base + n
        return out


def pack_shard(h1: np.ndarray, h2: np.ndarray, count: np.ndarray, largest: np.ndarray) -> bytes:
    pair = h1.view(np.uint64), h2.view(np.uint64)
    mph = PerfectHash.build(*pair)
    at = mph.index(*pair)
    arrays = []
    for x in (h2, count, largest):
        y = np.empty_like(x)
        y[at] = x
        arrays.append(y)
    f = io.BytesIO()
    np.savez(f, levels=np.packbits(np.concatenate([*mph.levels, np.zeros(0, bool)])),
             sizes=np.array(mph.sizes, np.int64), fingerprint=arrays[0], count=arrays[1], largest=arrays[2])
    return f.getvalue()


class Shard:
    """A shard's arrays, read back; ``find`` gives (slot, found) of probes."""

    def __init__(self, blob: bytes):
        z = np.load(io.BytesIO(blob))
        sizes = z["sizes"]
        bits = np.unpackbits(z["levels"], count=int(sizes.sum())).astype(bool)
        self.mph = PerfectHash(np.split(bits, np.cumsum(sizes)[:-1]) if len(sizes) else [])
        self.fingerprint, self.count, self.largest = z["fingerprint"], z["count"], z["largest"]

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self.mph.index(h1.view(np.uint64), h2.view(np.uint64))
        found = slot >= 0
        found[found] = self.fingerprint[slot[found]] == h2[found]
        return slot, found


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, h1, h2, places = [], [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                at: dict[str, list[int]] = {}
                for k, line in enumerate((text or "").split("\n")):
                    if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                        at.setdefault(key, []).append(k)
                for key, where in at.items():
                    d = xxhash.xxh128_digest(key.encode(), 0)
                    row.append(i)
                    h1.append(d[:8])
                    h2.append(d[8:])
                    places.append(where)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take),
                 pa.array(np.frombuffer(b"".join(h1), "<i8")), pa.array(np.frombuffer(b"".join(h2), "<i8")),
                 pa.array(places, pa.list_(pa.int32()))], ["_id", "_th", "_h1", "_h2", "_at"])
    return run


def _pack(group: pa.Table) -> pa.Table:
    n = {c: group.column(c).to_numpy() for c in ("_h1", "_h2", "_docs", "_largest")}
    blob = pack_shard(n["_h1"], n["_h2"], n["_docs"], n["_largest"])
    return pa.table({"_shard": group.column("_shard")[:1], "_blob": pa.array([blob], pa.binary())})


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, salt, kind): a shard's blob, then its probes."""
    shard, of = None, None
    for b in batches:
        keys = b.column("_shard").to_numpy()
        blobs = b.column("_blob")
        is_blob = blobs.is_valid().to_numpy(zero_copy_only=False)
        h1, h2 = (b.column(c).fill_null(0).to_numpy() for c in ("_h1", "_h2"))
        number = b.column("_num").to_numpy(zero_copy_only=False)
        drop = np.zeros(len(keys), bool)
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(is_blob), np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]))
        for x, y in zip(cuts[:-1], cuts[1:]):
            if is_blob[x]:
                shard, of = Shard(blobs[int(x)].as_py()), keys[x]
                x += 1
            if of == keys[min(x, len(keys) - 1)] and y > x:
                slot, found = shard.find(h1[x:y], h2[x:y])
                keep = np.zeros(y - x, bool)
                keep[found] = shard.largest[slot[found]] == number[x:y][found]
                drop[x:y] = found & ~keep
        hit = b.filter(pa.array(drop))
        yield pa.RecordBatch.from_arrays([hit.column(c) for c in ("_id", "_th", "_at")], ["_id", "_th", "_at"])


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, total, gone = [], [], []
        for text, drops in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            lines, out = (text or "").split("\n"), set(drops or ())
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in out))
            total.append(len(lines))
            gone.append(len(out))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()),
                                          pa.array(gone, pa.int64())], ["_id", "_text", "_lines", "_dropped"])


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per input row: id, ``text`` without repeated lines, ``n_lines`` (before), ``n_dropped``.

    Lines are split at ``\\n``; a line's key is the line without white space
    at its ends, A-Z lower-cased.  Keys of at least ``min_chars`` code points
    held by at least ``min_docs`` documents lose all their lines but those in
    the largest (integer) id holding the key.  Null or empty text is one
    empty line and gives an empty text.  A null id is smaller than any other.
    Rows repeating id and text count as separate documents and, if theirs is
    the largest id, all keep the line.  An empty table gives an empty result;
    other columns are not read.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"),
                       F.col(text_col).cast("string").alias("_t"))
    lowest = -(1 << 63)
    lines = written(base.mapInArrow(_lines(min_chars), f"_id {id_type}, _th bigint, _h1 bigint, _h2 bigint, _at array<int>")
                    .withColumn("_num", F.coalesce(F.col("_id").cast("bigint"), F.lit(lowest))), "line-hashes")
    frequent = written(lines.groupBy("_h1", "_h2").agg(F.count("*").alias("_docs"), F.max("_num").alias("_largest"))
                       .filter(F.col("_docs") >= min_docs), "frequent-lines")
    shards = max(1, -(-frequent.count() // SHARD_KEYS))
    shard = F.pmod(F.col("_h1"), F.lit(shards)).alias("_shard")
    index = written(frequent.select(shard, "*").groupBy("_shard").applyInArrow(_pack, "_shard bigint, _blob binary"),
                    "line-index")
    salts = written(lines.select(shard).groupBy("_shard").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("_salts"))
                    .join(index.select("_shard"), "_shard"), "line-salts")
    salts_small = broadcast_if_small(salts, 16)      # one row per SHARD_KEYS frequent lines
    probes = lines.select(shard, "*").join(salts_small, "_shard").select(
        "_shard", F.pmod(F.xxhash64("_num", "_th"), F.col("_salts")).cast("int").alias("_salt"), F.lit(1).alias("_kind"),
        F.lit(None).cast("binary").alias("_blob"), "_h1", "_h2", "_num", "_id", "_th", "_at")
    arrays = index.join(salts_small, "_shard").select(
        "_shard", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.lit(0).alias("_kind"), "_blob",
        *[F.lit(None).cast(t).alias(c) for c, t in (("_h1", "bigint"), ("_h2", "bigint"))],
        F.lit(lowest).alias("_num"), F.lit(None).cast(id_type).alias("_id"), F.lit(None).cast("bigint").alias("_th"),
        F.lit(None).cast("array<int>").alias("_at"))
    hits = (arrays.unionByName(probes).repartition("_shard", "_salt").sortWithinPartitions("_shard", "_salt", "_kind")
            .mapInArrow(_probe, f"_id {id_type}, _th bigint, _at array<int>"))
    drops = hits.groupBy(F.col("_id").alias("_di"), F.col("_th").alias("_dt")) \
        .agg(F.array_distinct(F.flatten(F.collect_list("_at"))).alias("_drop"))
    return (base.join(drops, F.col("_id").eqNullSafe(F.col("_di")) & (F.col("_th") == F.col("_dt")), "left")
            .select("_id", "_t", "_drop").mapInArrow(_rebuild, f"_id {id_type}, _text string, _lines bigint, _dropped bigint")
            .toDF(id_col, "text", "n_lines", "n_dropped"))
