"""Byte-level BPE as a streaming transducer, with an incremental decoder.

Merges are applied in order of rank, leftmost first.  How far can text that
is still to come change tokens already formed?  A merge (x, y) whose y starts
at the first open boundary removes that boundary, so the undecided part grows
by x; what then starts there begins with x, so only a later merge (x', y')
with x a prefix of y' can carry the change on.  ``sufficient_lookahead``
follows these chains over the merge list and returns the largest number of
bytes such a chain can cover.  Tokens that end at least so many bytes before
the end of what was read are stable; they are emitted, and the transducer
goes on behind them: since no merge crosses an emitted boundary, the rest is
encoded as if it stood alone.  Memory is one block and the lookahead, however
long the input.

Decoding turns ids into bytes and feeds an incremental UTF-8 state machine
that holds back at most three bytes between chunks.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandcast.llm.common import prepare

# The byte-level pre-token pattern and Unicode white space.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = "\t-\r \x85\xa0  -     　"

BLOCK = 4096                # bytes the transducer takes in at a time
SLICE = 1 << 16             # characters of text that are pre-tokenised at a time
CACHE = 1 << 19             # pre-tokens a worker remembers
LONGEST_CACHED = 64         # characters


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Largest number of bytes before the end of the input whose tokens later text may change."""
    far: dict[bytes, int] = {}      # prefix of some y of a later merge -> bytes its chain covers
    most = 0
    for x, y in reversed(merges):
        reach = len(x) + far.get(x, 0)
        most = max(most, reach)
        for n in range(1, len(y) + 1):
            if far.get(y[:n], 0) < reach:
                far[y[:n]] = reach
    return most


class Transducer:
    """Encoder and decoder for one byte-level BPE file; one per worker and path."""

    _open: dict[str, Transducer] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda token: bytes(alphabet[c] for c in token)      # noqa: E731
        vocab = spec["model"]["vocab"]
        self.token_bytes: dict[int, bytes] = {i: to_bytes(t) for t, i in vocab.items()}
        self.byte_id = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.rank, self.made, merges = {}, [], []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = r
            self.made.append(vocab[a + b])
            merges.append((to_bytes(a), to_bytes(b)))
        self.lookahead = sufficient_lookahead(merges)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pre_tokens = regex.compile(PRE_TOKENS.replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]")
                                        .replace(f"[^[{SPACES}]", f"[^{SPACES}"))
        self.runs = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
        self.cut = re.compile(f"[^{SPACES}](?= [^{SPACES}])")
        self.cache: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> Transducer:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def merge(self, data: bytes) -> list[int]:
        """Token ids of bytes by all merges."""
        return self._merge_short(data) if len(data) <= 256 else self._merge_long(data)

    def _merge_short(self, data: bytes) -> list[int]:
        ids, rank, none = [self.byte_id[b] for b in data], self.rank.get, len(self.made)
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            r = min(ranks)
            if r == none:
                break
            i = ranks.index(r)
            ids[i:i + 2] = [self.made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], none)
        return ids

    def _merge_long(self, data: bytes) -> list[int]:
        ids, rank = [self.byte_id[b] for b in data], self.rank.get
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[r], -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q < n and (s := rank(ids[p] << 32 | ids[q])) is not None:
                    heapq.heappush(heap, (s, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def stream(self, data: bytes, block: int = BLOCK) -> Iterator[int]:
        """Token ids of bytes, emitted as they become stable."""
        at, buffer, width = 0, b"", max(block, 256)
        while True:
            buffer += data[at:at + width]
            at += width
            if at >= len(data):
                yield from self.merge(buffer)
                return
            stable, end = len(buffer) - self.lookahead, 0
            for i in self.merge(buffer) if stable > 0 else ():
                if end + len(self.token_bytes[i]) > stable:
                    break
                end += len(self.token_bytes[i])
                yield i
            buffer = buffer[end:]

    def _piece(self, piece: str) -> bytes:
        """What the transducer emits for a pre-token, both of whose ends are forced cuts."""
        return b"".join([i.to_bytes(4, "little") for i in self.stream(piece.encode("utf-8", "replace"))])

    def _run(self, run: str) -> bytes:
        """Ids of a run that the white-space split gave.  Between forced cuts the transducer starts and ends
        empty, so what it emitted for a run is remembered (a transition of its state) and not run again."""
        pieces = self.pre_tokens.findall(run)
        if len(pieces) == 1:
            out = self._piece(run)
        else:
            out = b"".join([self.cache.get(p) or self._piece(p) for p in pieces])
        if len(run) <= LONGEST_CACHED:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[run] = out
        return out

    def encode_chunks(self, text: str) -> Iterator[bytes]:
        """Ids (little-endian unsigned 32-bit) of a text, in chunks."""
        at = 0
        for m in [*self.split_special.finditer(text), None] if self.split_special else [None]:
            yield from self._plain(text[at:m.start() if m else len(text)])
            if m:
                yield self.special[m[0]].to_bytes(4, "little")
                at = m.end()

    def _plain(self, text: str) -> Iterator[bytes]:
        cached, run, at = self.cache.get, self._run, 0
        while at < len(text):
            # a slice ends where a word is followed by a space and a word, so runs do not cross it
            m = self.cut.search(text, at + SLICE) if len(text) - at > SLICE else None
            end = m.end() if m else len(text)
            part = text if not at and end == len(text) else text[at:end]
            yield b"".join([cached(x) or run(x) for x in self.runs.findall(part)])
            at = end

    def decode_chunks(self, chunks: Iterator[bytes]) -> Iterator[str]:
        """Text of id chunks; bytes that are no UTF-8 become U+FFFD."""
        machine, of = codecs.getincrementaldecoder("utf-8")("replace"), self.token_bytes
        for chunk in chunks:
            yield machine.decode(b"".join([of[i] for i in memoryview(chunk).cast("I")]))
        yield machine.decode(b"", True)


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned
    32-bit integers) and ``decoded_sha256`` (of the decoded text in UTF-8), as lowercase hex.

    Each text goes through encoder, decoder and both digests slice by
    slice, so beside the text itself memory does not grow with its length.
    Nulls, added tokens and empty tables as in :func:`round_trip`.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Transducer.at(path)

        def through(text: str) -> tuple[int, str, str]:
            n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()

            def emitted() -> Iterator[bytes]:
                nonlocal n
                for chunk in t.encode_chunks(text):
                    n += len(chunk) // 4
                    ids.update(chunk)
                    yield chunk
            for part in t.decode_chunks(emitted()):
                decoded.update(part.encode())
            return n, ids.hexdigest(), decoded.hexdigest()

        for b in batches:
            rows = [through(x.as_py() or "") for x in b.column(1)]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                                             ["_id", "_n", "_ids", "_text"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")) \
        .mapInArrow(run, f"_id {id_type}, _n bigint, _ids string, _text string") \
        .toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``ids`` (binary: little-endian
    unsigned 32-bit integers), ``decoded`` (the text decoded from ``ids``).

    ``path`` is a byte-level BPE file (JSON) that every worker can read.  Its
    added tokens are found inside texts and decoded as their strings; none is
    added.  Null text counts as empty and gives no tokens.  Repeated rows get
    the same answer; an empty table gives an empty result; other columns are
    not read.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Transducer.at(path)
        for b in batches:
            ids = [list(t.encode_chunks(x or "")) for x in b.column(1).to_pylist()]
            texts = ["".join(t.decode_chunks(iter(x))) for x in ids]
            blobs = [b"".join(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in blobs], pa.int64()), pa.array(blobs, pa.binary()),
                 pa.array(texts, pa.string())], ["_id", "_n", "_ids", "_text"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")) \
        .mapInArrow(run, f"_id {id_type}, _n bigint, _ids binary, _text string") \
        .toDF(id_col, "n_tokens", "ids", "decoded")
