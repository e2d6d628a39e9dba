"""Fill-in-middle: a text is cut in three and put together as prefix, suffix, middle.

Cuts are counted in units (code points, words or lines) but made in bytes.
Each byte of a batch's texts has one of eight classes; a wavelet matrix over
the classes (three bit vectors with rank counts) answers how many bytes below
a position have a class in a range.  Classes are numbered so that the bytes
that begin a unit form a range, and rank queries combine into the number of
units that begin in a stretch.  A cut after c units lies where that number
first exceeds c; bisection on the ranks finds it, for all texts of a batch at
once, without a list of units per text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bandcast.llm.common import prepare

MARKS = ("<P>", "<S>", "<M>")

# Classes of a byte.  A code point begins in classes 2 to 7; a word (a run that is not blank, with
# the blanks before it) in class 4 or 6, after a blank; a line in class 6 or 7, behind a line end.
REST, UNUSED, BLANK, INNER, WORD, SPARE, LINE_WORD, LINE_BLANK = range(8)
BITS = 3
UNITS = {"char": ((2, 8),), "word": ((WORD, WORD + 1), (LINE_WORD, LINE_WORD + 1)), "line": ((6, 8),)}

SLICE_BYTES = 8 << 20       # texts indexed together; a longer text has a matrix of its own

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


def byte_classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of every byte of concatenated UTF-8 texts that begin at ``starts``."""
    blank = _IS_BLANK[data]
    after_blank, after_line = np.empty_like(blank), np.empty_like(blank)
    after_blank[1:], after_line[1:] = blank[:-1], data[:-1] == 10
    begin = starts[starts < len(data)]
    after_blank[begin] = after_line[begin] = True
    out = np.where(blank, BLANK, np.where(after_blank, WORD, INNER)).astype(np.uint8)
    out[after_line & blank] = LINE_BLANK
    out[after_line & ~blank] = LINE_WORD
    out[(data & 0xC0) == 0x80] = REST
    return out


class Ranks:
    """A bit vector that counts its ones below a position: 64-bit words and their running totals."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(packed) // 8 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank queries over a sequence of classes (0 to 7)."""

    def __init__(self, classes: np.ndarray):
        self.n, self.levels = len(classes), []
        for bit in range(BITS - 1, -1, -1):
            ones = (classes >> bit & 1).astype(bool)
            self.levels.append((bit, Ranks(ones), self.n - int(np.count_nonzero(ones))))
            classes = np.concatenate([classes[~ones], classes[ones]])

    def below(self, bound: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` classes are smaller than ``bound``."""
        if bound >= 1 << BITS:
            return at.copy()
        low, high, total = np.zeros_like(at), at.copy(), np.zeros_like(at)
        for bit, ranks, zeros in self.levels:
            low1, high1 = ranks.ones(low), ranks.ones(high)
            if bound >> bit & 1:
                total += (high - high1) - (low - low1)
                low, high = zeros + low1, zeros + high1
            else:
                low, high = low - low1, high - high1
        return total

    def within(self, ranges: tuple[tuple[int, int], ...], at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` classes lie in one of the (disjoint) ranges."""
        return sum((self.below(b, at) - (self.below(a, at) if a else 0) for a, b in ranges), np.zeros_like(at))


class Boundaries:
    """Units of all texts of a batch."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, unit: str):
        self.matrix, self.ranges = WaveletMatrix(byte_classes(data, starts)), UNITS[unit]
        self.starts, self.ends = starts, ends
        self.first = self.matrix.within(self.ranges, starts)
        self.n = self.matrix.within(self.ranges, ends) - self.first

    def cut(self, units: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The byte behind the first ``units`` units of each of ``rows``: the last position with no more begun."""
        low, high, limit = self.starts[rows], self.ends[rows], self.first[rows] + units
        while (open_ := low < high).any():
            middle = low + (high - low + 1) // 2
            fits = self.matrix.within(self.ranges, middle) <= limit
            low, high = np.where(open_ & fits, middle, low), np.where(open_ & ~fits, middle - 1, high)
        return low


def slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and UTF-8 texts of a batch, in runs of about ``SLICE_BYTES``."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
        ids.append(i)
        texts.append(t.as_py().encode())
        size += len(texts[-1])
        if size >= SLICE_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def draws(seed: str, ids: list) -> np.ndarray:
    """Four unsigned 32-bit numbers per id: the first four 8-digit groups of the SHA-256 of ``seed:id``."""
    blob = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(blob, ">u4").reshape(-1, 4).astype(np.int64)


def assemble(data: memoryview, start: int, one: int, two: int, end: int, form: str) -> str:
    """The output of a text cut at bytes ``one`` and ``two``."""
    p, m, s = (str(data[a:b], "utf-8") for a, b in ((start, one), (one, two), (two, end)))
    mark_p, mark_s, mark_m = MARKS
    if form == "psm":
        return f"{mark_p}{p}{mark_s}{s}{mark_m}{m}"
    return f"{mark_s}{s}{mark_p}{p}{mark_m}{m}" if form == "spm" else p + m + s


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: str = "1",
                   rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """One row per input row: id, ``n`` (units), ``form``, ``prefix_units``/``middle_units`` and
    ``prefix_chars``/``middle_chars`` (null if plain), ``output``.

    With four numbers drawn from the id, the prefix ends after the smaller of
    ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units and the middle after the
    larger.  ``form`` is ``plain`` if the text is empty or holds a mark, or
    if ``h3 % 100 >= rate``; else ``spm`` if ``h4 % 100 < spm_rate``, else
    ``psm``.  ``unit`` is ``char`` (code points), ``word`` (a word and the
    blanks behind it; blanks before the first word count to the prefix) or
    ``line`` (with its line end).

    Null text counts as empty (plain, empty output); a null id draws as an
    empty one; rows with the same id and text get the same answer.  An empty
    table gives an empty result; other columns are not read.
    """
    prepare(docs.sparkSession)
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    frame = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    id_type = docs.schema[id_col].dataType.simpleString()
    id_arrow = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in (x for b in batches for x in slices(b)):
            data = b"".join(texts)
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            starts = ends - np.array([len(t) for t in texts], np.int64)
            view, bytes_ = memoryview(data), np.frombuffer(data, np.uint8)
            h = draws(seed, ids)
            marked = np.array([not t or any(m.encode() in t for m in MARKS) for t in texts], bool)
            plain = marked | (h[:, 2] % 100 >= rate)
            units = Boundaries(bytes_, starts, ends, unit)
            chars = units if unit == "char" else Boundaries(bytes_, starts, ends, "char")
            c = np.sort(h[:, :2] % (units.n + 1)[:, None], axis=1)
            rows = np.flatnonzero(~plain)
            one, two = starts.copy(), starts.copy()
            one[rows], two[rows] = units.cut(c[rows, 0], rows), units.cut(c[rows, 1], rows)
            at_one, at_two = chars.matrix.within(UNITS["char"], one), chars.matrix.within(UNITS["char"], two)
            form = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm_rate, "spm", "psm")).tolist()
            out = [assemble(view, *cut, f) for *cut, f in zip(starts.tolist(), one.tolist(), two.tolist(), ends.tolist(), form)]
            nullable = lambda x: pa.array(x, pa.int64(), mask=plain)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_arrow), pa.array(units.n), pa.array(form, pa.string()), nullable(c[:, 0]), nullable(c[:, 1] - c[:, 0]),
                 nullable(at_one - chars.first), nullable(at_two - at_one), pa.array(out, pa.string())],
                ["_id", "n", "form", "prefix_units", "middle_units", "prefix_chars", "middle_chars", "output"])

    made = frame.mapInArrow(run, f"_id {id_type}, n bigint, form string, prefix_units bigint, middle_units bigint, "
                                 "prefix_chars bigint, middle_chars bigint, output string")
    return made.withColumnRenamed("_id", id_col)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text behind an output, from the output and its form alone.

    A text that holds a mark is plain, and no mark can arise across the edge
    of a piece, so the first place of a mark is its own."""
    o, (mark_p, mark_s, mark_m) = F.col(output), MARKS

    def pieces(outer: str, inner: str) -> tuple[Column, Column, Column]:
        body = F.substring(o, F.lit(len(outer) + 1), F.length(o))
        cut = F.locate(inner, body)
        head, tail = F.substring(body, F.lit(1), cut - 1), F.substring(body, cut + len(inner), F.length(body))
        last = F.locate(mark_m, tail)
        return head, F.substring(tail, F.lit(1), last - 1), F.substring(tail, last + len(mark_m), F.length(tail))

    prefix, suffix, middle = pieces(mark_p, mark_s)
    suffix2, prefix2, middle2 = pieces(mark_s, mark_p)
    return (F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix))
            .when(F.col(form) == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(o))
