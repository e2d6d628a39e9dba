"""Filter interaction audit: what each of k filters removes under all k! orders.

A row's failures form a mask of k bits, so rows are first counted by (part,
mask); 2^k counts a part are all that the audit needs.  Orders are ranked
lexicographically (their Lehmer codes read as factorial digits).  Orders that
share a prefix then fill one interval of ranks.  A mask leaves at step s by
filter x exactly in the orders that begin with s - 1 filters it passes,
followed by x; each such prefix is one interval of (k - s)! ranks.  The
mask's count is added where the interval starts and taken off where it ends,
in one difference array per step, and a prefix sum over the ranks gives the
removals of every order and step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandcast.llm.common import UPPER, prepare, written

MOST_FILTERS = 8            # k! * k rows a part: 322,560 for eight
_BLANKS = "\t\n\x0b\x0c\r"


def order_of(rank: int, k: int) -> tuple[int, ...]:
    """The order (filter indices) of a lexicographic rank, by the digits of its Lehmer code."""
    left, order = list(range(k)), []
    for i in range(k - 1, -1, -1):
        digit, rank = divmod(rank, math.factorial(i))
        order.append(left.pop(digit))
    return tuple(order)


def rank_of(prefix: tuple[int, ...], k: int) -> int:
    """The smallest rank of an order that begins with ``prefix``."""
    left, rank = list(range(k)), 0
    for s, x in enumerate(prefix):
        digit = left.index(x)
        rank += digit * math.factorial(k - 1 - s)
        left.pop(digit)
    return rank


def intervals(mask: int, k: int) -> Iterator[tuple[int, int, int]]:
    """(step from 0, first rank, rank behind the last) of the orders in which ``mask`` leaves at that step.

    The intervals are disjoint; for a mask with any bit they cover all k! ranks."""
    def grow(prefix: tuple[int, ...]) -> Iterator[tuple[int, int, int]]:
        for x in range(k):
            if x not in prefix:
                path = (*prefix, x)
                if mask >> x & 1:
                    first = rank_of(path, k)
                    yield len(prefix), first, first + math.factorial(k - len(path))
                else:
                    yield from grow(path)
    return grow(()) if mask else iter(())


MEASURES = ("rows", "good", "toxic")


def removals(counts: Mapping[int, tuple[int, ...]], k: int) -> np.ndarray:
    """Rows removed, by measure, rank and step, from the counts of each mask (one number per measure)."""
    diff = np.zeros((len(MEASURES), math.factorial(k) + 1, k), np.int64)
    for mask, n in counts.items():
        for step, first, behind in intervals(mask, k):
            diff[:, first, step] += n
            diff[:, behind, step] -= n
    return np.cumsum(diff, axis=1)[:, :-1]


def audit_counts(masks: DataFrame, names: str) -> DataFrame:
    """The audit from one row per (``part``, ``mask``) with ``rows``, ``good``, ``toxic`` counts.

    ``names`` has one letter per filter, in alphabetical order; bit i of a
    mask belongs to letter i.  A part has at most 2^k rows here, so its group
    is small whatever the size of the corpus."""
    k = len(names)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(group["mask"], group["rows"], group["good"], group["toxic"])}
        removed, good, toxic = removals(counts, k)
        total = sum(n for n, _, _ in counts.values())
        fails = np.array([sum(n for m, (n, _, _) in counts.items() if m >> x & 1) for x in range(k)], np.int64)
        alone = np.array([counts.get(1 << x, (0, 0, 0))[0] for x in range(k)], np.int64)
        order = np.array([order_of(r, k) for r in range(len(removed))])             # filter by rank and step
        shapley = np.bincount(order.ravel(), removed.ravel(), k).astype(np.int64) if total < 1 << 40 else \
            np.array([removed[order == x].sum() for x in range(k)], np.int64)       # float sums are exact up to 2^53
        text = ["".join(names[x] for x in o) for o in order]
        return pd.DataFrame({
            "part": group["part"].iloc[0], "filter_order": np.repeat(text, k), "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(text)),
            "kept": (total - np.cumsum(removed, axis=1)).ravel(), "removed": removed.ravel(),
            "redundant": (fails[order] - removed).ravel(), "unique_fails": alone[order].ravel(),
            "good_lost": good.ravel(), "toxic_lost": toxic.ravel(), "shapley": shapley[order].ravel()})

    return masks.groupBy("part").applyInPandas(
        run, "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
             "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def text_failures() -> dict[str, Column]:
    """The content filters by letter, over a text and the array of its words (neither null)."""
    text, words = F.col("text"), F.col("words")
    hundred = F.lit(100).cast("bigint")
    return {
        "A": F.size(words) < 100,
        "B": hundred * F.size(F.array_distinct(words)) < F.lit(80).cast("bigint") * F.size(words),
        "C": hundred * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 10 * F.length(text).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
    }


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                 content: Mapping[str, Column] | None = None, duplicate: str = "E") -> DataFrame:
    """One row per part, order of the filters and step: see :func:`audit_counts` for the method.

    ``content`` maps letters to conditions over the columns ``text`` and
    ``words`` under which a text fails (default :func:`text_failures`); ``duplicate`` is the letter
    of the filter that fails a text identical to the text of a smaller id
    anywhere in the table.  At most ``MOST_FILTERS`` filters, an error beyond.

    Columns: ``part`` (null: empty string), ``filter_order``, ``step`` (from
    1), ``kept`` after the step, ``removed`` by it, ``redundant`` (failing its
    filter but removed earlier), ``unique_fails`` (failing its filter only),
    ``good_lost`` and ``toxic_lost`` (removed rows whose id has a label row
    with quality 1, toxic 1), ``shapley`` (rows the step's filter removes,
    summed over all orders).

    Null text counts as empty.  A null id is larger than any other and has no
    label; rows repeating both id and text are all as small as each other, so
    the smallest id's repeats do not fail the duplicate filter.  Repeated
    label rows count once (any row decides).  An empty table has no parts and
    gives an empty result; other columns are not read.

    Copies are found by (digest, id) counts: identical texts share a SHA-256
    digest, and their rows are summed by id, part and label before they meet, so
    a text that a third of all rows repeat is a few rows in its group.
    """
    prepare(docs.sparkSession)
    content = text_failures() if content is None else dict(content)
    names = "".join(sorted([*content, duplicate]))
    if len(set(names)) != len(content) + 1 or len(names) > MOST_FILTERS or any(len(x) != 1 for x in [*content, duplicate]):
        raise ValueError(f"filters need different letters, {MOST_FILTERS} at most")
    bits = sum((F.when(c, F.lit(1 << names.index(x))).otherwise(0) for x, c in content.items()), F.lit(0))
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = F.array_remove(F.split(F.translate("text", _BLANKS, " " * len(_BLANKS)), " "), "")
    rows = written(text.withColumn("words", words).select("id", "part", bits.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "filter-masks")
    marks = written(labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")), "filter-labels")
    rows = rows.join(marks, "id", "left").fillna(False, ["good", "toxic"])
    kind = ["digest", "mask", "part", "good", "toxic"]
    by_id = rows.groupBy(*kind, "id").agg(F.count("*").alias("n"))
    smallest = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "n"))
    by_kind = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), smallest.alias("low"))
    first = by_kind.groupBy("digest").agg(F.min(F.struct("low.no_id", "low.id")).alias("first"))
    judged = by_kind.join(first, "digest").withColumn(
        "stay", F.when((F.col("low.no_id") == F.col("first.no_id")) & F.col("low.id").eqNullSafe(F.col("first.id")), F.col("low.n")).otherwise(0))
    bit = 1 << names.index(duplicate)
    counts = judged.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("stay").alias("n")),
        F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))).alias("x"))
    masks = counts.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("rows"), F.sum(F.when(F.col("good"), F.col("x.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("x.n")).otherwise(0)).alias("toxic"))
    return audit_counts(masks, names)
