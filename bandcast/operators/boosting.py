"""Histogram gradient boosting in a barrier stage.

Features are cut at quantiles into at most 255 bins (bin 0: missing) and held
as one byte each, pinned to the task that read them.  All rounds of a job run
inside one barrier stage: every task adds up gradient histograms of its rows per node, the
tasks exchange and add them by ``BarrierTaskContext.allGather``, and
each finds the same splits and grows the same trees.  Rows never move, and
nothing is planned or scheduled per round or per level.

* Gradients are rounded to a fixed point, so sums are exact whatever their
  order: the trees do not depend on the number of tasks or the order of rows.
* Missing values (null, NaN) go the way that gains more at each split.
* A tree sees a sample of the columns and a round a sample of the rows, both
  drawn by hashes (of the seed and round, of the row), so a retried task draws
  the same ones.
* The larger child's histogram is its parent's less its sibling's.
* A job trains ``ROUNDS_PER_JOB`` rounds; the next one starts from
  the trees so far, so a lost executor costs one job at most.

An exchange takes about a second whatever its size (Spark looks once a second whether it is done), and a round
has one for each level, so a job has one task, which exchanges nothing, as long as its rows take ``TASK_BYTES`` at most.
Beyond that rows are shared out (a barrier stage needs a slot per task at once).
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandcast.session import cut_lineage

MAX_BINS = 255              # of values; one more for missing ones
TASK_BYTES = 640 << 20      # of a task's rows in memory
ROUNDS_PER_JOB = 155
EPSILON = 1e-6              # smallest gain of a split
BUNDLE = 1024               # places of a code that counts several columns at once
BLOCK = 1 << 18             # rows taken at a time
SLICE = 1 << 14             # rows whose gradients are made at a time

OBJECTIVES = ("logistic", "squared", "softmax")


@dataclass(frozen=True)
class Params:
    objective: str = "logistic"
    rounds: int = 465
    depth: int = 8
    rate: float = 0.08
    row_share: float = 0.84
    column_share: float = 0.64
    min_child_weight: float = 6.0
    l2: float = 1.0
    classes: int = 1        # trees per round
    seed: int = 42


@dataclass
class Trees:
    """Trees as flat arrays over heap slots: children of slot s are 2s + 1 (left) and 2s + 2."""

    feature: np.ndarray     # [tree, inner slot], -1 for a leaf
    bin: np.ndarray         # rows with a bin up to it go left
    missing_left: np.ndarray
    gain: np.ndarray
    cover: np.ndarray       # sum of second derivatives [tree, slot]
    value: np.ndarray       # [tree, slot], learning rate applied

    @classmethod
    def empty(cls, n: int, depth: int) -> Trees:
        inner, slots = (1 << depth) - 1, (1 << depth + 1) - 1
        return cls(np.full((n, inner), -1, np.int16), np.zeros((n, inner), np.uint8), np.zeros((n, inner), bool),
                   np.zeros((n, inner)), np.zeros((n, slots)), np.zeros((n, slots)))

    def __len__(self) -> int:
        return len(self.feature)

    def arrays(self) -> list[np.ndarray]:
        return [self.feature, self.bin, self.missing_left, self.gain, self.cover, self.value]

    def joined(self, other: Trees) -> Trees:
        return Trees(*(np.concatenate(x) for x in zip(self.arrays(), other.arrays())))

    def leaf(self, tree: int, bins: np.ndarray) -> np.ndarray:
        """The leaf slot of every row of ``bins`` (rows by features, column-wise in memory)."""
        out, flat, n = np.empty(len(bins), np.min_scalar_type(self.value.shape[1])), bins.ravel(order="F"), len(bins)
        moves, depth = _moves(self, tree, np.flatnonzero(self.feature[tree] >= 0), n), self.value.shape[1].bit_length() - 1
        for begin in range(0, n, SLICE):
            slot = np.zeros(min(SLICE, n - begin), np.int64)
            for _ in range(depth):
                slot = _moved(slot, moves, flat, begin)
            out[begin:begin + SLICE] = slot
        return out


def mix(key: np.ndarray, salt: int) -> np.ndarray:
    """A uniform 64-bit hash of 64-bit keys (the SplitMix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = key + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def columns_of_tree(p: Params, n_features: int, round_: int, k: int) -> np.ndarray:
    n = max(1, int(np.ceil(p.column_share * n_features)))
    return np.sort(np.random.default_rng([p.seed, round_, k]).permutation(n_features)[:n])


def rate_of(p: Params, round_: int) -> float:
    """A regression starts from a whole tree instead of the mean alone; all later rounds are shrunk."""
    return 1.0 if p.objective == "squared" and round_ == 0 else p.rate


def gradients(p: Params, y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives [tree of the round, row]."""
    if p.objective == "squared":
        return (margin - y) * w, np.broadcast_to(w, margin.shape)
    if p.objective == "logistic":
        prob = 1.0 / (1.0 + np.exp(-margin))
        return (prob - y) * w, np.maximum(prob * (1.0 - prob), 1e-16) * w
    e = np.exp(margin - margin.max(axis=0))
    prob = e / e.sum(axis=0)
    hit = np.arange(p.classes)[:, None] == y
    return (prob - hit) * w, np.maximum(2.0 * prob * (1.0 - prob), 1e-16) * w


def best_splits(p: Params, g: np.ndarray, h: np.ndarray, starts: np.ndarray, sum_g: np.ndarray, sum_h: np.ndarray):
    """Per node of the histograms [node, bins of all columns in a row]: gain, column, bin, missing left, and the left
    child's sums.  Column j has the places from ``starts[j]`` to ``starts[j + 1]``.

    Ties go to the first column, then the smaller bin, then missing right."""
    n, sizes = len(g), np.diff(starts)
    node, tg, th = np.arange(n), sum_g[:, None], sum_h[:, None]
    whole = tg * tg / (th + p.l2)
    best, column, cut = np.full(n, -np.inf), np.zeros(n, np.int64), np.ones(n, np.int64)
    missing, best_g, best_h = np.zeros(n, bool), np.zeros(n), np.zeros(n)
    none = np.zeros((n, 1))
    g, h = np.concatenate([g, none], axis=1), np.concatenate([h, none], axis=1)     # a place of no rows
    octave = np.ceil(np.log2(sizes) / 2)
    for o in np.unique(octave):         # columns of about as many bins at once; a bin beyond a column's last repeats its gain
        cols = np.flatnonzero(octave == o)
        m = int(sizes[cols].max())
        at = np.where(np.arange(m) < sizes[cols, None], starts[cols, None] + np.arange(m), starts[-1])
        sides = []
        for x in (g, h):
            x = x.take(at, axis=1)
            left = np.empty((n, len(cols), m - 1, 2))
            np.cumsum(x[:, :, 1:], axis=2, out=left[..., 0])
            np.add(left[..., 0], x[:, :, :1], out=left[..., 1])
            sides.append(left.reshape(n, -1))
        lg, lh = sides
        rg, rh = tg - lg, th - lh
        gain = 0.5 * (lg * lg / (lh + p.l2) + rg * rg / (rh + p.l2) - whole)
        gain[(lh < p.min_child_weight) | (rh < p.min_child_weight)] = -np.inf
        i = np.argmax(gain, axis=1)
        top = gain[node, i]
        c, where = cols[i // (2 * (m - 1))], i % (2 * (m - 1))
        more = np.flatnonzero((top > best) | ((top == best) & (c < column)))
        i, where = i[more], where[more]
        best[more], column[more], cut[more], missing[more] = top[more], c[more], where // 2 + 1, where % 2 == 1
        best_g[more], best_h[more] = lg[more, i], lh[more, i]
    return best, column, cut, missing, best_g, best_h


def bundles_of(sizes: Sequence[int], most: int) -> list[list[int]]:
    """Columns put together as long as their bins multiply to ``most`` places at most (a wider column is alone)."""
    out: list[list[int]] = []
    room: list[int] = []
    for j in sorted(range(len(sizes)), key=lambda j: -sizes[j]):
        for i, free in enumerate(room):
            if sizes[j] <= free:
                out[i].append(j)
                room[i] //= sizes[j]
                break
        else:
            out.append([j])
            room.append(most // sizes[j])
    return out


class Counter:
    """Histograms of one tree's columns.

    Columns of few bins are counted together, by a code of all their bins; sums over the places of a code with the
    same bin are the column's histogram.  Values are whole numbers, so these sums are exact."""

    def __init__(self, bins: np.ndarray, columns: np.ndarray, sizes: np.ndarray):
        self.sizes = [int(sizes[f]) for f in columns]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.bundles = bundles_of(self.sizes, min(BUNDLE, len(bins) // 512))        # few rows: more places cost more than they spare
        self.codes, self.places, self.held = [], [], []
        for cols in self.bundles:
            of = [self.sizes[j] for j in cols]
            self.places.append(int(np.prod(of)))
            # [place of the code, bins of the columns in a row]: 1 where the code holds the bin
            self.held.append(np.concatenate([(b[:, None] == np.arange(x)).astype(float) for b, x in
                                             zip(np.unravel_index(np.arange(self.places[-1]), of), of)], axis=1))
            code = bins[:, columns[cols[0]]].astype(np.uint16)
            for j in cols[1:]:
                code *= np.uint16(self.sizes[j])
                code += bins[:, columns[j]]
            self.codes.append(code)

    def add(self, out: list[np.ndarray], rows: np.ndarray, node: np.ndarray, values: Sequence[np.ndarray]) -> None:
        """Add the values of some rows to ``out``: per bundle [value, node * place of the code]."""
        for code, places, o in zip(self.codes, self.places, out):
            at = node * places
            at += code.take(rows)
            for k, x in enumerate(values):
                o[k] += np.bincount(at, x, o.shape[1])

    def empty(self, n_values: int, n_nodes: int) -> list[np.ndarray]:
        return [np.zeros((n_values, n_nodes * places)) for places in self.places]

    def by_column(self, counted: list[np.ndarray], n_nodes: int) -> np.ndarray:
        """[value, node, bins of all columns in a row]"""
        out = np.zeros((len(counted[0]), n_nodes, int(self.starts[-1])))
        for cols, held, c in zip(self.bundles, self.held, counted):
            if len(cols) == 1:
                out[:, :, self.starts[cols[0]]:self.starts[cols[0] + 1]] = c.reshape(len(out), n_nodes, -1)
                continue
            sums, begin = c.reshape(len(out) * n_nodes, -1) @ held, 0
            for j in cols:
                size = self.sizes[j]
                out[:, :, self.starts[j]:self.starts[j + 1]] = sums[:, begin:begin + size].reshape(len(out), n_nodes, size)
                begin += size
        return out


def grow_round(p: Params, round_: int, bins: np.ndarray, sizes: np.ndarray, g: np.ndarray, h: np.ndarray, sampled: np.ndarray,
               scale: float, add: Callable[[np.ndarray], np.ndarray]) -> tuple[Trees, np.ndarray]:
    """The trees of one round, level by level and all at once, and every row's leaf value in each.

    ``g`` and ``h`` are whole numbers (times ``scale``); ``sizes`` are the numbers of bins by feature; ``add`` sums an
    array over all tasks.  Rows are taken in blocks, so what is made of them on the way stays small."""
    k_trees, (n, n_features) = len(g), bins.shape
    trees = Trees.empty(k_trees, p.depth)
    slots_all = trees.cover.shape[1]
    at = np.zeros((k_trees, n), np.min_scalar_type(slots_all))
    flat_bins = bins.ravel(order="F")           # a view of column-wise bins
    columns = [columns_of_tree(p, n_features, round_, k) for k in range(k_trees)]
    sums = add(np.stack([g @ sampled, h @ sampled]))
    total_g, total_h = np.zeros_like(trees.cover), np.zeros_like(trees.cover)
    total_g[:, 0], total_h[:, 0] = sums
    open_ = [np.zeros(1, np.int64) for _ in range(k_trees)]     # slots of the level that may split
    kept: list[dict[int, np.ndarray]] = [{} for _ in range(k_trees)]       # the parents' histograms
    moves: list[tuple[np.ndarray, ...] | None] = [None] * k_trees   # of rows to the children, not made yet
    counters = [Counter(bins, c, sizes) for c in columns]
    alike = [n > 0 and x.min() == x.max() for x in h]           # a count of rows gives the sums of h
    for _ in range(p.depth):
        if not any(len(o) for o in open_):
            break
        counted = []
        for k in range(k_trees):
            # of two siblings the one of less weight is counted (the left one in a tie), the other is the rest
            light = [s for s in open_[k] if s == 0 or total_h[k, s] < total_h[k, s + 1 if s % 2 else s - 1]
                     or (total_h[k, s] == total_h[k, s + 1 if s % 2 else s - 1] and s % 2)]
            # a light sibling that is closed itself must be counted for the open one
            light = sorted({*light, *(s + 1 if s % 2 else s - 1 for s in open_[k] if s and s not in light)})
            place = np.full(slots_all, -1)
            place[light] = np.arange(len(light))
            counter, same = counters[k], alike[k]
            if not light:
                counted.append((light, np.zeros((2, 0, counter.starts[-1])), counter.starts))
                continue
            c = counter.empty(2, len(light))
            for begin in range(0, n, BLOCK):
                span = slice(begin, min(begin + BLOCK, n))
                slot = at[k, span].astype(np.int64)
                if moves[k] is not None:
                    slot = _moved(slot, moves[k], flat_bins, begin)
                    at[k, span] = slot
                node = place.take(slot)
                rows = np.flatnonzero((node >= 0) & sampled[span])
                node, rows = node.take(rows), rows + begin
                counter.add(c, rows, node, [g[k].take(rows), None if same else h[k].take(rows)])
            moves[k] = None
            c = counter.by_column(c, len(light))
            if same:
                c[1] *= h[k, 0]
            counted.append((light, c, counter.starts))
        flat = add(np.concatenate([c.ravel() for _, c, _ in counted]))
        opened, begin = [], 0
        for k, (light, c, starts) in enumerate(counted):
            whole = flat[begin:begin + c.size].reshape(c.shape)
            begin += c.size
            hist = {s: whole[:, i] for i, s in enumerate(light)}
            for s in open_[k]:
                if s not in hist:
                    hist[s] = kept[k][(s - 1) // 2] - hist[s + 1 if s % 2 else s - 1]
            slots = open_[k]
            children: list[int] = []
            if len(slots):
                both = np.stack([hist[s] for s in slots], axis=1) / scale
                gain, f, b, missing, lg, lh = best_splits(p, both[0], both[1], starts, total_g[k, slots] / scale, total_h[k, slots] / scale)
                for i in np.flatnonzero(gain > EPSILON):
                    s = slots[i]
                    trees.feature[k, s], trees.bin[k, s], trees.missing_left[k, s], trees.gain[k, s] = columns[k][f[i]], b[i], missing[i], gain[i]
                    total_g[k, 2 * s + 1], total_h[k, 2 * s + 1] = lg[i] * scale, lh[i] * scale
                    total_g[k, 2 * s + 2], total_h[k, 2 * s + 2] = total_g[k, s] - lg[i] * scale, total_h[k, s] - lh[i] * scale
                    children += [2 * s + 1, 2 * s + 2]
                if children:
                    moves[k] = _moves(trees, k, slots[gain > EPSILON], n)
            kept[k] = {s: hist[s] for s in slots}
            # a child too light to be parted is a leaf
            opened.append(np.array([s for s in children if total_h[k, s] / scale >= 2 * p.min_child_weight], np.int64))
        open_ = opened
    trees.cover[:] = total_h / scale
    made = (trees.cover > 0) | (total_g != 0)
    trees.value[made] = -rate_of(p, round_) * (total_g[made] / scale) / (trees.cover[made] + p.l2)
    step = np.empty((k_trees, n))
    for k in range(k_trees):
        for begin in range(0, n, BLOCK):
            span = slice(begin, min(begin + BLOCK, n))
            slot = at[k, span].astype(np.int64)
            if moves[k] is not None:
                slot = _moved(slot, moves[k], flat_bins, begin)
            step[k, span] = trees.value[k].take(slot)
    return trees, step


def _moves(trees: Trees, k: int, parted: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Per slot: the place of its feature's bins in the column-wise bins of ``n`` rows, the left child, what is taken off
    a bin, and the last bin that goes left.  Rows of slots that are not parted stay."""
    slots = trees.cover.shape[1]
    first, child = np.zeros(slots, np.int64), np.arange(slots)
    first[parted] = trees.feature[k, parted].astype(np.int64) * n
    child[parted] = 2 * parted + 1
    # where missing values (0) go right, all bins are taken down by 1, so missing ones become 255
    down, most = np.zeros(slots, np.uint8), np.full(slots, 255, np.uint8)
    down[parted] = ~trees.missing_left[k, parted]
    most[parted] = trees.bin[k, parted] - down[parted]
    return first, child, down, most


def _moved(slot: np.ndarray, moves: tuple[np.ndarray, ...], flat_bins: np.ndarray, begin: int) -> np.ndarray:
    first, child, down, most = moves
    place = first.take(slot)
    place += np.arange(begin, begin + len(slot))
    right = flat_bins.take(place) - down.take(slot) > most.take(slot)
    out = child.take(slot)
    out += right
    return out


def boost(p: Params, first_round: int, rounds: int, trees: Trees, base: np.ndarray, bins: np.ndarray, n_bins: int | Sequence[int],
          y: np.ndarray, w: np.ndarray, key: np.ndarray, scale: float, add: Callable[[np.ndarray], np.ndarray]) -> Trees:
    """The trees of ``rounds`` more rounds over this task's rows; ``n_bins`` for all features or by feature."""
    sizes, bins = np.broadcast_to(n_bins, bins.shape[1:]), np.asfortranarray(bins)
    margin = np.repeat(np.asarray(base, float)[:, None], len(y), axis=1)
    for t in range(len(trees)):
        margin[t % len(base)] += trees.value[t, trees.leaf(t, bins)]
    made, g, h, sampled = [], np.empty_like(margin), np.empty_like(margin), np.empty(len(y), bool)
    limit = np.uint64(min(int(p.row_share * 2.0 ** 64), (1 << 64) - 1))
    for r in range(first_round, first_round + rounds):
        for begin in range(0, len(y), SLICE):
            span = slice(begin, begin + SLICE)
            sampled[span] = mix(key[span], p.seed * 1_000_003 + r) <= limit
            for out, x in zip((g, h), gradients(p, y[span], w[span], margin[:, span])):
                np.rint(x * scale, out=out[:, span])
        new, step = grow_round(p, r, bins, sizes, g, h, sampled, scale, add)
        margin += step
        made.append(new)
    return Trees(*(np.concatenate(x) for x in zip(*(t.arrays() for t in made)))) if made else Trees.empty(0, p.depth)


# Exchange between tasks ------------------------------------------------------------
def pack(x: np.ndarray) -> str:
    """The places and values other than zero, compressed."""
    flat = x.ravel()
    at = np.flatnonzero(flat)
    return base64.b64encode(zlib.compress(at.astype(np.int64).tobytes() + flat[at].astype(np.int64).tobytes(), 1)).decode()


def unpack(message: str, shape: tuple[int, ...]) -> np.ndarray:
    raw = zlib.decompress(base64.b64decode(message))
    both = np.frombuffer(raw, np.int64).reshape(2, -1)
    out = np.zeros(int(np.prod(shape)))
    out[both[0]] = both[1]
    return out.reshape(shape)


def sum_over_tasks(x: np.ndarray) -> np.ndarray:
    """The sum of an array of whole numbers over the tasks of the barrier stage."""
    return sum((unpack(m, x.shape) for m in BarrierTaskContext.get().allGather(pack(x))), np.zeros(x.shape))


# Model -------------------------------------------------------------------------------
@dataclass
class BoostedModel:
    params: Params
    features: list[str]
    edges: list[list[float]]        # upper ends of the bins, by feature
    base: list[float]               # margins before the first tree
    trees: Trees = field(repr=False)

    def bins(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        return to_bins(self.edges, columns)

    def margins(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """[tree of a round, row]"""
        bins = self.bins(columns)
        out = np.repeat(np.asarray(self.base, float)[:, None], len(bins), axis=1)
        for t in range(len(self.trees)):
            out[t % len(self.base)] += self.trees.value[t, self.trees.leaf(t, bins)]
        return out

    def predict(self, columns: Sequence[np.ndarray], kind: str) -> np.ndarray:
        """``prob``: of class 1; ``value``: the regression's; ``class``: the likeliest."""
        m = self.margins(columns)
        if kind == "class":
            return (np.argmax(m, axis=0) if self.params.objective == "softmax" else m[0] > 0).astype(float)
        if kind == "value":
            return m[0]
        if self.params.objective == "softmax":
            e = np.exp(m - m.max(axis=0))
            return (e / e.sum(axis=0))[1]
        return 1.0 / (1.0 + np.exp(-m[0]))

    def importance(self) -> np.ndarray:
        """Mean gain of a feature's splits, as shares that add up to 1 (0 for features never used)."""
        used = self.trees.feature >= 0
        f = self.trees.feature[used].astype(int)
        n = np.bincount(f, minlength=len(self.features))
        mean = np.bincount(f, self.trees.gain[used], len(self.features)) / np.maximum(n, 1)
        return mean / mean.sum() if len(f) else mean

    # A model is a bounded table of nodes (rounds x classes x slots) and one JSON row.
    def save(self, spark: SparkSession, path: str) -> None:
        t = self.trees
        tree, slot = np.nonzero((t.cover > 0) | (t.value != 0))
        inner = t.feature.shape[1]
        i = np.minimum(slot, inner - 1)
        pick = lambda x, none: np.where(slot < inner, x[tree, i], none)
        nodes = pa.table({"tree": tree.astype(np.int32), "slot": slot.astype(np.int32), "feature": pick(t.feature, -1).astype(np.int32),
                          "bin": pick(t.bin, 0).astype(np.int32), "missing_left": pick(t.missing_left, False).astype(bool),
                          "gain": pick(t.gain, 0.0), "cover": t.cover[tree, slot], "value": t.value[tree, slot]})
        meta = {"params": self.params.__dict__, "features": self.features, "edges": self.edges, "base": self.base, "trees": len(t)}
        spark.createDataFrame(nodes).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "nodes"))
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "meta"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
        p = Params(**meta["params"])
        trees = Trees.empty(meta["trees"], p.depth)
        n = {c.name: x.to_numpy(zero_copy_only=False) for c, x in _columns(spark.read.parquet(os.path.join(path, "nodes")).toArrow())}
        trees.cover[n["tree"], n["slot"]], trees.value[n["tree"], n["slot"]] = n["cover"], n["value"]
        inner = n["slot"] < trees.feature.shape[1]
        t, s = n["tree"][inner], n["slot"][inner]
        for name in ("feature", "bin", "missing_left", "gain"):
            getattr(trees, name)[t, s] = n[name][inner]
        return cls(p, meta["features"], meta["edges"], meta["base"], trees)


def _columns(table: pa.Table) -> Iterator[tuple[pa.Field, pa.ChunkedArray]]:
    return zip(table.schema, table.columns)


def to_bins(edges: Sequence[Sequence[float]], columns: Sequence[np.ndarray]) -> np.ndarray:
    """Rows by features, one byte each: 0 for missing, else 1 + the number of edges below the value."""
    out = np.empty((len(columns[0]) if columns else 0, len(columns)), np.uint8, order="F")
    for j, (e, x) in enumerate(zip(edges, columns)):
        x = np.asarray(x, float)
        out[:, j] = np.where(np.isnan(x), 0, np.searchsorted(np.asarray(e, float), x, side="left") + 1)
    return out


def bin_edges(df: DataFrame, features: Sequence[str], accuracy: int = 10_000) -> list[list[float]]:
    """Distinct quantiles of every feature (a column of doubles), at most ``MAX_BINS - 1``; one aggregate, one row."""
    shares = F.array(*[F.lit(i / MAX_BINS) for i in range(1, MAX_BINS)])
    row = df.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), shares, accuracy).alias(c) for c in features]).first()
    return [sorted(set(row[c] or [])) for c in features]


def row_bytes(p: Params, n_features: int) -> int:
    """About what a row takes in training: bins, label, weight, key and places; margin, derivatives and codes of each tree of a round."""
    return n_features + 64 + 48 * p.classes


def train(df: DataFrame, features: Sequence[str], label_col: str, weight: str | None, params: Params,
          rows_per_task: int | None = None, rounds_per_job: int = ROUNDS_PER_JOB, tasks: int | None = None) -> BoostedModel:
    """Train on all rows of ``df`` that have a label (rows without a weight weigh 0).

    ``tasks`` fixes the number of tasks; by default it is rows / ``rows_per_task`` (as many as take ``TASK_BYTES``), at
    most the session's slots.  No row, or equal labels everywhere, gives a model of its base margin."""
    spark, features = df.sparkSession, list(features)
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"f{j}") for j, c in enumerate(features)]
    data = df.filter(F.col(label_col).isNotNull()).select(*cols, F.col(label_col).cast("double").alias("y"), w.alias("w"))
    data = data.withColumn("key", F.xxhash64(*data.columns))
    numbered = [f"f{j}" for j in range(len(features))]
    stats = [F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("y") * F.col("w")).alias("wy"),
             F.min("y").alias("low"), F.max("y").alias("high"), F.max("w").alias("top")]
    data = cut_lineage(data)
    s = data.agg(*stats).first()
    p = params
    if p.objective == "softmax":
        p = replace(p, classes=max(p.classes, int(s.high or 0) + 1, 2))
    base = [0.0] * (p.classes if p.objective == "softmax" else 1)
    if s.n and s.w:
        mean = s.wy / s.w
        if p.objective == "squared":
            base = [mean]
        elif p.objective == "logistic":
            mean = min(max(mean, 1e-6), 1 - 1e-6)
            base = [float(np.log(mean / (1 - mean)))]
    model = BoostedModel(p, features, [[] for _ in features], base, Trees.empty(0, p.depth))
    if not s.n or not s.w:
        return model
    model.edges = [list(map(float, e)) for e in bin_edges(data, numbered)]
    slots = spark.sparkContext.defaultParallelism
    n_tasks = tasks or max(1, min(slots, -(-s.n // (rows_per_task or TASK_BYTES // row_bytes(p, len(features))))))
    data = cut_lineage(data.repartition(n_tasks, "key")) if n_tasks > 1 else data.coalesce(1)
    # whole numbers below 2^53 in every sum, with room for a margin beyond the labels
    reach = 4.0 * max(1.0, float(s.high - s.low))
    scale = 2.0 ** min(40, int(np.floor(52 - np.log2(max(1.0, s.w) * reach))))
    for first in range(0, p.rounds, rounds_per_job):
        step = _job(spark, model, first, min(rounds_per_job, p.rounds - first), scale, n_tasks)
        got = data.mapInArrow(step, "part int, body binary", barrier=n_tasks > 1).toArrow()     # the trees of one task, bounded
        body = got.column("body").to_pylist()[0]
        model.trees = model.trees.joined(_from_bytes(body, p.depth))
    return model


def _job(spark: SparkSession, model: BoostedModel, first: int, rounds: int, scale: float, n_tasks: int):
    p, edges, base, so_far = model.params, model.edges, model.base, model.trees
    n_bins = [len(e) + 2 for e in edges]
    shared = spark.sparkContext.broadcast(so_far.arrays())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, y, w, key = [np.empty((0, len(edges)), np.uint8)], [np.empty(0)], [np.empty(0)], [np.empty(0, np.uint64)]
        for b in batches:
            x = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            bins.append(to_bins(edges, x[:-3]))
            y.append(x[-3].astype(float))
            w.append(x[-2].astype(float))
            key.append(x[-1].astype(np.int64).view(np.uint64))
        add = sum_over_tasks if n_tasks > 1 else (lambda a: a)
        made = boost(p, first, rounds, Trees(*shared.value), np.array(base), np.asfortranarray(np.concatenate(bins)), n_bins,
                     np.concatenate(y), np.concatenate(w), np.concatenate(key), scale, add)
        part = BarrierTaskContext.get().partitionId() if n_tasks > 1 else 0
        if part == 0:
            yield pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int32()), "body": pa.array([_to_bytes(made)], pa.binary())})
    return step


def _to_bytes(t: Trees) -> bytes:
    return zlib.compress(b"".join(a.tobytes() for a in t.arrays()), 1)


def _from_bytes(raw: bytes, depth: int) -> Trees:
    raw, like = zlib.decompress(raw), Trees.empty(1, depth).arrays()
    n, at, out = len(raw) // sum(a.nbytes for a in like), 0, []
    for a in like:
        out.append(np.frombuffer(raw, a.dtype, n * a.size, at).reshape(n, -1).copy())
        at += n * a.nbytes
    return Trees(*out)


# Scoring -------------------------------------------------------------------------------
def score_column(spark: SparkSession, model: BoostedModel, kind: str) -> Column:
    """The model's prediction from the feature columns of a frame, vectorised per Arrow batch."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        m = shared.value
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)     # a single column comes bare
            yield pd.Series(m.predict([c.to_numpy(float) for c in columns], kind))

    return predict(*[F.col(c).cast("double") for c in model.features])


def cascade_column(spark: SparkSession, gate: BoostedModel, router: BoostedModel, down: BoostedModel, up: BoostedModel,
                   gate_threshold: float = 0.25, router_threshold: float = 0.5) -> Column:
    """All stages in one pass: struct of gate probability, router probability, and the magnitude by the specialist of
    the row's way (clipped at 0; 0 for rows the gate stops).  Each row meets the gate, the router and one specialist once."""
    shared = spark.sparkContext.broadcast((gate, router, down, up))
    names = list(dict.fromkeys(f for m in (gate, router, down, up) for f in m.features))

    @F.pandas_udf("gate double, router double, magnitude double")
    def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        models = shared.value
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            x = dict(zip(names, (c.to_numpy(float) for c in columns)))
            of = lambda m, kind, rows=slice(None): m.predict([x[f][rows] for f in m.features], kind)  # noqa: B023, E731
            g, r = of(models[0], "prob"), of(models[1], "prob")
            magnitude = np.zeros(len(g))
            for m, way in ((models[2], r >= router_threshold), (models[3], r < router_threshold)):
                rows = np.flatnonzero((g >= gate_threshold) & way)
                if len(rows):
                    magnitude[rows] = np.maximum(of(m, "value", rows), 0.0)
            yield pd.DataFrame({"gate": g, "router": r, "magnitude": magnitude})

    return predict(*[F.col(c).cast("double") for c in names])
