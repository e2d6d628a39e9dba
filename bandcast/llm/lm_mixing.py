"""Language-model scoring by logistic context mixing.

A text is lower-cased (A-Z) and split into words; each word, and the end of
the text, is coded by binary decisions, so the model's probability of a text
is the product of its bits' probabilities.  A frequent word is coded by its
class (half an octave of its rank, and its group) by a Huffman code; within the
class it has its share of the training counts.  Other words are escaped and
spelled: every byte, and the word's end, by a Huffman code; the spelled
probability is mixed (Witten-Bell) with the word's share of all escaped
training words, whose counts come from a table that grows with the corpus and
is joined to the words that texts hold.  A word's group is
the label (such as the language) of the training texts that use it most; labels
are read in training only, and without them all words are one group.

Every bit is predicted by the code's own odds and by two counters found by a
hashed context: for words the word before and the groups of the four words
before, for bytes three and five bytes before, as far as the word's start.  The log odds
are mixed by weights that a gate selects (how much evidence both counters
have seen), and an adaptive table refines the mixed probability by what was
really seen at that gate and level.

Training reads every training text once for word counts and once for the
model.  In the second pass each task runs online: it predicts a block of
bits with the counters it has so far, corrects the weights by the errors,
then counts the bits.  Counters and refinement counts of all tasks are
added up and weights averaged by the bits that trained them, in two levels.
Scoring does not change the model, so a text's score depends on
nothing but the text.  Contexts restart every ``SLICE`` bytes of a long text.

What the word before says is kept whole, in a table that grows with the corpus:
how often each class follows each word (a row per word, hashed in 64 bits;
the most frequent words' rows are split by class).
While a task trains, its own split's counts share a hashed table; scoring reads
the whole corpus's counts.  Texts are scored in chunks: a chunk asks for the words it holds, the join
sends their counts to the chunk, and the counts below a node of the code are
its zeros and ones.  The most frequent words' counts are broadcast
(``HOT_CELLS`` numbers at most), so no word is asked for by every chunk; a word seen once or twice is always joined.  The other contexts (groups,
and bytes inside a word) have few values and share tables of a fixed size.

Words are known by 64-bit hashes, computed for a whole group of texts at
once from a running polynomial, so two words are confused with a
probability of about 2**-64 a pair.  An exact unigram baseline stands beside the score: the
counts of frequent words are in the model, and a rare word occurs as often as it is followed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandcast.llm.common import LOWER_BYTES, give_back, id_crc_mod, most_frequent, prepare, written

HOLD_OUT = 7, 2                 # crc32(id) mod 7 == 2 is held out
VOCABULARY = 1 << 21            # frequent words that are coded by class (17 bytes each in the broadcast)
SLOT_BITS = 20                  # counters per hashed context: 2**20
TABLES = 4                      # two contexts of words, two of bytes
ORDERS = 3, 5                   # bytes before, for the contexts of spelled words
BLOCK = 1 << 12                 # words (or spelled bytes) predicted at a time
SLICE = 1 << 20                 # bytes of text gathered before that; longer texts are cut between words
SETS, LEVELS = 32, 33           # weight sets (16 for words, 16 for bytes), refinement levels
HOT_CELLS = 6 << 20             # counts of the most frequent words before, in the broadcast (6 bytes each)
HOT_LEAST = 3                   # rarer words are in two chunks of training texts at most: they are joined, not sent to every task
SALTED, SALTS = 1 << 12, 8      # words whose followers are counted in parts (by class), and their parts
LARGE_BITS = 44                 # a follower is one number, its class above its count: 31 bits, or 63 with a count of these bits
CHUNK = 1 << 25                 # bytes of text scored as one group
CELL = 1 << 13                  # counters sent as one cell
ESCAPE, END, FIRST = 0, 1, 2    # classes: escape, end of text, then words
HISTORY = 4                     # groups before a word
STOP = 256                      # byte symbol that ends a spelled word
_GATHER = 1 << 22               # words counted before they are sent
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_END_HASH = np.uint64(0x5851F42D4C957F2D)
_HALF = np.int64(1 << 32)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PIECE = 1 << 15                # bytes hashed at a time: their temporaries stay in a core's cache
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number modulo 2**64."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


_BASE = int(_C[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWER, _BACK = _powers(_BASE, _PIECE), _powers(_INVERSE, _PIECE)


class Words:
    """The words of a group of byte texts: places and hashes."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.raw = np.frombuffer(joined.translate(LOWER_BYTES), np.uint8)
        space = (self.raw == 32) | (self.raw - np.uint8(9) < 5)
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        pieces = -(-len(self.raw) // _PIECE)
        power, back = (_powers(pow(b, _PIECE, 1 << 64), pieces) for b in (_BASE, _INVERSE))    # where each piece begins
        total, before = np.zeros(len(edge), np.uint64), np.zeros(1, np.uint64)      # the running polynomial at the edges
        cut = np.searchsorted(edge, np.arange(pieces + 1) * _PIECE)
        x = np.zeros(_PIECE + 1, np.uint64)
        for k in range(pieces):
            raw, here = self.raw[k * _PIECE:(k + 1) * _PIECE], slice(cut[k], cut[k + 1])
            y = x[:len(raw) + 1]
            np.multiply(_BYTE.take(raw), _POWER[:len(raw)], out=y[1:])
            np.cumsum(y, out=y)
            total[here] = y.take(edge[here] - k * _PIECE) * power[k] + before
            before = y[-1:] * power[k] + before
        h = (total[1::2] - total[0::2]) * back.take(self.start // _PIECE) * _BACK.take(self.start % _PIECE)
        h = (h ^ (h >> np.uint64(29))) * _C[1]
        self.hash = (h ^ (h >> np.uint64(32))) * _C[2]
        offset = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.words = np.diff(np.searchsorted(self.start, offset))          # per text
        self.bytes = np.add.reduceat(np.concatenate([self.end - self.start, [0]]), np.minimum(
            np.searchsorted(self.start, offset[:-1]), len(self.start))) * (self.words > 0) if len(texts) else np.zeros(0, int)

    def sequence(self, ends: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all symbols (with an end after each text), the text of each, and which are words."""
        n = len(self.words)
        size = self.words + int(ends)
        of = np.repeat(np.arange(n), size)
        word = np.ones(len(of), bool)
        if ends:
            word[np.cumsum(size) - 1] = False
        h = np.full(len(of), _END_HASH, np.uint64)
        h[word] = self.hash
        return h, of, word


def slices(text: bytes) -> list[bytes]:
    """A text in slices of about ``SLICE`` bytes, cut at white space."""
    if len(text) <= SLICE:
        return [text]
    out, at = [], 0
    while at < len(text):
        cut = at + SLICE
        while cut < len(text) and text[cut] not in b" \t\n\x0b\x0c\r":
            cut += 1
        out.append(text[at:cut])
        at = cut
    return out


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[bytes], list, bool]]:
    """(texts, their rows, ends): texts in groups of about ``SLICE`` bytes.  The
    slices of a longer text come alone; only the last one has an end."""
    texts, rows, n = [], [], 0
    for b in batches:
        for i, text in enumerate(b.column(column).to_pylist()):
            parts = slices((text or "").encode())
            if len(parts) > 1:
                for k, part in enumerate(parts):
                    yield [part], [(b, i)], k == len(parts) - 1
                continue
            texts += parts
            rows.append((b, i))
            n += len(parts[0]) + 1
            if n >= SLICE:
                yield texts, rows, True
                texts, rows, n = [], [], 0
    if texts:
        yield texts, rows, True


class Code:
    """Huffman code: symbols as paths of (hashed node, bit, log odds of a one)."""

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        heap = [(float(w), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        weight, children = [w for w, _ in sorted(heap, key=lambda x: x[1])], {}
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[len(weight)] = a[1], b[1]
            heapq.heappush(heap, (a[0] + b[0], len(weight)))
            weight.append(a[0] + b[0])
        leaves = [1] * n                                    # symbols below each node
        for zero, one in (children[at] for at in range(n, len(weight))):
            leaves.append(leaves[zero] + leaves[one])
        paths: list[list[tuple]] = [[] for _ in weights]
        self.leaf = np.zeros(n, np.int64)                   # each symbol's place in the order of the code
        todo = [(len(weight) - 1, 0, [])]
        while todo:
            at, low, path = todo.pop()
            if at < n:
                paths[at], self.leaf[at] = path, low
            else:
                zero, one = children[at]
                odds = math.log(weight[one] / weight[zero])
                span = low, low + leaves[zero], low + leaves[at]
                todo += [(zero, low, [*path, (at - n, 0, odds, *span)]), (one, span[1], [*path, (at - n, 1, odds, *span)])]
        self.size = np.array([len(p) for p in paths], np.int64)
        self.start = np.cumsum(self.size) - self.size
        flat = [x for p in paths for x in p]
        self.step = (np.array([x[0] for x in flat], np.uint64) + np.uint64(1)) * _C[2]
        self.bit = np.array([x[1] for x in flat], bool)
        self.odds = np.array([x[2] for x in flat], np.float32)
        self.spans = np.array([x[3:] for x in flat], np.int64).reshape(-1, 3).T.copy()      # leaves: from, ones from, to

    def steps(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(decisions of each symbol, step of each decision) of a row of symbols."""
        size = self.size.take(symbols)
        end = np.cumsum(size)
        return size, np.arange(end[-1] if len(end) else 0) + np.repeat(self.start.take(symbols) - (end - size), size)

    def expand(self, symbols: np.ndarray):
        """(decisions of each symbol; hashed node, bit, code's log odds of each decision) of a row of symbols."""
        size, k = self.steps(symbols)
        return size, self.step.take(k), self.bit.take(k), self.odds.take(k)


class Vocabulary:
    """Frequent words by hash in an open-addressing table: class, group, share within the class and count of each."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ends: int, total: int, letters: np.ndarray,
                 groups: np.ndarray | None = None):
        # all that is as long as the vocabulary is made in parts, so that a worker holds it once
        parts = [slice(a, a + _PIECE) for a in range(0, len(hashes), _PIECE)]
        self.group = np.zeros(len(hashes), np.uint8) if groups is None else groups
        top = int(self.group.max(initial=0))
        self.base = max(32, top + 3)            # of the group history; its last digit marks a text's start
        octaves = len(hashes).bit_length()
        long = np.array([1, 0, *np.repeat(1 << np.arange(octaves - 1), 2)], np.int64)      # half an octave of ranks each
        cls = np.repeat(np.arange(2 * octaves, dtype=np.int32), long[:2 * octaves])[:len(hashes)]
        there = np.zeros(2 * octaves * (top + 1), bool)
        for z in parts:
            cls[z] = cls[z] * np.int32(top + 1) + self.group[z]
            there[cls[z]] = True
        number = (FIRST - 1 + np.cumsum(there)).astype(np.int32)          # classes are numbered without holes
        sums = np.zeros(FIRST + max(1, int(there.sum())))
        for z in parts:
            cls[z] = number.take(cls[z])
            sums += np.bincount(cls[z], counts[z], minlength=len(sums))
        sums[ESCAPE], sums[END] = max(0, total - ends - int(counts.sum())), ends
        self.code, self.letters = Code(sums + 1), Code(letters + 1)
        self.cls = cls.astype(np.uint16 if cls.max(initial=0) < 1 << 16 else np.int32)
        self.block = max(64, min(BLOCK, (1 << 23) // len(sums)))        # words predicted at a time
        self.share = np.zeros(len(hashes), np.float32)
        self.counts = counts
        self.log_end, self.known_end = math.log10(ends + 1), ends > 0
        bits = max(4, int(2 * len(hashes) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.hashes, self.values = hashes if len(hashes) else np.zeros(1, np.uint64), np.full(1 << bits, -1, np.int32)
        for z in parts:
            self.share[z] = np.log10(counts[z] / sums.take(cls[z]))
            at = (hashes[z] >> self.shift).astype(np.int64)
            left = np.arange(z.start, z.start + len(at), dtype=np.int32)
            while len(left):
                free = np.flatnonzero(self.values.take(at) < 0)
                self.values[at[free]] = left[free]          # of several words one gets the slot
                rest = self.values.take(at) != left
                at, left = (at[rest] + 1) & self.mask, left[rest]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rank of each hash, or -1."""
        at = (h >> self.shift).astype(np.int64)
        out = self.values.take(at)
        open_ = np.flatnonzero((out >= 0) & (self.hashes.take(out) != h))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            out[open_] = self.values[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.hashes.take(out[open_]) != h[open_])]
        return out

    def classes(self, word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Class of each symbol."""
        cls = np.where(word, ESCAPE, END)
        cls[rank >= 0] = self.cls.take(rank[rank >= 0])
        return cls

    def blocks(self, w: Words, h: np.ndarray, word: np.ndarray, rank: np.ndarray, by_word_before: bool = False):
        """(kind, code, symbols, contexts, whose): all words and ends (``whose``: their places), then the escaped words' bytes by word.

        Words come in their order, or sorted by the word before, so that what follows it is looked up once."""
        cls, one = self.classes(word, rank), word_before(h)
        past, place = self._history(word, rank), np.arange(len(cls))
        if by_word_before:
            place = np.argsort(one)
            cls, one, past = cls.take(place), one.take(place), past.take(place)
        for a in range(0, len(cls), self.block):
            z = slice(a, a + self.block)
            yield 0, self.code, cls[z], [one[z], past[z]], place[z]
        out = np.flatnonzero(rank[word] < 0)
        if len(out):
            yield from self._spelled(w, out)

    def _history(self, word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Hash of the groups of the words before each symbol, as far as the text's start."""
        restart = self.base - 1
        group = np.where(word, 0, restart)
        group[rank >= 0] = self.group.take(rank[rank >= 0]).astype(np.int64) + 1
        back, out = group, np.zeros(len(word), np.uint64)
        for k in range(HISTORY):
            earlier = np.concatenate([[restart], back[:-1]])
            back = earlier if k == 0 else np.where(back == restart, restart, earlier)
            out = out * np.uint64(self.base) + back.astype(np.uint64)
        return (out + np.uint64(1)) * _C[1]

    def _spelled(self, w: Words, which: np.ndarray):
        size = w.end[which] - w.start[which] + 1
        stop = np.cumsum(size) - 1
        at = np.arange(int(stop[-1]) + 1) + np.repeat(w.start[which] - (stop - size + 1), size)
        sym = np.concatenate([np.full(ORDERS[-1], STOP), w.raw.take(at)]).astype(np.int64)
        sym[stop + ORDERS[-1]] = STOP
        whose = np.repeat(np.arange(len(which)), size)
        for a in range(0, len(at), BLOCK):
            n = min(BLOCK, len(at) - a)
            hashes, h, before = [], np.zeros(n, np.uint64), None
            for k in range(1, ORDERS[-1] + 1):
                x = sym[a + ORDERS[-1] - k:a + ORDERS[-1] - k + n]
                before = x if before is None else np.where(before == STOP, STOP, x)
                h = (h + before.astype(np.uint64) + np.uint64(1)) * _C[1]
                if k in ORDERS:
                    hashes.append(h)
            yield 1, self.letters, sym[a + ORDERS[-1]:a + ORDERS[-1] + n], hashes, whose[a:a + n]


def distinct(h: np.ndarray) -> np.ndarray:
    """``h`` sorted in place, each value once; at 64 bits a sort is several times faster than ``np.unique``'s hash table."""
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def word_before(h: np.ndarray) -> np.ndarray:
    """Hash of the symbol before each one; a text's first follows an end."""
    return np.concatenate([[_END_HASH], h[:-1]]).astype(np.uint64)


class Followers:
    """How often each class follows a word, by the word's hash."""

    def __init__(self, keys: np.ndarray, start: np.ndarray, cls: np.ndarray, n: np.ndarray, total: np.ndarray):
        self.keys, self.start, self.cls, self.n, self.total = keys, start, cls, n, total

    @classmethod
    def of(cls, table: pa.Table, bits: int, parts: bool) -> Followers:
        """From rows (key, followers with counts of ``bits``, followers with large counts).  A repeated key is the same
        row again, or with ``parts`` another part of it."""
        keys = table.column(0).to_numpy().view(np.uint64)
        order = np.argsort(keys, kind="stable") if parts else np.unique(keys, return_index=True)[1]
        small, large = (pa.concat_arrays([*table.column(c).chunks, pa.array([], pa.list_(kind))]).take(pa.array(order))
                        for c, kind in ((1, pa.int32()), (2, pa.int64())))
        size = pc.list_value_length(small).to_numpy(False).astype(np.int64)
        packed = small.flatten().to_numpy(False)
        which, n = packed >> bits, packed & ((1 << bits) - 1)
        if len(large.flatten()):        # a row's large counts stand behind its others
            more, packed = pc.list_value_length(large).to_numpy(False).astype(np.int64), large.flatten().to_numpy(False)
            behind = np.repeat(np.cumsum(size), more)
            which = np.insert(which.astype(np.int64), behind, packed >> LARGE_BITS)
            n, size = np.insert(n.astype(np.int64), behind, packed & ((1 << LARGE_BITS) - 1)), size + more
        keys, first = np.unique(keys[order], return_index=True)
        offset = np.concatenate([[0], np.cumsum(size)])
        start = np.append(offset[first], offset[-1])
        total, some = np.zeros(len(keys)), np.flatnonzero(np.diff(start))
        if len(some):
            total[some] = np.add.reduceat(n, start[some], dtype=np.int64)
        return cls(keys, start, which.astype(np.min_scalar_type(int(which.max(initial=0)))), n.astype(np.float32), total)

    def parameters(self) -> tuple:
        return self.keys, self.start, self.cls, self.n, self.total

    def _rows(self, words: np.ndarray):
        """(places in ``words`` of those that are here, their rows)."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        here = np.flatnonzero(self.keys.take(at) == words)
        return here, at[here]

    def fill(self, into: np.ndarray, leaf: np.ndarray, words: np.ndarray) -> None:
        """Write the counts of ``words`` into their rows of ``into``, in the order of the code's leaves."""
        here, at = self._rows(words)
        size = self.start[at + 1] - self.start[at]
        k = np.arange(int(size.sum())) + np.repeat(self.start[at] - (np.cumsum(size) - size), size)
        into[np.repeat(here, size), 1 + leaf.take(self.cls.take(k))] = self.n.take(k)

    def sightings(self, words: np.ndarray) -> np.ndarray:
        """How often each word is followed: 0 where it is not here."""
        out = np.zeros(len(words))
        here, at = self._rows(words)
        out[here] = self.total[at]
        return out


class FollowerSums:
    """Sums of followers in the order of the code's leaves; those of the most sighted ``hot`` words are kept."""

    def __init__(self, code: Code, hot: Followers, block: int):
        self.code, self.hot, width = code, hot, len(code.leaf) + 1
        top = np.argsort(-hot.total, kind="stable")[:max(1, min(SALTED, (1 << 20) // width))]
        self.kept = np.sort(hot.keys[top])
        self.sums = np.zeros((len(self.kept) + block, width), np.int64)        # whole numbers add up several times faster
        self._add(0, self.kept, [hot])

    def _add(self, at: int, words: np.ndarray, known: list[Followers]) -> None:
        into = self.sums[at:at + len(words)]
        into[:] = 0
        for f in known:
            f.fill(into, self.code.leaf, words)
        np.cumsum(into, axis=1, out=into)

    def read(self, found: Followers, before: np.ndarray, size: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds and confidence of each decision after the word before (``before`` is sorted): the counts below its node's two branches."""
        new = np.append(True, before[1:] != before[:-1])
        words, row = before[new], np.cumsum(new) - 1
        place = np.minimum(np.searchsorted(self.kept, words), max(0, len(self.kept) - 1))
        rest = np.flatnonzero(self.kept.take(place) != words) if len(self.kept) else np.arange(len(words))
        place[rest] = len(self.kept) + np.arange(len(rest))
        self._add(len(self.kept), words[rest], [self.hot, found])
        base = np.repeat(place.take(row) * self.sums.shape[1], size)
        flat = self.sums.ravel()
        low, mid, high = (flat.take(base + x.take(k)) for x in self.code.spans)
        odds = np.log(((high - mid + 0.4) / (mid - low + 0.4)).astype(np.float32))
        return odds, confidence(high - low)


class Mixer:
    """Weights and refinement, and the arithmetic on blocks of bits."""

    def __init__(self, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.w = np.tile(np.array([0.6, 0.3, 0.3, 0.0], np.float32), (SETS, 1)) if weights is None else weights
        self.refine = refine
        self.h = np.full((SETS, 4), 1.0)
        self.seen = np.zeros(SETS)
        self.counts = np.zeros((SETS * LEVELS, 2))

    def mix(self, odds: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        w = self.w.T
        t = w[3].take(gate)
        for j in range(3):
            t += odds[j] * w[j].take(gate)
        return np.clip(t, -8, 8, out=t)

    def level(self, t: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return gate * LEVELS + np.rint((t + 8) * ((LEVELS - 1) / 16)).astype(np.int64)

    def learn(self, odds: list[np.ndarray], gate: np.ndarray, bit: np.ndarray) -> None:
        """One online step: each set's weights move along the block's errors, scaled by their curvature."""
        t = self.mix(odds, gate)
        p = 1 / (1 + np.exp(-t))
        err, curve = bit - p, p * (1 - p)
        for j in range(4):
            if j < 3:
                g, h = np.bincount(gate, err * odds[j], SETS), np.bincount(gate, curve * odds[j] * odds[j], SETS)
            else:
                g, h = np.bincount(gate, err, SETS), np.bincount(gate, curve, SETS)
            self.h[:, j] = 0.9 * self.h[:, j] + h
            self.w[:, j] += (0.3 * g / (self.h[:, j] + 1)).astype(np.float32)
        np.clip(self.w, -2, 4, out=self.w)
        n = np.bincount(self.level(t, gate) * 2 + bit, minlength=SETS * LEVELS * 2).reshape(-1, 2)
        self.counts += n
        self.seen += n.reshape(SETS, -1).sum(axis=1)

    def log10(self, odds: list[np.ndarray], gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        t = self.mix(odds, gate)
        p = 1 / (1 + np.exp(-t))
        p = np.float32(0.5) * (p + self.refine.take(self.level(t, gate)))
        return np.log(np.where(bit, p, 1 - p)) * np.float32(1 / math.log(10))


def confidence(n: np.ndarray) -> np.ndarray:
    """0, 1-3, 4-31 or more sightings."""
    return ((n > 0).astype(np.uint8) + (n > 3) + (n > 31)).astype(np.uint8)


def gate_of(kind: int, short: np.ndarray, long: np.ndarray) -> np.ndarray:
    return short.astype(np.int64) * 4 + long + kind * 16


def cells_of(kind: int, contexts: list[np.ndarray], size: np.ndarray, step: np.ndarray, first: int = 0) -> list[np.ndarray]:
    """Counter of each decision in the tables of its kind, from the ``first`` on."""
    return [(((np.repeat(c, size) ^ step) * _C[0]) >> np.uint64(64 - SLOT_BITS)).view(np.int64) + ((2 * kind + j) << SLOT_BITS)
            for j, c in enumerate(contexts, first)]


def read_counters(table: np.ndarray, cells: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Log odds and confidence of counters (zeros in the low half of a number, ones in the high half)."""
    odds, seen = [], []
    for s in cells:
        n = table.take(s).view(np.int32).reshape(-1, 2)         # little-endian: zeros, ones
        zeros, ones = n[:, 0].astype(np.float32), n[:, 1].astype(np.float32)
        odds.append(np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4))))
        ones += zeros
        seen.append(confidence(ones))
    return odds, seen


def _train(model):
    """Task: online training.  Rows are (cell, counters as bytes) and one (-1, weights and refinement counts).
    The first table (the word before) serves the task only: ``_count_followers`` gathers it for the whole corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, mixer = Vocabulary(*model.value), Mixer()
        table = np.zeros(TABLES << SLOT_BITS, np.int64)
        for texts, _, ends in _groups(batches, 0):
            w = Words(texts)
            h, _, word = w.sequence(ends)
            rank = np.where(word, vocabulary.find(h), -1)
            for kind, code, sym, contexts, _ in vocabulary.blocks(w, h, word, rank):
                size, step, bit, own = code.expand(sym)
                cells = cells_of(kind, contexts, size, step)
                odds, seen = read_counters(table, cells)
                mixer.learn([own, *odds], gate_of(kind, *seen), bit)
                add = np.where(bit, _HALF, np.int64(1))
                for s in cells:
                    np.add.at(table, s, add)
        task = TaskContext.get().partitionId()
        state = np.concatenate([(mixer.w * mixer.seen[:, None]).ravel(), mixer.seen, mixer.counts.ravel()])
        rows = [(-1, state.astype(np.float64).tobytes())]
        rows += [(c // CELL, table[c:c + CELL].tobytes()) for c in range(1 << SLOT_BITS, len(table), CELL) if table[c:c + CELL].any()]
        for a in range(0, len(rows), 64):
            part = rows[a:a + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * len(part), pa.int32()), pa.array([c for c, _ in part], pa.int32()),
                 pa.array([x for _, x in part], pa.binary())], ["_task", "_cell", "_counts"])
        del vocabulary, table, rows, part
        give_back()
    return run


def _merge(fan: int, finish: bool = False):
    """Group: sum of the counters of a cell; the first level leaves ``_task`` modulo fan, the last one (``finish``)
    log odds (16-bit) and confidence (8-bit) of the counters.  One function does both, as every Python
    function of a stage has a worker of its own, which stays when the stage is over."""
    def run(group: pa.Table) -> pa.Table:
        cell = group.column("_cell")[0].as_py()
        blobs = group.column("_counts").to_pylist()
        if cell < 0:
            out = sum(np.frombuffer(x) for x in blobs).tobytes()
        else:
            ones = zeros = np.int64(0)
            for x in blobs:
                c = np.frombuffer(x, np.int64)
                ones, zeros = ones + (c >> 32), zeros + (c & (_HALF - 1))
            large = np.maximum(ones, zeros) >> 30       # full counters are scaled down, which keeps their odds
            shift = np.where(large > 0, np.ceil(np.log2(large + 1.0)), 0).astype(np.int64)
            ones, zeros = ones >> shift, zeros >> shift
            out = (np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float16).tobytes() + confidence(ones + zeros).tobytes() if finish
                   else ((ones << 32) | zeros).tobytes())
        task = group.column("_task")[0].as_py() % fan
        return pa.table({"_task": pa.array([task], pa.int32()), "_cell": pa.array([cell], pa.int32()),
                         "_counts": pa.array([out], pa.binary())})
    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, group, n): 0 word counts by hash and the text's group, 1 letters of words (256: words), 2 texts."""
    def rows(kind, key, n, group=0):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key),
                                           pa.array(np.full(len(key), group, np.int32)), pa.array(n)], ["_kind", "_key", "_g", "_n"])

    def flush():
        for group, parts in waiting.items():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            yield rows(0, h.view(np.int64), n.astype(np.int64), group)
    waiting, size, texts_seen, letters = {}, 0, 0, np.zeros(257, np.int64)
    for texts, whose, ends in _groups(batches, 0):
        w = Words(texts)
        group = np.repeat([b.column(1)[i].as_py() for b, i in whose], w.words)
        for g in np.unique(group):
            waiting.setdefault(int(g), []).append(w.hash[group == g])
        size += len(w.hash)
        texts_seen += len(texts) if ends else 0
        letters[:256] += np.where(_SPACE, 0, np.bincount(w.raw, minlength=256))
        letters[256] += len(w.hash)
        if size >= _GATHER:
            yield from flush()
            waiting, size = {}, 0
    yield from flush()
    yield rows(1, np.arange(257), letters)
    yield rows(2, np.zeros(1, np.int64), np.array([texts_seen], np.int64))
    waiting.clear()
    give_back()


def _count_followers(model, salted: int, bits: int):
    """Task: rows (word before, part, followers) of its texts; only the ``salted`` most frequent words and the end
    have several parts, and a count beyond ``bits`` stands in several numbers.  The last word before a long text's cut counts as followed by an escape."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, pairs, size = Vocabulary(*model.value), [], 0

        def flush():
            b, c, hot = (np.concatenate(x) for x in zip(*pairs))
            pairs.clear()
            pair = b ^ (c.astype(np.uint64) + np.uint64(1)) * _C[0]
            order = np.argsort(pair)
            pair = pair.take(order)
            new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            first, n = order.take(new), np.diff(np.append(new, len(pair)))
            del pair
            part = np.where(hot[first], 1 + c[first] % SALTS, 0).astype(np.int32)
            order = np.lexsort((part, b[first]))
            b, part, c, n = b[first[order]], part[order], c[first[order]].astype(np.int64), n[order]
            most = (1 << bits) - 1
            times = (n - 1) // most + 1
            new = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (part[1:] != part[:-1])))
            offset = np.append((np.cumsum(times) - times)[new], times.sum()).astype(np.int32)
            last = np.zeros(offset[-1], bool)
            last[np.cumsum(times) - 1] = True
            packed = (np.repeat(c, times) << bits) + np.where(last, np.repeat(n - most * (times - 1), times), most)
            return pa.RecordBatch.from_arrays(
                [pa.array(b[new].view(np.int64)), pa.array(part[new]),
                 pa.ListArray.from_arrays(pa.array(offset), pa.array(packed.astype(np.int32)))], ["_key", "_part", "_list"])
        for texts, _, ends in _groups(batches, 0):
            h, _, word = Words(texts).sequence(ends)
            if not len(h):
                continue
            rank = np.where(word, vocabulary.find(h), -1)
            before, cls = word_before(h), vocabulary.classes(word, rank)
            hot = ~word | (rank >= 0) & (rank < salted)
            hot = np.concatenate([[True], hot[:-1]]) if ends else np.concatenate([[True], hot])
            if not ends:
                before, cls = np.append(before, h[-1]), np.append(cls, ESCAPE)
            pairs.append((before, cls.astype(np.int32), hot))
            size += len(h)
            if size >= _GATHER // 2:
                yield flush()
                size = 0
        if size:
            yield flush()
        del vocabulary
        give_back()
    return run


class Model:
    """A trained model: what is broadcast, and the table of the classes that follow each word."""

    def __init__(self, total: int, distinct: int, escaped: tuple[int, int], vocabulary: tuple, tables: tuple, followers: DataFrame, hot: tuple, bits: int):
        self.followers, self.hot, self.bits = followers, hot, bits      # those that are joined; the most frequent words' ones
        self.total, self.distinct = total, distinct
        self.escaped = escaped              # escaped training words: all, distinct
        self.vocabulary, self.tables = vocabulary, tables


def _label_group(docs: DataFrame, label_col: str | None):
    """Group of a row's label: 1, 2, ... from the most frequent label on (ties by name), 0 for null."""
    if label_col is None:
        return F.lit(0)
    label = F.col(label_col).cast("string")
    top = (docs.filter(label.isNotNull()).groupBy(label.alias("_label")).count()
           .orderBy(F.desc("count"), "_label").collect())          # a row per label
    return F.coalesce(F.array_position(F.array(*[F.lit(r["_label"]) for r in top]).cast("array<string>"), label), F.lit(0))


def train(docs: DataFrame, text_col: str = "text", label_col: str | None = None) -> Model:
    """Train on all rows of ``docs``: word counts, vocabulary and codes, then the mixing model."""
    spark = docs.sparkSession
    prepare(spark)
    labelled = docs.select(F.col(text_col).cast("string").alias("_t"), _label_group(docs, label_col).cast("int").alias("_g"))
    texts = labelled.select("_t")
    counted = written(labelled.mapInArrow(_count_words, "_kind int, _key bigint, _g int, _n bigint")
                      .repartition("_kind", "_key")          # one shuffle: a key has a row per task and group at most
                      .groupBy("_kind", "_key", "_g").agg(F.sum("_n").alias("_n"))
                      .groupBy("_kind", "_key").agg(F.sum("_n").alias("_n"), F.max_by("_g", F.struct("_n", "_g")).alias("_g")),
                      "word-counts")
    words = counted.filter("_kind = 0").select("_key", "_n", "_g")
    size = words.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")).first()
    letters, ends = np.zeros(257), 0
    for r in counted.filter("_kind > 0").collect():         # 258 rows
        if r["_kind"] == 1:
            letters[r["_key"]] = r["_n"]
        else:
            ends = r["_n"]
    # VOCABULARY rows at most; words seen once train the spelling, as unseen words will need it.
    # The counts of all other words reach the score by a join.
    top = most_frequent(words.filter("_n > 1"), "_n", VOCABULARY).toArrow()
    key, n = top.column(0).to_numpy(), top.column(1).to_numpy()
    order = np.lexsort((key, -n))
    hashes, n = key[order].astype(np.int64).view(np.uint64), n[order].astype(np.int64)
    groups = top.column(2).to_numpy()[order]
    groups = groups.astype(np.min_scalar_type(int(groups.max(initial=0))))
    total, distinct = int(size[0]) + ends, int(size[1]) + int(ends > 0)
    escaped = int(size[0]) - int(n.sum()), int(size[1]) - len(n)
    vocabulary = hashes, n, ends, total, letters, groups
    shared = spark.sparkContext.broadcast(vocabulary)
    classes = 44 * (int(groups.max(initial=0)) + 1)         # at most
    bits = max(1, 31 - classes.bit_length())
    most, large = (1 << bits) - 1, F.least("_n", F.lit((1 << LARGE_BITS) - 1))
    cls = F.col("_sym").cast("bigint")
    # one shuffle: no key has more than a row per task, or its parts
    followers = written(texts.mapInArrow(_count_followers(shared, min(SALTED, HOT_CELLS // 2 // classes), bits),
                                         "_key bigint, _part int, _list array<int>")
                        .repartition("_key", "_part").select("_key", "_part", F.explode("_list").alias("_f"))
                        .groupBy("_key", "_part", F.shiftright("_f", bits).alias("_sym"))
                        .agg(F.sum(F.col("_f").bitwiseAND(F.lit(most)).cast("bigint")).alias("_n"))
                        .groupBy("_key", "_part").agg(
                            F.collect_list(F.when(F.col("_n") <= most, (F.shiftleft(cls, bits) + F.col("_n")).cast("int"))).alias("_list"),
                            F.collect_list(F.when(F.col("_n") > most, F.shiftleft(cls, LARGE_BITS) + large)).alias("_large"),
                            F.sum("_n").alias("_n")), "followers")
    frequent = _most_frequent_cells(followers, HOT_CELLS)
    hot = Followers.of(followers.filter(frequent).select("_key", "_list", "_large").toArrow(), bits, True)
    cold = followers.filter(~frequent).select("_key", "_list", "_large")
    fan = max(1, math.isqrt(texts.rdd.getNumPartitions()))
    schema = "_task int, _cell int, _counts binary"
    merged = (texts.mapInArrow(_train(shared), schema)
              .groupBy("_cell", F.pmod("_task", F.lit(fan))).applyInArrow(_merge(fan), schema)
              .groupBy("_cell").applyInArrow(_merge(1, finish=True), schema).select("_cell", "_counts"))
    odds = np.full(TABLES << SLOT_BITS, 0, np.float16)
    seen = np.zeros(TABLES << SLOT_BITS, np.uint8)
    state = np.zeros(SETS * 5 + SETS * LEVELS * 2)
    del top, key, n, order
    cells = merged.toArrow()            # the counters at 3 bytes each: 12 MB at any corpus size
    for cell, blob in zip(cells.column(0).to_pylist(), cells.column(1).to_pylist()):
        if cell < 0:
            state = np.frombuffer(blob).copy()
        else:
            odds[cell * CELL:(cell + 1) * CELL] = np.frombuffer(blob[:2 * CELL], np.float16)
            seen[cell * CELL:(cell + 1) * CELL] = np.frombuffer(blob[2 * CELL:], np.uint8)
    shared.destroy()                    # what it served is written or here
    seen_bits = state[SETS * 4:SETS * 5]
    weights = np.where(seen_bits[:, None] > 0, state[:SETS * 4].reshape(SETS, 4) / np.maximum(seen_bits, 1)[:, None], Mixer().w)
    k = state[SETS * 5:].reshape(-1, 2)
    level = 1 / (1 + np.exp(-np.tile(np.linspace(-8, 8, LEVELS), SETS)))
    refine = (k[:, 1] + 8 * level) / (k.sum(1) + 8)
    return Model(total, distinct, escaped, vocabulary, (odds, seen, weights.astype(np.float32), refine.astype(np.float32)),
                 cold, hot.parameters(), bits)


def _most_frequent_cells(followers: DataFrame, limit: int):
    """Condition of the words in parts, and of the most frequent other ones (``HOT_LEAST`` sightings or more) whose
    followers fit, by a histogram."""
    bucket = F.floor(F.log2("_n") * 8)
    in_parts = F.col("_part") > 0
    hist = [(r["b"], r["c"]) for r in followers.groupBy(F.when(in_parts, 1 << 20).otherwise(bucket).alias("b"))
            .agg(F.sum(F.size("_list") + F.size("_large")).alias("c")).orderBy(F.desc("b")).collect()]             # at most 513 rows
    total, least = 0, 1 << 20
    for b, n in hist:
        total += n
        if total > limit and b < 1 << 20:
            break
        least = b
    return in_parts | ((bucket >= least) & (F.col("_n") >= HOT_LEAST))


def _chunks(limit: int):
    """Rows (id, text) with their chunk: ``limit`` bytes of one task's texts (a longer text ends its chunk)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(False).astype(np.int64) + 1
            chunk = task + (done + np.cumsum(size) - size) // limit
            done += int(size.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(chunk, pa.int64())], ["_id", "_t", "_chunk"])
    return run


def _contexts(hot_words):
    """Task: rows (chunk, word) of words that are not broadcast, once for each run of a chunk's texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = hot_words.value

        def flush(chunk, parts):
            h = distinct(np.concatenate(parts))
            if len(hot):
                h = h[hot.take(np.minimum(np.searchsorted(hot, h), len(hot) - 1)) != h]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), chunk)), pa.array(h.view(np.int64))], ["_chunk", "_h"])

        def by_chunk():
            for b in batches:
                chunk = b.column(0).to_numpy()
                for a, z in zip(edges := np.flatnonzero(np.diff(chunk, prepend=-1)), [*edges[1:], len(chunk)]):
                    yield int(chunk[a]), b.slice(a, z - a)
        last, parts = None, []
        for chunk, b in by_chunk():
            if chunk != last and parts:
                yield flush(last, parts)
                parts = []
            last = chunk
            for texts, _, _ in _groups(iter([b]), 1):
                parts.append(distinct(np.append(Words(texts).hash, _END_HASH)))
            if len(parts) > 64:
                parts = [distinct(np.concatenate(parts))]
        if parts:
            yield flush(last, parts)
        del parts
        give_back()
    return run


def _score(model, escaped: tuple[int, int], bits: int):
    """Group: the scores of a chunk's texts, with the followers that the chunk's words have.

    An escaped word's probability is (its count + distinct * spelled) / (all + distinct); unseen: count 0."""
    all_, distinct = (max(1, x) for x in escaped)
    unseen = math.log10(distinct / (all_ + distinct)) if escaped[1] else 0.0
    kept: list = []                 # a task's vocabulary serves all its chunks

    def run(texts_of: pa.Table, asked: pa.Table) -> pa.Table:
        if not kept:
            parameters, (odds16, seen, weights, refine), hot = model.value
            voc, hot = Vocabulary(*parameters), Followers(*hot)
            kept.extend([voc, Mixer(weights, refine), odds16, seen, hot, FollowerSums(voc.code, hot, voc.block)])
        found = Followers.of(asked.select([1, 2, 3]), bits, False)
        give_back()
        out = pa.Table.from_batches(list(scored(iter(texts_of.select([0, 1]).to_batches(500)), found)))
        del found
        give_back()
        return out

    def scored(batches: Iterator[pa.RecordBatch], found: Followers) -> Iterator[pa.RecordBatch]:
        voc, mixer, odds_of, seen, hot, sums_of = kept
        before: list | None = None          # sums of a long text's earlier slices
        for texts, rows, ends in _groups(batches, 1):
            w, k = Words(texts), len(texts)
            h, of, word = w.sequence(ends)
            rank = np.where(word, voc.find(h), -1)
            known = rank >= 0
            score = np.bincount(of[known], voc.share.take(rank[known]), minlength=k).astype(np.float64)
            out = word & ~known
            spelled, coded = np.zeros(int(out.sum())), np.zeros(len(h))
            for kind, code, sym, contexts, whose in voc.blocks(w, h, word, rank, True):
                size, step = code.steps(sym)
                bit = code.bit.take(step)
                # what the word before says comes from the followers; the other tables are those of the counters
                cells = cells_of(kind, contexts[1 - kind:], size, code.step.take(step), 1 - kind)
                odds, sure = [odds_of.take(s).astype(np.float32) for s in cells], [seen.take(s) for s in cells]
                if not kind:
                    after, known_after = sums_of.read(found, contexts[0], size, step)
                    odds, sure = [after, *odds], [known_after, *sure]
                got = mixer.log10([code.odds.take(step), *odds], gate_of(kind, *sure), bit)
                got = np.bincount(np.repeat(np.arange(len(sym)), size), got, minlength=len(sym))
                if kind:
                    spelled += np.bincount(whose, got, minlength=len(spelled))
                else:
                    coded[whose] = got
            score += np.bincount(of, coded, minlength=k)        # by text in the words' order, whatever texts stand beside it
            n = hot.sightings(h[out]) + found.sightings(h[out])
            with np.errstate(divide="ignore"):
                spelled = unseen + np.where(n > 0, np.log10(n / distinct + np.power(10.0, spelled)), spelled)
            score += np.bincount(of[out], spelled, minlength=k)
            base = (np.bincount(of[known], np.log10(voc.counts.take(rank[known]) + 1.0), minlength=k)
                    + np.bincount(of[out], np.log10(n + 1), minlength=k) + (voc.log_end if ends else 0))
            hits = (np.bincount(of[known], minlength=k) + np.bincount(of[out][n > 0], minlength=k) + int(ends and voc.known_end))
            sums = [w.words + int(ends), w.bytes + w.words + int(ends), hits, base, score]
            if before is not None:
                sums = [x + y for x, y in zip(sums, before)]
            before = None if ends else sums
            if ends:
                ids = pa.chunked_array([b.column(0).slice(i, 1) for b, i in rows]).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(x.astype(np.int64)) for x in sums[:3]], *[pa.array(x.astype(np.float64)) for x in sums[3:]]],
                    ["_id", "_n", "_bytes", "_known", "_base", "_score"])
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_tokens`` (words and one end), ``n_known``,
    ``train_tokens``, ``base_score``, ``score`` (both log10 probabilities of the
    text), ``bits_per_byte`` (of the coded bytes: words, one separator after
    each, one end).

    Null text counts as empty: one end token.  Repeated rows get the same
    answer; an empty table gives an empty result; with nothing to train on
    every score comes from the initial state and the base probability is
    1.  Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast((model.vocabulary, model.tables, model.hot))
    hot_words = spark.sparkContext.broadcast(model.hot[0])         # chunks ask for words with these alone
    id_type = docs.schema[id_col].dataType.simpleString()
    chunked = written(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
                      .mapInArrow(_chunks(CHUNK), f"_id {id_type}, _t string, _chunk bigint"), "chunks", compression="zstd")
    asked = (chunked.select("_chunk", "_t").mapInArrow(_contexts(hot_words), "_chunk bigint, _h bigint")
             .join(model.followers, F.col("_h") == F.col("_key")).select("_chunk", "_h", "_list", "_large"))
    schema = f"_id {id_type}, _n bigint, _bytes bigint, _known bigint, _base double, _score double"
    rows = chunked.groupBy("_chunk").cogroup(asked.groupBy("_chunk")).applyInArrow(_score(shared, model.escaped, model.bits), schema)
    norm = math.log10(model.total + model.distinct + 1)
    return rows.select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_tokens"),
        F.col("_known").alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("_base") - F.col("_n") * norm).alias("base_score"),
        F.col("_score").alias("score"), (-F.col("_score") * math.log2(10) / F.col("_bytes")).alias("bits_per_byte"))


def score_by_held_out_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            label_col: str | None = None) -> DataFrame:
    """Train on the rows whose crc32(id as text) mod 7 is not 2 and score all; adds ``held_out``.

    ``label_col``, if given, groups the words in training (null labels count
    as one more label); no label is an input of a score."""
    mod, out = HOLD_OUT
    model = train(docs.filter(id_crc_mod(id_col, mod) != out), text_col, label_col)
    held = (id_crc_mod(id_col, mod) == out).alias("held_out")
    s = score(docs, model, id_col, text_col)
    return s.select(id_col, held, *s.columns[1:])
