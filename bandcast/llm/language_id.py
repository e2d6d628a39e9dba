"""Language identification with hyperdimensional profiles.

Each letter owns a random bipolar vector.  An n-gram (three letters) is bound
into one vector: the elementwise product of the letters' vectors, rotated by
2, 1 and 0 places according to their place.  Bundling (adding) the n-gram
vectors of a text gives its profile, and bundling the profiles of all
training texts of a language gives the prototype.  A document takes the
language whose prototype has the largest cosine with its profile, after
removing the mean of the prototypes (what all languages share).

Letter vectors come from a fixed seed, so workers rebuild them and only
the prototypes (languages x ``DIM`` numbers) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandcast.llm.common import crc_mod, id_crc_mod, prepare, written

DIM = 512
LETTERS = 64            # letter classes: 0 is a word boundary, a-z have their own, others share by hash
MAX_LANGUAGES = 4096    # bound of the broadcast prototypes (8 MB); more labels are an error
HOLD_OUT = 4, 2         # crc32(id) mod 4 == 2 is held out


def _class_table() -> np.ndarray:
    """Letter class of every code point of the basic plane (others: see :func:`classes`)."""
    table = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()[0]
            table[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + (ord(low) * 40503 >> 4) % (LETTERS - 27)
    return table


class Profiler:
    """Profiles of texts; one per worker."""

    _one: list[Profiler] = []

    def __init__(self, dim: int = DIM):
        rng = np.random.default_rng(20240613)
        letters = rng.choice(np.array([-1, 1], np.int8), (LETTERS, dim))
        self.by_place = [np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters]
        self.dim = dim
        self.table = _class_table()

    @classmethod
    def get(cls) -> Profiler:
        if not cls._one:
            cls._one.append(cls())
        return cls._one[0]

    def classes(self, text: str) -> np.ndarray:
        """Letter classes with each run of other characters as one boundary, bounded on both sides."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = self.table[np.minimum(cp, 0xFFFF)]
        for i in np.flatnonzero(cp > 0xFFFF):
            low[i] = 27 + int(cp[i]) * 40503 % (LETTERS - 27) if chr(cp[i]).isalpha() else 0
        c = np.concatenate([[0], low, [0]]).astype(np.int64)
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        return c[keep]

    def profile(self, text: str | None) -> np.ndarray | None:
        """The text's profile; None without letters."""
        c = self.classes(text or "")
        if not c.any():
            return None
        grams = (c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:]
        gram, count = np.unique(grams, return_counts=True)
        out = np.zeros(self.dim, np.float64)
        for at in range(0, len(gram), 4096):
            g = gram[at:at + 4096]
            bound = self.by_place[0][g // (LETTERS * LETTERS)] * self.by_place[1][g // LETTERS % LETTERS] \
                * self.by_place[2][g % LETTERS]
            out += count[at:at + 4096].astype(np.float32) @ bound.astype(np.float32)
        return out


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p, sums = Profiler.get(), {}
    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            v = p.profile(text)
            if v is not None:
                n = np.linalg.norm(v)
                sums[lang] = sums.get(lang, 0) + v / (n or 1.0)
    for lang, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)],
                                         ["_lang", "_dim", "_v"])


def train_prototypes(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their prototypes from every labelled row outside the held-out part.

    Each text's profile enters with length one.  Tasks bundle what they read
    and send one vector per language; Spark adds them up."""
    n, out = HOLD_OUT
    rows = docs.filter(F.col(lang_col).isNotNull() & (id_crc_mod(id_col, n) != out)) \
        .select(F.col(text_col).cast("string").alias("_t"), F.col(lang_col).cast("string").alias("_lang"))
    sums = written(rows.mapInArrow(_bundle, "_lang string, _dim int, _v double").groupBy("_lang", "_dim")
                   .agg(F.sum("_v").alias("_v")), "prototypes")
    known = sums.count() // DIM
    if known > MAX_LANGUAGES:
        raise ValueError(f"{known} language labels; prototypes are broadcast for {MAX_LANGUAGES} at most")
    langs: dict[str, np.ndarray] = {}
    for r in sums.collect():            # languages x DIM numbers, bounded above
        langs.setdefault(r["_lang"], np.zeros(DIM))[r["_dim"]] = r["_v"]
    names = sorted(langs)
    return names, np.array([langs[x] for x in names]).reshape(len(names), DIM)


class Labeller:
    """Language and score of a text, by prototypes that are broadcast."""

    def __init__(self, spark, names: list[str], proto: np.ndarray):
        self.langs = names
        unit = proto / np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-12)
        mean = unit.mean(axis=0) if len(names) > 1 else np.zeros(DIM)
        centred = unit - mean
        centred = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
        self.model = spark.sparkContext.broadcast((centred, mean))

    def __call__(self, text: str | None) -> tuple[str, float]:
        v = Profiler.get().profile(text) if self.langs else None
        if v is None:
            return "und", 0.0
        protos, mean = self.model.value
        v = v / (np.linalg.norm(v) or 1.0) - mean
        cos = protos @ (v / (np.linalg.norm(v) or 1.0))
        k = int(cos.argmax())
        return self.langs[k], float(min(1.0, max(0.0, cos[k])))


def labeller(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> Labeller:
    return Labeller(docs.sparkSession, *train_prototypes(docs, id_col, text_col, lang_col))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, ``held_out``, ``lang_pred``, ``score`` (cosine, cut at 0 and 1).

    Prototypes are learned from text and language of the rows outside the
    held-out part (crc32 of the id as text, mod 4, is 2); a prediction sees
    only the text.  Null texts, texts without letters, and all texts if
    nothing could be learned, are ``und`` with score 0; of equal cosines the
    first language in sorted order wins.  A null id hashes as ''.  Repeated
    rows get the same answer; an empty table gives an empty result; other
    columns are not read.
    """
    prepare(docs.sparkSession)
    label = labeller(docs, id_col, text_col, lang_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    mod, out = HOLD_OUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [label(t) for t in b.column(1).to_pylist()]
            held = [crc_mod(x, mod) == out for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()),
                                              pa.array([x for x, _ in marks], pa.string()),
                                              pa.array([x for _, x in marks], pa.float64())], ["_id", "_held", "_lang", "_score"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")) \
        .mapInArrow(run, f"_id {id_type}, _held boolean, _lang string, _score double") \
        .toDF(id_col, "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, min_cosine: float, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language:
    letters, and a cosine of ``min_cosine`` or more with some prototype.  Where
    nothing could be learned all texts with letters stay."""
    prepare(docs.sparkSession)
    label = labeller(docs, id_col, text_col, lang_col)
    learned = bool(label.langs)
    names = list(docs.columns)
    plain = [f"c{i}" for i in range(len(names))]        # names may clash or repeat
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(plain, docs.schema.fields))
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Profiler.get()
        for b in batches:
            marks = [label(t) if learned else (("", 1.0) if p.classes(t or "").any() else ("und", 0.0))
                     for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([lang != "und" and cos >= min_cosine for lang, cos in marks], pa.bool_()))

    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*names)
