"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes, counted over a bounded sample of
labelled texts and frozen. A byte b after context c costs -log2 of n(c,b) / (n(c) + d(c)) bits when c
was followed by b, where d(c) is the number of different followers; otherwise -log2 of the
escape probability d(c) / (n(c) + d(c)) and the cost of b after the context without its oldest byte.
Contexts that were never met cost nothing, and below the empty context all 256 bytes are equally
likely. A text costs the sum over all its bytes, with a line feed before its start; the language
of least cost wins.

With statistics frozen, the cost depends only on the last ``ORDER`` + 1 bytes. The trees of all
languages are therefore laid out as one hash table for each depth, from a byte string to its costs in every
language; a whole batch of text is looked up at once, deepest table first, and only the positions
that a table lacks escape to the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_arrow

ORDER = 4
SAMPLE_DOCS = 400  # labelled texts of each language, at most
SAMPLE_BYTES = 1_000_000  # and bytes of each language; texts are taken whole, in order, up to the first that goes beyond
WINDOW = 1 << 18  # positions that are looked up at once
UNDETERMINED = "und"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PAD = b"\n" * ORDER


def keys_of(raw: np.ndarray, depth: int) -> np.ndarray:
    """The last ``depth`` bytes up to each position from ``ORDER`` on, as integers."""
    out = np.zeros(len(raw) - ORDER, np.uint64)
    for back in range(depth - 1, -1, -1):
        out = (out << np.uint64(8)) | raw[ORDER - back : len(raw) - back].astype(np.uint64)
    return out


class Table:
    """Open-addressing hash table from integers to row numbers."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.key = np.zeros(1 << bits, np.uint64)
        self.row = np.full(1 << bits, -1, np.int32)
        rest = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(rest):  # of the keys that ask for a free slot, the first takes it
            free = self.row[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.row[slot[taken]] = rest[taken]
            self.key[slot[taken]] = keys[rest[taken]]
            left = np.ones(len(rest), bool)
            left[taken] = False
            rest, slot = rest[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 for absent ones."""
        slot = self._slot(keys)
        out = self.row[slot]
        open_ = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            found = self.row[slot]
            out[open_] = found
            again = (found >= 0) & (self.key[slot] != keys[open_])
            open_, slot = open_[again], slot[again]
        return out


@dataclass
class Model:
    """Frozen statistics of all languages."""

    languages: list[str]
    strings: list[Table]  # by depth: strings of depth + 1 bytes, and their costs
    costs: list[np.ndarray]
    contexts: list[Table]  # by depth: contexts of that many bytes, and the bits of an escape
    escapes: list[np.ndarray]

    @classmethod
    def train(cls, samples: dict[str, list[bytes]]) -> Model:
        languages = sorted(samples)
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for depth in range(ORDER + 1):
            each = []
            for language in languages:
                raw = [np.frombuffer(_PAD + t, np.uint8) for t in samples[language] if t]
                keys = np.concatenate([keys_of(r, depth + 1) for r in raw]) if raw else np.zeros(0, np.uint64)
                each.append(np.unique(keys, return_counts=True))
            counts.append(each)
        strings, costs, contexts, escapes = [], [], [], []
        for depth in range(ORDER + 1):
            own = [(k, n.astype(np.float64), *np.unique(k >> np.uint64(8), return_inverse=True)) for k, n in counts[depth]]
            known = np.unique(np.concatenate([c for _, _, c, _ in own])) if own else np.zeros(0, np.uint64)
            escape = np.zeros((len(languages), len(known)))
            union = np.unique(np.concatenate([k for k, *_ in own])) if own else np.zeros(0, np.uint64)
            if depth:
                lower = np.zeros((len(languages), len(union)))
                below = strings[depth - 1].find(union & np.uint64((1 << 8 * depth) - 1))
                lower = costs[depth - 1][:, below]
            else:
                lower = np.full((len(languages), len(union)), 8.0)
            cost = np.zeros((len(languages), len(union)))
            for i, (keys, n, context, of) in enumerate(own):
                total, kinds = np.bincount(of, n, len(context)), np.bincount(of, minlength=len(context))
                bits = -np.log2(kinds / (total + kinds))
                escape[i, np.searchsorted(known, context)] = bits
                cost[i] = lower[i] + escape[i, np.searchsorted(known, union >> np.uint64(8))]
                cost[i, np.searchsorted(union, keys)] = -np.log2(n / (total + kinds)[of])
            strings.append(Table(union))
            costs.append(cost)
            contexts.append(Table(known))
            escapes.append(escape)
        return cls(languages, strings, costs, contexts, escapes)

    def _bits(self, raw: np.ndarray) -> np.ndarray:
        """Bits of each byte from position ``ORDER`` on, in every language."""
        n = len(raw) - ORDER
        out = np.zeros((len(self.languages), n))
        rest, key = np.arange(n), keys_of(raw, ORDER + 1)
        for depth in range(ORDER, -1, -1):
            row = self.strings[depth].find(key)
            hit = row >= 0
            at, row = rest[hit], row[hit]
            for i, cost in enumerate(self.costs[depth]):
                out[i, at] += cost[row]
            rest, key = rest[~hit], key[~hit]
            if not len(rest):
                return out
            row = self.contexts[depth].find(key >> np.uint64(8))
            met = row >= 0
            for i, escape in enumerate(self.escapes[depth]):
                out[i, rest[met]] += escape[row[met]]
            key = key & np.uint64((1 << 8 * depth) - 1)
        out[:, rest] += 8.0
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text in every language; a row for each language."""
        out = np.zeros((len(self.languages), len(texts)))
        joined = b"".join(_PAD + t for t in texts)
        raw = np.frombuffer(joined, np.uint8)
        size = np.array([len(t) + ORDER for t in texts])
        of = np.repeat(np.arange(len(texts)), size)
        counts = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size) >= ORDER
        for at in range(ORDER, len(raw), WINDOW):
            stop = min(at + WINDOW, len(raw))
            bits = self._bits(raw[at - ORDER : stop])
            bits[:, ~counts[at:stop]] = 0.0
            first, last = of[at], of[stop - 1]
            for i in range(len(self.languages)):
                out[i, first : last + 1] += np.bincount(of[at:stop] - first, bits[i], last - first + 1)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language and its share of the probability, or ``und`` and 0 without letters or training."""
        asked = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if asked:
            bits = self.code_lengths([texts[i].encode() for i in asked])
            best = bits.argmin(0)
            share = 1 / np.exp2(np.minimum(0, bits.min(0) - bits)).sum(0)
            for j, i in enumerate(asked):
                names[i], scores[i] = self.languages[best[j]], float(share[j])
        return names, scores


def in_fold(id_: Column) -> Column:
    """Rows that learning may not see."""
    return F.crc32(id_.cast("string")) % 5 == 0


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[bytes]]:
    """Whole texts of each language, in order of a hash of their ids, up to the two bounds.

    Counts by language say what part of the hash range holds somewhat more than ``SAMPLE_DOCS``
    rows, so the sample is read by a filter; both bounds are applied before anything comes to the driver. A first text that alone is
    over the bound of bytes is taken. Rows with null id, text or language are left out. The model grows with the number of languages.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_fold(F.col("id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return {}
    part = {lang: min(1.0, (SAMPLE_DOCS + 4 * SAMPLE_DOCS**0.5) / n) for lang, n in counts.items()}
    place = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)).alias("place")
    within = F.create_map(*[F.lit(x) for pair in part.items() for x in pair])[F.col("lang")]
    order = Window.partitionBy("lang").orderBy("place", "id", "text")  # some hundred rows of each language
    found = rows.select("lang", place, "id", "text").where(F.col("place") < within)
    found = found.select("lang", "text", F.row_number().over(order).alias("n"), F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"))
    found = found.where((F.col("n") == 1) | (F.col("n") <= SAMPLE_DOCS) & (F.col("upto") <= SAMPLE_BYTES)).orderBy("lang", "n")
    out: dict[str, list[bytes]] = {}
    for r in found.collect():
        out.setdefault(r["lang"], []).append(r["text"].encode())
    return out


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn_from: DataFrame | None = None
) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row of ``docs``.

    Learns from the rows of ``learn_from`` (``docs`` if not given) whose crc32 of the id, as
    text, is not a multiple of 5. Null text, or one without a letter, gives ``und`` and 0, as does an empty
    training set; a null id is held out of learning and has held_out null. Ties go to the language
    that sorts first. Neither lang nor source nor the id is read for a prediction. The model's size is bounded by
    the sample, a few MB for each language, and it is shipped with the tasks.
    """
    model = Model.train(training_sample(docs if learn_from is None else learn_from, id_col, text_col, lang_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, scores = shared.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), in_fold(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.transform(in_arrow, work, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, text_col: str = "text", learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that are predicted to be in some language, unchanged; those predicted as ``und`` go.

    Rows are predicted and dropped where they are, so rows that repeat an id need no join.
    """
    model = Model.train(training_sample(docs if learn_from is None else learn_from, "doc_id", text_col, "lang"))
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                names, _ = shared.value.predict(part.column(at).to_pylist())
                yield part.filter(pa.array([n != UNDETERMINED for n in names], pa.bool_()))

    return docs.transform(in_arrow, work, docs.schema)
