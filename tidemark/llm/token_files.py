"""Token files: ids of all documents under one canonical length-limited Huffman code.

1. Every text is encoded once; ids are kept as 16- or 32-bit integers in a written table.
2. Ids are counted over the whole table; package-merge turns the counts into code lengths of
   at most ``LONGEST`` bits and the lengths into a canonical code.
3. Documents are dealt out by ranges of doc_id, sorted, and written as blocks of about
   ``BLOCK_TOKENS`` ids. A block can be read alone: it holds its documents' ids and lengths,
   the packed codes, and the bit offset of every ``CHECKPOINT``-th id.
4. A reader starts at all checkpoints of a block at once and looks codes up in a table.

A block, all integers little-endian unless said otherwise: ``TMH1``; four 32-bit counts (documents,
checkpoints, 32-bit words of codes, crc32 of what follows); 64-bit count of ids; 64-bit document
ids; one byte each that is 1 for a null id; 64-bit ids per document; 64-bit bit offsets; the codes
as big-endian 32-bit words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_table, in_arrow, new_path, written
from .word_pool import WordPool, binary, ragged, slices, utf8

LONGEST = 18
BLOCK_TOKENS = 1 << 17
CHECKPOINT = 128
PUNCTUATION = b".,;:!?&#$%*"  # no apostrophe, which may open a unit of letters, and nothing of a special token
TOGETHER = 200  # pieces that go to the library as one text
MAGIC = b"TMH1"
_HEAD = struct.Struct("<4sIIIIQ")
BLOCKS = "part int, start long, n_tokens long, block binary"
HEAD = "lengths binary, vocabulary int, end_id int, checkpoint int"


# --- the code ----------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code length of each symbol, 0 for symbols that do not occur; none above ``longest``."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 0:
        return out
    if n > 1 << longest:
        raise ValueError("more symbols than codes of that length")
    if n == 1:
        out[used] = 1
        return out
    by_weight = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[by_weight].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(longest - 1):  # coins of the next larger value: leaves and pairs of the level below
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_leaf.append(order < n)
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        chosen = int(flags[:take].sum())
        length[:chosen] += 1
        take = 2 * (take - chosen)
    out[by_weight] = length
    return out


@dataclass
class Code:
    """A canonical code: shorter codes first, then smaller symbols."""

    length: np.ndarray
    code: np.ndarray
    longest: int
    symbol_at: np.ndarray
    length_at: np.ndarray

    @classmethod
    def of(cls, length: np.ndarray) -> Code:
        used = np.flatnonzero(length)
        order = used[np.lexsort((used, length[used]))]
        longest = int(length.max()) if len(used) else 1
        code = np.zeros(len(length), np.uint64)
        width = (np.uint64(1) << (longest - length[order].astype(np.uint64))).astype(np.uint64)
        start = np.concatenate([[0], np.cumsum(width)[:-1]]).astype(np.uint64) if len(order) else np.zeros(0, np.uint64)
        code[order] = start >> (longest - length[order].astype(np.uint64)).astype(np.uint64)
        symbol_at = np.zeros(1 << longest, np.uint32)
        length_at = np.zeros(1 << longest, np.uint8)
        filled = int(width.sum())
        symbol_at[:filled] = np.repeat(order, width.astype(np.int64))
        length_at[:filled] = length[symbol_at[:filled]]
        return cls(length.astype(np.int64), code, longest, symbol_at, length_at)

    def pack(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of ``ids`` as 32-bit words, and the bit offset of each id."""
        length = self.length[ids]
        offset = np.cumsum(length) - length
        bits = int(offset[-1] + length[-1]) if len(ids) else 0
        n = (bits + 31) // 32 + 2  # a reader looks two words ahead
        word = offset >> 5
        shift = (64 - length - (offset & 31)).astype(np.uint64)
        value = self.code[ids] << shift
        high = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=n)
        low = np.bincount(word + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
        return (high + low).astype(np.uint32), offset

    def unpack(self, words: np.ndarray, start: np.ndarray, total: int) -> np.ndarray:
        """``total`` ids; all runs of ``CHECKPOINT`` ids are read side by side from their bit offsets."""
        out = np.zeros((len(start), CHECKPOINT), np.uint32)
        if not total:
            return out.ravel()[:0]
        wide = words.astype(np.uint64)
        pair = (wide[:-1] << np.uint64(32)) | wide[1:]
        position, live = start.astype(np.int64), len(start)
        last = total - (live - 1) * CHECKPOINT
        keep = np.uint64(64 - self.longest)
        for i in range(CHECKPOINT):
            if i == last:
                live -= 1
                position = position[:live]
            peek = ((pair[position >> 5] << (position & 31).astype(np.uint64)) >> keep).astype(np.int64)
            out[:live, i] = self.symbol_at[peek]
            position = position + self.length_at[peek]
        return out.ravel()[:total]


# --- blocks ------------------------------------------------------------------------------


def write_block(code: Code, doc_ids: list[int | None], texts_ids: list[np.ndarray]) -> bytes:
    ids = np.concatenate(texts_ids) if texts_ids else np.zeros(0, np.uint32)
    words, offset = code.pack(ids)
    start = offset[::CHECKPOINT].astype("<u8")
    body = b"".join(
        [
            np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
            np.array([i is None for i in doc_ids], "u1").tobytes(),
            np.array([len(t) for t in texts_ids], "<u8").tobytes(),
            start.tobytes(),
            words.astype(">u4").tobytes(),
        ]
    )
    return _HEAD.pack(MAGIC, len(doc_ids), len(start), len(words), zlib.crc32(body), len(ids)) + body


def read_block(code: Code, block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids of the block."""
    magic, n_docs, n_starts, n_words, crc, total = _HEAD.unpack_from(block)
    if magic != MAGIC or zlib.crc32(memoryview(block)[_HEAD.size :]) != crc:
        raise ValueError("not a token block, or a damaged one")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(block, kind, n, at)
        at += found.nbytes
        return found

    doc_ids, null, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    start, words = take("<u8", n_starts), take(">u4", n_words)
    ids = code.unpack(words, start, total)
    return [None if x else int(i) for i, x in zip(doc_ids, null, strict=True)], lengths.astype(np.int64), ids


# --- encoding texts ----------------------------------------------------------------------


class Encoder:
    """Byte-level vocabulary through the tokenizers library, with remembered pieces.

    The library's pattern starts a new unit at every space or line feed that is followed by a
    visible character, and where a letter or digit is followed by punctuation, so a text is cut there. Each distinct piece is encoded
    once and the ids are strung together. Other white space is no cut, nor is a space before a character that might be white space.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.opens = np.zeros(size, bool)
        for token, i in self.library.get_vocab().items():
            self.opens[i] = token[0] in "ĠĊ"  # a space and a line feed, as byte-level vocabularies write them
        self.visible = np.ones(256, bool)
        self.visible[[*range(9, 14), *range(0x1C, 0x21)]] = False
        self.word, self.punctuation = np.zeros(256, bool), np.zeros(256, bool)
        self.word[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
        self.punctuation[list(PUNCTUATION)] = True
        self.pool = WordPool(self.kind, self._new)

    def cuts(self, raw: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Where pieces begin: at the start of each text, and where a space or line feed precedes a visible character."""
        at = np.flatnonzero((raw == 32) | (raw == 10))
        wide = np.append(raw, np.full(3, 32, np.uint8))
        last = np.zeros(len(raw) + 1, bool)
        last[edge] = True
        at = at[self.visible[wide[at + 1]] & ~last[at + 1]]
        a, b, c = wide[at + 1], wide[at + 2], wide[at + 3]  # white space beyond ASCII has two or three bytes
        odd = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        odd |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        begins = np.zeros(len(raw), bool)
        begins[at[~odd]] = True
        begins[edge[:-1][edge[1:] > edge[:-1]]] = True
        begins[1:] |= self.word[raw[:-1]] & self.punctuation[raw[1:]]
        return np.flatnonzero(begins)

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts from the library, by its call that leaves out offsets where there is one."""
        call = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [x.ids for x in call(texts, add_special_tokens=False)] if texts else []

    def _new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces; those without other white space than what opens them go to the library together."""
        raw, size = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
        start, white = np.cumsum(size) - size, (raw == 32) | (raw == 10)
        plain = np.flatnonzero((np.add.reduceat(white, start, dtype=np.int64) == 1) & white[start] & (size > 1))
        found, counts, order = [], [], []
        parts = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        for part, done in zip(parts, self.ids_of([b"".join(map(pieces.__getitem__, x.tolist())).decode() for x in parts]), strict=True):
            ids = np.array(done, self.kind)
            first = np.flatnonzero(self.opens[ids])
            if len(first) == len(part) and first[0] == 0:
                found.append(ids)
                counts.append(np.diff(np.append(first, len(ids))))
                order.append(part)
        left = np.ones(len(pieces), bool)
        left[np.concatenate([np.zeros(0, np.int64), *order])] = False
        order.append(np.flatnonzero(left))
        rest = self.ids_of([pieces[i].decode() for i in order[-1].tolist()])
        found += [np.array(x, self.kind) for x in rest]
        counts.append(np.array([len(x) for x in rest], np.int64))
        ids, count, place = np.concatenate(found), np.concatenate(counts), np.argsort(np.concatenate(order))
        return ids[ragged((np.cumsum(count) - count)[place], count[place])], count[place]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, without any special ids, and where each text's begin and the last's end.

        One text of each call is encoded by the library as a whole as well; a difference raises.
        """
        raw, edge = utf8(column)
        if not len(raw):
            return np.zeros(0, self.kind), np.zeros(len(edge), np.int64)
        start = self.cuts(raw, edge)
        ids, count = self.pool.encode(raw, start)
        upto = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, edge)]
        row = int(np.flatnonzero(edge[1:] > edge[:-1])[0])
        if ids[upto[row] : upto[row + 1]].tolist() != self.ids_of([raw[edge[row] : edge[row + 1]].tobytes().decode()])[0]:
            raise RuntimeError("the library encodes a text otherwise than its pieces")
        return ids, upto


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_table(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and packed ids of every row, each document ended by ``end_id``. Null text counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in (part for batch in batches for part in slices(batch, 1)):
            ids, edge = enc.encode(part.column(1))
            packed = binary(np.insert(ids, edge[1:], end_id), edge + np.arange(len(edge)))
            yield pa.RecordBatch.from_arrays([part.column(0), packed], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.transform(in_arrow, work, "doc_id long, ids binary")


def id_counts(tokens: DataFrame, kind: np.dtype, size: int) -> np.ndarray:
    """Counts of all ids; tasks send sums, at most one row for each id of the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for part in (part for batch in batches for part in slices(batch, 0)):
            total += np.bincount(utf8(part.column(0))[0].view(kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").transform(in_arrow, work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for r in rows:  # bounded by the vocabulary
        counts[r["id"]] = r["n"]
    return counts


# --- files -------------------------------------------------------------------------------


@dataclass
class TokenFiles:
    """A written set of blocks; all that a reader needs lies under ``path``.

    ``blocks`` there is a table of blocks, ``code`` a table of one row: the code length of each id as one byte, the
    size of the vocabulary, the end id and the number of ids between checkpoints.
    """

    spark: SparkSession
    path: str

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(self.path + "/blocks")

    def read(self, fields: str, each: Callable[[list, np.ndarray, np.ndarray, int], list[pa.Array]]) -> DataFrame:
        """Decodes every block and gives ``each`` its document ids, their lengths, the ids and the start."""
        sums = self.blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # a row per file
        offsets, at = {}, 0
        for r in sorted(sums, key=lambda r: r["part"]):
            offsets[r["part"]], at = at, at + r["n"]
        head = self.spark.read.schema(HEAD).parquet(self.path + "/code").first()
        if head["checkpoint"] != CHECKPOINT or head["vocabulary"] != len(head["lengths"]):
            raise ValueError("token files of another make")
        lengths = bytes(head["lengths"])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code = Code.of(np.frombuffer(lengths, np.uint8))
            for batch in batches:
                for part, start, block in zip(*(batch.column(k) for k in range(3)), strict=True):
                    doc_ids, sizes, ids = read_block(code, block.as_py())
                    found = each(doc_ids, sizes, ids, offsets[part.as_py()] + start.as_py())
                    names = [f.split()[0] for f in fields.split(",")]
                    yield pa.RecordBatch.from_arrays(found, names=names)

        return self.blocks.select("part", "start", "block").transform(in_arrow, work, fields)


def open_files(spark: SparkSession, path: str) -> TokenFiles:
    """Token files that were written before, by this session or another."""
    return TokenFiles(spark, path)


def write_files(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", to: str | None = None) -> TokenFiles:
    """Encodes ``docs`` and writes them under ``to`` (a new folder in the shared one if not given) as blocks in
    ascending doc_id order (null ids first).

    Null and empty texts consist of the end id alone. Rows that repeat an id stay, next to
    each other. An empty table gives no blocks. Other columns are not read.
    """
    spark = docs.sparkSession
    enc = encoder(path)
    kind, size = enc.kind, max(enc.library.get_vocab_size(), end_id + 1)
    tokens, kept = written(token_table(docs, path, end_id, id_col, text_col), "token-ids")
    lengths = code_lengths(id_counts(tokens, kind, size)).tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code.of(np.frombuffer(lengths, np.uint8))
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        held = start = 0

        def block(part: int) -> pa.RecordBatch:
            nonlocal doc_ids, parts, held, start
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([held], pa.int64()),
                    pa.array([write_block(code, doc_ids, parts)], pa.binary()),
                ],
                names=["part", "start", "n_tokens", "block"],
            )
            doc_ids, parts, start, held = [], [], start + held, 0
            return out

        part = 0
        for batch in batches:
            for doc_id, ids, at in zip(*(batch.column(k) for k in range(3)), strict=True):
                part = at.as_py()
                doc_ids.append(doc_id.as_py())
                parts.append(np.frombuffer(ids.as_py(), kind))
                held += len(parts[-1])
                if held >= BLOCK_TOKENS:
                    yield block(part)
        if doc_ids:
            yield block(part)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tokens.repartitionByRange(n, F.col("doc_id").asc()).sortWithinPartitions("doc_id")
    numbered = dealt.select("doc_id", "ids", F.spark_partition_id().alias("part"))
    at = to or new_path(spark, "token-files")
    head = spark.createDataFrame([(bytearray(lengths), size, end_id, CHECKPOINT)], HEAD)
    head.coalesce(1).write.parquet(at + "/code")
    numbered.transform(in_arrow, work, BLOCKS).write.option("compression", "uncompressed").parquet(at + "/blocks")
    drop_table(spark, kept)
    return TokenFiles(spark, at)


def document_digests(files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, all read back from the blocks."""

    def each(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, start: int) -> list[pa.Array]:
        edge = np.concatenate([[0], np.cumsum(sizes)])
        raw = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return [
            pa.array(doc_ids, pa.int64()),
            pa.array(start + edge[:-1], pa.int64()),
            pa.array(sizes, pa.int64()),
            pa.array(crc, pa.int64()),
        ]

    return files.read("doc_id long, start long, n_tokens long, ids_crc32 long", each)
