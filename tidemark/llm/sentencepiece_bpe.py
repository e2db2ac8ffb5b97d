"""Encoding and decoding with merge-type sentencepiece vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by vocabulary score, then by
position, and merges until the agenda is empty. No piece of the supported vocabularies joins
a visible character to a following word mark, so merges never cross from one word into the
next; words are therefore encoded one by one and their ids remembered. The words that a batch adds are
worked on side by side: in each round, every word merges the first pair of its own agenda.

Every Arrow batch has the words that it adds, and whole texts of its own, compared with the sentencepiece library; a
difference stops the job.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow
from .word_pool import LONGEST_KEPT, NumberTable, WordPool, binary, ragged, slices, utf8

MARK = "▁"  # stands for a space
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # piece types of the model file

_ID = np.dtype("<u4")
TOGETHER = 100  # words that the library is asked for as one text
_NONE = np.int64(1 << 62)  # the rank of a pair that merges to nothing


class MergeVocabulary:
    """A vocabulary file and the agenda that applies it."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != 2:
            raise ValueError("not a merge-type vocabulary")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("only identity normalisation with a leading word mark is supported")
        if model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("word marks after a word are not supported")
        kinds = {p.type for p in model.pieces}
        if not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        if any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces if p.type == NORMAL):
            raise ValueError("a piece crosses from one word into the next")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self._index(model)
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.surface = []
        for p in model.pieces:
            if p.type == CONTROL:
                self.surface.append(b"")
            elif p.type == UNKNOWN:
                self.surface.append(model.trainer_spec.unk_surface.encode())
            elif p.type == BYTE:
                self.surface.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.surface.append(p.piece.replace(MARK, " ").encode())
        size = np.array([len(x) for x in self.surface], np.int64)
        self.shown = np.frombuffer(b"".join(self.surface), np.uint8)
        self.shown_at, self.shown_size = np.cumsum(size) - size, size
        self.marks = np.array([x[:1] == b" " and i not in self.byte_of and i != self.unknown for i, x in enumerate(self.surface)])
        self.pool = WordPool(_ID, self._new)

    def _index(self, model) -> None:
        """Numbers the symbols (pieces, then characters that are none) and lists what pairs merge to.

        A pair's entry holds the rank of its piece's score above the number of the piece;
        equal scores share a rank, so that position decides between them.
        """
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.n_pieces = len(model.pieces)
        symbol = {piece: i for piece, (i, _) in normal.items()}
        chars = dict.fromkeys(c for piece in normal for c in piece)
        for c in chars:
            symbol.setdefault(c, len(symbol) + self.n_pieces)
        self.symbol = {c: symbol[c] for c in chars}
        self.name = {n: c for c, n in self.symbol.items()}
        rank = {s: r for r, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
        self.pair = {
            symbol[piece[:k]] << 32 | symbol[piece[k:]]: rank[score] << 32 | i
            for piece, (i, score) in normal.items()
            for k in range(1, len(piece))
            if piece[:k] in symbol and piece[k:] in symbol
        }
        self.symbol_of = np.full(0x110000, -1, np.int64)
        for c, n in self.symbol.items():
            self.symbol_of[ord(c)] = n
        self.pairs = NumberTable()
        self.pairs.add(np.array(list(self.pair), np.uint64), np.array(list(self.pair.values()), np.int64))

    def merged(self, word: str) -> list[int | str]:
        """Symbols left when no adjacent pair merges any more; characters of no piece stay as they are."""
        pair, n = self.pair, len(word)
        part = [self.symbol.get(c, -1) for c in word]
        after, before = list(range(1, n + 1)), list(range(-1, n))
        agenda = []  # rank of the pair's score above the position of its left symbol
        for i in range(n - 1):
            m = pair.get(part[i] << 32 | part[i + 1])
            if m is not None:
                agenda.append(m >> 32 << 32 | i)
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            left = entry & 0xFFFFFFFF
            right = after[left]
            if right >= n or part[left] < 0:
                continue
            m = pair.get(part[left] << 32 | part[right])
            if m is None or m >> 32 != entry >> 32:
                continue  # one of the two has been merged otherwise
            part[left], part[right] = piece, _ = m & 0xFFFFFFFF, -2
            far = after[left] = after[right]
            before[far] = left
            if far < n:
                m = pair.get(piece << 32 | part[far])
                if m is not None:
                    heappush(agenda, m >> 32 << 32 | left)
            near = before[left]
            if near >= 0:
                m = pair.get(part[near] << 32 | piece)
                if m is not None:
                    heappush(agenda, m >> 32 << 32 | near)
        return [p if p >= 0 else word[i] for i, p in enumerate(part) if p != -2]

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word with its marks; characters without a piece become their bytes."""
        out, n = [], self.n_pieces
        for s in self.merged(word):
            if isinstance(s, int) and s < n:
                out.append(s)
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in (s if isinstance(s, str) else self.name[s]).encode())
            else:
                out.append(self.unknown)
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs of symbols merge to, as in ``pair``, or ``_NONE``."""
        out = self.pairs.find((left << 32 | right).astype(np.uint64))
        return np.where((out < 0) | (left < 0) | (right < 0), _NONE, out)

    def merged_words(self, part: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of each word, and how many; ``part`` has the symbols of all words, which begin at ``start``.

        A symbol of no number, below 0, merges with nothing and stays as it is.
        """
        n = len(part)
        word = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
        merge = np.full(n, _NONE)
        merge[:-1] = np.where(word[1:] == word[:-1], self._ranks(part[:-1], part[1:]), _NONE)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(part):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            at = np.arange(len(part))
            entry = np.where(merge == _NONE, _NONE, merge >> 32 << 32 | at)  # rank of the score, then position
            best = np.minimum.reduceat(entry, first)
            live = best != _NONE
            if not live.all():
                each = np.repeat(live, np.diff(np.append(first, len(part))))
                done.append((word[~each], part[~each]))
                moved = np.cumsum(each) - 1
                part, word, merge, at = part[each], word[each], merge[each], None
                left = moved[best[live] & 0xFFFFFFFF]
            else:
                left = best & 0xFFFFFFFF
            if not len(part):
                break
            part[left] = merge[left] & 0xFFFFFFFF
            keep = np.ones(len(part), bool)
            keep[left + 1] = False
            left = (np.cumsum(keep) - 1)[left]
            merge[np.flatnonzero(~keep) - 1] = _NONE
            part, word, merge = part[keep], word[keep], merge[keep]
            for one in (left, left - 1):  # the pairs on both sides of what is new
                one = one[(one >= 0) & (one + 1 < len(part))]
                merge[one] = np.where(word[one] == word[one + 1], self._ranks(part[one], part[one + 1]), _NONE)
        words, parts = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(words, kind="stable")
        return parts[order], np.bincount(words, minlength=len(start))

    def _new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, which begin with spaces for marks, and how many each has; compared with the library."""
        ids: list[np.ndarray | None] = [None] * len(pieces)
        short = [i for i, p in enumerate(pieces) if len(p) <= LONGEST_KEPT]
        for i, p in enumerate(pieces):
            if len(p) > LONGEST_KEPT:
                ids[i] = np.array(self.word_ids(p.decode().replace(" ", MARK)), _ID)
        if short:
            raw = b"".join(map(pieces.__getitem__, short))
            chars = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
            size = np.array([len(pieces[i]) for i in short])
            place = np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80) - 1
            symbols = self.symbol_of[np.where(chars == 32, ord(MARK), chars)]
            symbols = np.where(symbols < 0, -1 - chars, symbols)  # keeps the character
            left, count = self.merged_words(symbols, place[np.cumsum(size) - size])
            if ((left < 0) | (left >= self.n_pieces)).any():
                names = [[s] if 0 <= s < self.n_pieces else self._spelled(chr(-1 - s) if s < 0 else self.name[s]) for s in left.tolist()]
                count = np.add.reduceat([len(x) for x in names], np.cumsum(count) - count)
                left = np.array([i for x in names for i in x])
            left = left.astype(_ID)
            if len(short) == len(pieces):
                self._check(pieces, left, count)
                return left, count
            for i, x in zip(short, np.split(left, np.cumsum(count)[:-1]), strict=True):
                ids[i] = x
        counts = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids)
        self._check(pieces, flat, counts)
        return flat, counts

    def _spelled(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode()] if self.byte_id else [self.unknown]

    def _check(self, pieces: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        """Raises if the library splits any of the words otherwise. Words with one mark are asked for together."""
        edge = np.append(0, np.cumsum(counts))
        plain = [i for i, p in enumerate(pieces) if len(p) > 1 and p.rfind(b" ") == 0]
        odd = list(range(len(pieces)))
        if plain:
            texts = [b"".join(map(pieces.__getitem__, plain[at : at + TOGETHER]))[1:].decode() for at in range(0, len(plain), TOGETHER)]
            theirs = np.array([i for x in self.library.encode(texts, num_threads=1) for i in x], _ID)
            own = np.array(plain)
            mine = ids[ragged(edge[own], counts[own])]
            if len(mine) == len(theirs) and (mine == theirs).all():
                odd = sorted(set(odd).difference(plain))
        self.check_words([pieces[i].decode().replace(" ", MARK) for i in odd], [ids[edge[i] : edge[i + 1]].tolist() for i in odd])

    def check_words(self, words: list[str], ids: list[list[int]]) -> None:
        """Raises if the library splits any of the words otherwise. Each starts with a mark."""
        asked = [w[1:] if len(w) > 1 else MARK for w in words]
        for word, mine, theirs in zip(words, ids, self.library.encode(asked, num_threads=1) if asked else [], strict=True):
            if word == MARK:
                theirs = [self.library.piece_to_id(MARK)]
            if mine != theirs:
                raise RuntimeError(f"the library encodes {word!r} as {theirs}, the agenda as {mine}")

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Little-endian 32-bit ids of all texts, each with begin and end ids, and where each text's begin and the last's end.

        The first text that is not empty is encoded by the library as a whole as well.
        """
        raw, edge = utf8(column)
        if MARK.encode() in raw.tobytes():  # a mark in a text is a space to the vocabulary
            raw, edge = utf8(pa.array([(t or "").replace(MARK, " ") for t in column.to_pylist()], pa.string()))
        some = np.flatnonzero(edge[1:] > edge[:-1])
        text = raw[edge[some[0]] : edge[some[0] + 1]].tobytes().decode() if len(some) else ""
        raw = np.insert(raw, edge[some], 32)  # the leading mark
        edge = edge + np.append(0, np.cumsum(edge[1:] > edge[:-1]))
        begins = raw == 32
        begins[1:] &= raw[:-1] != 32
        begins[edge[some]] = True
        start = np.flatnonzero(begins)
        ids, count = self.pool.encode(raw, start)
        upto = np.append(0, np.cumsum(count))[np.searchsorted(start, edge)]
        whole = upto + 2 * np.arange(len(edge))
        out, own = np.zeros(whole[-1], _ID), np.ones(whole[-1], bool)
        own[whole[:-1]] = own[whole[1:] - 1] = False
        out[own], out[whole[:-1]], out[whole[1:] - 1] = ids, self.begin, self.end
        if len(some) and out[whole[some[0]] + 1 : whole[some[0] + 1] - 1].tolist() != self.library.encode(text):
            raise RuntimeError("the library encodes a text otherwise than its words")
        return out, whole

    def decode_rows(self, ids: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts, as bytes, of rows of ids, and where each begins and the last ends, as the library's decode(ids):
        control ids vanish, one leading mark too."""
        size = self.shown_size[ids]
        raw = self.shown[ragged(self.shown_at[ids], size)]
        at = np.append(0, np.cumsum(size))[edge]
        seen = np.append(np.flatnonzero(size), len(ids))
        first = seen[np.searchsorted(seen[:-1], edge[:-1])]  # the first id of each row that shows
        strip = np.zeros(len(at) - 1, bool)
        inside = first < edge[1:]
        strip[inside] = self.marks[ids[first[inside]]]
        keep = np.ones(len(raw), bool)
        keep[at[:-1][strip]] = False
        at = at - np.append(0, np.cumsum(strip))
        return raw[keep], at

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids."""
        ids = list(ids)
        raw = self.decode_rows(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes()
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self.library.decode(ids)


@lru_cache(2)
def vocabulary(path: str) -> MergeVocabulary:
    return MergeVocabulary(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row of ``docs``; with ``outputs`` also ids (little-endian
    32-bit, with begin and end ids) and decoded (text).

    Null text counts as empty, which has the begin and end ids only and decodes to "".
    Literal U+2581 in a text decodes to a space, as in the library. Null ids, repeated rows
    and empty tables pass through; other columns are not read. Each row is worked on alone,
    so no group can grow large; texts are worked on by the megabyte, a longer one alone.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in (part for batch in batches for part in slices(batch, 1)):
            ids, edge = vocab.encode(part.column(1))
            shown, at = vocab.decode_rows(ids, edge)
            raw, text = memoryview(ids.tobytes()), memoryview(shown.tobytes())
            own = [raw[4 * a : 4 * b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            decoded = [text[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            try:
                bytes(text).decode()
            except UnicodeDecodeError:
                decoded = [vocab.decode(np.frombuffer(i, _ID).tolist()).encode() for i in own]
            columns = [
                part.column(0),
                pa.array(np.diff(edge), pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in own], pa.string()),
                pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
            ]
            if outputs:
                columns += [binary(ids, edge), pa.array([bytes(d).decode() for d in decoded], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if outputs else 4]
    fields = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * outputs
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).transform(in_arrow, work, fields)
