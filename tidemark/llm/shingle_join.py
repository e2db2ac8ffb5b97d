"""Near duplicates by an exact Jaccard join over word shingles, with token-combination prefixes.

Shingles are tokens in one global order: rare ones first, then the frequent ones by their counts. Frequency
alone decides how a token is indexed. Take two sets x and y that reach the similarity t, o being the size of their intersection.

* If the first token that they share is rare, it lies in the first n - ceil(t n) + 1 tokens of either set:
  rare tokens of that prefix are indexed one by one.
* Otherwise all that they share is frequent. Between the first shared token and a later one, each token that only one of
  them has can part two shared neighbours, so among the first tokens that they share there are two that stand next
  to each other in both sets: x has n_x - o tokens of its own and y has n_y - o, and o - 1 is more than both together.
  The second of the two lies in the first 2 (n_x - o) + (n_y - o) + 2 <= 2 (1 - t) n_x + 2 tokens of x. So
  the prefix is extended that far, and combinations of two frequent neighbours are indexed instead of the tokens. There are as many
  combinations as tokens, however long a text is.

What comes before the first common list of a pair is not shared, apart from what the argument above allows. Hence
the places of the list's token in both sets bound the intersection, and a pair is looked at only in the few lists where the bound
reaches the similarity. Near copies differ by rare tokens, which come first, so the bound is close to the truth.

Groups of near copies would make each list quadratic. Two things prevent that:

* Sets that are equal are one node from the start.
* Every list first links its members to its head alone (the member with the fewest tokens before it),
  with verification, and components are formed. Then each list is searched for pairs across components: the members of its most
  frequent component are dealt out in blocks and never meet each other, and only the others meet everyone.

Candidates that bitmaps of their sets do not rule out are verified on the words themselves. Nothing is sampled or capped; which tokens count as frequent only changes the cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import drop_table, in_arrow, maybe_among, split_by, write_table, written
from .word_pool import slices

WORDS = 5
SIMILAR = (75, 100)  # linked when 100 * intersection >= 75 * union
FREQUENT_TOKENS = 1 << 20  # most tokens that the order may know as frequent: bounds what is broadcast
LEAST_FREQUENT = 16  # the least count of a frequent token; doubled until no more than that many are left
CHUNK = 3 << 20  # tokens that a task counts at once
SALT_ROWS = 4096  # rows of one combination in one list
BLOCK = 4096  # rows of a list's most frequent component that are searched by one task
PAIRS = 1 << 18  # pairs that a task looks at at once
TEXT_BYTES = 1 << 18  # bytes of text that are worked on at once; a longer text is worked on alone
SIGNATURE_BITS = 4  # for each token of a set, rounded up to a power of two

_PRIME = [np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


# --- sets --------------------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """64-bit numbers of the shingles of texts, taken over many texts at once.

    A word's number is a sum, modulo 2**64, of one pseudo-random number for each byte times one for its place.
    """

    def __init__(self, seed: int):
        import xxhash

        self.seed, self.xxhash = seed, xxhash
        numbers = _mixed(np.arange(256 + 2 * 4096, dtype=np.uint64) + np.uint64((seed + 1) << 20))
        self.byte, self.near, self.far = numbers[:256].copy(), numbers[256:4352], numbers[4352:]
        self.byte[65:91] = self.byte[97:123]  # A-Z as a-z
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct tokens of each text; none for a text without words."""
        out, held, size = [], [], 0
        for t in texts:
            raw = t.encode("utf-8", "surrogatepass") if t else b""
            if held and size + len(raw) > TEXT_BYTES:
                out += self._sets(held)
                held, size = [], 0
            held.append(raw)
            size += len(raw)
        return out + self._sets(held) if held else out

    def _sets(self, texts: list[bytes]) -> list[np.ndarray]:
        none = np.zeros(0, np.uint64)
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        at = np.flatnonzero(~self.space[raw])
        if not len(at):
            return [none] * len(texts)
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1] + 1
        start = np.flatnonzero(first)
        length = np.diff(np.append(start, len(at)))
        place = np.arange(len(at)) - np.repeat(start, length)
        if length.max() <= 4096:
            number = self.byte[raw[at]] * self.near[place]
        else:
            number = self.byte[raw[at]] * (self.near[place & 4095] ^ (self.far[place >> 12 & 4095] * (place > 4095)))
        w = _mixed(np.add.reduceat(number, start) + length.astype(np.uint64) * _PRIME[0])
        edge = np.cumsum(np.array([len(t) + 1 for t in texts]))
        of = np.searchsorted(edge, at[start], "right")
        words = np.bincount(of, minlength=len(texts))
        n = len(w) - WORDS + 1
        if n > 0:
            whole = of[:n] == of[WORDS - 1 :]
            h = np.full(n, WORDS, np.uint64)
            for j in range(WORDS):
                h += w[j : j + n] * _PRIME[j]
            h, counts = _mixed(h[whole]), np.bincount(of[:n][whole], minlength=len(texts))
        else:
            h, counts = none, np.zeros(len(texts), np.int64)
        out, last, word = [], 0, 0
        for c, k in zip(counts.tolist(), words.tolist(), strict=True):
            if c:
                t = h[last : last + c]
                t.sort()
                new = t[1:] != t[:-1]
                out.append(t if new.all() else t[np.append(True, new)])
                last += c
            elif k:
                out.append(self._short(w[word : word + k]))
            else:
                out.append(none)
            word += k
        return out

    def _short(self, w: np.ndarray) -> np.ndarray:
        h = np.array([len(w)], np.uint64)
        for j in range(len(w)):
            h = _mixed(h * _PRIME[j] + w[j])
        return h

    def node(self, tokens: np.ndarray) -> tuple[int, int]:
        """Two 64-bit numbers of a set, signed."""
        d = self.xxhash.xxh3_128_digest(tokens.astype("<u8").tobytes(), self.seed)
        return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


@lru_cache(4)
def shingler(seed: int) -> Shingler:
    return Shingler(seed)


class _Seen:
    """Nodes that a task has met; forgetting some only repeats work."""

    def __init__(self):
        self.nodes: set[int] = set()

    def new(self, node: int) -> bool:
        if len(self.nodes) > 1_000_000:
            self.nodes.clear()
        n = len(self.nodes)
        self.nodes.add(node)
        return len(self.nodes) > n


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def signature(tokens: np.ndarray) -> bytes:
    """A bitmap in which every token turns one bit over, so that bitmaps of two sets differ in no more bits than
    there are tokens that only one of them has."""
    bits = 1 << max(6, (SIGNATURE_BITS * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def least_difference(one: bytes, other: bytes) -> int:
    """How many tokens two sets differ in at least; the longer signature is folded to the length of the shorter."""
    short, long = sorted((one, other), key=len)
    x, y, n = int.from_bytes(short, "little"), int.from_bytes(long, "little"), 8 * len(long)
    while n > 8 * len(short):
        n //= 2
        y = (y >> n) ^ (y & ((1 << n) - 1))
    return (x ^ y).bit_count()


def _scan(docs: DataFrame, seed: int) -> DataFrame:
    """Rows of documents (kind 0) and of tokens that a chunk of new sets holds more than once (kind 1).

    The first document of a set that a task meets has the set's signature.
    """
    names = ["kind", "doc_id", "n", "node", "check", "mark", "sig"]
    kinds = [pa.int8(), *[pa.int64()] * 5, pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh, seen, held, size = shingler(seed), _Seen(), [], 0

        def counted() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            token, n = token[n > 1], n[n > 1]
            kind = pa.array(np.ones(len(n), np.int8))
            none = pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_arrays([kind, none, pa.array(n, pa.int64()), _signed(token), none, none, pa.nulls(len(n), pa.binary())], names=names)

        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                doc_ids, texts, marks = (c.to_pylist() for c in part.columns)
                for doc_id, t, mark in zip(doc_ids, sh.sets(texts), marks, strict=True):
                    node, check = sh.node(t) if len(t) else (None, None)
                    new = len(t) > 0 and seen.new(node)
                    rows.append((0, doc_id, len(t), node, check, mark, signature(t) if new else None))
                    if new:
                        held.append(t)
                        size += len(t)
                        if size >= CHUNK:
                            yield counted()
                            held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
        if held:
            yield counted()

    rows = docs.select("doc_id", "text", "mark")
    return rows.transform(in_arrow, work, "kind byte, doc_id long, n long, node long, check long, mark long, sig binary")


# --- lists -------------------------------------------------------------------------------


def _extent(n: int) -> tuple[int, int]:
    """Tokens of the prefix of a set of ``n``, and of the extended one."""
    least, most = SIMILAR
    return n - -(-n * least // most) + 1, min(n, 2 * (most - least) * n // most + 2)


def _indexed(t: np.ndarray, known: np.ndarray, count: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, ...]:
    """What a set is listed under: keys, how many salts each has, places, and places among the frequent tokens.

    ``t`` has the set's tokens in order of their numbers, ``known`` the frequent ones with their ``count``, and ``maybe``
    the places in ``t`` of tokens that may be frequent. A single token counts as the first frequent one.
    """
    n = len(t)
    often = np.zeros(n, np.int64)
    if len(maybe):
        at = np.minimum(np.searchsorted(known, t[maybe]), len(known) - 1)
        often[maybe] = np.where(known[at] == t[maybe], count[at], 0)
    rare = n - int(np.count_nonzero(often))
    prefix, extended = _extent(n)
    order = np.argsort(often, kind="stable")[: max(prefix, extended)]  # tokens are in order already
    t, often = t[order], often[order]
    singles = min(rare, prefix)
    pairs = max(0, extended - rare - 1) if rare < prefix else 0  # what is rare is not shared in this case
    first, second = t[rare : rare + pairs], t[rare + 1 : rare + 1 + pairs]
    key = np.concatenate([t[:singles], _mixed(first * _PRIME[0] + _mixed(second + _PRIME[1]))])
    salts = np.concatenate([np.ones(singles, np.int64), often[rare : rare + pairs] // SALT_ROWS + 1])
    place = np.concatenate([np.arange(1, singles + 1), np.arange(rare + 2, rare + 2 + pairs)])
    ordinal = np.concatenate([np.ones(singles, np.int64), np.arange(2, 2 + pairs)])
    return key, salts, place, ordinal


def _postings(docs: DataFrame, seed: int, frequent) -> DataFrame:
    """(key, salts, salt, node, n, pos, ord) for what every set that is new to its task is listed under."""
    names = ["key", "salts", "salt", "node", "n", "pos", "ord"]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh, seen = shingler(seed), _Seen()
        known, count = frequent.value
        likely = np.zeros(1 << 24, bool)  # by the first bits of a token, whether it may be frequent
        likely[(known >> np.uint64(40)).astype(np.int64)] = True
        for batch in (part for whole in batches for part in slices(whole, 0)):
            found: list[list[np.ndarray]] = [[] for _ in names]
            for t in sh.sets(batch.column(0).to_pylist()):
                if not len(t):
                    continue
                node = sh.node(t)[0]
                if not seen.new(node):
                    continue
                key, salts, place, ordinal = _indexed(t, known, count, np.flatnonzero(likely[(t >> np.uint64(40)).astype(np.int64)]))
                row = (key, salts, (node & 0x7FFFFFFF) % salts, np.full(len(key), node), np.full(len(key), len(t)), place, ordinal)
                for column, x in zip(found, row, strict=True):
                    column.append(x)
            if found[0]:
                key, *rest = (np.concatenate(c) for c in found)
                columns = [_signed(key), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("text").transform(in_arrow, work, "key long, salts int, salt int, node long, n int, pos int, ord int")


def _grouped(batches: Iterator[pa.RecordBatch], by: list[int]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of whole groups of sorted rows, and where each group starts; the last group waits for more."""
    carry: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if carry is not None:
            columns = [np.concatenate(x) for x in zip(carry, columns, strict=True)]
        if not len(columns[0]):
            continue
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.any([columns[i][1:] != columns[i][:-1] for i in by], axis=0)
        start = np.flatnonzero(new)
        last = start[-1]
        carry = [c[last:] for c in columns]
        if last:
            yield [c[:last] for c in columns], start[:-1]
    if carry is not None:
        yield carry, np.zeros(1, np.int64)


def _shared_lists(postings: DataFrame) -> DataFrame:
    """Rows of lists with company, with the head of the list: lnode, ln, lpos, lord."""
    names = ["key", "salts", "node", "n", "pos", "ord", "lnode", "ln", "lpos", "lord"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, start in _grouped(batches, [0, 2]):
            again = np.zeros(len(columns[0]), bool)  # a set that several tasks have met
            again[1:] = columns[3][1:] == columns[3][:-1]
            again[start] = False
            if again.any():
                start = start - np.cumsum(again)[start]
                columns = [c[~again] for c in columns]
            size = np.diff(np.append(start, len(columns[0])))
            lead = np.repeat(start, size)
            keep = np.flatnonzero((np.repeat(size, size) > 1) | (columns[1] > 1))
            if not len(keep):
                continue
            key, salts, _, *own = columns
            out = [c[keep] for c in (key, salts, *own)] + [c[lead[keep]] for c in own]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "pos", "node")
    return dealt.transform(in_arrow, work, "key long, salts int, node long, n int, pos int, ord int, lnode long, ln int, lpos int, lord int")


def _in_reach(n1: Column, p1: Column, o1: Column, n2: Column, p2: Column, o2: Column) -> Column:
    """Whether sets of those sizes can be linked if this list is the first that has both.

    The tokens that they share up to the list's second token are the two neighbours and, for each token there that only one
    has, one more at most: no more than a third of both ordinals together, and 2.
    """
    least, most = SIMILAR
    before = F.least(F.floor((o1 + o2 + 2) / 3), o1, o2)
    similar_size = F.least(n1, n2) * most >= F.greatest(n1, n2) * least
    return similar_size & ((before + F.least(n1 - p1, n2 - p2)) * (least + most) >= (n1 + n2) * least)


def _star_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of each member with the head of its list, and of the heads over the salts of a key."""
    c = F.col
    near = lists.where("node != lnode").where(_in_reach(c("n"), c("pos"), c("ord"), c("ln"), c("lpos"), c("lord"))).select("node", "lnode")
    heads = lists.where("salts > 1 AND node = lnode")
    top = heads.groupBy("key").agg(F.min(F.struct("pos", "node", "n", "ord")).alias("top"))
    over = heads.join(top, "key").where("node != top.node")
    over = over.where(_in_reach(c("n"), c("pos"), c("ord"), c("top.n"), c("top.pos"), c("top.ord"))).select("node", F.col("top.node").alias("lnode"))
    return near.unionByName(over).select(F.least("node", "lnode").alias("a"), F.greatest("node", "lnode").alias("b")).distinct()


# --- verification ------------------------------------------------------------------------


def words_of(text: str | None) -> set[tuple[bytes, ...]]:
    """The shingles of a text as words."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # ASCII letters and white space only
    return set(zip(*(w[i:] for i in range(WORDS)), strict=False)) if len(w) >= WORDS else {tuple(w)} if w else set()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _near(pairs: DataFrame, scanned: DataFrame) -> tuple[DataFrame, str]:
    """Those of the pairs (a, b) that signatures do not rule out."""
    least, most = SIMILAR

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 4)):
            _, _, na, nb, sig_a, sig_b = (c.to_pylist() for c in batch.columns)
            keep = [(n + m - least_difference(x, y)) * (least + most) >= 2 * least * (n + m) for n, m, x, y in zip(na, nb, sig_a, sig_b, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    spark = pairs.sparkSession
    asked, at = written(_ends(pairs), "join-asked")
    sigs = maybe_among(scanned.where("sig IS NOT NULL").select("node", "n", "sig"), F.col("node"), asked).join(asked, "node", "left_semi")
    sigs, path = written(sigs.dropDuplicates(["node"]), "join-signatures")
    first = pairs.join(sigs.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sig_a")), "a")
    both = first.join(sigs.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sig_b")), "b")
    found = written(both.select("a", "b", "na", "nb", "sig_a", "sig_b").transform(in_arrow, work, "a long, b long"), "join-near")
    for x in (at, path):
        drop_table(spark, x)
    return found


def _texts(docs: DataFrame, seed: int, classes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, str]:
    """(node, text) for the nodes of ``pairs``, one text each.

    Rows are found by the hash of the text that ``classes`` names, behind a filter, so no other text moves.
    """
    names = ["node", "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = shingler(seed)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            asked, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = [len(t) > 0 and sh.node(t)[0] == node for node, t in zip(asked, sh.sets(texts), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    asked, at = written(_ends(pairs).join(classes.select("node", "mark"), "node"), "join-asked")
    rows = maybe_among(docs.select("text", "mark"), F.col("mark"), asked.select("mark")).dropDuplicates(["mark", "text"])
    found = asked.join(rows, "mark").select(*names).transform(in_arrow, work, "node long, text string")
    texts, path = written(found.dropDuplicates(["node"]), "join-texts")
    drop_table(docs.sparkSession, at)
    return texts, path


def _links(docs: DataFrame, seed: int, scanned: DataFrame, classes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that reach the similarity, by their words."""
    least, most = SIMILAR

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in (part for whole in batches for part in slices(whole, 3)):
            keep = []
            for a, first, second in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if a != last:
                    last, left = a, words_of(first.as_py())
                right = words_of(second)
                both = len(left & right)
                keep.append(both * most >= (len(left) + len(right) - both) * least)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    pairs, near_at = _near(candidates, scanned)
    texts, path = _texts(docs, seed, classes, pairs)
    second = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    rows = second.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    found = write_table(rows.select("a", "b", "text_a", "text_b").transform(in_arrow, work, "a long, b long"), "join-links")
    for x in (near_at, path):
        drop_table(docs.sparkSession, x)
    return found


# --- what the stars leave ----------------------------------------------------------------


def _unresolved(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of keys whose members are in more than one component, dealt out in blocks: kind is 0 for the rows at
    home in their block, 1 for visitors from others, and 2 for those of the key's most frequent component.

    A list's head has met all the others already, so it is left out where the list is the whole key.
    """
    known = lists.where("salts > 1 OR node != lnode").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = known.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    split = sizes.groupBy("key").agg(F.sum("size").alias("members"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("size", "comp")).alias("most"))
    split = split.where("comps > 1").select("key", F.ceil(F.col("members") / BLOCK).alias("blocks"), F.col("most.comp").alias("main"))
    rows = known.join(split, "key").withColumn("home", F.pmod(F.xxhash64("node"), F.col("blocks")))
    cells = F.when(F.col("comp") == F.col("main"), F.array("home")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("block", F.explode(cells))
    kind = F.when(F.col("comp") == F.col("main"), 2).when(F.col("block") == F.col("home"), 0).otherwise(1)
    return rows.select("key", F.col("block").cast("int").alias("block"), kind.alias("kind"), "node", "n", "pos", "ord", "comp")


def _partners(kind: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of sorted groups, where its partners begin in its group, and how many they are up to its end."""
    end = np.append(start[1:], len(kind))
    size = np.diff(np.append(start, len(kind)))
    main = end - np.add.reduceat((kind == 2).astype(np.int64), start)  # where the rows of kind 2 begin
    at = np.arange(len(kind))
    first = np.where(kind == 0, at + 1, np.repeat(main, size))
    count = np.where(kind == 2, 0, np.repeat(end, size) - first)
    return first, count


def _cross_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, across components of each list that size and place do not rule out."""
    least, most = SIMILAR

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def pairs() -> pa.RecordBatch:
            both = np.unique(np.concatenate(held), axis=0)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for (_, _, kind, node, n, pos, ordinal, comp), start in _grouped(batches, [0, 1]):
            first, count = _partners(kind, start)
            upto = np.cumsum(count)
            rest, row = n - pos, 0
            while row < len(count):
                stop = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + PAIRS)))
                k = count[row:stop]
                one = np.repeat(np.arange(row, stop), k)
                other = np.arange(len(one)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[row:stop], k)
                row = stop
                ok = comp[one] != comp[other]
                one, other = one[ok], other[ok]
                n1, n2, o1, o2 = n[one], n[other], ordinal[one], ordinal[other]
                before = np.minimum((o1 + o2 + 2) // 3, np.minimum(o1, o2))
                ok = (before + np.minimum(rest[one], rest[other])) * (least + most) >= (n1 + n2) * least
                ok &= np.minimum(n1, n2) * most >= np.maximum(n1, n2) * least
                one, other = node[one[ok]], node[other[ok]]
                if len(one):
                    held.append(np.stack([np.minimum(one, other), np.maximum(one, other)], axis=1))
                    if sum(map(len, held)) > PAIRS:
                        yield pairs()
        if held:
            yield pairs()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = [F.col(c).cast("long").alias(c) for c in ("key", "block", "kind", "node", "n", "pos", "ord", "comp")]
    dealt = rows.select(*wide).repartition(parts, "key", "block").sortWithinPartitions("key", "block", "kind")
    return dealt.transform(in_arrow, work, "a long, b long").distinct()


# --- the operator ------------------------------------------------------------------------


def _frequent(spark: SparkSession, scanned: DataFrame):
    """The frequent tokens in order, with their counts; at most ``FREQUENT_TOKENS`` by the choice of the bound."""
    counts, path = written(scanned.where("kind = 1").groupBy(F.col("node").alias("token")).agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_FREQUENT), "join-counts")
    bound = F.floor(F.log2(F.col("n") / LEAST_FREQUENT)).cast("int").alias("bound")
    least, total = LEAST_FREQUENT, 0
    for r in sorted(counts.groupBy(bound).agg(F.count(F.lit(1)).alias("tokens")).collect(), key=lambda r: -r["bound"]):  # a row for each power of two
        total += r["tokens"]
        if total > FREQUENT_TOKENS:
            least = LEAST_FREQUENT << (r["bound"] + 1)
            break
    rows = counts.where(F.col("n") >= least).toArrow()
    drop_table(spark, path)
    token = rows["token"].to_numpy().view(np.uint64) if rows.num_rows else np.zeros(1, np.uint64)
    count = rows["n"].to_numpy() if rows.num_rows else np.zeros(1, np.int64)
    order = np.argsort(token)
    return spark.sparkContext.broadcast((token[order], count[order]))


def _scanned(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """The scan, its classes (node, class_id, mark), and the seed by which no two different sets have one number."""
    for attempt in range(seed, seed + 4):
        scanned, path = written(_scan(docs, attempt), "join-scan")
        classes = scanned.where("kind = 0 AND n > 0").groupBy("node")
        classes = classes.agg(F.min("doc_id").alias("class_id"), F.min("mark").alias("mark"), F.min("check").alias("x"), F.max("check").alias("y"))
        if classes.where("x != y").isEmpty():
            return scanned, classes.select("node", "class_id", "mark"), attempt
        drop_table(docs.sparkSession, path)
    raise RuntimeError("different sets had the same 64-bit number under four seeds")


def _decided(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, node, component_id, class_id and stays (whether the
    node is the one that represents its component) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    scanned, classes, seed = _scanned(docs, seed)
    frequent = _frequent(spark, scanned)
    lists, lists_at = written(_shared_lists(_postings(docs, seed, frequent)), "join-lists")
    frequent.unpersist()
    pairs, pairs_at = written(_star_pairs(lists), "join-pairs")
    comps = write_table(components(_links(docs, seed, scanned, classes, pairs)), "join-components")

    more, more_at = written(_cross_pairs(_unresolved(lists, comps)).join(pairs, ["a", "b"], "left_anti"), "join-pairs")
    for path in (lists_at, pairs_at):
        drop_table(spark, path)
    if not more.isEmpty():
        links = _links(docs, seed, scanned, classes, more)
        if not links.isEmpty():  # stars stand for the links so far
            found = comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))
            comps = write_table(components(found.unionByName(links)), "join-components")
    drop_table(spark, more_at)

    named = classes.select("node", "class_id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    label = named.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    stays = F.coalesce(F.col("class_id") == F.col("component_id"), F.col("node") == F.col("comp"))
    named = named.join(label, "comp").select("node", "class_id", "component_id", stays.alias("stays"))
    named = write_table(named, "join-named")
    rows = scanned.where("kind = 0").select("doc_id", "mark", F.col("n").alias("n_shingles"), "node")
    own = F.col("doc_id")
    alone = rows.where("n_shingles = 0").withColumns({"component_id": own, "class_id": own, "stays": F.lit(True)})
    return rows.where("n_shingles > 0").join(named, "node").select(alone.columns).unionByName(alone)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id of every row of ``docs``.

    component_id is the smallest doc_id of the documents reachable by links, itself included; class_id that of the
    documents with the same set. Null and empty texts, and such without words, have no shingles, are linked with
    nothing and have their own id as component. A null id takes part, and has a null component unless a document
    with an id is reachable. Rows that repeat an id are documents of their own with one id. An empty table
    gives no rows. Other columns are not read, so their names cannot clash. Sets are counted and equal sets found by 64-bit numbers
    of their shingles (two numbers for a set); links between different sets are decided by the words.
    """
    return _decided(docs, id_col, text_col, seed).select("doc_id", "n_shingles", "component_id", "class_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """The rows of ``docs``, with all their columns, that represent their components.

    That is the row of the smallest id; in a component without any id, a row of one of its sets. Of rows that repeat
    that id with the same set, one stays. Rows without shingles stay, but of those that repeat an id and a text one. Columns may
    have any names. Only rows that may go, or that repeat an id and a text, are moved.
    """
    decided = write_table(_decided(docs, id_col, text_col, seed).select("doc_id", "mark", "n_shingles", "node", "component_id", "stays"), "join-decided")
    stays = F.col("stays") & (F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")))
    like = ["doc_id", "node", F.when(F.col("n_shingles") == 0, F.col("mark")).alias("text")]
    kept = write_table(decided.where(stays).groupBy(*like).agg(F.min("mark").alias("mark")).select("doc_id", "mark"), "join-kept")
    which = F.xxhash64("doc_id", "mark").alias("which")
    counts = decided.groupBy(which).agg(F.count(F.lit(1)).alias("n")).join(kept.select(which, F.lit(1).alias("good")).distinct(), "which", "left")
    moved = write_table(counts.where("n > 1 OR good IS NULL").select("which"), "join-moved")

    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"))
    hit, rest = split_by(whole.withColumn("which", which), F.col("which"), moved)
    same = hit["doc_id"].eqNullSafe(kept["doc_id"]) & (hit["mark"] == kept["mark"])
    rank = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy(F.lit(1)))
    one = hit.join(kept, same, "left_semi").withColumn("rank", rank).where("rank = 1")
    return rest.select("row.*").unionByName(one.select("row.*"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT r, doc_id,
         CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[])
              WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
              ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN generate_series(1, len(words) - 4)])
         END AS shingles
  FROM w),
x AS (SELECT r, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
links AS (
  SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.r < b.r
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT r, r AS other FROM s UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.other = e.a)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN s o ON o.r = reach.other GROUP BY reach.r) c ON c.r = s.r
"""
