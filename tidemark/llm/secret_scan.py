"""Secret scans: fixed patterns, and strings that look drawn at random.

Two character Markov models of the same order, one of random strings and one of ordinary identifiers,
are counted from labelled samples. A candidate is any run of token characters; those segments of it are
reported where the log-likelihood ratio of the two models, less ``LEAST_RATIO`` a pair, rises by ``EVIDENCE``. All of it
is DataFrame functions: positions follow from the lengths of matches and of the pieces between them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns that base spans are defined by.
KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYWORD + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"  # a shorter run holds no longer one
HEX = "[0-9a-f]{24,}"  # runs are taken whole, so this equals dropping short ones
CANDIDATE = "[A-Za-z0-9+/_-]{12,}"  # 12 characters in base 62 hold 71 bits; keys hold 64 and more
RUN = 64
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
SAMPLES = 4000  # labelled strings of either kind
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_-")
LEAST_RATIO = 0.6  # nats a character
MOST = 4.0  # nats a pair
EVIDENCE = 8.0  # nats beyond that: the prior odds of ordinary against random, 3000 to 1
# Parts of ordinary identifiers; samples join two to four of them.
PARTS = (
    "account action active address amount array author average balance batch bool buffer build byte cache call category channel char "
    "class client close code column comment config connect content context control copy count create current data date default delete "
    "description device document domain double edit element email enable end entry error event export factory failed field file filter "
    "first float folder format frame function group handle hash header height history home host image import index info input insert "
    "instance integer internal invoice item job key label language last length level limit line link list load local lock log login "
    "machine main manager map match max message method min mode model module month name network new next node note number object offset "
    "old open option order output owner page param parent parse password path payment phone point policy port position post price print "
    "process product profile project property provider query queue random range read record region remote report request reset response "
    "result return role root route row run sample save schema score search second section select send sequence server service session "
    "set size sort source stack start state status step stop store stream string style submit sum support switch system table tag target "
    "task template test text time title total track transaction tree type unit update upload user value version view week width window "
    "word work write year zone"
).split()


def labelled_samples(spark: SparkSession) -> DataFrame:
    """(label, value): ``SAMPLES`` random strings, in base 64 and base 16, and as many identifiers in four styles.

    Both are functions of a running number, so every run trains the same models.
    """
    i = F.col("id")
    digest = F.sha2(F.concat(F.lit("sample:"), i.cast("string")), 256)
    coded = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    value = F.when(i % 4 == 0, F.substring(digest, 1, 40)).otherwise(F.substring(coded, 1, 40))
    noise = spark.range(SAMPLES).select(F.lit("random").alias("label"), value.alias("value"))
    parts = F.split(F.lit(" ".join(PARTS)), " ")
    pick = lambda k: F.element_at(parts, (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    chosen = F.slice(F.array(*[pick(k) for k in range(4)]), 1, (i % 3 + 2).cast("int"))
    capital = F.transform(chosen, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 40)))
    number = (F.pmod(F.xxhash64(i, F.lit("n")), F.lit(2025))).cast("string")
    style = (
        F.when(i % 4 == 0, F.array_join(chosen, "_"))
        .when(i % 4 == 1, F.array_join(capital, ""))
        .when(i % 4 == 2, F.upper(F.array_join(chosen, "_")))
        .otherwise(F.array_join(chosen, "-"))
    )
    names = spark.range(SAMPLES).select(F.lit("ordinary").alias("label"), F.when(i % 5 == 0, F.concat(style, F.lit("_"), number)).otherwise(style).alias("value"))
    return noise.unionByName(names)


def train(samples: DataFrame) -> list[float]:
    """Log ratio of the two models for each pair of characters, by number of the first, then of the second.

    Each first character gets as many pairs more than seen as there are characters, dealt over the classes of the
    second as the label's pairs of classes are: pairs that are merely foreign to the samples are no sign of chance.
    Pairs with a separator may speak against chance, not for it, so a segment does not start or end in the word beside one;
    no other pair counts more than ``MOST``, so that one foreign pair (``v1``) is no evidence alone.
    At most a row for each label and pair comes to the driver.
    """
    known = samples.where("label IN ('random', 'ordinary') AND length(value) > 1")
    pairs = known.select("label", F.explode(F.expr("transform(sequence(1, length(value) - 1), i -> substring(value, i, 2))")).alias("pair"))
    pairs = pairs.where(F.col("pair").rlike(f"^[{ALPHABET}]{{2}}$"))
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    kind = {c: k for k, members in enumerate(CLASSES) for c in members}
    steps = {(label, i, j): 1 for label in ("random", "ordinary") for i in range(len(CLASSES)) for j in range(len(CLASSES))}
    for (label, pair), n in counts.items():
        steps[label, kind[pair[0]], kind[pair[1]]] += n

    def more(label: str, a: str, b: str) -> float:
        share = steps[label, kind[a], kind[b]] / sum(steps[label, kind[a], j] for j in range(len(CLASSES)))
        return len(ALPHABET) * share / len(CLASSES[kind[b]])

    out = []
    for a in ALPHABET:
        of = {label: [counts.get((label, a + b), 0) + more(label, a, b) for b in ALPHABET] for label in ("random", "ordinary")}
        total = {label: sum(n) for label, n in of.items()}
        row = [math.log(x / total["random"]) - math.log(y / total["ordinary"]) for x, y in zip(of["random"], of["ordinary"], strict=True)]
        out += [min(x, 0.0 if {a, b} & set(CLASSES[3]) else MOST) for b, x in zip(ALPHABET, row, strict=True)]
    return out


def _matches(text: Column, pattern: str, order: int, group: int = 0) -> Column:
    """Array of (start, order, end, value): the matches from left to right, value being the group's text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    none = F.array().cast("array<struct<start:int,order:int,end:int,value:string>>")

    def span(x: Column, end: Column) -> Column:
        return F.struct((end - F.length(x["found"])).alias("start"), F.lit(order).alias("order"), end.alias("end"), x["value"].alias("value"))

    def placed(triples: Column) -> Column:
        ends = running(F.transform(triples, lambda x: F.length(x["gap"]) + F.length(x["found"])), F.lit(0), lambda x, y: x + y)
        return F.zip_with(triples, ends, span)

    between = F.split(text, pattern, -1)  # one more than there are matches
    triples = F.arrays_zip(between.alias("gap"), found.alias("found"), value.alias("value"))
    triples = F.filter(triples, lambda x: x["found"].isNotNull())
    return F.when(text.rlike(pattern), let(triples, placed)).otherwise(none)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is used there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of ints, ``join`` over it and all before. ``join`` is associative and ``zero`` changes nothing.

    Runs of ``RUN`` elements are joined first, then their ends, as an array that grows by one element at a time is copied each time.
    """
    last = lambda x: F.get(x, F.size(x) - 1)
    grow = lambda acc, x: F.concat(acc, F.array(join(F.coalesce(last(acc), zero), x)))
    none = F.array().cast("array<int>")

    def runs(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))
        return F.transform(starts, lambda i: F.aggregate(F.slice(v, i * RUN + 1, F.lit(RUN)), none, grow))

    def joined(r: Column) -> Column:
        before = F.aggregate(F.transform(r, last), F.array(zero), grow)
        return F.flatten(F.zip_with(r, F.slice(before, F.lit(1), F.size(r)), lambda run, x: F.transform(run, lambda y: join(x, y))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(runs(v), joined)).otherwise(none))


def apart(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that meet none of ``base``; both are sorted together, and what begins before and after is looked at in passing."""
    marked = lambda of, own: F.transform(of, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s.alias("span")))
    far = F.lit((1 << 31) - 1)

    def free(both: Column) -> Column:
        reach = running(F.transform(both, lambda x: F.when(x["own"], 0).otherwise(x["end"])), F.lit(0), F.greatest)
        ahead = F.reverse(running(F.transform(F.reverse(both), lambda x: F.when(x["own"], far).otherwise(x["start"])), far, F.least))
        rows = F.arrays_zip(both.alias("x"), reach.alias("reach"), ahead.alias("ahead"))
        return F.transform(F.filter(rows, lambda y: y["x"]["own"] & (y["reach"] <= y["x"]["start"]) & (y["ahead"] >= y["x"]["end"])), lambda y: y["x"]["span"])

    return let(F.array_sort(F.concat(marked(spans, True), marked(base, False))), free)


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["order"]), s["start"], s["end"])), ",")


def pair_ratios(value: Column, ratios: list[float]) -> Column:
    """The models' log ratio of each character of ``value`` with its next; 0 for the last and for foreign characters."""
    table, n = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>"), len(ALPHABET)  # one constant
    numbers = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    of = lambda a, b: F.when((a > 0) & (b > 0), F.element_at(table, F.greatest(F.lit(1), (a - 1) * n + b))).otherwise(0.0)
    return F.zip_with(numbers, F.slice(numbers, F.lit(2), F.length(value)), of)


def log_ratio(value: Column, ratios: list[float]) -> Column:
    """Sum over the pairs of ``value`` of the models' log ratio."""
    return F.aggregate(pair_ratios(value, ratios), F.lit(0.0), lambda acc, x: acc + x)


def segments(run: Column, ratios: list[float]) -> Column:
    """The random-looking segments of a run (start, order, end, value), as an array of the same kind.

    One fold over the pairs: a segment starts where the sum of ratios is least and ends where it is greatest, and is
    closed once the sum has fallen by ``EVIDENCE`` from there. Ends are then moved out to the next separator.
    """
    value, origin = run["value"], run["start"]
    none = F.array().cast("array<struct<from:int,to:int>>")
    state = lambda *x: F.struct(*[c.alias(n) for c, n in zip(x, ("at", "sum", "from", "peak", "to", "found"), strict=True)])

    def closed(acc: Column) -> Column:
        return F.when(acc["peak"] >= EVIDENCE, F.concat(acc["found"], F.array(F.struct(acc["from"].alias("from"), acc["to"].alias("to"))))).otherwise(acc["found"])

    def step(acc: Column, x: Column) -> Column:
        at, total = acc["at"] + 1, acc["sum"] + x - LEAST_RATIO
        return (
            F.when(total <= F.greatest(F.lit(0.0), acc["peak"] - EVIDENCE), state(at, F.lit(0.0), at, F.lit(0.0), at, closed(acc)))
            .when(total > acc["peak"], state(at, total, acc["from"], total, at + 1, acc["found"]))
            .otherwise(state(at, total, acc["from"], acc["peak"], acc["to"], acc["found"]))
        )

    zero = state(F.lit(0), F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(0), none)
    found = F.aggregate(pair_ratios(value, ratios), zero, step, closed)
    before = lambda x: F.length(F.regexp_extract(F.substring(value, F.lit(1), x["from"]), "(?<![A-Za-z0-9])[A-Za-z0-9]*+$", 0))
    after = lambda x: F.length(F.regexp_extract(F.substring(value, x["to"] + 1, F.length(value)), "^[A-Za-z0-9]*+", 0))
    wide = F.transform(found, lambda x: F.struct((x["from"] - before(x)).alias("from"), (x["to"] + after(x)).alias("to")))

    def merge(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], x["to"]).alias("to"))))
        return F.when(F.coalesce(last["to"] > x["from"], F.lit(False)), joined).otherwise(F.concat(acc, F.array(x)))

    def span(x: Column) -> Column:
        text = F.substring(value, x["from"] + 1, x["to"] - x["from"])
        return F.struct((origin + x["from"]).alias("start"), run["order"].alias("order"), (origin + x["to"]).alias("end"), text.alias("value"))

    return F.transform(F.aggregate(wide, none, merge), span)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256 and spans of every row of ``docs``.

    Spans are kind:start:end in code points, end exclusive, in order of start, then kind. Base spans of
    different kinds may overlap; a random-looking string is added only where it meets no base span. Null text
    counts as empty and has no spans. Rows that repeat an id, and null ids, each get their own result; an empty table gives none. The
    time that a text takes grows with its length and hardly with the number of its spans. The models are trained from ``samples`` (label, which is
    ``random`` or ``ordinary``, and value), by default generated ones; null values, and labels of other names, are left out.
    """
    ratios = train(labelled_samples(docs.sparkSession) if samples is None else samples)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.select(
        "doc_id",
        F.filter(_matches(text, ASSIGN, 1, 2), lambda s: F.length(s["value"]) >= 6).alias("assign"),
        _matches(text, ACCESS, 2).alias("access"),
        _matches(text, HEX, 3).alias("hex"),
        _matches(text, CANDIDATE, 4).alias("candidate"),
    )
    rows = rows.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    rows = rows.withColumn("found", F.flatten(F.transform("candidate", lambda c: segments(c, ratios))))
    some = (F.size("found") > 0) & (F.size("base") > 0)
    rows = rows.withColumn("markov", F.when(some, apart(F.col("found"), F.col("base"))).otherwise(F.col("found")))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "markov"))).alias("spans"),
    )


def _spans_sql(kind: str, pattern: str, order: int) -> str:
    """(doc_id, start, k, finish, word) of the matches in the table t, by the lengths of matches and of what lies between them."""
    return f"""SELECT r, {order} AS k, '{kind}' AS kind, unnest(list_zip(generate_series(1, len(m)), m)) AS z, g, m, v FROM (
      SELECT r, regexp_extract_all(body, $p${pattern}$p$) AS m, string_split_regex(body, $p${pattern}$p$) AS g, regexp_extract_all(body, $p${pattern}$p$, {2 if order == 1 else 0}) AS v FROM t)"""


ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
u AS ({_spans_sql("assign", ASSIGN, 1)} UNION ALL {_spans_sql("access", ACCESS, 2)} UNION ALL {_spans_sql("hex", HEX, 3)}),
p AS (
  SELECT r, k, kind, list_sum([length(x) FOR x IN g[1:z[1]]]) + coalesce(list_sum([length(x) FOR x IN m[1:z[1] - 1]]), 0) AS start, length(z[2]) AS size, length(v[z[1]]) AS word FROM u),
b AS (SELECT * FROM p WHERE k != 1 OR word >= 6),
d AS (
  SELECT r, count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex,
         string_agg(kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + size AS BIGINT) AS VARCHAR), ',' ORDER BY start, k) AS spans
  FROM b GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM t LEFT JOIN d USING (r)
"""
