"""SQL of the operators, loops beside them, foreign inputs, and the pipeline against a plain version of it."""

import hashlib
import math
import random
import string
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_llm import ODD, brute_components, common_texts, docs, empty, families, needs_vocabularies, public_tokenizers, reshared
from test_queries import SF, canonical, views
from tidemark.llm import exact_dedup, language_id, mpeg_audio, queries, secret_scan, sentencepiece_bpe, shared, shingle_join, source_mix, token_files, toxicity, warc_derive, word_pool


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    theirs = views().execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    mine = queries.QUERIES[name](spark, SF)
    assert canonical(mine.columns, mine.collect()) == canonical(names, theirs.fetchall())


# --- shared parts ---------------------------------------------------------------------


def test_filter_keeps_all_that_is_asked_for(spark):
    rows = spark.range(-500, 500).select("id", (F.col("id") * 7919).alias("k"), F.lit("x").alias("_bucket")).union(spark.createDataFrame([(1000, None, "x")], "id long, k long, _bucket string"))
    keys = spark.createDataFrame([(i * 7919,) for i in range(-20, 20)] + [(None,)], "k long")
    hit, rest = shared.split_by(rows, F.col("k"), keys)
    found = {r["id"] for r in hit.collect()}
    assert set(range(-20, 20)) <= found and len(found) < 60 and 1000 not in found
    assert hit.count() + rest.count() == 1001 and hit.columns == rows.columns
    assert shared.maybe_among(rows, F.col("k"), keys.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [10**6, 50])
def test_pool_gives_each_piece_its_ids(monkeypatch, limit):
    monkeypatch.setattr(word_pool, "REMEMBERED", limit)
    monkeypatch.setattr(word_pool, "WINDOW", 500)
    asked = []

    def encode(pieces):
        asked.extend(pieces)
        return np.array([b for p in pieces for b in p[::-1]], np.uint32), np.array([len(p) for p in pieces], np.int64)

    pool = word_pool.WordPool(np.uint32, encode)
    rnd = random.Random(3)
    for k in range(20):
        pieces = [b" " + rnd.choice([b"the", b"of", b"%d" % rnd.randrange(60 * (k % 3 + 1)), b"x" * rnd.randint(1, 200), "é日".encode()]) for _ in range(400)]
        raw, size = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
        ids, counts = pool.encode(raw, np.cumsum(size) - size)
        assert bytes(ids.astype(np.uint8)) == b"".join(p[::-1] for p in pieces) and counts.tolist() == size.tolist()
    assert limit == 50 or Counter(asked)[b" the"] == 1
    assert [len(x) for x in pool.encode(np.zeros(0, np.uint8), np.zeros(0, np.int64))] == [0, 0]


def test_pool_tells_pieces_of_one_number_apart():
    pool = word_pool.WordPool(np.uint32, lambda pieces: (np.array([p[0] for p in pieces], np.uint32), np.ones(len(pieces), np.int64)))
    pool.of_byte = np.ones(256, np.uint64)  # all pieces of one length have one number
    raw = np.frombuffer(b"abcabd" * 50, np.uint8)
    for step in (1, 2, 3):
        ids, _ = pool.encode(raw, np.arange(0, len(raw), step))
        assert ids.tolist() == raw[::step].tolist()


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 5, None, "", "b" * 30, "c", "é"])], names=["i", "t"])
    for most in (1, 7, 1000):
        assert [i for part in word_pool.slices(batch, 1, most) for i in part.column(0).to_pylist()] == list(range(6))
    raw, edge = word_pool.utf8(batch.column(1).slice(2))
    assert [raw[a:b].tobytes().decode() for a, b in zip(edge[:-1], edge[1:], strict=True)] == ["", "b" * 30, "c", "é"]


# --- toxicity -------------------------------------------------------------------------


def test_risk_and_gradient_equal_loops():
    rnd = random.Random(8)
    text = lambda: rnd.sample("abcdefgh", rnd.randint(0, 6))
    pos, un = [text() for _ in range(7)], [text() for _ in range(9)]
    number = {c: i + 1 for i, c in enumerate("abcdefgh")}
    wp, wu = np.array([rnd.random() for _ in pos]), np.array([rnd.random() for _ in un])
    p, u = toxicity._Rows(pos, number, wp), toxicity._Rows(un, number, wu)
    loss = lambda z: math.log(1 + math.exp(-z))
    for prior in (0.05, 0.4):
        for scale in (0.1, 3.0):
            w = np.array([rnd.gauss(0, scale) for _ in range(9)])
            z = lambda t, v: v[0] + sum(v[number[c]] for c in t)
            mean = lambda texts, weights, f: sum(a * f(t) for a, t in zip(weights / weights.sum(), texts, strict=True))
            first = lambda v: prior * mean(pos, wp, lambda t: loss(z(t, v)))
            second = lambda v: mean(un, wu, lambda t: loss(-z(t, v))) - prior * mean(pos, wp, lambda t: loss(-z(t, v)))
            assert toxicity.risk(p, u, w, prior) == pytest.approx((first(w), second(w)))
            whole = (lambda v: first(v) + second(v)) if second(w) >= 0 else (lambda v: -second(v))
            step = np.eye(9) * 1e-6
            loops = [(whole(w + e) - whole(w - e)) / 2e-6 for e in step]
            assert toxicity.gradient(p, u, w, prior) == pytest.approx(loops, abs=1e-6)


def test_prior_is_estimated_from_the_two_samples():
    rnd = np.random.default_rng(2)
    good, bad = rnd.normal(-2, 1, 20_000), rnd.normal(3, 1, 3000)
    mixed = np.concatenate([good[:9000], rnd.normal(3, 1, 1000)])
    assert toxicity.estimated_prior(bad, mixed) == pytest.approx(0.1, abs=0.02)
    assert toxicity.estimated_prior(np.zeros(0), mixed) == toxicity.FIRST_PRIOR


def test_inflected_words_share_a_feature(spark):
    rnd = random.Random(4)
    plain = [f"w{i}" for i in range(200)]
    ends = ["".join(rnd.choices(string.ascii_lowercase, k=3)) for _ in range(400)]
    bad = {i for i in range(1500) if rnd.random() < 0.15}
    texts = [" ".join(rnd.choices(plain, k=rnd.randint(5, 100)) + ["vilest" + rnd.choice(ends)] * (i in bad)) for i in range(1500)]
    labels = spark.createDataFrame([(i, 1, int(i in bad), "x") for i in range(0, 1500, 2)] + [(None, 1, 1, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    rows = toxicity.score(docs(spark, texts), labels).collect()
    assert sum(r["predicted"] != (r["doc_id"] in bad) for r in rows) <= 15


# --- language, sentence pieces, token files -------------------------------------------


def test_numbers_that_are_no_letters_have_no_language():
    m = language_id.Model.train({"a": [b"abc abc"], "b": [b"xyz xyz"]})
    names, scores = m.predict(["½ ²", "①", "123", "", None, "Ⅷ", "_", "a", "日"])
    assert names[:7] == ["und"] * 7 and scores[:7] == [0.0] * 7 and "und" not in names[7:]


def test_sample_stays_within_its_bounds(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 100)
    texts = ["x" * 400, *["yy " * 10] * 30]
    found = language_id.training_sample(docs(spark, texts, lang={0: "big"}), "doc_id", "text", "lang")
    assert sum(map(len, found["en"])) <= 100 and [len(t) for t in found.get("big", [b"x" * 400])] == [400]


@needs_vocabularies
def test_agendas_side_by_side_equal_the_one_of_a_word():
    v = sentencepiece_bpe.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rnd = random.Random(6)
    words = ["▁" + "".join(rnd.choice("abcdefghinorstéß日_.1▁") for _ in range(rnd.randint(0, 20))) for _ in range(500)]
    part = [np.array([v.symbol.get(c, -1 - ord(c)) for c in w], np.int64) for w in words]
    size = np.array([len(x) for x in part])
    left, count = v.merged_words(np.concatenate(part), np.cumsum(size) - size)
    mine = [x.tolist() for x in np.split(left, np.cumsum(count)[:-1])]
    assert mine == [[s if isinstance(s, int) else -1 - ord(s) for s in v.merged(w)] for w in words]


@needs_vocabularies
def test_a_wrong_agenda_stops_the_batch(monkeypatch):
    v = sentencepiece_bpe.MergeVocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(v, "merged_words", lambda part, start: (part, np.diff(np.append(start, len(part)))))
    with pytest.raises(RuntimeError):
        v.encode(pa.array(["hello there"]))


@needs_vocabularies
def test_very_long_and_repeated_rows(spark):
    path, byte = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
    long = "lorem ipsum, dolor\n" * 120_000 + "x" * 100_000
    x = docs(spark, [long, "a", None]).union(docs(spark, [long])).withColumn("doc_id", F.when(F.col("text") == "a", None).otherwise(F.col("doc_id")))
    a = [r for r in sentencepiece_bpe.encode_decode(x, path, outputs=False).collect() if r["doc_id"] == 0]
    assert len(a) == 2 and a[0] == a[1] and a[0]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    rows = token_files.document_digests(token_files.write_files(x, byte)).collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])] == [None, 0, 0, 2] and len({r["ids_crc32"] for r in rows if r["doc_id"] == 0}) == 1


@needs_vocabularies
def test_token_files_are_read_by_their_path_alone(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    to = f"file://{tmp_path}/tokens"
    made = token_files.document_digests(token_files.write_files(docs(spark, ODD), path, to=to)).collect()
    assert sorted(token_files.document_digests(token_files.open_files(spark, to)).collect()) == sorted(made)
    head = spark.read.parquet(to + "/code").first()
    assert (head["vocabulary"], head["end_id"]) == (50257, 2)


# --- media, pages, secrets ------------------------------------------------------------


def test_foreign_and_damaged_streams_have_no_payload(spark):
    frame = bytes.fromhex("fffb9064") + bytes(413)
    made = mpeg_audio.write_mpeg(mpeg_audio.padded(b"z" * 3000), 3000)
    hurt = bytearray(made)
    hurt[mpeg_audio.read_mpeg(made).frames[1] + 100] ^= 1
    rows = [(0, made), (1, frame * 3), (2, bytes(hurt)), (3, b""), (4, None), (None, b"no audio"), (0, made[:1500])]
    out = mpeg_audio.from_media(spark.createDataFrame([(i, None if m is None else bytearray(m)) for i, m in rows], "doc_id long, media binary")).collect()
    by = {r["doc_id"]: r for r in out if r["doc_id"] not in (0, None)}
    good = [r for r in out if r["doc_id"] == 0 and r["payload_sha256"]]
    assert len(out) == 7 and len(good) == 1 and good[0]["n_bytes"] == 3000
    assert (by[1]["payload_bytes"], by[1]["n_frames"], by[1]["samples"], by[1]["sample_rate"]) == (None, 3, 3456, 44100)
    assert by[2]["payload_sha256"] is None and by[2]["n_frames"] == len(good[0]["seek_offsets"]) and by[3]["n_frames"] == 0 and by[4]["feature"] is None


def test_gaps_tables_and_tags_of_other_writers():
    frame = bytes.fromhex("fffb9064") + bytes(413)
    info = bytearray(frame)
    info[36:52] = b"Info" + (15).to_bytes(4, "big") + (3).to_bytes(4, "big") + (4 * 417).to_bytes(4, "big")
    info[156:160], info[177:180] = b"LAME", (576 << 12 | 1000).to_bytes(3, "big")
    s = mpeg_audio.read_mpeg(bytes(info) + frame * 3)
    assert (s.delay, s.padding, s.sound, s.table_agrees) == (576, 1000, 3 * 1152 - 1576, True)
    assert mpeg_audio.read_mpeg(bytes(info) + frame * 2).table_agrees is False
    vbri = bytearray(frame)
    vbri[36:62] = b"VBRI" + bytes(6) + (1668).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"\0\2\0\1\0\2\0\2"
    vbri[62:66] = b"\1\xa1\2\x4b"
    s = mpeg_audio.read_mpeg(bytes(vbri) + frame * 3)
    assert (s.table_frames, s.table_bytes, s.seek, s.seek_frames) == (3, 1668, [417, 587], 2)
    body = b"\0" + "caf\xff\0é".encode("latin-1")
    tag = b"TIT2" + len(body).to_bytes(4, "big") + b"\0\0" + body
    ext = b"\0\0\0\6" + bytes(6)
    for flags, inner in ((0x80, tag.replace(b"\xff", b"\xff\0")), (0x40, ext + tag)):
        size = len(inner)
        found = mpeg_audio.read_mpeg(b"ID3\3\0" + bytes([flags, size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + inner + frame * 2)
        assert found.tags["TIT2"].startswith("caf") and len(found.frames) == 2


def test_broken_records_give_error_rows(spark):
    good = warc_derive.response("k", "http://a/", "<p>x</p>").to_bytes()
    rows = [(1, good), (2, b"nothing"), (3, good[:-20]), (None, good), (1, good), (5, None)]
    out = warc_derive.derivatives(spark.createDataFrame([(i, None if r is None else bytearray(r)) for i, r in rows], "page_id long, record binary").withColumn("error", F.lit(1))).collect()
    assert Counter((r["page_id"], r["record_type"]) for r in out) == {(1, "conversion"): 2, (1, "metadata"): 2, (2, "error"): 1, (3, "error"): 1, (None, "conversion"): 1, (None, "metadata"): 1}
    assert all((r["error"] is None) != (r["record_type"] == "error") for r in out)


@pytest.mark.parametrize("part", ["<script ", "<title>", "<noscript>", "<a ", "<html ", "<!-- ", "<head ", "<p "])
def test_pages_take_a_time_in_proportion(part):
    began = time.process_time()
    for page in (part * 60_000, part * 60_000 + ">"):
        warc_derive.derive(warc_derive.response("k", "u", page))
    assert time.process_time() - began < 3


def test_visible_text_equals_a_parser(spark):
    """Blocks of text as Python's own parser finds them, on the driver's pages."""
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.parts, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "head", "template", "noscript")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "head", "template", "noscript")

        def handle_data(self, data):
            if not self.hidden:
                self.parts.append(data)

    n = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        p = Text()
        p.feed(r["html"] or "")
        p.close()
        mine = "".join(warc_derive.visible_text(r["html"] or "").split())
        n += "".join("".join(p.parts).split()) == mine
    assert n >= 0.98 * spark.read.parquet(f"{SF}/pages.parquet").count()


def test_many_spans_and_own_samples(spark):
    n = 6000
    text = " ".join(["0a" * 12 + " Zq83Lm0xPw7Vb5TnRk2Jc9Hs"] * n)
    r = secret_scan.scan(docs(spark, [text])).first()
    assert r["n_hex"] == r["n_markov"] == n and r["spans"].startswith("hex:0:24,markov:25:49,hex:50:74")
    rnd = random.Random(5)
    word = lambda k: "".join(rnd.choice("bdgkmnprst") + rnd.choice("aeiou") for _ in range(k))
    samples = [("ordinary", word(8)) for _ in range(500)] + [("random", "".join(rnd.choices(string.ascii_lowercase, k=24))) for _ in range(500)] + [("random", None), ("other", "x")]
    x = docs(spark, [f"a {word(9)} z", "a " + "bdgkmnprstgbkdnpmrtsgbdk" + " z"])
    scanned = lambda own: [r["n_markov"] for r in secret_scan.scan(x, samples=own).orderBy("doc_id").collect()]
    assert scanned(spark.createDataFrame(samples, "label string, value string")) == [0, 1]


# --- pipeline -------------------------------------------------------------------------


def plain_pipeline(texts, source, known, weights):
    """The stages from the second on, by loops: doc_ids as often as the mixture takes them."""
    left = {}
    for i in sorted(known):
        left.setdefault(" ".join(texts[i].replace("\t", " ").replace("\n", " ").split(" ")), i)  # these texts have single spaces
    ids = sorted(left.values())
    ids = sorted({c for _, _, c in brute_components(ids, [texts[i] for i in ids])})
    size = {i: len(texts[i].split()) for i in ids}
    total = defaultdict(int)
    for i in ids:
        total[source[i]] += size[i]
    copies, want = Counter(), reshared(dict(total))
    key = lambda i: -math.log((int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weights.get(i, 1.0)
    for s in total:
        passes = math.floor(want[s] / total[s])
        rest = round(want[s]) - passes * total[s]
        for i in sorted((i for i in ids if source[i] == s), key=key):
            extra = min(size[i], max(0, rest))
            rest -= size[i]
            copies[i] += math.floor((passes * size[i] + extra) / size[i] + 0.5)
    return +copies


@needs_vocabularies
def test_pipeline_equals_a_plain_version(spark, tmp_path):
    import corpus_pipeline

    texts = ["12 34", *families(21, 6, 40), *common_texts(9, 60)]
    texts += texts[3:9]
    rnd = random.Random(1)
    source = {i: rnd.choice(["a", "b", "c", None]) for i in range(len(texts))}
    texts = [" ".join(t.split()) or "¶" for t in texts]
    x = docs(spark, texts, source=source, lang={i: rnd.choice(["en", "de"]) for i in range(len(texts))}).select("doc_id", "text", "lang", "source", "n_chars")
    x.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0), (5, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    known = [i for i, t in enumerate(texts) if any(c.isalpha() for c in t)]
    assert len(known) < len(texts)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in rows) == plain_pipeline(texts, source, known, {4: 2.0, 5: 0.5})
    library = sentencepiece_bpe.vocabulary(public_tokenizers.path("piece_bpe_32k.model")).library
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["source"]) == (len(ids), source[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


@needs_vocabularies
def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    one = "the cat and the dog are here to stay for a while"
    x = docs(spark, [one, one, None, "", one + " longer now", "quite other words in this text"]).withColumn("doc_id", F.when(F.col("doc_id") == 5, None).otherwise(F.col("doc_id") % 4))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, rows in (("full", x.union(x)), ("none", x.limit(0)), ("blank", x.where("text IS NULL"))):
        d = tmp_path / name
        rows.write.parquet(str(d / "documents.parquet"))
        labels.write.parquet(str(d / "labels.parquet"))
        table = spark.read.parquet(str(d / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, str(d))
            assert table.columns == x.columns
        out = corpus_pipeline.run(spark, str(d)).collect()
        assert (len(out) > 0) == (name == "full")
        assert name != "full" or {r["doc_id"] for r in out} <= {0, None}


def test_odd_tables_of_every_keeper(spark):
    """Null and repeated ids, empty tables, and rows that repeat in full."""
    x = docs(spark, ["a b c d e f", None, "", "a b c d e f"]).select("doc_id", "text", "lang", "source", "n_chars")
    x = x.union(x).union(x.withColumn("doc_id", F.lit(None).cast("long")))
    for stage, n in ((exact_dedup.drop_exact_copies, 2), (shingle_join.keep_one_of_each, None), (source_mix.repeat_by_mix, None)):
        rows = stage(x).collect()
        assert n is None or len(rows) == n
        assert {r["doc_id"] for r in rows} <= {0, 1, 2, 3, None} and stage(empty(spark)).count() == 0
    assert zlib.crc32(b"0") % 5 != 0 or language_id.identify(x).count() == 12
