"""Operators on training text: exactness against brute force, round trips, odd rows."""

import gzip
import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, exact_dedup, language_id, mpeg_audio, secret_scan, sentencepiece_bpe, shingle_join, source_mix, token_files, toxicity, warc_derive

try:
    import public_tokenizers
except ImportError:
    public_tokenizers = None
needs_vocabularies = pytest.mark.skipif(public_tokenizers is None, reason="no vocabulary files")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\t\n", "a", "  a  b ", "▁a ▁▁", "日本語 テスト 😀", "<s> </s> <0x41> <|endoftext|> x", "é" * 300, "x" * 3000, "\n\n x\t y", "don't we'll", "a\x00b", "end \n", "a.\nB c,\n d"]


def docs(spark, texts, **more):
    """Numbered rows, with a column whose name an operator might use itself."""
    rows = [(i, t, more.get("lang", {}).get(i, "en"), more.get("source", {}).get(i, "s"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit(1), "_body": F.lit("x"), "key": F.lit(2), "token": F.lit(3), "size": F.lit(4), "part": F.lit(5)})


def noise(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(" \n\ta▁bcĠé日.,1\x1c 😀the ing") for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- exact copies ---------------------------------------------------------------------


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda body: F.crc32(body) % 3])
def test_exact_dedup_with_good_and_colliding_digests(spark, digest):
    texts = ["a b", "a  b", None, "", " ", "\t", "c", "a\nb", "long " * 5000, "long  " * 5000]
    x = docs(spark, texts).union(docs(spark, ["a b"]))  # id 0 twice
    x = x.union(x.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("only null id")))
    rows = exact_dedup.exact_dedup(x, digest=digest).collect()
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in x.collect():
        groups[normal(r["text"])].append(r["doc_id"])
    assert len(rows) == x.count() and sum(r["kept"] for r in rows) == len(groups)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in rows if r["text_sha256"] == sha]
        assert sorted(map(str, (r["doc_id"] for r in mine))) == sorted(map(str, ids))
        assert {r["keep_id"] for r in mine} == {min((i for i in ids if i is not None), default=None)} and {r["group_size"] for r in mine} == {len(ids)}
    assert exact_dedup.drop_exact_copies(x).count() == len(groups)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


# --- tokens ---------------------------------------------------------------------------


@needs_vocabularies
def test_agenda_equals_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ODD + noise(400)
    library = sentencepiece_bpe.vocabulary(path).library
    for r in sentencepiece_bpe.encode_decode(docs(spark, texts), path).collect():
        want = library.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == want and r["n_tokens"] == len(want) and r["decoded"] == library.decode(want)
    assert sentencepiece_bpe.encode_decode(empty(spark), path).count() == 0


@needs_vocabularies
def test_decoding_of_ids_that_are_no_encoding():
    v = sentencepiece_bpe.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rnd = random.Random(5)
    for _ in range(300):
        ids = [rnd.randrange(32000) if rnd.random() < 0.5 else rnd.randrange(300) for _ in range(rnd.randint(0, 8))]
        assert v.decode(ids) == v.library.decode(ids), ids


@needs_vocabularies
def test_a_difference_to_the_library_stops():
    v = sentencepiece_bpe.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    with pytest.raises(RuntimeError):
        v.check_words(["▁hello"], [[1]])


@needs_vocabularies
def test_token_files_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ODD + noise(400, 2)
    library = token_files.encoder(path).library
    files = token_files.write_files(docs(spark, texts).withColumn("doc_id", 1000 - F.col("doc_id")), path)
    rows = sorted(token_files.document_digests(files).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r in rows:
        ids = [*library.encode(texts[1000 - r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.document_digests(token_files.write_files(empty(spark), path)).count() == 0


def test_blocks_of_any_size_and_damage():
    rnd = np.random.default_rng(1)
    for n, longest in ((1, 1), (2, 1), (300, 9), (5000, 14)):
        counts = rnd.zipf(1.3, n).astype(np.int64) % 10**6 + 1
        lengths = token_files.code_lengths(counts, longest)
        assert lengths.max() <= longest and (0.5 ** lengths.astype(float)).sum() <= 1
        code = token_files.Code.of(lengths)
        parts = [rnd.integers(0, n, k).astype(np.uint32) for k in (0, 1, 127, 128, 129, 1000)]
        block = token_files.write_block(code, [None, 5, 6, 7, 8, 9], parts)
        doc_ids, sizes, ids = token_files.read_block(code, block)
        assert doc_ids == [None, 5, 6, 7, 8, 9] and sizes.tolist() == [0, 1, 127, 128, 129, 1000] and (ids == np.concatenate(parts)).all()
    with pytest.raises(ValueError):
        token_files.read_block(code, block[:-1] + bytes([block[-1] ^ 1]))


def test_code_lengths_are_optimal():
    import heapq

    rnd = random.Random(2)
    for _ in range(50):
        counts = np.array([rnd.randint(1, 40) for _ in range(rnd.randint(2, 20))])
        heap, cost = counts.tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        assert (token_files.code_lengths(counts, 30).astype(int) * counts).sum() == cost


# --- media ----------------------------------------------------------------------------


def test_mpeg_round_trip(spark):
    texts = [*ODD, "TAG" * 300, "ID3" * 300, "z" * 937 * 3]
    for r in mpeg_audio.from_media(mpeg_audio.to_media(docs(spark, texts))).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        whole = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(whole[-64:]) and r["samples"] == 1152 * r["n_frames"] and "skipped=0" in r["feature"]
    assert mpeg_audio.from_media(mpeg_audio.to_media(empty(spark))).count() == 0


def test_mpeg_resynchronises_and_checks():
    media = mpeg_audio.write_mpeg(mpeg_audio.padded(b"x" * 5000), 5000)
    clean = mpeg_audio.read_mpeg(media)
    assert clean.table_frames == len(clean.frames) == 6 and clean.samples == 6 * 1152 and clean.bad_checksums == 0
    at = clean.frames[2]
    torn = mpeg_audio.read_mpeg(b"junk\xff\xfb\x00" + media[:at] + b"\xff\xff garbage" + media[at:])
    assert torn.skipped > 0 and len(torn.frames) >= 4
    spoiled = bytearray(media)
    spoiled[at + 6] ^= 1
    assert mpeg_audio.read_mpeg(bytes(spoiled)).bad_checksums == 1
    tagged = mpeg_audio.read_mpeg(media + b"TAG" + b"Song".ljust(125, b"\0"))
    assert tagged.tags["ID3v1"] == "Song" and len(tagged.frames) == 6
    assert mpeg_audio.read_mpeg(b"").frames == [] and mpeg_audio.read_mpeg(b"no audio at all").skipped == 15


@pytest.mark.parametrize("raw, version, layer, size, samples", [("fffb9064", 3, 3, 417, 1152), ("fff38064", 2, 3, 208, 576), ("fffd9004", 3, 2, 522, 1152), ("ffff9004", 3, 1, 312, 384)])
def test_mpeg_headers(raw, version, layer, size, samples):
    h = mpeg_audio.parse_header(bytes.fromhex(raw))
    assert (h.version, h.layer, h.size, h.samples) == (version, layer, size, samples)


# --- language -------------------------------------------------------------------------


def brute_bits(trees, language, text):
    raw, bits = b"\n" * 4 + text, 0.0
    for i in range(4, len(raw)):
        for d in range(4, -2, -1):
            if d < 0:
                bits += 8
                break
            seen = trees[language].get(raw[i - d : i])
            if not seen:
                continue
            n, k = sum(seen.values()), len(seen)
            if raw[i] in seen:
                bits -= math.log2(seen[raw[i]] / (n + k))
                break
            bits -= math.log2(k / (n + k))
    return bits


def test_code_lengths_equal_tree_walks():
    samples = {"en": [b"the cat sat on the mat", b"then there"], "de": ["der Hund läuft über".encode()], "xx": []}
    trees = {k: defaultdict(Counter) for k in samples}
    for k, texts in samples.items():
        for t in texts:
            raw = b"\n" * 4 + t
            for i in range(4, len(raw)):
                for d in range(5):
                    trees[k][raw[i - d : i]][raw[i]] += 1
    m = language_id.Model.train(samples)
    texts = [b"the hat", b"", b"\xff\x00zz", "über den Hund".encode() * 50, b"q"]
    bits = m.code_lengths(texts)
    for i, language in enumerate(m.languages):
        for j, t in enumerate(texts):
            assert bits[i, j] == pytest.approx(brute_bits(trees, language, t), abs=1e-6)


def test_language_windows_do_not_matter(monkeypatch):
    m = language_id.Model.train({"a": [b"abcabcab" * 20], "b": [b"xyzzyx" * 20]})
    texts = [b"abcxyz" * 40, b"zy", b"ab" * 100]
    whole = m.code_lengths(texts)
    monkeypatch.setattr(language_id, "WINDOW", 7)
    assert np.allclose(whole, m.code_lengths(texts))


def test_identify_odd_rows(spark):
    texts = [*ODD, "123 456", *["the cat and the dog"] * 20, *["der Hund und die Katze"] * 20]
    lang = {i: "de" for i in range(len(ODD) + 21, len(texts))} | {3: None}
    x = docs(spark, texts, lang=lang)
    rows = {r["doc_id"]: r for r in language_id.identify(x).collect()}
    assert len(rows) == len(texts) and all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in rows)
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (0, 1, 2, 3, len(ODD)))
    assert rows[len(ODD) + 5]["lang_pred"] == "en" and rows[len(texts) - 1]["lang_pred"] == "de"
    kept = {r["doc_id"] for r in language_id.with_language(x).collect()}
    assert kept == {i for i, r in rows.items() if r["lang_pred"] != "und"}
    assert language_id.identify(empty(spark)).count() == 0
    assert language_id.identify(docs(spark, ["a"], lang={0: None})).first()["lang_pred"] == "und"


# --- toxicity -------------------------------------------------------------------------


def test_toxicity_learns_words_from_positives_and_unlabelled(spark):
    rnd = random.Random(4)
    plain = [f"w{i}" for i in range(200)]
    text = lambda bad: " ".join(rnd.choices(plain, k=rnd.randint(5, 200)) + (["vile"] if bad else []))
    bad = {i for i in range(1500) if rnd.random() < 0.15}
    x = docs(spark, [text(i in bad) for i in range(1500)])
    labels = spark.createDataFrame([(i, 1, int(i in bad)) for i in range(0, 1500, 2)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(x, labels).collect()
    wrong = [r for r in rows if r["predicted"] != (r["doc_id"] in bad)]
    assert len(wrong) <= 15 and all(0 <= r["score"] <= 1 for r in rows)
    again = {r["doc_id"]: r["score"] for r in toxicity.score(x, labels).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in rows)


def test_toxicity_without_labels_or_words(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs(spark, ODD), none).collect()
    assert len(rows) == len(ODD) and len({r["score"] for r in rows}) == 1 and all(r["predicted"] == 0 for r in rows)
    assert toxicity.score(empty(spark), none).count() == 0


# --- mixture --------------------------------------------------------------------------


def reshared(sizes):
    """Targets by repeated resharing, as the rule is worded."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixture_against_sorting(spark):
    rnd = random.Random(7)
    source = {i: rnd.choice(["b", "b", "b", "b", "a", "c", "Z", "é", None]) for i in range(600)}
    texts = [rnd.choice([None, "", " "]) if rnd.random() < 0.05 else "w " * rnd.randint(1, 40) for _ in range(600)]
    x = docs(spark, texts, source=source)
    rows = source_mix.mix(x).collect()
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    want, taken = reshared(total), Counter()
    for r in rows:
        s = r["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in total)
    key = lambda i: -math.log((int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
    for s in total:
        passes, rest = divmod(round(want[s]), total[s])
        for i in sorted((i for i in size if source[i] == s), key=key):
            extra = min(size[i], max(0, rest)) if passes < 2 else 0
            rest -= size[i]
            assert next(r for r in rows if r["doc_id"] == i)["taken"] == passes * size[i] + extra
    assert sorted(rows) == sorted(source_mix.mix(x.repartition(7)).collect())
    copies = Counter(r["doc_id"] for r in source_mix.repeat_by_mix(x).collect())
    assert copies == {r["doc_id"]: n for r in rows if r["size"] and (n := math.floor(r["taken"] / r["size"] + 0.5))}
    assert source_mix.mix(empty(spark)).count() == 0


def test_mixture_of_empty_texts(spark):
    assert [r["taken"] for r in source_mix.mix(docs(spark, [None, ""])).collect()] == [0, 0]


# --- secrets --------------------------------------------------------------------------

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_spans(t):
    out = [(m.start(), 1, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 2, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 3, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def test_secret_spans(spark):
    rnd = random.Random(9)
    pieces = ["password", "PassWd", "api_key", "apikey", "secret", "token", "=", ":", " ", '"', "'", "abc", "abcdef", "AKIA", "AKIA" + "Z9" * 10, "0af" * 9, "é", "😀", "\n", ".", "ſecret", "toKen", "xxxxxx"]
    texts = [*ODD, "secret: token: abcdefgh", "token=token=abcdefgh", 'token = "' + "0a" * 20 + '"', "k = Zq83Lm0xPw7Vb5TnRk2Jc9Hs end", "some_ordinary_identifier_2024 and max_value_index_1"]
    texts += ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 25))) for _ in range(400)]
    for r in secret_scan.scan(docs(spark, texts)).collect():
        want = base_spans(texts[r["doc_id"]] or "")
        got = [s for s in r["spans"].split(",") if s and not s.startswith("markov")]
        assert got == want, texts[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))
    rows = {r["doc_id"]: r for r in secret_scan.scan(docs(spark, texts)).collect()}
    assert rows[len(ODD) + 3]["spans"] == "markov:4:28" and rows[len(ODD) + 4]["spans"] == ""
    assert secret_scan.scan(empty(spark)).count() == 0


def test_markov_models_tell_samples_apart(spark):
    samples = secret_scan.labelled_samples(spark)
    ratios = secret_scan.train(samples)
    x = samples.select("label", (secret_scan.log_ratio(F.col("value"), ratios) >= secret_scan.LEAST_RATIO * F.length("value")).alias("hit"))
    share = {r["label"]: r["s"] for r in x.groupBy("label").agg(F.avg(F.col("hit").cast("double")).alias("s")).collect()}
    assert share["random"] > 0.95 and share["ordinary"] < 0.01


def test_random_strings_need_no_digit(spark):
    rnd = random.Random(3)
    letters = string.ascii_letters
    keys = ["".join(rnd.choice(al) for _ in range(n)) for al, n in ((letters, 40), (letters, 24), (letters + string.digits, 12)) for _ in range(200)]
    words = ["Donaudampfschifffahrtsgesellschaft", "misunderstandings", "HttpServletRequestFactory", "internationalement", "user_profile_settings"]
    rows = {r["doc_id"]: r for r in secret_scan.scan(docs(spark, [f"a {x} z" for x in keys + words])).collect()}
    for at, least in ((0, 195), (200, 190), (400, 185)):
        assert sum(rows[i]["n_markov"] for i in range(at, at + 200)) >= least
    assert [rows[i]["spans"] for i in range(600, 600 + len(words))] == [""] * len(words)


def test_random_strings_inside_ordinary_runs(spark):
    rnd = random.Random(4)
    key = lambda n: "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(n))
    heads = ["sk_live_", "com/account/settings/", "/api/v1/users/profile/session/", "download/files/archive/release/", ""]
    made = [(h, key(32), tail) for h in heads for tail in ("", "/download/files/archive") for _ in range(40)]
    texts = [f"a {h}{k}{t} z" for h, k, t in made] + [f"{key(32)}/user/profile/settings/download/files/archive/release/{key(32)}"]
    texts += ["/api/v1/users/profile/session/", "x86_64-linux-gnu", "sha256_digest_value"]
    rows = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs(spark, texts)).collect()}
    good = [rows[i] == f"markov:{2 + len(h)}:{2 + len(h) + 32}" for i, (h, _, _) in enumerate(made)]
    assert sum(good) >= 0.9 * len(good)
    covered = [any(int(s.split(":")[1]) <= 2 + len(h) and 34 + len(h) <= int(s.split(":")[2]) for s in rows[i].split(",") if s) for i, (h, _, _) in enumerate(made)]
    assert sum(covered) >= 0.97 * len(covered)
    both = len(texts[len(made)])
    assert rows[len(made)] == f"markov:0:32,markov:{both - 32}:{both}" and {rows[i] for i in range(len(made) + 1, len(texts))} == {""}


def test_all_frames_have_offsets_in_a_written_column(spark, tmp_path):
    text = "abc déf " * 12_000
    docs(spark, [text, None]).write.parquet(str(tmp_path / "documents.parquet"))
    from tidemark.llm import queries, shared

    before = set(Path(shared.shared_dir(spark).removeprefix("file://")).glob("tidemark/media-*"))
    out = queries.op5_mpeg_audio(spark, str(tmp_path))
    rows = {r["doc_id"]: r for r in out.collect()}
    raw = mpeg_audio.write_mpeg(mpeg_audio.padded(text.encode()), len(text.encode()))
    assert rows[0]["seek_offsets"] == mpeg_audio.read_mpeg(raw).frames and len(rows[0]["seek_offsets"]) == rows[0]["n_frames"] > 64
    assert len(rows[1]["seek_offsets"]) == rows[1]["n_frames"] and ";unchecked=0;" in rows[0]["feature"]
    new = set(Path(shared.shared_dir(spark).removeprefix("file://")).glob("tidemark/media-*")) - before
    assert len(new) == 1 and {bytes(r["media"]) for r in spark.read.parquet(str(new.pop())).where("doc_id = 0").collect()} == {raw}


@pytest.mark.parametrize("mode, allocated", [(0xC0, 16), (0x00, 32), (0x50, 20)])
def test_protected_frames_of_layer_one_and_two(mode, allocated):
    def frame(second, rate, good=True):
        head = bytes([0xFF, second, rate << 4, mode])
        body = bytearray(mpeg_audio.parse_header(head).size - 6)
        crc = mpeg_audio.frame_checksum(head[2:] + bytes(body[:allocated]))
        body[0] = 0 if good else 0x10
        return head + crc.to_bytes(2, "big") + bytes(body)

    one = mpeg_audio.read_mpeg(frame(0xFE, 8) + frame(0xFE, 8, False))
    assert (len(one.frames), one.checked, one.bad_checksums, one.unchecked) == (2, 2, 1, 0)
    two = mpeg_audio.read_mpeg(frame(0xFC, 8) * 2)
    assert (len(two.frames), two.checked, two.bad_checksums, two.unchecked) == (2, 0, 0, 2)


# --- web records ----------------------------------------------------------------------

PAGE = '<html lang="fr"><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x --><script>var t="</p>";</script><p>One<br>two &eacute;</p><a href="/x?a=1&amp;b=2">go</a></body></html>'


def test_derivatives_refer_to_their_response(spark):
    pages = spark.createDataFrame([(1, "http://a/", PAGE), (2, None, None), (3, "http://b/\r\nX: y", "")], "page_id long, url string, html string")
    records = warc_derive.responses(pages)
    out = {(r["page_id"], r["record_type"]): r for r in warc_derive.derivatives(records).collect()}
    assert len(out) == 6
    source = {r["page_id"]: warc_derive.parse_record(bytes(r["record"])) for r in records.collect()}
    for (page, kind), r in out.items():
        back = warc_derive.parse_record(bytes(r["record"]))
        assert back.get("WARC-Type") == kind and back.get("WARC-Refers-To") == source[page].get("WARC-Record-ID") == r["refers_to"]
        assert back.get("WARC-Block-Digest") == warc_derive.digest(back.block) and r["source_payload_digest"] == source[page].get("WARC-Payload-Digest")
    text = warc_derive.parse_record(bytes(out[1, "conversion"]["record"])).block.decode()
    assert text == "One\ntwo é\ngo"
    notes = warc_derive.parse_record(bytes(out[1, "metadata"]["record"])).block.decode()
    assert "title: A & B\r\n" in notes and "language: fr\r\n" in notes and "outlink: /x?a=1&b=2\r\n" in notes and "digest-verified: yes" in notes
    assert warc_derive.derivatives(warc_derive.responses(pages.limit(0))).count() == 0


def test_records_keep_sources_and_reject_damage():
    r = warc_derive.response("k", "http://a/", PAGE)
    r.fields.append(("WARC-Refers-To", "<urn:uuid:older>"))
    spoiled = warc_derive.Record(r.fields, r.block + b"!")
    notes = [warc_derive.derive(x)[1].block.decode() for x in (r, spoiled)]
    assert "source-refers-to: <urn:uuid:older>" in notes[0] and "digest-verified: no" in notes[1]
    assert warc_derive.derive(warc_derive.Record([("WARC-Type", "request")], b"")) == []
    folded = r.to_bytes().replace(b"WARC-Target-URI: http://a/", b"WARC-Target-URI:\r\n http://a/")
    assert warc_derive.parse_record(folded).get("warc-target-uri") == "http://a/"
    for raw in (b"", b"HTTP/1.1 200\r\n\r\n", r.to_bytes()[:-20]):
        with pytest.raises(ValueError):
            warc_derive.parse_record(raw)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>T <b></title><meta x=1><body><p>One</p><a href=/y>two</a>", "One\ntwo"),
        ("<head><title>T</title><p>One</p>", "One"),
        ("<head><title>T</title>\n One <a href=/y>two</a>", "One two"),
        ("<head><script>'<p>'</script><title>T</title></head>One", "One"),
        ("<head><title>T</title></head><noscript>n</noscript>One <noscript>two <template>three", "One two three"),
        ("<head><title>T</title>", ""),
        ("<p>One</p><script>x</script> two", "One\ntwo"),
        ("<p>One</p><script>x two", "One"),
        ("One <!-- two", "One"),
        ("One <b", "One <b"),
    ],
)
def test_open_heads_hide_no_text(page, text):
    assert " ".join(warc_derive.visible_text(page).split()) == " ".join(text.split())


@pytest.mark.parametrize("cut", [0, 30])
@pytest.mark.parametrize("coding", ["", "gzip", "deflate", "raw"])
@pytest.mark.parametrize("chunked", [False, True])
def test_coded_payloads_are_decoded(coding, chunked, cut):
    body = ("<p>One two</p>" + "".join(f"<p>{i * 7919}</p>" for i in range(300)) + "<a href=/z>z</a>").encode()
    raw = zlib.compressobj(wbits=-15)
    packed = {"": body, "gzip": gzip.compress(body[:99]) + gzip.compress(body[99:]), "deflate": zlib.compress(body), "raw": raw.compress(body) + raw.flush()}[coding]
    sent = b"".join(b"%x;e=1\r\n%s\r\n" % (len(packed[i : i + 50]), packed[i : i + 50]) for i in range(0, len(packed), 50)) + b"0\r\n\r\n" if chunked else packed
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + "Transfer-Encoding: chunked\r\n" * chunked + f"Content-Encoding: {coding.replace('raw', 'deflate')}\r\n" * bool(coding) + "\r\n"
    for state in (sent[: len(sent) - cut], body):  # cut off, or decoded by the collector and still declared
        made = warc_derive.derive(warc_derive.Record([("WARC-Type", "response"), ("WARC-Payload-Digest", warc_derive.digest(packed))], head.encode() + state))
        assert made[0].block.decode().startswith("One two\n0\n7919\n")
        if not cut or state is body:
            assert made[0].block.decode().endswith("z") and "outlink: /z" in made[1].block.decode()
        if state is sent and not cut:
            assert "digest-verified: yes" in made[1].block.decode()


# --- near copies ----------------------------------------------------------------------


def brute_components(ids, texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i in range(len(ids)):
        least[root(i)].append(ids[i])
    return [(ids[i], len(sets[i]), min(least[root(i)])) for i in range(len(ids))]


def families(seed, n, words=90):
    """Chains of near copies, texts around a common passage, and texts of their own."""
    rnd = random.Random(seed)
    own = lambda k: [f"{rnd.randrange(10**6)}" for _ in range(k)]
    passage, texts = own(60), []
    for _ in range(n):
        base = own(rnd.randint(3, words))
        for _ in range(rnd.randint(1, 6)):
            texts.append(" ".join(base))
            base = base[:]
            for _ in range(rnd.randint(0, 4)):
                base[rnd.randrange(len(base))] = own(1)[0]
        texts.append(" ".join(own(rnd.randint(0, 12)) + passage + own(rnd.randint(0, 12))))
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("block, salt_rows, least", [(4096, 4096, 16), (3, 3, 2), (4096, 2, 3)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, block, salt_rows, least):
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    monkeypatch.setattr(shingle_join, "SALT_ROWS", salt_rows)
    monkeypatch.setattr(shingle_join, "LEAST_FREQUENT", least)
    texts = [*families(11, 25), None, "", " \t", "a b", "A  B", "a b c d e", "one two three four"]
    rows = shingle_join.jaccard_components(docs(spark, texts).repartition(3)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == sorted(brute_components(list(range(len(texts))), texts))
    kept = sorted(r["doc_id"] for r in shingle_join.keep_one_of_each(docs(spark, texts)).collect())
    assert kept == sorted({c for _, _, c in brute_components(list(range(len(texts))), texts)})


def common_texts(seed, n):
    """Texts that are cut from few long ones, with changes, so that most of their shingles are frequent."""
    rnd = random.Random(seed)
    bases = [[f"b{k}w{i}" for i in range(160)] for k in range(3)]
    texts = []
    for _ in range(n):
        base = rnd.choice(bases)
        at = rnd.randrange(0, 60)
        words = base[at : at + rnd.randint(20, 100)]
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            words[rnd.randrange(len(words))] = rnd.choice(["x", "y", f"{rnd.random()}"])
        texts.append(" ".join(words))
    return texts


def test_combinations_of_frequent_shingles_at_default_settings(spark):
    """Nearly all links of these texts are found by combinations alone, as their shingles occur far more than 16 times."""
    texts = common_texts(5, 500)
    frequent = Counter(s for t in texts for s in shingle_join.words_of(t))
    wholly = [t for t in texts if all(frequent[s] >= shingle_join.LEAST_FREQUENT for s in shingle_join.words_of(t))]
    assert len(wholly) > 150
    rows = shingle_join.jaccard_components(docs(spark, texts).coalesce(1)).collect()
    want = brute_components(list(range(len(texts))), texts)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == want
    assert 3 < len({c for _, _, c in want}) < 400


def test_lists_have_every_link_without_components():
    """Every pair of linked sets shares a list whose bound lets it through, whatever the threshold of frequency."""
    texts = common_texts(6, 150) + families(3, 8)
    sets = [np.unique(np.array([zlib.crc32(repr(s).encode()) for s in shingle_join.words_of(t)], np.uint64)) for t in texts]
    counts = Counter(x for t in sets for x in t.tolist())
    for least in (2, 8, 40, 10**9):
        known = np.array(sorted(x for x, n in counts.items() if n >= least) or [0], np.uint64)
        count = np.array([counts[x] for x in known.tolist()], np.int64)
        lists = [{int(k): (int(p), int(o)) for k, _, p, o in zip(*shingle_join._indexed(t, known, count, np.flatnonzero(np.isin(t, known))), strict=True)} for t in sets]
        assert all(len(x) <= 0.75 * len(t) + 3 for x, t in zip(lists, sets, strict=True))
        for i in range(len(sets)):
            for j in range(i):
                both, n, m = len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])
                if both * 100 >= 75 * (n + m - both) and both < max(n, m):
                    places = [(lists[i][k], lists[j][k]) for k in lists[i].keys() & lists[j].keys()]
                    assert any(175 * (min((o + u + 2) // 3, o, u) + min(n - p, m - q)) >= 75 * (n + m) for (p, o), (q, u) in places)


def test_columns_may_have_any_names(spark):
    """Each stage that keeps whole rows keeps them unchanged, whatever its own columns are called."""
    names = ["node", "mark", "_mark", "_kept", "which", "row", "rank", "stays", "_row", "_hit", "_bucket", "_sha", "_rank", "_kid", "_ksha", "_copies", "_copy", "_id", "_did", "_dsize", "_source", "_order", "_body", "_digest", "_salt", "hit", "key", "size", "n"]
    texts = ["one two three four five six seven"] * 3 + ["one  two three four five six seven", "quite other words are in this text", None, ""]
    x = docs(spark, texts, source={1: "t", 4: None}).select("doc_id", "text", "lang", "source", "n_chars")
    x = x.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    x = x.union(x.limit(1)).union(x.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    rows = [tuple(r) for r in x.collect()]
    for stage in (exact_dedup.drop_exact_copies, shingle_join.keep_one_of_each, source_mix.repeat_by_mix):
        out = stage(x)
        assert out.columns == x.columns
        assert out.count() and {tuple(r) for r in out.collect()} <= set(rows), stage


def test_stars_alone_do_not_decide(spark):
    """Two sets that are far from the smallest one of their lists but near each other are still linked."""
    w = [str(i) for i in range(100)]
    a, b, c = w[:], w[:60] + ["x"] * 40, w[:60] + ["x"] * 38 + ["y", "z"]
    texts = [" ".join(x) for x in (a, b, c)]
    got = sorted((r["doc_id"], r["component_id"]) for r in shingle_join.jaccard_components(docs(spark, texts)).collect())
    assert got == [(i, c) for i, _, c in brute_components([0, 1, 2], texts)]


def test_jaccard_odd_ids(spark):
    rows = [(None, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "quite another text of more than five words"), (None, "alone by itself"), (2, None)]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str((r["doc_id"], r["component_id"])) for r in shingle_join.jaccard_components(x).collect())
    assert got == sorted(map(str, [(None, 5), (5, 5), (5, 5), (None, None), (2, 2)]))
    assert shingle_join.jaccard_components(empty(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- pipeline -------------------------------------------------------------------------


@needs_vocabularies
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts = ["1234", None, *[f"the cat {i} and the dog {i} are here to stay for {i} days" for i in range(30)], "the  cat 3 and the dog 3 are here to stay for 3 days"]
    docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    x = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        x = stage(spark, x, str(tmp_path))
        assert x.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append(sorted(r["doc_id"] for r in x.select("doc_id").collect()))
    assert left[0] == list(range(2, 33)) and left[1] == list(range(2, 32)) and set(left[2]) <= set(left[1])
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(r["doc_id"] for r in rows)
    assert set(copies) <= set(left[2]) and max(copies.values()) <= 2
    library = sentencepiece_bpe.vocabulary(public_tokenizers.path("piece_bpe_32k.model")).library
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
