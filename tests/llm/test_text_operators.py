"""Language ID, toxicity, language model, media, WARC, chat and piece codec: edge cases and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkledger.llm import chat, language_id, maxent_lm, media, piece_codec, toxicity, warc

LONG = "lorem ipsum dolor " * 20000
ODD = [(1, "The cat sat. THE end"), (2, None), (3, ""), (4, " \n\t"), (5, "über straße 日本語 😀"), (5, "über straße 日本語 😀"), (None, "no id"), (7, LONG), (8, "12 + 34 = ²½"), (9, "x")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_pieces_equal_the_library(model_path):
    c = piece_codec.PieceCodec(model_path)
    rng = random.Random(3)
    texts = ["", " ", "  a  b ", "▁x ▁", "<s>hi</s> [INST]", "\n\n x\t\r\n", "a" * 300, "\x00a", "日本語 テスト 😀"] + ["".join(rng.choice("ab \n\té日😀.,<>▁the") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    for t in texts:
        ids = c.library.encode(t, add_eos=True)
        assert c.encode(t) == ids and c.decode(ids) == c.library.decode(ids)


def test_short_and_long_agenda_agree(model_path):
    c = piece_codec.PieceCodec(model_path)
    for w in ("▁internationalization", "▁▁▁x", "aaaaaaaaaaaaaaaa", "日本語"):
        assert c.merge(w) == c._merge_long(w)


def test_piece_digests(spark, odd, empty, model_path):
    rows = piece_codec.piece_digests(odd.withColumn("n_tokens", F.lit(1)), model_path).collect()
    c = piece_codec.PieceCodec(model_path)
    assert len(rows) == len(ODD) and all(r.library_match for r in rows)
    expected = sorted((str(i), hashlib.sha256(" ".join(map(str, c.library.encode(t or "", add_eos=True))).encode()).hexdigest()) for i, t in ODD)
    assert sorted((str(r.doc_id), r.ids_sha256) for r in rows) == expected
    assert piece_codec.piece_digests(empty, model_path).count() == 0


SMALL = maxent_lm.ModelSize(head=8, head_classes=2, tail_classes=2, near=8, far=4, pair_rows=64, word_slots=128, lookup=10, updates=3, train_tasks=2)


def words_of(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if w] + [None]


@pytest.mark.parametrize("size", [SMALL, maxent_lm.ModelSize()])
def test_base_score_is_exact(odd, size):
    train = Counter(w for i, t in ODD if zlib.crc32(str(i).encode()) % 5 != 1 or i is None for w in words_of(t))
    n, v = sum(train.values()), len(train)
    held = maxent_lm.fold("doc_id", 5) == 1
    rows = maxent_lm.score_texts(odd, odd.where(~held), extra={"held_out": held}, size=size).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: r for r in rows}
    for i, t in ODD:
        r, ws = by_id[i], words_of(t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_model_is_a_distribution():
    """Over all classes, and over all head words of a class."""
    import numpy as np

    m = maxent_lm.Model(SMALL, np.array([0, 0, 1, 1]))
    m.w = {k: np.random.default_rng(1).normal(size=x.shape) for k, x in m.w.items()}
    assert np.allclose(np.exp(m.class_log(3)).sum(1), 1)
    assert np.allclose(np.bincount(m.classes, np.exp(m.word_log(3))), 1)


def test_words_outside_the_head_are_a_distribution_that_fits():
    """Over the words of a class and what is kept for unseen ones; updates raise the likelihood of the counts."""
    import numpy as np

    z = maxent_lm.ModelSize(tail_classes=2, groups=3, word_updates=3)
    rng = np.random.default_rng(3)
    counts, tail = rng.poisson(rng.gamma(0.7, 4, (60, 3))), rng.integers(0, 2, 60)
    m = maxent_lm.WordModel(z, np.stack([counts[tail == k].sum(0) for k in range(2)]))
    likelihood = []
    for _ in range(z.word_updates + 1):
        w = np.exp(m.weights(counts, tail))
        m.sums = [*m.sums, np.stack([w[tail == k].sum(0) for k in range(2)]) + 0.5]
        p = w / m.sums[-1][tail]
        assert np.allclose(np.stack([p[tail == k].sum(0) for k in range(2)]) + 0.5 / m.sums[-1], 1)
        likelihood.append((counts * np.log(p)).sum())
    assert likelihood == sorted(likelihood) and likelihood[-1] > likelihood[0] + 5


def test_joined_words_score_as_sent_ones(spark, odd):
    """The same scores whether counts and weights come with the lookup or by the join."""
    got = []
    for lookup in (0, 3, 1000):
        size = maxent_lm.ModelSize(head=2, head_classes=2, tail_classes=2, near=8, far=4, pair_rows=64, word_slots=128, lookup=max(lookup, 2), updates=3, train_tasks=2, longest=64 if lookup else 3)
        got.append(sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in maxent_lm.score_texts(odd, odd, size=size).collect()))
    assert got[0] == got[1] == got[2]
    size = maxent_lm.ModelSize(head=2, head_classes=2, tail_classes=2, near=8, far=4, pair_rows=64, word_slots=128, lookup=2, updates=3, train_tasks=2)
    more = maxent_lm.ModelSize(**{**size.__dict__, "lookup": 1000})
    a, b = (sorted((str(r.doc_id), round(r.score, 5)) for r in maxent_lm.score_texts(odd, odd, size=x).collect()) for x in (size, more))
    assert a == b


def test_model_without_training_rows(odd, empty):
    rows = maxent_lm.score_texts(odd, empty, size=SMALL).collect()
    assert len(rows) == len(ODD) and all(abs(r.base_score) < 1e-9 and r.n_known == 0 and math.isfinite(r.score) for r in rows)
    assert maxent_lm.score_texts(empty, empty, size=SMALL).count() == 0


def test_model_learns(spark):
    docs = spark.createDataFrame([(i, "a b c d " * 20) for i in range(40)], SCHEMA)
    rows = maxent_lm.held_out_scores(docs).where("held_out").collect()
    assert rows and all(r.score > 0.5 * r.base_score for r in rows)


def test_language_edges(spark, odd, empty):
    docs = spark.createDataFrame([(i, "the and of that is with for", "en") for i in range(30)] + [(100 + i, "der die das und nicht für ein", "de") for i in range(30)] + [(200 + i, "и не что он на это как", "ru") for i in range(30)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.identify(odd.withColumn("score", F.lit("old")), model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 8)) and got[1].lang_pred == "en"
    mixed = spark.createDataFrame([(1, "the and of that und nicht für ein die das это как что")], SCHEMA)
    (r,) = language_id.identify(mixed, model, spans=True).collect()
    assert [s.lang for s in r.spans] == ["en", "de", "ru"] and r.n_spans == 3
    assert language_id.fit(empty.withColumn("lang", F.lit("en"))) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    z = language_id.Settings(switch=1.5)
    m = language_id.LanguageModel(["a", "b"], np.ones((2, z.slots)), np.ones((2, 17)), z)
    m.rows = np.random.default_rng(0).normal(size=(6, 2)).astype(np.float32) * 2
    (path,) = m.viterbi([np.arange(6)])
    value = lambda p: sum(m.rows[i, k] for i, k in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))
    assert math.isclose(value(path), max(map(value, itertools.product(range(2), repeat=6))), rel_tol=1e-5)


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language_id.held_out_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_toxicity_edges(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    constant = toxicity.fit(odd, labels)
    assert {r.score for r in constant.score(odd).collect()} == {0.0}
    docs = spark.createDataFrame([(i, ("you idiot scum loser " if i % 2 else "a kind word to all ") * 3 + f"w{i % 7}") for i in range(240)], SCHEMA)
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")))
    scores = {r.doc_id: r.score for r in model.score(odd.withColumn("label", F.lit(1))).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and len(scores) == len({i for i, _ in ODD})
    (bad, good) = (r.score for r in model.score(spark.createDataFrame([(1, "you idiot scum loser"), (2, "a kind word to all")], SCHEMA)).orderBy("doc_id").collect())
    assert bad > 0.8 and good < 0.2
    assert model.score(empty).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.held_out_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.85 * sum(r.toxic for r in rows) and hit >= 0.95 * sum(r.predicted for r in rows)


def test_media_round_trip(odd, empty):
    rows = media.text_media(odd).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: r for r in rows}
    for i, t in ODD:
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        r = by_id[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes == len(payload) + 44 and r.detected_type == "audio/wav" and r.corrected
    assert media.text_media(empty).count() == 0


def test_sniffing(spark):
    import gzip
    import struct

    png = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"\0\0")), (b"IEND", b"")))
    gif = b"GIF89a\x01\0\x01\0\x80\0\0" + b"\0" * 6 + b",\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    assert media.media_in(png) == [(0, len(png), "image/png")] and media.media_in(gif) == [(0, len(gif), "image/gif")]
    packed = gzip.compress(b"x" * 5000)
    box = media.wav(b"ab" + png + gif + packed)
    assert media.media_in(b"BM RIFF GIF89a \xff\xd8\xff PK\x03\x04 %PDF- .snd OggS") == []
    assert media.media_in(png[:-5]) == []
    rows = spark.createDataFrame([(1, bytearray(png), "image/jpeg"), (2, bytearray(b"zz" + png + b"--" + packed), "text/plain"), (3, None, "a/b"), (4, bytearray(box), "audio/wav"), (5, bytearray(b""), None)], "id int, v binary, declared string")
    got = {r.id: r for r in media.sniff(rows, "v", "declared").collect()}
    assert got[1].detected_type == "image/png" and got[1].corrected
    assert got[2].detected_type == "text/plain" and [(e.offset, e.type) for e in got[2].embedded] == [(2, "image/png"), (4 + len(png), "application/gzip")]
    assert got[3].detected_type is None and got[3].corrected is False and got[3].embedded == []
    assert got[4].detected_type == "audio/wav" and not got[4].corrected and got[5].embedded == []


def test_sniffing_is_linear_on_false_starts():
    import time
    import zipfile
    from io import BytesIO

    began = time.time()
    for magic in (b"%PDF-", b"PK\x03\x04", b"\x1f\x8b\x08\x08", b"RIFF", b"OggS"):
        assert media.media_in(magic * 100_000) == []
    assert time.time() - began < 10
    box = BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a", "b" * 100)
    pdf = b"%PDF-1.4 x startxref 9 %%EOF"
    assert [(a, n) for a, n, _ in media.media_in(b"ab" + box.getvalue() + pdf + pdf)] == [(2, len(box.getvalue())), (2 + len(box.getvalue()), len(pdf)), (2 + len(box.getvalue()) + len(pdf), len(pdf))]


def test_cut_streams_are_walked_once():
    import time

    page = b"OggS\0\0" + bytes(8) + b"abcd" + bytes(8) + b"\1\5" + b"12345"
    last = b"OggS\0\4" + page[6:]
    cut = page * (2_000_000 // len(page))
    began = time.time()
    assert media.media_in(cut) == [] and media.media_in(b"OggS\0\0" + cut) == []
    assert media.media_in((b"OggS\0" + bytes(22)) * 74_000) == []
    assert time.time() - began < 3
    assert media.media_in(b"xy" + page * 3 + last + page) == [(2, 4 * len(page), "audio/ogg")]
    assert media.media_in(page + last[:-1]) == [] and media.media_in(page.replace(b"abcd", b"efgh") + page + last) == [(len(page), 2 * len(page), "audio/ogg")]


def test_media_feature_against_plain_sums(spark):
    texts = ["", "abc", "Zürich " * 90, "x" * 192]
    got = {r.doc_id: r.feature for r in media.text_media(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    for i, t in enumerate(texts):
        x = list(media.payload_of(t)[1])
        mean = sum(x) / len(x)
        dev = math.sqrt(max(0.0, sum(v * v for v in x) / len(x) - mean * mean))
        cross = sum((a > mean) != (b > mean) for a, b in zip(x, x[1:]))
        assert got[i] == f"audio/wav;inside=0;mean={mean:.4f};dev={dev:.4f};cross={cross};peak={max(x)}"


@pytest.mark.parametrize("page,want", [
    ("<p>a</p><script>var x=1; leaked", "a"), ("a<!-- b", "a"), ("a<!-- b --><style>c</style>d", "a d"), ("<script >x</script ><b>y</b>", "y"), ("<SCRIPT>x</sCript>y<template>z", "y"),
    ("<scripts>y</scripts>", "y"), ("a < b <", "a < b <"), ("<a title='x<y'>l</a>", "l"), ("<noscript>a</script>b</noscript>c", "c"), ("", ""),
])
def test_malformed_pages(page, want):
    assert warc.plain_text(page) == want


def test_long_pages_are_read_once():
    import time

    began = time.time()
    for x in ("<script>", "<!--", "<a ", "<title>", "<", "<p ", "<style>x</style>"):
        for end in ("", ">"):
            page = x * (2_000_000 // len(x)) + end
            warc.plain_text(page), warc.title_of(page), warc.outlinks(page), warc.language_of(page)
    assert time.time() - began < 14


def test_end_tags_without_end_are_looked_up_once():
    import time

    for kind in ("script", "style", "template", "noscript"):
        began = time.time()
        page = f"a<{kind}>" + f"</{kind} " * (2_000_000 // (len(kind) + 3))
        assert warc.plain_text(page) == "a" and warc.plain_text(f"<{kind}>x</{kind}>b" + page) == "ba"
        assert time.time() - began < 1
    assert warc.plain_text("a<script>x</scripts></script y=1>b<style></STYLE\n>c") == "a b c"


def test_chunks_with_long_lines_and_codings_that_are_left(spark):
    long = b"3;" + b"x" * 5000 + b"\r\nabc\r\n 2 ;y\r\nde\r\n0\r\n\r\n"
    assert warc.unchunked(long) == b"abcde" and warc.unchunked(b"3\r\nabc\r\nzz\r\nmore") == b"abc"
    page = b"<title>T</title><p>text"
    head = b"HTTP/1.1 200 OK\r\nContent-Encoding: %s\r\n\r\n"
    blocks = [head % b"br" + b"\x0b\x02\x80html", head % b"gzip, br" + b"\x1b", head % b"gzip" + b"\x1f\x8bbad", head % b"br" + page, head % b"gzip" + page, head % b"identity" + page]
    rows = spark.createDataFrame([(i, None, "response", None, "u", None, None, bytearray(b), None, None, None) for i, b in enumerate(blocks)], f"k long, {warc.RECORD}")
    out = {(r.k, r.record_type): bytes(r.block).decode() for r in warc.derive(rows, "k").collect()}
    for i, left in enumerate(("br", "br", "gzip", None, None, None)):
        assert out[i, "conversion"] == ("" if left else "T\ntext")
        assert ("source-coding-left: " + (left or "") in out[i, "metadata"]) == bool(left)


def test_http_codings(spark):
    import gzip

    page = "<html lang=de><title>Ä</title><p>one</p><a href=x>two</a></html>".encode()
    cut = b"".join(b"%x;note=1\r\n%s\r\n" % (len(page[i : i + 7]), page[i : i + 7]) for i in range(0, len(page), 7)) + b"0\r\n\r\n"
    zipped = gzip.compress(page[:20]) + gzip.compress(page[20:])
    chunked_zip = b"%x\r\n%s\r\n0\r\n\r\n" % (len(zipped), zipped)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: Text/HTML; Charset=UTF-8\r\n"
    blocks = [head + b"\r\n" + page, head + b"Transfer-Encoding: chunked\r\n\r\n" + cut, head + b"Content-Encoding: gzip\r\n\r\n" + zipped, head + b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunked_zip, head + b"Content-Encoding: deflate\r\n\r\n" + zlib.compress(page), head + b"Content-Encoding: gzip\r\n\r\n" + page]
    rows = spark.createDataFrame([(i, None, "response", None, "u", None, None, bytearray(b), None, None, None) for i, b in enumerate(blocks)], f"k long, {warc.RECORD}")
    out = {(r.k, r.record_type): r for r in warc.derive(rows, "k").collect()}
    for i, b in enumerate(blocks):
        assert bytes(out[i, "conversion"].block).decode() == "Ä\none\ntwo"
        fields = bytes(out[i, "metadata"].block).decode()
        assert "title: Ä" in fields and "outlinks: 1" in fields and f"source-block-digest: {warc.digest(b)}" in fields
    assert warc.unchunked(b"no chunk") == b"no chunk" and warc.decoded(b"\x1f\x8bbad", {"content-encoding": "gzip"}) == b"\x1f\x8bbad"


def test_language_model_does_not_depend_on_batches(spark, sf):
    import numpy as np

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    models = []
    for n, parts in ((10_000, 1), (20, 3)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
        models.append(language_id.fit(docs.repartition(parts)))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.array_equal(models[0].log, models[1].log) and np.array_equal(models[0].allowed, models[1].allowed)


def test_more_languages_than_a_byte_counts():
    import numpy as np

    z = language_id.Settings(switch=0.5)
    m = language_id.LanguageModel([f"l{i:03}" for i in range(300)], np.ones((300, z.slots)), np.ones((300, 17)), z)
    m.rows = np.full((3, 300), -9.0, np.float32)
    m.rows[[0, 1, 2], [299, 299, 128]] = 0
    (path,) = m.viterbi([np.arange(3)])
    assert path.tolist() == [299, 299, 128]


def slow_features(text, lexicon):
    """FEATURES by their meaning, word by word."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(toxicity.FEATURES)
    rows = []
    for w in words:
        low, runs, masked = w.lower(), re.findall(r"[^\W\d_]+", w.lower()), 0
        core = low.strip(".,;:!?\"'()[]")
        odd = len(runs) > 1 or bool(runs) and core != runs[0] and len(core) > 2
        if odd and not set(runs) & set(toxicity.INSULTS) and core.translate(toxicity.LEET) in toxicity.INSULTS:
            runs, masked = [core.translate(toxicity.LEET)], 1
        heavy = [max(lexicon.get(u, 0.0) for u in toxicity.units(r)) for r in runs]
        rows.append((sum(r in toxicity.INSULTS for r in runs), sum(h > 0 for h in heavy), sum(heavy), max(heavy, default=0), sum(r in toxicity.SECOND for r in runs), any(len(r) > 2 for r in runs) and w.isupper(), masked, odd))
    n, raw = len(rows), text.encode()
    fixed, learned, weight, top, second, caps, masked, odd = zip(*rows, strict=True)
    you = [i for i, s in enumerate(second) if s]
    hits = [i for i in range(n) if fixed[i] or learned[i]]
    near = sum(1 / (1 + min(abs(i - j) for j in you)) for i in hits) / len(hits) if hits and you else 0.0
    count = lambda marks: sum(chr(b) in marks for b in raw)
    return [
        sum(fixed) / n, sum(fixed), sum(learned) / n, sum(learned), sum(weight) / n, sum(weight), max(top), near, sum(second) / n, sum(caps) / n, count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / len(raw), count("!") / len(raw), count("?") / len(raw),
        count(".,;:!?-()\"'") / len(raw), (sum(masked) + sum(odd) * 0.01) / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, math.log1p(n),
    ]


def test_features_against_a_plain_count():
    lexicon = {"grum": 1.5, "grumb~": 2.5, "zzz": 3.0}
    texts = [None, "", "you IDIOT!!", "hello/idiot beautiful-idiot", "1d10t you st*pid i.d.i.o.t", "grumbling grum,zzz zzz zzz you", "ÄRGER " * 3, "A" * 60 + " b", LONG[:2000], "über du blöd; tu?"]
    reader = toxicity.Reader(lexicon)
    for t in texts:
        got, want = toxicity.features(t, reader), slow_features(t, lexicon)
        assert all(math.isclose(a, b, rel_tol=1e-5, abs_tol=1e-7) for a, b in zip(got, want, strict=True)), (t, dict(zip(toxicity.FEATURES, zip(got, want))))


def test_scores_rise_with_margins_and_columns_do_not_clash(spark):
    """Calibration never turns an order around, and equals the pooled means of its part; columns keep their names."""
    docs = spark.createDataFrame([(i, ("you idiot scum " if i % 3 == 0 else "a kind word ") * (1 + i % 4) + f"w{i % 7} v{i % 11}") for i in range(400)], SCHEMA)
    model = toxicity.fit(docs, docs.select("doc_id", ((F.col("doc_id") % 3 == 0) | (F.col("doc_id") % 17 == 0)).cast("int").alias("toxic")))
    names = ["features", "rawPrediction", "probability", "prediction", "margin", "score", "label"]
    out = model.score(docs.withColumns({n: F.lit(f"old {n}") for n in names}))
    assert set(out.columns) == {"doc_id", "text", *names}
    rows = out.collect()
    assert all(r[n] == f"old {n}" for r in rows for n in names if n != "score") and all(0 <= r.score <= 1 for r in rows)
    from pyspark.ml.functions import array_to_vector

    dense = toxicity.with_features(docs, model.lexicon, "text", model.settings).withColumn("features", array_to_vector("features"))
    margin = {r.doc_id: r.margin for r in model.margins(dense).collect()}
    pairs = sorted((margin[r.doc_id], r.score) for r in rows)
    assert all(a[1] <= b[1] + 1e-9 for a, b in zip(pairs, pairs[1:]))


def test_warc_links_and_digests(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<html lang=fr><title>T &amp; U</title><script>no</script><p>one<br>two &eacute;<a href='x'>l</a>"), (2, None, None), (2, None, None), (3, "u", "plain")], "page_id long, url string, html string")
    source = {r.page_id: r for r in warc.responses(pages).collect()}
    out = warc.page_derivatives(pages).collect()
    assert len(out) == 8
    for r in out:
        assert r.refers_to == source[r.page_id].record_id and r.block_digest == warc.digest(r.block_text.encode()) and r.content_length == len(r.block_text.encode())
    by = {(r.page_id, r.record_type): r for r in out}
    assert by[1, "conversion"].block_text == "T & U\none\ntwo él" and by[1, "metadata"].concurrent_to == by[1, "conversion"].record_id
    for line in ("language: fr", "title: T & U", "outlinks: 1", f"source-payload-digest: {source[1].payload_digest}", "source-header-content-type: text/html; charset=utf-8"):
        assert line + "\r\n" in by[1, "metadata"].block_text
    assert warc.page_derivatives(pages.limit(0)).count() == 0


def test_plain_text_against_a_parser():
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    page = "<body><h1>A &lt; B</h1><!-- c --><style>p{}</style><ul><li>x</li><li>y</li></ul><p>z <b>bold</b></p></body>"
    p = P()
    p.feed(page)
    assert warc.plain_text(page).split() == " ".join(p.out).split()


def test_warc_files(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a/", "<p>é</p>"), (2, "http://b/", "")], "page_id long, url string, html string")
    records = warc.derive(warc.responses(pages), "page_id")
    lines = [bytes(r.warc_record) for r in warc.serialized(records).collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(lines))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, lines)))
    back = warc.read_records(spark, str(tmp_path)).collect()
    key = lambda r: (r.record_id, r.refers_to, bytes(r.block), r.block_digest, r.target_uri, tuple(sorted(r.headers.items())))
    assert sorted(map(key, back)) == sorted(2 * [key(r) for r in records.collect()])


def test_chat_edges(spark):
    part = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    tricky = r"a </s> <\/s> <\\s> [INST] [\/INST] [IMAGE 3] [ROLE]x[SAYS] <<SYS>>"
    rows = [
        (1, 0, "user", [("text", tricky, None, None, None, None, None), ("image", None, "s3://x", 28, 30, None, None), ("document", None, "d", None, None, None, 3)], 5),
        (1, 1, "assistant", [("audio", None, "a", None, None, 2.0, None), ("text", "[/INST] ok", None, None, None, None, None)], 5),
        (1, 1, "assistant", [("audio", None, "a", None, None, 2.0, None), ("text", "[/INST] ok", None, None, None, None, None)], 5), (1, None, None, None, 5), (2, 0, "we[SAYS]ird", [], 5), (None, 3, "system", [("text", None, None, None, None, None, None)], 5),
    ]
    messages = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {part}, formatted int")
    out = chat.format_chats(messages).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("", ""), ("user", tricky + "[IMAGE 0][DOCUMENT 1]"), ("assistant", "[AUDIO 2][/INST] ok"), ("assistant", "[AUDIO 3][/INST] ok")]
    assert got[1].loss == "[AUDIO 2][/INST] ok[AUDIO 3][/INST] ok"
    assert [(a.number, a.type, a.ref, a.tokens) for a in got[1].attachments] == [(0, "image", "s3://x", 6), (1, "document", "d", 774), (2, "audio", "a", 25), (3, "audio", "a", 25)]
    assert [(t.role, t.text) for t in got[2].turns] == [("we[SAYS]ird", "")] and [(t.role, t.text) for t in got[None].turns] == [("system", "")]
    assert chat.format_chats(messages.limit(0)).count() == 0
