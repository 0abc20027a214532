"""Quality, source divergence and phrases: brute force, SQL on odd rows, and edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkledger.llm import collocations, quality, source_audit
from inkledger.llm.common import by_language, cut_words

SCHEMA = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM, WORD, PIECE = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+"), re.compile("[^\x20\x09]+"), re.compile("[.,;:!?\x0a-\x0d]")


def odd_rows(n=120, seed=4):
    rng = random.Random(seed)
    words = ["a", "B", "über", "ÜBER", "Straße", "日本", "x1y", "the", "The", "of", "\x00nul", "İ", "é", "it's", "-", "w7", "\x1f", "\x85"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " "]) for _ in range(rng.choice([0, 1, 5, 40])))
        rows.append((rng.choice([i, i, None, 3]), rng.choice([text, text, text, None, "the of the of"]), rng.choice(["en", "en", "de", None, "", "en\n", "und"]), rng.choice(["s1", "s1", "s1", "s2", "s3", None, ""])))
    rows.append((999, "the of a " * 30_000, "en", "s1"))
    return rows + rows[:7]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def sql_rows(sql, rows):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("documents", pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())))}))
    return con.sql(sql).fetchall()


def test_words_of_texts():
    rng = random.Random(1)
    for _ in range(200):
        texts = ["".join(rng.choice("aB .\n\té,日\x00") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 6))]
        words, ids, row, piece = cut_words(pa.chunked_array([pa.array(texts, pa.string())]), collocations.PIECE_BYTES)
        got = [(int(r), words[int(i)].as_py().decode()) for i, r in zip(ids, row, strict=True)]
        want = [(r, k, w) for r, t in enumerate(texts) for k, p in enumerate(PIECE.split(t.translate(LOWER))) for w in WORD.findall(p)]
        assert got == [(r, w) for r, _, w in want]
        assert all((piece[i] == piece[i + 1]) == (want[i][:2] == want[i + 1][:2]) for i in range(len(want) - 1))
    whole = pa.RecordBatch.from_pydict({"lang": ["x", "y", "x"], "text": ["skip", "b", "c"]}).slice(1)
    assert [(lang, [w.as_py() for w in cut_words(t.column("text"), source_audit.TERM_BYTES)[0]]) for lang, t in by_language(iter([whole]), 1)] == [("y", [b"b"]), ("x", [b"c"])]


# Source divergence


def plain_divergence(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // q
        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("chunk,few,top", [(12 << 20, 200_000, 200), (200, 0, 2)])
def test_divergence_against_definitions(spark, odd, monkeypatch, chunk, few, top):
    """Also in small pieces, with sizes joined and not broadcast, and a short list of terms."""
    monkeypatch.setattr(source_audit, "CHUNK", chunk)
    got = source_audit.divergence(odd.withColumn("term", F.lit(1)).withColumn("n", F.lit("x")), top=top, few=few).collect()
    want = plain_divergence(odd_rows(), 3, top)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {r.part for r in got} == {"pair", "term"} and any(r.part == "term" and r.source == "s2" for r in got)


def test_divergence_sql_on_odd_rows():
    assert set(sql_rows(source_audit.ORACLE, odd_rows())) == plain_divergence(odd_rows(), 3, 200)


def test_divergence_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert source_audit.divergence(empty).count() == 0
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "rare words", "en", "b"), (4, None, "en", "c")]
    got = {tuple(r) for r in source_audit.divergence(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("en", s, "pair", o, 0, k) for s, others in (("a", "bc"), ("b", "ac"), ("c", "ab")) for k, o in enumerate(others, 1)}
    renamed = spark.createDataFrame([("x y", "p", i % 2) for i in range(6)], "body string, tongue string, source int")
    assert {(r.lang, r.source) for r in source_audit.divergence(renamed, lang="tongue", text="body").collect()} == {("p", "0"), ("p", "1")}


def test_pairs_of_a_run_in_pieces(monkeypatch):
    rng = random.Random(2)
    rows = [("l", f"t{t}", f"s{s:02}", rng.randint(1, 10**9), 1 + s % 3) for t in range(12) for s in sorted(rng.sample(range(20), rng.randint(1, 20)))]
    f = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for _, t, s, p, z in rows:
        for _, u, o, q, y in rows:
            if t == u and s != o:
                want[s, o] += f(p, q) - f(p, y) - f(z, q) + f(z, y)
    batches = [pa.RecordBatch.from_pylist([dict(zip(("lang", "term", "source", "p", "zero"), r, strict=True)) for r in rows[i : i + 7]]) for i in range(0, len(rows), 7)]
    for most in (1, 50, 1 << 21):
        monkeypatch.setattr(source_audit, "PAIRS", most)
        got = Counter()
        for b in source_audit.pair_runs(iter(batches)):
            for r in b.to_pylist():
                got[r["source"], r["item"]] += r["value"]
        assert got == want


def test_shares_are_exact(spark):
    rows = [(0, 0, 0), (0, 10, 5), (7, 10, 3), (10**13, 3 * 10**13 + 7, 123_456_789), (9_300_000_000, 9_300_000_001, 1)]
    got = spark.createDataFrame(rows, "n long, total long, terms long").select("n", "total", "terms", source_audit.share(F.col("n"), F.col("total"), F.col("terms")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 1) // max(1, r.total + r.terms) for r in got)


# Phrases


def plain_phrases(rows, least, covered, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split((text or "").translate(LOWER)):
            w = WORD.findall(piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        some = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in some.items():
            if len(g) == 2 and any(100 * b >= covered * a for h, b in some.items() if len(h) == 3 and g in (h[:2], h[1:])):
                continue
            score, k = min((10**6 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out |= {(lang, rank, p.decode(), -a, x, y, n[lang], -s) for rank, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)}
    return out


@pytest.mark.parametrize("chunk,least,top", [(12 << 20, 10, 2000), (300, 3, 15)])
def test_phrases_against_definitions(spark, odd, monkeypatch, chunk, least, top):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    got = collocations.top_phrases(odd.withColumn("word", F.lit(1)).withColumn("f", F.lit(2)), top=top, least=least).collect()
    want = plain_phrases(odd_rows(), least, 50, top)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r.phrase.count(" ") == 2 for r in got) and any(r.phrase.count(" ") == 1 for r in got) and {"und", "en", ""} <= {r.lang for r in got}


def test_phrases_sql_on_odd_rows():
    assert set(sql_rows(collocations.ORACLE, odd_rows())) == plain_phrases(odd_rows(), 10, 50, 2000)


def test_codes_that_collide_are_drawn_anew(spark, odd):
    """With few different codes the first seeds fail; phrases are those of the definitions all the same."""
    few = lambda lang, word, seed: collocations.code_of(lang, word, seed) >> 53 << 53
    names = {("und" if lang is None else lang, w) for _, text, lang, _ in odd_rows() for p in PIECE.split((text or "").translate(LOWER)) for w in WORD.findall(p)}
    first = next(s for s in range(5000) if len({few(lang, w.encode(), s) for lang, w in names}) == len(names))
    start = max(0, first - 2)
    code = lambda lang, word, seed: few(lang, word, seed + start)
    words, seed = collocations.dictionary(odd.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")), code)
    assert seed + start == first and words.count() == len(names) == words.select("code").distinct().count()
    assert {tuple(r) for r in collocations.top_phrases(odd, least=3, code=code).collect()} == plain_phrases(odd_rows(), 3, 50, 2000)
    with pytest.raises(ValueError):
        collocations.dictionary(odd.select("lang", "text").na.fill(""), lambda lang, word, seed: 0, seeds=2)


def test_pairs_of_one_mixed_key_are_told_apart(spark):
    codes = {b"x": 1, b"y": 0, b"z": 1 << 21}
    rows = spark.createDataFrame([(1, 0, 2), (0, 1 << 21, 5), (1, 0, 3), (0, 1 << 21, 4), (1, 0, 1), (7, 7, 20)], "w1 long, w2 long, n long")
    assert collocations.mixed_codes(np.array([1, 0], np.uint64), np.array([0, 1 << 21], np.uint64)).tolist() == [1 << 21] * 2
    assert {tuple(r) for r in collocations.sorted_counts(rows, 2, 7).collect()} == {(0, 1 << 21, 9), (7, 7, 20)}
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(["x y. y z", "x y", "y z. x y", "x y"] * 3)], SCHEMA)
    got = {r.phrase: r.a for r in collocations.top_phrases(docs, least=5, code=lambda lang, word, seed: codes[word]).collect()}
    assert got == {"x y": 12, "y z": 6}


def test_bitmap_of_leading_bits(spark):
    rng = np.random.default_rng(3)
    codes = rng.integers(-(2**63), 2**63, 500)
    for bits in (16, 27):
        map_ = collocations.bitmap(spark.createDataFrame([(int(c),) for c in codes], "c long"), F.col("c"), bits)
        own, other = codes.view(np.uint64), rng.integers(-(2**63), 2**63, 2000).view(np.uint64)
        lead = set((own >> np.uint64(64 - bits)).tolist())
        assert collocations.holds(map_, own, bits).all()
        assert collocations.holds(map_, other, bits).tolist() == [int(x) in lead for x in (other >> np.uint64(64 - bits))]


def test_phrases_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations.top_phrases(empty).count() == 0
    assert collocations.top_phrases(spark.createDataFrame([(1, None, None, None), (2, "", "en", "s"), (3, " \t.!", "en", "s")], SCHEMA)).count() == 0


# Quality

SMALL = quality.Settings(rows=512, dims=4, rounds=4, tasks=2)
GOOD = ["clear words in a plain line", "a calm and even text of words", "plain words make a good line"]
BAD = ["BUY!! NOW!! $$$ &&&", "### xx&&& $$$ now!!", "&&& $$$ !!! CLICK!!"]


def made(n=200, seed=1):
    rng = random.Random(seed)
    label = [rng.random() < 0.7 for _ in range(n)]
    return [(i, " ".join(rng.choices(" ".join(GOOD if y else BAD).split(), k=rng.randint(3, 60)))) for i, y in enumerate(label)], [(i, int(y)) for i, y in enumerate(label)]


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = made()
    return quality.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), settings=SMALL)


def plain_features(token, z):
    """Polynomial sums of the whole marked token and of its n-grams, mixed into rows of the table."""
    chars, wrap, rows = [1, *map(ord, token), 2], 2**64, []
    for kind, parts in ((0, [chars]), *((n, [chars[i : i + n] for i in range(len(chars) - n + 1)]) for n in range(z.shortest, z.longest + 1))):
        for part in parts:
            h = (sum(c * pow(0x9E3779B97F4A7C15, k, wrap) for k, c in enumerate(part)) + kind) * 0xBF58476D1CE4E5B9 % wrap
            rows.append(((h ^ (h >> 29)) * 0x94D049BB133111EB % wrap >> 32) % z.rows)
    return rows


def plain_score(text, w, z):
    total, n = [0.0] * z.dims, 0
    for token in re.findall("[^ \t-\r]+", text or ""):
        for row in plain_features(token, z):
            total = [a + float(b) for a, b in zip(total, w.vectors[row], strict=True)]
            n += 1
    hidden = [x / max(n, 1) for x in total] + [1.0]
    raw = [sum(h * float(o) for h, o in zip(hidden, column, strict=True)) for column in w.output.T]
    return [math.exp(x - max(raw)) / sum(math.exp(y - max(raw)) for y in raw) for x in raw]


def test_quality_scores_against_plain_sums(spark, learned):
    rows = [(1, "clear words"), (2, None), (3, ""), (4, " \n\t"), (5, "BUY!! über 日本語 😀"), (5, "BUY!! über 日本語 😀"), (None, "no id"), (7, "plain $$$ " * 40_000), (8, "x" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine")).withColumn("vectors", F.lit(1)).withColumn("label", F.lit("k"))
    got = learned.score(docs).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "vectors", "label", "score"}
    for r in got:
        assert abs(r.score - plain_score(r.text, learned.weights, SMALL)[1]) < 1e-5 and 0 <= r.score <= 1 and r.label == "k"
    by_text = defaultdict(set)
    for part in (docs.repartition(1), docs.repartition(7)):
        for r in learned.score(part).collect():
            by_text[r.text].add(r.score)
    assert all(len(x) == 1 for x in by_text.values()) and by_text[None] == by_text[""] == by_text[" \n\t"]
    assert learned.score(docs.limit(0)).count() == 0
    assert abs(learned.score(docs, label=0).where("doc_id = 1").first().score + learned.score(docs).where("doc_id = 1").first().score - 1) < 1e-9


def test_quality_features():
    z = quality.Settings(rows=997)
    words = ["a", "über", "日本語😀", "\x01\x02", "x" * 500, "don't"]
    rows, size = quality.features(words, z)
    cuts = np.r_[0, np.cumsum(size)]
    assert [sorted(rows[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)] == [sorted(plain_features(w, z)) for w in words]
    assert [len(x) for x in quality.features([], z)] == [0, 0]


def test_quality_gradients_against_differences():
    z = quality.Settings(rows=64, dims=3, longest=3)
    rng = np.random.default_rng(2)
    w = quality.Weights(rng.normal(size=(64, 3)), rng.normal(size=(4, 3)))
    texts, labels = ["one two one", "three", None, "two two!!"], np.array([0, 2, 1, 1])

    def loss(v, o):
        return -sum(math.log(plain_score(t, quality.Weights(v, o), z)[y]) for t, y in zip(texts, labels, strict=True))

    own = quality.Trainer(w, z, 0.1)
    rows, grad, out, total = own.gradients(texts, labels)
    assert abs(total - loss(w.vectors, w.output)) < 1e-9
    full = np.zeros_like(w.vectors)
    full[rows] = grad
    for which, mine in ((0, full), (1, out)):
        for at in np.ndindex(mine.shape):
            both = []
            for step in (1e-5, -1e-5):
                parts = [w.vectors.copy(), w.output.copy()]
                parts[which][at] += step
                both.append(loss(*parts))
            assert abs((both[0] - both[1]) / 2e-5 - mine[at]) < 1e-6


def test_quality_learns_and_edges(spark, learned):
    docs, labels = made(150, 9)
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.score for r in learned.score(texts).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, y in labels) >= 0.97 * len(labels)
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, quality int")
    assert quality.fit(texts, rows(), settings=SMALL).score(texts).where("score = 0").count() == 150
    assert quality.fit(texts, rows((1, 1), (1, 1), (None, 0), (2, None)), settings=SMALL).score(texts).where("score = 1").count() == 150
    twice = quality.fit(texts, rows((1, 1), (1, 0), (2, 1)), settings=SMALL)
    assert twice.labels == [0, 1] and twice.weights is not None
    again = quality.fit(texts, rows(*((i, y) for i, y in labels)), settings=SMALL)
    other = quality.fit(texts.repartition(5), rows(*((i, y) for i, y in reversed(labels))), settings=SMALL)
    assert np.array_equal(again.weights.vectors, other.weights.vectors)  # neither partitions nor order change the model


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.held_out_quality(docs, labels)
    assert got.count() == docs.count() and got.where("score < 0 OR score > 1 OR predicted <> cast(score >= 0.5 AS int)").count() == 0
    right = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.97
