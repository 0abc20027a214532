"""SimHash, components, packing, M-tree and the pipeline against brute force."""

from dataclasses import replace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkledger.llm import mtree, packing, simhash
from inkledger.llm.common import tokens
from inkledger.llm.components import components


def slow_fingerprint(text, width=4):
    ws = tokens(text)
    pieces = [b" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in pieces]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_fingerprints():
    for t in (None, "", " \n", "One", "a b c", "a b c d e f a b c d", "É é x\x0by", "w " * 3000):
        assert simhash.fingerprint(t, simhash.Settings())[0] % 2**64 == slow_fingerprint(t)


def test_gray_rank():
    x = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


@pytest.mark.parametrize("spread", [2, 40])
def test_index_finds_all_links(spread):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, spread, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (1500 // spread, 3)).astype(np.uint64), axis=1) for b in base]))
    fps = fps[np.argsort(simhash.gray_rank(fps))][:, None]
    found = {(int(a), int(b)) for x, y in simhash.GrayIndex(fps, np.array([0])).links(4) for a, b in zip(x, y, strict=True)}
    i, j = np.nonzero(np.triu(np.bitwise_count(fps ^ fps.T) <= 4, 1))
    assert found == set(zip(i.tolist(), j.tolist(), strict=True))


@pytest.mark.parametrize("page,rows_per_task", [(512, 1_000_000), (8, 100)])
def test_components_of_near_fingerprints(spark, monkeypatch, page, rows_per_task):
    """Also with groups cut between many tasks into small pages."""
    monkeypatch.setattr(simhash, "PAGE", page)
    rng = np.random.default_rng(5)
    fps = [int(b) ^ (1 << int(rng.integers(40, 64))) ^ (1 << int(rng.integers(0, 64))) for b in rng.integers(0, 2**62, 30) for _ in range(25)]
    fps = sorted({x - 2**64 if x >= 2**63 else x for x in fps})
    nodes = spark.createDataFrame([(x, i) for i, x in enumerate(fps)], "f0 long, rep long")
    edges = simhash.link_nodes(nodes, simhash.Settings(rows_per_task=rows_per_task))
    got = {r.node: r.component for r in components(edges).collect()}
    u = np.array(fps, np.int64).view(np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4, 1))
    want = groups(len(fps), zip(i.tolist(), j.tolist(), strict=True))
    assert all(got.get(k, k) == w for k, w in enumerate(want))


def test_linked_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(9001, None), (9002, ""), (9003, " "), (None, "null id"), (9004, "null id"), (9004, "null id")], "doc_id long, text string"))
    rows = simhash.linked_documents(docs).orderBy("doc_id").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    ids = sorted(i for i in texts if i is not None)
    f = np.array([slow_fingerprint(texts[i]) for i in ids], np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4, 1))
    want = dict(zip(ids, (ids[g] for g in groups(len(ids), zip(a.tolist(), b.tolist(), strict=True))), strict=True))
    for r in rows:
        assert r.fingerprint == f"{slow_fingerprint(texts[r.doc_id]):016x}" and r.component_id == want[9004 if r.doc_id is None else r.doc_id]
    assert simhash.linked_documents(docs.limit(0)).count() == 0


def test_a_row_without_an_id_links_its_neighbours(spark):
    """A chain whose middle has no key, ids as numbers and as texts, with the fingerprint's links and with those of sets."""
    rng = np.random.default_rng(1)
    far = lambda a, b: int(np.bitwise_count(np.uint64(slow_fingerprint(a) ^ slow_fingerprint(b))))

    def edited(text):
        words = text.split()
        words[int(rng.integers(len(words)))] = f"e{rng.integers(10**6)}"
        return " ".join(words)

    while True:
        chain = [" ".join(f"w{k}" for k in rng.integers(0, 999, 60))]
        for _ in range(2):
            step = next((t for t in (edited(chain[-1]) for _ in range(300)) if 2 < far(chain[-1], t) <= 4), None)
            chain += [step] if step else []
        if len(chain) == 3 and far(chain[0], chain[2]) > 4:
            break
    for ids, kind in (((1, None, 2), "long"), (("b", None, "c"), "string"), ((None, None, None), "long")):
        docs = spark.createDataFrame([*zip(ids, chain, strict=True), (ids[2], "x y z")], f"doc_id {kind}, text string")
        got = simhash.near_duplicates(docs).collect()
        assert len(got) == 4 and sum(r.component_id == ids[0] for r in got) == 4
    sets = [" ".join(f"w{k}" for k in range(a, a + 200)) for a in (0, 12, 24)]
    docs = spark.createDataFrame([*zip((5, None, 9), sets, strict=True), (None, "alone"), (7, "other words here")], "doc_id long, text string")
    got = simhash.near_duplicates(docs, settings=simhash.NEAR_COPIES).collect()
    assert sorted(str(r.component_id) for r in got) == ["5", "5", "5", "7", "None"]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5, 5), (1, 0)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(400))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_nodes_of_many_links(spark):
    """The same classes whether such nodes are broadcast to their links or meet them in their task."""
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 900, (450, 2))] + [(2000 - i, 1200) for i in range(700)] + [(950, 1100 + i) for i in range(60)]
    want = groups(2001, edges)
    for hot in (0, 20, 100_000):
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), hot).collect()}
        assert set(got) == {x for a, b in edges if a != b for x in (a, b)} and all(want[k] == c for k, c in got.items())


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(3, text), (1, text.replace("w150", "changed")), (2, text), (2, text), (7, " ".join(f"v{i}" for i in range(300))), (None, "kept"), (None, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("mine"))
    kept = simhash.one_of_each(docs, settings=simhash.NEAR_COPIES).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "7", "None", "None"] and {r.component_id for r in kept} == {"mine"}


def test_near_copies_link_and_shared_passages_do_not(spark):
    """30 texts, each with a copy whose last 20 of 400 words differ (similarity 0.90) and one that shares 300 words (0.60)."""
    word = lambda kind, i, a, b: " ".join(f"{kind}{i}x{k}" for k in range(a, b))
    rows = []
    for i in range(30):
        rows += [(3 * i, word("a", i, 0, 400)), (3 * i + 1, word("a", i, 0, 380) + " " + word("b", i, 0, 20)), (3 * i + 2, word("a", i, 0, 300) + " " + word("c", i, 0, 100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for per_task in (1_000_000, 100):  # within tasks, and over pages between them
        z = replace(simhash.NEAR_COPIES, rows_per_task=per_task)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, settings=z).collect()}
        assert all(got[3 * i + 1] == 3 * i for i in range(30))
        assert all(got[3 * i + 2] == 3 * i + 2 for i in range(30))


def word_sets(texts, width=5):
    return [frozenset(simhash.shingles(t, width)) for t in texts]


@pytest.mark.parametrize("page,rows_per_task", [(512, 1_000_000), (4, 50)])
def test_near_copies_against_all_pairs(spark, monkeypatch, page, rows_per_task):
    """Edited copies at similarities from 0.4 to 1: nothing joins without a link of 0.8, few links of 0.8 are missed."""
    monkeypatch.setattr(simhash, "PAGE", page)
    rng = np.random.default_rng(11)
    texts = []
    for i in range(25):
        base = [f"{i}w{k}" for k in rng.integers(0, 500, 200)]
        texts.append(" ".join(base))
        for _ in range(8):
            edit = list(base)
            for k in rng.choice(200, rng.integers(0, 12), replace=False):
                edit[k] = f"e{rng.integers(10**6)}"
            texts.append(" ".join(edit))
    texts += [None, "", "one two", "One  two", "one two three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, settings=replace(simhash.NEAR_COPIES, rows_per_task=rows_per_task)).collect()}
    sets = word_sets(texts)
    links = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = groups(len(texts), links)
    assert all(want[i] == want[c] for i, c in got.items())
    dropped = [i for i, w in enumerate(want) if w != i]
    assert len(dropped) > 60 and sum(got[i] != i for i in dropped) >= 0.95 * len(dropped)


def test_a_node_of_many_links_is_checked_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 10)
    texts = ["a b c d e f g h i j"] + [f"a b c d e f g h i j x{k}" if k % 2 else f"z{k} b q d e f" for k in range(1, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string").union(spark.createDataFrame([(3, "another text of this key"), (None, "x")], "key long, text string"))
    edges = spark.createDataFrame([(k, 0) for k in range(60)] * 2, "a long, b long")
    got = {(r.a, r.b) for r in simhash.checked_links(edges, docs, simhash.NEAR_COPIES).collect()}
    sets = word_sets(texts)
    assert got == {(k, 0) for k in range(1, 60) if len(sets[k] & sets[0]) >= 0.8 * len(sets[k] | sets[0])} - ({(3, 0)} - got)


def test_nearest_forest_is_a_least_spanning_forest():
    rng = np.random.default_rng(12)
    for _ in range(30):
        n = int(rng.integers(2, 40))
        a, b = rng.integers(0, n, (2, 120))
        far = rng.integers(0, 6, 120)
        keep = simhash.nearest_forest(n, a, b, far)
        for d in range(6):  # at every cut-off the forest joins what all links join
            assert groups(n, zip(a[far <= d], b[far <= d], strict=True)) == groups(n, [(a[i], b[i]) for i in keep if far[i] <= d])
        assert len(keep) == n - len(set(groups(n, zip(a, b, strict=True))))


def test_further_words_are_hashes_of_their_own():
    z = simhash.Settings(words=2, more_words=4)
    f = np.array([simhash.fingerprint(f"w{i} w{i + 1} v{i}", z) for i in range(200)], np.int64).view(np.uint64)
    assert f.shape == (200, 6) and simhash.fingerprint(None, z) == [0] * 6
    for u in range(6):
        for w in range(u):
            assert abs(np.bitwise_count(f[:, u] ^ f[:, w]).mean() - 32) < 2


def slow_pack(sizes, z):
    """Best fit by trying every open bin and every opening."""
    bins, todo = [], list(sizes)
    while todo:
        size = todo.pop(0)
        fits = sorted((b[0] - sum(b[1]), i) for i, b in enumerate(bins) if b[0] - sum(b[1]) >= size)
        if fits:
            bins[fits[0][1]][1].append(size)
            continue

        def fill(room, rest=tuple(todo)):
            used = 0
            for x in rest:
                used += x if used + x <= room else 0
            return used

        length = min((x for x in sorted(z.lengths) if x >= size), key=lambda x: (z.cost(x) / (size + fill(x - size)), x))
        bins.append((length, [size]))
    return sorted((min(x for x in z.lengths if x >= sum(b[1])), tuple(b[1])) for b in bins)


def test_packing_is_best_fit():
    z, rng = packing.Settings(lengths=(8, 16, 32)), np.random.default_rng(6)
    for _ in range(50):
        sizes = np.sort(rng.integers(1, 33, rng.integers(1, 60)))[::-1]
        bins, offsets, lengths = packing.pack(sizes, z)
        got = sorted((int(lengths[b]), tuple(sizes[bins == b].tolist())) for b in range(len(lengths)))
        assert got == slow_pack(sizes.tolist(), z)
        for b in range(len(lengths)):
            mine = bins == b
            assert (np.cumsum(sizes[mine]) - sizes[mine] == offsets[mine]).all()


def test_packing_edges(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, "w " * 10000), (5, "x"), (5, "x"), (None, "y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bin_id", F.lit("mine"))
    z = packing.Settings(lengths=(4, 16, 4096))
    got = packing.pack_sequences(docs, settings=z).collect()
    assert sum(r.n_tokens for r in got) == 3 + 10000 + 1 + 1 + 2 and sorted(r.n_tokens for r in got if r.doc_id == 4) == [1808, 4096, 4096]
    assert all((r.bin_id is None) == (r.n_tokens == 0) for r in got) and sum(r.doc_id in (2, 3) for r in got) == 2
    fill = {}
    for r in got:
        if r.n_tokens:
            fill.setdefault(r.bin_id, []).append(r)
    for rs in fill.values():
        total = sum(r.n_tokens for r in rs)
        assert {(r.bin_tokens, r.bin_length) for r in rs} == {(total, min(x for x in z.lengths if x >= total))}
    assert packing.pack_sequences(docs.limit(0), settings=z).count() == 0


def test_rows_without_ids_are_spread(spark):
    """120,000 rows without an id over three shards, and as many of one id."""
    for key in ("CAST(NULL AS BIGINT)", "7L"):
        docs = spark.range(120_000).selectExpr(f"{key} AS doc_id", "'a b c' AS text")
        shards = [r["count"] for r in packing.pack_sequences(docs).groupBy(F.shiftright("bin_id", 32)).count().collect()]
        assert len(shards) == 3 and sum(shards) == 120_000 and max(shards) < 80_000


def test_packed_token_ids(spark):
    rng = np.random.default_rng(13)
    given = {i: rng.integers(1, 1000, n).tolist() for i, n in enumerate([0, 3, 40, 16, 17, 5, 5, 1, 100])} | {50: None}
    docs = spark.createDataFrame(list(given.items()), "doc_id long, ids array<int>")
    z = packing.Settings(lengths=(8, 16, 32))
    back = {}
    for r in packing.pack_token_ids(docs, "ids", settings=z).collect():
        assert len(r.input_ids) == r.bin_length in z.lengths and r.bin_tokens == sum(s.n_tokens for s in r.segments) and r.input_ids[r.bin_tokens :] == [0] * (r.bin_length - r.bin_tokens)
        at = 0
        for s in r.segments:
            assert s.bin_offset == at
            back.setdefault(s.key, {})[s.token_start] = r.input_ids[at : at + s.n_tokens]
            at += s.n_tokens
    assert {k: sum((p[t] for t in sorted(p)), []) for k, p in back.items()} == {k: v for k, v in given.items() if v}


def test_top_products_edges(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(260)] + [(300 + i, [0.5] * 6) for i in range(60)] + [(1000, None), (1100, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1200, [float("nan")] * 6), (1300, [float("inf")] * 6), (None, [0.1] * 6), (0, rng.normal(size=3).tolist()), (400, [0.5] * 6), (400, [0.5] * 6), (1400, []), (1500, [1.0, 2.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    z = mtree.Settings(page=8, rows_per_block=50, queries_per_group=2)
    got = {}
    for r in mtree.top_inner_products(data, F.col("vec_id") % 100 == 0, settings=z).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    usable = sorted({(i, tuple(int(np.floor(1024 * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    want = {}
    for q, v in usable:
        if q % 100 == 0:
            want.setdefault(q, []).extend((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))
    want = {q: [(n + 1, *x) for n, x in enumerate(sorted(c)[:10])] for q, c in want.items() if c}
    assert {q: sorted(v) for q, v in got.items()} == want
    assert mtree.top_inner_products(data.limit(0), F.lit(True)).count() == 0


def test_tree_bounds_save_work():
    """On clustered points most distances are never computed, and the nearest are all found."""
    rng = np.random.default_rng(9)
    points = np.concatenate([c + rng.normal(size=(200, 4)) * 0.01 for c in rng.normal(size=(20, 4)) * 10])
    tree = mtree.MTree(points, mtree.Settings(page=16))
    d = np.linalg.norm(points - points[7], axis=1)
    near, computed = tree.search(points[7], lambda r: r >= 0, 10, -1)
    assert set(np.argsort(d)[:10]) <= set(near.tolist()) and computed < len(points) / 3


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "toxicity", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit("1 2 3").alias("text"), "lang", "source", "n_chars")
    docs, seen = docs.union(extra), []
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs_out = spark.read.parquet(str(tmp_path / name))
        seen.append(docs_out.count())
        if name != "packing":
            assert docs_out.columns == docs.columns
            docs = docs_out
    assert seen[0] == 200 and 120 < seen[2] < seen[1] <= 200 and docs_out.agg(F.sum("n_tokens")).first()[0] == docs.agg(F.sum(packing.word_count(F.col("text")))).first()[0]
