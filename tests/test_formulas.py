"""Hand-derived answers on inline rows: word lists, thresholds and edges that the tables cannot reach."""

import pytest
from pyspark.sql import functions as F

from inkledger.functions import lexicons as L
from inkledger.functions import text as X
from inkledger.functions import vectors as V
from inkledger.operators import flags, pages, report, scoring, similarity, style


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(v, str) else 'double'}" for n, v in values.items())).select(column(*map(F.col, names))).first()[0]


def subs(spark, *texts):
    return spark.createDataFrame([(i, "s", "a", t) for i, t in enumerate(texts)], "id long, subject string, school string, text string").withColumn("low", F.lower("text"))


def test_cleaning(spark):
    assert one(spark, X.clean_text, t="a\tbé\n\n\n  c") == "a b\nc"
    assert one(spark, X.clean_text_keep_paragraphs, t="  a\tbé\n\n\n\n  c \n") == "a b \n\n c"


def test_pattern_and_marker_hits(spark):
    assert one(spark, lambda t: X.pattern_hits(t, L.AI_PATTERNS), t="furthermore, thus, we") == 1
    assert one(spark, lambda t: X.pattern_hits(t, L.STUDENT_PATTERNS), t="first, we can't") == 2
    r = style.markers(subs(spark, "some different things")).first()
    assert (r.human_marker_count, r.human_marker_ratio, r.ai_marker_count) == (2, 0.091, 0)
    assert (len(L.AI_PATTERNS), len(L.STUDENT_PATTERNS), len(L.AI_MARKERS), len(L.HUMAN_MARKERS), len(set(L.STYLE_STOPWORDS)), len(set(L.COPY_STOPWORDS))) == (66, 20, 42, 22, len(L.STYLE_STOPWORDS), len(L.COPY_STOPWORDS))


def test_entropy_and_burstiness(spark):
    rows = subs(spark, "ab" * 40, "short", "alpha " * 20 + "beta " * 20, "")
    assert [r.entropy for r in style.char_entropy(rows).orderBy("id").collect()][:2] == [0.2, 0.5]
    assert [r.burstiness for r in style.burstiness(rows).orderBy("id").collect()] == [0.5, 0.5, 1.0, 0.5]


def test_sentences_and_richness(spark):
    rows = subs(spark, "One two three. Four five six seven. Eight one.", " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in list(range(30)) * 2), "")
    s = style.sentence_stats(rows).orderBy("id").collect()
    assert (s[0].sentences, s[0]["mean"], s[0].std) == (3, 3.0, 0.82) and s[2].cv == 0.0
    assert [r.lexical_richness for r in style.mattr(rows).orderBy("id").collect()][1:] == [0.6, 0.0]


def test_punctuation_order(spark):
    r = style.punctuation(subs(spark, "b; a, c, d! e!")).first()
    assert r.counts == ",:2 !:2 ;:1"


def test_alt_probability(spark):
    rows = subs(spark, "furthermore constant pressure arises because multiple deadlines create overwhelming outcomes for all learners every year", "too short", "we mug up " * 10)
    assert [r.ai_probability for r in style.ai_probability_alt(rows).orderBy("id").collect()][:2] == [0.9, 0.0]


def test_similarity_edges(spark):
    rows = subs(spark, "the cat sat", "the cat ran", "", "", "the cat sat")
    got = {(r.id_a, r.id_b): r.text_sim for r in similarity.copy_pairs(rows).collect()}
    assert got == {(0, 1): 0.5, (0, 4): 1.0}  # 4 is a copy of 0 and linked through it
    assert similarity.copy_pairs(rows.limit(0)).count() == 0


def test_prefix_join_equals_brute_force(spark):
    import itertools
    import random

    rng = random.Random(1)
    texts = [" ".join(rng.choices([f"t{i}" for i in range(12)], weights=range(12, 0, -1), k=rng.randint(1, 9))) for _ in range(60)]
    for least in (0.25, 0.4, 0.8):
        want = {}
        for (i, a), (j, b) in itertools.combinations(enumerate(map(lambda t: set(t.split()), texts)), 2):
            s = int(len(a & b) / len(a | b) * 10000 + 0.5) / 10000
            first = texts.index(texts[i]) == i and texts.index(texts[j]) in (i, j)  # copies are listed with the first of them
            if s >= least and first:
                want[i, j] = s
        assert {(r.id_a, r.id_b): r.text_sim for r in similarity.copy_pairs(subs(spark, *texts), least).collect()} == want


def test_copies_stay_linear(spark):
    """5,000 equal texts, 3 of another block without a school, and one similar text: a row for each copy, one for the link."""
    rows = [(i, "s", "a", "the same few words in every text") for i in range(5000)] + [(6000, "s", "a", "the same few words in this text")] + [(7000 + i, "s", None, "the same few words in every text") for i in range(3)]
    table = spark.createDataFrame(rows, "id long, subject string, school string, low string")
    got = {(r.id_a, r.id_b): r.text_sim for r in similarity.copy_pairs(table).collect()}
    assert len(got) == 4999 + 1 + 2 and got[0, 6000] == 0.75 and all(got[0, i] == 1.0 for i in range(1, 5000)) and got[7000, 7002] == 1.0
    no_vectors = spark.createDataFrame([], "id long, subject string, school string, v array<double>")
    pairs = {(r.id_a, r.id_b): r.text_sim for r in similarity.evidence(table, no_vectors, 0.4, 0.75).collect()}
    assert len(pairs) == 4999 + 5000 + 2 and pairs[4999, 6000] == 0.75  # every copy meets the similar text too


def test_vector_pairs_of_tiles(spark):
    import random

    rng = random.Random(4)
    rows = [(i, "s", None if i % 3 else "a", [rng.uniform(-1, 1) for _ in range(3)] if i % 7 else None) for i in range(40)]
    table = spark.createDataFrame(rows, "id long, subject string, school string, v array<double>")
    want = {}
    for i, _, x, v in rows:
        for j, _, y, w in rows:
            if i < j and x == y and v and w:
                c = sum(a * b for a, b in zip(v, w)) / (sum(a * a for a in v) ** 0.5 * sum(b * b for b in w) ** 0.5)
                if int(c * 10000 + 0.5) / 10000 >= 0.3:
                    want[i, j] = int(c * 10000 + 0.5) / 10000
    assert want and {(r.id_a, r.id_b): r.hw_sim for r in similarity.vector_pairs(table, 0.3, tile=6).collect()} == want


def test_cosine(spark):
    rows = spark.createDataFrame([([0.80, 0.75, 0.60, 0.55, 0.70], [0.20, 0.18, 0.40, 0.80, 0.30]), ([1.0] * 18, [1.0] * 5), (None, [1.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in rows.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.7871, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("score,grade", [(9.0, "A+"), (8.9, "A"), (4.0, "D"), (3.9, "F")])
def test_grades(spark, score, grade):
    assert one(spark, scoring.grade_label, s=score) == grade


def test_unreadable_submission(spark):
    f = lambda ai, copy, hand, sty, ocr: scoring.final_score(scoring.originality(ai, copy), ai, copy, hand, sty, ocr)
    assert one(spark, f, ai=0.1, copy=0.0, hand=0.6, sty=0.5, ocr=0.0) == 8.7


def signals(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, ai_probability double, style_score double, ocr_confidence double, score double")


def test_base_flags(spark):
    got = [r.flags for r in flags.base_flags(signals(spark, (0.40, 0.5, 0.0, 5.0), (0.28, 0.5, 0.29, 5.0), (0.2799, 0.24, 0.30, 5.0))).orderBy("id").collect()]
    assert got == [["AI-generated content detected"], ["Possible AI assistance detected", "Low legibility – assignment hard to read"], ["Highly inconsistent writing style detected"]]


@pytest.mark.parametrize("ts,hs,scores,ai,rule,who", [
    (0.55, 0.99, (7.0, 7.0), (0.1, 0.1), "A", [0]), (0.55, 0.0, (8.0, 7.0), (0.1, 0.1), "A", [1]), (0.10, 0.75, (7.0, 7.0), (0.2, 0.6), "B", [1]), (0.54, 0.99, (7.0, 7.0), (0.1, 0.1), "C", [0, 1]), (0.39, 0.74, (7.0, 7.0), (0.1, 0.1), None, []),
])
def test_pair_rules(spark, ts, hs, scores, ai, rule, who):
    pairs = spark.createDataFrame([(0, 1, ts, hs)], "id_a long, id_b long, text_sim double, hw_sim double")
    got = flags.pair_flags(pairs, signals(spark, (ai[0], 0.5, 0.0, scores[0]), (ai[1], 0.5, 0.0, scores[1]))).orderBy("id").collect()
    assert [r.id for r in got] == who and all(r.rule == rule and r.peer == 1 - r.id for r in got)


def test_peer_flags(spark):
    rows = spark.createDataFrame([(0, 10, 0.9, 0.5), (1, 11, 0.1, 0.7), (2, 11, 0.1, 0.2)], "id long, student long, ai_probability double, hw_consistency double")
    pairs = spark.createDataFrame([(0, 1, 0.7, 0.1), (0, 2, 0.1, 0.95), (1, 2, 0.9, 0.9)], "id_a long, id_b long, text_sim double, hw_sim double")
    got = {(r.id, r.type, r.peer) for r in flags.peer_flags(rows, pairs, L.PEER).collect()}
    assert got == {(0, "ai", None), (0, "copied", 1), (1, "copied", 0), (0, "handwriting", 2), (2, "handwriting", 0)}
    alt = {(r.id, r.type, r.peer) for r in flags.peer_flags(rows, pairs, L.PEER_ALT, directed=True).collect()}
    assert alt == {(0, "ai", None), (0, "copied", 1), (2, "copied", 1), (0, "handwriting", 2), (2, "handwriting", 0)}


def test_five_are_no_special_batch(spark):
    texts = [f"alpha beta gamma delta w{i % 3}" for i in range(6)]
    pair = lambda n: {(r.id_a, r.id_b): r.text_sim for r in similarity.copy_pairs(subs(spark, *texts[:n])).collect()}
    five, six = pair(5), pair(6)
    assert five == {k: v for k, v in six.items() if 5 not in k}


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(2.0,), (2.1,), (8.0,), (8.1,), (None,)], "score double")
    assert {r.bin: r["count"] for r in report.score_histogram(rows).collect()} == {"0-2": 1, "3-4": 1, "5-6": 0, "7-8": 1, "9-10": 1}


def test_line_runs(spark):
    ink = [0, 9, 9, 9, 9, 0, 9, 9, 0, 9, 9, 9, 9, 9]  # a line, noise, a line that touches the edge
    rows = spark.createDataFrame([(1, y, v) for y, v in enumerate(ink)], "page int, y int, ink int")
    assert [tuple(r) for r in pages.line_runs(rows, F.lit(100.0)).collect()] == [(1, 1, 4, 36)]


def test_merge_and_recognise(spark):
    rows = spark.createDataFrame([(1, 2, "b", 0.5), (1, 1, "a", 1.0), (1, 3, " ", 0.1), (2, 1, None, 0.9)], "id long, page int, text string, confidence double")
    assert {tuple(r) for r in pages.merge_pages(rows).collect()} == {(1, "a\nb", 0.75, 3), (2, "", 0.0, 1)}
    images = spark.createDataFrame([("x", bytearray(b"ok")), ("y", bytearray(b""))], "path string, content binary")

    def provider(b):
        return b.decode(), 1.0 / len(b)

    assert {(r.path, r.text, r.ingest_status) for r in pages.recognise(images, provider).collect()} == {("x", "ok", "ok"), ("y", "", "failed: ZeroDivisionError")}


def test_planted_violations(spark):
    rows = spark.createDataFrame([(1, "scored", 5.0), (1, "scored", 5.0), (2, None, None), (3, "scored", 10.5), (4, "scored", None), (5, "submitted", 1.0), (6, "submitted", None)], "id long, status string, score double")
    assert {r.rule: r.violations for r in report.quality_checks(rows).collect()} == {"repeated id": 2, "unknown state": 1, "score out of range": 1, "score and state differ": 2}


def test_refused_users(spark):
    rows = [("1", "A", "a@b.c", "secret", "student"), ("2", " ", "a@b.c", "secret", "student"), ("3", "A", None, "secret", "student"), ("4", "A", "ab.c", "secret", "teacher"), ("5", "A", "a@b", "secret", "teacher"), ("6", "A", "a@b.c", "12345", "teacher"), ("7", "A", "a@b.c", "secret", "admin"), ("8", "A", "a@b.c", "", "admin")]
    got = {r.id: r.error for r in report.invalid_users(spark.createDataFrame(rows, "id string, name string, email string, password string, role string")).collect()}
    assert got == {"2": "missing name", "3": "missing email", "4": "bad email", "5": "bad email", "6": "short password", "7": "unknown role", "8": "missing password"}


@pytest.mark.parametrize("cvs,strokes,want", [((0.0, 0.0, 0.0, 0.0), 20, 1.0), ((1.0, 1.0, 1.0, 1.0), 20, 0.4), ((2.0, 0.5, 0.0, 0.25), 20, 0.6925), ((0.0, 0.0, 0.0, 0.0), 19, 0.7), ((9.0, 9.0, 9.0, 9.0), 1, 0.28)])
def test_consistency(spark, cvs, strokes, want):
    row = spark.createDataFrame([(*cvs, strokes)], "a double, b double, c double, d double, n int")
    assert abs(row.select(pages.consistency(*map(F.col, "abcdn"))).first()[0] - want) < 1e-9


def test_states_of_a_submission(spark):
    from inkledger import sources as S

    rows = spark.createDataFrame([(1, 7.5, "B+", "x" * 6000, ["f"], (3,)), (2, 1.0, "F", None, [], (0,)), (3, 9.0, "A+", "t", [], (0,))], "id long, score double, grade_label string, text string, flags array<string>, analysis struct<n:int>").withColumn("feedback", F.lit("fine"))
    at = lambda d: F.to_timestamp(F.lit(f"2024-01-0{d}"))
    events = S.submitted(rows, at(1)).unionAll(S.reviewing(rows, at(2))).unionAll(S.scored(rows.where("id <> 3"), at(2))).unionAll(S.submitted(rows.where("id = 2"), at(4)))
    got = {r.id: r for r in S.current(events).collect()}
    assert [got[i].status for i in (1, 2, 3)] == ["scored", "submitted", "reviewing"]
    assert (got[1].score, len(got[1].ocr_text), got[1].flags, got[1].analysis, got[1].submitted_at.day, got[1].scanned_at.day) == (7.5, 5000, '["f"]', '{"n":3}', 1, 2)
    assert (got[2].score, got[2].flags, got[2].analysis, got[2].scanned_at, got[2].submitted_at.day) == (None, "[]", "{}", None, 4)


def test_history_needs_a_text(spark):
    rows = spark.createDataFrame([(1, "s", "a", "reviewing", None, 1), (2, "s", "a", "scored", "t", 2), (3, "s", "a", "scored", "", 3), (4, "s", "a", "scored", None, 4), (5, "s", "b", "scored", "t", 5)], "id long, subject string, school string, status string, text string, submitted_at int")
    ids = rows.where("id = 1").select("id")
    assert {(r.id, r.origin) for r in report.peers_of_batch(rows, ids, "text").collect()} == {(1, "sibling"), (2, "history")}


def test_one_student_is_one_hand(spark):
    rows = spark.createDataFrame([(0, "s", "a", 1, [1.0, 0.0]), (1, "s", "a", 1, [0.0, 1.0]), (2, "s", "a", 2, [1.0, 0.2]), (3, "s", "b", 1, [1.0, 0.0]), (4, "s", "a", None, [1.0, 0.0])], "id long, subject string, school string, student int, v array<double>")
    got = {(r.id, r.peer): (r.sim, r.clipped) for r in similarity.hand_matrix(rows, 0.3).collect()}
    assert got[0, 1] == got[1, 0] == (1.0, 1.0) and got[0, 2] == got[2, 0] == (0.981, 0.981) and got[0, 4] == (1.0, 1.0) and (1, 2) not in got and not any(3 in k for k in got)


def test_images(spark):
    from inkledger.operators import images

    flat = spark.createDataFrame([(1, y, [200] * 6) for y in range(5)] + [(2, 0, [0, 255, 0])] + [(3, y, [250] * 9 if y != 4 else [250] * 4 + [10] + [250] * 4) for y in range(9)], "page int, y int, grey array<int>")
    dark = {(r.page, r.y): r.binary for r in images.binarized(flat).collect()}
    assert all(dark[1, y] == [255] * 6 for y in range(5)) and dark[3, 4] == [255] * 4 + [0] + [255] * 4 and dark[3, 0] == [255] * 9
    calm = {(r.page, r.y): r.grey for r in images.without_noise(flat).collect()}
    assert all(calm[1, y] == [200] * 6 for y in range(5)) and calm[2, 0] == [128, 128, 128]
    (m,) = images.page_metrics(images.ink_rows(images.binarized(flat.where("page = 3")))).collect()
    assert (m.width, m.height, m.ink_ratio, m.text_lines, m.pressure) == (9, 9, 0.0123, 1, 0.961)
    colour = spark.createDataFrame([([255, 0, 0], [0, 255, 0], [0, 0, 255])], "r array<int>, g array<int>, b array<int>")
    assert colour.select(images.grey_of(*map(F.col, "rgb"))).first()[0] == [76, 150, 29]


def test_strokes_and_lines(spark):
    from inkledger.operators import images

    boxes = spark.createDataFrame([(1, x, 10, 4, 8, 20, 24, False) for x in (0, 10, 20, 30, 40)] + [(1, 5, 5, 2, 2, 6, 8, True), (1, 60, 0, 1, 1, 3, 4, False)], "page int, x int, y int, w int, h int, area int, perimeter int, hole boolean")
    sheets = spark.createDataFrame([(1, 100, 50), (2, 100, 50)], "page int, height int, width int")
    got = {r.page: r for r in images.stroke_features(boxes, sheets).collect()}
    assert (got[1].stroke_count, got[1].stroke_density, got[1].mean_height, got[1].height_cv, got[1].mean_aspect, got[1].mean_gap, got[1].gap_cv, got[1].gap_to_width_ratio, got[1].thinness) == (5, 0.02, 8.0, 0.0, 0.5, 6.0, 0.0, 0.75, 0.12)
    assert {k: got[2][k] for k in images.NO_STROKES} == images.NO_STROKES
    (shape,) = images.stroke_shape(boxes).collect()
    assert (shape.loop_density, shape.baseline_deviation) == (0.2, 0.0)
    ink = [0, 9, 9, 9, 9, 0, 0, 9, 9, 9, 9, 9, 9, 0]
    rows = spark.createDataFrame([(1, y, v, 10) for y, v in enumerate(ink)] + [(2, 0, 0, 10)], "page int, y int, ink int, width int")
    lines = {r.page: tuple(r)[1:] for r in images.line_features(rows).collect()}
    assert lines == {1: (2, 5.0, 0.2, 0.9, 0.0), 2: (0, 0.0, 1.0, 0.0, 1.0)}
    angles = spark.createDataFrame([(1, 1, 10.0), (1, 2, -80.0), (1, 3, 20.0), (1, 4, 40.0), (2, 1, 90.0)], "page int, rank int, angle double")
    (a,) = images.median_angle(angles, 3).select("page", images.slant(F.col("angle")).alias("s"), images.skew(F.col("angle")).alias("k")).collect()
    assert tuple(a) == (1, 0.5, 15.0)


def test_rows_of_unequal_width_and_submissions_without_pages(spark):
    from inkledger.operators import images

    rows = spark.createDataFrame([(1, 0, [200, 90, 200]), (1, 1, [200, 90]), (1, 2, []), (1, 3, None), (1, 4, [200])], "page int, y int, grey array<int>")
    full = spark.createDataFrame([(1, 0, [200, 90, 200]), (1, 1, [200, 90, 90]), (1, 4, [200, 200, 200])], "page int, y int, grey array<int>")
    assert sorted(map(tuple, images.binarized(rows).collect())) == sorted(map(tuple, images.binarized(full).collect()))
    hands = spark.createDataFrame([(1, 0.9, 0.3, [0.5] * 18)], "id int, consistency double, pressure double, fingerprint array<double>")
    got = {r.id: r for r in images.hand_of_all(spark.createDataFrame([(1,), (2,), (2,)], "id int"), hands, "id").collect()}
    assert got[1].consistency == 0.9 and got[2].consistency == got[2].pressure == 0.5 and got[2].fingerprint == [0.0] * 18 and len(got) == 2


def test_stored_flags_and_states(spark):
    rows = spark.createDataFrame([("scored", 1.0, '["x"]'), ("scored", 2.0, "[]"), ("scored", 2.0, None), ("scored", 2.0, "bad"), ("reviewing", None, '["x"]')], "status string, score double, flags string")
    assert report.dashboard_stats(rows).first().asDict() == {"total": 5, "pending": 0, "reviewing": 1, "scored": 4, "flagged": 1, "avg_score": 1.75}
    odd = spark.createDataFrame([(1, "lost", None), (2, None, None), (3, "scored", 4.0)], "id long, status string, score double")
    assert {r.rule: r.violations for r in report.quality_checks(odd).collect()} == {"unknown state": 2}
    ask = spark.createDataFrame([(1, 5), (1, 6), (9, 5)], "id long, student long")
    mine = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "id long, student_id long, status string")
    assert [tuple(r) for r in report.owned_by(mine, ask).collect()] == [(1, 5, "a")]


def test_rows_as_json(spark):
    from inkledger import sources

    rows = spark.createDataFrame([(1, None, ["a", "ü"])], "id long, x string, flags array<string>")
    assert rows.select(sources.as_json(rows).alias("j")).first().j == '{"id":1,"flags":["a","ü"]}' and rows.select(sources.as_json(rows, "id").alias("j")).first().j == '{"id":1}'
