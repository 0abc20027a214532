"""All queries of the library over the driver's tables. Their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import sources as S
from .. import streaming
from ..functions import lexicons as L
from ..functions import text as X
from ..functions import vectors as V
from ..operators import contours, flags, images, pages, report, scans, scoring, similarity, style
from .oracle import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Vector similarity from which ``hw_pairs`` lists a pair.
HAND = 0.30
TEACHER = "NATION_0"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in QUERIES}


def subs(spark: SparkSession, d: str) -> DataFrame:
    return S.submissions(spark, d)


def hands(spark: SparkSession, d: str) -> DataFrame:
    """Submissions' vectors: the embedding of the same number."""
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("subject"), F.col("source").alias("school"))
    vectors = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return docs.join(vectors, "id")


def evidence(spark: SparkSession, d: str, profile: L.Profile, students: DataFrame | None = None) -> DataFrame:
    """Pairs that the profile can flag, written once for all that reads them."""
    return S.durable(similarity.best_evidence(subs(spark, d), hands(spark, d), profile.text_high, profile.same_writer, students))


def words(spark: SparkSession, d: str) -> DataFrame:
    """The word sets, written once for scores and flags."""
    return similarity.packed_words(subs(spark, d))


def maxima(spark: SparkSession, d: str, packed: DataFrame | None = None) -> DataFrame:
    return similarity.peer_maxima(subs(spark, d), hands(spark, d), words=packed)


def scored(spark: SparkSession, d: str, packed: DataFrame | None = None) -> DataFrame:
    """One row of signals and scores for each submission, written once for all that reads it."""
    s = subs(spark, d)
    return S.durable(scoring.integrity_score(style.text_signals(s), similarity.copy_batch(s, maxima(spark, d, packed))))


# Text


@query
def clean_text(spark, d):
    return subs(spark, d).select("id", "text", F.length("text").alias("n_chars"))


@query
def clean_text_keep_paras(spark, d):
    return S.table(spark, d, "pages").select(F.col("page_id").alias("id"), X.clean_text_keep_paragraphs(F.col("html")).alias("text"))


@query
def text_stats(spark, d):
    return style.text_stats(subs(spark, d))


@query
def sentence_stats(spark, d):
    return style.sentence_stats(subs(spark, d))


@query
def mattr(spark, d):
    return style.mattr(subs(spark, d))


@query
def ai_markers(spark, d):
    return style.markers(subs(spark, d))


@query
def punctuation(spark, d):
    return style.punctuation(subs(spark, d))


@query
def paragraphs(spark, d):
    """Conversation turns as texts whose line ends are doubled, so that there are paragraphs."""
    rows = S.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), X.clean_text_keep_paragraphs(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))).alias("text"))
    return style.paragraphs(rows)


@query
def char_entropy(spark, d):
    return style.char_entropy(subs(spark, d))


@query
def burstiness(spark, d):
    return style.burstiness(subs(spark, d))


@query
def top_words(spark, d):
    return style.top_words(subs(spark, d)).select("id", "rank", "word", "count", "first")


@query
def ai_phrase_hits(spark, d):
    return style.phrase_hits(subs(spark, d))


# Detectors


@query
def stylometry(spark, d):
    return style.stylometry(subs(spark, d))


@query
def style_score(spark, d):
    return style.stylometry(subs(spark, d)).select("id", "style_score")


@query
def ai_probability(spark, d):
    return style.ai_probability(subs(spark, d))


@query
def ai_probability_alt(spark, d):
    return style.ai_probability_alt(subs(spark, d))


@query
def style_similarity(spark, d):
    """Style likeness of the pairs whose texts match."""
    s = subs(spark, d)
    f = style.stylometry(s)
    rows = similarity.copy_pairs(s, 0.40).join(f.alias("a"), F.col("id_a") == F.col("a.id")).join(f.alias("b"), F.col("id_b") == F.col("b.id"))
    return rows.select("id_a", "id_b", style.style_distance("a", "b").alias("style_similarity"))


# Similarity


@query
def copy_pairs(spark, d):
    return similarity.copy_pairs(subs(spark, d)).select("id_a", "id_b", "common", "text_sim")


@query
def copy_pairs_by_subject(spark, d):
    """A batch is one subject here, whatever the school."""
    return similarity.copy_pairs(subs(spark, d).withColumn("school", F.lit("all"))).select("id_a", "id_b", "common", "text_sim")


@query
def ngram_jaccard(spark, d):
    return similarity.ngram_pairs(subs(spark, d), 3, 0.10).select("id_a", "id_b", "common", "sim")


@query
def ngram_matrix(spark, d):
    """Both orientations of the mean two- and three-gram similarity."""
    return similarity.both_ways(similarity.ngram_mean(subs(spark, d)), "bi", "tri", "sim")


@query
def tf_cosine(spark, d):
    return similarity.tf_cosine(subs(spark, d))


@query
def gated_similarity(spark, d):
    return similarity.gated_similarity(subs(spark, d))


@query
def topk_matches(spark, d):
    """The five best matches of each submission by gated text (0.65) and vector (0.35) similarity over 0.25."""
    return similarity.best_matches(subs(spark, d), hands(spark, d)).select("id", "peer", "text_sim", "hw_sim", "combined", "rank")


@query
def exact_dup_md5(spark, d):
    """Exact copies by digest: one row for each digest that repeats."""
    rows = S.table(spark, d, "documents").groupBy(F.md5("text").alias("md5")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return rows.where("copies > 1")


@query
def fingerprint_cosine(spark, d):
    """Each vector against the mean vector of its label."""
    rows = S.table(spark, d, "embeddings")
    mean = pages.centroids(rows, "label", "embedding")
    return rows.join(F.broadcast(mean), "label").select("vec_id", X.half_up(V.cosine(F.col("embedding"), F.col("centroid")) + 1.0, 4).alias("cosine_plus_1"))


@query
def hw_pairs(spark, d):
    return similarity.vector_pairs(hands(spark, d), HAND)


@query
def hand_matrix(spark, d):
    """Every third number is the same student."""
    return similarity.hand_matrix(hands(spark, d).withColumn("student", F.floor(F.col("id") / 3)), HAND)


@query
def vector_centroid(spark, d):
    rows = pages.centroids(S.table(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("centroid").alias("pos", "x"))
    return rows.select("label", "pos", F.floor(F.col("x") * 1000000 + 0.5).alias("micro"))


@query
def page_feature_avg(spark, d):
    """Items of an order as pages of a submission."""
    rows = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_quantity")).cast("long").alias("quantity"), F.round(F.col("l_discount") * 100).cast("long").alias("discount"))
    return pages.page_means(rows, "id", "quantity", "discount")


@query
def log_norm(spark, d):
    """The two log-scaled fingerprint features over part sizes and prices."""
    return S.table(spark, d, "part").select("p_partkey", X.half_up(V.log_norm(F.col("p_size"), 15.0), 6).alias("loops"), X.half_up(V.log_norm(F.col("p_retailprice"), 6000.0), 6).alias("area"))


# Copies and flags


@query
def copy_batch(spark, d):
    return similarity.copy_batch(subs(spark, d), maxima(spark, d))


@query
def best_peer(spark, d):
    return similarity.best_peer(maxima(spark, d))


@query
def base_flags(spark, d):
    return flags.base_flags(scored(spark, d)).select("id", F.array_join("flags", "; ").alias("flags"))


@query
def copy_flags(spark, d):
    """Flags of all pairs; those that a submission gets from equal texts are one row, with their number."""
    packed = words(spark, d)
    return flags_of_pairs(spark, d, scored(spark, d, packed), packed).select("id", "peer", "rule", "text_sim", "hw_sim", "more", "flag")


def flags_of_pairs(spark, d, s, packed):
    """The flags of pairs, written once."""
    return S.durable(flags.copy_flags(subs(spark, d), hands(spark, d), s, words=packed))


def all_flags(spark, d):
    packed = words(spark, d)
    s = scored(spark, d, packed)
    return flags.final_flags(flags.base_flags(s), flags_of_pairs(spark, d, s, packed))


@query
def final_flags(spark, d):
    return all_flags(spark, d).select("id", F.array_join("flags", "; ").alias("flags"))


@query
def flag_summary(spark, d):
    return flags.flag_summary(all_flags(spark, d))


def peers(spark, d):
    """Submissions with a student each (every third number is the same student) and a surrogate consistency."""
    return S.durable(style.ai_probability(subs(spark, d)).select("id", F.floor(F.col("id") / 3).alias("student"), "ai_probability", ((F.col("id") % 10) / 10.0).alias("hw_consistency")))


@query
def peer_flags(spark, d):
    rows = peers(spark, d)
    return flags.peer_flags(rows, evidence(spark, d, L.PEER, rows), L.PEER)


@query
def peer_flags_alt(spark, d):
    return flags.peer_flags(peers(spark, d), evidence(spark, d, L.PEER_ALT), L.PEER_ALT, directed=True)


# Scores


@query
def integrity_score(spark, d):
    return scored(spark, d)


@query
def originality_alt(spark, d):
    return scored(spark, d).select("id", X.half_up(scoring.originality_alt(F.col("ai_probability"), F.col("copy_similarity")), 3).alias("originality"), scoring.score_label(F.col("score")).alias("label"))


@query
def feedback(spark, d):
    return scoring.feedback(scored(spark, d)).select("id", "feedback")


@query
def ui_bands(spark, d):
    return scoring.ui_bands(scored(spark, d))


# Relational surface


@query
def lookup_by_key(spark, d):
    return report.lookup(S.assignments(spark, d), 7).select("id", "student_name", "subject", "status")


@query
def teacher_assignments(spark, d):
    return report.teacher_assignments(S.assignments(spark, d, "scored"), TEACHER, subject="BUILDING", status="scored").select("id", "student_name", "grade", "score", "submitted_at")


@query
def tenant_filter(spark, d):
    return report.filtered(S.assignments(spark, d), TEACHER).groupBy("school", "status").agg(F.count("*").alias("n"))


def ids(spark, d):
    """A batch: all submissions that wait for review."""
    return S.table(spark, d, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("id"))


@query
def batch_semi(spark, d):
    return report.batch(S.assignments(spark, d), ids(spark, d).unionAll(ids(spark, d))).select("id", "subject", "status")


@query
def history_peers(spark, d):
    return report.history_peers(S.assignments(spark, d), ids(spark, d)).select("id", "subject", "school", "submitted_at")


def texts(spark, d):
    """Assignments with the cleaned text of the document of the same number; the others have none."""
    return S.assignments(spark, d).join(subs(spark, d).select("id", "text"), "id", "left")


@query
def history_texts(spark, d):
    return report.history_peers(texts(spark, d), ids(spark, d), text="text").select("id", "subject", "school", F.length("text").alias("n_chars"))


@query
def peers_of_batch(spark, d):
    return report.peers_of_batch(texts(spark, d), ids(spark, d), "text").select("subject", "school", "id", "origin", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))


@query
def owned_assignment(spark, d):
    """A student sees a submission of their own, not another's."""
    rows = S.assignments(spark, d)
    asked = rows.where("id = 7").select("id", F.explode(F.array("student_id", F.col("student_id") + 1)).alias("student"))
    return report.owned_by(rows, asked).select("id", "student_id", "status")


@query
def student_assignments(spark, d):
    return report.of_student(S.assignments(spark, d), 7).select("id", "subject", "status", F.date_format("submitted_at", "yyyy-MM-dd").alias("day"))


@query
def first_submission(spark, d):
    return report.first_per(S.assignments(spark, d), "student_name", "submitted_at", "id").select("student_name", "id", "subject")


def users(spark, d):
    """Customers as users; those without a positive balance have left something out."""
    c = S.table(spark, d, "customer").join(S.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key, poor = F.col("c_custkey"), F.col("c_acctbal") <= 0
    email = F.when(poor & (F.col("c_mktsegment") == "BUILDING"), F.concat(F.lit(" user"), key)).otherwise(F.concat(F.lit(" User"), key, F.lit("@School.ORG ")))
    role = F.when(poor & (F.col("c_mktsegment") == "MACHINERY"), "visitor").when(F.col("c_mktsegment") == "HOUSEHOLD", "teacher").otherwise("student")
    return c.select(key.alias("id"), F.when(poor & (F.col("c_mktsegment") == "FURNITURE"), " ").otherwise(F.col("c_name")).alias("name"), email.alias("email"), F.when(poor, "short").otherwise("long enough").alias("password"), role.alias("role"), F.col("n_name").alias("school"), F.col("c_mktsegment").alias("grade"), F.lit(None).cast("string").alias("subject"), F.concat(F.lit("R"), key).alias("roll_number"))


@query
def public_users(spark, d):
    return report.public_users(users(spark, d))


@query
def invalid_users(spark, d):
    return report.invalid_users(users(spark, d))


@query
def assignment_states(spark, d):
    """All orders are handed in, then reviewed and scored as far as their state says; scores under 3 are handed in again."""
    rows = texts(spark, d).withColumns({"grade_label": scoring.grade_label(F.col("score")), "feedback": F.concat(F.lit("Score "), F.col("score")), "flags": F.array(F.lit("checked")), "analysis": F.struct(F.col("subject"))})
    after = lambda n: F.col("submitted_at") + F.expr(f"INTERVAL {n} DAYS")
    done = rows.where("status = 'scored'")
    events = S.submitted(rows, F.col("submitted_at")).unionAll(S.reviewing(rows.where("status <> 'submitted'"), after(1))).unionAll(S.scored(done, after(2))).unionAll(S.submitted(done.where("score < 3"), after(3)))
    now = S.current(events)
    return now.select("id", "status", "score", "grade_label", "flags", "analysis", F.length("ocr_text").alias("n_chars"), "feedback", "scanned_at", "submitted_at")


@query
def assignment_view(spark, d):
    """Stored JSON of scored assignments; the others hold none or what is no JSON."""
    done = F.col("status") == "scored"
    u = report.public_users(users(spark, d)).select(F.col("id").alias("student_id"), F.col("email").alias("student_email"))
    rows = S.assignments(spark, d).join(u, "student_id").withColumnsRenamed({"grade": "student_grade", "school": "student_school"})
    rows = rows.withColumns({
        "title": F.concat("subject", F.lit(" "), "id"), "notes": F.lit(None).cast("string"), "grade_label": scoring.grade_label(F.col("score")), "feedback": F.concat(F.lit("Score "), F.col("score")), "scanned_at": F.when(done, F.col("submitted_at") + F.expr("INTERVAL 2 DAYS")),
        "flags": F.when(done, F.lit('["checked"]')).when(F.col("status") == "reviewing", "not json"), "analysis": F.when(done, F.to_json(F.struct("subject"))).when(F.col("status") == "reviewing", "{"),
    })
    shown = report.assignment_view(rows)
    return shown.withColumns({"flags": F.array_join("flags", "; "), "analysis": F.array_join(F.transform(F.map_entries("analysis"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")})


@query
def full_report(spark, d):
    """Submissions with the student and the date of the order of the same number."""
    packed = words(spark, d)
    s = scored(spark, d, packed)
    flagged = flags.final_flags(flags.base_flags(s), flags_of_pairs(spark, d, s, packed))
    a = S.assignments(spark, d).select("id", "student_id", "submitted_at")
    u = report.public_users(users(spark, d)).select(F.col("id").alias("student_id"), F.col("name").alias("student_name"), "roll_number", "email", F.col("grade").alias("grade"))
    told = scoring.feedback(s).withColumnRenamed("grade", "grade_label").drop("ingest_status").join(flagged, "id").join(subs(spark, d).select("id", "subject"), "id").join(a, "id", "left").join(u, "student_id", "left")
    return report.full_report(told.withColumn("scanned_at", F.col("submitted_at") + F.expr("INTERVAL 2 DAYS")))


@query
def dashboard_stats(spark, d):
    """Stored flags: scores under 5 have one, other scored rows none, and every seventh row holds no JSON."""
    kept = F.when(F.col("id") % 7 == 0, "not json").when(F.col("score") < 5, F.to_json(F.array(F.lit("low")))).when(F.col("score").isNotNull(), "[]")
    return report.dashboard_stats(report.filtered(S.assignments(spark, d), TEACHER).withColumn("flags", kept))


@query
def score_histogram(spark, d):
    return report.score_histogram(S.assignments(spark, d))


@query
def ranked_report(spark, d):
    return report.ranked_report(S.assignments(spark, d, "scored"), subject="BUILDING")


@query
def student_stats(spark, d):
    return report.student_stats(S.assignments(spark, d))


@query
def quality_checks(spark, d):
    return report.quality_checks(S.assignments(spark, d))


@query
def json_flags(spark, d):
    """Flags stored as JSON text and read back; bad JSON is an empty list."""
    rows = S.table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("p"), F.from_json(F.when(F.col("event_id") % 5 == 0, "not json").otherwise(F.to_json(F.array("event_type"))), "array<string>").alias("f"))
    return rows.select("event_id", F.coalesce(F.size("p"), F.lit(0)).alias("keys"), F.array_join(F.coalesce("f", F.array().cast("array<string>")), ",").alias("flags"))


@query
def page_merge(spark, d):
    """Turns of a conversation as pages of a submission."""
    rows = S.table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("page"), "text", ((F.col("turn") % 4) / 4.0).alias("confidence"))
    return pages.merge_pages(rows)


@query
def latest_state(spark, d):
    """Current state of each user from appended events."""
    return S.latest(S.table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


# Page profiles: ink rows and stroke boxes made from events and items


@query
def line_runs(spark, d):
    rows = S.table(spark, d, "events").select((F.col("user_id") % 50).alias("page"), F.floor(F.col("event_id") / 64).alias("y"), F.col("event_type"))
    profile = rows.groupBy("page", "y").agg(F.count_if(F.col("event_type") == "click").alias("ink"))
    return pages.line_runs(profile, F.lit(25.0), least_height=1)


@query
def stroke_gaps(spark, d):
    boxes = S.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("x"), F.col("l_quantity").cast("long").alias("w"))
    return pages.stroke_gaps(boxes)


# Page images: texts of the benchmark as rows of 48 pixels; strokes from items of a supplier


def pixels(spark, d):
    line = F.rpad(F.substring("t", F.col("y") * 48 + 1, F.lit(48)), 48, "ÿ")
    rows = S.table(spark, d, "benchmark").select(F.col("item_id").alias("page"), F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.select("page", "t", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("t") / 48).cast("int") - 1, F.lit(0)))).alias("y"))
    code = F.transform(F.sequence(F.lit(1), F.lit(48)), lambda i: F.ascii(F.substring(F.col("line"), i, F.lit(1))).bitwiseAND(255))
    return rows.select("page", "y", line.alias("line")).select("page", "y", code.alias("grey"))


def as_text(df, column):
    return df.select("page", F.col("y").cast("int").alias("y"), F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column))


@query
def page_grey(spark, d):
    rows = pixels(spark, d)
    times = lambda k: F.transform("grey", lambda x: x * k % 256)
    return as_text(rows.select("page", "y", images.grey_of(F.col("grey"), times(3), times(7)).alias("grey")), "grey")


@query
def page_noise(spark, d):
    return as_text(images.without_noise(pixels(spark, d)), "grey")


@query
def page_binary(spark, d):
    return as_text(images.binarized(pixels(spark, d)), "binary")


@query
def page_metrics(spark, d):
    return scans.page_metrics(images.binarized(pixels(spark, d)))


def scanned(spark, d):
    """Eight texts of the benchmark under each other on a page."""
    rows = pixels(spark, d).withColumnRenamed("page", "item")
    tall = rows.groupBy("item").agg(F.count("*").alias("n")).withColumn("page", F.floor(F.col("item") / 8))
    above = Window.partitionBy("page").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    tall = tall.select("item", "page", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    return rows.join(tall, "item").select("page", (F.col("y") + F.col("above")).alias("y"), "grey")


@query
def page_contours(spark, d):
    found = contours.contours(contours.ink(images.binarized(scanned(spark, d))))
    return found.select("page", "x", "y", "w", "h", "area", X.half_up(F.col("perimeter"), 3).alias("perimeter"), "hole", "inner")


@query
def page_edges(spark, d):
    return as_text(scans.edges(scanned(spark, d)), "edge")


@query
def page_lines(spark, d):
    return scans.lines(scans.edge_runs(scanned(spark, d)), 8, 20)


def tilts(rows):
    """Pages are turned by 4 to 12 degrees to either side, every seventh stays."""
    return rows.select("page").distinct().select("page", ((F.col("page") % 7 - 3) * 4.0).alias("angle")).where("angle <> 0")


@query
def page_turned(spark, d):
    rows = scanned(spark, d)
    return as_text(scans.turned(rows, tilts(rows)), "grey")


@query
def page_denoised(spark, d):
    """Without SQL, where the direct sums take too long: tested against them on small pages."""
    return as_text(scans.denoised(scanned(spark, d)), "grey")


@query
def page_contrast(spark, d):
    """The tables of local contrast; levels as they come out of each tile."""
    rows = scans.contrast_tables(scans.tile_levels(scanned(spark, d)))
    levels = F.transform(F.array_sort(F.collect_list(F.struct("level", "out"))), lambda s: s["out"].cast("string"))
    return rows.groupBy("page", "tile").agg(F.array_join(levels, ",").alias("levels"))


@query
def scan_hands(spark, d):
    """From scanned rows to the values of each page's hand. Without SQL: tested against plain loops."""
    rows = scans.hand_pages(scans.preprocessed(scanned(spark, d)))
    plain = ("page", "stroke_count", "line_count", "area_mean", "mean_height", "height_cv", "loop_density", "baseline_deviation", "slant", "pressure")
    return rows.select(*plain, F.array_join(F.transform("fingerprint", lambda x: F.floor(x * 10000 + 0.5).cast("string")), ",").alias("fingerprint"))


#: Queries that only pytest checks, against plain loops.
WITHOUT_SQL = {"page_denoised", "scan_hands"}


def strokes(spark, d):
    n = F.col("l_linenumber").cast("long")
    return S.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("x"), (n * 20).alias("y"), F.col("l_quantity").cast("long").alias("w"), (n + 3).alias("h"), F.floor(F.col("l_extendedprice") / 100).alias("area"), (F.col("l_quantity").cast("long") * 2 + n * 3).alias("perimeter"), (F.col("l_returnflag") == "A").alias("hole"), F.col("l_tax").alias("tone"), F.col("l_linenumber").alias("rank"))


def sheets(spark, d):
    """Every supplier is a page, so some may have no stroke."""
    return S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), F.lit(4000).alias("height"), F.lit(3000).alias("width"), F.lit(90000).alias("ink"))


@query
def stroke_features(spark, d):
    return images.stroke_features(strokes(spark, d), sheets(spark, d))


@query
def stroke_shape(spark, d):
    return images.stroke_shape(strokes(spark, d))


def line_angles(spark, d):
    return strokes(spark, d).select("page", "rank", ((F.col("w") - 25) * 2).alias("angle"))


@query
def slant_angles(spark, d):
    rows = images.median_angle(line_angles(spark, d), 5)
    return rows.select("page", images.slant(F.col("angle")).alias("slant"), images.skew(F.col("angle")).alias("skew"))


def profile(spark, d):
    rows = S.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("page"), F.floor(F.col("l_extendedprice") / 512).alias("y"))
    return rows.agg(F.sum("l_quantity").cast("long").alias("ink")).withColumn("width", F.lit(3000))


@query
def line_features(spark, d):
    return images.line_features(profile(spark, d))


def hand_pages(spark, d):
    s = strokes(spark, d)
    tone = s.groupBy("page").agg(X.half_up(X.clip(1.0 - F.avg(F.round(F.col("tone") * 1000).cast("long")) / 255.0, 0.0, 1.0), 3).alias("pressure"))
    slants = images.median_angle(line_angles(spark, d), 5).select("page", images.slant(F.col("angle")).alias("slant"))
    rows = images.stroke_features(s, sheets(spark, d)).join(images.line_features(profile(spark, d)), "page").join(images.stroke_shape(s), "page").join(tone, "page").join(slants, "page")
    return images.fingerprint(rows)


@query
def hand_fingerprint(spark, d):
    rows = hand_pages(spark, d).select("page", F.posexplode("fingerprint").alias("pos", "x"))
    return rows.select("page", "pos", X.half_up(F.col("x"), 4).alias("x"))


@query
def hand_analysis(spark, d):
    """Ten pages in a row are a submission; there is one without pages for each nation."""
    rows = images.hand_of_pages(hand_pages(spark, d).withColumn("id", F.floor(F.col("page") / 10)), "id")
    rows = images.hand_of_all(rows.select("id").unionAll(S.table(spark, d, "nation").select(-1 - F.col("n_nationkey"))), rows, "id")
    return rows.select("id", "consistency", "pressure", "stroke_density", F.col("stroke_count").cast("int").alias("stroke_count"), F.col("line_count").cast("int").alias("line_count"), "height_cv", "gap_cv", "compactness", "slant", "loop_density", F.array_join(F.transform("fingerprint", lambda x: F.floor(x * 10000 + 0.5).cast("string")), ",").alias("fingerprint"))


@query
def identity_fingerprint(spark, d):
    rows = images.identity_features(strokes(spark, d), sheets(spark, d))
    return images.identity_fingerprint(rows.withColumn("id", F.floor(F.col("page") / 10)), "id")


# Streaming, as batches


@query
def event_windows(spark, d):
    return streaming.window_counts(S.table(spark, d, "events"))


@query
def event_sessions(spark, d):
    return streaming.sessions(S.table(spark, d, "events"))


@query
def event_types(spark, d):
    return streaming.type_stats(S.table(spark, d, "events"))
