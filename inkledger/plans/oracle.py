"""SQL (DuckDB dialect) for the queries of ``catalog``, written from the formulas and not from the DataFrame plans."""

from __future__ import annotations

from ..functions import lexicons as L
from ..operators import scans
from ..operators.contours import SIDES
from ..operators.images import IDENTITY, MANNER, REACH, WEIGHTS
from ..operators.scoring import FEEDBACK_SCORE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(values: list[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def r(x: str, k: int) -> str:
    return f"(floor(({x})::DOUBLE * 1e{k} + 0.5) / 1e{k})"


WORDS = "list_filter(string_split_regex({0}, '[ \\n]+'), lambda w: w <> '')"
SUBS = r"""subs AS (
  SELECT doc_id AS id, lang AS subject, source AS school, text, lower(text) AS low FROM (
    SELECT doc_id, lang, source, coalesce(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '[^\x20-\x7E\n]', ' ', 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10)), '') AS text FROM documents))"""


def sents(text: str, over: int) -> str:
    return rf"list_filter(string_split(regexp_replace({text}, '([.!?])[ \n]+', concat('\1', chr(1)), 'g'), chr(1)), lambda s: length(trim(s)) > {over})"


def lengths(text: str, over: int) -> str:
    return f"list_transform({sents(text, over)}, lambda s: len({WORDS.format('s')}))"


MOMENTS = "len(ls)::DOUBLE AS n, list_sum(ls)::DOUBLE AS s, list_sum(list_transform(ls, lambda x: x * x))::DOUBLE AS sq"
RICH = f"""rich AS (
  SELECT id, word_count, letters, len(content) AS content_words, CASE WHEN len(content) = 0 THEN 0.0 ELSE floor((CASE WHEN len(content) < 50 THEN len(list_distinct(content))::DOUBLE / len(content)
    ELSE list_sum(list_transform(range(1, greatest(len(content) - 48, 2)), lambda i: len(list_distinct(content[i:i+49]))))::DOUBLE / (50.0::DOUBLE * (len(content) - 49)) END) * 1e3 + 0.5) / 1e3 END AS lexical_richness
  FROM (SELECT id, len(w)::INTEGER AS word_count, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS letters, list_filter(w, lambda x: length(x) > 2 AND NOT list_contains({arr(L.STYLE_STOPWORDS)}, x)) AS content
    FROM (SELECT id, regexp_extract_all(low, '\\b[a-z'']+\\b') AS w FROM subs)))""".replace("\\\\b", "\\b")
SENT = f"""sent AS (
  SELECT id, n::INTEGER AS sentences, coalesce({r('m', 2)}, 0.0) AS mean, coalesce({r('v', 2)}, 0.0) AS variance, coalesce({r('sqrt(v)', 2)}, 0.0) AS std, CASE WHEN m > 0 THEN {r('sqrt(v) / m', 3)} ELSE 0.0 END AS cv
  FROM (SELECT id, n, CASE WHEN n > 0 THEN s / n END AS m, CASE WHEN n > 0 THEN (n * sq - s * s) / (n * n) END AS v FROM (SELECT id, {MOMENTS} FROM (SELECT id, {lengths('text', 5)} AS ls FROM subs))))"""
MARK = f"""mark AS (
  SELECT id, len(a)::INTEGER AS ai_marker_count, {r('len(a) / 42.0::DOUBLE', 3)} AS ai_marker_ratio, len(h)::INTEGER AS human_marker_count, {r('len(h) / 22.0::DOUBLE', 3)} AS human_marker_ratio, array_to_string(a[1:10], '; ') AS ai_markers_found
  FROM (SELECT id, list_filter({arr(L.AI_MARKERS)}, lambda m: contains(low, m)) AS a, list_filter({arr(L.HUMAN_MARKERS)}, lambda m: contains(low, m)) AS h FROM subs))"""
PUNCT = f"""punct AS (
  SELECT id, CASE WHEN length(text) > 0 THEN {r("list_sum(list_transform(" + arr(L.PUNCTUATION) + ", lambda c: length(text) - length(replace(text, c, ''))))::DOUBLE / length(text)", 4)} ELSE 0.0 END AS density,
    array_to_string(list_transform(list_sort(list_filter(list_transform({arr(L.PUNCTUATION)}, lambda c: {{'n': length(replace(text, c, '')) - length(text), 'p': instr(text, c), 'c': c}}), lambda s: s.n < 0))[1:8], lambda s: s.c || ':' || (-s.n)), ' ') AS counts
  FROM subs)"""
STYLE = f"""style AS (
  SELECT rich.id, CASE WHEN length(subs.text) < 20 THEN 0.5 ELSE {r('least(greatest(least(lexical_richness / 0.5::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE + least(cv / 0.5::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE + least(greatest(1.0::DOUBLE - ai_marker_ratio * 2 + human_marker_ratio * 0.5::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) * 0.3::DOUBLE + (CASE WHEN density BETWEEN 0.01::DOUBLE AND 0.06::DOUBLE THEN 1.0::DOUBLE ELSE greatest(0.3::DOUBLE, 1 - abs(density - 0.035::DOUBLE) * 20) END) * 0.1::DOUBLE, 0.05::DOUBLE), 1.0::DOUBLE)', 3)} END AS style_score,
    lexical_richness, cv, ai_marker_ratio, human_marker_ratio, density, CASE WHEN word_count > 0 THEN letters::DOUBLE / word_count ELSE 0.0 END AS avg_word_length, word_count, sentences
  FROM rich JOIN sent USING (id) JOIN mark USING (id) JOIN punct USING (id) JOIN subs USING (id))"""
STYLES = ", ".join([SUBS, RICH, SENT, MARK, PUNCT, STYLE])
HITS = f"""hits AS (SELECT id, ({' + '.join(f'regexp_matches(low, {q(p)})::INTEGER' for p in L.AI_PATTERNS)})::INTEGER AS ai_hits, ({' + '.join(f'regexp_matches(low, {q(p)})::INTEGER' for p in L.STUDENT_PATTERNS)})::INTEGER AS human_hits FROM subs)"""
ENTROPY = f"""ent AS (
  SELECT subs.id, CASE WHEN total IS NULL THEN 0.5::DOUBLE ELSE {r('least((log2(total) - s / total) / 5.0::DOUBLE, 1.0::DOUBLE)', 3)} END AS entropy FROM subs LEFT JOIN (
    SELECT id, sum(n)::DOUBLE AS total, sum(n * log2(n::DOUBLE)) AS s FROM (SELECT id, c, count(*) AS n FROM (SELECT id, unnest(string_split(low, '')) AS c FROM subs WHERE length(text) >= 50) WHERE c <> '' GROUP BY ALL) GROUP BY id) USING (id))"""
TOP = r"""chunks AS (
  SELECT id, n, word, sum(c)::BIGINT AS count, sum(c * c)::BIGINT AS squares, min(first)::INTEGER AS first FROM (
    SELECT id, n, word, floor(pos / 20) AS chunk, count(*) AS c, min(pos) AS first FROM (SELECT id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT id, regexp_extract_all(low, '\b[a-z]+\b') AS w FROM subs)) GROUP BY ALL) GROUP BY ALL
), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY count DESC, first)::INTEGER AS rank FROM chunks) WHERE rank <= 10)"""
BURST = f"""burst AS (
  SELECT subs.id, CASE WHEN v IS NULL THEN 0.5::DOUBLE ELSE {r('least(v / 2.0::DOUBLE, 1.0::DOUBLE)', 3)} END AS burstiness FROM subs LEFT JOIN (
    SELECT id, sum(ceil(n / 20.0::DOUBLE) * squares - count * count) / max(ceil(n / 20.0::DOUBLE) * ceil(n / 20.0::DOUBLE)) / count(*) AS v FROM top
    WHERE n >= 20 AND ceil(n / 20.0::DOUBLE) >= 2 AND NOT list_contains({arr(L.BURST_STOPWORDS)}, word) GROUP BY id) USING (id))"""
AI = f"""aip AS (
  SELECT id, CASE WHEN length < 30 THEN 0.1 ELSE {r('least(greatest(phrase * 0.55::DOUBLE + uniform * 0.10::DOUBLE + perplexity * 0.10::DOUBLE + burst * 0.10::DOUBLE + style * 0.15::DOUBLE, 0.02::DOUBLE), 0.98::DOUBLE)', 3)} END AS ai_probability,
    CASE WHEN length < 30 THEN 'low' WHEN n >= 5 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS confidence, {', '.join(r(c, 3) + f' AS {c}_signal' for c in ('phrase', 'uniform', 'perplexity', 'burst', 'style'))}
  FROM (SELECT id, length, n, greatest(0.0::DOUBLE, least(ai_hits / (66 * 0.3::DOUBLE), 1.0::DOUBLE) - least(human_hits / (20 * 0.3::DOUBLE), 1.0::DOUBLE) * 0.5::DOUBLE) AS phrase,
      CASE WHEN n >= 3 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - CASE WHEN s > 0 THEN sqrt((n * sq - s * s) / (n * n)) / (s / n) ELSE 1.0::DOUBLE END) ELSE 0.2::DOUBLE END AS uniform,
      greatest(0.0::DOUBLE, 1.0::DOUBLE - entropy) AS perplexity, greatest(0.0::DOUBLE, 1.0::DOUBLE - burstiness * 1.2::DOUBLE) AS burst, CASE WHEN length < 20 THEN 0.0::DOUBLE ELSE ai_marker_ratio END AS style
    FROM (SELECT id, length, {MOMENTS} FROM (SELECT id, length(text) AS length, {lengths('text', 3)} AS ls FROM subs)) JOIN hits USING (id) JOIN ent USING (id) JOIN burst USING (id) JOIN mark USING (id)))"""
AIS = ", ".join([STYLES, HITS, ENTROPY, TOP, BURST, AI])


def pairs(name: str, items: str, least: float, digits: int = 4, school: bool = True, words: str = "NULL", classes: bool = False) -> str:
    """``classes``: copies are listed with the first of them, and texts through their first copies."""
    block = "subject, school" if school else "subject"
    through = f" JOIN (SELECT id AS id_a, min(id) OVER (PARTITION BY {block}, low) AS rep_a FROM subs) USING (id_a) JOIN (SELECT id AS id_b, min(id) OVER (PARTITION BY {block}, low) AS rep_b FROM subs) USING (id_b)" if classes else ""
    listed = " AND (rep_b = id_a OR rep_a = id_a AND rep_b = id_b)" if classes else ""
    return f"""{name}_i AS (SELECT DISTINCT id, {block}, unnest({items}) AS item FROM (SELECT *, {words} AS w FROM subs)), {name}_n AS (SELECT id, count(*) AS n FROM {name}_i GROUP BY id),
{name} AS (SELECT id_a, id_b, common, sim FROM (SELECT id_a, id_b, common::INTEGER AS common, {r('common::DOUBLE / (a.n + b.n - common)', digits)} AS sim FROM (
  SELECT x.id AS id_a, y.id AS id_b, count(*) AS common FROM {name}_i x JOIN {name}_i y ON x.item = y.item AND x.subject IS NOT DISTINCT FROM y.subject {'AND x.school IS NOT DISTINCT FROM y.school' if school else ''} AND x.id < y.id GROUP BY ALL)
  JOIN {name}_n a ON id_a = a.id JOIN {name}_n b ON id_b = b.id){through} WHERE sim >= {least}::DOUBLE{listed})"""


def grams(n: int) -> str:
    """Runs of n words of the column w."""
    return f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i+{n - 1}], ' '))"


BWORDS = WORDS.format("low")
CWORDS = rf"list_filter(regexp_extract_all(low, '\b[a-z]{{2,}}\b'), lambda w: NOT list_contains({arr(L.COPY_STOPWORDS)}, w))"
LWORDS = "regexp_extract_all(low, '[a-z]+')"
HANDS = f"""hands AS (SELECT doc_id AS id, lang AS subject, source AS school, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM documents JOIN embeddings ON doc_id = vec_id),
hw AS (SELECT a.id AS id_a, b.id AS id_b, {r('list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x))))', 4)} AS hw_sim
  FROM hands a JOIN hands b ON a.subject IS NOT DISTINCT FROM b.subject AND a.school IS NOT DISTINCT FROM b.school AND a.id < b.id)"""
TS = pairs("ts", BWORDS, 0.0)
#: All pairs of a block, each with both similarities; a side without common words or without two vectors is 0.
EVID = """ev AS (SELECT a.id AS id_a, b.id AS id_b, coalesce(ts.sim, 0.0) AS text_sim, coalesce(hw_sim, 0.0) AS hw_sim
  FROM subs a JOIN subs b ON a.subject IS NOT DISTINCT FROM b.subject AND a.school IS NOT DISTINCT FROM b.school AND a.id < b.id LEFT JOIN ts ON ts.id_a = a.id AND ts.id_b = b.id LEFT JOIN hw ON hw.id_a = a.id AND hw.id_b = b.id),
evd AS (SELECT id_a AS id, id_b AS peer, text_sim, hw_sim FROM ev UNION ALL SELECT id_b, id_a, text_sim, hw_sim FROM ev)"""
BATCH = f"""batch AS (SELECT subs.id, coalesce({r('t', 3)}, 0.0) AS max_text_similarity, coalesce({r('h', 3)}, 0.0) AS max_hw_similarity, coalesce({r('c', 3)}, 0.0) AS combined_copy_score, coalesce(n, 0)::BIGINT AS matches, coalesce(c, 0.0) > 0.40::DOUBLE AS copy_flag
  FROM subs LEFT JOIN (SELECT id, max(text_sim) AS t, max(hw_sim) AS h, max(text_sim * 0.6::DOUBLE + hw_sim * (1 - 0.6::DOUBLE)) AS c, count(*) AS n FROM evd GROUP BY id) USING (id))"""
EVS = ", ".join([SUBS, TS, HANDS, EVID])
SCORED = f"""scored AS (SELECT id, ai_probability, style_score, copy_similarity, hw_consistency, ocr_confidence, originality, score,
    CASE WHEN score >= 9 THEN 'A+' WHEN score >= 8 THEN 'A' WHEN score >= 7 THEN 'B+' WHEN score >= 6 THEN 'B' WHEN score >= 5 THEN 'C' WHEN score >= 4 THEN 'D' ELSE 'F' END AS grade, CASE WHEN word_count > 0 THEN 'ok' ELSE 'empty' END AS ingest_status
  FROM (SELECT *, least(greatest({r('(originality * 0.35::DOUBLE + (1 - ai_probability) * 0.25::DOUBLE + (1 - copy_similarity) * 0.20::DOUBLE + hw_consistency * 0.10::DOUBLE + style_score * 0.10::DOUBLE + greatest(0.0::DOUBLE, (ocr_confidence - 0.5::DOUBLE) * 0.04::DOUBLE)) * 10', 1)}, 0.0::DOUBLE), 10.0::DOUBLE) AS score
    FROM (SELECT *, {r('least(greatest(1.0::DOUBLE - (copy_similarity * 0.65::DOUBLE + ai_probability * 0.35::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE)', 3)} AS originality
      FROM (SELECT id, ai_probability::DOUBLE AS ai_probability, style_score::DOUBLE AS style_score, word_count, combined_copy_score AS copy_similarity, 0.6::DOUBLE AS hw_consistency, 0.0::DOUBLE AS ocr_confidence FROM aip JOIN style USING (id) JOIN batch USING (id)))))"""
ALL = ", ".join([AIS, TS, HANDS, EVID, BATCH, SCORED])
PCT = "floor({0} * 100 + 0.5)::BIGINT"
#: The rules over all pairs of a block. Of one submission the flags from the members of one class of equal texts are one row.
RULES = f"""reps AS (SELECT id, min(id) OVER (PARTITION BY subject, school, low) AS rep FROM subs),
rules AS (SELECT *, CASE WHEN text_sim >= 0.55::DOUBLE THEN 'A' WHEN hw_sim >= 0.75::DOUBLE AND text_sim < 0.40::DOUBLE THEN 'B' WHEN text_sim >= 0.40::DOUBLE THEN 'C' END AS rule FROM ev),
pf0 AS (SELECT e.*, a.score AS sa, b.score AS sb, a.ai_probability AS aa, b.ai_probability AS ab FROM rules e JOIN scored a ON id_a = a.id JOIN scored b ON id_b = b.id WHERE rule IS NOT NULL),
pf1 AS (SELECT rule, text_sim, hw_sim, id_a AS id, id_b AS peer, sb AS score FROM pf0 WHERE rule = 'C' OR (rule = 'A' AND sa <= sb) OR (rule = 'B' AND aa >= ab) UNION ALL SELECT rule, text_sim, hw_sim, id_b, id_a, sa FROM pf0 WHERE rule = 'C' OR (rule = 'A' AND sa > sb) OR (rule = 'B' AND aa < ab)),
pf2 AS (SELECT pf1.*, row_number() OVER w AS n, count(*) OVER (PARTITION BY pf1.id, rule, CASE WHEN rule = 'B' THEN peer ELSE rep END) - 1 AS more FROM pf1 JOIN reps ON reps.id = peer
  WINDOW w AS (PARTITION BY pf1.id, rule, CASE WHEN rule = 'B' THEN peer ELSE rep END ORDER BY CASE WHEN rule = 'A' THEN -score END, CASE WHEN rule = 'A' THEN -peer ELSE peer END)),
pf3 AS (SELECT *, least(id, peer) AS id_a, greatest(id, peer) AS id_b FROM pf2 WHERE n = 1),
pf AS (SELECT *, CASE rule WHEN 'A' THEN 'Copied from ' || peer || ' (' || {PCT.format('text_sim')} || '% text similarity)' WHEN 'B' THEN 'Handwriting matches ' || peer || '''s submission — possible ghostwriter (' || {PCT.format('hw_sim')} || '% HW similarity)' ELSE 'Significant similarity with ' || peer || ' (' || {PCT.format('text_sim')} || '%)' END || CASE WHEN more > 0 THEN ' and ' || more || ' more' ELSE '' END AS flag FROM pf3)"""
BASE = """base AS (SELECT id, list_filter([CASE WHEN ai_probability >= 0.40::DOUBLE THEN 'AI-generated content detected' WHEN ai_probability >= 0.28::DOUBLE THEN 'Possible AI assistance detected' END,
  CASE WHEN style_score < 0.25::DOUBLE THEN 'Highly inconsistent writing style detected' END, CASE WHEN ocr_confidence > 0 AND ocr_confidence < 0.30::DOUBLE THEN 'Low legibility – assignment hard to read' END], lambda f: f IS NOT NULL) AS flags FROM scored)"""
FINAL = "fin AS (SELECT id, list_concat(flags, coalesce(more, [])) AS flags FROM base LEFT JOIN (SELECT id, list(flag ORDER BY id_a, id_b, flag) AS more FROM pf GROUP BY id) USING (id))"
FLAGS = ", ".join([ALL, RULES, BASE, FINAL])
BEST = "best AS (SELECT id, peer, text_sim, hw_sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY text_sim DESC, peer) AS n FROM {0} WHERE text_sim > 0) WHERE n = 1)"


def peer(ai: float, text: float, hand: float, guard: bool, directed: bool) -> str:
    ev = "SELECT * FROM evd WHERE id // 3 <> peer // 3" if guard else "SELECT * FROM evd"
    directed_sql = "AND (hw_sim > {0}::DOUBLE OR id % 10 <= peer % 10)".format(hand) if directed else ""
    return f"""WITH {AIS}, {TS}, {HANDS}, {EVID}, pe AS ({ev}), {BEST.format('pe')}
SELECT id, 'ai' AS type, NULL::BIGINT AS peer, {PCT.format('ai_probability')}::VARCHAR AS percent FROM aip WHERE ai_probability > {ai}::DOUBLE
UNION ALL SELECT id, CASE WHEN hw_sim > {hand}::DOUBLE THEN 'ghostwriter' ELSE 'copied' END, peer, {PCT.format('text_sim')}::VARCHAR FROM best WHERE text_sim > {text}::DOUBLE {directed_sql}
UNION ALL SELECT id, 'handwriting', peer, {PCT.format('hw_sim')}::VARCHAR FROM pe WHERE hw_sim > {hand}::DOUBLE AND text_sim <= {text}::DOUBLE"""


def case(cuts: list[tuple[float, str]], column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} >= {v} THEN {q(s)}" for v, s in cuts[:-1]) + f" ELSE {q(cuts[-1][1])} END"


FEED = f"""concat_ws(' ', {case(FEEDBACK_SCORE, 'score')},
  CASE WHEN ai_probability >= 0.40::DOUBLE THEN '⚠️ AI Detection: High likelihood (' || {PCT.format('ai_probability')} || '%) of AI-generated content. Writing patterns strongly match AI-generated text. Please ensure all work is original.' WHEN ai_probability >= 0.28::DOUBLE THEN '⚠️ AI Detection: Possible AI assistance detected (' || {PCT.format('ai_probability')} || '%). Some phrasing appears AI-generated. Please review and rewrite in your own words.' WHEN ai_probability < 0.20::DOUBLE THEN '✅ Writing appears genuinely student-authored with natural human patterns.' END,
  CASE WHEN copy_similarity >= 0.55::DOUBLE THEN '🚩 Copy Detection: High similarity (' || {PCT.format('copy_similarity')} || '%) found with another submission. Academic dishonesty policy applies.' WHEN copy_similarity >= 0.40::DOUBLE THEN '⚠️ Copy Detection: Moderate similarity (' || {PCT.format('copy_similarity')} || '%) with another submission. Please review and ensure independent work.' WHEN copy_similarity >= 0.28::DOUBLE THEN '📋 Copy Detection: Some similarity (' || {PCT.format('copy_similarity')} || '%) detected. This may be coincidental for assignments on the same topic.' END,
  CASE WHEN originality >= 0.80::DOUBLE THEN '✅ High originality score – work appears genuinely independent.' WHEN originality < 0.50::DOUBLE THEN '⚠️ Originality score is below acceptable threshold.' END)"""


def bar(c: str, bad: bool) -> str:
    high, low = ("red", "green") if bad else ("green", "red")
    return f"CASE WHEN floor({c} * 100 + 0.5) > 60 THEN '{high}' WHEN floor({c} * 100 + 0.5) > 30 THEN 'yellow' ELSE '{low}' END"


ASSIGN = """asg AS (SELECT o_orderkey AS id, o_custkey AS student_id, c_name AS student_name, c_mktsegment AS subject, o_orderpriority AS grade, n_name AS school,
  CASE o_orderstatus WHEN 'O' THEN 'submitted' WHEN 'P' THEN 'reviewing' WHEN 'F' THEN 'scored' END AS status, CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice % 101) / 10.0::DOUBLE END AS score, o_orderdate AS submitted_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
MINE = "(school = 'NATION_0' OR school IS NULL OR school = '')"
IDS = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'"

SQL: dict[str, str] = {
    "clean_text": f"WITH {SUBS} SELECT id, text, length(text)::INTEGER AS n_chars FROM subs",
    "clean_text_keep_paras": r"SELECT page_id AS id, trim(regexp_replace(regexp_replace(regexp_replace(html, '[^\x20-\x7E\n]', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM pages",
    "text_stats": f"""WITH {SUBS} SELECT id, length(text)::INTEGER AS char_count, len(w)::INTEGER AS word_count, len(s)::INTEGER AS sentence_count, CASE WHEN text = '' THEN 0 ELSE 1 END AS paragraph_count,
  CASE WHEN len(w) > 0 THEN {r('list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w)', 2)} ELSE 0.0 END AS avg_word_length, CASE WHEN len(s) > 0 THEN {r('len(w)::DOUBLE / len(s)', 2)} ELSE 0.0 END AS avg_sentence_length,
  CASE WHEN len(w) > 0 THEN {r('len(list_distinct(list_transform(w, lambda x: lower(x))))::DOUBLE / len(w)', 3)} ELSE 0.0 END AS unique_word_ratio
  FROM (SELECT *, {WORDS.format('text')} AS w, list_filter(string_split_regex(text, '[.!?]+'), lambda s: regexp_replace(s, '[ \\n]', '', 'g') <> '') AS s FROM subs)""".replace("\\\\n", "\\n"),
    "sentence_stats": f"WITH {SUBS}, {SENT} SELECT * FROM sent",
    "mattr": f"WITH {SUBS}, {RICH} SELECT id, word_count, letters, content_words::INTEGER AS content_words, lexical_richness FROM rich",
    "ai_markers": f"WITH {SUBS}, {MARK} SELECT * FROM mark",
    "punctuation": f"WITH {SUBS}, {PUNCT} SELECT * FROM punct",
    "paragraphs": rf"""SELECT id, len(p)::INTEGER AS count, {r('list_sum(ls)::DOUBLE / len(p)', 1)} AS avg_length, array_to_string(ls, ',') AS lengths FROM (SELECT id, p, list_transform(p, lambda x: len({WORDS.format('x')})) AS ls FROM (SELECT id, CASE WHEN len(p) > 0 THEN p ELSE [text] END AS p FROM (
  SELECT id, text, list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '[ \n]', '', 'g') <> '') AS p FROM (
    SELECT conv_id * 1000 + turn AS id, trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '[^\x20-\x7E\n]', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM conversations))))""",
    "char_entropy": f"WITH {SUBS}, {ENTROPY} SELECT * FROM ent",
    "burstiness": f"WITH {SUBS}, {TOP}, {BURST} SELECT * FROM burst",
    "top_words": f"WITH {SUBS}, {TOP} SELECT id, rank, word, count, first FROM top",
    "ai_phrase_hits": f"WITH {SUBS}, {HITS} SELECT * FROM hits",
    "stylometry": f"WITH {STYLES} SELECT * FROM style",
    "style_score": f"WITH {STYLES} SELECT id, style_score FROM style",
    "ai_probability": f"WITH {AIS} SELECT * FROM aip",
    "ai_probability_alt": f"""WITH {SUBS} SELECT id, CASE WHEN len(w) < 15 OR len(ls) = 0 THEN 0.0 ELSE {r('least(greatest((least(list_sum(ls)::DOUBLE / len(ls) / 25.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE + least(f::DOUBLE / len(w) * 12.0::DOUBLE, 1.0::DOUBLE) * 0.40::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - i::DOUBLE / len(w) * 8.0::DOUBLE) * 0.35::DOUBLE) * CASE WHEN x THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 0.0::DOUBLE), 1.0::DOUBLE)', 3)} END AS ai_probability
  FROM (SELECT id, w, ls, len(list_filter(w, lambda x: list_contains({arr(L.FORMAL_WORDS)}, x))) AS f, len(list_filter(w, lambda x: list_contains({arr(L.INFORMAL_WORDS)}, x))) AS i, list_has_any(w, {arr(L.COLLOQUIAL_WORDS)}) AS x
    FROM (SELECT id, {WORDS.format('low')} AS w, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: len({WORDS.format('s')})), lambda n: n > 2) AS ls FROM subs))""",
    "style_similarity": f"""WITH {STYLES}, {pairs('cp', BWORDS, 0.40, classes=True)} SELECT id_a, id_b, {r('1.0::DOUBLE - least((' + ' + '.join(f'abs(a.{c} - b.{c}) / greatest(abs(a.{c}), abs(b.{c}), 0.001::DOUBLE)' for c in ('lexical_richness', 'cv', 'ai_marker_ratio', 'density', 'avg_word_length')) + ') / 5, 1.0::DOUBLE)', 3)} AS style_similarity FROM cp JOIN style a ON id_a = a.id JOIN style b ON id_b = b.id""",
    "copy_pairs": f"WITH {SUBS}, {pairs('cp', BWORDS, 0.40, classes=True)} SELECT id_a, id_b, common, sim AS text_sim FROM cp",
    "copy_pairs_by_subject": f"WITH {SUBS}, {pairs('cp', BWORDS, 0.40, school=False, classes=True)} SELECT id_a, id_b, common, sim AS text_sim FROM cp",
    "ngram_jaccard": f"WITH {SUBS}, {pairs('ng', grams(3), 0.10, words=CWORDS, classes=True)} SELECT * FROM ng",
    "ngram_matrix": f"""WITH {SUBS}, {pairs('g2', grams(2), 0.0, 3, words=LWORDS)}, {pairs('g3', grams(3), 0.0, 3, words=LWORDS)}, m AS (SELECT id_a, id_b, coalesce(g2.sim, 0.0) AS bi, coalesce(g3.sim, 0.0) AS tri FROM g2 FULL JOIN g3 USING (id_a, id_b)), b AS (SELECT id_a AS id, id_b AS peer, bi, tri FROM m UNION ALL SELECT id_b, id_a, bi, tri FROM m) SELECT id, peer, bi, tri, {r('(bi + tri) / 2', 3)} AS sim FROM b""",
    "tf_cosine": f"""WITH {SUBS}, {pairs('cp', BWORDS, 0.40, classes=True)}, tf AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest({CWORDS}) AS term FROM subs) GROUP BY ALL), nm AS (SELECT id, sum(n * n)::DOUBLE AS sq FROM tf GROUP BY id)
  SELECT id_a, id_b, {r('sum(x.n * y.n)::DOUBLE / sqrt(max(a.sq) * max(b.sq))', 4)} AS tf_cos FROM cp JOIN tf x ON x.id = id_a JOIN tf y ON y.id = id_b AND x.term = y.term JOIN nm a ON a.id = id_a JOIN nm b ON b.id = id_b GROUP BY id_a, id_b""",
}
def gated(least: float, classes: bool) -> str:
    return f"""{pairs('ng', grams(3), least, words=CWORDS, classes=classes)}, tf AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest({CWORDS}) AS term FROM subs) GROUP BY ALL), nm AS (SELECT id, sum(n * n)::DOUBLE AS sq FROM tf GROUP BY id),
tc AS (SELECT id_a, id_b, max(sim) AS ng3, {r('sum(x.n * y.n)::DOUBLE / sqrt(max(a.sq) * max(b.sq))', 4)} AS tf_cos FROM ng JOIN tf x ON x.id = id_a JOIN tf y ON y.id = id_b AND x.term = y.term JOIN nm a ON a.id = id_a JOIN nm b ON b.id = id_b GROUP BY id_a, id_b),
gated AS (SELECT id_a, id_b, tf_cos, ng3, {r('least(tf_cos, ng3 * 1.5::DOUBLE) * 0.6::DOUBLE + ng3 * 0.4::DOUBLE', 4)} AS similarity FROM tc)"""


SQL |= {
    "gated_similarity": f"WITH {SUBS}, {gated(0.10, True)}, {pairs('n2', grams(2), 0.0, words=CWORDS)} SELECT gated.*, coalesce(n2.sim, 0.0) AS ng2 FROM gated LEFT JOIN n2 USING (id_a, id_b)",
    "topk_matches": f"""WITH {SUBS}, {gated(0.0, False)}, {HANDS}, e AS (SELECT id_a, id_b, coalesce(similarity, 0.0) AS text_sim, coalesce(hw_sim, 0.0) AS hw_sim FROM gated FULL JOIN hw USING (id_a, id_b)), b AS (SELECT id_a AS id, id_b AS peer, text_sim, hw_sim FROM e UNION ALL SELECT id_b, id_a, text_sim, hw_sim FROM e),
  c AS (SELECT *, {r('text_sim * 0.65::DOUBLE + hw_sim * (1 - 0.65::DOUBLE)', 3)} AS combined FROM b) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY combined DESC, peer)::INTEGER AS rank FROM c WHERE combined > 0.25::DOUBLE OR hw_sim > 0.88::DOUBLE) WHERE rank <= 5""",
    "exact_dup_md5": "SELECT md5(text) AS md5, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "fingerprint_cosine": f"""WITH m AS (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY pos) AS c FROM m GROUP BY label)
  SELECT vec_id, {r('list_sum(list_transform(list_zip(embedding, c), lambda p: p[1]::DOUBLE * p[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(c, lambda x: x * x)))) + 1.0::DOUBLE', 4)} AS cosine_plus_1 FROM embeddings JOIN c USING (label)""",
    "hw_pairs": f"WITH {HANDS} SELECT * FROM hw WHERE hw_sim >= 0.3::DOUBLE",
    "vector_centroid": """WITH m AS (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL), s AS (SELECT label, sqrt(sum(m * m)) + 1e-8 AS s FROM m GROUP BY label)
  SELECT label, pos::INTEGER AS pos, floor(m / s * 1000000 + 0.5)::BIGINT AS micro FROM m JOIN s USING (label)""",
    "page_feature_avg": f"SELECT l_orderkey AS id, {r('avg(l_quantity::BIGINT)', 4)} AS quantity, {r('avg(round(l_discount * 100)::BIGINT)', 4)} AS discount FROM lineitem GROUP BY 1",
    "log_norm": f"SELECT p_partkey, {r('least(ln(1 + p_size::DOUBLE) / ln(16.0::DOUBLE), 1.0::DOUBLE)', 6)} AS loops, {r('least(ln(1 + p_retailprice) / ln(6001.0::DOUBLE), 1.0::DOUBLE)', 6)} AS area FROM part",
    "copy_batch": f"WITH {EVS}, {BATCH} SELECT * FROM batch",
    "best_peer": f"WITH {EVS}, {BEST.format('evd')} SELECT * FROM best",
    "base_flags": f"WITH {FLAGS} SELECT id, array_to_string(flags, '; ') AS flags FROM base",
    "copy_flags": f"WITH {FLAGS} SELECT id, peer, rule, text_sim, hw_sim, more, flag FROM pf",
    "final_flags": f"WITH {FLAGS} SELECT id, array_to_string(flags, '; ') AS flags FROM fin",
    "flag_summary": f"WITH {FLAGS} SELECT id, len(flags) > 0 AS flagged, array_to_string(flags, '; ') AS reasons, len(flags)::INTEGER AS flag_count FROM fin",
    "peer_flags": peer(0.55, 0.40, 0.75, True, False),
    "peer_flags_alt": peer(0.65, 0.60, 0.92, False, True),
    "integrity_score": f"WITH {ALL} SELECT * FROM scored",
    "originality_alt": f"WITH {ALL} SELECT id, {r('1.0::DOUBLE - greatest(ai_probability, copy_similarity)', 3)} AS originality, CASE WHEN score >= 8 THEN 'Excellent' WHEN score >= 6 THEN 'Good' WHEN score >= 5 THEN 'Average' WHEN score >= 3 THEN 'Below Average' ELSE 'Needs Improvement' END AS label FROM scored",
    "feedback": f"WITH {ALL} SELECT id, {FEED} AS feedback FROM scored",
    "ui_bands": f"WITH {ALL} SELECT id, score, {case([(9.0, 'Outstanding'), (8.0, 'Excellent'), (7.0, 'Good'), (6.0, 'Satisfactory'), (5.0, 'Average'), (3.0, 'Below Average'), (0.0, 'Poor')], 'score')} AS label, {case([(8.0, 'green'), (5.0, 'yellow'), (0.0, 'red')], 'score')} AS colour, {bar('originality', False)} AS originality_bar, {bar('ai_probability', True)} AS ai_bar, {bar('copy_similarity', True)} AS copy_bar FROM scored",
    "lookup_by_key": f"WITH {ASSIGN} SELECT id, student_name, subject, status FROM asg WHERE id = 7",
    "teacher_assignments": f"WITH {ASSIGN} SELECT id, student_name, grade, score, submitted_at FROM asg WHERE {MINE} AND subject = 'BUILDING' AND status = 'scored'",
    "tenant_filter": f"WITH {ASSIGN} SELECT school, status, count(*) AS n FROM asg WHERE {MINE} GROUP BY ALL",
    "batch_semi": f"WITH {ASSIGN} SELECT id, subject, status FROM asg WHERE id IN ({IDS})",
    "history_peers": f"WITH {ASSIGN}, sc AS (SELECT DISTINCT subject, school FROM asg WHERE id IN ({IDS})) SELECT id, subject, school, submitted_at FROM (SELECT asg.*, row_number() OVER (PARTITION BY subject, school ORDER BY submitted_at DESC, id) AS n FROM asg JOIN sc USING (subject, school) WHERE status = 'scored' AND id NOT IN ({IDS})) WHERE n <= 30",
    "dashboard_stats": f"WITH {ASSIGN} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'submitted') AS pending, count(*) FILTER (WHERE status = 'reviewing') AS reviewing, count(*) FILTER (WHERE status = 'scored') AS scored, count(*) FILTER (WHERE status = 'scored' AND score < 5 AND id % 7 <> 0) AS flagged, {r('sum(round(score * 10)::BIGINT)::DOUBLE / count(score) / 10.0::DOUBLE', 2)} AS avg_score FROM asg WHERE {MINE}",
    "score_histogram": f"WITH {ASSIGN}, b AS (SELECT unnest(range(5)) AS n, unnest(['0-2', '3-4', '5-6', '7-8', '9-10']) AS bin) SELECT bin, count(score) AS count FROM b LEFT JOIN asg ON score IS NOT NULL AND n = CASE WHEN score <= 2 THEN 0 WHEN score <= 4 THEN 1 WHEN score <= 6 THEN 2 WHEN score <= 8 THEN 3 ELSE 4 END GROUP BY bin",
    "ranked_report": f"WITH {ASSIGN} SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, student_name, grade, subject, score, submitted_at FROM asg WHERE status = 'scored' AND subject = 'BUILDING'",
    "student_stats": f"WITH {ASSIGN}, n AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY submitted_at DESC, id) AS n FROM asg) SELECT student_id, count(*) AS total, count(*) FILTER (WHERE status <> 'scored') AS pending, count(*) FILTER (WHERE status = 'scored') AS scored, {r('sum(round(score * 10)::BIGINT)::DOUBLE / nullif(count(score), 0) / 10.0::DOUBLE', 1)} AS avg_score, string_agg(id::VARCHAR, ',' ORDER BY n) FILTER (WHERE n <= 5) AS latest FROM n GROUP BY student_id",
    "quality_checks": f"WITH {ASSIGN}, v AS (SELECT 'repeated id' AS rule, count(*) AS n FROM asg GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'unknown state', 1 FROM asg WHERE status IS NULL UNION ALL SELECT 'score out of range', 1 FROM asg WHERE score NOT BETWEEN 0 AND 10 UNION ALL SELECT 'score and state differ', 1 FROM asg WHERE (status = 'scored') <> (score IS NOT NULL)) SELECT rule, sum(n)::BIGINT AS violations FROM v GROUP BY rule",
    "json_flags": "SELECT event_id, coalesce(len(json_keys(props)), 0)::INTEGER AS keys, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS flags FROM events",
    "page_merge": f"SELECT conv_id AS id, coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (WHERE trim(text) <> ''), '') AS text, coalesce({r('avg((turn % 4) / 4.0::DOUBLE) FILTER (WHERE trim(text) <> chr(32) AND trim(text) <> chr(10) AND length(trim(text)) > 0)', 3)}, 0.0) AS avg_confidence, count(*) AS page_count FROM conversations GROUP BY conv_id",
    "latest_state": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "line_runs": """WITH p AS (SELECT user_id % 50 AS page, event_id // 64 AS y, count(*) FILTER (WHERE event_type = 'click') AS ink FROM events GROUP BY ALL), m AS (SELECT *, (ink > 25 * 0.02::DOUBLE)::INTEGER AS on_, row_number() OVER (PARTITION BY page ORDER BY y) AS k, max(y) OVER (PARTITION BY page) AS last FROM p),
  g AS (SELECT *, k - row_number() OVER (PARTITION BY page, on_ ORDER BY y) AS grp FROM m) SELECT page, min(y) AS start, max(y) - min(y) + 1 AS height, sum(ink)::BIGINT AS ink FROM g WHERE on_ = 1 GROUP BY page, grp, last HAVING max(y) < last AND max(y) - min(y) + 1 > 1""",
    "stroke_gaps": f"WITH g AS (SELECT l_suppkey AS page, l_orderkey - lag(l_orderkey + l_quantity::BIGINT) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_quantity::BIGINT) AS gap FROM lineitem) SELECT page, count(*) AS gaps, {r('avg(gap)', 3)} AS mean_gap FROM g WHERE gap > 0 GROUP BY page",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL",
    "event_sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    "event_types": f"SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, {r('avg(value)', 2)} AS mean_value FROM events GROUP BY event_type",
}

PIX = """lines AS (SELECT item_id AS page, unnest(range(greatest(ceil(length(coalesce(text, '')) / 48.0)::BIGINT, 1))) AS y, coalesce(text, '') AS t FROM benchmark),
px AS (SELECT page, y, x, (unicode(substr(rpad(substr(t, y * 48 + 1, 48), 48, 'ÿ'), x + 1, 1)) & 255) AS g FROM lines, range(48) r(x)), tall AS (SELECT page, max(y) AS last FROM px GROUP BY page)"""


def lists(value: str, name: str, source: str) -> str:
    return f"SELECT page, y::INTEGER AS y, string_agg(({value})::BIGINT::VARCHAR, ',' ORDER BY x) AS {name} FROM {source} GROUP BY page, y"


def mirrored(c: str, last: str) -> str:
    return f"CASE WHEN {c} < 0 THEN least(1, {last}) WHEN {c} > {last} THEN greatest({last} - 1, 0) ELSE {c} END"


NOISE = f"""bell AS (SELECT * FROM (VALUES (-1, 1), (0, 2), (1, 1)) b(k, f)),
soft AS (SELECT p.page, p.y, p.x, (sum(q.g * a.f * b.f) + 8) // 16 AS g FROM px p JOIN tall USING (page), bell a, bell b, px q WHERE q.page = p.page AND q.y = {mirrored('p.y + a.k', 'last')} AND q.x = {mirrored('p.x + b.k', '47')} GROUP BY ALL),
thin AS (SELECT p.page, p.y, p.x, min(q.g) AS g FROM soft p JOIN soft q ON q.page = p.page AND q.y BETWEEN p.y - 1 AND p.y AND q.x BETWEEN p.x - 1 AND p.x GROUP BY ALL),
wide AS (SELECT p.page, p.y, p.x, max(q.g) AS g FROM thin p JOIN thin q ON q.page = p.page AND q.y BETWEEN p.y - 1 AND p.y AND q.x BETWEEN p.x - 1 AND p.x GROUP BY ALL)"""
BINARY = f"""bell AS (SELECT unnest(range(-{REACH}, {REACH + 1})) AS k, unnest({WEIGHTS}) AS f),
flat AS (SELECT p.page, p.y, p.x, sum(q.g * f) AS h FROM px p, bell, px q WHERE q.page = p.page AND q.y = p.y AND q.x = least(greatest(p.x + k, 0), 47) GROUP BY ALL),
mean AS (SELECT p.page, p.y, p.x, (sum(q.h * f)::BIGINT + 32768) // 65536 AS m FROM flat p JOIN tall USING (page), bell, flat q WHERE q.page = p.page AND q.x = p.x AND q.y = least(greatest(p.y + k, 0), last) GROUP BY ALL),
bin AS (SELECT page, y, x, g, CASE WHEN g > m - 4 THEN 255 ELSE 0 END AS b FROM px JOIN mean USING (page, y, x))"""
STROKES = """st AS (SELECT l_suppkey AS page, l_orderkey AS x, l_linenumber * 20 AS y, l_quantity::BIGINT AS w, l_linenumber + 3 AS h, floor(l_extendedprice / 100)::BIGINT AS area, l_quantity::BIGINT * 2 + l_linenumber * 3 AS perimeter, l_returnflag = 'A' AS hole, l_tax AS tone, l_linenumber AS rank FROM lineitem)"""


def cv(x: str) -> str:
    return f"coalesce(CASE WHEN avg({x}) > 0 THEN stddev_pop({x}) / avg({x}) END, 1.0::DOUBLE)"


ROUND = "4 * pi() * area / (perimeter * perimeter)"
SFEAT = f"""sg AS (SELECT *, CASE WHEN d > 0 AND d < 200 THEN d END AS gap FROM (SELECT *, x - lag(x + w) OVER (PARTITION BY page ORDER BY x, w) AS d FROM st WHERE NOT hole AND area >= 4)),
sfound AS (SELECT page, count(*) AS stroke_count, {r('sum(area)::DOUBLE / 12000000', 4)} AS stroke_density, {r('avg(h)', 2)} AS mean_height, {r(cv('h'), 3)} AS height_cv, {r('avg(w)', 2)} AS mean_width, {r(cv('w'), 3)} AS width_cv, {r('coalesce(avg(w::DOUBLE / h), 1.0)', 3)} AS mean_aspect,
  {r('coalesce(avg(gap), 0.0)', 2)} AS mean_gap, {r(cv('gap'), 3)} AS gap_cv, {r('CASE WHEN avg(w) > 0 THEN least(coalesce(avg(gap), 0.0) / avg(w), 2.0::DOUBLE) / 2.0::DOUBLE ELSE 0.25::DOUBLE END', 3)} AS gap_to_width_ratio, {r(f'coalesce(avg({ROUND}) FILTER (WHERE perimeter > 0), 0.0)', 4)} AS compactness, {r('least(avg(perimeter::DOUBLE / area) / 10.0::DOUBLE, 1.0::DOUBLE)', 4)} AS thinness,
  {r('avg(area)', 2)} AS area_mean, {r('stddev_pop(area)', 2)} AS area_std FROM sg GROUP BY page),
sf AS (SELECT s_suppkey AS page, coalesce(stroke_count, 0)::BIGINT AS stroke_count, coalesce(stroke_density, 0.0) AS stroke_density, coalesce(mean_height, 0.0) AS mean_height, coalesce(height_cv, 1.0) AS height_cv, coalesce(mean_width, 0.0) AS mean_width, coalesce(width_cv, 1.0) AS width_cv, coalesce(mean_aspect, 1.0) AS mean_aspect, coalesce(mean_gap, 0.0) AS mean_gap, coalesce(gap_cv, 1.0) AS gap_cv,
  coalesce(gap_to_width_ratio, 0.5) AS gap_to_width_ratio, coalesce(compactness, 0.0) AS compactness, coalesce(thinness, 0.0) AS thinness, coalesce(area_mean, 0.0) AS area_mean, coalesce(area_std, 0.0) AS area_std FROM supplier LEFT JOIN sfound ON s_suppkey = page)"""
FEET = "FILTER (WHERE area >= 10 AND NOT hole)"
SHAPE = f"""sh AS (SELECT page, CASE WHEN o = 0 THEN 0.0 ELSE {r('least((a - o)::DOUBLE / o, 1.0::DOUBLE)', 3)} END AS loop_density, CASE WHEN k < 5 THEN 0.5 ELSE {r('least(CASE WHEN m > 0 THEN s / m ELSE 1.0::DOUBLE END / 0.15::DOUBLE, 1.0::DOUBLE)', 3)} END AS baseline_deviation
  FROM (SELECT page, count(*) FILTER (WHERE area > 4) AS a, count(*) FILTER (WHERE area > 4 AND NOT hole) AS o, count(*) {FEET} AS k, avg(y + h) {FEET} AS m, stddev_pop(y + h) {FEET} AS s FROM st GROUP BY page))"""
ANGLE = "an AS (SELECT page, median((w - 25) * 2) AS angle FROM st WHERE rank <= 5 AND abs((w - 25) * 2) < 45 GROUP BY page)"
SLANT = r("greatest(least(angle / 30.0::DOUBLE, 1.0::DOUBLE), -1.0::DOUBLE)", 3)
LINEF = f"""pr AS (SELECT l_suppkey AS page, floor(l_extendedprice / 512)::BIGINT AS y, sum(l_quantity)::BIGINT AS ink FROM lineitem GROUP BY ALL), mk AS (SELECT *, (ink > 3000 * 0.02::DOUBLE)::INTEGER AS on_, row_number() OVER (PARTITION BY page ORDER BY y) AS k, max(y) OVER (PARTITION BY page) AS last FROM pr),
gp AS (SELECT *, k - row_number() OVER (PARTITION BY page, on_ ORDER BY y) AS grp FROM mk), ru AS (SELECT page, min(y) AS start, max(y) - min(y) + 1 AS height, sum(ink)::BIGINT AS ink FROM gp WHERE on_ = 1 GROUP BY page, grp, last HAVING max(y) < last AND max(y) - min(y) + 1 > 3),
ch AS (SELECT *, abs(height - lag(height) OVER (PARTITION BY page ORDER BY start)) AS change, ink::DOUBLE / (height * 3000) AS density FROM ru), lfound AS (SELECT page, count(*) AS line_count, {r('avg(height)', 2)} AS line_height_mean, {r(cv('height'), 3)} AS line_height_cv, {r('avg(density)', 4)} AS line_density_mean, {r(cv('change'), 3)} AS line_spacing_cv FROM ch GROUP BY page),
lf AS (SELECT page, coalesce(line_count, 0)::BIGINT AS line_count, coalesce(line_height_mean, 0.0) AS line_height_mean, coalesce(line_height_cv, 1.0) AS line_height_cv, coalesce(line_density_mean, 0.0) AS line_density_mean, coalesce(line_spacing_cv, 1.0) AS line_spacing_cv FROM (SELECT DISTINCT page FROM pr) LEFT JOIN lfound USING (page))"""
HAND = f"""{STROKES}, {SFEAT}, {SHAPE}, {ANGLE}, {LINEF}, tn AS (SELECT page, {r('greatest(least(1.0::DOUBLE - avg(round(tone * 1000)::BIGINT) / 255.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE)', 3)} AS pressure FROM st GROUP BY page),
hp AS (SELECT *, [{', '.join(f'{c} * 1.5::DOUBLE' for c in IDENTITY)}, {', '.join(f'{c}::DOUBLE' for c in MANNER)}, least(area_mean / 500.0::DOUBLE, 1.0::DOUBLE), least(area_std / 500.0::DOUBLE, 1.0::DOUBLE), least(stroke_count / 200.0::DOUBLE, 1.0::DOUBLE)] AS v FROM (SELECT *, {SLANT} AS slant FROM sf JOIN lf USING (page) JOIN sh USING (page) JOIN tn USING (page) JOIN an USING (page))),
fp AS (SELECT page, unnest(range(18)) AS pos, unnest(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))) AS x FROM hp)"""
EVEN = "greatest(0.4::DOUBLE, 1.0::DOUBLE - least({0}, 1.0::DOUBLE) * 0.6::DOUBLE)"
#: Eight texts on a page, under the names of PIX: then BINARY and the others read them.
SCAN = f"""{PIX.replace("px AS (", "px0 AS (").replace("tall AS (", "tall0 AS (").replace("FROM px", "FROM px0")}, off AS (SELECT item, item // 8 AS page, coalesce(sum(n) OVER (PARTITION BY item // 8 ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS above FROM (SELECT page AS item, max(y) + 1 AS n FROM px0 GROUP BY page)),
px AS (SELECT off.page, px0.y + above AS y, x, g FROM px0 JOIN off ON item = px0.page), tall AS (SELECT page, max(y) AS last FROM px GROUP BY page)"""


def labels(name: str, ink: str) -> str:
    """cells (with an empty frame) and lab: their labels, over eight neighbours for ink and four for ground; recursive."""
    return f"""{name}c AS (SELECT page, y, x, coalesce({ink}, false) AS ink, (y + 1) * 50 + x + 1 AS id FROM (SELECT page, unnest(range(-1, last + 2)) AS y FROM tall) JOIN (SELECT unnest(range(-1, 49)) AS x) ON true LEFT JOIN bin USING (page, y, x) LEFT JOIN pol USING (page)),
{name}l AS (SELECT p.page, p.id AS a, q.id AS b FROM {name}c p JOIN (SELECT unnest([-1, 0, 1]) AS dx) ON true JOIN (SELECT unnest([-1, 0, 1]) AS dy) ON dx <> 0 OR dy <> 0 JOIN {name}c q ON q.page = p.page AND q.x = p.x + dx AND q.y = p.y + dy AND q.ink = p.ink WHERE p.ink OR dx = 0 OR dy = 0),
{name} (page, id, label) USING KEY (page, id) AS (SELECT page, id, id FROM {name}c UNION SELECT l.page, l.b, min(n.label) FROM {name} n JOIN {name}l l ON l.page = n.page AND l.a = n.id JOIN recurring.{name} o ON o.page = l.page AND o.id = l.b WHERE n.label < o.label GROUP BY l.page, l.b)"""


POL = "pol AS (SELECT page, avg(b) > 127 AS white FROM bin GROUP BY page)"
CORNERS = [(0, 0), (1, 0), (0, 1), (1, 1)]
CONTOURS = f"""lbl AS (SELECT c.*, label FROM labc c JOIN lab USING (page, id)),
quad AS (SELECT a.page, a.x, a.y, a.ink::INTEGER + 2 * b.ink::INTEGER + 4 * c.ink::INTEGER + 8 * d.ink::INTEGER AS pattern, [a.label, b.label, c.label, d.label] AS ls FROM lbl a JOIN lbl b ON b.page = a.page AND b.id = a.id + 1 JOIN lbl c ON c.page = a.page AND c.id = a.id + 50 JOIN lbl d ON d.page = a.page AND d.id = a.id + 51 WHERE a.x < 48),
side (pattern, px, py, qx, qy, i, g) AS (VALUES {', '.join(f'({k}, {p[0]}, {p[1]}, {q[0]}, {q[1]}, {CORNERS.index(i) + 1}, {CORNERS.index(g) + 1})' for k, v in SIDES.items() for p, q, i, g in v)}),
sums AS (SELECT page, ls[i] AS ink, ls[g] AS ground, count(*) FILTER (WHERE (px = qx) <> (py = qy)) AS straight, count(*) FILTER (WHERE px <> qx AND py <> qy) AS slanting, abs(sum((x + px) * (y + qy) - (x + qx) * (y + py))) / 2.0::DOUBLE AS area FROM quad JOIN side USING (pattern) GROUP BY ALL),
box AS (SELECT page, label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM lbl GROUP BY page, label),
around AS (SELECT s.page, s.label AS ink, g.label AS ground FROM lbl s JOIN lbl g ON g.page = s.page AND g.id = s.id - 1 WHERE s.ink AND s.id = s.label),
found AS (SELECT s.*, s.ground <> a.ground AS inner_ FROM sums s JOIN around a ON a.page = s.page AND a.ink = s.ink)"""
EDGES = """pad AS (SELECT p.page, p.y, p.x, dx, dy, q.g FROM px p JOIN tall USING (page) JOIN (SELECT unnest([-1, 0, 1]) AS dx) ON true JOIN (SELECT unnest([-1, 0, 1]) AS dy) ON true JOIN px q ON q.page = p.page AND q.x = least(greatest(p.x + dx, 0), 47) AND q.y = least(greatest(p.y + dy, 0), last)),
grad AS (SELECT page, y, x, sum(g * dx * (2 - abs(dy)))::BIGINT AS gx, sum(g * dy * (2 - abs(dx)))::BIGINT AS gy FROM pad GROUP BY ALL), mag AS (SELECT *, abs(gx) + abs(gy) AS m FROM grad),
way AS (SELECT *, CASE WHEN abs(gy) * 32768 < abs(gx) * 13573 THEN [1, 0] WHEN abs(gy) * 32768 > abs(gx) * (13573 + 65536) THEN [0, 1] WHEN (gx < 0) <> (gy < 0) THEN [-1, 1] ELSE [1, 1] END AS w FROM mag),
ridge AS (SELECT a.page, a.y, a.x, a.m > 150 AS strong FROM way a LEFT JOIN mag b ON b.page = a.page AND b.x = a.x - w[1] AND b.y = a.y - w[2] LEFT JOIN mag c ON c.page = a.page AND c.x = a.x + w[1] AND c.y = a.y + w[2]
  WHERE a.m > 50 AND a.m > coalesce(b.m, 0) AND CASE WHEN w[1] <> 0 AND w[2] <> 0 THEN a.m > coalesce(c.m, 0) ELSE a.m >= coalesce(c.m, 0) END),
edge (page, y, x) AS (SELECT page, y, x FROM ridge WHERE strong UNION SELECT r.page, r.y, r.x FROM edge e JOIN ridge r ON r.page = e.page AND abs(r.x - e.x) <= 1 AND abs(r.y - e.y) <= 1)"""
NORMALS = f"nrm AS (SELECT unnest(range(180)) AS theta, unnest({[float(x) for x in scans.COS]}::REAL[]) AS c, unnest({[float(x) for x in scans.SIN]}::REAL[]) AS s)"
LINES = f"""{NORMALS}, vote AS (SELECT page, theta, round_even(x::REAL * c + y::REAL * s, 0)::BIGINT AS rho, count(*) AS votes FROM edge, nrm GROUP BY ALL),
peak AS (SELECT v.* FROM vote v {' '.join(f'LEFT JOIN vote {n} ON {n}.page = v.page AND {n}.theta = v.theta + {t} AND {n}.rho = v.rho + {r}' for n, t, r in (('a', 0, -1), ('b', 0, 1), ('c', -1, 0), ('d', 1, 0)))} WHERE v.votes > 8 AND v.votes > coalesce(a.votes, 0) AND v.votes >= coalesce(b.votes, 0) AND v.votes > coalesce(c.votes, 0) AND v.votes >= coalesce(d.votes, 0))"""
TURNED = """tilt AS (SELECT page, last + 1 AS h, (last + 1) // 2 AS cy, 24 AS cx, cos(radians((page % 7 - 3) * 4.0::DOUBLE)) AS c, sin(radians((page % 7 - 3) * 4.0::DOUBLE)) AS s FROM tall WHERE page % 7 <> 3),
src AS (SELECT page, y, x, h, (round_even(c * x * 1024, 0)::BIGINT + round_even((-s * y + (cx - c * cx + s * cy)) * 1024, 0)::BIGINT + 16) >> 5 AS u, (round_even(s * x * 1024, 0)::BIGINT + round_even((c * y + (cy - s * cx - c * cy)) * 1024, 0)::BIGINT + 16) >> 5 AS v FROM px JOIN tilt USING (page)),
turn AS (SELECT s.page, s.y, s.x, (sum(q.g * CASE dx WHEN 0 THEN 32 - (u & 31) ELSE u & 31 END * CASE dy WHEN 0 THEN 32 - (v & 31) ELSE v & 31 END)::BIGINT + 512) >> 10 AS g FROM src s JOIN (SELECT unnest([0, 1]) AS dx) ON true JOIN (SELECT unnest([0, 1]) AS dy) ON true JOIN px q ON q.page = s.page AND q.x = least(greatest((u >> 5) + dx, 0), 47) AND q.y = least(greatest((v >> 5) + dy, 0), h - 1) GROUP BY ALL)"""
CONTRAST = """fill AS (SELECT page, th, 6 AS tw, unnest(range(th * 8)) AS y, last FROM (SELECT page, last, (last + 8) // 8 AS th FROM tall)),
lev AS (SELECT f.page, f.y // th * 8 + x // tw AS tile, g AS level, count(*) AS n, any_value(th * tw) AS area FROM fill f JOIN px ON px.page = f.page AND px.y = least(f.y % (2 * last), 2 * last - f.y % (2 * last)) GROUP BY ALL),
every AS (SELECT page, tile, area, level, coalesce(n, 0) AS n, greatest(floor(3.0::DOUBLE * area / 256), 1)::BIGINT AS most FROM (SELECT DISTINCT page, tile, area FROM lev) JOIN (SELECT unnest(range(256)) AS level) ON true LEFT JOIN lev USING (page, tile, area, level)),
cut AS (SELECT *, (sum(greatest(n - most, 0)) OVER (PARTITION BY page, tile))::BIGINT AS over_ FROM every),
even AS (SELECT *, greatest(256 // greatest(over_ % 256, 1), 1) AS step FROM cut),
new AS (SELECT page, tile, area, level, least(n, most) + over_ // 256 + CASE WHEN level % step = 0 AND level // step < over_ % 256 THEN 1 ELSE 0 END AS n FROM even),
tab AS (SELECT page, tile, level, least(round_even(sum(n) OVER (PARTITION BY page, tile ORDER BY level) * 255.0::DOUBLE / area, 0), 255)::BIGINT AS out FROM new)"""
SQL |= {
    "page_grey": f"WITH {PIX} {lists('(g * 4899 + g * 3 % 256 * 9617 + g * 7 % 256 * 1868 + 8192) // 16384', 'grey', 'px')}",
    "page_noise": f"WITH {PIX}, {NOISE} {lists('g', 'grey', 'wide')}",
    "page_binary": f"WITH {PIX}, {BINARY} {lists('b', 'binary', 'bin')}",
    "page_metrics": f"WITH RECURSIVE {PIX}, {BINARY}, {POL}, {labels('lab', 'b = 0')}, outer_ AS (SELECT s.page, count(*) AS char_count FROM labc s JOIN lab l ON l.page = s.page AND l.id = s.id JOIN lab g ON g.page = s.page AND g.id = s.id - 1 WHERE s.ink AND l.label = s.id AND g.label = 0 GROUP BY s.page), inked AS (SELECT bin.*, CASE WHEN white THEN b = 0 ELSE b = 255 END AS ink FROM bin JOIN pol USING (page)), rw AS (SELECT page, y, count(*) FILTER (WHERE b = 0) AS black FROM bin GROUP BY ALL) SELECT page, 48 AS width, count(DISTINCT y) AS height, {r('count(*) FILTER (WHERE b = 0)::DOUBLE / count(*)', 4)} AS ink_ratio, (SELECT count(*) FROM rw WHERE rw.page = inked.page AND black * 255 > 48 * 0.02::DOUBLE) AS text_lines, CASE WHEN count(*) FILTER (WHERE ink) > 0 THEN {r('greatest(least(1.0::DOUBLE - sum(g) FILTER (WHERE ink)::DOUBLE / count(*) FILTER (WHERE ink) / 255.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE)', 3)} ELSE 0.5 END AS pressure, coalesce(max(char_count), 0) AS char_count FROM inked LEFT JOIN outer_ USING (page) GROUP BY page",
    "page_contours": f"WITH RECURSIVE {SCAN}, {BINARY}, {POL}, {labels('lab', 'CASE WHEN white THEN b = 0 ELSE b = 255 END')}, {CONTOURS} SELECT found.page, CASE WHEN inner_ THEN x0 - 1 ELSE x0 END AS x, CASE WHEN inner_ THEN y0 - 1 ELSE y0 END AS y, x1 - x0 + CASE WHEN inner_ THEN 3 ELSE 1 END AS w, y1 - y0 + CASE WHEN inner_ THEN 3 ELSE 1 END AS h, area, {r('straight + slanting * sqrt(2.0::DOUBLE)', 3)} AS perimeter, inner_ OR ground <> 0 AS hole, inner_ AS inner FROM found JOIN box ON box.page = found.page AND box.label = CASE WHEN inner_ THEN ground ELSE ink END",
    "page_edges": f"WITH RECURSIVE {SCAN}, {EDGES}, ed AS (SELECT px.page, px.y, px.x, CASE WHEN edge.x IS NULL THEN 0 ELSE 255 END AS e FROM px LEFT JOIN edge ON edge.page = px.page AND edge.y = px.y AND edge.x = px.x) {lists('e', 'edge', 'ed')}",
    "page_lines": f"WITH RECURSIVE {SCAN}, {EDGES}, {LINES} SELECT * FROM (SELECT page, row_number() OVER (PARTITION BY page ORDER BY votes DESC, theta, rho)::INTEGER AS rank, (theta - 90)::DOUBLE AS angle, rho, votes FROM peak) WHERE rank <= 20",
    "page_turned": f"WITH {SCAN}, {TURNED} {lists('g', 'grey', 'turn')}",
    "page_contrast": f"WITH {SCAN}, {CONTRAST} SELECT page, tile, string_agg(out::VARCHAR, ',' ORDER BY level) AS levels FROM tab GROUP BY ALL",
    "stroke_features": f"WITH {STROKES}, {SFEAT} SELECT * FROM sf",
    "stroke_shape": f"WITH {STROKES}, {SHAPE} SELECT * FROM sh",
    "slant_angles": f"WITH {STROKES}, {ANGLE} SELECT page, {SLANT} AS slant, CASE WHEN abs(angle) >= 0.5 THEN angle ELSE 0.0 END AS skew FROM an",
    "line_features": f"WITH {LINEF} SELECT * FROM lf",
    "hand_fingerprint": f"WITH {HAND} SELECT page, pos::INTEGER AS pos, {r('x', 4)} AS x FROM fp",
    "hand_analysis": f"WITH {HAND}, mf AS (SELECT page // 10 AS id, pos, avg(x) AS m FROM fp GROUP BY ALL), nf AS (SELECT id, string_agg(floor(m / n * 10000 + 0.5)::BIGINT::VARCHAR, ',' ORDER BY pos) AS fingerprint FROM mf JOIN (SELECT id, sqrt(sum(m * m)) + 1e-8 AS n FROM mf GROUP BY id) USING (id) GROUP BY id), me AS (SELECT page // 10 AS id, {', '.join(r(f'avg({c})', 4) + f' AS {c}' for c in ('height_cv', 'width_cv', 'gap_cv', 'line_height_cv', 'stroke_count', 'line_count', 'stroke_density', 'compactness'))}, {', '.join(r(f'avg({c})', 3) + f' AS {c}' for c in ('pressure', 'slant', 'loop_density'))} FROM hp GROUP BY 1) SELECT id, {r(f'least(greatest(({EVEN.format("height_cv")} * 0.35::DOUBLE + {EVEN.format("width_cv")} * 0.25::DOUBLE + {EVEN.format("gap_cv")} * 0.25::DOUBLE + {EVEN.format("line_height_cv")} * 0.15::DOUBLE) * CASE WHEN stroke_count < 20 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END, 0.1::DOUBLE), 1.0::DOUBLE)', 3)} AS consistency, pressure, stroke_density, trunc(stroke_count)::INTEGER AS stroke_count, trunc(line_count)::INTEGER AS line_count, height_cv, gap_cv, compactness, slant, loop_density, fingerprint FROM me JOIN nf USING (id) UNION ALL SELECT -1 - n_nationkey, 0.5, 0.5, 0.0, 0, 0, 1.0, 1.0, 0.0, 0.0, 0.0, array_to_string(list_transform(range(18), lambda i: '0'), ',') FROM nation",
    "identity_fingerprint": f"WITH {STROKES}, su AS (SELECT page, count(*) FILTER (WHERE area > 10) AS n, count(*) FILTER (WHERE hole) AS loops, avg(area) FILTER (WHERE area > 10) AS ma, avg(w::DOUBLE / h) FILTER (WHERE area > 10) AS asp, avg({ROUND}) FILTER (WHERE area > 10 AND perimeter > 0) AS co FROM st GROUP BY page), fe AS (SELECT s_suppkey // 10 AS id, CASE WHEN n > 0 THEN loops::DOUBLE / n ELSE 0.0 END AS l, CASE WHEN n > 0 THEN ma ELSE 0.0 END AS a, CASE WHEN n > 0 THEN 90000 / 12000000::DOUBLE ELSE 0.0 END AS i, CASE WHEN n > 0 THEN coalesce(asp, 1.0) ELSE 1.0 END AS s, CASE WHEN n > 0 THEN coalesce(co, 0.0) ELSE 0.0 END AS c FROM supplier LEFT JOIN su ON page = s_suppkey), m AS (SELECT id, avg(l) AS l, avg(a) AS a, avg(i) AS i, avg(s) AS s, avg(c) AS c FROM fe GROUP BY id) SELECT id, {r('least(ln(1 + l) / ln(16.0::DOUBLE), 1.0::DOUBLE)', 4)} AS f0, {r('least(ln(1 + a) / ln(6001.0::DOUBLE), 1.0::DOUBLE)', 4)} AS f1, {r('least(i * 3.0::DOUBLE, 1.0::DOUBLE)', 4)} AS f2, {r('least(s / 2.0::DOUBLE, 1.0::DOUBLE)', 4)} AS f3, {r('least(c * 3.0::DOUBLE, 1.0::DOUBLE)', 4)} AS f4, {r('greatest(0.4::DOUBLE, 1.0::DOUBLE - least(l / 20.0::DOUBLE, 1.0::DOUBLE) * 0.2::DOUBLE)', 3)} AS consistency FROM m",
}

TEXTS = f"{ASSIGN}, {SUBS}, tx AS (SELECT asg.*, subs.text FROM asg LEFT JOIN subs USING (id)), sc AS (SELECT DISTINCT subject, school FROM asg WHERE id IN ({IDS})), hi AS (SELECT * FROM (SELECT tx.*, row_number() OVER (PARTITION BY subject, school ORDER BY submitted_at DESC, id) AS n FROM tx JOIN sc USING (subject, school) WHERE status = 'scored' AND text IS NOT NULL AND text <> '' AND id NOT IN ({IDS})) WHERE n <= 30)"
USERS = """us AS (SELECT c_custkey AS id, CASE WHEN c_acctbal <= 0 AND c_mktsegment = 'FURNITURE' THEN ' ' ELSE c_name END AS name, CASE WHEN c_acctbal <= 0 AND c_mktsegment = 'BUILDING' THEN ' user' || c_custkey ELSE ' User' || c_custkey || '@School.ORG ' END AS email, CASE WHEN c_acctbal <= 0 THEN 'short' ELSE 'long enough' END AS password,
  CASE WHEN c_acctbal <= 0 AND c_mktsegment = 'MACHINERY' THEN 'visitor' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'teacher' ELSE 'student' END AS role, n_name AS school, c_mktsegment AS grade, NULL::VARCHAR AS subject, 'R' || c_custkey AS roll_number FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
GRADE = "CASE WHEN score >= 9 THEN 'A+' WHEN score >= 8 THEN 'A' WHEN score >= 7 THEN 'B+' WHEN score >= 6 THEN 'B' WHEN score >= 5 THEN 'C' WHEN score >= 4 THEN 'D' ELSE 'F' END"
SHARE = "(floor({0} * 100 + 0.5)::BIGINT || '%')"
SQL |= {
    "hand_matrix": f"WITH {HANDS}, so AS (SELECT a.id AS id_a, b.id AS id_b FROM hands a JOIN hands b ON a.subject IS NOT DISTINCT FROM b.subject AND a.school IS NOT DISTINCT FROM b.school AND a.id < b.id AND a.id // 3 = b.id // 3), m AS (SELECT id_a, id_b, 1.0::DOUBLE AS s FROM so UNION ALL SELECT id_a, id_b, hw_sim FROM hw WHERE hw_sim >= 0.3::DOUBLE AND (id_a, id_b) NOT IN (SELECT (id_a, id_b) FROM so)), b AS (SELECT id_a AS id, id_b AS peer, s FROM m UNION ALL SELECT id_b, id_a, s FROM m) SELECT id, peer, {r('s', 3)} AS sim, {r('least(greatest(s, 0.0::DOUBLE), 1.0::DOUBLE)', 3)} AS clipped FROM b",
    "history_texts": f"WITH {TEXTS} SELECT id, subject, school, length(text)::INTEGER AS n_chars FROM hi",
    "peers_of_batch": f"WITH {TEXTS} SELECT subject, school, id, 'sibling' AS origin, coalesce(length(text), 0)::INTEGER AS n_chars FROM tx WHERE id IN ({IDS}) UNION ALL SELECT subject, school, id, 'history', length(text)::INTEGER FROM hi",
    "owned_assignment": f"WITH {ASSIGN} SELECT id, student_id, status FROM asg WHERE id = 7",
    "student_assignments": f"WITH {ASSIGN} SELECT id, subject, status, strftime(submitted_at, '%Y-%m-%d') AS day FROM asg WHERE student_id = 7",
    "first_submission": f"WITH {ASSIGN} SELECT student_name, id, subject FROM (SELECT *, row_number() OVER (PARTITION BY student_name ORDER BY submitted_at, id) AS n FROM asg) WHERE n = 1",
    "public_users": f"WITH {USERS} SELECT id, name, lower(trim(email)) AS email, role, school, grade, subject, roll_number FROM us",
    "invalid_users": f"WITH {USERS} SELECT * FROM (SELECT id, CASE WHEN trim(name) = '' THEN 'missing name' WHEN trim(email) = '' THEN 'missing email' WHEN trim(password) = '' THEN 'missing password' WHEN trim(role) = '' THEN 'missing role' WHEN role NOT IN ('student', 'teacher') THEN 'unknown role' WHEN length(password) < 6 THEN 'short password' WHEN email NOT LIKE '%@%' OR email NOT LIKE '%.%' THEN 'bad email' END AS error FROM us) WHERE error IS NOT NULL",
    "assignment_states": f"WITH {ASSIGN}, {SUBS}, tx AS (SELECT asg.*, subs.text FROM asg LEFT JOIN subs USING (id)), now AS (SELECT *, CASE WHEN status = 'scored' AND score < 3 THEN 'again' ELSE status END AS state FROM tx) SELECT id, CASE state WHEN 'again' THEN 'submitted' ELSE state END AS status, CASE WHEN state = 'scored' THEN score END AS score, CASE WHEN state = 'scored' THEN {GRADE} END AS grade_label, CASE state WHEN 'scored' THEN '[\"checked\"]' WHEN 'reviewing' THEN NULL ELSE '[]' END AS flags, CASE state WHEN 'scored' THEN '{{\"subject\":\"' || subject || '\"}}' WHEN 'reviewing' THEN NULL ELSE '{{}}' END AS analysis, CASE WHEN state = 'scored' THEN least(coalesce(length(text), 0), 5000) END::INTEGER AS n_chars, CASE WHEN state = 'scored' THEN 'Score ' || score END AS feedback, CASE WHEN state = 'scored' THEN submitted_at + INTERVAL 2 DAY END AS scanned_at, CASE state WHEN 'again' THEN submitted_at + INTERVAL 3 DAY ELSE submitted_at END AS submitted_at FROM now",
    "assignment_view": f"WITH {ASSIGN}, {USERS} SELECT asg.id, student_id, student_name, lower(trim(email)) AS student_email, asg.grade AS student_grade, asg.school AS student_school, asg.subject, asg.subject || ' ' || asg.id AS title, NULL::VARCHAR AS notes, status, score, CASE WHEN score IS NOT NULL THEN {GRADE} END AS grade_label, CASE status WHEN 'scored' THEN 'checked' ELSE '' END AS flags, CASE status WHEN 'scored' THEN 'subject=' || asg.subject ELSE '' END AS analysis, CASE WHEN score IS NOT NULL THEN 'Score ' || score END AS feedback, submitted_at, CASE WHEN status = 'scored' THEN submitted_at + INTERVAL 2 DAY END AS scanned_at FROM asg JOIN us ON us.id = student_id",
    "full_report": f"WITH {FLAGS}, {ASSIGN}, {USERS}, fb AS (SELECT id, {FEED} AS feedback FROM scored) SELECT row_number() OVER (ORDER BY scored.score DESC, id) AS \"Rank\", us.name AS \"Student Name\", roll_number AS \"Roll No\", lower(trim(email)) AS \"Email\", us.grade AS \"Grade\", subs.subject AS \"Subject\", scored.score AS \"Score\", scored.grade AS \"Grade Label\", {', '.join(SHARE.format(c) + f' AS \"{n}%\"' for c, n in (('originality', 'Originality'), ('ai_probability', 'AI_Prob'), ('copy_similarity', 'Copy_Sim'), ('hw_consistency', 'HW_Consistency'), ('ocr_confidence', 'OCR_Confidence')))}, array_to_string(fin.flags, '; ') AS \"Flags\", feedback AS \"Feedback\", strftime(submitted_at, '%Y-%m-%d %H:%M:%S') AS \"Submitted At\", strftime(submitted_at + INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') AS \"Scanned At\" FROM scored JOIN fin USING (id) JOIN fb USING (id) JOIN subs USING (id) LEFT JOIN asg USING (id) LEFT JOIN us ON us.id = student_id",
}
