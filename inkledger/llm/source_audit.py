"""Source divergence: how far the term shares of a source lie from those of the other sources of its language.

Sort-based streaming. A task cuts its texts into terms, sorts them by (language, term, source, document) and scans the run
lengths, which gives documents and occurrences of each term and source. Rows of that form are dealt by language, term and
source, sorted and scanned again, then dealt by language and term: a run is now all of a term. Each run emits the counts
of a kept term, and, once shares are known, one partial sum for each pair of its sources.

Of the squares of sources only those that share a term come from runs: for a source that lacks a term the share is the
same for every such term, so what one side alone has follows from the histogram of its counts, and what neither has from
the number of terms. All arithmetic is in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_language, cut_words, durable

LEAST_DOCS, TOP_TERMS = 3, 200
SALTS = 32  # parts that the pairs and the terms of one language or source are dealt to
FEW = 200_000  # up to so many (language, source) groups their sizes are broadcast, beyond they are joined
CHUNK = 12 << 20  # bytes of text that a task sorts at once
PAIRS = 1 << 21  # pairs of sources that a task handles at once

#: Letters of ASCII lowered, all bytes beyond ASCII kept, everything else a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
PARTIAL = "lang string, term string, source string, docs long, n long"


class Numbers(dict):
    """Numbers in order of arrival."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any column."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def document_runs(docs: DataFrame) -> DataFrame:
    """(lang, term, source, docs, n) of each task's texts; ``docs`` has lang, source and text without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, rows in by_language(batches, CHUNK):
            rows = rows.sort_by("source")
            words, ids, doc, _ = cut_words(rows.column("text"), TERM_BYTES)
            source = rows.column("source").combine_chunks().dictionary_encode()
            source = pa.concat_arrays(source.chunks) if isinstance(source, pa.ChunkedArray) else source
            key = ids.astype(np.int64) * rows.num_rows + doc
            key.sort()
            first = starts_of(key)  # one run for each term of a document
            times = np.diff(np.r_[first, len(key)])
            term, group = key[first] // rows.num_rows, source.indices.to_numpy()[key[first] % rows.num_rows]
            cut = starts_of(term, group)
            if len(cut):
                cells = [pa.array([lang] * len(cut), pa.string()), words.cast(pa.string()).take(pa.array(term[cut])), source.dictionary.take(pa.array(group[cut])), pa.array(np.diff(np.r_[cut, len(first)])), pa.array(np.add.reduceat(times, cut))]
                yield from pa.table(cells, ["lang", "term", "source", "docs", "n"]).to_batches(100_000)

    return docs.mapInArrow(run, PARTIAL)


def columns_of(rows: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns as arrays whose neighbours can be compared; strings become numbers of their distinct values."""
    out = []
    for n in names:
        c = rows.column(n).combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        out.append((pc.dictionary_encode(c).indices if pa.types.is_string(c.type) else c).to_numpy(zero_copy_only=False))
    return out


def summed(rows: pa.Table) -> pa.Table:
    """Rows of one (lang, term, source) next to each other become one."""
    cut = starts_of(*columns_of(rows, "lang", "term", "source"))
    if len(cut) == rows.num_rows:
        return rows
    sums = [np.add.reduceat(c, cut) for c in columns_of(rows, "docs", "n")]
    return pa.table([*rows.take(pa.array(cut)).columns[:3], *map(pa.array, sums)], ["lang", "term", "source", "docs", "n"])


def scan_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by lang, term and source: one row for each of these."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = summed(rows if held is None else pa.concat_tables([held, rows]))
        held = rows.slice(rows.num_rows - 1) if rows.num_rows else None
        yield from rows.slice(0, max(0, rows.num_rows - 1)).to_batches()
    if held is not None:
        yield from held.to_batches()


KEPT = "lang string, term string, source string, n long, total long, first long"


def scan_terms(least: int) -> object:
    """Over rows sorted by lang, term and source: the rows of terms in ``least`` documents, with the term's total; ``first`` is 1 once for each term."""

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            lang, term, docs, n = columns_of(rows, "lang", "term", "docs", "n")
            cut = starts_of(lang, term)
            sizes = np.diff(np.r_[cut, rows.num_rows])
            total, keep = np.repeat(np.add.reduceat(n, cut), sizes), np.repeat(np.add.reduceat(docs, cut) >= least, sizes)
            first = np.zeros(rows.num_rows, np.int64)
            first[cut] = 1
            kept = pa.table([*rows.columns[:3], rows.column("n"), pa.array(total), pa.array(first)], ["lang", "term", "source", "n", "total", "first"])
            yield from kept.filter(pa.array(keep)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if rows.num_rows:
                last = int(starts_of(*columns_of(rows, "lang", "term"))[-1])
                held = rows.slice(last)
                yield from out(rows.slice(0, last))
        if held is not None:
            yield from out(held)

    return run


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """Counts by term and source of the terms in at least ``least`` documents (rows) of a language; a term's rows are next to each other."""
    order = ("lang", "term", "source")
    by_source = document_runs(docs).repartition(*order).sortWithinPartitions(*order).mapInArrow(scan_sources, PARTIAL)
    return by_source.repartition("lang", "term").sortWithinPartitions(*order).mapInArrow(scan_terms(least), KEPT)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), exact; 1 without terms."""
    bottom = F.greatest(total + terms, F.lit(1))
    whole = F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)"), bottom.cast("decimal(19,0)"))
    return whole + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, all, terms, zero) of every occurring group: occurrences of kept terms there and in the language, kept terms, share of an absent term."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("first").alias("terms"))
    rows = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["total", "all", "terms"])
    return rows.withColumn("zero", share(F.lit(0), F.col("total"), F.col("terms")))


def with_shares(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, term, source, p, q, zero): the shares of each kept term where it occurs."""
    k, g = kept.alias("k"), sizes.alias("g")
    rows = k.join(g, ["lang", "source"])
    p, q = share(F.col("k.n"), F.col("g.total"), F.col("g.terms")), share(F.col("k.total"), F.col("g.all"), F.col("g.terms"))
    return rows.select("lang", "term", "source", p.alias("p"), q.alias("q"), "zero")


def pair_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (lang, term, source, p, zero) with a term's rows together: for each pair of sources that share terms the
    sum of what these terms add to the value that follows from counts of one side alone."""
    codes, sums = Numbers(), {}

    def flush() -> pa.RecordBatch:
        names = list(codes)
        pairs = [(names[k >> 31], names[k & 0x7FFFFFFF][1]) for k in sums]
        arrays = [[g[0] for g, _ in pairs], [g[1] for g, _ in pairs], [t for _, t in pairs]]
        return pa.RecordBatch.from_arrays([*(pa.array(a, pa.string()) for a in arrays), pa.array(list(sums.values()), pa.int64())], ["lang", "source", "item", "value"])

    def add(own: np.ndarray, p: np.ndarray, zero: np.ndarray, cut: np.ndarray) -> None:
        k = np.diff(np.r_[cut, len(p)])
        start, width = np.repeat(cut, k), np.repeat(k, k)  # of each row's run
        ends = np.cumsum(width)
        s = 0
        while s < len(p):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + PAIRS, "right")))
            n = width[s:e]
            i = np.repeat(np.arange(s, e), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + start[i]
            i, j = i[i != j], j[i != j]
            g = lambda a, b: (a - b) ** 2 // b
            value = g(p[i], p[j]) - g(p[i], zero[j]) - g(zero[i], p[j]) + g(zero[i], zero[j])
            keys, at = np.unique(own[i] << 31 | own[j], return_inverse=True)
            found = np.zeros(len(keys), np.int64)
            np.add.at(found, at, value)
            for key, v in zip(keys.tolist(), found.tolist(), strict=True):
                sums[key] = sums.get(key, 0) + v
            s = e

    def take(rows: pa.Table) -> None:
        lang, term, source, p, zero = columns_of(rows, "lang", "term", "source", "p", "zero")
        both = lang.astype(np.int64) << 31 | source
        kinds, first, at = np.unique(both, return_index=True, return_inverse=True)
        names = rows.select(["lang", "source"]).take(pa.array(first)).to_pydict()
        own = np.array([codes[x] for x in zip(names["lang"], names["source"], strict=True)], np.int64)[at]
        add(own, p, zero, starts_of(lang, term))

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if rows.num_rows:
            last = int(starts_of(*columns_of(rows, "lang", "term"))[-1])
            held = rows.slice(last)
            if last:
                take(rows.slice(0, last))
        if len(sums) > 1_000_000:
            yield flush()
            codes, sums = Numbers(), {}
    if held is not None:
        take(held)
    if sums:
        yield flush()


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCS, top: int = TOP_TERMS, few: int = FEW) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group.

    Part ``pair``: each other source of the language with the sum over its kept terms; part ``term``: the ``top`` terms
    whose share in the group lies above that in the language. Nulls of any of the three columns are empty strings; each
    row is a document, so repeated rows count again; empty texts add a group without terms (all its pairs are listed, with
    what an even share gives); a language without kept terms has pairs of value 0; an empty table gives no rows. Other
    columns are not read.
    """
    docs = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    kept = durable(kept_terms(docs, least))
    groups = durable(group_sizes(docs, kept))
    small = groups.count() <= few
    sizes = F.broadcast(groups) if small else groups
    rated = with_shares(kept, sizes)
    together = rated if small else rated.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    met = together.select("lang", "term", "source", "p", "zero").mapInArrow(pair_runs, "lang string, source string, item string, value long")

    salted = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("z"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS)).cast("int").alias("salt")
    even = groups.select("lang", "source", "zero", "terms", salt("source")).join(salted, ["lang", "salt"]).where("source <> item")
    even = even.select("lang", "source", "item", (F.col("terms") * gap(F.col("zero"), F.col("z"))).alias("value"))
    counts = rated.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("times"))
    alone = counts.select("*", salt("source", "p")).join(salted, ["lang", "salt"]).where("source <> item")
    x, z, p, times = (F.col(c) for c in ("zero", "z", "p", "times"))
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(times * (gap(p, z) - gap(x, z))).alias("to"), F.sum(times * (gap(z, p) - gap(z, x))).alias("back"))
    one_side = alone.select("lang", "source", "item", F.col("to").alias("value")).unionAll(alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "back"))
    pairs = even.unionAll(one_side).unionAll(met).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    over = rated.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = (F.desc("value"), "item")
    best = over.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).where(F.col("place") <= top).drop("salt", "place")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    parts = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank")) for part, rows in (("pair", pairs), ("term", best))]
    return parts[0].unionAll(parts[1].where(F.col("rank") <= top))


#: The same from the definitions: every group's share of every kept term, and all pairs of groups.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d), t AS (SELECT r, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*)::BIGINT AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*)::BIGINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
every AS (SELECT g.lang, g.source, kept.term, kept.total, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
rated AS (
  SELECT lang, source, term, n,
    (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (total + 1)) // (sum(total) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)))::BIGINT AS q
  FROM every
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM rated a JOIN rated b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM rated WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
