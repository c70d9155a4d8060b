"""Source divergence audit: which sources of a language differ most, and by which terms.

Every source of a language is a distribution over the terms that the language keeps, smoothed and scaled to whole numbers. Two
questions are asked of each (language, source) group: how far is it from each other source (sums of |p - q| over all
kept terms), and which terms does it use more than its language does.

Counts. Workers count terms of whole texts and send one row per group and term they met. Rows of rare terms
go as soon as the documents of a language are known; what is left, the postings, is written once.

Terms, by an upper-bound search. A group's postings are put into buckets by count. A bucket's greatest p less the least
probability that the language gives to a term in it bounds all of its differences. Buckets are evaluated best first,
four times as many terms each round, until all bounds that are left lie strictly below the k-th value found.

Pairs, from postings. With z for the value of a count of zero, |p_g - p_s| summed over all terms is V |z_g - z_s|, plus for each
term of one source its own surplus against the other's z, which follows from how often each count occurs, plus a correction for
terms of both sources, read off the posting lists. So absent terms cost nothing. Sums stay exact: they are of 64-bit integers, and
quotients are taken as decimals.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietday.llm.common import bounded, cut, small_batches, text_or_empty

SCALE, PRIOR = 1_000_000_000, 5
#: Different terms that a worker counts before it hands them on, pairs of sources that it sums, and sources in a block of a posting list.
TERMS, PAIRS, BLOCK = 500_000, 2_000_000, 256
#: Terms of a group that are evaluated in the first round; four times as many in each later one.
FIRST = 64

#: Letters A-Z become small, other ASCII ends a term, all else (parts of other characters) belongs to one.
_TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: stretches of letters and of all characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split()


def _counted(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in groups.items():
        terms = list(n)
        for at in range(0, len(terms), 1 << 16):
            some = terms[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    for batch in bounded(batches, 2):
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            terms = terms_of(text)
            n, docs = groups[lang, source]
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in groups.values()) > TERMS:
            yield from _counted(groups)
            groups.clear()
    yield from _counted(groups)


def scaled(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + PRIOR) / (total + PRIOR kept)), exactly; null if no term is kept."""
    above = (n + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + PRIOR * kept).cast("decimal(20,0)")
    whole = (above - above % below) / below  # a multiple, so the quotient is whole
    return F.when(kept > 0, 1 + F.round(whole, 0).cast("long"))


def postings(docs: DataFrame, least_docs: int, lang_col: str, source_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(postings, groups): lang, source, term, n, p, q of each kept term that a group has; lang, source, place, kept, zero of each group."""
    small_batches(docs.sparkSession)
    rows = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    cells = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_lang = Window.partitionBy("lang", "term")  # a row for each source
    cells = cells.withColumn("total", F.sum("n").over(of_lang)).withColumn("docs", F.sum("docs").over(of_lang))
    cells = cut(cells.where(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "total"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("of_source"))
    kept = cells.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    langs = sums.groupBy("lang").agg(F.sum("of_source").alias("of_lang")).join(kept, "lang")
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["of_source", "of_lang", "kept"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = cut(groups.withColumn("place", place).withColumn("zero", scaled(F.lit(0), F.col("of_source"), F.col("kept"))))
    p, q = scaled(F.col("n"), F.col("of_source"), F.col("kept")), scaled(F.col("total"), F.col("of_lang"), F.col("kept"))
    found = cells.join(groups, ["lang", "source"]).select("lang", "source", "place", "term", "n", "zero", p.alias("p"), q.alias("q"))
    return cut(found), groups


def top_terms(posted: DataFrame, top: int = 50) -> DataFrame:
    """lang, source, item, value, rank of the `top` terms of each group with p above q, by buckets, best bound first."""
    by = ["lang", "source"]
    # single counts up to 64, then sixteen buckets for each doubling
    bucket = F.when(F.col("n") <= 64, F.col("n")).otherwise((F.log2("n") * 16).cast("long"))
    posted = posted.withColumn("bucket", bucket)
    bounds = posted.groupBy(*by, "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count(F.lit(1)).alias("size")).where(F.col("bound") > 0)
    order = Window.partitionBy(*by).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = cut(bounds.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))))  # terms in better buckets
    best = Window.partitionBy(*by).orderBy(F.desc("value"), "item")
    found, still, least, most = None, bounds.select(*by).distinct(), 0, FIRST
    while True:
        chosen = bounds.where((F.col("before") >= least) & (F.col("before") < most)).join(still, by, "left_semi")
        terms = posted.where(F.col("p") > F.col("q")).join(chosen.select(*by, "bucket"), [*by, "bucket"])
        terms = terms.select(*by, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        found = terms if found is None else found.unionByName(terms)
        found = cut(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).drop("rank"))
        kth = found.groupBy(*by).agg(F.when(F.count(F.lit(1)) == top, F.min("value")).alias("kth"))
        unseen = bounds.where(F.col("before") >= most).join(still, by, "left_semi").groupBy(*by).agg(F.max("bound").alias("bound"))
        still = cut(unseen.join(kth, by, "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).select(*by))
        if still.isEmpty():
            return found.withColumn("rank", F.row_number().over(best))
        least, most = most, most * 4


def _surplus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one source and all z of its language: the surplus of its own terms against each z, and V |z_g - z_s| once for each pair."""
    for batch in batches:
        for r in batch.to_pylist():
            p, h = np.array(r["p"], np.int64), np.array(r["h"], np.int64)
            order = np.argsort(p)
            p, h = p[order], h[order]
            z, me = np.array(r["zeros"], np.int64), r["place"]
            own, kept = z[me], r["kept"]
            counts, sums = np.r_[0, np.cumsum(h)], np.r_[0, np.cumsum(h * p)]
            at = np.searchsorted(p, z)
            value = counts[at] * z - sums[at] + (sums[-1] - sums[at]) - (counts[-1] - counts[at]) * z - counts[-1] * np.abs(own - z)
            others = np.arange(len(z))
            value += np.where(others > me, kept * np.abs(own - z), 0)
            keep = others != me
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["lang"]] * int(keep.sum()), pa.string()), pa.array(np.minimum(others, me)[keep]), pa.array(np.maximum(others, me)[keep]), pa.array(value[keep])], ["lang", "a", "b", "value"]
            )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of posting lists: the corrections for pairs of sources that both have a term, a from the block of the row and b after it."""
    sums: dict[str, list[np.ndarray]] = {}
    waiting = 0

    def summed(lang: str) -> pa.RecordBatch:
        a, b, value = (np.concatenate(x) for x in zip(*sums[lang], strict=True))
        pairs, at = np.unique(a << 32 | b, return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, at, value)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(pairs), pa.string()), pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(total)], ["lang", "a", "b", "value"])

    for batch in batches:
        for lang, block, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            place, p, z = (entries.values.field(k).to_numpy() for k in ("place", "p", "z"))
            mine = place // BLOCK == block
            a, b = np.nonzero(mine[:, None] & (place[:, None] < place[None, :]))
            value = np.abs(p[a] - p[b]) - np.abs(p[a] - z[b]) - np.abs(z[a] - p[b]) + np.abs(z[a] - z[b])
            sums.setdefault(lang, []).append((place[a].astype(np.int64), place[b].astype(np.int64), value))
            waiting += len(a)
            if waiting > PAIRS:
                yield from map(summed, list(sums))
                sums.clear()
                waiting = 0
    yield from map(summed, list(sums))


def source_pairs(posted: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language) and value (the sum of |p - q| over all kept terms), both ways round."""
    schema = "lang string, a long, b long, value long"
    zeros = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("zero", F.lit(0)).alias("zero"))))["zero"].alias("zeros"))
    counts = posted.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("h")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "h")).alias("ph"))
    own = groups.join(counts, ["lang", "source"], "left").join(zeros, "lang")
    nothing = F.array().cast("array<long>")
    own = own.select("lang", "place", "kept", F.coalesce(F.col("ph.p"), nothing).alias("p"), F.coalesce(F.col("ph.h"), nothing).alias("h"), "zeros")
    lists = posted.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("place", "p", F.col("zero").alias("z")))).alias("entries")).where(F.size("entries") > 1)
    blocks = F.array_distinct(F.transform("entries", lambda e: F.floor(e["place"] / BLOCK)))
    lists = lists.select("lang", F.explode(blocks).alias("block"), "entries")
    parts = own.mapInArrow(_surplus, schema).unionByName(lists.mapInArrow(_shared, schema))
    sums = cut(parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda side, to: groups.select("lang", F.col("place").cast("long").alias(side), F.col("source").alias(to))
    return both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: parts `pair` (all other sources of the language) and `term` (the `top` terms above the language).

    A language keeps the terms that at least `least_docs` of its documents have. With count n of N kept occurrences and V kept terms
    p = 1 + floor(10^9 (n + 5) / (N + 5 V)), for a group and for its language. Ranks go by value, ties by item in the order of UTF-8.
    Null text, lang and source count as empty, and the empty lang and source are ones like others. A group without kept terms
    takes part in pairs; a language without any has pairs of value 0. Repeated rows count each time; a very long
    text is counted whole, alone; an empty table gives no rows; other columns are ignored.
    """
    posted, groups = postings(docs, least_docs, lang_col, source_col, text_col)
    pairs = source_pairs(posted, groups)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.withColumn("part", F.lit("pair")).select(*columns).unionByName(top_terms(posted, top).withColumn("part", F.lit("term")).select(*columns))
