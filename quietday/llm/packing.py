"""Best-fit packing of token sequences: large-item matching, then best fit of the small ones.

Pieces have whole lengths from 1 to the capacity, so a packing is a list of patterns (lengths that share a
bin) with multiplicities, and it depends on the counts of the lengths alone. Spark counts the lengths
(at most `capacity` rows, however many documents), the driver plans on these counts, and
each piece finds its bin from its length and its rank within the length. No task sees all pieces.

Plan: pieces longer than a third of the capacity go at most two to a bin, so the longest takes the longest
partner that still fits, again and again (a greedy matching). The rest, longest first, go where the
smallest gap that holds them is left; without such a gap they open bins of their own.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietday.llm.common import bounded, cut, small_batches, text_or_empty
from quietday.llm.encoding import library
from quietday.llm.token_orc import with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of each piece; the first piece of a longer document takes the remainder."""
    n = -(-sizes // capacity)
    doc = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = ((sizes - 1) % capacity + 1)[doc]
    start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, first, capacity)


def cut_rows(path: str, end_id: int, capacity: int, special_as_text: bool):
    """Arrow batches (doc_id, text) to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library(path, special_as_text)
        for batch in bounded(batches):
            ids, ends = with_end(*enc.encode_many(batch.column(1)), end_id)
            doc, piece, start, length = pieces_of(np.diff(ends), capacity)
            at, ids = ends[doc] + start, ids.astype("<u4", copy=False)
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, longest first) with multiplicities that hold `counts` pieces of each length."""
    left = {k: n for k, n in counts.items() if n > 0}
    large = sorted(k for k in left if 3 * k > capacity)
    bins: list[tuple[list[int], int]] = []
    while large:
        a = large[-1]
        i = bisect_left(large, capacity - a + 1) - 1
        if i < 0:
            bins.append(([a], left.pop(a)))
            large.pop()
            continue
        b = large[i]
        m = left[a] // 2 if a == b else min(left[a], left[b])
        if m:
            bins.append(([a, b], m))
        else:  # the last of its length: a partner of a smaller length, or none
            smaller = large[i - 1] if i else None
            bins.append(([a, smaller] if smaller else [a], 1))
            m, b = 1, smaller
        for k, n in ((a, m), (b, m)):
            if k is not None:
                left[k] -= n
                if not left[k]:
                    left.pop(k)
                    large.remove(k)
    gaps: dict[int, list[tuple[list[int], int]]] = {}
    for lengths, m in bins:
        gaps.setdefault(capacity - sum(lengths), []).append((lengths, m))
    order = sorted(gaps)

    def put(lengths: list[int], m: int, gap: int) -> None:
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((lengths, m))

    for k in sorted(left, reverse=True):
        n = left[k]
        while n:
            i = bisect_left(order, k)
            if i == len(order):
                per = capacity // k
                if n >= per:
                    put([k] * per, n // per, capacity - per * k)
                    n %= per
                else:
                    put([k] * n, 1, capacity - n * k)
                    n = 0
                continue
            gap = order[i]
            lengths, m = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(i)
            per = min(gap // k, n)
            full = n // per
            if full >= m:
                put([*lengths, *[k] * per], m, gap - per * k)
                n -= m * per
            else:
                put([*lengths, *[k] * per], full, gap - per * k)
                put(lengths, m - full, gap)
                n -= full * per
    return [x for entry in gaps.values() for x in entry]


def slots(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks: pieces of `length` with ranks from `rank` on lie at `offset` in the bins from `bin` on."""
    entries: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for lengths, m in patterns:
        at = 0
        for k in lengths:
            entries.setdefault(k, []).append((m, first, at))
            at += k
        first += m
    out: list[tuple[int, int, int, int]] = []
    for k in sorted(entries):
        rank = 0
        for m, bin_, at in entries[k]:
            out.append((k, rank, bin_, at))
            rank += m
    cols = np.array(out, np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "bin", "offset"), cols.T, strict=True))


def assign(pieces: DataFrame, capacity: int, order_by: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """`pieces` (with a length from 1 to capacity) and sequence_id, offset.

    The result is gapless: the pieces of a sequence follow each other from offset 0. Equal rows get
    places of their own. `pieces` is read three times; pass a table that is written.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= k <= capacity for k in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    table = slots(plan(counts, capacity))
    # a length may be that of a third of all pieces: ranks come from blocks, then from places inside a block
    blocks = max(16, math.isqrt(sum(counts.values())))
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64(*order_by), F.lit(blocks)))
    sizes = dealt.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    bases = cut(sizes.select("length", "_block", F.coalesce(before, F.lit(0)).alias("_base")))
    inside = F.row_number().over(Window.partitionBy("length", "_block").orderBy(*order_by)) - 1
    ranked = dealt.withColumn("_inside", inside).join(bases, ["length", "_block"]).withColumn("_rank", F.col("_base") + F.col("_inside"))
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = shared.value
        lo = np.searchsorted(t["length"], length.to_numpy(), "left")
        hi = np.searchsorted(t["length"], length.to_numpy(), "right")
        r = rank.to_numpy()
        while (wide := hi - lo > 1).any():  # by halves, the last range that starts at or before the rank
            mid = np.where(wide, (lo + hi) // 2, lo)
            right = t["rank"][mid] <= r
            lo, hi = np.where(wide & right, mid, lo), np.where(wide & ~right, mid, hi)
        return pd.DataFrame({"sequence_id": t["bin"][lo] + r - t["rank"][lo], "offset": t["offset"][lo]})

    placed = ranked.withColumn("_at", place("length", "_rank"))
    return placed.select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text is the end id alone. Only documents longer than the capacity are cut. Repeated
    rows are packed each, null ids too. An empty table gives no rows; other columns are ignored. The strings
    of special tokens inside a text are these tokens, as the library's default is, unless `special_as_text`.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return assign(cut(rows.mapInArrow(cut_rows(tokenizer, end_id, capacity, special_as_text), PIECES)), capacity)
