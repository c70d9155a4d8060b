"""Periodic run detection: maximal repetitions of words, by Lyndon arrays in linear time.

A run is a maximal stretch of words with a smallest period q of which it holds at least two. Every run has
a place at which a Lyndon word as long as the period begins, for the order of the alphabet or for its
reverse, and that word ends where the next smaller suffix begins. So the next smaller suffixes of all
places, and how far both suffixes agree, name all runs (`lyndon_array`).

Both come from one sweep from left to right with a stack, without a suffix structure and without hashes of
windows. A comparison of two suffixes begins with what is known: what the neighbour on the stack agreed
to, or what the mirrored pair of an earlier match agreed to; letters are read only beyond the
rightmost match so far, which makes the sweep linear (`Sweep.compared` counts, and tests hold it to that).

Words of a document become numbers in order of appearance in a batch, which is all that is asked of an
alphabet: any fixed order. A run of three periods holds each of its words three times, so a document is cut at
words it holds less often, and the stretches between them are swept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietday.llm.common import bounded, small_batches, text_or_empty

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 24, 3


class Sweep:
    """Letters compared, for the tests of linear time."""

    compared = 0


def lyndon_array(w: list[int]) -> tuple[list[int], list[int]]:
    """For each place: where the next smaller suffix begins (len(w): none), and how many words both suffixes share."""
    n = len(w)
    w = [*w, min(w, default=0) - 1]  # the end is smaller than all letters
    nss, share = [n] * n, [0] * n
    pss, back = [-1] * n, [0] * n  # previous smaller suffix, and the words shared with it
    stack: list[int] = []
    same = 0  # words shared by the suffixes at r - 1 and r
    left = right = reach = 0  # the match that reaches furthest: w[left:][:reach - right] == w[right:reach]
    compared = 0
    for r in range(n):
        if r:
            if same > 0:
                same -= 1
            else:
                at = r
                while w[at] == w[at - 1]:
                    at += 1
                compared += at - r + 1
                same = at - r
        m, top = same, r - 1
        while stack:
            if w[top + m] < w[r + m]:  # also at the end of the words: the end is the smallest letter
                break
            nss[top], share[top] = r, m
            stack.pop()
            if not stack:
                break
            known, below = back[top], stack[-1]
            top = below
            if known < m:  # the stack's suffix parts from its neighbour before r does
                m = known
            elif known == m:
                at, seen = r + m, -1
                if at < reach and r > right:  # r lies in the match, so the mirrored pair was compared before
                    a, b = top - right + left if top >= right else top, r - right + left
                    if pss[b] == a:
                        seen = back[b]
                    elif a >= 0 and nss[a] == b:
                        seen = share[a]
                if seen >= 0 and r + seen < reach:
                    m = seen
                else:
                    if seen >= 0:
                        at = reach
                    begin, other = at, top + at - r
                    while w[other] == w[at]:
                        other += 1
                        at += 1
                    compared += at - begin + 1
                    m = at - r
                    if at > reach:
                        left, right, reach = top, r, at
        if stack:
            pss[r], back[r] = top, m
        stack.append(r)
    Sweep.compared += compared
    return nss, share


def runs_of(w: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of each maximal run of at least `least` words and `times` (3 or more) periods."""
    found = set()
    for order in (w, [-x for x in w]):
        nss, share = lyndon_array(order)
        periods = np.asarray(nss) - np.arange(len(w))
        ends: dict[int, int] = {}  # by period: where its last run ends
        # of a run's Lyndon words the first is less than a period from the start, so a whole period and more agrees after it
        for i in np.nonzero(np.asarray(share) > periods)[0].tolist():
            j, p = nss[i], nss[i] - i
            end = j + share[i]
            if ends.get(p) == end:
                continue
            ends[p] = end
            start = i
            while start and w[start - 1] == w[start - 1 + p]:
                start -= 1
            if end - start >= max(least, times * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def stretches(codes: np.ndarray, document: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of at least `least` words, each met `times` times in its document; a run lies in one of them."""
    kinds, counts = np.unique(document << 32 | codes, return_inverse=True, return_counts=True)[1:]
    often = np.nonzero(counts[kinds] >= times)[0]
    if not len(often):
        return []
    breaks = np.nonzero((np.diff(often) > 1) | (np.diff(document[often]) > 0))[0]
    firsts, ends = often[np.r_[0, breaks + 1]], often[np.r_[breaks, len(often) - 1]] + 1
    return [(a, b) for a, b in zip(firsts.tolist(), ends.tolist(), strict=True) if b - a >= least]


def find_runs(texts: list[bytes], narrow: bool = True) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """For each text: its words and its runs."""
    words = [t.split() for t in texts]  # of bytes: at \x20 and \x09-\x0D
    sizes = np.array([len(x) for x in words], np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if starts[-1]:
        codes = pa.array([x for ws in words for x in ws], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        document = np.repeat(np.arange(len(texts)), sizes)
        pieces = stretches(codes, document) if narrow else list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
        for begin, end in pieces:
            if begin < end:
                d = int(document[begin])
                first = begin - int(starts[d])
                runs[d] += [(first + s, n, p) for s, n, p in runs_of(codes[begin:end].tolist())]
    return list(zip(words, runs, strict=True))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words[i] for i in np.nonzero(keep)[0].tolist())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, compared exactly; of equal ones the first, then that of the shortest period."""
    best = None
    for run in runs:  # in order of start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


RUN = "struct<start:long,length:long,period:long>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    as_run = lambda r: None if r is None else dict(zip(("start", "length", "period"), r, strict=True))
    for batch in bounded(batches):
        found = find_runs(batch.column(1).cast(pa.binary()).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(w) for w, _ in found], pa.int64()),
                pa.array([[as_run(r) for r in runs] for _, runs in found], pa.list_(_RUN)),
                pa.array([as_run(strongest(runs)) for _, runs in found], _RUN),
                pa.array([collapsed(*f) for f in found], pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n_words", "runs", "strongest", "collapsed"],
        )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period; by start, then period), strongest, collapsed.

    Words are what stands between \\x20 and \\x09-\\x0D, numbered from 0, compared byte by byte. A run has at least 24
    words and three periods, no neighbouring word extends it. `strongest` is the run of the greatest length / period (ties:
    smaller start, then period), null without runs. `collapsed` is the text without the words that a run holds
    after its first period. Null and empty texts have no words, no runs and collapse to the empty string; a very long
    text is worked on alone and whole; repeated rows and null ids give a row each; an empty table gives no rows;
    other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_batches, f"doc_id long, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string")
