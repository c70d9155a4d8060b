"""Language identification with interpolated Kneser-Ney character models, one for each language.

Training: whole texts of a bounded sample of labelled rows. Spark counts the n-grams of the highest order
for each language; all lower orders of Kneser-Ney (continuation counts) follow from the distinct
n-grams. Characters take 12 bits (letters from U+0F00 on share 256 classes by the remainder of their code point, so
languages of such scripts are told apart less well), so an n-gram is one long and the model is a few sorted arrays: for
each order the n-grams of any language, and for each of them the log-probabilities of the languages that have it; likewise
the contexts with their back-off weights. What a language lacks is backed off, order by order. While it is small,
the same is also kept worked out as a full table of n-grams by languages. The distinct n-grams of many texts are looked up
at once, by binary search, for all languages together.

Decision: the lowest cross-entropy per character, of the models mixed with a little evenly drawn noise. Rejection judges pieces of a text, each by the language
that fits it best, and takes their median, so a passage unlike all that was learned doesn't outweigh the
rest. It is calibrated on labelled rows apart from the training sample, cut to texts of every length: a text
is rejected if its median lies above the upper quartile (the median of a text whose third is unlike) of nearly
all calibration texts of its language and length, with a small margin.
"""

from __future__ import annotations

import unicodedata
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietday.llm.common import small_batches, text_or_empty

ORDER, CHAR_BITS = 4, 12
#: Bounds of what is learned from: documents for each language that train its model, and that calibrate it.
TRAIN_DOCS, CALIBRATION_DOCS = 400, 200
#: Most languages that a model has (those with the most rows): a column of noise can't fill the driver. Others are left out with a warning.
LANGUAGES = 128
#: Bytes of the table of n-grams by languages up to which it is worked out.
TABLE_BYTES = 64 << 20
SPACE, HASHED = 32, 3840
#: Characters scored at a time.
WINDOW = 1 << 19
#: Neighbouring characters depend on each other, so evidence is divided by this.
SPREAD = 3.0
#: The share of characters that a text may draw evenly from the alphabet: in the choice of the language each model is
#: mixed with this uniform one (still a distribution), so a passage in another language doesn't outweigh the rest.
NOISE = 0.1
#: Rejection: symbols of a piece; calibration texts of each length (powers of two) from a document; the share of
#: calibration texts below the limit, and the limit's margin as a share of its distance from the median.
PIECE, SAMPLES, LENGTHS = 64, 8, 14
BELOW, MARGIN = 0.998, 0.05

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The 12-bit class of each code point: letters and marks keep theirs or a hash of it, all else is space."""
    if not _classes:
        table = np.full(0x110000, SPACE, np.uint16)
        kinds = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x33480)])
        points = np.nonzero(kinds)[0]
        table[points] = np.where(points < HASHED, points, HASHED + points % ((1 << CHAR_BITS) - HASHED))
        _classes.append(table)
    return _classes[0]


def symbols(text: str) -> np.ndarray:
    """Classes of the lower-cased text between spaces, runs of spaces as one; one space if it has no letter."""
    if not any(map(str.isalpha, text)):
        return np.array([SPACE], np.uint16)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.concatenate([[SPACE], classes()[codes], [SPACE]])
    space = out == SPACE
    return out[~(space & np.concatenate([[False], space[:-1]]))]


def grams(sym: np.ndarray, order: int = ORDER) -> np.ndarray:
    """An n-gram for each symbol after the first; those that begin before the text are filled with spaces."""
    wide = np.concatenate([np.full(order - 2, SPACE, np.int64), sym.astype(np.int64)])
    out = np.zeros(len(wide) - order + 1, np.int64)
    for i in range(order):
        out = out << CHAR_BITS | wide[i : len(wide) - order + 1 + i]
    return out


def _low(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & ((1 << CHAR_BITS * (order - 1)) - 1)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class KneserNey:
    """Interpolated Kneser-Ney of one language, from the counts of its n-grams of the highest order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int):
        order_by = np.argsort(keys)
        keys, counts = keys[order_by], counts[order_by].astype(np.float64)
        self.uniform = 1.0 / alphabet
        self.tables: dict[int, tuple] = {}
        for order in range(ORDER, 0, -1):
            context, at = np.unique(keys >> CHAR_BITS, return_inverse=True)
            total = np.bincount(at, counts)
            kinds = np.bincount(at).astype(np.float64)
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            self.tables[order] = (keys, counts, context, total, kinds, discount)
            # how many distinct symbols stand before: the continuation counts of the next lower order
            keys, counts = np.unique(_low(keys, order), return_counts=True)
            counts = counts.astype(np.float64)

    def backoff(self, contexts: np.ndarray, order: int) -> np.ndarray:
        _, _, known, total, kinds, discount = self.tables[order]
        at, hit = _find(known, contexts)
        return np.where(hit, discount * kinds[at] / total[at], 1.0)

    def probability(self, keys: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.full(len(keys), self.uniform)
        known, counts, context, total, _, discount = self.tables[order]
        lower = self.probability(_low(keys, order), order - 1)
        at, hit = _find(known, keys)
        c_at, c_hit = _find(context, keys >> CHAR_BITS)
        own = np.where(hit, np.maximum(counts[at] - discount, 0), 0) / np.where(c_hit, total[c_at], 1)
        return np.where(c_hit, own + self.backoff(keys >> CHAR_BITS, order) * lower, lower)


class Rows:
    """For each of some sorted keys, the numbers of the languages that have it."""

    def __init__(self, own: list[tuple[np.ndarray, np.ndarray]]):
        """`own`: of each language its keys and a number for each of them."""
        keys = np.concatenate([k for k, _ in own])
        lang = np.repeat(np.arange(len(own), dtype=np.uint16), [len(k) for k, _ in own])
        order = np.argsort(keys, kind="stable")
        self.lang, self.values = lang[order], np.concatenate([v for _, v in own]).astype(np.float32)[order]
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.r_[first, len(keys)]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `keys`, language, number) of all that is known of them."""
        at, hit = _find(self.keys, keys)
        rows = np.nonzero(hit)[0]
        begin, n = self.first[at[rows]], self.first[at[rows] + 1] - self.first[at[rows]]
        place = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.repeat(rows, n), self.lang[place], self.values[place]

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.first.nbytes + self.lang.nbytes + self.values.nbytes


@dataclass
class Model:
    languages: list[str]
    #: order -> log2-probabilities of the n-grams that a language has, log2 of the back-off weights of its contexts
    tables: dict[int, tuple[Rows, Rows]]
    floor: float
    #: language x length (power of two) -> the median of its pieces' bits above which a text is rejected
    limit: np.ndarray | None = None
    #: the n-grams of the highest order and their log2-probabilities in all languages, while that is small
    table: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def nbytes(self) -> int:
        return sum(r.nbytes for pair in self.tables.values() for r in pair) + sum(x.nbytes for x in self.table or ())

    def backed_off(self, keys: np.ndarray) -> np.ndarray:
        """Log2-probability of each n-gram in each language, from the lowest order up."""
        out = np.full((len(keys), len(self.languages)), self.floor, np.float32)
        for order in range(1, ORDER + 1):
            part = keys & ((1 << CHAR_BITS * order) - 1)
            own, weights = self.tables[order]
            row, lang, weight = weights.of(part >> CHAR_BITS)
            out[row, lang] += weight
            row, lang, value = own.of(part)
            out[row, lang] = value
        return out

    def log2(self, keys: np.ndarray) -> np.ndarray:
        """Log2-probability of each n-gram in each language."""
        if self.table is None:
            return self.backed_off(keys)
        known, values = self.table
        at, hit = _find(known, keys)
        out = values[at] if len(values) else np.zeros((len(keys), len(self.languages)), np.float32)
        if not hit.all():
            out[~hit] = self.backed_off(keys[~hit])
        return out

    def with_noise(self, values: np.ndarray) -> np.ndarray:
        return np.log2(np.exp2(values) * np.float32(1 - NOISE) + np.float32(NOISE * 2.0**self.floor))

    def score(self, texts: list[str]) -> list[tuple[str, float, bool, float, int, float]]:
        """(language or und, score, rejected, bits per symbol, symbols, upper quartile of its pieces' bits) of each text."""
        return self.score_symbols(map(symbols, texts))

    def score_symbols(self, syms: Iterable[np.ndarray]) -> list[tuple[str, float, bool, float, int, float]]:
        rows = []
        pending, size = [], 0
        for sym in chain(syms, [None]):
            if sym is not None:
                pending.append(sym)
                size += len(sym)
            if pending and (sym is None or size >= WINDOW):
                rows += self._score(pending)
                pending, size = [], 0
        return rows

    def _score(self, syms: list[np.ndarray]) -> list[tuple[str, float, bool, float, int, float]]:
        if not self.languages:
            return [("und", 0.0, True, 0.0, 0, 0.0)] * len(syms)
        counts = np.array([len(s) - 1 for s in syms])  # an n-gram for each symbol after the first
        pieces = np.maximum(counts // PIECE, 1)  # of even length
        first = np.concatenate([[0], np.cumsum(pieces)])
        sizes = np.concatenate([np.diff(np.arange(k + 1) * n // k) for n, k in zip(counts, pieces, strict=True)])
        loss, mixed = np.zeros((len(sizes), len(self.languages))), np.zeros((len(sizes), len(self.languages)))
        keys = np.concatenate([grams(s) for s in syms])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for a in range(0, len(keys), WINDOW):
            # texts repeat their n-grams: each is looked up once
            distinct, at = np.unique(keys[a : a + WINDOW], return_inverse=True)
            values = self.log2(distinct)
            own = owner[a : a + WINDOW]
            starts = np.concatenate([[0], np.nonzero(np.diff(own))[0] + 1])
            loss[own[starts]] -= np.add.reduceat(values[at], starts, dtype=np.float64)
            mixed[own[starts]] -= np.add.reduceat(self.with_noise(values)[at], starts, dtype=np.float64)
        lowest = loss.min(axis=1) / np.maximum(sizes, 1)
        total = np.add.reduceat(mixed, first[:-1])
        best = np.argmin(total, axis=1)  # the first of equals: languages are sorted
        least = np.take_along_axis(total, best[:, None], 1)
        # the posterior, tempered, since neighbouring characters depend on each other
        score = 1 / np.exp2(-np.minimum((total - least) / SPREAD, 60)).sum(1)
        # quantiles of each text's pieces, interpolated between its sorted pieces
        ordered = lowest[np.lexsort((lowest, np.repeat(np.arange(len(syms)), pieces)))]
        middle, upper = (self._quantile(ordered, first, pieces, q) for q in (0.5, 0.75))
        rejected = np.zeros(len(syms), bool)
        if self.limit is not None:
            above = middle - self.limit[best, length_class(counts)]
            rejected = above > 0
            score = score * np.exp(-np.maximum(0.0, above))
        score, bits = np.clip(score, 0.0, 1.0), least[:, 0] / np.maximum(counts, 1)
        found = zip([self.languages[i] for i in best], score.tolist(), rejected.tolist(), bits.tolist(), counts.tolist(), upper.tolist(), strict=True)
        return [x if x[4] > 0 else ("und", 0.0, True, 0.0, 0, 0.0) for x in found]  # no letter

    @staticmethod
    def _quantile(ordered: np.ndarray, first: np.ndarray, pieces: np.ndarray, q: float) -> np.ndarray:
        at = first[:-1] + (pieces - 1) * q
        low = np.floor(at).astype(np.int64)
        high = np.minimum(low + 1, first[1:] - 1)
        return ordered[low] + (ordered[high] - ordered[low]) * (at - low)


def length_class(n: np.ndarray) -> np.ndarray:
    """The power of two at or below each length, LENGTHS - 1 at most."""
    return np.minimum(np.frexp(np.maximum(np.asarray(n), 1))[1] - 1, LENGTHS - 1)


def samples(sym: np.ndarray) -> list[np.ndarray]:
    """The whole text and, for each power of two, up to SAMPLES texts of whole words about as long."""
    space = np.nonzero(sym == SPACE)[0]
    out = [sym]
    for k in range(LENGTHS):
        if 1 << k >= len(sym) - 1:
            break
        found = set()
        for at in np.arange(SAMPLES) * (len(sym) - 1 - (1 << k)) // SAMPLES:
            a = space[np.searchsorted(space, at)]
            b = np.searchsorted(space, a + (1 << k))
            if b < len(space):
                found.add((int(a), int(space[b])))
        out += [sym[a : b + 1] for a, b in sorted(found) if b - a < 2 << k]
    return out


def limits(languages: list[str], seen: pd.DataFrame) -> np.ndarray:
    """Limits by language and length from the calibration texts' lang, n and upper; a shorter text's limit is never lower."""
    limit = np.full((len(languages), LENGTHS), np.inf)
    kind = length_class(seen["n"].to_numpy())
    for i, lang in enumerate(languages):
        for k in range(LENGTHS):
            x = np.sort(seen.loc[(seen["lang"] == lang) & (kind == k), "upper"].to_numpy())
            if len(x):
                top = x[int(np.ceil(BELOW * len(x))) - 1]
                limit[i, k] = top + MARGIN * (top - np.median(x))
        given = np.isfinite(limit[i])
        if given.any():  # a length without texts takes the limit of the next shorter one, or of the shortest
            at = np.maximum.accumulate(np.where(given, np.arange(LENGTHS), -1))
            limit[i] = limit[i][np.where(at < 0, int(np.argmax(given)), at)]
            limit[i] = np.maximum.accumulate(limit[i][::-1])[::-1]
    return limit


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], table_bytes: int = TABLE_BYTES) -> Model:
    """The joint model of all languages from the n-gram counts of each; it takes the space of the n-grams that each has, and the full table's bound."""
    languages = sorted(counts)
    alphabet = max(2, len(np.unique(np.concatenate([k & ((1 << CHAR_BITS) - 1) for k, _ in counts.values()])))) if counts else 2
    own = {lang: KneserNey(*counts[lang], alphabet) for lang in languages}
    model = Model(languages, {}, float(-np.log2(alphabet)))
    if not languages:
        return model
    for order in range(1, ORDER + 1):
        values, weights = [], []
        for m in own.values():
            keys, _, contexts, *_ = m.tables[order]
            values.append((keys, np.log2(m.probability(keys, order))))
            weights.append((contexts, np.log2(m.backoff(contexts, order))))
        model.tables[order] = (Rows(values), Rows(weights))
    known = model.tables[ORDER][0].keys
    if 4 * len(known) * len(languages) <= table_bytes:
        model.table = (known, model.backed_off(known))
    return model


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to the n-gram counts of each batch and language."""
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if len(s := symbols(text)) > 1:
                by.setdefault(lang, []).append(grams(s))
        for lang, parts in by.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS, calibration_docs: int = CALIBRATION_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: int = LANGUAGES) -> Model:
    """Learns from `labelled`; rows without a language or text are left out.

    Of each language about `train_docs` rows train and `calibration_docs` others calibrate, chosen by a hash
    of the id; their whole texts are used. The model's size depends on these bounds and the
    number of languages (`languages` at most, those with the most rows; a warning tells of others), not on the corpus. Without
    labelled rows, or on an empty table, every text is `und`. Repeated rows count each; very long texts count whole.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    # a scan of the labels alone; rows without a text make the sample a little smaller
    sizes = {r["lang"]: r["n"] for r in labelled.select(F.col(lang_col).alias("lang")).where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages + 1).collect()}
    if len(sizes) > languages:
        sizes = dict(list(sizes.items())[:languages])
        warnings.warn(f"only the {languages} most frequent languages are learned; raise `languages` for others", stacklevel=2)
    if not sizes:
        return build({})
    rows = rows.where(F.col("lang").isin(*sizes))
    parts = 1 << 30
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(min(parts, parts * train_docs / n))))])
    both = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(min(parts, parts * (train_docs + calibration_docs) / n))))])
    draw = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(parts))
    # a language with few rows trains on three of four of them
    train_cut = F.least(share[F.col("lang")], (both[F.col("lang")] * 0.75).cast("int"))
    counted = rows.where(draw < train_cut).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    langs, keys, n = table.column(0).combine_chunks().dictionary_encode(), table.column(1).to_numpy(), table.column(2).to_numpy()
    which, names = np.asarray(langs.indices), langs.dictionary.to_pylist()
    model = build({name: (keys[which == i], n[which == i]) for i, name in enumerate(names)})
    held = rows.where((draw >= train_cut) & (draw < both[F.col("lang")])).select("lang", "text")
    shared = spark.sparkContext.broadcast(model)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole, *cut = shared.value.score_symbols(samples(symbols(text)))
                if whole[0] == lang:
                    own = [whole, *(x for x in cut if x[0] == lang)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(own), pa.string()), pa.array([x[5] for x in own], pa.float64()), pa.array([x[4] for x in own], pa.int64())],
                        ["lang", "upper", "n"],
                    )

    seen = held.mapInArrow(calibrate, "lang string, upper double, n long").toPandas()
    model.limit = limits(model.languages, seen)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), rejected, bits, one row for each row of `docs`.

    lang_pred is a learned language, `und` if the text is null or has no letter (score 0, rejected). Equal
    cross-entropies go to the language that sorts first. `rejected` marks texts unlike all that was
    learned. Only the text is looked at; very long texts are scored whole, in windows. Repeated rows and null
    ids give rows each; an empty table gives none; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.score(batch.column(1).to_pylist())
            cols = list(zip(*got, strict=True)) if got else [(), (), (), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.float64())],
                ["doc_id", "lang_pred", "score", "rejected", "bits"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean, bits double")


def filter_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows and columns of `docs` whose text has a letter and isn't rejected.

    Null and empty texts go; very long texts are judged whole; repeated rows stay or go together; an empty table stays empty; nulls in
    other columns and their names don't matter.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.score([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([not g[2] for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
