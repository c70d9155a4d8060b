"""Quality classifier: a regularised quadratic discriminant on transformed statistics of whole texts.

Each class has its own mean and covariance. Covariances are shrunk towards the pooled one and towards a
multiple of the identity, factored once (Cholesky) and kept with their log-determinants; a score is
the difference of the two classes' log-densities (Mahalanobis distance and log-determinant) plus the
log-prior, tempered and mapped to 0..1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietday.llm.common import small_batches, text_or_empty

#: Labelled rows that the model is fitted on at most, chosen by a hash of the id; shrinkage; temperature.
FIT_ROWS = 20_000
POOL, RIDGE, TEMPERATURE = 0.5, 0.05, 2.0

_UPPER, _LOWER, _DIGITS = (bytes(range(*r)) for r in ((65, 91), (97, 123), (48, 58)))
_STOPS, _COMMAS, _HIGH = b".?!", b",;:", bytes(range(128, 256))
_SYMBOLS = bytes(b for b in range(33, 127) if b not in _UPPER + _LOWER + _DIGITS + _STOPS + _COMMAS + b"'\"()-")

#: Each statistic is a ratio x / n. A short text says little, so its ratios lean on the usual ones of the
#: sample as if it went on for so many words, bytes or lines.
WORDS, BYTES, LINES = 20.0, 120.0, 2.0
LEAN = {
    "bytes_per_word": WORDS, "upper": BYTES, "digits": BYTES, "symbols": BYTES, "stops": WORDS, "commas": WORDS, "high": BYTES, "exclaim": WORDS, "distinct_words": WORDS,
    "top_word": WORDS, "repeats": WORDS, "words_per_line": LINES, "distinct_lines": LINES, "symbol_words": WORDS, "capital_words": WORDS, "long_words": WORDS, "pipes": WORDS,
}
FEATURES = list(LEAN)
FLOOR = 0.02
COLUMNS = [f"{part}_{name}" for part in ("x", "of") for name in FEATURES]


def statistics(text: str) -> list[float]:
    """The numerators, then the denominators, of the ratios of one whole text."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x]
    n, w = len(data), len(words)
    count = lambda chars: n - len(data.translate(None, chars))
    tops = Counter(words)
    ends = Counter(x[-1:] for x in words)
    symbol_words = sum(v for k, v in ends.items() if k in _SYMBOLS or k == b"!")
    x = [
        n, count(_UPPER), count(_DIGITS), count(_SYMBOLS), count(_STOPS), count(_COMMAS), count(_HIGH), data.count(b"!"), len(tops),
        max(tops.values(), default=0), sum(map(eq, words, words[1:])), w, len(set(lines)), symbol_words, sum(map(bytes.isupper, words)), sum(len(v) > 14 for v in words), data.count(b"|"),
    ]
    of = [w, n, n, n, w, w, n, w, w, w, w, len(lines), len(lines), w, w, w, w]
    return [float(v) for v in (*x, *of)]


def transform(raw: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Logarithms of the ratios, each leaning on its usual value."""
    k, lean = len(FEATURES), np.array(list(LEAN.values()))
    return np.log((raw[:, :k] + lean * usual + FLOOR) / (raw[:, k:] + lean))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, 2 * len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in x.T]], ["label", *COLUMNS])


@dataclass
class Discriminant:
    """Class 0 and 1: centres, inverse Cholesky factors, log-determinants, log-priors; a lone class is certain."""

    usual: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    centres: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    priors: list[float]
    only: int | None = None

    def score(self, raw: np.ndarray) -> np.ndarray:
        """The probability of class 1 for rows of `statistics`."""
        if self.only is not None:
            return np.full(len(raw), float(self.only))
        return self.posterior(transform(raw, self.usual))

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -12, 12)
        density = []
        for centre, factor, logdet, prior in zip(self.centres, self.factors, self.logdets, self.priors, strict=True):
            y = (z - centre) @ factor.T
            density.append(prior - 0.5 * (y**2).sum(1) - 0.5 * logdet)
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE, -30, 30)))


def fit_statistics(raw: np.ndarray, y: np.ndarray) -> Discriminant:
    """Fits rows of `statistics`; the usual ratios are those of class 1 if there is any."""
    k = len(FEATURES)
    base = raw[y == 1] if (y == 1).any() else raw
    usual = base[:, :k].sum(0) / np.maximum(base[:, k:].sum(0), 1)
    return fit_arrays(transform(raw, usual), y, usual)


def fit_arrays(x: np.ndarray, y: np.ndarray, usual: np.ndarray, pool: float = POOL, ridge: float = RIDGE) -> Discriminant:
    k = x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(k)
    scale = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(k)
    if len(np.unique(y)) < 2:
        return Discriminant(usual, mean, scale, [], [], [], [], only=int(y[0]) if len(y) else 1)
    z = np.clip((x - mean) / scale, -12, 12)
    own = [z[y == c] for c in (0, 1)]
    centres = [o.mean(0) for o in own]
    scatter = [(o - c).T @ (o - c) for o, c in zip(own, centres, strict=True)]
    pooled = sum(scatter) / max(len(z) - 2, 1)
    factors, logdets, priors = [], [], []
    for o, s in zip(own, scatter, strict=True):
        # a class with few rows leans on the pooled covariance
        lean = max(pool, k / (k + len(o)))
        cov = (1 - lean) * s / max(len(o) - 1, 1) + lean * pooled
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / k, 1e-3) * np.eye(k)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.solve(low, np.eye(k)))
        logdets.append(2 * float(np.log(np.diag(low)).sum()))
        priors.append(float(np.log(len(o) / len(z))))
    return Discriminant(usual, mean, scale, centres, factors, logdets, priors)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Discriminant:
    """Learns label 1 against 0 from the whole texts of at most about `rows` labelled rows.

    Rows are chosen by a hash of the id. Null labels and labels other than 0 and 1 are left out, repeated
    ones count once; null texts count as empty, null ids match no label, and each of repeated documents counts.
    With one class only, that class is certain; without rows (or on empty tables), class 1 is.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").distinct()
    n = marks.count()
    parts = 1 << 30
    drawn = marks.where(F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(parts)) < int(min(parts, parts * rows / max(n, 1))))
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    # the drawn labels are bounded by `rows`, so they are broadcast and no text is shuffled
    joined = texts.join(F.broadcast(drawn), "id").select("label", "text")
    schema = "label int, " + ", ".join(f"{f} double" for f in COLUMNS)
    sample = joined.mapInArrow(_features, schema).toPandas()
    return fit_statistics(sample[COLUMNS].to_numpy(), sample["label"].to_numpy())


def predict(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier), predicted (score >= 0.5), one row for each row.

    Null text counts as empty; empty texts get a score like any other; very long texts are read whole. Only the
    text is looked at. Repeated rows and null ids give rows each; an empty table gives none; other
    columns are ignored, whatever their names. A score of exactly one half is class 1.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, 2 * len(FEATURES))
            score = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def filter_good(docs: DataFrame, model: Discriminant, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows and columns of `docs` with a score of at least `least`.

    Null and empty texts are scored as such, very long ones whole; repeated rows stay or go together; an empty table stays
    empty; nulls in other columns and their names don't matter.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, 2 * len(FEATURES))
            yield batch.filter(pa.array(shared.value.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
