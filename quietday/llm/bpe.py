"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each leaf holds the rank of the pair that starts at its position, with the position in the low bits, so
the root is the leftmost pair of minimum rank. A merge rewrites three leaves (the merged position, the
right neighbour that is gone, the left neighbour whose pair changed) and the nodes above them: a
logarithmic update on live neighbours. Many pieces are merged in step: trees of one size
are rows of one NumPy array, and each step takes one merge from each piece that has one left.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietday.llm.common import bounded, small_batches, text_or_empty
from quietday.llm.encoding import ChunkIds, offsets_of, take_runs

NONE = np.int64(1) << 62
#: Cells of the trees that are held at once.
CELLS = 1 << 20

_coders: dict[tuple[str, str], "BytePairs"] = {}


class BytePairs(ChunkIds):
    """A rank file as the tiktoken library reads it, and its split pattern."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.split = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, r in self.ranks.items():
            tokens[r] = token
        self.tokens, self.numbers = flat_bytes(tokens), flat_bytes([f" {r}".encode() for r in range(len(tokens))])
        pairs = [
            (self.ranks[left] << 32 | self.ranks[right], rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if (left := token[:i]) in self.ranks and (right := token[i:]) in self.ranks
        ]
        pairs.sort()
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of token ids, NONE where no token joins them."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def _merge(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Ids of pieces of 2 to width + 1 bytes; width, a power of two, is the number of leaves."""
        n, sizes = len(pieces), np.array([len(p) for p in pieces])
        raw = np.zeros((n, width + 1), np.uint8)
        raw[np.arange(width + 1) < sizes[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        token = self.byte[raw]
        where = np.arange(width)
        first = self._rank(token[:, :-1], token[:, 1:])
        first[where >= (sizes - 1)[:, None]] = NONE
        tree = np.full((n, 2 * width), NONE, np.int64)
        tree[:, width:] = np.where(first == NONE, NONE, first << 32 | where)
        step = width
        while step > 1:
            tree[:, step // 2 : step] = np.minimum(tree[:, step : 2 * step : 2], tree[:, step + 1 : 2 * step : 2])
            step //= 2
        after = np.tile(np.arange(1, width + 3), (n, 1))  # the next live position; at or past the size: none
        before = np.tile(np.arange(-1, width + 1), (n, 1))
        live = np.arange(width + 1) < sizes[:, None]
        rows = np.nonzero(tree[:, 1] < NONE)[0]
        while len(rows):
            best = tree[rows, 1]
            at, rank = best & 0xFFFFFFFF, best >> 32
            gone = after[rows, at]
            nxt = after[rows, gone]
            prev = before[rows, at]
            token[rows, at] = rank
            live[rows, gone] = False
            after[rows, at] = nxt
            before[rows, np.minimum(nxt, width + 1)] = at
            tree[rows, width + np.minimum(gone, width - 1)] = np.where(gone < width, NONE, tree[rows, 2 * width - 1])
            has = nxt < sizes[rows]
            right = self._rank(rank, token[rows, np.minimum(nxt, width)])
            tree[rows, width + at] = np.where(has & (right < NONE), right << 32 | at, NONE)
            left = np.maximum(prev, 0)
            pair = self._rank(token[rows, left], rank)
            tree[rows, width + left] = np.where(prev < 0, tree[rows, width + left], np.where(pair < NONE, pair << 32 | left, NONE))
            for leaf in (np.minimum(gone, width - 1), at, left):
                node = (width + leaf) >> 1
                while node[0]:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] < NONE]
        return [token[i, live[i]].tolist() for i in range(n)]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; a piece that is a token itself is that token."""
        out: list[list[int]] = [[]] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (rank := self.ranks.get(p)) is not None:
                out[i] = [rank]
            elif p:
                by_width.setdefault(1 << (len(p) - 2).bit_length(), []).append(i)
        for width, which in by_width.items():
            step = max(1, CELLS // (2 * width))
            for k in range(0, len(which), step):
                part = which[k : k + step]
                for i, ids in zip(part, self._merge([pieces[j] for j in part], width), strict=True):
                    out[i] = ids
        return out

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [[p.encode() for p in self.split(c)] for c in chunks]
        distinct = list({p for ps in pieces for p in ps})
        ids = dict(zip(distinct, self.encode_pieces(distinct), strict=True))
        out = [[i for p in ps for i in ids[p]] for ps in pieces]
        return np.array([i for x in out for i in x], np.uint32), np.array([len(x) for x in out], np.int64)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of runs of ids, one after the other, and where each run's begin (with the end of the last)."""
        return spell(self.tokens, ids, ends)

    def decimals(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Like `decode`, the ids in decimal, each after a blank."""
        return spell(self.numbers, ids, ends)


def flat_bytes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), offsets_of(sizes)[:-1], sizes


def spell(words: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat, starts, sizes = words
    return take_runs(flat, starts[ids], sizes[ids]), offsets_of(sizes[ids])[ends]


def coder(path: str, pattern: str) -> BytePairs:
    """One coder for each rank file and worker process."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = BytePairs(path, pattern)
    return _coders[path, pattern]


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in bounded(batches):
            ids, ends = bpe.encode_many(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return run


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            data, ends = bpe.decode(np.asarray(lists.flatten(), np.int64), offsets_of(np.asarray(lists.value_lengths(), np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["doc_id", "bytes"])

    return run


def _digests(path: str, pattern: str):
    def sha(data: np.ndarray) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in bounded(batches):
            ids, ends = bpe.encode_many(batch.column(1))
            joined, j = bpe.decimals(ids, ends)
            decoded, d = bpe.decode(ids, ends)
            shas = [sha(joined[a + 1 : b]) for a, b in zip(j[:-1], j[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends)), pa.array(shas, pa.string()), pa.array([sha(decoded[a:b]) for a, b in zip(d[:-1], d[1:], strict=True)], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of whole texts, a row for each row, repeated ones too; null text has no ids.

    An empty table gives no rows; other columns are ignored. One very long piece takes time in
    proportion to its length (times its logarithm).
    """
    return _rows(docs, id_col, text_col).mapInArrow(_encode(path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and bytes of ids; null or empty ids give no bytes, an id past the vocabulary is an error."""
    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path, pattern), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids of whole texts and of what they decode to.

    A row for each row, repeated ones too; null text counts as empty (no ids). An empty table gives no rows;
    other columns are ignored, whatever their names. Texts, ids and bytes leave no worker.
    """
    return _rows(docs, id_col, text_col).mapInArrow(_digests(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
