"""SimHash near-dedup: pigeonhole blocks, joined, then checked by Hamming distance.

Fingerprints are 64 bits; only distinct ones take part in the search. They are split into eight blocks of
8 bits. Two fingerprints that differ in at most two bits share at least six blocks, so they meet under one
of 28 keys (six blocks each). A key's bucket holds distinct fingerprints that agree in 48 bits: at most
65,536, whatever the size of the corpus. Inside a bucket links come from looking up the 136 fingerprints
at distance 1 or 2 in the other 16 bits, or from all distances in a small bucket, and leave it as
a spanning tree: no link between components is lost and no pairs are listed.

Components of the links are found by hooking and pointer jumping over DataFrames, cut by a checkpoint
each round. Each join of a round has plain exchanges on both sides, so hot keys split at run time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietday.llm.common import cut, one_of_each, small_batches, text_or_empty

BITS, BLOCKS, DISTANCE = 64, 8, 2
SEED = 42

#: Shingles hashed and counted at a time, and fingerprints compared all with all.
CHUNK, SMALL = 1 << 16, 64


def fingerprint(text: str, size: int = 3) -> int:
    """Bit i is set if it is in over half of the hashes of the text's shingles; 0 without words."""
    words = text.encode().lower().split()  # of bytes: A-Z only, and split at \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), CHUNK):
        h = np.array([digest(s, SEED) for s in shingles[at : at + CHUNK]], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(shingles)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints, pa.int64())], ["doc_id", "mark", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """doc_id, mark (a hash that tells a row's text) and fp (the 64 bits as a signed long) of whole texts; null text counts as empty.

    One row for each input row, repeated ones too; an empty table gives none; a very long text is shingled whole, some of its
    hashes at a time; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    return rows.mapInArrow(_fingerprints(size), "doc_id long, mark long, fp long")


def block_keys(fp: Column) -> Column:
    """The 28 keys of six blocks: the fingerprint without two of its blocks, marked by which two."""
    width = BITS // BLOCKS
    keys = []
    for n, gone in enumerate(combinations(range(BLOCKS), DISTANCE)):
        mask = reduce(lambda m, b: m & ~(((1 << width) - 1) << (b * width)), gone, (1 << BITS) - 1)
        keys.append(F.struct(F.lit(n).cast("byte").alias("t"), fp.bitwiseAND(F.lit(mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask).cast("long")).alias("key")))
    return F.array(*keys)


def _masks(bits: int) -> np.ndarray:
    """All differences of one or two bits of the 64."""
    one = [1 << i for i in range(bits)]
    return np.array(one + [a | b for a, b in combinations(one, 2)], np.uint64)


def bucket_tree(prints: np.ndarray) -> list[tuple[int, int]]:
    """(fingerprint, least of its component) for the links of at most two bits among distinct fingerprints."""
    fps = np.sort(prints.astype(np.int64).view(np.uint64))
    n = len(fps)
    if n <= SMALL:
        a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= DISTANCE, 1))
    else:
        spread = int(np.bitwise_or.reduce(fps ^ fps[0]))
        free = [i for i in range(BITS) if spread >> i & 1]  # bits in which the bucket differs at all
        pairs = []
        for m in _masks(len(free)):
            mask = np.uint64(sum(1 << free[i] for i in range(len(free)) if int(m) >> i & 1))
            other = fps ^ mask
            at = np.minimum(np.searchsorted(fps, other), n - 1)
            hit = np.nonzero((fps[at] == other) & (fps < other))[0]
            pairs.append((hit, at[hit]))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
    label = np.arange(n)
    while True:  # least label over links and pointer jumps
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    signed = fps.view(np.int64)
    return [(int(signed[i]), int(signed[label[i]])) for i in range(n) if label[i] != i]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [p for prints in batch.column(0) for p in bucket_tree(np.asarray(prints.values))]
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints `fp` exactly as all links of at most two bits do."""
    # a table that was checkpointed comes in few partitions; each row becomes 28
    prints = prints.repartition(prints.sparkSession.sparkContext.defaultParallelism, "fp")
    keyed = prints.select("fp", F.explode(block_keys(F.col("fp"))).alias("k"))
    buckets = keyed.groupBy("k").agg(F.collect_list("fp").alias("prints")).where(F.size("prints") > 1)
    return buckets.select("prints").mapInArrow(_trees, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of `edges` (a, b): root is the least node that can be reached."""
    edges = cut(edges.select("a", "b"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = cut(nodes.select("node", F.col("node").alias("root")))
    for _ in range(most_rounds):
        la = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        lb = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        ends = edges.join(la, "a").join(lb, "b").where("ra <> rb").withColumn("low", F.least("ra", "rb"))
        if ends.isEmpty():
            return labels
        # the larger root of a link hooks onto the smaller one
        hooks = cut(ends.select(F.greatest("ra", "rb").alias("node"), "low").groupBy("node").agg(F.min("low").alias("low")))
        hooked = labels.join(hooks, "node", "left").select("node", F.coalesce("low", "root").alias("root"))
        labels = cut(hooked)
        while True:  # until every pointer leads to a root
            above = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
            jumped = cut(labels.join(above, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
            labels = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
    raise RuntimeError("components did not settle")


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, mark, fp, root (the least fingerprint of its component), component_id of each row."""
    prints = cut(fingerprints(docs, id_col, text_col, size))
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(groups.select("fp")))
    members = groups.join(labels, groups["fp"] == labels["node"]).select("fp", "root", "least")
    roots = cut(members.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(
        groups.join(labels, groups["fp"] == labels["node"], "left")
        .select("fp", "least", "root")
        .join(roots, "root", "left")
        .select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    )
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id that links of at most two differing bits reach. Texts without words,
    null ones too, have the fingerprint zero and link like any other; very long texts are shingled whole. A bit set in exactly
    half of the hashes is 0. Repeated rows share
    their component; a null id never names a component unless it holds null ids only. An empty
    table gives no rows; other columns are ignored.
    """
    rows = _grouped(docs, id_col, text_col, size)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """The input's columns and exactly one row of each component: that of the least id.

    Of different texts under the least id, or in a component without ids, one stays, and of repeated rows
    one. Rows are told apart by id and text, so another text under the same id stays where it
    is the least of its own component. Null and texts without words are one group; very long texts count whole; an empty table stays
    empty. Columns may have any names, also those used inside.
    """
    rows = _grouped(docs, id_col, text_col, size).groupBy("root", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    rows = cut(rows)
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("least"))
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark"))
    judged = cut(rows.join(least, "root").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "n", kept.alias("kept")))
    mark = F.xxhash64(text_or_empty(docs[text_col]))
    more = judged.where(~F.col("kept") | (F.col("n") > 1)).select("_id", "_mark")
    once = docs.join(more, docs[id_col].eqNullSafe(more["_id"]) & (mark == more["_mark"]), "left_anti")
    again = judged.where("kept and n > 1").select("_id", "_mark")
    if again.isEmpty():
        return once
    repeated = docs.join(again, docs[id_col].eqNullSafe(again["_id"]) & (mark == again["_mark"]), "left_semi")
    return once.unionByName(one_of_each(repeated, [F.col(id_col), F.xxhash64(text_or_empty(text_col))], id_col, text_col))
