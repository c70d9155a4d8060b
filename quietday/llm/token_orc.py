"""Token ids as ORC: run-length encoded integers in stripes, row indexes, Bloom filters on the document id.

Writing: texts are range-partitioned and sorted by id (ties by a hash of the text, then by the partition they
come from, so that no id is too many for one task), then encoded and written inside the same task.
Only texts are shuffled, and each file covers a range of ids that its footer states. A row also holds
the number of its file's range and its place there (ids of the file before it). Readers split files by
stripe, and a filter on the id skips stripes and row groups by min/max and Bloom filter.

Reading: counts and checksums come from the files; a document's start is its place in the file after the
ids of all earlier ranges, a sum over one row for each file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietday.llm.common import bounded, small_batches, text_or_empty
from quietday.llm.encoding import library

SCHEMA = "doc_id long, part int, place long, n_tokens int, ids array<int>"

#: Stripes small enough to read in parallel (their size is looked at each 200 documents), an index entry each thousand.
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(32 << 20),
    "orc.rows.between.memory.checks": "200",
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `ids` that `ends` marks, each with end_id after it, and their new marks."""
    return np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))


def encode_rows(path: str, end_id: int, special_as_text: bool):
    """Arrow batches (doc_id, text) to rows of SCHEMA; every document ends with end_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, place = library(path, special_as_text), TaskContext.get().partitionId(), 0
        for batch in bounded(batches):
            ids, ends = with_end(*enc.encode_many(batch.column(1)), end_id)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))
            parts = pa.array(np.full(batch.num_rows, part, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), parts, pa.array(place + ends[:-1]), pa.array(np.diff(ends).astype(np.int32)), lists], ["doc_id", "part", "place", "n_tokens", "ids"])
            place += int(ends[-1])

    return run


def write_ids(docs: DataFrame, out: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> None:
    """Writes `docs` in ascending id order to ORC files under `out`.

    Null or empty text gives the end id only. Null ids come first. Repeated ids stay, in order of a hash of
    their texts; equal rows in any order. A very long text is one row. An empty table gives files without
    rows. Other columns are ignored, whatever their names. The strings of special tokens
    inside a text are these tokens, as the library's default is, unless `special_as_text`.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("_mark"), F.spark_partition_id().alias("_from"))
    keys = ["doc_id", "_mark", "_from"]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    sorted_rows.mapInArrow(encode_rows(tokenizer, end_id, special_as_text), SCHEMA).write.options(**ORC_OPTIONS).orc(out)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, place, n_tokens, ids of all files; filters on doc_id prune stripes."""
    return spark.read.schema(SCHEMA).orc(path)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        values = np.asarray(ids.values).astype("<u4", copy=False)
        ends = np.asarray(ids.offsets)
        sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "part", "place", "n_tokens", "ids_crc32"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per row of the files that `write_ids` wrote: doc_id, start (ids of all rows before it), n_tokens, ids_crc32.

    Null and repeated ids have a row for each row, with its own start; files without rows give none.
    """
    small_batches(spark)
    rows = read_ids(spark, path)
    docs = rows.select("doc_id", "part", "place", "ids").mapInArrow(_checksums, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    # a row for each file, not for each document
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return docs.join(bases, "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
