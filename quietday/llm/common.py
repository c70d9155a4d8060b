"""What several operators share: text columns, bounded Arrow batches, checks of a table's columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietday.session import cut, scratch_path, shared_dir, ship

__all__ = ["ASCII_LOWER", "ASCII_UPPER", "ascii_lower", "bounded", "cut", "one_of_each", "scratch_path", "shared_dir", "ship", "small_batches", "spread", "table", "text_or_empty"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows in an Arrow batch, the same for all operators, since a plan made by one may run after another has set the option.
BATCH_ROWS = 256
#: Bytes of text that a worker works on at a time (one longer text is worked on alone).
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker is sent at once, and gives workers this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def bounded(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the texts of `column` exceed BATCH_BYTES."""
    for batch in batches:
        sizes = batch.column(column).cast(pa.large_binary())
        ends = np.frombuffer(sizes.buffers()[1], np.int64, len(sizes) + 1, 8 * sizes.offset) if len(sizes) else np.zeros(1, np.int64)
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(ends, ends[at] + BATCH_BYTES, "right")) - 1 - at)
            yield batch.slice(at, n)
            at += n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A table of fewer file splits than there are cores, dealt to all of them; any other table as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z only, as bytes would be."""
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)



def one_of_each(docs: DataFrame, group: list[Column], id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The columns of `docs` and one row of each group, by a combining aggregate: the least (or greatest) id, null last, then text and row hash."""
    plain = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    missing, pick = (F.col(id_col).isNull(), F.min_by) if keep == "min" else (F.col(id_col).isNotNull(), F.max_by)
    order = F.struct(missing, F.col(id_col), F.sha2(text_or_empty(text_col), 256), F.xxhash64(*plain))
    keys = [g.alias(f"_g{i}") for i, g in enumerate(group)]
    return docs.groupBy(*keys).agg(pick(F.struct(*docs.columns), order).alias("_row")).select("_row.*")
