"""Work items: a piece of Python work for each row, which may fail without taking the others along, and may be run again.

Items whose output is there already aren't worked on again. The rest run in Arrow batches; an error becomes the status of its item. Outputs
go to files by `sources.array_files`, which are moved in place at the end, so an item counts as done only if its file is whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietday.session import cut, ship
from quietday.sources.array_files import write_arrays

#: Items that a worker is sent at once.
ITEMS = 64

OUTCOME = "status string, error string, values array<double>, values_shape array<bigint>"


class Skipped(Exception):
    """Raised by work that has no output for an item; its text is the status."""


def _outcomes(work: Callable[[dict], np.ndarray], fields: list[str], carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ITEMS):
                part = batch.slice(at, ITEMS)
                status, error, values, shapes = [], [], [], []
                for item in part.select(fields).to_pylist():
                    try:
                        out = np.asarray(work(item))
                        status.append("ok")
                        error.append(None)
                        values.append(out.astype(float).ravel())
                        shapes.append(list(out.shape))
                    except Skipped as why:
                        status.append(str(why))
                        error.append(None)
                        values.append(None)
                        shapes.append(None)
                    except Exception as failed:  # noqa: BLE001  one item's failure is its status, whatever it is
                        status.append(f"error:{type(failed).__name__}")
                        error.append(str(failed))
                        values.append(None)
                        shapes.append(None)
                found = [pa.array(status, pa.string()), pa.array(error, pa.string()), pa.array(values, pa.list_(pa.float64())), pa.array(shapes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carried] + found, [*carried, "status", "error", "values", "values_shape"])

    return run


def run_items(items: DataFrame, work: Callable[[dict], np.ndarray], keys: list[str], done: DataFrame | None = None) -> DataFrame:
    """keys, name, status, error, values, values_shape: `exists` for items whose name `done` holds, else what `work` made of the row.

    `items` has keys, `name` (of the output) and what `work` reads from the row's dict. Status is `ok`, the text of a `Skipped`, or
    `error:` and the kind of the exception with its message beside. Null names are worked on. Names should differ; items of one name are all run.
    """
    ship(items.sparkSession)
    carried = [*keys, "name"]
    fields = items.columns
    if done is not None:
        seen = done.select(F.col("name").alias("_name")).distinct()
        marked = items.join(seen, items["name"] == seen["_name"], "left")
        there = marked.where(F.col("_name").isNotNull()).select(*carried, F.lit("exists").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("array<double>").alias("values"), F.lit(None).cast("array<bigint>").alias("values_shape"))
        items = items.join(seen, items["name"] == seen["_name"], "left_anti")
    kinds = dict(items.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", " + OUTCOME
    out = items.mapInArrow(_outcomes(work, fields, carried), schema)
    return out if done is None else there.unionByName(out)


def build_files(items: DataFrame, work: Callable[[dict], np.ndarray], keys: list[str], path: str, done: DataFrame | None = None, dtype: str = "float64") -> DataFrame:
    """keys, name, status, error after the outputs of all items that went well are files below `path`.

    `done` lists what is there by `name` (see `named_files`). The work is done once: its outcome is cut off before files and
    statuses are taken from it. Run again with a new listing, it does nothing.
    """
    outcome = cut(run_items(items, work, keys, done))
    good = outcome.where("status = 'ok'")
    if not good.isEmpty():
        write_arrays(good.select("name", "values", "values_shape"), path, ["values"], dtype)
    return outcome.select(*keys, "name", "status", "error")


def named_files(files: DataFrame, root: str) -> DataFrame:
    """`name` of listed files: the path below `root`, whatever scheme the listing gives its paths."""
    plain = root.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    return files.select(F.element_at(F.split("path", F.concat(F.lit("\\Q"), F.lit(plain), F.lit("\\E"))), -1).alias("name"), "*")
