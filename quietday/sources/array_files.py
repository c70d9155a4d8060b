"""Array files (.npz with named arrays, .npy with one) as a Spark data source, and listings of files without their contents.

    register(spark)
    spark.read.format("arrays").option("arrays", "y,mu").option("pattern", r"(?P<model>\\w+)_s(?P<seed>\\d+)\\.npz").load(path)

gives one row for each file whose path below `path` the pattern matches as a whole: `name` (that path), a string column for each named
group, and for each array its values as array<double>, flattened, and its shape. One partition reads a few files, a task holds one file
at a time. A written row becomes the file that its `name` says; files are written beside and moved in place when all tasks have ended well, so a
failed or repeated task leaves nothing behind and a file is never seen half written. Paths are those that pyarrow opens: a folder that all
machines mount, S3, or HDFS with its native library.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quietday.session import ship

#: More partitions than this are never planned.
MOST_PARTITIONS = 10_000


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a path names (a plain path: the local one, shared on a cluster) and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return pafs.LocalFileSystem(), path


def _listed(path: str) -> list[str]:
    """Paths below a folder, in order; names that begin with _ or . don't count. A folder that isn't there is empty."""
    fs, root = _opened(path)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    names = [posixpath.relpath(f.path, root) for f in found if f.type == pafs.FileType.File]
    return sorted(n for n in names if not any(part[0] in "_." for part in n.split("/")))


@dataclass
class Files(InputPartition):
    names: list[str]


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.arrays, self.schema = options["path"], _arrays(options), schema
        self.pattern = re.compile(options.get("pattern", r".+\.np[yz]"))
        self.files = int(options.get("files", "1"))
        self.only = {k: set(map(str, v)) for k, v in json.loads(options.get("only", "{}")).items()}

    def partitions(self) -> list[Files]:
        names = [n for n in _listed(self.path) if (m := self.pattern.fullmatch(n)) and all(({"name": n} | m.groupdict())[c] in v for c, v in self.only.items())]
        each = max(self.files, -(-len(names) // MOST_PARTITIONS))
        return [Files(names[i : i + each]) for i in range(0, len(names), each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(self.path)
        for name in partition.names:
            with fs.open_input_stream(posixpath.join(root, name)) as stream:
                stored = np.load(io.BytesIO(stream.read()), allow_pickle=False)
            row: dict[str, object] = {"name": name} | self.pattern.fullmatch(name).groupdict()
            for a in self.arrays:
                if isinstance(stored, np.ndarray) and len(self.arrays) > 1:
                    raise ValueError(f"{name} holds one array, not {len(self.arrays)}")
                values = stored if isinstance(stored, np.ndarray) else stored[a]
                if np.issubdtype(values.dtype, np.datetime64):
                    values = values.astype("datetime64[D]").astype(np.int64)
                row[a], row[f"{a}_shape"] = values.astype(float).ravel(), list(values.shape)
            yield pa.RecordBatch.from_pylist([row], _arrow(self.schema))


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.arrays, self.kind = options["path"], _arrays(options), options.get("dtype", "float64")
        self.columns = schema.names
        self.beside = posixpath.join(self.path.rstrip("/"), f"_writing-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _opened(self.path)
        beside = _opened(self.beside)[1]
        fs.create_dir(beside, recursive=True)
        moves = []
        for batch in iterator:
            for row in batch.to_pylist():
                held = {}
                for a in [] if "content" in self.columns else self.arrays:
                    values = np.array(row[a], float)
                    held[a] = values.reshape(row[f"{a}_shape"] if row.get(f"{a}_shape") is not None else -1).astype(self.kind)
                out = io.BytesIO()
                if "content" in self.columns:
                    out.write(row["content"] or b"")
                elif row["name"].endswith(".npy"):
                    if len(held) != 1:
                        raise ValueError("a .npy file holds one array")
                    np.save(out, next(iter(held.values())))
                else:
                    np.savez(out, **held)
                part = posixpath.join(beside, uuid.uuid4().hex)
                with fs.open_output_stream(part) as stream:
                    stream.write(out.getvalue())
                moves.append((part, posixpath.join(root, row["name"])))
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = _opened(self.path)
        moves = [m for x in messages if x is not None for m in x.moves]
        for folder in {posixpath.dirname(to) for _, to in moves}:
            fs.create_dir(folder, recursive=True)
        for part, to in moves:
            fs.move(part, to)  # takes the place of an earlier file of the name
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, beside = _opened(self.beside)
        if fs.get_file_info(beside).type == pafs.FileType.Directory:
            fs.delete_dir(beside)


def _arrays(options: dict[str, str]) -> list[str]:
    return [a.strip() for a in options.get("arrays", "values").split(",")]


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])


class ArrayFiles(DataSource):
    """options: path, arrays (names, joined by commas; default `values`); reading: pattern, only (JSON: key -> values that choose the files), files (read by one partition, one after the other; default 1); writing: dtype (default float64).

    Files are chosen by an option and not by filter pushdown: a reader that took a filter is kept by Spark for later queries on the same DataFrame.
    """

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        keys = re.compile(self.options.get("pattern", "")).groupindex
        return ", ".join(["name string", *[f"{k} string" for k in keys], *[f"{a} array<double>, {a}_shape array<bigint>" for a in _arrays(self.options)]])

    def reader(self, schema: T.StructType) -> ArrayReader:
        return ArrayReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Makes the format `arrays` known to the session and its workers."""
    ship(spark)
    spark.dataSource.register(ArrayFiles)


def read_arrays(spark: SparkSession, path: str, arrays: list[str], pattern: str = r".+\.np[yz]", only: dict[str, list[str]] | None = None, files: int = 1) -> DataFrame:
    """name, the pattern's named groups, and of each array its values and shape, for each file that matches; `only` lists the values of keys (or names) whose files are opened, `files` how many (small ones) a partition takes."""
    register(spark)
    return spark.read.format("arrays").option("arrays", ",".join(arrays)).option("pattern", pattern).option("only", json.dumps(only or {})).option("files", files).load(path)


def write_arrays(rows: DataFrame, path: str, arrays: list[str], dtype: str = "float64") -> None:
    """A file for each row, under its `name`; an earlier file of that name is replaced. Rows of equal names are an error of the caller: one of them stays."""
    register(rows.sparkSession)
    columns = ["name", *[c for a in arrays for c in (a, f"{a}_shape") if c in rows.columns]]
    rows.select(*columns).write.format("arrays").option("arrays", ",".join(arrays)).option("dtype", dtype).mode("append").save(path)


def write_contents(rows: DataFrame, path: str) -> None:
    """A file for each row, its bytes the column `content` (null: empty), under its `name`."""
    register(rows.sparkSession)
    rows.select("name", F.col("content").cast("binary").alias("content")).write.format("arrays").mode("append").save(path)


def seed_groups(files: DataFrame, keys: list[str], arrays: list[str], seeds: int = 3, strict: bool = False) -> DataFrame:
    """keys, n_seeds, and for each array the mean over seeds, element by element; groups of another number of seeds are left out, or with `strict` raise.

    `files` has keys, seed and arrays, as `read_arrays` gives them. Shapes of a group have to be equal, otherwise the query fails.
    """
    shapes = [F.size(F.collect_set(f"{a}_shape")).alias(f"{a}_shapes") for a in arrays]
    groups = files.groupBy(*keys).agg(F.count_distinct("seed").alias("n_seeds"), F.min_by("name", "seed").alias("first_name"), *shapes, *[F.collect_list(a).alias(a) for a in arrays])
    if strict:
        groups = groups.where(F.assert_true(F.col("n_seeds") == seeds, F.concat(F.lit(f"not {seeds} seeds: "), F.concat_ws(" ", *keys))).isNull())
    groups = groups.where(F.col("n_seeds") == seeds)
    for a in arrays:
        groups = groups.where(F.assert_true(F.col(f"{a}_shapes") == 1, F.lit(f"the shapes of {a} differ between seeds")).isNull())
    total = lambda c: F.aggregate(c, F.transform(F.get(c, F.lit(0)), lambda v: v * 0), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
    return groups.select(*keys, "n_seeds", "first_name", *[F.transform(total(a), lambda v: v / seeds).alias(a) for a in arrays])


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, bytes, modified of the files below a folder, from their metadata: contents aren't read. Names that the glob rejects and files without bytes aren't listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
