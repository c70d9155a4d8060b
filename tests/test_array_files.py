"""Array files and work items on a shared folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietday.operators import work
from quietday.sources import array_files

PATTERN = r"(?P<tag>\w+?)_preds_(?P<model>\w+?)_L(?P<history>\d+)_s(?P<seed>\d+)\.npz"


def predictions(spark, path, seeds):
    rows = [(f"l6_preds_{m}_L{n}_s{s}.npz", [float(s + k) for k in range(6)], [2, 3], [1.0, 2.0]) for m, n, some in seeds for s in some]
    df = spark.createDataFrame(rows, "name string, mu array<double>, mu_shape array<bigint>, y array<double>")
    array_files.write_arrays(df, path, ["mu", "y"])
    return rows


def test_files_are_read_as_they_were_written(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = predictions(spark, path, [("full", 7, [0, 1, 2]), ("ts", 1, [0, 2])])
    stored = np.load(tmp_path / "runs" / "l6_preds_full_L7_s1.npz")
    assert stored["mu"].shape == (2, 3) and stored["mu"].tolist() == [[1, 2, 3], [4, 5, 6]] and stored["y"].tolist() == [1, 2]
    np.savez(tmp_path / "runs" / "other.npz", mu=[1.0])
    (tmp_path / "runs" / "_part.npz").write_bytes(b"broken")
    got = array_files.read_arrays(spark, path, ["mu", "y"], PATTERN)
    assert got.columns == ["name", "tag", "model", "history", "seed", "mu", "mu_shape", "y", "y_shape"]
    assert sorted((r["name"], list(r["mu"]), list(r["mu_shape"]), list(r["y"])) for r in got.collect()) == sorted(rows)
    assert got.rdd.getNumPartitions() == 5
    assert not [p for p in (tmp_path / "runs").iterdir() if p.name.startswith("_writing")]
    # replaced by name, and days as whole numbers
    array_files.write_arrays(got.limit(1).withColumn("y", F.array(F.lit(9.0))).select("name", "mu", "mu_shape", "y"), path, ["mu", "y"])
    assert array_files.read_arrays(spark, path, ["y"], PATTERN).where("y[0] = 9").count() == 1
    np.save(tmp_path / "days.npy", np.array(["1970-01-03", "1970-01-01"], "datetime64[D]"))
    assert array_files.read_arrays(spark, str(tmp_path), ["values"], r"days\.npy").first()["values"] == [2.0, 0.0]


def test_keys_choose_the_files(spark, tmp_path):
    path = str(tmp_path)
    predictions(spark, path, [("full", 7, [0, 1, 2]), ("ts", 1, [0, 1, 2])])
    (tmp_path / "l6_preds_bad_L1_s0.npz").write_bytes(b"not an array")
    some = array_files.read_arrays(spark, path, ["mu"], PATTERN, {"model": ["ts"], "seed": ["0", "2"]})
    assert sorted(r["seed"] for r in some.collect()) == ["0", "2"]  # the broken file isn't opened
    df = array_files.read_arrays(spark, path, ["mu"], PATTERN)
    with pytest.raises(Exception, match="(?i)pickle|magic|valueerror|unpickling"):
        df.collect()


def test_groups_of_three_seeds(spark, tmp_path):
    path = str(tmp_path)
    predictions(spark, path, [("full", 7, [0, 1, 2]), ("ts", 1, [0, 2])])
    files = array_files.read_arrays(spark, path, ["mu"], PATTERN)
    got = array_files.seed_groups(files, ["model", "history"], ["mu"]).collect()
    assert [(r["model"], r["history"], r["n_seeds"], list(r["mu"])) for r in got] == [("full", "7", 3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])]
    with pytest.raises(Exception, match="not 3 seeds: ts 1"):
        array_files.seed_groups(files, ["model", "history"], ["mu"], strict=True).collect()
    other = spark.createDataFrame([("l6_preds_full_L7_s1.npz", [1.0])], "name string, mu array<double>")
    array_files.write_arrays(other, path, ["mu"])
    with pytest.raises(Exception, match="shapes of mu differ"):
        array_files.seed_groups(array_files.read_arrays(spark, path, ["mu"], PATTERN), ["model", "history"], ["mu"]).collect()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = spark.createDataFrame([("a.npz", [1.0, 2.0], [2]), ("b.npz", [1.0, 2.0], [3])], "name string, v array<double>, v_shape array<bigint>").repartition(2)
    with pytest.raises(Exception, match="reshape"):
        array_files.write_arrays(bad, path, ["v"])
    assert array_files.read_arrays(spark, path, ["v"]).count() == 0 and not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]


def difference(item):
    now, before = item["now"], item["before"]
    if now is None:
        raise FileNotFoundError("no frame")
    if before is None:
        raise work.Skipped("no-previous-frame")
    if len(now) != len(before):
        raise work.Skipped("shape-mismatch")
    side = int(len(now) ** 0.5)
    return (np.array(now) - np.array(before)).reshape(side, side)


def test_items_fail_alone_and_run_once(spark, tmp_path):
    path = str(tmp_path / "frames")
    rows = [(1, "s/1.npy", [1.0] * 4, None), (2, "s/2.npy", [3.0] * 4, [1.0] * 4), (3, "s/3.npy", [1.0] * 9, [1.0] * 4), (4, "s/4.npy", None, [1.0]), (5, "s/5.npy", [1.0] * 5, [1.0] * 5), (6, "s/6.npy", [2.0] * 4, [1.0] * 4)]
    items = spark.createDataFrame(rows, "id int, name string, now array<double>, before array<double>").repartition(2)
    listed = lambda: work.named_files(array_files.listing(spark, path, "*.npy"), path) if (tmp_path / "frames").exists() else None
    statuses = lambda df: {r["id"]: r["status"] for r in df.collect()}
    first = work.build_files(items.where("id <= 3"), difference, ["id"], path, listed(), "uint8")
    assert statuses(first) == {1: "no-previous-frame", 2: "ok", 3: "shape-mismatch"}
    assert np.load(tmp_path / "frames/s/2.npy").tolist() == [[2, 2], [2, 2]] and np.load(tmp_path / "frames/s/2.npy").dtype == np.uint8
    second = work.build_files(items, difference, ["id"], path, listed(), "uint8")
    assert statuses(second) == {1: "no-previous-frame", 2: "exists", 3: "shape-mismatch", 4: "error:FileNotFoundError", 5: "error:ValueError", 6: "ok"}
    assert {r["id"]: r["error"] for r in second.collect()}[4] == "no frame"
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "frames").rglob("*.npy")}
    third = work.build_files(items, difference, ["id"], path, listed(), "uint8")
    assert statuses(third) == statuses(second) | {6: "exists"}
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "frames").rglob("*.npy")} == before
