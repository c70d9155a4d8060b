"""Chat formatting and nearest neighbours."""

import numpy as np
import pytest

from quietday.llm import ann, chat
from quietday.llm.queries import ORACLE_SQL, QUERIES
from tests.twin import assert_twin, connect


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, n int, p1 string")


def test_snapshots_collapse(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "bye")]
    rows = [(c, t, *talk[t]) for c, n in ((1, 1), (2, 2), (3, 3), (4, 3)) for t in range(n)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 0, None, None), (7, 7, "user", "hi"), (5, 0, "user", "hi"), (None, 0, "user", "alone"), (8, None, "user", "late")]
    got = {r["conv_id"]: r for r in chat.collapse_and_render(turns(spark, rows)).collect()}
    assert sorted(got, key=str) == [3, 5, 6, 8, None]  # 7 equals 1, a prefix; 4 equals 3
    assert got[3]["text"] == "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in talk) and got[3]["n_turns"] == 3 and got[5]["n_turns"] == 2
    assert got[6]["text"] == "<||>\n\n<|end|>\n"
    assert chat.collapse_and_render(turns(spark, [])).count() == 0


def test_long_conversations_come_in_parts(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(600)] + [(2, t, "user", f"t{t}") for t in range(580)] + [(3, t, "user", f"t{t}" if t < 599 else "z") for t in range(600)]
    got = chat.collapse_and_render(turns(spark, rows)).orderBy("conv_id", "part").collect()
    assert [(r["conv_id"], r["part"]) for r in got] == [(c, p) for c in (1, 3) for p in range(3)]
    assert "".join(r["text"] for r in got if r["conv_id"] == 1).count("<|end|>") == 600
    whole = {r["conv_id"]: r["text"] for r in chat.collapse_and_render(turns(spark, rows), 1 << 30).collect()}
    assert whole == {c: "".join(r["text"] for r in got if r["conv_id"] == c) for c in (1, 3)}
    huge = chat.collapse_and_render(turns(spark, [(1, 0, "user", "x" * 2_000_000)])).first()
    assert len(huge["text"]) == 2_000_000 + len("<|user|>\n\n<|end|>\n")


def test_repeated_rows_are_gone_before_texts_are_gathered(spark, monkeypatch):
    """One turn repeated a thousand times: each list that is gathered has a struct for each place, not for each row."""
    seen, real = [], chat.F.sort_array

    def spy(column):
        seen.append(column)
        return chat.F.when(chat.F.size(column) > 2, chat.F.raise_error("too many pieces")).otherwise(real(column))

    rows = [(1, 0, "user", "hi")] * 1000 + [(1, 1, "user", "bye")] * 3
    monkeypatch.setattr(chat.F, "sort_array", spy)
    got = chat.collapse_and_render(turns(spark, rows)).collect()
    assert seen and [(r["n_turns"], r["text"]) for r in got] == [(2, "<|user|>\nhi\n<|end|>\n<|user|>\nbye\n<|end|>\n")]


def test_op6_twin(spark, sf):
    assert assert_twin(spark, connect(sf), sf, QUERIES["op6_chat_formatting"], ORACLE_SQL["op6_chat_formatting"]) > 0


def brute(ids, x, every, k):
    out = {}
    for i in np.nonzero(ids % every == 0)[0]:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        best = np.lexsort((ids, d))[:k]
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in best if d[j] < np.inf]
    return out


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), v.astype(np.float32).tolist(), 1, 2, 3) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int, cell int, score int")


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_small_tables_are_exact_with_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8)).astype(np.float32).astype(float)
    x[10:30] = x[5]  # a group of equal vectors, larger than k
    ids = np.arange(60)
    got, want = found(ann.search(table(spark, ids, x), 5, 4)), brute(ids, x, 5, 4)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}
    assert all(a[1] == pytest.approx(b[1]) for q in got for a, b in zip(got[q], want[q], strict=True))


@pytest.mark.parametrize("offset", [0.0, 1e4, 1e6, 1e8])
def test_a_block_is_exact_far_from_the_origin(offset):
    """With large norms, near distances and ties to the smaller id are lost in norms - 2xy, not in the answer."""
    rng = np.random.default_rng(3)
    ids, x = rng.permutation(300), rng.integers(0, 1 << 20, 8) / (1 << 20) + rng.integers(0, 4, (300, 8)) / 4
    x[:, 0] = offset
    got = ann.nearest_in_block(ids, x, ids[:50], x[:50], 10)
    for q, v in zip(ids[:50], x[:50], strict=True):
        d = np.where(ids == q, np.inf, np.sqrt(((x - v) ** 2).sum(1)))
        assert ids[got[1][got[0] == q]].tolist() == ids[np.lexsort((ids, d))[:10]].tolist()


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (100, [2.0, 0.0]), (100, [2.0, 0.0]), (8, [])]
    got = found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    assert got == {0: [(6, 1.0), (100, 1.0)], 100: [(0, 1.0), (6, pytest.approx(2**0.5))]}
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_recall_of_the_forest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    ids = np.arange(6000)
    got, want = found(ann.search(table(spark, ids, x), 200)), brute(ids, x, 200, 10)
    assert set(got) == set(want) and all(len(r) == 10 for r in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9
    for q, r in got.items():
        for i, s in r:
            assert s == pytest.approx(np.sqrt(((x[i] - x[q]) ** 2).sum()), rel=1e-12)


def test_the_queue_visits_cells_in_the_order_of_their_turns():
    rng = np.random.default_rng(5)
    forest = ann.grow(rng.normal(size=(500, 6)), 3, 4, 1)
    for q in rng.normal(size=(20, 6)):
        turn = forest.turns(q)
        assert turn[forest.visits(q, forest.cells)].tolist() == list(range(1, forest.cells + 1))


@pytest.mark.parametrize("structured", [False, True])
def test_visits_follow_the_data(spark, structured):
    """Above one leaf the forest is at work; clusters need few of its leaves, an even spread many."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5000, 16)) / (20 if structured else 1) + (rng.normal(size=(40, 16))[rng.integers(0, 40, 5000)] if structured else 0)
    x = x.astype(np.float32).astype(float)
    ids = np.arange(5000)
    depth = ann.depth_for(5000, 5000)
    forest = ann.grow(x, 4, depth, 7)
    rows = table(spark, ids, x).selectExpr("vec_id", "embedding AS v")
    needed = np.sort(ann.visits_needed(rows, rows.where("vec_id % 50 = 0"), forest, 10))
    assert depth >= 3 and len(needed) == 1000
    share = needed[int(0.95 * len(needed))] / forest.cells
    assert share < 0.15 if structured else share > 0.15
    got, want = found(ann.search(table(spark, ids, x), 100)), brute(ids, x, 100, 10)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.93


def test_lower_levels_grow_inside_cells(spark, monkeypatch):
    """50,000 rows with a sample that is good for a few levels only: leaves stay small, few of them are visited, neighbours are found."""
    rng = np.random.default_rng(8)
    n = 50_000
    x = (rng.normal(size=(n, 12)) / 12 + rng.normal(size=(400, 12))[rng.integers(0, 400, n)]).astype(np.float32).astype(float)
    ids = np.arange(n)
    monkeypatch.setattr(ann, "LEAF_ROWS", 100)
    seen = []
    real = ann.deepened
    monkeypatch.setattr(ann, "deepened", lambda *a: seen.append((a[0].depth, real(*a))) or seen[-1][1])
    got, want = found(ann.search(table(spark, ids, x), 500, 10, sample_rows=1000)), brute(ids, x, 500, 10)
    (top, forest), = seen
    assert (top, forest.depth) == (6, 9)
    filed = np.bincount(forest.leaves(x).ravel(), minlength=forest.cells)
    assert np.median(filed) < 200 and filed.max() < 2000 and filed.sum() == 4 * n
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
    rows = table(spark, ids, x).selectExpr("vec_id", "embedding AS v")
    needed = np.sort(ann.visits_needed(rows, rows.where("vec_id % 1000 = 0"), forest, 10))
    assert needed[int(0.95 * len(needed))] < 0.1 * forest.cells


def test_doubles_stay_doubles(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.1, 0.0]), (2, [1e200, 0.0]), (3, [-1e200, 1e200]), (4, [1.0 + 2**-40, 0.0])]
    got = found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == {0: [(4, 2**-40), (1, 1.1 - 1.0), (2, 1e200), (3, pytest.approx(2**0.5 * 1e200))]}


def test_repeated_and_clashing_rows_of_vectors(spark):
    rows = [(0, [1.0, 0.0], 1, "x", 2), (1, [0.0, 1.0], 1, "x", 2), (1, [0.0, 1.0], 1, "x", 2), (1, [0.0, 3.0], 1, "x", 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, v string, _n int")
    assert found(ann.search(df)) == {0: [(1, pytest.approx(2**0.5))]}
