"""Sketches and edited versions against plain sets, with sketches that are too small at first."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quietday.llm import fingerprints
from quietday.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.common import documents, empty, odd
from tests.twin import assert_twin, connect


def plain_digests(text):
    return {int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for x in re.split(fingerprints.PARTING, text) if x}


def likeness(a, b):
    a, b = plain_digests(a), plain_digests(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_rows(rows):
    """(doc_id, n_chars, edited_sha256, near_edited, near_next, next_id) of rows in order."""
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{'-' if r[0] is None else r[0]}:{r[1] or ''}".encode()).digest())
    rows = sorted(rows, key=key)
    out = []
    for i, (doc_id, text) in enumerate(rows):
        next_id, after = rows[(i + 1) % len(rows)]
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(text, edited), likeness(text, after), next_id))
    return sorted(out, key=str)


def test_twin(spark, sf):
    assert assert_twin(spark, connect(sf), sf, QUERIES["op12_document_fingerprints"], ORACLE_SQL["op12_document_fingerprints"]) == 1000


@pytest.mark.parametrize("turns", [3, 1])  # one turn leaves many pairs to larger sketches
def test_odd_rows(spark, turns):
    rng = random.Random(2)
    text = lambda n: ". ".join(str(rng.randrange(1000)) for _ in range(n)) + "\n"
    made = [(100 + i, text(rng.randrange(1, 200))) for i in range(30)] + [(None, "a. b. c. d"), (None, "x"), (7, "other\ntext"), (101, text(3))] + [(200, "again. and again. x")] * 3
    docs = odd(spark).unionByName(documents(spark, made))
    got = fingerprints.edited_versions(docs, turns=turns).collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = plain_rows(rows)
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"], r["next_id"]) for r in got), key=str) == want
    prints = {}
    for r in got:
        assert len(r["fingerprint"]) == 12 * 31
        prints.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert len(prints[200, 19]) == 1


def test_empty_and_single(spark):
    assert fingerprints.edited_versions(empty(spark)).count() == 0
    one = fingerprints.edited_versions(documents(spark, [(3, "ab. cd. ef. gh")])).collect()[0]
    assert (one["next_id"], one["near_next"], one["edited_sha256"]) == (3, 1.0, hashlib.sha256(b"ab. cd.ab. cd.").hexdigest())


def test_differences_recover_digests(spark):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        a = [rng.randrange(1 << 60) for _ in range(rng.randrange(400))]
        b = [x for x in a if rng.random() < 0.8] + [rng.randrange(1 << 60) for _ in range(rng.randrange(30))]
        rows.append((i, a + a[:3], b))
    rows += [(100, None, [5, 6]), (101, [], []), (102, [5], [5]), (103, [1], None)]
    pairs = spark.createDataFrame(rows, "name long, l array<long>, r array<long>")
    for expected in (None, F.lit(2)):  # the second is far too small for most
        got = {r["name"]: (r["left_only"], r["right_only"]) for r in fingerprints.differences(pairs, "name", "l", "r", expected).collect()}
        assert got == {n: (sorted(set(a or []) - set(b or [])), sorted(set(b or []) - set(a or []))) for n, a, b in rows}
    assert fingerprints.differences(pairs.limit(0), "name", "l", "r").count() == 0


def test_sketches_subtract(spark):
    a, b = [1, 2, 3, 1 << 59], [2, 3, 4]
    row = spark.createDataFrame([(a, b, [1, 1 << 59], [4])], "a array<long>, b array<long>, c array<long>, d array<long>")
    s = fingerprints.sketch
    got = row.select(fingerprints.subtract(s("a"), s("b")).alias("x"), fingerprints.subtract(s("c"), s("d")).alias("y")).first()
    assert got["x"] == got["y"]
