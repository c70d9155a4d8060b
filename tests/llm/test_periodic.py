"""Periodic runs against brute force, the sweep against plain comparisons, and its linear time."""

import hashlib
import random
import re
import zlib

import pytest

from quietday.llm import periodic
from quietday.llm.queries import QUERIES
from tests.llm.common import documents, empty, odd


def plain_runs(w, least=24, times=3):
    """All maximal runs, period by period."""
    found = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            n = i - start + p
            if n >= max(least, times * p) and all(any(w[start + k] != w[start + k + q] for k in range(n - q)) for q in range(1, p)):
                found.append((start, n, p))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_lyndon(w):
    nss, share = [], []
    for i in range(len(w)):
        j = next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w))
        m = 0
        while j + m < len(w) and w[i + m] == w[j + m]:
            m += 1
        nss.append(j)
        share.append(m)
    return nss, share


def words(rng, most=40):
    w = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(most))]
    if w and rng.random() < 0.6:
        w = w[: rng.randrange(1, 6)] * rng.randrange(2, 12) + w[: rng.randrange(4)]
        w += [rng.randrange(3)] + w if rng.random() < 0.5 else []
    return w


def test_sweep_equals_plain_comparisons():
    rng = random.Random(7)
    for _ in range(3000):
        w = words(rng)
        assert periodic.lyndon_array(w) == plain_lyndon(w)
        assert periodic.runs_of(w, 3, 3) == plain_runs(w, 3, 3)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize(
    "w",
    [
        [0] * 20_000,
        fibonacci(20_000),
        [i.bit_count() & 1 for i in range(20_000)],
        ([0] * 140 + [1]) * 140,
        [random.Random(1).randrange(2) for _ in range(20_000)],
        [x for i in range(200) for x in [0] * i + [1]],
        [x for i in range(200, 0, -1) for x in [0] * i + [1]],
        random.Random(2).choices(range(50), k=700) * 28,
    ],
)
def test_sweep_reads_a_word_a_few_times(w):
    for order in (w, [-x for x in w], w[::-1]):
        periodic.Sweep.compared = 0
        periodic.lyndon_array(order)
        assert periodic.Sweep.compared <= 4 * len(w)


def plain_row(doc_id, text, edit=False):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if edit:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return w, runs, best, " ".join(x for i, x in enumerate(w) if i not in gone)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        if len((text or "").split()) > 1500:
            continue  # the plain version takes the square
        _, runs, best, kept = plain_row(doc_id, text, edit=True)
        r = got[doc_id]
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert sum(r["n_runs"] for r in got.values()) > 5


def test_odd_texts(spark):
    rng = random.Random(3)
    made = [(100 + i, " ".join(f"w{x}" for x in words(rng, 90))) for i in range(60)]
    made += [(1000, "é  x y\n" * 9), (1001, "a " * 24), (1002, "a " * 23), (1003, "A a " * 12 + "A"), (1004, ("a b c d e f g h i " * 3)[:-1]), (None, "z " * 30), (None, None), (1001, "a " * 24)]
    docs = odd(spark).unionByName(documents(spark, made))
    got = sorted(((r["doc_id"] or -1, r["n_words"], [tuple(x) for x in r["runs"]], r["strongest"] and tuple(r["strongest"]), r["collapsed"]) for r in periodic.periodic_runs(docs).collect()), key=str)
    want = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        long = doc_id in (8, 9)  # 20,000 random words
        w, runs, best, kept = plain_row(doc_id, text) if not long else (text.split(), [], None, " ".join(text.split()))
        want.append((doc_id or -1, len(w), runs, best, kept))
    assert got == sorted(want, key=str)
    assert periodic.periodic_runs(empty(spark)).count() == 0


def test_cut_at_rare_words_loses_no_run():
    rng = random.Random(5)
    texts = [" ".join(f"w{x}" for x in words(rng, 200) + words(rng, 200)).encode() for _ in range(300)]
    assert periodic.find_runs(texts) == periodic.find_runs(texts, narrow=False)
