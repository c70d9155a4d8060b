"""Exact and near dedup against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quietday.llm import exact_dedup, simhash
from quietday.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.common import EN, documents, empty, odd, prose
from tests.twin import assert_twin, connect


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("hasher", [exact_dedup.content_hash, lambda c: F.length(c).cast("string").cast("binary")])
def test_exact_groups(spark, hasher):
    """Also with a hash that collides: texts of one length share it."""
    docs = odd(spark).unionByName(documents(spark, [(None, "Hello  World\n\n x"), (None, "alone")]))
    rows = docs.select("doc_id", "text").collect()
    got = exact_dedup.exact_groups(docs, keep="max", hasher=hasher).collect()
    assert len(got) == len(rows)
    want = []
    for r in rows:
        same = [x["doc_id"] for x in rows if lower(x["text"]) == lower(r["text"])]
        keep = max((x for x in same if x is not None), default=None)
        want.append((r["doc_id"], keep, len(same), r["doc_id"] == keep, hashlib.sha256(lower(r["text"]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in got)


def test_exact_drop_keeps_rows_and_columns(spark):
    docs = odd(spark)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 6, 7, 8, 10, 10, 11, 12, 13, 14, 15, 16, 17]


def test_drops_go_by_id_and_text(spark):
    """Copies go; another text under a dropped row's id stays, with or without an id."""
    one, two, three = (prose(EN, 80, i) for i in (3, 4, 5))
    docs = documents(spark, [(1, one), (2, one), (2, two), (None, one), (None, three), (None, None)])
    want = sorted([(1, one), (2, two), (None, three), (None, None)], key=str)
    for kept in (exact_dedup.drop_exact_copies(docs), simhash.drop_near_copies(docs)):
        assert kept.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == want


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, rows without ids and different near-copies under the least id: by counts of rows."""
    one, two = prose(EN, 300, 3), prose(EN, 300, 4)
    docs = documents(spark, [(1, one)] * 5 + [(2, one)] + [(None, two)] * 4 + [(None, None)] * 3)
    for keep, least in (("min", 1), ("max", 2)):
        assert sorted(((r["doc_id"], r["text"] or "") for r in exact_dedup.one_exact_copy(docs, keep=keep).collect()), key=str) == sorted([(least, one), (None, two), (None, "")], key=str)
    assert sorted(((r["doc_id"], r["text"] or "") for r in simhash.drop_near_copies(docs).collect()), key=str) == sorted([(1, one), (None, two), (None, "")], key=str)
    near = [one, one.upper(), one + " "]
    assert simhash.drop_near_copies(documents(spark, [(7, t) for t in near] + [(8, one)])).count() == 1
    assert simhash.drop_near_copies(documents(spark, [(None, t) for t in near])).count() == 1


def test_empty_tables(spark):
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_exact_twin(spark, sf):
    assert assert_twin(spark, connect(sf), sf, QUERIES["op5_exact_dedup"], ORACLE_SQL["op5_exact_dedup"]) == 1000


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(rows):
    """doc id -> (hex fingerprint, least id reachable), by all pairs."""
    prints = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, f"{prints[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))


def test_near_duplicates_match_all_pairs(spark):
    near = [(100 + i, prose(EN, 300, 7)[: -1 - 6 * i] + f" tail{i}") for i in range(12)]
    docs = odd(spark).unionByName(documents(spark, near))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = simhash.near_duplicates(docs)
    assert sorted(map(tuple, got.collect())) == plain_components(rows)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in plain_components(rows)}


@pytest.mark.parametrize("n", [5, 60, 400])
def test_bucket_trees_keep_every_link(n):
    rng = np.random.default_rng(n)
    free = rng.choice(64, 16, replace=False)
    prints = np.unique([sum(1 << int(b) for b in rng.choice(free, rng.integers(0, 9), replace=False)) for _ in range(n)]).astype(np.uint64)
    tree = simhash.bucket_tree(prints.view(np.int64))
    groups = {int(p): int(p) for p in prints.view(np.int64)}
    groups.update(tree)
    signed = prints.view(np.int64)
    order = {int(v): i for i, v in enumerate(signed)}
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if int(prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert all(order[root] == find(order[node]) for node, root in groups.items())


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1001 + i) for i in range(40)]
    zigzag = [(2000 + (i * 37) % 50, 2000 + ((i + 1) * 37) % 50) for i in range(49)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(chain + star + zigzag, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(61)) and all(got[1001 + i] == 1000 for i in range(40)) and all(got[2000 + i] == 2000 for i in range(50))
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pigeonhole_finds_links_at_any_two_bits(spark):
    base = 0x0123456789ABCDEF
    prints = [base] + [base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(a + 1, 64, 7)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    labels = dict(map(tuple, simhash.components(simhash.links(df)).collect()))
    assert len(labels) == len(prints) and len(set(labels.values())) == 1
