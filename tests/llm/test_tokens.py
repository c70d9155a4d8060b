"""Encoders against the public libraries; ORC output and packing against their definitions."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyarrow import orc
from tokenizers import Tokenizer

from quietday.llm import bpe, common, encoding, packing, token_orc
from quietday.llm.queries import BPE_JSON, BPE_RANKS, QUERIES
from tests.llm.common import documents, empty, odd

PIECES = ["<|endoftext|>", "\u3000", "\u2029", "×", ",", " ", "  ", "\n", " \n", "a", "b'", "é", "1", "½", "!", "\t", " ", "the", "ing", "日", "\x1c", "\x85", "'s", " ", "\r\n", "_", "***", "."]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def hf():
    t = Tokenizer.from_file(BPE_JSON)
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def tk():
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.coder(BPE_RANKS, public_tokenizers.PATTERN).ranks, special_tokens={})
    return lambda texts: [own.encode_ordinary(x or "") for x in texts]


def test_chunks_encode_as_whole_texts(hf, monkeypatch):
    texts = random_texts(3000, 1)
    for limit in (400_000, 40):  # with a memo that overflows too
        monkeypatch.setattr(encoding, "MEMO_CHUNKS", limit)
        enc = encoding.LibraryIds(BPE_JSON)
        assert chunked(enc, texts) == hf(texts)


def chunked(enc, texts):
    got = [enc.encode_many(pa.array(texts[a : a + 50], pa.string())) for a in range(0, len(texts), 50)]
    return [ids[a:b].tolist() for ids, ends in got for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_special_tokens_as_the_library_reads_them(hf):
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a\n <|endoftext|>b", "  <|endoftext|>  .", "a<|endoftext|>.", "<|endof text|>"]
    assert chunked(encoding.LibraryIds(BPE_JSON), texts) == hf(texts) and hf(texts)[0] == [87, 220, 50256, 331]
    plain = Tokenizer.from_file(BPE_JSON)
    plain.encode_special_tokens = True
    assert chunked(encoding.LibraryIds(BPE_JSON, True), texts) == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_segment_tree_encodes_as_the_library(tk):
    coder = bpe.BytePairs(BPE_RANKS, public_tokenizers.PATTERN)
    texts = random_texts(3000, 2) + ["a" * 3000, "ab" * 777, "é" * 500, "x", "", " " * 300, "thetheing" * 40]
    assert chunked(coder, texts) == tk(texts)


def test_round_trip_query_and_edges(spark, tk):
    docs = odd(spark)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(map(tuple, bpe.round_trip(docs, BPE_RANKS, public_tokenizers.PATTERN).collect()))
    ids = tk([t for _, t in texts])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted((d, len(i), sha(" ".join(map(str, i)).encode()), sha((t or "").encode())) for (d, t), i in zip(texts, ids, strict=True))
    decoded = bpe.decode(bpe.encode(docs, BPE_RANKS, public_tokenizers.PATTERN), BPE_RANKS, public_tokenizers.PATTERN)
    assert sorted((r["doc_id"], bytes(r["bytes"])) for r in decoded.collect()) == sorted((d, (t or "").encode()) for d, t in texts)
    assert bpe.round_trip(empty(spark), BPE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_op3_on_the_table(spark, sf, tk):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = dict(zip([r["doc_id"] for r in docs], tk([r["text"] for r in docs]), strict=True))
    got = QUERIES["op3_byte_bpe"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids[r["doc_id"]])).encode()).hexdigest()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_orc_places_and_checksums(spark, hf, tmp_path):
    docs = odd(spark).where("doc_id <> 10").repartition(3)
    out = str(tmp_path / "orc")
    token_orc.write_ids(docs, out, BPE_JSON, 2)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    start, want = 0, []
    for (d, _), ids in zip(rows, hf([t for _, t in rows]), strict=True):
        ids = [*ids, 2]
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, token_orc.read_index(spark, out).collect())) == want
    pruned = token_orc.read_ids(spark, out).where("doc_id = 8")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,8)]" in pruned._jdf.queryExecution().toString()
    assert pruned.first()["n_tokens"] == dict((d, n) for d, _, n, _ in want)[8]


def test_orc_of_repeated_rows_and_of_nothing(spark, tmp_path):
    token_orc.write_ids(odd(spark), str(tmp_path / "a"), BPE_JSON, 2)
    got = [r for r in token_orc.read_index(spark, str(tmp_path / "a")).collect() if r["doc_id"] == 10]
    assert len(got) == 2 and abs(got[0]["start"] - got[1]["start"]) == got[0]["n_tokens"]
    token_orc.write_ids(empty(spark), str(tmp_path / "b"), BPE_JSON, 2)
    assert token_orc.read_index(spark, str(tmp_path / "b")).count() == 0


def test_orc_starts_of_repeated_ids_are_those_of_the_files(spark, tmp_path):
    rows = [(5, "a a a a a a"), (5, "b"), (7, "c"), (None, "d d"), (None, None)] + [(6, "e " * (i % 7)) for i in range(300)] + [(6, "same")] * 300
    out = str(tmp_path / "orc")
    token_orc.write_ids(documents(spark, rows).repartition(4), out, BPE_JSON, 2)
    stored = []
    for file in sorted((tmp_path / "orc").glob("part-*.orc")):
        stored += [(r["doc_id"], r["ids"]) for r in orc.read_table(file).to_pylist()]
    assert [d for d, _ in stored] == sorted((d for d, _ in stored), key=lambda d: -1 if d is None else d)
    start, want = 0, []
    for d, ids in stored:
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, token_orc.read_index(spark, out).collect()), key=lambda r: r[1]) == want


def test_orc_files_have_stripes_indexes_and_bloom_filters(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(str(rng.randrange(10**9)) for _ in range(400))) for i in range(3000)]
    monkeypatch.setitem(token_orc.ORC_OPTIONS, "orc.stripe.size", str(1 << 18))
    token_orc.write_ids(documents(spark, rows).coalesce(1), str(tmp_path / "orc"), BPE_JSON, 2)
    paths = list((tmp_path / "orc").glob("part-*.orc"))
    files = [orc.ORCFile(f) for f in paths]
    assert sum(f.nrows for f in files) == 3000 and all(f.row_index_stride == 1000 for f in files)
    assert sum(f.nstripes for f in files) > len(files)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(paths[0])), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    footer = reader.rows().readStripeFooter(reader.getStripes()[0])
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= {str(footer.getStreams(i).getKind()) for i in range(footer.getStreamsCount())}


def check_packing(rows, texts, hf, capacity, end):
    ids = {d: [*i, end] for (d, _), i in zip(texts, hf([t for _, t in texts]), strict=True)}
    bins = {}
    for r in rows:
        assert crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for d, parts in pieces.items():
        n = len(ids[d])
        if len({p for p, _, _ in parts}) == len(parts):
            parts.sort()
            assert sum(length for _, _, length in parts) == n and all(length == capacity for _, _, length in parts[1:])
            assert len(parts) == -(-n // capacity)
    return len(bins)


def test_packing_edges(spark, hf):
    docs = odd(spark)
    rows = packing.pack_documents(docs, BPE_JSON, 0, 64).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], hf, 64, 0)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    assert packing.pack_documents(empty(spark), BPE_JSON, 0, 64).count() == 0
    whole = packing.pack_documents(documents(spark, [(1, None), (2, "a")]), BPE_JSON, 0, 2).collect()
    assert sorted((r["doc_id"], r["length"]) for r in whole) == [(1, 1), (2, 2)]


def test_op9_on_the_table_is_near_the_bound(spark, sf, hf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op9_best_fit_packing"](spark, sf).collect()
    bins = check_packing(rows, docs, hf, 2048, 0)
    assert bins <= 1.01 * -(-sum(r["length"] for r in rows) // 2048)


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, rng.integers(1, 400)) if seed % 2 else rng.choice([34, 35, 66, 67, 50, 33, 1, 100], 300)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan = packing.plan(dict(counts), 100)
    got = {}
    for parts, m in plan:
        assert sum(parts) <= 100 and m > 0 and sum(3 * k > 100 for k in parts) <= 2
        for k in parts:
            got[k] = got.get(k, 0) + m
    assert got == counts
    bins = []  # best fit decreasing, one by one
    for k in sorted(lengths.tolist(), reverse=True):
        fits = [i for i, b in enumerate(bins) if b >= k]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= k
        else:
            bins.append(100 - k)
    assert sum(m for _, m in plan) <= len(bins) * 1.03 + 1


def test_batches_are_bounded_by_bytes():
    texts = ["a" * n for n in (10, common.BATCH_BYTES - 5, 1, 0, common.BATCH_BYTES * 2, 7, 7)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["id", "text"])
    for b in (batch, batch.slice(1, 5)):
        parts = list(common.bounded(iter([b])))
        assert [r for p in parts for r in p.to_pylist()] == b.to_pylist()
        assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= common.BATCH_BYTES for p in parts)
    assert list(common.bounded(iter([batch.slice(0, 0)]))) == []


def test_long_texts_in_small_parts(spark, hf, monkeypatch):
    """Packing and token files of texts beyond the bound of a batch."""
    docs = documents(spark, [(1, "word and more. " * 4000), (2, "x"), (3, None), (4, "y z " * 30_000)])
    monkeypatch.setattr(common, "BATCH_BYTES", 1000)
    rows = packing.pack_documents(docs, BPE_JSON, 0, 512).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], hf, 512, 0)
