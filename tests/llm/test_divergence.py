"""The divergence audit against brute force, also where SQL's plain form wouldn't be asked: odd rows, many sources, deep searches."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quietday.llm import divergence
from quietday.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.common import documents, empty, odd
from tests.twin import assert_twin, connect


def plain(rows, least, top):
    """(lang, source, part, item, value, rank) by exact whole numbers, term by term."""
    in_docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    found = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in in_docs[lang].items() if n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        total = Counter()
        for s in sources:
            total.update(counts[lang, s])

        def share(c, kept=kept):
            below = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // below for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(total)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, values, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    found.append((lang, s, part, item, value, rank))
    return sorted(found)


def got(docs, least, top):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.source_divergence(docs, least, top).collect())


def rows_of(docs):
    return [tuple(r) for r in docs.select("text", "lang", "source").collect()]


def test_twin(spark, sf):
    assert assert_twin(spark, connect(sf), sf, QUERIES["op13_source_divergence"], ORACLE_SQL["op13_source_divergence"]) > 1000


def test_odd_rows_and_empty_tables(spark):
    docs = odd(spark).unionByName(documents(spark, [(50, "one two", None), (51, None, "xx"), (52, "solo", "xx"), (53, "Ää É ein\x00zwei [drei] 4vier"), (53, "Ää É ein\x00zwei [drei] 4vier")]))
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"))))
    for least in (1, 2, 1000):
        assert got(docs, least, 3) == plain(rows_of(docs), least, 3)
    assert got(empty(spark), 1, 3) == []


def test_many_sources_and_deep_searches(spark):
    """More sources than a block holds; many terms of equal value, so that buckets of equal bounds have to be opened."""
    rng = random.Random(4)
    words = [f"w{i}x" for i in range(1500)]
    rows = [(i, " ".join(rng.choice(words[: 40 if i % 3 else 1500]) for _ in range(rng.randrange(3, 30)))) for i in range(300)]
    rows += [(1000, " ".join(words)), (1001, " ".join(words[:700] * 2)), (1002, " ".join(w for i, w in enumerate(words) for _ in range(i % 90)))]
    docs = documents(spark, rows).withColumn("source", F.concat(F.lit("s"), F.col("doc_id").cast("string"))).withColumn("lang", F.lit("en"))
    docs = docs.unionByName(docs.where("doc_id >= 1000").withColumn("source", F.lit("s7")).withColumn("lang", F.lit("de")))
    assert got(docs, 1, 50) == plain(rows_of(docs), 1, 50)


def test_workers_hand_on_what_they_counted(spark, monkeypatch):
    docs = odd(spark)
    monkeypatch.setattr(divergence, "TERMS", 3)
    batches = docs.select("lang", "source", F.coalesce("text", F.lit("")).alias("text")).toArrow().to_batches(max_chunksize=2)
    counted = Counter()
    for batch in divergence._count(iter(batches)):
        for r in batch.to_pylist():
            counted[r["term"]] += r["n"]
    want = Counter(t for r in docs.select("text").collect() for t in divergence.terms_of((r["text"] or "").encode()))
    assert {t.encode(): n for t, n in counted.items()} == dict(want)
