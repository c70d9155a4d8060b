"""The pipeline against a plain version of each stage on its own input, and on odd tables."""

import corpus_pipeline
from quietday.llm import langid, quality
from tests.llm.common import DE, EN, documents, odd, prose
from tests.llm.test_dedup import lower, plain_components


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def write(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(100, 160)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def corpus(spark):
    good = [(i, prose(EN if i % 2 else DE, 60, i), "en" if i % 2 else "de") for i in range(100, 160) if i % 3]
    bad = [(i, " | ".join(prose(EN if i % 2 else DE, 60, i).upper().split()) + " |", "en" if i % 2 else "de") for i in range(100, 160) if not i % 3]
    copies = [(1000 + i, good[i][1].upper(), good[i][2]) for i in range(5)] + [(2000 + i, good[i][1] + " x", good[i][2]) for i in range(5)]
    return documents(spark, good + bad + copies).unionByName(odd(spark))


def test_stages_on_their_own_inputs(spark, tmp_path):
    sf = write(spark, tmp_path, corpus(spark))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = stage("language_id")(spark, docs, sf)
    assert out.columns == docs.columns
    want = {r["doc_id"] for r in langid.predict(docs, langid.train(docs)).where("not rejected").collect()}
    assert {r["doc_id"] for r in out.collect()} == want and {100, 101, 103} & want and not {1, 2, 3, 14} & want
    out = stage("quality_classifier")(spark, docs, sf)
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in quality.predict(docs, model).where("predicted = 1").collect()}
    out = stage("exact_dedup")(spark, docs, sf)
    least = {}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for d, t in rows:
        least[lower(t)] = min(least.get(lower(t), d), d)
    assert {r["doc_id"] for r in out.collect()} == set(least.values())
    out = stage("simhash_near_dedup")(spark, docs, sf)
    assert {r["doc_id"] for r in out.collect()} == {c for _, _, c in plain_components(rows)}


def test_run_is_the_stages_in_order(spark, tmp_path):
    sf = write(spark, tmp_path, corpus(spark))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_dedup_stages_leave_one_row_of_each_group(spark, tmp_path):
    text = prose(EN, 80, 1)
    docs = documents(spark, [(1, text)] * 4 + [(None, None)] * 3 + [(None, prose(DE, 80, 2))] * 3)
    for name in ("exact_dedup", "simhash_near_dedup"):
        assert stage(name)(spark, docs, str(tmp_path)).count() == 3


def test_empty_tables(spark, tmp_path):
    sf = write(spark, tmp_path, documents(spark, []))
    assert corpus_pipeline.run(spark, sf).count() == 0
