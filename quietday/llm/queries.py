"""The registered queries of the ten operators and the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietday.llm import ann, bpe, chat, divergence, exact_dedup, fingerprints, html, langid, packing, periodic, quality, simhash, token_orc
from quietday.llm.common import scratch_path, spread, table, text_or_empty

BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")


BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def fold(of: int, column: str = "doc_id") -> Column:
    """crc32 of the decimal id modulo `of`; a null id is in no fold."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(of))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = langid.train(docs.where(fold(4) != 2))
    found = langid.predict(docs, model)
    return found.select("doc_id", (F.coalesce(fold(4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    model = quality.fit(docs.where(fold(3) != 1), labels)
    found = quality.predict(docs, model)
    return found.select("doc_id", (F.coalesce(fold(3), F.lit(0)) == 1).alias("held_out"), "score", "predicted")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(spread(table(spark, sf_dir, "documents")), BPE_RANKS, public_tokenizers.PATTERN)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(spread(table(spark, sf_dir, "pages")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op7_rp_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-ids")
    token_orc.write_ids(table(spark, sf_dir, "documents"), out, BPE_JSON, end_id=2)
    return token_orc.read_index(spark, out)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spread(table(spark, sf_dir, "documents")), BPE_JSON, end_id=0, capacity=2048)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts goes on in repeats of p words from word a on; words of these are joined by one space."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.floor(number / 10).alias("g"), (number % 10 == 0).alias("tenth"))
    rows = rows.withColumn("words", F.when(F.col("tenth"), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))))
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    root = F.slice("words", a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(root, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    edited = F.concat_ws(" ", F.slice("words", F.lit(1), a), tail)
    return rows.select("doc_id", F.when(F.col("tenth") & (n > 0), edited).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_periodic_tails(spread(table(spark, sf_dir, "documents"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_versions(spread(table(spark, sf_dir, "documents"))).drop("next_id")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(spread(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_quality_classifier, op3_byte_bpe, op4_html_extraction, op5_exact_dedup, op6_chat_formatting, op7_rp_forest_neighbours, op8_token_orc, op9_best_fit_packing, op10_simhash_near_dedup, op11_periodic_runs, op12_document_fingerprints, op13_source_divergence)
}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORM} AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
        FROM d JOIN g USING (norm)""",
    "op6_chat_formatting": """
        WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
             p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos FROM t),
             c AS (SELECT conv_id, list(role || chr(31) || text ORDER BY pos) AS turns, count(*) AS n_turns FROM p GROUP BY conv_id),
             m AS (SELECT * FROM c a
                   WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.n_turns > a.n_turns AND b.turns[1] = a.turns[1] AND b.turns[1:a.n_turns] = a.turns)
                     AND NOT EXISTS (SELECT 1 FROM c b WHERE b.turns = a.turns AND b.conv_id < a.conv_id))
        SELECT p.conv_id, CAST((pos - 1) // 256 AS INTEGER) AS part, n_turns,
               string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY pos) AS text
        FROM p JOIN m USING (conv_id) GROUP BY 1, 2, 3""",
    "op12_document_fingerprints": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
             o AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (ORDER BY doc_id)) AS next FROM d),
             e AS (SELECT *, left(text, n - n // 2) || left(next, n // 2) AS edited FROM o),
             t AS (SELECT doc_id, 'a' AS k, text AS t FROM e UNION ALL SELECT doc_id, 'b', edited FROM e UNION ALL SELECT doc_id, 'c', next FROM e),
             x AS (SELECT doc_id, k, unnest(regexp_split_to_array(t, '{fingerprints.PARTING}')) AS x FROM t),
             g AS (SELECT DISTINCT doc_id, k, ('0x' || substr(md5(x), 1, 15))::BIGINT AS key FROM x WHERE x <> ''),
             h AS (SELECT *, key >> 30 AS hi, key & {(1 << 30) - 1} AS lo FROM g),
             r AS (SELECT *, (hi * {fingerprints.CHECK[0]} + lo * {fingerprints.CHECK[1]}) % {fingerprints.PRIME} AS chk,
                          [lo % 4, hi % 4, ((hi * {fingerprints.THIRD[0]} + lo * {fingerprints.THIRD[1]}) % {fingerprints.PRIME}) % 4] AS at FROM h),
             grid AS (SELECT doc_id, k, i, j FROM t, range(3) a(i), range(4) b(j)),
             c AS (SELECT g.doc_id, g.k, i, j, count(key) AS n, coalesce(bit_xor(key), 0) AS key, coalesce(bit_xor(chk), 0) AS chk
                   FROM grid g LEFT JOIN r ON r.doc_id = g.doc_id AND r.k = g.k AND r.at[i + 1] = j WHERE g.k <> 'c' GROUP BY ALL),
             f AS (SELECT doc_id, k, string_agg(lower(lpad(to_hex(n), 8, '0') || lpad(to_hex(key), 15, '0') || lpad(to_hex(chk), 8, '0')), '' ORDER BY i, j) AS f FROM c GROUP BY ALL),
             n AS (SELECT doc_id, count(*) FILTER (k = 'a') AS na, count(*) FILTER (k = 'b') AS nb, count(*) FILTER (k = 'c') AS nc FROM g GROUP BY doc_id),
             s AS (SELECT a.doc_id, count(*) FILTER (b.k = 'b') AS sb, count(*) FILTER (b.k = 'c') AS sc
                   FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.key = b.key AND a.k = 'a' AND b.k <> 'a' GROUP BY 1),
             q AS (SELECT e.doc_id, e.n, e.edited, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb, coalesce(nc, 0) AS nc, coalesce(sb, 0) AS sb, coalesce(sc, 0) AS sc
                   FROM e LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id))
        SELECT q.doc_id, q.n AS n_chars, sha256(edited) AS edited_sha256, fa.f AS fingerprint, fb.f AS edited_fingerprint,
               CASE WHEN na + nb = 0 THEN 1.0 ELSE sb / (na + nb - sb) END AS near_edited,
               CASE WHEN na + nc = 0 THEN 1.0 ELSE sc / (na + nc - sc) END AS near_next
        FROM q JOIN f fa ON fa.doc_id = q.doc_id AND fa.k = 'a' JOIN f fb ON fb.doc_id = q.doc_id AND fb.k = 'b'""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
             w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
             k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 30),
             l AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
             c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
             s AS (SELECT DISTINCT lang, source FROM d),
             g AS (SELECT s.lang, s.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM s LEFT JOIN c ON c.lang = s.lang AND c.source = s.source GROUP BY ALL),
             p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                          1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * l.v) AS p,
                          1 + (1000000000::HUGEINT * (k.total + 5)) // (l.n + 5 * l.v) AS q
                   FROM g JOIN l ON l.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
             f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
                   FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
                   UNION ALL
                   SELECT a.lang, a.source, 'pair', b.source, 0 FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM l)
                   UNION ALL
                   SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM f)
        WHERE part = 'pair' OR rank <= 50""",
}
