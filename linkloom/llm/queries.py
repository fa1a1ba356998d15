"""Queries of the operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, language_id, line_dedup, quality_rules, simhash_golay, token_counts, toxicity, warc
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, counted and counted again after four edits at places set by its length."""
    n = F.length(F.coalesce("text", F.lit("")))
    change = lambda at, size, new: F.struct((n * at).cast("int").alias("start"), ((n * at).cast("int") + size).alias("stop"), F.lit(new).alias("text"))
    edits = F.array(change(0.2, 0, " it's 42 "), change(0.4, 7, ""), change(0.6, 5, "  words,\n"), change(0.8, 1, "é"))
    return token_counts.token_counts(table(spark, sf_dir, "documents").withColumn("edits", edits), edits="edits")


def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_golay.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (document, benchmark item) pairs with a window of similarity 0.8 or more."""
    pairs = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "similarity")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op6_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text cleaned."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_gone").alias("n_removed"), "text")


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the chain's probabilities and the verdict."""
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.predict(docs, chain).withColumn("toxic", F.col("p_toxic") >= toxicity.REJECT)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs))
    return found.select("doc_id", F.coalesce(language_id.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_windows(chat.format_conversations(turns)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_simhash_golay, op3_decontamination, op4_quality_rules, op5_byte_bpe, op6_warc_revisit, op7_line_dedup, op8_toxicity_chain, op9_language_id, op10_chat_windows, pipeline)
}

_grams = ", ".join(f"string_agg(w, ' ') OVER (PARTITION BY d ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS g{n}" for n in quality_rules.NGRAM_LIMITS)
_marks = ", ".join(f"CASE WHEN i + {n - 1} <= c AND row_number() OVER (PARTITION BY d, g{n}, i + {n - 1} <= c ORDER BY i) > 1 THEN 1 ELSE 0 END AS m{n}" for n in quality_rules.NGRAM_LIMITS)
_covers = ", ".join(f"max(m{n}) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS v{n}" for n in quality_rules.NGRAM_LIMITS)
_sums = ", ".join(f"sum(v{n} * length(w)) AS s{n}" for n in quality_rules.NGRAM_LIMITS)
_bad = " OR ".join(f"coalesce(s{n}, 0) > {limit} * word_chars" for n, limit in quality_rules.NGRAM_LIMITS.items())

ORACLE = {
    "op4_quality_rules": f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS text FROM documents),
lists AS (SELECT d, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM docs),
words AS (SELECT d, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS c FROM lists),
grams AS (SELECT d, w, i, c, {_grams} FROM words),
marks AS (SELECT d, w, i, {_marks}, CASE WHEN i + 7 <= c AND count(*) OVER (PARTITION BY d, g8, i + 7 <= c) > 1 THEN 1 ELSE 0 END AS r8 FROM grams),
covers AS (SELECT d, w, {_covers}, max(r8) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS r FROM marks),
per AS (SELECT d, count(*) AS n_words, sum(length(w)) AS word_chars, sum(r) AS n_repeat_words, {_sums} FROM covers GROUP BY d),
lines AS (SELECT d, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
again AS (SELECT d, l, row_number() OVER (PARTITION BY d, l ORDER BY i) > 1 AS later FROM lines WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
per_line AS (SELECT d, count(*) AS n_dup_lines, sum(length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g'))) AS line_chars FROM again WHERE later GROUP BY d),
base AS (
 SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(line_chars, 0) AS line_chars, {", ".join(f"s{n}" for n in quality_rules.NGRAM_LIMITS)}
 FROM docs LEFT JOIN per USING (d) LEFT JOIN per_line USING (d)),
said AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
 CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT (base_failed OR line_chars > {quality_rules.LINE_LIMIT} * word_chars OR {_bad}) AS kept
FROM said""",
    "op6_warc_revisit": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS last FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
 CASE WHEN last <> page_id OR page_id IS NULL AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN last <> page_id OR page_id IS NULL AND last IS NOT NULL THEN last END AS refers_to
FROM q""",
}
