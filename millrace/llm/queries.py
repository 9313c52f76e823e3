"""The registered queries of this subpackage and, where SQL can express them, their equivalents for a SQL engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, mixing, packing, pii, quality_classifier, quality_rules, sharding, simhash, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    """The vocabulary's file on this machine; every executor holds the same package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.rate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.write_archive(_table(spark, sf_dir, "pages"), folder, min_revisit_bytes=0)
    return warc.read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, max_bits=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, _table(spark, sf_dir, "labels"))
    out = quality_classifier.select_documents(docs.select("doc_id", "text"), model)
    return out.select("doc_id", "expected_grade", F.get("tail", 0).alias("tail_1"), "selected")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer(), capacity=2048)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py``, which is deleted together with this subpackage."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def quality_rules_sql() -> str:
    """Operator 4 for a SQL engine with lists: windows of words are compared as texts, lines by the same patterns."""
    q = {k: "'" + v.replace("'", "''") + "'" for k, v in (
        ("word", quality_rules.WORD), ("blank", quality_rules.BLANK), ("symbols", quality_rules.SYMBOLS), ("ends", quality_rules.ENDS),
        ("navigation", quality_rules.NAVIGATION), ("boilerplate", quality_rules.BOILERPLATE),
    )}
    return f"""
        WITH body AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
        ), split AS (
            SELECT r, doc_id, text, regexp_extract_all(text, {q["word"]}) AS words,
                [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, {q["word"]})] AS lines
            FROM body
        ), placed AS (
            SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM split
        ), windows AS (
            SELECT r, i, concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w) AS five,
                lead(i, 4) OVER w AS last
            FROM placed WINDOW w AS (PARTITION BY r ORDER BY i)
        ), twice AS (
            SELECT r, i, count(*) OVER (PARTITION BY r, five) AS times FROM windows WHERE last IS NOT NULL
        ), repeats AS (
            SELECT r, count(DISTINCT i + k) AS n_repeat_words
            FROM twice, (SELECT unnest(range(5)) AS k) WHERE times > 1 GROUP BY r
        ), lines AS (
            SELECT r, line, length(line) AS n, len(regexp_extract_all(line, {q["symbols"]})) AS symbols, len(regexp_extract_all(line, {q["word"]})) AS words,
                len(regexp_extract_all(line, '\\p{{L}}')) AS letters, len(regexp_extract_all(line, '\\p{{Lu}}')) AS upper
            FROM (SELECT r, unnest(lines) AS line FROM split)
        ), good AS (
            SELECT r, sum(length(regexp_replace(line, {q["blank"]}, '', 'g'))) AS word_chars
            FROM lines
            WHERE NOT (words < 3 AND NOT regexp_matches(line, {q["ends"]})) AND symbols * 10 <= n AND NOT (upper * 2 > letters AND letters >= 20)
                AND NOT regexp_matches(line, {q["navigation"]}) AND NOT regexp_matches(line, {q["boilerplate"]})
            GROUP BY r
        ), counts AS (
            SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_words,
                CAST(coalesce(list_sum([length(x) FOR x IN words]), 0) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(text, {q["symbols"]})) AS BIGINT) AS n_symbols,
                CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
            FROM split LEFT JOIN repeats USING (r)
        ), judged AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
        )
        SELECT doc_id, n_words, judged.word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND 2 * coalesce(good.word_chars, 0) >= judged.word_chars AS kept
        FROM judged LEFT JOIN good USING (r)
    """


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_mixing": op2_mixing,
        "op3_pii": op3_pii,
        "op4_quality_rules": op4_quality_rules,
        "op5_warc": op5_warc,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_simhash": op7_simhash,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_sharding": op9_sharding,
        "op10_packing": op10_packing,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """Operator 4 in SQL; the others rest on hashes, models, checksums, archives or a tokenizer."""
    return {"op4_quality_rules": quality_rules_sql()}
