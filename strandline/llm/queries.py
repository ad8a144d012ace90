"""The numbered operators bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import (
    alignment,
    bucket_digest,
    chat,
    decontaminate,
    html_text,
    language_id,
    licenses,
    line_dedup,
    packing,
    prefix_trie,
    quality_model,
    quality_rules,
    simhash_dedup,
)
from strandline.llm.divergence_sql import divergence_sql
from strandline.llm.prefix_trie_sql import prefix_trie_sql

Job = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Job] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def register(job: Job) -> Job:
        QUERIES[name] = job
        if sql is not None:
            SQL[name] = sql
        return job

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def piece_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe_path())


@query("op2_prefix_target_chat")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    trial = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.examples(rows.unionByName(trial)))


OP4_SQL = """
WITH lines AS (
    SELECT doc_id, pos, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
repeated AS (
    SELECT k, max(doc_id) AS keep FROM lines WHERE length(k) >= 20
    GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
    SELECT l.doc_id, l.pos, l.line, r.keep IS NOT NULL AND l.doc_id <> r.keep AS lost
    FROM lines l LEFT JOIN repeated r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), ''))
           AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op4_line_dedup", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return line_dedup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", kept)


@query("op9_simhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


#: The contract's base phrase for mit is longer than the library's, which goes on as a label.
OP5_TEMPLATES = (
    licenses.Template("mit", "under the mit license", exact=True),
    *[replace(t, base=t.text != "the mit license") for t in licenses.TEMPLATES],
)


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), templates=OP5_TEMPLATES)


@query("op8_simhash_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.drop("text_hash")


@query("op3_divergence_rules", divergence_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"))
    return found.drop("class_distance", "word_distance")


@query("op6_language_bitmask")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op7_quality_network")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    return quality_model.score(docs, quality_model.fit(docs, labels))


@query("op1_block_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), bpe_path(), piece_path())


@query("op12_bucket_digest")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_digest.fingerprints(table(spark, sf_dir, "documents"))


@query("op13_prefix_trie", prefix_trie_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_ids(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_shared_starts(turns))
