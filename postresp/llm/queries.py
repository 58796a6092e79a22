"""Registered queries of the corpus operators: ``opN_<name>(spark, sf_dir)``.

Each applies its operator with production parameters to its whole table and
derives the digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postresp.llm import oracles
from postresp.llm.bpe import bpe_encode
from postresp.llm.chat_format import format_conversations, loss_text, parse_formatted
from postresp.llm.collocations import collocations
from postresp.llm.common import WORD_PATTERN, table
from postresp.llm.language_id import fit, identify
from postresp.llm.mixing import taken_words
from postresp.llm.near_dup import near_duplicates
from postresp.llm.periodic_runs import periodic_runs
from postresp.llm.pii import BASE_KINDS, fit_table, labelled_table, personal_data, span_text
from postresp.llm.quality_rules import quality_rules
from postresp.llm.sentence_dedup import sentence_dedup
from postresp.llm.simhash import edit_likeness, near_classes
from postresp.llm.suffix_dedup import dedup_digests
from postresp.llm.token_counts import token_counts

#: op4: texts above this many tokens do not fit the context
TOKEN_LIMIT = 512


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digests(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edit_likeness(table(spark, sf_dir, "documents"))
    # further columns: other documents whose fingerprint is within three bits (copies) and within those of
    # near copies, and the smallest fingerprint among these
    return rows.join(near_classes(rows.select("fingerprint")), "fingerprint").select(*rows.columns, "n_near", "n_similar", "link")


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_dedup(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


#: op6: an additional conversation whose texts are control strings
TRAP = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    out = format_conversations(turns.unionByName(trap), loss_role="assistant")
    out = out.withColumn("read", parse_formatted(F.col("formatted"))).withColumn("loss", loss_text(F.col("segments")))
    lines = F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = fit(docs.where(~out))
    return identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), "word_bpe_49k.json",
                      outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in a tenth of the documents (by crc32 of the id) the
    words from a place on repeat a period of words, as the contract of op12 says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.floor(h / 10).alias("g"), (h % 10 == 0).alias("hit"),
                        F.regexp_extract_all(F.when(h % 10 == 0, F.col("text")), F.lit(WORD_PATTERN), F.lit(0)).alias("w"))
    n = F.size("w").cast("long")
    a = F.when(n > 0, F.expr("g % nullif(size(w), 0)"))
    placed = words.withColumn("a", a).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(
        F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return placed.select("doc_id", F.when(F.col("hit") & (n > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumn("best", longest).withColumn("length", -F.col("best.less"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), "length", F.col("best.period").alias("period"),
                        F.expr("1000 * length div best.period").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"), fit_table(labelled_table(spark)))
    base = F.filter("spans", lambda s: s["base"])
    n_of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n_of(kind) for kind in BASE_KINDS], F.sha2(span_text(base), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_simhash": op2_simhash,
    "op3_sentence_spans": op3_sentence_spans,
    "op4_token_counts": op4_token_counts,
    "op5_mixing": op5_mixing,
    "op6_chat_format": op6_chat_format,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_language_id": op8_language_id,
    "op9_bpe": op9_bpe,
    "op10_quality_rules": op10_quality_rules,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_pii": op13_pii,
}

ORACLE: dict[str, str] = dict(oracles.ORACLE)
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
