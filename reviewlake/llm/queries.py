"""The registered queries of the numbered operators: thin digests of their outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.session import scratch_dir

from . import chat_format as CF
from . import collocations as CO
from . import decontamination as DC
from . import hard_negatives as HN
from . import html_extraction as HX
from . import line_dedup as LD
from . import oracle
from . import packing as PK
from . import quality_rules as QR
from . import simhash_dedup as SH
from . import suffix_dedup as SX
from . import token_blocks as TB
from . import token_counts as TC
from . import toxicity as TX
from .common import table, words_of

#: The vocabulary of the queries; the operators take any path.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QR.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = LD.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = SX.suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: The tool of the derived calls below.
TOOLS = {"reply": {
    "type": "object", "required": ["turn", "words"], "additionalProperties": False,
    "properties": {"turn": {"type": "integer", "minimum": 0}, "words": {"type": "integer", "minimum": 1, "maximum": 400},
                   "after": {"type": "object", "required": ["$ref"]}}}}


def derived_tool_messages(conversations: DataFrame) -> DataFrame:
    """Conversations read as tool use: a user turn calls ``reply``, the turn after it is the tool's
    result, and from the second call on the arguments refer to the call before."""
    call = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    arguments = F.struct(F.size(words_of(F.coalesce("text", F.lit("")))).alias("words"), F.col("turn"), F.when(
        F.col("turn") >= 2, F.struct(call(F.col("turn") - 2).alias("$ref"))).alias("after"))
    calls = F.to_json(F.array(F.struct(F.lit("reply").alias("name"), call(F.col("turn")).alias("id"), arguments.alias("arguments"))))
    return conversations.select(
        "conv_id", "turn", F.when(F.col("role") == "assistant", "tool").when(F.col("role") == "user", "assistant")
        .otherwise(F.col("role")).alias("role"), "text",
        F.when(F.col("role") == "user", calls).alias("calls"),
        F.when(F.col("role") == "assistant", call(F.col("turn") - 1)).alias("call_id"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CF.chat_format(derived_tool_messages(table(spark, sf_dir, "conversations")), TOOLS)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = DC.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "start_word", "n_words", "similarity")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = SH.simhash_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _crc32_of_ids() -> Column:
    return F.crc32("ids").alias("ids_crc32")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-blocks")
    TB.write_blocks(table(spark, sf_dir, "documents"), path, vocabulary())
    return TB.read_blocks(spark, path).select("doc_id", "start", "n_tokens", _crc32_of_ids())


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TC.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = TX.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = PK.pack(table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", "piece", "start", "length", _crc32_of_ids(), "sequence_id", "offset")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CO.collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return HN.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 100 == 0)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HX.extract(table(spark, sf_dir, "pages"))


SQL = oracle.SQL
QUERIES = {q.__name__: q for q in (
    op1_token_blocks, op2_suffix_dedup, op3_line_dedup, op4_chat_format, op5_decontamination,
    op6_simhash_dedup, op7_token_counts, op8_quality_rules, op9_toxicity, op10_best_fit_packing,
    op11_collocations, op12_hard_negatives, op13_html_extraction)}
