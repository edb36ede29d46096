"""The operators of this package bound to the given tables, with SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.llm import statements
from flightframe.llm.alignment import aligned_payloads
from flightframe.llm.divergence import video_divergence
from flightframe.llm.exchanges import read_loss, read_turns, reply_examples
from flightframe.llm.language import score_payloads, train
from flightframe.llm.leaks import leaked_items
from flightframe.llm.licenses import scan_licenses
from flightframe.llm.mixing import mix_copies
from flightframe.llm.near import near_duplicate_files
from flightframe.llm.private import KINDS as PRIVATE_KINDS
from flightframe.llm.private import with_personal_data
from flightframe.llm.quality import judged
from flightframe.llm.repeats import without_repeated_footage
from flightframe.llm.secrets import scan_secrets
from flightframe.llm.store import hex_sha256
from flightframe.llm.token_files import read_token_files, write_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = dict(statements.SQL)


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.base & (s.kind == kind))).cast("long").alias(f"n_{kind}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def _digests(spans: Column) -> list[Column]:
    return [hex_sha256(_joined(F.filter(spans, lambda s: s.base))).alias("base_sha256"), _joined(spans).alias("spans")]


@_query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("path", "doc_id")


@_query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_files(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("path").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


@_query
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = without_repeated_footage(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return cleaned.select(F.col("session").alias("doc_id"), F.col("n_frames").alias("n_words"), "n_removed", hex_sha256(F.col("kept")).alias("kept_sha256"))


@_query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
    return found.select(F.col("path").alias("doc_id"), F.col("item").alias("item_id"), "shared", "item_shingles")


@_query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_copies(_table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return mixed.select(F.col("frame_id").alias("doc_id"), "size", F.col("video_size").alias("source_size"), "target", "taken")


@_query
def op6_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    examples = reply_examples(turns.union(planted), "conv_id", "turn", "role", "text")
    read = examples.select(
        F.col("session").alias("conv_id"), F.struct("example", read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("text")).alias("loss"),
        F.struct("example", "formatted").alias("last"), F.char_length("formatted").cast("long").alias("chars"))
    whole = read.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x.text), "").alias("loss"),
        read_turns(F.max("last").formatted).alias("turns"), F.sum("chars").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), hex_sha256(said).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), hex_sha256(F.col("loss")).alias("loss_sha256"), "formatted_chars")


@_query
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % 7 == 2
    model = train(documents.where(~held_out("doc_id")), "text")
    return score_payloads(documents, model, "doc_id", "text").select(
        F.col("url").alias("doc_id"), held_out("url").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@_query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged(documents, "text", language="lang").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


@_query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("spans")
    return with_personal_data(documents, "text", keep_text=False).select("doc_id", *[_count(spans, k) for k in PRIVATE_KINDS], *_digests(spans))


@_query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    found = scan_secrets(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("path").alias("doc_id"), *[_count(spans, k) for k in ("assign", "access", "hex")], *_digests(spans))


def _tokenizer(name: str) -> str:
    """The path of a vocabulary that is installed on all machines."""
    from public_tokenizers import path

    return path(name)


@_query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), "doc_id", "text")
    return read_token_files(spark, files).select(F.col("url").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aligned_payloads(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"), "doc_id", "text")
    return found.withColumnRenamed("url", "doc_id")


@_query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = video_divergence(_table(spark, sf_dir, "documents"), "lang", "source", "text")
    return found.withColumnsRenamed({"modality": "lang", "video": "source"})
