"""The operators bound to the test tables: ``opN_<name>`` queries and their SQL where it exists.

Every query reads its whole table and applies its operator with production parameters; the digest
columns are derived from the operator's output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import (
    chat_format,
    collocations,
    decontamination,
    fuzzy_passages,
    html_text,
    near_dedup,
    quality,
    quality_scores,
    repeat_removal,
    sharding,
    token_alignment,
    token_files,
    word_bpe,
)
from trailmark.llm.staging import shared_folder

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SHARDS = 40
SHARD_SEED = 2024


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that an earlier document has too, with their place in both."""
    return fuzzy_passages.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op2_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39; row counts differ by one at most (law ``rows``)."""
    return shard_documents(table(spark, sf_dir, "documents"))


def shard_documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
                        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = sharding.shard_rows(sized, SHARDS, SHARD_SEED)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")


@query
def op4_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, measures and verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, keep=["doc_id"])


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and their decoding, as SHA-256."""
    return word_bpe.assembled(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), digests=True)


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents written to the shared folder, read back."""
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"))
    return token_files.documents_of(token_files.read_token_files(spark, path))


@query
def op8_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near duplicates for every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_suffix_sort_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without 50-byte strings of earlier documents."""
    return repeats_removed(table(spark, sf_dir, "documents"))


def repeats_removed(docs: DataFrame) -> DataFrame:
    out = repeat_removal.remove_repeats(docs.select("doc_id", "text"))
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query
def op9_lstm_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op10_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items found in them, a row per passage."""
    return decontamination.contaminated_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and pair counts of two tokenizers for every document."""
    out = token_alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), digests=True)
    return out.withColumnRenamed("groups", "groups_sha256")


@query
def op12_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    out = quality_scores.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.drop("statistics")


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


STREAM_PIECE = 200
SPECIAL = "\\### Assistant: </turn> ok"


def conversation_events(conversations: DataFrame) -> DataFrame:
    """The event log of finished conversations: turns of the assistant arrive as streamed pieces,
    the first piece once in a draft that is then regenerated; other turns are whole messages.

    Rows of a conversation are renumbered in order, so repeated turns stay separate turns.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", F.row_number().over(order).cast("long").alias("turn"), "role",
                                F.coalesce("text", F.lit("")).alias("text"))
    count = F.greatest(F.ceil(F.length("text") / STREAM_PIECE), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(
        (i + 2).cast("long").alias("step"), F.lit("delta").alias("kind"),
        F.substring("text", i * STREAM_PIECE + 1, F.lit(STREAM_PIECE)).alias("text")))
    draft = F.array(F.struct(F.lit(0).cast("long").alias("step"), F.lit("delta").alias("kind"),
                             F.substring("text", 1, STREAM_PIECE).alias("text")),
                    F.struct(F.lit(1).cast("long").alias("step"), F.lit("regenerate").alias("kind"),
                             F.lit("").alias("text")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("step"), F.lit("message").alias("kind"),
                             F.col("text").alias("text")))
    log = F.when(F.col("role") == "assistant", F.concat(draft, pieces)).otherwise(whole)
    return (rows.select("conv_id", "turn", "role", F.explode(log).alias("e"))
            .select("conv_id", F.struct("turn", "e.step").alias("seq"), F.col("e.kind").alias("kind"), "turn",
                    "role", F.col("e.text").alias("text")))


@query
def op6_chat_event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted; digests are read back from the output."""
    return format_conversations(table(spark, sf_dir, "conversations"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"),
                                F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SPECIAL).alias("text"))
    out = chat_format.render(chat_format.fold(conversation_events(rows.unionByName(extra))))
    out = out.withColumn("turns", chat_format.read_turns(F.col("formatted")))
    out = out.withColumn("loss", F.array_join(
        chat_format.read_loss(F.col("formatted"), F.col("loss_spans")), ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    from trailmark.llm import oracles

    return dict(oracles.SQL)
