"""Corpus pipeline: quality rules, near duplicates, repeated strings, benchmark passages, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; ``run``
writes each stage's result to the shared folder and reads it again for the next. All but the last
return the columns of ``documents`` (and any others that came in).

A stage's intermediate tables are read by its result until that is written. They are deleted when the
next stage is called with the written result (not if it is called with a frame that still reads
them), those of the last stage by ``release``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import decontamination, near_dedup, quality, repeat_removal, word_bpe
from trailmark.llm.queries import table, tokenizer_file
from trailmark.llm.staging import Owned, discard, owned, stored

#: Graph iteration, trained axes and a tokenizer are beyond SQL; the tests hold the stages against
#: plain Python instead.
ORACLE_SQL = None


#: Tables of the stages whose results may not be written yet, by stage.
_held: dict[str, list[Owned]] = {}


def _stage(after: str | None) -> Callable:
    """A stage that owns what it stores, and deletes what the stage ``after`` which it comes has stored."""
    def wrap(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
        @wraps(fn)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if after is not None:
                _held[after] = [o for o in _held.get(after, []) if not o.release(unless_read_by=docs)]
            with owned(spark) as mine:
                out = fn(spark, docs, sf_dir)
            _held.setdefault(fn.__name__, []).append(mine)
            return out

        return run_stage

    return wrap


def release() -> None:
    """Deletes all intermediate tables of stages; call it once the last result is written."""
    for owners in _held.values():
        for owner in owners:
            owner.release()
    _held.clear()


def _renamed(docs: DataFrame, taken: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that an operator would replace under other names, and the way back."""
    names = {c: f"__input_{c}" for c in docs.columns if c in taken}
    return docs.withColumnsRenamed(names), {v: k for k, v in names.items()}


@_stage(after=None)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    safe, back = _renamed(docs, quality.OUT)
    return quality.quality_rules(safe, twice=True).where("kept").select(*safe.columns).withColumnsRenamed(back)


@_stage(after="quality_rules")
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the least id; rows without words stay."""
    safe, back = _renamed(docs, ["n_shingles", "component_id", "kept", "group_key"])
    kept = near_dedup.near_duplicates(safe, keep=safe.columns).where("kept")
    one = kept.where("group_key is not null").dropDuplicates(["group_key"])  # rows that repeat an id
    return one.unionByName(kept.where("group_key is null")).select(*safe.columns).withColumnsRenamed(back)


@_stage(after="near_duplicates")
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings of earlier ones; those with nothing left go.

    A character is removed only whole. ``n_chars`` is counted anew for documents that changed.
    """
    safe, back = _renamed(docs, ["removed_spans", "kept_bytes", "kept_text"])
    cut = repeat_removal.remove_repeats(safe)
    changed = F.size("removed_spans") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    kept = cut.where(~changed | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in safe.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.length("kept_text").cast(safe.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.withColumn("text", text).select(*safe.columns).withColumnsRenamed(back)


@_stage(after="repeated_strings")
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    A document is known by its id and its text, so a contaminated row without an id goes like any
    other, and a clean one that shares its id stays.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"), F.hash("text").cast("string"))
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    asked = docs.select(key.alias("doc_id"), "text")
    hits = decontamination.contaminated_passages(asked, table(spark, sf_dir, "benchmark"), id_type="string")
    hit = stored(hits.select(F.col("doc_id").alias("hit")).distinct(), "contaminated")
    return told.join(hit, F.col("key") == F.col("hit"), "left_anti").select("row.*")


@_stage(after="decontaminated")
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    return word_bpe.assembled(docs, tokenizer_file("word_bpe_49k.json"), digests=True)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k}")
            discard(before)
            before = docs
    return docs
