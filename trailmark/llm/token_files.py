"""Operator 7: binary token files with Elias-Fano document boundaries.

A token file is a table of blocks in the order of the documents: ``part, seq`` (the order of
blocks), ``doc_ids`` (long, in order), ``ids`` (the token ids of the block's documents one after
another, little-endian, 16 bits where the vocabulary allows it, else 32) and ``ends`` (Elias-Fano
code of the documents' end offsets within the block, see ``elias_fano``). Offsets in the whole
corpus follow from the block sizes, so no 64-bit table of offsets is kept; the ids that name the documents
are a column of their own, which a reader by number leaves out.

Spark orders the documents (range partitions on the document id and, for documents that share an
id, on a hash of the text, so no id can fill a partition alone) and writes the blocks; each task
holds one Arrow batch and one block at a time.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm import elias_fano
from trailmark.llm.staging import shuffle_partitions

BLOCK_IDS = 1 << 22
CACHE_UNITS = 300_000
END_ID = 0
CELL = 1 << 16

BLOCKS = "part int, seq int, n_docs int, n_ids long, doc_ids array<long>, ids binary, ends binary"

# Fixed values of the public vocabulary: how its JSON file writes bytes as printable characters
# (the printable ones as themselves, the others from U+0100 on in order).
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_characters() -> dict[str, int]:
    others = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteEncoder:
    """Token ids of whole texts under a byte-level BPE tokenizer file (its JSON text).

    A text is cut at single spaces between two other characters; no token crosses such a cut, so
    each unit is encoded once and looked up afterwards. Texts with other runs of white space at a
    space, or with the text of a special token, go to the tokenizer whole.
    """

    # any white space next to a space, or a space at either end; Python's class is the wider one
    IRREGULAR = re.compile(r"\s | \s|\A | \Z")
    UNIT = 1 << 14

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(tokenizer_json)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.loads(tokenizer_json)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = spec["model"]["vocab"]
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 and len(vocab) < 1 << 16 else "<u4")
        to_byte = byte_characters()
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in vocab.items() if piece not in self.special}
        from public_tokenizers import PATTERN

        self.pieces = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.length[i] = len(piece)
        self.cache: dict[str, bytes] = {}

    def _learn(self, units: list[str]) -> None:
        """Encodes units, each as it stands after a space, in one text; cuts it by byte lengths."""
        for lo in range(0, len(units), self.UNIT):
            some = units[lo:lo + self.UNIT]
            ids = np.array(self.pieces.encode_ordinary("".join([" " + u for u in some])), np.int64)
            sizes = np.cumsum([1 + len(u.encode()) for u in some])
            cuts = np.searchsorted(np.cumsum(self.length[ids]), sizes, side="left") + 1
            data, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            at = 0
            for u, end in zip(some, (cuts * width).tolist()):
                self.cache[u] = data[at:end]
                at = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``dtype``."""
        out: list[bytes | None] = [None] * len(texts)
        split: list[tuple[int, list[str]]] = []
        new: set[str] = set()
        for i, t in enumerate(texts):
            if not t:
                out[i] = b""
            elif self.IRREGULAR.search(t) or any(s in t for s in self.special):
                out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, self.dtype).tobytes()
            else:
                units = t.split(" ")
                split.append((i, units))
                new.update(units[1:])
        new.difference_update(self.cache)
        if len(self.cache) + len(new) > CACHE_UNITS:
            self.cache.clear()
            new = set().union(*(u[1:] for _, u in split))
        self._learn(list(new))
        find = self.cache.__getitem__
        heads = self.pieces.encode_ordinary_batch([u[0] for _, u in split], num_threads=1)
        for (i, units), head in zip(split, heads):
            out[i] = np.array(head, self.dtype).tobytes() + b"".join(map(find, units[1:]))
        return out


_encoders: dict[int, ByteEncoder] = {}


def _encoder(tokenizer_json: str) -> ByteEncoder:
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = ByteEncoder(tokenizer_json)
    return _encoders[key]


def token_blocks(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of the token ids of ``docs`` (doc_id, text), each document followed by ``end_id``.

    Documents are in ascending order of id (null first), those with equal ids by text. A null text
    is an empty one: its document has the end id only. Other columns are ignored; an empty table
    has no blocks. A block is closed once it has ``block_ids`` ids, so one very long document is a
    block of its own size.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = spark.sparkContext.broadcast(f.read())  # the vocabulary file, a few MB whatever the data
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = texts.repartitionByRange(shuffle_partitions(spark), "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _encoder(shipped.value)
        end = np.array([end_id], encode.dtype).tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        parts: list[bytes] = []
        n_bytes = 0

        def close() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // encode.dtype.itemsize
            ends = np.cumsum(sizes)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(parts)], pa.int32()),
                pa.array([int(ends[-1])], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([b"".join(parts)], pa.binary()), pa.array([elias_fano.encode(ends)], pa.binary())],
                names=["part", "seq", "n_docs", "n_ids", "doc_ids", "ids", "ends"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                for d, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist())):
                    doc_ids.append(d)
                    parts.append(ids + end)
                    n_bytes += len(parts[-1])
                    if n_bytes >= block_ids * encode.dtype.itemsize:
                        yield close()
                        seq += 1
                        doc_ids, parts, n_bytes = [], [], 0
        if parts:
            yield close()

    return ordered.mapInArrow(blocks, BLOCKS)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, **options) -> None:
    """Writes the blocks as a token file folder at ``path`` (any store that Spark can write)."""
    token_blocks(docs, tokenizer_path, **options).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def documents_at(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """``number, doc_id, ids`` (array of token ids, the end id last) of the documents with these ``numbers``
    (column ``number``, from 0 in the order of the files): two selects a document, no other boundary is decoded.

    Numbers meet blocks in cells of ``CELL`` documents, so no block list is broadcast or scanned. A number out of
    range or null gives no row, a repeated one a row each time.
    """
    placed = _block_starts(blocks, "n_docs").join(
        blocks.select(F.col("part").alias("bp"), F.col("seq").alias("bs"), "n_docs", "n_ids", "doc_ids", "ids", "ends"),
        (F.col("p") == F.col("bp")) & (F.col("s") == F.col("bs"))).where("n_docs > 0")
    width = F.lit(CELL)
    cell = F.call_function("div", F.col("before"), width), F.call_function("div", F.col("before") + F.col("n_docs") - 1, width)
    cells = placed.select(F.explode(F.sequence(*cell)).alias("cell"), "p", "s", "before", "n_docs")
    asked = numbers.select(F.col("number").cast("long").alias("number")).where("number >= 0")
    asked = asked.withColumn("of", F.call_function("div", F.col("number"), width))
    hits = asked.join(cells, (F.col("of") == F.col("cell")) & (F.col("number") >= F.col("before")) & (F.col("number") < F.col("before") + F.col("n_docs")))
    wanted = hits.groupBy("p", "s").agg(F.collect_list(F.col("number") - F.col("before")).alias("at"))  # at most a block's documents, as often as asked for
    found = placed.join(wanted.select(F.col("p").alias("wp"), F.col("s").alias("ws"), "at"), (F.col("p") == F.col("wp")) & (F.col("s") == F.col("ws")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
                ends = elias_fano.EliasFano(row.column("ends")[0].as_py())
                data, n_ids, before = row.column("ids")[0].as_py(), row.column("n_ids")[0].as_py(), row.column("before")[0].as_py()
                names = row.column("doc_ids")[0].values
                ids = np.frombuffer(data, "<u2" if len(data) == 2 * n_ids else "<u4")
                at = row.column("at")[0].as_py()
                spans = [(ends.select(i - 1) if i else 0, ends.select(i)) for i in at]
                yield pa.RecordBatch.from_arrays([
                    pa.array([before + i for i in at], pa.int64()), names.take(pa.array(at)),
                    pa.array([ids[a:b].astype(np.int64) for a, b in spans], pa.list_(pa.int64()))], names=["number", "doc_id", "ids"])

    return found.select("before", "n_ids", "doc_ids", "ids", "ends", "at").mapInArrow(read, "number long, doc_id long, ids array<long>")


def _block_starts(blocks: DataFrame, column: str) -> DataFrame:
    """``p, s`` (part and seq of a block) and ``before``, the sum of ``column`` over all blocks before it."""
    sizes = blocks.select("part", "seq", F.col(column).cast("long").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per writing task
    parts = (sizes.groupBy("part").agg(F.sum("n").alias("n"))
             .select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start")))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (sizes.withColumn("block_start", F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .join(parts, F.col("part") == F.col("p"))
            .select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("part_start") + F.col("block_start")).alias("before")))


def documents_of(blocks: DataFrame) -> DataFrame:
    """A row per document, from the files alone: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` is the number of ids before the document in the whole corpus: the start within its
    block (Elias-Fano) plus the sizes of the blocks before, by partition and then by block.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = elias_fano.EliasFano(row["ends"]).all()
                starts = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(row["ids"], "<u2" if len(row["ids"]) == 2 * row["n_ids"] else "<u4").astype("<u4")
                n = len(ends)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, row["part"]), pa.int32()), pa.array(np.full(n, row["seq"]), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)], pa.int64())],
                    names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = blocks.mapInArrow(read, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    starts = _block_starts(blocks, "n_ids")
    return rows.join(starts, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
