"""Operator 3: BPE encoding and decoding through a table of distinct words.

Texts are split into words at white space; no token of the tokenizer crosses it. Three steps:

1. Each task turns its texts into chunks: the distinct words of a chunk, and every text as numbers
   of words. The words go into hash buckets.
2. Bucket by bucket, every distinct word of the corpus is encoded once; the ids go back to the
   chunks that asked.
3. Each chunk joins ids to its word numbers by position, which gives the ids of whole texts, and
   decodes them through the id-to-piece table of the vocabulary.

Word lists, word numbers and ids travel as compressed arrays, a row per chunk and bucket, so what
is shuffled is a few bytes per word and no key is hot: a word that occurs in every text is one
entry per chunk. Buckets grow in number with the texts, so a bucket's share of the vocabulary fits in a task. Words are numbered bucket by bucket, so the answers need no numbers with them. The
chunks are stored bucketed by chunk number and are not shuffled again: only word lists go out and
only ids come back. A task holds one chunk, or the distinct words of one bucket.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.staging import buckets_for, shuffle_partitions, stored

CHUNK_CHARS = 6 << 20
BUCKETS = 128  # of words, at least
CODES, WORDS = 1, 0

CHUNKS = "chunk long, kind int, bucket int, doc_ids array<long>, counts binary, codes binary, payload binary"
ANSWERS = "chunk long, bucket int, counts binary, ids binary"

# White space of the tokenizer: Python's class without the four separators U+001C to U+001F.
GAP = re.compile("[^\\S\x1c-\x1f]+")
# Texts that lower-case differently from letter to letter, or may hold special tokens, stay as is.
AS_IT_IS = re.compile("[Σİ]|<\\|")


def _pack(a: np.ndarray) -> bytes:
    """Compressed unsigned 32-bit integers, byte planes apart."""
    return zlib.compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 4)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def split_words(text: str) -> list[str]:
    """Words at the tokenizer's white space, lower-cased where that cannot change the ids."""
    if not AS_IT_IS.search(text):
        text = text.lower()
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in GAP.split(text) if w]
    return text.split()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    chunk, kind, bucket, doc_ids, counts, codes, payload = zip(*rows)
    return pa.RecordBatch.from_arrays([
        pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()),
        pa.array(doc_ids, pa.list_(pa.int64())), pa.array(counts, pa.binary()), pa.array(codes, pa.binary()),
        pa.array(payload, pa.binary())], names=["chunk", "kind", "bucket", "doc_ids", "counts", "codes", "payload"])


def _split(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    doc_ids: list = []
    words: list[str] = []
    counts: list[int] = []
    n_chars = 0

    def close() -> Iterator[pa.RecordBatch]:
        ranked = [w for w, _ in Counter(words).most_common()]
        home = np.fromiter((zlib.crc32(w.encode()) for w in ranked), np.int64, len(ranked)) % buckets
        order = np.argsort(home, kind="stable")  # by bucket, frequent words first
        cuts = np.searchsorted(home[order], np.arange(buckets + 1))
        rank = np.empty(len(ranked), np.int64)
        rank[order] = np.arange(len(ranked)) - cuts[home[order]]
        place = dict(zip(ranked, range(len(ranked))))
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        # a word of a text is its bucket and its rank there: small numbers, which pack well
        yield _batch([(number, CODES, 0, doc_ids, _pack(np.array(counts)), _pack(rank[at]), _pack(home[at]))])
        rows = []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            mine = [ranked[i] for i in order[cuts[b]:cuts[b + 1]].tolist()]
            rows.append((number, WORDS, b, None, None, None, zlib.compress("\n".join(mine).encode())))
        if rows:
            yield _batch(rows)

    for batch in batches:
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            mine = split_words(t or "")
            doc_ids.append(d)
            counts.append(len(mine))
            words.extend(mine)
            n_chars += len(t or "")
            if n_chars >= CHUNK_CHARS:
                yield from close()
                number += 1
                doc_ids, words, counts, n_chars = [], [], [], 0
    if doc_ids:
        yield from close()


def _tokenizer(spec: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t


def _offsets(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def _gather(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``codes`` of a ragged array one after another, and the length of each."""
    sizes = (offsets[1:] - offsets[:-1])[codes]
    ends = np.cumsum(sizes)
    at = np.repeat(offsets[codes] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    return flat[at], sizes


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): ``n_tokens``, ``ids`` (binary, little-endian unsigned
    32-bit) and ``decoded`` (text), with ``add_special_tokens=False`` and nothing skipped.

    A null text is an empty one, with no ids. Every row is encoded whole, also repeated ones; a
    null id stays null. Other columns are ignored.
    """
    return assembled(docs, tokenizer_path, digests=False)


def assembled(docs: DataFrame, tokenizer_path: str, digests: bool) -> DataFrame:
    """``encode_decode``, or with ``digests`` the SHA-256 of ids and decoded text in their place."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shipped = spark.sparkContext.broadcast(spec)  # the vocabulary file, a few MB whatever the data
    tasks = shuffle_partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = buckets_for(texts, least=BUCKETS)
    chunks = stored(texts.mapInArrow(lambda it: _split(it, buckets), CHUNKS), "chunks", bucketed=("chunk", tasks))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shipped.value)
        known: dict[str, tuple[int, ...]] = {}
        now = None
        for batch in batches:
            out = []
            for chunk, bucket, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    now, known = bucket, {}
                words = zlib.decompress(blob).decode().split("\n")
                new = [w for w in words if w not in known]
                for w, e in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                    known[w] = e.ids
                ids = list(map(known.__getitem__, words))
                out.append((chunk, bucket, _pack(np.array(list(map(len, ids)))), _pack(np.array([i for x in ids for i in x]))))
            if out:
                types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["chunk", "bucket", "counts", "ids"])

    answers = (chunks.where(F.col("kind") == WORDS).select("chunk", "bucket", "payload").repartition(tasks, "bucket")
               .sortWithinPartitions("bucket").mapInArrow(encode, ANSWERS))
    answers = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts", "ids"))).alias("answers"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = json.loads(shipped.value)
        pieces: dict[int, bytes] = {i: p.encode() for p, i in vocab["model"]["vocab"].items()}
        pieces |= {t["id"]: t["content"].encode() for t in vocab["added_tokens"]}
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, counts, ranks, homes, got = (batch.column(c).slice(i, 1).to_pylist()[0] for c in range(batch.num_columns))
                yield _chunk(pieces, got or [], doc_ids, _unpack(counts), _unpack(ranks), _unpack(homes), buckets, digests)

    rows = (chunks.where(F.col("kind") == CODES).select("chunk", "doc_ids", "counts", "codes", "payload")
            .join(answers, "chunk", "left").select("doc_ids", "counts", "codes", "payload", "answers"))
    columns = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    return rows.mapInArrow(join, f"doc_id long, n_tokens long, {columns}")


def _chunk(pieces, answers, doc_ids, counts, ranks, homes, buckets, digests) -> pa.RecordBatch:
    """The documents of a chunk from the ids of its words, bucket by bucket."""
    sizes = [_unpack(a["counts"]) for a in answers]
    first = np.zeros(buckets, np.int64)  # number of a bucket's first word
    first[[a["bucket"] for a in answers]] = np.cumsum([0, *map(len, sizes)])[:-1]
    codes = first[homes] + ranks
    flat = np.concatenate([np.zeros(0, np.int64), *(_unpack(a["ids"]) for a in answers)])
    offsets = _offsets(np.concatenate([np.zeros(0, np.int64), *sizes]))
    values, bounds = flat.tolist(), offsets.tolist()
    text = [b" ".join([pieces[i] for i in values[a:b]]) for a, b in zip(bounds, bounds[1:])]
    at = _offsets(counts)
    ids, n_tokens = [], []
    decoded = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        mine = codes[a:b]
        values, _ = _gather(flat, offsets, mine)
        n_tokens.append(len(values))
        raw = values.astype("<u4").tobytes()
        # a word without ids (no character of the vocabulary) adds nothing, not even a space
        said = b" ".join(filter(None, map(text.__getitem__, mine.tolist())))
        ids.append(hashlib.sha256(raw).hexdigest() if digests else raw)
        decoded.append(hashlib.sha256(said).hexdigest() if digests else said.decode())
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    return pa.RecordBatch.from_arrays([
        pa.array(doc_ids, pa.int64()), pa.array(n_tokens, pa.int64()),
        pa.array(ids, pa.string() if digests else pa.binary()), pa.array(decoded, pa.string())],
        names=["doc_id", "n_tokens", *names])
