"""Operator 5: removal of byte strings that occur in an earlier document, by a depth-limited sort.

A suffix matters only through its first ``LENGTH`` bytes: two documents repeat each other exactly
where suffixes are equal to that depth. The sort to that depth runs by most significant digits, and
a group that can no longer hold two documents leaves it after each pass.

The suffixes sorted are those at anchors. Every string of ``LENGTH`` bytes has one anchor, the
leftmost of its ``LENGTH - DIGIT + 1`` byte runs of length ``DIGIT`` with the least hash. The choice
depends on the string alone, so equal strings have equal anchors at the same place: sorting the
strings by (anchor, what is around it) brings equal ones together, with one entry per anchor
(about one in 16 bytes) instead of one per byte.

* First digit: the ``DIGIT`` bytes of the anchor. Groups within one document leave.
* Second digit: the anchor's surroundings, up to ``LENGTH - DIGIT`` bytes before it and to ``LENGTH``
  bytes from its start, which hold every string of this anchor. Where they are equal all strings
  are: every document but the first of such a group has all of them earlier. Its first document
  stands for the group from here on, if its first-digit group holds other surroundings.
* Last digit: the whole strings of those that stand for their groups. Equal groups are exactly the
  repeated strings.

Each pass is one exchange of 64-bit digits with document ids, by ranges of the digit; equal digits
are merged to the earliest document per Arrow batch before it, so a string in every document is one
entry per batch and its other copies are decided in place. Texts are not sorted or compared; they
join the decisions by document at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import textbytes as tb
from trailmark.llm.staging import buckets_for, shuffle_partitions, stored

LENGTH = 50
DIGIT = 20
REACH = LENGTH - DIGIT  # bytes of surroundings on either side of an anchor
U64 = np.uint64
NO_ID = np.iinfo(np.int64).min  # stands for a null id, before every other
CHUNK = 1 << 18  # bytes of text at a time: what their anchors take is many times as much

WHOLE, OPEN, STRING = 0, 1, 2  # all strings of an anchor repeat; to be sorted further; a string repeats
DIGITS = "bucket int, keys binary, subs binary, docs binary, decided binary"
MARKS = "doc long, kind int, mark long"


class Anchors:
    """Anchors of a chunk of texts: position, first and last string start, row, both digits."""

    def __init__(self, chunk: tb.Chunk):
        data = chunk.data
        n = len(data)
        self.prefix = prefix = tb.prefix_hash(data)
        starts_in = np.maximum(chunk.lengths - LENGTH + 1, 0)
        self.at = self.first = self.last = np.zeros(0, np.int64)
        self.row = np.zeros(0, np.int64)
        self.key = self.sub = np.zeros(0, U64)
        if not starts_in.any():
            return
        _, inverse = tb.powers(n)
        m = n - DIGIT + 1
        least = tb.mix((prefix[DIGIT:] - prefix[:m]) * inverse[:m])
        digit = least
        where = np.arange(m, dtype=np.int32)
        width = 1
        while width < REACH + 1:  # sliding minimum, the leftmost of equals, by doubling
            step = min(width, REACH + 1 - width)
            right = least[step:] < least[:-step]
            least = np.where(right, least[step:], least[:-step])
            where = np.where(right, where[step:], where[:-step])
            width += step
        starts = np.repeat(chunk.offsets[:-1], starts_in) + _within(starts_in)
        row = np.repeat(np.arange(len(starts_in)), starts_in)
        chosen = where[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        self.at = chosen[begin].astype(np.int64)
        self.first = starts[begin]
        self.last = starts[np.append(begin[1:], len(starts)) - 1]
        self.row = row[begin]
        left = np.maximum(self.at - REACH, chunk.offsets[self.row])
        right = np.minimum(self.at + LENGTH, chunk.offsets[self.row + 1])
        around = tb.range_hash(prefix, left, right)
        self.key = digit[self.at]
        self.sub = tb.mix(around + (self.at - left).astype(U64) * U64(0x9E3779B97F4A7C15)
                          + (right - self.at).astype(U64) * U64(0xC2B2AE3D27D4EB4F))

    def strings(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the anchors ``some``: start, row and hash of every string."""
        sizes = self.last[some] - self.first[some] + 1
        start = np.repeat(self.first[some], sizes) + _within(sizes)
        return start, np.repeat(self.row[some], sizes), tb.mix(tb.range_hash(self.prefix, start, start + LENGTH))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0..size-1 for each size, end to end."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def mark(doc: np.ndarray, key: np.ndarray, sub: np.ndarray | int = 0) -> np.ndarray:
    """64 bits that stand for a decision: document and digits."""
    return tb.mix(key + tb.mix(np.asarray(sub, U64) + doc.view(U64) * U64(0x9E3779B97F4A7C15)))


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(NO_ID)).to_numpy().astype(np.int64)


def _digits(entries: Callable, buckets: int) -> Callable:
    """A task that yields digits by bucket from ``entries(batch) -> (key, sub, doc)``.

    Within a batch (cut to some MB of text) only the earliest document of equal digits goes on; the
    later ones have an earlier holder already and are handed on as decided.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, 1):
            key, sub, doc = entries(batch)
            if not len(key):
                continue
            order = np.lexsort((doc, sub, key))
            key, sub, doc = key[order], sub[order], doc[order]
            group = np.ones(len(key), bool)
            group[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])
            same = ~group
            same[1:] &= doc[1:] == doc[:-1]
            least = doc[np.maximum.accumulate(np.where(group, np.arange(len(doc)), 0))]
            later = (doc > least) & ~same
            decided = np.stack([doc[later], mark(doc[later], key[later], sub[later]).view(np.int64)])
            home = (key[group] >> U64(32)).astype(np.int64) * buckets >> 32
            cuts = np.searchsorted(home, np.arange(buckets + 1))  # sorted by key, so by bucket
            k, s, d = key[group], sub[group], doc[group]
            full = np.flatnonzero(np.diff(cuts))
            share = np.linspace(0, decided.shape[1], len(full) + 1).astype(int)
            rows = [(int(b), k[cuts[b]:cuts[b + 1]].tobytes(), s[cuts[b]:cuts[b + 1]].tobytes(), d[cuts[b]:cuts[b + 1]].tobytes(),
                     decided[:, share[i]:share[i + 1]].tobytes()) for i, b in enumerate(full)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))],
                names=["bucket", "keys", "subs", "docs", "decided"])

    return run


def _marks(doc: np.ndarray, kind: int, marks: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(np.full(len(doc), kind), pa.int32()),
                                       pa.array(marks.view(np.int64), pa.int64())], names=["doc", "kind", "mark"])


def _equal_groups(found: int) -> Callable:
    """A task that reads the digits of whole buckets and yields the decisions as marks."""
    def decide(parts: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        key, sub, doc = (np.frombuffer(b"".join(p), t) for p, t in zip(zip(*parts), (U64, U64, np.int64)))
        order = np.lexsort((doc, sub, key))
        key, sub, doc = key[order], sub[order], doc[order]
        first_key = np.ones(len(key), bool)
        first_key[1:] = key[1:] != key[:-1]
        group = first_key.copy()
        group[1:] |= sub[1:] != sub[:-1]
        at = np.arange(len(key))
        least = doc[np.maximum.accumulate(np.where(group, at, 0))]
        later = doc > least
        if later.any():
            yield _marks(doc[later], found, mark(doc[later], key[later], sub[later]))
        # groups of one first digit: open if there are several, of more than one document
        which = np.cumsum(first_key) - 1
        begin = np.flatnonzero(first_key)
        several = np.add.reduceat(group.astype(np.int64), begin) > 1
        many = np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin)
        stand = group & (several & many)[which]
        if found == WHOLE and stand.any():
            yield _marks(doc[stand], OPEN, mark(doc[stand], key[stand], sub[stand]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bucket, k, s, d, decided in zip(*map(tb.values, batch.columns)):
                if bucket != now and parts:
                    yield from decide(parts)
                    parts = []
                now = bucket
                parts.append((k, s, d))
                if decided:
                    doc, marks = np.frombuffer(decided, np.int64).reshape(2, -1)
                    yield _marks(doc, found, marks)
        if parts:
            yield from decide(parts)

    return run


def _anchor_entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = _ids(batch.column(0))
    keys, subs, docs = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for chunk in tb.chunks(batch.column(1), CHUNK):
        a = Anchors(chunk)
        keys.append(a.key)
        subs.append(a.sub)
        docs.append(ids[chunk.lo + a.row])
    return np.concatenate(keys), np.concatenate(subs), np.concatenate(docs)


def _members(marks: np.ndarray, known: pa.Array) -> np.ndarray:
    """Which marks are in a column of lists (marks hold the document, so the lists can be pooled)."""
    pool = np.sort(known.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
    if not len(pool):
        return np.zeros(len(marks), bool)
    return pool[np.minimum(np.searchsorted(pool, marks), len(pool) - 1)] == marks


def _string_entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = _ids(batch.column(0))
    keys, docs = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for chunk in tb.chunks(batch.column(1), CHUNK):
        a = Anchors(chunk)
        open_ = _members(mark(ids[chunk.lo + a.row], a.key, a.sub), batch.column(2).slice(chunk.lo, chunk.hi - chunk.lo))
        _, row, h = a.strings(np.flatnonzero(open_))
        keys.append(h)
        docs.append(ids[chunk.lo + row])
    key = np.concatenate(keys)
    return key, np.zeros(len(key), U64), np.concatenate(docs)


def _spans(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows carried (first column), and what remains of each text by its lists of marks."""
    carried, number, text_of, whole, open_, string = batch.columns
    ids = _ids(number)
    spans, kept, text = [], [], []
    for chunk in tb.chunks(text_of, CHUNK):
        n = chunk.hi - chunk.lo
        part = [c.slice(chunk.lo, n) for c in (whole, open_, string)]
        gone = np.zeros(len(chunk.data) + 1, np.int32)
        if any(len(p.flatten()) for p in part):
            a = Anchors(chunk)
            marks = mark(ids[chunk.lo + a.row], a.key, a.sub)
            hit = np.flatnonzero(_members(marks, part[0]))
            np.add.at(gone, a.first[hit], 1)
            np.add.at(gone, a.last[hit] + LENGTH, -1)
            start, row, h = a.strings(np.flatnonzero(_members(marks, part[1])))
            start = start[_members(mark(ids[chunk.lo + row], h), part[2])]
            np.add.at(gone, start, 1)
            np.add.at(gone, start + LENGTH, -1)
        covered = np.cumsum(gone[:-1]) > 0
        inner = np.zeros(len(covered) + 1, bool)  # bytes that continue a character
        inner[:-1] = (chunk.data & 0xC0) == 0x80
        for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist()):
            c = covered[a:b]
            if not c.any():
                spans.append([])
                kept.append(chunk.data[a:b].tobytes())
                text.append(kept[-1].decode())
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], c.view(np.int8), [0]])))
            lo, hi = edge[::2], edge[1::2]
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi)])
            kept.append(chunk.data[a:b][~c].tobytes())
            whole_characters = c.copy()
            for x, y in zip(lo.tolist(), hi.tolist()):
                while x < y and inner[a + x]:
                    whole_characters[x] = False
                    x += 1
                while y > x and a + y < b and inner[a + y]:
                    y -= 1
                    whole_characters[y] = False
            text.append(chunk.data[a:b][~whole_characters].tobytes().decode())
    yield pa.RecordBatch.from_arrays(
        [carried, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
         pa.array(kept, pa.binary()), pa.array(text, pa.string())],
        names=["carried", "removed_spans", "kept_bytes", "kept_text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with ``removed_spans`` (array of start, end in bytes), ``kept_bytes`` and
    ``kept_text``.

    A byte is removed if a string of 50 bytes over it also starts in a document with a smaller
    doc_id. ``kept_text`` keeps a character of which only some bytes are covered. Strings never
    cross documents; a null text is empty and stays so; a null id counts as smaller than any other;
    rows that share an id are not compared with each other. Other columns are carried along under any
    name, except that columns named like the three results are replaced.
    """
    docs = docs.drop("removed_spans", "kept_bytes", "kept_text")
    names = docs.columns
    id_at, text_at = (names.index(c) if c in names else [x.lower() for x in names].index(c) for c in ("doc_id", "text"))
    spark = docs.sparkSession
    tasks = shuffle_partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = buckets_for(texts)

    def equal_groups(entries: DataFrame, fn: Callable, found: int, name: str) -> DataFrame:
        digits = entries.mapInArrow(_digits(fn, buckets), DIGITS)
        marks = digits.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_equal_groups(found), MARKS)
        return stored(marks, name)

    first = equal_groups(texts, _anchor_entries, WHOLE, "anchors")
    open_ = first.where(F.col("kind") == OPEN).groupBy("doc").agg(F.collect_set("mark").alias("marks"))
    key = F.coalesce("doc_id", F.lit(int(NO_ID)).cast("long"))
    to_sort = texts.join(open_, key == F.col("doc")).select("doc_id", "text", "marks")
    last = equal_groups(to_sort, _string_entries, STRING, "strings")

    def of(kind: int):
        return F.collect_set(F.when(F.col("kind") == kind, F.col("mark"))).alias(f"__{kind}")

    marks = first.unionByName(last).groupBy(F.col("doc").alias("__doc")).agg(of(WHOLE), of(OPEN), of(STRING))
    none = F.array().cast("array<long>")
    # the input's columns travel in one struct, so none can clash with a helper's name, and each text only once
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("carried"))
    joined = rows.join(marks, F.coalesce(F.col("carried.doc_id").cast("long"), F.lit(int(NO_ID)).cast("long")) == F.col("__doc"), "left").select(
        "carried", *[F.coalesce(f"__{k}", none).alias(f"__{k}") for k in (WHOLE, OPEN, STRING)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried, *lists = batch.columns
            read = pa.RecordBatch.from_arrays([carried, carried.field(id_at), carried.field(text_at), *lists], names=["carried", "doc_id", "text", *batch.schema.names[1:]])
            for part in tb.slices(iter([read]), 2):
                yield from _spans(part)

    schema = f"carried {rows.schema['carried'].dataType.simpleString()}, removed_spans array<struct<start: long, end: long>>, kept_bytes binary, kept_text string"
    return joined.mapInArrow(cut, schema).select("carried.*", "removed_spans", "kept_bytes", "kept_text")
