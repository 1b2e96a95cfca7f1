"""Operator 13: phrase collocations, mined by Toivonen's sampling.

Phrases are runs of words of one piece of text, counted per language. A phrase can only reach the
least count if its first and its last words (all but one of them) do.

1. A sample of the documents proposes phrases: those of one to three words that reach a lowered
   count in it, level by level.
2. One pass over all documents counts, exactly, every proposed phrase and the negative border: the
   phrases that are not proposed but whose two parts are. Every single word belongs to it.
3. Frequent phrases of the border that were not proposed are failures: longer phrases over them were
   not counted. Expansion passes count the phrases whose parts are known to be frequent and were
   not both proposed, until a pass finds nothing that a longer phrase could be built on. Phrases of the greatest
   length over the last failures are counted by the last pass below, which takes all whose parts are
   frequent. No pass is left out on account of the sample, so the result is that of counting everything.

The sets of proposed and of frequent phrases reach the tasks as bitmaps of at most ``2**MAX_BITS``
bits, whatever the corpus; a false positive costs counting one phrase more and changes nothing.
Passes count 48-bit hashes, equal ones merged within a task, in hash buckets sized by the texts;
a collision can only raise such a count, so it screens without loss. A last pass counts what is left as strings, and from
there on all is joins on strings: counts, cuts, scores and containment are exact.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm import textbytes as tb
from trailmark.llm.staging import shuffle_partitions, stored

LONGEST = 4
LEAST = 30
SCALE = 2_000_000
CONTAINED = 80  # per cent of a phrase's count inside one longer candidate
TOP = 2000
SAMPLE = 0.25
SAMPLE_LEAST = 3  # of 7.5 expected for a phrase at the least count
MAX_BITS = 27
HELD = 1 << 19  # distinct phrases that a task holds before it hands them on; it takes some 150 bytes for each
BUCKET_BYTES = 1 << 22  # of text for each hash bucket
SALTS = 64
STRING_BYTES = 6 << 20  # of text whose phrases are merged as strings at a time

U64 = np.uint64
KEY_BITS = 48
ENTRIES = "bucket int, keys binary, counts binary, sizes binary"
COUNTED = "key long, size int, n long"
PHRASES = "lang string, phrase string, size int, n long"

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True

_rng = np.random.Generator(np.random.PCG64(13))
_BYTE, _PLACE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64), _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_AT = [U64(pow(0xC2B2AE3D27D4EB4F, j, 1 << 64)) for j in range(LONGEST)]


class Phrases:
    """Words of a chunk of texts, and the phrases of up to ``LONGEST`` words at each of them."""

    def __init__(self, chunk: tb.Chunk, salts: np.ndarray):
        """``salts``: 64 bits per row that stand for its language."""
        self.chunk = chunk
        self.words = w = tb.words(chunk, lower=True, between=GAP)
        self.row = np.searchsorted(w.first, np.arange(len(w.start)), side="right") - 1
        breaks = np.zeros(len(chunk.data) + 1, np.int64)
        np.cumsum(BREAK[chunk.data], out=breaks[1:])
        self.piece = breaks[w.start] + self.row  # both only grow, so equal sums are equal pieces
        self.salt = salts[self.row] if len(self.row) else np.zeros(0, U64)
        self._sum = np.zeros(len(w.hash), U64)
        self.size = 0
        self.inside = np.zeros(0, bool)

    def grow(self, hashes: np.ndarray | None = None) -> np.ndarray:
        """Keys of the phrases one word longer than the last ones, and which stay within a piece."""
        w = self.words.hash if hashes is None else hashes
        k = self.size
        n = max(len(w) - k, 0)
        self._sum = self._sum[:n] + w[k:k + n] * _AT[k]
        self.size = k + 1
        self.inside = self.piece[k:k + n] == self.piece[:n]
        return tb.mix(self._sum + self.salt[:n] * U64(2 * k + 3)) >> U64(64 - KEY_BITS)

    def again(self) -> Phrases:
        """The same words, to grow phrases from other hashes."""
        out = copy.copy(self)
        out._sum, out.size = np.zeros(len(self.words.hash), U64), 0
        return out

    def forget(self) -> None:
        """Keeps what ``texts`` needs."""
        self._sum = self.salt = self.piece = self.row = self.inside = None

    def second_hashes(self) -> np.ndarray:
        """Further 64 bits for every word, from other multipliers."""
        w, data = self.words, tb.LOWER[self.chunk.data]
        if not len(w.start):
            return np.zeros(0, U64)
        length = w.end - w.start
        ends = np.cumsum(length)
        begin = ends - length
        at = np.arange(int(ends[-1])) - np.repeat(begin, length)
        some = data[np.repeat(w.start, length) + at]
        far = (at >> 8).astype(U64) * U64(0x9E3779B97F4A7C15)
        return tb.mix(np.add.reduceat((_BYTE[some] + far) * _PLACE[at & 255], begin) + length.astype(U64))

    def texts(self, first: np.ndarray, size: int) -> pa.Array:
        """The phrases of ``size`` words at the words ``first``, one space between words."""
        if not len(first):
            return pa.array([], pa.string())
        w, data = self.words, tb.LOWER[self.chunk.data]
        wide = np.concatenate([w.start[1:] - w.end[:-1], [0]]) > 1
        odd = np.zeros(len(first), bool)
        for j in range(size - 1):
            odd |= wide[first + j]
        start, length = w.start[first], w.end[first + size - 1] - w.start[first]
        ends = np.cumsum(length)
        some = data[np.arange(int(ends[-1])) + np.repeat(start - (ends - length), length)]
        some[some == 0x09] = 0x20  # no word holds a tab
        out = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(some))
        if odd.any():  # more than one byte between two words
            fixed = [b" ".join(data[w.start[i + j]:w.end[i + j]].tobytes() for j in range(size)).decode()
                     for i in first[odd].tolist()]
            out = pc.replace_with_mask(out, pa.array(odd), pa.array(fixed, pa.string()))
        return out


def language_salts(column: pa.Array) -> np.ndarray:
    """64 bits for each row's language."""
    out = np.zeros(len(column), U64)
    for chunk in tb.chunks(column):
        prefix = tb.prefix_hash(chunk.data)
        out[chunk.lo:chunk.hi] = tb.mix(tb.range_hash(prefix, chunk.offsets[:-1], chunk.offsets[1:]) + chunk.lengths.astype(U64))
    return out


@dataclass
class Bitmap:
    """Hashed members of a set of phrases; ``holds`` is never false for a member."""

    bits: int
    words: np.ndarray

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys & U64((1 << self.bits) - 1)
        return (self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).astype(bool)


def bitmap_of(counted: DataFrame, bits: int, into: Bitmap | None = None) -> Bitmap:
    """The keys of ``counted`` as a bitmap, added to those of ``into``: a row per 64 bits set reaches the driver."""
    at = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    rows = (counted.groupBy(F.shiftright(at, 6).alias("word"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast((key & {(1 << bits) - 1}) & 63 as int))")).alias("set")).toArrow())
    words = np.zeros(1 << max(bits - 6, 0), U64) if into is None else into.words.copy()
    words[rows.column("word").to_numpy()] |= rows.column("set").to_numpy().view(U64)
    return Bitmap(bits, words)


def _steps(keys: np.ndarray) -> bytes:
    """Keys in order as differences, each in the fewest bytes that hold all of them."""
    steps = np.diff(keys, prepend=U64(0))
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    if width > 4 and len(keys) > 1:  # the first key alone may be wide
        rest = max(1, -(-int(steps[1:].max()).bit_length() // 8))
        if rest < width:
            return bytes([rest]) + keys[0].tobytes() + _low_bytes(steps[1:], rest)
    return bytes([width]) + bytes(8) + _low_bytes(steps, width)


def _low_bytes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _from_steps(data: bytes, n: int) -> np.ndarray:
    width, first = data[0], np.frombuffer(data, "<u8", 1, 1)
    low = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(low), 8), np.uint8)
    steps[:, :width] = low
    steps = steps.view("<u8").ravel()
    return np.cumsum(steps if len(steps) == n else np.concatenate([first, steps]), dtype=U64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal keys of (keys, counts, sizes) merged; in order of the key."""
    key, n, size = (np.concatenate(c) for c in zip(*parts))
    if not len(key):
        return key, n, size
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[begin], np.add.reduceat(n[order], begin), size[order][begin]


def _entries(pick: Callable, sizes: range, buckets: int) -> Callable:
    """A task that counts phrases of ``sizes``; ``pick(size, keys, keys of all parts)`` says which."""
    def handed(key: np.ndarray, n: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        home = ((key >> U64(KEY_BITS - 32)) * U64(buckets) >> U64(32)).astype(np.int64)  # sorted by key, so by bucket
        cuts = np.searchsorted(home, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        n = n.astype("<u8" if len(n) and n.max() >> 32 else "<u4")
        rows = [(int(b), _steps(key[cuts[b]:cuts[b + 1]]), n[cuts[b]:cuts[b + 1]].tobytes(), size[cuts[b]:cuts[b + 1]].tobytes()) for b in full]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))],
                                          names=["bucket", "keys", "counts", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0
        for batch in batches:
            salts = language_salts(batch.column(0))
            for chunk in tb.chunks(batch.column(1)):
                p = Phrases(chunk, salts[chunk.lo:chunk.hi])
                before = None
                for k in range(1, sizes.stop):
                    keys = p.grow()
                    if k in sizes:
                        some = keys[p.inside & pick(k, before)] if k > 1 else keys
                        if len(some):
                            some, n = np.unique(some, return_counts=True)
                            held.append((some, n.astype(np.int64), np.full(len(some), k, np.uint8)))
                            count += len(some)
                    before = keys
                if count > 2 * HELD:
                    held = [_merged(held)]
                    count = len(held[0][0])
                    if count > HELD:
                        yield handed(*held[0])
                        held, count = [], 0
        if count:
            yield handed(*_merged(held))

    return run


def _summed(least: int) -> Callable:
    """A task that adds up whole buckets and yields what reaches the least count."""
    def total(parts: list) -> Iterator[pa.RecordBatch]:
        key, n, size = _merged(parts)
        some = n >= least
        if some.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[some].view(np.int64)), pa.array(size[some].astype(np.int32)), pa.array(n[some])], names=["key", "size", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bucket, keys, counts, sizes in zip(*map(tb.values, batch.columns)):
                if bucket != now and parts:
                    yield from total(parts)
                    parts = []
                now = bucket
                size = np.frombuffer(sizes, np.uint8)
                n = np.frombuffer(counts, f"<u{len(counts) // len(size)}").astype(np.int64)
                parts.append((_from_steps(keys, len(size)), n, size))
        if parts:
            yield from total(parts)

    return run


class Miner:
    """Passes over one table of (lang, text)."""

    def __init__(self, texts: DataFrame):
        self.texts = texts
        self.spark = texts.sparkSession
        size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        self.buckets = max(64, -(-size // BUCKET_BYTES))
        self.bits = min(max(int(size // 8).bit_length(), 12), MAX_BITS)

    def ship(self, bitmap: Bitmap) -> Broadcast:
        return self.spark.sparkContext.broadcast(bitmap)

    def counted(self, texts: DataFrame, pick: Callable, sizes: range, least: int, name: str) -> DataFrame:
        """Phrases (key, size, n) that ``pick`` names and that occur ``least`` times in ``texts``."""
        entries = texts.mapInArrow(_entries(pick, sizes, self.buckets), ENTRIES)
        dealt = entries.repartition(shuffle_partitions(self.spark), "bucket").sortWithinPartitions("bucket")
        return stored(dealt.mapInArrow(_summed(least), COUNTED), name)

    def proposed(self) -> Bitmap:
        """Phrases of up to ``LONGEST - 1`` words that reach the lowered count in the sample."""
        sample = self.texts.sample(SAMPLE, seed=13)
        out = bitmap_of(self.spark.createDataFrame([], COUNTED), self.bits)
        for k in range(1, LONGEST):
            known = self.ship(out)
            found = self.counted(sample, lambda size, parts, known=known: _both(known.value, parts), range(k, k + 1), SAMPLE_LEAST, f"sample-{k}")
            out = bitmap_of(found, self.bits, out)
        return out

    def frequent(self, least: int) -> DataFrame:
        """All phrases (key, size, n) whose hashes occur ``least`` times, closed as described above."""
        proposed = self.proposed()
        s = self.ship(proposed)
        found = self.counted(self.texts, lambda size, parts: _both(s.value, parts), range(1, LONGEST + 1), least, "full")
        out, before, known = found, None, None
        while True:
            # over the longest but one only phrases of the greatest length are built, which ``as_strings`` counts
            failures = found.where(F.col("size") < LONGEST - 1)
            if before is None:
                failures = failures.mapInArrow(_unproposed(s), "key long")
            if failures.isEmpty():
                return out
            before, known = known, bitmap_of(found.where(F.col("size") < LONGEST), self.bits, known)
            old, new = (None if before is None else self.ship(before)), self.ship(known)

            def pick(size: int, parts: np.ndarray, old=old, new=new) -> np.ndarray:
                some = _both(new.value, parts) & ~_both(s.value, parts)
                return some if old is None else some & ~_both(old.value, parts)

            if before is None:
                before = Bitmap(self.bits, np.zeros_like(known.words))
            found = self.counted(self.texts, pick, range(2, LONGEST + 1), least, "expansion")
            out = out.unionByName(found)

    def as_strings(self, frequent: DataFrame) -> DataFrame:
        """Exact counts (lang, phrase, size, n) of the phrases that the hashes of ``frequent`` may stand
        for, and each language's number of words (phrase null)."""
        shipped = self.ship(bitmap_of(frequent, self.bits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in tb.slices(batches, 1, STRING_BYTES):
                langs, which = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
                salts = language_salts(batch.column(0))
                words = np.zeros(len(langs), np.int64)
                held: list[list] = [[] for _ in range(LONGEST)]  # by size: key, second hash, language, chunk, word
                chunks: list[Phrases] = []
                for chunk in tb.chunks(batch.column(1)):
                    p = Phrases(chunk, salts[chunk.lo:chunk.hi])
                    q, second = p.again(), p.second_hashes()
                    lang = which[chunk.lo:chunk.hi]
                    words += np.bincount(lang, weights=np.diff(p.words.first), minlength=len(langs)).astype(np.int64)
                    fits = None
                    for k in range(1, LONGEST + 1):
                        keys, others = p.grow(), q.grow(second)
                        before, fits = fits, p.inside.copy()
                        if k < LONGEST:
                            fits &= shipped.value.holds(keys)
                        if before is not None:
                            fits &= before[:-1] & before[1:] if len(before) else False
                        at = np.flatnonzero(fits)
                        key, other, first, n = _same(keys[at], others[at], at)
                        held[k - 1].append((key, other, lang[p.row[first]], np.full(len(first), len(chunks)), first, n))
                    p.forget()
                    chunks.append(p)
                for k, parts in enumerate(held, 1):
                    key, other, lang, chunk, first, n = (np.concatenate(c) for c in zip(*parts))
                    key, other, some, n = _same(key, other, np.arange(len(key)), n)
                    for c, p in enumerate(chunks):
                        here = some[chunk[some] == c]
                        if len(here):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(langs[lang[here]], pa.string()), p.texts(first[here], k), pa.array(np.full(len(here), k, np.int32)),
                                 pa.array(n[chunk[some] == c])], names=["lang", "phrase", "size", "n"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()), pa.nulls(len(langs), pa.string()), pa.array(np.zeros(len(langs), np.int32)), pa.array(words)],
                    names=["lang", "phrase", "size", "n"])

        rows = self.texts.mapInArrow(run, PHRASES)
        return stored(rows.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")), "phrases")


def _same(key: np.ndarray, other: np.ndarray, at: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Rows equal in both hashes as one: hashes, the place of one of them, and their number."""
    order = np.argsort(key, kind="stable")
    a, b = key[order], other[order]
    if len(a) and ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((other, key))
        a, b = key[order], other[order]
    begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    total = np.diff(np.append(begin, len(a))) if n is None else np.add.reduceat(n[order], begin) if len(a) else n
    return a[begin], b[begin], at[order[begin]], total


def _both(bitmap: Bitmap, parts: np.ndarray | None) -> np.ndarray:
    """Whether the first and the last part of each phrase one word longer are held."""
    held = bitmap.holds(parts)
    return held[:-1] & held[1:]


def _unproposed(proposed: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key")
            yield pa.RecordBatch.from_arrays([keys], names=["key"]).filter(pa.array(~proposed.value.holds(keys.to_numpy().view(U64))))

    return run


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def scored(phrases: DataFrame, least: int) -> DataFrame:
    """Candidates (lang, phrase, a, l, r, score) of exact counts (lang, phrase, size, n), without those
    that a longer candidate contains."""
    known = phrases.where(F.col("phrase").isNotNull() & (F.col("n") >= least))
    several = known.where("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = several.select("lang", "phrase", F.col("n").alias("a"), F.posexplode(F.expr(
        "transform(sequence(1, size - 1), k -> struct(array_join(slice(words, 1, k), ' ') as left, array_join(slice(words, k + 1, size - k), ' ') as right))"
    )).alias("k", "cut"))

    def of(side: str, name: str) -> DataFrame:
        return known.select(F.col("lang").alias(f"{side}_lang"), F.col("phrase").alias(f"{side}_phrase"), F.col("n").alias(name))

    left, right = of("left", "l"), of("right", "r")
    both = (cuts.join(left, (F.col("lang") == F.col("left_lang")) & (F.col("cut.left") == F.col("left_phrase")))
            .join(right, (F.col("lang") == F.col("right_lang")) & (F.col("cut.right") == F.col("right_phrase"))))
    score = F.expr(f"cast(a as decimal(20,0)) * {SCALE} div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = both.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = several.where("size > 2").select("lang", "n", F.explode(F.array_distinct(F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(words, i, m), ' '))))"
    ))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    inner = inner.select(F.col("lang").alias("in_lang"), F.col("phrase").alias("in_phrase"), "longer")
    kept = lowest.join(inner, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")), "left").where(
        F.col("longer").isNull() | (_exact(F.col("longer")) * 100 < _exact(F.col("a")) * CONTAINED))
    return kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of every language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    A null language is ``und``; a null or empty text has no words. Rows that repeat count again each
    time. Other columns are ignored; an empty table gives no rows. Ties are settled by the count,
    then by the phrase in the order of its bytes. A very long text is one chunk of its task.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    miner = Miner(texts)
    phrases = miner.as_strings(miner.frequent(least))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most phrases: first the best of each share of it, then of those
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*best)
    some = scored(phrases, least).withColumn("in_share", F.row_number().over(share)).where(F.col("in_share") <= top).drop("in_share")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    totals = phrases.where("phrase is null").select(F.col("lang").alias("of_lang"), F.col("n"))
    return ranked.join(totals, F.col("lang") == F.col("of_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
