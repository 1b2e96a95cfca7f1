"""Operator 10: benchmark passages in documents by latent semantic retrieval, then exact checks.

Words are runs of letters and digits, lower-cased. Passages are windows of ``2 * BLOCK`` words that
start every ``BLOCK`` words; their vectors are TF-IDF.

1. Document frequencies of all words of all documents, in ``SLOTS`` hashed counters (a fixed size
   whatever the corpus; rare words that share a counter get a slightly lower weight).
2. Every passage is weighed: the share of its squared weight in the words of an item bounds its
   squared cosine with it, so passages with a share under ``ENERGY`` for every item cannot be
   candidates by their cosine. The rest, with the words around them, is written to a table; so are
   the passages and items that step 5 can accept by the words in its reach, whatever their cosine.
3. For each group of ``GROUP`` items a randomised SVD of the TF-IDF passages, benchmark and corpus:
   the range of the matrix is found by multiplying it, and its transpose, with a random matrix,
   summed over tasks; a second pass gives the Gram matrix in that range, whose eigenvectors are the
   latent axes. The rank exceeds the number of items, so the items themselves stay distinguishable.
4. Candidates are the pairs of passage and item with a latent cosine of ``COSINE`` or more, and
   those of step 2 whose words in reach weigh ``LCS_MIN`` of the item. The latter leave out nothing
   that step 5 accepts by exact words: items much shorter or longer than a passage, and paraphrases, have a low
   cosine.
5. A candidate counts if the longest common subsequence of item and passage (with its
   surroundings), weighted by the words' rarity, covers ``LCS_SURE`` of the item, or ``LCS_MIN`` of
   it while the answer (the item's last sentence) is present to ``ANSWER``. For the latter a passage that is
   a candidate by its latent cosine and lies within ``LATENT`` of the item there may fall short of exact words:
   ``SOFT_FLOOR`` of the weight must be exact, the rest may be words aligned with near ones,
   each for its latent similarity. This no cover of exact words finds.

The benchmark is taken in blocks of ``SCAN_ITEMS`` items, each a scan of the documents, so neither
the driver nor a broadcast grows with it, nor with the documents. Passages are independent rows:
no document, word or item gathers rows in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import textbytes as tb
from trailmark.llm.staging import shuffle_partitions, stored

SLOTS = 1 << 18
SLOT_BLOCK = 4096
BLOCK = 16
AROUND = 4  # blocks kept on either side of a passage for the checks
GROUP = 256
OVERSAMPLE = 16
COSINE = 0.35
ENERGY = COSINE ** 2
COMMON = 8
LCS_SURE = 0.8
LCS_MIN = 0.5
ANSWER = 0.5
NEARLY = 0.75  # of ``COSINE`` that a passage within ``LATENT`` of an item needs
LATENT = 0.6  # similarity within the latent space of a passage that may count near words
SOFT_FLOOR = 0.3  # of the item's weight that must be there word for word all the same
NEAR = 0.3  # latent similarity of words that may stand for each other
SCAN_ITEMS = 1 << 14

U64 = np.uint64
HITS = "item_id long, start_word long, n_words long, cosine double, lcs double, answer double"


def words_of(column: pa.Array) -> Iterator[tuple[tb.Chunk, tb.Words]]:
    column = pc.utf8_lower(pc.fill_null(column, ""))
    for chunk in tb.chunks(column):
        yield chunk, tb.words(chunk, between=tb.NOT_ALPHANUMERIC)


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - 18)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and of documents by hashed word, over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(SLOTS, np.int64)
        for batch in batches:
            n += batch.num_rows
            for _, w in words_of(batch.column(0)):
                row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
                key = np.sort(row * SLOTS + slot(w.hash))
                total += np.bincount(key[np.append(True, key[1:] != key[:-1])[:len(key)]] % SLOTS, minlength=SLOTS)
        if n:
            blocks = total.reshape(-1, SLOT_BLOCK)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(-1, len(blocks)), pa.int32()),
                pa.array([np.array([n]).tobytes(), *[b.tobytes() for b in blocks]], pa.binary())], names=["block", "counts"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "block int, counts binary")
    out = np.zeros(SLOTS, np.int64)
    n = 0
    for r in summed(parts, np.int64).collect():  # SLOTS counters, a fixed size
        values = np.frombuffer(r.counts, np.int64)
        if r.block < 0:
            n = int(values[0])
        else:
            out[r.block * SLOT_BLOCK:(r.block + 1) * SLOT_BLOCK] = values
    return n, out


def summed(parts: DataFrame, dtype) -> DataFrame:
    """Adds up arrays ``counts`` of equal ``block`` numbers, one array at a time."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int32()), "counts": [total.tobytes()]})
                    now, total = block, np.frombuffer(data, dtype).copy()
                else:
                    total += np.frombuffer(data, dtype)
        if now is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int32()), "counts": [total.tobytes()]})

    tasks = shuffle_partitions(parts.sparkSession)
    return parts.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(add, "block int, counts binary")


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    answer: np.ndarray


def items_of(rows: list) -> list[Item]:
    """Benchmark items with words; the answer is the last sentence, without a mark the last five words."""
    out = []
    for r in rows:
        text = r.text or ""
        cut = max(text.rstrip(" .!?\n\t\r").rfind(c) for c in ".!?\n")
        (_, w), = words_of(pa.array([text], pa.string()))
        (_, a), = words_of(pa.array([text[cut + 1:] if cut >= 0 else ""], pa.string()))
        if len(w.hash):
            out.append(Item(r.item_id, w.hash.copy(), a.hash.copy() if len(a.hash) else w.hash[-5:].copy()))
    return out


def postings(items: list[Item]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of the items; where each term's items begin and how many it has; the items."""
    terms = np.concatenate([np.unique(i.words) for i in items])
    owner = np.repeat(np.arange(len(items)), [len(np.unique(i.words)) for i in items])
    order = np.lexsort((owner, terms))
    terms, first, count = np.unique(terms[order], return_index=True, return_counts=True)
    return terms, first, count, owner[order]


def reach(n: int | np.ndarray) -> int | np.ndarray:
    """Blocks on either side of a passage that the check of an item of ``n`` words looks at."""
    return -(-n // BLOCK)


def coverage(items: list[Item], weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Postings of the items' words (terms, first, count, owner), and by item the weight that the words
    in reach must have. Words of more than ``COMMON`` items are not listed but taken as present, unless
    they are too much of an item: then all its words are listed."""
    terms, first, count, owner = postings(items)
    often = terms[count > COMMON]
    of_item = [weights[slot(i.words)].astype(np.float64) for i in items]
    total = np.array([w.sum() for w in of_item])
    given = np.array([w[np.isin(i.words, often)].sum() for i, w in zip(items, of_item)])
    whole = given > LCS_MIN / 2 * total
    listed = np.repeat(count <= COMMON, count) | whole[owner]
    term = np.repeat(np.arange(len(terms)), count)[listed]
    count = np.bincount(term, minlength=len(terms))
    need = LCS_MIN * total * (1 - 1e-6) - np.where(whole, 0.0, given)
    return terms, np.cumsum(count) - count, count, owner[listed], need, reach(np.array([len(i.words) for i in items]))


def covered(place: np.ndarray, at: np.ndarray, value: np.ndarray, block: np.ndarray, low: np.ndarray, high: np.ndarray,
            lists: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and items where the words in reach of the passage, listed for the item, weigh enough. ``place`` and ``at``
    are the places of words that are terms, and their terms; ``low`` and ``high`` the first and last block of a block's text."""
    _, first, count, owner, need, far = lists
    known = count[at] > 0
    place, at = place[known], at[known]
    n = count[at]
    item = owner[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
    total = len(low)
    key, spot = np.unique(item * total + np.repeat(block[place], n), return_inverse=True)
    if not len(key):
        return key, key
    upto = np.concatenate([[0.0], np.cumsum(np.bincount(spot, np.repeat(value[place], n)))])
    item, b = key // total, key % total
    # the passage that begins a block earlier has its reach one block earlier
    also = b > low[b]
    key_, item, b = (np.concatenate([x, x[also] - y]) for x, y in ((key, 1), (item, 0), (b, 1)))
    lo = np.searchsorted(key, item * total + np.maximum(b - far[item], low[b]), "left")
    hi = np.searchsorted(key, item * total + np.minimum(b + 1 + far[item], high[b]), "right")
    enough = np.unique(key_[upto[hi] - upto[lo] >= need[item] - 1e-9])
    return enough % total, enough // total


def passages(docs: DataFrame, items: list[Item], weights: np.ndarray) -> DataFrame:
    """Runs of words around passages that can be candidates: ``doc_id, at`` (first word), ``words``
    (hashes), ``hits`` (the blocks of the run that these passages begin with), ``near`` and
    ``near_items`` (blocks and numbers of the items that the words in reach cover enough).

    The squared cosine of a passage with an item is at most the share of the passage's squared
    weight in the item's words. Words of more than ``COMMON`` items count towards every item, so
    the share is never underestimated; those of fewer are added up item by item.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((*postings(items), len(items), weights, coverage(items, weights)))  # a block of the benchmark, SLOTS weights

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, first, count, owner, n_items, weights, lists = shared.value
        maybe = np.zeros(1 << 16, bool)
        maybe[(terms & U64(0xFFFF)).astype(np.int64)] = True
        square = (weights.astype(np.float64)) ** 2
        for batch in batches:
            for chunk, w in words_of(batch.column(1)):
                n_words = np.diff(w.first)
                n_blocks = -(-n_words // BLOCK)
                if not n_blocks.any():
                    continue
                first_block = np.concatenate([[0], np.cumsum(n_blocks)])
                row = np.repeat(np.arange(len(n_words)), n_words)
                block = first_block[row] + (np.arange(len(row)) - w.first[row]) // BLOCK
                value = square[slot(w.hash)]
                near = np.flatnonzero(maybe[(w.hash & U64(0xFFFF)).astype(np.int64)])
                at = np.minimum(np.searchsorted(terms, w.hash[near]), len(terms) - 1)
                known = terms[at] == w.hash[near]
                term, at = near[known], at[known]
                place, found = term, at  # those of all terms
                total = int(first_block[-1])
                block_row = np.repeat(np.arange(len(n_blocks)), n_blocks)
                follows = np.append(block_row[1:] == block_row[:-1], False)
                all_ = np.bincount(block, value, total)
                all_[:-1] += np.where(follows[:-1], all_[1:], 0)
                wide = count[at] > COMMON
                common = np.bincount(block[term[wide]], value[term[wide]], total)
                common[:-1] += np.where(follows[:-1], common[1:], 0)
                hits = [np.flatnonzero(common >= ENERGY * all_)]
                term, at = term[~wide], at[~wide]
                if len(term):
                    n = count[at]
                    item = owner[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                    b, v = np.repeat(block[term], n), np.repeat(value[term], n)
                    also = (b > 0) & follows[b - 1]  # the passage that begins a block earlier
                    key = np.concatenate([b, b[also] - 1]) * n_items + np.concatenate([item, item[also]])
                    key, spot = np.unique(key, return_inverse=True)
                    share = np.bincount(spot, np.concatenate([v, v[also]]))
                    b = key // n_items
                    hits.append(b[share + common[b] >= ENERGY * all_[b]])
                ends = first_block[block_row + 1]
                b, of = covered(place, found, np.sqrt(value), block, first_block[block_row], ends - 1, lists)
                hits.append(np.unique(b))
                hit = np.unique(np.concatenate(hits))
                if not len(hit):
                    continue
                edge = np.zeros(total + 1, np.int32)
                np.add.at(edge, np.maximum(hit - AROUND, first_block[block_row[hit]]), 1)
                np.add.at(edge, np.minimum(hit + 2 + AROUND, ends[hit]), -1)
                np.add.at(edge, np.maximum(b - lists[-1][of], first_block[block_row[b]]), 1)
                np.add.at(edge, np.minimum(b + 2 + lists[-1][of], ends[b]), -1)
                marked = np.cumsum(edge[:-1]) > 0
                begin = marked.copy()
                begin[1:] &= ~marked[:-1] | ~follows[:-1]
                stop = marked.copy()
                stop[:-1] &= ~marked[1:] | ~follows[:-1]
                lo, hi = np.flatnonzero(begin), np.flatnonzero(stop) + 1
                r = block_row[lo]
                order = np.argsort(b, kind="stable")
                b, of = b[order], of[order]
                cuts = list(zip(np.searchsorted(b, lo), np.searchsorted(b, hi), lo))
                a = w.first[r] + (lo - first_block[r]) * BLOCK
                z = np.minimum(w.first[r] + (hi - first_block[r]) * BLOCK, w.first[r + 1])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(chunk.lo + r)), pa.array(a - w.first[r], pa.int64()),
                    pa.array([w.hash[x:y].tobytes() for x, y in zip(a, z)], pa.binary()),
                    pa.array([hit[x:y] - k for x, y, k in zip(np.searchsorted(hit, lo), np.searchsorted(hit, hi), lo)], pa.list_(pa.int64())),
                    pa.array([b[x:y] - k for x, y, k in cuts], pa.list_(pa.int64())), pa.array([of[x:y] for x, y, _ in cuts], pa.list_(pa.int64()))],
                    names=["doc_id", "at", "words", "hits", "near", "near_items"])

    return docs.mapInArrow(find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, at long, words binary, hits array<long>, near array<long>, near_items array<long>")


class Runs:
    """Runs of words laid end to end, and the passages of them that count: the blocks in ``hits`` and
    the block after each."""

    def __init__(self, runs: list[bytes], hits: list[list[int]]):
        parts = [np.frombuffer(r, U64) for r in runs]
        sizes = np.array([len(p) for p in parts])
        self.words = np.concatenate(parts)
        self.start = np.cumsum(sizes) - sizes
        blocks = -(-sizes // BLOCK)
        self.first_block = np.cumsum(blocks) - blocks
        run = np.repeat(np.arange(len(parts)), sizes)
        self.block = self.first_block[run] + (np.arange(len(run)) - self.start[run]) // BLOCK
        of_run = np.repeat(np.arange(len(parts)), blocks)
        self.follows = np.append(of_run[1:] == of_run[:-1], False)  # a block with one after it
        n_hits = [len(h) for h in hits]
        self.run = np.repeat(np.arange(len(parts)), n_hits)
        self.at_block = self.first_block[self.run] + np.concatenate(hits).astype(np.int64)
        self.of_block = np.full(len(of_run), -1)  # the passage that begins with a block
        self.of_block[self.at_block] = np.arange(len(self.at_block))
        used = self.of_block >= 0
        used[1:] |= used[:-1] & self.follows[:-1]
        self.used = np.flatnonzero(used[self.block])  # words of the passages

    @staticmethod
    def batches(words: pa.Array, hits: pa.Array, most: int = 1 << 15) -> Iterator[tuple[int, "Runs"]]:
        """Columns of runs in parts of about ``most`` words, with the row each begins at."""
        held: tuple[list, list] = ([], [])
        size = at = 0
        for i, (w, h) in enumerate(zip(words.to_pylist(), hits.to_pylist())):
            held[0].append(w)
            held[1].append(h)
            size += len(w) // 8
            if size >= most:
                yield at, Runs(*held)
                held, size, at = ([], []), 0, i + 1
        if held[0]:
            yield at, Runs(*held)


def summed_by(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Row sums by key, keys below ``n``."""
    out = np.zeros((n, rows.shape[1]))
    if len(keys):
        k = keys
        if (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys, kind="stable")
            k, rows = keys[order], rows[order]
        begin = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        out[k[begin]] = np.add.reduceat(rows, begin, axis=0)
    return out


class Space:
    """Terms of a group of items and their weights; rows of words become TF-IDF passages."""

    def __init__(self, items: list[Item], weights: np.ndarray):
        self.items = items
        self.weights = weights
        self.terms = np.unique(np.concatenate([i.words for i in items]))
        self.weight = weights[slot(self.terms)].astype(np.float64)

    def term(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that are terms, and their terms."""
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        found = np.flatnonzero(self.terms[at] == h)
        return found, at[found]

    def windows(self, runs: Runs, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every passage its vector times ``axes`` and its full norm; and the places of the words
        that are terms, with their terms."""
        found, t = self.term(runs.words[runs.used])
        found = runs.used[found]
        n = len(runs.of_block)
        by_block = summed_by(runs.block[found], (axes * self.weight[:, None])[t], n)
        square = np.bincount(runs.block, self.weights[slot(runs.words)].astype(np.float64) ** 2, n)
        by_block[:-1] += by_block[1:] * runs.follows[:-1, None]
        square[:-1] += square[1:] * runs.follows[:-1]
        return by_block[runs.at_block], np.sqrt(np.maximum(square[runs.at_block], 1e-12)), found, t

    def item_rows(self) -> np.ndarray:
        """The items' unit TF-IDF vectors (items x terms)."""
        out = np.zeros((len(self.items), len(self.terms)))
        for k, i in enumerate(self.items):
            _, t = self.term(i.words)
            np.add.at(out[k], t, self.weight[t])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def latent_axes(space: Space, runs: DataFrame) -> np.ndarray:
    """Orthonormal latent axes (terms x rank) by randomised SVD of the group's items and all passages."""
    spark = runs.sparkSession
    rank = min(len(space.terms), len(space.items) + OVERSAMPLE)
    rng = np.random.Generator(np.random.PCG64(len(space.terms)))
    rows = space.item_rows()

    def multiplied(axes: np.ndarray, gram: bool) -> np.ndarray:
        """Sum over passages a of a (a axes), or with ``gram`` of (a axes)' (a axes)."""
        shared = spark.sparkContext.broadcast((space, axes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, axes = shared.value
            total = np.zeros((axes.shape[1] if gram else len(space.terms), axes.shape[1]))
            for batch in batches:
                for _, runs in Runs.batches(batch.column(0), batch.column(1)):
                    y, norm, found, t = space.windows(runs, axes)
                    y /= norm[:, None]
                    if gram:
                        total += y.T @ y
                        continue
                    y /= norm[:, None]
                    # a word is in the passages that begin with its block and with the one before
                    block = runs.block[found]
                    before = np.append(-1, np.where(runs.follows[:-1], runs.of_block[:-1], -1))
                    padded = np.vstack([y, np.zeros((1, y.shape[1]))])
                    mine = padded[runs.of_block[block]]
                    mine += padded[before[block]]
                    total += summed_by(t, mine, len(total)) * space.weight[:, None]
            step = 512
            for lo in range(0, len(total), step):
                yield pa.RecordBatch.from_pydict({"block": pa.array([lo // step], pa.int32()), "counts": [total[lo:lo + step].tobytes()]})

        parts = runs.select("words", "hits").mapInArrow(run, "block int, counts binary")
        got = sorted(summed(parts, np.float64).collect(), key=lambda r: r.block)  # terms x rank of one group
        flat = np.concatenate([np.frombuffer(r.counts) for r in got]) if got else np.zeros(0)
        shape = (axes.shape[1] if gram else len(space.terms), axes.shape[1])
        return flat.reshape(shape) if len(flat) else np.zeros(shape)

    def balanced(corpus: np.ndarray, bench: np.ndarray) -> np.ndarray:
        """Benchmark and corpus with the same weight."""
        size = np.linalg.norm(corpus)
        return bench + corpus * (np.linalg.norm(bench) / size if size else 0)

    start = rng.standard_normal((len(space.terms), rank))
    basis, _ = np.linalg.qr(balanced(multiplied(start, False), rows.T @ (rows @ start)))
    inner = rows @ basis
    values, turn = np.linalg.eigh(balanced(multiplied(basis, True), inner.T @ inner))
    return basis @ turn[:, values > 1e-9 * max(values.max(), 1e-12)][:, ::-1]


def weighted_lcs(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> float:
    """Greatest weight of a common subsequence of word sequences ``a`` (weighted) and ``b``."""
    best = np.zeros(len(b) + 1)
    for word, w in zip(a, weight):
        best[1:] = np.maximum(best[1:], (best[:-1] + w) * (b == word))
        best = np.maximum.accumulate(best)
    return float(best[-1])


def soft_lcs(a: np.ndarray, b: np.ndarray, weight: np.ndarray, near: np.ndarray) -> float:
    """As ``weighted_lcs``, where word i of ``a`` and another word j of ``b`` also match, for the share ``near[i, j]``."""
    best = np.zeros(len(b) + 1)
    for word, w, close in zip(a, weight, near):
        gain = np.where(b == word, 1.0, np.where(close >= NEAR, close, 0.0)) * w
        best[1:] = np.maximum(best[1:], (best[:-1] + gain) * (gain > 0))
        best = np.maximum.accumulate(best)
    return float(best[-1])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def search(space: Space, axes: np.ndarray, runs: DataFrame, base: int = 0) -> DataFrame:
    """Checked pairs of documents and items of the group (doc_id and ``HITS``), one per run and item. The group's
    items have the numbers from ``base`` in ``near_items``."""
    shared = runs.sparkSession.sparkContext.broadcast((space, axes))
    return runs.mapInArrow(lambda batches: _search(batches, *shared.value, base, COSINE), f"doc_id {runs.schema['doc_id'].dataType.simpleString()}, {HITS}")


def _search(batches: Iterator[pa.RecordBatch], space: Space, axes: np.ndarray, base: int, least: float) -> Iterator[pa.RecordBatch]:
    weight = [tuple(space.weights[slot(x)].astype(np.float64) for x in (i.words, i.answer)) for i in space.items]
    words = [list(zip(i.words.tolist(), w.tolist())) for i, (w, _) in zip(space.items, weight)]
    whole = [w.sum() for w, _ in weight]
    latent = space.item_rows() @ axes
    of_item, of_term = _unit(latent), _unit(axes)

    def close(item: Item, part: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """Latent similarity of the item's words with those of the passage. A word that no item has stands
        where its surroundings do, at the passage's own place."""
        found, t = space.term(part)
        places = np.repeat(vector[None, :], len(part), axis=0)
        places[found] = of_term[t]
        _, own = space.term(item.words)
        return of_term[own] @ places.T

    def check(k: int, h: np.ndarray, at: int, vector: np.ndarray, sets: dict[tuple[int, int], set]) -> tuple[int, int, float, float]:
        """Span, share of the item's weight in a common subsequence, and of its answer's; ``sets`` keeps the words
        of the run's spans. Where the passage is
        close to the item in the latent space and has the answer, the subsequence may take near words too."""
        item, (w, aw) = space.items[k], weight[k]
        n = len(item.words)
        lo, hi = max(0, at - BLOCK * reach(n)), min(len(h), at + (2 + reach(n)) * BLOCK)
        part = h[lo:hi]
        held = sets.get((lo, hi))
        if held is None:
            held = sets[lo, hi] = set(part.tolist())
        # the words present bound the subsequence: most candidates end here
        bound = sum([x for word, x in words[k] if word in held]) / whole[k]
        soft = SOFT_FLOOR <= bound and float(of_item[k] @ vector) >= LATENT
        if bound < LCS_MIN and not soft:
            return lo, hi - lo, bound, 0.0
        lcs, answer = weighted_lcs(item.words, part, w) / w.sum(), float((aw * np.isin(item.answer, part)).sum() / aw.sum())
        if soft and SOFT_FLOOR <= lcs < LCS_MIN and answer >= ANSWER:
            lcs = min(soft_lcs(item.words, part, w, close(item, part, vector)) / w.sum(), LCS_SURE - 1e-9)
        return lo, hi - lo, lcs, answer

    for batch in batches:
        out = []
        ids, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        near, near_items = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        for first, runs in Runs.batches(batch.column(2), batch.column(3)):
            vectors, norm, _, _ = space.windows(runs, axes)
            cosine = (vectors / norm[:, None]) @ latent.T
            places = _unit(vectors)
            wanted = cosine >= least
            # the projection lowers a cosine; within the latent space the passage may still be close to the item
            wanted |= (cosine >= NEARLY * least) & (places @ of_item.T >= LATENT)
            for r in range(len(runs.start)):
                of = np.array(near_items[first + r], np.int64) - base
                mine = (of >= 0) & (of < len(space.items))
                wanted[runs.of_block[runs.first_block[r] + np.array(near[first + r], np.int64)[mine]], of[mine]] = True
            passage, item = np.nonzero(wanted)
            order = np.lexsort((-cosine[passage, item], item, runs.run[passage]))
            best: dict[tuple[int, int], tuple] = {}
            of_run, sets = -1, {}
            for w, k in zip(passage[order].tolist(), item[order].tolist()):  # best cosine of a run and item first
                r = int(runs.run[w])
                if (r, k) in best and best[r, k][5] >= 1 - 1e-9:
                    continue
                stop = int(runs.start[r + 1]) if r + 1 < len(runs.start) else len(runs.words)
                h = runs.words[runs.start[r]:stop]
                if r != of_run:
                    of_run, sets = r, {}
                lo, n, lcs, answer = check(k, h, int(runs.at_block[w] - runs.first_block[r]) * BLOCK, places[w], sets)
                if (lcs >= LCS_SURE or (lcs >= LCS_MIN and answer >= ANSWER)) and ((r, k) not in best or lcs > best[r, k][5]):
                    row = first + r
                    best[r, k] = (ids[row], space.items[k].item_id, starts[row] + lo, n, float(cosine[w, k]), lcs, answer)
            out += best.values()
        if out:
            types = [batch.column(0).type] + [pa.int64()] * 3 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                             names=["doc_id", "item_id", "start_word", "n_words", "cosine", "lcs", "answer"])


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, id_type: str = "long") -> DataFrame:
    """Where documents (doc_id, text) hold items of ``benchmark`` (item_id, text): ``doc_id`` (as
    ``id_type``) and ``HITS``.

    A document with an item in several places has a row for each. Texts are taken whole; null or
    empty ones have no passages; a null id is carried along; with an empty benchmark or no
    documents the result is empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n_items = asked.count()
    hits = spark.createDataFrame([], f"doc_id {id_type}, {HITS}")
    if not n_items:
        return hits
    n_docs, frequency = document_frequencies(texts)
    weights = np.log((2.0 + n_docs) / (1.0 + frequency)).astype(np.float32)
    scans = -(-n_items // SCAN_ITEMS)
    for scan in range(scans):
        mine = asked if scans == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(scans)) == scan)
        items = items_of(sorted(mine.collect(), key=lambda r: (r.item_id is not None, r.item_id or 0, r.text or "")))  # about SCAN_ITEMS
        if not items:
            continue
        runs = stored(passages(texts, items, weights), "passages")
        for lo in range(0, len(items), GROUP):
            space = Space(items[lo:lo + GROUP], weights)
            hits = hits.union(search(space, latent_axes(space, runs), runs, lo))
    return hits
