"""Operator 11: alignment of two tokenizers by external counting of linked id pairs.

Tokenizer A is a byte-level BPE (``tokenizers``), B a piece BPE with byte fallback (``sentencepiece``).
Byte offsets where tokens of both end cut a text into groups; every A token of a group is linked with
every B token of it. An id pair counts once for each document that links it.

1. Spill. Each task turns some MB of texts into a run: its pair-document records (pair, document,
   links), radix-partitioned by the low bits of the A id and sorted by A id, then B id, then
   document, as zstd arrays. A run's distinct pairs with their numbers of documents are its heads.
2. Merge. Only heads travel. The heads of a radix part are merged k ways through a heap, at most
   ``FAN`` runs in a task, level by level until one table is left. The order is side-major: all pairs of an A id
   follow each other, so its highest count is known where they end.
3. Back. The table of a part answers the heads of every run, in tasks of ``FAN`` runs; counts and
   marks of the best come back to the run in the order of its heads, and its records are added up
   document by document.

A pair that is in every document is one head per run, not one per document, so no part is hot. A part's
table is bounded by the pairs of its A ids, 1/``PARTS`` of the product of both vocabularies.

Texts are cut at single spaces between two other characters: no token of A crosses such a place, and
none of B does where no piece holds a space after another character (looked up in the model; otherwise
texts are encoded whole). Each distinct unit is encoded once and looked up after that.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import textbytes as tb
from trailmark.llm.staging import shuffle_partitions, stored
from trailmark.llm.token_files import byte_characters

PARTS = 128
FAN = 256
BLOCK = 4096
RUN_BYTES = 4 << 20
TEXT_BYTES = 1 << 20
CACHE_UNITS = 1 << 19
LONG_UNIT = 64

RUNS = "run long, part int, heads binary, body binary, facts binary, doc_ids array<long>, groups array<string>"
TABLES = "part int, team int, payload binary"
FACTS = ["n_a", "n_b", "n_groups", "n_links"]
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, each in the least width that holds it, compressed."""
    import zstandard

    parts = [np.int64(len(arrays[0])).tobytes()]
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
        parts += [bytes([width]), a.astype(f"<u{width}").tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    while at < len(raw):
        width = raw[at]
        out.append(np.frombuffer(raw, f"<u{width}", n, at + 1).astype(np.int64))
        at += 1 + n * width
    return out


def _pack_sorted(pairs: np.ndarray, *arrays: np.ndarray) -> bytes:
    return _pack(np.diff(pairs, prepend=0), *arrays)


def _unpack_sorted(data: bytes) -> list[np.ndarray]:
    steps, *rest = _unpack(data)
    return [np.cumsum(steps), *rest]


class _Pool:
    """An array that grows at its end."""

    def __init__(self) -> None:
        self.data, self.n = np.zeros(1 << 12, np.int64), 0

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n:self.n + len(values)] = values
        self.n += len(values)


class Aligner:
    """Units of texts: their tokens under both tokenizers, groups and links."""

    IRREGULAR = re.compile(r"\s | \s|\A | \Z")
    CUT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, tokenizer_json: str, piece_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(tokenizer_json)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        spec = json.loads(tokenizer_json)
        to_byte = byte_characters()
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            if piece not in special:
                self.a_bytes[i] = bytes(to_byte[c] for c in piece)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.cuts = not any("▁" in p.lstrip("▁") for p in plain)
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = ([str(i) for i in range(len(side))] for side in (self.a_bytes, self.b_bytes))
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []  # groups of each unit
        self.pairs = _Pool()
        self.first, self.facts = _Pool(), [_Pool() for _ in FACTS]  # per unit
        self.good = _Pool()

    def units(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        return self.CUT.split(text) if self.IRREGULAR.search(text) else text.split(" ")

    def _byte_ids(self, units: list[str]) -> list[list[int]]:
        """A ids of units, each as it stands after a space. Units without white space at their ends are
        encoded in one text, where each begins at a cut, and told apart by their bytes."""
        plain = [k for k, u in enumerate(units) if u and not (u[0].isspace() or u[-1].isspace())]
        if len(plain) < len(units):
            out = [e.ids for e in self.a.encode_batch([" " + u for u in units], add_special_tokens=False)]
            return out
        ids = self.a.encode(" " + " ".join(units), add_special_tokens=False).ids
        ends = np.cumsum(self.a_length[np.array(ids, np.int64)])
        cuts = [0, *(np.searchsorted(ends, np.cumsum([1 + len(u.encode()) for u in units])) + 1).tolist()]
        return [ids[x:y] for x, y in zip(cuts, cuts[1:])]

    def _learn(self, units: list[str]) -> None:
        """Encodes units, each as it stands after a space."""
        a = self._byte_ids(units)
        b = self.b.encode(units, num_threads=1)
        good = []
        for k, u in enumerate(units):
            want = b" " + u.encode()
            fine = b"".join([self.a_bytes[i] for i in a[k]]) == want and b"".join([self.b_bytes[i] for i in b[k]]) == want
            good.append(fine)
            if not fine:
                a[k], b[k] = [], []
        flat_a, flat_b = (np.fromiter((i for ids in side for i in ids), np.int64) for side in (a, b))
        ends_a, ends_b = np.cumsum(self.a_length[flat_a]), np.cumsum(self.b_length[flat_b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        first_b = np.cumsum(in_b) - in_b
        each = in_b[group_a]
        at = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        pairs = np.repeat(flat_a, each) * self.n_b + flat_b[np.repeat(first_b[group_a], each) + at]
        n_a, n_b = (np.array([len(ids) for ids in side], np.int64) for side in (a, b))
        last = np.cumsum(n_a)
        links = np.concatenate([[0], np.cumsum(each)])
        n_links = links[last] - links[last - n_a]
        unit_end = np.concatenate([[0], ends_a])[last]
        n_groups = np.diff(np.searchsorted(common, unit_end, side="right"), prepend=0)
        self.first.add(self.pairs.n + np.cumsum(n_links) - n_links)
        self.pairs.add(pairs)
        for pool, values in zip(self.facts, (n_a, n_b, n_groups, n_links)):
            pool.add(values)
        self.good.add(np.array(good, np.int64))
        size_a, size_b, count = in_a.tolist(), in_b.tolist(), n_groups.tolist()
        say_a, say_b = self.a_text, self.b_text
        g = 0
        for ids_a, ids_b, groups in zip(a, b, count):
            if groups == len(ids_a) == len(ids_b):
                self.text.append(";".join([say_a[x] + "|" + say_b[y] for x, y in zip(ids_a, ids_b)]))
                g += groups
                continue
            said, i, j = [], 0, 0
            for m, n in zip(size_a[g:g + groups], size_b[g:g + groups]):
                one = say_a[ids_a[i]] if m == 1 else ",".join([say_a[x] for x in ids_a[i:i + m]])
                said.append(one + "|" + (say_b[ids_b[j]] if n == 1 else ",".join([say_b[y] for y in ids_b[j:j + n]])))
                i, j = i + m, j + n
            g += groups
            self.text.append(";".join(said))

    def read(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Unit numbers of every text; whether all its units are good. Numbers hold until the next call."""
        split = [self.units(t) if t else [] for t in texts]
        new = set().union(*split) if split else set()
        new.difference_update(self.number)
        if len(self.text) + len(new) > CACHE_UNITS:
            self._clear()
            new = set().union(*split)
        plain = [u for u in new if len(u) <= LONG_UNIT and not (u[0].isspace() or u[-1].isspace())]
        odd = list(new.difference(plain))
        for some in [plain[i:i + 8192] for i in range(0, len(plain), 8192)] + [odd[i:i + 64] for i in range(0, len(odd), 64)]:
            for u in some:
                self.number[u] = len(self.number)
            self._learn(some)
        find = self.number.__getitem__
        numbers = [np.fromiter(map(find, units), np.int64, len(units)) for units in split]
        good = np.array([bool(len(n)) and bool(self.good.data[n].all()) for n in numbers], bool)
        return [n if g else n[:0] for n, g in zip(numbers, good)], good


_aligners: dict[str, Aligner] = {}


def _aligner(tokenizer_json: str, piece_model: bytes) -> Aligner:
    key = hashlib.sha256(tokenizer_json.encode() + piece_model).hexdigest()
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(tokenizer_json, piece_model)
    return _aligners[key]


def _unique(pairs: np.ndarray, row: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (pair, row) merged, in their order."""
    key = (pairs << 24) | row
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(links[order], begin) if len(begin) else links
    return key[begin] >> 24, key[begin] & ((1 << 24) - 1), total


class _Run:
    """A run in the making."""

    def __init__(self, number: int, n_b: int):
        self.number, self.n_b = number, n_b
        self.ids: list = []
        self.groups: list[str] = []
        self.facts: list[np.ndarray] = []
        self.records: list[tuple] = []
        self.size = 0

    def add(self, ids: list, texts: list[str], aligner: Aligner, digests: bool) -> None:
        numbers, _ = aligner.read(texts)
        rows = len(ids)
        units = np.concatenate(numbers) if rows else np.zeros(0, np.int64)
        row = np.repeat(np.arange(rows), [len(n) for n in numbers])
        self.facts.append(np.stack([np.bincount(row, weights=pool.data[units], minlength=rows).astype(np.int64) for pool in aligner.facts]))
        for n in numbers:
            said = ";".join([aligner.text[i] for i in n.tolist()])
            self.groups.append(hashlib.sha256(said.encode()).hexdigest() if digests and said else said)
        # a unit that a text repeats is expanded once
        units, row, times = _unique(units, row, np.ones(len(units), np.int64))
        links = aligner.facts[3].data[units]
        at = np.arange(int(links.sum())) - np.repeat(np.cumsum(links) - links, links)
        pairs = aligner.pairs.data[np.repeat(aligner.first.data[units], links) + at]
        self.records.append(_unique(pairs, np.repeat(row, links) + len(self.ids), np.repeat(times, links)))
        self.ids += ids
        self.size += sum(map(len, texts))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The run's documents (part -1) and its records by part."""
        facts = _pack(*np.concatenate(self.facts, axis=1))
        out = [(self.number, -1, None, None, facts, self.ids, self.groups)]
        pairs, row, links = (np.concatenate(c) for c in zip(*self.records))
        part = pairs // self.n_b % PARTS
        order = np.lexsort((row, pairs, part))
        pairs, row, links, part = pairs[order], row[order], links[order], part[order]
        cuts = np.searchsorted(part, np.arange(PARTS + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            some = slice(cuts[p], cuts[p + 1])
            head, docs = np.unique(pairs[some], return_counts=True)
            out.append((self.number, p, _pack_sorted(head, docs), _pack(row[some], links[some]), None, None, None))
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                         names=["run", "part", "heads", "body", "facts", "doc_ids", "groups"])


def merged(streams: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Equal pairs of sorted (pairs, counts) streams added up, in order, a block at a time.

    A heap holds the last pair of every stream's block: up to the least of them no stream can bring
    anything more.
    """
    at = [0] * len(streams)
    heap = [(int(p[min(BLOCK, len(p)) - 1]), k) for k, (p, _) in enumerate(streams) if len(p)]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]
        some = []
        for k in [k for _, k in heap]:
            pairs, counts = streams[k]
            to = at[k] + int(np.searchsorted(pairs[at[k]:at[k] + BLOCK], bound, side="right"))
            if to > at[k]:
                some.append((pairs[at[k]:to], counts[at[k]:to]))
                at[k] = to
        while heap and heap[0][0] <= bound:
            _, k = heapq.heappop(heap)
            pairs = streams[k][0]
            if at[k] < len(pairs):
                heapq.heappush(heap, (int(pairs[min(at[k] + BLOCK, len(pairs)) - 1]), k))
        pairs, counts = (np.concatenate(c) for c in zip(*some))
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        begin = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        yield pairs[begin], np.add.reduceat(counts[order], begin)


def best_of(pairs: np.ndarray, counts: np.ndarray, n_b: int) -> np.ndarray:
    """1 where a pair's count is the highest of its A id; pairs are in order, so by A id."""
    if not len(pairs):
        return np.zeros(0, np.int64)
    side = pairs // n_b
    new = np.concatenate([[True], side[1:] != side[:-1]])
    top = np.maximum.reduceat(counts, np.flatnonzero(new))
    return (counts == top[np.cumsum(new) - 1]).astype(np.int64)


def _grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of sorted batches by key."""
    now, rows = None, []
    for batch in batches:
        names = batch.schema.names
        for values in zip(*map(tb.values, batch.columns)):
            r = dict(zip(names, values))
            key = tuple(r[c] for c in by)
            if key != now and rows:
                yield now, rows
                rows = []
            now = key
            rows.append(r)
    if rows:
        yield now, rows


def _table_row(part: int, team: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([team], pa.int32()), pa.array([payload], pa.binary())],
                                      names=["part", "team", "payload"])


def _merge_task(n_b: int | None):
    """Merges the tables of each (part, team); the last level (``n_b`` given) adds the marks of the best."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, team), rows in _grouped(batches, ["part", "team"]):
            blocks = list(merged([tuple(_unpack_sorted(r["payload"])) for r in rows]))
            pairs, counts = (np.concatenate(c) for c in zip(*blocks))
            marks = [] if n_b is None else [best_of(pairs, counts, n_b)]
            yield _table_row(part, team, _pack_sorted(pairs, counts, *marks))

    return run


def _answer_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and marks for the heads of each run, from the table of its part."""
    table: tuple | None = None
    of = None
    for batch in batches:
        for part, team, run, payload in zip(*map(tb.values, (batch.column(c) for c in ("part", "team", "run", "payload")))):
            if run is None:
                table, of = tuple(_unpack_sorted(payload)), (part, team)
                continue
            assert of == (part, team) and table is not None
            at = np.searchsorted(table[0], _unpack_sorted(payload)[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([run], pa.int64()), pa.array([part], pa.int32()), pa.array([_pack(table[1][at], table[2][at])], pa.binary())],
                names=["run", "part", "payload"])


def _fold_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each run with the sums over their links."""
    now: dict | None = None
    body: dict | None = None

    def done(r: dict, best: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        facts = _unpack(r["facts"])
        return pa.RecordBatch.from_arrays(
            [pa.array(r["doc_ids"], pa.int64()), *[pa.array(f) for f in facts], pa.array(best), pa.array(total), pa.array(r["groups"], pa.string())],
            names=["doc_id", *FACTS, "n_best", "count_sum", "groups"])

    best = total = np.zeros(0, np.int64)
    for batch in batches:
        names = batch.schema.names
        for values in zip(*map(tb.values, batch.columns)):
            r = dict(zip(names, values))
            if r["part"] < 0:
                if now is not None:
                    yield done(now, best, total)
                now = r
                best, total = np.zeros(len(r["doc_ids"]), np.int64), np.zeros(len(r["doc_ids"]), np.int64)
            elif r["body"] is not None:
                body = r
            else:
                assert now is not None and body is not None and (r["run"], r["part"]) == (body["run"], body["part"]) and r["run"] == now["run"]
                counts, marks = _unpack(r["answer"])
                _, docs = _unpack_sorted(body["heads"])
                row, links = _unpack(body["body"])
                np.add.at(total, row, links * np.repeat(counts, docs))
                np.add.at(best, row, links * np.repeat(marks, docs))
    if now is not None:
        yield done(now, best, total)


def _spilled(docs: DataFrame, tokenizer_path: str, piece_path: str, digests: bool) -> tuple[DataFrame, int]:
    """The runs of ``docs`` in the shared folder, and the number of B ids."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        shipped = spark.sparkContext.broadcast((f.read(), g.read()))  # both vocabularies, a few MB whatever the data
    n_b = Aligner(*shipped.value).n_b

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = _aligner(*shipped.value)
        number = TaskContext.get().partitionId() << 32
        run = _Run(number, n_b)
        for batch in tb.slices(batches, 1, TEXT_BYTES):
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                run.add(some.column(0).to_pylist(), [t or "" for t in some.column(1).to_pylist()], aligner, digests)
                if run.size >= RUN_BYTES or len(run.ids) >= 1 << 20:
                    yield from run.rows()
                    number += 1
                    run = _Run(number, n_b)
        if run.ids:
            yield from run.rows()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(texts.mapInArrow(spill, RUNS), "runs"), n_b


def _counted(runs: DataFrame, n_b: int) -> tuple[DataFrame, DataFrame, int]:
    """Heads (part, team, run, payload), tables (part, payload) with counts and marks, number of teams."""
    tasks = shuffle_partitions(runs.sparkSession)
    teams = max(1, -(-runs.where("part < 0").count() // FAN))
    heads = runs.where("part >= 0").select("part", F.pmod(F.xxhash64("run"), F.lit(teams)).cast("int").alias("team"), "run", F.col("heads").alias("payload"))
    table, left = heads.select("part", "team", "payload"), teams
    while True:
        dealt = table.repartition(tasks, "part", "team").sortWithinPartitions("part", "team")
        table = stored(dealt.mapInArrow(_merge_task(n_b if left == 1 else None), TABLES), "pair-counts")
        if left == 1:
            return heads, table.select("part", "payload"), teams
        left = -(-left // FAN)
        table = table.select("part", F.pmod("team", F.lit(left)).cast("int").alias("team"), "payload")


def pair_counts(docs: DataFrame, tokenizer_path: str, piece_path: str) -> DataFrame:
    """``a_id, b_id, documents, best`` of every id pair that some document of ``docs`` links."""
    runs, n_b = _spilled(docs, tokenizer_path, piece_path, True)
    _, tables, _ = _counted(runs, n_b)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in tb.values(batch.column("payload")):
                pairs, counts, marks = _unpack_sorted(payload)
                yield pa.RecordBatch.from_arrays([pa.array(pairs // n_b), pa.array(pairs % n_b), pa.array(counts), pa.array(marks.astype(bool))],
                                                 names=["a_id", "b_id", "documents", "best"])

    return tables.mapInArrow(rows, "a_id long, b_id long, documents long, best boolean")


def aligned(docs: DataFrame, tokenizer_path: str, piece_path: str, digests: bool = False) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` (decimal ids in order), or with ``digests`` its SHA-256 in
    hex. A null or empty text, and one whose tokens of A or of B do not give back the bytes of a
    space and the text, has no tokens: zeros and ''. Rows are documents of their own even where they
    share an id or a text; a null id stays null. Other columns are ignored; an empty table gives no
    rows. A text larger than a run is a run of its own.
    """
    runs, n_b = _spilled(docs, tokenizer_path, piece_path, digests)
    heads, tables, teams = _counted(runs, n_b)
    tasks = shuffle_partitions(docs.sparkSession)
    every = F.explode(F.sequence(F.lit(0), F.lit(teams - 1))).alias("team")
    asked = tables.select("part", every, F.lit(None).cast("long").alias("run"), "payload").unionByName(heads)
    answers = asked.repartition(tasks, "part", "team").sortWithinPartitions("part", "team", F.col("run").asc_nulls_first()).mapInArrow(
        _answer_task, "run long, part int, payload binary")
    none = F.lit(None)
    told = answers.select("run", "part", none.cast("binary").alias("heads"), none.cast("binary").alias("body"), none.cast("binary").alias("facts"),
                          none.cast("array<long>").alias("doc_ids"), none.cast("array<string>").alias("groups"), F.col("payload").alias("answer"))
    both = runs.withColumn("answer", none.cast("binary")).unionByName(told)
    return both.repartition(tasks, "run").sortWithinPartitions("run", "part", F.col("answer").isNotNull()).mapInArrow(_fold_task, OUT)
