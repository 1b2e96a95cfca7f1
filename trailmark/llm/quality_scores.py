"""Operator 12: quality scores from random Fourier features of document statistics.

1. Every text becomes ``len(STATISTICS)`` numbers that follow from the text alone.
2. ``FEATURES`` random cosines of the standardised numbers approximate a Gaussian kernel of width
   ``WIDTH``. Ridge regression on them needs only the sums X'X and X'y: every task adds up its rows,
   the sums are added matrix row by matrix row, and the driver solves one system of fixed size.
3. Isotonic regression on training rows that the ridge fit has not seen turns raw scores into
   probabilities. It works on a histogram of ``BINS`` bins, so what reaches the driver is bounded;
   between the centres of its steps scores are interpolated, which keeps their order.

All labelled rows take part; nothing is sampled. Only rows whose ``crc32(doc_id as text) mod 5`` is
not 0 are ever joined to a label: remainders 1 to 3 fit the ridge, remainder 4 the calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm import textbytes as tb
from trailmark.llm.staging import stored

STATISTICS = [
    "log_words", "log_bytes", "word_length", "word_length_spread", "upper", "digits", "symbols", "stops", "marks", "spaces",
    "newlines", "other_signs", "not_ascii", "controls", "entropy", "distinct_words", "top_word", "repeated_windows", "dup_lines",
    "words_per_line", "short_words", "no_letter_words", "all_upper_words", "repeated_pairs",
]
FEATURES = 256
WIDTH = 5.0
RIDGE = 1e-4
CLIP = 5.0
BINS = 4096
LOW, HIGH = -0.5, 1.5  # raw scores outside are in the first or the last bin
CUT = 0.3
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 4
ROWS = 512  # texts handled at a time

U64 = np.uint64


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789")
_SYMBOL, _STOP, _MARK = _mask("#*$%&|<>"), _mask(".,;:"), _mask("!?")
_OTHER = _mask("\"'()+-/=@[\\]^_`{}~")
_HIGH = np.arange(256) >= 0x80
_NEWLINE = _mask("\n")
_CONTROL = (np.arange(256) < 0x20) & ~tb.SPACE
_LETTER = _UPPER | _mask("abcdefghijklmnopqrstuvwxyz") | _HIGH
_SHARES = np.stack([_UPPER, _DIGIT, _SYMBOL, _STOP, _MARK, tb.SPACE, _NEWLINE, _OTHER, _HIGH, _CONTROL], axis=1).astype(np.float64)


def _by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values per row, rows at ``first``."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _groups(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: distinct hashes, the largest group, and members of groups of two or more."""
    distinct, top, repeated = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    if len(hashes):
        order = np.lexsort((hashes, row))
        h, r = hashes[order], row[order]
        begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]))
        n, of = np.diff(np.append(begin, len(h))), r[begin]
        distinct = np.bincount(of, minlength=rows).astype(float)
        np.maximum.at(top, of, n)
        repeated = np.bincount(of, weights=n * (n > 1), minlength=rows)
    return distinct, top, repeated


def _statistics(chunk: tb.Chunk) -> np.ndarray:
    """One row of statistics per text of a chunk; all zero for an empty text."""
    rows = chunk.hi - chunk.lo
    size = chunk.lengths.astype(float)
    some = np.maximum(size, 1)
    of_byte = np.repeat(np.arange(rows), chunk.lengths)
    bytes_of = np.bincount(of_byte * 256 + chunk.data, minlength=rows * 256).reshape(rows, 256).astype(float)
    shares = bytes_of @ _SHARES / some[:, None]
    p = bytes_of / some[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    w = tb.words(chunk, lower=True)
    n = np.diff(w.first).astype(float)
    many = np.maximum(n, 1)
    row = np.repeat(np.arange(rows), np.diff(w.first))
    length = (w.end - w.start).astype(float)
    mean = _by_row(length, w.first) / many
    spread = np.sqrt(np.maximum(_by_row(length * length, w.first) / many - mean * mean, 0))
    distinct, top, _ = _groups(w.hash, row, rows)

    def repeated(k: int) -> np.ndarray:
        h, _, bounds = tb.shingle_rows(w, k)
        count = np.diff(bounds)
        return _groups(h, np.repeat(np.arange(rows), count), rows)[2] / np.maximum(count, 1)

    lines = tb.words(chunk, between=_NEWLINE)
    n_lines = np.diff(lines.first).astype(float)
    distinct_lines, _, _ = _groups(lines.hash, np.repeat(np.arange(rows), np.diff(lines.first)), rows)

    def within(mask: np.ndarray) -> np.ndarray:
        """Bytes of a class in each word."""
        total = np.zeros(len(chunk.data) + 1, np.int64)
        np.cumsum(mask[chunk.data], out=total[1:])
        return total[w.end] - total[w.start]

    letters, upper = within(_LETTER), within(_UPPER)
    out = np.stack([
        np.log1p(n), np.log1p(size), np.log1p(mean), np.log1p(spread), *shares[:, :5].T, shares[:, 5], shares[:, 6] * 10, *shares[:, 7:].T,
        entropy, distinct / many, top / many, repeated(8), 1 - np.where(n_lines > 0, distinct_lines / np.maximum(n_lines, 1), 1),
        np.log1p(n / np.maximum(n_lines, 1)), _by_row(length <= 2, w.first) / many, _by_row(letters == 0, w.first) / many,
        _by_row((letters > 1) & (upper == letters), w.first) / many, repeated(2)], axis=1)
    return out * (size > 0)[:, None]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tb.slices(batches, 1):
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            x = np.concatenate([_statistics(chunk) for chunk in tb.chunks(part.column(1))])
            values = pa.array(x.ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([part.column(0), lists, part.column(2)], names=["doc_id", "statistics", "row"])


def statistics(docs: DataFrame, row: Column) -> DataFrame:
    """``doc_id, statistics, row`` for every row of ``docs`` (doc_id, text)."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row.alias("row"))
    return named.mapInArrow(_measured, f"doc_id long, statistics array<double>, row {named.schema['row'].dataType.simpleString()}")


@dataclass
class Model:
    """Raw scores are ``cosines @ weights``; ``knots`` and ``levels`` turn them into probabilities."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random cosines, the standardised statistics themselves, and a constant."""
        rng = np.random.Generator(np.random.PCG64(12))
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        turn = rng.normal(size=(len(STATISTICS), FEATURES)) / WIDTH
        return np.hstack([np.cos(z @ turn + rng.uniform(0, 2 * np.pi, FEATURES)) * np.sqrt(2 / FEATURES), z / CLIP, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.round(np.clip(self.features(x) @ self.weights, LOW, HIGH), 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.levels[0])
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _partial_sums(model: Model):
    """A task that yields its part of X'X with X'y as last column, a row per feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = model.features(_matrix(batch.column("statistics")))
                y = batch.column("label").to_numpy().astype(float)
                part = x.T @ np.column_stack([x, y])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, sums in zip(batch.column("i").to_pylist(), batch.column("sums").to_pylist()):
            row = np.frombuffer(sums, np.float64)
            total[i] = total[i] + row if i in total else row
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([r.tobytes() for r in total.values()], pa.binary())], names=["i", "sums"])


def isotonic(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Non-decreasing levels of least squared error (pool adjacent violators), one per point."""
    level: list[float] = []
    mass: list[float] = []
    count: list[int] = []
    for w, v in zip(weight.tolist(), value.tolist()):
        level.append(v)
        mass.append(w)
        count.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            w2, w1 = mass.pop(), mass.pop()
            v2, v1 = level.pop(), level.pop()
            c2, c1 = count.pop(), count.pop()
            mass.append(w1 + w2)
            level.append((w1 * v1 + w2 * v2) / (w1 + w2))
            count.append(c1 + c2)
    return np.repeat(level, count)


def fit(labelled: DataFrame) -> Model:
    """The model of rows with ``statistics, label`` (0 or 1) and ``fold`` (1 to 4).

    Without rows of both labels every score is the share of label 1, or 0.5 without any row.
    """
    at = [F.col("statistics")[i] for i in range(len(STATISTICS))]
    totals = labelled.agg(F.count("*").alias("n"), F.avg("label").alias("share"), F.count(F.when(F.col("fold") != CALIBRATE, 1)).alias("n_ridge"),
                          F.array(*[F.avg(c) for c in at]).alias("mean"), F.array(*[F.stddev_pop(c) for c in at]).alias("scale")).first()
    if not totals["n"] or totals["share"] in (0.0, 1.0):
        level = totals["share"] if totals["n"] else 0.5
        return Model(np.zeros(0), np.zeros(0), None, np.zeros(1), np.array([level]))
    # sums depend on the order of rows in their last digits; rounded, the model does not
    mean = np.array([float(f"{v:.6g}") for v in totals["mean"]])
    scale = np.array([float(f"{v:.6g}") for v in totals["scale"]])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), None, np.zeros(1), np.zeros(1))
    ridge = labelled.where(F.col("fold") != CALIBRATE) if totals["n_ridge"] else labelled
    sums = ridge.select("statistics", "label").mapInArrow(_partial_sums(model), "i int, sums binary")
    rows = sums.repartition(8, "i").mapInArrow(_added, "i int, sums binary").collect()  # one row per feature
    both = np.stack([np.frombuffer(r["sums"], np.float64) for r in sorted(rows, key=lambda r: r["i"])])
    xx, xy = both[:, :-1], both[:, -1]
    model.weights = np.round(np.linalg.solve(xx + RIDGE * max(totals["n_ridge"], 1) * np.eye(len(xx)), xy), 8)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(_matrix(batch.column("statistics")))
                at = np.minimum(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int32), BINS - 1)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label")], names=["bin", "label"])

    rest = labelled.where(F.col("fold") == CALIBRATE)
    found = _histogram(rest.select("statistics", "label"), binned)
    if not len(found) or found["share"].min() == found["share"].max() and len(found) == 1:
        found = _histogram(labelled.select("statistics", "label"), binned)
    levels = isotonic(found["n"].to_numpy(), found["share"].to_numpy())
    centre = LOW + (found["bin"].to_numpy() + 0.5) * (HIGH - LOW) / BINS
    model.knots, model.levels = _steps(centre, found["n"].to_numpy(), levels)
    return model


def _histogram(rows: DataFrame, binned):
    return rows.mapInArrow(binned, "bin int, label int").groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("label").alias("share")).toPandas().sort_values("bin")


def _steps(centre: np.ndarray, n: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A knot at the weighted centre of every step, and outer knots so that order is kept there too."""
    begin = np.flatnonzero(np.concatenate([[True], levels[1:] != levels[:-1]]))
    x = np.add.reduceat(centre * n, begin) / np.add.reduceat(n, begin)
    y = levels[begin]
    return np.concatenate([[LOW], x, [HIGH]]), np.concatenate([[y[0] * 0.5], y, [1 - (1 - y[-1]) * 0.5]])


def quality_scores(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default doc_id), ``held_out, score, predicted, statistics`` for every row of
    ``docs`` (doc_id, text), by the labels (doc_id, quality) of rows that are not held out.

    A null or empty text has statistics of zero and the score that they get. A null id has no label
    and is not held out. Rows that share an id are all trained on, with each label of the id; labels
    other than 0 and 1 are left out. Very long texts are measured whole. Columns of ``docs`` named
    like an output column are replaced; ``lang``, ``source`` and ids are never looked at by a score.
    An empty table gives no rows.
    """
    out = ["held_out", "score", "predicted", "statistics"]
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in out]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("string").alias("none"))
    measured = stored(statistics(docs, row), "statistics")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)).cast("int")
    known = labels.select(F.col("doc_id").cast("long").alias("of"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)")
    some = measured.select("doc_id", "statistics", fold.alias("fold")).where(F.col("fold") != HELD_OUT)
    labelled = stored(some.join(known, F.col("doc_id") == F.col("of")).select("statistics", "label", "fold"), "labelled")
    model = fit(labelled)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(_matrix(batch.column("statistics"))))], names=[*batch.schema.names, "score"])

    scored = measured.mapInArrow(score, f"doc_id long, statistics array<double>, row {measured.schema['row'].dataType.simpleString()}, score double")
    return scored.select(*[F.col(f"row.`{c}`") for c in keep], F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"), "statistics")
