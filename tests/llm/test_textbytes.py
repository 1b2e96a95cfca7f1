"""Chunks, slices, words and rolling hashes of Arrow text columns."""

from __future__ import annotations

import random

import pyarrow as pa

from tests.llm.brute import WORD
from trailmark.llm import textbytes as tb

TEXTS = ["", None, "a b", " lead and trail ", "\x0b\x0c", "Ünï CODE", "x" * 50, "one\ntwo\rthree", None, "z"]


def test_words_stay_within_rows():
    for size in (1, 7, 1 << 20):
        got = []
        for chunk in tb.chunks(pa.array(TEXTS), size):
            w = tb.words(chunk)
            for i in range(chunk.hi - chunk.lo):
                got.append([chunk.data[a:b].tobytes().decode() for a, b in zip(w.start[w.first[i]:w.first[i + 1]], w.end[w.first[i]:w.first[i + 1]])])
        assert got == [WORD.findall(t or "") for t in TEXTS]


def test_hashes_do_not_depend_on_place():
    rng = random.Random(1)
    seen = {}
    for _ in range(30):
        texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(12))) for _ in range(8)]
        for chunk in tb.chunks(pa.array(texts).slice(2), 9):
            w = tb.words(chunk)
            for a, b, h in zip(w.start, w.end, w.hash.tolist()):
                assert seen.setdefault(chunk.data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_cover_the_batch_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], names=["id", "text"])
    for size in (1, 5, 60, 1 << 20):
        parts = list(tb.slices(iter([batch]), 1, size))
        assert pa.Table.from_batches(parts).column("id").to_pylist() == list(range(len(TEXTS)))
    assert list(tb.slices(iter([batch.slice(0, 0)]), 1)) == []
