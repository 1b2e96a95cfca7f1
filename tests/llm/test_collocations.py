"""Collocations against plain counting, whatever the sample proposes."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tests.llm.brute import LOWER
from tests.llm.fixtures import SCHEMA, documents
from trailmark.llm import collocations as c


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i:i + m]] = max(inside[lang, w[i:i + m]], a)
    per: dict = {}
    for (lang, w), a in found.items():
        if 100 * inside[lang, w] >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        per.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang, some in per.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(some)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["river", "Stone", "éclair", "ΣΑΣ", "a", "of", "the", "q-x", "\x00z", " w", "日本"]
    phrases = ["old mill road", "the river of stone", "to be or not", "x x x x", "A b"]
    rows = documents(seed=2, n=40)
    for i in range(250):
        parts = [rng.choice(phrases) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randrange(1, 40))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " !"]) for p in parts)
        rows.append((1000 + i, text, rng.choice(["en", "en", "de", None, "", "und"]), "s", len(text), True))
    rows += rows[-20:] + [(None, "x x x x", "en", None, None, None)] * 4
    return rows


def of(df, **options):
    return sorted(tuple(r) for r in c.collocations(df, **options).collect())


@pytest.mark.parametrize("sample,sample_least,bits,parts", [(0.25, 3, 27, 3), (0.25, 10**6, 27, 1), (1.0, 1, 27, 4), (0.25, 3, 12, 2)])
def test_equals_counting(spark, monkeypatch, sample, sample_least, bits, parts):
    monkeypatch.setattr(c, "SAMPLE", sample)
    monkeypatch.setattr(c, "SAMPLE_LEAST", sample_least)  # a sample that proposes nothing leaves all to the border
    monkeypatch.setattr(c, "MAX_BITS", bits)
    df = spark.createDataFrame(corpus(), SCHEMA).repartition(parts)
    assert of(df, least=30, top=2000) == brute(corpus(), 30, 2000)


def test_top_and_small_least(spark, monkeypatch):
    monkeypatch.setattr(c, "HELD", 50)  # tasks hand on what they hold again and again
    monkeypatch.setattr(c, "BUCKET_BYTES", 256)
    df = spark.createDataFrame(corpus(9), SCHEMA).repartition(2)
    assert of(df, least=5, top=7) == brute(corpus(9), 5, 7)


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert of(empty) == []
    rows = [("one two " * 40, "en", 1, 2)] * 2 + [(None, None, 3, 4), ("", "en", 5, 6)]
    df = spark.createDataFrame(rows, "text string, lang string, phrase int, n int")
    got = of(df)
    assert got == brute([(None, t, lang) for t, lang, *_ in rows], 30, 2000) and got[0][6] == 160


def test_scores_beyond_64_bits(spark):
    rows = [("en", "a b", 2, 9 * 10**18), ("en", "a", 1, 9 * 10**18), ("en", "b", 1, 9 * 10**18), ("en", None, 0, 5)]
    (r,) = c.scored(spark.createDataFrame(rows, c.PHRASES), 30).collect()
    assert r["score"] == 1_000_000 and r["a"] == 9 * 10**18


def test_counting_tasks_hold_little():
    """A task that counts phrases, all of them different, holds a bounded number of them and loses none."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 10**9, 10_000).tolist())) for _ in range(120)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * 10), pa.array(texts[i:i + 10])], names=["lang", "text"]) for i in range(0, 120, 10)]
    run = c._entries(lambda size, before: np.ones(len(before) - 1, bool), range(1, 5), 64)
    tracemalloc.start()
    try:
        n = sum(len(sizes) for batch in run(iter(batches)) for sizes in batch.column("sizes").to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n > 4_500_000 and peak < 200 << 20
