"""Planted benchmark passages: verbatim, partial, paraphrased; clean documents stay clean."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.fixtures import SCHEMA, documents, sentence
from trailmark.llm import decontamination as dc

ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(11)
    fresh = lambda n: " ".join(f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bdfgklmnprst')}{rng.randrange(900)}" if rng.random() < 0.6
                               else rng.choice(["the", "of", "and", "in"]) for _ in range(n))
    items = [(i, f"{fresh(rng.randrange(12, 40))}. {fresh(8)}.") for i in range(30)]
    rows, want = [], set()
    for i in range(120):
        rows.append([i, f"{fresh(rng.randrange(30, 200))}"])
    for k, (i, text) in enumerate(items[:20]):
        d = rows[k * 5]
        w = text.split()
        if k % 4 == 1:
            text = text.upper().replace(" ", "!! ")
        elif k % 4 == 2:  # paraphrase: a few words replaced, some inserted
            for _ in range(2):
                w[rng.randrange(len(w) - 8)] = "other"
            w.insert(5, "really")
            text = " ".join(w)
        elif k % 4 == 3:
            text = text.replace(" ", "\n ")
        d[1] = f"{fresh(40)} {text} {fresh(25)}"
        want.add((d[0], i))
    docs = spark.createDataFrame([(d, t, "en", "s", 0, True) for d, t in rows] + [(None, None, None, None, None, None), (500, "", "", "", 0, True)], SCHEMA)
    return docs, spark.createDataFrame(items, ITEMS), want


def test_planted_items_are_found_and_clean_documents_left(planted):
    docs, items, want = planted
    got = dc.contaminated_passages(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.lcs >= dc.LCS_MIN and r.cosine >= dc.COSINE for r in got)


def test_blocks_and_groups_do_not_matter(planted, monkeypatch):
    docs, items, want = planted
    monkeypatch.setattr(dc, "SCAN_ITEMS", 16)
    monkeypatch.setattr(dc, "GROUP", 7)
    assert {(r.doc_id, r.item_id) for r in dc.contaminated_passages(docs.repartition(4), items).collect()} == want


def test_repeats_nulls_and_empty_tables(spark, planted):
    docs, items, want = planted
    twice = dc.contaminated_passages(docs.union(docs), items).groupBy("doc_id", "item_id").count().collect()
    assert {(r.doc_id, r.item_id): r["count"] for r in twice} == dict.fromkeys(want, 2)
    none = spark.createDataFrame([], ITEMS)
    assert dc.contaminated_passages(docs, none).count() == 0
    assert dc.contaminated_passages(docs.where("false"), items).count() == 0
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "..."), (3, "word")], ITEMS)
    assert dc.contaminated_passages(docs, odd).count() == 0


def test_prose_against_unrelated_benchmark(spark):
    rng = random.Random(3)
    items = spark.createDataFrame([(i, sentence(rng, 30)) for i in range(10)], ITEMS)
    assert dc.contaminated_passages(spark.createDataFrame(documents(5, 100), SCHEMA), items).count() == 0


def test_frequencies_cover_all_documents(spark):
    rows = documents(6, 80)
    n, f = dc.document_frequencies(spark.createDataFrame(rows, SCHEMA).repartition(3))
    import pyarrow as pa

    want = np.zeros(dc.SLOTS, np.int64)
    for r in rows:
        (_, w), = dc.words_of(pa.array([r[1]], pa.string()))
        want[np.unique(dc.slot(w.hash))] += 1
    assert n == len(rows) and (f == want).all()


def test_weighted_lcs():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        w = [rng.random() for _ in a]

        def best(i, j):
            if i == len(a) or j == len(b):
                return 0.0
            return max(best(i + 1, j), best(i, j + 1), w[i] + best(i + 1, j + 1) if a[i] == b[j] else 0.0)

        assert abs(dc.weighted_lcs(np.array(a), np.array(b), np.array(w)) - best(0, 0)) < 1e-9


def around(spark, rng, copies):
    """Found (document, item) pairs: each text of ``copies`` (item, its form in a document) in fresh words."""
    fresh = lambda n: " ".join(f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(4000)}" for _ in range(n))
    docs = [(i, f"{fresh(rng.randrange(20, 90))} {text} {fresh(rng.randrange(20, 90))}", "en", "s", 0, True) for i, (_, text) in enumerate(copies)]
    docs += [(1000 + i, fresh(150), "en", "s", 0, True) for i in range(40)]
    items = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(copies)], ITEMS)
    return {(r.doc_id, r.item_id) for r in dc.contaminated_passages(spark.createDataFrame(docs, SCHEMA), items).collect()}


@pytest.mark.parametrize("sizes", [range(3, 13), (300, 400, 900)])
def test_verbatim_items_of_any_length(spark, sizes):
    rng = random.Random(len(sizes))
    copies = [(t, t) for n in sizes for t in [" ".join(f"item{rng.randrange(10**7)}" for _ in range(n))] * (3 if n < 13 else 1)]
    texts = {t: [i for i, c in enumerate(copies) if c[0] == t] for t, _ in copies}
    assert around(spark, rng, copies) == {(d, i) for same in texts.values() for d in same for i in same}


@pytest.mark.parametrize("share", [0.6, 0.5])
def test_paraphrases_that_keep_half_of_the_words(spark, share):
    rng = random.Random(int(share * 100))
    copies = []
    for _ in range(40):
        w = [f"item{rng.randrange(10**7)}" for _ in range(rng.randrange(24, 44, 4))]
        head = w[:len(w) * 3 // 4]
        out = set(rng.sample(range(len(head)), round(len(head) * (1 - share))))
        new = [f"para{rng.randrange(10**7)} and{rng.randrange(10**7)}" if i in out else x for i, x in enumerate(head)]
        copies.append((" ".join(head) + ". " + " ".join(w[len(head):]) + ".", " ".join(new + w[len(head):])))
    assert around(spark, rng, copies) == {(i, i) for i in range(len(copies))}


def test_paraphrases_under_half_of_the_words_rest_on_the_latent_score(spark, monkeypatch):
    rng = random.Random(77)
    copies, loose = [], []
    for _ in range(30):
        w = [f"item{rng.randrange(10**7)}" for _ in range(28)]
        head, tail = w[:21], w[21:]
        out = set(rng.sample(range(21), 15))
        new = [f"para{rng.randrange(10**7)}" if i in out else x for i, x in enumerate(head)]
        copies.append((" ".join(head) + ". " + " ".join(tail) + ".", " ".join(new + tail)))  # 13 of 28 words
        loose.append((" ".join(head) + ". " + " ".join(tail) + ".", " ".join(head[:13] + [f"x{rng.randrange(10**7)}" for _ in range(15)])))  # no answer
    found = around(spark, random.Random(78), copies)
    assert found <= {(i, i) for i in range(30)} and len(found) >= 18  # the cosine of the rest is lower still
    assert around(spark, random.Random(79), loose) == set()
    monkeypatch.setattr(dc, "COSINE", 2.0)  # without latent candidates nothing is left of them
    assert around(spark, random.Random(78), copies) == set()


def test_soft_lcs():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 8)), rng.integers(0, 5, rng.integers(1, 8))
        w, near = rng.random(len(a)), rng.random((len(a), len(b)))

        def best(i, j):
            if i == len(a) or j == len(b):
                return 0.0
            gain = 1.0 if a[i] == b[j] else near[i, j] if near[i, j] >= dc.NEAR else 0.0
            return max(best(i + 1, j), best(i, j + 1), gain * w[i] + best(i + 1, j + 1) if gain else 0.0)

        assert abs(dc.soft_lcs(a, b, w, near) - best(0, 0)) < 1e-9
        assert dc.soft_lcs(a, b, w, np.zeros_like(near)) == pytest.approx(dc.weighted_lcs(a, b, w))


def test_cover_of_items_by_looked_up_words():
    """Words are looked up once; blocks whose surroundings hold half of an item are those of a plain count."""
    rng = random.Random(4)
    names = [f"w{i}" for i in range(60)]
    rows = [type("Row", (), {"item_id": k, "text": " ".join(rng.sample(names, 12))}) for k in range(9)]
    items, weights = dc.items_of(rows), np.ones(dc.SLOTS, np.float32)
    text = " ".join(rng.choice(names + [f"other{i}" for i in range(90)]) for _ in range(600))
    (_, w), = dc.words_of(dc.pa.array([text]))
    lists = dc.coverage(items, weights)
    at = np.minimum(np.searchsorted(lists[0], w.hash), len(lists[0]) - 1)
    place = np.flatnonzero(lists[0][at] == w.hash)
    block = np.arange(600) // dc.BLOCK
    low, high = np.zeros(block[-1] + 1, int), np.full(block[-1] + 1, block[-1])
    b, of = dc.covered(place, at[place], np.ones(600), block, low, high, lists)
    want = set()
    for k, item in enumerate(items):
        for x in range(block[-1] + 1):
            far = dc.reach(len(item.words))
            part = w.hash[max(x - far, 0) * dc.BLOCK:(x + 2 + far) * dc.BLOCK]
            own = np.isin(w.hash[x * dc.BLOCK:(x + 2) * dc.BLOCK], item.words).any()
            if own and np.isin(part, item.words).sum() >= dc.LCS_MIN * len(item.words):
                want.add((x, k))
    assert set(zip(b.tolist(), of.tolist())) == want and 5 < len(want) < 9 * len(low)
