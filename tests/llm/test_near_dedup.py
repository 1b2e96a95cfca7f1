"""Near duplicates against all pairs that share a shingle."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.brute import near_duplicate_components, shingle_set
from tests.llm.fixtures import SCHEMA, documents, sentence
from trailmark.llm import near_dedup
from trailmark.llm.staging import components


def check(spark, rows):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = near_duplicate_components([(r[0], r[1]) for r in rows])
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (d == r.component_id) for d, r in got.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    check(spark, documents(seed, 120))


def test_chains_of_gradual_edits(spark):
    rng = random.Random(7)
    rows, w = [], sentence(rng, 80).split()
    for i in range(60):  # each close to the one before, far from the first
        w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w), "en", "s", 0, True))
    rows += [(100 + i, sentence(rng, 50), "en", "s", 0, True) for i in range(40)]
    rng.shuffle(rows)
    check(spark, rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = sentence(rng, 100).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(100)] = f"x{rng.randrange(1000)}"
        rows.append((i * 7, " ".join(w), None, None, None, None))
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, "a b c", None, None, None, None), (2, "A  b\nC", None, None, None, None), (3, None, None, None, None, None),
            (4, "", None, None, None, None), (5, "c b a", None, None, None, None)]
    check(spark, rows)
    twice = near_dedup.near_duplicates(spark.createDataFrame(rows + rows + [(None, "a b c", None, None, None, None), (None, "z", None, None, None, None)], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in twice) == sorted(
        2 * [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True)] + [(-1, 1, False), (-1, -1, True)])
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    named = spark.createDataFrame(rows, SCHEMA).withColumn("n_shingles", near_dedup.F.lit("x"))
    out = near_dedup.near_duplicates(named, keep=named.columns)
    assert out.columns == [c for c in named.columns if c not in ("n_shingles", "kept")] + ["n_shingles", "component_id", "kept", "group_key"]
    keys = {r.doc_id: r.group_key for r in out.collect()}
    assert keys[1] == keys[2] != keys[5] and keys[3] is None and keys[4] is None


def test_rows_that_share_an_id_are_one_document(spark):
    rng = random.Random(3)
    a, b = sentence(rng, 60), sentence(rng, 60)
    rows = [(5, a), (5, b), (7, a), (9, b), (11, sentence(rng, 60))]
    got = near_dedup.near_duplicates(spark.createDataFrame([(d, t, "", "", 0, True) for d, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (5, 5), (7, 5), (9, 5), (11, 11)]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 1 << 63, 400, dtype=np.uint64), rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    rx, ry = (near_dedup.registers_of(s, np.array([0]))[0] for s in (x, y))
    both = near_dedup.registers_of(np.concatenate([x, y]), np.array([0]))[0]
    assert (np.maximum(rx, ry) == both).all()
    errors = []
    for share in (0.5, 0.75, 0.9):
        for t in range(20):
            pool = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            n = int(1000 * share)
            a, b = pool[:(1000 + n) // 2], pool[(1000 - n) // 2:]
            j = len(np.intersect1d(a, b)) / 1000
            ra, rb = (near_dedup.registers_of(s, np.array([0])) for s in (a, b))
            errors.append(near_dedup.estimate(ra, rb, np.array([float(len(a))]), np.array([float(len(b))]))[0] - j)
    assert np.sqrt(np.mean(np.square(errors))) < 0.05 and max(map(abs, errors)) < near_dedup.SLACK


def test_components(spark):
    rng = random.Random(1)
    for edges in ([], [(1, 2)], [(i, i + 1) for i in range(0, 40)], [(0, i) for i in range(1, 50)] + [(100, 101)],
                  [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]):
        parent = {}

        def find(v):
            parent.setdefault(v, v)
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in edges:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
        df = spark.createDataFrame(edges, "a long, b long")
        assert {r.node: r.root for r in components(df).collect()} == {v: find(v) for v in list(parent)}


def test_brute_force_sets():
    assert shingle_set("A b\x0bc d e f") == {("a", "b", "c", "d", "e"), ("b", "c", "d", "e", "f")}


def test_links_among_documents_of_one_template(spark, monkeypatch):
    """Pairs just above the threshold whose buckets are full of documents just under it."""
    monkeypatch.setattr(near_dedup, "DRIVERS", 8)
    rng = random.Random(21)
    base = [f"t{i}" for i in range(200)]

    def slots(n, tag):  # the last words are the document's own
        return [f"{tag}{i}" for i in range(n)]

    rows = [(i, " ".join(base[:168] + slots(32, f"d{i}x"))) for i in range(300)]  # 0.72 of each other
    for k in range(30):
        a = slots(32, f"p{k}x")
        b = a[:4] + slots(28, f"q{k}x")  # 0.75 of each other
        rows += [(1000 + 2 * k, " ".join(base[:168] + a)), (1001 + 2 * k, " ".join(base[:168] + b))]
    rng.shuffle(rows)
    check(spark, [(d, t, None, None, None, None) for d, t in rows])


def test_rest_pairs_are_all_that_can_reach_the_threshold(spark):
    """Random sets over few shingles, every label its own: the pairs found hold all links and little else."""
    rng = random.Random(5)
    rows = []
    for g in range(12):
        w = sentence(rng, 60).split()
        for _ in range(9):
            v = list(w)
            for _ in range(rng.randrange(7)):
                v[rng.randrange(len(v))] = f"e{rng.randrange(9)}"
            rows.append((len(rows), " ".join(v[:rng.choice([60, 60, 55, 45])])))
    texts = spark.createDataFrame(rows, "node long, text string")
    pairs = {(r.a, r.b) for r in near_dedup.rest_pairs(texts.selectExpr("node", "node as label"), texts).collect()}
    sets = [shingle_set(t) for _, t in rows]
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
             if sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert links <= pairs and len(links) > 20
    one = near_dedup.rest_pairs(texts.selectExpr("node", "cast(0 as long) as label"), texts)
    assert one.count() == 0


def test_near_copies_of_one_text_are_not_all_paired(spark, monkeypatch):
    """Near copies of one text that are joined by way of it: pairs grow with the rows, not their square."""
    rng = random.Random(31)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for d in range(500):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(7) if d else 0):
            w[at] = f"own{d}x{at}"
        rows.append((d, " ".join(w), None, None, None, None))
    counts, judge = [], near_dedup._likely_pairs

    def counted(pairs, sketch):
        counts.append(pairs.count())
        return judge(pairs, sketch)

    monkeypatch.setattr(near_dedup, "_likely_pairs", counted)
    check(spark, rows)
    assert sum(counts) <= 8 * len(rows)


def test_core_pairs_offer_the_least_changed(spark):
    rows = [(s, node, node % 3, 50, node % 7, 5) for s in (1, 2) for node in range(40)]
    entry = spark.createDataFrame(rows, "shingle long, node long, label long, n long, alone long, place long")
    met = {(r.a, r.b) for r in near_dedup.core_pairs(entry).collect()}
    assert met == {(0, b) for b in range(40) if b % 3} | {(7, b) for b in range(40) if not b % 3}
    assert near_dedup.core_pairs(entry.where("label = 1")).isEmpty()


def test_members_meet_one_partner_a_turn(spark):
    rows = [(b, n, 50, n % 3) for b in range(4) for n in range(40)]
    members = spark.createDataFrame(rows, "band long, node long, n long, label long")
    for turn in range(2):
        met = near_dedup.partners(members, turn).collect()
        assert len({r.b for r in met}) == len(met) <= 40 and all(r.a % 3 != r.b % 3 for r in met)


def test_stored_tables_go_when_released(spark, tmp_path):
    import os

    from trailmark.llm.staging import discard, owned, stored

    outer = stored(spark.range(3), "outer")
    with owned(spark) as mine:
        kept = stored(spark.range(5), "kept")
        gone = stored(spark.range(7), "gone")
        discard(gone)
    assert not os.path.exists(gone.stored_at.replace("file:", "")) and kept.count() == 5
    assert not mine.release(unless_read_by=kept.where("id > 1")) and kept.count() == 5
    assert mine.release(unless_read_by=outer) and not os.path.exists(kept.stored_at.replace("file:", "")) and outer.count() == 3


def test_components_write_few_files(spark):
    """A small graph is not written to a file for each shuffle partition; results are as with one file each."""
    from pathlib import Path

    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        out = components(spark.createDataFrame([(i, i + 1) for i in range(0, 900, 2)] + [(0, 2), (2, 4)], "a long, b long"))
        files = list(Path(out.stored_at.removeprefix("file:")).glob("part-*"))
        assert 0 < len(files) <= spark.sparkContext.defaultParallelism
        roots = {r.node: r.root for r in out.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert roots == {v: 0 if v < 6 else v - v % 2 for v in range(900)}


def test_stored_sends_small_arrow_batches(spark):
    """While a table is written, a Python worker gets some MB of documents at a time, and the session's setting comes back."""
    import pyarrow as pa

    from trailmark.llm.staging import stored

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    n = [r.n for r in stored(spark.range(0, 9000, 1, 1).mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(n) == 9000 and max(n) <= 2048
    assert spark.conf.get(key) == before


def test_tables_of_few_rows_are_written_by_few_tasks(spark, monkeypatch):
    """The tables of a small corpus do not get a file for each shuffle partition; results are as with one file each."""
    from pathlib import Path

    files: dict[str, int] = {}
    store = near_dedup.stored

    def counted(df, name, **options):
        out = store(df, name, **options)
        files[name] = max(files.get(name, 0), len(list(Path(out.stored_at.removeprefix("file:")).glob("part-*"))))
        return out

    monkeypatch.setattr(near_dedup, "stored", counted)
    keys = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        check(spark, documents(4, 120))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    few = {"classes", "members", "nodes", "pairs", "likely", "links", "labels", "shingles", "prefixes", "entries"}
    assert few <= set(files)
    assert max(files[name] for name in few) <= spark.sparkContext.defaultParallelism


def test_an_id_with_several_texts_gives_a_pair_once(spark):
    """Sketches of rows that share an id offer the pairs of that id several times; the estimate names each once."""
    r = near_dedup.registers_of(np.arange(1, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array([0]))[0].tobytes()
    sketch = spark.createDataFrame([(1, 59, r)] * 3 + [(2, 59, r)] * 2 + [(3, 59, r)], "node long, n long, registers binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long").repartition(1)
    assert sorted(tuple(x) for x in near_dedup._likely_pairs(pairs, sketch).distinct().collect()) == [(1, 2), (1, 3)]
