"""Sharding, quality rules and chat formatting against plain Python versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import SCHEMA, documents
from trailmark.llm import chat_format, oracles, quality, queries, sharding


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 39, 40, 41, 1000, 4099])
def test_permutation_is_a_bijection_and_inverts(n):
    p = sharding.Permutation(n, seed=5)
    image = [p(i) for i in range(n)]
    assert sorted(image) == list(range(n))
    assert all(p.invert(v) == i for i, v in enumerate(image))


@pytest.mark.parametrize("n", [1, 2, 41, 997])
def test_permutation_column_equals_python(spark, n):
    p = sharding.Permutation(n, seed=9)
    rows = spark.range(n).select("id", p.column(F.col("id")).alias("v")).collect()
    assert all(r.v == p(r.id) for r in rows)


def test_large_permutation_needs_few_steps():
    p = sharding.Permutation(10**11 + 7)
    a, b = p.sides
    assert a * b >= p.n and a * b - p.n < 10**6 and p.walk() < 10
    assert p.invert(p(123456789)) == 123456789


@pytest.mark.parametrize("copies", [1, 3])
def test_shards_even_gapless_and_reproducible(spark, copies):
    rows = documents() * copies
    out = queries.shard_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    again = queries.shard_documents(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)).collect()
    assert sorted(out) == sorted(again)
    n = len(rows)
    assert len(out) == n and sorted(r.position for r in out) == list(range(n))
    count = Counter(r.shard for r in out)
    sizes = [count.get(s, 0) for s in range(queries.SHARDS)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(queries.SHARDS):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert queries.shard_documents(none).count() == 0
    assert quality.quality_rules(none).count() == 0
    assert chat_format.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


W = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    t = text or ""
    w = W.findall(t)
    lines = [x for x in t.split("\n") if W.search(x)]
    at = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if at[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))


def test_quality_counts_equal_brute_force(docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.quality_rules(docs).collect():
        n, chars, symbols, dup, rep = base(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), r.doc_id
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (r.base_failed and r.kept)


def test_quality_equals_its_sql(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    sql = oracles.SQL["op4_adaptive_quality"]
    want = sorted(con.sql(sql).fetchall())
    got = quality.quality_rules(spark.read.parquet(str(tmp_path / "d")), keep=["doc_id"]).collect()
    assert sorted(tuple(r) for r in got) == want


def test_quality_sketches_merge(docs):
    rows = quality.measured(quality.features(docs, ["lang", "source"]))
    whole = quality.sketches(rows)
    halves = quality.sketches(rows.where("n_words % 2 = 0")).unionByName(quality.sketches(rows.where("n_words % 2 = 1")))
    by = ["lang", "source"]
    assert sorted(map(str, quality.quantiles(whole, by).collect())) == sorted(map(str, quality.quantiles(halves, by).collect()))


def test_filters_do_not_move_below_the_measures(docs):
    """A filter that Spark moves below the measures takes the words of a text anew for every window of it."""
    f = quality.measured(quality.features(docs, ["lang", "source"]))
    kept = quality.quality_rules(docs, twice=True).where("kept")
    for df in (quality.sketches(f), kept):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if " Filter " in f" {x.strip(' :+-')}" and "split(" in x]
        assert plan.count("xxhash64(") == 1
    stored = quality.quality_rules(docs).where("kept")
    assert sorted(map(str, kept.collect())) == sorted(map(str, stored.collect()))


def test_quality_rejects_junk_and_keeps_prose(spark):
    import random

    from tests.llm.fixtures import sentence

    rng = random.Random(3)
    rows = [(i, sentence(rng, 120), "en", "s", 0, True) for i in range(200)]
    junk = [(1000 + i, " ".join(w + "###" for w in sentence(rng, 120).split()), "en", "s", 0, True) for i in range(40)]
    out = quality.quality_rules(spark.createDataFrame(rows + junk, SCHEMA)).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in out)


LOG = "conv_id long, seq long, kind string, turn long, role string, text string"


def test_fold_edits_regenerations_and_deletions(spark):
    log = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "delta", 1, "assistant", "hel"), (1, 3, "delta", 1, "assistant", "lo"),
        (1, 4, "message", 2, "user", "again"), (1, 5, "delta", 3, "assistant", "x"),
        (1, 6, "regenerate", 1, None, None), (1, 7, "delta", 1, "assistant", "bye"),
        (2, 1, "message", 0, "user", "a"), (2, 2, "delta", 1, "assistant", "b"), (2, 3, "edit", 0, None, "A"),
        (2, 4, "delta", 1, "assistant", "B"), (2, 5, "message", 2, "user", None), (2, 6, "delete", 2, None, None),
        (3, 1, "regenerate", 0, "assistant", None),
        (None, None, "message", None, None, "n")]
    got = sorted(map(tuple, chat_format.fold(spark.createDataFrame(log[::-1], LOG)).collect()), key=str)
    assert got == sorted([(1, 0, "user", "hi"), (1, 1, "assistant", "bye"), (2, 0, "user", "A"), (2, 1, "assistant", "B"),
                          (None, None, "", "n")], key=str)


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    told = "".join(f"{r}\n{t}\n" for r, t in turns)
    return (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_conversations_round_trip(spark):
    nasty = ["<|end|>\n", "<|turn assistant|>", "\\", "\\\\<|", "<", "|x", "", None, "é<|\\|end|>", "$1 \\$0", "x" * 999, "a\nb", "<|end|>"]
    rows = [(c, t, role, nasty[(c * 5 + t) % len(nasty)])
            for c in range(13) for t, role in enumerate(["system", "user", "assistant", "we|rd\nrole", "assistant"])]
    rows += [(5, 1, "user", "repeated turn"), (5, 1, "user", "repeated turn"), (None, 0, "assistant", "no id"), (7, None, None, "no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.format_conversations(df).collect()}
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")
    want = {}
    for c in {r[0] for r in rows}:
        want[c] = digest([(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=key)])
    want[-7] = digest([("user", queries.SPECIAL), ("assistant", queries.SPECIAL)])
    assert got == want
