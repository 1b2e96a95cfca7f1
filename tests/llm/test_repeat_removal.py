"""Repeated 50-byte strings against a table of all strings."""

from __future__ import annotations

import hashlib
import random

import pytest

from tests.llm.brute import without_repeats
from tests.llm.fixtures import SCHEMA, documents, sentence
from trailmark.llm import queries, repeat_removal
from trailmark.llm import textbytes as tb


def check(spark, rows):
    got = {r.doc_id: r for r in queries.repeats_removed(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = without_repeats([(r[0], r[1]) for r in rows])
    assert set(got) == set(want)
    for d, (n, removed, spans, kept) in want.items():
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest()), d


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    check(spark, documents(seed, 150))


def test_tight_cases(spark):
    rng = random.Random(5)
    base = sentence(rng, 40)
    rows = [(0, base)]
    for i, n in enumerate((48, 49, 50, 51, 52, 99, 100, 101)):
        at = rng.randrange(len(base) - n)
        rows.append((10 + i, f"{i}#{base[at:at + n]}#{i}"))
        rows.append((30 + i, base[at:at + n]))
    rows += [(60, "ab" * 100), (61, "b" + "ab" * 40 + "x"), (62, "a" * 300), (63, "a" * 49), (64, "a" * 50), (65, "é" * 60),
             (66, "x" + "é" * 60), (67, "é" * 25 + "ü" * 30), (70, base + base), (71, base[:200] + "!" + base[200:]), (72, None), (73, "")]
    # strings that only a later text shares with a middle one, in other surroundings each time
    parts = [sentence(rng, 12) for _ in range(6)]
    rows += [(100 + i, " ".join(rng.sample(parts, 4))) for i in range(30)]
    rng.shuffle(rows)
    check(spark, [(d, t, "en", "s", None, True) for d, t in rows])


def test_odd_rows(spark):
    t = "this text is long enough to be found again in another row of the table, surely"
    rows = [(5, t), (5, t), (5, t + "!"), (None, None), (7, t), (-3, "x" + t)]
    df = spark.createDataFrame([(*r, "en", "s", None, True) for r in rows], SCHEMA).withColumn("kept_text", repeat_removal.F.lit(1))
    got = sorted(((r.doc_id or 0, len(r.text or ""), r.kept_text) for r in repeat_removal.remove_repeats(df).collect()))
    assert got == sorted([(5, 78, ""), (5, 78, ""), (5, 79, "!"), (0, 0, ""), (7, 78, ""), (-3, 79, "x" + t)])
    with_null = spark.createDataFrame([(None, t, "", "", 0, True), (4, t, "", "", 0, True)], SCHEMA)
    assert {r.doc_id: r.kept_text for r in repeat_removal.remove_repeats(with_null).collect()} == {None: t, 4: ""}
    assert repeat_removal.remove_repeats(df.where("false")).count() == 0


def test_characters_stay_whole(spark):
    a = "ä" * 40
    rows = [(1, a, "", "", 0, True), (2, "x" + a[:30] + "ö" + "y", "", "", 0, True)]
    out = {r.doc_id: r for r in repeat_removal.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[2].kept_text == "xöy" and out[2].kept_bytes.endswith("öy".encode()[1:])


def test_every_string_has_one_anchor_by_content():
    import pyarrow as pa

    rng = random.Random(2)
    texts = [sentence(rng, 60), "a" * 200, "ab" * 77, "", "short", sentence(rng, 200)]
    seen = {}
    for chunk in tb.chunks(pa.array(texts)):
        a = repeat_removal.Anchors(chunk)
        start, row, _ = a.strings(list(range(len(a.at))) and repeat_removal.np.arange(len(a.at)))
        assert sorted(start.tolist()) == [o + i for o, n in zip(chunk.offsets, chunk.lengths) for i in range(max(0, n - 49))]
        for k in range(len(a.at)):
            for p in range(a.first[k], a.last[k] + 1):
                s = chunk.data[p:p + 50].tobytes()
                assert 0 <= a.at[k] - p <= 30 and seen.setdefault(s, a.at[k] - p) == a.at[k] - p


def test_a_phrase_of_all_documents(spark):
    """One phrase longer than an anchor in every document, in other surroundings each time."""
    rng = random.Random(11)
    phrase = "zz the usual closing formula zz"
    rows = [(i, f"{sentence(rng, 9)} {phrase} {sentence(rng, 9)}") for i in range(400)]
    rows += [(400 + i, f"{sentence(rng, 3)} {rows[i * 7][1][20:110]} {sentence(rng, 3)}") for i in range(20)]
    check(spark, [(d, t, "en", "s", None, True) for d, t in rows])


def test_many_rows_under_one_id(spark):
    rng = random.Random(12)
    base = [sentence(rng, 30) for _ in range(40)]
    rows = [(0, base[0])] + [(9, t) for t in base] + [(None, t) for t in base[20:]] + [(4, base[5] + " end")]
    got = [(r.doc_id, r.text, r.kept_text) for r in repeat_removal.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    kept = {(d, t): k for d, t, k in got}
    assert len(got) == len(rows) and kept[9, base[0]] == "" and kept[9, base[25]] == "" and kept[9, base[5]] == ""
    assert kept[9, base[7]] == base[7] and all(kept[None, t] == t for t in base[20:]) and kept[4, base[5] + " end"] == base[5] + " end"


def test_texts_travel_once(spark):
    """The task that cuts gets each text in the carried row only; it had a copy of its own beside it."""
    rows = [(1, "x" * 60, "a"), (2, "y" + "x" * 60, "b")]
    out = repeat_removal.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, other string"))
    plan = out._jdf.queryExecution().analyzed().toString()
    given = next(line for line in plan[plan.index("MapInArrow"):].split("\n")[1:] if "Project" in line)
    assert "carried" in given and "text#" not in given
    assert {(r.doc_id, r.other, r.kept_text) for r in out.collect()} == {(1, "a", "x" * 60), (2, "b", "y")}
