"""The pipeline's stages on a small awkward table, against plain Python versions of what each keeps."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as cp
from tests.llm.brute import near_duplicate_components, without_repeats
from tests.llm.fixtures import SCHEMA, documents, sentence


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("sf")
    rng = random.Random(21)
    items = [(i, " ".join(f"q{rng.randrange(10**5)}" for _ in range(25))) for i in range(5)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    rows = documents(31, 150)
    rows += [(5000 + i, f"{sentence(rng, 40)} {t} {sentence(rng, 30)}", "en", "src0", 0, True) for i, t in items]
    rows += [(6000 + i, " ".join(w + "###" for w in sentence(rng, 60).split()), "en", "src0", 0, True) for i in range(5)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{base}/documents.parquet")
    return str(base)


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, sf_dir):
    docs = cp.table(spark, sf_dir, "documents")
    columns = docs.columns
    good = cp.quality_rules(spark, docs, sf_dir)
    assert good.columns == columns
    ids = {d for d, _ in texts(good)}
    assert not ids & set(range(6000, 6005)) and ids >= set(range(5000, 5005))
    assert all(len((t or "").split()) >= 20 for _, t in texts(good))

    good = spark.createDataFrame(good.collect(), good.schema)
    one = cp.near_duplicates(spark, good, sf_dir)
    want = near_duplicate_components(texts(good))
    assert one.columns == columns
    assert sorted(d for d, _ in texts(one)) == sorted(d for d, (_, c) in want.items() if d == c)

    one = spark.createDataFrame(one.collect(), one.schema)
    cut = cp.repeated_strings(spark, one, sf_dir)
    assert cut.columns == columns
    left = without_repeats(texts(one))
    got = {r.doc_id: r for r in cut.collect()}
    for d, (_, removed, _, kept) in left.items():
        if removed == 0:
            assert got[d].text == dict(texts(one))[d]
        elif kept.strip():
            assert got[d].text.encode() == kept and got[d].n_chars == len(got[d].text)
        else:
            assert d not in got

    cut = spark.createDataFrame(cut.collect(), cut.schema)
    clean = cp.decontaminated(spark, cut, sf_dir)
    assert clean.columns == columns
    assert {d for d, _ in texts(clean)} == set(got) - set(range(5000, 5005))

    out = cp.tokens(spark, clean, sf_dir).collect()
    assert {r.doc_id for r in out} == {d for d, _ in texts(clean)}
    assert sorted(tuple(r) for r in cp.run(spark, sf_dir).collect()) == sorted(tuple(r) for r in out)


def test_stages_stand_odd_tables(spark, sf_dir):
    odd = spark.createDataFrame(
        [(None, None, None, None, None, None), (None, "x " * 30, None, None, None, None), (4, "", "en", "s", 0, True)], SCHEMA)
    odd = odd.withColumn("n_words", cp.F.lit("extra")).withColumn("kept_text", cp.F.lit(1))
    for table in (odd, odd.where("false")):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, table, sf_dir)
            assert out.columns == table.columns and out.count() <= table.count()
        assert cp.STAGES[-1][1](spark, table, sf_dir).count() == table.count()


def test_contaminated_rows_go_whatever_their_id(spark, sf_dir):
    item = cp.table(spark, sf_dir, "benchmark").first().text
    rows = [(None, f"so {item} it is", "a"), (2, f"and {item} again", "b"), (2, "a clean text under the same id", "c"), (None, "clean", "d"), (7, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string").withColumn("key", cp.F.lit(1)).withColumn("hit", cp.F.lit(2)).withColumn("row", cp.F.lit(3))
    out = cp.decontaminated(spark, docs, sf_dir)
    assert out.columns == docs.columns and sorted(r["__id"] for r in out.collect()) == ["c", "d", "e"]


HELPERS = ["__t", "__w", "__h", "__l", "__upper", "__lines", "__doc", "__0", "__1", "__2", "__id", "row", "key", "hit", "marks", "doc", "bucket", "x", "cls", "band", "label", "node"]


def test_helper_names_do_not_clash(spark, sf_dir):
    docs = cp.table(spark, sf_dir, "documents").limit(30).withColumns({c: cp.F.lit("x") for c in HELPERS})
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.where("label = 'x'").count() == out.count() <= 30


def test_tables_of_a_stage_go_when_the_next_one_starts(spark, sf_dir):
    import os

    from trailmark.llm.staging import stored

    cp.release()
    docs = cp.quality_rules(spark, cp.table(spark, sf_dir, "documents"), sf_dir)
    mine = [p.replace("file:", "") for p in cp._held["quality_rules"][0].tables]
    assert mine and all(map(os.path.exists, mine))
    lazy = cp.near_duplicates(spark, docs, sf_dir)  # still reads them
    assert all(map(os.path.exists, mine))
    written = stored(docs, "written")
    cp.near_duplicates(spark, written, sf_dir)
    assert lazy is not None and not any(map(os.path.exists, mine)) and written.count() > 0
    cp.release()


def test_names():
    assert len(cp.STAGES) == 5 and len({n for n, _ in cp.STAGES}) == 5
