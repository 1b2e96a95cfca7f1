"""Token files and the distinct-word encoder against the tokenizers library itself."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from tests.llm.fixtures import SCHEMA, documents  # noqa: E402
from trailmark.llm import elias_fano, queries, token_files, word_bpe  # noqa: E402

ODD = ["  two  spaces ", "tab\tand\nline\n\n  x", " lead", "trail ", "it's we'll I'M 'tis", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>",
       "ΣΑΣ Σ İstanbul", "é é ﬁ Ⅷ ½ 12 345", "日本語 テキスト", "emoji 👩‍👩‍👧 x", "\x1c\x1d a\x1eb \x85 \xa0  z", "a" * 5000, "x\x00y", "!!!???...", "\n", "​​ w"]


def rows():
    out = documents(seed=4)
    return out + [(1000 + i, t, "en", "s", len(t), True) for i, t in enumerate(ODD)] + [(None, "no id", "en", "s", 5, True), (None, None, None, None, None, None)]


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 10**9), (700, 700), (3000, 10**7), (2000, 9)])
def test_elias_fano_round_trip(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top, n))
    data = elias_fano.encode(v)
    e = elias_fano.EliasFano(data)
    assert len(e) == n and (e.all() == v).all() and all(e.select(i) == v[i] for i in range(n))
    if n > 500:
        assert 8 * len(data) < n * (3.5 + max(0, np.log2(top / n))) + 400


def hf(name):
    return tokenizers.Tokenizer.from_file(queries.tokenizer_file(name))


def test_word_bpe_equals_the_library(spark, monkeypatch):
    monkeypatch.setattr(word_bpe, "CHUNK_CHARS", 3000)
    t = hf("word_bpe_49k.json")
    want = []
    for d, text, *_ in rows():
        ids = t.encode(text or "", add_special_tokens=False).ids
        said = t.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    path = queries.tokenizer_file("word_bpe_49k.json")
    got = [tuple(r) for r in word_bpe.assembled(df, path, digests=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    full = word_bpe.encode_decode(df, path).collect()
    assert sorted((r.n_tokens, hashlib.sha256(r.ids).hexdigest()) for r in full) == sorted(w[1:3] for w in want)
    assert word_bpe.assembled(df.where("false"), path, digests=True).count() == 0


@pytest.mark.parametrize("block_ids", [50, 1 << 20])
def test_token_files_equal_the_library(spark, tmp_path, block_ids):
    t = hf("byte_bpe_50k.json")
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    path = str(tmp_path / "files")
    token_files.write_token_files(df, path, queries.tokenizer_file("byte_bpe_50k.json"), block_ids=block_ids)
    got = token_files.documents_of(token_files.read_token_files(spark, path)).orderBy("start").collect()
    crc = lambda text: (lambda ids: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))(t.encode(text or "", add_special_tokens=False).ids + [0])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(((d, *crc(x)) for d, x, *_ in rows()), key=str)
    ids = [r.doc_id for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()


def test_no_documents_no_files(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    token_files.write_token_files(df, str(tmp_path / "f"), queries.tokenizer_file("byte_bpe_50k.json"))
    assert token_files.documents_of(token_files.read_token_files(spark, str(tmp_path / "f"))).count() == 0


@pytest.mark.parametrize("block_ids,cell", [(50, 3), (1 << 20, 1 << 16)])
def test_documents_by_number_through_select(spark, tmp_path, monkeypatch, block_ids, cell):
    monkeypatch.setattr(token_files, "CELL", cell)
    monkeypatch.setattr(elias_fano.EliasFano, "all", None)  # no block is decoded
    t = hf("byte_bpe_50k.json")
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    path = str(tmp_path / "files")
    token_files.write_token_files(df, path, queries.tokenizer_file("byte_bpe_50k.json"), block_ids=block_ids)
    blocks = token_files.read_token_files(spark, path)
    n = len(rows())
    asked = spark.createDataFrame([(i,) for i in [*range(n), 5, 5, -1, n, None]], "number long")
    got = sorted((r.number, r.doc_id, tuple(r.ids)) for r in token_files.documents_at(blocks, asked).collect() if r.doc_id is not None)
    want = sorted(((d, tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for d, x, *_ in rows() if d is not None))
    assert sorted(g[1:] for g in got if g[0] != 5) == sorted(w for w in want if w[0] != dict((g[0], g[1]) for g in got)[5])
    assert [g[0] for g in got].count(5) == 3 and sorted({g[0] for g in got}) == list(range(2, n))


def test_no_catalog_entry_stays(spark):
    before = {t.name for t in spark.catalog.listTables()}
    path = queries.tokenizer_file("word_bpe_49k.json")
    assert word_bpe.assembled(spark.createDataFrame(rows(), SCHEMA), path, digests=True).count() == len(rows())
    assert {t.name for t in spark.catalog.listTables()} == before
