"""Alignment of two tokenizers against the libraries on whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from tests.llm.fixtures import SCHEMA, documents  # noqa: E402
from tests.llm.test_tokens import ODD  # noqa: E402
from trailmark.llm import queries, token_alignment as al, token_files  # noqa: E402

A, B = (queries.tokenizer_file(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
MORE = ["▁", "a▁b c", "<s> </s> <unk> <0x0A>", "x" * 70 + " " + "y" * 70, "a  b", " \n ", "tab\t tab", "ſ ß ŉ", "  x", "한국어 텍스트 입니다", "🙂🙂 ok", "Á é"]


def rows():
    out = documents(seed=6, n=50)
    out += [(1000 + i, t, "en", "s", len(t), True) for i, t in enumerate(ODD + MORE)]
    return out + [(None, "no id here", "en", "s", 5, True), (None, None, None, None, None, None), (out[9][0], "an id again", "en", "s", 1, True)]


def brute(texts):
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    chars = token_files.byte_characters()
    docs, seen = [], Counter()
    for t in texts:
        if not t:
            docs.append(None)
            continue
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        ba = [bytes(chars[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not b"".join(ba) == b"".join(bb) == (" " + t).encode():
            docs.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        both = sorted(set(ea) & set(eb))
        groups, lo = [], 0
        for cut in both:
            groups.append(([i for i, e in zip(ia, ea) if lo < e <= cut], [i for i, e in zip(ib, eb) if lo < e <= cut]))
            lo = cut
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        seen.update(links.keys())
        docs.append((len(ia), len(ib), groups, links))
    top: dict = defaultdict(int)
    for (x, _), n in seen.items():
        top[x] = max(top[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0,) * 6 + ("",))
            continue
        n_a, n_b, groups, links = d
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if seen[p] == top[p[0]]),
                    sum(n * seen[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest()))
    return out, seen, top


@pytest.mark.parametrize("fan,block,run,cache,parts", [(256, 4096, 4 << 20, 1 << 18, 3), (2, 3, 400, 60, 2)])
def test_equals_the_libraries(spark, monkeypatch, fan, block, run, cache, parts):
    for name, value in (("FAN", fan), ("BLOCK", block), ("RUN_BYTES", run), ("CACHE_UNITS", cache), ("TEXT_BYTES", min(run, 1 << 20))):
        monkeypatch.setattr(al, name, value)
    al._aligners.clear()
    want, seen, top = brute([r[1] for r in rows()])
    df = spark.createDataFrame(rows(), SCHEMA).repartition(parts)
    got = [tuple(r) for r in al.aligned(df, A, B, digests=True).collect()]
    assert Counter(got) == Counter((r[0], *w) for r, w in zip(rows(), want))
    counts = {(r["a_id"], r["b_id"]): (r["documents"], r["best"]) for r in al.pair_counts(df, A, B).collect()}
    assert counts == {p: (n, n == top[p[0]]) for p, n in seen.items()}


def test_groups_as_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, "Hello there"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["groups"] for r in al.aligned(df, A, B).collect()}
    assert got[2] == "" and got[1].count("|") == got[1].count(";") + 1
    assert al.aligned(df.limit(0), A, B).collect() == [] and al.pair_counts(df.limit(0), A, B).collect() == []


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, run int, part int, groups int")
    assert al.aligned(df, A, B).count() == 1


def test_merge_equals_sums():
    rng = np.random.default_rng(2)
    streams = []
    for _ in range(9):
        p = np.unique(rng.integers(0, 20000, rng.integers(0, 9000)))
        streams.append((p, rng.integers(1, 5, len(p))))
    want: Counter = Counter()
    for p, n in streams:
        want.update(dict(zip(p.tolist(), n.tolist())))
    got = list(al.merged(streams))
    pairs = np.concatenate([g[0] for g in got])
    assert (np.diff(pairs) > 0).all() and dict(zip(pairs.tolist(), np.concatenate([g[1] for g in got]).tolist())) == want
