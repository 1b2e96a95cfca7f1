"""Small awkward tables shared by the operator tests."""

from __future__ import annotations

import random

WORDS = "the of and river stone light garden winter copper letter engine marble silver forest".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed", "ing", str(rng.randrange(50))]) for _ in range(n))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, kept): nulls, empty, ties, copies, near copies, shared passages."""
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", "   \n\t ", "one", "two words", "\x00odd\x0bspace\x1c here", "Ünïcode Straße ΣΑΣ — “q”", "a" * 300]
    passage = sentence(rng, 70)
    while len(texts) < n:
        t = sentence(rng, rng.randrange(5, 160))
        k = rng.randrange(6)
        if k == 0 and len(texts) > 12:
            t = rng.choice(texts[8:])
        elif k == 1 and len(texts) > 12:
            w = rng.choice(texts[8:]).split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif k == 2:
            t = t + "\n" + passage + "\n" + sentence(rng, 12)
        elif k == 3:
            line = sentence(rng, 6)
            t = "\n".join([line] * rng.randrange(2, 6)) + "\n" + t
        texts.append(t)
    texts.append(texts[-1])
    out = [(i * 3 + 1, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", None]),
            None if t is None else len(t), i % 2 == 0) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"
