"""Operator 9: main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks: runs of text between block-level tags, each with its tag path
(tags, and the words of class, id and role, from the root down). A bidirectional LSTM, in numpy,
reads the sequence of a page's blocks as vectors of hashed path parts, hashed words and a few
counts, and labels every block as main text or not with the whole page in view.

The network is trained on the driver, on ``TRAIN_PAGES`` pages of the table at most (those with the
least hashes, each under ``TRAIN_BYTES``) and on ``TRAIN_LAYOUTS`` layouts put together from their
paragraphs. Labels of the table's pages come from the pages that mark their parts themselves
(article or main against nav, aside, footer and so on); the layouts also show pages that do not.
The weights (about 100 kB) are broadcast; labelling covers every page, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import textbytes as tb

TRAIN_PAGES = 160
TRAIN_BYTES = 100_000
TRAIN_LAYOUTS = 480
EPOCHS = 10
PATH_SLOTS = 96
WORD_SLOTS = 24
EXTRA = 6
INPUT = PATH_SLOTS + WORD_SLOTS + EXTRA
HIDDEN = 20
GROUP_BLOCKS = 20_000

# Fixed values of the markup language: elements that end a line of text, elements without an end
# tag, elements whose content is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "template", "noscript", "textarea", "iframe", "svg", "title")
# An element that starts ends these if they are open (their end tags may be left out).
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",)}
NOT_IN_P = BLOCK_TAGS - {"body", "html", "head", "button", "option", "select"}

# A tag with no other one inside it: an attempt ends at the next "<" at the latest and takes nothing back.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><"']*+)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>""")
NAME = re.compile(r"""</?([a-zA-Z][^\s/><"']*+)""")
STOP = re.compile("[>\"']")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS}
FIRST_WORD = re.compile(r"\w+")
ATTRIBUTE = re.compile(r"\b(class|id|role|data-keep)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD_PART = re.compile(r"[a-z]+")


class Scanner:
    """Tags of a page in order, each byte of it read a bounded number of times whatever the page holds."""

    def __init__(self, html: str):
        self.html = html
        self.next: dict[str, int] = {}  # the place last found of what is looked for from ever later places
        self.dead: set[int] = set()  # signs from which no tag can end

    def _find(self, what: str, at: int) -> int:
        """Where ``what`` is next, from ``at`` on; -1 if nowhere. Places asked for only grow."""
        known = self.next.get(what, -2)
        if known == -1 or known >= at:
            return known
        self.next[what] = known = self.html.find(what, at)
        return known

    def _sign(self, at: int) -> int:
        """The next ">" or quote from ``at`` on."""
        return min((x for x in (self._find(c, at) for c in ">\"'") if x >= 0), default=-1)

    def _tag_end(self, at: int) -> int:
        """Where a tag that goes on at ``at``, outside quotes, has its ">"; -1 if it has none.

        What lies behind a sign does not depend on where the tag began, so signs that led nowhere are
        remembered and each is followed once.
        """
        html, seen = self.html, []
        e = self._sign(at)
        while e >= 0 and e not in self.dead:
            if html[e] == ">":
                return e
            seen.append(e)
            close = html.find(html[e], e + 1)
            m = STOP.search(html, close + 1) if close >= 0 else None
            e = m.start() if m else -1
        self.dead.update(seen)
        return -1

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """Start, end, whether it ends an element, tag and attributes; comments, declarations and elements
        whose content is no text have the tag ''."""
        html, n = self.html, len(self.html)
        at = html.find("<")
        while 0 <= at:
            end = at + 1
            m = TAG.match(html, at)
            named = m or NAME.match(html, at)
            low = named[2 if m else 1].lower() if named else ""
            raw = FIRST_WORD.match(low)[0] if low and html[at + 1] != "/" else ""
            e = self._tag_end(named.end()) if named and not m and raw not in RAW_END else -1
            if html.startswith("<!--", at):
                close = html.find("-->", at + 4)
                end = n if close < 0 else close + 3
                yield at, end, False, "", ""
            elif raw in RAW_END and self._find(">", at) >= 0:
                close = RAW_END[raw].search(html, self._find(">", at) + 1)
                end = close.end() if close else n
                yield at, end, False, "", ""
            elif m:
                end = m.end()
                yield at, end, bool(m[1]), low, m[3]
            elif e >= 0:
                end = e + 1
                yield at, end, html[at + 1] == "/", low, html[named.end():e]
            elif html[at + 1:at + 2] in ("!", "?", "/") and self._find(">", at) >= 0:
                end = self._find(">", at) + 1
                yield at, end, False, "", ""
            at = html.find("<", end)


# Words by which pages mark what is not their text, and what is.
OUTSIDE = {"nav", "aside", "footer", "form", "menu", "button", "select", "option", "title", "head", ".ad", ".ads", ".advert", ".advertisement",
           ".sponsored", ".promo", ".sidebar", ".menu", ".nav", ".navigation", ".breadcrumb", ".footer", ".cookie", ".notice", ".banner",
           ".newsletter", ".share", ".related", ".comments", ".comment", ".subscribe", ".popup", ".copyright", ".social"}
INSIDE = {"article", "main"}
MARKS = frozenset(OUTSIDE | INSIDE)


class Paths:
    """Tag paths as numbers; path n is its parent with one element more. Keeps a vector for each."""

    def __init__(self):
        self.known: dict[tuple[int, str, str], int] = {}
        self.vectors = [np.zeros(PATH_SLOTS, np.float32)]
        self.keep: list[int | None] = [None]
        self.words: list[frozenset[str]] = [frozenset()]

    def child(self, parent: int, tag: str, attrs: str) -> int:
        key = (parent, tag, attrs)
        if key not in self.known:
            parts = [tag]
            keep = self.keep[parent]
            for name, *value in ATTRIBUTE.findall(attrs):
                value = "".join(value).lower()
                if name.lower() == "data-keep":
                    keep = int(value) if value in ("0", "1") else keep
                    continue
                parts += ["." + w for w in WORD_PART.findall(value)]
            v = self.vectors[parent].copy()
            v *= np.float32(0.97)  # nearer elements count a little more
            for p in parts:
                h = hash_text(p)
                v[h % PATH_SLOTS] = 1
                v[(h >> 20) % PATH_SLOTS] = 1
            self.known[key] = len(self.vectors)
            self.vectors.append(v)
            self.keep.append(keep)
            self.words.append(self.words[parent] | (frozenset(parts) & MARKS))
        return self.known[key]


def hash_text(s: str) -> int:
    h = 0xCBF29CE484222325
    for b in s.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h ^ h >> 29


def blocks_of(html: str, paths: Paths) -> tuple[list[str], list[int], list[int]]:
    """Text, path and number of characters inside links of every block with text, in order."""
    texts: list[str] = []
    at: list[int] = []
    links: list[int] = []
    open_: list[tuple[str, int, bool]] = []  # tag, path with it, link
    places: dict[str, list[int]] = {}  # where a tag's open elements are in open_
    blocks: list[int] = []  # where open block elements are in open_
    parts: list[str] = []
    linked = 0
    path = here = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                texts.append(text)
                at.append(here)
                links.append(linked)
            parts.clear()
        linked = 0

    def pop_to(n: int) -> None:
        nonlocal path, in_link
        if any(t in BLOCK_TAGS for t, _, _ in open_[n:]):
            flush()
        in_link -= sum(link for _, _, link in open_[n:])
        for t, _, _ in open_[n:]:
            places[t].pop()
        del open_[n:]
        while blocks and blocks[-1] >= n:
            blocks.pop()
        path = open_[-1][1] if open_ else 0

    def add(text: str) -> None:
        nonlocal here, linked
        if not parts:
            if text.isspace():
                return
            here = path
        parts.append(text)
        if in_link:
            linked += len(text)

    end = 0
    for start, stop, closes, tag, attrs in Scanner(html):
        if start > end:
            add(html[end:start])
        end = stop
        if not tag:
            continue
        if closes:
            if places.get(tag):
                pop_to(places[tag][-1])
            elif tag in BLOCK_TAGS:
                flush()
            continue
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            if blocks:  # the nearest is the only one that may end here
                t = open_[blocks[-1]][0]
                if t == "p" and tag in NOT_IN_P or t in ENDS.get(tag, ()):
                    pop_to(blocks[-1])
        if tag in VOID_TAGS or attrs.endswith("/"):
            continue
        link = tag == "a"
        if tag in BLOCK_TAGS or link:
            path = paths.child(path, tag, attrs if tag in BLOCK_TAGS else "")
        if tag in BLOCK_TAGS:
            blocks.append(len(open_))
        places.setdefault(tag, []).append(len(open_))
        open_.append((tag, path, link))
        in_link += link
    if end < len(html):
        add(html[end:])
    flush()
    return texts, at, links


def inputs(texts: list[str], at: list[int], links: list[int], paths: Paths) -> np.ndarray:
    """A row per block for the network."""
    n = len(texts)
    x = np.zeros((n, INPUT), np.float32)
    if not n:
        return x
    x[:, :PATH_SLOTS] = [paths.vectors[p] for p in at]
    column = pa.array(texts, pa.large_string())
    n_words = np.zeros(n)
    for chunk in tb.chunks(column):
        w = tb.words(chunk, lower=True)
        rows = chunk.hi - chunk.lo
        count = np.diff(w.first)
        row = np.repeat(np.arange(rows), count)
        slots = (w.hash >> np.uint64(40)).astype(np.int64)
        sign = 1.0 - 2.0 * ((w.hash >> np.uint64(20)) & np.uint64(1)).astype(np.float64)
        v = np.bincount(row * WORD_SLOTS + slots % WORD_SLOTS, sign, rows * WORD_SLOTS).reshape(rows, -1)
        x[chunk.lo:chunk.hi, PATH_SLOTS:PATH_SLOTS + WORD_SLOTS] = v / np.sqrt(np.maximum(count, 1))[:, None] * 0.3
        n_words[chunk.lo:chunk.hi] = count
    size = np.array([len(t) for t in texts])
    e = PATH_SLOTS + WORD_SLOTS
    x[:, e] = np.minimum(np.log1p(n_words) / 5, 1.5)
    x[:, e + 1] = np.minimum(np.array(links) / np.maximum(size, 1), 1)
    x[:, e + 2] = [t[-1] in ".!?" for t in texts]
    x[:, e + 3] = np.arange(n) < 3
    x[:, e + 4] = np.arange(n) >= n - 3
    x[:, e + 5] = 1
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output per block."""

    def __init__(self, seed: int = 9):
        rng = np.random.Generator(np.random.PCG64(seed))
        scale = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = scale(INPUT, 4 * HIDDEN)
            self.w[f"h{d}"] = scale(HIDDEN, 4 * HIDDEN)
        self.w["out"] = scale(2 * HIDDEN + 1, 1)

    @staticmethod
    def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sequences as (time, sequence, input), and which places are filled."""
        n = [len(s) for s in sequences]
        x = np.zeros((max(n), len(n), INPUT), np.float32)
        mask = np.zeros((max(n), len(n)), np.float32)
        for i, s in enumerate(sequences):
            x[:n[i], i] = s
            mask[:n[i], i] = 1
        return x, mask

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        z_in = x @ self.w[f"x{d}"]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.zeros((len(x), x.shape[1], HIDDEN), np.float32)
        trace = []
        for t in steps:
            z = z_in[t] + h @ self.w[f"h{d}"]
            gates = _sigmoid(z[:, :3 * HIDDEN])
            i, f, o = (gates[:, k * HIDDEN:(k + 1) * HIDDEN] for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            before = (h, c)
            c = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(c)
            h = m * (o * tc) + (1 - m) * h
            out[t] = h
            trace.append((t, before, i, f, o, g, tc, m))
        return out, trace

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, _ = self._run(x, mask, "f")
        b, _ = self._run(x, mask, "b")
        return (f @ self.w["out"][:HIDDEN] + b @ self.w["out"][HIDDEN:2 * HIDDEN] + self.w["out"][-1])[:, :, 0]

    def _gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, known: np.ndarray) -> tuple[dict, float]:
        outs = {d: self._run(x, mask, d) for d in "fb"}
        both = np.concatenate([outs["f"][0], outs["b"][0], np.ones((*mask.shape, 1), np.float32)], axis=2)
        p = _sigmoid((both @ self.w["out"])[:, :, 0])
        n = max(known.sum(), 1)
        loss = float(-(known * np.where(y > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum() / n)
        dz = (known * (p - y) / n)[:, :, None].astype(np.float32)
        grad = {"out": np.einsum("tbi,tbo->io", both, dz)}
        d_both = dz @ self.w["out"].T
        for k, d in enumerate("fb"):
            d_out = d_both[:, :, k * HIDDEN:(k + 1) * HIDDEN]
            wh = self.w[f"h{d}"]
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            d_in = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            g_h = np.zeros_like(wh)
            for t, (h0, c0), i, f, o, g, tc, m in reversed(outs[d][1]):
                dh = dh + d_out[t]
                live = m * dh
                dct = m * dc + live * o * (1 - tc * tc)
                d_gates = np.concatenate([dct * g * i * (1 - i), dct * c0 * f * (1 - f), live * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
                d_in[t] = d_gates
                g_h += h0.T @ d_gates
                dh = (1 - m) * dh + d_gates @ wh.T
                dc = (1 - m) * dc + dct * f
            grad[f"h{d}"] = g_h
            grad[f"x{d}"] = np.einsum("tbi,tbo->io", x, d_in, optimize=True)
        return grad, loss

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 24, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam over batches; labels are 1, 0 or -1 (unknown). Returns the loss by epoch."""
        rng = np.random.Generator(np.random.PCG64(seed))
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            order = rng.permutation(len(sequences))
            total = []
            for lo in range(0, len(order), batch):
                some = sorted((sequences[i] for i in order[lo:lo + batch]), key=lambda s: len(s[0]))
                x, mask = self.padded([s[0] for s in some])
                y = np.full(mask.shape, -1.0, np.float32)
                for i, (_, labels) in enumerate(some):
                    y[:len(labels), i] = labels
                grad, loss = self._gradients(x, mask, np.maximum(y, 0), ((y >= 0) * mask).astype(np.float32))
                total.append(loss)
                step += 1
                lr = rate * (1 - epoch / epochs * 0.8)
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    self.w[k] = self.w[k] - (lr * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            losses.append(float(np.mean(total)))
        return losses

    def label(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block is main text, by page; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(sequences)
        order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and len(sequences[order[hi]]) * (hi + 1 - lo) <= GROUP_BLOCKS:
                hi += 1
            some = order[lo:hi]
            z = self.logits(*self.padded([sequences[i] for i in some]))
            for k, i in enumerate(some):
                out[i] = z[:len(sequences[i]), k] > 0
            lo = hi
        return out


def own_labels(at: list[int], paths: Paths) -> np.ndarray:
    """Labels that a page gives itself; -1 throughout if it marks no main part."""
    words = [paths.words[p] for p in at]
    if not any(w & INSIDE for w in words):
        return np.full(len(at), -1.0)
    return np.array([float(bool(w & INSIDE) and not w & OUTSIDE) for w in words])


def layout(rng: np.random.Generator, paragraphs: list[str]) -> str:
    """An invented page around given paragraphs; ``data-keep`` holds the labels."""
    pick = lambda *a: a[rng.integers(len(a))]
    vocabulary = " ".join(paragraphs[rng.integers(len(paragraphs))] for _ in range(3)).split()

    def words(lo: int, hi: int) -> str:
        return " ".join(vocabulary[rng.integers(len(vocabulary))] for _ in range(rng.integers(lo, hi)))

    def link_list(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(1, 4)}</a></li>' for _ in range(n)) + "</ul>"

    def prose(lo: int, hi: int) -> str:
        return "".join(f"<p>{paragraphs[rng.integers(len(paragraphs))] if rng.random() < 0.7 else words(2, 40)}</p>" for _ in range(rng.integers(lo, hi)))

    def small() -> str:
        return pick(words(1, 12), f"<p>{words(3, 30)}</p>", link_list(rng.integers(1, 5)), prose(1, 3), f"<h3>{words(1, 4)}</h3><p>{words(3, 20)}</p>")

    def box(*openings: str) -> str:
        o = pick(*openings)
        return f'<{o} data-keep="0">{small()}</{o.split()[0]}>'

    comment = lambda: box('section id="comments"', 'div class="comments"', 'div class="reader-comments"', 'div id="disqus_thread"',
                          'ol class="comment-list"', 'section class="user comments"', 'article class="comment"', 'div class="comment"',
                          'div class="replies"', 'section class="responses"', 'div id="reader_comments"')
    kinds = [
        lambda: f'<nav data-keep="0">{link_list(rng.integers(2, 8))}</nav>',
        lambda: box('div class="menu"', 'ul id="navigation"', 'div class="navbar"', 'div id="nav"', 'div class="breadcrumbs"', 'nav class="toc"',
                    'div role="navigation"', 'div class="nav"', 'menu'),
        lambda: box("header", 'div id="header"', 'div class="top-bar"', 'div class="site-header"', 'header class="masthead"', 'div role="banner"', 'div class="header"'),
        lambda: box('div class="ad"', 'div class="ads"', 'aside class="advert"', 'div class="sponsored"', 'div id="promo"', 'section class="advertisement"',
                    'div class="ad-slot"', 'div id="banner-ad"', 'div class="advert"'),
        lambda: box("aside", 'div class="sidebar"', 'div id="sidebar"', 'aside class="related"', 'div class="widget"', 'div class="side"', 'section class="sidebar"'),
        lambda: box('div class="cookie-notice"', 'div id="cookie-banner"', 'div class="notice"', 'div class="alert"', 'div role="alert"',
                    'div class="gdpr consent"', 'section class="notice"', 'div class="popup"', 'dialog', 'div class="cookie"'),
        lambda: f'<form data-keep="0"><label>{words(1, 4)}</label><p>{words(1, 9)}</p><button>{words(1, 3)}</button></form>',
        lambda: box('div class="newsletter"', 'div class="subscribe"', 'div class="share"', 'div class="social"', 'div class="related"', 'form class="search"'),
    ]
    ends = [lambda: box("footer", 'div id="footer"', 'div class="footer"', 'div class="copyright"', 'div class="site-footer"', 'div role="contentinfo"'), comment]
    inner = [kinds[3], kinds[4], kinds[6], kinds[7], comment]
    body = f"<h1>{words(2, 10)}</h1>" if rng.random() < 0.8 else ""
    for _ in range(rng.integers(1, 9)):
        body += pick(prose(1, 4), prose(1, 4), prose(2, 5), f"<h2>{words(1, 7)}</h2>", f"<p><b>{words(3, 30)}<br>", f"<ul><li>{words(1, 20)}</li><li>{words(1, 20)}</li></ul>",
                     f"<blockquote>{words(5, 40)}</blockquote>", f"<table><tr><td>{words(1, 8)}</td><td>{words(1, 8)}</td></tr></table>",
                     f"<pre>{words(2, 20)}</pre>", f"<p>{words(1, 4)}</p>")
        if rng.random() < 0.12:
            body += inner[rng.integers(len(inner))]()
    opening = pick("article", "article", "article", 'article class="post"', "main", 'main id="main"', 'div class="content"', 'div id="content"', 'div class="post"',
                   'div class="entry-content"', 'section class="article-body"', 'div class="story"', 'div class="main"', 'section', 'div', 'div role="main"')
    tag = opening.split()[0]
    page = "".join(kinds[rng.integers(len(kinds))]() for _ in range(rng.integers(0, 4)))
    page += f'<{opening} data-keep="1">{body}</{tag}>'
    page += "".join(pick(*ends, kinds[3], kinds[4], kinds[7])() for _ in range(rng.integers(0, 4)))
    if rng.random() < 0.3:
        page = f"<{pick('div', 'div class=wrapper', 'div id=page')}>{page}</div>"
    return f"<html><body>{page}</body></html>"


PARAGRAPHS = [
    "The committee met on Monday to talk about the plan for the old harbour and the road beside it.",
    "A short note on method: every sample was weighed twice, once before and once after it was dried.",
    "She walked along the river until the lights of the town were behind her, and then sat down.",
    "Prices rose in spring, fell in summer and hardly moved for the rest of the year.",
]


def train(pages: list[str]) -> Labeller:
    """A labeller from sample pages and layouts invented around their paragraphs."""
    paths = Paths()
    sequences, paragraphs = [], list(PARAGRAPHS)
    for html in pages:
        texts, at, links = blocks_of(html, paths)
        labels = own_labels(at, paths)
        if len(texts):
            sequences.append((inputs(texts, at, links, paths)[:200], labels[:200]))
            paragraphs += [t[:400] for t, y in zip(texts, labels) if y > 0][:6]
    rng = np.random.Generator(np.random.PCG64(17))
    for _ in range(TRAIN_LAYOUTS):
        texts, at, links = blocks_of(layout(rng, paragraphs), paths)
        keep = np.array([-1.0 if paths.keep[p] is None else float(paths.keep[p]) for p in at])
        sequences.append((inputs(texts, at, links, paths), keep))
    model = Labeller()
    model.fit(sequences)
    return model


def sample_pages(pages: DataFrame, n: int = TRAIN_PAGES) -> list[str]:
    """At most ``n`` pages under ``TRAIN_BYTES`` bytes: those whose hash is least."""
    some = (pages.where(F.octet_length("html") < TRAIN_BYTES).select("html", F.xxhash64("html").alias("h"))
            .orderBy("h", "html").limit(n))
    return [r.html for r in some.collect()]  # n * TRAIN_BYTES at most


def extracted(html: list[str], model: Labeller) -> list[str]:
    paths = Paths()
    read = [blocks_of(h, paths) for h in html]
    labels = model.label([inputs(*r, paths) for r in read])
    return ["\n".join([t for t, keep in zip(r[0], y) if keep]) for r, y in zip(read, labels)]


def main_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """Every row of ``pages`` with ``text`` (its main text, empty if it has none) and ``n_chars``.

    Without a model one is trained on a sample of ``pages``. Character references are decoded, white
    space inside a block becomes one space, blocks are joined by a newline. A null page is an empty
    one. Other columns are carried along, except that columns named text or n_chars are replaced.
    """
    spark = pages.sparkSession
    pages = pages.drop("text", "n_chars")
    shared = spark.sparkContext.broadcast((model or train(sample_pages(pages))).w)
    html_at = pages.columns.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller()
        model.w = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                texts = extracted([h or "" for h in some.column(html_at).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=[*some.schema.names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(run, f"{schema}, text string").withColumn("n_chars", F.length("text").cast("long"))
