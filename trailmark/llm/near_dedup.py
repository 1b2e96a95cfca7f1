"""Operator 8: near duplicates by SetSketch registers, banding, joint estimate and verification.

A document is the set of its distinct word 5-grams. Its sketch has ``REGISTERS`` registers; each is
the exponentially spaced, truncated minimum of an exponential hash over the set,
``K = clip(floor(1 - log_b(min)), 0, q + 1)``, so sketches of parts merge by the register-wise
maximum, and two sketches share a register with a probability close to the Jaccard similarity of
their sets (base ``b`` near 1).

1. Documents with the same set form a class (one aggregation), named by its least id; only
   classes go on.
2. Bands of ``BAND`` registers hash a class into buckets. A pair at similarity 0.75 shares at least
   one of 32 buckets with probability above 0.99999.
3. A cheap first step joins what is easily joined: in each of ``TURNS`` rounds a member meets one
   other of its buckets, one pair per member however large the bucket. Pairs that differ too much in
   size, or whose joint likelihood estimate from the two sketches and the known set sizes lies
   ``SLACK`` below the threshold, are dropped.
4. What remains is verified on the full sets, recomputed from the texts. Verified links join classes
   into components.
5. Members of all buckets that still hold several components are laid out by their rare shingles
   (``prefixes``). Each meets at most ``CORES`` others, those of its shingles that have least of their own
   (``core_pairs``): in a group of near copies these are near the text that all are copies of, so one
   such round joins what two random members would mostly miss.
6. The rest is exact: a prefix join over the same shingles (``prefix_pairs``) gives every pair of
   different components that can reach the threshold, which the estimate and the verification then judge.

Only ids, sketches, the texts of bucket members and the shingles of the rest are shuffled. A bucket,
class or component may hold any share of the rows: pivots are minima found by partial aggregation,
the joins that follow have one row per key on one side, a pivot's pairs are dealt in bounded tasks.
Documents that share a template have its shingles last in the order of the prefix join, so they do
not meet there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm import textbytes as tb
from trailmark.llm.staging import among, components, discard, files_for, shuffle_partitions, stored

WORDS = 5
THRESHOLD = 75  # per cent
REGISTERS = 128
BAND = 4
BASE = 1.001
RATE = 20.0
LIMIT = (1 << 16) - 2
SLACK = 0.17  # above four standard errors of the estimate at the threshold
TURNS = 2
CORES = 3  # partners of a member by its rare shingles
DRIVERS = 256  # pairs of a pivot in one task
SLOTS = 8  # rows of an id table that a class, a member or a pair counts as, where files are sized
WIDE = 64  # the same where rows are texts or their shingles

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(8))
_MULTIPLIERS = _rng.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * U64(2) + U64(1)

SKETCHES = "doc_id long, n_shingles long, cls binary, registers binary, bands array<long>"


def sets_of(column: pa.Array) -> Iterator[tuple[tb.Chunk, list[np.ndarray]]]:
    """Per chunk of texts the set of each: sorted distinct shingle hashes."""
    for chunk in tb.chunks(column):
        w = tb.words(chunk, lower=True)
        hashes, _, bounds = tb.shingle_rows(w, WORDS)
        n_words = np.diff(w.first)
        out = []
        for i in range(chunk.hi - chunk.lo):
            if n_words[i] >= WORDS:
                out.append(np.unique(hashes[bounds[i]:bounds[i + 1]]))
            elif n_words[i]:
                # a short text is one shingle, its whole word sequence
                out.append(tb.shingles(w.hash[w.first[i]:w.first[i + 1]], int(n_words[i])) + U64(n_words[i]))
            else:
                out.append(np.zeros(0, U64))
        yield chunk, out


def registers_of(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SetSketch registers (rows x REGISTERS, 16 bits) of non-empty sets laid end to end."""
    least = np.empty((len(starts), REGISTERS), np.uint64)
    x = np.empty_like(flat)
    for j, m in enumerate(_MULTIPLIERS):
        np.multiply(flat, m, out=x)  # the hashes are mixed already: an odd factor permutes them
        least[:, j] = np.minimum.reduceat(x, starts)
    uniform = (least.astype(np.float64) + 1.0) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 2**-53)) / RATE
    k = np.floor(1.0 - np.log(exponential) / np.log(BASE))
    return np.clip(k, 0, LIMIT + 1).astype("<u2")


def class_key(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    total = s.sum(dtype=np.uint64)
    other = (tb.mix(s) * U64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    return np.array([total + U64(len(s)), other], "<u8").tobytes()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, sets in sets_of(batch.column(1)):
            ids, row = (batch.column(c).slice(chunk.lo, chunk.hi - chunk.lo) for c in (0, 2))
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            registers: list = [None] * len(sets)
            bands: list = [None] * len(sets)
            if len(full):
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                r = registers_of(np.concatenate([sets[i] for i in full]), starts)
                b = r.reshape(len(full), -1, BAND).astype(np.uint64)
                h = np.full(b.shape[:2], 0, np.uint64) + np.arange(b.shape[1], dtype=np.uint64)
                for j in range(BAND):
                    h = tb.mix(h * U64(0x9E3779B97F4A7C15) + b[:, :, j] + U64(1))
                for at, i in enumerate(full):
                    registers[i] = r[at].tobytes()
                    bands[i] = tb.signed(h[at])
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(sizes, pa.int64()),
                pa.array([class_key(s) if len(s) else None for s in sets], pa.binary()),
                pa.array(registers, pa.binary()), pa.array(bands, pa.list_(pa.int64())), row],
                names=["doc_id", "n_shingles", "cls", "registers", "bands", "row"])


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of register rows with known set sizes.

    A register of the first set is the greater one with probability ``p(u - v j)``, the lesser one
    with ``p(v - u j)``, where u, v are the shares of the two sizes and ``p(x) = -log_b(1 - x (b-1)/b)``.
    The likelihood is evaluated on a grid of similarities up to the greatest that the sizes allow.
    """
    up = (a > b).sum(axis=1)[:, None]
    down = (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - up - down
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, 101)[None, :]

    def p(x):
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    more, less = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    score = up * np.log(more + tiny) + down * np.log(less + tiny) + same * np.log(np.maximum(1 - more - less, 0) + tiny)
    return j[np.arange(len(j)), score.argmax(axis=1)]


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("a_registers", "b_registers"))
        na, nb = (batch.column(c).to_numpy().astype(float) for c in ("a_n", "b_n"))
        keep = estimate(a, b, na, nb) >= THRESHOLD / 100 - SLACK
        found = np.unique(np.stack([batch.column(c).to_numpy()[keep] for c in "ab"], axis=1), axis=0)  # sketches of one id repeat its pairs
        yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in (0, 1)], names=["a", "b"])


TASK = ["pivot", "salt"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``TASK`` in tables of whole tasks, with the task number of each row."""
    held: list[pa.RecordBatch] = []

    def split(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for c in TASK:
            v = table.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        task = split(table)
        last = int(np.searchsorted(task, task[-1]))  # the last task may go on in the next batch
        if last:
            yield table.slice(0, last), task[:last]
            held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, split(table)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of tasks (text null) whose sets, from the texts of the same tasks, reach the threshold."""
    for table, task in _groups(batches):
        cuts = np.append(np.flatnonzero(np.append(True, task[1:] != task[:-1])), len(task))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = table.slice(lo, hi - lo)
            is_pair = part.column("text").is_null()
            pairs, held = part.filter(is_pair), part.filter(part.column("text").is_valid())
            a, b = (pairs.column(c).to_numpy() for c in "ab")
            ids = held.column("a").to_numpy()
            sets = [s for c in held.column("text").chunks for _, some in sets_of(c) for s in some]
            of_node: dict[int, list[np.ndarray]] = {}  # rows may share an id
            for x, s in zip(ids.tolist(), sets):
                of_node.setdefault(x, []).append(s)
            linked = []
            for x in np.unique(a).tolist():
                others = [(y, s) for y in b[a == x].tolist() for s in of_node.get(y, ()) if len(s)]
                if not others:
                    continue
                sizes = np.array([len(s) for _, s in others])
                flat = np.concatenate([s for _, s in others])
                for mine in of_node.get(x, ()):
                    if len(mine):
                        found = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                        both = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes) - sizes)
                        near = 100 * both >= THRESHOLD * (len(mine) + sizes - both)
                        linked += [(x, others[k][0]) for k in np.flatnonzero(near)]
            if linked:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*linked)], names=["a", "b"])


def partners(members: DataFrame, turn: int) -> DataFrame:
    """Pairs ``(a, b)`` of members (band, node, n, label): every member with at most one other.

    The first turn takes the first member of each bucket in a random order of all members, one order
    for all bands, so members of a group meet the same few. Later turns take, by a random order of the labels, the first two
    labels of each bucket, so that every member meets one of another label. Of what its
    buckets offer a member takes the first in that order; pairs of one label or of too different sizes are left out.
    """
    salt = F.lit(turn)
    order = F.xxhash64("node", salt) if not turn else F.struct(F.xxhash64("label", salt), F.xxhash64("node", salt))
    some = members.select("band", F.struct(order.alias("place"), "node", "n", "label").alias("m"))
    first = some.groupBy("band").agg(F.min("m").alias("first"), F.min("m.label").alias("lo"), F.max("m.label").alias("hi"))
    first = first.where("lo <> hi").select(F.col("band").alias("of"), "first")
    met = some.join(first, F.col("band") == F.col("of"))
    offered = met.where("m.label <> first.label").select("m", F.col("first").alias("p"))
    if turn:
        second = met.where("m.label <> first.label").groupBy("of").agg(F.min("m").alias("second"))
        back = met.where("m.label = first.label").select("m", F.col("of").alias("at"))
        offered = offered.unionByName(back.join(second, F.col("at") == F.col("of")).select("m", F.col("second").alias("p")))
    fits = F.least("m.n", "p.n") * 100 >= F.greatest("m.n", "p.n") * THRESHOLD
    taken = offered.where(fits).groupBy(F.col("m.node").alias("b")).agg(F.min("p").alias("p"))
    return taken.select(F.col("p.node").alias("a"), "b")


def _likely_pairs(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The stored ``pairs`` that may reach the threshold by the estimate from their sketches; stored."""
    def side(s: str) -> DataFrame:
        return sketch.select(F.col("node").alias(s), F.col("registers").alias(f"{s}_registers"), F.col("n").alias(f"{s}_n"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.select("a", "b", "a_n", "b_n", "a_registers", "b_registers").coalesce(files_for(pairs.sparkSession, SLOTS * pairs.count()))
    return stored(both.mapInArrow(_likely, "a long, b long"), "likely")


def _linked(likely: DataFrame, texts: DataFrame) -> DataFrame:
    """The likely pairs whose whole sets, from the texts (node, text), reach the threshold; stored.

    Pairs of one ``a`` are dealt in tasks of about ``DRIVERS``; a text goes to a task once.
    """
    tasks = shuffle_partitions(likely.sparkSession)
    many = likely.groupBy(F.col("a").alias("pivot")).agg(F.ceil(F.count("*") / DRIVERS).cast("int").alias("salts"))
    dealt = likely.join(many, F.col("a") == F.col("pivot")).select(
        "pivot", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "a", "b")
    wanted = dealt.select("pivot", "salt", F.explode(F.array("a", "b")).alias("wants")).distinct()
    held = wanted.join(texts, F.col("wants") == F.col("node"))
    both = dealt.withColumn("text", F.lit(None).cast("string")).union(
        held.select("pivot", "salt", "node", F.lit(None).cast("long"), "text"))
    found = both.repartition(tasks, *TASK).sortWithinPartitions(*TASK).mapInArrow(_verify, "a long, b long").distinct()
    return stored(found, "links", files=files_for(likely.sparkSession, SLOTS * likely.count()))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("node").alias("x"), "root")
    return members.join(known, F.col("node") == F.col("x"), "left").select(
        "band", "node", "n", F.coalesce("root", "node").alias("label"))


def _relabelled(entry: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("node").alias("x"), "root")
    return entry.join(known, F.col("node") == F.col("x"), "left").withColumn("label", F.coalesce("root", "label")).select(*entry.columns)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per node and shingle; ``set`` tells sets of one node apart."""
    for batch in batches:
        for chunk, sets in sets_of(batch.column("text")):
            size = np.array([len(s) for s in sets], np.int64)
            if not size.sum():
                continue
            row = np.repeat(np.arange(len(sets)), size)
            key = np.array([np.frombuffer(class_key(s), np.int64)[0] for s in sets], np.int64)
            node, label = (batch.column(c).slice(chunk.lo, chunk.hi - chunk.lo).to_numpy() for c in ("node", "label"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (tb.signed(np.concatenate(sets)), node[row], key[row], label[row], size[row])],
                names=["shingle", "node", "set", "label", "n"])


def prefixes(mixed: DataFrame, texts: DataFrame, files: int | None = None) -> DataFrame:
    """The shingles (shingle, node, label, n, alone, place) of ``mixed`` (node, label) by which pairs of
    different labels that can reach the threshold are found, rare ones first; ``alone`` of the n are in no
    other set.

    Two sets of x <= y shingles at the threshold share ``ceil(3 (x + y) / 7)`` of them, so in any one order of all
    shingles they share one of the first ``x - ceil(6 x / 7) + 1`` of the lesser and one of the first
    ``y - ceil(3 y / 4) + 1`` of the greater. The order is by the number of sets that have a shingle: what a template gives
    to all of its documents comes last, and shingles that one set has alone fill places without
    being joined at all. Tables have at most ``files`` files.
    """
    of = mixed.select(F.col("node").alias("x"), "label")
    told = of.join(texts, F.col("x") == F.col("node")).select("node", "label", "text")
    told = told if files is None else told.coalesce(files)
    each = stored(told.mapInArrow(_sets, "shingle long, node long, `set` long, label long, n long"), "shingles")
    shared = each.groupBy("shingle").agg(F.count("*").alias("sets"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("sets > 1")
    known = each.join(shared.withColumnRenamed("shingle", "s"), F.col("shingle") == F.col("s"))
    places = known.groupBy("node", "set", "label", "n").agg(F.sort_array(F.collect_list(
        F.struct("sets", "shingle", (F.col("lo") != F.col("hi")).alias("mixed")))).alias("shared"))
    first = F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1
    places = places.withColumn("alone", F.col("n") - F.size("shared")).where(F.col("alone") < first)
    entry = places.select("node", "label", "n", "alone", F.posexplode(F.expr("slice(shared, 1, cast(n - ceil(n * 3 / 4) + 1 - alone as int))")).alias("at", "e"))
    entry = stored(entry.where("e.mixed").select(
        F.col("e.shingle").alias("shingle"), "node", "label", "n", "alone", (F.col("alone") + F.col("at") + 1).alias("place")), "prefixes", files=files)
    discard(each)
    return entry


def core_pairs(entry: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``prefixes``: every member with at most ``CORES`` others.

    A shingle offers its members the one that has the least share of shingles alone, and those of its label the next
    one of another label. Of what its shingles offer a member takes the first in that order; pairs of too different sizes are left out.
    """
    some = entry.select("shingle", F.struct((F.col("alone") / F.col("n")).alias("share"), "node", "n", "label").alias("m"))
    first = some.groupBy("shingle").agg(F.min("m").alias("first"), F.min("m.label").alias("lo"), F.max("m.label").alias("hi"))
    first = first.where("lo <> hi").select(F.col("shingle").alias("of"), "first")
    met = some.join(first, F.col("shingle") == F.col("of"))
    second = met.where("m.label <> first.label").groupBy("of").agg(F.min("m").alias("second"))
    back = met.where("m.label = first.label").select("m", F.col("of").alias("at"))
    offered = met.where("m.label <> first.label").select("m", F.col("first").alias("p")).unionByName(
        back.join(second, F.col("at") == F.col("of")).select("m", F.col("second").alias("p")))
    fits = F.least("m.n", "p.n") * 100 >= F.greatest("m.n", "p.n") * THRESHOLD
    taken = offered.where(fits).groupBy(F.col("m.node").alias("b")).agg(F.slice(F.sort_array(F.collect_set("p")), 1, CORES).alias("taken"))
    return taken.select(F.explode("taken.node").alias("a"), "b").where("a <> b").distinct()


def prefix_pairs(entry: DataFrame, files: int | None = None) -> DataFrame:
    """All pairs (a, b) of different labels of ``prefixes`` that can reach the threshold. Where most sets
    of a shingle have one label, only the others ask. What is laid out for it has at most ``files`` files."""
    sizes = entry.groupBy("shingle", "label").agg(F.count("*").alias("count"))
    major = sizes.groupBy("shingle").agg(F.max(F.struct("count", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    major = major.select(F.col("shingle").alias("s"), F.col("most.label").alias("major"))
    entry = stored(entry.join(major, F.col("shingle") == F.col("s")).drop("s"), "entries", files=files)
    asks = entry.where("label <> major").select("shingle", F.struct("n", "node").alias("x"), F.col("label").alias("x_label"), F.col("place").alias("x_place"))
    met = entry.select(F.col("shingle").alias("s"), F.struct("n", "node").alias("y"), F.col("label").alias("y_label"),
                       F.col("place").alias("y_place"), (F.col("label") == F.col("major")).alias("y_major"))
    fits = F.expr("""shingle = s and x_label <> y_label and (y_major or x.node < y.node)
        and least(x.n, y.n) * 4 >= greatest(x.n, y.n) * 3
        and if(x < y, x_place <= x.n - ceil(x.n * 6 / 7) + 1, y_place <= y.n - ceil(y.n * 6 / 7) + 1)
        and 7 * (1 + least(x.n - x_place, y.n - y_place)) >= 3 * (x.n + y.n)""")
    pairs = asks.join(met, fits).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    out = stored(pairs.where("a <> b").distinct(), "rest")
    discard(entry)
    return out


def rest_pairs(mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different labels among ``mixed`` (node, label) that can reach the threshold: all
    of them, by a prefix join that takes rare shingles first."""
    entry = prefixes(mixed, texts)
    out = prefix_pairs(entry)
    discard(entry)
    return out


def near_duplicates(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default doc_id), ``n_shingles, component_id, kept, group_key`` for every row
    of ``docs`` (doc_id, text).

    Words are runs of other characters than ASCII white space, A-Z lower-cased. A text with fewer
    than five words is one shingle; a null, empty or blank text has none and is linked with
    nothing. A document is its id: rows that share one are one document. ``component_id`` is the
    least id reachable over links, ``kept`` where it is the row's own. Rows without an id are
    linked with rows of equal sets only; where none of these has an id, the component is null and
    the rows are kept. ``group_key`` is equal for the rows of a component (null for rows without a
    set), so one row of each can be chosen where rows repeat. Input columns named like an output
    column are replaced by it.
    """
    out = ["n_shingles", "component_id", "kept", "group_key"]
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in out]
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).alias("none"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row.alias("row"))
    schema = f"{SKETCHES}, row {named.schema['row'].dataType.simpleString()}"
    rows = stored(named.mapInArrow(_sketch, schema), "sketches")
    # an exchange has as many tasks as there are shuffle partitions; tables of few rows are written by fewer
    classes = stored(rows.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"),
        F.first("registers").alias("registers"), F.first("bands").alias("bands")), "classes", files=files_for(spark, 2 * SLOTS * rows.count()))
    members = classes.where("node is not null").select("node", "n", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    members = stored(members.join(shared.select(F.col("band").alias("b")), F.col("band") == F.col("b"), "left_semi"), "members",
                     files=files_for(spark, REGISTERS // BAND * classes.count()))
    nodes = stored(members.select("node").distinct(), "nodes", files=files_for(spark, members.count()))
    count = nodes.count()
    narrow, wide = files_for(spark, SLOTS * count), files_for(spark, WIDE * count)
    sketch = stored(classes.where("node is not null").join(nodes, "node", "left_semi").select("node", "n", "registers"), "registers")
    texts = stored(among(named.select("doc_id", "text"), nodes).join(
        nodes, F.col("doc_id") == F.col("node"), "left_semi").select(F.col("doc_id").alias("node"), "text"), "texts")

    labels = nodes.select("node", F.col("node").alias("root")).where(F.lit(False))
    for turn in range(TURNS):
        pairs = stored(partners(_labelled(members, labels), turn), "pairs", files=narrow)
        likely = _likely_pairs(pairs, sketch)
        links = _linked(likely, texts)
        labels = joined(labels, links)
        discard(pairs, likely, links)
    labelled = _labelled(members, labels)
    mixed = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    mixed = labelled.join(mixed.select(F.col("band").alias("of")), F.col("band") == F.col("of"), "left_semi")
    laid = entry = prefixes(mixed.select("node", "label").distinct(), texts, wide)
    pairs = stored(core_pairs(entry), "pairs", files=narrow)
    links = _linked(_likely_pairs(pairs, sketch), texts)
    if not links.isEmpty():
        labels = joined(labels, links)
        entry = _relabelled(entry, labels)
    pairs = prefix_pairs(entry, wide)
    discard(laid)
    links = _linked(_likely_pairs(pairs, sketch), texts)
    if not links.isEmpty():
        labels = joined(labels, links)

    known = labels.select(F.col("node").alias("x"), "root")
    grouped = classes.select(F.col("cls").alias("c"), "node").join(known, F.col("node") == F.col("x"), "left").select(
        "c", F.coalesce("root", "node").alias("of_class"))
    judged = rows.select("row", "doc_id", "n_shingles", "cls").join(grouped, F.col("cls") == F.col("c"), "left")
    component: Column = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("of_class"))
    key = F.when(F.col("cls").isNotNull(), F.coalesce(F.col("of_class").cast("string"), F.hex("cls")))
    return judged.select(
        *[F.col(f"row.`{c}`") for c in keep], "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), key.alias("group_key"))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, root) after further links: components of the roots that the links connect."""
    spark, count = links.sparkSession, links.count()
    to = labels.select(F.col("node").alias("x"), F.col("root").alias("to"))
    at = links
    for s in "ab":
        at = at.join(to, F.col(s) == F.col("x"), "left").withColumn(s, F.coalesce("to", s)).drop("x", "to")
    merged = components(at, files=files_for(spark, count))
    moved = merged.select(F.col("node").alias("m"), F.col("root").alias("r"))
    old = labels.join(moved, F.col("root") == F.col("m"), "left").select("node", F.coalesce("r", "root").alias("root"))
    new = merged.join(labels.select(F.col("node").alias("x")), F.col("node") == F.col("x"), "left_anti")
    return stored(old.unionByName(new), "labels", files=files_for(spark, labels.count() + 2 * count))
