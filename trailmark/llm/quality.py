"""Operator 4: quality rules with adaptive thresholds from mergeable quantile sketches.

Five integer measures per document (per mille or per cent, so engines agree) go into one sketch per
(language, source): counts over fixed bins of ``STEP``, at most ``TOP // STEP + 1`` of them, the
last one open. Two sketches merge by adding counts, in any order, with the same result; a quantile
of the sketch is exact to one bin. The thresholds of a group are Tukey fences from its own
quartiles, never closer to them than the measure's margin; a group with fewer than ``MIN_DOCS``
documents uses the merged sketch of its language, and that failing the merged sketch of all.
Documents then join their group's thresholds and are kept if every measure is inside.

Documents that fail the base rules (too short, too many repeated words) are rejected beforehand and
do not shape the sketches. SQL functions only; no Python code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.staging import stored

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
STEP = 5
TOP = 10_000
MIN_DOCS = 50
FENCE = 8

# measure -> (least distance of the upper fence from the third quartile, the same below the first
# quartile or None where only high values are bad); same units as the measure. The distance is that of
# the sketch, ``FENCE`` quartile ranges, wherever this is more: for the last two measures these are a few bins, the
# first three are 0 in most documents of most groups, so their quartiles do not spread
MARGINS: dict[str, tuple[int, int | None]] = {
    "symbol_rate": (10 * STEP, None),    # symbols per 1000 words
    "dup_line_rate": (70 * STEP, None),  # duplicate lines per 1000 lines with a word
    "repeat_rate": (57 * STEP, None),    # words in repeated windows per 1000 words
    "upper_rate": (7 * STEP, None),      # upper-case letters per 1000 characters in words
    "word_length": (10 * STEP, 10 * STEP),  # characters per 100 words
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OUT = [*BASE, "base_failed", *MARGINS, "threshold_level", "kept"]

GAP = r"[\x20\x09-\x0D]+"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(window_hashes: Column) -> Column:
    """Words covered by windows whose hash occurs more than once, from the hashes in text order."""
    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda j, o: s[j]["h"] == s[o]["h"]
        twice = F.filter(F.sequence(F.lit(0), last), lambda j: F.when(j > 0, same(j, F.greatest(j - 1, F.lit(0)))).otherwise(False)
                         | F.when(j < last, same(j, F.least(j + 1, last))).otherwise(False))
        return F.sort_array(F.transform(twice, lambda j: s[j]["i"]))

    ordered = F.sort_array(F.transform(window_hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.aggregate(
        _let(ordered, starts), F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"])


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the base counts of every whole text (a null text has no words)."""
    keep = [c for c in keep if c not in OUT]
    text = F.coalesce("text", F.lit(""))
    d = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("__t"),
                    F.array_remove(F.split(text, GAP), "").alias("__w"))
    n = F.size("__w")
    d = d.withColumn("__h", F.when(n > WINDOW, F.transform(
        F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("__w", i, WINDOW)))))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("__l", lines)
    repeated = F.when(F.size("__h") > F.size(F.array_distinct("__h")), repeated_words(F.col("__h"))).otherwise(0)
    return d.select(
        *[F.col(f"`{c}`") for c in keep],
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count("__t", F.lit(r"\p{Lu}")).cast("long").alias("__upper"),
        F.size("__l").cast("long").alias("__lines"))


def measured(f: DataFrame) -> DataFrame:
    """The base verdict and the five measures (0 where there is nothing to divide by)."""
    def rate(a: str, b: str, per: int) -> Column:
        return F.when(F.col(b) > 0, F.floor(F.col(a) * per / F.col(b))).otherwise(0).cast("long")

    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return (f.withColumn("base_failed", failed)
            .withColumn("symbol_rate", rate("n_symbols", "n_words", 1000))
            .withColumn("dup_line_rate", rate("n_dup_lines", "__lines", 1000))
            .withColumn("repeat_rate", rate("n_repeat_words", "n_words", 1000))
            .withColumn("upper_rate", rate("__upper", "word_chars", 1000))
            .withColumn("word_length", rate("word_chars", "n_words", 100))
            .drop("__upper", "__lines"))


def sketches(rows: DataFrame) -> DataFrame:
    """One quantile sketch per (lang, source, measure), as rows ``(..., bin, n)``."""
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MARGINS])
    # counted instead of filtered: Spark would move a filter below the measures and take them, and the words
    # anew for every window, to decide it
    return (rows.select("lang", "source", "base_failed", F.explode(measures).alias("m"))
            .groupBy("lang", "source", F.col("m.measure").alias("measure"),
                     F.floor(F.least(F.col("m.v"), F.lit(TOP)) / STEP).cast("long").alias("bin"))
            .agg(F.count_if(~F.col("base_failed")).alias("n")).where("n > 0"))


def quantiles(sketch: DataFrame, by: list[str], percents: tuple[int, ...] = (25, 75)) -> DataFrame:
    """Merges sketches over ``by`` and reads quantiles: the lower end of the first bin at which
    the running count reaches the share. Also the number of documents, ``docs``."""
    merged = sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = merged.select("*", F.sum("n").over(upto).alias("c"), F.sum("n").over(group).alias("docs"))
    return merged.groupBy(*by, "measure").agg(
        F.max("docs").alias("docs"),
        *[F.min(F.when(F.col("c") * 100 >= F.col("docs") * p, F.col("bin") * STEP)).alias(f"q{p}") for p in percents])


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """A row per group with ``<measure>_lo`` and ``<measure>_hi`` and ``docs``."""
    q = quantiles(sketch, by)
    spread = FENCE * (F.col("q75") - F.col("q25"))
    aggs = [F.max("docs").alias("docs")]
    for m, (up, down) in MARGINS.items():
        this = F.col("measure") == m
        aggs.append(F.max(F.when(this, F.col("q75") + F.greatest(spread, F.lit(up)))).alias(f"{m}_hi"))
        low = F.col("q25") - F.greatest(spread, F.lit(down)) if down is not None else F.lit(None).cast("long")
        aggs.append(F.max(F.when(this, low)).alias(f"{m}_lo"))
    return q.groupBy(*by).agg(*aggs)


def quality_rules(docs: DataFrame, keep: list[str] | None = None, twice: bool = False) -> DataFrame:
    """``keep`` columns of every document (default all), the counts, the measures, ``kept``.

    Needs columns text, lang and source; null language or source is a group like any other. Input
    columns named like an output column are replaced by it; any other name may occur. Order, repeated rows and extra columns
    do not matter; an empty table gives an empty table. Both the sketches and the filter need the
    measures: the rows are stored once in the shared folder, or with ``twice`` measured again for
    the filter, which saves a copy of the texts where they are kept.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in OUT]
    # the input's columns travel in one struct, so none can clash with a helper's name
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    docs = docs.select(row.alias("row"), "lang", "source", "text")
    carried = ["row", "lang", "source"]
    if twice:
        sketch = stored(sketches(measured(features(docs, ["lang", "source"]))), "quality-sketches")
        rows = measured(features(docs, carried))
    else:
        rows = stored(measured(features(docs, carried)), "quality")
        sketch = sketches(rows)
    own = fences(sketch, ["lang", "source"])
    of_lang = fences(sketch, ["lang"])
    of_all = fences(sketch, [])
    names = [f"{m}_{s}" for m in MARGINS for s in ("lo", "hi")]

    def side(f: DataFrame, tag: str) -> DataFrame:
        return f.select(*[F.col(c).alias(f"__{tag}_{c}") for c in f.columns])

    o, g, a = side(own, "o"), side(of_lang, "g"), side(of_all, "a")
    limits = (o.join(g, o["__o_lang"].eqNullSafe(g["__g_lang"]), "left")
              .join(a.withColumn("__one", F.lit(1)), F.lit(1) == F.col("__one"), "left"))
    level = (F.when(F.col("__o_docs") >= MIN_DOCS, "source")
             .when(F.col("__g_docs") >= MIN_DOCS, "lang").otherwise("all"))

    def pick(name: str) -> Column:
        return (F.when(F.col("__o_docs") >= MIN_DOCS, F.col(f"__o_{name}"))
                .when(F.col("__g_docs") >= MIN_DOCS, F.col(f"__g_{name}"))
                .otherwise(F.col(f"__a_{name}")).alias(f"__{name}"))

    limits = limits.select("__o_lang", "__o_source", level.alias("threshold_level"), *[pick(n) for n in names])
    if twice:
        limits = stored(limits, "quality-limits")  # of known size, so Spark can broadcast it instead of shuffling texts
    inside = F.lit(True)
    for m, (_, down) in MARGINS.items():
        inside = inside & (F.col(m) <= F.col(f"__{m}_hi"))
        if down is not None:
            inside = inside & (F.col(m) >= F.col(f"__{m}_lo"))
    judged = rows.join(limits, F.col("lang").eqNullSafe(F.col("__o_lang"))
                       & F.col("source").eqNullSafe(F.col("__o_source")), "left")
    return judged.select(
        *[F.col(f"row.`{c}`") for c in keep], *BASE, "base_failed", *MARGINS, "threshold_level",
        # one value of an array, not a conjunction: a filter on half of it would move below the measures as well
        F.forall(F.array(~F.col("base_failed"), F.coalesce(inside, F.lit(False))), lambda x: x).alias("kept"))
