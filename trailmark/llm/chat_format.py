"""Operator 6: conversations rebuilt from an event log, then rendered with a loss mask.

Log rows are ``(conv_id, seq, kind, turn, role, text)``; per conversation, in order of ``seq``:

=============  ===============================================================================
``message``    the turn's text becomes ``text`` and its role ``role``
``delta``      ``text`` is appended to the turn (streamed piece); ``role`` names a new turn's role
``edit``       the turn's text becomes ``text``; the role stays; every later turn is dropped
``regenerate`` the turn's text is cleared, to be streamed again; every later turn is dropped
``delete``     the turn is dropped
=============  ===============================================================================

The fold is relational: for a turn only the events from its last reset on count (message, edit,
regenerate, delete, or an edit or regenerate of an earlier turn), so its text is the concatenation
of the pieces from there. Resets are found by one aggregation per turn and a window over turns.

Rendering: ``<|turn ROLE|>TEXT<|end|>`` and a newline per turn. ROLE is URL-encoded. In TEXT a
backslash is doubled and ``<|`` becomes ``<\\|``, so no control string can occur inside a text, and
``unescape`` restores it exactly. ``loss_spans`` are (turn index, start of the turn, start, length)
in code points of the escaped assistant texts.

SQL expressions only. A conversation ends as one row with its rendered text, as it must; before
that its events are sorted by windows, which spill. Nulls: a null text is empty, a null role is
the empty role, a null conversation id is a conversation of its own, a null turn or seq sorts
first; rows equal in (conv_id, seq) are ordered by turn, kind, role, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"
RESETS = ("message", "edit", "regenerate", "delete")
CUTS = ("edit", "regenerate")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undoes ``escape``: a backslash stands for the character after it."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, turn, role, text)`` of a log; see the module text."""
    e = events.select("conv_id", "seq", "kind", "turn",
                      F.coalesce("role", F.lit("")).alias("role"),
                      F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("seq", "turn", "kind", "role", "text")]
    whole = Window.partitionBy("conv_id").orderBy(*order)
    e = e.withColumn("n", F.row_number().over(whole))
    cut = F.col("kind").isin(*CUTS)
    per_turn = e.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("kind").isin(*RESETS), F.col("n"))).alias("reset"),
        F.max(F.when(cut, F.col("n"))).alias("own_cut"))
    smaller = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1)
    per_turn = per_turn.withColumn("dropped", F.max("own_cut").over(smaller))
    last = F.greatest(F.coalesce("reset", F.lit(0)), F.coalesce("dropped", F.lit(0)))
    per_turn = per_turn.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), last.alias("from_n"))
    kept = e.join(per_turn, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
                  ).where("n >= from_n")
    said = F.when(F.col("kind").isin("message", "delta", "edit"), F.col("text")).otherwise("")
    pieces = F.sort_array(F.collect_list(F.struct("n", "kind", said.alias("text"))))
    # the role: of the last message of the turn, else of its first delta
    roles = e.where(F.col("kind").isin("message", "delta")).groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("kind") == "message", F.struct("n", "role"))).alias("said"),
        F.min(F.struct("n", "role")).alias("first"))
    roles = roles.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"),
                         F.coalesce("said.role", "first.role").alias("role"))
    turns = kept.groupBy("conv_id", "turn").agg(pieces.alias("p")).where(
        # a deletion, or a regeneration not streamed again, leaves no turn
        F.exists("p", lambda x: x["kind"].isin("message", "delta", "edit")))
    alive = turns.select("conv_id", "turn", F.array_join(F.col("p.text"), "").alias("text"))
    return (alive.join(roles, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left")
            .select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "text"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans`` from ``(conv_id, turn, role, text)``.

    Repeated (conv_id, turn) rows are all rendered, ordered by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    role = F.coalesce("role", F.lit(""))
    m = messages.select(
        "conv_id", F.row_number().over(order).alias("k"), role.isin(*loss_roles).alias("loss"),
        F.concat(F.lit("<|turn "), F.url_encode(role), F.lit("|>")).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"))
    m = m.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)))
    span = F.struct((F.col("k") - 1).alias("turn"), F.col("at").alias("turn_start"),
                    (F.col("at") + F.length("head")).alias("start"),
                    F.length("body").cast("long").alias("length"))
    rows = F.sort_array(F.collect_list(F.struct("k", "piece")))
    return m.groupBy("conv_id").agg(
        F.array_join(rows["piece"], "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("loss"), span))).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a rendered text, ``array<struct<role, text>>``, unescaped."""
    pieces = F.split(formatted, r"<\|end\|>\n")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(pieces, lambda p: F.struct(
        F.url_decode(F.regexp_extract(p, r"\A<\|turn ([^|]*)\|>", 1)).alias("role"),
        unescape(F.regexp_replace(p, r"\A<\|turn [^|]*\|>", "")).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, in order, unescaped: ``array<string>``.

    Offsets are looked up inside the span's own turn, so the work is linear in the text.
    """
    def inside(pieces: Column) -> Column:
        return F.transform(spans, lambda s: unescape(F.substring(
            F.concat(F.element_at(pieces, (s["turn"] + 1).cast("int")), F.lit(END)),
            (s["start"] - s["turn_start"] + 1).cast("int"), s["length"].cast("int"))))

    pieces = F.split(formatted, r"<\|end\|>\n")
    return F.element_at(F.transform(F.array(pieces), inside), 1)
