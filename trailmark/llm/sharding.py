"""Operator 2: reproducible shuffle into shards by a Feistel permutation over global row numbers.

Every row gets a number 0..N-1, the permutation sends the number to a position, and the position
alone gives shard (position mod shards) and slot (position div shards). Shard sizes differ by one
row at most and slots have no gaps; shard and slot of any row number can be computed without the
data, and ``Permutation.invert`` gives the row number back.

The permutation works on a x b >= N with a, b near sqrt(N): alternating rounds add a keyed function
of one half to the other (modulo a or b), which is a bijection of a x b; a value that falls outside
0..N-1 walks its cycle until it is inside. The walk length needed is not a guess: the few values
outside are followed on the driver (fewer than sqrt(N), by the choice of a) and the longest run
found is the number of steps planned.

Everything on the rows is SQL expressions; no Python code, and no sort of the whole table: rows are
numbered inside hash buckets and bucket totals (``buckets`` rows at most) give each bucket's start.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1  # squares stay below 2**62: no overflow in long arithmetic
SEARCH = 1000


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection of 0..n-1 with the same arithmetic in Python and as a Spark column."""

    n: int
    seed: int = 0
    rounds: int = 8

    @property
    def sides(self) -> tuple[int, int]:
        """a, b with a*b >= n and as little above it as a short search near sqrt(n) finds."""
        if self.n < 2:
            return 1, 1
        root = isqrt(self.n - 1) + 1
        if self.n >= 1 << 52:  # the columns divide through double
            raise ValueError("more than 2**52 rows")
        return min(((a, -(-self.n // a)) for a in range(root, root + min(SEARCH, root))),
                   key=lambda ab: (ab[0] * ab[1], ab[0]))

    @property
    def keys(self) -> list[tuple[int, int]]:
        def key(r: int, part: int) -> int:
            digest = hashlib.sha256(f"{self.seed}/{r}/{part}".encode()).digest()
            return 1 + int.from_bytes(digest[:8], "little") % (PRIME - 1)

        return [(key(r, 0), key(r, 1)) for r in range(self.rounds)]

    def _once(self, v: int, sign: int = 1) -> int:
        a, b = self.sides
        left, right = divmod(v, b)
        numbered = list(enumerate(self.keys))
        for r, (k1, k2) in numbered if sign > 0 else reversed(numbered):
            source = right if r % 2 == 0 else left
            f = (source * k1 + k2) % PRIME
            f = f * f % PRIME
            if r % 2 == 0:
                left = (left + sign * f) % a
            else:
                right = (right + sign * f) % b
        return left * b + right

    def __call__(self, v: int) -> int:
        v = self._once(v)
        while v >= self.n:
            v = self._once(v)
        return v

    def invert(self, v: int) -> int:
        v = self._once(v, -1)
        while v >= self.n:
            v = self._once(v, -1)
        return v

    def walk(self) -> int:
        """Most steps that any value inside needs after its first step."""
        a, b = self.sides
        longest = 0
        for v in range(self.n, a * b):
            steps = 1
            while (v := self._once(v)) >= self.n:
                steps += 1
            longest = max(longest, steps)
        return longest

    def column(self, v: Column) -> Column:
        """The permuted value of a long column with values 0..n-1."""
        a, b = self.sides
        keys = F.array(*[F.struct(F.lit(k1).alias("k1"), F.lit(k2).alias("k2"),
                                  F.lit(r % 2 == 0).alias("even"))
                         for r, (k1, k2) in enumerate(self.keys)])

        def keyed(x: Column, k: Column) -> Column:
            f = (x * k["k1"] + k["k2"]) % F.lit(PRIME)
            return F.element_at(F.transform(F.array(f), lambda y: y * y % F.lit(PRIME)), 1)

        def step(s: Column, k: Column) -> Column:
            left, right = s["l"], s["r"]
            return F.struct(
                F.when(k["even"], (left + keyed(right, k)) % F.lit(a)).otherwise(left).alias("l"),
                F.when(k["even"], right).otherwise((right + keyed(left, k)) % F.lit(b)).alias("r"))

        def once(x: Column) -> Column:
            right = x % F.lit(b)
            start = F.struct(((x - right) / F.lit(b)).cast("long").alias("l"), right.alias("r"))
            return F.aggregate(keys, start, step, lambda s: s["l"] * F.lit(b) + s["r"])

        out = once(v)
        steps = self.walk()
        if steps:
            out = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), out,
                              lambda x, _: F.when(x < F.lit(self.n), x).otherwise(once(x)))
        return out


def numbered(df: DataFrame, number: str = "row_number", buckets: int = 4096) -> DataFrame:
    """Adds a gapless global row number (long), the same for equal tables however they are split.

    Rows are counted per distinct row and scan partition first, so that a row repeated any number
    of times is one row of the sort; equal rows get neighbouring numbers. Nulls are values. An
    empty table stays empty. A column named like ``number`` is replaced.
    """
    df = df.drop(number)
    cols = df.columns
    keys = [F.col(f"`{c}`") for c in cols]
    counted = df.groupBy(*keys, F.spark_partition_id().alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    counted = counted.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (counted.groupBy("__bucket").agg(F.sum("__n").alias("__total"))  # at most `buckets` rows
              .select(F.col("__bucket").alias("__b"),
                      F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__start")))
    inside = Window.partitionBy("__bucket").orderBy(*keys, "__part").rowsBetween(Window.unboundedPreceding, -1)
    return (counted.withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
            .join(F.broadcast(starts), F.col("__bucket") == F.col("__b"))
            .select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__k"),
                    "__start", "__before")
            .select(*keys, (F.col("__start") + F.col("__before") + F.col("__k")).alias(number)))


def shard_rows(df: DataFrame, shards: int, seed: int = 0, buckets: int = 4096) -> DataFrame:
    """Adds ``row_number``, ``position``, ``shard`` (int) and ``slot`` (long) to every row.

    ``df`` should hold keys and measures, not texts: its rows are shuffled once, its row count is
    taken by one job. Columns with these four names are replaced. With fewer rows than shards some
    shards are empty; null values are allowed everywhere.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    df = df.drop("row_number", "position", "shard", "slot")
    n = df.count()
    position = Permutation(max(n, 1), seed).column(F.col("row_number"))
    return (numbered(df, buckets=buckets)
            .withColumn("position", position)
            .withColumn("shard", F.pmod("position", F.lit(shards)).cast("int"))
            .withColumn("slot", F.floor((F.col("position") - F.col("shard")) / F.lit(shards)).cast("long")))
