"""Windows over a key in order of time, cut into pieces that different tasks work on.

A key with a large share of all rows would make one task sort them all. Here quantiles of time, the same for all keys, cut
every key's rows into pieces; windows run inside a piece, and what they must know of other pieces is carried over by a
table with one row for each key and piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = "_piece"


def below(x: Column, cuts: Sequence[int]) -> Column:
    """How many of the ascending cuts are below x, by halving; 0 for null."""
    if not cuts:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) < x, at + step).otherwise(at))


def cut(df: DataFrame, time: str, pieces: int | None = None) -> DataFrame:
    """df with the number of each row's piece by a timestamp column: rows of one time are in one piece, later times in the
    same or a later one. Null times are in the first. One pass over the column finds the cuts. As many pieces as a shuffle
    has partitions, unless given, 4,000 at most."""
    n = min(pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4000)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    found = df.agg(F.percentile_approx(micros, [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    return df.withColumn(PIECE, below(micros, sorted(set(found or []))))


def carried(parts: DataFrame, key: str, before: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    """parts, which has a row for each key and piece, with columns over the key's earlier and later pieces."""
    w = Window.partitionBy(key).orderBy(PIECE)
    earlier, later = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    return parts.withColumns({**{n: x.over(earlier) for n, x in before.items()}, **{n: x.over(later) for n, x in after.items()}})
