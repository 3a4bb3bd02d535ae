"""Joining wide rows with a dimension whose size is measured, not estimated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 * 1024 * 1024
SALTS = 32


def is_small(dim: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a dimension has at most so many rows and bytes, counted over one row more than allowed.

    Catalyst's estimate of a derived plan follows the files it comes from: it can be far too
    large (an aggregate) or too small (compressed or exploded rows).
    """
    few = dim.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("n"))
    told = few.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size")).first()
    return told["rows"] <= rows and (told["size"] or 0) <= size


def join_dimension(
    wide: DataFrame, dim: DataFrame, on: list[str], spread: str, how: str = "inner", small: bool | None = None,
    measure: DataFrame | None = None,
) -> DataFrame:
    """Inner or left join of rows that carry text with a dimension keyed by ``on``.

    A dimension measured as small is broadcast, so texts stay where they were read.  A larger
    one is shuffled, each row copied ``SALTS`` times, and a key's wide rows are dealt over the
    copies by ``spread`` (a high-cardinality column): a key holding a third of all rows is
    shared by SALTS tasks instead of landing on one.  Joins of narrow rows need none of this:
    they are left to adaptive execution.  ``measure`` are rows that hold all the dimension holds and
    are cheaper to get, such as the ones it gathers.
    """
    if is_small(dim if measure is None else measure) if small is None else small:
        return wide.join(F.broadcast(dim), on, how)
    salted = wide.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
