"""Tools against keys that hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import is_small, materialize

HASH_BUCKETS = 1 << 14


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join whose hot left keys are spread over ``salts`` tasks.

    ``right`` must be the compact side (one row per key, already aggregated): it is repeated ``salts`` times.
    ``spread`` names left columns that differ between rows of a hot key.  ``how`` is inner or left.
    Null keys never match, as in any equi-join.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left")
    l = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [*on, "_salt"], how).drop("_salt")


def lookup_join(left: DataFrame, table: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner", max_rows: int = 20_000) -> DataFrame:
    """Join with a table that is small by nature: broadcast if a count says so, else salted, never trusted to be small."""
    if is_small(table, max_rows):
        return left.join(F.broadcast(table), list(on), how)
    return salted_join(left, table, on, spread, how)


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = 1 / 256) -> list[tuple]:
    """Exactly the keys that hold more than ``share`` of the rows: at most 1/share of them, on the driver.

    Two narrow passes.  The first counts hashed buckets (a fixed number of rows), the second counts the keys of
    the heavy buckets only, and is skipped when no bucket is heavy.  Rows with a null in a key are not counted.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    rows = df.select(*keys).dropna()
    bucket = F.pmod(F.xxhash64(*keys), F.lit(HASH_BUCKETS)).cast("int")
    counts = {r["b"]: r["n"] for r in rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()}
    least = share * sum(counts.values())
    hot = [b for b, n in counts.items() if n > least]
    # With few distinct rows every bucket looks heavy; a key below a thousand rows never needs splitting.
    hot = [b for b in hot if counts[b] > 1000]
    if not hot:
        return []
    found = rows.where(bucket.isin(hot)).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > F.lit(max(least, 1000)))
    return [tuple(r[k] for k in keys) for r in found.collect()]


def is_one_of(keys: Sequence[str], values: Sequence[tuple]) -> Column:
    """True where the key columns equal one of a short list of tuples."""
    test = F.lit(False)
    for value in values:
        one = F.lit(True)
        for name, x in zip(keys, value, strict=True):
            one = one & F.col(name).eqNullSafe(F.lit(x))
        test = test | one
    return test


def eager_join(left: DataFrame, right: DataFrame, on: Sequence[str], keep: Sequence[str] = (), left_sums: Sequence[str] = (), right_sums: Sequence[str] = (), left_rows: str | None = None, right_rows: str | None = None, small_right: int | None = None) -> DataFrame:
    """Aggregates of an inner join without ever forming the joined rows.

    Both inputs are reduced by the join key first (map-side combine, so a hot key is one row per task), the compact
    states are joined, and the results of the full join follow by algebra: its row count is the product of the two
    counts, a sum over left columns is the left sum times the right count, and the other way round.
    ``keep``: further left columns to group by.  ``left_rows``, ``right_rows``: the column that says how many rows a row
    of an input stands for, where it was reduced before.  ``small_right``: the number of keys of the right side, where it
    is fixed by the call: that many rows are broadcast, so no task gets all states of a key.
    Columns out: on, keep, rows, right_rows, the sums (as ``left_x``/``right_x``).
    """
    count = lambda rows: F.sum(rows) if rows else F.count("*")
    l = left.groupBy(*on, *keep).agg(count(left_rows).alias("_l"), *[F.sum(c).alias(f"_l_{c}") for c in left_sums])
    r = right.groupBy(*on).agg(count(right_rows).alias("_r"), *[F.sum(c).alias(f"_r_{c}") for c in right_sums])
    return l.join(r if small_right is None else F.broadcast(r), list(on)).select(
        *on,
        *keep,
        (F.col("_l").cast("decimal(18,0)") * F.col("_r").cast("decimal(18,0)")).alias("rows"),
        F.col("_r").alias("right_rows"),
        *[(F.col(f"_l_{c}") * F.col("_r")).alias(f"left_{c}") for c in left_sums],
        *[(F.col(f"_r_{c}") * F.col("_l")).alias(f"right_{c}") for c in right_sums],
    )


def running_max(df: DataFrame, key: str, order: str, value: str, out: str, block: int = 1024) -> DataFrame:
    """Greatest ``value`` of the rows of the same key with a smaller ``order``; null for the first.

    A two-level scan: the maxima of blocks of ``block`` consecutive orders are scanned per key, then the rows inside
    each block.  So no task holds more than a block of rows, or one row per block, of a hot key.  ``df`` has one row
    per (key, order); order is a whole number.
    """
    rows = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    before_block = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy(key, "_block").agg(F.max(value).alias("_m")).select(key, "_block", F.max("_m").over(before_block).alias("_before"))
    before_row = W.partitionBy(key, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.max(value).over(before_row))
    return inside.join(blocks, [key, "_block"], "left").withColumn(out, F.greatest("_before", "_inside")).drop("_block", "_before", "_inside")


def rank_in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, blocks: int = 64) -> DataFrame:
    """Row number within the key by ``order`` (no nulls in it), from 1; rows that tie are numbered in any order.

    ``df`` is a written table.  Rows are counted by key, order and a block that splits equal rows, ranked inside, and
    shifted by the counts before: a task holds a block of equal rows, or one row per different row of a key.
    """
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.withColumns(dict(zip(names, order, strict=True))).withColumn("_place", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("_block", F.pmod(F.xxhash64("_place"), F.lit(blocks))), "ranked")  # places must not change
    spot = [*names, "_block"]
    counts = rows.groupBy(*keys, *spot).agg(F.count("*").alias("_c"))
    before = W.partitionBy(*keys).orderBy(*spot).rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(*keys, *spot, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_shift"))
    inside = rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys, *spot).orderBy("_place")))
    return inside.join(shifts, [*keys, *spot]).withColumn(out, (F.col("_r") + F.col("_shift")).cast("long")).select(*df.columns, out)
