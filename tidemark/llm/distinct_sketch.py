"""Distinct counts over huge identifier sets: mergeable registers on a logarithmic scale of tunable base.

An identifier is hashed once; part of the hash picks one of ``m`` registers, the rest gives an exponential variate E.
The register keeps the greatest ``floor(1 - log_base(E / A))``, so two sketches merge by maximum and the sketch of a
union is the maximum of the sketches.  Only touched registers are rows, so a small set costs as many rows as it has
identifiers and a huge one never more than ``m``: the maximum per (set, register) is a hash aggregate that Spark
combines on the map side.

Estimates are maximum likelihood.  One set: with u the hash fraction of a register (1 if untouched), the rate that
maximizes the likelihood of the smallest fractions is ``touched / sum(u)``, so the count is ``m * touched / sum(u)``.
Two sets: given both counts, the numbers of registers where the first, the second or neither is greater have a
multinomial likelihood in the Jaccard index, which is concave and solved by bisection.

The relative standard error of a count is at most ``1 / sqrt(m)`` (1.6 % for m = 4096) and ``1 / sqrt(2 m)`` for sets
much smaller than m.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import lookup_join, salted_join
from tidemark.session import materialize, send_by_value

A = 20.0  # a variate beyond A (probability e**-20) still gets register value 1
FRACTION_BITS = 48
SMALL = 20_000  # rows of a table that may be broadcast


@dataclass(frozen=True)
class Sketch:
    """Parameters that sets must share to be merged or compared."""

    registers: int = 4096
    base: float = 1.001

    def __post_init__(self) -> None:
        if self.registers < 16 or self.registers & (self.registers - 1) or self.registers > 1 << 16:
            raise ValueError("registers must be a power of two from 16 to 65536")
        if not 1 < self.base <= 2:
            raise ValueError("base must lie in (1, 2]")

    @property
    def error(self) -> float:
        """Relative standard error of a count."""
        return self.registers**-0.5

    def register(self, item: Column) -> Column:
        return F.xxhash64(item).bitwiseAND(self.registers - 1).cast("int")

    def value(self, item: Column) -> Column:
        fraction = (F.shiftrightunsigned(F.xxhash64(item), 64 - FRACTION_BITS) + F.lit(0.5)) / F.lit(float(1 << FRACTION_BITS))
        level = F.floor(F.lit(1.0) - F.log(-F.log1p(-fraction) / A) / F.lit(float(np.log(self.base))))
        return F.greatest(level, F.lit(1)).cast("int")

    def fraction(self, value: Column) -> Column:
        """Hash fraction in the middle of a register value's interval."""
        return F.lit(1.0) - F.exp(-F.lit(A * (1 + self.base) / 2) * F.exp(-value * F.lit(float(np.log(self.base)))))


def sketch(rows: DataFrame, keys: Sequence[str], item: str, s: Sketch = Sketch()) -> DataFrame:
    """(keys, register, value) of each set.  Null items are not counted; a null key is a key of its own."""
    return rows.where(F.col(item).isNotNull()).groupBy(*keys, s.register(F.col(item)).alias("register")).agg(F.max(s.value(F.col(item))).alias("value"))


def merge(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of sets: the sketches of finer keys (or of other days, runs, clusters) merged to ``keys``."""
    return sketches.groupBy(*keys, "register").agg(F.max("value").alias("value"))


def estimate(sketches: DataFrame, keys: Sequence[str], s: Sketch = Sketch()) -> DataFrame:
    """(keys, estimate, standard_error) per set."""
    u, m = s.fraction(F.col("value")), s.registers
    sums = sketches.groupBy(*keys).agg(F.count("*").alias("_v"), F.sum(u).alias("_u"))
    count = F.col("_v") / ((F.col("_u") + m - F.col("_v")) / m)
    # Far below m registers only collisions hide items (variance n^2 / 2m); a full sketch has variance n^2 / m.
    n = F.col("estimate")
    return sums.select(*keys, count.alias("estimate")).withColumn("standard_error", F.sqrt(n * (n + 1) * (1 + F.least(n / (2 * m), F.lit(1.0))) / (2 * m)))


def jaccard_ml(n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray, equal: np.ndarray, base: float) -> np.ndarray:
    """Maximum likelihood Jaccard index per row, by bisection on the derivative of the concave log-likelihood."""
    total = np.maximum(n_a + n_b, 1e-300)
    u, v = n_a / total, n_b / total
    most = np.minimum(np.divide(u, v, out=np.ones_like(u), where=v > 0), np.divide(v, u, out=np.ones_like(u), where=u > 0))
    step = 1e-9

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)
        hi, lo = p(u - v * j), p(v - u * j)
        eps = 1e-300
        return above * np.log(hi + eps) + below * np.log(lo + eps) + equal * np.log(np.clip(1 - hi - lo, 0, 1) + eps)

    low, high = np.zeros_like(u), np.clip(most, 0, 1)
    for _ in range(50):
        mid = (low + high) / 2
        rising = log_likelihood(np.minimum(mid + step, high)) > log_likelihood(np.maximum(mid - step, 0))
        low, high = np.where(rising, mid, low), np.where(rising, high, mid)
    return (low + high) / 2


CLOSED_LIST = 256  # up to as many members the registers of a key meet in one row; beyond, by a join


def _tally_by_rows(sketches: DataFrame, keys: Sequence[str], member: str, members: list) -> DataFrame:
    """(keys, a, b, above, below, equal) for a closed list of members: a row per register holds them all."""
    keys, names = list(keys), [str(x) for x in members]
    number = F.array_position(F.array(*[F.lit(x) for x in members]), F.col(member)).cast("int") - 1
    wide = sketches.where(F.col(member).isNotNull()).groupBy(*keys, "register").agg(F.collect_list(F.struct(number.alias("m"), F.col("value").alias("v"))).alias("_x"))
    wide = wide.select(*keys, F.col("_x.m").alias("_m"), F.col("_x.v").alias("_v"))
    n = len(members)
    first, second = np.triu_indices(n, 1)
    step = max(1, 4_000_000 // (n * n))  # registers compared together

    def tally(batches):
        """Per batch and key: for every two members the registers where the first, the second or neither is greater."""
        for batch in batches:
            for key, rows in batch.groupby(keys, dropna=False, sort=False) if keys else [((), batch)]:
                counts = np.zeros((3, len(first)), dtype=np.int64)
                for i in range(0, len(rows), step):
                    some = rows.iloc[i : i + step]
                    lengths = some["_m"].map(len).to_numpy()
                    grid = np.zeros((len(some), n), dtype=np.int32)
                    grid[np.repeat(np.arange(len(some)), lengths), np.concatenate(some["_m"].to_numpy())] = np.concatenate(some["_v"].to_numpy())
                    a, b = grid[:, first], grid[:, second]
                    counts += np.stack([(a > b).sum(0), (a < b).sum(0), ((a == b) & (a > 0)).sum(0)])
                key = key if isinstance(key, tuple) else (key,)
                yield pd.DataFrame({**{k: [v] * len(first) for k, v in zip(keys, key, strict=True)}, "_a": first.astype("int32"), "_b": second.astype("int32"), "above": counts[0], "below": counts[1], "equal": counts[2]})

    key_types = ", ".join(f"`{k}` {t}" for k, t in wide.select(*keys).dtypes)
    parts = wide.mapInPandas(tally, f"{key_types + ', ' if keys else ''}_a int, _b int, above long, below long, equal long")
    sums = parts.groupBy(*keys, "_a", "_b").agg(*[F.sum(c).alias(c) for c in ("above", "below", "equal")])
    shown = F.array(*[F.lit(x) for x in names])
    return sums.select(*keys, shown[F.col("_a")].alias("a"), shown[F.col("_b")].alias("b"), "above", "below", "equal")


def _tally_by_join(sketches: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """The same for any number of members: two sets meet in the registers both touched, all others follow from how many
    registers each touched.  Sets that share no register are left out: nothing speaks for an overlap."""
    keys = list(keys)
    named = sketches.where(F.col(member).isNotNull()).select(*keys, F.col(member).cast("string").alias("_m"), "register", "value")
    one = named.withColumn("_k", F.xxhash64(*keys) if keys else F.lit(0)).drop(*keys)
    left, right = one.withColumnsRenamed({"_m": "a", "value": "_va"}), one.withColumnsRenamed({"_m": "b", "value": "_vb"})
    met = left.join(right, ["_k", "register"]).where("a < b").groupBy("_k", "a", "b").agg(F.count_if(F.col("_va") > F.col("_vb")).alias("_gt"), F.count_if(F.col("_va") < F.col("_vb")).alias("_lt"), F.count_if(F.col("_va") == F.col("_vb")).alias("equal"))
    touched = named.withColumn("_k", F.xxhash64(*keys) if keys else F.lit(0)).groupBy("_k", *keys, "_m").agg(F.count("*").alias("_n"))
    met = met.join(touched.withColumnsRenamed({"_m": "a", "_n": "_na"}), ["_k", "a"]).join(touched.select("_k", F.col("_m").alias("b"), F.col("_n").alias("_nb")), ["_k", "b"])
    common = F.col("_gt") + F.col("_lt") + F.col("equal")
    return met.select(*keys, "a", "b", (F.col("_gt") + F.col("_na") - common).alias("above"), (F.col("_lt") + F.col("_nb") - common).alias("below"), "equal")


def compare(sketches: DataFrame, keys: Sequence[str], member: str, s: Sketch = Sketch()) -> DataFrame:
    """Union, intersection and Jaccard index of every two sets that share ``keys``.

    ``member`` names the column that tells the sets apart.  Its values are meant to be few (a closed list such as event
    types): then the registers of one key meet in one row per register and no two sets are joined.  More than 256 members
    are compared by a join on the register, which gives the same numbers for all sets that share a register.
    Columns out: keys, a, b, count_a, count_b, union, intersection, jaccard, jaccard_error, union_error, intersection_error.

    The errors are standard errors.  Those of union and intersection are propagated from both counts, whose errors add
    up at worst (sets that overlap share registers), and from the Jaccard index, taken as one equal register off at least.
    """
    members = [r[0] for r in sketches.select(member).distinct().limit(CLOSED_LIST + 1).collect() if r[0] is not None]
    if len(members) > CLOSED_LIST:
        sums = _tally_by_join(sketches, keys, member)
    elif len(members) < 2:
        return sketches.sparkSession.createDataFrame([], f"{', '.join(f'`{n}` {t}' for n, t in sketches.select(*keys).dtypes) or '_none int'}, a string, b string, count_a double, count_b double, union double, intersection double, jaccard double, jaccard_error double, union_error double, intersection_error double")
    else:
        sums = _tally_by_rows(sketches, keys, member, sorted(members))
    keys = list(keys)
    counts = estimate(sketches.withColumn("_s", F.col(member).cast("string")), [*keys, "_s"], s)
    side = lambda x: counts.withColumnsRenamed({"_s": x, "estimate": f"count_{x}", "standard_error": f"_error_{x}", **{k: f"_{x}_{k}" for k in keys}})
    long = sums
    for x in ("a", "b"):
        c = side(x).withColumnRenamed(x, "_name")
        match = F.col(x) == F.col("_name")
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_{x}_{k}"))
        long = long.join(c, match).drop("_name", *[f"_{x}_{k}" for k in keys])
    base = s.base

    @F.pandas_udf("double")
    def solve(n_a: pd.Series, n_b: pd.Series, above: pd.Series, below: pd.Series, equal: pd.Series) -> pd.Series:
        return pd.Series(jaccard_ml(*[x.to_numpy("float64") for x in (n_a, n_b, above, below, equal)], base))

    solved = long.withColumn("jaccard", solve("count_a", "count_b", "above", "below", "equal"))
    both = F.col("count_a") + F.col("count_b")
    used = F.greatest(F.col("above") + F.col("below") + F.col("equal"), F.lit(1))
    j = F.col("jaccard")
    of_counts = (F.col("_error_a") + F.col("_error_b")) / (1 + j)
    of_index = both / ((1 + j) * (1 + j)) * F.sqrt((j * (1 - j) + 1 / used) / used)
    return solved.select(
        *keys, "a", "b", "count_a", "count_b",
        (both / (1 + F.col("jaccard"))).alias("union"),
        (both * F.col("jaccard") / (1 + F.col("jaccard"))).alias("intersection"),
        "jaccard",
        F.sqrt(F.col("jaccard") * (1 - F.col("jaccard")) / used).alias("jaccard_error"),
        F.hypot(of_counts, of_index).alias("union_error"),
        F.hypot(of_counts * j, of_index).alias("intersection_error"),
    )


def cube_estimates(rows: DataFrame, dimensions: Sequence[str], item: str, s: Sketch = Sketch()) -> DataFrame:
    """Distinct items per dimension and every combination of dimensions, from one pass over the rows.

    The finest sketches are made and written once; every coarser grouping merges the smallest of the next finer ones by
    maximum, so only registers that are still apart are moved again.  A dimension that is not part of
    a grouping is null there, and ``grouping`` names the ones that are, joined by '+'.
    """
    made = {tuple(dimensions): materialize(sketch(rows, dimensions, item, s), "finest-sketch")}
    types = dict(rows.dtypes)
    parts = []
    for n in range(len(dimensions), 0, -1):
        for c in combinations(dimensions, n):
            if c not in made:  # the smallest finer sketch holds all that is needed
                parents = [p for p in made if len(p) == n + 1 and set(c) < set(p)]
                parent = min(parents, key=lambda p: _stored_rows(made[p])) if len(parents) > 1 else parents[0]
                made[c] = merge(made[parent], list(c))
                if n > 1:
                    made[c] = materialize(made[c], "sketch")
            one = estimate(made[c], list(c), s)
            parts.append(one.select(F.lit("+".join(c)).alias("grouping"), *[(F.col(d) if d in c else F.lit(None).cast(types[d])).alias(d) for d in dimensions], "estimate", "standard_error"))
    return reduce(DataFrame.unionByName, parts)


def _stored_rows(table: DataFrame) -> int:
    """Rows of a written table, from the footers."""
    return table.count()


def doubtful_rows(estimates: DataFrame, published: str, tolerance: float, sigmas: float = 6.0) -> DataFrame:
    """Rows whose published count may differ from the true one by more than ``tolerance``, given the stated error.

    Only these need an exact check.  A small set is underestimated by whole items when two of its items share a
    register, so the upper margin is one item more.
    """
    margin = F.col("standard_error") * sigmas
    low, high = F.greatest(F.col("estimate") - margin - 0.01, F.lit(0.0)), F.when(F.col("estimate") > 0, F.col("estimate") + margin + 1).otherwise(0.0)
    surely_fine = (F.col(published) >= high * (1 - tolerance)) & (F.col(published) <= low * (1 + tolerance))
    return estimates.where(~F.coalesce(surely_fine, F.lit(False)))


def wrong_counts(events: DataFrame, published: DataFrame, keys: Sequence[str], item: str, column: str, tolerance: float, s: Sketch = Sketch(1 << 16)) -> DataFrame:
    """Published rows whose distinct count is off by more than ``tolerance`` of the true count.

    ``events`` and ``published`` share ``keys``.  The sketches pick the doubtful rows; those alone are counted exactly.
    A row without any event is off unless it publishes 0; rows with a null key or null count are left out.
    """
    counts = published.select(*keys, column).dropna()
    guess = estimate(sketch(events, keys, item, s), keys, s)
    guessed = counts.join(guess, list(keys), "left").fillna({"estimate": 0.0, "standard_error": 0.0})
    doubtful = materialize(doubtful_rows(guessed, column, tolerance).select(*keys, column), "doubtful")
    asked = doubtful.select(*keys).distinct()
    pairs = events.where(F.col(item).isNotNull()).select(*keys, item)
    if asked.limit(SMALL + 1).count() <= SMALL:
        pairs = pairs.join(F.broadcast(asked), list(keys), "left_semi").distinct()
    else:  # too many to broadcast: reduce first, so a hot set is spread by its items
        pairs = salted_join(pairs.distinct(), asked, keys, [item])
    exact = pairs.groupBy(*keys).agg(F.count("*").alias("true_count"))
    checked = doubtful.join(exact, list(keys), "left").fillna({"true_count": 0})
    return checked.where(F.abs(F.col(column) - F.col("true_count")) > F.lit(tolerance) * F.col("true_count")).select(*keys, column, "true_count")


def in_windows(events: DataFrame, windows: DataFrame, day: str = "event_date") -> DataFrame:
    """Each event once per distinct (window_start, window_end) that holds its day, end excluded.

    Windows are turned into days, so the join is an equi-join; empty and open windows hold no day.
    """
    days = windows.select("window_start", "window_end").distinct().where("window_start < window_end")
    days = days.select("window_start", "window_end", F.explode(F.sequence("window_start", F.date_sub("window_end", 1))).alias(day))
    return lookup_join(events.drop("window_start", "window_end"), materialize(days, "windows"), [day], events.columns)


send_by_value(__name__)
