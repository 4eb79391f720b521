"""Laying texts into containers of fixed capacity by patterns of lengths.

Only the histogram of lengths reaches the driver: at most ``capacity`` counts, whatever the number of texts.  Patterns of
few lengths that fill a container are enumerated over quantized lengths, their repeat counts are fitted to the histogram
by non-negative least squares and rounded down, and what is left (the residuals, and the many short texts) is packed
best-fit into the space the patterns left open, then into new containers: whole groups of equal containers at a time.
The result is a list of segments "of length L, the texts ranked a to b go to containers c, c+1, ..."; its size depends on
the capacity, not on the data.  The texts find their segment by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import materialize, send_by_value

BLOCK_ROWS = 100_000  # pieces that one task ranks


@dataclass(frozen=True)
class Segment:
    """Texts of one length with ranks from ``first`` on, ``count`` of them, ``each`` to a container, containers from ``container`` on."""

    length: int
    first: int
    count: int
    container: int
    each: int


def optimality_gap(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> float:
    """How far x >= 0 is from the least |a x - b|, relative to a' b: at the solution no gradient points below zero, and none
    is left where x is above zero (the conditions of Karush, Kuhn and Tucker)."""
    g = a.T @ (a @ x - b)
    return float(max(np.maximum(-g, 0).max(initial=0), np.abs(np.minimum(g, x)).max(initial=0)) / max(np.abs(a.T @ b).max(initial=0), 1e-300))


def nnls(a: np.ndarray, b: np.ndarray, gap: float = 2e-4, most_rounds: int = 20_000) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient: min |a x - b|, x >= 0, until ``gap`` is reached.

    The step is safe: for a matrix without negative entries no eigenvalue exceeds the greatest ratio (G v)_i / v_i.
    The acceleration starts anew whenever it points uphill.
    """
    gram, target = a.T @ a, a.T @ b
    v = np.ones(a.shape[1])
    for _ in range(30):
        v = gram @ v + 1e-12
        v /= np.linalg.norm(v)
    bound = float(np.abs(gram).sum(axis=1).max(initial=0))
    if (a >= 0).all():
        bound = min(bound, float((gram @ v / v).max(initial=0)))
    step = 1.0 / max(bound, 1e-300)
    x = np.zeros(a.shape[1])
    y, t = x.copy(), 1.0
    scale = max(np.abs(target).max(initial=0), 1e-300)
    for turn in range(most_rounds):
        new = np.maximum(0.0, y - step * (gram @ y - target))
        if (y - new) @ (new - x) > 0:
            y, t = new.copy(), 1.0
        else:
            t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, t = new + (t - 1) / t_next * (new - x), t_next
        x = new
        if turn % 20 == 19:
            g = gram @ x - target
            if max(np.maximum(-g, 0).max(initial=0), np.abs(np.minimum(g, x)).max(initial=0)) <= gap * scale:
                break
    return x


def patterns(bins: int, most: int = 3) -> list[tuple[int, ...]]:
    """Non-increasing tuples of up to ``most`` quantized lengths that fill ``bins`` exactly."""
    out: list[tuple[int, ...]] = [(bins,)]
    out += [(i, bins - i) for i in range((bins + 1) // 2, bins)]
    if most >= 3:
        out += [(i, j, bins - i - j) for i in range((bins + 2) // 3, bins - 1) for j in range((bins - i + 1) // 2, min(i, bins - i - 1) + 1)]
    return out


def best_plan(histogram: dict[int, int], capacity: int, grids: tuple[int, ...] = (64, 128)) -> tuple[list[Segment], int]:
    """The plan with the fewest containers over several grids of quantized lengths."""
    return min((plan(histogram, capacity, bins) for bins in grids), key=lambda p: p[1])


def plan(histogram: dict[int, int], capacity: int, bins: int = 128, most: int = 3) -> tuple[list[Segment], int]:
    """(segments, number of containers) for texts of the given lengths, each from 1 to ``capacity``."""
    if any(not 1 <= length <= capacity for length in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    left = dict(histogram)
    taken: dict[int, int] = {}
    out: list[Segment] = []
    containers = 0
    # Open groups by free space: free -> list of (first container, count).
    free_space: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}

    def open_group(free: int, first: int, count: int) -> None:
        if free > 0 and count > 0:
            if free not in groups:
                groups[free] = []
                insort(free_space, free)
            groups[free].append((first, count))

    def put(length: int, container: int, count: int, each: int = 1) -> None:
        first = taken.get(length, 0)
        out.append(Segment(length, first, count * each, container, each))
        taken[length] = first + count * each
        left[length] -= count * each

    # Fit patterns over quantized lengths: a quantum holds the lengths that round up to it.
    width = max(1, -(-capacity // bins))
    quanta = -(-capacity // width)
    b = np.zeros(quanta)
    for length in left:
        b[-(-length // width) - 1] += left[length]
    there = sorted(left)

    def longest(room: int, picked: list[int]) -> int | None:
        """The longest length up to ``room`` of which texts are left besides the picked ones."""
        at = bisect_right(there, room) - 1
        while at >= 0 and left[there[at]] - picked.count(there[at]) <= 0:
            if left[there[at]] <= 0:
                there.pop(at)
            at -= 1
        return there[at] if at >= 0 else None

    shapes = patterns(quanta, most)
    if b.any():
        a = np.zeros((quanta, len(shapes)))
        for k, shape in enumerate(shapes):
            for q in shape:
                a[q - 1, k] += 1
        weight = np.arange(1, quanta + 1, dtype=float)[:, None] ** 0.5  # a long text that does not fit costs more
        scale = max(b.max(), 1.0)
        repeats = np.floor(nnls(a * weight, b / scale * weight[:, 0]) * scale + 1e-6).astype(np.int64)
        for k in np.argsort(-np.array([max(s) for s in shapes]), kind="stable"):
            todo = int(repeats[k])
            while todo > 0:
                picked: list[int] = []
                for q in shapes[k]:
                    # The pattern names the quantum; the last place takes the longest text that really fits.
                    room = capacity - sum(picked) if len(picked) + 1 == len(shapes[k]) else q * width
                    choice = longest(room, picked)
                    if choice is None or -(-choice // width) < q - (0 if len(picked) + 1 < len(shapes[k]) else 1):
                        break
                    picked.append(choice)
                if len(picked) < len(shapes[k]):
                    break
                n = min(todo, *[left[x] // picked.count(x) for x in picked])
                for x in set(picked):
                    put(x, containers, n, picked.count(x))
                open_group(capacity - sum(picked), containers, n)
                containers += n
                todo -= n
    # Residuals, longest first, into the tightest open space; equal containers are served together.
    for length in sorted(left, reverse=True):
        while left[length] > 0:
            at = bisect_left(free_space, length)
            if at < len(free_space):
                free = free_space[at]
                first, count = groups[free].pop()
                if not groups[free]:
                    del groups[free]
                    free_space.pop(at)
            else:
                free, first, count = capacity, containers, max(1, left[length] // (capacity // length))
                containers += count
            each = max(1, min(free // length, left[length] // count))
            n = min(count, left[length] // each)
            put(length, first, n, each)
            open_group(free - each * length, first, n)
            open_group(free, first + n, count - n)
    return out, containers


def text_pieces(texts: DataFrame, key: str, tokens: Column, capacity: int) -> DataFrame:
    """(key, piece, piece_start, length): one piece of a text that fits, else full pieces and a rest.

    Only a text larger than the container is cut.  Texts without tokens need no container and give no piece.
    """
    sized = texts.select(key, tokens.alias("_n")).where("_n > 0")
    pieces = sized.select(key, "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / capacity).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return pieces.select(key, "piece", start.alias("piece_start"), F.least(F.lit(capacity), F.col("_n") - start).cast("int").alias("length"))


def ranked(pieces: DataFrame, key: str, blocks: int) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0.

    A length may hold any share of the rows, so ranks are made in blocks: the pieces of a length are hashed to
    ``blocks`` blocks, counted per block, ranked inside their block, and shifted by the pieces of earlier blocks.
    """
    blocked = pieces.withColumn("_block", F.pmod(F.xxhash64(key, "piece"), F.lit(blocks)).cast("int"))
    counts = blocked.groupBy("length", "_block").agg(F.count("*").alias("_c"))
    before = W.partitionBy("length").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select("length", "_block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_shift"))
    inside = blocked.withColumn("_r", F.row_number().over(W.partitionBy("length", "_block").orderBy(key, "piece")) - 1)
    return inside.join(shifts, ["length", "_block"]).withColumn("rank", F.col("_r") + F.col("_shift")).drop("_r", "_shift", "_block")


def place(pieces: DataFrame, segments: list[Segment]) -> DataFrame:
    """The container of each ranked piece, looked up in the segments of its length."""
    ordered = sorted(segments, key=lambda s: (s.length, s.first))
    lengths, firsts, containers, each = (np.array([getattr(s, n) for s in ordered], dtype=np.int64) for n in ("length", "first", "container", "each"))

    @F.pandas_udf("long")
    def container_of(length: pd.Series, rank: pd.Series) -> pd.Series:
        of, r = length.to_numpy("int64"), rank.to_numpy("int64")
        at = np.empty(len(of), dtype=np.int64)
        for x in np.unique(of):
            low, high = np.searchsorted(lengths, [x, x + 1])
            mine = of == x
            at[mine] = low + np.searchsorted(firsts[low:high], r[mine], side="right") - 1
        return pd.Series(containers[at] + (r - firsts[at]) // each[at])

    return pieces.withColumn("container", container_of("length", "rank")).drop("rank")


def pack(texts: DataFrame, key: str, tokens: Column, capacity: int) -> DataFrame:
    """(key, piece, piece_start, length, container): every text with tokens, laid into containers of ``capacity``.

    Full pieces of cut texts are containers of their own by size; rows with a repeated key are texts of their own as
    long as they differ in piece order only by tie.  An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    pieces = text_pieces(texts, key, tokens, capacity)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    if not histogram:
        return pieces.withColumn("container", F.lit(None).cast("long"))
    segments, _ = best_plan(histogram, capacity)
    blocks = -(-max(histogram.values()) // BLOCK_ROWS)  # of the most frequent length
    return place(ranked(pieces, key, blocks), segments)


def pack_all(documents: DataFrame, targets: list[tuple[str, int]], tokens: Column, key: str = "doc_id") -> DataFrame:
    """``pack`` for each (container_kind, capacity); tokens are counted once."""
    sized = materialize(documents.select(key, tokens.alias("_tokens")), "token-counts")
    out = None
    for kind, capacity in targets:
        one = pack(sized, key, F.col("_tokens"), capacity).select(F.lit(kind).alias("container_kind"), F.lit(capacity).alias("capacity_tokens"), key, "piece", "piece_start", "length", "container")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no container kinds given")
    return out


def report(packed: DataFrame) -> DataFrame:
    """Per container kind: containers, tokens, share of the space left unused, and the fewest containers possible."""
    used = packed.groupBy("container_kind", "capacity_tokens", "container").agg(F.sum("length").alias("_used"))
    sums = used.groupBy("container_kind", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("_used").alias("tokens"), F.max("_used").alias("fullest"))
    space = F.col("containers") * F.col("capacity_tokens")
    return sums.withColumn("unused_share", 1 - F.col("tokens") / space).withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")))


send_by_value(__name__)
