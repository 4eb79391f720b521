"""Mixing sources to target weights by capped water-filling, and the mixed records themselves."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.skew import lookup_join
from tidemark.session import materialize, send_by_value


@dataclass
class Share:
    """What one source gives to one mix."""

    mix_id: str
    source: str
    target_share: float
    source_tokens: int
    max_repeats: int
    wanted_tokens: float  # its share of the budget, before any redistribution
    given_tokens: float = 0.0
    clamped_round: int | None = None  # 0: its cap lies below its own share; later: below what others passed on

    @property
    def cap(self) -> int:
        return self.source_tokens * self.max_repeats

    @property
    def repeats(self) -> float:
        return self.given_tokens / self.source_tokens if self.source_tokens else 0.0


def water_fill(shares: list[Share], budget: float) -> None:
    """Fill the sources of one mix in proportion to their targets, no source beyond its cap.

    Sources whose level would exceed their cap are clamped to it and leave; what they could not take is spread over
    the rest in proportion to their targets, until nobody is clamped.  At most as many rounds as sources.  If all are
    clamped the budget cannot be reached.
    """
    free, rest, turn = list(shares), float(budget), 0
    while free:
        weight = sum(s.target_share for s in free)
        if weight <= 0:
            return
        over = [s for s in free if s.cap < s.target_share / weight * rest]
        for s in over:
            s.given_tokens, s.clamped_round = float(s.cap), turn
            rest -= s.cap
        if not over:
            for s in free:
                s.given_tokens = s.target_share / weight * rest
            return
        free, turn = [s for s in free if s not in over], turn + 1


def plan_mixes(targets: Iterable[tuple[str, str, float, int]], tokens: dict[str, int], budget: float) -> list[Share]:
    """Shares of every mix.  Targets are (mix_id, source, weight, max_repeats); weights count relative to their mix's
    sum.  A source without documents has 0 tokens; null or negative weights and repeats count as 0; a source listed
    twice in a mix counts with its summed weight and its greatest repeats."""
    merged: dict[tuple[str, str], list[float]] = {}
    for mix, source, weight, repeats in targets:
        entry = merged.setdefault((mix, source), [0.0, 0])
        entry[0] += max(weight or 0.0, 0.0)
        entry[1] = max(entry[1], repeats or 0)
    out: list[Share] = []
    for mix in dict.fromkeys(m for m, _ in merged):
        rows = {s: v for (m, s), v in merged.items() if m == mix}
        total = sum(w for w, _ in rows.values())
        shares = [Share(mix, s, w / total if total else 0.0, tokens.get(s, 0), int(r), budget * (w / total if total else 0.0)) for s, (w, r) in rows.items()]
        water_fill(shares, budget)
        out += shares
    return out


PLAN = "mix_id string, source string, target_share double, source_tokens long, max_repeats int, wanted_tokens double, given_tokens double, repeats double, whole_repeats int, part_repeat double, clamped_round int"


def source_tokens(documents: DataFrame, tokens: Column) -> DataFrame:
    return documents.groupBy("source").agg(F.sum(tokens).alias("tokens"))


def mix_plan(documents: DataFrame, targets: DataFrame, tokens: Column) -> tuple[DataFrame, float]:
    """(plan with a row per mix and source, budget).  The budget of every mix is the tokens of all documents.

    Any number of mixes: each is filled on its own, from one row per source it names.
    """
    by_source = materialize(source_tokens(documents, tokens), "source-tokens")
    budget = float(by_source.agg(F.sum("tokens")).first()[0] or 0)
    none = F.lit("\x00null")  # a null source or mix is a name of its own
    rows = targets.join(by_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select("mix_id", "source", "target_weight", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    rows = rows.select(F.coalesce("mix_id", none).alias("mix_id"), F.coalesce("source", none).alias("source"), "target_weight", "max_repeats", "tokens")

    def fill(mix: pd.DataFrame) -> pd.DataFrame:
        control = [(m, s, None if pd.isna(w) else float(w), None if pd.isna(r) else int(r)) for m, s, w, r in zip(mix["mix_id"], mix["source"], mix["target_weight"], mix["max_repeats"], strict=True)]
        shares = plan_mixes(control, {s: int(n) for s, n in zip(mix["source"], mix["tokens"], strict=True)}, budget)
        data = [(s.mix_id, s.source, s.target_share, s.source_tokens, s.max_repeats, s.wanted_tokens, s.given_tokens, s.repeats, int(s.repeats), s.repeats - int(s.repeats), s.clamped_round) for s in shares]
        return pd.DataFrame(data, columns=[c.split()[0] for c in PLAN.split(", ")]).astype({"clamped_round": "Int32"})

    filled = rows.groupBy("mix_id").applyInPandas(fill, PLAN)
    named = [F.nullif(c, none).alias(c) for c in ("mix_id", "source")]
    return materialize(filled.select(*named, *[c for c in filled.columns if c not in ("mix_id", "source")]), "mix-plan"), budget


def _with_copies(documents: DataFrame, plan: DataFrame, key: str, seed: int) -> DataFrame:
    """Documents by mix with ``_copies``: the whole repeats, and one more for a seeded part of them."""
    wanted = plan.where("given_tokens > 0").select("mix_id", "source", "whole_repeats", "part_repeat")
    joined = lookup_join(documents, wanted, ["source"], [key])
    draw = F.pmod(F.xxhash64(F.lit(seed), "mix_id", key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return joined.withColumn("_copies", F.col("whole_repeats") + F.when(draw < F.col("part_repeat"), 1).otherwise(0)).where("_copies > 0")


def mixed_records(documents: DataFrame, plan: DataFrame, key: str = "doc_id", seed: int = 20260105) -> DataFrame:
    """(mix_id, key, source, copy): every document of a source its whole number of times, and a seeded part of them once more.

    Whether a document gets the extra copy depends on the seed, the mix and its key only, so the sample is the same
    on any cluster.  Documents without a source belong to none.
    """
    some = _with_copies(documents.select(key, "source"), plan, key, seed)
    return some.select("mix_id", key, "source", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))


def reached_shares(documents: DataFrame, targets: DataFrame, tokens: Column, key: str = "doc_id", seed: int = 20260105) -> DataFrame:
    """Per mix and source: the target share and the share the sampled records reach, summed from the records."""
    plan, _ = mix_plan(documents, targets, tokens)
    some = _with_copies(documents.select(key, "source", tokens.alias("_tokens")), plan, key, seed)
    got = some.groupBy("mix_id", "source").agg(F.sum(F.col("_tokens") * F.col("_copies")).alias("reached_tokens"))
    both = plan.join(got, ["mix_id", "source"], "left").fillna(0, ["reached_tokens"])
    total = F.sum("reached_tokens").over(W.partitionBy("mix_id"))  # a row per source of the mix
    return both.withColumn("reached_share", F.coalesce(F.try_divide("reached_tokens", total), F.lit(0.0)))


send_by_value(__name__)
