"""p3: sketches against exact counts and their stated errors."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_batch_operators import EVENTS, make_events
from test_entry import DATA, compare

from tidemark.llm import distinct_sketch


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(make_events(), EVENTS).cache()


@pytest.mark.parametrize("base", [1.001, 1.2, 2.0])
@pytest.mark.parametrize("n", [1, 50, 20_000])
def test_estimates_keep_to_their_error(spark, n, base):
    s = distinct_sketch.Sketch(1024, base)
    df = spark.range(8 * n).selectExpr("id % 8 as g", "id as x")
    out = distinct_sketch.estimate(distinct_sketch.sketch(df, ["g"], "x", s), ["g"], s).collect()
    errors = [(r.estimate - n) / max(r.standard_error, 1e-9) for r in out]
    assert max(map(abs, errors)) < 6
    assert abs(float(np.mean(errors))) < 2.5


def test_merged_sketches_equal_the_sketch_of_all(spark, events):
    whole = distinct_sketch.sketch(events, ["repo_id"], "actor_id")
    merged = distinct_sketch.merge(distinct_sketch.sketch(events, ["repo_id", "event_date"], "actor_id"), ["repo_id"])
    assert whole.select("repo_id", "register", "value").exceptAll(merged.select("repo_id", "register", "value")).isEmpty()
    cube = distinct_sketch.cube_estimates(events, ["event_date", "repo_id", "event_type"], "actor_id")
    assert cube.select("grouping").distinct().count() == 7
    truth = {r[0]: r[1] for r in events.where("actor_id is not null").groupBy("event_date").agg(F.countDistinct("actor_id")).collect()}
    got = {r.event_date: r.estimate for r in cube.where("grouping = 'event_date'").collect()}
    assert all(abs(got[d] - n) <= 1.5 for d, n in truth.items())


def test_joint_estimates_of_two_sets(spark):
    a = spark.range(0, 9000).selectExpr("'a' as name", "id as x")
    b = spark.range(6000, 12000).selectExpr("'b' as name", "id as x")
    r = distinct_sketch.compare(distinct_sketch.sketch(a.union(b), ["name"], "x"), [], "name").first()
    assert r.intersection == pytest.approx(3000, rel=0.12)
    assert r.union == pytest.approx(12000, rel=0.06)
    assert abs(r.jaccard - 0.25) < 5 * r.jaccard_error


def test_union_and_intersection_errors_hold_over_many_trials(spark):
    rows = spark.range(60 * 4600).select((F.col("id") % 60).alias("trial"), (F.col("id") / 60).cast("long").alias("i"), F.col("id").alias("x"))
    sets = {"a": "i < 3000", "b": "i >= 1500 and i < 4500", "c": "i >= 4500"}
    named = rows.select("trial", "x", F.explode(F.array(*[F.when(F.expr(w), F.lit(n)) for n, w in sets.items()])).alias("name")).dropna()
    s = distinct_sketch.Sketch(256)
    got = distinct_sketch.compare(distinct_sketch.sketch(named, ["trial", "name"], "x", s), ["trial"], "name", s).toPandas()
    assert len(got) == 180
    for pair, union, intersection in (("ab", 4500, 1500), ("ac", 3100, 0), ("bc", 3100, 0)):
        one = got[(got.a + got.b) == pair]
        for name, true in (("union", union), ("intersection", intersection)):
            off = (one[name] - true) / one[f"{name}_error"]
            print(pair, name, float((off**2).mean()) ** 0.5, float(off.abs().max()))
            assert (off**2).mean() ** 0.5 < 1.2 and off.abs().max() < 4.5
    overlapping = got[(got.a + got.b) == "ab"]
    assert (overlapping.union_error < 0.3 * 4500).all() and (overlapping.intersection_error < 0.5 * 1500).all()


def test_wrong_counts_are_found_exactly(spark, events):
    truth = events.groupBy("repo_id", "event_date").agg(F.countDistinct("actor_id").alias("c"))
    shift = F.when(F.col("repo_id") % 3 == 0, F.col("c") * 2 + 1).when(F.col("repo_id") % 3 == 1, F.ceil(F.col("c") * 1.2)).otherwise(F.col("c")).cast("long")
    published = truth.withColumn("active_accounts", shift).drop("c").union(spark.createDataFrame([(999, date(2026, 1, 5), 0), (998, date(2026, 1, 5), 1), (None, date(2026, 1, 5), 7)], "r long, d date, a long"))
    got = {(r.repo_id, r.event_date) for r in distinct_sketch.wrong_counts(events, published, ["repo_id", "event_date"], "actor_id", "active_accounts", 0.2).collect()}
    want = {(r.repo_id, r.event_date) for r in published.join(truth, ["repo_id", "event_date"], "left").fillna({"c": 0}).dropna().where("abs(active_accounts - c) > 0.2 * c").collect()}
    assert got == want and (998, date(2026, 1, 5)) in got


def test_windows_hold_their_days(spark, events):
    windows = spark.createDataFrame([(date(2026, 1, 5), date(2026, 1, 7)), (date(2026, 1, 6), date(2026, 1, 6)), (date(2026, 1, 6), date(2026, 1, 8))], "window_start date, window_end date")
    got = distinct_sketch.in_windows(events, windows).groupBy("window_start").count().collect()
    days = {r[0]: r[1] for r in events.groupBy("event_date").count().collect()}
    assert {r[0]: r[1] for r in got} == {date(2026, 1, 5): days[date(2026, 1, 5)] + days[date(2026, 1, 6)], date(2026, 1, 6): days[date(2026, 1, 6)] + days[date(2026, 1, 7)]}


def test_both_ways_to_compare_agree(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("cast(if(id % 7 = 0, null, id % 2) as int) as g", "concat('m', id % 5) as name", "id * id % 611 as x")
    s = distinct_sketch.Sketch(256)
    sketches = distinct_sketch.sketch(rows, ["g", "name"], "x", s)
    order = lambda df: df.toPandas().sort_values(["g", "a", "b"]).reset_index(drop=True)
    by_rows = order(distinct_sketch.compare(sketches, ["g"], "name", s))
    monkeypatch.setattr(distinct_sketch, "CLOSED_LIST", 2)
    by_join = order(distinct_sketch.compare(sketches, ["g"], "name", s))
    assert len(by_rows) == 30
    pd.testing.assert_frame_equal(by_rows, by_join)


def test_cube_equals_a_sketch_per_grouping(spark, events):
    cube = distinct_sketch.cube_estimates(events, ["event_date", "repo_id", "event_type"], "actor_id")
    for keys in (["event_type"], ["repo_id", "event_type"], ["event_date", "repo_id"]):
        want = distinct_sketch.estimate(distinct_sketch.sketch(events, keys, "actor_id"), keys)
        got = cube.where(F.col("grouping") == "+".join(keys)).select(*keys, "estimate", "standard_error")
        key = lambda r: tuple(str(r[k]) for k in keys)
        a, b = ({key(r): (r.estimate, r.standard_error) for r in df.collect()} for df in (want, got))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_empty_events(spark, events):
    none = events.limit(0)
    assert distinct_sketch.cube_estimates(none, ["event_date", "repo_id"], "actor_id").count() == 0
    assert distinct_sketch.compare(distinct_sketch.sketch(none, ["event_date", "event_type"], "actor_id"), ["event_date"], "event_type").count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's test data")
@pytest.mark.parametrize("name", ["p3_found", "p8_found", "p9_found"])
def test_queries_equal_their_sql(spark, name):
    compare(spark, name)
