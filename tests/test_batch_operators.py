"""p4 to p6, snapshots, serving arguments and models on small fixtures."""

import random
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tidemark.operators import activity, explore, feature_table, gold, heavy_results, language, learn, serving, skew, small_files
from tidemark.sources import readers, snapshots, storage

EVENTS = "event_id string, event_type string, payload_action string, actor_id long, actor_login string, repo_id long, repo_name string, event_time timestamp, event_date date, event_hour int, source_archive_start timestamp, source_filename string, raw_record_sha256 string, file_id long, register int, n int"


def make_events(n=800, seed=3, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = datetime(2026, 1, 5) + timedelta(minutes=rng.randint(0, 14 * 1440 - 1), seconds=rng.randint(0, 59))
        repo = 1 if rng.random() < hot else rng.choice([None, *range(2, 40)])
        actor = rng.choice([None, *range(1, 60)])
        kind = rng.choice(["PushEvent", "WatchEvent", "ForkEvent", "PullRequestEvent", "BadgeEvent", None])
        row = (str(i), kind, rng.choice([None, "started", "opened", "closed"]), actor, f"a{actor}", repo, f"o/r{repo}" + ("x" if t.day > 12 else ""), t, t.date(), t.hour, t.replace(minute=0, second=0), f"f{i % 5}", f"{i:064d}", i % 37, 0, 0)
        rows.append(row)
        if i % 10 == 0:
            rows.append((*row[:10], t + timedelta(hours=3), "late", f"{i + 1:064d}", *row[13:]))
    rows.append((None, "PushEvent", None, 1, "a", 1, "o/r", datetime(2026, 1, 6), date(2026, 1, 6), 0, None, None, "", None, 0, 0))
    return rows


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(make_events(), EVENTS).cache()


# ---------------------------------------------------------------- p4


def test_features_equal_brute_force(spark, events):
    points = [datetime(2026, 1, 9, 11, 7), datetime(2026, 1, 12), datetime(2026, 1, 12), None]
    df = feature_table.entity_features(events, spark.createDataFrame([(p,) for p in points], "as_of_utc timestamp"))
    once = {r[0]: r for r in make_events() if r[0] is not None}
    for r in df.collect():
        mine = [e for e in once.values() if e[5] == r.repo_id and timedelta(0) < r.as_of_utc - e[7] <= timedelta(days=7)]
        assert r.total_events == len(mine) > 0
        assert r.active_accounts == len({e[3] for e in mine} - {None})
        assert r.n_watch_started == sum(e[1] == "WatchEvent" and e[2] == "started" for e in mine)
        assert r.n_other == sum(e[1] in ("BadgeEvent", None) for e in mine)
        pushes = [e[7] for e in mine if e[1] == "PushEvent"]
        assert r.n_push == len(pushes)
        assert r.recency_push == (int((r.as_of_utc - max(pushes)).total_seconds()) if pushes else None)
        assert r.n_action_closed == sum(e[2] == "closed" for e in mine)
    assert df.count() == len({(e[5], p) for e in once.values() for p in points[:2] if e[5] and timedelta(0) < p - e[7] <= timedelta(days=7)})


def test_stale_features_and_empty_tables(spark, events):
    fresh = feature_table.entity_features(events, spark.createDataFrame([(datetime(2026, 1, 12),)], "as_of_utc timestamp"))
    published = fresh.select("repo_id", "as_of_utc", F.col("n_watch_started").alias("recent_stars"), F.when(F.col("repo_id") == 5, F.col("n_push") + 1).when(F.col("repo_id") == 6, None).otherwise(F.col("n_push")).alias("recent_pushes"), "active_accounts")
    assert sorted(r.repo_id for r in feature_table.stale_features(events, published).collect()) == [5, 6]
    assert feature_table.stale_features(events.limit(0), published.limit(0)).count() == 0


# ---------------------------------------------------------------- p5


def test_compacted_rows_are_the_same_and_hot_hours_are_split(spark, events, tmp_path):
    table = events.withColumn("_pack", F.lit("clash")).withColumn("tags", F.create_map(F.lit("k"), F.col("repo_id")))
    files = spark.createDataFrame([(i % 37, date(2026, 1, 5), i % 24, 10) for i in range(80)], "file_id long, event_date date, event_hour int, n_bytes long")
    place, report = small_files.compact_rows(table, files, keys=["event_hour"], packing=small_files.Packing(target_bytes=20_000))
    back = small_files.read_compacted(spark, place, table)
    plain = lambda df: df.withColumn("tags", F.to_json("tags"))
    assert plain(table).exceptAll(plain(back)).isEmpty() and back.count() == table.count()
    rows = report.collect()
    assert sum(r.rows for r in rows) == table.count()
    assert all(r.files_after <= r.files_cut for r in rows) and sum(r.files_after for r in rows) < sum(r.files_cut for r in rows)
    assert max(r.files_after for r in rows) > 1
    empty, report = small_files.compact_rows(table.limit(0), files.limit(0), ["event_hour"])
    assert report.count() == 0 and small_files.read_compacted(spark, empty, table).count() == 0


def test_a_differing_copy_is_not_published(spark, events, monkeypatch):
    monkeypatch.setattr(small_files, "digest", lambda df, keys: df.groupBy(*keys).agg(F.count("*").alias("rows"), F.lit(0).cast("decimal(38,0)").alias("checksum")))
    with pytest.raises(small_files.RowsDiffer):
        small_files.compact_rows(events, spark.createDataFrame([], "file_id long, event_hour int, n_bytes long"), ["event_hour"])


def test_packing_plans_have_no_exchange(spark, events, tmp_path, monkeypatch):
    small_files.cut_by_folder(events, f"file://{tmp_path}/in", ["event_hour"])
    found = storage.folders(spark, f"file://{tmp_path}/in")
    plans = []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or write(self, path))
    small_files.pack_folders(spark, found, storage.qualified(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", events.schema, small_files.Packing())
    assert len(plans) == len(found) and not any("Exchange" in p or "Sort" in p for p in plans)
    after = storage.folders(spark, f"file://{tmp_path}/out")
    assert [n for _, n, _ in after] == [1] * len(found)


def test_directories_are_compacted_without_a_shuffle(spark, events, tmp_path):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    narrow = events.select("event_id", "repo_id", "event_hour").where("event_hour < 3")
    narrow.repartition(12).write.partitionBy("event_hour").parquet(source)
    report = {r.folder: r for r in small_files.compact_directories(spark, source, target).collect()}
    assert set(report) == {f"event_hour={h}" for h in range(3)}
    assert all(r.files_before > r.files_after == 1 for r in report.values())
    back = spark.read.parquet(*[f"{target}/event_hour={h}" for h in range(3)])
    assert back.exceptAll(narrow.select("event_id", "repo_id")).isEmpty() and back.count() == narrow.count()
    assert small_files.compact_directories(spark, source, target).count() == 0
    assert spark.conf.get("spark.sql.files.openCostInBytes") != str(small_files.Packing().open_cost)


def test_columns_of_only_some_files_are_kept(spark, tmp_path):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.range(5).selectExpr("id", "id as more").coalesce(1).write.mode("append").parquet(f"{source}/a")
    spark.range(5, 9).coalesce(1).write.mode("append").parquet(f"{source}/a")
    assert [tuple(r) for r in small_files.compact_directories(spark, source, target).collect()] == [("a", 9, 2, 1)]
    assert spark.read.parquet(f"{target}/a").agg(F.sum("more")).first()[0] == 10


# ---------------------------------------------------------------- p6


def test_dominant_keys_and_results(spark, events):
    got = {(r.key_field, r.key_value) for r in heavy_results.dominant_keys(events, ["repo_id", "actor_id"], 0.03).collect()}
    rows = make_events()
    want = {(f, v) for f, i in (("repo_id", 5), ("actor_id", 3)) for v in {r[i] for r in rows} if v is not None and sum(r[i] == v for r in rows) >= 0.03 * len(rows)}
    assert got == want and ("repo_id", 1) in got
    once = {r[0]: r for r in rows if r[0] is not None}.values()
    for r in heavy_results.repository_results(events).collect():
        mine = [e for e in once if e[5] == r.repo_id]
        assert (r.total_events, r.active_accounts) == (len(mine), len({e[3] for e in mine} - {None}))
    for r in heavy_results.account_results(events).collect():
        mine = [e for e in once if e[3] == r.actor_id]
        assert (r.total_events, r.active_repositories, r.active_days) == (len(mine), len({e[5] for e in mine} - {None}), len({e[8] for e in mine}))
    assert heavy_results.dominant_keys(events.limit(0), ["repo_id"], 0.02).count() == 0
    for n in (50, 150, 350, 1150):  # a key with exactly the share
        df = spark.range(n).selectExpr(f"if(id < {n // 50}, -1, id) as k")
        assert [tuple(r) for r in heavy_results.dominant_keys(df, ["k"], 0.02).collect() if r.key_value == -1] == [("k", -1)], n


def test_eager_join_equals_the_join(spark, events):
    files = spark.createDataFrame([(i % 40, i) for i in range(60)], "file_id long, n_bytes long")
    got = heavy_results.stored_bytes_by_repository(events, files)
    want = events.join(files, "file_id").groupBy("repo_id").agg(F.count("*").alias("joined_rows"), F.sum("n_bytes").alias("joined_bytes"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_heavy_keys_and_salted_join(spark):
    df = spark.range(9000).selectExpr("if(id < 5000, 1, id) as k", "id as v", "if(id % 7 = 0, null, 1) as other")
    assert skew.heavy_keys(df, ["k"], 0.25) == [(1,)]
    assert skew.heavy_keys(df.limit(0), ["k"]) == []
    right = df.select("k").distinct().withColumn("w", F.col("k") * 2)
    assert skew.salted_join(df, right, ["k"], ["v"]).where("w = 2 * k").count() == 9000


# ---------------------------------------------------------------- activity, serving, language, models


def test_windows_and_growth_rules(spark):
    for bad in (3, 1, 0):
        with pytest.raises(ValueError):
            activity.Window(datetime(2026, 1, 1), bad)
    hours = [datetime(2026, 1, 1, h) for h in range(4)]
    assert activity.Window.of_hours(hours[::-1]).split == datetime(2026, 1, 1, 2)
    for bad in (hours[:2] + hours[3:], hours + hours[:1], []):
        with pytest.raises(ValueError):
            activity.Window.of_hours(bad)
    rows = [(1, 0, 0, 5, 0, 2, 10, 4), (2, 3, 0, 1, 0, 1, 10, 4), (3, 2, 0, 5, 1, 2, 9, 3)]
    df = spark.createDataFrame(rows, "repo_id long, previous_stars long, previous_forks long, current_stars long, current_forks long, current_active_accounts long, total_events long, active_accounts long")
    got = {r.repo_id: r for r in activity.scored(activity.growth(df.withColumn("current_prs_opened", F.lit(0)))).collect()}
    assert got[1].attention_change_percent is None and got[1].zero_attention_baseline and got[1].emerging_attention_candidate
    assert not got[2].growth_eligible and got[2].attention_growth_ratio == 0.5
    assert got[3].emerging_attention_candidate and got[3].attention_change_percent == 200
    assert got[2].trend_score == pytest.approx(0.7 * got[2].activity_score)  # a decline adds nothing and takes nothing


def test_repository_totals_conserve_events(spark, events):
    clean = activity.clean(events.where("event_id is not null and repo_id is not null"))
    repos = activity.repositories(clean, activity.Window(datetime(2026, 1, 5), 336))
    assert repos.agg(F.sum("total_events")).first()[0] == clean.count()
    assert {r.repo_name[-1] for r in repos.collect()} <= {"x", *map(str, range(10))}
    dense = activity.hourly_dense(clean, activity.Window(datetime(2026, 1, 5), 336))
    assert dense.count() == 336 and dense.agg(F.sum("total_events")).first()[0] == clean.count()


@pytest.mark.parametrize("limit", [0, 201, True, 1.5])
def test_serving_limits(limit):
    with pytest.raises(ValueError):
        serving.checked_limit(limit)


def test_serving_search_is_literal_and_compare_is_strict(spark):
    df = spark.createDataFrame([(1, "a_b"), (2, "axb"), (3, "A_B%")], "repo_id long, repo_name string")
    assert sorted(r.repo_id for r in df.where(serving.contains_literal("repo_name", "A_b")).collect()) == [1, 3]
    with pytest.raises(ValueError):
        serving.compare(df, [1])
    with pytest.raises(LookupError):
        serving.compare(df, [1, 9])
    with pytest.raises(ValueError):
        serving.rankings(df, sort="repo_id; drop")


def test_language_rules(spark):
    entries = [
        {"repo_id": 1, "status": "ok", "primary_language": "Go", "language_bytes": {"Go": 300, "C": 100, "Zero": 0}, "topics": ["ETL", "ios"], "description": None},
        {"repo_id": 2, "status": "ok", "primary_language": None, "language_bytes": {"C": 0}, "topics": None, "description": "a Mobile app for kubernetes"},
        {"repo_id": 3, "status": "not_found"},
        {"repo_id": 4, "status": "ok", "description": "mobile apps, biosphere"},
    ]
    m = language.metadata_frame(spark, entries)
    shares = {(r.repo_id, r.language): r.byte_share for r in language.language_shares(m).collect()}
    assert shares == {(1, "Go"): 0.75, (1, "C"): 0.25, (2, language.NO_LANGUAGE): 1.0, (3, language.UNAVAILABLE): 1.0, (4, language.NO_LANGUAGE): 1.0}
    found = {r.repo_id: r.c for r in m.select("repo_id", language.categories().alias("c")).collect()}
    assert found == {1: ["Data engineering", "Mobile"], 2: ["Cloud", "Mobile"], 3: [language.UNAVAILABLE], 4: [language.UNCLASSIFIED]}
    labels = {r.repo_id: r.p for r in m.select("repo_id", language.primary_label().alias("p")).collect()}
    assert labels == {1: "Go", 2: language.NO_PRIMARY, 3: language.UNAVAILABLE, 4: language.NO_PRIMARY}


def test_evaluation_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9, 1.0, 0), (2, 0.7, 0.0, 0), (3, 0.4, 1.0, 0), (4, 0.1, 0.0, 0)], "repo_id long, score double, label double, as_of_seconds long")
    assert learn.choose_threshold(df) == 0.3
    assert learn.areas(df)["roc_auc"] == pytest.approx(0.75)
    m = learn.ranking_metrics(df).first()
    assert m.brier_score == pytest.approx(0.2175) and m.precision_at_10 == 0.5
    curve = {r.decision_threshold: (r.tp, r.fp, r.fn, r.tn) for r in learn.confusion_curve(df).collect()}
    assert curve[0.5] == (1, 1, 1, 1) and len(curve) == 9


def test_labels_do_not_leak_and_the_threshold_is_a_value(spark):
    rows = [("train", d) for d in [1] * 8 + [9, 50]] + [("test", 99), ("train", -3)]
    df = spark.createDataFrame(rows, "split string, star_delta long")
    assert learn.growth_threshold(df).first().threshold == 9
    assert learn.growth_threshold(df.where("star_delta < 0")).first().threshold is None
    wide = spark.range(5000).selectExpr("id * 7919 % 100003 - 50000 as v", "id % 3 + 1 as n")
    ordered = sorted(v for r in wide.collect() for v in [r.v] * r.n)
    for q in (0.5, 0.9, 1.0):
        assert learn.exact_quantile(wide, "v", "n", q) == ordered[-(-int(len(ordered) * q * 1000) // 1000) - 1]
    events = spark.createDataFrame(make_events(1500, 8), EVENTS).where("event_id is not null")
    h = learn.Horizon(datetime(2026, 1, 5), days=2, first_days=1, min_future=1)
    made = learn.labelled(learn.examples(learn.period_features(activity.clean(events), h), h), 1, h)
    assert learn.leaks(made, h).isEmpty()
    assert made.where("split = 'forecast' and label is not null").isEmpty()
    assert not made.where("split = 'test' and future_stars = 0").isEmpty()
    assert set(learn.check_splits(made, h)) == {"train", "validation", "test", "forecast"}
    for broken in (made.where("split <> 'test'"), made.withColumn("label", F.when(F.col("split") != "forecast", 1.0)), made.withColumn("as_of_seconds", F.col("as_of_seconds") + F.when(F.col("split") == "train", 86400).otherwise(0)), made.withColumn("label", F.lit(1.0) * (F.col("repo_id") % 2))):
        with pytest.raises(ValueError):
            learn.check_splits(broken, h)
    with pytest.raises(ValueError):
        learn.labelled(made.drop("label"), None, h)
    by = {(r.period, r.repo_id): r.star_events for r in learn.period_features(activity.clean(events), h).collect()}
    for r in made.where("split <> 'forecast'").collect():
        assert r.future_stars == by.get((r.period + 1, r.repo_id), 0)


def test_snapshots_are_reused_checked_and_switched(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    good = {"repos": snapshots.Table(lambda: spark.createDataFrame([(1, 2)], "repo_id long, total_events long"), ["repo_id"])}
    place, reused = snapshots.publish(spark, root, {"v": 1}, good)
    assert not reused and snapshots.publish(spark, root, {"v": 1}, good) == (place, True)
    for rows in ([(1, 2), (1, 3)], [(1, -2)], [(None, 2)]):
        with pytest.raises(snapshots.ContractBroken):
            snapshots.publish(spark, root, {"v": 2}, {"repos": snapshots.Table(lambda rows=rows: spark.createDataFrame(rows, "repo_id long, total_events long"), ["repo_id"])})
    a, b = ({"rows": 2.0, "x": v} for v in (1.0, 1.0 + 1e-12))
    assert snapshots.sums_differ(a, b) == [] and snapshots.sums_differ(a, {"rows": 3.0, "y": 1.0}) == ["rows", "x", "y"]
    assert snapshots.sums(spark.read.parquet(f"{place}/repos")) == {"rows": 1.0, "repo_id": 1.0, "total_events": 2.0}
    assert snapshots.current(spark, root) == place and storage.children(spark, f"{root}/staged") == []


def test_gold_is_published_only_if_events_are_conserved(spark, events, tmp_path):
    once = activity.clean(events.where("event_id is not null and repo_id is not null and actor_id is not null"))
    window = activity.Window(datetime(2026, 1, 5), 336)
    entries = [{"repo_id": 1, "status": "ok", "primary_language": "Go", "language_bytes": {"Go": 10, "C": 30}, "topics": ["llm"]}, {"repo_id": 2, "status": "not_found"}]
    meta = language.metadata_frame(spark, entries)
    root = f"file://{tmp_path}/gold"
    place, _ = gold.publish(spark, once, window, meta, root, {"silver": "a"})
    m = snapshots.verify(spark, place)
    assert len(m["rows"]) == 15 and m["facts"]["events"] == once.count() == m["facts"]["in_window"]
    assert gold.publish(spark, once, window, meta, root, {"silver": "a"}) == (place, True)
    with pytest.raises(snapshots.ContractBroken):
        gold.publish(spark, once.unionByName(once.limit(1).withColumn("repo_id", F.lit(None).cast("long"))), window, meta, root, {"silver": "b"})
    storage.delete(spark, f"{place}/activity_calendar")
    with pytest.raises(snapshots.ContractBroken):
        snapshots.verify(spark, place)


def test_readers(spark, events, tmp_path):
    hours = readers.hour_range(datetime(2026, 1, 5), datetime(2026, 1, 5, 3))
    assert len(hours) == 4
    with pytest.raises(ValueError):
        readers.hour_range(datetime(2026, 1, 5, 3), datetime(2026, 1, 5))
    assert readers.latest_complete_hour(datetime(2026, 1, 5, 3, 59)) == datetime(2026, 1, 5, 1)
    out = readers.write_formats(events.select("event_id", "event_type", "event_hour"), f"file://{tmp_path}/formats")
    schema = "event_id string, event_type string, event_hour int"
    counts = [readers.json_typed(spark, out[n], schema).where("event_hour = 12").count() for n in ("jsonl", "jsonl_gzip")] + [spark.read.parquet(out[n]).where("event_hour = 12").count() for n in ("parquet", "parquet_by_hour")]
    assert len(set(counts)) == 1 and counts[0] > 0


def test_exploration(spark, events):
    lines = spark.createDataFrame([('{"id":"1","type":"A","actor":{"id":1,"login":" "},"payload":{"x":[1,"a",null]}}',), ('{"id":null,"type":"A"}',)], "raw_json string")
    got = {r.field: (r.absent, r["null"], r.blank) for r in explore.field_quality(lines).collect()}
    assert got["id"] == (0, 1, 0) and got["actor.login"] == (1, 0, 1) and got["public"] == (2, 0, 0)
    paths = {(r.path, r.types): r.records for r in explore.json_paths(lines).collect()}
    assert paths[("payload.x[]", "integer,null,string")] == 1 and paths[("id", "null")] == 1
    assert explore.uniform_sample(events, 10, "event_id").count() == 10
    assert explore.overview(events.limit(0)).first().duplicate_event_ids == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the driver's test data")
def test_model_queries_choose_among_all_models_and_publish(spark, tmp_path):
    from tidemark.plans import more_queries

    rows, best, found, scored = more_queries._fitted(spark, "/root/testdata/sf0.01")
    assert set(found) == set(learn.classifiers())
    assert found[best]["pr_auc"] == max(m["pr_auc"] for m in found.values())
    root = f"file://{tmp_path}/models"
    place, reused = learn.publish_model(spark, root, {"v": 1}, best, found, rows, scored, more_queries.HORIZON)
    m = snapshots.verify(spark, place)
    assert not reused and m["facts"]["selected"] == best and m["rows"]["predictions"] == m["rows"]["forecast_context"] > 0 and m["rows"]["heldout_predictions"] > 0
    assert snapshots.current(spark, root) == place
    with pytest.raises(snapshots.ContractBroken):
        learn.publish_model(spark, root, {"v": 2}, best, found, rows.where("repo_id % 2 = 0"), scored, more_queries.HORIZON)
    with pytest.raises(snapshots.ContractBroken):
        learn.publish_model(spark, root, {"v": 3}, best, found, rows, scored.withColumn("score", F.lit(1.5)), more_queries.HORIZON)
