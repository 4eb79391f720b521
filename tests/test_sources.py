"""Source lists, stream registration, saved models and result digests."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import explore, learn
from tidemark.sources import manifest
from tidemark.streaming import ledger

SHA = "a" * 64


def entry(hour, **more):
    return {"filename": f"2026-01-05-{hour}.json.gz", "status": "ok", "sha256": SHA, "records": 2, "uri": "u", **more}


def test_plan_and_merge_sources(spark):
    planned = manifest.plan_sources([entry(3), entry(1), entry(2, status="failed")])
    assert [p["hour"].hour for p in planned] == [1, 3]
    with pytest.raises(ValueError):
        manifest.plan_sources([entry(1)], [datetime(2026, 1, 5, 2)])
    for bad in (entry(25), entry(1, sha256=None), {"filename": "x"}):
        with pytest.raises(ValueError):
            manifest.plan_sources([bad])
    assert len(manifest.merge_sources([entry(1)], [entry(1), entry(2)])) == 2
    with pytest.raises(manifest.SourceChanged):
        manifest.merge_sources([entry(1)], [entry(1, sha256="b" * 64)])
    lines = spark.createDataFrame([("x/2026-01-05-1.json.gz",)] * 2 + [("x/2026-01-05-2.json.gz",)], "source_uri string")
    assert [tuple(r) for r in manifest.count_against(lines, [entry(1), entry(2)]).collect()] == [("2026-01-05-2.json.gz", 1, 2)]


def test_registration_is_immutable(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}")
    contract = ("s-1", "t.s-1", "snap", datetime(2026, 1, 5), datetime(2026, 1, 6), 10)
    book.register(*contract)
    book.register(*contract)
    assert book.status("s-1") == "awaiting_replay"
    with pytest.raises(ValueError):
        book.register(*contract[:-1], 11)
    with pytest.raises(ValueError):
        book.register("S 1", *contract[1:])


def test_a_second_writer_fails_on_the_manifest(spark, tmp_path):
    first, second = (ledger.Ledger(spark, f"file://{tmp_path}") for _ in range(2))
    stale = second.manifest()
    first.register("a", "t", "s", datetime(2026, 1, 5), datetime(2026, 1, 6), 1)
    stale["version"] += 1
    with pytest.raises(FileExistsError):
        second._publish(stale)


def test_reloaded_models_score_alike(spark, tmp_path):
    rows = spark.range(200).select(
        F.lit(1).alias("period"), F.col("id").alias("repo_id"), F.when(F.col("id") % 4 == 0, "validation").otherwise("train").alias("split"), (F.col("id") % 3 == 0).cast("double").alias("label"),
        F.lit(0).cast("long").alias("as_of_seconds"), *[((F.col("id") * (i + 3)) % 11 + (F.col("id") % 3)).cast("double").alias(c) for i, c in enumerate(learn.FEATURES)],
    )
    name, model, found = learn.fit_and_choose(rows)
    assert set(found) == {"logistic_regression", "random_forest", "gradient_boosted"} and name in found
    back = learn.saved_with_parity(model, f"file://{tmp_path}/m", rows)
    assert set(learn.importances(back)) == set(learn.FEATURES)
    scored = learn.predicted(learn.with_score(back, rows), 0.5)
    assert scored.where("predicted is null").isEmpty()


def test_digest_does_not_depend_on_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n long, s string")
    assert explore.result_digest(df, "n").first() == explore.result_digest(df.orderBy(F.desc("n")).select("s", "n"), "n").first()
    assert explore.result_digest(df, "n").first() != explore.result_digest(df.fillna("b"), "n").first()
