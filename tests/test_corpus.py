"""The corpus writer, collections, the state ledger, and sources and sinks of small files."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import corpus, explore
from tidemark.session import is_small
from tidemark.sources import bronze, readers, storage
from tidemark.sources.state import StateLedger

LINE = "7,1,o/r,2,PushEvent,,2026-01-05T00:00:01Z,2026-01-05T{h:02d}:00:00Z,f{h},{row}," + "a" * 64


def lines(spark, *texts):
    return spark.createDataFrame([(i, t, "u") for i, t in enumerate(texts)], "line_id long, raw_csv string, source_uri string")


def test_corpus_is_guarded_and_deduplicated(spark, tmp_path):
    good = [LINE.format(h=2, row=1), LINE.format(h=1, row=9), LINE.format(h=1, row=3), LINE.format(h=1, row=3)]
    place = f"file://{tmp_path}/corpus"
    assert corpus.write_corpus(spark, lines(spark, *good, "x,y"), place, 0.2) == {"events": 4, "quarantine": 1}
    rows = spark.read.parquet(f"{place}/events")
    assert [(r.source_filename, r.source_row) for r in corpus.first_rows(rows).collect()] == [("f1", 3)]
    assert [r.reason for r in spark.read.json(f"{place}/quarantine").collect()] == ["wrong_column_count"]
    for texts, most in (((*good, "x,y"), 0.01), (("x",), 1.0), ((), 1.0)):
        with pytest.raises(corpus.TooManyRejected):
            corpus.write_corpus(spark, lines(spark, *texts), f"{place}-2", most)
    assert not storage.exists(spark, f"{place}-2") and not storage.exists(spark, f"{place}-2-staged")


def test_collections_roll_up(spark):
    entries = [
        {"filename": "a", "status": "complete", "compressed_bytes": 10, "records": 5, "reused_download": True, "reused_publication": False, "type_counts": {"PushEvent": 4, "ForkEvent": 1}},
        {"filename": "b", "status": "complete", "compressed_bytes": 1, "records": 2, "type_counts": {"PushEvent": 2}},
        {"filename": "c", "status": "failed", "compressed_bytes": 99, "records": 9},
        {"filename": "d"},
    ]
    got = corpus.roll_up(corpus.collected(spark, entries)).first().asDict()
    assert got == {"wanted": 4, "completed": 2, "missing": 2, "compressed_bytes": 11, "validated_records": 7, "downloaded_files": 1, "reused_downloads": 1, "reused_validations": 0, "reused_publications": 0, "status": "failed"}
    assert corpus.roll_up(corpus.collected(spark, entries[:2])).first().status == "complete"
    assert corpus.roll_up(corpus.collected(spark, [])).first().status == "failed"
    assert {r.event_type: r.records for r in corpus.type_totals(corpus.collected(spark, entries)).collect()} == {"PushEvent": 6, "ForkEvent": 1}


def test_state_ledger_keeps_history_and_newest_state(spark, tmp_path):
    book = StateLedger(spark, f"file://{tmp_path}/state")
    assert book.state("runs").count() == 0
    assert [book.put("runs", "r1", {"status": "started"}), book.put("archives", "a", {"n": 1}), book.put("runs", "r1", {"status": "complete"})] == [1, 2, 3]
    assert storage.claim(spark, f"{book.root}/claims/{5:010d}") and book.put("runs", "r2", {}) == 6
    assert book.put("runs", "r2", {"x": 1}) == 7
    assert {r.key: json.loads(r.body) for r in book.state("runs").collect()} == {"r1": {"status": "complete"}, "r2": {"x": 1}}
    assert book.history().count() == 5
    with pytest.raises(ValueError):
        book.put("other", "x", {})


def test_csv_keeps_quotes_line_ends_nulls_and_empty_texts(spark, tmp_path):
    rows = [(1, 'a "q", b'), (2, "two\nlines"), (3, None), (4, ""), (5, "\\"), (6, " x ")]
    df = spark.createDataFrame(rows, "i int, t string")
    readers.write_csv(df, f"file://{tmp_path}/csv")
    assert sorted(map(tuple, readers.read_csv(spark, f"file://{tmp_path}/csv", "i int, t string").collect())) == rows


def test_damaged_lines_are_skipped_or_fail(spark, tmp_path):
    df = spark.createDataFrame([('{"id":"1"}',), ("",), (None,), ("{",), ('{"id":"' + "x" * 100 + '"}',)], "raw_json string")
    assert [r.raw_json for r in readers.usable_lines(df, max_bytes=50).collect()] == ['{"id":"1"}']
    with pytest.raises(Exception, match="damaged line"):
        readers.usable_lines(df, on_invalid="raise").collect()
    assert readers.usable_lines(df.where("raw_json like '%1%'"), on_invalid="raise").count() == 1
    df.where("raw_json is not null").write.text(f"file://{tmp_path}/lines")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        readers.json_strict(spark, f"file://{tmp_path}/lines").collect()


def test_a_replay_is_bounded(spark):
    rows = [(str(i), date(2026, 1, 5), 3, datetime(2026, 1, 5, 3, 9 - i % 3)) for i in range(6)]
    df = spark.createDataFrame(rows, "event_id string, event_date date, event_hour int, event_time timestamp")
    assert [r.event_id for r in readers.replay_hour(df, date(2026, 1, 5), 3).orderBy("place").collect()] == ["2", "5", "1", "4", "0", "3"]
    for hour, limit in ((4, 10), (3, 5), (3, 0), (3, 250_001)):
        with pytest.raises(ValueError):
            readers.replay_hour(df, date(2026, 1, 5), hour, limit)


def test_unreadable_records_and_missing_types_are_counted(spark):
    df = spark.createDataFrame([('{"type":"A"}',), ("{",), (None,)], "raw_json string")
    got = {(r.event_type, r.path, r.types): r.records for r in explore.json_paths(df).collect()}
    assert got[("", "", explore.UNREADABLE)] == 2 and got[("A", "type", "string")] == 1
    events = spark.createDataFrame([("1", "A", 1, 1), ("1", None, 1, 2), ("2", None, None, 1)], "event_id string, event_type string, repo_id long, actor_id long")
    assert {r.event_type: r.events for r in explore.type_counts(events).collect()} == {"A": 1, "<missing>": 2}
    assert explore.unique_ids(events, F.col("repo_id") == 1).first().asDict() == {"unique_events": 2, "public_events": 1, "unique_repositories": 1, "public_repositories": 1, "unique_accounts": 2, "public_accounts": 2}


def test_trials_and_small_tables(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("b", 5.0)], "name string, seconds double")
    assert sorted(map(tuple, explore.trial_stats(df, ["name"]).collect())) == [("a", 3, 1.0, 2.0, 3.0), ("b", 1, 5.0, 5.0, 5.0)]
    assert is_small(df) and not is_small(df, max_rows=3) and not is_small(df, max_bytes=50) and is_small(df.limit(0))
    wide = df.withColumn("m", F.create_map(F.lit("k"), F.repeat(F.lit("x"), 1000)))
    assert not is_small(wide, max_bytes=2000) and is_small(wide)


def test_files_are_stored_once_by_content(spark, tmp_path):
    for name, text in (("a", "one"), ("b", "two"), ("c", "one")):
        (tmp_path / name).write_text(text)
    paths = [f"file://{tmp_path}/{n}" for n in "abc"]
    root = f"file://{tmp_path}/bronze"
    with pytest.raises(ValueError):
        bronze.store_files(spark, paths, root, {paths[1]: "0" * 64})
    got = bronze.store_files(spark, paths, root).orderBy("path").collect()
    assert [r.reused for r in got] == [False, False, True] and got[0].stored_path == got[2].stored_path
    assert all(r.reused for r in bronze.store_files(spark, paths, root, {paths[0]: got[0].sha256}).collect())
    assert spark.read.text(got[1].stored_path).first()[0] == "two"
    assert bronze.store_files(spark, [], root).count() == 0
