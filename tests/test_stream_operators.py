"""p2 and p7 against brute force, and the stream ledger."""

import random
from datetime import timedelta

import pytest

from pyspark.sql import functions as F

from tidemark.operators import deliveries, late_events
from tidemark.operators.skew import running_max
from tidemark.streaming import ledger

SCHEMA = "delivery_id long, stream_id string, topic string, partition_id int, offset_id long, batch_id long, event_id string, event_time timestamp, event_type string, payload_action string, repo_id long, repo_name string, actor_id long, actor_login string, disposition string, value_sha256 string, _rank int, rank int"
RUNS = "stream_id string, late_after_seconds int, cutoff_seconds int"
PUBLISHED = "stream_id string, minute_utc timestamp, total_events long, star_events long, fork_events long, active_accounts long, late_corrections long"
CONTENT = slice(7, 14)


def messages(at, n=600, seed=1, hot=0.34):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        event = "77" if rng.random() < hot else str(rng.randint(1, n // 2))
        stream = rng.choice(["a", "b", None]) if rng.random() < 0.1 else rng.choice(["a", "b"])
        minute = (int(event) * 7) % 180
        kind = rng.choice(["WatchEvent", "ForkEvent"]) if rng.random() < 0.05 else "PushEvent" if int(event) % 2 else "WatchEvent"
        batch = max(0, minute // 10 + rng.randint(-1, 6))
        rows.append((i, stream, "t", rng.randint(0, 2), i, batch, event if rng.random() > 0.02 else None, at(minute) if rng.random() > 0.02 else None, kind, rng.choice([None, "started"]), 5, "o/r", rng.choice([1, 2, 3, None]), "x", rng.choice(["pending", None, None, "invalid"]), "h", 0, 0))
    return rows


def settle(rows):
    out, groups = {}, {}
    for r in rows:
        if r[14] == "invalid":
            continue
        if r[1] is None or r[6] is None:
            out[r[0]] = "kept"
        else:
            groups.setdefault((r[1], r[6]), []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[5], r[3], r[4], r[0]))
        for i, r in enumerate(g):
            out[r[0]] = "kept" if i == 0 else "duplicate" if r[CONTENT] == g[0][CONTENT] else "conflict"
    return out


def outcomes(rows, late=600, cut=1800):
    verdict = settle(rows)
    kept = [r for r in rows if verdict.get(r[0]) == "kept"]
    out = {}
    for r in kept:
        before = [x[7] for x in kept if x[1] == r[1] and x[1] is not None and x[5] < r[5] and x[7] is not None]
        behind = (max(before) - r[7]).total_seconds() if before and r[7] is not None else 0
        out[r[0]] = "dropped" if behind > cut else "late" if behind > late else "on_time"
    return out, {r[0]: r for r in kept}


@pytest.mark.parametrize("share", [1 / 256, 0.9])
def test_settled_deliveries_equal_brute_force(spark, at, share):
    rows = messages(at, 4000 if share < 0.5 else 500)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r[0]: r.disposition for r in deliveries.settle_deliveries(df, hot_share=share).collect()}
    assert got == settle(rows)


def test_late_messages_and_minutes_equal_brute_force(spark, at):
    rows = messages(at)
    df = spark.createDataFrame(rows, SCHEMA)
    runs = spark.createDataFrame([("a", 600, 1800), ("a", 600, 1800), ("b", 600, 1800)], RUNS)
    want, kept = outcomes(rows)
    got = {r.delivery_id: r.outcome for r in late_events.late_messages(df, runs).collect()}
    assert got == {k: v for k, v in want.items() if v != "on_time"}
    assert "late" in got.values() and "dropped" in got.values()
    minutes = {}
    touched = set()
    for i, r in kept.items():
        if r[1] is None or r[7] is None:
            continue
        touched.add((r[1], r[7]))
        if want[i] == "dropped":
            continue
        m = minutes.setdefault((r[1], r[7]), [0, 0, 0, set(), 0])
        m[0] += 1
        m[1] += r[8] == "WatchEvent" and r[9] == "started"
        m[2] += r[8] == "ForkEvent"
        m[3] |= {r[12]} - {None}
        m[4] += want[i] == "late"
    stale = spark.createDataFrame([("a", at(9999), 3, 0, 0, 1, 0), ("a", at(9999), 4, 0, 0, 1, 0), ("a", next(iter(t for s, t in touched if s == "a")), 99, 0, 0, 0, 0)], PUBLISHED)
    fixed = {(r.stream_id, r.minute_utc): tuple(r)[2:] for r in late_events.repaired_minutes(df, runs, stale).collect()}
    assert fixed == {**{k: (m[0], m[1], m[2], len(m[3]), m[4]) for k, m in minutes.items()}, ("a", at(9999)): (4, 0, 0, 1, 0)}


def test_empty_streams(spark):
    df, runs, published = (spark.createDataFrame([], s) for s in (SCHEMA, RUNS, PUBLISHED))
    assert deliveries.settle_deliveries(df).count() == 0
    assert late_events.late_messages(df, runs).count() == 0
    assert late_events.repaired_minutes(df, runs, published).count() == 0


def test_store_runs_are_idempotent_and_merge(spark, at):
    rows = messages(at, 300)
    df = spark.createDataFrame(rows, SCHEMA).where("stream_id is not null and event_id is not null").select(*deliveries.IDENTITY, *deliveries.ORDER, *deliveries.fingerprint())
    store = deliveries.IdentifierStore(spark, buckets=3)
    first, second = df.where("delivery_id < 150"), df.where("delivery_id >= 150")
    assert store.upsert(first, "one") and store.upsert(second, "two")
    assert not store.upsert(first, "one")
    assert store.rows().count() == df.count()
    identifiers = df.select("stream_id", "event_id").distinct().count()
    settled = store.compact()
    assert settled.where("disposition = 'kept'").count() == store.rows().count() == identifiers
    assert settled.count() == df.count()
    assert not store.upsert(second, "two") and store.rows().count() == identifiers
    assert store.upsert(df.withColumn("delivery_id", F.col("delivery_id") + 1000).withColumn("batch_id", F.col("batch_id") + 1000), "again")
    later = store.compact()
    assert later.where("disposition = 'kept'").count() == store.rows().count() == identifiers
    assert later.where("disposition <> 'kept'").count() == df.count() and later.where("disposition = 'kept' and delivery_id >= 1000").isEmpty()
    store.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(store.name)]


def test_runs_of_the_store_meet_without_a_shuffle(spark, at):
    df = spark.createDataFrame(messages(at, 50), SCHEMA).dropna(subset=["stream_id", "event_id"]).select(*deliveries.IDENTITY, *deliveries.ORDER, *deliveries.fingerprint())
    store = deliveries.IdentifierStore(spark, buckets=3)
    runs = df.withColumn("_run", F.concat(F.lit("r"), (F.col("delivery_id") % 3).cast("string")))
    assert store.add(runs, ["r0", "r1"]) == ["r0", "r1"] and store.add(runs, ["r0", "r1", "r2"]) == ["r2"]
    assert store.rows().count() == df.count()
    assert "Exchange" not in store.ranked()._jdf.queryExecution().executedPlan().toString()
    store.close()


def test_batches_touch_only_their_hours_and_cutting_them_changes_nothing(spark, at):
    df = spark.createDataFrame(messages(at), SCHEMA)
    runs = spark.createDataFrame([("s1", 60, 600), ("s2", 120, 1200)], "stream_id string, late_after_seconds int, cutoff_seconds int")
    tables = [late_events.repaired(df, runs, n) for n in (1, 2, 5)]
    rows = [sorted(map(tuple, t.minutes().collect())) for t in tables]
    assert rows[0] == rows[1] == rows[2]
    assert len({t.events().count() + t.dropped().count() for t in tables}) == 1
    table = late_events.PeriodTable(spark)
    judged = late_events.judged_messages(df, runs).where("event_time is not null and stream_id is not null")
    early, late = judged.where(late_events.hour_of(F.col("event_time")) <= "2026-01-05-00"), judged.where(late_events.hour_of(F.col("event_time")) > "2026-01-05-00")
    table.apply(early, "first")
    before = table.manifest()["minutes"]
    assert table.apply(late, "second") and table.apply(late, "second") == []
    after = table.manifest()["minutes"]
    assert all(after[h] == p for h, p in before.items())
    assert sorted(map(tuple, table.minutes().collect())) == sorted(map(tuple, late_events.minute_totals(judged.where("outcome <> 'dropped'")).collect()))


def test_running_max_crosses_blocks(spark):
    rng = random.Random(2)
    rows = [("k", i * 3, rng.randint(0, 1000)) for i in range(100)]
    got = {r.o: r.seen for r in running_max(spark.createDataFrame(rows, "k string, o long, v long"), "k", "o", "v", "seen", block=16).collect()}
    assert got == {o: max((v for _, p, v in rows if p < o), default=None) for _, o, _ in rows}


def feed(spark, at, root, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame([(r[1], r[2], r[3], r[4], r[0], r[6], r[7], r[8], r[9], r[10], r[11], r[12], r[13], r[15]) for r in rows], ledger.MESSAGE).coalesce(1).write.mode("append").parquet(f"{root}/in")
        yield i


def stream_rows(at):
    one = lambda i, event, minute, **k: (i, "s", "t", 0, i, 0, event, at(minute), k.get("kind", "PushEvent"), None, 5, "o/r", k.get("actor", 1), "x", None, k.get("hash", f"h{i}"), 0, 0)
    return [
        [one(1, "1", 0), one(2, "2", 30), one(3, "2", 30), one(4, "x", 1)],
        [one(5, "3", 0, actor=2), one(6, "1", 0, kind="ForkEvent"), one(7, "4", 31)],
    ]


def test_ledger_repairs_late_minutes_and_replays_change_nothing(spark, at, tmp_path):
    root = f"file://{tmp_path}"
    book = ledger.Ledger(spark, f"{root}/ledger")
    for _ in feed(spark, at, root, stream_rows(at)):
        book.run(ledger.file_source(spark, f"{root}/in"), f"{root}/checkpoint")
    first, second = book.receipts
    assert (first["accepted"], first["duplicate"], first["invalid"]) == (2, 1, 1)
    assert (second["accepted"], second["conflict"], second["late"]) == (2, 1, 1)
    minutes = {r.minute_utc: (r.total_events, r.active_accounts, r.late_events) for r in book.table("minutes").collect()}
    assert minutes == {at(0): (2, 2, 1), at(30): (1, 1, 0), at(31): (1, 1, 0)}
    before = book.manifest()["version"]
    again = ledger.Ledger(spark, f"{root}/ledger").run(ledger.file_source(spark, f"{root}/in", 1), f"{root}/second-checkpoint")
    assert all(r["reused"] or r["new_messages"] == 0 for r in again)
    assert {r.minute_utc: (r.total_events, r.active_accounts, r.late_events) for r in book.table("minutes").collect()} == minutes
    assert book.manifest()["version"] >= before


def test_ledger_cutoff_drops_what_is_too_late(spark, at, tmp_path):
    root = f"file://{tmp_path}"
    book = ledger.Ledger(spark, f"{root}/ledger", cutoff_seconds=1200)
    for _ in feed(spark, at, root, stream_rows(at)):
        book.run(ledger.file_source(spark, f"{root}/in"), f"{root}/checkpoint")
    assert book.receipts[1]["dropped"] == 1
    assert {r.minute_utc: r.total_events for r in book.table("minutes").collect()}[at(0)] == 1


@pytest.mark.parametrize(("hook", "version"), [("before_commit", 0), ("after_commit", 1)])
def test_a_crash_around_the_commit_is_replayed_safely(spark, at, tmp_path, hook, version):
    root = f"file://{tmp_path}"
    next(feed(spark, at, root, stream_rows(at)))
    broken = ledger.Ledger(spark, f"{root}/ledger", fail=hook)
    with pytest.raises(Exception, match="commit"):
        broken.run(ledger.file_source(spark, f"{root}/in"), f"{root}/checkpoint")
    assert broken.manifest()["version"] == version
    book = ledger.Ledger(spark, f"{root}/ledger")
    book.run(ledger.file_source(spark, f"{root}/in"), f"{root}/checkpoint")
    assert book.manifest()["version"] == 1
    assert book.table("events").count() == 2


def test_changed_bytes_at_a_known_offset_fail(spark, at, tmp_path):
    root = f"file://{tmp_path}"
    row = lambda h: [(1, "s", "t", 0, 1, 0, "1", at(0), "PushEvent", None, 5, "o/r", 1, "x", None, h, 0, 0)]
    book = ledger.Ledger(spark, f"{root}/ledger")
    for i, h in enumerate("ab"):
        for _ in feed(spark, at, f"{root}/{h}", [row(h)]):
            pass
        df = spark.read.schema(ledger.MESSAGE).parquet(f"{root}/{h}/in")
        if i == 0:
            book.commit(df, 0)
        else:
            with pytest.raises(ledger.OffsetContentChanged):
                book.commit(df, 1)


def commits(at):
    """Five commits: late events, a dropped one whose copies come later, and an offset that comes again."""
    one = lambda i, commit, event, minute, offset=None, **k: ("s", "t", 0, i if offset is None else offset, i, event, at(minute), k.get("kind", "PushEvent"), None, 5, "o/r", k.get("actor", 1), "x", f"h{i if offset is None else offset}", commit)
    return [one(9, 0, "1", 0), one(2, 1, "2", 60), one(1, 2, "1", 0), one(3, 2, "3", 48), one(4, 2, "4", 5), one(5, 3, "4", 5), one(6, 3, "4", 61), one(7, 4, "5", 61), one(8, 4, "2", 60, offset=2)]


@pytest.mark.parametrize("cuts", [[], [2], [0, 1, 2, 3]])
def test_a_replay_by_commit_does_not_depend_on_its_micro_batches(spark, at, tmp_path, cuts):
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger", limits=spark.createDataFrame([("s", 600, 1800), ("s", 300, 1800)], RUNS), by_commit=True)
    df = spark.createDataFrame(commits(at), ledger.COMMITTED)
    for i, (low, high) in enumerate(zip([-1, *cuts], [*cuts, 99], strict=True)):
        book.commit(df.where(f"batch_id > {low} and batch_id <= {high}"), i)
    got = {r.delivery_id: r.disposition for r in book.table("messages").collect()}
    assert got == {9: "accepted", 2: "accepted", 1: "duplicate", 3: "accepted", 4: "dropped", 5: "duplicate", 6: "conflict", 7: "accepted"}
    assert {r.minute_utc: (r.total_events, r.late_events) for r in book.table("minutes").collect()} == {at(0): (1, 0), at(60): (1, 0), at(48): (1, 1), at(61): (1, 0)}
    assert (sum(r["late"] for r in book.receipts), sum(r["dropped"] for r in book.receipts)) == (2, 1)


def test_the_commit_queries_replay_several_micro_batches(spark):
    from tidemark.plans import more_queries

    book = more_queries.replayed_commits(spark, "/root/testdata/sf0.001")
    assert len(book.receipts) > 1 and sum(r["late"] for r in book.receipts) > 0


def test_the_contract_of_a_stream_is_kept(spark, at, tmp_path):
    row = ("s", "t", 0, 1, 1, "1", at(0), "PushEvent", None, 5, "o/r", 1, "x", "h")
    df = lambda *rows: spark.createDataFrame([r + (True, "snap", 0) for r in rows], ledger.MESSAGE + ", public boolean, source_snapshot string, minute_us long").withColumn("minute_us", F.unix_micros(F.date_trunc("minute", "event_time")))
    change = lambda **k: tuple(k.get(n, v) for n, v in zip(ledger.columns(ledger.MESSAGE), row, strict=True))
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger", require_contract=True, max_rows=20)
    with pytest.raises(ledger.NotRegistered):
        book.commit(df(row), 0)
    book.register("s", "t", "snap", at(0), at(60), 2)
    book.register_all(spark.createDataFrame([("s2", "t2", "other", at(0), at(60), 1)], ledger.CONTRACT))
    with pytest.raises(ledger.NotRegistered):
        book.commit(df(change(topic="t2")), 0)
    good = df(row, change(offset_id=2, delivery_id=2, event_id="2", event_time=at(59)))
    bad = [df(change(offset_id=i, delivery_id=i, event_id=str(i), **k)) for i, k in enumerate([{"event_time": at(60)}, {"event_time": at(-1)}, {"stream_id": "s2", "topic": "t2"}], 3)]
    bad += [df(change(offset_id=6, delivery_id=6, event_id="6")).withColumn("public", F.lit(None).cast("boolean")), df(change(offset_id=7, delivery_id=7, event_id="7")).withColumn("minute_us", F.lit(5).cast("long"))]
    whole = good
    for b in bad:
        whole = whole.unionByName(b)
    receipt = book.commit(whole, 0)
    assert (receipt["accepted"], receipt["invalid"]) == (2, 5)
    assert (book.status("s"), book.status("s2")) == ("complete", "awaiting_replay")
    with pytest.raises(ValueError, match="bound"):
        book.commit(whole.unionByName(whole).unionByName(whole), 1)
    with pytest.raises(ValueError, match="named twice"):
        book.register_all(spark.createDataFrame([("s2", "t2", "other", at(0), at(60), 1)], ledger.CONTRACT))


def test_old_receipts_and_offsets_of_other_parts(spark, at, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "RECENT", 1)
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger")
    batch = lambda i: spark.createDataFrame([("s", "t", 0, i, i, str(i), at(i), "PushEvent", None, 5, "o/r", 1, "x", f"h{i}")], ledger.MESSAGE)
    for i in (1, 2, 3):
        book.commit(batch(i), i)
    m = book.manifest()
    assert len(m["batches"]) == 1 and book.commit(batch(1), 9)["reused"]
    assert book.overlapping(m, [{"topic": "t", "partition_id": 0, "first_offset": 4, "end_offset": 9}]) is None
    assert book.overlapping(m, [{"topic": "t", "partition_id": 0, "first_offset": 2, "end_offset": 3}]).count() == 1
    other = ledger.Ledger(spark, f"file://{tmp_path}/ledger")
    stale = other.manifest()
    book.commit(batch(4), 4)
    stale["version"] += 1
    with pytest.raises(FileExistsError):
        other._publish(stale)


def test_a_consumer_pins_its_checkpoint_and_tells_progress(spark, at, tmp_path):
    root = f"file://{tmp_path}"
    messages = spark.createDataFrame([(r[1], r[2], r[3], r[4], r[0], r[6], r[7], r[8], r[9], r[10], r[11], r[12], r[13], r[15]) for part in stream_rows(at) for r in part], ledger.MESSAGE)
    waits = []
    assert ledger.drop_messages(messages, f"{root}/in", rate=2, pause=waits.append) == 4 and waits == [1.0] * 3
    with pytest.raises(ValueError):
        ledger.drop_messages(messages, f"{root}/in", rate=0)
    book = ledger.Ledger(spark, f"{root}/ledger")
    contract = {"stream_id": "s", "topic": "t", "source_snapshot": "snap"}
    book.run(ledger.file_source(spark, f"{root}/in", 2), f"{root}/checkpoint", contract, interval="1 second", duration=12)
    assert len(book.receipts) == 2 and book.progress and sum(p["numInputRows"] for p in book.progress) >= 7
    assert book.run(ledger.file_source(spark, f"{root}/in", 2), f"{root}/checkpoint", contract) == []
    with pytest.raises(ValueError, match="another source"):
        book.run(ledger.file_source(spark, f"{root}/in"), f"{root}/checkpoint", {**contract, "topic": "u"})


def test_times_are_utc(at):
    assert at(1) - at(0) == timedelta(minutes=1)
