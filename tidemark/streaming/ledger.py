"""Exactly-once-effect stream sink: a ledger of Parquet files behind one manifest.

``foreachBatch`` hands over a micro-batch; the ledger validates it, keeps the first message of each identifier, recomputes
the hours the batch touched from all retained events of those hours, and commits by adding one manifest file, claimed
exclusively.  Until that file is there nothing of the batch is visible; after it, a repeated batch is recognized by its
digest and changes nothing.  Late events repair their own minute.

What a batch reads of the past: the events of the hours it touches (files are sorted by hour), the messages whose offsets
overlap its own (none in a stream that goes on), and one narrow scan of identifiers against the batch, which is broadcast
if it is admitted as small; the history is not shuffled then.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.model import EVENT_TYPES, is_star, is_type
from tidemark.operators.deliveries import CONTENT, fingerprint
from tidemark.operators.skew import lookup_join, running_max
from tidemark.session import materialize
from tidemark.sources import storage

MESSAGE = "stream_id string, topic string, partition_id int, offset_id long, delivery_id long, event_id string, event_time timestamp, event_type string, payload_action string, repo_id long, repo_name string, actor_id long, actor_login string, value_sha256 string"
COMMITTED = f"{MESSAGE}, batch_id long"  # messages that carry the number of their commit in the stream
CONTRACT = "stream_id string, topic string, source_snapshot string, start_utc timestamp, end_utc timestamp, expected_events long"
BY_HOUR = ("minutes", "repo_minutes")  # an hour's rows are those of the last batch that touched it
ADMITTED = 50_000  # rows of a micro-batch that may be broadcast, and the bound a consumer may set
RECENT = 100  # receipts kept in the manifest; older ones lie beside it


def columns(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


class OffsetContentChanged(RuntimeError):
    """A known offset came again with other bytes: the topic was made anew or data was lost."""


class InjectedFailure(RuntimeError):
    """Raised by the test hooks."""


class NotRegistered(ValueError):
    """A message of a stream, or of a topic, that no contract names."""


def contract_errors(known_types_only: bool = True, given: Sequence[str] = (), registered: bool = False) -> Column:
    """The first rule of the message contract that a message breaks, or null.

    ``given``: optional columns of the batch that have rules of their own: ``public`` must be true, ``minute_us`` the
    minute of the event's time.  ``registered``: the stream's contract is joined as _snapshot, _start and _end; the event
    lies in its span and, if the batch says so, comes from its snapshot.
    """
    name = lambda c, n: F.col(c).isNull() | ~F.length(c).between(1, n) | F.contains(F.col(c), F.lit("\x00"))
    action, t = F.col("payload_action"), F.col("event_time")
    rules = [
        ("event_id", ~F.coalesce(F.col("event_id").rlike(r"^[1-9][0-9]{0,29}\z"), F.lit(False))),
        ("entity_id", F.coalesce(F.col("repo_id") <= 0, F.lit(True)) | F.coalesce(F.col("actor_id") <= 0, F.lit(True))),
        ("entity_name", name("repo_name", 512) | name("actor_login", 256)),
        ("public", ~F.col("public").eqNullSafe(F.lit(True)) if "public" in given else F.lit(False)),
        ("event_type", F.col("event_type").isNull() | (~F.col("event_type").isin(*EVENT_TYPES) if known_types_only else F.lit(False))),
        ("payload_action", action.isNotNull() & ((F.length(action) > 128) | F.contains(action, F.lit("\x00")))),
        ("source_snapshot", ~F.col("source_snapshot").eqNullSafe(F.col("_snapshot")) if registered and "source_snapshot" in given else F.lit(False)),
        ("event_time", t.isNull()),
        ("outside_span", ~F.coalesce((t >= F.col("_start")) & (t < F.col("_end")), F.lit(False)) if registered else F.lit(False)),
        ("minute", ~F.col("minute_us").eqNullSafe(F.unix_micros(F.date_trunc("minute", t))) if "minute_us" in given else F.lit(False)),
    ]
    return F.coalesce(*[F.when(broken, label) for label, broken in rules])


def batch_digest(rows: DataFrame) -> str:
    """Order-free identity of a batch: number of rows and sums of two hashes of offset and content."""
    spot = ["stream_id", "topic", "partition_id", "offset_id", "value_sha256"]
    h = [F.sum(F.xxhash64(F.lit(i), *spot).cast("decimal(20,0)")).cast("string") for i in (1, 2)]
    r = rows.agg(F.count("*"), *h).first()
    return "-".join(str(x) for x in r)


def offset_ranges(rows: DataFrame) -> DataFrame:
    return rows.groupBy("topic", "partition_id").agg(F.min("offset_id").alias("first_offset"), (F.max("offset_id") + 1).alias("end_offset"), F.count("*").alias("rows"))


@dataclass
class Ledger:
    """State of one ledger folder.  One writer at a time: a second one fails on the manifest it tries to add."""

    spark: SparkSession
    root: str
    late_after_seconds: int = 600
    cutoff_seconds: int | None = None  # None: late events are always kept
    strict_offsets: bool = True
    limits: DataFrame | None = None  # (stream_id, late_after_seconds, cutoff_seconds): each stream's own, in place of the two above
    require_contract: bool = False  # refuse messages of streams and topics that are not registered
    max_rows: int | None = None  # a larger micro-batch is refused
    by_commit: bool = False  # COMMITTED messages: earlier commits come first, wherever the micro-batches are cut between commits
    fail: str | None = None  # test hook: 'before_commit' or 'after_commit'
    receipts: list[dict] = field(default_factory=list)
    progress: list[dict] = field(default_factory=list)  # of the last run

    def manifest(self) -> dict:
        names = [n for n in storage.children(self.spark, f"{self.root}/manifest") if n.endswith(".json")]
        if not names:
            return {"version": 0, "batches": {}, "state": {}, "streams": {}, "contracts": [], "events": [], "messages": [], "dropped": [], **{t: {} for t in BY_HOUR}}
        return json.loads(self.spark.read.option("wholetext", "true").text(f"{self.root}/manifest/{names[-1]}").first()[0])

    def register(self, stream_id: str, topic: str, source_snapshot: str, start: datetime, end: datetime, expected_events: int) -> None:
        """Fix the source of a stream.  The same contract may come again; another one for the same stream is refused."""
        if not re.fullmatch(r"[a-z0-9][a-z0-9.-]{0,99}", stream_id):
            raise ValueError("a stream is named by lower-case letters, digits, dots and dashes")
        if start >= end:
            raise ValueError("a stream's span must not be empty")
        contract = [stream_id, topic, source_snapshot, start.isoformat(), end.isoformat(), expected_events]
        m = self.manifest()
        known = m["streams"].get(stream_id)
        if known is None:
            m["streams"][stream_id] = contract
            m["version"] += 1
            self._publish(m)
        elif known != contract:
            raise ValueError("the stream has another contract")

    def register_all(self, contracts: DataFrame) -> None:
        """Fix the source of many streams from a table (CONTRACT); a stream must not be named twice or registered before."""
        rows = contracts.select(*columns(CONTRACT))
        twice = rows.groupBy("stream_id").agg(F.count("*").alias("n")).where("n > 1 or stream_id is null")
        if not twice.isEmpty() or not rows.join(self.contracts(), "stream_id", "left_semi").isEmpty():
            raise ValueError("a stream is named twice or not at all")
        m, place = self.manifest(), f"{self.root}/contracts/{uuid.uuid4().hex[:12]}"
        rows.write.parquet(place)
        m["contracts"].append(place)
        m["version"] += 1
        self._publish(m)

    def contracts(self, m: dict | None = None) -> DataFrame:
        """All registered contracts."""
        m = m or self.manifest()
        one = [(s, t, snap, datetime.fromisoformat(a), datetime.fromisoformat(b), n) for s, t, snap, a, b, n in m["streams"].values()]
        rows = self.spark.createDataFrame(one, CONTRACT)
        return rows.unionByName(self.spark.read.schema(CONTRACT).parquet(*m["contracts"])) if m["contracts"] else rows

    def status(self, stream_id: str) -> str:
        """complete once the ledger holds as many events as the contract expects, else awaiting_replay."""
        expected = self.contracts().where(F.col("stream_id") == stream_id).first()
        if expected is None:
            raise NotRegistered(stream_id)
        events = self.table("events")
        n = 0 if events is None else events.where(F.col("stream_id") == stream_id).count()
        return "complete" if n == expected["expected_events"] else "awaiting_replay"

    def table(self, name: str, hours: list[str] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """The visible rows of a table, of some hours or all; None if there are none."""
        m = manifest or self.manifest()
        if name in BY_HOUR:
            now = {h: p for h, p in m[name].items() if hours is None or h in hours}
            if not now:
                return None
            folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+/[^/]*$", 1).alias("_folder")
            rows = self.spark.read.parquet(*sorted(set(now.values()))).select("*", folder)
            current = self.spark.createDataFrame([(h, p.rsplit("/", 2)[1]) for h, p in now.items()], "hour string, _folder string")
            return lookup_join(rows, current, ["hour", "_folder"], ["minute_utc"]).drop("_folder")
        paths = [p["path"] if isinstance(p, dict) else p for p in m[name]]
        if not paths:
            return None
        rows = self.spark.read.parquet(*paths)
        return rows if hours is None else rows.where(F.col("hour").isin(*hours))

    def overlapping(self, m: dict, ranges: list) -> DataFrame | None:
        """Earlier messages of the parts whose offsets overlap those of a batch; others cannot hold a known offset."""
        hit = lambda part: any(r["topic"] == o[0] and r["partition_id"] == o[1] and r["first_offset"] < o[3] and r["end_offset"] > o[2] for r in ranges for o in part["ranges"])
        paths = [p["path"] for p in m["messages"] if hit(p)]
        return self.spark.read.parquet(*paths) if paths else None

    def commit(self, batch: DataFrame, batch_id: int) -> dict:
        """Take in one micro-batch; returns its receipt.  The foreachBatch function."""
        m = self.manifest()
        spark = self.spark
        earlier = ["batch_id"] if self.by_commit else []
        given = [c for c in ("public", "source_snapshot", "minute_us") if c in batch.columns]
        rows = batch.select(*columns(COMMITTED if self.by_commit else MESSAGE), *given)
        digest = batch_digest(rows)
        size = int(digest.split("-")[0])
        if self.max_rows is not None and size > self.max_rows:
            raise ValueError(f"a micro-batch of {size} rows is beyond the bound of {self.max_rows}")
        old = m["batches"].get(digest) or self._receipt_of(digest)
        if old:
            return self._receipt({**old, "reused": True})
        near = (lambda df: F.broadcast(df)) if size <= ADMITTED else (lambda df: df)
        work = f"{self.root}/data/{uuid.uuid4().hex[:12]}"
        spot = ["stream_id", "topic", "partition_id", "offset_id"]
        first = W.partitionBy(*spot).orderBy(*earlier, "delivery_id")
        staged = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        if self.require_contract:
            known = self.contracts(m).select("stream_id", F.col("topic").alias("_topic"), F.col("source_snapshot").alias("_snapshot"), F.col("start_utc").alias("_start"), F.col("end_utc").alias("_end"))
            staged = lookup_join(staged, known, ["stream_id"], ["delivery_id"], "left")
            stranger = staged.where(~F.col("topic").eqNullSafe(F.col("_topic"))).select("stream_id", "topic").first()
            if stranger is not None:
                raise NotRegistered(f"stream {stranger['stream_id']!r} on topic {stranger['topic']!r}")
        staged = staged.withColumn("reason", contract_errors(given=given, registered=self.require_contract)).select(*[c for c in rows.columns if c not in given], "reason", *fingerprint(CONTENT))
        ranges = [r.asDict() for r in offset_ranges(rows.where("topic is not null")).collect()]  # a row per topic and partition
        known = self.overlapping(m, ranges)
        if known is not None:
            seen = known.select(*spot, F.col("value_sha256").alias("_old"))
            if self.strict_offsets and not seen.join(near(staged.select(*spot, "value_sha256")), spot).where("_old <> value_sha256").isEmpty():
                raise OffsetContentChanged(digest)
            again = seen.join(near(staged.select(*spot)), spot, "left_semi").select(*spot).distinct()
            staged = staged.join(again, spot, "left_anti")
        staged.write.parquet(f"{work}/staged")
        fresh = spark.read.parquet(f"{work}/staged")
        hour = F.date_format("event_time", "yyyy-MM-dd-HH")
        state = spark.createDataFrame([(s, datetime.fromtimestamp(t / 1e6, timezone.utc)) for s, t in m["state"].items()], "stream_id string, seen timestamp")
        own = ["stream_id", "event_id"]
        best = W.partitionBy(*own).orderBy(*earlier, "topic", "partition_id", "offset_id")
        candidates = fresh.where("reason is null").withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
        kept = self._first_copies(m)
        if kept is not None:
            kept = materialize(kept.join(near(fresh.where("reason is null").select(*own).distinct()), own, "left_semi"), "known-ids")
            candidates = candidates.join(kept.select(*own), own, "left_anti")
        behind = F.unix_micros("seen") - F.unix_micros("event_time")
        beyond = lambda seconds: F.coalesce(behind > F.col(seconds).cast("long") * 1_000_000, F.lit(False))
        flagged = self._with_limits(self._with_seen(candidates, state)).withColumns({"is_late": beyond("_late_after"), "is_out_of_order": F.coalesce(behind > 0, F.lit(False)), "_dropped": beyond("_cutoff")})
        added = flagged.drop("seen", "reason", "_late_after", "_cutoff", *earlier).withColumn("hour", hour)
        added.write.parquet(f"{work}/added")
        added = spark.read.parquet(f"{work}/added")
        accepted = added.where("not _dropped").drop("_dropped")
        accepted.sortWithinPartitions("hour").write.parquet(f"{work}/events")
        hours = [r[0] for r in accepted.select("hour").distinct().collect()]  # hours touched by one batch
        m["events"].append(f"{work}/events")
        retained = self.table("events", hours, m)
        self._aggregates(retained).write.parquet(f"{work}/minutes")
        self._repo_minutes(retained).write.parquet(f"{work}/repo_minutes")
        self._dispositions(fresh, added, kept).write.parquet(f"{work}/messages")
        added.where("_dropped").select(*own, "_fp1", "_fp2").write.parquet(f"{work}/dropped")
        messages = spark.read.parquet(f"{work}/messages")
        counts = messages.agg(F.count("*").alias("new_messages"), *[F.count_if(F.col("disposition") == d).alias(d) for d in ("accepted", "duplicate", "conflict", "invalid", "dropped")]).first().asDict()
        flags = added.agg(F.count_if("is_late").alias("late"), F.count_if("is_out_of_order").alias("out_of_order")).first().asDict()
        tops = added.groupBy("stream_id").agg(F.max(F.unix_micros("event_time")).alias("t")).collect()
        for r in tops:
            m["state"][r["stream_id"]] = max(r["t"], m["state"].get(r["stream_id"], r["t"]))
        m["messages"].append({"path": f"{work}/messages", "ranges": [[r["topic"], r["partition_id"], r["first_offset"], r["end_offset"]] for r in ranges]})
        if counts["dropped"]:
            m["dropped"].append(f"{work}/dropped")
        for t in BY_HOUR:
            m[t].update({h: f"{work}/{t}" for h in hours})
        receipt = {"digest": digest, "batch_id": batch_id, **counts, **flags, "reused": False}
        m["batches"][digest] = receipt
        for old in list(m["batches"])[:-RECENT]:
            storage.write_text(spark, f"{self.root}/receipts/{old}.json", json.dumps(m["batches"].pop(old)))
        m["version"] += 1
        if self.fail == "before_commit":
            raise InjectedFailure("before the commit")
        self._publish(m)
        if self.fail == "after_commit":
            raise InjectedFailure("after the commit, before the checkpoint")
        return self._receipt(receipt)

    def parity(self) -> DataFrame:
        """One row: minutes and repository minutes that differ from those recomputed from all retained events."""
        events = self.table("events")
        out = None
        for name, make in (("minutes", self._aggregates), ("repo_minutes", self._repo_minutes)):
            if events is None:
                return self.spark.createDataFrame([(0, 0)], "minutes_off long, repo_minutes_off long")
            now, again = self.table(name), make(events)
            off = now.select(*again.columns).exceptAll(again).unionByName(again.exceptAll(now.select(*again.columns))).agg(F.count("*").alias(f"{name}_off")).withColumn("_one", F.lit(1))
            out = off if out is None else out.join(off, "_one")
        return out.drop("_one")

    def _first_copies(self, m: dict) -> DataFrame | None:
        """Identifier and fingerprint of every first message so far, dropped ones too: a later copy of these is a copy."""
        own = ["stream_id", "event_id", "_fp1", "_fp2"]
        found = [t.select(*own) for t in (self.table(n, manifest=m) for n in ("events", "dropped")) if t is not None]
        return reduce(DataFrame.unionByName, found) if found else None

    def _with_seen(self, candidates: DataFrame, state: DataFrame) -> DataFrame:
        """Adds ``seen``, the greatest event time of earlier micro-batches and, by commit, of earlier commits of this one."""
        known = candidates.join(state, "stream_id", "left")
        if not self.by_commit:
            return known
        commits = candidates.groupBy("stream_id", "batch_id").agg(F.max("event_time").alias("_latest"))
        earlier = running_max(commits, "stream_id", "batch_id", "_latest", "_earlier").select("stream_id", "batch_id", "_earlier")
        return known.join(earlier, ["stream_id", "batch_id"], "left").withColumn("seen", F.greatest("seen", "_earlier")).drop("_earlier")

    def _with_limits(self, rows: DataFrame) -> DataFrame:
        """Adds _late_after and _cutoff; a null limit never applies.  A stream listed twice has its greater limits."""
        if self.limits is None:
            return rows.withColumns({"_late_after": F.lit(self.late_after_seconds), "_cutoff": F.lit(self.cutoff_seconds)})
        limits = self.limits.groupBy("stream_id").agg(F.max("late_after_seconds").alias("_late_after"), F.max("cutoff_seconds").alias("_cutoff"))
        return rows.join(limits, "stream_id", "left")

    def _receipt(self, receipt: dict) -> dict:
        self.receipts.append(receipt)
        return receipt

    def _receipt_of(self, digest: str) -> dict | None:
        path = f"{self.root}/receipts/{digest}.json"
        return json.loads(self.spark.read.option("wholetext", "true").text(path).first()[0]) if storage.exists(self.spark, path) else None

    def _publish(self, m: dict) -> None:
        """Claim the next version, then make it visible by a rename; of two writers one fails."""
        version = f"{self.root}/manifest/{m['version']:08d}"
        names = storage.children(self.spark, f"{self.root}/manifest")
        if f"{m['version']:08d}.json" in names or not storage.claim(self.spark, f"{self.root}/claims/{m['version']:08d}-{len(names)}"):
            raise FileExistsError(version)
        storage.write_text(self.spark, f"{version}.json", json.dumps(m))

    @staticmethod
    def _aggregates(events: DataFrame) -> DataFrame:
        minute = F.date_trunc("minute", "event_time")
        by_actor = events.groupBy("stream_id", minute.alias("minute_utc"), "actor_id").agg(F.count("*").alias("n"), F.count_if(is_star()).alias("s"), F.count_if(is_type("ForkEvent")).alias("f"), F.count_if("is_late").alias("l"))
        out = by_actor.groupBy("stream_id", "minute_utc").agg(F.sum("n").alias("total_events"), F.sum("s").alias("star_events"), F.sum("f").alias("fork_events"), F.count("actor_id").alias("active_accounts"), F.sum("l").alias("late_events"))
        return out.withColumn("hour", F.date_format("minute_utc", "yyyy-MM-dd-HH"))

    @staticmethod
    def _repo_minutes(events: DataFrame) -> DataFrame:
        minute = F.date_trunc("minute", "event_time")
        out = events.groupBy("stream_id", minute.alias("minute_utc"), "repo_id").agg(F.count("*").alias("total_events"), F.count_if(is_star()).alias("star_events"), F.count_if(is_type("ForkEvent")).alias("fork_events"))
        return out.withColumn("hour", F.date_format("minute_utc", "yyyy-MM-dd-HH"))

    @staticmethod
    def _dispositions(fresh: DataFrame, added: DataFrame, kept: DataFrame | None) -> DataFrame:
        """invalid, then conflict, then accepted (or dropped), then duplicate."""
        own, spot = ["stream_id", "event_id"], ["topic", "partition_id", "offset_id"]
        known = added.select(*own, F.col("_fp1").alias("_k1"), F.col("_fp2").alias("_k2"), *[F.col(c).alias(f"_k_{c}") for c in spot], "_dropped")
        if kept is not None:
            known = known.unionByName(kept.select(*own, F.col("_fp1").alias("_k1"), F.col("_fp2").alias("_k2"), *[F.lit(None).alias(f"_k_{c}") for c in spot], F.lit(False).alias("_dropped")))
        mine = F.lit(True)
        for c in spot:
            mine = mine & (F.col(c) == F.col(f"_k_{c}"))
        verdict = F.when(F.col("reason").isNotNull(), "invalid").when((F.col("_fp1") != F.col("_k1")) | (F.col("_fp2") != F.col("_k2")), "conflict").when(mine, F.when(F.col("_dropped"), "dropped").otherwise("accepted")).otherwise("duplicate")
        return fresh.join(known, own, "left").select("stream_id", *spot, "delivery_id", "event_id", "value_sha256", verdict.alias("disposition"))

    def run(self, source: DataFrame, checkpoint: str, contract: dict | None = None, interval: str | None = None, duration: float | None = None) -> list[dict]:
        """Drain a streaming source once, or with ``interval`` (such as '5 seconds') keep taking in what comes, for
        ``duration`` seconds or until it fails; returns the receipts of its batches.  ``progress`` holds what Spark told.

        ``contract`` is kept beside the checkpoint: one that belongs to another source is refused.
        """
        if contract is not None:
            self._pin(checkpoint, contract)
        before = len(self.receipts)
        writer = source.writeStream.foreachBatch(lambda df, i: self.commit(df, i) and None).option("checkpointLocation", checkpoint)
        query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
        try:
            if interval is None or duration is None:
                query.awaitTermination()
            else:
                query.awaitTermination(duration)
        finally:
            query.stop()
        if query.exception() is not None:
            raise query.exception()
        self.progress = [json.loads(p.json) for p in query.recentProgress]
        return self.receipts[before:]

    def _pin(self, checkpoint: str, contract: dict) -> None:
        path = f"{checkpoint.rstrip('/')}-contract/contract.json"
        if not storage.exists(self.spark, path):
            storage.write_text(self.spark, path, json.dumps(contract, sort_keys=True))
        elif json.loads(self.spark.read.option("wholetext", "true").text(path).first()[0]) != contract:
            raise ValueError("the checkpoint belongs to another source")


def drop_messages(messages: DataFrame, place: str, key: str = "repo_id", order: Sequence[str] = ("event_time", "event_id"), rate: int = 10_000, seconds: float = 1.0, pause: Callable[[float], None] = time.sleep) -> int:
    """A paced producer without a broker: the messages dropped as one file of at most ``rate * seconds`` rows after the
    other, in order, all messages of a key in the same partition; returns the files dropped.

    For a bounded replay (one hour): the rows are numbered in one task.  ``rate``: events a second, from 1 to 50,000.
    """
    if not 1 <= rate <= 50_000:
        raise ValueError("the rate must lie between 1 and 50,000 events a second")
    size = max(1, int(rate * seconds))
    n = F.row_number().over(W.orderBy(*order)) - 1
    numbered = materialize(messages.withColumn("partition_id", F.pmod(F.xxhash64(key), F.lit(8)).cast("int")).withColumn("_n", n).withColumn("_chunk", F.floor(F.col("_n") / size).cast("int")), "replay")
    chunks = [r[0] for r in numbered.select("_chunk").distinct().sort("_chunk").collect()]
    for i, chunk in enumerate(chunks):
        if i:
            pause(seconds)
        numbered.where(F.col("_chunk") == chunk).drop("_n", "_chunk").coalesce(1).write.mode("append").parquet(place)
    return len(chunks)


def file_source(spark: SparkSession, path: str, files_per_batch: int | None = None, schema: str = MESSAGE) -> DataFrame:
    """The message stream from dropped files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def kafka_source(spark: SparkSession, servers: str, topic: str, per_batch: int = 10_000) -> DataFrame:
    """The message stream from Kafka (needs the connector on the class path; not exercised by the tests here)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("failOnDataLoss", "true").option("maxOffsetsPerTrigger", per_batch).load()
    value = F.from_json(F.col("value").cast("string"), "event_id string, event_time timestamp, event_type string, payload_action string, repo_id long, repo_name string, actor_id long, actor_login string, public boolean, source_snapshot string")
    v = raw.select(F.col("topic"), F.col("partition").alias("partition_id"), F.col("offset").alias("offset_id"), value.alias("v"), F.sha2(F.col("value"), 256).alias("value_sha256"))
    return v.select(F.regexp_extract("topic", r"([^.]+)$", 1).alias("stream_id"), "topic", "partition_id", "offset_id", F.col("offset_id").alias("delivery_id"), "v.*", "value_sha256", F.unix_micros(F.date_trunc("minute", F.col("v.event_time"))).alias("minute_us"))
