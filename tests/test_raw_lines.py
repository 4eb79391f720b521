"""p1: strict JSON and CSV lines against a brute-force reading in Python."""

import csv
import io
import json
import re
from datetime import datetime

import pytest

from tidemark.operators import raw_lines, silver
from tidemark.sources import snapshots

csv.field_size_limit(10**9)
BASE = '{"id":"5","type":"PushEvent","actor":{"id":1,"login":"a"},"repo":{"id":2,"name":"o/r"},"payload":{%s},"public":true,"created_at":"2026-01-05T00:00:00Z"}'
GOOD = BASE % ""


def strict(text):
    def refuse(x):
        raise ValueError(x)

    if text is None:
        raise ValueError
    return json.loads(text, parse_constant=refuse, parse_int=str, parse_float=str)


def timestamp(v):
    m = isinstance(v, str) and re.fullmatch(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(\.\d+)?(Z|[+-]\d\d:\d\d)", v)
    if not m:
        return False
    try:
        datetime.fromisoformat(m[1] + (m[3] if m[3] != "Z" else "+00:00"))
    except ValueError:
        return False
    return True


def long(v):
    return v is not None and not isinstance(v, bool) and re.fullmatch("[0-9]+", str(v)) is not None and len(str(v).lstrip("0")) < 30 and 1 <= int(v) <= 2**63 - 1


def json_reason(text):
    try:
        o = strict(text)
    except (ValueError, TypeError):
        return "invalid_json_or_field_type"
    if not isinstance(o, dict) or any(o.get(k) is not None and not isinstance(o[k], dict) for k in ("actor", "repo", "payload", "org")) or o.get("public") is not None and not isinstance(o["public"], bool):
        return "invalid_json_or_field_type"
    if isinstance(o.get("id"), (bool, dict, list, type(None))) or not re.fullmatch("[1-9][0-9]*", str(o["id"])):
        return "invalid_event_id"
    if not isinstance(o.get("type"), str) or not re.fullmatch("[A-Z][A-Za-z0-9]*Event", o["type"]):
        return "invalid_event_type"
    a, r = o.get("actor") or {}, o.get("repo") or {}
    if not long(a.get("id")):
        return "invalid_actor_id"
    if a.get("login") is None or not str(a["login"]).strip():
        return "missing_actor_login"
    if not long(r.get("id")):
        return "invalid_repo_id"
    if not isinstance(r.get("name"), str) or not re.fullmatch(r"[^\s/]+/[^\s/]+", r["name"]):
        return "invalid_repo_name"
    if not timestamp(o.get("created_at")):
        return "invalid_timestamp"
    if o.get("public") is not True:
        return "not_public"
    return "missing_payload" if o.get("payload") is None else None


def csv_reason(line):
    if line is None or not re.fullmatch(r'([^",\r\n]*|"([^"]|"")*")(,([^",\r\n]*|"([^"]|"")*"))*', line):
        return "broken_quoting"
    f = next(csv.reader(io.StringIO(line, newline="")), [""])
    if len(f) != 11:
        return "wrong_column_count"
    ok = re.fullmatch("[1-9][0-9]*", f[0]) and long(f[1]) and re.fullmatch(r"[^\s/]+/[^\s/]+", f[2]) and long(f[3]) and re.fullmatch("[A-Z][A-Za-z0-9]*Event", f[4])
    return None if ok and timestamp(f[6]) and timestamp(f[7]) and re.fullmatch("[0-9]+", f[9]) and re.fullmatch("[0-9a-f]{64}", f[10]) else "invalid_value"


def swap(old, new):
    return BASE.replace(old, new) % "" if "%s" in BASE.replace(old, new) else BASE.replace(old, new)


JSON_LINES = [
    GOOD, GOOD, None, "", " ", "null", "[]", f"[{GOOD}]", '"x"', GOOD + " x", " \n" + GOOD + "\t", GOOD + "," + GOOD, GOOD + ',"r":{}', GOOD + '],"r":[' + GOOD, GOOD + "}", GOOD + GOOD,
    *[BASE % x for x in ('"a":1e400', '"a":"\\ud800"', '"action":"\\ud800"', '"a":01', '"a":NaN', "'a':1", '"a":1.', '"a":.5', '"a":-0', '"a":+1', '"a":[1,]', '"a":"\t"', '"a":"\\x"', '"a":"\\u12G4"', '"a":1 "b":2', '"a":' + "[" * 900 + "]" * 900, '"a":"' + "x" * 300_000 + '"', '"action":{"deep":1}')],
    "\ufeff" + GOOD, "\u00a0" + GOOD, swap('"id":"5"', '"id":"5","id":"x"'), swap('"id":"5"', '"id":"x","id":"5"'), swap('"id":"5"', '"id":5'), swap('"id":"5"', '"id":5.0'), swap('"id":"5"', '"id":true'), swap('"id":"5"', '"id":["5"]'), swap('"id":"5"', '"id":"05"'),
    swap('"login":"a"', '"login":7'), swap('"login":"a"', '"login":"\\u3000 "'), swap('"login":"a"', '"login":null'), swap('"public":true', '"public":"true"'), swap('"public":true', '"public":null'), swap('"public":true', '"public":false'), swap('"public":true', '"public":1'),
    *[swap('"id":1,', f'"id":{x},') for x in ("9223372036854775807", "9223372036854775808", '"00000000000000000000000001"', '"0"', "9" * 4000, "-1", "1.0", "null")],
    swap("{%s}", '""'), swap("{%s}", "[]"), swap("{%s}", "null"), swap('"actor":{"id":1,"login":"a"}', '"actor":""'), swap('"actor":{"id":1,"login":"a"}', '"actor":null'),
    *[swap("T00:00:00Z", x) for x in ("T24:00:00Z", "T00:00:60Z", "T00:00:00", "T00:00:00+23:59", "T00:00:00.123456789-05:30", "T00:00:00+24:00", "T00:00:00Z\\n", " 00:00:00Z")],
    swap("-01-05T", "-02-29T"), swap("2026-", "0000-"), swap("o/r", "o/r\\n"), swap("o/r", "o\\u00a0/r"), swap("o/r", "o/r/s"), swap("PushEvent", "pushEvent"), swap("PushEvent", "SomethingNewEvent"),
]
ROW = "800000933886,104551567,%s,1003199286,CreateEvent,,2026-01-17T02:32:32Z,2026-01-17T02:00:00Z,f.gz,123093,7d1a94b6adb691bb1dc92340f1e41ac2eaeb30407c70a893fe339929a7eea18d"
CSV_LINES = [
    *[ROW % x for x in ("a/b", '"a/b"', '"a/""b"', '"a/b', 'a"/b', '"a/b"x', 'x"a/b"', '"a,/b"', '"a/\nb"', "a/b\n", '"a/b,c"', '""', '""""', '"""a/b"', '"a/b"""', '"a/b""c"""', '"""" ,a', " a/b", '"a/' + '""' * 20_000 + '"', 'a\\"/b', '"a/b\\"', '"","')],
    None, "", ",", '"', '""', '","', ROW % "a/b" + ",", ROW % "a/b" + "\r\n", (ROW % "a/b") + "," * 20_000, "#" + ROW % "a/b", (ROW % "a/b").replace(",", ";"), (ROW % "a/b").upper(),
]


@pytest.mark.parametrize(("kind", "lines", "reason"), [("json", JSON_LINES, json_reason), ("csv", CSV_LINES, csv_reason)])
def test_reasons_equal_brute_force_and_every_line_is_accounted_for(spark, kind, lines, reason):
    rows = [(i, x, "u", 1, 2) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, f"line_id long, raw_{kind} string, source_uri string, _key int, _p int")
    got = {r[0]: r[1] for r in raw_lines.first_reasons(df, kind).collect()}
    assert got == {i: w for i, x in enumerate(lines) if (w := reason(x))}
    good, bad = raw_lines.load_lines(df, kind)
    kept, broken = [r["line_id"] for r in good.collect()], [r["line_id"] for r in bad.collect()]
    assert sorted(kept + broken) == list(range(len(lines)))
    assert set(broken) == set(got)


def test_repeated_and_null_keys_are_judged_apart(spark):
    df = spark.createDataFrame([(1, GOOD, "u"), (1, "x", "u"), (1, "x", "u"), (None, "x", "u"), (None, GOOD, "u")], "line_id long, raw_json string, source_uri string")
    good, bad = raw_lines.load_lines(df, "json")
    assert sorted(str(r["line_id"]) for r in good.collect()) == ["1", "None"]
    assert sorted(str(r["line_id"]) for r in bad.collect()) == ["1", "1", "None"]


def test_empty_table(spark):
    for kind in ("json", "csv"):
        df = spark.createDataFrame([], f"line_id long, raw_{kind} string, source_uri string")
        good, bad = raw_lines.load_lines(df, kind)
        assert good.count() == bad.count() == 0


def test_values_of_good_rows(spark):
    line = swap("T00:00:00Z", "T00:00:00.1234567+05:30")
    df = spark.createDataFrame([(1, line, "u")], "line_id long, raw_json string, source_uri string")
    row = raw_lines.load_lines(df, "json")[0].first()
    assert (row.event_id, row.actor_id, row.repo_name) == ("5", 1, "o/r")
    assert row.event_time.isoformat() == "2026-01-04T18:30:00.123456"


def test_silver_reasons_warnings_and_validity_before_dedup(spark):
    old, new = "a/2026-01-05-0.json.gz", "a/2026-01-05-1.json.gz"
    rows = [(GOOD, new), (GOOD.replace('"login":"a"', '"login":"b"'), old), (GOOD.replace("true", "false"), old), (swap('"id":"5"', '"id":"6"').replace("PushEvent", "OddEvent"), old), ("{", old), (swap("o/r", "or").replace('"5"', '"x"'), old)]
    n = silver.normalize(spark.createDataFrame(rows, "raw_json string, source_uri string"))
    lines = silver.settled(n)
    clean, quarantine, duplicates = silver.split(lines)
    assert {(r.event_id, r.actor_login) for r in clean.collect()} == {("5", "b"), ("6", "a")}
    assert [r.duplicate_rank for r in duplicates.collect()] == [2]
    assert sorted(r.validation_errors[0] for r in quarantine.collect()) == ["invalid_event_id", "invalid_json_or_field_type", "not_public"]
    assert next(r.validation_errors for r in quarantine.collect() if r.validation_errors[0] == "invalid_event_id") == ["invalid_event_id", "invalid_repo_name"]
    warned = {r.label: r.n for r in silver.label_counts(n.where("size(validation_errors) = 0"), "quality_warnings").collect()}
    assert warned == {"unknown_event_type": 1, "outside_archive_hour": 1}
    assert silver.accounting(lines).first().asDict() == {"lines": 6, "clean": 2, "quarantined": 3, "duplicates": 1}
    assert set(clean.columns) == set(silver.CLEAN_COLUMNS)


def test_silver_trims_and_reads_what_an_object_begins(spark):
    uri = "a/2026-01-05-0.json.gz"
    rows = [(swap('"id":"5"', '"id":" 7 "'), uri), (GOOD + "}", uri), (swap('"login":"a"', '"login":"  "'), uri), (None, uri)]
    df = spark.createDataFrame(rows, "raw_json string, source_uri string")
    lenient = {r.raw_json: r.validation_errors for r in silver.normalize(df).collect()}
    strict = {r.raw_json: r.validation_errors for r in silver.normalize(df, strict=True).collect()}
    assert lenient[rows[0][0]] == strict[rows[0][0]] == [] and lenient[rows[1][0]] == []
    assert strict[rows[1][0]] == ["invalid_json_or_field_type"] and lenient[rows[2][0]] == ["missing_actor_login"]
    assert lenient[None][0] == "invalid_json_or_field_type"
    assert {r.event_id for r in silver.normalize(df).where("size(validation_errors) = 0").collect()} == {"7", "5"}


def test_many_copies_of_one_event_are_ranked_in_blocks(spark):
    rows = [(GOOD, f"a/2026-01-05-{h}.json.gz") for h in (1, 0, 0, 0, 3)] + [(GOOD.replace('"login":"a"', '"login":"b"'), "a/2026-01-05-0.json.gz"), (GOOD, "odd name")]
    lines = silver.settled(silver.normalize(spark.createDataFrame(rows, "raw_json string, source_uri string")))
    got = sorted((r.duplicate_rank, r.source_filename) for r in lines.collect())
    assert [r for r, _ in got] == list(range(1, 8))
    assert [f for _, f in got] == ["2026-01-05-0.json.gz"] * 4 + ["2026-01-05-1.json.gz", "2026-01-05-3.json.gz", "odd name"]


def test_silver_snapshot_accounts_for_every_line(spark, tmp_path):
    root = f"file://{tmp_path}/silver"
    rows = [(GOOD, "a/2026-01-05-0.json.gz"), (GOOD, "a/2026-01-05-1.json.gz"), ("{", "a/2026-01-05-0.json.gz"), (swap('"id":"5"', '"id":"6"'), "a/2026-01-05-0.json.gz")]
    df = spark.createDataFrame(rows, "raw_json string, source_uri string")
    place, reused = silver.publish(spark, df, root, {"sources": "x"})
    m = snapshots.verify(spark, place)
    assert not reused and m["facts"]["lines"] == 4 and m["rows"] == {"events": 2, "quarantine": 1, "duplicates": 1, "repository_daily_stats": 1}
    assert silver.publish(spark, df, root, {"sources": "x"}) == (place, True)
    assert set(snapshots.views(spark, place)) == {"events", "quarantine", "duplicates", "repository_daily_stats"}
    assert spark.sql("select count(*) from events where repo_id = :r", args={"r": 1}).first()[0] in (0, 2)
    for other, quota in ((df.where("raw_json = '{'"), None), (df, 10)):
        with pytest.raises(snapshots.ContractBroken):
            silver.publish(spark, other, root, {"sources": "y"}, quota_bytes=quota)
    assert snapshots.current(spark, root) == place
