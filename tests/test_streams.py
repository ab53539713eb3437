"""State that ends: the same rows over many micro-batches as at once, and fewer state rows once their time is over."""

from __future__ import annotations

import os
import random

import pytest

from gristmill.streaming import stateful as S

DAY = 86_400


def as_stream(spark, folder, rows, schema, parts):
    """``rows`` in order of time as ``parts`` files, a micro-batch each."""
    folder.mkdir(parents=True)
    for k in range(parts):
        own = rows[len(rows) * k // parts:len(rows) * (k + 1) // parts]
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(str(folder / f"p{k}"))
        for f in (folder / f"p{k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


def drained(stream, folder):
    """(rows, state rows after each micro-batch)."""
    query = (stream.writeStream.format("parquet").option("checkpointLocation", str(folder / "state")).option("path", str(folder / "rows"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return sorted((tuple(r) for r in stream.sparkSession.read.schema(stream.schema).parquet(str(folder / "rows")).collect()), key=repr), states


def events(n, users, span, seed):
    r = random.Random(seed)
    times = sorted(r.randrange(span) for _ in range(n))
    return [(k, r.randrange(users), 1_700_000_000 + t, r.choice(["enqueue", "cancel", "done", "failed", "-"])) for k, t in enumerate(times)]


SCHEMA = "id long, u long, s long, said string"
FORMS = {
    "claims": lambda d: S.claims(d, ["u"], "ts", 500),
    "cached": lambda d: S.cached_lookups(d.selectExpr("*", "said = 'done' as asks", "case when id % 2 = 0 then 'save' end as stage"), ["u"], "ts", "id", "stage", "asks", 300),
    "batches": lambda d: S.batches(d, ["u"], "ts", "id", 3, 700),
    "jobs": lambda d: S.job_outcomes(d, ["u"], "ts", "id", "said", 400, 1),
}


@pytest.mark.parametrize("form", FORMS)
def test_many_batches_give_the_same_rows(spark, tmp_path, form):
    rows = events(240, 6, 20_000, 5)
    found = []
    for parts in (1, 6):
        stream = as_stream(spark, tmp_path / f"in{parts}", rows, SCHEMA, parts).selectExpr("*", "timestamp_seconds(s) as ts")
        found.append(drained(FORMS[form](stream), tmp_path / f"out{parts}")[0])
    assert found[0] == found[1] and len(found[0]) > 30


@pytest.mark.parametrize("form", ["claims", "cached", "batches"])
def test_state_rows_fall_when_their_time_is_over(spark, tmp_path, form):
    # a hundred keys once, then one other key a day later, twice
    rows = [(k, k, 1_700_000_000 + k, "enqueue") for k in range(100)] + [(100 + k, 1000, 1_700_000_000 + (k + 1) * DAY, "enqueue") for k in range(2)]
    stream = as_stream(spark, tmp_path / "in", rows, SCHEMA, 6).selectExpr("*", "timestamp_seconds(s) as ts")
    _, states = drained(FORMS[form](stream), tmp_path / "out")
    assert max(states) > 50 and states[-1] <= 2


def test_claims_and_late_rows(spark, tmp_path):
    rows = [(0, 1, 1_700_000_000, ""), (1, 1, 1_700_000_400, ""), (2, 1, 1_700_000_500, ""), (3, 2, 1_700_100_000, ""), (4, 1, 1_700_000_900, ""), (5, None, 1_700_100_000, ""), (6, 1, None, "")]
    stream = as_stream(spark, tmp_path / "in", rows, SCHEMA, 3).selectExpr("*", "timestamp_seconds(s) as ts")
    found, _ = drained(S.claims(stream, ["u"], "ts", 500), tmp_path / "out")
    # the row of id 4 is behind the watermark that id 3 set, and id 6 has no time
    assert [(u, t.timestamp() % 1_000_000) for u, t in found] == [(1, 0.0), (1, 500.0), (2, 100_000.0), (None, 100_000.0)]


def test_cache_bounds_and_stages(spark, tmp_path):
    at = 1_700_000_000
    rows = [(0, 1, at, "put"), (1, 1, at + 59, "study"), (2, 1, at + 60, "study"), (3, 2, at, "save-put"), (4, 2, at + 10, "study"), (5, 2, at + 10, "save"), (6, 1, at + 30, "save")]
    stream = as_stream(spark, tmp_path / "in", rows, SCHEMA, 1).selectExpr("*", "timestamp_seconds(s) as ts", "said not like '%put' as asks", "split(said, '-')[0] as stage")
    found, _ = drained(S.cached_lookups(stream, ["u"], "ts", "id", "stage", "asks", 5), tmp_path / "out")
    assert sorted(r[1:] for r in found) == [(1, True), (2, False), (4, False), (5, True), (6, True)]


def test_job_marks_and_attempts(spark, tmp_path):
    at = 1_700_000_000
    said = ["cancel", "done", "done", "failed", "failed", "failed", "cancel", "enqueue", "failed", "cancel", "failed", "-", "done"]
    rows = [(k, 1, at + 10 * k, x) for k, x in enumerate(said)] + [(50, 2, at, "cancel"), (51, 2, at + 400, "done")]
    stream = as_stream(spark, tmp_path / "in", rows, SCHEMA, 2).selectExpr("*", "timestamp_seconds(s) as ts")
    found, _ = drained(S.job_outcomes(stream, ["u"], "ts", "id", "said", 400, 1), tmp_path / "out")
    assert [r[1:] for r in sorted(found, key=lambda r: r[1])] == [
        (1, "cancelled", 0), (2, "done", 0), (3, "retried", 1), (4, "discarded", 2), (5, "retried", 1), (8, "retried", 1), (10, "cancelled", 1), (12, "done", 1), (51, "done", 0)]


def test_no_input(spark, tmp_path):
    stream = as_stream(spark, tmp_path / "in", [], SCHEMA, 1).selectExpr("*", "timestamp_seconds(s) as ts")
    assert S.run_available(S.claims(stream, ["u"], "ts", 5)).count() == 0
    assert S.run_available(S.progress(stream, ["u"], ["s"]), "update").count() == 0


def test_keys_share_the_states_of_groups(spark, tmp_path):
    """More keys than groups make no more states than groups; keys of any type, null or not, and large ids come back as they were."""
    n, big = 3 * S.GROUPS, 2**62 + 1
    rows = [(big + k, k % n if k % 7 else None, 1_700_000_000 + k, "x" if k % 5 else None) for k in range(2 * n)] + [(None, 1, 1_700_000_000, "y")]
    stream = as_stream(spark, tmp_path / "in", rows, SCHEMA, 2).selectExpr("*", "timestamp_seconds(s) as ts", "timestamp_micros(u * 1000001) as at", "u / 3 as part")
    keys = ["u", "said", "at", "part"]
    query = S.batches(stream, keys, "ts", "id", 2, DAY)
    found, states = drained(query, tmp_path / "out")
    assert max(states) <= S.GROUPS
    same = {}
    for i, u, s, said in sorted(rows, key=lambda r: (r[2], str(r[0]))):
        same.setdefault((u, said), []).append(i)
    want = {(u, said, own[k], own[k + 1]) for (u, said), own in same.items() for k in range(0, len(own) - 1, 2)}
    assert {(r[0], r[1], r[6], r[7]) for r in found} == want
    assert all(r[2] is None if r[0] is None else (r[2].timestamp(), r[3]) == pytest.approx((r[0] * 1000001 / 1e6, r[0] / 3)) for r in found)
