"""Streams driven from files, and detector behaviour."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from murkwatch.operators import dashboards
from murkwatch.session import bounded_stream, cut_lineage
from murkwatch.streaming import drift, feed


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_monitor_stable_and_drift():
    m = drift.Monitor()
    rng = random.Random(42)
    assert all(m.update(0)["status"] != "drift" for _ in range(300))
    m = drift.Monitor()
    for _ in range(200):
        assert m.update(int(rng.random() < 0.02))["status"] != "drift"
    seen = [i for i in range(300) if m.update(1)["status"] == "drift"]
    assert seen and seen[0] <= 100
    assert drift.Monitor(m.state()).state() == m.state()


def test_error_window():
    m = drift.Monitor()
    for x in [1] * 5 + [0] * 5:
        last = m.update(x)
    assert last["error_rate_current"] == 0.5


def test_adwin_delay():
    rng = random.Random(1)
    a = drift.Adwin()
    fired = [t for t in range(2000) if a.update(int(rng.random() < (0.05 if t < 1000 else 0.40)))]
    assert [t for t in fired if t < 1000] == [] and fired[0] - 1000 < 150


def test_drift_stream_with_reset(spark, tmp_path):
    rng = random.Random(7)
    rows = [("a", i, int(rng.random() < (0.05 if i < 500 else 0.6)), False) for i in range(900)] + [("a", 900, 0, True)] + [
        ("b", i, 0, False) for i in range(300)]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "module string, i int, error int, reset boolean").selectExpr(
        "module", "timestamp_seconds(1700000000 + i) AS ts", "error", "reset").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("module string, ts timestamp, error int, reset boolean").parquet(str(src))
    out = run(drift.drift_signals(stream), tmp_path, "signals", "append").collect()
    assert {r.module for r in out} == {"a"}
    assert any(r.status == "drift" and r.n > 500 for r in out)


def test_feed_streams(spark, tmp_path):
    src = tmp_path / "ev"
    spark.sql("""SELECT 'e' || id AS event_id, timestamp_seconds(1700000000 + id * 60) AS ts, 'URL' AS source_type,
        CASE WHEN id % 2 = 0 THEN 'HIGH' ELSE 'CLEAN' END AS risk_level, 'p' || (id % 5) AS payload_hash FROM range(200)""").coalesce(1).write.parquet(str(src))
    schema = "event_id string, ts timestamp, source_type string, risk_level string, payload_hash string"
    stream = spark.readStream.schema(schema).parquet(str(src))
    batch = spark.read.parquet(str(src))
    got = run(feed.windowed_counts(stream, width="1 hour"), tmp_path, "counts", "complete").agg(F.sum("n"), F.sum("urgent")).first()
    assert tuple(got) == (200, 100)
    assert feed.windowed_counts(batch, width="1 hour").agg(F.sum("n")).first()[0] == 200
    kept = run(feed.drop_repeats(stream, ttl_seconds=600), tmp_path, "kept")
    assert kept.count() >= 5
    assert feed.drop_repeats(batch, ttl_seconds=600).count() == 70  # of every 300 s, those 900 s apart


def test_suppressed_rows_do_not_renew(spark):
    rows = spark.sql("SELECT 'p' AS payload_hash, timestamp_seconds(300 * id) AS ts, id FROM range(12)")
    assert sorted(r.id for r in feed.drop_repeats(rows, ttl_seconds=600).collect()) == [0, 3, 6, 9]


def test_first_adwin_signal(spark):
    rng = random.Random(2)
    rows = [("a", i, int(rng.random() < (0.05 if i < 1000 else 0.5))) for i in range(1600)] + [("b", i, i % 10 == 0) for i in range(600)]
    stream = spark.createDataFrame([(m, i, int(e)) for m, i, e in rows], "module string, event_id long, error int").selectExpr(
        "*", "timestamp_seconds(1700000000 + event_id) AS ts")
    found = {r.module: r.adwin_at for r in drift.adwin(drift.numbered(stream)).collect()}
    assert set(found) == {"a"} and 1000 < found["a"] < 1150


def test_alert_fanout(spark, tmp_path):
    src = tmp_path / "al"
    spark.sql("SELECT id, CASE WHEN id % 4 = 0 THEN 'critical' ELSE 'low' END AS severity FROM range(40)").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("id long, severity string").parquet(str(src))
    q = feed.alert_fanout(stream, str(tmp_path / "t"), str(tmp_path / "u"), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 40 and spark.read.parquet(str(tmp_path / "u")).count() == 10


def test_fanout_replays_a_batch_into_the_same_files(spark, tmp_path):
    """A batch that fails after its first sink runs again with the same number and leaves each alert once."""
    spark.sql("SELECT id, CASE WHEN id % 4 = 0 THEN 'high' ELSE 'low' END AS severity FROM range(40)").coalesce(1).write.parquet(str(tmp_path / "al"))
    stream = spark.readStream.schema("id long, severity string").parquet(str(tmp_path / "al"))
    (tmp_path / "u").write_text("no folder")  # the second sink can't be written
    first = feed.alert_fanout(stream, str(tmp_path / "t"), str(tmp_path / "u"), str(tmp_path / "c")).trigger(availableNow=True).start()
    with pytest.raises(Exception):
        first.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 40
    again = feed.alert_fanout(stream, str(tmp_path / "t"), str(tmp_path / "u2"), str(tmp_path / "c")).trigger(availableNow=True).start()
    again.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 40 and spark.read.parquet(str(tmp_path / "u2")).count() == 10


def test_restored_detectors_go_on_as_if_never_stopped(spark):
    rng = random.Random(9)
    kind = "module string, ts timestamp, event_id long, error int"
    rows = spark.createDataFrame([(m, datetime.fromtimestamp(1700000000 + i), i, int(rng.random() < (0.05 if i < 700 else 0.5))) for m in "ab" for i in range(1200)], kind)
    order = ("ts", "event_id")
    whole, whole_at = drift.run_signals(bounded_stream(rows), order)
    before, at = drift.run_signals(bounded_stream(rows.where("event_id < 760")), order)
    control = drift.restore_rows(cut_lineage(drift.state_snapshot(spark, at)), F.expr("timestamp_seconds(1700000000 + 759.5)"))
    rest = rows.where("event_id >= 760").unionByName(control, allowMissingColumns=True)
    after, after_at = drift.run_signals(bounded_stream(rest), order)
    key = lambda r: (r.module, r.n)
    assert sorted(whole.collect(), key=key) == sorted(before.collect() + after.collect(), key=key) and whole.count() > 2
    ends = [sorted(drift.state_snapshot(spark, c).collect()) for c in (whole_at, after_at)]
    assert ends[0] == ends[1] and [r.n for r in ends[0]] == [1200, 1200]


def test_timeline_and_levels(spark):
    ev = spark.sql("SELECT 'URL' AS source_type, TIMESTAMP '2024-01-03 10:00:00' AS created_at, 'HIGH' AS risk_level, 5 AS risk_score")
    days = dashboards.timeline(ev, F.to_date(F.lit("2024-01-04"))).orderBy("day").collect()
    assert len(days) == 7 and [d.total for d in days] == [0, 0, 0, 0, 0, 1, 0]
    assert {r.risk_level: r.n for r in dashboards.risk_distribution(ev).collect()} == {"CLEAN": 0, "SUSPICIOUS": 0, "HIGH": 1, "CRITICAL": 0}
    assert dashboards.threat_summary(ev.where("false")).first().threat_level == "NONE"
