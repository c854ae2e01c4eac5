"""Streams over several micro-batches, with restarts."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import keyed, pnl, positions
from tickloom.operators.segments import SEGMENT_ROWS
from tickloom.registry import views
from tickloom.session import scratch_path
from tickloom.streaming import changes, jobs, landing, openings

SMALL = "/root/testdata/sf0.001"


def add_files(spark, path, frame, order, parts=4):
    """Append the rows to a folder as several files, earlier rows first."""
    ordered = frame.orderBy(order).repartitionByRange(parts, order)
    for part in range(parts):
        ordered.filter(F.spark_partition_id() == part).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(frame, target, checkpoint, merge):
    query = changes.write_parts(frame, target, checkpoint, merge)
    query.awaitTermination()
    assert query.exception() is None


def rows(frame):
    return sorted(map(str, frame.select(*sorted(frame.columns)).collect()))


def test_latest_items_over_batches_restart_and_compaction(spark):
    keys, order = ["asset", "model_type"], ["updated_at", "seq"]
    merge = jobs.latest_items(keys, order)
    puts = views.kv_puts(spark, SMALL)
    path, target, checkpoint = (scratch_path(spark, n) for n in ("puts", "changes", "offsets"))
    add_files(spark, path, puts.filter("seq < 600"), "seq", 3)
    run(stream(spark, path, puts.schema), target, checkpoint, merge)
    assert len(os.listdir(target)) >= 3
    early = rows(keyed.latest_per_key(puts.filter("seq < 600"), keys, order))
    assert rows(changes.current(spark, target, merge)) == early
    changes.compact(spark, target, merge)
    assert rows(changes.current(spark, target, merge)) == early
    add_files(spark, path, puts.filter("seq >= 600"), "seq", 3)
    run(stream(spark, path, puts.schema), target, checkpoint, merge)
    expected = rows(keyed.latest_per_key(puts, keys, order))
    assert rows(changes.current(spark, target, merge)) == expected
    last = changes.compact(spark, target, merge)
    assert rows(changes.current(spark, target, merge)) == expected
    assert changes.compact(spark, target, merge) == last


def test_expired_items_go_and_folders_stay_few(spark):
    schema = "k int, v int, updated_at timestamp_ntz, seq long, expiration_time long"
    merge, target = jobs.latest_items(["k"], ["updated_at", "seq"]), scratch_path(spark, "changes")
    moment = datetime.datetime(2024, 1, 1)
    for number in range(20):
        batch = spark.createDataFrame([(number, number, moment, number, number), (-1, number, moment, number, None)], schema)
        merge(batch).coalesce(1).write.mode("overwrite").parquet(f"{target}/batch={number}")
        if number % 4 == 3:
            changes.compact(spark, target, merge, keep=lambda items, now=number - 2: keyed.live(items, F.lit(now)))
            assert sum(name.startswith(("batch=", "upto=")) for name in os.listdir(target)) <= 6
    kept = {(r.k, r.v) for r in changes.current(spark, target, merge).collect()}
    assert kept == {(-1, 19), (18, 18), (19, 19)}


def test_a_batch_that_runs_again_counts_once_and_an_unfinished_one_not_at_all(spark):
    merge, target = jobs.add_up, scratch_path(spark, "changes")
    batch = spark.createDataFrame([(datetime.date(2024, 1, 1), 1, 2.0, 1)], "day date, symbol long, pnl double, entries long")
    for number in (0, 0, 1):
        merge(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")
    os.remove(f"{target}/batch=1/_SUCCESS")
    assert [r.pnl for r in changes.current(spark, target, merge).collect()] == [2.0]
    changes.compact(spark, target, merge)
    merge(batch).write.mode("overwrite").parquet(f"{target}/batch=0")
    assert [r.pnl for r in changes.current(spark, target, merge).collect()] == [2.0]
    merge(batch).write.mode("overwrite").parquet(f"{target}/batch=1")
    assert [r.pnl for r in changes.current(spark, target, merge).collect()] == [4.0]


def test_no_finished_batch_is_an_error(spark):
    with pytest.raises(ValueError, match="no finished batch"):
        changes.current(spark, scratch_path(spark, "changes"), jobs.add_up)


def test_stops_over_batches_equal_the_last_of_the_history(spark):
    marks = views.marks(spark, SMALL)
    path, target, checkpoint = (scratch_path(spark, n) for n in ("marks", "changes", "offsets"))
    add_files(spark, path, marks, F.col("mark_id") % 7)
    run(jobs.scored_marks(stream(spark, path, marks.schema)), target, checkpoint, jobs.best_stops)
    stopped = positions.ratchet(marks).groupBy("position_id")
    last = stopped.agg(F.max_by(F.struct("side", "stop"), F.struct("mark_time", "mark_id")).alias("last")).select("position_id", "last.*")
    actual = jobs.stops_in_force(changes.current(spark, target, jobs.best_stops))
    assert rows(actual) == rows(last.filter("stop IS NOT NULL"))


def test_daily_profit_over_batches_includes_the_open_day(spark):
    income = views.income(spark, SMALL)
    path, target, checkpoint = (scratch_path(spark, n) for n in ("income", "changes", "offsets"))
    add_files(spark, path, income, "income_time")
    run(jobs.pnl_entries(stream(spark, path, income.schema)), target, checkpoint, jobs.add_up)
    actual = changes.current(spark, target, jobs.add_up).withColumn("pnl", F.round("pnl", 6))
    assert rows(actual) == rows(pnl.daily_pnl(income).withColumn("pnl", F.round("pnl", 6)))


def test_late_income_counts(spark):
    schema = "event_id long, symbol long, income_type string, income double, income_time timestamp_ntz"
    path, target, checkpoint = (scratch_path(spark, n) for n in ("income", "changes", "offsets"))
    for number, day in enumerate([1, 9, 2, 8, 1]):
        row = [(number, 1, "REALIZED_PNL", 1.0, datetime.datetime(2024, 1, day))]
        spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(path)
        run(jobs.pnl_entries(stream(spark, path, schema)), target, checkpoint, jobs.add_up)
    days = {(r["day"].day, r["pnl"], r["entries"]) for r in changes.current(spark, target, jobs.add_up).collect()}
    assert days == {(1, 2.0, 2), (2, 1.0, 1), (9, 1.0, 1), (8, 1.0, 1)}


def test_landing_takes_each_file_once_and_archives(spark, tmp_path):
    source, archive = tmp_path / "in", tmp_path / "done"
    source.mkdir()
    record = {"timestamp": "2024-01-01 00:00:05", "asset": "A", "price": "1.5", "source_id": 0, "engine": 0}
    target, checkpoint = scratch_path(spark, "landed"), scratch_path(spark, "offsets")
    for number in range(4):
        body = record if number % 2 else [record, dict(record, asset="B", timestamp="2024-01-02 00:00:00")]
        (source / f"{number}.json").write_text(json.dumps(body, indent=4))
        landed = jobs.landing_stream(spark, str(source), str(archive))
        jobs.land(landed, target, checkpoint).awaitTermination()
    result = spark.read.parquet(target)
    assert result.count() == 6
    assert {str(r[0]) for r in result.select("scraped_date").distinct().collect()} == {"2024-01-01", "2024-01-02"}
    assert list(archive.rglob("*.json"))


def _record(**more):
    return {"timestamp": "2024-01-01 00:00:05", "asset": "A", "price": "1.5", "source_id": 0, "engine": 0, **more}


def test_a_bad_file_does_not_stop_the_stream(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", scratch_path(spark, "landed"), scratch_path(spark, "offsets")
    source.mkdir()
    bodies = {
        "good.json": json.dumps(_record(), indent=4),
        "list.json": json.dumps([_record(), _record(asset="B")]),
        "cut.json": json.dumps([_record(), _record()])[:-20],
        "text.json": "nothing of the kind",
        "number.json": "5",
        "type.json": json.dumps([_record(source_id="x"), _record(asset="C"), _record(price="n/a"), None]),
        "lacking.json": json.dumps({"asset": "D"}),
        "none.json": "[]",
        "blank.json": " \n",
    }
    for name, body in bodies.items():
        (source / name).write_text(body)
    for files_per_batch in (2, None):
        files = landing.file_stream(spark, str(source), files_per_batch=files_per_batch)
        query = landing.land_files(files, target, checkpoint)
        query.awaitTermination()
        assert query.exception() is None
        (source / "late.json").write_text(json.dumps(_record(asset="late")))
    got = landing.landed(spark, target).collect()
    assert sorted(r.asset for r in got) == ["A", "A", "B", "C", "D", "late"]
    assert {r.source_file.rsplit("/", 1)[1] for r in got} == {"good.json", "list.json", "type.json", "lacking.json", "late.json"}
    rejects = {(r.source_file.rsplit("/", 1)[1], r.reason) for r in landing.rejected(spark, target).collect()}
    assert rejects == {("cut.json", "no records"), ("text.json", "no records"), ("number.json", "no records"),
                       ("type.json", "value of source_id"), ("type.json", "value of price"), ("type.json", "no object")}
    texts = {r.source_file.rsplit("/", 1)[1]: r.text for r in landing.rejected(spark, target).filter("reason = 'no records'").collect()}
    assert texts == {name: bodies[name] for name in ("cut.json", "text.json", "number.json")}
    assert landing.processed(spark, target).count() == 10


def test_a_landing_batch_that_runs_again_counts_once(spark, tmp_path):
    source, target = tmp_path / "in", scratch_path(spark, "landed")
    source.mkdir()
    (source / "a.json").write_text(json.dumps([_record(), _record(price="?")]))
    for _ in range(2):
        # A new checkpoint makes the second run repeat batch 0.
        landing.land_files(landing.file_stream(spark, str(source)), target, scratch_path(spark, "offsets")).awaitTermination()
        assert (landing.landed(spark, target).count(), landing.rejected(spark, target).count()) == (1, 1)
    os.remove(f"{target}/landed/batch=0/_SUCCESS")
    assert landing.landed(spark, target).count() == 0 and landing.landed(spark, target).columns[-1] == "source_file"


def test_files_go_from_pending_to_landed_to_archived(spark, tmp_path):
    source, archive, target, checkpoint = tmp_path / "in", tmp_path / "done", scratch_path(spark, "landed"), scratch_path(spark, "offsets")
    source.mkdir()

    def states():
        return {r.file: (r.state, r.batch, r.records) for r in landing.lifecycle(spark, str(source), str(archive), target).collect()}

    def run():
        files = landing.file_stream(spark, str(source), str(archive), files_per_batch=1)
        landing.land_files(files, target, checkpoint).awaitTermination()

    for number in range(3):
        (source / f"{number}.json").write_text(json.dumps([_record()] * number))
        os.utime(source / f"{number}.json", (number, number))
    run()
    assert states() == {"0.json": ("archived", 0, 0), "1.json": ("archived", 1, 1), "2.json": ("landed", 2, 2)}
    (source / "3.json").write_text(json.dumps(_record()))
    assert states()["3.json"] == ("pending", None, 0)
    run()
    assert states()["2.json"] == ("archived", 2, 2) and states()["3.json"] == ("landed", 3, 1)


def test_a_landing_batch_reads_its_files_once_and_lists_them_in_few_tasks(spark, tmp_path):
    source, target = tmp_path / "in", scratch_path(spark, "landed")
    source.mkdir()
    bodies = [json.dumps(_record()), json.dumps([_record(), _record(price="?")]), "cut {", " \n"]
    for number in range(60):
        (source / f"{number}.json").write_text(bodies[number % 4])
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        reads.add(1)
        return text

    files = landing.file_stream(spark, str(source)).withColumn("text", seen("text"))
    query = landing.land_files(files, target, scratch_path(spark, "offsets"))
    query.awaitTermination()
    assert query.exception() is None and reads.value == 60
    assert (landing.landed(spark, target).count(), landing.rejected(spark, target).count()) == (30, 30)
    assert sorted((r.records, r.rejects) for r in landing.processed(spark, target).collect()) == sorted([(1, 0), (1, 1), (0, 1), (0, 0)] * 15)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(j).stageIds]
    assert len(stages) >= 4 and max(stage.numTasks for stage in stages) <= 2 * spark.sparkContext.defaultParallelism


def test_settings_of_the_deployment_stay_as_they_are(spark, tmp_path):
    key = "spark.sql.streaming.fileSource.cleaner.numThreads"
    spark.conf.set(key, "2")
    try:
        landing.file_stream(spark, str(tmp_path), str(tmp_path / "done"))
        assert spark.conf.get(key) == "2"
        spark.conf.unset(key)
        landing.file_stream(spark, str(tmp_path), str(tmp_path / "done"))
        assert int(spark.conf.get(key)) > 1
    finally:
        spark.conf.unset(key)


def _item(spark, number):
    moment = datetime.datetime(2024, 1, 1)
    rows = [(number % 7, number, moment, number), (100 + number % 13, number, moment, number)]
    return spark.createDataFrame(rows, "k int, v int, updated_at timestamp_ntz, seq long").coalesce(1)


def _summed(parts):
    return parts.groupBy("k").agg(F.sum("v").alias("v"), F.max("updated_at").alias("updated_at"), F.max("seq").alias("seq"))


def test_fifty_batches_leave_few_folders_and_the_same_result(spark, monkeypatch):
    """Spans of four; batches that run again, a compaction in the middle, and one that is still going on."""
    monkeypatch.setattr(changes, "FAN_IN", 4)
    target = scratch_path(spark, "changes")
    for number in range(50):
        changes.write_part(_item(spark, number), target, number, _summed)
        if number in (15, 33):
            changes.write_part(_item(spark, number), target, number, _summed)
        if number == 21:
            changes.compact(spark, target, _summed)
        if number == 37:
            os.makedirs(f"{target}/intent=37")
        if number % 7 == 0 or number == 49:
            want = {}
            for n in range(number + 1):
                for k in (n % 7, 100 + n % 13):
                    want[k] = want.get(k, 0) + n
            assert {r.k: r.v for r in changes.current(spark, target, _summed).collect()} == want
            assert len(changes._parts(spark, target)) <= 12
            assert sum("=" in name for name in os.listdir(target)) <= 30
    assert changes.compact(spark, target, _summed) == 49
    changes.write_part(_item(spark, 50), target, 50, _summed)
    assert changes.compact(spark, target, _summed) == 50
    assert sorted(name for name in os.listdir(target) if "=" in name and "intent" not in name) == ["batch=50", "upto=49", "upto=50"]


def test_a_compaction_that_ends_after_a_span_was_merged_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(changes, "FAN_IN", 2)
    target = scratch_path(spark, "changes")
    write = changes.write_part
    for number in range(3):
        write(_item(spark, number), target, number, _summed)
    late = []

    def merging(parts):
        """The stream goes on for six batches while the compaction runs."""
        if not late:
            late.append(True)
            for number in range(3, 9):
                write(_item(spark, number), target, number, _summed)
        return _summed(parts)

    assert changes.compact(spark, target, merging) == 2
    total = sum(r.v for r in changes.current(spark, target, _summed).collect())
    assert total == 2 * sum(range(9))
    for number in range(9, 16):
        write(_item(spark, number), target, number, _summed)
    assert sum(r.v for r in changes.current(spark, target, _summed).collect()) == 2 * sum(range(16))


@pytest.mark.parametrize("rows_per_bucket", ["5", "100000"])
def test_openings_over_batches_equal_a_walk_over_each_position(spark, monkeypatch, rows_per_bucket):
    """Random turns, flat marks, and batches that cut runs anywhere; merged in tiers of two."""
    monkeypatch.setattr(changes, "FAN_IN", 2)
    source = random.Random(5)
    start, marks = datetime.datetime(2024, 1, 1), []
    side = {p: 1.0 for p in range(4)}
    for i in range(300):
        p = source.randrange(4)
        if source.random() < 0.2:
            side[p] = source.choice([1.0, -2.0, 0.0])
        marks.append((i, p, side[p], 100.0, float(source.randint(60, 150)), 5, start + datetime.timedelta(seconds=i // 3)))
    schema = "mark_id long, position_id int, position_amt double, entry_price double, mark_price double, leverage int, mark_time timestamp_ntz"
    candidates = {r.mark_id: r.candidate for r in positions.stop_candidates(spark.createDataFrame(marks, schema)).collect()}
    want = {}
    for i, p, amount, *_, time in marks:
        now = "LONG" if amount > 0 else "SHORT" if amount < 0 else None
        was, opened, best = want.get(p, (object(), None, None))
        if now != was:
            opened, best = (time, i), None
        if candidates[i] is not None:
            best = candidates[i] if best is None else (max if now == "LONG" else min)(best, candidates[i])
        want[p] = (now, opened, best)
    want = {p: (now, *opened, best) for p, (now, opened, best) in want.items() if now and best is not None}
    target = scratch_path(spark, "changes")
    spark.conf.set(SEGMENT_ROWS, rows_per_bucket)
    try:
        for number, (begin, end) in enumerate([(0, 7), (7, 60), (60, 61), (61, 190), (190, 300)]):
            batch = marks[begin:end]
            source.shuffle(batch)
            changes.write_part(openings.stretches(spark.createDataFrame(batch, schema)), target, number, openings.join_stretches)
    finally:
        spark.conf.unset(SEGMENT_ROWS)
    found = openings.open_stops(changes.current(spark, target, openings.join_stretches)).collect()
    assert {r.position_id: (r.side, r.opened_at, r.opened_by, r.stop) for r in found} == want and len(want) >= 2
