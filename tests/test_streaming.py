"""A stream must end with the table the batch job gives, however files arrive."""

import random
from datetime import date, datetime, timedelta

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from tidemark.plans import bikes, catalog, governance
from tidemark.plans.adapters import Tables
from tidemark.sources import tables
from tidemark.streaming import jobs
from tidemark.streaming.metric_log import MetricLog


@pytest.fixture
def event_files(spark, tmp_path):
    """The event table in four files, none later than another, and the views over
    them as a stream."""
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    source = str(tmp_path / "events")
    events.repartition(4, "event_id").write.parquet(source)

    def stream(files_per_batch):
        views = Tables(spark, SMALL)
        views.__dict__["events"] = jobs.file_stream(
            spark, source, events.schema, files_per_batch=files_per_batch)
        return views

    return stream


def silver_rows(df):
    plain = df.withColumn("api_timestamp", F.col("api_timestamp").cast("string"))
    return rows(plain, *bikes.PAYLOAD)


def clean(raw):
    return bikes.with_partition(bikes.silver_clean(raw, with_ingestion=True))


def run_silver(stream, silver, checkpoint, after=None):
    jobs.run_bronze_silver(
        stream.bike_stations_raw(), clean, silver,
        [*bikes.SILVER_KEYS, bikes.SILVER_PARTITION], bikes.SILVER_PARTITION, checkpoint,
        "ingestion_time", after=after)


GOLD = [(bikes.network_summary, "extraction_at"), (bikes.station_hourly, "hour_bucket")]


@pytest.mark.parametrize("files_per_batch", [1, 4])
@pytest.mark.parametrize("build, day", GOLD, ids=["summary", "hourly"])
def test_silver_and_gold_equal_batch(spark, tmp_path, event_files, files_per_batch, build, day):
    batch = bikes.silver_clean(
        Tables(spark, SMALL).bike_stations_raw(), with_ingestion=True)
    schema = bikes.with_partition(batch).schema
    silver, gold = str(tmp_path / "silver"), str(tmp_path / "gold")
    checkpoint = str(tmp_path / "mark")
    refresh = jobs.refresh_touched(
        silver, schema, gold, bikes.SILVER_PARTITION, "day",
        lambda rows: build(rows).withColumn("day", F.to_date(day)))
    for _run in range(2):  # the second run has nothing to do
        run_silver(event_files(files_per_batch), silver, checkpoint, refresh)
    got = tables.read_table(spark, silver, schema)
    # Files are not ordered by time: a later batch may hold an older copy of a
    # station and hour, which must not replace the newer one.
    assert silver_rows(got) == silver_rows(batch)
    columns = build(batch).columns
    assert rows(spark.read.parquet(gold), *columns) == rows(build(batch), *columns)


def test_a_large_batch_comes_in_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "FILE_ROWS", 50, raising=False)
    views, batches = Tables(spark, str(tmp_path)), []
    views.__dict__["events"] = spark.range(1000).select(
        F.when(F.col("id") < 998, F.col("id")).alias("event_id"), F.col("id").alias("value"))

    def seen(batch, _batch_id):
        batches.append([tuple(r) for r in batch.collect()])

    for by in (["event_id"], []):
        batches.clear()
        rows_in = catalog._streamed(views, "events", views.events, *by).events
        rows_in.select("value", F.input_file_name().alias("f")).writeStream.foreachBatch(seen).option(
            "checkpointLocation", str(tmp_path / f"mark{len(by)}")).trigger(availableNow=True).start().awaitTermination()
        assert len(batches) == 4
        assert all(len({f for _, f in batch}) == 5 for batch in batches)
        assert sorted(v for batch in batches for v, _ in batch) == list(range(1000))


def test_two_checkpoints_and_a_reset_one_lose_nothing(spark, tmp_path, event_files):
    batch = bikes.silver_clean(
        Tables(spark, SMALL).bike_stations_raw(), with_ingestion=True)
    silver = str(tmp_path / "silver")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    for half in (0, 1):  # two feeds with batch numbers of their own
        source = str(tmp_path / f"half{half}")
        events.where(F.col("event_id") % 2 == half).write.parquet(source)
        views = Tables(spark, SMALL)
        views.__dict__["events"] = jobs.file_stream(spark, source, events.schema)
        run_silver(views, silver, str(tmp_path / f"mark{half}"))
    schema = bikes.with_partition(batch).schema
    assert silver_rows(tables.read_table(spark, silver, schema)) == silver_rows(batch)
    run_silver(event_files(4), silver, str(tmp_path / "reset"))
    assert silver_rows(tables.read_table(spark, silver, schema)) == silver_rows(batch)


@pytest.mark.parametrize("files_per_batch", [1, 4])
def test_login_windows_over_midnight_equal_batch(spark, tmp_path, event_files, files_per_batch):
    sink, alerts = str(tmp_path / "logins"), str(tmp_path / "alerts")
    logins = event_files(files_per_batch).login_history().withColumn(
        "log_date", F.to_date("event_timestamp"))

    def spikes(rows):
        return governance.failed_login_spikes(rows, 0, "2 hours", "1 hour")

    refresh = jobs.refresh_touched(
        sink, logins.schema, alerts, "log_date", "window_date",
        lambda rows: spikes(rows).withColumn("window_date", F.to_date("window_start")), reach=1)
    for _run in range(2):
        jobs.append_stream(logins, sink, "log_date", str(tmp_path / "mark"), refresh)
    expected = spikes(Tables(spark, SMALL).login_history())
    assert rows(spark.read.parquet(alerts), *expected.columns) == rows(expected)


@pytest.mark.parametrize("files_per_batch", [1, 4])
def test_change_stream_does_not_depend_on_arrival(
        spark, tmp_path, event_files, files_per_batch):
    feed = event_files(files_per_batch).events.select(
        "user_id", F.col("event_id").alias("seq"), "event_type",
        (F.col("event_type") == "error").alias("is_deleted"))
    path = str(tmp_path / "users")
    jobs.apply_change_stream(feed, path, ["user_id"], "seq", str(tmp_path / "mark"))
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    last = events.groupBy("user_id").agg(
        F.max("event_id").alias("seq"), F.max_by("event_type", "event_id").alias("e"))
    for _step in range(2):
        live = tables.live_rows(spark, path, feed.schema, ["user_id"], "seq")
        assert rows(live, "user_id", "seq", "event_type") == rows(last.where("e != 'error'"))
        tables.compact_changes(spark, path, feed.schema, ["user_id"], "seq")


def test_ingest_skips_loaded_files_and_takes_new_ones(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.range(1).schema

    def ingest():
        jobs.ingest_new_files(spark, source, schema, sink, str(tmp_path / "mark"))
        return spark.read.parquet(sink).count()

    spark.range(3).coalesce(1).write.parquet(source)
    assert ingest() == 3
    assert ingest() == 3
    spark.range(2).coalesce(1).write.mode("append").parquet(source)
    assert ingest() == 5


def test_running_ingest_picks_files_up_as_they_arrive(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(3).coalesce(1).write.parquet(source)
    query = jobs.ingest_new_files(
        spark, source, spark.range(1).schema, sink, str(tmp_path / "mark"),
        available_now=False, every="1 second")
    try:
        query.processAllAvailable()
        spark.range(4).coalesce(1).write.mode("append").parquet(source)
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.read.parquet(sink).count() == 7


def test_dedup_stream_keeps_each_key_once_however_late(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    start = datetime(2024, 1, 1)
    data = [(i % 10, start + timedelta(days=(i * 37) % 400)) for i in range(40)]
    df = spark.createDataFrame(data, "k int, ts timestamp_ntz")
    df.repartition(4, "ts").write.parquet(source)
    stream = jobs.file_stream(spark, source, df.schema, files_per_batch=1)
    keyed = stream.select("k", tables.key_bucket(["k"], 3).alias("b"))
    jobs.dedup_stream(keyed, sink, ["k"], "b", str(tmp_path / "mark"))
    assert rows(spark.read.parquet(sink), "k") == [(k,) for k in range(10)]


def test_metric_log_equals_a_full_count_after_every_batch(spark, tmp_path):
    rnd = random.Random(6)
    schema = "id string, k string, v double, day date, at int"
    table, log = str(tmp_path / "t"), MetricLog(str(tmp_path / "m"), "day", {"null v": "v", "null k": "k"}, {"twice k": "k"})
    days = [date(2024, 1, 1) + timedelta(days=d) for d in range(4)]
    for batch in range(5):
        touched = rnd.sample(days, 2)
        data = {(f"i{rnd.randrange(6)}", rnd.choice(touched)): (rnd.choice(["a", "b", "c", None]), rnd.choice([None, 1.0]))
                for _ in range(12)}
        frame = spark.createDataFrame([(i, k, v, d, batch) for (i, d), (k, v) in data.items()], schema)
        tables.upsert(frame, table, ["id", "day"], "day", newest_by="at")
        stored = tables.read_table(spark, table, frame.schema)
        for _ in range(2 if batch == 2 else 1):  # a repeated batch gives the same
            log.update(stored, frame, batch)
        counted = {r.metric_name: r.metric_value for r in log.latest(spark).collect()}
        assert counted == {
            "null v": stored.where("v is null").count(), "null k": stored.where("k is null").count(),
            "twice k": stored.count() - stored.select("k").where("k is not null").distinct().count()}
        assert log.log(spark).where(F.col("batch") == batch).count() == 3
    # a day that lost its rows, and a day outside the touched ones that nothing looks at
    gone = stored.where(F.col("day") != days[0])
    log.update(gone, spark.createDataFrame([(days[0],)], "day date"), 5)
    counted = {r.metric_name: r.metric_value for r in log.latest(spark).collect()}
    assert counted["null v"] == gone.where("v is null").count()
    assert counted["twice k"] == gone.count() - gone.select("k").where("k is not null").distinct().count()


def test_dedup_stream_restarts_and_reads_no_sink(spark, tmp_path):
    source, sink, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "k int, v int"

    def land(*data):
        spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = jobs.file_stream(spark, source, spark.createDataFrame([], schema).schema, files_per_batch=1)
        jobs.dedup_stream(stream.withColumn("b", F.lit(0)), sink, ["k"], "b", mark)
        return rows(spark.read.parquet(sink), "k")

    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    land((1, 1), (1, 2), (None, 3), (2, 4))
    assert run() == [(1,), (2,), (None,)]
    land((2, 5), (None, 6), (3, 7))
    first = sorted(p.name for p in (tmp_path / "out" / "b=0").iterdir())
    assert run() == run() == [(1,), (2,), (3,), (None,)]
    assert set(first) <= {p.name for p in (tmp_path / "out" / "b=0").iterdir()}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_login_spike_window_is_sliding(spark):
    at = datetime(2024, 1, 1, 10, 4)
    data = [(at + timedelta(seconds=30 * i), "NO") for i in range(6)] + [(at, "YES")]
    logins = spark.createDataFrame(data, "event_timestamp timestamp_ntz, is_success string")
    got = governance.failed_login_spikes(logins)
    assert rows(got) == [
        (datetime(2024, 1, 1, 10, 0), datetime(2024, 1, 1, 10, 10), 6)]
