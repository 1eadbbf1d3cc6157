import re
import shutil
from datetime import date
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType, LongType, StringType, StructField, StructType,
)

from tidemark.sources import files, tables


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


# -- landing ------------------------------------------------------------------


def test_csv_null_tokens_quotes_and_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'id,name,amount\n1,"Smith, ""J""",2.5\n2,NULL,\n3,,1\nx,bad,oops\n')
    schema = StructType([StructField("id", LongType()), StructField("name", StringType()),
                         StructField("amount", DoubleType())])
    good, bad = files.split_bad_rows(files.land_csv(spark, str(tmp_path), schema))
    assert rows(good, "id", "name", "amount") == [
        (1, 'Smith, "J"', 2.5), (2, None, None), (3, None, 1.0)]
    assert [r["_corrupt_record"] for r in bad.collect()] == ["x,bad,oops"]


def test_csv_null_tokens_in_every_column_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'id,name,amount\n1,"two\nlines",NULL\nNULL,b,2\n3,c,x\n4,d\n5,"q ""e"" ",1.5\n')
    schema = StructType([StructField("id", LongType()), StructField("name", StringType()),
                         StructField("amount", DoubleType())])
    good, bad = files.split_bad_rows(files.land_csv(spark, str(tmp_path), schema))
    assert rows(good, "id", "name", "amount") == [
        (1, "two\nlines", None), (5, 'q "e" ', 1.5), (None, "b", 2.0)]
    assert sorted(r["_corrupt_record"] for r in bad.collect()) == ["3,c,x", "4,d"]


def test_json_documents_over_several_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"a": 1},\n {"a":\n 2}\n]\n')
    (tmp_path / "b.json").write_text('{\n "a": 3\n}')
    (tmp_path / "c.json").write_text('{"a": \n')
    landed = files.land_json(spark, str(tmp_path), whole_documents=True)
    good, bad = files.split_bad_rows(landed)
    values = good.select(F.variant_get("raw_data", "$.a", "int").alias("a"))
    assert rows(values) == [(1,), (2,), (3,)]
    assert [r["raw_text"] for r in bad.collect()] == ['{"a": \n']


def test_corrupt_files_are_quarantined(spark, folder):
    spark.range(3).coalesce(1).write.parquet(f"{folder}/in")
    Path(folder, "in", "cut.parquet").write_bytes(b"PAR1 and no end")
    found = files.quarantine_files(spark, f"{folder}/in", f"{folder}/bad", "*.parquet")
    assert [r.filename.rpartition("/")[2] for r in found.collect()] == ["cut.parquet"]
    good = spark.read.schema("id long").option("ignoreCorruptFiles", "true").parquet(
        f"{folder}/in")
    assert rows(good) == [(0,), (1,), (2,)]


def test_json_keeps_unparseable_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": \n{"a": "x"}\n')
    good, bad = files.split_bad_rows(files.land_json(spark, str(tmp_path)))
    values = good.select(F.try_variant_get("raw_data", "$.a", "int").alias("a"))
    assert rows(values) == [(1,), (None,)]
    assert [r["raw_text"] for r in bad.collect()] == ['{"a": ']


def test_parquet_keeps_dotted_names_and_the_file(spark, folder):
    spark.createDataFrame([(1, 5)], "id int, `extra.slots` int").write.parquet(
        f"{folder}/in")
    raw = files.land_parquet(spark, f"{folder}/in")
    got = raw.select(F.variant_get("raw_data", '$["extra.slots"]', "int").alias("s"),
                     F.col("filename").contains("/in/part-").alias("f"),
                     F.col("ingestion_time").isNotNull().alias("t"))
    assert rows(got) == [(5, True, True)]


# -- tables -------------------------------------------------------------------


def test_full_replace(spark, folder):
    path = f"{folder}/t"
    tables.full_replace(spark.range(5), path)
    tables.full_replace(spark.range(2), path)
    assert rows(tables.read_current(spark, path)) == [(0,), (1,)]


def test_full_replace_that_fails_leaves_the_table(spark, folder):
    path = f"{folder}/t"
    tables.full_replace(spark.range(2), path)
    broken = spark.range(3).withColumn("id", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        tables.full_replace(broken, path)
    assert rows(tables.read_current(spark, path)) == [(0,), (1,)]
    # a table may be replaced by what is made of itself
    tables.full_replace(tables.read_current(spark, path).where("id = 1"), path)
    assert rows(tables.read_current(spark, path)) == [(1,)]


def test_append_dedup(spark, folder):
    path = f"{folder}/t"
    schema = "id int, v string, day date"
    day = date(2024, 1, 1)
    first = spark.createDataFrame([(1, "a", day), (1, "a", day), (2, "b", day)], schema)
    again = spark.createDataFrame([(2, "x", day), (3, "c", date(2024, 1, 2))], schema)
    for load in (first, again, again):
        tables.append_dedup(load, path, ["id"], "day")
    got = tables.read_table(spark, path, first.schema)
    assert rows(got, "id", "v") == [(1, "a"), (2, "b"), (3, "c")]


def test_append_dedup_knows_null_keys_and_has_an_order(spark, folder):
    path = f"{folder}/t"
    rows_ = [(None, "b", 1), (None, "a", 1), (5, "z", 1), (5, "y", 1)]
    load = spark.createDataFrame(rows_, "id int, v string, day int")
    for _load in range(2):
        tables.append_dedup(load, path, ["id"], "day")
    got = tables.read_table(spark, path, load.schema)
    assert rows(got, "id", "v") == [(5, "y"), (None, "a")]


UP = "id int, day int, v string"


def test_plain_upserts_need_no_numbers_and_lose_nothing(spark, folder):
    path = f"{folder}/t"
    for k in range(3):
        tables.upsert(spark.createDataFrame([(k, 1, "a")], UP), path, ["id", "day"], "day")
    assert rows(tables.read_table(spark, path, spark.createDataFrame([], UP).schema), "id") == [
        (0,), (1,), (2,)]


def test_two_streams_with_the_same_numbers(spark, folder):
    path = f"{folder}/t"
    for stream, value in (("a", 1), ("b", 2)):
        for _time in range(2):  # a repeated change is applied once
            tables.upsert(spark.createDataFrame([(value, 1, stream)], UP), path,
                          ["id", "day"], "day", (stream, 0))
    got = tables.read_table(spark, path, spark.createDataFrame([], UP).schema)
    assert rows(got, "id", "v") == [(1, "a"), (2, "b")]


def test_upsert_moves_a_row_between_partitions(spark, folder):
    path = f"{folder}/t"
    tables.upsert(spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")], UP),
                  path, ["id"], "day")
    tables.upsert(spark.createDataFrame([(1, 3, "A"), (3, 1, "C")], UP), path, ["id"], "day")
    got = tables.read_table(spark, path, spark.createDataFrame([], UP).schema)
    assert rows(got, "id", "day", "v") == [(1, 3, "A"), (2, 1, "b"), (3, 1, "C")]


def test_upsert_refuses_two_rows_of_one_key(spark, folder):
    twice = spark.createDataFrame([(1, 1, "a"), (1, 1, "b")], UP)
    with pytest.raises(Exception, match="two source rows of one key"):
        tables.upsert(twice, f"{folder}/t", ["id", "day"], "day")


def test_upsert_touches_only_partitions_of_the_change(spark, folder):
    path = f"{folder}/t"
    tables.upsert(spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")], UP),
                  path, ["id", "day"], "day")
    untouched = sorted(p.name for p in Path(path, "day=2").iterdir())
    change = spark.createDataFrame([(2, 1, "B"), (4, 1, "d")], UP)
    tables.upsert(change, path, ["id", "day"], "day")
    got = tables.read_table(spark, path, change.schema)
    assert rows(got, "id", "day", "v") == [(1, 1, "a"), (2, 1, "B"), (3, 2, "c"), (4, 1, "d")]
    assert untouched == sorted(
        p.name for p in Path(path, "day=2").iterdir())


def test_change_opens_only_its_partitions(spark, folder):
    path = f"{folder}/t"
    spark.createDataFrame([(i, i % 5, "a") for i in range(50)], UP).write.partitionBy(
        "day").parquet(path)
    change = spark.createDataFrame([(1, 1, "b"), (3, 3, "b")], UP)
    old = tables.read_table(spark, path, change.schema)
    near = tables.in_touched_partitions(old, change, "day")
    assert sorted({r["day"] for r in near.collect()}) == [1, 3]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\n]*array_contains\(Subquery", plan)


def test_upsert_replay_and_recovery_after_a_half_done_swap(spark, folder):
    path = f"{folder}/t"
    base = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], UP)
    tables.upsert(base, path, ["id", "day"], "day", ("s", 0))
    change = spark.createDataFrame([(1, 1, "A"), (3, 2, "c")], UP)
    expected = [(1, 1, "A"), (2, 2, "b"), (3, 2, "c")]
    # A run that died after it had removed a partition: its staged rows remain.
    spark.createDataFrame(expected, UP).write.parquet(f"{path}__staged/s-1")
    shutil.rmtree(f"{path}/day=2")
    for _time in range(2):
        tables.upsert(change, path, ["id", "day"], "day", ("s", 1))
        got = tables.read_table(spark, path, change.schema)
        assert rows(got, "id", "day", "v") == expected
    assert not Path(f"{path}__staged/s-1").exists()


def test_changes_keep_tombstones_over_compaction(spark, folder):
    path, number = f"{folder}/t", iter(range(100))
    schema = spark.createDataFrame([], "id int, seq int, v string, is_deleted boolean").schema

    def feed(*changes):
        change = "s", next(number)
        for _time in range(2):  # a repeated change is one change
            tables.apply_changes(spark.createDataFrame(list(changes), schema), path, ["id"],
                                 "seq", change)

    def live():
        return rows(tables.live_rows(spark, path, schema, ["id"], "seq"), "id", "v")

    feed((1, 1, "a", False), (2, 1, "b", False), (1, 3, "c", False))
    feed((2, 5, None, True))
    tables.compact_changes(spark, path, schema, ["id"], "seq")
    feed((2, 4, "late", False), (1, 2, "old", False))
    feed((3, 1, "new", False))
    assert live() == [(1, "c"), (3, "new")]
    tables.compact_changes(spark, path, schema, ["id"], "seq")
    assert live() == [(1, "c"), (3, "new")]
    # the last change comes again after it was folded into the base
    tables.apply_changes(spark.createDataFrame([(3, 1, "new", False)], schema), path, ["id"],
                         "seq", ("s", 3))
    assert not list(Path(path, "log").iterdir())
    feed((2, 6, "back", False))
    assert live() == [(1, "c"), (2, "back"), (3, "new")]


def test_incremental_since_reads_all_without_a_mark(spark, folder):
    df = spark.createDataFrame([(1,), (5,), (9,)], "t int")
    none = F.lit(None).cast("int")
    assert tables.incremental_since(df, "t", none).count() == 3
    tables.store_high_water(df.where("t < 6"), "t", f"{folder}/mark")
    mark = tables.read_current(spark, f"{folder}/mark").select("high_water").scalar()
    # rows of the same instant may come later
    assert rows(tables.incremental_since(df, "t", mark)) == [(5,), (9,)]


def test_archive_keeps_days_that_the_log_has_lost(spark, folder):
    path, limit = f"{folder}/a", F.lit(date(2024, 1, 4))
    log = spark.sql("""select timestamp_ntz'2024-01-01' + make_dt_interval(0, 8 * id) as ts, id
        from range(12)""")
    archive = lambda df: tables.archive_log(df, "ts", path, limit)
    archive(log)
    archive(log.where("id >= 2"))  # the first day is half gone
    got = spark.read.parquet(path)
    assert rows(got, "id") == [(i,) for i in range(9)]
    before = sorted(p.name for p in Path(path, "log_date=2024-01-02").iterdir())
    late = log.union(spark.sql("select timestamp_ntz'2024-01-03 05:00:00', 99L"))
    archive(late)  # a day that got a row is written again, the others are not
    assert rows(spark.read.parquet(path), "id") == [(i,) for i in range(9)] + [(99,)]
    assert before == sorted(p.name for p in Path(path, "log_date=2024-01-02").iterdir())


def test_archive_is_a_bag_union_of_trimmed_and_late_rows(spark, folder):
    path, limit = f"{folder}/bag", F.lit(date(2024, 1, 2))
    row = "select timestamp_ntz'2024-01-01 01:00:00' as ts, cast(if(id = 3, null, id) as long) as id"
    archive = lambda df: tables.archive_log(df, "ts", path, limit)
    log = spark.sql(f"{row} from range(10)").unionAll(spark.sql(f"{row} from range(2)"))
    archive(log)
    late = spark.sql(f"{row} from range(20, 28)").unionAll(spark.sql(f"{row} from range(1)"))
    archive(log.where("id >= 5").unionAll(late))  # half is trimmed, and more late rows came
    expected = sorted([(i,) for i in [0, 0, 1, 1, 2, 4, 5, 6, 7, 8, 9, *range(20, 28)]] + [(None,)], key=repr)
    assert rows(spark.read.parquet(path), "id") == expected
    before = sorted(p.name for p in Path(path, "log_date=2024-01-01").iterdir())
    archive(log)
    assert before == sorted(p.name for p in Path(path, "log_date=2024-01-01").iterdir())
    archive(log.unionAll(spark.sql(f"{row} from range(1)")))  # a third copy in the log
    assert rows(spark.read.parquet(path), "id") == sorted([*expected, (0,)], key=repr)


@pytest.mark.parametrize("newest_by", [None, "at"])
def test_upsert_keeps_every_row_without_a_key(spark, folder, newest_by):
    path, schema = f"{folder}/n{newest_by}", "id int, sub int, at int, p int"
    load = lambda *r: tables.upsert(
        spark.createDataFrame(list(r), schema), path, ["id", "sub"], "p", newest_by=newest_by)
    load((None, 1, 1, 1), (None, 1, 2, 1), (7, None, 1, 1), (7, 1, 1, 1))
    load((None, 1, 1, 1), (7, 1, 5, 1))
    assert rows(spark.read.schema(schema).parquet(path)) == sorted(
        [(None, 1, 1, 1), (None, 1, 2, 1), (7, None, 1, 1), (None, 1, 1, 1), (7, 1, 5, 1)], key=repr)


def test_erasure_rewrites_touched_partitions_and_keeps_its_audit(spark, folder):
    path, audit = f"{folder}/t", f"{folder}/audit"
    df = spark.createDataFrame(
        [(1, "a", 1), (2, "b", 1), (1, "c", 2), (3, "d", 3)], "s int, v string, p int")
    df.write.partitionBy("p").parquet(path)
    gone = spark.createDataFrame([(1,), (1,), (7,)], "s int")
    before = sorted(f.name for f in Path(path, "p=3").iterdir())
    for _time in range(2):
        tables.erase_subjects(spark, path, df.schema, gone, "s", "p", audit, "r1")
    assert rows(tables.read_table(spark, path, df.schema), "s", "v") == [(2, "b"), (3, "d")]
    assert before == sorted(f.name for f in Path(path, "p=3").iterdir())
    assert rows(spark.read.parquet(audit), "s", "erased_rows") == [(1, 2)]
    assert rows(tables.erasure_audit({"t": df}, gone, "s")) == [("t", 1, 2)]
