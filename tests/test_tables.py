"""Readers, writers and table changes."""

from __future__ import annotations

import gzip
import random
import sys
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shirabe.catalog import QUERIES
from shirabe.operators import aggregate, change, join, project
from shirabe.session import scratch_path
from shirabe.sources import paging, readers, writers

AS_OF = datetime(2001, 6, 30, 16, 30)
LAYOUT = "id string, kind string, mail string"


@pytest.fixture
def layout(spark):
    return spark.createDataFrame([], LAYOUT).schema


def text_file(tmp_path, *lines):
    path = tmp_path / "in.tsv"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_strict_read_passes_good_rows(spark, rows, layout, tmp_path):
    path = text_file(tmp_path, "1\ta\tx@y", "2\tb\t")
    df = readers.read_delimited(spark, path, layout, sep="\t", max_rejects=0)
    assert rows(df) == [("1", "a", "x@y"), ("2", "b", None)]
    assert df.count() == 2


@pytest.mark.parametrize("bad", ["3\tc", "3\tc\tm\textra", "3\ttoolong\tm"])
def test_strict_read_fails_on_any_bad_row(spark, layout, tmp_path, bad):
    path = text_file(tmp_path, "1\ta\tx@y", bad)
    with pytest.raises(readers.RejectedRows):
        readers.read_delimited(spark, path, layout, sep="\t", max_rejects=0, max_length={"kind": 4})


def test_rejects_within_the_limit_are_left_out(spark, rows, layout, tmp_path):
    path = text_file(tmp_path, "1\ta\tx@y", "3\tc", "4\td\tm\textra")
    df = readers.read_delimited(spark, path, layout, sep="\t", max_rejects=2)
    assert rows(df.select("id")) == [("1",)]


def test_missing_and_empty_files(spark, layout, tmp_path):
    assert readers.read_or_empty(spark, str(tmp_path / "absent.tsv"), layout).isEmpty()
    path = tmp_path / "empty.tsv"
    path.write_text("")
    assert readers.read_or_empty(spark, str(path), layout, sep="\t", max_rejects=0).isEmpty()


def test_dated_path_uses_the_tokyo_day():
    assert readers.dated_path("in/%Y%m%d/f.tsv", AS_OF) == "in/20010701/f.tsv"


def test_extract_bytes(spark, tmp_path):
    df = spark.createDataFrame([("a", 'q"t', None)], LAYOUT)
    (path,) = writers.write_csv_gz(df, str(tmp_path / "out"), "list_%Y%m%d", AS_OF, files=1)
    assert path.endswith("list_20010701.csv.gz")
    assert gzip.open(path, "rt").read() == '"id","kind","mail"\n"a","q\\"t",""\n'


def test_empty_extract_is_a_header(spark, layout, tmp_path):
    (path,) = writers.write_csv_gz(spark.createDataFrame([], layout), str(tmp_path / "out"), "list", files=1)
    assert gzip.open(path, "rt").read() == '"id","kind","mail"\n'


def test_large_extract_becomes_parts(spark, tmp_path):
    paths = writers.write_csv_gz(spark.range(25), str(tmp_path / "out"), "list", files=3)
    assert len(paths) == 3 and paths[0].endswith("list-00000.csv.gz")
    assert sum(len(gzip.open(p, "rt").readlines()) - 1 for p in paths) == 25


def test_ordered_extract(spark, tmp_path):
    paths = writers.write_csv_gz(spark.range(25), str(tmp_path / "out"), "list", order=["id"], files=3)
    lines = [int(line.strip('"\n')) for p in paths for line in gzip.open(p, "rt").readlines()[1:]]
    assert lines == list(range(25))


def test_json_null_fields(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "id int, v string")
    (kept,) = writers.write_json(df, str(tmp_path / "a"), "f", keep_nulls=True, files=1)
    (gone,) = writers.write_json(df, str(tmp_path / "b"), "f", files=1)
    assert open(kept).read() == '{"id":1,"v":null}\n' and open(gone).read() == '{"id":1}\n'


def test_upsert_of_repeated_and_null_keys(spark, rows):
    target = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "id int, v string")
    source = spark.createDataFrame([(1, "x"), (1, "y"), (None, "m"), (3, "z"), (3, "z")], "id int, v string")
    assert rows(change.upsert(target, source, ["id"], ["v"])) == [(None, "m"), (1, "y"), (2, "b"), (3, "z")]


def test_history_takes_a_new_key_once(spark, rows):
    current = spark.createDataFrame([("k", "1"), ("k", "1"), (None, "2")], "k string, v string")
    history = spark.createDataFrame([], "k string, v string, first_seen string, last_seen string")
    once = change.track_history(current, history, ["k"], "d1")
    assert rows(once) == [(None, "2", "d1", "d1"), ("k", "1", "d1", "d1")]
    assert rows(change.track_history(current, once, ["k"], "d2"), "k", "last_seen") == [(None, "d2"), ("k", "d2")]


def test_delta_with_null_hashes(spark, rows):
    src = spark.createDataFrame([(1, "a", None), (2, "b", "h"), (3, "c", None)], "id int, v string, hash string")
    tgt = spark.createDataFrame([(1, "o", "h"), (2, "o", None), (3, "o", None)], "id int, v string, hash string")
    assert rows(join.detect_delta(src, tgt, "id", "hash").filter("is_updated"), "id") == [(1,), (2,)]
    assert rows(change.delta_upsert(src, tgt, "id", "hash"), "id", "v") == [(1, "a"), (2, "b"), (3, "o")]


def test_overwrite_may_read_its_own_table(spark, rows):
    folder = scratch_path(spark, "own")
    table = writers.overwrite_table(spark.range(3), folder)
    table = writers.overwrite_table(table.select((F.col("id") + 10).alias("id")), folder)
    assert rows(table) == [(10,), (11,), (12,)]


def test_layout_does_not_depend_on_rows(spark, tmp_path):
    for n in (1, 5000):
        paths = writers.write_csv_gz(spark.range(n), str(tmp_path / str(n)), "list", order=["id"])
        assert paths[0].endswith("list-00000.csv.gz")


def watched(spark, monkeypatch, folder, seen):
    """Read the table before and after every step that a writer takes in the file system."""

    def look():
        seen.append(sorted(r.id for r in writers.current_table(spark, folder).collect()))

    real = writers._file_system

    class Watched:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            def step(*args):
                if name not in ("exists", "listStatus"):
                    look()
                out = getattr(self.fs, name)(*args)
                if name not in ("exists", "listStatus"):
                    look()
                return out

            return step

    def wrapped(*args):
        path, fs = real(*args)
        # The reader itself looks through the plain file system.
        return (path, fs) if seen is None or any(f.f_code.co_name == "look" for f in frames()) else (path, Watched(fs))

    monkeypatch.setattr(writers, "_file_system", wrapped)


def frames():
    frame = sys._getframe()
    while frame:
        yield frame
        frame = frame.f_back


def test_a_reader_always_finds_a_whole_table(spark, rows, monkeypatch):
    for way in ("overwrite", "publish"):
        folder, seen = scratch_path(spark, way), []
        write = lambda df: writers.overwrite_table(df, folder) if way == "overwrite" else writers.publish(df, f"{folder}-stage", folder, "id")  # noqa: B023, E731
        write(spark.range(3))
        held = writers.current_table(spark, folder)
        with monkeypatch.context() as patch:
            watched(spark, patch, folder, seen)
            for n in (4, 5, 6):
                write(spark.range(n))
        assert len(seen) > 8 and all(x in [list(range(n)) for n in (3, 4, 5, 6)] for x in seen)
        assert [len(x) for x in seen] == sorted(len(x) for x in seen)
        # The two newest versions stay for readers that have resolved them; older folders are gone.
        assert writers._versions(spark, folder) == [3, 4] and rows(writers.current_table(spark, folder)) == [(i,) for i in range(6)]
        with pytest.raises(Exception, match="exist|FILE_NOT_EXIST|Failed"):
            held.collect()


def test_a_failed_write_leaves_the_old_table(spark, rows):
    folder = scratch_path(spark, "kept")
    with pytest.raises(FileNotFoundError):
        writers.current_table(spark, folder)
    writers.overwrite_table(spark.range(3), folder)
    broken = spark.range(9).select(F.raise_error(F.lit("refused")).cast("long").alias("id"))
    with pytest.raises(Exception, match="refused"):
        writers.overwrite_table(broken, folder)
    assert rows(writers.current_table(spark, folder)) == [(0,), (1,), (2,)]
    assert rows(writers.overwrite_table(spark.range(1), folder)) == [(0,)]
    with pytest.raises(OSError, match="does not exist"):
        writers._point(spark, folder, 99, 2)


def test_publish_refuses_repeated_keys(spark):
    root = scratch_path(spark, "pub")
    main = writers.publish(spark.range(3), f"{root}/s", f"{root}/m", "id")
    with pytest.raises(writers.StageMismatch):
        writers.publish(spark.range(3).union(spark.range(1)), f"{root}/s", f"{root}/m", "id")
    assert main.count() == 3 and writers.current_table(spark, f"{root}/m").count() == 3


def test_upsert_and_delta(spark, rows):
    tgt = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2")], "id int, v string, hash string")
    src = spark.createDataFrame([(2, "B", "h9"), (3, "c", "h3"), (1, "ignored", "h1")], "id int, v string, hash string")
    assert rows(change.delta_upsert(src, tgt, "id", "hash"), "id", "v") == [(1, "a"), (2, "B"), (3, "c")]


def test_delete_keeps_unknown(spark, rows):
    df = spark.createDataFrame([("x",), (None,), ("y",)], "c string")
    assert rows(change.delete_where(df, F.col("c") == "x")) == [(None,), ("y",)]


def test_history_twice_gives_the_same(spark, rows):
    history = spark.createDataFrame([(1, "d1", "d1"), (2, "d1", "d1")], "k int, first_seen string, last_seen string")
    current = spark.createDataFrame([(2,), (3,)], "k int")
    once = change.track_history(current, history, ["k"], "d2")
    want = [(1, "d1", "d1"), (2, "d1", "d2"), (3, "d2", "d2")]
    assert rows(once) == want
    assert rows(change.track_history(current, once, ["k"], "d2")) == want


def test_watermarks(spark, rows):
    marks = spark.createDataFrame([("a_source", 5, "idle"), ("c_source", 1, "idle")], "source_name string, last_processed_id bigint, processing_status string")
    df = spark.createDataFrame([("a", 5), ("a", 6), ("b", 0)], "kind string, id bigint")
    fresh = change.since_watermark(df, marks, "kind", "id")
    assert rows(fresh) == [("a", 6), ("b", 0)]
    moved = change.advance_watermark(marks, fresh, "kind", "id")
    assert rows(moved) == [("a_source", 6, "completed"), ("c_source", 1, "idle")]


@pytest.mark.parametrize("closed, want", [("left", ["20010611", "20010625"]), ("both", ["20010611", "20010625", "20010626"])])
def test_date_window_bounds(spark, closed, want):
    days = [("20010610",), ("20010611",), ("20010625",), ("20010626",), ("00000000",), ("99999999",)]
    df = project.date_window(spark.createDataFrame(days, "d string"), "d", AS_OF, 20, 5, closed)
    assert sorted(r[0] for r in df.collect()) == want


def test_date_window_reaches_the_scan(spark, plan, tmp_path):
    spark.range(3).select(F.timestamp_seconds("id").cast("timestamp_ntz").alias("d")).write.parquet(str(tmp_path / "t"))
    text = plan(project.date_window(spark.read.parquet(str(tmp_path / "t")), "d", AS_OF, 20, 5))
    assert "PushedFilters: [IsNotNull(d), GreaterThanOrEqual(d," in text


def test_slot_with_null_key_stays_null(spark):
    df = spark.createDataFrame([("001", None, "001", "k2")], "t1 string, k1 string, t2 string, k2 string")
    assert df.select(project.slot_lookup("001", ["t1", "t2"], ["k1", "k2"])).first()[0] is None


def test_null_columns_keep_the_layout(spark):
    df = project.null_columns(spark.createDataFrame([(1, "x")], "a int, b string"), {"b": "string", "z": "int"})
    assert df.columns == ["a", "b", "z"] and tuple(df.first()) == (1, None, None)


def test_run_log_current_state(spark):
    from shirabe.operators.window import latest_per_key

    folder = scratch_path(spark, "log")
    writers.log_run(spark, folder, "r1", "n", "Running", datetime(2001, 1, 1))
    log = writers.log_run(spark, folder, "r1", "n", "Failed", datetime(2001, 1, 2), error="e")
    assert latest_per_key(log, ["run_id"], ["at"]).first()["status"] == "Failed"


def test_deep_page_reads_few_files(spark):
    folder, data = scratch_path(spark, "pages"), [(i * 37 % 1000, f"r{i % 7}", None if i % 50 == 0 else i % 11) for i in range(1000)]
    df = spark.createDataFrame(data, "id int, name string, g int")
    paging.write_sorted(df, folder, ["g", "id"], ranges=20)
    whole = sorted(data, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    for offset, size in [(0, 10), (900, 50), (990, 50), (333, 1), (123, 400), (1000, 5), (5, 0)]:
        page = paging.read_page(spark, folder, ["g", "id"], offset, size)
        assert [tuple(r) for r in page.collect()] == whole[offset : offset + size]
        assert len(page.inputFiles()) <= size // 40 + 2
    paging.write_sorted(df.limit(0), folder, ["g", "id"])
    assert paging.read_page(spark, folder, ["g", "id"], 0, 5).collect() == []


def test_spans_without_sorting(spark, rows, monkeypatch):
    picked = random.Random(5)
    low, high = -(1 << 63), (1 << 63) - 1
    cases = {
        "dense": range(100), "one": [5], "none": [], "ends": [low, -3, 0, 7, high], "few": [2, 3],
        "skewed": [*range(300), 10**15, 10**18], "sparse": [picked.randrange(low, high) for _ in range(200)],
    }
    for cells in (1 << 16, 30):
        monkeypatch.setattr(change, "HISTOGRAM_CELLS", cells)
        for name, keys in cases.items():
            ordered = sorted(set(keys))
            size = max(len(ordered) // 7, 1)
            want = [(i // size, part[0], part[-1], len(part)) for i in range(0, len(ordered), size) for part in [ordered[i : i + size]]]
            got = change.spans(spark.createDataFrame([(k,) for k in ordered], "k long"), "k", 7)
            assert sorted(tuple(r) for r in got.collect()) == want, (name, cells)


def test_spans_of_other_types(spark):
    df = spark.range(10).select(F.col("id").cast("int").alias("i"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"), F.format_string("k%02d", "id").alias("s"))
    df = df.withColumn("t", F.col("d").cast("timestamp_ntz"))
    for c in df.columns:
        got = change.spans(df, c, 2)
        assert got.schema["low"].dataType == df.schema[c].dataType
        values = sorted(r[0] for r in df.select(c).collect())
        assert sorted(tuple(r) for r in got.collect()) == [(0, values[0], values[4], 5), (1, values[5], values[9], 5)]


def test_equal_snapshots_join_no_rows(spark, rows):
    df = spark.range(500).selectExpr("if(id = 3, null, id) as id", "cast(id % 7 as string) as v", "sha2(cast(id % 7 as string), 256) as hash")
    assert change.changed_buckets(df, df, ["id"], "hash", 64).collect() == []
    changed = df.withColumn("v", F.when(F.col("id") == 9, "new").otherwise(F.col("v"))).withColumn("hash", F.sha2("v", 256))
    marked = change.changed_buckets(changed, df, ["id"], "hash", 64).collect()
    assert len(marked) == 1
    out = change.delta_upsert(changed, df, "id", "hash", 64)
    assert rows(out.filter("v = 'new'"), "id") == [(9,)] and out.count() == 500
    # A repeated row, a lost row and a null hash each mark their bucket.
    for other in (df.unionAll(df.filter("id = 8")), df.filter("id <> 8 or id is null"), df.withColumn("hash", F.when(F.col("id") == 8, None).otherwise(F.col("hash")))):
        assert len(change.changed_buckets(other, df, ["id"], "hash", 64).collect()) == 1


def test_distincts_roll_up_from_days(spark, rows):
    data = [(d, i) for d in range(6) for i in (d, d + 1, -d, 40_000 * d, 1 << 40, None)] + [(7, None)]
    df = spark.createDataFrame(data, "day int, id long")
    days = aggregate.id_bitmaps(df, ["day"], "id")
    per_day = {d: len({i for e, i in data if e == d and i is not None}) for d in range(6)}
    assert {r.day: r.n for r in aggregate.distinct_of_bitmaps(days, ["day"], "n").collect()} == per_day
    halves = aggregate.distinct_of_bitmaps(days.withColumn("half", F.floor(F.col("day") / 3)), ["half"], "n")
    assert {r.half: r.n for r in halves.collect()} == {h: len({i for e, i in data if e // 3 == h and i is not None}) for h in (0, 1)}


def test_wide_mart_of_one_file_is_made_by_several_tasks(spark):
    folder = scratch_path(spark, "narrow")
    key = F.col("id")
    people = spark.range(0, 40_000, 1, 1).select(
        key.alias("c_custkey"),
        F.format_string("Customer#%09d", key).alias("c_name"),
        (key % 2).cast("int").alias("c_nationkey"),
        (key / 100).alias("c_acctbal"),
        F.lit("FURNITURE").alias("c_mktsegment"),
    )
    people.write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(0, "FRANCE", 3), (1, "JAPAN", 2)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(2, "ASIA"), (3, "EUROPE")], "r_regionkey int, r_name string").write.parquet(f"{folder}/region.parquet")
    mart = QUERIES["job_wide_mart"](spark, folder)
    assert len(mart.inputFiles()) > 1 and len(mart.columns) == 533
    found = mart.agg(F.count("*"), F.count_distinct("client_key"), F.min("client_amount_001"), F.max("client_amount_119"), F.count("web_flag_2010_00"))
    assert tuple(found.first()) == (40_000, 40_000, 1.0, 518.99, 0)
    last = mart.where("client_key = 39999").first()
    assert (last.client_label_007, last.client_number_007, last.client_place_007) == ("Customer#000039999-7", "40006", "JAPAN/7")


def test_publish_without_dictionary(spark):
    root = scratch_path(spark, "plain")
    df = spark.range(0, 1000, 1, 1).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 3).alias("kind"))
    made = writers.publish(df, f"{root}/s", f"{root}/m", "id", plain=["id", "name"])
    assert made.count() == 1000 and made.where("name = 'n' || id AND kind = id % 3").count() == 1000
    row_group = pq.ParquetFile(made.inputFiles()[0].removeprefix("file://")).metadata.row_group(0)
    encoded = [any("DICTIONARY" in e for e in row_group.column(i).encodings) for i in range(3)]
    assert encoded == [False, False, True]
