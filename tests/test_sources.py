from __future__ import annotations

import datetime as dt
import sqlite3
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from weftlog.operators import ocdfg
from weftlog.plans import derive
from weftlog.plans.derive import order_log
from weftlog.sources import ocel
from weftlog.sources.dot import DotWriter, Written, write_dot_files
from weftlog.sources.ocel import convert_to_parquet, object_log, read_ocel2_sqlite, read_parquet_log, write_csv, write_dot
from weftlog.streaming.flows import streamed_successions, windowed_activity_counts


def test_sqlite(spark, tmp_path):
    path = tmp_path / "log.SQLITE"
    with sqlite3.connect(path) as db:
        db.executescript("""
        CREATE TABLE event (ocel_id, ocel_type); CREATE TABLE event_map_type (ocel_type, ocel_type_map); CREATE TABLE object (ocel_id, ocel_type); CREATE TABLE event_object (ocel_event_id, ocel_object_id, ocel_qualifier);
        CREATE TABLE event_PlaceOrder (ocel_id, ocel_time); CREATE TABLE event_Pay (ocel_id, ocel_time);
        INSERT INTO event_map_type VALUES ('place order', 'PlaceOrder'), ('pay', 'Pay'); INSERT INTO event_PlaceOrder VALUES ('e1', '2024-01-01T09:00:00Z'); INSERT INTO event_Pay VALUES ('e2', '2024-01-01T11:00:00+01:00');
        INSERT INTO object VALUES ('o1', 'orders'); INSERT INTO event_object VALUES ('e1', 'o1', 'q'), ('e2', 'o1', NULL);""")
    log = read_ocel2_sqlite(spark, str(path))
    assert rows(log.relations) == [("e1", "o1", "orders", "q", "place order", dt.datetime(2024, 1, 1, 9)), ("e2", "o1", "orders", "", "pay", dt.datetime(2024, 1, 1, 10))]
    assert rows(ocdfg.discover(log.relations)) == [("orders", "place order", "pay", 1, 1, 1)]
    with pytest.raises(FileNotFoundError):
        read_ocel2_sqlite(spark, str(tmp_path / "none.sqlite"))
    (tmp_path / "x.txt").write_text("")
    with pytest.raises(ValueError):
        read_ocel2_sqlite(spark, str(tmp_path / "x.txt"))
    write_csv(log.objects, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def big_file(path, n=50):
    with sqlite3.connect(path) as db:
        db.executescript("""CREATE TABLE event_map_type (ocel_type, ocel_type_map); CREATE TABLE object (ocel_id, ocel_type); CREATE TABLE event_object (ocel_event_id, ocel_object_id, ocel_qualifier, PRIMARY KEY (ocel_event_id, ocel_object_id)) WITHOUT ROWID;
        CREATE TABLE event_A (ocel_id, ocel_time); CREATE TABLE event_B (ocel_id, ocel_time); CREATE TABLE event_C (ocel_id, ocel_time); INSERT INTO event_map_type VALUES ('a', 'A'), ('b', 'B'), ('c', 'C');""")
        for k in range(n):
            db.execute(f"INSERT INTO event_{'AB'[k % 2]} VALUES (?, '2024-01-01T00:00:00')", (f"e{k:02d}",))
            db.execute("INSERT INTO object VALUES (?, ?)", (f"o{k:02d}", ("x", "y", "z")[k % 3]))
            db.execute("INSERT INTO event_object VALUES (?, ?, 'q')", (f"e{k:02d}", f"o{k:02d}"))
        db.execute("DELETE FROM object WHERE ocel_id IN ('o00', 'o20')")
    return str(path)


def test_sqlite_in_ranges(spark, tmp_path, monkeypatch):
    path = big_file(tmp_path / "big.sqlite")
    monkeypatch.setattr(ocel, "RANGE", 10)
    split = ocel.Reader(path, "events", ["eid", "ts", "activity"]).partitions()
    assert [p.value[1] for p in split] == [[1, 10], [11, 20], [21, 25]] * 2 + [[]] and {p.value[2] for p in split} == {"a", "b", "c"}
    r = ocel.Reader(path, "events", ["eid"])
    other = EqualTo(("eid",), "e01")
    assert list(r.pushFilters([EqualTo(("activity",), "b"), In(("activity",), ("a", "b")), other])) == [other]
    assert [p.value[0] for p in r.partitions()] == ['SELECT ocel_id FROM "event_B" WHERE rowid BETWEEN ? AND ?'] * 3
    r = ocel.Reader(path, "objects", ["oid"])
    assert list(r.pushFilters([In(("otype",), ("x", "y"))])) == []
    assert r.partitions()[0].value == ('SELECT ocel_id FROM "object" WHERE ocel_type IN (?, ?) AND rowid BETWEEN ? AND ?', ["x", "y", 2, 11], None)
    assert sum(len(list(r.read(p))) for p in r.partitions()) == 33
    assert [p.value for p in ocel.Reader(path, "relations", ["oid"]).partitions()] == [('SELECT ocel_object_id FROM "event_object"', [], None)]
    log = read_ocel2_sqlite(spark, path)
    assert (log.events.count(), log.objects.count(), log.relations.count()) == (50, 48, 48)
    assert log.events.where("activity = 'a'").count() == 25 and log.objects.where("otype in ('x', 'y')").count() == 33 and log.events.where("activity = 'none'").count() == 0
    assert log.relations.where("otype = 'z' and activity = 'b'").count() == len([k for k in range(50) if k % 3 == 2 and k % 2 and k != 20])
    read = spark.read.format("ocel2").option("path", path).option("table", "objects")
    assert read.option("columns", "otype").load().distinct().count() == 3
    with pytest.raises(Exception, match="no columns"):
        read.option("columns", "nothing").load().count()


def test_graphs_are_written_all_or_none(spark, tmp_path):
    path = tmp_path / "graphs"
    dots = spark.createDataFrame([(f"order/{k}", f"digraph {{{k}}}") for k in range(20)], "exec_id string, dot string").repartition(3)
    files = lambda: {f.name: f.read_text() for f in path.glob("part-*/*.dot")}
    want = {f"order%2F{k}.dot": f"digraph {{{k}}}" for k in range(20)}
    write_dot_files(dots, str(path))
    assert files() == want and (path / "_SUCCESS").exists() and not list(path.glob("_staging*"))
    # a task that fails late, and an execution that comes twice: what was there stays, and no half of it is left
    bad = dots.repartition(2).withColumn("dot", F.when(F.col("exec_id") == "order/7", F.raise_error(F.lit("broken"))).otherwise(F.lit("new")))
    for wrong in (bad, dots.unionByName(dots.limit(1))):
        with pytest.raises(Exception):  # noqa: B017
            write_dot_files(wrong, str(path))
        assert files() == want and not list(path.glob("_staging*"))
    # a task that is tried again leaves one file of it
    writer = DotWriter(str(path), True)
    first, second = (writer._at()[2] + f"/part-00000-{k}" for k in (1, 2))
    for folder in (first, second):
        writer._at()[0].create_dir(folder, recursive=True)
        (Path(folder) / "a.dot").write_text(folder)
    writer.commit([Written("part-00000-2", ["a.dot"]), None])
    assert files() == {"a.dot": second} and not list(path.glob("_staging*"))
    write_dot_files(dots.where("exec_id = 'order/1'"), str(path), "append")
    assert set(files()) == {"a.dot", "order%2F1.dot"}


def test_derived_log_follows_its_files(spark, tmp_path):
    import shutil

    where = tmp_path / "tables"
    where.mkdir()
    for t in ("orders", "lineitem"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", where / f"{t}.parquet")
    log = order_log(spark, str(where))
    assert log.unique and order_log(spark, str(where)) is log
    few = spark.read.parquet(str(where / "orders.parquet")).orderBy("o_orderkey").limit(5)
    few.coalesce(1).write.parquet(str(tmp_path / "few"))
    shutil.copy(next((tmp_path / "few").glob("*.parquet")), where / "orders.parquet")
    again = order_log(spark, str(where))
    assert again is not log and again.objects.where("otype = 'orders'").count() == 5
    for folder in derive._DERIVED[next(k for k, v in derive._DERIVED.items() if v[0] is again)][1]:
        shutil.rmtree(folder.removeprefix("file:"))
    assert order_log(spark, str(where)).objects.where("otype = 'orders'").count() == 5
    with pytest.raises(ValueError, match="e1 more than once"):
        twice = object_log(spark, [("e1", dt.datetime(2024, 1, 1), "a")], [("e1", "o", "orders")])
        type(twice)(twice.events.unionByName(twice.events), twice.objects, twice.relations).with_unique_events()


def test_streamed_flows_equal_the_batch(spark, tmp_path):
    """Events come out of order, within and over batches, and some twice."""
    t = dt.datetime(2024, 1, 1)
    data = [(f"e{k:02d}", f"o{k % 3}", "orders", f"a{k % 2}", t + dt.timedelta(minutes=k)) for k in range(20)]
    swapped = [*data[3:12], *data[15:17], *data[:3], data[4], *data[12:15], *data[17:]]
    schema = "eid string, oid string, otype string, activity string, ts timestamp_ntz"
    end = [("end", "last", "orders", "z", t + dt.timedelta(days=2))]
    for k, part in enumerate((swapped[:11], swapped[11:], end)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    q = streamed_successions(stream, "1 hour").writeStream.format("memory").queryName("flows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = ocdfg.successions(spark.read.schema(schema).parquet(str(tmp_path / "in" / "*"))).select("otype", "src_act", "dst_act", "src_eid", "dst_eid")
    assert rows(spark.table("flows")) == rows(batch) and batch.count() == 17
    q = windowed_activity_counts(stream.withColumn("ts", stream["ts"].cast("timestamp"))).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.events for r in spark.table("counts").collect()) == 22


def test_parquet_log_and_dot_files(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    log = object_log(spark, [("a", t, "one"), ("b", t, "two")], [("a", "x", "t"), ("b", "x", "t")])
    convert_to_parquet(log, str(tmp_path / "log"))
    again = read_parquet_log(spark, str(tmp_path / "log"))
    assert [rows(getattr(again, n)) for n in ("events", "objects", "relations")] == [rows(getattr(log, n)) for n in ("events", "objects", "relations")]
    with pytest.raises(ValueError, match="events lacks columns: ts"):
        type(log)(log.events.drop("ts"), log.objects, log.relations).checked()
    write_dot(spark.createDataFrame([("e1", "digraph {}"), ("e2", "digraph {\n}")], "exec_id string, dot string"), str(tmp_path / "dot"))
    assert sorted(p.name for p in (tmp_path / "dot").iterdir() if p.is_dir()) == ["exec_id=e1", "exec_id=e2"]
    assert "".join(p.read_text() for p in (tmp_path / "dot" / "exec_id=e1").glob("*.txt")).strip() == "digraph {}"


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from weftlog.plans import scratch

    class Conf:
        def __init__(self, **known):
            self.known = known

        def get(self, key, default=None):
            return self.known.get(key, default)

        def set(self, key, value):
            self.known[key] = value

    class Session:
        def __init__(self, master):
            self.conf = Conf(**{"spark.master": master})

    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077", ""):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.shared_dir(Session(master))
    assert scratch.shared_dir(Session("local[2]")).startswith("file://")
