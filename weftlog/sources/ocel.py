"""OCEL 2.0 logs in SQLite files, as a Spark data source of three tables.

``spark.read.format("ocel2")`` takes ``path`` and ``table`` (events, objects or relations), and ``columns`` if not all
are wanted. Every table of the file, and each type of events is one, is read in partitions of ranges of its row ids.
Filters on activity and otype by equality go into the statements that SQLite runs.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from weftlog.schema import ObjectLog

#: Row ids of a partition.
RANGE = 200_000

_SCHEMAS = {"events": "eid string, ts timestamp_ntz, activity string", "objects": "oid string, otype string", "relations": "eid string, oid string, qualifier string"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _time(x: object) -> datetime:
    t = datetime.fromisoformat(str(x).replace("Z", "+00:00"))
    if t.tzinfo:
        t = t.astimezone(timezone.utc).replace(tzinfo=None)
    return t


class Ocel2(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ocel2"

    def schema(self) -> str:
        table = self.options.get("table", "")
        if table not in _SCHEMAS:
            raise ValueError(f"table must be one of {', '.join(_SCHEMAS)}")
        kinds = dict(c.split(" ") for c in _SCHEMAS[table].split(", "))
        return ", ".join(f"{c} {kinds[c]}" for c in _columns(self.options, table))

    def reader(self, schema) -> DataSourceReader:
        table = self.options["table"]
        return Reader(self.options["path"], table, _columns(self.options, table))


def _columns(options: dict, table: str) -> list[str]:
    every = [c.split(" ")[0] for c in _SCHEMAS[table].split(", ")]
    wanted = [c.strip() for c in options.get("columns", "").split(",") if c.strip()] or every
    if unknown := sorted(set(wanted) - set(every)):
        raise ValueError(f"{table} has no columns {', '.join(unknown)}")
    return wanted


class Reader(DataSourceReader):
    """One table. ``only``: the activities of events, or types of objects, that filters leave (None: all)."""

    def __init__(self, path: str, table: str, columns: list[str]) -> None:
        self.path, self.table, self.columns = path, table, columns
        self.only: frozenset | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        column = {"events": ("activity",), "objects": ("otype",)}.get(self.table)
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == column:
                values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.only = values if self.only is None else self.only & values
            else:
                yield f

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        """(SQL, parameters, activity) for each range of row ids; a table without row ids is one partition."""
        with self._open() as db:
            if self.table == "events":
                types = [(a, n) for a, n in db.execute("SELECT ocel_type, ocel_type_map FROM event_map_type ORDER BY 1") if self.only is None or a in self.only]
                sources = [(f"event_{n}", {"eid": "ocel_id", "ts": "ocel_time", "activity": "NULL"}, a) for a, n in types]
            elif self.table == "objects":
                sources = [("object", {"oid": "ocel_id", "otype": "ocel_type"}, None)]
            else:
                sources = [("event_object", {"eid": "ocel_event_id", "oid": "ocel_object_id", "qualifier": "ocel_qualifier"}, None)]
            out = []
            for name, columns, activity in sources:
                sql = f"SELECT {', '.join(columns[c] for c in self.columns)} FROM {_quoted(name)}"
                where, values = [], []
                if self.table == "objects" and self.only is not None:
                    where, values = [f"ocel_type IN ({', '.join('?' * len(self.only))})"], sorted(self.only)
                try:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(name)}").fetchone()
                except sqlite3.OperationalError:
                    low = high = None
                ranges = [(k, min(k + RANGE - 1, high)) for k in range(low, high + 1, RANGE)] if low is not None else [None]
                for r in ranges:
                    parts = [*where, "rowid BETWEEN ? AND ?"] if r else where
                    out.append(InputPartition((sql + (f" WHERE {' AND '.join(parts)}" if parts else ""), [*values, *(r or ())], activity)))
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        sql, values, activity = partition.value
        clean = {"ts": _time, "activity": lambda _: activity, "otype": lambda x: x, "qualifier": lambda x: x or ""}
        how = [clean.get(c, str) for c in self.columns]
        with self._open() as db:
            for row in db.execute(sql, values):
                yield tuple(f(x) for f, x in zip(how, row, strict=True))


def read_ocel2_sqlite(spark: SparkSession, path: str) -> ObjectLog:
    """An object log. A missing file is a FileNotFoundError, another suffix than .sqlite a ValueError."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if not path.lower().endswith(".sqlite"):
        raise ValueError(f"not a .sqlite file: {path}")
    spark.dataSource.register(Ocel2)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = lambda t: spark.read.format("ocel2").option("path", path).option("table", t).load()
    events, objects, links = read("events"), read("objects"), read("relations")
    relations = links.join(events, "eid").join(objects, "oid").select("eid", "oid", "otype", "qualifier", "activity", "ts")
    return ObjectLog(events, objects, relations).checked()


def convert_to_parquet(log: ObjectLog, path: str) -> None:
    """Write the three tables once, for logs that are read often."""
    for name in ("events", "objects", "relations"):
        getattr(log, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_parquet_log(spark: SparkSession, path: str) -> ObjectLog:
    return ObjectLog(*(spark.read.parquet(f"{path}/{n}") for n in ("events", "objects", "relations"))).checked()


_EXECUTION = "execution_id string, events array<struct<event_id string, activity string, timestamp string, objects array<struct<object_id string, object_type string>>>>"


def read_executions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, relations) of execution documents in JSON: (exec_id, eid, ts, activity) and (eid, oid, otype)."""
    doc = spark.read.schema(_EXECUTION).option("multiLine", True).json(path)
    e = doc.select(F.col("execution_id").alias("exec_id"), F.explode("events").alias("e"))
    nodes = e.select("exec_id", F.col("e.event_id").alias("eid"), F.to_timestamp_ntz("e.timestamp").alias("ts"), F.col("e.activity").alias("activity"))
    o = e.select(F.col("e.event_id").alias("eid"), F.explode("e.objects").alias("o"))
    return nodes, o.select("eid", F.col("o.object_id").alias("oid"), F.col("o.object_type").alias("otype")).distinct()


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """(otype, src_act, dst_act) from a JSON array of source_activity, target_activity and object_type."""
    r = spark.read.schema("source_activity string, target_activity string, object_type string").option("multiLine", True).json(path)
    return r.select(F.col("object_type").alias("otype"), F.col("source_activity").alias("src_act"), F.col("target_activity").alias("dst_act")).distinct()


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_dot(dots: DataFrame, path: str) -> None:
    """DOT texts (exec_id, dot), a folder for each execution."""
    dots.select("exec_id", F.col("dot").alias("value")).write.mode("overwrite").partitionBy("exec_id").option("lineSep", "\n").text(path)


def object_log(spark: SparkSession, events: list[tuple], relations: list[tuple]) -> ObjectLog:
    """A log from rows: events (eid, ts, activity), relations (eid, oid, otype)."""
    e = spark.createDataFrame(events, "eid string, ts timestamp_ntz, activity string")
    r = spark.createDataFrame(relations, "eid string, oid string, otype string").join(e, "eid")
    r = r.select("eid", "oid", "otype", F.lit("").alias("qualifier"), "activity", "ts")
    return ObjectLog(e, r.select("oid", "otype").distinct(), r)
