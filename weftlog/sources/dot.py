"""A sink of graphs: one file for each, all of them or none.

``dots.write.format("dot").mode("overwrite").save(path)`` writes rows (exec_id, dot). A task writes its files to a folder
of its own attempt below the job's staging folder; the job's commit moves the folders of the attempts that count to their
place, and then puts down ``_SUCCESS``. A failed job removes what it has written; attempts that were lost or repeated leave
nothing that the commit takes. An execution that is written twice is an error before anything is moved.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """The folder of an attempt, and the names of its files."""

    folder: str
    names: list[str]


class DotSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dot"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if missing := {"exec_id", "dot"} - set(schema.fieldNames()):
            raise ValueError(f"graphs lack columns: {', '.join(sorted(missing))}")
        return DotWriter(self.options["path"], overwrite)


class DotWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _at(self) -> tuple[pyarrow.fs.FileSystem, str, str]:
        """The store, the folder of the graphs and the staging folder of this job."""
        fs, base = pyarrow.fs.FileSystem.from_uri(self.path)
        return fs, base, f"{base}/_staging-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        task = TaskContext.get()
        fs, _, staging = self._at()
        folder = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        names: list[str] = []
        fs.create_dir(f"{staging}/{folder}", recursive=True)
        for row in iterator:
            name = f"{quote(row['exec_id'], safe='')}.dot"
            with fs.open_output_stream(f"{staging}/{folder}/{name}") as f:
                f.write((row["dot"] or "").encode())
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base, staging = self._at()
        done = [m for m in messages if m is not None and m.names]
        seen: set[str] = set()
        for name in (n for m in done for n in m.names):
            if name in seen:
                fs.delete_dir(staging)
                raise ValueError(f"two graphs of one execution: {name}")
            seen.add(name)
        if self.overwrite:
            for old in fs.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True)):
                if old.path.rstrip("/").rsplit("/", 1)[-1] != f"_staging-{self.job}":
                    (fs.delete_dir if old.type == pyarrow.fs.FileType.Directory else fs.delete_file)(old.path)
        for m in done:
            # another job's part of the same number stays where it is
            fs.move(f"{staging}/{m.folder}", f"{base}/{m.folder}-{self.job[:8]}")
        fs.create_dir(staging, recursive=True)
        fs.delete_dir(staging)
        with fs.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        fs, _, staging = self._at()
        fs.create_dir(staging, recursive=True)
        fs.delete_dir(staging)


def write_dot_files(dots: DataFrame, path: str, mode: str = "overwrite") -> None:
    """DOT texts (exec_id, dot) as a file for each execution, in a folder for each task that had some."""
    spark: SparkSession = dots.sparkSession
    spark.dataSource.register(DotSink)
    dots.select("exec_id", "dot").write.format("dot").mode(mode).save(path)
