"""A sink for reports: one named file for each row, written aside and moved into place when all tasks have succeeded.

``df.select("path", "report").write.format("dose_reports").mode("append").save(folder)``, after ``register(spark)``. Names are taken as
``report_path`` makes them. Tasks write into a folder of their own attempt, so a task that is tried again or runs twice leaves nothing half
written; the commit moves the files of the attempts that counted, an abort removes them all. A name that comes twice in one job, and one that
leads out of the folder, stop the job before any file is moved. A file of an earlier job with the same name is replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, FILES = "dose_reports", "named_files"


def _files(folder: str):
    """The file system of a folder, local or remote, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


@dataclass
class Written(WriterCommitMessage):
    aside: str
    names: list[str]


class ReportWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder
        self.side = f"_aside-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = _files(self.folder)
        aside, names = f"{root}/{self.side}/{uuid.uuid4().hex}", []
        files.create_dir(aside, recursive=True)
        for row in iterator:
            name = row["path"]
            if not name or PurePosixPath(name).is_absolute() or ".." in PurePosixPath(name).parts:
                raise ValueError(f"no name of a report: {name!r}")
            place = f"{aside}/{name}"
            files.create_dir(place.rpartition("/")[0], recursive=True)
            with files.open_output_stream(place) as out:
                text = row[1] or b""
                out.write(text.encode() if isinstance(text, str) else bytes(text))
            names.append(name)
        return Written(aside, names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _files(self.folder)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        twice = [n for n, times in Counter(names).items() if times > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"reports of one name: {sorted(twice)[:3]}")
        for folder in {f"{root}/{n}".rpartition("/")[0] for n in names}:
            files.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:  # names alone pass through here
            list(pool.map(lambda x: files.move(*x), [(f"{m.aside}/{n}", f"{root}/{n}") for m in done for n in m.names]))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        files, root = _files(self.folder)
        if files.get_file_info(f"{root}/{self.side}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.side}")


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, report string"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        if overwrite:
            raise ValueError("reports are added to a folder; mode must be append")
        return ReportWriter(self.options["path"])


class FileSink(ReportSink):
    """The same for files of any content."""

    @classmethod
    def name(cls) -> str:
        return FILES

    def schema(self) -> str:
        return "path string, content binary"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReportSink)
    spark.dataSource.register(FileSink)


def write_named(reports: DataFrame, folder: str) -> None:
    """Reports (path, report) as files of those names in a folder, all or none."""
    register(reports.sparkSession)
    reports.select("path", "report").write.format(FORMAT).mode("append").save(folder)


def write_files(files: DataFrame, folder: str) -> None:
    """Files (path, content) of those names in a folder, all or none."""
    register(files.sparkSession)
    files.select("path", "content").write.format(FILES).mode("append").save(folder)
