"""A sink that writes rows (name, content) as files of a folder, all or none.

spark.dataSource.register(FileSink)
df.write.format("whole_files").mode("append").option("path", "s3://...").save()

Each attempt of a task writes under a folder of its own beside the final places. When all
tasks are done, the driver moves the files of the attempts that count; whatever a failed, lost or
speculative attempt wrote goes with the staging folder. (An attempt that outlives a failed job may leave some
of it, in a folder whose name begins with a dot, which readers pass over.) Rows of one name that follow one
another are one file.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where each one lies, and its name


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.stage = f".staged-{uuid.uuid4().hex}"

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> _Written:
        files, place = self._files()
        folder = f"{place}/{self.stage}/{uuid.uuid4().hex}"
        done: list[tuple[str, str]] = []
        out, last = None, None
        try:
            for name, content in iterator:
                if not name or name in (".", "..") or "/" in name or name.startswith(".staged-"):
                    raise ValueError(f"no name for a file: {name!r}")
                if name != last:
                    if out is not None:
                        out.close()
                    if not done:
                        files.create_dir(folder, recursive=True)
                    if any(name == own for _, own in done):
                        raise ValueError(f"rows of {name!r} don't follow one another")
                    done.append((f"{folder}/{name}", name))
                    out, last = files.open_output_stream(done[-1][0]), name
                out.write(bytes(content or b""))
        finally:
            if out is not None:
                out.close()
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        files, place = self._files()
        done = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in done]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("several tasks have files of one name")
        files.create_dir(place, recursive=True)
        if self.overwrite:
            from pyarrow import fs

            for info in files.get_file_info(fs.FileSelector(place)):
                if info.type == fs.FileType.File:
                    files.delete_file(info.path)
        for path, name in done:
            files.move(path, f"{place}/{name}")
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        """Remove what is staged, of all attempts."""
        from pyarrow import fs

        files, place = self._files()
        if files.get_file_info(f"{place}/{self.stage}").type == fs.FileType.Directory:
            files.delete_dir(f"{place}/{self.stage}")


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def write_files(rows: DataFrame, folder: str, *, name: str = "name", content: str = "content", overwrite: bool = False) -> None:
    """Write rows as files of a folder that executors reach. Nothing is seen there before all of them are written.

    overwrite: files that the folder has go when the new ones come. Null contents are
    empty; a name may not hold a slash; two tasks with one name fail the job.
    """
    rows.sparkSession.dataSource.register(FileSink)
    whole = folder if "://" in folder else os.path.abspath(folder)
    rows = rows.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))
    rows.write.format("whole_files").mode("overwrite" if overwrite else "append").option("path", whole).save()
