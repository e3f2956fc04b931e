"""Extracted files as a sink: parts are appended in order, a file appears once it is whole."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lodestone.schema import struct
from lodestone.sources import files


@dataclass
class Extracted(WriterCommitMessage):
    parts: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def write(self, iterator: Iterator) -> Extracted:
        done, out, current = [], None, None
        attempt = uuid.uuid4().hex
        try:
            for row in iterator:
                if row["path"] != current:
                    if out:
                        out.close()
                    current = row["path"]
                    target = f"{self.folder}/{current}"
                    files.make_dirs(target.rpartition("/")[0])
                    name = f"{target}.{attempt}.part"
                    done.append((name, target))
                    out = files.writer(name)
                if row["data"] is not None:
                    out.write(row["data"])
            if out:
                out.close()
        except BaseException:
            # The driver only hears of tasks that succeed.
            files.drop(out, [name for name, _ in done])
            raise
        return Extracted(done)

    def commit(self, messages: list[Extracted | None]) -> None:
        for m in messages:
            for name, target in m.parts if m else ():
                files.move(name, target)

    def abort(self, messages: list[Extracted | None]) -> None:
        for m in messages:
            for name, _ in m.parts if m else ():
                files.remove(name)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "extracted_files"

    def schema(self) -> StructType:
        return struct("path STRING, pos INT, data BINARY")

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options))


def write_files(parts: DataFrame, folder: str) -> None:
    """Writes parts (path, pos, data) below folder; a part without data leaves its file short."""
    parts.sparkSession.dataSource.register(FileSink)
    files.make_dirs(folder)
    parts.select("path", "pos", "data").repartition("path").sortWithinPartitions("path", "pos").write.format("extracted_files").mode("append").save(folder)
