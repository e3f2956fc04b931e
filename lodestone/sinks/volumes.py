"""Volumes as a sink: one writer task each, in order, and the header in front of the first."""

from __future__ import annotations

import uuid
from base64 import b64decode, b64encode
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lodestone.schema import struct
from lodestone.sources import files


@dataclass
class Written(WriterCommitMessage):
    parts: list[tuple[int, str, int]]


class VolumeWriter(DataSourceWriter):
    """Tasks write to names of their own; the driver renames them once all have succeeded, so that a task
    that is tried again leaves nothing half-written behind."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.names = options["names"].split("\n")
        self.header = b64decode(options["header"])
        self.tag = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        done, out, current, at, name = [], None, None, 0, ""
        attempt = uuid.uuid4().hex
        try:
            for row in iterator:
                if row["volume"] != current:
                    if out:
                        out.close()
                        done.append((current, name, at))
                    current, at = row["volume"], 0
                    name = f"{self.folder}/.{self.tag}-{current}-{attempt}"
                    out = files.writer(name)
                    if current == 0:
                        out.write(self.header)
                        at = len(self.header)
                if row["offset"] != at:
                    raise ValueError(f"a chunk of volume {current} belongs at {row['offset']}, the volume ends at {at}")
                out.write(row["data"])
                at += len(row["data"])
            if out:
                out.close()
                done.append((current, name, at))
        except BaseException:
            # The driver only hears of tasks that succeed.
            files.drop(out, [*(n for _, n, _ in done), name])
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        parts = {v: name for m in messages if m for v, name, _ in m.parts}
        for v, name in enumerate(self.names):
            if v not in parts:
                with files.writer(f"{self.folder}/{name}") as out:
                    out.write(self.header if v == 0 else b"")
            else:
                files.move(parts[v], f"{self.folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for _, name, _ in m.parts if m else ():
                files.remove(name)


class VolumeSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_volumes"

    def schema(self) -> StructType:
        return struct("volume INT, offset BIGINT, data BINARY")

    def writer(self, schema: StructType, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(dict(self.options))


def write_volumes(chunks: DataFrame, folder: str, names: list[str], header: bytes) -> None:
    """Writes chunks (volume, offset, data) to the volumes `names` in folder; offsets must leave no gaps."""
    chunks.sparkSession.dataSource.register(VolumeSink)
    files.make_dirs(folder)
    # An empty chunk shares its offset with the next one and comes before it.
    dealt = chunks.select("volume", "offset", "data").repartition(max(1, len(names)), "volume").sortWithinPartitions("volume", "offset", F.octet_length("data"))
    dealt.write.format("archive_volumes").options(names="\n".join(names), header=b64encode(header).decode()).mode("append").save(folder)
