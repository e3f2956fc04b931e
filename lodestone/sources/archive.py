"""Archives as tables: spark.read.format("archive").option("table", ...).load(path).

path is an archive, a directory of archives, or several of these separated by commas; the option paths, a list in
JSON, takes its place where a name may hold a comma.  A partition reads the headers of some archives; payloads are never part of these tables.  Options: table (archives, strings, files,
dirs, volumes, chunks), suffix (of the archives in a directory, `.dz`), mode (`failfast`, or `permissive`: an
archive that can't be read is a row of `archives` with its error), resolver, perPartition.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lodestone import schema as S
from lodestone.sources import files
from lodestone.sources.header import Header, parse


class Archives(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def safe_name(name: str) -> str:
    """A volume's name as the header gives it; one that leads out of the archive's directory is refused."""
    if not name or name.startswith(("/", "\\")) or ":" in name or ".." in name.replace("\\", "/").split("/"):
        raise S.ArchiveError("VolumeOpenError", f"unsafe volume name {name!r}")
    return name


def rows_of(table: str, path: str, h: Header) -> Iterator[tuple]:
    if table == "archives":
        yield path, h.num_user_files, h.num_directories, h.version, h.num_archive_files, len(h.chunks), h.header_end, h.range, None, None
    elif table == "strings":
        yield from ((path, k, v) for k, v in enumerate(h.strings))
    elif table == "files":
        yield from ((path, k, name, d, ids) for k, (name, (d, ids)) in enumerate(zip(h.names, h.files, strict=True)))
    elif table == "dirs":
        yield from ((path, k + 1, v) for k, v in enumerate(h.dirs))
    elif table == "chunks":
        yield from ((path, k, *c) for k, c in enumerate(h.chunks))
    elif table == "volumes":
        yield path, 0, path.rpartition("/")[2], path, files.size(path)
        for k, name in enumerate(h.volumes):
            try:
                own = files.sibling(path, safe_name(name))
            except S.ArchiveError:
                own = None
            yield path, k + 1, name, own, files.size(own) if own else None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.table = options.get("table", "archives")
        self.permissive = options.get("mode", "failfast").lower() == "permissive"
        self.resolver = options.get("resolver", "")
        self.suffix = options.get("suffix", ".dz")
        self.per = int(options.get("perpartition", options.get("perPartition", "16")))
        self.paths = json.loads(options["paths"]) if "paths" in options else [x.strip() for x in options["path"].split(",")]

    def partitions(self) -> list[InputPartition]:
        found = [p for x in self.paths for p, _ in files.listed(x, self.suffix)]
        return [Archives(found[k : k + self.per]) for k in range(0, len(found), self.per)]

    def read(self, partition: Archives) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with files.open_file(path, self.resolver) as f:
                    header = parse(f)
            except S.ArchiveError as e:
                if not self.permissive:
                    raise
                if self.table == "archives":
                    yield path, *[None] * 7, e.kind, e.message
                continue
            yield from rows_of(self.table, path, header)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> StructType:
        table = self.options.get("table", "archives")
        if table not in S.TABLES:
            raise ValueError(f"no such table: {table}; there are {', '.join(S.TABLES)}")
        return S.TABLES[table]

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def table(spark: SparkSession, path: str | list[str], name: str, **options: str) -> DataFrame:
    """One of the tables of the archives at path, or at all of the paths."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("archive").options(table=name, **options)
    return reader.load(path) if isinstance(path, str) else reader.option("paths", json.dumps(path)).load()
