"""verify, unpack and pack as plans over the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions.codec import TOGETHER, bounded, encoded
from lodestone.functions.paths import basename, parent, to_archive
from lodestone.operators import layout, listing
from lodestone.sinks.extracted import write_files
from lodestone.sinks.volumes import write_volumes
from lodestone.sources import config as configs
from lodestone.sources import files
from lodestone.sources.archive import table
from lodestone.sources.header import Header, serialise
from lodestone.sources.payload import decoded_chunks


@dataclass
class Tables:
    """The tables of one or more archives, with stored lengths set right."""

    files: DataFrame
    dirs: DataFrame
    volumes: DataFrame
    chunks: DataFrame


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one is made up on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def options_of(settings: dict | None) -> dict | None:
    """An archive's range settings as options of a configuration; what they don't tell has its default."""
    return None if settings is None else dict(S.OPTION_DEFAULTS) | {k: v for k, v in settings.items() if k in S.OPTION_DEFAULTS}


def open_archives(spark: SparkSession, path: str | list[str], **options: str) -> Tables:
    t = {name: table(spark, path, name, **options) for name in ("files", "dirs", "volumes", "chunks")}
    return Tables(t["files"], t["dirs"], t["volumes"], layout.corrected_sizes(t["chunks"], t["volumes"]))


def decoded(t: Tables, keep_data: bool = True, resolver: str = "") -> DataFrame:
    """The chunks' contents or errors, and whether each has the length that it claims."""
    got = decoded_chunks(t.chunks, t.volumes, keep_data, resolver)
    claims = t.chunks.select("archive", "chunk_id", "decompressed_length")
    return got.join(claims, ["archive", "chunk_id"]).withColumn("ok", F.col("error_kind").isNull()).withColumn("length_match", F.coalesce(F.col("data_length") == F.col("decompressed_length"), F.lit(False)))


def verify(spark: SparkSession, path: str | list[str], resolver: str = "", **options: str) -> DataFrame:
    """The report on all files of the archives at path.  OK means that all chunks could be decoded; length_match, that
    they have the lengths they claim, too."""
    t = open_archives(spark, path, **options)
    return listing.report(t.files, t.chunks, t.dirs, decoded(t, keep_data=False, resolver=resolver))


def contents(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """(archive, file_idx, path, pos, data, error_kind, error_msg): the decoded parts of all files; path as an
    extraction would name them, null if refused."""
    t = open_archives(spark, path, **options)
    named = listing.manifest(t.files, t.chunks, t.dirs)
    parts = listing.file_chunks(t.files).join(decoded(t), ["archive", "chunk_id"], "left")
    missing = F.when(F.col("ok").isNull(), "Io").otherwise(F.col("error_kind"))
    return named.join(parts, ["archive", "file_idx"], "left").select("archive", "file_idx", "path", "pos", "data", F.when(F.col("pos").isNotNull(), missing).alias("error_kind"), "error_msg")


def unpack(spark: SparkSession, path: str, output: str) -> DataFrame:
    """Extracts one archive below output, with a configuration that packs it again, and returns (file_idx, path,
    compression, archive_file_index, failed_chunks).

    A chunk that fails is left out of its file.  A refused path fails the whole before anything is written.  Of
    files that share a path the last one stays.  A configuration that would replace an extracted file is refused.
    """
    t = open_archives(spark, path)
    head = table(spark, path, "archives").first()
    listed = listing.manifest(t.files, t.chunks, t.dirs)
    # One archive has 65,535 files at most.
    rows = listed.orderBy("file_idx").collect()
    stem = path.rpartition("/")[2]
    stem = stem.rpartition(".")[0] or stem
    for r in rows:
        if r.path is None:
            raise S.ArchiveError("Io", f"file {r.file_idx} has a path that is refused")
        if r.path == ".":
            raise S.ArchiveError("Io", f"file {r.file_idx} has the output directory for its path")
        if r.path == f"{stem}.toml":
            raise S.ArchiveError("Io", f"the configuration would replace the extracted file {r.path}")
    last = {r.path: r.file_idx for r in rows}
    keep = spark.createDataFrame(list(last.items()), "path string, file_idx int")
    parts = contents(spark, path)
    write_files(parts.join(keep, ["path", "file_idx"], "left_semi"), output)
    options = options_of(head.range and head.range.asDict())
    names = [r.name for r in t.volumes.orderBy("volume_id").collect()]
    entries = [{"path": r.path, "archive_file_index": r.archive_file_index, "compression": r.compression, "modifiers": ""} for r in rows]
    with files.writer(f"{output}/{stem}.toml") as out:
        out.write(configs.to_toml({"archives": names, "base_dir": ".", "files": entries, "options": options}).encode())
    failed = parts.where(F.col("error_kind").isNotNull()).groupBy("file_idx").agg(F.count("*").alias("failed_chunks"))
    return listed.join(failed, "file_idx", "left").select("file_idx", "path", "compression", "archive_file_index", F.coalesce("failed_chunks", F.lit(0)).alias("failed_chunks"))


def pack_frame(entries: DataFrame, archives: list[str], output: str, options: dict | None = None, staging: str | None = None) -> DataFrame:
    """Packs entries (file_idx, path, volume, method, data) into the volumes `archives` in output and returns
    (file_idx, path, volume, flags, offset, original_length, stored_length, substituted).

    Encoded data is staged once, as the layout and the volumes must agree on it.  file_idx must run from 0 without
    gaps.
    """
    if not archives:
        raise S.ArchiveError("Io", "No archives specified")
    return _write(_staged(entries, staging), archives, output)


def pack_frames(entries: DataFrame, archives: list[str], output: str, staging: str | None = None) -> list[int]:
    """Packs entries (archive, file_idx, path, volume, method, data) into one archive for each number in `archive`, and
    returns the numbers.

    The names of volumes, which `archives` lists, have the number for {}.  All archives are encoded, laid out and
    written together, so that nothing but their numbers reaches the driver.  In each, file_idx must run from 0 without gaps.
    """
    if not archives:
        raise S.ArchiveError("Io", "No archives specified")
    staged = _staged(entries, staging, "archive")
    numbers = [r.archive for r in staged.select("archive").distinct().collect()]
    if None in numbers:
        raise ValueError("an entry has no archive")
    # Without any entry there is one archive, and nothing in it.
    _write_many(staged, {k: [name.format(k) for name in archives] for k in sorted(numbers) or [0]}, output)
    return sorted(numbers) or [0]


def _staged(entries: DataFrame, staging: str | None, *by: str) -> DataFrame:
    """The entries with their data encoded, and the columns `by`, as a table."""
    spark = entries.sparkSession
    staged_at = f"{staging or shared_folder(spark)}/pack-{uuid.uuid4().hex}"
    rows = encoded(entries.select("file_idx", "path", F.col("volume").cast("int").alias("volume"), "method", "data", *by))
    rows.write.parquet(staged_at)
    return spark.read.schema(rows.schema).parquet(staged_at)


_PLACED = ("file_idx", "name", "path", "dir_id", "offset", "stored_length", "original_length", "flags", "volume")


def _header(rows: pa.Table, archives: list[str], text: list[str]) -> bytes:
    """The header of an archive with the files `rows` (_PLACED, in order) and the strings `text`."""
    index, names, path, dir_ids, *chunk = (rows.column(c).to_pylist() for c in _PLACED)
    for k, (i, name, p, volume) in enumerate(zip(index, names, path, chunk[-1], strict=True)):
        if i != k:
            raise ValueError(f"file_idx has a gap at {k}")
        if not name or p == ".":
            raise S.ArchiveError("Io", f"Invalid file path {p!r}")
        if not 0 <= volume < len(archives):
            raise S.ArchiveError("VolumeNotFound", f"{p} belongs to volume {volume}; there are {len(archives)}")
    return serialise(Header(len(index), len(text) - len(index) + 1, 0, text, [(d, [k]) for k, d in enumerate(dir_ids)], len(archives), list(zip(*chunk, strict=True)), [name.rpartition("/")[2] for name in archives[1:]]))


def _write_many(staged: DataFrame, places: dict[int, list[str]], output: str) -> None:
    """Lays out the archives of staged, whose volumes `places` names by the archive's number, with their folders below output, and
    writes all volumes in one job.  An archive's header is made by one task, as it describes 65,535 files at most."""
    spark = staged.sparkSession
    named = staged.drop("data").withColumn("file", F.col("volume")).withColumn("name", basename(F.col("path"))).withColumn("dir", to_archive(parent(F.col("path"))))
    dictionary = layout.directory_dictionary(named)
    volume_names = spark.createDataFrame([(k, v, name.rpartition("/")[2]) for k, names in places.items() for v, name in enumerate(names)], "archive long, volume_id int, name string")
    sizes = layout.header_sizes(layout.string_table(named, dictionary), named, volume_names)
    base = F.when(F.col("file") == 0, F.col("header_size")).otherwise(0)
    placed = layout.running_offsets(layout.with_directory_ids(named, dictionary).join(sizes, "archive"), "stored_length", "file_idx", base)

    def header(rows: pa.Table) -> pa.Table:
        k = rows.column("archive")[0].as_py()
        if rows.num_rows > 0xFFFF:
            raise S.ArchiveError("Io", f"{rows.num_rows} files; the format holds {0xFFFF}")
        rows = rows.sort_by("file_idx")
        dirs = dict(sorted((i, d) for i, d in set(zip(rows.column("dir_id").to_pylist(), rows.column("dir").to_pylist(), strict=True)) if i))
        made = _header(rows, places[k], [*rows.column("name").to_pylist(), *dirs.values()])
        if len(made) != rows.column("header_size")[0].as_py():
            raise AssertionError("the header isn't as long as it was taken to be")
        return pa.table({"archive": pa.array([k], pa.int64()), "volume": pa.array([0], pa.int32()), "offset": pa.array([0], pa.int64()), "data": pa.array([made], pa.binary())})

    kinds = "archive long, volume int, offset long, data binary"
    headers = placed.select(F.col("archive").cast("long").alias("archive"), *_PLACED, "dir", "header_size").groupBy("archive").applyInArrow(header, kinds)
    full = {r.archive for r in staged.select("archive").distinct().collect()}
    nothing = [(k, 0, 0, serialise(Header(0, 1, 0, [], [], len(names), [], [n.rpartition("/")[2] for n in names[1:]]))) for k, names in places.items() if k not in full]
    chunks = staged.join(placed.select("archive", "file_idx", "offset"), ["archive", "file_idx"]).select("archive", "volume", "offset", "data")
    # All archives' volumes are numbered through; headers are chunks like others.
    names = [name for k in places for name in places[k]]
    first, n = [], 0
    for k in places:
        first.append((k, n))
        n += len(places[k])
    numbered = chunks.unionByName(headers).unionByName(spark.createDataFrame(nothing, kinds)).join(F.broadcast(spark.createDataFrame(first, "archive long, first int")), "archive")
    for folder in {name.rpartition("/")[0] for name in names}:
        files.make_dirs(f"{output}/{folder}" if folder else output)
    write_volumes(numbered.withColumn("volume", F.col("first") + F.col("volume")), output, names, b"")


def _write(staged: DataFrame, archives: list[str], output: str) -> DataFrame:
    """Lays out one archive and writes its volumes."""
    spark = staged.sparkSession
    meta = staged.drop("data").withColumn("archive", F.lit(archives[0])).withColumn("file", F.col("volume"))
    named = meta.withColumn("name", basename(F.col("path"))).withColumn("dir", to_archive(parent(F.col("path"))))
    dictionary = layout.directory_dictionary(named)
    strings = layout.string_table(named, dictionary)
    volume_names = spark.createDataFrame([(archives[0], k, v) for k, v in enumerate(archives)], "archive string, volume_id int, name string")
    # The header describes 65,535 files at most, so its parts are small.
    sizes = layout.header_sizes(strings, named, volume_names).first()
    base = F.when(F.col("file") == 0, F.lit(sizes.header_size if sizes else 0)).otherwise(0)
    placed = layout.running_offsets(layout.with_directory_ids(named, dictionary), "stored_length", "file_idx", base)
    n = meta.count()
    if n > 0xFFFF:
        raise S.ArchiveError("Io", f"{n} files; the format holds {0xFFFF}")
    # Columns, as rows of Python take several times the memory.
    rows = placed.select(*_PLACED).orderBy("file_idx").toArrow()
    text = strings.select("pos", "value").orderBy("pos").toArrow().column("value").to_pylist()
    header = _header(rows, archives, text)
    if sizes and len(header) != sizes.header_size:
        raise AssertionError("the header isn't as long as it was taken to be")
    write_volumes(staged.join(placed.select("file_idx", "offset"), "file_idx"), output, archives, header)
    return placed.select("file_idx", "path", "volume", "flags", "offset", "original_length", "stored_length", "substituted")


def pack(spark: SparkSession, config_path: str, output: str) -> DataFrame:
    """Packs what the configuration lists; see pack_frame."""
    c = configs.read_config(config_path)
    entries = spark.createDataFrame([(k, f["path"], f["archive_file_index"], f["compression"]) for k, f in enumerate(c["files"])], "file_idx long, path string, volume int, method string")
    base = c["base_dir"].rstrip("/") or "/"
    wanted = sorted({f["path"] for f in c["files"]})
    sizes = {p: files.size(f"{base}/{p}") for p in wanted}
    if missing := [p for p in wanted if sizes[p] is None]:
        raise S.ArchiveError("Io", f"no such file: {base}/{missing[0]}")
    _, inner = files.at(base)
    uri = base if "://" in base else f"file://{inner}" if inner.startswith("/") else f"file://{_absolute(inner)}"

    spread = entries.withColumn("source", F.concat(F.lit(f"{base if '://' in base else uri.removeprefix('file://')}/"), "path")).repartition(max(1, len(c["files"]) // FILES_A_TASK + 1), "file_idx")
    return pack_frame(_read_files(spread), c["archives"], output)


#: Files that a task reads and encodes, about; archives whose files are extracted together, as the driver gives the files their names.
FILES_A_TASK, ARCHIVES_AT_ONCE = 1024, 8


def _read_files(entries: DataFrame) -> DataFrame:
    """entries with `data`, the bytes of the file `source`, instead of that column."""
    kept = [f for f in entries.schema if f.name != "source"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, held, got = batch.drop_columns(["source"]), 0, []
            for k, p in enumerate(batch.column("source").to_pylist()):
                try:
                    with files.open_file(p) as f:
                        got.append(f.read())
                except FileNotFoundError:
                    raise S.ArchiveError("Io", f"no such file: {p}") from None
                held += len(got[-1])
                if held > TOGETHER or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*rest.slice(k + 1 - len(got), len(got)).columns, pa.array(got, pa.binary())], names=[*rest.schema.names, "data"])
                    held, got = 0, []

    return bounded(entries).mapInArrow(read, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", data binary")


def pack_all(spark: SparkSession, config_paths: dict[int, str], output: str) -> list[str]:
    """Packs what each configuration lists into an archive in the folder of output that has its number, all of them together, and
    returns the archives.  Configurations are read by the tasks."""
    listed = spark.createDataFrame(sorted(config_paths.items()), "archive long, config string").repartitionByRange(len(config_paths), "archive")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [configs.read_config(p) for p in batch.column("config").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("archive"), pa.array([c["archives"] for c in found], pa.list_(pa.string())), pa.array([len(c["files"]) for c in found], pa.int64())], names=["archive", "names", "n"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, p in zip(batch.column("archive").to_pylist(), batch.column("config").to_pylist(), strict=True):
                c = configs.read_config(p)
                base = c["base_dir"].rstrip("/") or "/"
                base = base if "://" in base else files.at(base)[1]
                for since in range(0, len(c["files"]), 4096):
                    part = c["files"][since : since + 4096]
                    columns = {"archive": [k] * len(part), "file_idx": range(since, since + len(part)), "path": [f["path"] for f in part], "volume": [f["archive_file_index"] for f in part], "method": [f["compression"] for f in part], "source": [f"{base}/{f['path']}" for f in part]}
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), kinds, strict=True)], names=list(columns))

    found = listed.mapInArrow(heads, "archive long, names array<string>, n long").collect()
    if not all(r.names for r in found):
        raise S.ArchiveError("Io", "No archives specified")
    spread = listed.mapInArrow(entries, "archive long, file_idx long, path string, volume int, method string, source string").repartition(sum(r.n for r in found) // FILES_A_TASK + 1, "archive", "file_idx")
    places = {r.archive: [f"{r.archive}/{name}" for name in r.names] for r in sorted(found)}
    _write_many(_staged(_read_files(spread), None, "archive"), places, output)
    return [f"{output}/{names[0]}" for names in places.values()]


def unpack_all(spark: SparkSession, paths: list[str], output: str) -> dict[str, str]:
    """Extracts archives, each to the folder below output that has its name without extension, by the rules of unpack(), and returns the
    folders by path.  Some archives are extracted together; what they list stays with the tasks."""
    stems = {p: (name := p.rpartition("/")[2]).rpartition(".")[0] or name for p in paths}
    if len(set(stems.values())) < len(paths):
        raise ValueError("two archives would share a folder")
    own = F.broadcast(spark.createDataFrame(list(stems.items()), "archive string, stem string"))

    def listed(some: list[str]) -> DataFrame:
        t = open_archives(spark, some, perPartition="1")
        return listing.manifest(t.files, t.chunks, t.dirs).join(own, "archive")

    bad = listed(paths).where(F.col("path").isNull() | (F.col("path") == ".") | (F.col("path") == F.concat("stem", F.lit(".toml")))).first()
    if bad:
        raise S.ArchiveError("Io", f"file {bad.file_idx} of {bad.archive} has a path that is refused: {bad.path}")
    names: dict[str, list[str]] = {p: [] for p in paths}
    for r in table(spark, paths, "volumes", perPartition="1").select("archive", "volume_id", "name").orderBy("archive", "volume_id").collect():
        names[r.archive].append(r.name)
    options = {r.archive: options_of(r.range and r.range.asDict()) for r in table(spark, paths, "archives", perPartition="1").select("archive", "range").collect()}

    def write(archive: str, entries: list[dict]) -> None:
        with files.writer(f"{output}/{stems[archive]}/{stems[archive]}.toml") as out:
            out.write(configs.to_toml({"archives": names[archive], "base_dir": ".", "files": entries, "options": options[archive]}).encode())

    def config(rows: pa.Table) -> pa.Table:
        archive = rows.column("archive")[0].as_py()
        write(archive, [r | {"modifiers": ""} for r in rows.sort_by("file_idx").select(["path", "archive_file_index", "compression"]).to_pylist()])
        return pa.table({"archive": pa.array([archive], pa.string())})

    written = set()
    for k in range(0, len(paths), ARCHIVES_AT_ONCE):
        some = paths[k : k + ARCHIVES_AT_ONCE]
        for p in some:
            files.make_dirs(f"{output}/{stems[p]}")
        last = listed(some).groupBy("archive", "path").agg(F.max("file_idx").alias("file_idx"))
        parts = contents(spark, some, perPartition="1").join(last, ["archive", "path", "file_idx"], "left_semi").join(own, "archive")
        write_files(parts.withColumn("path", F.concat("stem", F.lit("/"), "path")), output)
        written |= {r.archive for r in listed(some).select("archive", "file_idx", "path", "archive_file_index", "compression").groupBy("archive").applyInArrow(config, "archive string").collect()}
    for p in set(paths) - written:
        write(p, [])
    return {p: f"{output}/{stems[p]}" for p in paths}


def _absolute(path: str) -> str:
    import os

    return os.path.abspath(path)
