"""Relations between an archive's files and chunks, and the reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.flags import has, manifest_method, report_method
from lodestone.functions.paths import joined, resolve
from lodestone.schema import DZ


def file_chunks(files: DataFrame) -> DataFrame:
    """(archive, file_idx, pos, chunk_id): the files' chunks in order."""
    return files.select("archive", "file_idx", F.posexplode("chunk_ids").alias("pos", "chunk_id"))


def archive_paths(files: DataFrame, dirs: DataFrame, separator: str) -> DataFrame:
    """files with `path`: directory and name; an unknown directory counts as the root.  Extraction joins them by
    a backslash, reports by a slash."""
    known = dirs.select("archive", "dir_id", F.col("path").alias("__dir"))
    return files.join(known, ["archive", "dir_id"], "left").withColumn("path", joined(F.col("__dir"), F.col("name"), separator)).drop("__dir")


def volume_lookup(chunks: DataFrame, volumes: DataFrame) -> DataFrame:
    """chunks with their volume's name, size and path, if there are such columns, and an error where there is no such volume."""
    known = volumes.withColumnRenamed("volume_id", "file").withColumn("__known", F.lit(True))
    found = chunks.join(known, ["archive", "file"], "left")
    return found.withColumn("volume_error", F.when(F.col("__known").isNull(), "VolumeNotFound")).drop("__known")


def first_chunks(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """files with the flags and volume of their first chunk, null without one."""
    first = chunks.select("archive", F.col("chunk_id").alias("__first"), F.col("flags").alias("first_flags"), F.col("file").alias("first_volume"))
    return files.withColumn("__first", F.get("chunk_ids", F.lit(0))).join(first, ["archive", "__first"], "left").drop("__first")


def report(files: DataFrame, chunks: DataFrame, dirs: DataFrame, statuses: DataFrame) -> DataFrame:
    """Per file: status, size, packed, method, path, and whether all lengths are as claimed.

    chunks have corrected lengths; statuses: (archive, chunk_id, ok, length_match).  A chunk that isn't
    there fails its file; a file without chunks is OK.
    """
    known = chunks.select("archive", "chunk_id", "decompressed_length", "compressed_length").join(statuses.select("archive", "chunk_id", "ok", "length_match"), ["archive", "chunk_id"], "left")
    sums = (
        file_chunks(files)
        .join(known, ["archive", "chunk_id"], "left")
        .groupBy("archive", "file_idx")
        .agg(F.sum("decompressed_length").alias("size"), F.sum("compressed_length").alias("packed"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"), F.bool_and(F.coalesce("length_match", F.lit(False))).alias("match"))
    )
    listed = first_chunks(archive_paths(files, dirs, "/"), chunks)
    return listed.join(sums, ["archive", "file_idx"], "left").select(
        "archive",
        "file_idx",
        F.when(F.coalesce("ok", F.lit(True)), "OK").otherwise("FAIL").alias("status"),
        F.coalesce("size", F.lit(0)).cast("long").alias("size"),
        F.coalesce("packed", F.lit(0)).cast("long").alias("packed"),
        report_method(F.col("first_flags")).alias("method"),
        "path",
        F.coalesce("match", F.lit(True)).alias("length_match"),
    )


def report_text(rows: DataFrame) -> DataFrame:
    """The report's rows as lines of fixed width, in order within an archive."""
    line = F.format_string("%-5d | %-7s | %-10d | %-10d | %-8s | %s", "file_idx", "status", "size", "packed", "method", "path")
    return rows.select("archive", "file_idx", line.alias("line")).orderBy("archive", "file_idx")


def manifest(files: DataFrame, chunks: DataFrame, dirs: DataFrame) -> DataFrame:
    """Per file what a configuration would say of it: path, archive_file_index and compression.  A path that is
    refused is null."""
    listed = first_chunks(archive_paths(files, dirs, "\\"), chunks)
    return listed.select("archive", "file_idx", resolve(F.col("path")).alias("path"), F.coalesce("first_volume", F.lit(0)).alias("archive_file_index"), manifest_method(F.col("first_flags")).alias("compression"))


def any_dz(chunks: DataFrame, *by: str) -> DataFrame:
    return chunks.groupBy("archive", *by).agg(F.bool_or(has(F.col("flags"), DZ)).alias("has_dz"))


def reassembled(parts: DataFrame) -> DataFrame:
    """(archive, file_idx, data): the parts' bytes in the order of pos.  For files that fit one value;
    larger ones are written part by part by the extraction sink."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "data")))
    return parts.groupBy("archive", "file_idx").agg(F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["data"])).alias("data"))
