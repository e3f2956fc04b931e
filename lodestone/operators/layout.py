"""Layout of archives: what lies where, as DataFrame operators.

All windows are partitioned by archive (and volume), which the format bounds at 65,535 files and chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions.flags import is_compressed
from lodestone.functions.paths import is_root


def corrected_sizes(chunks: DataFrame, sizes: DataFrame) -> DataFrame:
    """chunks with compressed_length set right and the length before as claimed_length.

    A chunk has the room up to the next offset in its volume, or up to the volume's end; the room is
    none where the volume is missing.  A compressed chunk whose two lengths are equal gets
    all its room, any other is cut down to it.  sizes: (archive, volume_id, size).
    """
    place = Window.partitionBy("archive", "file").orderBy("offset", "chunk_id")
    after = F.lead("offset").over(place)
    known = sizes.select("archive", F.col("volume_id").alias("file"), F.col("size").alias("__size"))
    room = F.greatest(F.coalesce(F.col("__next"), F.col("__size"), F.lit(0)) - F.col("offset"), F.lit(0))
    claimed = F.col("compressed_length")
    unknown = is_compressed(F.col("flags")) & (claimed == F.col("decompressed_length"))
    return (
        chunks.withColumn("__next", after)
        .join(known, ["archive", "file"], "left")
        .withColumn("claimed_length", claimed)
        .withColumn("compressed_length", F.when(unknown, room).otherwise(F.least(claimed, room)))
        .select(*chunks.columns, "claimed_length")
    )


def running_offsets(chunks: DataFrame, stored: str, order: str, base: Column | None = None) -> DataFrame:
    """chunks with `offset`: the sum of what is stored before it in its volume, after base."""
    before = Window.partitionBy("archive", "file").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum(stored).over(before), F.lit(0)) + (F.lit(0) if base is None else base))


def directory_dictionary(entries: DataFrame) -> DataFrame:
    """(archive, dir_id, dir): distinct directories in the order of first use, from 1; the root isn't listed."""
    first = entries.where(~is_root(F.col("dir"))).groupBy("archive", "dir").agg(F.min("file_idx").alias("first_use"))
    return first.select("archive", F.dense_rank().over(Window.partitionBy("archive").orderBy("first_use")).alias("dir_id"), "dir")


def with_directory_ids(entries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """entries with dir_id; 0 is the root."""
    return entries.join(dictionary, ["archive", "dir"], "left").withColumn("dir_id", F.coalesce("dir_id", F.lit(0)))


def string_table(entries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(archive, pos, value): names by file, then directories by id."""
    files = entries.groupBy("archive").agg(F.count("*").alias("n"))
    names = entries.select("archive", F.col("file_idx").alias("pos"), F.col("name").alias("value"))
    dirs = dictionary.join(files, "archive").select("archive", (F.col("n") + F.col("dir_id") - 1).alias("pos"), F.col("dir").alias("value"))
    return names.unionByName(dirs)


def counts(entries: DataFrame, chunks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Per archive: files, directories with the root, strings, chunks and volumes."""
    files = entries.groupBy("archive").agg(F.count("*").alias("num_user_files"))
    dirs = dictionary.groupBy("archive").agg(F.count("*").alias("dirs"))
    parts = chunks.groupBy("archive").agg(F.count("*").alias("num_chunks"), F.count_distinct("file").alias("num_archive_files"))
    n_dirs = F.coalesce("dirs", F.lit(0)) + 1
    return files.join(dirs, "archive", "left").join(parts, "archive", "left").select(
        "archive", "num_user_files", n_dirs.alias("num_directories"), (F.col("num_user_files") + n_dirs - 1).alias("num_strings"), F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"), F.coalesce("num_archive_files", F.lit(0)).alias("num_archive_files")
    )


def header_sizes(strings: DataFrame, entries: DataFrame, volume_names: DataFrame) -> DataFrame:
    """(archive, header_size) of archives with one chunk a file.  volume_names: (archive, volume_id, name)."""
    text = strings.groupBy("archive").agg(F.sum(F.octet_length("value") + 1).alias("text"))
    files = entries.groupBy("archive").agg(F.count("*").alias("n"))
    more = volume_names.where("volume_id > 0").groupBy("archive").agg(F.sum(F.octet_length("name") + 1).alias("more"))
    fixed = S.SETTINGS_BYTES + S.CHUNK_SETTINGS_BYTES
    return files.join(text, "archive", "left").join(more, "archive", "left").select("archive", (fixed + (S.FILE_BYTES + S.CHUNK_BYTES) * F.col("n") + F.coalesce("text", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("header_size"))
