"""The archive operators' queries over the driver's tables, and their SQL.

Most run on a model of archives that is derived from `documents`: each thousand of doc_ids is an archive, each
document a file in it, with directory, volume, method and chunks told by arithmetic.  The others pack real archives
and read them again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions import codec, flags, paths
from lodestone.operators import layout, listing
from lodestone.plans import archives
from lodestone.sources import files
from lodestone.sources.archive import table
from lodestone.sources.config import parsed_lines, read_config
from lodestone.sources.header import Header, serialise

Q = dict[str, DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# The model, in Spark and in SQL ------------------------------------------------------------------------------------


def model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    k = (F.col("doc_id") % 1000).cast("int")
    return d.select(
        F.floor(F.col("doc_id") / 1000).cast("long").alias("archive"),
        k.alias("file_idx"),
        "doc_id",
        F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")).alias("name"),
        F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.concat(F.col("lang"), F.lit("\\"), F.col("source"))).alias("dir"),
        (k % 3).alias("volume"),
        (F.col("doc_id") % 6).cast("int").alias("m"),
        (1 + k % 2).alias("n_chunks"),
        F.col("n_chars").alias("length"),
    )


FILES = """fm_files AS (SELECT doc_id // 1000 AS archive, doc_id % 1000 AS file_idx, doc_id, concat('doc_', doc_id, '.txt') AS name,
  CASE WHEN doc_id % 10 = 0 THEN '' ELSE concat(lang, chr(92), source) END AS dir, (doc_id % 1000) % 3 AS volume, doc_id % 6 AS m,
  1 + (doc_id % 1000) % 2 AS n_chunks, n_chars AS length FROM documents)"""


def model_chunks(files: DataFrame) -> DataFrame:
    """Two chunks for every other file; stored at running offsets; lengths are claimed wrongly for some."""
    each = F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))
    part = F.floor(F.col("length") / F.col("n_chunks"))
    own = F.when(F.col("pos") == F.col("n_chunks") - 1, F.col("length") - part * (F.col("n_chunks") - 1)).otherwise(part).cast("long")
    m = F.col("m")
    bits = F.when(m == 0, S.COPYCOMP).when(m == 1, S.ZERO).when(m == 2, S.ZLIB).when(m == 3, S.BZIP).when(m == 4, S.LZMA).otherwise(S.DZ)
    stored = F.when(m == 0, F.col("decompressed_length")).when(m == 1, 0).otherwise(F.floor(F.col("decompressed_length") / 2)).cast("long")
    chunks = (
        files.withColumn("pos", each)
        .withColumn("chunk_id", F.col("file_idx") + F.floor(F.col("file_idx") / 2).cast("int") + F.col("pos"))
        .withColumn("decompressed_length", own)
        .withColumn("flags", bits)
        .withColumn("stored_length", stored)
        .withColumn("compressed_length", F.when((m >= 2) & (F.col("doc_id") % 7 == 0), F.col("decompressed_length")).otherwise(F.col("stored_length")))
        .withColumn("file", F.col("volume"))
    )
    return layout.running_offsets(chunks, "stored_length", "chunk_id").select("archive", "file_idx", "pos", "chunk_id", "offset", "compressed_length", "decompressed_length", "flags", "file", "stored_length")


CHUNKS = f"""{FILES},
fm_parts AS (SELECT *, file_idx + file_idx // 2 + pos AS chunk_id,
  CASE WHEN pos = n_chunks - 1 THEN length - (length // n_chunks) * (n_chunks - 1) ELSE length // n_chunks END AS decompressed_length,
  CASE m WHEN 0 THEN 256 WHEN 1 THEN 128 WHEN 2 THEN 8 WHEN 3 THEN 16 WHEN 4 THEN 512 ELSE 4 END AS flags
  FROM (SELECT *, unnest(range(n_chunks)) AS pos FROM fm_files)),
fm_stored AS (SELECT *, CASE WHEN m = 0 THEN decompressed_length WHEN m = 1 THEN 0 ELSE decompressed_length // 2 END AS stored_length FROM fm_parts),
fm_chunks AS (SELECT archive, file_idx, pos, chunk_id,
  CAST(coalesce(sum(stored_length) OVER (PARTITION BY archive, volume ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  CASE WHEN m >= 2 AND doc_id % 7 = 0 THEN decompressed_length ELSE stored_length END AS compressed_length, decompressed_length, flags, volume AS file, stored_length
  FROM fm_stored),
fm_sizes AS (SELECT archive, file, CAST(sum(stored_length) AS BIGINT) AS size FROM fm_chunks GROUP BY ALL),
fm_corrected AS (SELECT c.*, CASE WHEN flags & 540 <> 0 AND compressed_length = decompressed_length THEN room ELSE least(compressed_length, room) END AS corrected
  FROM (SELECT c.*, greatest(coalesce(lead("offset") OVER (PARTITION BY c.archive, c.file ORDER BY "offset", chunk_id), size, 0) - "offset", 0) AS room
        FROM fm_chunks c LEFT JOIN fm_sizes s ON c.archive = s.archive AND c.file = s.file) c)"""

DICTIONARY = """fm_dirs AS (SELECT archive, dir, dense_rank() OVER (PARTITION BY archive ORDER BY first_use) AS dir_id
  FROM (SELECT archive, dir, min(file_idx) AS first_use FROM fm_files WHERE dir <> '' GROUP BY ALL))"""

PATHS = f"""{CHUNKS}, {DICTIONARY},
fm_paths AS (SELECT f.archive, f.file_idx, d.dir_id, CASE WHEN d.dir IS NULL THEN name ELSE concat(d.dir, '/', name) END AS report_path,
  CASE WHEN d.dir IS NULL THEN name ELSE concat(d.dir, chr(92), name) END AS unpack_path
  FROM fm_files f LEFT JOIN fm_dirs d ON f.archive = d.archive AND f.dir = d.dir)"""


class Model:
    """The model's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.entries = model_files(spark, sf_dir)
        self.chunks = model_chunks(self.entries)
        self.sizes = self.chunks.groupBy("archive", F.col("file").alias("volume_id")).agg(F.sum("stored_length").alias("size"))
        self.dictionary = layout.directory_dictionary(self.entries)
        self.dirs = self.dictionary.withColumnRenamed("dir", "path")
        ids = F.transform(F.sequence(F.lit(0), F.col("n_chunks") - 1), lambda p: F.col("file_idx") + F.floor(F.col("file_idx") / 2).cast("int") + p)
        self.files = layout.with_directory_ids(self.entries, self.dictionary).select("archive", "file_idx", "name", "dir_id", ids.alias("chunk_ids"))
        self.corrected = layout.corrected_sizes(self.chunks.select("archive", "chunk_id", "offset", "compressed_length", "decompressed_length", "flags", "file"), self.sizes)


REGISTERED: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


# Layout --------------------------------------------------------------------------------------------------------------


@query(f"""WITH {FILES}, {DICTIONARY}, n AS (SELECT archive, count(*) AS n FROM fm_files GROUP BY 1)
SELECT archive, file_idx AS pos, name AS value FROM fm_files UNION ALL
SELECT d.archive, n + dir_id - 1, dir FROM fm_dirs d JOIN n ON d.archive = n.archive""")
def string_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    return layout.string_table(m.entries, m.dictionary)


@query(f"WITH {FILES}, {DICTIONARY} SELECT archive, dir_id, dir FROM fm_dirs")
def directory_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Model(spark, sf_dir).dictionary


@query(f"WITH {FILES}, {DICTIONARY} SELECT f.archive, file_idx, coalesce(dir_id, 0) AS dir_id FROM fm_files f LEFT JOIN fm_dirs d ON f.archive = d.archive AND f.dir = d.dir")
def file_directory_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    return layout.with_directory_ids(m.entries, m.dictionary).select("archive", "file_idx", "dir_id")


@query(f"""WITH {CHUNKS}, {DICTIONARY}, f AS (SELECT archive, count(*) AS num_user_files FROM fm_files GROUP BY 1), d AS (SELECT archive, count(*) AS n FROM fm_dirs GROUP BY 1),
c AS (SELECT archive, count(*) AS num_chunks, count(DISTINCT file) AS num_archive_files FROM fm_chunks GROUP BY 1)
SELECT f.archive, num_user_files, coalesce(n, 0) + 1 AS num_directories, num_user_files + coalesce(n, 0) AS num_strings, num_chunks, num_archive_files
FROM f LEFT JOIN d ON f.archive = d.archive LEFT JOIN c ON f.archive = c.archive""")
def archive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    return layout.counts(m.entries, m.chunks, m.dictionary)


@query(f"""WITH {FILES}, {DICTIONARY}, t AS (SELECT archive, octet_length(encode(name)) + 1 + 22 AS b FROM fm_files UNION ALL SELECT archive, octet_length(encode(dir)) + 1 FROM fm_dirs
UNION ALL SELECT DISTINCT archive, octet_length(encode(concat('vol', v, '.dz'))) + 1 FROM fm_files, (VALUES (1)) x(v) UNION ALL SELECT DISTINCT archive, octet_length(encode('vol2.dz')) + 1 FROM fm_files)
SELECT archive, CAST(13 + sum(b) AS BIGINT) AS header_size FROM t GROUP BY 1""")
def header_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    names = m.entries.select("archive").distinct().select("archive", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("volume_id")).withColumn("name", F.concat(F.lit("vol"), F.col("volume_id"), F.lit(".dz")))
    return layout.header_sizes(layout.string_table(m.entries, m.dictionary), m.entries, names)


@query(f"""WITH {CHUNKS} SELECT archive, file, chunk_id, "offset" + CASE WHEN file = 0 THEN 1000 ELSE 0 END AS "offset" FROM fm_chunks""")
def pack_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    base = F.when(F.col("file") == 0, 1000).otherwise(0)
    return layout.running_offsets(m.chunks.drop("offset"), "stored_length", "chunk_id", base).select("archive", "file", "chunk_id", "offset")


@query(f"WITH {CHUNKS} SELECT archive, chunk_id, corrected AS compressed_length, compressed_length AS claimed_length FROM fm_corrected")
def chunk_size_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Model(spark, sf_dir).corrected.select("archive", "chunk_id", "compressed_length", "claimed_length")


# Relations -----------------------------------------------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT archive, file_idx, pos, chunk_id FROM fm_chunks")
def file_chunk_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.file_chunks(Model(spark, sf_dir).files)


@query(f"""WITH {CHUNKS} SELECT archive, chunk_id, CASE WHEN file < 2 THEN concat('vol', file, '.dz') END AS name, CASE WHEN file = 2 THEN 'VolumeNotFound' END AS volume_error FROM fm_chunks""")
def volume_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    known = m.sizes.where("volume_id < 2").select("archive", "volume_id", F.concat(F.lit("vol"), F.col("volume_id"), F.lit(".dz")).alias("name"))
    return listing.volume_lookup(m.chunks, known).select("archive", "chunk_id", "name", "volume_error")


@query(f"WITH {PATHS} SELECT archive, file_idx, report_path, unpack_path FROM fm_paths")
def archive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    once = listing.archive_paths(m.files, m.dirs, "/").withColumnRenamed("path", "report_path")
    return listing.archive_paths(once, m.dirs, "\\").select("archive", "file_idx", "report_path", F.col("path").alias("unpack_path"))


@query(f"""WITH {PATHS}, s AS (SELECT archive, file_idx, CAST(sum(decompressed_length) AS BIGINT) AS size, CAST(sum(corrected) AS BIGINT) AS packed, bool_and(chunk_id % 97 <> 13) AS ok, bool_and(chunk_id % 89 <> 5) AS length_match,
  min_by(flags, pos) AS flags FROM fm_corrected GROUP BY ALL)
SELECT p.archive, p.file_idx, CASE WHEN ok THEN 'OK' ELSE 'FAIL' END AS status, size, packed, CASE WHEN flags = 8 THEN 'Zlib' WHEN flags = 16 THEN 'Bzip' WHEN flags = 512 THEN 'LZMA' WHEN flags = 256 THEN 'Copy' WHEN flags = 128 THEN 'Zero' ELSE 'Dz' END AS method,
  report_path AS path, length_match FROM fm_paths p JOIN s ON p.archive = s.archive AND p.file_idx = s.file_idx""")
def verify_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    statuses = m.chunks.select("archive", "chunk_id", (F.col("chunk_id") % 97 != 13).alias("ok"), (F.col("chunk_id") % 89 != 5).alias("length_match"))
    return listing.report(m.files, m.corrected, m.dirs, statuses)


@query(f"""WITH {PATHS} SELECT p.archive, p.file_idx, replace(unpack_path, chr(92), '/') AS path, c.file AS archive_file_index,
  CASE flags WHEN 8 THEN 'Zlib' WHEN 16 THEN 'Bzip' WHEN 256 THEN 'Copy' WHEN 128 THEN 'Zero' WHEN 512 THEN 'Lzma' ELSE 'Dz' END AS compression
FROM fm_paths p JOIN fm_chunks c ON p.archive = c.archive AND p.file_idx = c.file_idx AND c.pos = 0""")
def unpack_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Model(spark, sf_dir)
    return listing.manifest(m.files, m.chunks, m.dirs)


@query(f"WITH {CHUNKS} SELECT archive, file, bool_or(flags & 4 <> 0) AS has_dz FROM fm_chunks GROUP BY ALL")
def any_dz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.any_dz(Model(spark, sf_dir).chunks, "file")


@query("""SELECT doc_id, md5(string_agg(p, '' ORDER BY pos)) AS md5 FROM (SELECT doc_id, unnest([substr(text, 1, 7), substr(text, 8, 90), substr(text, 98)]) AS p, unnest([0, 1, 2]) AS pos FROM documents) GROUP BY 1""")
def reassemble_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    cut = F.array(F.substring(t, 1, 7), F.substring(t, 8, 90), F.substring(t, 98, 2147483647))
    parts = read(spark, sf_dir, "documents").select(F.lit(0).alias("archive"), F.col("doc_id").alias("file_idx"), F.posexplode(cut).alias("pos", "piece"))
    whole = listing.reassembled(parts.withColumn("data", F.col("piece").cast("binary")))
    return whole.select(F.col("file_idx").alias("doc_id"), F.md5("data").alias("md5"))


# Scalar functions ----------------------------------------------------------------------------------------------------


def spelled(k: Column) -> Column:
    """A spelling by number; every other one in capitals, and one that there isn't."""
    names = [*S.SPELLINGS, "rar"]
    name = F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    return F.when(k % 2 == 0, F.upper(name)).otherwise(name)


_SPELLED = "[" + ", ".join(f"'{x}'" for x in [*S.SPELLINGS, "rar"]) + "]"


@query(f"""SELECT doc_id, CASE lower(s) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.SPELLINGS.items())} END AS method
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(s) ELSE s END AS s FROM (SELECT doc_id, ({_SPELLED})[doc_id % {len(S.SPELLINGS) + 1} + 1] AS s FROM documents))""")
def method_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", flags.parse_method(spelled(F.col("doc_id"))).alias("method"))


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eleven flag bits in every combination, and others."""
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 331).cast("long").alias("k")).distinct().select("k", (F.col("k") % 2048).cast("int").alias("flags"))


_BITS = "(SELECT k, k % 2048 AS flags FROM (SELECT DISTINCT l_orderkey * 7 + l_linenumber * 331 AS k FROM lineitem))"


@query(f"SELECT k, CASE {' '.join(f'''WHEN flags & {m} <> 0 THEN '{n}' ''' for m, n in flags.MANIFEST)} ELSE 'Dz' END AS method FROM {_BITS}")
def method_label_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bits(spark, sf_dir).select("k", flags.manifest_method(F.col("flags")).alias("method"))


@query(f"SELECT k, CASE {' '.join(f'''WHEN flags & {m} <> 0 THEN '{n}' ''' for m, n in flags.REPORT)} ELSE 'Unknown' END AS method FROM {_BITS}")
def method_label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bits(spark, sf_dir).select("k", flags.report_method(F.col("flags")).alias("method"))


@query(f"""SELECT k, CASE WHEN flags & 128 <> 0 THEN 'zero' WHEN flags & 352 <> 0 THEN 'raw' WHEN flags & 1024 <> 0 AND flags & 540 = 0 THEN 'raw' WHEN flags & 8 <> 0 THEN 'zlib'
WHEN flags & 16 <> 0 THEN 'bzip' WHEN flags & 512 <> 0 THEN 'lzma' ELSE 'unsupported' END AS route FROM {_BITS}""")
def decode_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bits(spark, sf_dir).select("k", flags.decode_route(F.col("flags")).alias("route"))


def odd_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs without their scheme, altered by number: mixed separators, dots, drives, parents, roots."""
    p, k = F.regexp_replace("url", "^[a-z]+://", ""), F.col("page_id") % 7
    return read(spark, sf_dir, "pages").select(
        "page_id", F.when(k == 0, F.concat(F.lit("/"), p)).when(k == 1, F.translate(p, "/", "\\")).when(k == 2, F.concat(F.lit("./"), p, F.lit("/."))).when(k == 3, F.concat(p, F.lit("/../x"))).when(k == 4, F.concat(F.lit("C:\\"), p)).when(k == 5, F.lit("/./")).otherwise(p).alias("path")
    )


_ODD = """(SELECT page_id, CASE page_id % 7 WHEN 0 THEN concat('/', p) WHEN 1 THEN replace(p, '/', chr(92)) WHEN 2 THEN concat('./', p, '/.') WHEN 3 THEN concat(p, '/../x') WHEN 4 THEN concat('C:', chr(92), p) WHEN 5 THEN '/./' ELSE p END AS path
FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages))"""


@query(f"""SELECT page_id, CASE WHEN len(list_filter(l, lambda x: x = '..' OR contains(x, ':'))) > 0 THEN NULL WHEN len(l) = 0 THEN '.' ELSE array_to_string(l, '/') END AS path,
CASE WHEN list_contains(l, '..') THEN 'parent' WHEN len(list_filter(l, lambda x: contains(x, ':'))) > 0 THEN 'prefix' END AS error
FROM (SELECT page_id, list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda x: x <> '' AND x <> '.') AS l FROM {_ODD})""")
def path_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_paths(spark, sf_dir).select("page_id", paths.resolve(F.col("path")).alias("path"), paths.resolve_error(F.col("path")).alias("error"))


_SANITIZED = """CASE WHEN list_contains(l, '..') OR len(l) = 0 THEN NULL ELSE array_to_string(l, '/') END AS path, CASE WHEN list_contains(l, '..') THEN 'parent' WHEN len(l) = 0 THEN 'empty' END AS error"""


@query(f"SELECT page_id, {_SANITIZED} FROM (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS l FROM {_ODD})")
def path_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_paths(spark, sf_dir).select("page_id", paths.sanitize(F.col("path")).alias("path"), paths.sanitize_error(F.col("path")).alias("error"))


@query(f"SELECT page_id, replace(path, '/', chr(92)) AS path FROM {_ODD}")
def path_to_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_paths(spark, sf_dir).select("page_id", paths.to_archive(F.col("path")).alias("path"))


@query(f"SELECT page_id, path FROM (SELECT page_id, {_SANITIZED} FROM (SELECT page_id, list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda x: x <> '' AND x <> '.') AS l FROM {_ODD}))")
def path_from_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_paths(spark, sf_dir).select("page_id", paths.from_archive(F.col("path")).alias("path"))


@query(f"""SELECT page_id, string_split(path, '/')[-1] AS name, array_to_string(string_split(path, '/')[:-2], '/') AS parent, CASE WHEN array_to_string(string_split(path, '/')[:-2], '/') IN ('', '.') THEN true ELSE false END AS is_root,
CASE WHEN strpos(substr(string_split(path, '/')[-1], 2), '.') > 0 THEN regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') ELSE string_split(path, '/')[-1] END AS stem FROM {_ODD}""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return odd_paths(spark, sf_dir).select("page_id", paths.basename(p).alias("name"), paths.parent(p).alias("parent"), paths.is_root(paths.parent(p)).alias("is_root"), paths.stem(paths.basename(p)).alias("stem"))


# Codecs --------------------------------------------------------------------------------------------------------------


def roundtrip(method: str, expected: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = read(spark, sf_dir, "documents").select("doc_id", F.lit(method).alias("method"), F.col("text").cast("binary").alias("data"))
        stored = codec.encoded(d).withColumnsRenamed({"original_length": "decompressed_length", "stored_length": "compressed_length"})
        back = codec.decoded(stored)
        return back.select("doc_id", "flags", F.md5("data").alias("md5"), F.col("substituted"), "error_kind")

    run.__name__ = f"codec_roundtrip_{method.lower()}"
    known = codec.ENCODERS.get(method)
    bits_ = (known or codec.ENCODERS["Copy"])[0]
    query(f"SELECT doc_id, {bits_} AS flags, md5({expected}) AS md5, {'false' if known else 'true'} AS substituted, CAST(NULL AS VARCHAR) AS error_kind FROM documents")(run)


for _m in S.METHODS:
    roundtrip(_m, "repeat(chr(0), octet_length(encode(text)))" if _m == "Zero" else "text")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'UnsupportedCompression' WHEN doc_id % 5 < 4 AND octet_length(encode(text)) >= 0 THEN 'Io' END AS error_kind FROM documents""")
def corrupt_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored bytes damaged in five ways: cut off, without a decoder, a wrong magic, shorter than said, and not at all."""
    k = F.col("doc_id") % 5
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(k == 2, "Bzip").when(k == 0, "Zlib").otherwise("Copy").alias("method"), F.col("text").cast("binary").alias("data"))
    stored = codec.encoded(d).withColumnsRenamed({"original_length": "decompressed_length", "stored_length": "compressed_length"})
    n = F.col("compressed_length").cast("int")
    cut = F.when(k == 0, F.substring("data", F.lit(1), n - 9)).when(k == 2, F.concat(F.lit(b"XYZ"), F.substring("data", F.lit(4), n))).otherwise(F.col("data"))
    damaged = stored.withColumn("data", cut).withColumn("flags", F.when(k == 1, S.DZ).otherwise(F.col("flags"))).withColumn("compressed_length", F.when(k == 0, n - 9).when(k == 3, n + 5).otherwise(n).cast("long")).withColumn("decompressed_length", F.col("decompressed_length") + F.when(k == 4, 0).otherwise(1000003))
    return codec.decoded(damaged).select("doc_id", "error_kind")


# Configurations ------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, 'file' AS key, concat('DIR/f', doc_id, '.txt') AS path, doc_id % 3 AS archive_file_index, CASE doc_id % 3 WHEN 0 THEN 'Zlib' WHEN 1 THEN 'Jpeg' ELSE 'RandomAccess' END AS compression,
CASE WHEN doc_id % 2 = 0 THEN 'to 25%' ELSE '' END AS modifiers FROM documents WHERE doc_id % 4 > 1
UNION ALL SELECT doc_id, 'archive', NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 4 = 1""")
def config_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    method = F.when(k % 3 == 0, "ZLIB").when(k % 3 == 1, "jpg").otherwise("RandomAccess")
    line = F.concat(F.lit("  FILE .\\DIR\\\\f"), k, F.lit(".txt\t"), k % 3, F.lit("  "), method, F.when(k % 2 == 0, "   to \t25%").otherwise(""), F.lit(" \r"))
    lines = read(spark, sf_dir, "documents").select("doc_id", F.when(k % 4 == 0, "  # a comment").when(k % 4 == 1, F.concat(F.lit("archive vol"), k, F.lit(".dz"))).otherwise(line).alias("value"))
    return parsed_lines(lines).select("doc_id", "key", "path", "archive_file_index", "compression", "modifiers")


# Whole archives ------------------------------------------------------------------------------------------------------

METHOD_OF = ("Copy", "Zlib", "Bzip", "Lzma", "Zero")


def local(path: str) -> str:
    """A path of this machine's files without its scheme."""
    return path.removeprefix("file://")


def packed_archives(spark: SparkSession, sf_dir: str, most: int = 0xFFFF) -> str:
    """The documents as the files of archives of three volumes, in a folder of the shared one.  An archive holds `most`
    documents, so there are as many archives as it takes."""
    folder = local(archives.shared_folder(spark))
    k = F.col("doc_id")
    entries = read(spark, sf_dir, "documents").select(
        F.floor(k / most).cast("long").alias("archive"),
        (k % most).alias("file_idx"),
        F.concat(F.when(k % 10 == 0, "").otherwise(F.concat("lang", F.lit("/"), "source", F.lit("/"))), F.lit("doc_"), k, F.lit(".txt")).alias("path"),
        (k % 3).cast("int").alias("volume"),
        F.element_at(F.array(*map(F.lit, METHOD_OF)), (k % 5 + 1).cast("int")).alias("method"),
        F.col("text").cast("binary").alias("data"),
    )
    out = f"{folder}/archives-{uuid.uuid4().hex}"
    archives.pack_frames(entries, ["{}.dz", "{}.one", "{}.two"], out)
    return out


def file_number(most: int) -> Column:
    """A file's number among those of all archives."""
    return (F.regexp_extract("archive", r"(\d+)\.dz$", 1).cast("long") * most + F.col("file_idx")).alias("file_idx")


_E2E = """CASE WHEN doc_id % 10 = 0 THEN '' ELSE concat(lang, {sep}, source, '/') END"""


@query(f"""SELECT doc_id AS file_idx, 'OK' AS status, octet_length(encode(text)) AS size, ['Copy', 'Zlib', 'Bzip', 'LZMA', 'Zero'][doc_id % 5 + 1] AS method,
concat({_E2E.format(sep='chr(92)')}, 'doc_', doc_id, '.txt') AS path, true AS length_match FROM documents""")
def archive_e2e(spark: SparkSession, sf_dir: str, most: int = 0xFFFF) -> DataFrame:
    """Packs the documents, as many archives as it takes, and verifies all of them."""
    return archives.verify(spark, packed_archives(spark, sf_dir, most), perPartition="1").select(file_number(most), "status", "size", "method", "path", "length_match")


@query(f"""SELECT doc_id AS file_idx, concat({_E2E.format(sep="'/'")}, 'doc_', doc_id, '.txt') AS path, md5(CASE WHEN doc_id % 5 = 4 THEN repeat(chr(0), octet_length(encode(text))) ELSE text END) AS md5 FROM documents""")
def archive_extract(spark: SparkSession, sf_dir: str, most: int = 0xFFFF) -> DataFrame:
    """Packs the documents, as many archives as it takes, and decodes all files again."""
    return archives.contents(spark, packed_archives(spark, sf_dir, most), perPartition="1").select(file_number(most), "path", F.md5("data").alias("md5"))


def unpacked_folders(spark: SparkSession, sf_dir: str, most: int) -> dict[int, str]:
    """The documents packed, then every archive extracted to a folder of its own, by the archives' numbers."""
    packed = packed_archives(spark, sf_dir, most)
    numbers = sorted(int(r.archive.rpartition("/")[2].removesuffix(".dz")) for r in table(spark, packed, "archives", perPartition="1").select("archive").collect())
    archives.unpack_all(spark, [f"{packed}/{k}.dz" for k in numbers], f"{packed}/files")
    return {k: f"{packed}/files/{k}" for k in numbers}


@query(f"""SELECT doc_id // 65535 AS archive, concat({_E2E.format(sep="'/'")}, 'doc_', doc_id, '.txt') AS path, octet_length(encode(text)) AS size, md5(CASE WHEN doc_id % 5 = 4 THEN repeat(chr(0), octet_length(encode(text))) ELSE text END) AS md5 FROM documents""")
def unpack_files(spark: SparkSession, sf_dir: str, most: int = 0xFFFF) -> DataFrame:
    """Packs the documents, extracts all archives and reads the files that this has written."""
    folders = unpacked_folders(spark, sf_dir, most)
    root = folders[min(folders)].rpartition("/")[0]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"file://{root}")
    inside = F.substring_index("path", f"{root}/", -1)
    return found.select(F.substring_index(inside, "/", 1).cast("long").alias("archive"), F.regexp_replace(inside, "^[0-9]+/", "").alias("path"), F.col("length").alias("size"), F.md5("content").alias("md5"))


def repacked(spark: SparkSession, folders: dict[int, str], config: str) -> list[str]:
    """Packs what each folder's configuration lists, and returns the new archives."""
    out = f"{folders[min(folders)].rpartition('/')[0]}/again-{uuid.uuid4().hex}"
    return archives.pack_all(spark, {k: f"{folder}/{config.format(k)}" for k, folder in folders.items()}, out)


@query(f"""SELECT doc_id AS file_idx, 'OK' AS status, octet_length(encode(text)) AS size, ['Copy', 'Zlib', 'Bzip', 'LZMA', 'Zero'][doc_id % 5 + 1] AS method,
concat({_E2E.format(sep='chr(92)')}, 'doc_', doc_id, '.txt') AS path, true AS length_match FROM documents""")
def pack_toml(spark: SparkSession, sf_dir: str, most: int = 0xFFFF) -> DataFrame:
    """Packs the documents, extracts all archives, packs them once more by the TOML that the extraction wrote, and verifies the result."""
    again = repacked(spark, unpacked_folders(spark, sf_dir, most), "{}.toml")
    return archives.verify(spark, again, perPartition="1").select(file_number(most), "status", "size", "method", "path", "length_match")


@query(f"""SELECT doc_id AS file_idx, concat({_E2E.format(sep="'/'")}, 'doc_', doc_id, '.txt') AS path, md5(CASE WHEN doc_id % 5 = 4 THEN repeat(chr(0), octet_length(encode(text))) ELSE text END) AS md5 FROM documents""")
def pack_lines(spark: SparkSession, sf_dir: str, most: int = 0xFFFF) -> DataFrame:
    """Packs the documents, extracts all archives, packs them once more by configurations of lines, and decodes the result."""
    folders = unpacked_folders(spark, sf_dir, most)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, folder in zip(b.column("k").to_pylist(), b.column("folder").to_pylist(), strict=True):
                listed = read_config(f"{folder}/{k}.toml")["files"]
                lines = ["# made of the extraction's configuration", *(f"ARCHIVE {k}.{x}" for x in ("dz", "one", "two")), "basedir ."]
                lines += [f"file\t{f['path'].replace('/', chr(92))} {f['archive_file_index']}  {f['compression'].upper()} as is" for f in listed]
                with files.writer(f"{folder}/{k}.cfg") as out:
                    out.write("\r\n".join(lines).encode())
            yield b

    each = spark.createDataFrame(list(folders.items()), "k long, folder string").repartitionByRange(len(folders), "k")
    each.mapInArrow(write, "k long, folder string").write.format("noop").mode("overwrite").save()
    again = repacked(spark, folders, "{}.cfg")
    return archives.contents(spark, again, perPartition="1").select(file_number(most), "path", F.md5("data").alias("md5"))


def stored_oddly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts three times over, stored in ways that decoding forgives, or not, by number."""
    import bz2
    import zlib

    for b in codec.pieces(batches, lambda batch: [3 * n for n in pc.binary_length(batch.column("data")).fill_null(0).to_pylist()]):
        out = []
        for k, text in zip(b.column("doc_id").to_pylist(), b.column("data").to_pylist(), strict=True):
            text *= 3
            gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
            kinds = (
                (S.ZLIB, zlib.compress(text)),
                (S.ZLIB, (gzip.compress(text) + gzip.flush())[:-4]),
                (S.ZLIB, b"\x01" + text),
                (S.BZIP, b"\x01" + text),
                (S.LZMA, b"\x01" + text),
                (S.MP3, text),
                (S.JPEG, text),
                (S.RANDOMACCESS, text),
                (S.BZIP, bz2.compress(text)[:-9]),
                (S.COMBUF, text),
            )
            flags, data = kinds[k % len(kinds)]
            raw = k % len(kinds) in (2, 3, 4)
            if len(data) == len(text) and not raw and flags in (S.ZLIB, S.BZIP):
                data += b"\0"
            out.append((k, flags, len(data), len(data) if raw else len(text), data))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "flags", "compressed_length", "decompressed_length", "data"])


@query("""SELECT doc_id, CASE WHEN k < 2 OR k BETWEEN 5 AND 7 THEN md5(repeat(text, 3)) WHEN k < 5 THEN md5(concat(chr(1), repeat(text, 3))) END AS md5, k BETWEEN 2 AND 4 AS raw_fallback,
CASE k WHEN 8 THEN 'Io' WHEN 9 THEN 'UnsupportedCompression' END AS error_kind FROM (SELECT doc_id, doc_id % 10 AS k, text FROM documents)""")
def decode_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zlib container, gzip without its footer, raw data that is said to be compressed, methods that store bytes as they are,
    a stream cut off, and a method without decoder."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    stored = d.mapInArrow(stored_oddly, "doc_id long, flags int, compressed_length long, decompressed_length long, data binary")
    return codec.decoded(stored).select("doc_id", F.md5("data").alias("md5"), "raw_fallback", "error_kind")


def written_headers(spark: SparkSession, sf_dir: str, damage: bool) -> str:
    """A folder with an archive for each supplier, which has one file, an empty chunk for the range coder, and range
    settings by number; on request damaged by number: not, a wrong magic, cut off, a name that isn't UTF-8."""
    out = f"{local(archives.shared_folder(spark))}/headers-{uuid.uuid4().hex}"
    files.make_dirs(out)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("s_suppkey").to_pylist():
                h = Header(1, 1, k % 256, [f"s{k}.txt"], [(0, [0])], 1, [(0, 0, 0, S.DZ, 0)], [], tuple((k * (j + 3)) % 256 for j in range(10)))
                data = serialise(h)
                if damage:
                    data = (data, b"\x01" + data[1:], data[:-7], data.replace(b"s", b"\xff"))[k % 4]
                with files.writer(f"{out}/{k}.dz") as f:
                    f.write(data)
            yield b

    read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey")).mapInArrow(write, "s_suppkey long").write.format("noop").mode("overwrite").save()
    return out


def supplier() -> Column:
    return F.regexp_extract("archive", r"(\d+)\.dz$", 1).cast("long").alias("s_suppkey")


@query(f"""SELECT k AS s_suppkey, CAST(k % 256 AS INTEGER) AS version, 9 + length(concat('s', k, '.txt')) + 1 + 6 + 4 + 16 + 10 AS header_end, {', '.join(f"CAST((k * {j + 3}) % 256 AS INTEGER) AS {f}" for j, f in enumerate(S.RANGE_FIELDS))},
'dz' AS option_method, CAST((k * 3) % 256 AS INTEGER) AS option_win_size, CAST((k * 12) % 256 AS INTEGER) AS option_big_min_match, true AS option_preprocess FROM (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier)""")
def range_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with range settings, written, read as a table and turned into a configuration's options."""
    found = table(spark, written_headers(spark, sf_dir, False), "archives").select(supplier(), "version", "header_end", "range")

    def options(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [archives.options_of(r) for r in b.column("range").to_pylist()]
            kinds = {"method": pa.string(), "win_size": pa.int32(), "big_min_match": pa.int32(), "preprocess": pa.bool_()}
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([o[k] for o in got], t) for k, t in kinds.items())], names=[*b.schema.names, *(f"option_{k}" for k in kinds)])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return found.mapInArrow(options, f"{kinds}, option_method string, option_win_size int, option_big_min_match int, option_preprocess boolean").select("s_suppkey", "version", "header_end", "range.*", "option_method", "option_win_size", "option_big_min_match", "option_preprocess")


@query("""SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN 'InvalidHeader' WHEN 2 THEN 'Io' WHEN 3 THEN 'Utf8' END AS error_kind, CASE WHEN s_suppkey % 4 = 0 THEN 1 END AS num_chunks FROM supplier""")
def header_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of which most are damaged, read permissively."""
    return table(spark, written_headers(spark, sf_dir, True), "archives", mode="permissive").select(supplier(), "error_kind", "num_chunks")


@query(f"""WITH {PATHS}, s AS (SELECT archive, file_idx, CAST(sum(decompressed_length) AS BIGINT) AS size, CAST(sum(corrected) AS BIGINT) AS packed, bool_and(chunk_id % 97 <> 13) AS ok, min_by(flags, pos) AS flags FROM fm_corrected GROUP BY ALL)
SELECT p.archive, p.file_idx, concat(rpad(CAST(p.file_idx AS VARCHAR), CAST(greatest(5, length(CAST(p.file_idx AS VARCHAR))) AS INTEGER), ' '), ' | ', rpad(CASE WHEN ok THEN 'OK' ELSE 'FAIL' END, 7, ' '), ' | ',
  rpad(CAST(size AS VARCHAR), CAST(greatest(10, length(CAST(size AS VARCHAR))) AS INTEGER), ' '), ' | ', rpad(CAST(packed AS VARCHAR), CAST(greatest(10, length(CAST(packed AS VARCHAR))) AS INTEGER), ' '), ' | ',
  rpad(CASE WHEN flags = 8 THEN 'Zlib' WHEN flags = 16 THEN 'Bzip' WHEN flags = 512 THEN 'LZMA' WHEN flags = 256 THEN 'Copy' WHEN flags = 128 THEN 'Zero' ELSE 'Dz' END, 8, ' '), ' | ', report_path) AS line
FROM fm_paths p JOIN s ON p.archive = s.archive AND p.file_idx = s.file_idx""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as the text that is shown."""
    return listing.report_text(verify_listing(spark, sf_dir))


QUERIES = {name: f for name, (f, _) in REGISTERED.items()}
SQL = {name: sql for name, (_, sql) in REGISTERED.items() if sql}
