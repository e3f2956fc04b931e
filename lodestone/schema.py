"""Types and fixed values of multi-volume archives."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the archive format.
MAGIC = 0x5A525444
END_OF_CHUNKS = 0xFFFF
COMBUF = 0x1
DZ = 0x4
ZLIB = 0x8
BZIP = 0x10
MP3 = 0x20
JPEG = 0x40
ZERO = 0x80
COPYCOMP = 0x100
LZMA = 0x200
RANDOMACCESS = 0x400
#: A chunk with one of these is compressed.
COMPRESSED = LZMA | ZLIB | BZIP | DZ
#: Bytes of the fixed parts of a header.
SETTINGS_BYTES, FILE_BYTES, CHUNK_SETTINGS_BYTES, CHUNK_BYTES, RANGE_BYTES = 9, 6, 4, 16, 10

#: Method names as configurations spell them, and the spellings that line configurations accept.
METHODS = ("Dz", "Zlib", "Bzip", "Copy", "Zero", "Mp3", "Jpeg", "Lzma", "Combuf", "RandomAccess")
SPELLINGS = {m.lower(): m for m in METHODS} | {"jpg": "Jpeg"}

RANGE_FIELDS = ("win_size", "flags", "offset_table_size", "offset_tables", "offset_contexts", "ref_length_table_size", "ref_length_tables", "ref_offset_table_size", "ref_offset_tables", "big_min_match")

#: Options of a configuration with their defaults.
OPTION_DEFAULTS = {
    "method": "dz",
    "max_mem_usage": -1,
    "use_combuf": False,
    "preprocess": True,
    "win_size": 16,
    "offset_table_size": 8,
    "offset_tables": 3,
    "offset_contexts": 3,
    "ref_length_table_size": 7,
    "ref_length_tables": 1,
    "ref_offset_table_size": 7,
    "ref_offset_tables": 3,
    "big_min_match": 15,
}

RANGE = T.StructType([T.StructField(f, T.IntegerType()) for f in RANGE_FIELDS])


_KINDS = {"STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "BINARY": T.BinaryType(), "ARRAY<INT>": T.ArrayType(T.IntegerType())}


def struct(text: str) -> T.StructType:
    """A flat schema from `name KIND, ...`; unlike fromDDL it needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(","))])


TABLES = {
    "archives": T.StructType([*struct("archive STRING, num_user_files INT, num_directories INT, version INT, num_archive_files INT, num_chunks INT, header_end BIGINT").fields, T.StructField("range", RANGE), T.StructField("error_kind", T.StringType()), T.StructField("error_msg", T.StringType())]),
    "strings": struct("archive STRING, pos INT, value STRING"),
    "files": struct("archive STRING, file_idx INT, name STRING, dir_id INT, chunk_ids ARRAY<INT>"),
    "dirs": struct("archive STRING, dir_id INT, path STRING"),
    "volumes": struct("archive STRING, volume_id INT, name STRING, path STRING, size BIGINT"),
    "chunks": struct("archive STRING, chunk_id INT, offset BIGINT, compressed_length BIGINT, decompressed_length BIGINT, flags INT, file INT"),
}

OPTIONS = T.StructType([T.StructField(k, T.StringType() if isinstance(v, str) else T.BooleanType() if isinstance(v, bool) else T.IntegerType()) for k, v in OPTION_DEFAULTS.items()])
ENTRY = struct("path STRING, archive_file_index INT, compression STRING, modifiers STRING")
CONFIG = T.StructType([T.StructField("archives", T.ArrayType(T.StringType())), T.StructField("base_dir", T.StringType()), T.StructField("files", T.ArrayType(ENTRY)), T.StructField("options", OPTIONS)])


class ArchiveError(Exception):
    """A failure with one of the kinds Io, InvalidHeader, UnsupportedVersion, Utf8, UnsupportedCompression,
    VolumeNotFound, VolumeOpenError."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind, self.message = kind, message

    def __reduce__(self):
        return type(self), (self.kind, self.message)
