"""Stored bytes of chunks, read by seeking."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.functions.codec import decode
from lodestone.sources import files

#: Bytes that one task reads of a volume, about; bytes that leave it at once; the largest value that is returned.
RANGE_BYTES, OUT_BYTES, VALUE_BYTES = 64 << 20, 16 << 20, (1 << 31) - 1

RESULT = "archive string, chunk_id int, data binary, data_length bigint, data_md5 string, error_kind string, error_msg string, raw_fallback boolean"


def decoded_chunks(chunks: DataFrame, volumes: DataFrame, keep_data: bool = True, resolver: str = "", most: int = VALUE_BYTES) -> DataFrame:
    """(archive, chunk_id, data, data_length, data_md5, error_kind, error_msg, raw_fallback) of each chunk.

    chunks have corrected lengths.  A chunk that fails has an error and no data.  Tasks
    get ranges of a volume, read them in order of offset and hold one open file per volume; zeros are
    made up without any read.  Without keep_data only length and digest leave the task.
    """
    zero = F.col("flags").bitwiseAND(S.ZERO) != 0
    known = volumes.select("archive", F.col("volume_id").alias("file"), F.col("path").alias("__path"), F.lit(True).alias("__known"))
    found = chunks.join(known, ["archive", "file"], "left").select(
        "archive", "chunk_id", "offset", "compressed_length", "decompressed_length", "flags", "file", "__path", F.coalesce("__known", F.lit(False)).alias("known"), F.when(zero, 0).otherwise(F.floor(F.col("offset") / RANGE_BYTES)).alias("range")
    )
    dealt = found.repartition("archive", "file", "range").sortWithinPartitions("archive", "file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        handles: dict[str, object] = {}
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["archive", "chunk_id", "data", "data_length", "data_md5", "error_kind", "error_msg", "raw_fallback"])
            out.clear()
            return batch

        def stored(path: str | None, known: bool, volume: int, offset: int, n: int) -> bytes:
            if not known:
                raise S.ArchiveError("VolumeNotFound", f"volume {volume}")
            if path not in handles:
                while len(handles) > 64:
                    handles.pop(next(iter(handles))).close()
                try:
                    handles[path] = files.open_file(path, resolver)
                except (OSError, TypeError, AttributeError) as e:
                    raise S.ArchiveError("VolumeOpenError", str(e)) from None
            handles[path].seek(offset)
            return handles[path].read(n)

        try:
            for batch in batches:
                for r in batch.to_pylist():
                    data, raw, kind, message = None, False, None, None
                    try:
                        bytes_ = b"" if r["flags"] & S.ZERO else stored(r["__path"], r["known"], r["file"], r["offset"], r["compressed_length"])
                        got = decode(r["flags"], r["compressed_length"], r["decompressed_length"], bytes_, most)
                        data, raw, kind, message = got.data, got.raw_fallback, got.error_kind, got.error_msg
                    except S.ArchiveError as e:
                        kind, message = e.kind, e.message
                    except OSError as e:
                        kind, message = "Io", str(e)
                    out.append((r["archive"], r["chunk_id"], data if keep_data else None, None if data is None else len(data), None if data is None else hashlib.md5(data).hexdigest(), kind, message, raw))
                    held += len(data) if data and keep_data else 200
                    if held > OUT_BYTES:
                        yield flush()
                        held = 0
            if out:
                yield flush()
        finally:
            for h in handles.values():
                h.close()

    return dealt.mapInArrow(read, RESULT)
