"""Chunk codecs over bytes, and the same over Arrow batches."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestone import schema as S

#: Output of one decompression step; what an error loses is less than that.
STEP = 4096
#: Bytes of chunks, stored or claimed, that are encoded or decoded together and leave as a batch, at most (one chunk at least).
TOGETHER = 2 << 20


@dataclass
class Decoded:
    data: bytes | None
    raw_fallback: bool = False
    error_kind: str | None = None
    error_msg: str | None = None


def _inflate(data: bytes, wbits: int) -> tuple[bytes, str | None]:
    """What could be inflated, and what went wrong, if anything.  Bytes after the stream don't matter."""
    d, out, rest = zlib.decompressobj(wbits), [], data
    try:
        while rest and not d.eof:
            out.append(d.decompress(rest, STEP))
            rest = d.unconsumed_tail
        if not d.eof:
            out.append(d.flush())
    except zlib.error as e:
        return b"".join(out), str(e)
    return b"".join(out), None if d.eof else "unexpected end of stream"


def _stepwise(d, data: bytes, errors: tuple) -> tuple[bytes, str | None]:
    out, feed = [], data
    try:
        while not d.eof:
            piece = d.decompress(feed, STEP)
            feed = b""
            out.append(piece)
            if not piece and d.needs_input:
                return b"".join(out), "unexpected end of stream"
    except errors as e:
        return b"".join(out), str(e)
    return b"".join(out), None


def _zlib(data: bytes, compressed: int, length: int) -> Decoded:
    same = compressed == length
    if same and (not data or data[0] & 0x0F != 8):
        return Decoded(data, raw_fallback=True)
    if data[:2] == b"\x1f\x8b":
        out, wrong = _inflate(data, 31)
        return Decoded(out) if wrong is None or len(out) == length else Decoded(None, error_kind="Io", error_msg=wrong)
    out, wrong = _inflate(data, 15)
    if wrong is None:
        return Decoded(out)
    return Decoded(data, raw_fallback=True) if same else Decoded(None, error_kind="Io", error_msg=wrong)


def _bzip(data: bytes, compressed: int, length: int) -> Decoded:
    same = compressed == length
    if same and data[:3] != b"BZh":
        return Decoded(data, raw_fallback=True)
    out, wrong = _stepwise(bz2.BZ2Decompressor(), data, (OSError, ValueError))
    if wrong is None:
        return Decoded(out)
    return Decoded(data, raw_fallback=True) if same else Decoded(None, error_kind="Io", error_msg=wrong)


def _lzma(data: bytes, compressed: int, length: int) -> Decoded:
    same = compressed == length
    if same and data[:1] != b"\x5d":
        return Decoded(data, raw_fallback=True)
    if len(data) < 13 or data[0] >= 225:
        return Decoded(None, error_kind="Io", error_msg="bad stream header")
    out, wrong = _stepwise(lzma.LZMADecompressor(lzma.FORMAT_ALONE, memlimit=1 << 32), data, (lzma.LZMAError, EOFError))
    if wrong is None or len(out) > int(struct.unpack("f", struct.pack("f", compressed * 0.8))[0]):
        return Decoded(out)
    return Decoded(data, raw_fallback=True) if same else Decoded(None, error_kind="Io", error_msg=wrong)


def decode(flags: int, compressed: int, length: int, data: bytes, most: int = (1 << 31) - 1) -> Decoded:
    """A chunk's content from its stored bytes.  `compressed` is the corrected stored length.

    A length beyond `most` is refused, as one value can't hold it.
    """
    if flags & S.ZERO:
        return Decoded(bytes(length)) if length <= most else Decoded(None, error_kind="Io", error_msg=f"{length} bytes are too many for one value")
    if len(data) < compressed:
        return Decoded(None, error_kind="Io", error_msg="failed to fill whole buffer")
    if flags & (S.COPYCOMP | S.MP3 | S.JPEG) or (flags & S.RANDOMACCESS and not flags & S.COMPRESSED):
        return Decoded(data)
    for bit, route in ((S.ZLIB, _zlib), (S.BZIP, _bzip), (S.LZMA, _lzma)):
        if flags & bit:
            return route(data, compressed, length)
    return Decoded(None, error_kind="UnsupportedCompression", error_msg=f"flags {flags:#x}")


def _lzma_alone(data: bytes) -> bytes:
    """With the length in the header rather than an end mark only.  A dictionary larger than the data only costs time and memory."""
    dictionary = min(max(1 << 12, 1 << (len(data) - 1).bit_length()), 1 << 23) if data else 1 << 12
    packed = lzma.compress(data, lzma.FORMAT_ALONE, filters=[{"id": lzma.FILTER_LZMA1, "preset": 6, "dict_size": dictionary}])
    return packed[:5] + struct.pack("<Q", len(data)) + packed[13:]


def _gzip(data: bytes) -> bytes:
    """Never as long as the data, as decoding takes such bytes for raw ones; a byte after the stream doesn't matter."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    packed = c.compress(data) + c.flush()
    return packed + b"\0" if len(packed) == len(data) else packed


ENCODERS: dict[str, tuple[int, Callable[[bytes], bytes]]] = {
    "Copy": (S.COPYCOMP, bytes),
    "Zero": (S.ZERO, lambda data: b""),
    "Zlib": (S.ZLIB, _gzip),
    "Bzip": (S.BZIP, bz2.compress),
    "Lzma": (S.LZMA, _lzma_alone),
}


def encode(method: str, data: bytes) -> tuple[int, bytes, bool]:
    """Flags, stored bytes, and whether the method has no encoder, so that the data is stored as it is."""
    if method not in S.METHODS:
        raise ValueError(f"no such method: {method}")
    flags, pack = ENCODERS.get(method, ENCODERS["Copy"])
    return flags, pack(data), method not in ENCODERS


def bounded(df: DataFrame) -> DataFrame:
    """Bounds the session's Arrow batches by bytes, whatever the rows' lengths."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TOGETHER))
    return df


def pieces(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], list[int | None]]) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose sizes add up to TOGETHER at most; a larger row is a slice by itself."""
    for batch in batches:
        since, held = 0, 0
        for k, n in enumerate(size(batch)):
            if k > since and held + (n or 0) > TOGETHER:
                yield batch.slice(since, k - since)
                since, held = k, 0
            held += n or 0
        if since < batch.num_rows:
            yield batch.slice(since)


def encoded(df: DataFrame, data: str = "data", method: str = "method") -> DataFrame:
    """df with `data` encoded, and flags, original_length, stored_length and substituted added."""
    extra = {"flags": pa.int32(), "original_length": pa.int64(), "stored_length": pa.int64(), "substituted": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, lambda batch: pc.binary_length(batch.column(data)).to_pylist()):
            plain = [x or b"" for x in b.column(data).to_pylist()]
            got = [encode(m, x) for m, x in zip(b.column(method).to_pylist(), plain, strict=True)]
            new = [pa.array([g[1] for g in got], pa.binary()) if n == data else c for n, c in zip(b.schema.names, b.columns, strict=True)]
            values = ([g[0] for g in got], [len(x) for x in plain], [len(g[1]) for g in got], [g[2] for g in got])
            yield pa.RecordBatch.from_arrays([*new, *(pa.array(v, t) for v, t in zip(values, extra.values(), strict=True))], names=[*b.schema.names, *extra])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return bounded(df).mapInArrow(run, f"{kinds}, flags int, original_length bigint, stored_length bigint, substituted boolean")


def decoded(df: DataFrame, data: str = "data", flags: str = "flags", compressed: str = "compressed_length", length: str = "decompressed_length") -> DataFrame:
    """df with `data` decoded, null where that failed, and raw_fallback, error_kind and error_msg added."""

    def size(batch: pa.RecordBatch) -> list[int]:
        claims = batch.column(length).to_pylist()
        return [max(n or 0, m or 0) for n, m in zip(claims, pc.binary_length(batch.column(data)).to_pylist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, size):
            rows = zip(*(b.column(c).to_pylist() for c in (flags, compressed, length, data)), strict=True)
            got = [decode(f, c, n, d or b"") for f, c, n, d in rows]
            new = [pa.array([g.data for g in got], pa.binary()) if n == data else c for n, c in zip(b.schema.names, b.columns, strict=True)]
            more = [pa.array([g.raw_fallback for g in got]), pa.array([g.error_kind for g in got], pa.string()), pa.array([g.error_msg for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*new, *more], names=[*b.schema.names, "raw_fallback", "error_kind", "error_msg"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return bounded(df).mapInArrow(run, f"{kinds}, raw_fallback boolean, error_kind string, error_msg string")
