"""The header of an archive: bytes to values and back."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from typing import BinaryIO

from lodestone import schema as S


@dataclass
class Header:
    num_user_files: int
    num_directories: int
    version: int
    strings: list[str]
    files: list[tuple[int, list[int]]]
    num_archive_files: int
    #: offset, compressed_length, decompressed_length, flags, file
    chunks: list[tuple[int, int, int, int, int]]
    volumes: list[str] = field(default_factory=list)
    range: tuple[int, ...] | None = None
    header_end: int = 0

    @property
    def names(self) -> list[str]:
        return self.strings[: self.num_user_files]

    @property
    def dirs(self) -> list[str]:
        return self.strings[self.num_user_files :]


class _Reader:
    """Buffered reads that know where they are."""

    def __init__(self, file: BinaryIO, piece: int = 1 << 16):
        self.file, self.piece, self.buffer, self.at, self.base = file, piece, b"", 0, 0

    @property
    def position(self) -> int:
        return self.base + self.at

    def _more(self) -> bool:
        new = self.file.read(self.piece)
        self.base += self.at
        self.buffer, self.at = self.buffer[self.at :] + new, 0
        return bool(new)

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n:
            if not self._more():
                raise S.ArchiveError("Io", "failed to fill whole buffer")
        self.at += n
        return self.buffer[self.at - n : self.at]

    def unpack(self, form: str) -> tuple:
        return struct.unpack(form, self.take(struct.calcsize(form)))

    def string(self) -> str:
        """Up to a NUL, or silently up to the end of the file."""
        out = []
        while True:
            end = self.buffer.find(b"\0", self.at)
            if end >= 0:
                out.append(self.buffer[self.at : end])
                self.at = end + 1
                break
            out.append(self.buffer[self.at :])
            self.at = len(self.buffer)
            if not self._more():
                break
        try:
            return b"".join(out).decode("utf-8")
        except UnicodeDecodeError as e:
            raise S.ArchiveError("Utf8", str(e)) from None


def parse(file: BinaryIO) -> Header:
    """Reads a header from the start of a file, buffered; payloads aren't touched."""
    r = _Reader(file)
    magic, n_files, n_dirs, version = r.unpack("<IHHB")
    if magic != S.MAGIC:
        raise S.ArchiveError("InvalidHeader", f"magic {magic:#010x}")
    n_strings = n_files + n_dirs - 1
    if n_strings < 0:
        raise S.ArchiveError("InvalidHeader", "neither files nor a root directory")
    strings = [r.string() for _ in range(n_strings)]
    files = []
    for _ in range(n_files):
        (dir_id,) = r.unpack("<H")
        chunk_ids = []
        while (c := r.unpack("<H")[0]) != S.END_OF_CHUNKS:
            chunk_ids.append(c)
        files.append((dir_id, chunk_ids))
    n_volumes, n_chunks = r.unpack("<HH")
    chunks = [tuple(c) for c in struct.iter_unpack("<IIIHH", r.take(S.CHUNK_BYTES * n_chunks))]
    volumes = [r.string() for _ in range(max(n_volumes - 1, 0))]
    settings = tuple(r.unpack("<10B")) if any(c[3] & S.DZ for c in chunks) else None
    return Header(n_files, n_dirs, version, strings, files, n_volumes, chunks, volumes, settings, r.position)


def _text(values: list[str]) -> bytes:
    for v in values:
        if "\0" in v:
            raise S.ArchiveError("Utf8", f"a name holds a NUL: {v!r}")
    return b"".join(v.encode() + b"\0" for v in values)


def serialise(h: Header) -> bytes:
    """The header's bytes.  Values that the format can't hold raise an error rather than wrap."""
    for what, n, most in (("files", h.num_user_files, 0xFFFF), ("directories", h.num_directories, 0xFFFF), ("volumes", h.num_archive_files, 0xFFFF), ("chunks", len(h.chunks), 0xFFFF)):
        if n > most:
            raise S.ArchiveError("Io", f"{n} {what}; the format holds {most}")
    for c in h.chunks:
        if max(c[:3]) > 0xFFFFFFFF:
            raise S.ArchiveError("Io", "an offset or a length is 4 GiB or more")
    out = [struct.pack("<IHHB", S.MAGIC, h.num_user_files, h.num_directories, h.version), _text(h.strings)]
    out += [struct.pack(f"<{len(ids) + 2}H", d, *ids, S.END_OF_CHUNKS) for d, ids in h.files]
    out.append(struct.pack("<HH", h.num_archive_files, len(h.chunks)))
    out += [struct.pack("<IIIHH", *c) for c in h.chunks]
    out.append(_text(h.volumes))
    if h.range is not None and any(c[3] & S.DZ for c in h.chunks):
        out.append(struct.pack("<10B", *h.range))
    return b"".join(out)
