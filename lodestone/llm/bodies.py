"""Texts that cross the network: compressed, and met by what was found about them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .arrays import in_bytes


def packed(identified: DataFrame) -> DataFrame:
    """(doc, th, body): the texts in compressed form; null counts as empty."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            raw, off = in_bytes(batch.column("text"))
            raw = raw.tobytes()
            bodies = pa.array([squeeze(raw[a:b]) for a, b in zip(off, off[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("th"), bodies], names=["doc", "th", "body"])

    return identified.select("doc", "th", "text").mapInArrow(pack, "doc long, th long, body binary")


def unpacked(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about so many bytes of text each, and their texts."""
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts, held, since = [], 0, 0
        for k, body in enumerate(batch.column("body")):
            texts.append(expand(body.as_py()))
            held += len(texts[-1])
            if held > most:
                yield batch.slice(since, k + 1 - since), texts
                texts, held, since = [], 0, k + 1
        if texts:
            yield batch.slice(since), texts
