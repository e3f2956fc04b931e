"""Document fingerprints by one-permutation MinHash.

Each word shingle is hashed once: the high bits name a bin, the rest is its value
there, and a bin keeps its least value.  An empty bin borrows from the bins that
its own random sequence visits until one isn't empty (optimal densification);
the low-order bits of all bins are packed.  Chance agreement of those bits is
taken out of the likeness of two fingerprints.
"""

from __future__ import annotations

import hashlib
from base64 import b64encode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LOWER, Windows, in_bytes, mix, owners, parts, ranges, word_hashes, words
from .session import bounded, read

#: Bins and bits kept of each.
BINS, BITS, SHINGLE = 256, 8, 5
#: Rows and bytes of text that are sketched together, at most (one row at least).
ROWS, BYTES = 4096, 2_000_000
U64 = np.uint64


def shingle_hashes(raw: np.ndarray, off: np.ndarray, k: int = SHINGLE, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row, and row offsets; fewer words are one shingle, none is none."""
    start, end, woff = words(LOWER[raw], off, "space")
    codes = word_hashes(LOWER[raw], start, end, seed)
    n = np.diff(woff)
    many = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    first = ranges(woff[:-1], many)
    length = np.repeat(np.minimum(n, k), many)
    soff = np.concatenate([[0], np.cumsum(many)])
    return Windows(codes).slices(first, first + length), soff


def sketch(raw: np.ndarray, off: np.ndarray, bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The low bits of each row's bins as uint8 or uint16 rows, and which rows have any shingle."""
    hashes, soff = shingle_hashes(raw, off, k)
    n = len(off) - 1
    shift = U64(64 - (bins.bit_length() - 1))
    none = U64(0xFFFFFFFFFFFFFFFF)
    least = np.full(n * bins, none, dtype=U64)
    np.minimum.at(least, owners(soff) * bins + (hashes >> shift).astype(np.int64), hashes & U64((1 << int(shift)) - 1))
    there = (least != none).reshape(n, bins)
    full = there.any(axis=1)
    filled = least.copy()
    # Where one bin is full, every sequence ends there.
    single = np.flatnonzero(there.sum(axis=1) == 1)
    filled.reshape(n, bins)[single] = least.reshape(n, bins)[single, there[single].argmax(axis=1)][:, None]
    row, bin_ = np.nonzero(~there & (there.sum(axis=1) > 1)[:, None])
    turn = 0
    while len(row):
        turn += 1
        other = (mix(bin_.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(turn)) % U64(bins)).astype(np.int64)
        got = least[row * bins + other]
        ok = got != none
        filled[row[ok] * bins + bin_[ok]] = got[ok]
        row, bin_ = row[~ok], bin_[~ok]
    return (filled & U64((1 << bits) - 1)).astype(np.uint16 if bits > 8 else np.uint8).reshape(n, bins), full


def likeness(a: np.ndarray, b: np.ndarray, a_full: np.ndarray, b_full: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity, row by row, free of the bias of chance agreement; two texts
    without words are alike (1), one without words is like no other (0)."""
    chance = 2.0**-bits
    same = (a == b).mean(axis=1)
    return np.where(a_full & b_full, np.clip((same - chance) / (1 - chance), 0, 1), (a_full == b_full).astype(float))


def packed(rows: np.ndarray, full: np.ndarray) -> list[str]:
    """Fingerprints as base64 text; without words the empty string."""
    return [b64encode(r.tobytes()).decode() if f else "" for r, f in zip(rows, full, strict=True)]


def fingerprints(docs: DataFrame, text: str = "text", bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> DataFrame:
    """docs' rows with a column `fingerprint`, which replaces one of that name; null counts as empty and has the empty
    fingerprint, as has any text without words.  Equal texts have equal fingerprints."""
    bounded(docs.sparkSession)
    docs = docs.drop("fingerprint")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, text, BYTES, ROWS):
                raw, off = in_bytes(part.column(text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(packed(*sketch(raw, off, bins, bits, k)), pa.string())], names=[*part.schema.names, "fingerprint"])

    return docs.mapInArrow(scan, docs.select("*", F.lit("").alias("fingerprint")).schema)


LEAST = -(1 << 63)


def with_next(docs: DataFrame, bounds: list[int], heads: dict[int, int], n_buckets: int) -> DataFrame:
    """Rows (bucket, tail, doc_id, body): ranges of doc_id, each with a copy of the next range's first
    document (tail).  Bodies are compressed, as each text crosses the network once."""
    filled = sorted(heads)
    copies: dict[int, list[int]] = {}
    for a, b in zip(filled, filled[1:] + filled[:1], strict=True):
        copies.setdefault(heads[b], []).append(a)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            ids = batch.column("doc_id").fill_null(LEAST).to_numpy(zero_copy_only=False)
            buckets = np.searchsorted(np.array(bounds, dtype=np.int64), ids, side="right")
            raw, off = in_bytes(batch.column("text"))
            raw = raw.tobytes()
            for k, (i, b) in enumerate(zip(ids.tolist(), buckets.tolist(), strict=True)):
                body = pack(raw[off[k] : off[k + 1]])
                for to, tail in [(b, False), *((c, True) for c in copies.get(i, ()))]:
                    for column, value in zip(out, (to, tail, i, body), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["bucket", "tail", "doc_id", "body"])

    rows = docs.mapInArrow(deal, "bucket int, tail boolean, doc_id long, body binary")
    return rows.repartition(max(1, n_buckets // 4), "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "body")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each text's fingerprint against that of its edited text and of the next document.

    The order is by doc_id, a null one first, equal ones by their texts' compressed bytes; after the last document
    comes the first; a single document is its own next one.  Null counts as empty.  Other columns are not read;
    rows of one id lie in one range, which a task goes through without holding it.
    """
    spark = bounded(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_buckets = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted({int(x) for x in docs.approxQuantile("doc_id", [k / n_buckets for k in range(1, n_buckets)], 0.1 / n_buckets)})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(LEAST).to_numpy(zero_copy_only=False)
            b, at = np.unique(np.searchsorted(np.array(bounds, dtype=np.int64), ids, side="right"), return_inverse=True)
            least = np.full(len(b), np.iinfo(np.int64).max)
            np.minimum.at(least, at, ids)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(least)], names=["bucket", "head"])

    found = docs.select("doc_id").mapInArrow(first, "bucket int, head long").groupBy("bucket").agg(F.min("head").alias("head"))
    heads = {r.bucket: r["head"] for r in found.collect()}
    dealt = with_next(docs, bounds, heads, n_buckets)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            """All but the last are followed by their next one, if that is in the same range."""
            bodies = [r[3] for r in rows]
            mine = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
            chars = {k: bodies[k].decode() for k in {*mine, *(k + 1 for k in mine)}}
            edited = []
            for k in mine:
                cut = len(chars[k]) // 4
                edited.append((chars[k][: len(chars[k]) - cut] + chars[k + 1][:cut]).encode())
            fp = []
            for group in (bodies, edited):
                off = np.concatenate([[0], np.cumsum([len(x) for x in group])]).astype(np.int64)
                fp.append(sketch(np.frombuffer(b"".join(group), dtype=np.uint8), off))
            at = np.array(mine, dtype=np.int64)
            (own, own_full), (other, other_full) = fp
            near_edited = likeness(own[at], other, own_full[at], other_full)
            near_next = likeness(own[at], own[at + 1], own_full[at], own_full[at + 1])
            text_of = packed(own[at], own_full[at])
            ids = [None if rows[k][2] == LEAST else rows[k][2] for k in mine]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(chars[k]) for k in mine], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()), pa.array(text_of, pa.string()), pa.array(packed(other, other_full), pa.string()), pa.array(near_edited), pa.array(near_next)],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = unpack(r[3]) if len(r[3]) else b""
                rows.append((r[0], r[1], r[2], body))
                held += len(body)
                if (held > BYTES or len(rows) > ROWS) and len(rows) > 1:
                    yield flush(rows)
                    rows, held = rows[-1:], len(body)
        if len(rows) > 1:
            yield flush(rows)

    return dealt.mapInArrow(scan, EDITED)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(read(spark, sf_dir, "documents"))
