"""Repeated byte strings by prefix-free parsing.

A rolling hash over GRAM bytes places triggers in each text; a phrase runs from
one trigger to the end of the next, so that neighbouring phrases overlap in a
trigger and no suffix of a phrase that holds its closing trigger is a prefix of another.  A
string's place in corpus order is thus told by two things: which suffix of
which phrase it begins with (the dictionary's share), and how the parse goes on
after the trigger that closes the phrase (the parse's share).

Only one question is asked of that order here: do two neighbours agree on `length`
bytes?  So the order is kept as classes of equal prefixes.  All strings that begin
with one of up to BLOCK neighbouring suffixes of a phrase share a core: the bytes
from the shortest of those suffixes on.  Cores that occur once are done with.  Among the
others, an occurrence whose whole extent (all suffixes and their
continuations) equals another's is repeated throughout; single strings are
compared only where extents differ, and just one copy of each extent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Windows, in_bytes, parts, ranges, signed
from .bodies import packed, unpacked
from .session import bounded, discard, doc_ids, identified, kept, read

U64 = np.uint64
#: Bytes of a string, bytes of a trigger, mean bytes from trigger to trigger, suffixes that share a core.
LENGTH, GRAM, SPACING, BLOCK = 400, 8, 48, 64
#: Bytes of a repeated string that is reported though it stays: passages of 50 short words.
REPORTED = 200
#: Bytes of text that are parsed together, about (one text at least).
PIECE = 1_000_000
#: How much more frequent triggers are where there were none.
DENSER = 3


def triggers(raw: np.ndarray, off: np.ndarray, spacing: int = SPACING) -> tuple[np.ndarray, np.ndarray]:
    """The places where a trigger starts, and their rows.  A trigger lies within one row."""
    if len(raw) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = np.ndarray((len(raw) - GRAM + 1,), "<u8", np.ascontiguousarray(raw), 0, (1,))
    rolled = (gram ^ (gram >> U64(29))) * U64(0x9E3779B97F4A7C15)
    at = np.flatnonzero((rolled >> U64(40)) < U64((1 << 24) // spacing))
    row = np.searchsorted(off, at, side="right") - 1
    inside = at + GRAM <= off[row + 1]
    return at[inside], row[inside]


def cores(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, spacing: int = SPACING, block: int = BLOCK, level: int = 0) -> dict[str, np.ndarray]:
    """For each block of a phrase's suffixes: the row; the first and the last string that starts in it (s to t, from the
    row's start); the core's hash (key) and the extent's (h).

    Strings without a whole trigger, as in texts that repeat few words, are parsed once
    more with triggers DENSER times as frequent; without those, too, each is a block of its own.
    """
    at, row = triggers(raw, off, spacing)
    windows = Windows.of_bytes(raw)
    first = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
    # Strings whose first trigger is this one start after the one before, or with the row.
    since = np.where(first, off[row], np.concatenate([[0], at[:-1] + 1])[: len(at)])
    most = np.minimum(at - since, length - GRAM)
    least = np.maximum(0, at + length - off[row + 1])
    n = np.where(most >= least, most // block - least // block + 1, 0)
    which = np.repeat(np.arange(len(at)), n)
    b = ranges(least // block, n)
    far = np.minimum(b * block + block - 1, most[which])
    near = np.maximum(b * block, least[which])
    x = at[which]
    key = windows.slices(x - b * block, x - b * block + length - block + 1) + b.astype(U64) + U64(level << 32)
    s, t, rows = x - far, x - near, row[which]
    h = windows.slices(s, t + length) + far.astype(U64) * U64(1000003) + near.astype(U64)
    # Strings without a trigger: far before the next one, or after the last.
    n_rows = len(off) - 1
    last = np.full(n_rows, -1, np.int64)
    last[row] = at
    bare_from = np.concatenate([since, np.where(last >= 0, last + 1, off[:-1])])
    bare_to = np.concatenate([np.minimum(at - (length - GRAM), off[row + 1] - length + 1), off[1:] - length + 1])
    bare_row = np.concatenate([row, np.arange(n_rows)])
    some = bare_to > bare_from
    bare_from, bare_row, m = bare_from[some], bare_row[some], (bare_to - bare_from)[some]
    if spacing > 1 and len(m):
        inner = cores(raw[ranges(bare_from, m + length - 1)], np.concatenate([[0], np.cumsum(m + length - 1)]), length, max(1, spacing // DENSER), block, level + 1)
        more = {"row": bare_row[inner["row"]], "s": bare_from[inner["row"]] + inner["s"], "t": bare_from[inner["row"]] + inner["t"], "key": inner["key"], "h": inner["h"]}
    else:
        alone = ranges(bare_from, m)
        own = windows.slices(alone, alone + length)
        more = {"row": np.repeat(bare_row, m), "s": alone, "t": alone, "key": own ^ U64(0x5BD1E995), "h": own}
    rows = np.concatenate([rows, more["row"]])
    cat = lambda a, c: np.concatenate([a, more[c]])
    return {"row": rows, "s": cat(s, "s") - off[rows], "t": cat(t, "t") - off[rows], "key": cat(key, "key"), "h": cat(h, "h")}


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch, bytes, offsets, rows, starts) of pieces of the batches: whole texts (doc, th, text), or the
    `runs` of compressed ones (doc, th, body, runs); rows and starts say where in the batch each stretch lies."""
    for batch in batches:
        if "text" in batch.schema.names:
            for part in parts(batch, "text", PIECE):
                raw, off = in_bytes(part.column("text"))
                yield part, raw, off, np.arange(part.num_rows), np.zeros(part.num_rows, np.int64)
            continue
        for part, texts in unpacked([batch], PIECE):
            listed = part.column("runs")
            flat = listed.flatten()
            row = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(listed).to_numpy())
            start, end = (flat.field(k).to_numpy().astype(np.int64) for k in range(2))
            base = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            raw = np.frombuffer(b"".join(texts), dtype=np.uint8)[ranges(base[row] + start, end - start)]
            yield part, raw, np.concatenate([[0], np.cumsum(end - start)]), row, start


def read_cores(docs: DataFrame, length: int, spacing: int, block: int, keys_only: bool) -> DataFrame:
    """(key, h, doc, th, s, t) of all blocks, or (key, n) of their cores."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, off, row, start in stretches(batches):
            c = cores(raw, off, length, spacing, block)
            if keys_only:
                key, n = np.unique(c["key"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(n, pa.int32())], names=["key", "n"])
                continue
            rows = pa.array(row[c["row"]])
            s, t = (c[k] + start[c["row"]] for k in ("s", "t"))
            yield pa.RecordBatch.from_arrays([pa.array(signed(c["key"])), pa.array(signed(c["h"])), part.column("doc").take(rows), part.column("th").take(rows), pa.array(s, pa.int32()), pa.array(t, pa.int32())], names=["key", "h", "doc", "th", "s", "t"])

    return docs.mapInArrow(scan, "key long, n int" if keys_only else "key long, h long, doc long, th long, s int, t int")


def single_strings(extents: DataFrame, bodies: DataFrame, length: int) -> DataFrame:
    """(key, e, doc, th, s): the single strings of the given extents, read from the texts."""
    by_doc = extents.groupBy("doc", "th").agg(F.collect_list(F.struct("key", "s", "t", "alone")).alias("extents"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in unpacked(batches):
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
            strings = Windows.of_bytes(raw)
            listed = batch.column("extents")
            flat = listed.flatten()
            key, s, t, alone = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(listed).to_numpy())
            n = t.astype(np.int64) - s + 1
            which = np.repeat(np.arange(len(s)), n)
            at = ranges(s, n)
            start = at + off[row[which]]
            rows = pa.array(row[which])
            yield pa.RecordBatch.from_arrays([pa.array(key[which]), pa.array(signed(strings.slices(start, start + length))), batch.column("doc").take(rows), batch.column("th").take(rows), pa.array(at, pa.int32()), pa.array(alone[which], pa.bool_())], names=["key", "e", "doc", "th", "s", "alone"])

    return by_doc.join(bodies, ["doc", "th"]).mapInArrow(scan, "key long, e long, doc long, th long, s int, alone boolean")


def repeated_spans(docs: DataFrame, bodies: DataFrame, length: int = LENGTH, spacing: int = SPACING, block: int = BLOCK) -> DataFrame:
    """(doc, th, start, end) in bytes: strings of `length` bytes that also start elsewhere.

    docs is what identified() gives, each document once, or (doc, th, body, runs), where only the runs
    can hold such strings; bodies are the texts that packed() gives.  Spans may overlap.
    """
    block = max(1, min(block, length - GRAM))
    place = F.struct("doc", "th", "s", "t")
    # Written before the join, so that Spark can split a frequent core's partition.
    keys = kept(read_cores(docs, length, spacing, block, True).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))
    found = kept(read_cores(docs, length, spacing, block, False).join(keys, "key", "left_semi"))
    discard(keys)
    extents = kept(found.groupBy("key", "h").agg(F.min(place).alias("one"), F.count("*").alias("n")))
    again = kept(extents.where("n > 1").select("key", "h"))
    whole = kept(
        found.join(again, ["key", "h"], "left_semi")
        .select("doc", "th", F.col("s").alias("start"), (F.col("t") + length).alias("end"))
    )
    discard(found, again)
    differing = kept(extents.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    compared = extents.join(differing, "key", "left_semi").select("key", "one.*", (F.col("n") == 1).alias("alone"))
    strings = kept(single_strings(compared, bodies, length))
    discard(extents, differing)
    shared = kept(strings.groupBy("key", "e").agg(F.count("*").alias("n")).where("n > 1").select("key", "e"))
    partly = kept(strings.where("alone").join(shared, ["key", "e"], "left_semi").select("doc", "th", F.col("s").alias("start"), (F.col("s") + length).alias("end")))
    discard(strings, shared)
    return whole.unionByName(partly)


def runs_of(spans: DataFrame) -> DataFrame:
    """(doc, th, runs): the spans of each document, those that overlap or touch as one run, ascending."""
    by_doc = spans.groupBy("doc", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column("spans"):
                start, end = (spans.values.field(k).to_numpy() for k in range(2))
                order = np.argsort(start, kind="stable")
                start, far = start[order], np.maximum.accumulate(end[order])
                new = np.flatnonzero(np.concatenate([[True], start[1:] > far[:-1]]))
                out.append([{"start": a, "end": b} for a, b in zip(start[new].tolist(), far[np.append(new[1:], len(far)) - 1].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("th"), pa.array(out, kind)], names=["doc", "th", "runs"])

    return by_doc.mapInArrow(merge, "doc long, th long, runs array<struct<start:int,end:int>>")


def without_runs(docs: DataFrame, removed: DataFrame, reported: DataFrame) -> DataFrame:
    """(doc, th, n_bytes, n_removed, n_spans, n_repeated, body): each text's bytes outside the runs `removed`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in unpacked(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for text, gone, seen in zip(texts, batch.column("removed"), batch.column("reported"), strict=True):
                kept_, at = [], 0
                runs = [(r["start"], r["end"]) for r in gone.as_py() or ()]
                for a, b in runs:
                    kept_.append(text[at:a])
                    at = b
                kept_.append(text[at:])
                repeated = sum(r["end"] - r["start"] for r in seen.as_py() or ())
                for column, value in zip(out, (len(text), sum(b - a for a, b in runs), len(runs), repeated, b"".join(kept_)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("th"), *(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], names=["doc", "th", "n_bytes", "n_removed", "n_spans", "n_repeated", "body"])

    met = packed(docs).join(removed.withColumnRenamed("runs", "removed"), ["doc", "th"], "left").join(reported.withColumnRenamed("runs", "reported"), ["doc", "th"], "left")
    return met.mapInArrow(cut, "doc long, th long, n_bytes long, n_removed long, n_spans long, n_repeated long, body binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, spacing: int = SPACING, block: int = BLOCK, reported: int = REPORTED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, n_repeated, body): each text without the bytes of any string of `length`
    bytes that also starts anywhere else, in its own or in another document; n_repeated: bytes in
    strings of `reported` (at most `length`) bytes that do, whether they stay or not.

    Such shorter strings are looked for in all texts, the longer ones in their runs only.

    Null and empty texts have no bytes, texts shorter than `length` lose none.  A body is
    binary, as a cut can fall inside a character.  Rows that agree in id and text are
    one document, which is reported as often as it occurs; rows that only share an id are documents
    of their own.  Texts of any length are taken whole; other columns are not read, whatever their names.
    """
    bounded(docs.sparkSession)
    source, unique = identified(docs, doc_id, text)
    once = source if unique else source.dropDuplicates(["doc", "th"])
    reported = min(reported, length)
    seen = kept(runs_of(repeated_spans(once, packed(once), reported, spacing, block)))
    gone = seen
    if reported < length:
        long = F.filter("runs", lambda r: r["end"] - r["start"] >= length)
        repetitive = kept(packed(once).join(seen.select("doc", "th", long.alias("runs")).where(F.size("runs") > 0), ["doc", "th"]))
        gone = kept(runs_of(repeated_spans(repetitive, repetitive.drop("runs"), length, spacing, block)))
        discard(repetitive)
    return without_runs(source, gone, seen).select(doc_ids().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "n_repeated", "body")


def op10_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("body", 256).alias("kept_sha256"), "n_repeated")
