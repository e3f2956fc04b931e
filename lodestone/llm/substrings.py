"""Repeated word windows by De Bruijn compaction.

Every window of k consecutive words is an edge from its first k - 1 words to its last
k - 1, its nodes.  A node where occurrences differ in the word before or the word after
branches, as does one that occurs once; between such nodes a path doesn't branch, and all its
edges occur equally often, one after the other.  Nodes are counted and their branches told by
minima and maxima, a join marks the branching places of each document, and what lies between two of
them is one occurrence of one compacted path.  The source coordinates of a path's occurrences
must agree on its length, and decide which of them is the first.

Two things are settled beforehand by each window's minimizer, the least of its word m-mers.  Consecutive
windows with one minimizer are a stretch; an edge whose minimizer occurs nowhere else can't repeat and
is left out; and where all stretches of a minimizer have the same words, no edge in them has
more than one successor, so of such a stretch only the two ends go into the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import Windows, covered, in_bytes, owners, parts, ranges, signed, word_hashes, words
from .bodies import packed, unpacked
from .session import bounded, discard, doc_ids, identified, kept, read

U64 = np.uint64
#: Words in a window, and in the m-mers that tell which windows may repeat.
WINDOW, MER = 20, 8
#: Low bits that hold a position while minima are taken; the other bits hold the hash.
PLACE = 32


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def stretches(codes: np.ndarray, woff: np.ndarray, window: int, mer: int) -> dict[str, np.ndarray]:
    """Consecutive windows with one minimizer: row, first word (from the row's start), number of
    windows, the hash of the minimizer, and that of all words with the minimizer's place among them."""
    n = len(codes)
    if n < window:
        return {k: np.zeros(0, np.int64) for k in ("row", "s", "len")} | {k: np.zeros(0, U64) for k in ("key", "h")}
    hashes = Windows(codes)
    mers = hashes.of(mer)
    ordered = (mers & ~U64((1 << PLACE) - 1)) | np.arange(len(mers), dtype=U64)
    least = (sliding_min(ordered, window - mer + 1) & U64((1 << PLACE) - 1)).astype(np.int64)
    row = owners(woff)
    edge = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    at = least[edge]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    first, length, at = edge[new], np.diff(np.append(new, len(at))), at[new]
    h = hashes.slices(first, first + length + window - 1) + (at - first).astype(U64)
    return {"row": row[first], "s": first - woff[row[first]], "len": length, "key": mers[at], "h": h}


def read_stretches(docs: DataFrame, window: int, mer: int, keys_only: bool) -> DataFrame:
    """(key, h, doc, th, s, len) of all stretches, or (key, n) of their minimizers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", 4_000_000):
                raw, off = in_bytes(part.column("text"))
                start, end, woff = words(raw, off, "space")
                p = stretches(word_hashes(raw, start, end), woff, window, mer)
                if keys_only:
                    key, n = np.unique(p["key"], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(n, pa.int32())], names=["key", "n"])
                    continue
                rows = pa.array(p["row"])
                columns = [pa.array(signed(p["key"])), pa.array(signed(p["h"])), part.column("doc").take(rows), part.column("th").take(rows), pa.array(p["s"], pa.int32()), pa.array(p["len"], pa.int16())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "h", "doc", "th", "s", "len"])

    return docs.mapInArrow(scan, "key long, n int" if keys_only else "key long, h long, doc long, th long, s int, len short")


#: The words before a text and after it.
BEFORE, AFTER = U64(0xBE), U64(0xAF)


def read_nodes(candidates: DataFrame, bodies: DataFrame, window: int) -> DataFrame:
    """(a, b, before, after, doc, th, s, edge, cut): the nodes at either end of each candidate edge, or of a
    whole stretch that is simple.

    a and b: two hashes of the node's words; before and after: the neighbouring words; s: its first word; edge: an edge
    of the graph starts here; cut: this is an end of consecutive edges.
    """
    by_doc = candidates.groupBy("doc", "th").agg(F.collect_list(F.struct("s", "len", "simple")).alias("stretches"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in unpacked(batches):
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
            start, end, woff = words(raw, off, "space")
            codes = word_hashes(raw, start, end)
            listed = batch.column("stretches")
            flat = listed.flatten()
            row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(listed).to_numpy())
            s = flat.field(0).to_numpy() + woff[row]
            length = flat.field(1).to_numpy()
            simple = flat.field(2).to_numpy(zero_copy_only=False)
            edge = covered(len(codes) + 1, s, s + length)
            ended = np.concatenate([[False], edge[:-1]])
            node = edge | ended
            node[ranges(s[simple] + 1, length[simple] - 1)] = False
            at = np.flatnonzero(node)
            row = np.searchsorted(woff, at, side="right") - 1
            a, b = (Windows(c).of(window - 1)[at] for c in (codes, word_hashes(raw, start, end, 2)))
            before = np.where(at > woff[row], codes[at - 1], BEFORE)
            last = at + window - 1
            after = np.where(last < woff[row + 1], codes[np.minimum(last, len(codes) - 1)], AFTER)
            rows = pa.array(row)
            columns = [*(pa.array(signed(x)) for x in (a, b, before, after)), batch.column("doc").take(rows), batch.column("th").take(rows), pa.array(at - woff[row], pa.int32()), pa.array(edge[at]), pa.array(edge[at] != ended[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "before", "after", "doc", "th", "s", "edge", "cut"])

    return by_doc.join(bodies, ["doc", "th"]).mapInArrow(scan, "a long, b long, before long, after long, doc long, th long, s int, edge boolean, cut boolean")


def compacted(nodes: DataFrame) -> DataFrame:
    """(a, b, after, doc, th, s, len): each occurrence of a path that doesn't branch, named by its first
    edge; len: its edges."""
    # Written before the join, so that Spark can split a frequent node's partition.
    degrees = nodes.groupBy("a", "b").agg(F.count("*").alias("n"), *(f(c).alias(f"{name}_{c}") for c in ("before", "after") for name, f in (("least", F.min), ("most", F.max))))
    joints = kept(degrees.where("n = 1 or least_before != most_before or least_after != most_after").select("a", "b"))
    ends = nodes.where("cut").unionByName(nodes.where("not cut").join(joints, ["a", "b"], "left_semi"))
    following = F.lead("s").over(Window.partitionBy("doc", "th").orderBy("s"))
    paths = kept(ends.withColumn("len", following - F.col("s")).where("edge").select("a", "b", "after", "doc", "th", "s", "len"))
    discard(joints)
    return paths


def repeated_spans(docs: DataFrame, window: int = WINDOW, mer: int = MER) -> DataFrame:
    """(doc, th, start, end) in words: stretches of windows that also start earlier in the corpus.

    docs is what identified() gives, each document once.
    """
    mer = min(mer, window)
    coordinate = F.struct("doc", "th", "s")
    keys = kept(read_stretches(docs, window, mer, True).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))
    candidates = kept(read_stretches(docs, window, mer, False).join(keys, "key", "left_semi"))
    branching = kept(candidates.groupBy("key").agg(F.min(F.struct("h", "len")).alias("least"), F.max(F.struct("h", "len")).alias("most")).where("least != most").select("key", F.lit(False).alias("simple")))
    discard(keys)
    marked = candidates.join(branching, "key", "left").select("doc", "th", "s", "len", F.coalesce("simple", F.lit(True)).alias("simple"))
    nodes = kept(read_nodes(marked, packed(docs), window))
    discard(candidates, branching)
    paths = compacted(nodes)
    discard(nodes)
    repeated = paths.groupBy("a", "b", "after").agg(F.min(coordinate).alias("first"), F.count("*").alias("n"), F.min("len").alias("least"), F.max("len").alias("most")).where("n > 1")
    checked = F.when(F.col("least") == F.col("most"), F.col("first")).otherwise(F.raise_error(F.lit("occurrences of one path differ in length")))
    firsts = kept(repeated.select("a", "b", "after", checked.alias("first")))
    later = paths.join(firsts, ["a", "b", "after"]).where(coordinate > F.col("first"))
    spans = kept(later.select("doc", "th", F.col("s").alias("start"), (F.col("s") + F.col("len") + (window - 1)).alias("end")))
    discard(paths, firsts)
    return spans


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, th, n_words, n_removed, kept, body): each text with the kept words joined by one space (body, binary)."""
    by_doc = spans.groupBy("doc", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in unpacked(batches):
            n_words, n_removed, out = [], [], []
            for text, spans in zip(texts, batch.column("spans"), strict=True):
                raw = np.frombuffer(text, dtype=np.uint8)
                start, end, _ = words(raw, np.array([0, len(raw)]), "space")
                gone = np.zeros(len(start), dtype=bool)
                if spans.is_valid:
                    flat = spans.values
                    gone = covered(len(start), flat.field(0).to_numpy(), flat.field(1).to_numpy())
                n_words.append(len(start))
                n_removed.append(int(gone.sum()))
                out.append(b" ".join([text[a:b] for a, b in zip(start[~gone].tolist(), end[~gone].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("th"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.binary())], names=["doc", "th", "n_words", "n_removed", "body"])

    return packed(docs).join(by_doc, ["doc", "th"], "left").mapInArrow(cut, "doc long, th long, n_words long, n_removed long, body binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, mer: int = MER, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, text): each text without the words of any window of `window` words
    that also starts earlier (smaller doc_id, or same document, earlier start).

    Null and empty texts have no words; texts of fewer words than a window lose nothing; among
    rows with one id the order is by a hash of their text, a null id sorts first, and
    rows that agree in both are one document that is reported as often as it occurs.
    """
    bounded(docs.sparkSession)
    source, unique = identified(docs, doc_id, text)
    once = source if unique else source.dropDuplicates(["doc", "th"])
    out = without_spans(source, repeated_spans(once, window, mer))
    return out.select(doc_ids().alias("doc_id"), "n_words", "n_removed", F.col("body").cast("string").alias("text"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
