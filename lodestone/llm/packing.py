"""Best-fit packing of token sequences in bulk-synchronous supersteps.

A superstep range-sorts the documents that are left and the gaps by size, largest first, a gap before
the documents of its size.  A sweep gives each document its successor, the smallest gap that holds it;
of documents that want one gap the first by rank gets it and the next ones go on to the gap above, which is how
brackets match: each task sweeps its range, and what it leaves meets the other tasks' by
ranks, for which only two counts a task reach the driver.  Then the gaps are updated, sequences are opened
for what won't have room, and the next superstep begins.  It starts with a sequence for each document of more than
half the capacity; those of more than a quarter come next, all others then; and the last LAST documents are placed
one by one in a single task.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LOWER, distinct, in_bytes, parts, ranges, same_bytes, word_hashes
from .session import bounded, discard, doc_ids, identified, kept, read

#: Tokens in a sequence; the token after each document.
CAPACITY, END_TOKEN = 2048, 0
#: Documents and gaps that a task sweeps, about; documents that are placed one by one in the end.
SWEPT, LAST = 200_000, 2000
#: Distinct fragments whose tokens a task remembers, about.
REMEMBERED = 400_000


def bracket_matches(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (document, gap) of all pairs, when each document in turn takes the nearest gap before it that is left."""
    depth = np.cumsum(np.where(is_gap, 1, -1))
    level = depth + ~is_gap
    order = np.argsort(level, kind="stable")
    a, b = order[:-1], order[1:]
    pair = (level[a] == level[b]) & is_gap[a] & ~is_gap[b]
    return b[pair], a[pair]


def best_fit(lengths: list[int], gaps: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """Best-fit decreasing, one by one: (item, gap or one of the new ones numbered on, what is left of it then).  The
    item lies where capacity less that and its length is."""
    left = sorted((g, k) for k, g in enumerate(gaps))
    opened, out = len(gaps), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect.bisect_left(left, (lengths[i], -1))
        if at < len(left):
            g, k = left.pop(at)
        else:
            g, k, opened = capacity, opened, opened + 1
        bisect.insort(left, (g - lengths[i], k))
        out.append((i, k, g - lengths[i]))
    return out


def fragment_classes() -> np.ndarray:
    """By byte: 0 white space, 1 ASCII letters and digits, 2 ASCII punctuation, 3 what no cut is made beside."""
    t = np.full(256, 3, dtype=np.uint8)
    t[[0x20, *range(0x09, 0x0E)]] = 0
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = 1
    t[[k for k in range(0x21, 0x7F) if t[k] == 3 and chr(k) not in "'<|>"]] = 2
    return t


def fragments(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces of text that the tokenizer never joins, and row offsets: words without white space, cut
    also between letters or digits and punctuation.  No cut is made beside apostrophes (contractions), the
    marks of special tokens and anything beyond ASCII."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    kind = fragment_classes()[raw]
    inside = kind > 0
    new = np.ones(len(raw), dtype=bool)
    new[1:] = (kind[:-1] == 0) | ((kind[1:] ^ kind[:-1]) == 3) & (kind[1:] < 3) & (kind[:-1] < 3)
    new[off[:-1][off[:-1] < len(raw)]] = True
    last = np.ones(len(raw), dtype=bool)
    last[:-1] = new[1:] | ~inside[1:]
    start, end = np.flatnonzero(inside & new), np.flatnonzero(inside & last) + 1
    return start, end, np.searchsorted(start, off)


class KnownTokens:
    """The tokens of the fragments met so far, by hash, in flat arrays."""

    def __init__(self, vocabulary_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path)
        # A symbol that is a token of its own parts fragments that are encoded together.
        self.mark = next(c for c in ("\u2605", "\u2192", "\u2122", "\u2713", "\u2022", "\u00a9", "") if not c or len(self._ids(c)) == 1)
        self.mark_id = self._ids(self.mark)[0] if self.mark else None
        self.clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.hashes, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.at, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.raw = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def encode(self, texts: list[str], together: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """All tokens, and how many each text has."""
        plain = [k for k, t in enumerate(texts) if self.mark and self.mark not in t and "<|" not in t]
        size = np.zeros(len(texts), dtype=np.int64)
        groups = [plain[k : k + together] for k in range(0, len(plain), together)]
        joined = self.tokenizer.encode_batch_fast([f" {self.mark} ".join([texts[k] for k in g]) for g in groups], add_special_tokens=False)
        one = np.concatenate([np.array([*e.ids, self.mark_id], dtype=np.uint32) for e in joined]) if groups else np.zeros(0, np.uint32)
        cut = np.flatnonzero(one == self.mark_id) if groups else np.zeros(0, np.int64)
        size[plain] = np.diff(np.concatenate([[-1], cut])) - 1
        rest = sorted({*range(len(texts))} - {*plain}) if len(plain) < len(texts) else []
        alone = self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)
        size[rest] = [len(e.ids) for e in alone]
        out = np.empty(int(size.sum()), dtype=np.uint32)
        begin = np.cumsum(size) - size
        out[ranges(begin[plain], size[plain])] = one[one != self.mark_id] if groups else one
        for k, e in zip(rest, alone, strict=True):
            out[begin[k] : begin[k] + size[k]] = e.ids
        return out, size

    def of(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all fragments in order, and how many each has.  A fragment is known if its bytes are, not only its hash."""
        one, which = distinct(raw, start, end, hashes)
        own, first, length = hashes[one], start[one], (end - start)[one]
        if len(self.hashes) > REMEMBERED or len(self.raw) > 64 * REMEMBERED:
            self.clear()
        met = self._find(own)
        k = np.flatnonzero(met >= 0)
        same = self.length[met[k]] == length[k]
        same &= same_bytes(raw, first[k], self.raw, self.at[met[k]], np.where(same, length[k], 0))
        texts = lambda at: [raw[a : a + n].tobytes().decode() for a, n in zip(first[at].tolist(), length[at].tolist(), strict=True)]
        if not same.all() or len(np.unique(own)) < len(own):  # two fragments of one hash: nothing is remembered of these
            flat, size = self.encode(texts(np.arange(len(one))))
            begin = np.cumsum(size) - size
            return flat[ranges(begin[which], size[which])], size[which]
        new = np.flatnonzero(met < 0)
        if len(new):
            flat, size = self.encode(texts(new))
            order = np.argsort(all_ := np.concatenate([self.hashes, own[new]]))
            add = lambda old, x: np.concatenate([old, x])[order]
            self.begin, self.size = add(self.begin, np.cumsum(size) - size + len(self.flat)), add(self.size, size)
            self.at, self.length = add(self.at, np.cumsum(length[new]) - length[new] + len(self.raw)), add(self.length, length[new])
            self.hashes, self.flat, self.raw = all_[order], np.concatenate([self.flat, flat]), np.concatenate([self.raw, raw[ranges(first[new], length[new])]])
        k = self._find(own)[which]
        return self.flat[ranges(self.begin[k], self.size[k])], self.size[k]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Where the hashes are among the known ones, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[k] == hashes, k, -1)


def token_pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc, th, piece, start, length, ids_crc32[, ids]): each text's tokens and the end token, cut
    only where longer than a sequence.

    Each distinct fragment that a task meets is tokenized once.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = KnownTokens(vocabulary_path)
        for batch in batches:
            for part in parts(batch, "text", 4_000_000):
                raw, off = in_bytes(part.column("text"))
                if b"<|" not in raw.tobytes():  # the tokenizer would do so after it has looked for special tokens
                    raw = LOWER[raw]
                start, end, foff = fragments(raw, off)
                ids, size = known.of(raw, start, end, word_hashes(raw, start, end))
                toff = np.concatenate([[0], np.cumsum(size)])[foff]
                ids = np.insert(ids, toff[1:], END_TOKEN).astype("<u4")
                toff = toff + np.arange(len(toff))
                n = np.diff(toff)
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(part.num_rows), pieces)
                piece = ranges(np.zeros(len(n), np.int64), pieces)
                begin = piece * capacity
                length = np.minimum(n[row] - begin, capacity)
                at = toff[row] + begin
                data = ids.tobytes()
                crc = [zlib.crc32(data[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                rows = pa.array(row)
                columns = [part.column("doc").take(rows), part.column("th").take(rows), pa.array(piece, pa.int32()), pa.array(begin), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc", "th", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(scan, "doc long, th long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


STATE = "row long, length int, seq long, size int"


def swept(rows: DataFrame, tasks: int) -> DataFrame:
    """One sweep over each range of sizes: pairs (row, length, seq, size), and what is left, documents without seq and size, gaps
    without row and length; part and nth say in which range and as the how-manieth of its kind."""
    order = [F.desc("size"), F.col("row").isNotNull(), F.xxhash64(F.coalesce("row", "seq"))]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        row, length, seq, size = (table.column(c).combine_chunks() for c in ("row", "length", "seq", "size"))
        is_gap = np.asarray(row.is_null())
        doc, gap = bracket_matches(is_gap)
        free = np.ones(len(is_gap), dtype=bool)
        free[doc] = free[gap] = False
        docs, gaps = np.flatnonzero(free & ~is_gap), np.flatnonzero(free & is_gap)
        part = TaskContext.get().partitionId()
        for d, g in ((doc, gap), (docs, None), (None, gaps)):
            n = len(d if d is not None else g)
            none = lambda kind: pa.nulls(n, kind)  # noqa: B023,E731
            left = d is None or g is None
            yield pa.RecordBatch.from_arrays(
                [row.take(pa.array(d)) if d is not None else none(pa.int64()), length.take(pa.array(d)) if d is not None else none(pa.int32()), seq.take(pa.array(g)) if g is not None else none(pa.int64()), size.take(pa.array(g)) if g is not None else none(pa.int32()), pa.array(np.full(n, part), pa.int32()) if left else none(pa.int32()), pa.array(np.arange(n), pa.int32()) if left else none(pa.int32())],
                names=["row", "length", "seq", "size", "part", "nth"],
            )

    return rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(sweep, f"{STATE}, part int, nth int")


def by_rank(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(part, first, end, part of the gaps, the gap that the first takes) for ranges of documents left: these take the last gaps of
    the ranges before that are left, one after the other.  left: (part, documents, gaps)."""
    out, stack = [], []
    for part, docs, gaps in sorted(left):
        nth = 0
        while nth < docs and stack:
            other, there = stack.pop()
            n = min(docs - nth, there)
            out.append((part, nth, nth + n, other, there - 1))
            nth += n
            if there > n:
                stack.append((other, there - n))
        if gaps:
            stack.append((part, gaps))
    return out


def across(found: DataFrame) -> DataFrame:
    """What the sweeps have left, matched between ranges: found's rows with more pairs among them."""
    spark = found.sparkSession
    counts = found.where("part is not null").groupBy("part").agg(F.count("row").alias("docs"), F.count("seq").alias("gaps")).collect()
    ranges_ = sorted(by_rank([(r.part, r.docs, r.gaps) for r in counts]))
    if not ranges_:
        return found.drop("part", "nth")
    sent = spark.sparkContext.broadcast(np.array(ranges_, dtype=np.int64))

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, end, other, gap = sent.value.T
        for b in batches:
            p, k = (b.column(c).to_numpy().astype(np.int64) for c in ("part", "nth"))
            at = np.maximum(np.searchsorted(part << 32 | first, p << 32 | k, side="right") - 1, 0)
            ok = (part[at] == p) & (first[at] <= k) & (k < end[at])
            to = [pa.array(x, pa.int32(), mask=~ok) for x in (other[at], gap[at] - (k - first[at]))]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("length"), *to], names=["row", "length", "part", "nth"])

    docs = found.where("part is not null and row is not null").mapInArrow(aim, "row long, length int, part int, nth int")
    gaps = found.where("part is not null and row is null").select("part", "nth", "seq", "size")
    # Documents that get no gap have no key, which would bring them all into one task.
    met = docs.where("part is not null").join(gaps, ["part", "nth"], "right").select("row", "length", "seq", "size")
    lost = docs.where("part is null").select("row", "length", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("int").alias("size"))
    return found.where("part is null").drop("part", "nth").unionByName(met).unionByName(lost)


def one_by_one(docs: DataFrame, gaps: DataFrame, fresh: int, capacity: int) -> DataFrame:
    """The last documents, as pairs: best fit in a single task."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = sorted(pa.Table.from_batches(held).to_pylist(), key=lambda r: (r["row"] is None, r["row"], r["seq"]))
        d, g = [r for r in rows if r["row"] is not None], [r for r in rows if r["row"] is None]
        found = best_fit([r["length"] for r in d], [r["size"] for r in g], capacity)
        cols = zip(*((d[i]["row"], d[i]["length"], g[k]["seq"] if k < len(g) else -1 - fresh - (k - len(g)), left + d[i]["length"]) for i, k, left in found), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], names=["row", "length", "seq", "size"])

    return docs.unionByName(gaps.orderBy(F.desc("size"), "seq").limit(LAST)).coalesce(1).mapInArrow(fill, STATE)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset, by best fit.  pieces: a table with a number for each row (row)."""
    spark = pieces.sparkSession
    alone = F.col("length") * 2 > capacity
    state = pieces.select("row", F.col("length").cast("int").alias("length"), F.when(alone, F.col("row")).alias("seq"), F.when(alone, capacity).cast("int").alias("size"))
    placed, fresh = [], 0
    while True:
        placed.append(state.where("row is not null and seq is not null"))
        docs = state.where("row is not null and seq is null")
        large = F.col("length") > capacity // 4
        n, many = docs.agg(F.count("*"), F.count_if(large)).first()
        if not n:
            break
        gaps = state.where("seq is not null").select(F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("length"), "seq", (F.col("size") - F.coalesce("length", F.lit(0))).alias("size")).where("size > 0")
        if n <= LAST:
            placed.append(kept(one_by_one(docs, gaps, fresh, capacity)))
            break
        now = docs.where(large) if many else docs
        count, tokens, least = now.agg(F.count("*"), F.sum("length"), F.min("length")).first()
        mean = tokens / count
        fitting = F.col("size") >= least
        n_gaps, room, held = gaps.where(fitting).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.floor(F.col("size") / mean)), F.lit(0))).first()
        # At least what the tokens need beyond the room; for large documents also what their number needs, as they leave
        # much of a gap unused, which the small ones take later.  A sequence that gets nothing doesn't count.
        new = max(-(-(tokens - room) // capacity), 0 if n_gaps else 1, -(-(count - held) // int(capacity // mean)) if many else 0)
        opened = spark.range(new).select(F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("length"), (-1 - fresh - F.col("id")).alias("seq"), F.lit(capacity).alias("size"))
        fresh += new
        both = now.withColumn("size", F.col("length")).unionByName(gaps.where(fitting).unionByName(opened))
        found = kept(swept(both, -(-(count + n_gaps + new) // SWEPT)))
        rest = gaps.where(~fitting).unionByName(docs.where(~large)) if many else gaps.where(~fitting)
        state = kept(across(found).unionByName(rest.select("row", "length", "seq", "size")))
        discard(found)
    at = placed[0]
    for p in placed[1:]:
        at = at.unionByName(p)
    return pieces.join(at.select("row", F.col("seq").alias("sequence_id"), (capacity - F.col("size")).cast("long").alias("offset")), "row").drop("row")


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, with_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset, and on request its ids.

    A null or empty text is its end token alone; a long one is cut, however long.  Repeated rows are packed as often as they
    occur, equal lengths in an order of their own numbers; a null doc_id stays null.  An empty table packs into nothing.  Other
    columns are not read, whatever their names.
    """
    bounded(docs.sparkSession)
    source, _ = identified(docs, doc_id, text)
    # Written once, so that the rows' numbers stay what they are.
    numbered = kept(token_pieces(source, vocabulary_path, capacity, with_ids).withColumn("row", F.monotonically_increasing_id()))
    placed = place(numbered, capacity)
    return placed.select(doc_ids().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
