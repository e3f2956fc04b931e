"""Benchmark decontamination with sparse suffix arrays over shards of the corpus.

Each run of rows that a task holds is a shard.  Its sparse suffix array holds
the word suffixes that begin like some benchmark suffix, in the order of their
words' codes; every benchmark suffix is binary-searched in it, which yields the
range of its verbatim occurrences, its longest match and where that lies.

The benchmark is sent to the tasks in blocks of at most `block_bytes` of text, up to
TOGETHER of them at a time; a row passes through the searches of all blocks in one scan,
with what was found so far, so that rows need no numbers and the corpus is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LOWER, covered, in_bytes, mix, parts, ranges, same_bytes, word_hashes, words
from .session import bounded, kept, read

#: Bytes of benchmark text in a block, and blocks that are sent at a time; they bound what the driver and each task hold.
BLOCK_BYTES, TOGETHER = 8 << 20, 4
#: Pairs of places that are held against each other at a time.
PAIRS = 500_000

FOUND = "n_words long, hits array<int>, items array<long>, match_item long, match_item_word int, match_word long, match_len int"


def padded(codes: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word codes with `width` zeros after each row, and the new row starts; a zero never equals a word."""
    n = np.diff(off)
    start = np.cumsum(n + width) - (n + width)
    out = np.zeros(int((n + width).sum()), dtype=np.uint64)
    out[ranges(start, n)] = codes
    return out, start


def suffix_array(codes: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at `at`, ordered by their first `depth` word codes, ties by position."""
    order = np.lexsort((at, *(codes[at + d] for d in range(depth - 1, -1, -1))))
    return at[order]


def below(codes: np.ndarray, at: np.ndarray, test: np.ndarray, wanted: np.ndarray, depth: int, or_equal: bool) -> np.ndarray:
    """Pair by pair: do the words at `at` sort before those of the test at `wanted` (0: no more)?"""
    less = np.zeros(len(at), dtype=bool)
    same = np.ones(len(at), dtype=bool)
    for d in range(depth):
        w, have = test[wanted + d], codes[at + d]
        less |= same & (w > 0) & (have < w)
        same &= (w == 0) | (have == w)
    return less | same if or_equal else less


def bound(codes: np.ndarray, array: np.ndarray, test: np.ndarray, wanted: np.ndarray, depth: int, right: bool) -> np.ndarray:
    """Binary search of all wanted suffixes at once: the first place whose suffix isn't below."""
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(array), np.int64)
    while len(array) and (lo < hi).any():
        live = lo < hi
        mid = np.minimum((lo + hi) // 2, len(array) - 1)
        down = below(codes, array[mid], test, wanted, depth, right)
        lo = np.where(live & down, mid + 1, lo)
        hi = np.where(live & ~down, mid, hi)
    return lo


#: Stands for the word before an item's first one; word codes are odd.
NOTHING = np.uint64(2)


def test_suffixes(ids: list[int], texts: list[bytes], window: int) -> dict[str, np.ndarray]:
    """The benchmark's suffixes that start a window, in order, equal windows together.

    codes: the word codes of all items, zeros in between; raw, start, end and word: their bytes.  head: one suffix of
    each distinct window, length: its words, from: where its suffixes begin in at (their places), which are
    ordered by the word before (prev), and in_from where its items begin in `in`.
    """
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    raw = LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    start, end, woff = words(raw, off, "alnum")
    codes, base = padded(word_hashes(raw, start, end) | np.uint64(1), woff, window)
    n = np.diff(woff)
    starts = np.where(n == 0, 0, np.maximum(n - window + 1, 1))
    item = np.repeat(np.arange(len(texts)), starts)
    at = base[item] + ranges(np.zeros(len(texts), np.int64), starts) if len(texts) else np.zeros(0, np.int64)
    prev = np.where(at > base[item], codes[at - 1], NOTHING) if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((at, prev, *(codes[at + d] for d in range(window - 1, -1, -1)))) if len(at) else np.zeros(0, np.int64)
    at, prev, item = at[order], prev[order], item[order]
    new = np.zeros(len(at), dtype=bool)
    new[:1] = True
    for d in range(window):
        new[1:] |= codes[at[1:] + d] != codes[at[:-1] + d]
    group = np.cumsum(new) - 1
    ids_ = np.array(ids, dtype=np.int64)
    owned = np.unique(group * (len(texts) + 1) + item)
    word = np.zeros(len(codes), np.int64)
    word[ranges(base, n)] = np.arange(len(start))
    first = np.zeros(len(codes), np.int64)
    first[ranges(base, n)] = np.repeat(base, n)
    return {
        "codes": codes, "raw": raw, "start": start, "end": end, "word": word, "first": first,
        "at": at, "prev": prev, "group": group, "id": ids_[item] if len(item) else item,
        "head": at[new], "length": np.minimum(n[item], window)[new] if len(item) else item,
        "from": np.append(np.flatnonzero(new), len(at)),
        "in": ids_[owned % (len(texts) + 1)] if len(owned) else owned, "in_from": np.searchsorted(owned // (len(texts) + 1), np.arange(int(new.sum()) + 1)),
    }


def longest(test: dict[str, np.ndarray], window: int, codes: np.ndarray, place: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, ...]:
    """(k, place there, length): verbatim matches at places[k] that can't be prolonged to the left, to their ends.
    A document's longest match is among them; so a word that a text repeats many times
    costs as many pairs, not their square."""
    known = np.unique(test["prev"])
    before = np.where(place > 0, codes[place - 1], 0)
    nth = np.minimum(np.searchsorted(known, before), max(len(known) - 1, 0))
    key = test["group"] * (len(known) + 1) + np.searchsorted(known, test["prev"])
    same = known[nth] == before
    mine = which * (len(known) + 1) + nth
    a, d = test["from"][which], test["from"][which + 1]
    b, c = np.where(same, np.searchsorted(key, mine), d), np.where(same, np.searchsorted(key, mine, side="right"), d)
    out: list[tuple] = [(np.zeros(0, np.int64),) * 3]
    weight = np.cumsum((b - a) + (d - c))
    s = 0
    while s < len(place):
        e = max(s + 1, int(np.searchsorted(weight, (weight[s - 1] if s else 0) + PAIRS, side="right")))
        k = np.concatenate([np.repeat(np.arange(s, e), (b - a)[s:e]), np.repeat(np.arange(s, e), (d - c)[s:e])])
        there = test["at"][np.concatenate([ranges(a[s:e], (b - a)[s:e]), ranges(c[s:e], (d - c)[s:e])])]
        length = test["length"][which[k]].astype(np.int64)
        live = np.flatnonzero(length == window)
        while len(live):
            x, y = place[k[live]] + length[live], there[live] + length[live]
            inside = (x < len(codes)) & (y < len(test["codes"]))
            live, x, y = live[inside], x[inside], y[inside]
            live = live[(codes[x] == test["codes"][y]) & (codes[x] > 0)]
            length[live] += 1
        out.append((k, there, length))
        s = e
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(test: dict[str, np.ndarray], window: int, raw: np.ndarray, off: np.ndarray) -> list[tuple]:
    """Per row: words, hit words, items, and its longest match (item, word there, word here, length)."""
    start, end, woff = words(raw, off, "alnum")
    codes, base = padded(word_hashes(raw, start, end) | np.uint64(1), woff, window)
    n_rows, n_words = len(off) - 1, np.diff(woff)
    row_of = np.repeat(np.arange(n_rows), n_words + window)
    at = np.flatnonzero(codes)
    head, heads = test["head"], test["codes"]
    alive = np.zeros(len(at), dtype=bool)
    if len(head):
        single = test["length"] == 1
        one, two = heads[head[single]], head[~single]
        for known, got in ((one, codes[at]), (mix(heads[two]) + heads[two + 1], mix(codes[at]) + codes[at + 1])):
            known = np.unique(known)
            if len(known):
                alive |= known[np.minimum(np.searchsorted(known, got), len(known) - 1)] == got
    array = suffix_array(codes, at[alive], window)
    lo, hi = (bound(codes, array, heads, head, window, right) for right in (False, True))
    found = np.flatnonzero(hi > lo)
    which = np.repeat(found, (hi - lo)[found])
    place = array[ranges(lo[found], (hi - lo)[found])]
    if len(place):
        # Codes only lead here; the bytes decide.
        length = test["length"][which]
        pair = np.repeat(np.arange(len(place)), length)
        step = ranges(np.zeros(len(place), np.int64), length)
        row = row_of[place[pair]]
        mine = woff[row] + place[pair] - base[row] + step
        theirs = test["word"][head[which[pair]]] + step
        size = (end - start)[mine]
        good = size == (test["end"] - test["start"])[theirs]
        good &= same_bytes(raw, start[mine], test["raw"], test["start"][theirs], np.where(good, size, 0))
        good = np.logical_and.reduceat(good, np.cumsum(length) - length)
        which, place = which[good], place[good]
    hit = covered(len(codes), place, place + test["length"][which])
    rows = row_of[place]
    best: dict[int, tuple] = {}
    k, there, length = longest(test, window, codes, place, which)
    if len(k):
        item = np.zeros(len(heads), np.int64)
        item[test["at"]] = test["id"]
        order = np.lexsort((place[k], there, item[there], -length, rows[k]))
        firsts = order[np.unique(rows[k][order], return_index=True)[1]]
        for i in firsts:
            p = place[k[i]]
            best[int(row_of[p])] = (int(item[there[i]]), int(there[i] - test["first"][there[i]]), int(p - base[row_of[p]]), int(length[i]))
    of_row: dict[int, set] = {}
    for pair in np.unique(rows * np.int64(len(head) + 1) + which).tolist():
        h = pair % (len(head) + 1)
        of_row.setdefault(pair // (len(head) + 1), set()).update(test["in"][test["in_from"][h] : test["in_from"][h + 1]].tolist())
    out = []
    for r in range(n_rows):
        marks = np.flatnonzero(hit[base[r] : base[r] + n_words[r]]).tolist() if r in of_row else []
        out.append((int(n_words[r]), marks, sorted(of_row.get(r, ())), *best.get(r, (None, None, None, None))))
    return out


def blocks(benchmark: DataFrame, window: int, item_id: str, item_text: str, block_bytes: int) -> Iterator[list]:
    """The benchmark's suffixes as broadcasts of about block_bytes of text each, up to TOGETHER at a time; there is one at least."""
    sized = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where(F.length("text") > 0)
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    sent = []
    for k in range(n):
        items = (sized if n == 1 else sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()
        test = test_suffixes([-1 if r.item_id is None else r.item_id for r in items], [r.text.encode() for r in items], window)
        sent.append(benchmark.sparkSession.sparkContext.broadcast(test))
        if len(sent) == TOGETHER or k == n - 1:
            yield sent
            sent = []


def through_blocks(rows: DataFrame, benchmark: DataFrame, window: int, item_id: str, item_text: str, block_bytes: int, step) -> DataFrame:
    """rows after step(rows, broadcast) for every block; beyond TOGETHER blocks, rows are written in between."""
    before: list = []
    for sent in blocks(benchmark, window, item_id, item_text, block_bytes):
        if before:
            rows = kept(rows)
            for b in before:
                b.destroy()
        for b in sent:
            rows = step(rows, b)
        before = sent
    return rows


def merged(a: tuple, b: tuple) -> tuple:
    """What two blocks have found in one row."""
    if not a[1] or not b[1]:
        return a if a[1] else b
    best = min((a[3:], b[3:]), key=lambda m: (-m[3], m[0], m[1], m[2]))
    return (a[0], sorted({*a[1], *b[1]}), sorted({*a[2], *b[2]}), *best)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, the hit words' positions, the items with an occurring
    window and the longest verbatim match with its place in the item and the document.

    A null or empty text has no words; an item without words occurs nowhere; items of
    fewer than `window` words are one window; an item without an id is reported as -1;
    repeated rows are judged each by itself and reported as often as they occur; an empty
    benchmark hits nothing; a text of any length is searched as a whole; other columns of the tables are not read.
    """
    bounded(docs.sparkSession)
    names = ["n_words", "hits", "items", "match_item", "match_item_word", "match_word", "match_len"]
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int32())

    def step(rows: DataFrame, sent) -> DataFrame:
        again = "hits" in rows.columns

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = sent.value
            for batch in batches:
                for part in parts(batch, "text", 4_000_000):
                    raw, off = in_bytes(part.column("text"))
                    found = search(test, window, LOWER[raw], off)
                    if again:
                        found = [merged(a, b) for a, b in zip(zip(*(part.column(c).to_pylist() for c in names), strict=True), found, strict=True)]
                    cols = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), *map(pa.array, cols, kinds)], names=["doc_id", "text", *names])

        return rows.mapInArrow(scan, f"doc_id long, text string, {FOUND}")

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return through_blocks(source, benchmark, window, item_id, item_text, block_bytes, step).drop("text")


def contaminated(n_hit, n_words):
    """The verdict on a document: at least a twentieth of its words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 13, least_share: float = 0.0, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold a benchmark window and of whose words at least `least_share`
    are hit by one block (0: any hit); all other rows and all columns stay.

    Null, empty and very long texts, repeated rows and an empty benchmark are as in matches().
    """
    bounded(docs.sparkSession)

    def step(rows: DataFrame, sent) -> DataFrame:
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = sent.value
            for batch in batches:
                for part in parts(batch, text, 4_000_000):
                    raw, off = in_bytes(part.column(text))
                    good = [not (r[1] and len(r[1]) >= least_share * r[0]) for r in search(test, window, LOWER[raw], off)]
                    yield part.filter(pa.array(good, pa.bool_()))

        return rows.mapInArrow(clean, rows.schema)

    return through_blocks(docs, benchmark, window, item_id, item_text, block_bytes, step)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of matches() per document."""
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return matches(docs, benchmark).select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        contaminated(F.size("hits"), F.col("n_words")).alias("contaminated"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
