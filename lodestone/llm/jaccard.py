"""A Jaccard self-join of word-shingle sets by count vectors in an R-tree.

Shingles are hashed into groups; a document's point is its number of shingles in
each group.  Two sets share at most the sum of their points' coordinate minima, so a tree
over points, whose nodes keep the largest coordinates below them, is searched only
where that sum can reach the overlap asked for.  Pairs that survive are verified on the
whole texts.

A tree over all documents wouldn't part them (most points of a size lie close), so
documents are gathered first: sets that are alike enough must share a shingle among their
first few in any one order of shingles (frequent ones come last here), and all documents that
share such a shingle gather around the least of them, its centre.  First only points are gathered:
a document stays if its bound with the centre, or with a point that the gathering's tree finds, reaches the
overlap.  Of those that stay the texts are gathered and linked where they lie: what is alike to the
centre needs no further comparison, the rest searches the tree again, and of pairs found alike
only those are returned that connect what wasn't connected yet.  What leaves a task is thus
linear in the documents gathered, however large a group of copies is.  Equal sets are one point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import in_bytes, mix, owners, parts, ranges, signed
from .bodies import packed
from .components import components
from .fingerprints import shingle_hashes
from .session import LEAST, bounded, discard, doc_ids, identified, in_few_tasks, kept, read

U64 = np.uint64
#: Words in a shingle; the similarity as a fraction; groups of a point, at least and at most.
SHINGLE, NUM, DEN, GROUPS, MOST_GROUPS = 5, 3, 4, 128, 2048
#: Shingles are counted below this share of the hash range; prefixes seldom go beyond.
COUNTED = 0.3
COUNTED_BELOW = int(COUNTED * 2**63)
#: Shingles in more documents than this, or than one in so many documents, are frequent; of these at most so many are sent to tasks.
FREQUENT, FREQUENT_SHARE, SENT = 200, 5000, 1_000_000
#: Shingles (and so many more for each row) that a task holds of a gathering; larger ones are dealt to several tasks.
HELD, ROW = 1_000_000, 64
#: Groups of points that a task holds of a gathering; larger ones are dealt to several tasks.
POINTS_HELD = 4_000_000


def sets(part: pa.RecordBatch, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes (63 bits), ascending, and row offsets."""
    raw, off = in_bytes(part.column("text"))
    hashes, soff = shingle_hashes(raw, off, k, seed)
    hashes = hashes >> U64(1)
    own = owners(soff)
    order = np.argsort(hashes)
    order = order[by_row(own[order], part.num_rows)]
    hashes, own = hashes[order], own[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])
    return hashes[new], np.searchsorted(own[new], np.arange(part.num_rows + 1))


def by_row(own: np.ndarray, rows: int) -> np.ndarray:
    """A stable order by row; few rows sort by their digits."""
    return np.argsort(own.astype(np.uint16) if rows < 1 << 16 else own, kind="stable")


def coded(counts: np.ndarray) -> bytes:
    """Counts as a byte each, and a power of two that they are multiples of, rounded up: a bound from above."""
    shift = 0
    while (int(counts.max(initial=0)) + (1 << shift) - 1) >> shift > 255:
        shift += 1
    return ((counts + (1 << shift) - 1) >> shift).astype(np.uint8).tobytes() + bytes([shift])


def decoded(point: bytes) -> np.ndarray:
    counts = np.frombuffer(point, np.uint8, len(point) - 1)
    return counts.astype(np.int32) << point[-1] if point[-1] else counts


def finest(n: int, groups: int) -> int:
    """Groups of a set's point: a power of two, one for each shingle or so."""
    return max(groups, 1 << max(n, 1).bit_length())


def grouped(hashes: np.ndarray, groups: int) -> np.ndarray:
    """The number of shingles in each group; groups (a power of two) are ranges of a hash, so that neighbours add up to coarser ones."""
    return np.bincount((mix(hashes) >> U64(65 - groups.bit_length())).astype(np.int64), minlength=groups)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Coarser points: the last axis summed up to so many groups."""
    return counts.reshape(*counts.shape[:-1], groups, -1).sum(axis=-1, dtype=np.int32) if counts.shape[-1] > groups else counts


def points(hashes: np.ndarray, off: np.ndarray, groups: int) -> np.ndarray:
    """The number of shingles in each group, a row for each set."""
    at = owners(off) * groups + (mix(hashes) >> U64(65 - groups.bit_length())).astype(np.int64)
    count = np.bincount(at, minlength=(len(off) - 1) * groups).reshape(-1, groups)
    return count.astype(np.uint8 if count.max(initial=0) < 256 else np.int32)


def sizes(docs: DataFrame, k: int, groups: int) -> DataFrame:
    """(doc, th, n, f1, f2, point): size, fingerprint (128 bits) and compressed point of each document's set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in parts(batch, "text"):
                hashes, soff = sets(part, k)
                f = [np.diff(np.concatenate([[U64(0)], np.cumsum(mix(hashes + U64(s)))])[soff]) for s in (1, 2)]
                point = [squeeze(coded(grouped(hashes[a:b], finest(b - a, groups)))) if b > a else None for a, b in zip(soff[:-1].tolist(), soff[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("th"), pa.array(np.diff(soff)), *(pa.array(signed(np.ascontiguousarray(x))) for x in f), pa.array(point, pa.binary())], names=["doc", "th", "n", "f1", "f2", "point"])

    return docs.mapInArrow(scan, "doc long, th long, n long, f1 long, f2 long, point binary")


def count_shingles(docs: DataFrame, k: int) -> DataFrame:
    """(key, n): in how many documents each shingle of the counted range occurs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                hashes, _ = sets(part, k)
                key, n = np.unique(hashes[hashes < U64(COUNTED_BELOW)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(n, pa.int32())], names=["key", "n"])

    return docs.mapInArrow(scan, "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))


def prefixes(docs: DataFrame, k: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """(key, doc, th, size): the first shingles of each set, frequent ones last; sets alike enough share one."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sent.value
        for batch in batches:
            for part in parts(batch, "text"):
                hashes, soff = sets(part, k)
                n = np.diff(soff)
                own = owners(soff)
                late = np.zeros(len(hashes), dtype=bool)
                if len(often):
                    late = often[np.minimum(np.searchsorted(often, hashes), len(often) - 1)] == hashes
                order = by_row(own * 2 + late, 2 * part.num_rows)
                nth = np.arange(len(hashes)) - soff[own]
                first = nth < (n - -(-num * n // den) + 1)[own]
                at = pa.array(own[first])
                yield pa.RecordBatch.from_arrays([pa.array(signed(hashes[order][first])), part.column("doc").take(at), part.column("th").take(at), pa.array(n[own[first]], pa.int32())], names=["key", "doc", "th", "size"])

    return docs.mapInArrow(scan, "key long, doc long, th long, size int")


class CountTree:
    """An R-tree over count vectors, packed by size and then by the leading coordinates."""

    def __init__(self, vectors: np.ndarray, n: np.ndarray, fan: int = 16):
        lead = vectors[:, np.argsort(-vectors[:: 1 + len(n) // 4096].astype(float).var(axis=0))[:2]]
        band = np.empty(len(n), dtype=np.int64)
        band[np.argsort(n, kind="stable")] = np.arange(len(n)) // max(fan * 4, 1)
        self.order = np.lexsort((lead[:, 1], lead[:, 0], band))
        self.fan = fan
        #: From the leaves up: the largest coordinates, the least and the largest size below each node.
        self.levels = [(vectors[self.order], n[self.order], n[self.order])]
        while len(self.levels[-1][0]) > fan:
            top, least, most = self.levels[-1]
            cut = np.arange(0, len(top), fan)
            self.levels.append((np.maximum.reduceat(top, cut, axis=0), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)))

    def search(self, vector: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
        """The points whose bound on the overlap reaches what the similarity num / den asks for."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least, most = (x[nodes] for x in self.levels[depth])
            bound = np.minimum(top, vector).sum(axis=1, dtype=np.int64)
            nodes = nodes[(bound * (num + den) >= num * (n + least)) & (num * least <= den * n) & (num * n <= den * most)]
            if depth:
                nodes = (nodes[:, None] * self.fan + np.arange(self.fan)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return self.order[nodes]


def alike(a, b, both, num: int, den: int):
    """Is the intersection at least num / den of the union of sets of sizes a and b?"""
    return both * (num + den) >= num * (a + b)


def shared_with(q: np.ndarray, hashes: np.ndarray, off: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many of q's shingles each of the rows' sets (none empty) has."""
    n = off[rows + 1] - off[rows]
    x = hashes[ranges(off[rows], n)]
    there = np.minimum(np.searchsorted(q, x), len(q) - 1)
    return np.add.reduceat((q[there] == x).astype(np.int64), np.cumsum(n) - n) if len(rows) else n


def group_links(hashes: np.ndarray, off: np.ndarray, label: np.ndarray, query: np.ndarray | None, num: int, den: int, groups: int) -> list[tuple[int, int]]:
    """Links (i, j) between rows of one gathering, enough to connect all that any path of links connects.

    label: rows of one label are known to be connected (it is changed).  query: pairs without
    a query row are not looked at; if None, row 0 is the centre, and what isn't alike to it are the queries.
    """
    n = np.diff(off)
    out = []

    def connect(i: int, js: np.ndarray) -> None:
        for j in js.tolist():
            if label[i] != label[j]:
                out.append((i, j))
                label[label == label[j]] = label[i]

    if query is None:
        near = 1 + np.flatnonzero((den * np.minimum(n[0], n[1:]) >= num * np.maximum(n[0], n[1:])) & (label[1:] != label[0]))
        both = shared_with(hashes[: off[1]], hashes, off, near)
        connect(0, near[alike(n[0], n[near], both, num, den)])
        query = label != label[0]
        if len(n) == 2:
            return out
    if not query.any():
        return out
    wide = max(groups, min(MOST_GROUPS, 1 << int(2 * n.mean()).bit_length()))
    vectors = points(hashes, off, wide)
    tree = CountTree(vectors, n)
    for q in np.flatnonzero(query).tolist():
        hits = tree.search(vectors[q], int(n[q]), num, den)
        hits = hits[(label[hits] != label[q]) & (~query[hits] | (hits > q))]
        if len(hits):
            both = shared_with(hashes[off[q] : off[q + 1]], hashes, off, hits)
            connect(q, hits[alike(n[q], n[hits], both, num, den)])
    return out


def tables(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], most: int = 2_000_000) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Batches put together to about so many bytes and cut where keys change, and the ranges of rows of equal keys."""
    held: list[pa.RecordBatch] = []

    def ranged(table: pa.Table) -> tuple[pa.Table, list[tuple[int, int]]]:
        new = np.ones(table.num_rows, dtype=bool)
        new[1:] = False
        for c in keys:
            x = table.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        at = np.flatnonzero(new).tolist()
        return table, list(zip(at, [*at[1:], table.num_rows], strict=True))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(h.nbytes for h in held) < most:
            continue
        table, groups = ranged(pa.Table.from_batches(held))
        if len(groups) > 1:
            cut = groups[-1][0]
            held = table.slice(cut).to_batches()
            yield table.slice(0, cut), groups[:-1]
    if held:
        yield ranged(pa.Table.from_batches(held))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """All rows of equal keys in one partition and together, the centre in front."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "first", "doc", "th")


class Points:
    """The points of a gathering, with as many groups each as its size asks for."""

    def __init__(self, compressed: list[bytes], n: np.ndarray, groups: int):
        expand = zstandard.ZstdDecompressor().decompress
        each = [decoded(expand(p)) for p in compressed]
        self.n, self.wide = n, np.array([len(p) for p in each])
        self.place, self.of = np.zeros(len(n), np.int64), {}
        for w in np.unique(self.wide).tolist():
            at = np.flatnonzero(self.wide == w)
            self.place[at] = np.arange(len(at))
            self.of[w] = np.stack([each[i] for i in at.tolist()])
        coarse = {w: folded(x, groups) for w, x in self.of.items()}
        self.coarse = np.empty((len(n), groups), dtype=np.uint16 if all(x.max(initial=0) < 1 << 16 for x in coarse.values()) else np.int32)
        for w, x in coarse.items():
            self.coarse[self.wide == w] = x

    def reach(self, q: int, rows: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which of the rows' bounds with row q reach the overlap asked for?"""
        ok = den * np.minimum(self.n[rows], self.n[q]) >= num * np.maximum(self.n[rows], self.n[q])
        mine = self.of[int(self.wide[q])][self.place[q]]
        for w, x in self.of.items():
            at = np.flatnonzero(ok & (self.wide[rows] == w))
            if len(at):
                g = min(w, len(mine))
                bound = np.minimum(folded(x[self.place[rows[at]]], g), folded(mine, g)).sum(axis=1, dtype=np.int64)
                ok[at] = alike(self.n[q], self.n[rows[at]], bound, num, den)
        return ok


def within_bound(rows: DataFrame, num: int, den: int, groups: int) -> DataFrame:
    """(cdoc, cth, chunk, doc, th, size, stay): whose bound with any other document of its gathering's chunk reaches the overlap asked for?

    rows: (cdoc, cth, chunk, first, doc, th, size, point) and, where only some are asked for, query; only
    those are returned then.
    """
    asked = "query" in rows.columns

    def staying(p: Points, query: np.ndarray | None) -> np.ndarray:
        stay = np.zeros(len(p.n), dtype=bool)
        if query is None:
            stay[1:] = p.reach(0, np.arange(1, len(p.n)), num, den)
            stay[0] = stay.any()
            rest = np.flatnonzero(~stay)
        else:
            rest = np.flatnonzero(query)
        if len(p.n) > (2 if query is None else 1) and len(rest):
            tree = CountTree(p.coarse, p.n)
            for q in rest.tolist():
                hits = tree.search(p.coarse[q], int(p.n[q]), num, den)
                stay[q] = p.reach(q, hits[hits != q], num, den).any()
        return stay

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, gathered in tables(batches, ("cdoc", "cth", "chunk"), 1_000_000):
            size, point = table.column("size").to_numpy().astype(np.int64), table.column("point").to_pylist()
            query = table.column("query").to_numpy().astype(bool) if asked else None
            stay = np.zeros(len(size), dtype=bool)
            for s, e in gathered:
                if e - s > 1:
                    stay[s:e] = staying(Points(point[s:e], size[s:e], groups), query[s:e] if asked else None)
            out = table.select(["cdoc", "cth", "chunk", "doc", "th", "size"]).append_column("stay", pa.array(stay))
            yield from (out.filter(pa.array(query)) if asked else out).combine_chunks().to_batches()

    return dealt(rows, "cdoc", "cth", "chunk").mapInArrow(scan, "cdoc long, cth long, chunk int, doc long, th long, size int, stay boolean")


LINK = "udoc long, uth long, vdoc long, vth long"


def gathered_links(rows: DataFrame, k: int, num: int, den: int, groups: int) -> DataFrame:
    """Links (u, v) within gatherings, told from the whole texts.

    rows: (cdoc, cth, chunk, first, doc, th, body) and, where labels are known, (ldoc, lth, query); the
    centre has first = 0.  Shingles are hashed anew with a seed of their own, so that a pair is never taken
    for alike because its candidates' hashes met.
    """
    labelled = "query" in rows.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for table, gathered in tables(batches, ("cdoc", "cth", "chunk")):
            column = lambda c: table.column(c).to_numpy()  # noqa: B023,E731
            doc, th = column("doc"), column("th")
            _, one, own = np.unique(np.stack([doc, th]), axis=1, return_index=True, return_inverse=True)
            texts = pa.RecordBatch.from_arrays([pa.array([expand(b.as_py()) for b in table.column("body").take(pa.array(one))], pa.large_binary())], names=["text"])
            got = [sets(p, k, 2) for p in parts(texts, "text")]
            all_ = np.concatenate([h for h, _ in got])
            soff = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in got]))])
            found: list[tuple[int, int]] = []
            if labelled:
                _, label = np.unique(np.stack([column("ldoc"), column("lth")]), axis=1, return_inverse=True)
                query = column("query").astype(bool)
            for s, e in gathered:
                if e - s > 1:
                    u = own[s:e]
                    n = soff[u + 1] - soff[u]
                    hashes, off = all_[ranges(soff[u], n)], np.concatenate([[0], np.cumsum(n)])
                    found += [(s + i, s + j) for i, j in group_links(hashes, off, label[s:e].copy() if labelled else np.arange(e - s), query[s:e] if labelled else None, num, den, groups)]
            i, j = np.array(found, dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[i], th[i], doc[j], th[j])], names=["udoc", "uth", "vdoc", "vth"])

    return dealt(rows, "cdoc", "cth", "chunk").mapInArrow(scan, LINK).select(vertex("udoc", "uth").alias("u"), vertex("vdoc", "vth").alias("v"))


def vertex(doc: str = "doc", th: str = "th") -> Column:
    return F.struct(F.col(doc).alias("doc"), F.col(th).alias("th"))


def gatherings(buckets: DataFrame) -> DataFrame:
    """(cdoc, cth, doc, th, size): whoever shares a bucket with the least document of it, the centre, once."""
    centres = kept(buckets.groupBy("key").agg(F.min(vertex()).alias("c"), F.max(vertex()).alias("last")).where("c < last").select("key", F.col("c.doc").alias("cdoc"), F.col("c.th").alias("cth")), few=True)
    members = kept(buckets.join(centres, "key").groupBy("cdoc", "cth", "doc", "th").agg(F.max("size").alias("size")), few=True)
    discard(centres)
    return members


def own_part(parts: str, seed: int = 42) -> Column:
    """One of so many parts of a gathering, by a hash of the document."""
    return F.pmod(F.xxhash64("doc", "th", F.lit(seed)), F.col(parts)).cast("int")


def cells(rows: DataFrame, load: Column, most: int) -> DataFrame:
    """rows once for each cell in which they meet others: chunk is the cell's number, and query says who is asked for there.

    rows: (cdoc, cth, chunks, doc, th, query, ...).  A gathering's rows are dealt to its chunks and its queries,
    besides, to blocks of about `most` load; a cell is a block and a chunk.  Each query meets each row of its gathering in one
    cell, and no cell has more than a block and a chunk, however many queries there are.
    """
    blocks = rows.where("query").groupBy("cdoc", "cth").agg(F.ceil(F.sum(load) / most).cast("int").alias("blocks"))
    at = rows.join(blocks, ["cdoc", "cth"]).withColumn("own", own_part("chunks")).withColumn("block", own_part("blocks", 7))
    as_row = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct((b * F.col("chunks") + F.col("own")).alias("chunk"), (F.col("query") & (b == F.col("block"))).alias("query")))
    elsewhere = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.col("query") & (c != F.col("own")))
    as_query = F.transform(elsewhere, lambda c: F.struct((F.col("block") * F.col("chunks") + c).alias("chunk"), F.lit(True).alias("query")))
    others = [c for c in rows.columns if c not in ("chunks", "query")]
    return at.select(*others, F.explode(F.concat(as_row, as_query)).alias("cell")).select(*others, "cell.chunk", "cell.query")


def staying(members: DataFrame, points: DataFrame, num: int, den: int, groups: int) -> DataFrame:
    """members without those that their points tell to be alike to nobody; points: (doc, th, point)."""
    load = F.greatest(F.lit(groups), 2 * F.col("size").cast("long"))
    wide = kept(members.groupBy("cdoc", "cth").agg(F.ceil(F.sum(load) / POINTS_HELD).cast("int").alias("chunks")).where("chunks > 1"), few=True)
    centre = vertex() == vertex("cdoc", "cth")
    own = members.join(wide, ["cdoc", "cth"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    chunked = own.withColumn("chunk", F.explode(F.when(centre, every).otherwise(F.array(own_part("chunks"))))).join(points, ["doc", "th"])
    columns = ["cdoc", "cth", "doc", "th", "size"]
    told = within_bound(chunked.select("cdoc", "cth", "chunk", F.when(centre, 0).otherwise(1).alias("first"), "doc", "th", "size", "point"), num, den, groups)
    if wide.isEmpty():
        out = kept(told.where("stay").select(columns), few=True)
        discard(wide)
        return out
    # Gatherings that several tasks share: who is alike to nobody in its chunk is asked for in all of them.
    told = kept(told, few=True)
    asked = told.join(wide, ["cdoc", "cth"]).groupBy(*columns, "chunks").agg((~F.max("stay")).alias("query"))
    rows = cells(asked, load, POINTS_HELD).withColumn("first", F.lit(1)).join(points, ["doc", "th"])
    more = within_bound(rows, num, den, groups)
    out = kept(told.where("stay").select(columns).unionByName(more.where("stay").select(columns)).distinct(), few=True)
    discard(wide, told)
    return out


def links_and_classes(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN, groups: int = GROUPS) -> tuple[DataFrame, DataFrame]:
    """links (u, v) between distinct sets, enough of them to tell which reach each other, and
    members (doc, th, n, rep): each document's set by its first document.  docs is what identified() gives.

    Each link is verified, and any two linked sets are joined by some path of the links returned.
    """
    known = kept(sizes(docs, k, groups), few=True)
    classes = known.where("n > 0").groupBy("f1", "f2", "n").agg(F.min(vertex()).alias("rep"))
    members = kept(known.join(classes, ["f1", "f2", "n"], "left").select("doc", "th", "n", F.coalesce("rep", vertex()).alias("rep")), few=True)
    n_docs = known.count()
    reps = kept(members.where("n > 0").select("rep.doc", "rep.th").distinct(), few=True)
    shared = kept(count_shingles(docs, k).where("n > 1"), few=True)
    often = max(FREQUENT, n_docs // FREQUENT_SHARE)
    while shared.where(F.col("n") > often).count() > SENT:
        often *= 2
    frequent = np.sort(np.array([r.key for r in shared.where(F.col("n") > often).select("key").collect()], dtype=np.int64).view(U64))
    first = prefixes(docs, k, num, den, frequent).join(shared, "key", "left").where(F.col("n").isNotNull() | (F.col("key") >= COUNTED_BELOW))
    buckets = kept(first.select("key", "doc", "th", "size").join(reps, ["doc", "th"], "left_semi"), few=True)
    discard(shared, reps)
    gathered = gatherings(buckets)
    discard(buckets)
    repeated = docs_repeat(members)
    points = known.select("doc", "th", "point")
    left = staying(gathered, points.dropDuplicates(["doc", "th"]) if repeated else points, num, den, groups)
    discard(gathered, known)
    once = packed(docs.dropDuplicates(["doc", "th"]) if repeated else docs)
    bodies = kept(once.join(left.select("doc", "th").distinct(), ["doc", "th"], "left_semi"), few=True)
    leads = kept(left.groupBy("cdoc", "cth").agg(F.min(vertex()).alias("lead"), F.ceil(F.sum(F.col("size") + ROW) / HELD).cast("int").alias("chunks")), few=True)
    around = left.join(leads, ["cdoc", "cth"])
    own = own_part("chunks")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    leading = vertex() == F.col("lead")
    rows = around.select("cdoc", "cth", F.explode(F.when(leading, every).otherwise(F.array(own))).alias("chunk"), F.when(leading, 0).otherwise(1).alias("first"), "doc", "th")
    links = kept(gathered_links(rows.join(bodies, ["doc", "th"]), k, num, den, groups), few=True)
    shared_out = around.where("chunks > 1")
    if shared_out.isEmpty():
        discard(left, leads, bodies)
        return links, members
    # Gatherings that several tasks share: what isn't linked with the lead meets all the others, in cells.
    roots = components(links)
    label = shared_out.withColumn("u", vertex()).join(roots, "u", "left").withColumn("root", F.coalesce("root", "u")).drop("u")
    main = label.where(leading).select("cdoc", "cth", F.col("root").alias("main"))
    asked = label.join(main, ["cdoc", "cth"]).withColumn("query", F.col("root") != F.col("main")).drop("lead", "main")
    rows = cells(asked, F.col("size") + ROW, HELD).select("cdoc", "cth", "chunk", F.lit(1).alias("first"), "doc", "th", F.col("root.doc").alias("ldoc"), F.col("root.th").alias("lth"), "query")
    more = kept(gathered_links(rows.join(bodies, ["doc", "th"]), k, num, den, groups), few=True)
    discard(left, leads, bodies)
    return links.unionByName(more), members


def docs_repeat(members: DataFrame) -> bool:
    return not members.where("th != 0").isEmpty()


def linked(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN, groups: int = GROUPS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, th, n, root): for each row its set's size and the first document that it reaches by links.

    A document without words, or null, has an empty set and is linked with nothing.  Rows that
    agree in id and text are one document, given as often as they occur; rows that only share an id are
    documents of their own; null ids sort first.  Texts of any length are taken whole; other columns aren't read.
    """
    bounded(docs.sparkSession)
    source, _ = identified(docs, doc_id, text)
    links, members = links_and_classes(source, k, num, den, groups)
    roots = components(links)
    found = members.join(roots.withColumnRenamed("u", "rep"), "rep", "left")
    return found.select("doc", "th", "n", F.coalesce("root", "rep").alias("root"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with one document, the first, of each group that links connect; all columns stay, whatever their names.
    Of rows that agree in id and text one stays, too; texts without words stay, as they are linked with nothing.

    Whole rows meet the identities that stay by hashes of those, so texts aren't sorted; the result comes in few partitions."""
    named = docs.withColumn("__all", F.struct(*docs.columns))
    source, unique = identified(named, doc_id, text, ("__all",))
    firsts = linked(docs, text=text, doc_id=doc_id, **options).where(vertex() == F.col("root")).select("doc", "th").distinct()
    out = source.select("doc", "th", "__all") if unique else source.select("doc", "th", "__all").dropDuplicates(["doc", "th"])
    return in_few_tasks(out.join(firsts.hint("shuffle_hash"), ["doc", "th"], "left_semi").select("__all.*"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked(read(spark, sf_dir, "documents"))
    root = F.col("root.doc")
    return found.select(doc_ids().alias("doc_id"), F.col("n").alias("n_shingles"), F.when(root != LEAST, root).alias("component_id"))
