"""A Brown class-based n-gram language model.

Exchange clustering assigns every listed word, and the groups of the rarer words that end alike, to classes
so as to raise the likelihood of the training text.  It begins with the most frequent words,
exchanged one at a time on the driver until none moves; then all units are exchanged in rounds
over the whole text: how often each unit stands before and after each class is summed up by
unit, each unit goes to its best class, and rounds end when the likelihood gains no more
than `tolerance` a token.  A token's probability is its class's, given the
class before, times its unit's in the class, times (within a group) the word's in
the group:  P(class | class before) P(unit | class) P(word | unit).

All counts are taken over all training text.  What reaches the driver is bounded
by parameters: `listed` words with their classes, and the pair counts of `frequent` words, groups and classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LOWER, in_bytes, mix, parts, signed, word_hashes, words
from .language import held_out
from .session import bounded, discard, identified, kept, read

U64 = np.uint64
#: Words that the clustering begins with; groups of the words that aren't listed; classes; listed words: units of their own, sent to every task.
FREQUENT, GROUPS, CLASSES, LISTED = 500, 256, 48, 200_000
#: Rounds of exchange go on while the training text gains this much a token, in natural logarithms.
TOLERANCE = 0.002
#: The end of a text counts as a token; this is its code.
END = U64(0xE0D)


@dataclass
class Model:
    """What scoring needs at each task.  codes: sorted, with their counts and units (0 is the end, then the
    listed words, then the groups); classes and log_unit are by unit."""

    codes: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    least: int
    total: int
    distinct: int
    group_total: np.ndarray
    group_distinct: np.ndarray
    classes: np.ndarray
    log_unit: np.ndarray
    log_class: np.ndarray
    listed: int
    groups: int

    @property
    def log_all(self) -> float:
        """log10 of the base model's denominator."""
        return math.log10(self.total + self.distinct + 1)


def tokens(part: pa.RecordBatch, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word codes and groups of a part's texts, each followed by its end, and row offsets."""
    raw, off = in_bytes(part.column("text"))
    raw = LOWER[raw]
    start, end, woff = words(raw, off, "space")
    codes = word_hashes(raw, start, end)
    last = raw[end - 1].astype(U64) if len(end) else np.zeros(0, U64)
    before = np.where(end - start > 1, raw[end - 2], 0).astype(U64) if len(end) else last
    group = (mix(last * U64(256) + before + U64(1)) % U64(groups)).astype(np.int32)
    at = woff[1:]
    new = np.insert(codes, at, END)
    return new, np.insert(group, at, -1), woff + np.arange(len(woff))


def count_words(docs: DataFrame, groups: int) -> DataFrame:
    """(code, grp, c) over all texts, ends included (grp -1); each task adds up before the shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged() -> tuple:
            codes, grp, c = (np.concatenate(x) for x in zip(*held, strict=True))
            out, first, which = np.unique(codes, return_index=True, return_inverse=True)
            return out, grp[first], np.bincount(which, weights=c, minlength=len(out)).astype(np.int64)

        def out() -> pa.RecordBatch:
            codes, grp, c = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(codes)), pa.array(grp, pa.int32()), pa.array(c)], names=["code", "grp", "c"])

        for batch in batches:
            for part in parts(batch, "text"):
                codes, grp, _ = tokens(part, groups)
                one, first, c = np.unique(codes, return_index=True, return_counts=True)
                held.append((one, grp[first], c))
                if sum(len(x[0]) for x in held) > 1_500_000:
                    held[:] = [merged()]
                    if len(held[0][0]) > 1_000_000:
                        yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(scan, "code long, grp int, c long").groupBy("code").agg(F.min("grp").alias("grp"), F.sum("c").alias("c"))


def units_of(codes: np.ndarray, grp: np.ndarray, listed: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Units (0 is the end, then n listed words, then the groups), and the place among the listed codes or -1."""
    units = np.where(grp < 0, 0, 1 + n + grp).astype(np.int32)
    if not len(listed):
        return units, np.full(len(codes), -1)
    there = np.minimum(np.searchsorted(listed, codes), len(listed) - 1)
    there = np.where(listed[there] == codes, there, -1)
    return np.where(there >= 0, unit[there], units), there


def count_pairs(docs: DataFrame, top: np.ndarray, unit: np.ndarray, groups: int) -> np.ndarray:
    """How often each unit follows each unit, the units being the words `top` and the groups; a text begins after an end."""
    k = 1 + len(top) + groups
    sent = docs.sparkSession.sparkContext.broadcast((top, unit))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, dtype=np.int64)
        for batch in batches:
            for part in parts(batch, "text"):
                codes, grp, _ = tokens(part, groups)
                u = units_of(codes, grp, *sent.value, k - 1 - groups)[0].astype(np.int64)
                total += np.bincount(np.concatenate([[0], u[:-1]]) * k + u, minlength=k * k)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["pair", "n"])

    got = docs.select("text").mapInArrow(scan, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(k, k)


def unit_sequences(docs: DataFrame, listed: np.ndarray, unit: np.ndarray, n: int, groups: int) -> DataFrame:
    """(units): the units of some texts after one another; each text ends with an end.  Read in every round, so that texts aren't."""
    sent = docs.sparkSession.sparkContext.broadcast((listed, unit))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", 1_000_000):
                codes, grp, _ = tokens(part, groups)
                u = units_of(codes, grp, *sent.value, n)[0]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(u)], pa.int32()), pa.array(u, pa.int32()))], names=["units"])

    return docs.select("text").mapInArrow(scan, "units array<int>")


def count_neighbours(sequences: DataFrame, of: np.ndarray, classes: int) -> DataFrame:
    """(unit, counts): for each unit that occurs, how often it stands before each class, after each class, and after itself."""
    width, end = 2 * classes + 1, len(of)
    sent = sequences.sparkSession.sparkContext.broadcast(of)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        total = np.zeros(end * width, dtype=np.int32)
        for batch in batches:
            if batch.num_rows:
                # Every sequence ends with an end, so they can follow one another.
                u = batch.column("units").flatten().to_numpy().astype(np.int64)
                last = np.concatenate([[0], u[:-1]])
                np.add.at(total, last * width + of[u], 1)
                np.add.at(total, u * width + classes + of[last], 1)
                np.add.at(total, u[u == last] * width + 2 * classes, 1)
        there = np.flatnonzero(total)
        for at in range(0, len(there), 1_000_000):
            some = there[at : at + 1_000_000]
            yield pa.RecordBatch.from_arrays([pa.array((some // width).astype(np.int32)), pa.array((some % width).astype(np.int16)), pa.array(total[some])], names=["unit", "slot", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple] = []

        def merge() -> None:
            nonlocal keys, sums
            key, n = (np.concatenate(x) for x in zip((keys, sums), *held, strict=True))
            keys, which = np.unique(key, return_inverse=True)
            sums = np.bincount(which, weights=n, minlength=len(keys)).astype(np.int64)
            held.clear()

        for batch in batches:
            held.append((batch.column("unit").to_numpy().astype(np.int64) * width + batch.column("slot").to_numpy(), batch.column("n").to_numpy()))
            # Now and then, lest what is known be sorted for each batch.
            if sum(len(k) for k, _ in held) > max(500_000, len(keys)):
                merge()
        merge()
        units, row = np.unique(keys // width, return_inverse=True)
        for at in range(0, len(units), 10_000):
            mine = (row >= at) & (row < at + 10_000)
            counts = np.zeros((min(10_000, len(units) - at), width), dtype=np.int64)
            counts[row[mine] - at, keys[mine] % width] = sums[mine]
            yield pa.RecordBatch.from_arrays([pa.array(units[at : at + 10_000].astype(np.int32)), pa.array([c.tobytes() for c in counts], pa.binary())], names=["unit", "counts"])

    tasks = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sequences.mapInArrow(scan, "unit int, slot short, n int").repartition(tasks, "unit").mapInArrow(meet, "unit int, counts binary")


def class_table(counts: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """How often each class follows each class, from count_neighbours()."""
    sent = counts.sparkSession.sparkContext.broadcast(of)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, classes), dtype=np.int64)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("counts").to_pylist()), dtype=np.int64).reshape(-1, 2 * classes + 1)
            np.add.at(total, sent.value[batch.column("unit").to_numpy()], x[:, :classes])
        yield pa.RecordBatch.from_arrays([pa.array(range(classes * classes), pa.int32()), pa.array(total.ravel())], names=["pair", "n"])

    got = counts.mapInArrow(scan, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes * classes)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(classes, classes)


def exchanged(counts: DataFrame, of: np.ndarray, table: np.ndarray, least: float) -> np.ndarray:
    """The units' best classes, each as if it alone moved."""
    sent = counts.sparkSession.sparkContext.broadcast((of, table))
    classes = len(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, table = sent.value
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("counts").to_pylist()), dtype=np.int64).reshape(-1, 2 * classes + 1).astype(float)
            units = batch.column("unit").to_numpy()
            to = [best_class(table, of[u], c[:classes], c[classes:-1], c[-1], least)[0] for u, c in zip(units.tolist(), x, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(to, pa.int32())], names=["unit", "to"])

    got = counts.mapInArrow(scan, "unit int, to int").toArrow()
    out = of.copy()
    out[got.column("unit").to_numpy()] = got.column("to").to_numpy()
    return out


def refined(docs: DataFrame, listed: np.ndarray, unit: np.ndarray, n: int, of: np.ndarray, groups: int, classes: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The units' classes after rounds of exchange over all text, and how often each class follows each."""
    best = None
    sequences = kept(unit_sequences(docs, listed, unit, n, groups))
    while True:
        counts = kept(count_neighbours(sequences, of, classes))
        table = class_table(counts, of, classes)
        now = likelihood(table)
        gain = np.inf if best is None else now - best[0]
        if gain > 0:
            best = (now, of, table)
        moved = of if gain <= tolerance * table.sum() else exchanged(counts, of, table, rounding(table))
        discard(counts)
        if (moved == of).all():
            discard(sequences)
            return best[1:]
        of = moved


def likelihood(table: np.ndarray) -> float:
    """What the classes share in the log-likelihood of the text."""
    return float(xlogx(table).sum() - xlogx(table.sum(axis=0)).sum() - xlogx(table.sum(axis=1)).sum())


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def rounding(table: np.ndarray) -> float:
    """What a move must gain, lest units move to and fro by the sums' rounding."""
    return max(1e-6, 1e-12 * float(xlogx(table.sum())))


def best_class(table: np.ndarray, was: int, after: np.ndarray, before: np.ndarray, own: float, least: float) -> tuple[int, np.ndarray]:
    """The class where a unit, now in `was`, makes the class-pair likelihood highest, and the table that this makes.

    after, before: how often the unit stands before and after each class, itself included `own` times.
    """
    out, into = after.copy(), before.copy()
    out[was] -= own
    into[was] -= own
    base = table.copy()
    base[was, :] -= out
    base[:, was] -= into
    base[was, was] -= own
    # What the unit's neighbours add to the sums stays wherever it goes.
    rows, columns = base.sum(axis=1) + into, base.sum(axis=0) + out
    gain = xlogx(base + out[None, :]).sum(axis=1) - xlogx(base).sum(axis=1)
    gain += xlogx(base + into[:, None]).sum(axis=0) - xlogx(base).sum(axis=0)
    d = np.diag(base)
    gain += xlogx(d + out + into + own) - xlogx(d + out) - xlogx(d + into) + xlogx(d)
    n_out, n_in = out.sum() + own, into.sum() + own
    gain -= xlogx(rows + n_out) - xlogx(rows) + xlogx(columns + n_in) - xlogx(columns)
    # the others' sums don't depend on where the unit goes
    to = int(gain.argmax())
    if gain[to] <= gain[was] + least:
        to = int(was)
    base[to, :] += out
    base[:, to] += into
    base[to, to] += own
    return to, base


def exchange(pairs: np.ndarray, classes: int, rounds: int | None = None) -> np.ndarray:
    """Classes of units by exchange clustering: each unit in turn, most frequent first, moves to the
    class where the class-pair likelihood of the training text is highest, until none moves (or for
    `rounds` rounds)."""
    k = len(pairs)
    weight = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-weight, kind="stable")
    of = np.empty(k, dtype=np.int64)
    of[order] = np.arange(k) % classes
    member = np.zeros((k, classes))
    member[np.arange(k), of] = 1
    after, before = pairs @ member, pairs.T @ member  # unit -> class, class -> unit
    table = member.T @ after
    least = rounding(pairs)
    for _ in count() if rounds is None else range(rounds):
        moved = 0
        for w in order:
            if weight[w] == 0:
                break
            was = of[w]
            to, table = best_class(table, was, after[w], before[w], pairs[w, w], least)
            if to != was:
                moved += 1
                after[:, was] -= pairs[:, w]
                after[:, to] += pairs[:, w]
                before[:, was] -= pairs[w, :]
                before[:, to] += pairs[w, :]
                of[w] = to
        if not moved:
            break
    return of


def smoothed(table: np.ndarray, units: np.ndarray, of: np.ndarray, strength: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """log10 of P(class | class before), backed by P(class), and of P(unit | class), plus one; units: how often each occurs."""
    alone = (table.sum(axis=0) + 1) / (table.sum() + len(table))
    step = (table + strength * alone[None, :]) / (table.sum(axis=1, keepdims=True) + strength)
    n = units + 1.0
    return np.log10(step), np.log10(n / np.bincount(of, weights=n, minlength=len(table))[of])


def fit(docs: DataFrame, text: str = "text", frequent: int = FREQUENT, groups: int = GROUPS, classes: int = CLASSES, listed: int = LISTED, tolerance: float = TOLERANCE) -> tuple[Model, DataFrame]:
    """The model of all rows' texts (null: empty), and the table (code, grp, c) of all their words."""
    bounded(docs.sparkSession)
    docs = docs.select(F.col(text).alias("text"))
    counts = kept(count_words(docs, groups))
    # The least count at which at most `listed` words are listed, from a histogram of bounded size.
    eighth = F.floor(F.log2("c") * 8).cast("int")
    histogram = {r.b: r.n for r in counts.groupBy(eighth.alias("b")).agg(F.count("*").alias("n")).collect()}
    bins, room = max(histogram, default=0) + 1, listed
    for b in sorted(histogram, reverse=True):
        room -= histogram[b]
        if room < 0:
            break
        bins = b
    rows = counts.where((eighth >= bins) | (F.col("grp") < 0)).toArrow()
    codes, grp, c = (rows.column(x).to_numpy() for x in ("code", "grp", "c"))
    codes = codes.view(U64)
    place = np.argsort(codes)
    codes, grp, c = codes[place], grp[place], c[place]
    word = grp >= 0
    n = int(word.sum())
    unit = np.where(word, np.cumsum(word), 0).astype(np.int32)
    by = counts.groupBy("grp").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    group_total, group_distinct, ends = np.zeros(groups), np.zeros(groups), 0
    for r in by:
        if r.grp >= 0:
            group_total[r.grp], group_distinct[r.grp] = r.c, r.v
        else:
            ends = r.c
    total, distinct = sum(r.c for r in by), sum(r.v for r in by)
    np.subtract.at(group_total, grp[word], c[word])
    np.subtract.at(group_distinct, grp[word], 1)
    # The most frequent words first; any other word begins in the class of its group.
    best = np.flatnonzero(word)[np.lexsort((codes[word], -c[word]))][:frequent]
    best = np.sort(best)
    core = exchange(count_pairs(docs, codes[best], np.arange(1, len(best) + 1, dtype=np.int32), groups), classes)
    first = core[1 + len(best) + grp[word]]
    first[unit[best] - 1] = core[1 : 1 + len(best)]
    of = np.concatenate([core[:1], first, core[1 + len(best) :]])
    of, table = refined(docs, codes, unit, n, of, groups, classes, tolerance)
    log_class, log_unit = smoothed(table, np.concatenate([[ends], c[word], group_total]), of)
    return Model(codes, c, unit, bins, int(total), int(distinct), group_total, group_distinct, of, log_unit, log_class, n, groups), counts


def lookup(model: Model, codes: np.ndarray, grp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: is it listed, its count (0 if not), its unit."""
    units, there = units_of(codes, grp, model.codes, model.units, model.listed)
    known = there >= 0
    return known, np.where(known, model.counts[there], 0) if len(model.codes) else np.zeros(len(codes), np.int64), units


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs' rows, without the text, with n_tokens, n_known, base_score and score (both log10 of the text's probability).

    A null text counts as empty: only its end is scored.  Words beyond the listed
    ones meet their counts in a join; only (code, document, times) crosses the network.
    Rows that agree in id and text get the same scores; columns of these four names are replaced, all others
    stay as they are, whatever their names.  A text or a word of any length is scored as a whole; an empty table gives none.
    """
    spark = bounded(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    added = ("n_tokens", "n_known", "base_score", "score")
    docs = docs.drop(*added)
    source, unique = identified(docs.withColumn("__all", F.struct(*docs.columns)), doc_id, text, ("__all",))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        before_group = 1 + m.listed
        for batch in batches:
            for part in parts(batch, "text"):
                codes, grp, toff = tokens(part, m.groups)
                known, c, unit = lookup(m, codes, grp)
                base = np.log10(c + 1.0) - m.log_all
                cls = m.classes[unit]
                last = np.concatenate([[m.classes[0]], cls[:-1]])
                own = m.log_class[last, cls] + m.log_unit[unit]
                g = unit - before_group
                inside = g >= 0
                own[inside] += np.log10(c[inside] + 1.0) - np.log10(m.group_total[g[inside]] + m.group_distinct[g[inside]] + 1)
                sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[toff]) for x in (known & (c > 0), base, own)]
                new = [pa.array(np.diff(toff)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("th"), part.column("__all"), *new], names=["doc", "th", "__all", *added])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        for batch in batches:
            for part in parts(batch, "text"):
                codes, grp, toff = tokens(part, m.groups)
                known = lookup(m, codes, grp)[0]
                row = np.repeat(np.arange(part.num_rows), np.diff(toff))[~known]
                codes = codes[~known]
                order = np.lexsort((codes, row))
                codes, row = codes[order], row[order]
                new = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])])) if len(codes) else np.zeros(0, np.int64)
                at = pa.array(row[new])
                yield pa.RecordBatch.from_arrays([pa.array(signed(codes[new])), part.column("doc").take(at), part.column("th").take(at), pa.array(np.diff(np.append(new, len(codes))), pa.int32())], names=["code", "doc", "th", "times"])

    once = source.select("doc", "th", "text")
    if not unique:
        once = once.dropDuplicates(["doc", "th"])
    known_rare = counts.where(F.floor(F.log2("c") * 8).cast("int") < model.least).select("code", "c")
    met = once.mapInArrow(rare, "code long, doc long, th long, times int").join(known_rare, "code")
    more = met.groupBy("doc", "th").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("log_more"))
    slim = source.select("doc", "th", "text", F.col("__all").dropFields(text).alias("__all")) if len(docs.columns) > 1 else source
    kinds = slim.select("doc", "th", "__all", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score")).schema
    mine = slim.mapInArrow(local, kinds)
    return mine.join(more, ["doc", "th"], "left").select(
        "__all.*",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("log_more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("log_more", F.lit(0.0))).alias("score"),
    )


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 7)
    model, counts = fit(docs.where(~out))
    scored = score(docs, model, counts)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
