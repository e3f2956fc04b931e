"""Language identification by rank-order profiles and out-of-place distance.

A text is a sequence of letter symbols (a to z in either case, other characters by
their UTF-8 bytes, folded, so that such a letter is two or three symbols) in which each run of
anything else, the punctuation and spaces beyond ASCII among it, is one boundary.  Its
profile is the list of its most frequent 1- to 3-grams, most frequent first; its
distance to a language's profile is how far each gram is out of its place there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import in_bytes, parts
from .session import bounded, read

#: Symbols: 0 is the boundary, 1 to 26 the letters, the rest are bytes from 0x80, folded.
SYMBOLS = 64
SIZE = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
#: Grams in a profile.
PROFILE = 400


def symbol_table() -> np.ndarray:
    t = np.zeros(256, dtype=np.int32)
    for k in range(26):
        t[0x41 + k] = t[0x61 + k] = k + 1
    t[0x80:] = 27 + (np.arange(128) * 29) % (SYMBOLS - 27)
    return t


def symbols_of(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The symbols of UTF-8 bytes.  U+0080 to U+00BF, U+2000 to U+207F and U+3000 to U+303F (controls, spaces and
    punctuation, hardly any letter) are boundaries."""
    out = table[raw]
    after = np.append(raw[1:], 0)
    for at, width in ((np.flatnonzero(raw == 0xC2), 2), (np.flatnonzero((raw == 0xE2) & ((after == 0x80) | (after == 0x81))), 3), (np.flatnonzero((raw == 0xE3) & (after == 0x80)), 3)):
        for k in range(width):
            out[np.minimum(at + k, len(out) - 1)] = 0
    return out


def grams(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 1- to 3-grams of one text's symbols, and their counts."""
    c = np.concatenate([[0], symbols, [0]]).astype(np.int32)
    c = c[np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)])]
    pair = c[:-1] * SYMBOLS + c[1:]
    codes = np.concatenate([c[c > 0], SYMBOLS + pair, SYMBOLS + SYMBOLS**2 + pair[:-1] * SYMBOLS + c[2:]])
    if len(codes) < 6000:
        return np.unique(codes, return_counts=True)
    count = np.bincount(codes, minlength=SIZE)
    there = np.flatnonzero(count)
    return there, count[there]


def ranked(codes: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    key = count.astype(np.int64) * (1 << 20) + ((1 << 20) - 1 - codes)
    if len(key) > most:
        best = np.argpartition(key, len(key) - most)[-most:]
        codes, key = codes[best], key[best]
    return codes[np.argsort(-key)]


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (text, lang); each task adds up before the shuffle."""
    bounded(labelled.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = symbol_table(), {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, total in sums.items():
                there = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array(total[there])], names=["lang", "gram", "n"])
            sums.clear()

        for batch in batches:
            for part in parts(batch, "text"):
                raw, off = in_bytes(part.column("text"))
                symbols = symbols_of(raw, table)
                for k, lang in enumerate(part.column("lang").to_pylist()):
                    if lang not in sums:
                        if len(sums) >= 32:
                            yield from out()
                        sums[lang] = np.zeros(SIZE, dtype=np.int64)
                    codes, count = grams(symbols[off[k] : off[k + 1]])
                    sums[lang][codes] += count
        yield from out()

    return labelled.select("text", "lang").mapInArrow(scan, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", profile: int = PROFILE) -> dict[str, np.ndarray]:
    """A profile for each language among the labelled rows, from all their texts.

    Rows without text or label teach nothing.  What comes to the driver is
    `profile` grams for each distinct label.
    """
    counts = count_grams(docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull()))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.where(F.col("gram") > 0).withColumn("place", place).where(F.col("place") <= profile)
    out: dict[str, np.ndarray] = {}
    for r in best.select("lang", "gram", "place").collect():
        out.setdefault(r.lang, np.full(SIZE, profile, dtype=np.int32))[r.gram] = r.place - 1
    return {k: out[k] for k in sorted(out)}


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", profile: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score: 1 less the distance to the nearest profile as a share of the
    largest possible one.  A text that is null or has no letter, and any text if there
    are no profiles, is `und` with score 0; equal distances go to the first label in order.  Columns named
    lang_pred or score are replaced, all others stay; repeated rows are judged alike, and texts of any length as a whole."""
    bounded(docs.sparkSession)
    if {"lang_pred", "score"} & set(docs.columns):
        docs = docs.drop("lang_pred", "score")
    langs = list(profiles)
    sent = docs.sparkSession.sparkContext.broadcast({k: (np.flatnonzero(v < profile), v[v < profile]) for k, v in profiles.items()})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table()
        places = np.full((len(langs), SIZE), profile, dtype=np.int32)
        for k, (codes, place) in enumerate(sent.value.values()):
            places[k, codes] = place
        for batch in batches:
            for part in parts(batch, text):
                column = part.column(text)
                raw, off = in_bytes(column)
                symbols = symbols_of(raw, table)
                preds, scores = [], []
                for k in range(part.num_rows):
                    own = symbols[off[k] : off[k + 1]]
                    sure = bool(((own > 0) & (own < 27)).any())
                    if not langs or not (sure or has_letter(column[k].as_py() or "")):
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    mine = ranked(*grams(own), profile)
                    if not len(mine):  # a letter that counts as a boundary, as \u00aa does
                        preds.append(langs[0])
                        scores.append(0.0)
                        continue
                    far = places[:, mine]
                    distance = np.where(far < profile, np.abs(far - np.arange(len(mine))), profile).sum(axis=1)
                    best = int(distance.argmin())
                    preds.append(langs[best])
                    scores.append(float(1 - distance[best] / (profile * len(mine))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.mapInArrow(scan, schema)


def held_out(column, parts_of: int):
    """The fixed share of documents that no model learns from."""
    return F.coalesce(F.crc32(column.cast("string")) % parts_of == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4)
    profiles = fit(docs.where(~out & F.col("doc_id").isNotNull()))
    return predict(docs.select("doc_id", "text"), profiles).select("doc_id", out.alias("held_out"), "lang_pred", "score")
