import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import packing as P

from .common import corpus, table, thue_morse

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def best_fit(lengths, capacity):
    """One item at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in range(len(gaps)) if gaps[g] >= n]
        if fits:
            gaps[min(fits, key=lambda g: gaps[g])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def by_sweeps(spark, lengths, capacity):
    """The number of sequences; all of them are filled without gaps and none beyond the capacity."""
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "row long, length long").withColumn("nth", F.col("row"))
    got = P.place(rows, capacity).collect()
    assert sorted((r.nth, r.length) for r in got) == list(enumerate(lengths))
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        at = 0
        for off, n in sorted(x):
            assert off == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize(("capacity", "last", "swept"), [(1, 2000, 200_000), (200, 2000, 200_000), (50, 20, 30), (2048, 3, 40), (2048, 10, 200_000)])
def test_supersteps_against_best_fit(spark, monkeypatch, capacity, last, swept):
    """With the last documents one by one, as many sequences as by best fit; with sweeps over several ranges to the end, too."""
    monkeypatch.setattr(P, "LAST", last)
    monkeypatch.setattr(P, "SWEPT", swept)
    r = random.Random(capacity + last)
    lengths = [min(capacity, 1 + int(r.expovariate(5 / capacity))) for _ in range(260)]
    assert by_sweeps(spark, lengths, capacity) <= best_fit(lengths, capacity)


def test_brackets():
    r = random.Random(1)
    for _ in range(300):
        gap = np.array([r.random() < 0.5 for _ in range(r.randrange(1, 40))])
        want, stack = [], []
        for k, g in enumerate(gap):
            if g:
                stack.append(k)
            elif stack:
                want.append((k, stack.pop()))
        assert sorted(zip(*(x.tolist() for x in P.bracket_matches(gap)))) == sorted(want)
        # The same in ranges, of which each leaves what the others then match.
        cuts = sorted(r.sample(range(len(gap) + 1), 2)) if len(gap) > 1 else [0, 0]
        left, found = [], []
        for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(gap)])):
            d, g = P.bracket_matches(gap[a:b]) if b > a else (np.zeros(0, int),) * 2
            found += list(zip((d + a).tolist(), (g + a).tolist()))
            free = [k for k in range(a, b) if k - a not in {*d.tolist(), *g.tolist()}]
            left.append((part, [k for k in free if not gap[k]], [k for k in free if gap[k]]))
        docs, gaps = ({p: x[i] for p, *x in left} for i in (0, 1))
        for p, first, end, other, at in P.by_rank([(p, len(d), len(g)) for p, d, g in left]):
            found += [(docs[p][first + k], gaps[other][at - k]) for k in range(end - first)]
        assert sorted(found) == sorted(want)


def check(got, texts, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    want = []
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            cut = ids[k : k + capacity]
            want.append((i, k // capacity, k, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        at = 0
        for off, n in sorted(x):
            assert off == at
            at += n
        assert at <= capacity
    assert len(by) <= best_fit([w[3] for w in want], capacity)


def test_tokens_and_places(spark):
    odd = ["don't STOP<|endoftext|>now", "étude  x y\u0085z", "ΣΑΣ İstanbul ﬁ", "a\x00b\x1c c", "'s 't 12 345 $$$ ###", "日本語 テスト　です", "́ x ́", "a≠b (c)d,e.f;G\u2605h \u2605 i★★", "<|STARTOFTEXT|> THE <|startoftext|>.x", "x.'s .'S a'b'c ''t", "A\u0301.B é,È;"]
    texts = [*corpus(9, n=50), *odd]
    check(P.pack(table(spark, texts), PATH, 100).collect(), texts, 100)


def test_fragments_of_random_texts():
    from tokenizers import Tokenizer

    from lodestone.llm.arrays import word_hashes

    t, known = Tokenizer.from_file(PATH), P.KnownTokens(PATH)
    r = random.Random(1)
    alphabet = [*"abZ019.,'s!?<|>()$=_- \n\t", "́", "̸", "é", "ſ", "K", "\u2605", "日", "٣", "\u00a0", "\x1c", "\x85", "don't", "<|endoftext|>", "İ"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(4000)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x.encode()) for x in texts])]).astype(np.int64)
    start, end, foff = P.fragments(raw, off)
    ids, size = known.of(raw, start, end, word_hashes(raw, start, end))
    toff = np.concatenate([[0], np.cumsum(size)])[foff]
    for k, x in enumerate(texts):
        assert ids[toff[k] : toff[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_query(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    check(P.op5_packing(spark, "/root/testdata/sf0.001").collect(), texts, 2048)


def test_long_and_confusing_texts(spark):
    x, y = thue_morse(10)
    texts = [x, y, f"{x} {y}", "word " * 60_000, *[""] * 300]
    check(P.pack(table(spark, texts).selectExpr("*", "1 as row", "2 as seq", "3 as length"), PATH, 2048).collect(), texts, 2048)


def test_repeated_and_empty(spark):
    docs = table(spark, ["a b c", None])
    twice = docs.union(docs).union(docs.selectExpr("cast(null as long)", "text", "lang", "source", "n_chars", "row_id"))
    got = P.pack(twice, PATH, with_ids=True).collect()
    assert len(got) == 6 and len({(r.sequence_id, r.offset) for r in got}) == 6
    assert {tuple(r.ids[-1:]) for r in got} == {(0,)}
    assert P.pack(docs.limit(0), PATH).count() == 0
