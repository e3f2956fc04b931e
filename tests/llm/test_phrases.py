import collections
import hashlib

import numpy as np
import pytest

from lodestone.llm import phrases as P

from .common import corpus, rows, table, thue_morse


def brute(texts, k):
    plain = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[a : a + k] for t in plain for a in range(len(t) - k + 1))
    out = []
    for i, t in enumerate(plain):
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - k + 1):
            if seen[t[a : a + k]] > 1:
                gone[a : a + k] = True
        runs = sum(gone[j] and (j == 0 or not gone[j - 1]) for j in range(len(t)))
        out.append((i, len(t), int(gone.sum()), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize(("seed", "k", "spacing", "block"), [(1, 400, 48, 64), (3, 24, 5, 7), (4, 30, 1000, 8)])
def test_against_brute_force(spark, seed, k, spacing, block):
    texts = [*corpus(seed, n=40, longest=90), "a" * 700, "b" * 390 + "a" * 450, "ab" * 300, "xyz" + "ab" * 220]
    got = rows(P.remove_repeats(table(spark, texts), k, spacing, block), "doc_id", "n_bytes", "n_removed", "n_spans", "body")
    assert [(*g[:4], bytes(g[4])) for g in got] == brute(texts, k)
    short = rows(P.remove_repeats(table(spark, texts), k, spacing, block, k // 2), "doc_id", "n_bytes", "n_removed", "n_spans", "body", "n_repeated")
    assert [(*g[:4], bytes(g[4])) for g in short] == brute(texts, k)
    assert [g[5] for g in short] == [b[2] for b in brute(texts, k // 2)]


def test_query_digest(spark):
    got = rows(P.op10_phrase_dedup(spark, "/root/testdata/sf0.001"), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    assert got == [(*b[:4], hashlib.sha256(b[4]).hexdigest()) for b in brute([t for _, t in docs], 400)]
    assert sum(g[2] for g in got) > 0


def test_strings_that_sums_of_powers_confuse(spark):
    x, y = thue_morse(9)
    assert rows(P.remove_repeats(table(spark, [x, y, "c" + x]), 512), "doc_id", "n_removed") == [(0, 512), (1, 0), (2, 512)]


def test_long_texts_and_clashing_names(spark):
    docs = table(spark, ["long " * 200_000, "a" * 1_000_000, "b" * 400, *[""] * 500]).selectExpr("doc_id", "text", "1 as key", "2 as n_spans", "3 as e")
    got = rows(P.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans")
    assert got[:3] == [(0, 1_000_000, 1_000_000, 1), (1, 1_000_000, 1_000_000, 1), (2, 400, 0, 0)] and len(got) == 503


def test_repeated_rows_and_ids(spark):
    docs = table(spark, ["q" + "".join(chr(97 + (i * i) % 23) for i in range(500)), "short", None])
    twice = docs.union(docs)
    got = rows(P.remove_repeats(twice), "doc_id", "n_removed")
    assert [g[0] for g in got] == [0, 0, 1, 1, 2, 2] and got[0] == got[1]
    assert P.remove_repeats(docs.limit(0)).count() == 0
