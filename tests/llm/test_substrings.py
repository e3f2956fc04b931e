import hashlib
import re

import numpy as np
import pytest

from lodestone.llm import substrings as S

from .common import corpus, rows, table, thue_morse


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(texts, k):
    seen, out = set(), []
    for i, t in enumerate(texts):
        w, gone = split(t), set()
        for a in range(len(w) - k + 1):
            piece = tuple(w[a : a + k])
            if piece in seen:
                gone |= set(range(a, a + k))
            seen.add(piece)
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize(("seed", "k", "mer", "vocabulary"), [(1, 20, 8, 40), (2, 20, 8, 2), (3, 6, 3, 3)])
def test_against_brute_force(spark, seed, k, mer, vocabulary):
    texts = corpus(seed, n=50, vocabulary=vocabulary, longest=90)
    got = rows(S.remove_repeats(table(spark, texts), k, mer), "doc_id", "n_words", "n_removed", "text")
    assert got == brute(texts, k)


def test_query_digest(spark):
    got = rows(S.op6_substring_dedup(spark, "/root/testdata/sf0.001"), "doc_id", "n_words", "n_removed", "kept_sha256")
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    assert got == [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute([t for _, t in docs], 20)]


def test_repeated_rows_and_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = table(spark, [text, "x " + text, None])
    twice = docs.union(docs)
    got = rows(S.remove_repeats(twice), "doc_id", "n_removed")
    assert got == [(0, 0), (0, 0), (1, 30), (1, 30), (2, 0), (2, 0)]
    same = docs.selectExpr("cast(null as long) as doc_id", "text", "lang")
    assert sorted(r.n_removed for r in S.remove_repeats(same).collect()) == [0, 0, 30]
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_words_that_sums_of_powers_confuse(spark):
    x, y = thue_morse(10)
    texts = [" ".join([x, *"abcdefghijklmnopqrst"]), " ".join([y, *"abcdefghijklmnopqrs"]), " ".join([x, *"abcdefghijklmnopqrs"])]
    assert rows(S.remove_repeats(table(spark, texts)), "doc_id", "n_removed") == [(0, 0), (1, 0), (2, 20)]


def test_paths_end_with_texts_and_branch(spark):
    """Passages at the very start and end of texts, inside others, and cut short."""
    w = [f"p{i}" for i in range(60)]
    join = lambda *x: " ".join(y for z in x for y in z)
    texts = [join(w), join(w), join(["a"], w), join(w, ["b"]), join(["c"], w[5:50], ["d"]), join(w[:30]), join(w[30:]), join(w[:40], w[20:]), join(w[10:31], ["e"], w[10:31])]
    got = rows(S.remove_repeats(table(spark, texts)), "doc_id", "n_words", "n_removed", "text")
    assert got == brute(texts, 20)


def test_long_texts_and_clashing_names(spark):
    many = " ".join(f"m{i}" for i in range(300_000))
    docs = table(spark, [many, "x" * 1_000_000, "go " * 100_000, "tail " + many, *[""] * 500]).selectExpr("doc_id", "text", "1 as a", "2 as key", "3 as stretches", "4 as n_removed")
    got = rows(S.remove_repeats(docs), "doc_id", "n_words", "n_removed")
    assert got[:4] == [(0, 300_000, 0), (1, 1, 0), (2, 100_000, 99_999), (3, 300_001, 300_000)] and len(got) == 504


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 50, 40)
    for w in range(1, 20):
        assert S.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(41 - w)]
