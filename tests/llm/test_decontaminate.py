import hashlib
import re

import pytest

from lodestone.llm import decontaminate as D

from .common import corpus, rows, table, thue_morse

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(texts, items, window=13):
    out = []
    for i, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for item, text in items:
            v = split(text)
            for s in range(max(1, len(v) - window + 1)) if v else ():
                piece = v[s : s + window]
                for a in range(len(w) - len(piece) + 1):
                    if w[a : a + len(piece)] == piece:
                        hit |= set(range(a, a + len(piece)))
                        found.add(item)
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = corpus(seed, n=50, longest=60)
    long_ones = [t for t in texts if t and len(t.split()) > 30]
    items = [(3, long_ones[0]), (11, long_ones[1][30:200]), (2, "Ü5É!w1"), (20, "w3, W4"), (5, None), (6, ""), (7, "w7"), (8, long_ones[0])]
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows(D.report(table(spark, texts), b), *COLUMNS) == brute(texts, items)


def test_blocks_agree(spark):
    texts = corpus(3, n=40, longest=60)
    items = [(i, t) for i, t in enumerate(texts[10:20])]
    b = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, texts)
    one, many = D.matches(docs, b), D.matches(docs, b, block_bytes=400)
    key = lambda df: sorted((r["doc_id"], r["n_words"], r["hits"], sorted(r["items"]), r["match_len"]) for r in df.collect())
    assert key(one) == key(many)
    assert rows(D.remove(docs, b), "doc_id") == rows(D.remove(docs, b, block_bytes=400), "doc_id")
    bad = {r[0] for r in brute(texts, items) if r[2]}
    assert {r.doc_id for r in D.remove(docs, b).collect()} == set(range(len(texts))) - bad
    assert D.remove(docs, b).columns == docs.columns


def test_longest_match_and_place(spark):
    words = [f"x{i}" for i in range(40)]
    docs = table(spark, ["a b " + " ".join(words[5:30]) + " z"])
    got = D.matches(docs, spark.createDataFrame([(4, " ".join(words))], "item_id long, text string")).first()
    assert (got.match_item, got.match_item_word, got.match_word, got.match_len) == (4, 5, 2, 25)


def test_repeated_words_and_long_ones(spark):
    """A word that item and text repeat; words that differ in what sums of powers don't see; a long text."""
    x, y = thue_morse(10)
    texts = [" ".join(["go"] * 30_000), x, y, " ".join([y] * 14), "q " * 5 + " ".join(f"n{i}" for i in range(400_000)), " ".join(f"n{i}" for i in range(399_980, 399_999))]
    items = [(1, " ".join(["go"] * 300)), (2, x), (3, " ".join([x] * 13)), (4, " ".join(f"n{i}" for i in range(399_985, 399_998)))]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (len(r.hits), list(r["items"]), r.match_len) for r in D.matches(table(spark, texts), b).collect()}
    assert got == {0: (30_000, [1], 300), 1: (1, [2], 1), 2: (0, [], None), 3: (0, [], None), 4: (13, [4], 13), 5: (13, [4], 13)}


def test_repeated_rows_nulls_and_clashing_names(spark):
    b = spark.createDataFrame([(None, "one two"), (2, None), (3, "...")], "item_id long, text string")
    docs = table(spark, ["so one, two", None, "one"]).selectExpr("doc_id", "text", "1 as hits", "2 as n_words", "'x' as match_len")
    twice = docs.union(docs)
    assert rows(D.report(twice, b), "doc_id", "n_words", "n_hit", "n_items") == sorted(2 * [(0, 3, 2, 1), (1, 0, 0, 0), (2, 1, 0, 0)])
    left = D.remove(twice, b)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 1, 2, 2]
    assert sorted(r.doc_id for r in D.remove(twice, b, least_share=0.9).collect()) == [0, 0, 1, 1, 2, 2]


def test_empty_tables(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    docs = table(spark, ["some words here", None])
    assert [r.n_hit for r in D.report(docs, b).collect()] == [0, 0]
    assert D.report(docs.limit(0), b).count() == 0
