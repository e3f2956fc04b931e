import random
import re

import numpy as np
import pytest

from lodestone.llm import jaccard as J
from lodestone.llm.components import components

from .common import corpus, rows, table, thue_morse


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    s = [shingles(t) for t in texts]
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(s[i]), find(i)) for i in range(len(s))]


def edited(seed, n=70, size=60):
    """Chains and clusters of edited copies around the threshold."""
    r = random.Random(seed)
    make = lambda k: [f"v{r.randrange(5000)}" for _ in range(k)]
    out = [" ".join(make(size)) for _ in range(4)]
    passage = " ".join(make(30))
    while len(out) < n:
        w = out[r.randrange(len(out))].split()
        for _ in range(r.choice([0, 1, 1, 2, 2, 3])):
            w[r.randrange(len(w))] = f"e{r.randrange(5000)}"
        w += make(r.choice([0, 0, 1, 6]))
        out.append(" ".join(w))
        if r.random() < 0.2:
            out.append(passage + " " + " ".join(make(r.choice([3, 10, 60]))))
    return out


@pytest.mark.parametrize(("seed", "frequent", "held", "points"), [(1, 200, J.HELD, J.POINTS_HELD), (3, 1, 200, J.POINTS_HELD), (4, 200, 500, 4000)])
def test_components_against_brute_force(spark, monkeypatch, seed, frequent, held, points):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "HELD", held)
    monkeypatch.setattr(J, "POINTS_HELD", points)
    texts = [*corpus(seed, n=40, longest=40), *edited(seed)]
    docs = table(spark, texts)
    got = sorted((r.doc, r.n, r.root.doc) for r in J.linked(docs).collect())
    assert got == brute(texts)
    want = {c for _, _, c in brute(texts)}
    assert {r.doc_id for r in J.deduplicated(docs).collect()} == want
    assert J.deduplicated(docs).columns == docs.columns


def test_tree_finds_all_within_bound():
    r = np.random.default_rng(3)
    v = r.poisson(3, (500, 16)).astype(np.uint16)
    v[100:200] = v[:100]
    v[100:200, 0] += 1
    n = v.sum(axis=1).astype(np.int64)
    t = J.CountTree(v, n)
    for q in range(0, 500, 7):
        bound = np.minimum(v, v[q]).sum(axis=1)
        want = np.flatnonzero((bound * 7 >= 3 * (n + n[q])) & (3 * n <= 4 * n[q]) & (3 * n[q] <= 4 * n))
        assert sorted(t.search(v[q], int(n[q]), 3, 4).tolist()) == want.tolist()


def test_points_bound_from_above():
    r = np.random.default_rng(5)
    for n in (0, 1, 7, 900, 5000):
        h = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        fine = J.grouped(h, J.finest(len(h), 128))
        assert fine.sum() == len(h) and (J.folded(fine, 128) == J.grouped(h, 128)).all()
        assert (J.decoded(J.coded(fine)) == fine).all()
    big = np.array([3, 700, 70000, 0])
    assert (J.decoded(J.coded(big)) >= big).all() and J.decoded(J.coded(big))[3] == 0


def test_query(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    assert rows(J.op7_jaccard_join(spark, "/root/testdata/sf0.001"), "doc_id", "n_shingles", "component_id") == brute(texts)


def test_chain_of_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    df = spark.createDataFrame([((a, 0), (b, 0)) for a, b in edges], "u struct<doc:long,th:long>, v struct<doc:long,th:long>")
    got = {r.u.doc: r.root.doc for r in components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def near_copies(seed, n, size=80):
    """A large group of near copies, of which many aren't alike to the first one but to others."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
            w[r.randrange(size)] = f"x{r.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return [" ".join(base[: size // 2] + [f"y{i}" for i in range(size // 2)]), *out]


def test_links_are_linear_in_a_large_group(spark, monkeypatch):
    """With each gathering in one task and in several."""
    texts = near_copies(5, 150)
    want = brute(texts)
    for held in (J.HELD, 2000):
        monkeypatch.setattr(J, "HELD", held)
        docs, _ = J.identified(table(spark, texts))
        links, members = J.links_and_classes(docs)
        assert links.count() < 8 * len(texts)
        assert sorted((r.doc, r.n, r.root.doc) for r in J.linked(table(spark, texts)).collect()) == want


def test_words_that_sums_of_powers_confuse(spark):
    x, y = thue_morse(10)
    texts = [x, y, f"a b c d {x}", f"a b c d {y}", x]
    assert sorted((r.doc, r.n, r.root.doc) for r in J.linked(table(spark, texts)).collect()) == [(0, 1, 0), (1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 0)]


def test_long_texts(spark):
    """A text of some megabytes, its near copy, one long word, and one word many times."""
    r = random.Random(1)
    w = [f"t{r.randrange(10 ** 7)}" for _ in range(300_000)]
    texts = [" ".join(w), " ".join(w[:150_000] + ["new"] + w[150_000:]), "z" * 1_000_000, "z" * 1_000_001, "go " * 100_000, "go " * 5, " ".join(w[:150_000])]
    got = sorted((r.doc, r.n, r.root.doc) for r in J.linked(table(spark, texts)).collect())
    assert [g[2] for g in got] == [0, 0, 2, 3, 4, 4, 6] and [g[1] for g in got[2:6]] == [1, 1, 1, 1]


def test_repeated_and_empty(spark):
    docs = table(spark, ["a b c d e f g", None, "", "A b c d e f g"])
    twice = docs.union(docs).union(docs.selectExpr("cast(null as long)", "text", "lang", "source", "n_chars", "row_id"))
    got = sorted((r.doc, r.root.doc, r.n) for r in J.linked(twice).collect())
    least = J.LEAST
    assert got == sorted([(0, least, 3), (0, least, 3), (3, least, 3), (3, least, 3), (1, 1, 0), (1, 1, 0), (2, 2, 0), (2, 2, 0), (least, least, 3), (least, least, 3), (least, least, 0), (least, least, 0)])
    assert J.linked(docs.limit(0)).count() == 0
    assert J.deduplicated(docs.limit(0)).count() == 0


def test_cells_are_bounded_and_let_all_queries_meet(spark):
    """Queries of a large gathering, here 9 in 10 rows, went to each of its tasks all together."""
    n, most = 400, 40
    rows = spark.range(n).selectExpr("cast(1 as long) as cdoc", "cast(0 as long) as cth", f"cast({n // most} as int) as chunks", "id as doc", "cast(0 as long) as th", "1 as size", "id % 10 != 0 as query")
    met, held = set(), {}
    got = J.cells(rows, J.F.col("size"), most).collect()
    for r in got:
        held.setdefault(r.chunk, []).append(r)
    for cell in held.values():
        assert len({r.doc for r in cell}) == len(cell) < 3 * most
        met |= {(q.doc, r.doc) for q in cell if q.query for r in cell if r.doc != q.doc}
    assert met == {(a, b) for a in range(n) if a % 10 for b in range(n) if a != b}


def test_points_decide_in_large_gatherings_too(spark, monkeypatch):
    """Texts that share a passage of a quarter and little else, but for two: all of a gathering beyond POINTS_HELD went on."""
    monkeypatch.setattr(J, "POINTS_HELD", 1000)
    r = random.Random(2)
    passage = [f"p{i}" for i in range(20)]
    own = [[f"o{r.randrange(10 ** 6)}" for _ in range(60)] for _ in range(40)]
    own[31] = own[7][:-1] + ["else"]
    texts = [" ".join(passage + w) for w in own]
    docs, _ = J.identified(table(spark, texts))
    points = J.sizes(docs, J.SHINGLE, J.GROUPS)
    members = points.selectExpr("cast(0 as long) as cdoc", "cast(0 as long) as cth", "doc", "th", "cast(n as int) as size")
    assert rows(J.staying(members, points.select("doc", "th", "point"), J.NUM, J.DEN, J.GROUPS), "doc") == [(7,), (31,)]
    assert sorted((r.doc, r.n, r.root.doc) for r in J.linked(table(spark, texts)).collect()) == brute(texts)
