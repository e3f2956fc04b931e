import collections
import math
import re
import zlib

import numpy as np
import pytest

from lodestone.llm import class_lm as M

from .common import corpus, rows, table, thue_morse


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


@pytest.mark.parametrize("listed", [10, 100000])
def test_against_brute_force(spark, listed):
    texts = corpus(6, n=60, vocabulary=200)
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    docs = table(spark, texts)
    model, counts = M.fit(docs.where(docs.doc_id.isin(train)), frequent=8, groups=16, classes=6, listed=listed)
    c = collections.Counter(w for i in train for w in split(texts[i]))
    n, v = sum(c.values()), len(c)
    assert (model.total, model.distinct) == (n, v)
    got = rows(M.score(docs, model, counts), "doc_id", "n_tokens", "n_known", "base_score", "score", "source")
    assert len(got) == len(texts)
    for i, n_tokens, known, base, own, _ in got:
        w = split(texts[i])
        assert (n_tokens, known) == (len(w), sum(c[x] > 0 for x in w))
        assert base == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert own == pytest.approx(log_probability(model, [texts[k] for k in train], split(texts[i]), c), rel=1e-9)


def log_probability(model, training, tokens, c, strength=20):
    """By definition, from the training texts and the units' classes alone."""
    codes = {None: 0}

    def unit(w):
        if w not in codes:
            raw = np.frombuffer(w.encode(), np.uint8)
            code = M.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]
            at = np.flatnonzero(model.codes == code)
            tail = raw[-2:].astype(np.uint64) if len(raw) > 1 else np.array([0, raw[0]], np.uint64)
            group = int(M.mix(np.array([tail[1] * np.uint64(256) + (tail[0] if len(raw) > 1 else tail[1]) + np.uint64(1)]))[0] % np.uint64(model.groups))
            codes[w] = int(model.units[at[0]]) if len(at) else 1 + model.listed + group
        return codes[w]

    of = lambda w: int(model.classes[unit(w)])
    k = len(model.log_class)
    table, single, units, inside = np.zeros((k, k)), np.zeros(k), collections.Counter(), collections.defaultdict(collections.Counter)
    for t in training:
        last = of(None)
        for w in split(t):
            table[last, of(w)] += 1
            last = of(w)
    for w, m in c.items():
        units[unit(w)] += m
        if unit(w) > model.listed:
            inside[unit(w)][w] += m
    size = collections.Counter()
    for u, cls in enumerate(model.classes.tolist()):
        size[cls] += units[u] + 1
    alone = (table.sum(axis=0) + 1) / (table.sum() + k)
    out, last = 0.0, of(None)
    for w in tokens:
        cls, u = of(w), unit(w)
        out += math.log10((table[last, cls] + strength * alone[cls]) / (table[last].sum() + strength))
        out += math.log10((units[u] + 1) / size[cls])
        if u > model.listed:
            out += math.log10((c[w] + 1) / (sum(inside[u].values()) + len(inside[u]) + 1))
        last = cls
    return out


def test_rounds_raise_the_likelihood(spark):
    """Words of two kinds that alternate, most of them too rare for the first step, end in classes of their own."""
    import random

    r = random.Random(2)
    texts = [" ".join(f"{'ab'[k % 2]}{r.randrange(40)}q{r.randrange(3)}" for k in range(60)) for _ in range(80)]
    docs = table(spark, texts)
    model, _ = M.fit(docs, frequent=4, groups=2, classes=4, tolerance=1e-6)
    by = {}
    for kind in "ab":
        for x in range(40):
            for y in range(3):
                w = f"{kind}{x}q{y}".encode()
                code = M.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
                for at in np.flatnonzero(model.codes == code):
                    by.setdefault(kind, []).append(int(model.classes[model.units[at]]))
    assert len(by["a"]) > 100 and not {*by["a"]} & {*by["b"]}


def test_probabilities_sum_to_one(spark):
    texts = corpus(7, n=40, vocabulary=60)
    model, counts = M.fit(table(spark, texts), frequent=5, groups=4, classes=3)
    step, unit = 10**model.log_class, 10**model.log_unit
    assert np.allclose(step.sum(axis=1), 1)
    assert np.allclose(np.bincount(model.classes, weights=unit, minlength=3), 1)
    per = counts.where("grp >= 0").toPandas()
    top = set(model.codes[(model.units > 0) & (model.units <= model.listed)].view(np.int64))
    for g in range(4):
        inside = per[(per.grp == g) & ~per.code.isin(top)]
        mass = (inside.c + 1).sum() + 1  # one for all unseen words
        assert mass == model.group_total[g] + model.group_distinct[g] + 1


def test_exchange_finds_alternation():
    pairs = np.zeros((8, 8))
    for a in (0, 2, 4, 6):
        for b in (1, 3, 5, 7):
            pairs[a, b] = pairs[b, a] = 10 + a + b
    of = M.exchange(pairs, 2)
    assert len({of[0], of[2], of[4], of[6]}) == len({of[1], of[3], of[5], of[7]}) == 1 and of[0] != of[1]


def test_best_class_is_the_one_of_the_highest_likelihood():
    r = np.random.default_rng(4)
    for _ in range(40):
        pairs = r.poisson(0.7, (12, 12)).astype(float)
        pairs[3, 3] = 50
        of = r.integers(0, 4, 12)
        table = lambda c: np.array([[pairs[np.ix_(c == a, c == b)].sum() for b in range(4)] for a in range(4)])  # noqa: B023,E731
        w = int(r.integers(12))
        member = np.eye(4)[of]
        to, after = M.best_class(table(of), of[w], (pairs @ member)[w], (pairs.T @ member)[w], pairs[w, w], 1e-9)
        each = [M.likelihood(table(np.where(np.arange(12) == w, c, of))) for c in range(4)]
        assert each[to] == pytest.approx(max(each)) and np.allclose(after, table(np.where(np.arange(12) == w, to, of)))


def test_exchange_ends_with_one_frequent_pair():
    pairs = np.zeros((259, 259))
    pairs[1, 1], pairs[0, 1], pairs[1, 0], pairs[0, 2], pairs[2, 0] = 99999, 1, 1, 1, 1
    assert len(M.exchange(pairs, 48)) == 259


def test_exchange_ends_when_no_unit_moves():
    """This one is still moving units after eight rounds."""
    pairs = np.random.default_rng(1).poisson(0.5, (120, 120)).astype(float)
    of = M.exchange(pairs, 8)
    assert (of != M.exchange(pairs, 8, rounds=8)).any()
    assert (of == M.exchange(pairs, 8, rounds=1000)).all()


def test_words_that_sums_of_powers_confuse(spark):
    x, y = thue_morse(10)
    model, counts = M.fit(table(spark, [x, "go " * 100_000]))
    assert rows(M.score(table(spark, [x, y, "z" * 1_000_000]), model, counts), "doc_id", "n_tokens", "n_known") == [(0, 2, 2), (1, 2, 1), (2, 2, 1)]


def test_beats_base_held_out_and_handles_empty(spark):
    got = M.op4_lm_scores(spark, "/root/testdata/sf0.001").where("held_out").groupBy().sum("score", "base_score").first()
    assert got[0] > got[1]
    docs = table(spark, ["a b", None])
    model, counts = M.fit(docs.limit(0))
    scored = rows(M.score(docs, model, counts), "doc_id", "n_tokens", "n_known", "base_score")
    assert scored == [(0, 3, 0, 0.0), (1, 1, 0, 0.0)]
    assert M.score(docs.limit(0), *M.fit(docs)).count() == 0
    model, counts = M.fit(docs, listed=0)
    twice = docs.union(docs).union(table(spark, ["b c c"]))
    assert rows(M.score(twice, model, counts), "doc_id", "n_tokens", "n_known") == [(0, 3, 3), (0, 3, 3), (0, 4, 2), (1, 1, 1), (1, 1, 1)]
