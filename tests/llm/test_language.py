import collections

import pytest

from lodestone.llm import language as L

from .common import rows, table

SAMPLES = {"en": "the cat and the dog went to the house with this thing ", "de": "der hund und die katze gehen schnell über die straße ", "fr": "le chien et la chatte étaient là où nous étions allés ", "es": "el niño y la señora están en la montaña con años "}


def profile(text, size):
    """The same profile the slow way."""
    table_ = L.symbol_table()
    s = [0]
    for b in text.encode():
        k = int(table_[b])
        if k or s[-1]:
            s.append(k)
    if s[-1] or len(s) == 1:
        s.append(0)
    c = collections.Counter(x for x in s if x)
    c.update(L.SYMBOLS + a * L.SYMBOLS + b for a, b in zip(s, s[1:]))
    c.update(L.SYMBOLS + L.SYMBOLS**2 + (a * L.SYMBOLS + b) * L.SYMBOLS + d for a, b, d in zip(s, s[1:], s[2:]))
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))][:size], c


def test_against_brute_force(spark):
    texts = [SAMPLES[k] * n for k in SAMPLES for n in (1, 2, 9)] + ["Ünd so!", "12 34", "", None, "x" * 9000]
    langs = [k for k in SAMPLES for _ in range(3)] + [None] * 5
    docs = table(spark, texts, langs)
    got = rows(L.predict(docs, L.fit(docs, profile=60), profile=60), "doc_id", "lang_pred", "score")
    trained = {}
    for t, k in zip(texts, langs):
        if k:
            trained.setdefault(k, collections.Counter()).update(profile(t, 60)[1])
    places = {k: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:60])} for k, c in trained.items()}
    for (i, pred, score), t in zip(got, texts):
        if not t or not any(c.isalpha() for c in t):
            assert (pred, score) == ("und", 0.0)
            continue
        mine = profile(t, 60)[0]
        far = {k: sum(abs(p[g] - j) if g in p else 60 for j, g in enumerate(mine)) for k, p in places.items()}
        best = min(sorted(far), key=far.get)
        assert pred == best and score == pytest.approx(1 - far[best] / 60 / len(mine)), i


def test_no_labels_and_empty(spark):
    docs = table(spark, ["some text", None], [None, None])
    assert L.fit(docs) == {}
    assert rows(L.predict(docs, {}), "lang_pred") == [("und",), ("und",)]
    assert L.predict(docs.limit(0), {}).count() == 0


def test_punctuation_beyond_ascii_is_a_boundary(spark):
    texts = ["the\u2014house \u00abthe\u00bb \u2026 the\u3000cat", "the house  the   the cat", "\u00aa", "\u2014\u2026", "日本語", "the " * 500_000]
    docs = table(spark, texts, ["en", "en", None, None, None, None])
    got = rows(L.predict(docs, L.fit(docs)), "doc_id", "lang_pred", "score")
    assert [g[1] for g in got] == ["en", "en", "en", "und", "en", "en"] and got[0][2] == got[1][2] and got[2][2] == 0


def test_repeated_rows_and_null_ids(spark):
    docs = table(spark, ["the house", None], ["en", "en"])
    twice = docs.union(docs).union(docs.selectExpr("cast(null as long)", "text", "lang", "source", "n_chars", "row_id"))
    assert collections.Counter(r.lang_pred for r in L.predict(twice, L.fit(twice)).collect()) == {"en": 3, "und": 3}


def test_extra_columns_stay(spark):
    docs = table(spark, ["the house"], ["en"]).selectExpr("*", "1 as gram", "2 as score")
    assert set(docs.columns) <= set(L.predict(docs, L.fit(docs)).columns)


def test_held_out_accuracy(spark):
    got = L.op1_language_id(spark, "/root/testdata/sf0.01").alias("p").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() > 0.95 * got.count()
