import json
import random

from lodestone.llm import token_counts as T

from .common import corpus, rows, table, thue_morse


def greedy(word, pieces):
    n, at, longest = 0, 0, max(map(len, pieces))
    while at < len(word):
        at += next((k for k in range(min(longest, len(word) - at), 1, -1) if word[at : at + k] in pieces), 1)
        n += 1
    return n


def split(text):
    return [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]


def test_random_vocabularies():
    import numpy as np

    r = random.Random(5)
    for _ in range(60):
        pieces = {bytes(r.choice(b"abc ") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 40))}
        a = T.automaton(list(pieces))
        words = [bytes(r.choice(b"abcd") for _ in range(r.randint(1, 15))) for _ in range(50)]
        raw = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum([len(w) for w in words])
        start = end - [len(w) for w in words]
        for lead in (None, 0x20):
            got = T.count_pieces(a, raw, start, end, lead)
            assert got.tolist() == [greedy((b"" if lead is None else b" ") + w, pieces) for w in words]


def test_long_words_and_confusing_ones(spark, tmp_path):
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"added_tokens": [], "model": {"vocab": {p: i for i, p in enumerate(["ab", "ba", "abba", "aab", "Ġa"])}}}))
    known = set(T.vocabulary(str(path)))
    x, y = thue_morse(11)
    texts = [x, y, f"{x} {y} {x}", "ab" * 500_000, "b " * 300_000]
    got = rows(T.count_tokens(table(spark, texts), str(path)), "doc_id", "n_words", "n_tokens")
    assert got == [(i, len(split(t)), sum(greedy(b" " + w.encode(), known) for w in split(t))) for i, t in enumerate(texts)]
    twice = table(spark, ["ab", None]).selectExpr("doc_id", "text", "9 as n_words", "8 as state")
    assert rows(T.count_tokens(twice.union(twice), str(path)), "doc_id", "n_words", "state") == [(0, 1, 8), (0, 1, 8), (1, 0, 8), (1, 0, 8)]


def test_documents(spark, tmp_path):
    pieces = ["Ġw1", "w", "Ġ", "1", "w12", "Ġw", "12", "é", "Ã", "Ġx"]
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"added_tokens": [{"content": "<s>"}], "model": {"vocab": {p: i for i, p in enumerate([*pieces, "<s>"])}}}))
    known = set(T.vocabulary(str(path)))
    texts = corpus(8, n=40)
    want = [(i, len(split(t)), sum(greedy(b" " + w.encode(), known) for w in split(t))) for i, t in enumerate(texts)]
    assert rows(T.count_tokens(table(spark, texts), str(path)), "doc_id", "n_words", "n_tokens") == want
    assert T.count_tokens(table(spark, texts).limit(0), str(path)).count() == 0


def test_whole_vocabulary(spark):
    import public_tokenizers

    known = set(T.vocabulary(str(public_tokenizers.path("byte_bpe_50k.json"))))
    assert len(known) == 50256
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect()
    got = {r.doc_id: r.n_tokens for r in T.op3_token_counts(spark, "/root/testdata/sf0.001").collect()}
    for r in docs:
        assert got[r.doc_id] == sum(greedy(b" " + w.encode(), known) for w in split(r.text))
