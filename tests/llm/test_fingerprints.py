import hashlib
import re
from base64 import b64encode

import numpy as np

from lodestone.llm import fingerprints as P

from .common import corpus, rows, table


def encode(texts):
    b = [t.encode() for t in texts]
    return np.frombuffer(b"".join(b), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in b])]).astype(np.int64)


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


M64 = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def then(a, b):
    return mixed(((a ^ (a >> 31)) * 0xC2B2AE3D27D4EB4F + b) & M64)


def word(w):
    h = mixed((len(w) * 0xD6E8FEB86659FD93 + 0x9E3779B97F4A7C15) & M64)
    for k in range(0, len(w), 8):
        h = mixed(((h ^ int.from_bytes(w[k : k + 8], "little")) * 0xC2B2AE3D27D4EB4F + 0x9E3779B97F4A7C15) & M64)
    return h


def one_by_one(text, bins=256, bits=8):
    """The fingerprint in plain integers, shingle by shingle and bin by bin."""
    low = text.encode().lower()
    w = [word(x) for x in re.findall(rb"[^\x20\x09-\x0D]+", low)]
    least = {}
    for s in range(max(1, len(w) - 4)) if w else ():
        part = w[s : s + 5]
        p = 1 << (len(part).bit_length() - 1)

        def tree(x):
            return x[0] if len(x) == 1 else then(tree(x[: len(x) // 2]), tree(x[len(x) // 2 :]))

        h = (then(tree(part[:p]), tree(part[-p:])) + len(part) * 0xD6E8FEB86659FD93) & M64
        at = h >> 56
        least[at] = min(least.get(at, M64), h & ((1 << 56) - 1))
    if not least:
        return ""
    out = []
    for at in range(bins):
        other, turn = at, 0
        while other not in least:
            turn += 1
            other = mixed((at * 0x9E3779B97F4A7C15 + turn) & M64) % bins if len(least) > 1 else next(iter(least))
        out.append(least[other] & ((1 << bits) - 1))
    return b64encode(bytes(out)).decode()


def test_fingerprints_one_by_one(spark):
    texts = [t if t is None else t.replace("é", "e") for t in corpus(8, n=40)] + ["a" * 60, "one", "one two", "One\ttwo", "x y z u v w " * 300]
    got = rows(P.fingerprints(table(spark, texts).withColumnRenamed("source", "fingerprint")), "doc_id", "fingerprint")
    assert [g[1] for g in got] == [one_by_one(t or "") for t in texts]


def test_many_short_and_long_texts(spark):
    docs = spark.range(60_000).selectExpr("id as doc_id", "case when id % 3 = 0 then '' when id % 3 = 1 then 'a' else null end as text").union(spark.createDataFrame([(60_000, "w " * 300_000), (60_001, "z" * 1_000_000)], "doc_id long, text string"))
    got = P.edited_pairs(docs)
    assert got.count() == 60_002 and got.where("fingerprint = ''").count() == 40_000
    assert {(r.doc_id, r.n_chars) for r in got.where("n_chars > 1").collect()} == {(60_000, 600_000), (60_001, 1_000_000)}


def test_edited_pairs(spark):
    texts = corpus(4, n=60)
    docs = table(spark, texts)
    got = rows(P.edited_pairs(docs), "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    plain = [t or "" for t in texts]
    assert len(got) == len(texts)
    for i, n, sha, fp, efp, near, _ in got:
        t, nxt = plain[i], plain[(i + 1) % len(plain)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        assert (n, sha) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        want = P.packed(*P.sketch(*encode([t, edited])))
        assert [fp, efp] == want
        assert abs(near - jaccard(shingles(t), shingles(edited))) < 0.2


def test_estimates_are_unbiased():
    base = [f"t{i}" for i in range(600)]
    errors = []
    for k in range(40):
        other = list(base)
        for j in range(k * 3):
            other[(j * 37 + k) % 600] = f"n{j}-{k}"
        a, b = " ".join(base), " ".join(other)
        s, full = P.sketch(*encode([a, b]))
        errors.append(P.likeness(s[:1], s[1:], full[:1], full[1:])[0] - jaccard(shingles(a), shingles(b)))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.05
    s, full = P.sketch(*encode(["a b c", "a b c", "x y", "", " "]))
    assert (s[0] == s[1]).all() and (s[0] != s[2]).any()
    assert P.packed(s, full)[3:] == ["", ""]
    assert P.likeness(s[[0, 0, 3]], s[[1, 3, 4]], full[[0, 0, 3]], full[[1, 3, 4]]).tolist() == [1.0, 0.0, 1.0]


def test_small_tables(spark):
    one = table(spark, ["just one document here now"])
    assert P.edited_pairs(one).first().near_next == 1.0
    assert P.edited_pairs(one.limit(0)).count() == 0
    twice = one.union(one).union(table(spark, [None]).selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars", "row_id"))
    assert sorted(r.n_chars for r in P.edited_pairs(twice).collect()) == [0, 26, 26]
    assert P.fingerprints(twice).columns[-1] == "fingerprint"
