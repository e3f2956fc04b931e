import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id long"


def table(spark, texts, langs=None):
    """Documents with an extra column whose name clashes with internal ones."""
    rows = [(i, t, (langs[i] if langs else "en"), f"s{i % 3}", len(t or ""), 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed, n=60, vocabulary=40, longest=120):
    """Random texts with copies, shared passages, nulls and empty ones."""
    r = random.Random(seed)
    words = [f"w{i}" if i % 5 else f"Ü{i}é" for i in range(vocabulary)]
    gaps = [" ", " ", " ", "\n", "\t ", ", "]
    make = lambda k: "".join(r.choice(words) + r.choice(gaps) for _ in range(k))
    passages = [make(r.randint(15, 60)) for _ in range(3)]
    out = [None, "", "   ", "one", make(8 * longest)]
    while len(out) < n:
        kind = r.random()
        if kind < 0.2 and len(out) > 6:
            out.append(out[r.randrange(4, len(out))])
        elif kind < 0.5:
            out.append(make(r.randint(0, longest)) + r.choice(passages) + make(r.randint(0, longest)))
        elif kind < 0.6 and out[-1]:
            old = out[-1].split(" ")
            old[r.randrange(len(old))] = "changed"
            out.append(" ".join(old))
        else:
            out.append(make(r.randint(0, longest)))
    return out


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def thue_morse(k):
    """Two different words of 2**k letters that sums of powers modulo 2**64 take for equal, for k of 10 and more."""
    word = "a"
    for _ in range(k):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))
