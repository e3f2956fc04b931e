"""Token counts by a linear longest-match automaton.

The vocabulary is a trie.  A node's failure link says where matching goes on once
the tokens decided at that node are popped; only how many they are is stored.
A word's greedy longest-match pieces are thus counted in one pass over its bytes,
and no piece is ever built.  All distinct words of a batch step at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import distinct, in_bytes, parts, word_hashes, words
from .session import bounded, read


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file (tokenizers' JSON), without special tokens."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data.get("added_tokens", [])}
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return [bytes(back[c] for c in piece) for piece in data["model"]["vocab"] if piece not in special]


def automaton(pieces: list[bytes]) -> dict[str, np.ndarray]:
    """The trie's edges as sorted keys node * 256 + byte, with each node's failure link, how many
    tokens it pops, and how many a word that ends there still has.  Every single
    byte counts as a piece, so that any word can be split."""
    children: list[dict[int, int]] = [{}]
    token = [False]
    for piece in sorted({*pieces, *(bytes([b]) for b in range(256))} - {b""}):
        at = 0
        for b in piece:
            if b not in children[at]:
                children[at][b] = len(children)
                children.append({})
                token.append(False)
            at = children[at][b]
        token[at] = True
    n = len(children)
    fail, pops, rest = [0] * n, [0] * n, [0] * n
    level = [0]
    while level:
        nodes = []
        for u in level:
            for b, v in children[u].items():
                nodes.append(v)
                if token[v]:
                    fail[v], pops[v] = 0, 1
                else:
                    z, popped = fail[u], pops[u]
                    while b not in children[z]:
                        popped += pops[z]
                        z = fail[z]
                    fail[v], pops[v] = children[z][b], popped
                rest[v] = pops[v] + rest[fail[v]]
        level = nodes
    edges = sorted((u * 256 + b, v) for u in range(n) for b, v in children[u].items())
    keys, to = np.array(edges, dtype=np.int64).T
    root = np.array([children[0][b] for b in range(256)], dtype=np.int32)
    return {"keys": np.ascontiguousarray(keys), "to": to.astype(np.int32), "root": root, "fail": np.array(fail, np.int32), "pops": np.array(pops, np.int64), "rest": np.array(rest, np.int64)}


#: Words beyond so many bytes are counted one by one.
LONG = 512


def count_long(a: dict, edges: dict[int, int], word: bytes, lead: int | None) -> int:
    """The number of pieces of one word."""
    state = 0 if lead is None else int(a["root"][lead])
    pops, fail, count = a["pops"], a["fail"], 0
    for b in word:
        to = edges.get(state << 8 | b)
        while to is None:
            count += int(pops[state])
            state = int(fail[state])
            to = edges.get(state << 8 | b)
        state = to
    return count + int(a["rest"][state])


def count_pieces(a: dict[str, np.ndarray], raw: np.ndarray, start: np.ndarray, end: np.ndarray, lead: int | None) -> np.ndarray:
    """The number of pieces of each word; `lead` is a byte put before each word."""
    long = np.flatnonzero(end - start > LONG)
    if len(long):
        if "edges" not in a:
            a["edges"] = dict(zip(a["keys"].tolist(), a["to"].tolist(), strict=True))
        out = count_pieces(a, raw, start, np.where(end - start > LONG, start, end), lead)
        out[long] = [count_long(a, a["edges"], raw[start[i] : end[i]].tobytes(), lead) for i in long.tolist()]
        return out
    state = np.zeros(len(start), dtype=np.int64)
    count = np.zeros(len(start), dtype=np.int64)
    if lead is not None:
        state[:] = a["root"][lead]
    order = np.argsort(start - end, kind="stable")  # longest first: those still open are a prefix
    length = (end - start)[order]
    at = start[order]
    live, j = len(order), 0
    while live:
        live = int(np.searchsorted(-length, -j, side="left"))
        if not live:
            break
        byte = raw[at[:live] + j].astype(np.int64)
        todo = np.arange(live)
        while len(todo):
            key = state[todo] * 256 + byte[todo]
            there = np.minimum(np.searchsorted(a["keys"], key), len(a["keys"]) - 1)
            known = a["keys"][there] == key
            state[todo[known]] = a["to"][there[known]]
            todo = todo[~known]
            count[todo] += a["pops"][state[todo]]
            state[todo] = a["fail"][state[todo]]
        j += 1
    count += a["rest"][state]
    out = np.empty_like(count)
    out[order] = count
    return out


def count_tokens(docs: DataFrame, vocabulary_path: str, text: str = "text", lead: bytes = b" ") -> DataFrame:
    """docs' rows with n_words and n_tokens added; columns of these names are replaced, all others stay.

    Words are runs without white space; each is preceded by `lead`, the mark of
    a word's beginning in the vocabulary.  Null and empty texts have none.  Every row is counted, repeated ones as
    often as they occur; a text or a word of any length is counted as a whole; an empty table gives none.
    """
    bounded(docs.sparkSession)
    docs = docs.drop("n_words", "n_tokens")
    sent = docs.sparkSession.sparkContext.broadcast(automaton(vocabulary(vocabulary_path)))
    first = lead[0] if lead else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        for batch in batches:
            for part in parts(batch, text, 4_000_000):
                raw, off = in_bytes(part.column(text))
                start, end, woff = words(raw, off, "space")
                one, which = distinct(raw, start, end, word_hashes(raw, start, end))
                per = count_pieces(a, raw, start[one], end[one], first)[which]
                sums = np.concatenate([[0], np.cumsum(per)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(woff)), pa.array(np.diff(sums[woff]))], names=[*part.schema.names, "n_words", "n_tokens"])

    return docs.mapInArrow(scan, docs.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_tokens")).schema)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, str(public_tokenizers.path("byte_bpe_50k.json"))).select("doc_id", "n_words", "n_tokens")
