"""Periodic runs against brute force over all periods, Lyndon arrays against their definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import runs
from tidemark.llm.common import read

DOCS = "doc_id long, text string, runs string, start long, collapsed string"
SF = "/root/testdata/sf0.001"


def plain_runs(words, least=6, times=4):
    number = {}
    w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    found = []
    for q in range(1, len(w) // times + 1):
        same = np.concatenate([[0], (w[q:] == w[:-q]).view(np.int8), [0]])
        edge = np.diff(same)
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q):
            smaller = any(q % d == 0 and (w[s + d : e] == w[s : e - d]).all() for d in range(1, q))
            if e - s >= max(least, times * q) and not smaller:
                found.append((int(s), int(e - s), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    """The contract, word for word."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    tell = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{length},{q}\n" for s, length, q in found), " ".join(x for i, x in enumerate(w) if i not in drop))]
    return (doc_id, len(found), *tell, *sha)


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_lyndon_lengths():
    rng = random.Random(1)
    for _ in range(300):
        codes = [0 if rng.random() < 0.1 else rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 30))]
        want = []
        for i, c in enumerate(codes):
            ends = [j for j in range(i + 1, len(codes) + 1) if 0 not in codes[i:j]]
            words = [codes[i:j] for j in ends]
            want.append(max((len(u) for u in words if all(u < u[k:] for k in range(1, len(u)))), default=0))
        assert runs.lyndon_lengths(codes) == want


@pytest.mark.parametrize("least,times", [(6, 4), (1, 2), (6, 3), (2, 2), (10, 5), (1, 3)])
def test_runs_of_texts(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(250):
        texts = []
        for _ in range(rng.randint(1, 5)):
            w = []
            while rng.random() < 0.8:
                root = [rng.randint(1, rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 9))]
                w += (root * rng.randint(1, 7))[: rng.randint(1, 60)]
            texts.append(np.array(w, np.int64))
        assert runs.runs_of(texts, least, times) == [plain_runs(t.tolist(), least, times) for t in texts]


def test_query_is_the_contract(spark):
    docs = read(spark, SF, "documents").select("doc_id", "text").collect()
    assert order(runs.query(spark, SF).collect()) == order(plain_row(*r) for r in docs)


def test_edge_rows(spark):
    long_ = " ".join(f"w{i % 700}" for i in range(40_000))
    texts = [None, "", " \n", "a a a a a", "a a a a a a", "a\x0ba\x0ca\ra\ta\na\x1ca a", "é é é é é é é é", "x " * 5000, long_, long_, "a b a b a b a b c a b"]
    rows = [(i, t, "clash", 5, "clash") for i, t in enumerate(texts)] + [(None, "b " * 9, "r", None, None), (3, "a b c " * 4, "r", 0, "")]
    got = runs.digest(runs.find(spark.createDataFrame(rows, DOCS), prepare=runs.planted)).collect()
    assert order(got) == order(plain_row(r[0], r[1]) for r in rows)
    whole = runs.find(spark.createDataFrame(rows, DOCS)).filter("doc_id = 10").first()
    assert whole["collapsed"] == "a b c a b" and whole["n_words"] == 11 and whole["runs"][0].asDict() == {"start": 0, "length": 8, "period": 2}
    assert runs.digest(runs.find(spark.createDataFrame([], DOCS))).collect() == []
