"""Packing: pieces against the tokenizer, places against a plain statement of the rule, gapless sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing

DOCS = "doc_id long, text string, sequence_id string, _row string, length string"
MODEL = Tokenizer.from_file(packing.vocabulary())


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DOCS)


def plain_ids(text):
    return MODEL.encode(text or "", add_special_tokens=False).ids + [packing.END]


def check(rows, texts, capacity=packing.CAPACITY):
    """Every document whole and in order, and every sequence gapless and within its capacity."""
    want = Counter()
    for doc, text in texts:
        ids = plain_ids(text)
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for k, (s, e) in enumerate(zip(starts, starts[1:] + [len(ids)])):
            want[doc, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def texts(seed=3, n=300):
    rng = random.Random(seed)
    out = [(None, "no id"), (None, None), (1, ""), (1, None), (2, "one\n\n  two   \t three's I'll 123456 ...!!"), (3, "é" * 5000)]
    out += [(4, "日本語 текст 𝔘 <|endoftext|> <|"), (5, "a " * 9000), (5, "a " * 9000), (-6, " "), (7, "\x00\x1c x")]
    return out + [(100 + i, " ".join(rng.choice(["red", "Straße", "xyzzyq", "2024", "it's"]) for _ in range(rng.randint(1, 900)))) for i in range(n)]


@pytest.mark.parametrize("group", [16_384, 40])
def test_packs_everything(spark, group):
    rows = packing.pack(packing.tokenize(table(spark, texts())), group=group).collect()
    made = check(rows, texts())
    least = -(-sum(r["length"] for r in rows) // packing.CAPACITY)
    assert made <= least * (1.03 if group > 1000 else 1.15) + 2


def test_empty_table(spark):
    assert packing.pack(packing.tokenize(table(spark, []))).collect() == []


def test_whole_ids_come_back(spark):
    rows = [(i, t) for i, (_, t) in enumerate(texts(n=40))]
    packed = packing.pack(packing.tokenize(table(spark, rows), ids=True))
    found = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    back = defaultdict(list)
    for r in sorted(packed.collect(), key=lambda r: (r["doc_id"], r["piece"])):
        back[r["doc_id"]] += found[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
    assert dict(back) == {i: plain_ids(t) for i, t in rows}


def plain_place(lengths, capacity):
    """All choices, each by its whole sum of squares."""
    gaps, where = [], []
    for s in lengths:
        choices = []
        for gap in sorted({g for g in gaps if g >= s} | {capacity}):
            after = Counter(g for g in gaps if g)
            if gap < capacity:
                after[gap] -= 1
            if gap > s:
                after[gap - s] += 1
            choices.append((sum(v * v for v in after.values()), gap))
        gap = min(choices)[1]
        if gap == capacity:
            gaps.append(capacity - s)
        else:
            gaps[gaps.index(gap)] -= s
        where.append(gap)
    return where, sorted(gaps)


@pytest.mark.parametrize("seed", range(20))
def test_sum_of_squares(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([1, 2, 7, 20]))
    lengths = rng.integers(1, capacity + 1, 120)
    owner, offset, gaps = packing.place(lengths, capacity)
    where, want = plain_place(lengths.tolist(), capacity)
    assert (capacity - offset).tolist() == where and sorted(gaps.tolist()) == want
    assert np.bincount(owner, weights=lengths).tolist() == (capacity - gaps).tolist()


def test_same_places_when_a_task_is_repeated(spark):
    pieces = packing.tokenize(table(spark, texts()))
    a, b = (sorted(packing.pack(pieces, group=64).collect(), key=str) for _ in range(2))
    assert a == b


def test_tokens_are_those_of_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokens = packing.Tokens(packing.vocabulary())
    for r in docs.select("text").collect():
        assert tokens.encode(r["text"] or "") == np.array(plain_ids(r["text"])[:-1], "<u4").tobytes()
