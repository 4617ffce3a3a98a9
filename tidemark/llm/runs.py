"""Periodic runs of words, found through Lyndon roots.

A run is a stretch of words with a smallest period q, at least max(LEAST, TIMES * q) long, that no
neighbouring word extends. Every run holds, under the order of words or under its reverse, a position
whose longest Lyndon word is as long as the period. So the Lyndon arrays under both orders name all
candidates, and each candidate is extended to both sides by longest common extensions.

The Lyndon arrays come from the first phase of Baier's suffix sorter. Positions start in groups by
word. The greatest group is taken first, each of its members looks for the nearest position on its left
in a smaller group, and positions that were found k times are moved together just above their old
group, with k times the group's word appended. What a position has when its group is taken is its longest
Lyndon word. No suffixes are sorted for it. Extensions compare 64-bit hashes of stretches.

Words are numbered within a batch of texts. Before the grouping, stretches that cannot touch a run are
left out: in a run of period q, each three words but the last q + 2 are found again at most q words later.
For each power of two, only stretches of enough such positions stay, with a margin that takes in the whole run and
its neighbours; so no run is lost.

Words are split at spaces and tab to carriage return, nothing else. Null and empty texts have no words and no
runs. Repeated rows give repeated results, further columns are ignored, an empty table gives none. A text is
held whole by one task; its words are numbered, so memory grows with the longest text only.
"""

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import batches, mixed, prefix_sums, read, stretch_hashes, texts_of

LEAST, TIMES = 6, 4
_BATCH = 4 << 20
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

Run = tuple[int, int, int]


def lyndon_lengths(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each position. Code 0 separates texts: it ends words and has none."""
    n = len(codes)
    members: dict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(codes):
        members[c].append(i)
    members.pop(0, None)
    size = {g: len(m) for g, m in members.items()}
    order = sorted(members)
    below = dict(zip(order, [0, *order]))  # the next smaller group
    above = {g: h for h, g in below.items()}
    group, length = list(codes), [0 if c == 0 else 1 for c in codes]
    taken, left = bytearray(n), list(range(-1, n - 1))
    fresh = (order[-1] if order else 0) + 1
    g = order[-1] if order else 0
    while g:
        own = [i for i in members[g] if group[i] == g] if size[g] else []
        if own:
            word = length[own[0]]
            for i in own:
                taken[i] = 1
            times: dict[int, int] = {}
            for i in own:
                j = left[i]
                while j >= 0 and taken[j]:
                    j = left[j]
                left[i] = j
                if j >= 0 and codes[j]:
                    times[j] = times.get(j, 0) + 1
            moves: dict[tuple[int, int], list[int]] = {}
            for j, k in times.items():
                length[j] += k * word
                moves.setdefault((k, group[j]), []).append(j)
            for k, old in sorted(moves, reverse=True):
                moved = moves[k, old]
                if len(moved) == size[old]:
                    continue  # the whole group, so its place among the others stays
                up = above.get(old)
                below[fresh], above[old] = old, fresh
                if up is not None:
                    below[up], above[fresh] = fresh, up
                members[fresh], size[fresh] = moved, len(moved)
                size[old] -= len(moved)
                for j in moved:
                    group[j] = fresh
                fresh += 1
        g = below[g]
    return length


def _common(sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, sign: int) -> np.ndarray:
    """How far the words from a and from b > a on are equal, to the right (sign 1) or to the left (-1)."""
    got = np.zeros(len(a), np.int64)
    step = 1 << int(most.max(initial=0)).bit_length()
    while step:
        wide = got + step
        ok = np.flatnonzero(wide <= most)
        x, y, w = a[ok], b[ok], wide[ok]
        if sign > 0:
            same = stretch_hashes(sums, x, x + w) == stretch_hashes(sums, y, y + w)
        else:
            same = stretch_hashes(sums, x - w, x) == stretch_hashes(sums, y - w, y)
        got[ok[same]] += step
        step >>= 1
    return got


def lyndon_runs(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of all runs in `codes`, where each 0 separates two texts."""
    n = len(codes)
    top = int(codes.max(initial=0))
    roots = []
    for way in (codes, np.where(codes == 0, 0, top + 1 - codes)):
        period = np.array(lyndon_lengths(way.tolist()), np.int64)
        at = np.flatnonzero(period)
        roots.append(np.stack([at, period[at]]))
    at, period = np.unique(np.concatenate(roots, axis=1), axis=1)
    inside = at + period < n
    at, period = at[inside], period[inside]
    # Separators differ from each other, so that nothing extends across them.
    own = codes.astype(np.uint64)
    own[codes == 0] = np.uint64(top + 1) + np.arange((codes == 0).sum(), dtype=np.uint64)
    sums = prefix_sums(mixed(own + np.uint64(0x9E37)))
    right = _common(sums, at, at + period, n - at - period, 1)
    before = _common(sums, at, at + period, at, -1)
    length = before + period + right
    good = length >= np.maximum(least, times * period)
    return np.unique(np.stack([at - before, length, period])[:, good], axis=1).T


def _next_distance(codes: np.ndarray) -> np.ndarray:
    """Distance to where the three words at each position are found next."""
    h = sum((codes[k : len(codes) - 2 + k].astype(np.uint64) * _STEPS[k] for k in range(3)), np.uint64(0))
    order = np.argsort(mixed(h), kind="stable")
    again = h[order[1:]] == h[order[:-1]]
    out = np.full(len(h), len(codes), np.int64)
    out[order[:-1][again]] = np.diff(order)[again]
    return out


def likely(codes: np.ndarray, least: int, times: int) -> np.ndarray:
    """True where a run can be: all of each run, and its neighbours, are true."""
    n = len(codes)
    marks = np.zeros(n + 1, np.int64)

    def repeated(q: int) -> int:
        return max(least, times * q) - q - 2  # so many positions of each run of period q are found again

    turn = max(1, least // times)  # the fewest are where the two lengths meet
    if n < 3 or times < 2 or min(map(repeated, (1, turn, turn + 1))) < 1:
        return np.ones(n, bool)
    near, most = _next_distance(codes), 1
    while True:
        shortest = most // 2 + 1  # periods of this round are shortest to most
        need = min(repeated(min(max(q, shortest), most)) for q in (1, turn, turn + 1))
        edge = np.diff(np.concatenate([[0], (near <= most).view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long_ = end - start >= need
        np.add.at(marks, np.maximum(start[long_] - 1, 0), 1)
        np.add.at(marks, np.minimum(end[long_] + most + 3, n), -1)
        if times * shortest > n:
            return np.cumsum(marks)[:n] > 0
        most *= 2


def runs_of(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """The runs of each text, given as word numbers from 1 on, by start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    codes = np.zeros(first[-1], np.int64)
    for at, t in zip(first, texts):
        codes[at : at + len(t)] = t
    # Separators must not look like words that come again.
    apart = codes.copy()
    apart[first[1:] - 1] = -1 - np.arange(len(texts))
    stay = np.flatnonzero(likely(apart, least, times) & (codes > 0))
    out: list[list[Run]] = [[] for _ in texts]
    if not len(stay):
        return out
    gap = np.flatnonzero(np.diff(stay) > 1) + 1
    _, dense = np.unique(codes[stay], return_inverse=True)
    short = np.insert(dense + 1, gap, 0)
    source = np.insert(stay, gap, -1)
    for start, length, period in lyndon_runs(short, least, times):
        owner = int(np.searchsorted(first, source[start], "right")) - 1
        out[owner].append((int(source[start] - first[owner]), int(length), int(period)))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that a run repeats, joined by one space."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [w for w, n in zip(words, np.cumsum(edge)[:-1].tolist()) if not n]
    return b" ".join(words)


def find(
    docs: DataFrame, least: int = LEAST, times: int = TIMES, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None
) -> DataFrame:
    """A row per document: doc_id, n_words, runs, and the text without repeated words.

    `prepare` may change a document's words before the search.
    """
    types = [pa.int64(), pa.int64(), pa.list_(_RUN), pa.string()]
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for at, end in batches(batch.column(1), _BATCH):
                ids = batch.column(0).slice(at, end - at).to_pylist()
                # bytes.split() splits at exactly the six spaces of the contract.
                texts = [t.split() for t in batch.column(1).slice(at, end - at).cast(pa.binary()).to_pylist()]
                if prepare:
                    texts = [prepare(i, t) for i, t in zip(ids, texts)]
                number = defaultdict(count(1).__next__)
                codes = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64)
                found = runs_of(np.split(codes, np.cumsum([len(t) for t in texts])[:-1]), least, times)
                columns = (
                    ids, [len(t) for t in texts],
                    [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found],
                    [collapse(t, rs).decode() for t, rs in zip(texts, found)],
                )
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return texts_of(docs).mapInArrow(run, SCHEMA)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the periodic tail that the query plants in a tenth of the documents. A null id plants none."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


def digest(found: DataFrame) -> DataFrame:
    """n_runs, the longest run (ties: smallest start, then period), and digests of all runs and of the kept words."""
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    best = found.withColumn("_best", F.array_min(ranked))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    length = -F.col("_best.n")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), length.alias("length"),
        F.col("_best.period").alias("period"), F.expr("(-_best.n * 1000) div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def query(spark, folder: str) -> DataFrame:
    return digest(find(read(spark, folder, "documents"), prepare=planted))
