"""N-gram Jaccard join by signature trees.

Words are lower-cased (A-Z) and separated by white space; a document's set holds its distinct
four-word shingles, or its whole word sequence if that is shorter. Two documents link when their
sets overlap in 85 % of their union (the pipeline's stage: five words and 80 %). Links are exact up to equal 64-bit hashes of shingles; result
rows carry the smallest doc_id that is reachable by links.

1. Documents with equal sets are one class, which its smallest doc_id stands for.
2. All shingles have one order: those found in many documents last, then by hash. Linked sets share
   one of their first p = n - ceil(0.85 n) + 1 shingles, and p // 2 + 1 of their first p + p // 2
   (one if p is 2, as the other set's p can be 1).
   Those are dealt to buckets by hash as packed arrays; a class with too few that anyone else has
   is alone. Of the others, those that share one of the first p shingles are put into one pool,
   by an edge from each to the smallest of the shingle: no pairs are made.
3. A pool beyond BLOCK_BYTES is cut into blocks of sets of close size. A block becomes a signature tree:
   nodes hold OR-combined bitmaps of shingles, size ranges and the least number of set bits. Two
   trees are traversed together; a pair of nodes is dropped when even the largest possible overlap
   is too small, or when everything below is linked already. Pairs of sets that are left are compared
   exactly, and only links that join two groups are reported.
4. Blocks of one pool meet each other in pairs, unless the bounds of their roots exclude it or they
   are one group already. Each block also holds the pool's smallest set, so large families of near
   copies are mostly one group before that.

The table of frequent shingles holds those in at least SHARE of all documents, and there can be no
more than (mean set size / SHARE) of them; it changes the order and so the speed, never the result.

Null and empty texts have an empty set and stay alone. Repeated rows fall into the same class.
Further columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import (
    BYTE_CODES, broadcast_if_small, by_row, components, mixed, own_ids, park, prefix_sums, read, slices, stretch_hashes, texts_of, word_bounds,
)
from tidemark.session import pin

SHINGLE, PERCENT = 4, 85
STAGE_SHINGLE, STAGE_PERCENT = 5, 80
SHARE, LEAST_FREQUENT = 0.001, 64
BLOCK_BYTES, FAN, BITS = 96 << 20, 16, 2048
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TOKENS = 3_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a run of texts, ordered by text and hash, and each text's first."""
    starts, ends, first = word_bounds(data, offsets)
    words = stretch_hashes(prefix_sums(BYTE_CODES[_LOWER[data]]), starts, ends)
    texts = len(offsets) - 1
    n = np.diff(first)
    text = np.repeat(np.arange(texts), n)
    odd = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * i & (1 << 64) - 1 | 1) for i in range(shingle)]
    with np.errstate(over="ignore"):
        whole = max(0, len(words) - shingle + 1)
        h = sum((words[i : i + whole] * odd[i] for i in range(shingle)), np.zeros(whole, np.uint64))
        inside = text[:whole] == text[shingle - 1 :][:whole] if whole else np.zeros(0, bool)
        hashes, owner = [mixed(h[inside])], [text[:whole][inside]]
        for k in range(1, shingle):
            short = first[:-1][n == k]
            value = sum((words[short + i] * odd[i] for i in range(k)), np.full(len(short), k, np.uint64))
            hashes.append(mixed(value))
            owner.append(np.flatnonzero(n == k))
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(texts + 1))


def _survey(shingle: int):
    """A row for each document: its set's size and two sums that name the set. Beside them, in rows
    without a size, shingles that four or more documents of this partition hold."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= 4
            return rows(pa.nulls(int(some.sum()), pa.int64()), None, values[some], counts[some].astype(np.uint64))

        def rows(ids, n, s1, s2) -> pa.RecordBatch:
            sizes = pa.nulls(len(ids), pa.int64()) if n is None else pa.array(n.astype(np.int64))
            return pa.RecordBatch.from_arrays(
                [ids, sizes, pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))], names=["doc_id", "n", "s1", "s2"]
            )

        for batch in arrow:
            for at, end, data, offsets in slices(batch.column(1)):
                hashes, first = shingle_sets(data, offsets, shingle)
                n = np.diff(first)
                full = np.flatnonzero(n)
                s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(full):
                    with np.errstate(over="ignore"):
                        s1[full] = np.add.reduceat(hashes, first[full])
                        s2[full] = np.add.reduceat(mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first[full])
                yield rows(batch.column(0).slice(at, end - at), n, s1, s2)
                held.append(hashes)
                total += len(hashes)
                if total > _TOKENS:
                    yield frequent()
                    held, total = [], 0
        if held:
            yield frequent()

    return run


def prefix_length(n, percent=PERCENT):
    """Linked sets share one of so many first shingles; of `extra` more, they share as many more."""
    return n - -(-percent * n // 100) + 1


def extra_length(n, percent=PERCENT):
    return prefix_length(n, percent) // 2


def _ordered(hashes: np.ndarray, first: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's shingles with the frequent ones last: hashes, whether frequent, and places in the text."""
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    rank = np.zeros(len(hashes), bool)
    if len(late):
        place = np.searchsorted(late, hashes)
        place[place == len(late)] = 0
        rank = late[place] == hashes
    order = np.lexsort((hashes, rank, owner))
    return hashes[order], rank[order], np.arange(len(hashes)) - np.repeat(first[:-1], n)


def _steps(ids: np.ndarray) -> bytes:
    return np.diff(ids.astype(np.int64), prepend=0).tobytes()


def _unsteps(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.int64))


_PACKED = "bucket long, keys binary, docs binary"


def _packed_batch(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "keys", "docs"])


def _packed(shared, buckets: int, shingle: int, percent: int):
    """First shingles dealt to buckets, as packed arrays: 32 bits of the hashes and their documents, as steps.

    In a bucket these bits nearly always tell hashes apart; two that are taken for one make a candidate more, never
    one less. Frequent shingles are known to be shared, so they are only counted (`bucket` below 0, and counts
    in place of the hashes).
    """

    def row(bucket, keys, docs):
        return (bucket, keys.tobytes(), _steps(docs))

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for batch in arrow:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for at, end, data, offsets in slices(batch.column(1), 4 << 20):
                hashes, first = shingle_sets(data, offsets, shingle)
                n, ids = np.diff(first), every[at:end]
                owner = np.repeat(np.arange(len(n)), n)
                hashes, known, place = _ordered(hashes, first, late)
                take = place < (prefix_length(n, percent) + extra_length(n, percent))[owner]
                known_count = np.bincount(owner[take & known], minlength=len(n))
                some = np.flatnonzero(known_count)
                out = [row(-1 - int(hashes[0] % np.uint64(buckets)) if len(hashes) else -1, known_count[some], ids[some])]
                take &= ~known
                h, o = hashes[take], owner[take]
                bucket = (mixed(h) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                h, o, bucket = h[order], o[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    out.append(row(int(bucket[a]), h[a:b].astype(np.uint32), ids[o[a:b]]))
                yield _packed_batch(out)

    return run


def _shared_counts(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, c): how many of a document's first shingles another document has among its own."""
    keys, docs, out = [], [], []
    for batch in arrow:
        for bucket, k, d in zip(*(c.to_pylist() for c in batch.columns)):
            d = _unsteps(d)
            if bucket < 0:
                out.append((d, np.frombuffer(k, np.int64)))
            else:
                keys.append(np.frombuffer(k, np.uint32) | np.uint64(bucket << 32))
                docs.append(d)
    if keys:
        keys, docs = np.concatenate(keys), np.concatenate(docs)
        _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
        out.append(np.unique(docs[counts[back] > 1], return_counts=True))
    for d, c in out:
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(c)], names=["doc_id", "c"])


def _sets(shared, shingle: int, percent: int):
    """(doc_id, n, first shingles, sorted hashes as bytes)."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for at, end, data, offsets in slices(batch.column(1)):
                hashes, first = shingle_sets(data, offsets, shingle)
                bounds, n = first.tolist(), np.diff(first)
                ordered, _, place = _ordered(hashes, first, shared.value)
                take = prefix_length(n, percent)
                tokens = ordered[place < np.repeat(take, n)].view(np.int64)
                at_list = pa.array(np.concatenate([[0], np.cumsum(np.minimum(take, n))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, end - at), pa.array(n.astype(np.int64)),
                        pa.ListArray.from_arrays(at_list, pa.array(tokens)),
                        pa.array([hashes[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                    ],
                    names=["doc_id", "n", "first", "hashes"],
                )

    return run


def bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    bits[(hashes % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


class Tree:
    """Levels of nodes over sets sorted by size; level 0 are the sets."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray):
        bits = np.bitwise_count(bitmaps).sum(axis=1).astype(np.int64)
        self.levels = [(bitmaps, sizes, sizes, bits)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, least = self.levels[-1]
            at = np.arange(0, len(maps), FAN)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                    np.minimum.reduceat(least, at),
                )
            )

    def children(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * FAN, min((node + 1) * FAN, len(self.levels[level - 1][0])))


def possible(a, i: np.ndarray, b, j: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs of nodes (i of level a) x (j of level b) can hold a link, by the largest overlap."""
    shared = np.bitwise_count(a[0][i][:, None, :] & b[0][j][None, :, :]).sum(axis=2).astype(np.int64)
    # A set of a has at least its bits outside the other side's OR as shingles that it does not share.
    top_a = a[2][i][:, None] - np.maximum(0, a[3][i][:, None] - shared)
    top_b = b[2][j][None, :] - np.maximum(0, b[3][j][None, :] - shared)
    top = np.minimum(np.minimum(top_a, top_b), np.minimum(a[2][i][:, None], b[2][j][None, :]))
    # overlap >= t (x + y) / (1 + t) for a link of sizes x and y
    return top * (100 + percent) >= percent * (a[1][i][:, None] + b[1][j][None, :])


class Groups:
    def __init__(self, labels: np.ndarray):
        """Sets with equal labels are linked already."""
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels.tolist())]

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def tree_links(
    sets: list[np.ndarray], labels: np.ndarray, side: np.ndarray | None = None, percent: int = PERCENT
) -> list[tuple[int, int]]:
    """Links that join two groups, by dual traversal. With `side`, only pairs from different sides are compared."""
    sizes = np.array([len(s) for s in sets])
    maps = np.stack([bitmap(s) for s in sets])
    groups, out = Groups(labels), []
    parts = [np.arange(len(sets))] if side is None else [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
    parts = [p[np.lexsort((maps[p, 0], sizes[p]))] for p in parts]
    trees = [Tree(maps[p], sizes[p]) for p in parts]
    one, two, left, right = parts[0], parts[-1], trees[0], trees[-1]
    same = side is None
    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        if la == 0 and lb == 0:
            x, y = int(one[i]), int(two[j])
            if groups.top(x) != groups.top(y):
                a, b = sets[x], sets[y]
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    groups.up[groups.top(y)] = groups.top(x)
                    out.append((x, y))
            continue
        down_a = left.children(la, i) if la else np.array([i])
        down_b = right.children(lb, j) if lb else np.array([j])
        na, nb = max(0, la - 1), max(0, lb - 1)
        good = possible(left.levels[na], down_a, right.levels[nb], down_b, percent)
        if same and la == lb:
            good &= down_a[:, None] <= down_b[None, :] if na else down_a[:, None] < down_b[None, :]
        if na == 0 and nb == 0:
            ga = np.array([groups.top(int(one[k])) for k in down_a])
            gb = np.array([groups.top(int(two[k])) for k in down_b])
            good &= ga[:, None] != gb[None, :]
        p, q = np.nonzero(good)
        stack += [(na, x, nb, y) for x, y in zip(down_a[p].tolist(), down_b[q].tolist())]
    return out


_LINKS = "a long, b long"


def _grouped(arrow: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups from batches sorted by `key`."""
    held: list[pa.Table] = []
    last = None
    for batch in arrow:
        table = pa.Table.from_batches([batch])
        keys = table.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and keys[a] != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.concat_tables(held)


def _linked(two_sided: bool, percent: int):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(arrow, "task"):
            if len(group) < 2:
                continue
            ids = group.column("doc_id").to_pylist()
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("hashes")]
            side = group.column("side").to_numpy() if two_sided else None
            if side is not None and len(set(side.tolist())) < 2:
                continue
            found = tree_links(sets, group.column("label").to_numpy(), side, percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[x] for x, _ in found], pa.int64()), pa.array([ids[y] for _, y in found], pa.int64())], names=["a", "b"]
            )

    return run


def _run(rows: DataFrame, two_sided: bool, percent: int) -> DataFrame:
    """rows: task, side, label, doc_id, hashes."""
    rows = rows.select("task", "side", "label", "doc_id", "hashes")
    placed = rows.repartition("task").sortWithinPartitions("task", "side", "doc_id")
    return placed.mapInArrow(_linked(two_sided, percent), _LINKS)


def _blocks(sets: DataFrame, pools: DataFrame, percent: int) -> DataFrame:
    """pools with each set's block: one for a pool of up to BLOCK_BYTES, else by steps of size and by hash."""
    # Sizes a factor 100 / percent apart fall into the same or into neighbouring steps.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9)
    placed = pools.join(sets.select("doc_id", "n"), "doc_id").withColumn("step", step)
    steps = placed.groupBy("pool", "step").agg((F.sum("n") * 8).alias("step_bytes"), F.min("doc_id").alias("step_least"))
    whole = steps.groupBy("pool").agg(F.sum("step_bytes").alias("bytes"), F.min("step_least").alias("least"))
    placed = placed.join(steps.drop("step_least"), ["pool", "step"]).join(whole, "pool")
    large = F.col("bytes") > BLOCK_BYTES
    salt = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("step_bytes") * 4 / BLOCK_BYTES))
    return pin(
        placed.withColumns({"large": large, "salt": F.when(large, salt).otherwise(0), "step": F.when(large, F.col("step")).otherwise(0)})
        .drop("bytes", "step_bytes")
    )


_BLOCK = ["pool", "step", "salt"]


def _within(sets: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Links inside blocks. The blocks of a larger pool also hold the pool's smallest set."""
    task = F.xxhash64(*_BLOCK).alias("task")
    seats = placed.filter("large").select(task, F.col("least").alias("doc_id")).distinct()
    own = placed.select(task, "doc_id").union(seats).distinct()
    own = own.select("task", F.lit(0).alias("side"), F.col("doc_id").alias("label"), "doc_id")
    return pin(_run(sets.select("doc_id", "hashes").join(broadcast_if_small(pin(own)), "doc_id"), False, percent))


def _between(sets: DataFrame, placed: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links between the blocks of a pool, which `links` have not joined yet."""
    groups = components(links).select(F.col("node").alias("doc_id"), "component")
    labelled = pin(placed.join(groups, "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component"))
    nodes = labelled.groupBy(*_BLOCK).agg(F.min("label").alias("g0"), F.max("label").alias("g1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    nodes = pin(nodes)
    a, b = nodes.alias("a"), nodes.alias("b")
    near = (F.col("b.step") == F.col("a.step")) & (F.col("a.salt") < F.col("b.salt")) | (F.col("b.step") == F.col("a.step") + 1)
    close = F.least("a.n1", "b.n1") * 100 >= F.greatest("a.n0", "b.n0") * percent
    one = (F.col("a.g0") == F.col("a.g1")) & (F.col("b.g0") == F.col("b.g1")) & (F.col("a.g0") == F.col("b.g0"))
    pairs = a.join(b, (F.col("a.pool") == F.col("b.pool")) & near & close & ~one).select(
        F.xxhash64("a.pool", "a.step", "a.salt", "b.step", "b.salt").alias("task"), F.col("a.pool").alias("pool"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("a.step").alias("step"), F.col("a.salt").alias("salt")),
            F.struct(F.lit(1).alias("side"), F.col("b.step").alias("step"), F.col("b.salt").alias("salt")),
        )).alias("m"),
    ).select("task", "pool", "m.side", "m.step", "m.salt")
    members = labelled.join(pairs, _BLOCK).select("task", "side", "label", "doc_id")
    return pin(_run(sets.select("doc_id", "hashes").join(broadcast_if_small(pin(members)), "doc_id"), True, percent))


def pool_links(sets: DataFrame, pools: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links within pools, from sets (doc_id, n, hashes) and pools (doc_id, pool).

    Blocks are laid out on ids and sizes; the hashes join last.
    """
    placed = _blocks(sets, pools, percent)
    first = _within(sets, placed, percent)
    large = placed.filter("large")
    return first if large.isEmpty() else first.union(_between(sets, large, first, percent))


def _token_rows(buckets: int):
    """First shingles of candidates dealt to buckets: each once per batch, with the smallest of its documents
    there. The others' edges to that one go on as they are (`bucket` below 0)."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            lists = batch.column(1)
            keys = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            docs = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((docs, keys))
            keys, docs = keys[order], docs[order]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            least = docs[np.flatnonzero(new)][np.cumsum(new) - 1] if len(keys) else docs
            pairs = np.unique(np.stack([least, docs])[:, ~new], axis=1)
            out = []
            if pairs.size:
                out.append((-1 - int(keys[0] % np.uint64(buckets)), pairs[0].tobytes(), _steps(pairs[1])))
            keys, docs = keys[new], docs[new]
            bucket = (mixed(keys) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((docs, bucket))
            keys, docs, bucket = keys[order], docs[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
            out += [(int(bucket[a]), keys[a:b].tobytes(), _steps(docs[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
            if out:
                yield _packed_batch(out)

    return run


def _token_edges(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): from each document to the smallest one that shares a first shingle."""
    keys, docs, edges = [], [], []
    for batch in arrow:
        for bucket, k, d in zip(*(c.to_pylist() for c in batch.columns)):
            d = _unsteps(d)
            if bucket < 0:
                edges.append(np.stack([np.frombuffer(k, np.int64), d]))
            else:
                keys.append(np.frombuffer(k, np.uint64))
                docs.append(d)
    if keys:
        keys, docs = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        least = docs[np.flatnonzero(new)][np.cumsum(new) - 1]
        edges.append(np.stack([least, docs])[:, ~new])
    if edges:
        found = np.unique(np.concatenate(edges, axis=1), axis=1)
        found = found[:, found[0] != found[1]]
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])


def candidates(
    docs: DataFrame, sizes: DataFrame, late, buckets: int, parts: int, shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """doc_ids that can have a link: enough of their first shingles are found in another document too."""
    packed = docs.mapInArrow(_packed(late, buckets, shingle, percent), _PACKED)
    counts = packed.repartition(parts, "bucket").mapInArrow(_shared_counts, "doc_id long, c long").groupBy("doc_id").agg(F.sum("c").alias("c"))
    n = F.col("n")
    prefix = n - F.ceil(n * percent / 100) + 1
    # At a prefix of 2 the other set can have a prefix of 1, and deals out just that shingle.
    least = F.when(prefix <= 2, 1).otherwise(F.floor(prefix / 2) + 1)
    return counts.join(sizes, "doc_id").filter(F.col("c") >= least).select("doc_id")


# Bytes of packed shingles that a task gets on average. There are some buckets to each task, so that they spread.
_PART_BYTES = 32 << 20


def link(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    `percent` is 80 at least: candidates() counts on that for pairs of unequal size. If ids are null or come twice, rows
    are linked by number; a component has the smallest id of its rows then, null if none of them has one.
    """
    rows, own = by_row(docs.select("doc_id", "text"))
    found = _link(rows, shingle, percent)
    if own is None:
        return found
    named = found.join(rows.select("doc_id", own), "doc_id")
    least = named.groupBy("component_id").agg(F.min(own).alias("_least"))
    return named.join(least, "component_id").select(F.col(own).alias("doc_id"), "n_shingles", F.col("_least").alias("component_id"))


def _link(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """link() of rows whose doc_id tells them apart."""
    if percent < STAGE_PERCENT:
        raise ValueError(f"percent {percent} is below {STAGE_PERCENT}")
    docs = texts_of(docs)
    spark = docs.sparkSession
    survey = park(docs.mapInArrow(_survey(shingle), "doc_id long, n long, s1 long, s2 long"))
    every = survey.filter("n IS NOT NULL")
    total, size = every.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = survey.filter("n IS NULL").groupBy("s1").agg(F.sum("s2").alias("m"))
    often = often.filter(F.col("m") >= max(LEAST_FREQUENT, int(SHARE * total))).select("s1").collect()
    late = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in often], np.int64).view(np.uint64)))
    classes = pin(every.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")))
    copies = every.filter("n > 0").join(classes, ["s1", "s2", "n"]).filter("doc_id <> rep").select("doc_id").distinct()
    single = docs.join(broadcast_if_small(pin(copies)), "doc_id", "left_anti")
    parts = max(4, int(size) * 16 * (100 - percent) * 3 // 200 // _PART_BYTES)
    able = pin(candidates(single, classes.select(F.col("rep").alias("doc_id"), "n"), late, parts * 16, parts, shingle, percent))
    own = single.join(broadcast_if_small(able), "doc_id").select("doc_id", "text")
    sets = park(own.mapInArrow(_sets(late, shingle, percent), "doc_id long, n long, first array<long>, hashes binary"))
    edges = sets.select("doc_id", "first").mapInArrow(_token_rows(parts * 16), _PACKED).repartition(parts, "bucket")
    edges = pin(edges.mapInArrow(_token_edges, _LINKS))
    pools = pin(components(edges).select(F.col("component").alias("pool"), F.col("node").alias("doc_id")))
    groups = components(pool_links(sets, pools, percent))
    merged = classes.join(groups, F.col("rep") == F.col("node"), "left")
    merged = merged.select("s1", "s2", "n", F.coalesce("component", "rep").alias("c"))
    found = every.join(merged, ["s1", "s2", "n"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def query(spark, folder: str) -> DataFrame:
    return link(read(spark, folder, "documents"))


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group: the one of smallest doc_id (of the first row, if ids are null or come twice).

    Five words and 80 %, as in decontamination.
    """
    rows, own = by_row(docs)
    found = pin(_link(rows, STAGE_SHINGLE, STAGE_PERCENT).filter("component_id <> doc_id").select("doc_id").distinct())
    return own_ids(rows.join(broadcast_if_small(found), "doc_id", "left_anti"), own, docs.columns)


SQL = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {SHINGLE} THEN w ELSE list_slice(w, i, i + {SHINGLE - 1}) END AS g
  FROM w, unnest(range(1, greatest(2, len(w) - {SHINGLE - 2}))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a) SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(r.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id
"""
