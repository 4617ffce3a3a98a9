"""Sum-of-squares packing of tokenised documents into sequences of CAPACITY tokens.

A document becomes its token ids and END. Longer ones are cut into pieces of CAPACITY tokens, the
first of which takes the remainder. A whole piece is a sequence of its own. All others are packed:
a piece goes where the sum of squares of N(gap), the number of open sequences with that gap, becomes
smallest; a new sequence is one of the choices, and the smaller gap wins among equals. Longest
pieces come first, so the many short ones at the end close the gaps.

Pieces are dealt at random into groups of about GROUP, each packed by one task. Sequences with at
most SLACK places left are closed; the pieces of the others go into a pool that is dealt out anew
into fewer groups, until one group holds the pool or a round closes less than WORTH of its
pieces. So no task gets more than a group, the driver gets counts, and no piece is lost: the last
round closes everything.

Null and empty texts are one piece with END alone. Repeated rows and repeated or null ids are
packed like any others: a piece is known by the number of its row. Very long texts are only as many
pieces. No documents give no rows. Further columns are ignored.

Token ids are those of the vocabulary file. For texts whose characters are all below U+0250, the file of the same vocabulary as
ranks gives the same ids at several times the speed (a test compares them); all others, and texts that may hold a special
token, go through the vocabulary file itself, as the classes of rarer characters can differ between libraries.
"""

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import batches, park, read, texts_of

CAPACITY, END = 1024, 2
GROUP, SLACK, WORTH = 16_384, 4, 0.1
_RARE = re.compile("[^\\x00-\\u024f]")
_SPECIAL = "<|"
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokens:
    """Token ids of texts as little-endian bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.fast = _ranked() if path == vocabulary() else None

    def encode(self, text: str) -> bytes:
        if self.fast is None or _SPECIAL in text or _RARE.search(text):
            return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def _ranked():
    """The same vocabulary as ranks: the same ids at several times the speed."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of n tokens; only the first may be shorter than the capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    path = path or vocabulary()
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * ids
    schema = _PIECE + (", ids array<int>" if ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, tail = Tokens(path), np.array([end], "<u4").tobytes()
        for batch in arrow:
            for at, stop in batches(batch.column(1), 4 << 20):
                rows = []
                for doc, text in zip(batch.column(0).slice(at, stop - at).to_pylist(), batch.column(1).slice(at, stop - at).to_pylist()):
                    data = tokens.encode(text) + tail
                    for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                        part = data[4 * start : 4 * (start + length)]
                        rows.append((doc, k, start, length, zlib.crc32(part), *([np.frombuffer(part, "<i4")] * ids)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return texts_of(docs).mapInArrow(run, schema)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum-of-squares packing in the given order: sequence and offset of each piece, gap of each sequence.

    From gap g to g - s, the sum changes by 1 - 2 N(g) and by 2 N(g - s) + 1; a sequence that
    becomes full leaves the sum, and a new one only enters it.
    """
    never = np.int64(1) << 40
    open_ = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    owner, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, s in enumerate(lengths.tolist()):
        here = open_[s:capacity]
        change = 2 * (open_[: capacity - s] - here) + 2
        if s < capacity:
            change[0] -= 1  # filled to the end: N(0) does not count
            change[here == 0] = never
            at = int(change.argmin())
        if s < capacity and change[at] <= 2 * open_[capacity - s] + 1:
            gap = s + at
            sequence = waiting[gap].pop()
            open_[gap] -= 1
        else:
            gap, sequence = capacity, len(gaps)
            gaps.append(capacity)
        owner[i], offset[i] = sequence, capacity - gap
        gaps[sequence] = gap - s
        if gap > s:
            open_[gap - s] += 1
            waiting[gap - s].append(sequence)
    return owner, offset, np.array(gaps, np.int64)


def place_all(lengths: np.ndarray, capacity: int, last: bool, slack: int = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (-1: not closed) and offset of each piece, longest first.

    If it is the last group, the pieces of sequences that stay open are packed again as long as that closes any.
    """
    owner, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    rest, made = np.argsort(-lengths, kind="stable"), 0
    while len(rest):
        own, off, gaps = place(lengths[rest], capacity)
        closed = gaps <= slack
        if last and not closed.any():
            closed[:] = True
        done = closed[own]
        owner[rest[done]], offset[rest[done]] = made + own[done], off[done]
        made += len(gaps)
        rest = rest[~done]
        if not last:
            break
    return owner, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, worth: float = WORTH) -> DataFrame:
    """`pieces` with sequence_id and offset. Numbers of sequences are unique, but not consecutive."""
    # The number of a row is fixed by writing it, so that a repeated task deals the same groups.
    known = park(pieces.withColumn("_row", F.monotonically_increasing_id()))
    columns = [c for c in known.columns if c != "_row"]
    whole = known.filter(F.col("length") == capacity).select(
        *columns, F.bitwise_not("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    parts, turn, settle = [whole], 0, False
    pool = known.filter(F.col("length") < capacity)
    kind = f"{', '.join(f'{n} {t}' for n, t in known.dtypes)}, _group int, sequence_id long, offset long"
    while left := pool.count():
        many = -(-left // group)
        last = settle or many == 1
        dealt = pool.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(many)).cast("int"))
        filled = park(dealt.groupBy("_group").applyInArrow(_filler(capacity, last, turn), kind))
        parts.append(filled.filter("sequence_id is not null").select(*columns, "sequence_id", "offset"))
        if last:
            break
        pool, turn = filled.filter("sequence_id is null").select(*known.columns), turn + 1
        settle = pool.count() > (1 - worth) * left
    return reduce(DataFrame.union, parts)


def _filler(capacity: int, last: bool, turn: int):
    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")  # whatever order the shuffle delivered
        owner, offset = place_all(table["length"].to_numpy(), capacity, last)
        number = (np.int64(turn) << 56) | (table["_group"].to_numpy().astype(np.int64) << 24) | owner
        kept = owner < 0
        table = table.append_column("sequence_id", pa.array(number, pa.int64(), mask=kept))
        return table.append_column("offset", pa.array(offset, pa.int64(), mask=kept))

    return fill


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of its pieces in their order, from pieces that carry ids. A sequence is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def query(spark, folder: str) -> DataFrame:
    return pack(tokenize(read(spark, folder, "documents")))
