"""Shared helpers: written intermediate tables, Arrow batches as byte arrays, rolling hashes, components."""

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import broadcast_if_small, pin  # noqa: F401

# Bytes that separate words: space, and tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
WORD_SPACE = "[\\x20\\x09-\\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def texts_of(docs: DataFrame, *extra: str) -> DataFrame:
    """Only doc_id, text (null becomes empty) and `extra`, whatever else the table carries."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def park(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared checkpoint folder, and read it from there.

    Smaller than checkpoint() for texts. The folders go when the driver ends.
    """
    return parked(df)[0]


def parked(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """park(), and a function that removes the folder as soon as nothing reads it any more."""
    spark = df.sparkSession
    pin(spark.range(1))  # makes sure that there is a checkpoint folder
    path = f"{spark.sparkContext.getCheckpointDir()}/park-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def drop() -> None:
        if spark.sparkContext._jsc is not None:
            files.delete(hadoop, True)

    atexit.register(drop)
    return spark.read.schema(df.schema).parquet(path), drop


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """In this block the shuffle files of a step go when the step has ended, not when the driver collects its garbage.

    Only for steps whose results are written (park, pin): a frame that is made here may run once only.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def by_row(docs: DataFrame) -> tuple[DataFrame, str | None]:
    """docs as they are if doc_id tells their rows apart; otherwise written once with row numbers as doc_id.

    The second value names the column that then has the rows' own ids.
    """
    ids = docs.groupBy("doc_id").count()
    if ids.filter("count > 1 OR doc_id IS NULL").isEmpty():
        return docs, None
    own = "_own_doc_id"
    while own in docs.columns:
        own = "_" + own
    numbered = docs.withColumn(own, F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id())
    return park(numbered), own


def own_ids(df: DataFrame, own: str | None, columns: list[str]) -> DataFrame:
    """Undo by_row: the rows' own ids again, and the given columns."""
    if own is None:
        return df.select(columns)
    return df.drop("doc_id").withColumnRenamed(own, "doc_id").select(columns)


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about `limit` bytes: first row, end row, bytes, offsets.

    A longer text makes a run of its own; a text is never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()) if not pa.types.is_binary(column.type) else column.cast(pa.large_binary())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def batches(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    for at, end, _, _ in slices(column, limit):
        yield at, end


_RANDOM = np.random.default_rng(20240229)
BYTE_CODES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        n = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)]))
            _INVERSES = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _INVERSE, np.uint64)]))
    return _POWERS, _INVERSES


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which all bits look random."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """S such that the hash of any stretch of `codes` follows from two of its entries."""
    powers, _ = _powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers[: len(codes)], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, starts, ends) -> np.ndarray:
    """64-bit hash of each stretch [start, end), the same for equal content anywhere."""
    _, inverses = _powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * inverses[: len(sums)][starts])


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of words before it (one entry more)."""
    inside = ~SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]) | inside & edge[:-1]) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, offsets)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that is reachable, for every node that has an edge.

    Alternating large-star and small-star steps until nothing changes. A step sends each edge
    once, a hub is only ever a grouping key of partial minima, and each round is pinned.
    """
    pairs = pin(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    )
    signature = None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        pairs = pin(small.filter("u > v").distinct())
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == signature:
            break
        signature = now
    nodes = pairs.groupBy("u").agg(F.min("v").alias("component"))
    roots = nodes.select(F.col("component").alias("node")).distinct()
    return nodes.select(F.col("u").alias("node"), "component").union(roots.select("node", F.col("node").alias("component")))
