"""What the two span finders share: running over Arrow batches, and the digest of spans."""

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import slices, texts_of

Span = tuple[str, int, int]


def joined(spans: list[Span], order: dict[str, int]) -> str:
    """kind:start:end by start, then by the listed order of kinds."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def matches(pattern: re.Pattern, kind: str, text: str, valid: Callable[[re.Match], bool]) -> list[Span]:
    return [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(m)]


def map_texts(docs: DataFrame, schema: str, gate: str, some: Callable[[list], list], none: Callable[[list], list]) -> DataFrame:
    """Rows from (doc_id, text) pairs, a slice of a batch at a time.

    `gate` is a cheap regular expression that every text with a span matches: the others go to
    `none` with their ids only.
    """

    names, types = _columns(schema)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            ids, texts = batch.column(0), batch.column(1)
            for at, end, _, _ in slices(texts, 4 << 20):
                part, own = texts.slice(at, end - at), ids.slice(at, end - at)
                hit = pc.match_substring_regex(part, gate)
                rows = none(own.filter(pc.invert(hit)).to_pylist())
                rows += some(list(zip(own.filter(hit).to_pylist(), part.filter(hit).to_pylist())))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return texts_of(docs).mapInArrow(run, schema)


_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}


def _columns(schema: str) -> tuple[list[str], list[pa.DataType]]:
    pairs = [x.split() for x in schema.split(",")]
    return [n for n, _ in pairs], [_KINDS[t] for _, t in pairs]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
