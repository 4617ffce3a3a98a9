"""SentencePiece encoding and decoding with max-plus algebra.

A text is written with the space mark: spaces become it, one is put in front, and the character
itself is kept apart. Its encoding is the path of pieces with the greatest sum of scores; a
character without a piece costs the fallback score and becomes its bytes. Decoding gives back the
text exactly.

No piece has the mark behind another character, so a text up to CHUNK code points is a row of
independent units (marks, then other characters). Units are solved together: one numpy step for
each place in all units of a batch, and a bounded memory of units seen before.

A longer text is cut into chunks of CHUNK code points wherever that falls. Each chunk yields a
matrix: the best score from entering it at offset i to leaving it j past its end. All paths meet at
the marks that begin units, so the whole units inside a chunk add one number; what is before and
behind them, or a chunk without such a mark, is solved in blocks of characters side by side, which are
combined by the associative max-plus product. A text's matrices then give the best state at each
boundary, and every chunk is backtraced by itself between its two states.

Among equal scores, the longest last piece wins within a unit, and the smallest offset at a boundary. Null and empty texts have no pieces. Repeated doc_ids would mix the chunks of long
texts, so each row gets its own number there. Further columns are ignored.

The given model file was built for pair merging; its scores are used here as a unigram lattice, so
the pieces can differ from those that the merge rule picks. Scores of -1e8 and below mark pieces
that are never chosen.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import mixed, park, prefix_sums, read, slices, stretch_hashes, texts_of
from tidemark.session import pin

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, BLOCK = 32_768, 128
CACHED_UNITS, BATCH_CODES = 300_000, 200_000
# The mark stands for a space. Marked texts have no spaces, so a space stands for a mark that the text itself has.
MARK, OWN_MARK = "▁", " "
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_BOUND = re.compile(f"[^{MARK}](?={MARK})")
_NEVER = -1e8
_SWAP = {ord(MARK): OWN_MARK, ord(" "): MARK}
_LOW = -1e300
_SLOT = np.uint64(64 - 21)


class Pieces:
    """Pieces by the hash of their characters, from a model file. Small enough to send to every task."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in ids]
        self.bytes = {int(self.text[i][3:5], 16): i for i in ids if model.is_byte(i)}
        special = {i for i in ids if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.unknown = model.unk_id()
        self.scores = np.array([model.get_score(i) for i in ids])
        usable = [i for i in ids if i not in special and OWN_MARK not in self.text[i]]
        self.fallback = float(min(self.scores[i] for i in usable if self.scores[i] > _NEVER)) - 10
        # A single character stays a piece whatever its score.
        self.scores = np.where(self.scores > _NEVER, self.scores, self.fallback)
        usable = [i for i in usable if model.get_score(i) > _NEVER or len(self.text[i]) == 1]
        self.longest = max(len(self.text[i]) for i in usable)
        if any(MARK in self.text[i].lstrip(MARK) for i in usable):
            raise ValueError("a piece has the space mark inside, so units are not independent")
        codes, at = codes_of("".join(self.text[i] for i in usable)), np.cumsum([0] + [len(self.text[i]) for i in usable])
        keys = stretch_hashes(prefix_sums(code_values(codes)), at[:-1], at[1:])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable, np.int32)[order]
        slot = (self.keys >> _SLOT).astype(np.int64)
        self.slots = np.zeros(1 << 21, np.bool_)
        self.slots[slot] = True
        # Bytes are written as Python's escapes of undecodable bytes, and decoded together at the end.
        self.plain = [t.replace(MARK, " ") for t in self.text]
        for b, i in self.bytes.items():
            self.plain[i] = chr(b) if b < 128 else chr(0xDC00 + b)

    def lookups(self, codes: np.ndarray, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each length and start: the piece there (-1 if none) and its score; lengths in the first axis.

        A single character always has a score: the fallback's, and id -2, if it is no piece.
        `room` says how many characters may be used from each start.
        """
        n = len(codes)
        ids = np.full((self.longest, n), -1, np.int32)
        scores = np.full((self.longest, n), _LOW)
        sums = prefix_sums(code_values(codes))
        for k in range(1, min(self.longest, n) + 1):
            start = np.arange(n - k + 1) if room is None else np.flatnonzero(room[: n - k + 1] >= k)
            h = stretch_hashes(sums, start, start + k)
            maybe = np.flatnonzero(self.slots[(h >> _SLOT).astype(np.int64)])
            at = np.searchsorted(self.keys, h[maybe])
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == h[maybe]
            found = self.ids[at[hit]]
            ids[k - 1, start[maybe[hit]]] = found
            scores[k - 1, start[maybe[hit]]] = self.scores[found]
        none = ids[0] < 0
        ids[0, none], scores[0, none] = -2, self.fallback
        return ids, scores

    def written(self, found: np.ndarray, text: str, starts: np.ndarray) -> list[int]:
        """Piece ids, with fallback characters written as bytes."""
        if (found >= 0).all():
            return found.tolist()
        out = []
        for i, s in zip(found.tolist(), starts.tolist()):
            if i >= 0:
                out.append(i)
            else:
                c = text[s].replace(OWN_MARK, MARK)
                out += [self.bytes.get(b, self.unknown) for b in c.encode("utf-8", "surrogatepass")]
        return out

    def decode(self, ids: list[int]) -> str:
        text = "".join(map(self.plain.__getitem__, ids))[1:]
        return text if text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8")


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def code_values(codes: np.ndarray) -> np.ndarray:
    return mixed(codes.astype(np.uint64) + np.uint64(0x51ED27))


def marked(text: str) -> str:
    if not text:
        return ""
    return MARK + (text.translate(_SWAP) if MARK in text else text.replace(" ", MARK))


def solve_units(pieces: Pieces, units: list[str]) -> tuple[list[bytes], list[float]]:
    """The best path of each unit as packed ids, and its score; all of them advance by one character at a step."""
    out = [b""] * len(units)
    totals = [0.0] * len(units)
    order = sorted(range(len(units)), key=lambda i: -len(units[i]))
    at = 0
    while at < len(order):
        total, end = 0, at
        while end < len(order) and (end == at or total + len(units[order[end]]) <= BATCH_CODES):
            total += len(units[order[end]])
            end += 1
        part = order[at:end]
        at = end
        text = "".join(units[i] for i in part)
        size = np.array([len(units[i]) for i in part])
        first = np.cumsum(size) - size
        room = np.repeat(first + size, size) - np.arange(len(text))
        ids, scores = pieces.lookups(codes_of(text), room)
        node = first + np.arange(len(part))  # a unit has one node more than characters
        best = np.full(len(text) + len(part), _LOW)
        back = np.zeros(len(best), np.int32)
        best[node] = 0.0
        for t in range(1, int(size[0]) + 1 if len(size) else 0):
            n = int(np.searchsorted(-size, -t, "right"))
            top, length = best[node[:n] + t - 1] + scores[0, first[:n] + t - 1], np.ones(n, np.int32)
            for k in range(2, min(t, pieces.longest) + 1):
                value = best[node[:n] + t - k] + scores[k - 1, first[:n] + t - k]
                better = np.flatnonzero(value >= top)
                top[better], length[better] = value[better], k
            best[node[:n] + t], back[node[:n] + t] = top, length
        for i, value in zip(part, best[node + size].tolist()):
            totals[i] = value
        unit, at_end, cuts = np.arange(len(part)), size.copy(), []
        while len(unit):
            k = back[node[unit] + at_end]
            at_end = at_end - k
            cuts.append((unit, at_end, k))
            unit, at_end = unit[at_end > 0], at_end[at_end > 0]
        if not cuts:
            continue
        unit, start, length = (np.concatenate(x) for x in zip(*cuts))
        flat = first[unit] + start
        order_flat = np.argsort(flat)
        flat, length, unit = flat[order_flat], length[order_flat], unit[order_flat]
        found = ids[length - 1, flat]
        ends = np.cumsum(np.bincount(unit, minlength=len(part))).tolist()
        packed, a = found.astype("<i4").tobytes(), 0
        for u, e in enumerate(ends):
            out[part[u]] = packed[4 * a : 4 * e]
            a = e
        for u in np.unique(unit[found < 0]).tolist():
            a = ends[u - 1] if u else 0
            out[part[u]] = np.array(pieces.written(found[a : ends[u]], text, flat[a : ends[u]]), "<i4").tobytes()
    return out, totals


class Encoder:
    """Encodes or scores marked texts unit by unit, and remembers units."""

    def __init__(self, pieces: Pieces, scores: bool = False):
        self.pieces, self.scores, self.known = pieces, scores, {}

    def units(self, rows: list[list[str]]) -> dict:
        """What is known of every unit of the rows."""
        known = self.known
        new = list({u for row in rows for u in row if u not in known})
        if len(known) + len(new) > CACHED_UNITS:
            known.clear()
            new = list({u for row in rows for u in row})
        known.update(zip(new, solve_units(self.pieces, new)[self.scores]))
        return known

    def encode_marked(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text. Units keep theirs packed, so a text costs one step per unit and none per piece."""
        rows = [_UNIT.findall(t) for t in texts]
        known = self.units(rows)
        packed = [b"".join(map(known.__getitem__, row)) for row in rows]
        ends = np.cumsum([0, *map(len, packed)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))

    def encode(self, texts: list[str]) -> pa.ListArray:
        return self.encode_marked([marked(t) for t in texts])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of stacks of matrices."""
    out = np.full(np.broadcast_shapes(a.shape, b.shape), _LOW)
    for k in range(a.shape[-1]):
        np.maximum(out, a[..., :, k, None] + b[..., None, k, :], out=out)
    return np.maximum(out, _LOW)


def identity(n: int) -> np.ndarray:
    out = np.full((n, n), _LOW)
    np.fill_diagonal(out, 0.0)
    return out


def transfer(encoder: Encoder, text: str, size: int) -> np.ndarray:
    """The matrix of the first `size` characters of text, which goes on for `longest` - 1 more if there are any.

    Entry (i, j): the best score of pieces that begin at offset i, each before `size`, and end j
    past it.
    """
    bounds = [m.start() + 1 for m in _BOUND.finditer(text, 0, size)]
    if not bounds:
        return blocks_transfer(encoder.pieces, text, size)
    first, last = bounds[0], bounds[-1]
    head = blocks_transfer(encoder.pieces, text[:first], first)[:, 0]
    units = _UNIT.findall(text[first:last])
    known = encoder.units([units])
    tail = blocks_transfer(encoder.pieces, text[last:], size - last)[0]
    return np.maximum(head[:, None] + sum(known[u] for u in units) + tail[None, :], _LOW)


def blocks_transfer(pieces: Pieces, text: str, size: int) -> np.ndarray:
    """The same by blocks side by side; an offset past a block is handed to the next one."""
    s = pieces.longest
    _, scores = pieces.lookups(codes_of(text))
    blocks = -(-size // BLOCK)
    padded = np.full((s, blocks * BLOCK), _LOW)
    padded[:, : min(size, padded.shape[1])] = scores[:, :size]
    padded = padded.reshape(s, blocks, BLOCK)
    last = size - (blocks - 1) * BLOCK
    best = np.full((blocks, s, BLOCK + s), _LOW)
    best[:, np.arange(s), np.arange(s)] = 0.0
    for t in range(BLOCK if blocks > 1 else last):
        now = best[:, :, t]
        for k in range(1, s + 1):
            np.maximum(best[:, :, t + k], now + padded[k - 1, :, t, None], out=best[:, :, t + k])
    parts = np.maximum(best[:, :, BLOCK : BLOCK + s].copy(), _LOW)
    if last < BLOCK:
        parts[-1] = np.maximum(best[-1, :, last : last + s], _LOW)
        for i in range(s):  # an offset past a short last block passes through it
            if i >= last:
                parts[-1, i] = _LOW
                parts[-1, i, i - last] = 0.0
    while len(parts) > 1:
        if len(parts) % 2:
            parts = np.concatenate([parts, identity(s)[None]])
        parts = product(parts[0::2], parts[1::2])
    return parts[0]


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """The offset at each boundary of a text's best path, from its chunks' matrices: first 0, last 0."""
    vector = np.full(matrices[0].shape[0], _LOW)
    vector[0] = 0.0
    before = []
    for m in matrices:
        before.append(vector)
        vector = np.maximum((vector[:, None] + m).max(axis=0), _LOW)
    states, j = [0], 0
    for v, m in zip(reversed(before), reversed(matrices)):
        j = int(np.argmax(v + m[:, j]))
        states.append(j)
    return states[::-1]


def _encode_short(shared):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in arrow:
            for at, end, _, _ in slices(batch.column(1), 2 << 20):
                texts = batch.column(1).slice(at, end - at).to_pylist()
                found = encoder.encode(texts)
                ids, ends = found.values.to_numpy().tolist(), found.offsets.to_numpy().tolist()
                same = [shared.value.decode(ids[a:b]) == t if a < b else not t for a, b, t in zip(ends, ends[1:], texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), found, pa.array(same)],
                    names=["doc_id", "ids", "round_trip"],
                )

    return run


def _chunks(longest: int):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for doc_id, row, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                whole = marked(text)
                cuts = range(0, len(whole), CHUNK)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id] * len(cuts), pa.int64()), pa.array([row] * len(cuts), pa.int64()),
                        pa.array(range(len(cuts)), pa.int64()),
                        pa.array([min(CHUNK, len(whole) - c) for c in cuts], pa.int64()),
                        pa.array([whole[c : c + CHUNK + longest - 1] for c in cuts], pa.string()),
                    ],
                    names=["doc_id", "row", "chunk", "size", "part"],
                )

    return run


def _matrices(shared):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, scores=True)
        for batch in arrow:
            found = [transfer(encoder, t, n).tobytes() for t, n in zip(batch.column("part").to_pylist(), batch.column("size").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("chunk"), pa.array(found, pa.binary())], names=["row", "chunk", "matrix"]
            )

    return run


def _states(longest: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        found = boundary_states([np.frombuffer(m.as_py()).reshape(longest, longest) for m in table.column("matrix")])
        return pa.table(
            {"row": table.column("row"), "chunk": table.column("chunk"), "enter": pa.array(found[:-1], pa.int64()), "leave": pa.array(found[1:], pa.int64())}
        )

    return run


def _traced(shared):
    """Each chunk's path from where it is entered to where it is left. No better or equal path has a cut
    between the chunk's end and that place, as a boundary takes the smallest offset."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in arrow:
            rows = zip(*(batch.column(c).to_pylist() for c in ("part", "size", "enter", "leave")))
            found = encoder.encode_marked([part[enter : size + leave] for part, size, enter, leave in rows])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), batch.column("chunk"), found],
                names=["doc_id", "row", "chunk", "ids"],
            )

    return run


def _decoded(shared):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            texts = pa.array([shared.value.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("ids"), texts], names=["row", "ids", "decoded"])

    return run


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_pieces, round_trip): the pieces of each text, and whether they decode to it."""
    spark, docs = docs.sparkSession, texts_of(docs)
    shared = spark.sparkContext.broadcast(Pieces(model))  # the vocabulary, about 5 MB
    longest = shared.value.longest
    kind = dict(docs.dtypes)["doc_id"]
    small = docs.filter(F.length("text") < CHUNK).mapInArrow(_encode_short(shared), f"doc_id {kind}, ids array<int>, round_trip boolean")
    large = docs.filter(F.length("text") >= CHUNK)
    numbered = park(large.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "text"))
    chunks = numbered.mapInArrow(_chunks(longest), "doc_id long, row long, chunk long, size long, part string")
    chunks = park(chunks.repartition("row", "chunk"))
    states = chunks.mapInArrow(_matrices(shared), "row long, chunk long, matrix binary")
    states = pin(states.groupBy("row").applyInArrow(_states(longest), "row long, chunk long, enter long, leave long"))
    traced = chunks.join(states, ["row", "chunk"]).mapInArrow(_traced(shared), "doc_id long, row long, chunk long, ids array<int>")
    whole = traced.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("_parts"))
    whole = whole.select("row", F.flatten(F.transform("_parts", lambda x: x["ids"])).alias("ids"))
    decoded = whole.mapInArrow(_decoded(shared), "row long, ids array<int>, decoded string")
    large = numbered.join(decoded, "row").select("doc_id", "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))
    every = small.union(large)
    return every.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip")


def query(spark, folder: str) -> DataFrame:
    return encode(read(spark, folder, "documents"))


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of every document that is left."""
    return encode(docs)
