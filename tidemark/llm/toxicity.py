"""Toxicity: a bidirectional gated recurrent network with attention pooling, written in numpy.

Each word enters as a hashed word vector plus the mean of its hashed character-trigram vectors. The
network reads windows of WINDOW words; neighbours overlap, and every window of the whole text is
scored. A document's score is a calibrated function of its largest window logit and of its number
of windows.

Training takes the documents of smallest hash of their id among the labelled rows outside the
held-out fifth: at most SAMPLE of each label, each of at most TRAIN_CHARS characters. A toxic
document is a bag: after the first rounds only its most suspicious window counts as toxic. Training
is seeded, so a repeated run gives the same model. Labels, language, source and id are never inputs.

Null and empty texts, and texts without a letter or digit, score EMPTY_SCORE. Repeated rows give
repeated results; null labels are not used; without a labelled row of each kind all scores are
EMPTY_SCORE. Further columns are ignored.
"""

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.common import prefix_sums, read, slices, stretch_hashes, texts_of
from tidemark.session import pin

# Parameters of the method.
SAMPLE, TRAIN_CHARS = 1500, 8_000
WINDOW, STRIDE = 32, 24
WORD_ROWS, GRAM_ROWS, DIM, HIDDEN = 8192, 4096, 16, 8
EPOCHS, BAG_EPOCHS, BATCH_BYTES, RATE, DECAY, LEAST_UPDATES = 2, 2, 1 << 15, 0.01, 1e-4, 120
EMPTY_SCORE = 0.0

_LETTER = np.ones(256, bool)
_LETTER[[c for c in range(128) if not chr(c).isalnum()]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


class Words:
    """The words of a run of texts: hashed rows, trigram rows, and the texts' first words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = _LETTER[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(data) else inside
        after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(data) else inside
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        low = _LOWER[data]
        sums = prefix_sums(_CODES[low])
        self.rows = (stretch_hashes(sums, starts, ends) % np.uint64(WORD_ROWS)).astype(np.int32)
        left, right = np.zeros(len(data), np.uint32), np.zeros(len(data), np.uint32)
        left[1:], right[:-1] = low[:-1], low[1:]
        grams = (left * before * np.uint32(961) + low * np.uint32(31) + right * after) * np.uint32(2654435761)
        self.grams = (grams[inside] >> np.uint32(20)).astype(np.int32) % GRAM_ROWS
        self.lengths = (ends - starts).astype(np.float32)
        self.at = np.concatenate([[0], np.cumsum(ends - starts)])[:-1]
        self.first = np.searchsorted(starts, offsets)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and length of every window, and the text it belongs to."""
        n = np.diff(self.first)
        count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)))
        text = np.repeat(np.arange(len(n)), count)
        number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start = self.first[:-1][text] + number * STRIDE
        return start, np.minimum(WINDOW, self.first[1:][text] - start), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        h = HIDDEN
        self.p = {
            "word": normal(WORD_ROWS, DIM, scale=0.1), "gram": normal(GRAM_ROWS, DIM, scale=0.1),
            "in": normal(DIM, 6 * h, scale=0.4), "bias": np.zeros(6 * h, np.float32),
            "rec0": normal(h, 3 * h, scale=0.3), "rec1": normal(h, 3 * h, scale=0.3),
            "att": normal(2 * h, h, scale=0.3), "query": normal(h, scale=0.3),
            "out": normal(2 * h, scale=0.3), "shift": np.full(1, -1.0, np.float32),
        }
        self.calibration = np.array([1.0, 0.0, 0.0])

    def inputs(self, words: Words, keep: np.ndarray | None = None) -> np.ndarray:
        chars = np.add.reduceat(self.p["gram"][words.grams], words.at, axis=0) if len(words.at) else np.zeros((0, DIM), np.float32)
        return self.p["word"][words.rows] + chars / words.lengths[:, None]

    def forward(self, x: np.ndarray, start: np.ndarray, size: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Logits of windows over the word inputs x."""
        p, h = self.p, HIDDEN
        gates = np.concatenate([x @ p["in"] + p["bias"], np.zeros((1, 6 * h), np.float32)])
        steps = int(size.max()) if len(size) else 0
        inside = np.arange(steps)[:, None] < size
        index = np.where(inside, start + np.arange(steps)[:, None], len(x))
        states = np.zeros((steps, len(start), 2 * h), np.float32)
        parts = {}
        for d in (0, 1):
            now = np.zeros((len(start), h), np.float32)
            rec = p[f"rec{d}"]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g = gates[index[t], 3 * h * d : 3 * h * (d + 1)]
                u = now @ rec
                zr = _sigmoid(g[:, : 2 * h] + u[:, : 2 * h])
                z, r, un = zr[:, :h], zr[:, h:], u[:, 2 * h :]
                n = np.tanh(g[:, 2 * h :] + r * un)
                new = n + z * (now - n)
                if trace is not None:
                    parts[d, t] = (now, z, r, un, n)
                now = new * inside[t][:, None]
                states[t, :, h * d : h * (d + 1)] = now
        keys = np.tanh(states @ p["att"])
        raw = np.where(inside, keys @ p["query"], np.float32(-1e9))
        weight = np.exp(raw - raw.max(axis=0)) if steps else raw
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbk->bk", weight, states)
        if trace is not None:
            trace += [gates, inside, index, states, parts, keys, weight, pooled]
        return pooled @ p["out"] + p["shift"][0]

    def gradients(self, words: Words, start, size, target, weigh) -> tuple[dict, np.ndarray]:
        p, h, trace = self.p, HIDDEN, []
        x = self.inputs(words)
        logits = self.forward(x, start, size, trace)
        gates, inside, index, states, parts, keys, weight, pooled = trace
        g = {k: np.zeros_like(v) for k, v in p.items()}
        top = ((_sigmoid(logits) - target) * weigh / len(start)).astype(np.float32)
        g["out"], g["shift"][0] = top @ pooled, top.sum()
        d_pooled = top[:, None] * p["out"]
        d_weight = np.einsum("bk,tbk->tb", d_pooled, states)
        d_states = weight[:, :, None] * d_pooled
        d_raw = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["query"] = np.einsum("tb,tbh->h", d_raw, keys)
        d_keys = d_raw[:, :, None] * p["query"] * (1 - keys * keys)
        g["att"] = np.einsum("tbk,tbh->kh", states, d_keys)
        d_states = d_states + d_keys @ p["att"].T
        d_gates = np.zeros_like(gates)
        d_steps = np.zeros((*index.shape, 6 * h), np.float32)
        for d in (0, 1):
            carry = np.zeros((len(start), h), np.float32)
            rec = p[f"rec{d}"]
            for t in range(len(states) - 1, -1, -1) if d == 0 else range(len(states)):
                now, z, r, un, n = parts[d, t]
                dh = (d_states[t, :, h * d : h * (d + 1)] + carry) * inside[t][:, None]
                d_n = dh * (1 - z) * (1 - n * n)
                d_z = dh * (now - n) * z * (1 - z)
                d_r = d_n * un * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_n * r], axis=1)
                g[f"rec{d}"] += now.T @ d_u
                carry = dh * z + d_u @ rec.T
                d_g = np.concatenate([d_z, d_r, d_n], axis=1)
                d_steps[t, :, 3 * h * d : 3 * h * (d + 1)] = d_g
        np.add.at(d_gates, index.ravel(), d_steps.reshape(-1, 6 * h))
        d_gates = d_gates[:-1]
        g["in"], g["bias"] = x.T @ d_gates, d_gates.sum(axis=0)
        d_x = d_gates @ p["in"].T
        np.add.at(g["word"], words.rows, d_x)
        own = np.repeat(np.arange(len(words.rows)), words.lengths.astype(int))
        np.add.at(g["gram"], words.grams, (d_x / words.lengths[:, None])[own])
        return g, logits


class Adam:
    def __init__(self, p: dict, rate: float = RATE):
        self.rate = rate
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        fix = np.float32(self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for k in p:
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.001 * (g[k] * g[k] - self.v[k])
            p[k] -= fix * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-8)) + np.float32(self.rate * DECAY) * p[k]


def best_windows(net: Network, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest logit and number of windows of each text, and all logits."""
    start, size, text = words.windows()
    logits = net.forward(net.inputs(words), start, size) if len(start) else np.zeros(0, np.float32)
    best = np.full(len(words.first) - 1, -np.inf)
    np.maximum.at(best, text, logits)
    return best, np.bincount(text, minlength=len(best)), logits


def _features(best: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.stack([best, np.log1p(count), np.ones(len(best))], axis=1)


def calibrate(best: np.ndarray, count: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge."""
    x, w = _features(best, count), np.array([1.0, 0.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + 1e-2 * np.eye(3), x.T @ (q - toxic) + 1e-2 * w)
    return w


def train(texts: list[str], toxic: list[int], prior: float | None = None) -> Network | None:
    """A network fitted to whole texts with 0/1 labels; None unless both occur.

    `prior` is the share of toxic rows where the texts come from, if the sample has another one.
    """
    if len(set(toxic)) < 2:
        return None
    rng, net = np.random.default_rng(5), Network()
    order = rng.permutation(len(texts))
    cut = len(texts) - len(texts) // 5
    runs = _runs([texts[i] for i in order[:cut]], [toxic[i] for i in order[:cut]])
    adam, share = Adam(net.p), max(0.02, float(np.mean(toxic)))
    # A small sample is read again, so that the weights get enough updates.
    again = max(1, -(-LEAST_UPDATES // (EPOCHS * max(1, len(runs)))))
    for epoch in range((EPOCHS + BAG_EPOCHS) * again):
        for i in rng.permutation(len(runs)):
            words, mark = runs[i]
            start, size, text = words.windows()
            if not len(start):
                continue
            target, weigh = mark[text], np.ones(len(text))
            if epoch >= EPOCHS * again:
                best, _, logits = best_windows(net, words)
                weigh = np.where((target == 0) | (logits >= best[text] - 1e-6), 1.0, 0.0)
            g, _ = net.gradients(words, start, size, target, weigh * np.where(target > 0, 0.5 / share, 1.0))
            adam.step(net.p, g)
    # The calibration takes texts that the weights have not seen.
    unseen = _runs([texts[i] for i in order[cut:]], [toxic[i] for i in order[cut:]]) or runs
    found = [best_windows(net, w)[:2] for w, _ in unseen]
    best, count = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    used = count > 0
    net.calibration = calibrate(best[used], count[used], np.concatenate([m for _, m in unseen])[used])
    odds = np.mean(toxic)
    if prior is not None:
        net.calibration[2] += np.log(prior / (1 - prior)) - np.log(odds / (1 - odds))
    return net


def _runs(texts: list[str], toxic: list[int]) -> list[tuple[Words, np.ndarray]]:
    marks = np.array(toxic, float)
    return [(Words(d, o), marks[a:e]) for a, e, d, o in slices(pa.array(texts, pa.string()), BATCH_BYTES)]


def scores(net: Network | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.full(len(offsets) - 1, EMPTY_SCORE)
    if net is None:
        return out
    best, count, _ = best_windows(net, Words(data, offsets))
    used = count > 0
    x = _features(best[used], count[used]) @ net.calibration
    out[used] = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    known = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IN (0, 1)").dropDuplicates(["doc_id"])
    known = pin(known.filter(~held_out(F.col("doc_id"))))
    parts = []
    for mark in (0, 1):
        # SAMPLE rows at most, so the broadcast is bounded; twice as many ids, as some texts are too long.
        ids = known.filter(F.col("toxic") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * SAMPLE)
        own = texts_of(docs).join(F.broadcast(ids), "doc_id").filter((F.length("text") > 0) & (F.length("text") <= TRAIN_CHARS))
        parts.append(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((t, h, i, x) for b in arrow for h, i, x, t in zip(*(c.to_pylist() for c in b.columns)))
        net = train([x for *_, x in rows], [int(t) for t, *_ in rows], prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    # The sample is bounded, so one task takes it; the driver gets the weights only.
    found = parts[0].union(parts[1]).repartition(1).mapInArrow(run, "net binary").collect()
    return pickle.loads(found[0]["net"]) if found else None


def score(docs: DataFrame, net: Network | None, into: str = "_score") -> DataFrame:
    """All columns of docs, and the score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights, under 1 MB

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            parts = [scores(shared.value, d, o) for _, _, d, o in slices(batch.column("text"))]
            found = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, DoubleType())]))


def query(spark, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    kept = score(docs, fit(docs, read(spark, folder, "labels")))
    return kept.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that are not toxic."""
    into = "_score"
    while into in docs.columns:
        into = "_" + into
    return score(docs, fit(docs, read(spark, folder, "labels")), into).filter(F.col(into) < 0.5).drop(into)
