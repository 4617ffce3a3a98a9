"""Secret scans: automata of credential formats, inferred from labelled credentials.

Base spans (assignments, access keys, long hexadecimal runs) are always reported, and their values
are the labelled credentials. A sample of distinct values, those of smallest hash and at most
SAMPLE of them, trains a probabilistic automaton by state merging: a prefix tree over character
classes, in which states merge while a Hoeffding bound finds their futures compatible. Ordinary
long tokens train a second automaton. Every other long token is scored by how much likelier the
first makes its format, per character, and is reported as kind `format` from MARGIN bits.

Null and empty texts have no spans; without a labelled credential nothing is added. Places are code
points, the end excluded. Repeated rows give repeated results; further columns are ignored.
"""

import heapq
import math
import re
import zlib

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import read
from tidemark.llm.spans import Span, joined, map_texts, matches, sha

# The patterns of the base kinds.
ASSIGN = re.compile(
    r"""(?ia:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
ORDER = {k: i for i, k in enumerate(("assign", "access", "hex", "format"))}
# A text with a span has a keyword, a key's prefix, a long hexadecimal run or a long token.
GATE = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[A-Za-z0-9+/_=-]{16}"
# Parameters of the method.
SAMPLE, ALPHA, MARGIN = 400, 0.05, 1.0

def _class(c: str) -> str:
    if "0" <= c <= "9":
        return "d"
    if "a" <= c <= "f":
        return "h"
    if "A" <= c <= "F":
        return "H"
    if "a" <= c <= "z":
        return "l"
    return "u" if "A" <= c <= "Z" else "s"


def symbols(value: str) -> str:
    return "".join(map(_class, value))


class Automaton:
    """States with counts of symbols and of ends; `step[q][symbol]` is (next state, count)."""

    def __init__(self, words: list[str]):
        self.step: list[dict[str, list[int]]] = [{}]
        self.ends = [0]
        for w in words:
            q = 0
            for c in w:
                if c not in self.step[q]:
                    self.step.append({})
                    self.ends.append(0)
                    self.step[q][c] = [len(self.step) - 1, 0]
                edge = self.step[q][c]
                edge[1] += 1
                q = edge[0]
            self.ends[q] += 1

    def total(self, q: int) -> int:
        return self.ends[q] + sum(n for _, n in self.step[q].values())

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        if not n or not m:
            return False
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return abs(a / n - b / m) > bound

    def compatible(self, p: int, q: int) -> bool:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            n, m = self.total(p), self.total(q)
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            for c in self.step[p].keys() | self.step[q].keys():
                x, y = self.step[p].get(c), self.step[q].get(c)
                if self._differ(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y and x[0] != y[0]:
                    stack.append((x[0], y[0]))
        return True

    def fold(self, p: int, q: int) -> None:
        """Add the tree below q to p. q is a tree of its own, so this ends."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            self.ends[p] += self.ends[q]
            for c, (to, n) in self.step[q].items():
                if c in self.step[p]:
                    self.step[p][c][1] += n
                    stack.append((self.step[p][c][0], to))
                else:
                    self.step[p][c] = [to, n]

    def merge(self) -> "Automaton":
        """Red and blue states: a blue state merges into the first compatible red one, or turns red."""
        red, seen = [0], {0}
        while True:
            blue = next(((p, c, to[0]) for p in red for c, to in sorted(self.step[p].items()) if to[0] not in seen), None)
            if blue is None:
                return self
            p, c, q = blue
            into = next((r for r in red if self.compatible(r, q)), None)
            if into is None:
                red.append(q)
                seen.add(q)
            else:
                self.step[p][c][0] = into
                self.fold(into, q)

    def states(self) -> set[int]:
        """The states that are left, from the start."""
        found, stack = {0}, [0]
        while stack:
            for to, _ in self.step[stack.pop()].values():
                if to not in found:
                    found.add(to)
                    stack.append(to)
        return found

    def bits(self, word: str) -> float:
        """log2 likelihood per symbol, with one count shared by the seven outcomes of a state."""
        q, out = 0, 0.0
        for c in word:
            n = self.total(q) if q is not None else 0
            edge = self.step[q].get(c) if q is not None else None
            out += math.log2(((edge[1] if edge else 0) + 1 / 7) / (n + 1))
            q = edge[0] if edge else None
        return out / max(1, len(word))


def base_spans(text: str) -> tuple[list[Span], list[str]]:
    """The spans, and the credentials in them."""
    spans, values = [], []
    for m in ASSIGN.finditer(text):
        if len(m[1]) >= 6:
            spans.append(("assign", m.start(), m.end()))
            values.append(m[1])
    keys = matches(ACCESS, "access", text, lambda m: len(m[0]) >= 20)
    runs = matches(HEX, "hex", text, lambda m: True)
    values += [text[s:e] for _, s, e in keys + runs]
    return spans + keys + runs, values


def _rank(value: str) -> tuple[int, str]:
    return zlib.crc32(value.encode()), value


def candidates(text: str, taken: list[Span], digits: bool = True) -> list[tuple[int, int]]:
    """Long tokens outside the base spans; with `digits`, those of letters and digits."""
    out = []
    for m in CANDIDATE.finditer(text):
        token = m[0]
        if any(s < m.end() and m.start() < e for _, s, e in taken):
            continue
        if not digits or any("0" <= c <= "9" for c in token) and any(c.isalpha() for c in token):
            out.append((m.start(), m.end()))
    return out


def _samples(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Distinct credentials and distinct ordinary long tokens, the SAMPLE of smallest hash of each."""

    def some(pairs):
        rows = {True: set(), False: set()}
        for _, text in pairs:
            spans, values = base_spans(text)
            rows[True].update(values)
            rows[False].update(text[s:e] for s, e in candidates(text, spans, digits=False))
        # The smallest of a slice are enough for the smallest of all.
        return [(k, zlib.crc32(v.encode()), v) for k in rows for v in heapq.nsmallest(SAMPLE, rows[k], key=_rank)]

    found = map_texts(docs, "secret boolean, rank long, value string", GATE, some, lambda ids: []).distinct()
    out = []
    for secret in (True, False):
        least = found.filter(F.col("secret") == secret).orderBy("rank", "value").limit(SAMPLE)
        out.append(sorted(r["value"] for r in least.collect()))
    return out[0], out[1]


def fit(credentials: list[str], ordinary: list[str]) -> tuple[Automaton, Automaton] | None:
    if not credentials:
        return None
    return Automaton([symbols(v) for v in credentials]).merge(), Automaton([symbols(v) for v in ordinary]).merge()


def format_score(models, token: str) -> float:
    word = symbols(token)
    return models[0].bits(word) - models[1].bits(word)


SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_candidates long"
)


def find(docs: DataFrame) -> DataFrame:
    """A row per document: counts and digest of the base spans, and all spans."""
    models = fit(*_samples(docs))
    nothing = sha("")

    def row(doc_id, text: str) -> tuple:
        base, _ = base_spans(text)
        others = candidates(text, base)
        added = [("format", s, e) for s, e in others if models and format_score(models, text[s:e]) >= MARGIN]
        counts = [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        return (doc_id, *counts, sha(joined(base, ORDER)), joined(base + added, ORDER), len(others))

    return map_texts(
        docs, SCHEMA, GATE, lambda pairs: [row(*p) for p in pairs], lambda ids: [(i, 0, 0, 0, nothing, "", 0) for i in ids]
    )


def query(spark, folder: str) -> DataFrame:
    return find(read(spark, folder, "documents"))
