"""Repair of conversations: the cheapest edits after which the roles are (system? (user assistant)+)?.

A conversation's rows are taken by turn (nulls first), then role, then text. Each is kept (K), given the role that
is wanted there (R, 3) or deleted (D, 4); messages without text can be inserted (I, 3). Blank and repeated rows have to
be deleted; a truncated row that is not deleted costs 3 more. Among the cheapest edits the letters that come
first in ASCII win.

Viterbi with survivor coalescence: four states (nothing yet, after system, after user, after assistant) each
have one surviving path. The survivors form a tree of back pointers with counted references; a branch
without survivors goes, a node with one branch is merged with it. When all survivors share an ancestor,
the edits up to it are emitted and forgotten, so memory holds only what is unresolved. Equal costs are
decided by the complete unresolved letters of both paths. Neither can begin the other: equal beginnings lead to
equal states, and the rest would only be inserts, which cost.

Conversations of at most SEGMENT rows are streamed through one task each, sorted. A longer one is cut into
segments by its sorted order, so its rows lie in many tasks. Each segment is run from each state that it can be entered in and
gives costs and ranks per pair of states; a short pass over these numbers picks the states between
segments, and each segment then emits its own edits. Only the hash of a repaired conversation, which no one can
compute in parts, is streamed through one task, with the memory of a hash.

Nulls: role and text become one space, a row without conv_id belongs to the conversation null. An empty table gives no rows.
A role counts by its first character. Rows that are equal in everything are repeats of each other. Further columns are ignored.
"""

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import park, read
from tidemark.session import broadcast_if_small, pin

SEGMENT = 10_000
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
# The state after the role that is wanted in each state, and that role.
NEXT = (USER, USER, ASSISTANT, USER)
WANTED = (None, "system", "user", "assistant")
# Inserts that bring each state to an end.
CLOSING = (b"", b"II", b"I", b"")
SPACES = " \t\n\x0b\x0c\r"
OK, BLANK, DUPLICATE, CUT = "ok", "blank", "duplicate", "truncated"
ORDER = ("conv_id", "turn", "role", "text")
EDITS = (
    "conv_id long, segment long, place long, edit string, fault string, turn long, role string, text string, new_role string, cost long"
)
DIGEST = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _columns(schema: str) -> tuple[list[str], list[pa.DataType]]:
    pairs = [x.split() for x in schema.split(", ")]
    return [n for n, _ in pairs], [_TYPES[t] for _, t in pairs]


class Node:
    """Letters from its parent to here; `refs` are the branches behind it, 0 for a survivor's end."""

    __slots__ = ("parent", "letters", "refs")

    def __init__(self, parent: "Node | None", letters: bytes):
        self.parent, self.letters, self.refs = parent, bytearray(letters), []

    def line(self) -> list["Node"]:
        out, at = [self], self.parent
        while at is not None:
            out.append(at)
            at = at.parent
        return out[::-1]


Path = tuple[int, Node, bytes]  # cost, a survivor's end, letters behind it


def better(a: Path | None, b: Path | None) -> Path | None:
    """The cheaper path; of equal ones the one whose letters come first."""
    if a is None or b is None or a[0] != b[0]:
        return b if a is None or b is not None and b[0] < a[0] else a
    if a[1] is b[1]:
        return a if a[2] <= b[2] else b
    one, other = a[1].line(), b[1].line()
    k = 0
    while k < min(len(one), len(other)) and one[k] is other[k]:
        k += 1
    # Survivors' ends are leaves, so both have letters behind the last shared node.
    x, y = one[k].letters, other[k].letters
    if x[0] == y[0]:
        x = b"".join(n.letters for n in one[k:]) + a[2]
        y = b"".join(n.letters for n in other[k:]) + b[2]
    return a if x < y else b


class Survivors:
    """The best path to each state, over rows that come one at a time; `emit` gets letters once they are certain."""

    def __init__(self, entry: int, emit: Callable[[bytes], None]):
        self.root = Node(None, b"")
        self.ends: list[tuple[int, Node] | None] = [None] * 4
        self.ends[entry] = (0, self.root)
        self.emit = emit

    def inserted(self) -> list[Path | None]:
        """The best path to each state if messages may be inserted first."""
        best: list[Path | None] = [None if e is None else (*e, b"") for e in self.ends]
        plus = [None if p is None else (p[0] + INSERT, p[1], b"I") for p in best]
        for state in (START, SYSTEM, ASSISTANT):
            best[USER] = better(best[USER], plus[state])
        if best[USER]:
            cost, node, letters = best[USER]
            best[ASSISTANT] = better(best[ASSISTANT], (cost + INSERT, node, letters + b"I"))
        return best

    def step(self, initial: str, fault: str) -> None:
        wins: list[Path | None] = [None] * 4
        extra = TRUNCATED if fault == CUT else 0
        for state, path in enumerate(self.inserted()):
            if path is None:
                continue
            cost, node, letters = path
            wins[state] = better(wins[state], (cost + DELETE, node, letters + b"D"))
            if fault == BLANK or fault == DUPLICATE:
                continue
            after = NEXT[state]
            if initial == "s" and state == START:
                wins[SYSTEM] = better(wins[SYSTEM], (cost + extra, node, letters + b"K"))
            if initial == WANTED[after][0]:
                wins[after] = better(wins[after], (cost + extra, node, letters + b"K"))
            else:
                wins[after] = better(wins[after], (cost + REROLE + extra, node, letters + b"R"))
        # From after an assistant, all can be done that can be done from the first two states, at a price: a system row
        # that could be kept is deleted. A path that is dearer even so can never win, and would hold memory.
        reach = min((w[0] + more for w, more in ((wins[ASSISTANT], 0), (wins[USER], INSERT)) if w), default=None)
        for state, price in ((START, DELETE), (SYSTEM, 0)):
            if reach is not None and wins[state] and wins[state][0] > reach + price:
                wins[state] = None
        self._follow(wins)

    def _follow(self, wins: list[Path | None]) -> None:
        old = {id(e[1]): e[1] for e in self.ends if e}
        heirs: dict[int, list[int]] = {k: [] for k in old}
        for state, win in enumerate(wins):
            if win:
                heirs[id(win[1])].append(state)
        for key, states in heirs.items():
            node = old[key]
            if len(states) == 1:
                cost, _, letters = wins[states[0]]
                node.letters += letters
                self.ends[states[0]] = (cost, node)
                continue
            for state in states:
                cost, _, letters = wins[state]
                child = Node(node, letters)
                node.refs.append(child)
                self.ends[state] = (cost, child)
        for state, win in enumerate(wins):
            if win is None:
                self.ends[state] = None
        for key, states in heirs.items():
            if not states:
                self._release(old[key])
        self._settle()

    def _release(self, node: Node) -> None:
        """Drop an end that nothing continues, and merge what then has one branch only."""
        parent = node.parent
        if parent is None:
            return
        parent.refs.remove(node)
        if not parent.refs:
            self._release(parent)
        elif len(parent.refs) == 1 and parent is not self.root:
            child = parent.refs[0]
            parent.letters += child.letters
            child.letters, child.parent = parent.letters, parent.parent
            parent.parent.refs[parent.parent.refs.index(parent)] = child

    def _settle(self) -> None:
        if len(self.root.refs) == 1:
            child = self.root.refs[0]
            child.parent, self.root = None, child
        if self.root.letters:
            self.emit(bytes(self.root.letters))
            self.root.letters = bytearray()

    def finish(self) -> int:
        """Emit the rest of the cheapest path that ends well; its cost."""
        best = None
        for state, end in enumerate(self.ends):
            if end:
                closing = CLOSING[state]
                best = better(best, (end[0] + INSERT * len(closing), end[1], closing))
        self.emit(b"".join(n.letters for n in best[1].line()) + best[2])
        return best[0]

    def exits(self) -> Iterator[tuple[int, int, bytes]]:
        """State, cost and unemitted letters of each survivor."""
        for state, end in enumerate(self.ends):
            if end:
                yield state, end[0], b"".join(n.letters for n in end[1].line())


def fault_of(text: str, repeated: bool) -> str:
    bare = text.rstrip(SPACES)
    if not bare:
        return BLANK
    return DUPLICATE if repeated else OK if bare[-1] in ".!?" else CUT


class Editor:
    """Turns letters into edits of the rows that wait for them."""

    def __init__(self, conv_id: int | None, segment: int, state: int):
        self.conv_id, self.segment, self.state, self.place = conv_id, segment, state, 0
        self.rows: deque = deque()  # turn, role, text, fault
        self.out: list[tuple] = []

    def write(self, letters: bytes) -> None:
        for letter in letters.decode():
            row = (None, None, None, None) if letter == "I" else self.rows.popleft()
            turn, role, text, fault = row
            new, cost = None, DELETE
            if letter != "D":
                cost = INSERT if letter == "I" else (REROLE if letter == "R" else 0) + (TRUNCATED if fault == CUT else 0)
                self.state = SYSTEM if letter == "K" and self.state == START and role[0] == "s" else NEXT[self.state]
                new = role if letter == "K" else WANTED[self.state]
            self.out.append((self.conv_id, self.segment, self.place, letter, fault, turn, role, text, new, cost))
            self.place += 1

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _rows(arrow: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in arrow:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _edited(arrow: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Edits of conversations whose sorted rows come one after the other."""
    now, editor, paths, seen = (), None, None, set()
    for conv_id, turn, role, text in _rows(arrow):
        if editor is None or conv_id != now:
            if editor:
                paths.finish()
                yield from editor.taken()
            now, editor, seen = conv_id, Editor(conv_id, 0, START), set()
            paths = Survivors(START, editor.write)
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        fault = fault_of(text, key in seen)
        seen.add(key)
        editor.rows.append((turn, role, text, fault))
        paths.step(role[:1], fault)
        yield from editor.taken()
    if editor:
        paths.finish()
        yield from editor.taken()


class Digest:
    """What the query reports of a conversation, from its edits in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.low, self.high, self.last_turn = conv_id, 0, None, None, None
        self.faults = {BLANK: 0, DUPLICATE: 0, CUT: 0}
        self.illegal, self.initial, self.cost, self.audit = 0, None, 0, bytearray()
        self.sha, self.empty = hashlib.sha256(), True

    def add(self, edit: tuple) -> None:
        _, _, _, letter, fault, turn, role, text, new, cost = edit
        self.audit += letter.encode()
        self.cost += cost
        if letter != "I":
            if turn is not None and turn != self.last_turn:
                self.turns += 1
                self.low = turn if self.low is None else self.low
                self.high = self.last_turn = turn
            if fault in self.faults:
                self.faults[fault] += 1
            if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = role[:1]
        if new is not None:
            self.sha.update((("" if self.empty else "\n") + f"{new}:{text or ''}").encode())
            self.empty = False

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest())


def _digested(edits: Iterator[tuple]) -> Iterator[tuple]:
    now = None
    for edit in edits:
        if now is None or edit[0] != now.conv_id:
            if now:
                yield now.row()
            now = Digest(edit[0])
        now.add(edit)
    if now:
        yield now.row()


def _written(rows: Iterator[tuple], schema: str, size: int = 5_000) -> Iterator[pa.RecordBatch]:
    names, types = _columns(schema)
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _clean(turns: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    return turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))


def _sorted(df: DataFrame) -> DataFrame:
    return df.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def _parts(turns: DataFrame, segment: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of conversations of at most `segment` rows, each in one task and sorted; edits of the longer ones."""
    turns = _clean(turns)
    long_ = pin(turns.groupBy(F.col("conv_id").alias("_long")).count().filter(F.col("count") > segment).select("_long"))
    few = turns
    edits = None
    if not long_.isEmpty():
        which = broadcast_if_small(long_)
        same = F.col("conv_id").eqNullSafe(F.col("_long"))
        few = turns.join(which, same, "left_anti")
        edits = _long_edits(turns.join(which, same, "left_semi"), segment)
    return _sorted(few.repartition("conv_id")), edits


def _repeats(turns: DataFrame) -> DataFrame:
    """Rows with `again`: whether the conversation has the same role and text at an earlier turn."""
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = turns.withColumn("_key", key).withColumn("_conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    first = rows.groupBy("_conv", "_key").agg(
        F.max(F.col("turn").isNull()).alias("_null"), F.min("turn").alias("_low"), F.max("turn").alias("_high")
    )
    first = first.filter("_null and _low is not null or _low < _high").drop("_high")
    again = F.when(F.col("_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("_low"))
    return rows.join(first, ["_conv", "_key"], "left").select(*ORDER, F.coalesce(again, F.lit(False)).alias("again"))


_NUMBERED = "conv_id long, segment long, no long, turn long, role string, text string, fault string"


def _numbered(segment: int):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 33  # ranges and their numbers rise together

        def rows() -> Iterator[tuple]:
            last = None
            for no, (conv_id, turn, role, text, again) in enumerate(_rows(arrow)):
                row = (conv_id, turn, role, text)
                # Rows that are equal in everything stand side by side in one range.
                yield conv_id, part + no // segment, part + no, turn, role, text, fault_of(text, again or row == last)
                last = row

        yield from _written(rows(), _NUMBERED)

    return run


_SUMMARY = "conv_id long, segment long, entry int, exit int, cost long, rank int, letters string"


def _summarise(table: pa.Table) -> pa.Table:
    """Costs, ranks and letters of one segment, between each two states; no inserts behind its last row."""
    table = table.sort_by("no")
    conv_id, segment = table["conv_id"][0].as_py(), table["segment"][0].as_py()
    rows = list(zip(table["initial"].to_pylist(), table["fault"].to_pylist()))
    out = []
    for entry in STATES:
        letters = bytearray()
        paths = Survivors(entry, letters.extend)
        for initial, fault in rows:
            paths.step(initial, fault)
        found = sorted((bytes(letters) + rest, state, cost) for state, cost, rest in paths.exits())
        out += [(conv_id, segment, entry, state, cost, rank, text.decode()) for rank, (text, state, cost) in enumerate(found)]
    names, types = _columns(_SUMMARY)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


_CHOICE = "conv_id long, segment long, entry int, exit int, closing string"


def _stitch(table: pa.Table) -> pa.Table:
    """The states between the segments of one conversation: cheapest in sum, then by the ranks of the letters."""
    hops: dict[int, list[tuple]] = {}
    rows = zip(*(table[c].to_pylist() for c in ("segment", "entry", "exit", "cost", "rank")))
    for segment, entry, state, cost, rank in rows:
        hops.setdefault(segment, []).append((entry, state, cost, rank))
    order = sorted(hops)
    rest = {s: INSERT * len(CLOSING[s]) for s in STATES}
    choice: dict[int, dict[int, int]] = {}
    for segment in reversed(order):
        best: dict[int, tuple] = {}
        for entry, state, cost, rank in hops[segment]:
            if state in rest:
                best[entry] = min(best.get(entry, (1 << 62, 0, 0)), (cost + rest[state], rank, state))
        choice[segment] = {e: b[2] for e, b in best.items()}
        rest = {e: b[0] for e, b in best.items()}
    state, out = START, []
    conv_id = table["conv_id"][0].as_py()
    for segment in order:
        after = choice[segment][state]
        out.append((conv_id, segment, state, after, CLOSING[after].decode() if segment == order[-1] else ""))
        state = after
    names, types = _columns(_CHOICE)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def _apply(rows: pa.Table, chosen: pa.Table) -> pa.Table:
    names, types = _columns(EDITS)
    rows = rows.sort_by("no")
    editor = Editor(rows["conv_id"][0].as_py(), rows["segment"][0].as_py(), chosen["entry"][0].as_py())
    editor.rows.extend(zip(*(rows[c].to_pylist() for c in ("turn", "role", "text", "fault"))))
    editor.write((chosen["letters"][0].as_py() + chosen["closing"][0].as_py()).encode())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*editor.out), types)], names=names)


def _long_edits(turns: DataFrame, segment: int) -> DataFrame:
    """Edits of conversations that are cut into segments of at most `segment` rows."""
    place = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = _repeats(turns).repartitionByRange(*place)
    rows = park(_sorted(rows).mapInArrow(_numbered(segment), _NUMBERED))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("_conv")
    small = rows.select("conv_id", "segment", "no", F.substring("role", 1, 1).alias("initial"), "fault")
    sums = park(small.groupBy(conv, "segment").applyInArrow(_summarise, _SUMMARY))
    choice = sums.drop("letters").groupBy(conv).applyInArrow(_stitch, _CHOICE).withColumn("_conv", conv).drop("conv_id")
    chosen = sums.withColumn("_conv", conv).join(choice, ["_conv", "segment", "entry", "exit"]).drop("_conv")
    return rows.groupBy(conv, "segment").cogroup(chosen.groupBy(conv, "segment")).applyInArrow(_apply, EDITS)


def repair(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """All edits in their order (segment, place): letter, fault, the row's turn, role and text, the role after it.

    The repaired conversation is made of the rows with new_role; an inserted message has no text.
    """
    few, edits = _parts(turns, segment)
    out = few.mapInArrow(lambda arrow: _written(_edited(arrow), EDITS), EDITS)
    return out if edits is None else out.union(edits)


def digest(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row per conversation that has rows: faults, illegal neighbours, cost, letters, hash of the repaired text."""
    few, edits = _parts(turns, segment)
    out = few.mapInArrow(lambda arrow: _written(_digested(_edited(arrow)), DIGEST), DIGEST)
    if edits is None:
        return out
    lines = edits.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "place")
    return out.union(lines.mapInArrow(lambda arrow: _written(_digested(_rows(arrow)), DIGEST), DIGEST))


def _copies() -> tuple[Column, Column]:
    """How a row is damaged, and how often it is there afterwards."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(text[0], F.lit(":"), text[1])) % 20
    return kind, F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)


def damaged(turns: DataFrame) -> DataFrame:
    """The rows with the damage that the query is asked to repair."""
    kind, copies = _copies()
    rows = _clean(turns)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_n"))
    return rows.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_n")))).drop("_n")


def query(spark, folder: str, segment: int = SEGMENT) -> DataFrame:
    turns = read(spark, folder, "conversations")
    none = turns.groupBy("conv_id").agg(F.sum(_copies()[1]).alias("n")).filter("n = 0")
    zero = F.lit(0).cast("long")
    gone = none.select("conv_id", *(zero.alias(c.split()[0]) for c in DIGEST.split(", ")[1:7]), F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    return digest(damaged(turns), segment).union(gone)


SQL = r"""
WITH RECURSIVE known AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ord(k[i])::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS kind
  FROM known
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, (VALUES (1), (2)) t(copy) WHERE copy <= CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), judged AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE 'o' END AS fault
  FROM placed
), insert_before(state, inserts, mid, lines) AS (
  VALUES (0, '', 0, ''), (0, 'I', 2, E'\nuser:'), (0, 'II', 3, E'\nuser:\nassistant:'), (1, '', 1, ''), (1, 'I', 2, E'\nuser:'),
    (1, 'II', 3, E'\nuser:\nassistant:'), (2, '', 2, ''), (2, 'I', 3, E'\nassistant:'), (3, '', 3, ''), (3, 'I', 2, E'\nuser:')
), act(mid, letter, initial, after, role) AS (
  VALUES (0, 'D', NULL, 0, NULL), (1, 'D', NULL, 1, NULL), (2, 'D', NULL, 2, NULL), (3, 'D', NULL, 3, NULL),
    (0, 'K', 's', 1, NULL), (0, 'K', 'u', 2, NULL), (1, 'K', 'u', 2, NULL), (2, 'K', 'a', 3, NULL), (3, 'K', 'u', 2, NULL),
    (0, 'R', NULL, 2, 'user'), (1, 'R', NULL, 2, 'user'), (2, 'R', NULL, 3, 'assistant'), (3, 'R', NULL, 2, 'user')
), path AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, '' AS written FROM (SELECT DISTINCT conv_id FROM damaged)
  UNION ALL
  SELECT conv_id, i, state, cost, audit, written FROM (
    SELECT p.conv_id, p.i + 1 AS i, a.after AS state,
      p.cost + 3 * length(n.inserts) + CASE a.letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
        + CASE WHEN a.letter <> 'D' AND j.fault = 't' THEN 3 ELSE 0 END AS cost,
      p.audit || n.inserts || a.letter AS audit,
      p.written || n.lines || CASE WHEN a.letter = 'D' THEN '' ELSE E'\n' || coalesce(a.role, j.role) || ':' || j.text END AS written
    FROM path p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1
    JOIN insert_before n ON n.state = p.state JOIN act a ON a.mid = n.mid
    WHERE (a.initial IS NULL OR a.initial = j.initial) AND (a.letter = 'D' OR j.fault NOT IN ('b', 'd'))
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1
), finish(state, inserts, lines) AS (
  VALUES (0, '', ''), (1, 'II', E'\nuser:\nassistant:'), (2, 'I', E'\nassistant:'), (3, '', '')
), counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), ended AS (
  SELECT p.conv_id, p.cost + 3 * length(f.inserts) AS cost, p.audit || f.inserts AS audit, substr(p.written || f.lines, 2) AS written
  FROM path p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i JOIN finish f ON f.state = p.state
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + 3 * length(f.inserts), p.audit || f.inserts) = 1
)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(written, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM k.conv_id
"""
